"""A query for each operator over the test tables, and its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densigrid.fixtures import (
    EVENTS, FINE, MAPPING, MASKED, ORDER, PRICING, ROLES, SQL_HEADERS, SQL_OBSERVATIONS, TARGET, double, headers, lines, observations, sql_cells, sql_index, table, values,
)
from densigrid.functions import cells
from densigrid.functions.expression import compile_expression
from densigrid.operators import density, grids, masks, occupancy, preview, projection, records, report
from densigrid.plans.grid import Goal
from densigrid.plans.rules import boxes_of, feasible_size, normalised
from densigrid.sources import files, saved, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def keyed(counts: DataFrame) -> DataFrame:
    """Cells as text, which both engines write alike."""
    return counts.withColumn("key", cells.bin_key(F.col("cell"))).drop("cell")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def priced(spark: SparkSession, sf_dir: str, goal: Goal = PRICING, keep: tuple = ("record_id",)) -> DataFrame:
    return occupancy.binned(lines(spark, sf_dir), goal, values(goal), list(keep))


# Sources


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS quantity, CAST(l_discount AS DOUBLE) AS discount FROM lineitem")
def scan_rows(spark, sf_dir):
    df = tables.read_rows(spark, f"{sf_dir}/lineitem.parquet", "parquet")
    return df.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("quantity"), F.col("l_discount").alias("discount"))


@query("SELECT event_type AS key, max(event_id) AS id, arg_max(json_extract_string(props, '$.k'), event_id) AS payload FROM events GROUP BY event_type")
def latest_payload_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    content = F.concat(F.lit('{"key":"'), F.col("event_type"), F.lit('","payload":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return tables.latest_payload(e.select(F.col("event_id").alias("id"), content.alias("content")))


# Scalars

_MIXED = "CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' ' WHEN l_linenumber = 5 THEN 'NaN' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"


@query(f"""SELECT CASE WHEN regexp_full_match(q, '\\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN 'numeric' ELSE 'invalid' END AS status, count(*) AS n,
  round(sum(TRY_CAST(CASE WHEN q LIKE '%N%' OR q LIKE '%n%' THEN NULL ELSE trim(q) END AS DOUBLE)), 3) AS total FROM (SELECT {_MIXED} AS q FROM lineitem) GROUP BY 1""")
def parse_status_counts(spark, sf_dir):
    df = lines(spark, sf_dir).select(F.expr(_MIXED.replace("VARCHAR", "STRING")).alias("q"))
    v = cells.parsed(F.col("q"))
    return df.select(F.when(v.isNull(), "invalid").otherwise("numeric").alias("status"), v.alias("v")).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("v"), 3).alias("total"))


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'{sql_index(a, MAPPING[a.name])} AS {a.name}_bin' for a in PRICING.axes)} FROM lineitem")
def bin_index(spark, sf_dir):
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *[cells.bin_index(a, F.col(MAPPING[a.name])).alias(f"{a.name}_bin") for a in PRICING.axes])


@query("SELECT l_orderkey, l_linenumber, CAST(floor((least(greatest(l_extendedprice, CAST(0 AS DOUBLE)), CAST(100000 AS DOUBLE) - CAST('2.220446049250313e-16' AS DOUBLE)) - CAST(0 AS DOUBLE)) / CAST(10000 AS DOUBLE)) AS INTEGER) AS price_bin FROM lineitem")
def bin_index_clamped(spark, sf_dir):
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", cells.bin_index_clamped(PRICING.axes[1], F.col("l_extendedprice")).alias("price_bin"))


def _grids(spark, sf_dir) -> DataFrame:
    """A goal for each supplier, whose resolutions depend on it: (goal_id, axis, low, high, step)."""
    key = F.col("s_suppkey")
    axes = F.array(*[F.struct(F.lit(a.name).alias("axis"), F.lit(a.low).alias("low"), F.lit(a.high).alias("high"), step.alias("step")) for a, step in zip(PRICING.axes, (F.lit(0.01), 1000.0 * (1 + key % 7), 1.0 + key % 5))])
    return table(spark, sf_dir, "supplier").select(key.alias("goal_id"), F.explode(axes).alias("a")).select("goal_id", "a.*")


_SQL_GRIDS = " UNION ALL ".join(f"SELECT s_suppkey AS goal_id, '{a.name}' AS axis, {double(a.low)} AS low, {double(a.high)} AS high, CAST({step} AS DOUBLE) AS step FROM supplier" for a, step in zip(PRICING.axes, ("0.01", "1000 * (1 + s_suppkey % 7)", "1 + s_suppkey % 5")))
_SQL_BINS = "greatest(1, ceil((high - low) / step))"


@query(f"SELECT goal_id, count(*)::INTEGER AS axes, CAST(product({_SQL_BINS}) AS BIGINT) AS total_bins FROM ({_SQL_GRIDS}) GROUP BY 1")
def total_bins(spark, sf_dir):
    return grids.total_bins(_grids(spark, sf_dir)).withColumn("total_bins", F.col("total_bins").cast("long"))


@query(f"SELECT key, {', '.join(f'round(least({double(a.low)} + (b{k} + 0.5) * {double(a.step)}, {double(a.high)}), 9) AS {a.name}' for k, a in enumerate(PRICING.axes))} FROM (SELECT DISTINCT key, b0, b1, b2 FROM {sql_cells(PRICING)} WHERE status = 'valid')")
def bin_centers(spark, sf_dir):
    counts = occupancy.histogram(priced(spark, sf_dir), PRICING)
    return keyed(counts.select("cell", *[F.round(cells.centre(a, F.col("cell")[k]), 9).alias(a.name) for k, a in enumerate(PRICING.axes)]))


@query("SELECT l_orderkey, l_linenumber, l_discount AS a, l_extendedprice AS b FROM lineitem")
def vector_reorder(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array("l_extendedprice", "l_discount", "l_quantity").alias("v"))
    return df.select("l_orderkey", "l_linenumber", cells.reordered(F.col("v"), ORDER, ["Discount", "price"]).alias("w")).select("l_orderkey", "l_linenumber", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))


@query("SELECT l_suppkey AS record_id, count(*) AS n, round(sum(l_discount), 6) AS total FROM lineitem WHERE l_linenumber NOT IN (3, 5) GROUP BY 1")
def sanitize_vectors(spark, sf_dir):
    odd = F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_discount"))
    v = F.when(F.col("l_linenumber") == 5, F.array(odd)).otherwise(F.array(odd, F.col("l_quantity")))
    good = lines(spark, sf_dir).select("record_id", v.alias("v")).where((F.size("v") == 2) & F.forall("v", lambda x: cells.finite(x).isNotNull()))
    return good.groupBy("record_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v")[0]), 6).alias("total"))


@query("SELECT l_suppkey AS key, sum(l_linenumber - 3)::BIGINT AS cnt FROM lineitem WHERE l_linenumber > 3 GROUP BY 1")
def count_map_normalize(spark, sf_dir):
    raw = lines(spark, sf_dir).select(F.col("l_suppkey").alias("key"), (F.col("l_linenumber") - 3).cast("string").alias("c"))
    return raw.select("key", F.col("c").try_cast("long").alias("cnt")).where("cnt > 0").groupBy("key").agg(F.sum("cnt").alias("cnt"))


@query("SELECT '[' || (l_linenumber - 1) || ',' || CAST(floor(l_quantity / 10) AS INTEGER) || ']' AS key, count(*) AS cnt FROM lineitem WHERE l_linenumber - 1 < 10 AND floor(l_quantity / 10) < 5 AND l_linenumber <> 2 GROUP BY 1")
def bin_key_validate(spark, sf_dir):
    goal = Goal("g", (replace(PRICING.axes[0], name="a"), replace(PRICING.axes[2], name="b", step=10.0)))
    q = F.floor(F.col("l_quantity") / 10).cast("int").cast("string")
    text = F.when(F.col("l_linenumber") == 2, "bad").otherwise(F.concat(F.lit("[ "), (F.col("l_linenumber") - 1).cast("string"), F.lit(" , "), q, F.lit("]")))
    return keyed(occupancy.from_keys(lines(spark, sf_dir).select(text.alias("key"), F.lit(1).alias("cnt")), goal))


@query(f"SELECT record_id, array_to_string(list_sort(keys), '|') AS subset FROM {SQL_HEADERS}")
def axis_subset_key(spark, sf_dir):
    return headers(spark, sf_dir).select("record_id", cells.subset_key(F.col("axis_names")).alias("subset"))


# Rows and histograms


@query(f"SELECT status, count(*) AS n FROM {sql_cells(MASKED, {**MAPPING, 'quantity': 'CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END'})} GROUP BY 1")
def row_status_counts(spark, sf_dir):
    df = lines(spark, sf_dir).select("*", F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("q"))
    return occupancy.binned(df, MASKED, occupancy.text_values(df, MASKED, {**MAPPING, "quantity": "q"})).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT key, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' GROUP BY 1")
def bin_occupancy(spark, sf_dir):
    return keyed(occupancy.histogram(priced(spark, sf_dir), PRICING))


@query(f"SELECT key, count(*) AS cnt FROM {sql_cells(FINE, source=SQL_OBSERVATIONS)} WHERE status = 'valid' GROUP BY 1")
def rebin_occupancy(spark, sf_dir):
    return keyed(occupancy.histogram(occupancy.rebinned(observations(spark, sf_dir), FINE, ORDER, []), FINE))


@query(" UNION ALL ".join(f"SELECT '{a.name}' AS axis, b{k} AS idx, count(*) AS cnt FROM {sql_cells(MASKED)} WHERE status = 'valid' GROUP BY ALL" for k, a in enumerate(MASKED.axes)))
def axis_bin_occupancy(spark, sf_dir):
    return occupancy.axis_histogram(priced(spark, sf_dir, MASKED), MASKED)


_COUNTERS = "count(*) AS total_rows, count(*) FILTER (status = 'valid') AS valid_rows, count(*) FILTER (status = 'invalid') AS invalid_rows, count(*) FILTER (status = 'out_of_domain') AS out_of_domain_rows, count(*) FILTER (status = 'masked') AS masked_rows, count(DISTINCT CASE WHEN status = 'masked' THEN key END) AS masked_bins"


@query(f"SELECT record_id, {_COUNTERS} FROM {sql_cells(MASKED)} GROUP BY 1")
def occupancy_meta(spark, sf_dir):
    return occupancy.counters(priced(spark, sf_dir, MASKED), MASKED, ["record_id"])


@query("SELECT l_suppkey AS record_id, count(*) AS row_count, " + ", ".join(f"round(avg({MAPPING[n]}), 6) AS mean_{n}, round(coalesce(var_samp({MAPPING[n]}), 0), 4) AS var_{n}, round(coalesce(stddev_samp({MAPPING[n]}), 0), 6) AS std_{n}" for n in PRICING.names) + " FROM lineitem GROUP BY 1")
def dataset_summary(spark, sf_dir):
    out = occupancy.summary(lines(spark, sf_dir), PRICING, values(), ["record_id"])
    return out.select(*[F.round(n, 4 if n.startswith("var") else 6).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes])


@query("SELECT 'discount' AS axis, count(*) AS numeric_cells FROM lineitem UNION ALL SELECT 'price', count(*) FROM lineitem UNION ALL SELECT 'quantity', count(*) FROM lineitem WHERE l_linenumber <> 7")
def axis_numeric_counts(spark, sf_dir):
    v = {**values(), "quantity": F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))}
    return occupancy.numeric_counts(lines(spark, sf_dir), PRICING, v)


@query(f"SELECT l_orderkey, l_linenumber, l_discount AS discount, l_extendedprice AS price, l_quantity AS quantity FROM lineitem WHERE l_suppkey = {TARGET} AND l_linenumber <> 7")
def row_level_vectors(spark, sf_dir):
    v = {**values(), "quantity": F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))}
    got = occupancy.vectors(lines(spark, sf_dir).where(F.col("record_id") == TARGET), PRICING, v, ["l_orderkey", "l_linenumber"])
    return got.select("l_orderkey", "l_linenumber", *[F.col("v")[k].alias(n) for k, n in enumerate(PRICING.names)])


@query(f"SELECT key, count(*) AS cnt FROM {sql_cells(EVENTS, {'k': 'CAST(json_extract_string(props, chr(36) || chr(46) || chr(107)) AS DOUBLE)', 'value': 'value'}, 'events', 'event_type')} WHERE status = 'valid' GROUP BY 1")
def event_occupancy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = {"k": cells.parsed(F.get_json_object("props", "$.k")), "value": cells.finite(F.col("value"))}
    return keyed(occupancy.histogram(occupancy.binned(e, EVENTS, v), EVENTS))


@query(f"SELECT i AS idx, coalesce(cnt, 0) AS cnt FROM (SELECT unnest(range(10))::INTEGER AS i) LEFT JOIN (SELECT b1, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' AND record_id = {TARGET} GROUP BY 1) ON b1 = i")
def axis_distribution(spark, sf_dir):
    counts = occupancy.histogram(priced(spark, sf_dir).where(F.col("record_id") == TARGET), PRICING)
    return occupancy.distribution(counts, PRICING, PRICING.axes[1])


@query(f"SELECT key, sum(cnt)::BIGINT AS cnt FROM (SELECT key, record_id, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' GROUP BY ALL) GROUP BY 1")
def pooled_merge(spark, sf_dir):
    rows = priced(spark, sf_dir)
    parts = [occupancy.histogram(rows.where((F.col("record_id") == TARGET) == side), PRICING) for side in (True, False)]
    return keyed(occupancy.merged(parts, ["cell"]))


# Masks


@query(f"SELECT key, count(*) AS cnt FROM {sql_cells(MASKED)} WHERE status = 'valid' GROUP BY 1")
def mask_filter(spark, sf_dir):
    return keyed(occupancy.histogram(priced(spark, sf_dir, MASKED), MASKED))


@query(SQL["mask_filter"])
def mask_anti_join(spark, sf_dir):
    counts = occupancy.histogram(occupancy.binned(lines(spark, sf_dir), PRICING, values()), PRICING)
    return keyed(masks.unmasked(counts, MASKED, boxes_of(MASKED)))


_GRID = "(SELECT a.i AS b0, b.i AS b1, c.i AS b2 FROM (SELECT unnest(range(10)) AS i) a, (SELECT unnest(range(10)) AS i) b, (SELECT unnest(range(10)) AS i) c)"
_IN_BOX = " OR ".join("(" + " AND ".join(f"b{MASKED.names.index(n)} >= {s} AND b{MASKED.names.index(n)} < {e}" for n, (s, e) in b.items()) + ")" for b in boxes_of(MASKED))


def _boxes(spark, sf_dir) -> DataFrame:
    """A box for each part, on the fine grid: some are open on an axis, some reach beyond it."""
    k, size = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    low = F.when(k % 50 != 7, k % 10)
    return table(spark, sf_dir, "part").select(low.alias("s0"), (k % 10 + 1).alias("e0"), (size % 40).alias("s1"), (size % 40 + 1 + k % 3).alias("e1"), (k % 47).alias("s2"), (k % 47 + 2).alias("e2"))


_SQL_BOXES = "(SELECT CASE WHEN p_partkey % 50 <> 7 THEN p_partkey % 10 ELSE 0 END AS s0, p_partkey % 10 + 1 AS e0, p_size % 40 AS s1, least(40, p_size % 40 + 1 + p_partkey % 3) AS e1, p_partkey % 47 AS s2, p_partkey % 47 + 2 AS e2 FROM part)"
_SQL_BOXED = f"(SELECT DISTINCT b0, b1, unnest(range(s2, e2)) AS b2 FROM (SELECT b0, unnest(range(s1, e1)) AS b1, s2, e2 FROM (SELECT unnest(range(s0, e0)) AS b0, s1, e1, s2, e2 FROM {_SQL_BOXES})))"


@query(f"SELECT count(*) AS masked_bins FROM {_SQL_BOXED}")
def mask_union_volume(spark, sf_dir):
    return masks.union_volume(_boxes(spark, sf_dir), FINE).select(F.col("masked_bins").cast("long").alias("masked_bins"))


@query(f"SELECT 20000::BIGINT AS total_bins, count(*) AS masked_bins, 20000 - count(*) AS valid_bins FROM {_SQL_BOXED}")
def a_valid(spark, sf_dir):
    out = masks.sizes(_boxes(spark, sf_dir), FINE)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query(f"SELECT key, count(*) AS cnt FROM {sql_cells(FINE)} c WHERE status = 'valid' AND NOT EXISTS (SELECT 1 FROM {_SQL_BOXED} m WHERE m.b0 = c.b0 AND m.b1 = c.b1 AND m.b2 = c.b2) GROUP BY 1")
def mask_box_join(spark, sf_dir):
    """Occupied cells that none of many boxes, given as rows, masks."""
    return keyed(masks.outside_boxes(occupancy.histogram(priced(spark, sf_dir, FINE), FINE), FINE, _boxes(spark, sf_dir)))


_EXPRESSION = "price <= 1000000 * discount ** 2 + 5000 * min(quantity, 10) and not quantity > 45"
_CENTRES = ", ".join(f"least({double(a.low)} + (b{k} + 0.5) * {double(a.step)}, {double(a.high)}) AS {a.name}" for k, a in enumerate(PRICING.axes))
_SQL_EXPRESSION = "price <= 1000000 * pow(discount, 2) + 5000 * least(quantity, 10) AND NOT quantity > 45"


def _centre_columns(goal: Goal) -> dict:
    return {a.name: cells.centre(a, F.col("cell")[k]) for k, a in enumerate(goal.axes)}


_SQL_FILLED = f"(SELECT b0, b1, b2, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' GROUP BY ALL)"


def _every_cell(spark, sf_dir) -> DataFrame:
    """All cells of the grid, with the rows in them."""
    counts = occupancy.histogram(priced(spark, sf_dir), PRICING)
    return masks.every_cell(spark, PRICING).join(counts, "cell", "left")


@query(f"SELECT count(*) AS valid_bins, count(cnt) AS occupied_valid_bins, coalesce(sum(cnt), 0)::BIGINT AS rows FROM (SELECT cnt, {_CENTRES} FROM {_GRID} LEFT JOIN {_SQL_FILLED} USING (b0, b1, b2)) WHERE {_SQL_EXPRESSION}")
def expression_valid_bins(spark, sf_dir):
    good = compile_expression(_EXPRESSION, _centre_columns(PRICING))
    return _every_cell(spark, sf_dir).where(good).agg(F.count("*").alias("valid_bins"), F.count("cnt").alias("occupied_valid_bins"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"))


@query(f"SELECT coalesce(sum(cnt) FILTER (ok), 0)::BIGINT AS kept_rows, count(*) FILTER (ok) AS kept_bins, coalesce(sum(cnt) FILTER (NOT ok), 0)::BIGINT AS infeasible_rows, count(*) FILTER (NOT ok) AS infeasible_bins FROM (SELECT cnt, {_SQL_EXPRESSION} AS ok FROM (SELECT cnt, {_CENTRES} FROM (SELECT b0, b1, b2, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' GROUP BY ALL)))")
def expression_filter_bins(spark, sf_dir):
    counts = occupancy.histogram(priced(spark, sf_dir), PRICING)
    marked = counts.select("cnt", compile_expression(_EXPRESSION, _centre_columns(PRICING)).alias("ok"))
    total = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("cnt"))), F.lit(0)).cast("long").alias(name)
    ok = F.col("ok")
    return marked.agg(total(ok, "kept_rows"), F.count(F.when(ok, 1)).alias("kept_bins"), total(~ok, "infeasible_rows"), F.count(F.when(~ok, 1)).alias("infeasible_bins"))


# Density


def _modes_sql(goal: Goal, source: str = "lineitem") -> str:
    return f"""WITH rows_ AS (SELECT record_id = {TARGET} AS t, key FROM {sql_cells(goal, source=source)} WHERE status = 'valid'),
counts AS (SELECT key, count(*) FILTER (NOT t) AS peer, count(*) FILTER (t) AS target FROM rows_ GROUP BY 1),
modes AS (SELECT 'external' AS mode, key, peer AS ref, target FROM counts UNION ALL SELECT 'pooled', key, peer + target, target FROM counts UNION ALL SELECT 'internal', key, target, target FROM counts),
ranked AS (SELECT mode, key, cume_dist() OVER (PARTITION BY mode ORDER BY ref) AS cd FROM modes WHERE ref > 0),
totals AS (SELECT mode, sum(ref)::BIGINT AS n, count(*) FILTER (ref > 0) AS occ FROM modes GROUP BY 1),
scored AS (SELECT m.mode, m.key, m.ref, m.target, CASE WHEN m.ref = 0 THEN 1.0::DOUBLE ELSE 1 - cd END AS s, -ln((m.ref + 0.5::DOUBLE) / (n + 0.5::DOUBLE * {goal.total_bins})) AS r
  FROM modes m JOIN totals USING (mode) LEFT JOIN ranked USING (mode, key) WHERE m.target > 0)"""


_SPEC = "round(sum(target * s) / sum(target), 6) AS specificity_score, round(max(s), 6) AS max_specificity, round(coalesce(sum(target) FILTER (ref = 0), 0) / sum(target), 6) AS unseen_bin_rate, round(coalesce(sum(target) FILTER (s >= 0.95 - 1e-12), 0) / sum(target), 6) AS extreme_specificity_rate, sum(target)::BIGINT AS valid_target_rows"
_RARE = "round(sum(target * r) / sum(target), 6) AS mean_rarity, round(max(r), 6) AS max_rarity"


def _confidence_sql(source: str, valid: str, k: float, by: str, eps: str = "1e-12") -> str:
    """s, c, e, confidence of a query (by, cnt)."""
    return f"""(SELECT {by}, n AS reference_rows, occ AS occupied_bins, n / (n + {double(k)}) AS s, occ / {valid}::DOUBLE AS c, CASE WHEN occ <= 1 THEN 0 ELSE h / ln(occ) END AS e,
  pow(n / (n + {double(k)}) * (occ / {valid}::DOUBLE) * CASE WHEN occ <= 1 THEN 0 ELSE h / ln(occ) END, 1.0::DOUBLE / 3) AS confidence
  FROM (SELECT {by}, any_value(n)::BIGINT AS n, count(*) AS occ, -sum(cnt / n * ln(cnt / n + {eps})) AS h FROM (SELECT {by}, cnt, sum(cnt) OVER (PARTITION BY {by}) AS n FROM {source} WHERE cnt > 0) GROUP BY {by}))"""


def modes_of(spark, sf_dir, goal: Goal = FINE) -> DataFrame:
    return density.by_mode(density.split_counts(priced(spark, sf_dir, goal), goal, F.col("record_id") == TARGET))


@query(f"WITH c AS (SELECT key, count(*) AS cnt FROM {sql_cells(FINE)} WHERE status = 'valid' GROUP BY 1) SELECT cnt, count(*) AS cells, any_value(r)::BIGINT AS rank FROM (SELECT cnt, count(*) OVER (ORDER BY cnt) AS r FROM c) GROUP BY 1")
def ecdf_rank(spark, sf_dir):
    return density.ecdf_rank(occupancy.histogram(priced(spark, sf_dir, FINE), FINE))


@query(f"{_modes_sql(FINE)} SELECT mode, {_SPEC} FROM scored GROUP BY 1")
def ecdf_specificity(spark, sf_dir):
    return rounded(density.specificity(density.by_count(modes_of(spark, sf_dir))))


@query(f"{_modes_sql(FINE)} SELECT mode, key, target, ref, round(s, 6) AS specificity FROM scored")
def scored_target_cells(spark, sf_dir):
    return rounded(keyed(density.scored_cells(modes_of(spark, sf_dir))))


@query(f"{_modes_sql(FINE)} SELECT mode, {_RARE} FROM scored GROUP BY 1")
def rarity(spark, sf_dir):
    return rounded(density.rarity(density.by_count(modes_of(spark, sf_dir)), FINE.total_bins))


_BY_RECORD = f"(SELECT record_id, key, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' GROUP BY ALL)"
_ROUND_TERMS = "round(s, 6) AS s, round(c, 6) AS c, round(e, 6) AS e, round(confidence, 6) AS confidence"


@query(f"SELECT record_id, reference_rows, occupied_bins, {_ROUND_TERMS} FROM {_confidence_sql(_BY_RECORD, '1000', 1000.0, 'record_id')}")
def confidence_terms(spark, sf_dir):
    return rounded(density.confidence(occupancy.histogram(priced(spark, sf_dir), PRICING, ["record_id"]), PRICING.total_bins, PRICING.k, ["record_id"]))


@query(f"SELECT occupied_bins, reference_rows AS peer_valid_rows, {_ROUND_TERMS} FROM {_confidence_sql(f'(SELECT 1 AS one, key, count(*) AS cnt FROM {sql_cells(ROLES.design)} WHERE status = {chr(39)}valid{chr(39)} GROUP BY ALL)', '100', 1000.0, 'one', '0')}")
def preview_metrics(spark, sf_dir):
    design = ROLES.design
    out = density.confidence(occupancy.histogram(priced(spark, sf_dir, design), design), design.total_bins, design.k, epsilon=0.0)
    return rounded(out.withColumnRenamed("reference_rows", "peer_valid_rows"))


@query(f"WITH c AS (SELECT key, count(*) AS cnt FROM {sql_cells(FINE)} WHERE status = 'valid' GROUP BY 1) SELECT sum(cnt)::BIGINT AS observation_count, count(*) AS occupied_bins, round(count(*) / 20000, 6) AS coverage, round(-sum(p * ln(p + 1e-12)) / ln(count(*)), 6) AS equitability FROM (SELECT cnt, cnt / sum(cnt) OVER () AS p FROM c)")
def tracker_metrics(spark, sf_dir):
    out = density.confidence(occupancy.histogram(priced(spark, sf_dir, FINE), FINE), FINE.total_bins, FINE.k)
    return out.select(F.col("reference_rows").alias("observation_count"), "occupied_bins", F.round("c", 6).alias("coverage"), F.round("e", 6).alias("equitability"))


def _three_modes(spark, sf_dir, goal: Goal) -> DataFrame:
    design = goal.design
    target = F.col("record_id") == TARGET
    split = lambda g: density.split_counts(priced(spark, sf_dir, g), g, target)
    selected = split(goal)
    same = design.names == goal.names
    return rounded(density.reference_modes(selected, selected if same else split(design), goal, design, feasible_size(design)["valid_bins"]))


def _three_modes_sql(goal: Goal, where: str = "", source: str = "lineitem") -> str:
    design = goal.design
    d = _modes_sql(design, source).replace("WITH rows_", "WITH drows").replace("FROM rows_", "FROM drows").replace("counts AS", "dcounts AS").replace("FROM counts", "FROM dcounts").replace("modes AS", "dmodes AS").split(",\nranked")[0]
    valid = str(feasible_size(design)["valid_bins"])
    return f"""{_modes_sql(goal, source)}, {d.removeprefix('WITH ')},
conf AS (SELECT * FROM {_confidence_sql('(SELECT mode, key, ref AS cnt FROM dmodes)', valid, goal.k, 'mode')}),
spec AS (SELECT mode, {_SPEC}, {_RARE} FROM scored GROUP BY 1)
SELECT mode, specificity_score, max_specificity, unseen_bin_rate, extreme_specificity_rate, valid_target_rows, mean_rarity, max_rarity, reference_rows, occupied_bins, {_ROUND_TERMS}
FROM spec JOIN conf USING (mode) {where}"""


@query(_three_modes_sql(FINE))
def reference_modes(spark, sf_dir):
    return _three_modes(spark, sf_dir, FINE)


@query(_three_modes_sql(ROLES))
def reference_modes_roles(spark, sf_dir):
    return _three_modes(spark, sf_dir, ROLES)


@query(_three_modes_sql(MASKED))
def reference_modes_masked(spark, sf_dir):
    return _three_modes(spark, sf_dir, MASKED)


def _cells_by_role(spark, sf_dir) -> DataFrame:
    """Rows per cell of the masked grid, of the target (role 2), its peers of the goal (1) and all others (0): binned once."""
    mine = records.peers(headers(spark, sf_dir), "pricing", PRICING.names, str(TARGET)).select("record_id", F.lit(1).alias("of_goal")).distinct()
    role = F.when(F.col("record_id") == TARGET, 2).otherwise(F.coalesce("of_goal", F.lit(0)))
    rows = priced(spark, sf_dir, MASKED).join(mine, "record_id", "left").withColumn("role", role)
    return files.written(occupancy.per_cell(rows, MASKED, ["role"]))


def _modes_of_cells(grouped: DataFrame) -> DataFrame:
    counts = density.split_cells(grouped, MASKED, F.col("role") == 2)
    return rounded(density.reference_modes(counts, counts, MASKED, MASKED, feasible_size(MASKED)["valid_bins"]))


def _target_of_cells(grouped: DataFrame) -> DataFrame:
    return occupancy.cell_counters(grouped.where("role = 2"), MASKED)


def _diagnosed(spark, sf_dir, mode: str) -> DataFrame:
    """One mode on the masked grid, with what became of the target's rows."""
    grouped = _cells_by_role(spark, sf_dir)
    return rounded(density.with_target(_modes_of_cells(grouped).where(F.col("mode") == mode), _target_of_cells(grouped)))


def _diagnosed_sql(mode: str) -> str:
    of = lambda status: f"count(*) FILTER (status = '{status}')"
    return f"""SELECT * FROM ({_three_modes_sql(MASKED, f"WHERE mode = '{mode}'")}) CROSS JOIN (SELECT count(*) AS target_total_rows, {of("invalid")} AS invalid_target_rows, {of("out_of_domain")} AS out_of_domain_rows,
  {of("masked")} AS masked_out_target_rows, round({of("out_of_domain")} / count(*), 6) AS out_of_domain_rate FROM {sql_cells(MASKED)} WHERE record_id = {TARGET})"""


@query(_diagnosed_sql("pooled"))
def diagnose_pooled(spark, sf_dir):
    return _diagnosed(spark, sf_dir, "pooled")


@query(_diagnosed_sql("internal"))
def diagnose_internal(spark, sf_dir):
    return _diagnosed(spark, sf_dir, "internal")


@query(_diagnosed_sql("external"))
def diagnose_external(spark, sf_dir):
    return _diagnosed(spark, sf_dir, "external")


@query(f"SELECT 'external' AS mode, 1.0::DOUBLE AS specificity_score, 1.0::DOUBLE AS unseen_bin_rate, round(ln(20000), 6) AS mean_rarity, 0.0::DOUBLE AS confidence, 0::BIGINT AS reference_rows, count(*) AS valid_target_rows FROM {sql_cells(FINE)} WHERE status = 'valid' AND record_id = {TARGET}")
def external_boundary(spark, sf_dir):
    alone = priced(spark, sf_dir, FINE).where(F.col("record_id") == TARGET)
    counts = density.split_counts(alone, FINE, F.lit(True))
    out = density.reference_modes(counts, counts, FINE, FINE, FINE.total_bins).where("mode = 'external'")
    return rounded(out.select("mode", "specificity_score", "unseen_bin_rate", "mean_rarity", "confidence", "reference_rows", "valid_target_rows"))


@query(f"SELECT mode, label, round(score, 4) AS score, CASE WHEN score < least_ THEN 'down' ELSE 'stable' END AS impact FROM ({_three_modes_sql(FINE)}) CROSS JOIN LATERAL (VALUES ('Observation Support', s, 0.6), ('Coverage', c, 0.3), ('Equitability', e, 0.5)) t(label, score, least_)")
def confidence_reasons(spark, sf_dir):
    return report.confidence_reasons(_three_modes(spark, sf_dir, FINE))


@query(f"SELECT mode, CASE WHEN specificity_score > 0.75 AND confidence > 0.7 THEN 'rare_and_supported' WHEN specificity_score > 0.75 AND confidence <= 0.4 THEN 'rare_but_weakly_supported' WHEN specificity_score <= 0.5 THEN 'ordinary' ELSE 'moderate' END AS verdict FROM ({_three_modes_sql(FINE)})")
def summary_verdict(spark, sf_dir):
    return report.verdict(_three_modes(spark, sf_dir, FINE))


@query(f"SELECT kind, rows, total_rows FROM (SELECT {_COUNTERS} FROM {sql_cells(MASKED)} WHERE record_id = {TARGET}) CROSS JOIN LATERAL (VALUES ('out_of_domain', out_of_domain_rows), ('masked', masked_rows)) t(kind, rows) WHERE rows > 0")
def out_of_domain_warnings(spark, sf_dir):
    return report.warnings(occupancy.counters(priced(spark, sf_dir, MASKED).where(F.col("record_id") == TARGET), MASKED))


# The report of a record, from its peers of the goal; its JSON columns are parsed again to compare numbers.
_REPORT_TIME = "2024-01-01T00:00:00+00:00"


def _report(spark, sf_dir) -> DataFrame:
    grouped = _cells_by_role(spark, sf_dir)
    near = records.peers(headers(spark, sf_dir), "pricing", PRICING.names, str(TARGET)).select("record_id")
    seen = lines(spark, sf_dir).select("record_id").distinct().join(near, "record_id", "left_semi").agg(F.count("*").alias("eligible_records"))
    peers = seen.crossJoin(occupancy.cell_counters(grouped.where("role = 1"), MASKED).select(F.col("masked_rows").alias("infeasible_rows"), F.col("masked_bins").alias("infeasible_bins")))  # of one row each
    means = rounded(occupancy.summary(lines(spark, sf_dir).where(F.col("record_id") == TARGET), MASKED, values()))
    return report.report_row(MASKED, _modes_of_cells(grouped), _target_of_cells(grouped), means, peers, feasible_size(MASKED), _REPORT_TIME)


_REPORT_PEERS = f"""(SELECT count(DISTINCT record_id) AS eligible, count(*) FILTER (status = 'masked') AS rows_, count(DISTINCT key) FILTER (status = 'masked') AS bins
  FROM {sql_cells(MASKED)} WHERE record_id <> {TARGET} AND record_id IN (SELECT record_id FROM {SQL_HEADERS} WHERE trim(goal_id) = 'pricing' AND len(keys) = 3))"""


_SIZE = feasible_size(MASKED)
_REPORT_TERMS = ("specificity_score", "mean_rarity", "confidence", "reference_rows")


@query(f"""WITH m AS ({_three_modes_sql(MASKED)}), x AS ({_diagnosed_sql("external")}), v AS (SELECT avg(l_discount) AS v0, avg(l_extendedprice) AS v1, avg(l_quantity) AS v2 FROM lineitem WHERE l_suppkey = {TARGET})
SELECT 'pricing_masked' AS experiment_goal, 'pricing_masked' AS goal_id, '["discount","price","quantity"]' AS axis_names, eligible AS peer_group_size, eligible AS peer_record_count, eligible AS external_peer_record_count,
  reference_rows AS external_peer_observation_count, reference_rows AS reference_observation_count, occupied_bins AS reference_occupied_bins, 'external_only' AS reference_density_policy, 'external' AS primary_reference_mode,
  FALSE AS target_included_in_reference, reference_rows = 0 AS no_external_reference, FALSE AS internal_density_mode, NULL::VARCHAR AS self_contained_reference_warning, 'density_grid' AS engine, 'occupied_bin_count_ecdf' AS specificity_method,
  specificity_score, specificity_score AS mean_bin_specificity, max_specificity, extreme_specificity_rate, mean_rarity, max_rarity, unseen_bin_rate, extreme_specificity_rate AS rare_bin_rate, out_of_domain_rate, masked_out_target_rows,
  masked_out_target_rows AS infeasible_target_rows, TRUE AS feasible_mask_enabled, 3 AS feasible_expressions, FALSE AS feasible_mask_evaluation_skipped, NULL::VARCHAR AS feasible_mask_warning, NULL::VARCHAR AS coverage_warning,
  {_SIZE["valid_bins"]}::BIGINT AS valid_bins, {_SIZE["masked_bins"]}::BIGINT AS masked_bins, round({_SIZE["valid_bins"]} / {_SIZE["total_bins"]}.0::DOUBLE, 6) AS valid_domain_ratio, rows_ AS infeasible_peer_rows, bins AS infeasible_peer_bins,
  confidence, s AS "observation_support_S", c AS "coverage_C", e AS "equitability_E", reference_rows AS peer_observation_count, valid_target_rows, invalid_target_rows, out_of_domain_rows, {_SIZE["total_bins"]}::BIGINT AS total_bins, occupied_bins,
  '{_REPORT_TIME}' AS analysis_timestamp, concat_ws(',', CASE WHEN masked_out_target_rows > 0 THEN 'masked:' || masked_out_target_rows END, CASE WHEN out_of_domain_rows > 0 THEN 'out_of_domain:' || out_of_domain_rows END) AS out_of_domain_warnings,
  'Coverage:' || CASE WHEN c < 0.3 THEN 'down' ELSE 'stable' END || ',Equitability:' || CASE WHEN e < 0.5 THEN 'down' ELSE 'stable' END || ',Observation Support:' || CASE WHEN s < 0.6 THEN 'down' ELSE 'stable' END AS confidence_reasons,
  CASE WHEN specificity_score > 0.75 AND confidence > 0.7 THEN 'rare_and_supported' WHEN specificity_score > 0.75 AND confidence <= 0.4 THEN 'rare_but_weakly_supported' WHEN specificity_score <= 0.5 THEN 'ordinary' ELSE 'moderate' END AS summary_messages, '[]' AS grid_preview_logs,
  round(v0, 6) AS target_vector_0, round(v1, 6) AS target_vector_1, round(v2, 6) AS target_vector_2, {", ".join(f"(SELECT {t} FROM m WHERE m.mode = '{m}') AS {m}_{t}" for m in density.MODES for t in _REPORT_TERMS)}
FROM x CROSS JOIN v CROSS JOIN {_REPORT_PEERS}""")
def export_report(spark, sf_dir):
    """The flat report, written as csv and as json and read back: all fields are those of the csv, and both files are the same.
    Lists are taken apart to be compared."""
    made = _report(spark, sf_dir)
    folder = f"{files.shared_folder(spark)}/report-{uuid.uuid4().hex}"
    row = files.written(made)
    for kind in ("csv", "json"):
        report.write_report(row, f"{folder}/{kind}", kind)
    schema = row.schema
    back = spark.read.schema(schema).options(header=True, escape='"').csv(f"{folder}/csv")
    same = spark.read.schema(schema).json(f"{folder}/json")
    numbers = [f.name for f in schema if f.dataType.simpleString() in ("double", "bigint", "boolean")]
    back = back.join(same.select(*[F.col(n).alias(f"__{n}") for n in numbers]), reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in numbers]), "left_semi")
    modes = F.from_json("reference_modes", "array<struct<mode:string,specificity_score:double,mean_rarity:double,confidence:double,reference_rows:bigint>>")
    of = lambda m, t: F.get(F.filter(modes, lambda x: x["mode"] == m), F.lit(0))[t]
    texts = lambda name, fields, show: F.array_join(F.array_sort(F.transform(F.from_json(name, f"array<struct<{fields}>>"), show)), ",").alias(name)
    shown = {
        "axis_names": F.replace("axis_names", F.lit(" "), F.lit("")).alias("axis_names"),
        "feasible_expressions": F.size(F.from_json("feasible_expressions", "array<string>")).alias("feasible_expressions"),
        "out_of_domain_warnings": texts("out_of_domain_warnings", "kind:string,rows:bigint", lambda x: F.concat_ws(":", x["kind"], x["rows"].cast("string"))),
        "confidence_reasons": texts("confidence_reasons", "label:string,impact:string", lambda x: F.concat_ws(":", x["label"], x["impact"])),
        "summary_messages": texts("summary_messages", "verdict:string", lambda x: x["verdict"]),
    }
    vector = [F.from_json("target_vector", "array<double>")[k].alias(f"target_vector_{k}") for k in range(3)]
    kept = [shown.get(n, F.col(n)) for n in report.REPORT_FIELDS if n not in ("target_vector", "reference_modes")]
    return rounded(back.select(*kept, *vector, *[of(m, t).alias(f"{m}_{t}") for m in density.MODES for t in _REPORT_TERMS]))


# Projections


@query(f"SELECT 'discount' AS x_axis, 'price' AS y_axis, b0 AS x_bin, b1 AS y_bin, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' AND record_id <> {TARGET} GROUP BY ALL")
def projection_peer(spark, sf_dir):
    counts = occupancy.histogram(priced(spark, sf_dir).where(F.col("record_id") != TARGET), PRICING)
    return projection.projected(counts, PRICING, most=1)


@query(SQL["projection_peer"].replace("<>", "="))
def projection_target(spark, sf_dir):
    rows = priced(spark, sf_dir).where((F.col("record_id") == TARGET) & (F.col("status") == "valid"))
    return projection.projected(rows.select("cell", F.lit(1).cast("long").alias("cnt")), PRICING, most=1)


@query(" UNION ALL ".join(f"SELECT '{PRICING.names[i]}' AS x_axis, '{PRICING.names[j]}' AS y_axis, b{i} AS x_bin, b{j} AS y_bin, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' GROUP BY ALL" for i, j in ((0, 1), (0, 2), (1, 2))))
def projection_all_pairs(spark, sf_dir):
    return projection.projected(occupancy.histogram(priced(spark, sf_dir), PRICING), PRICING)


_WIDE = PRICING.with_axes([{"name": "price", "step": 0.5}])


@query(f"SELECT 'discount' AS x_axis, 'price' AS y_axis, 2000000::BIGINT AS fields, TRUE AS skipped, 0::BIGINT AS max_cnt UNION ALL SELECT 'price', 'quantity', 2000000, TRUE, 0 UNION ALL SELECT 'discount', 'quantity', 100, FALSE, max(n) FROM (SELECT count(*) AS n FROM {sql_cells(_WIDE)} WHERE status = 'valid' GROUP BY b0, b2)")
def projection_summaries(spark, sf_dir):
    return projection.pair_summaries(occupancy.histogram(priced(spark, sf_dir, _WIDE), _WIDE), _WIDE)


@query(f"SELECT key, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' AND record_id = {TARGET} AND b0 = 3 AND b2 = 4 GROUP BY 1")
def projection_selection(spark, sf_dir):
    rows = priced(spark, sf_dir).where((F.col("record_id") == TARGET) & (F.col("status") == "valid"))
    return keyed(projection.selected(rows, PRICING, "discount", "quantity", 3, 4).groupBy("cell").agg(F.count("*").alias("cnt")))


_CHOSEN = f"(SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 10 END AS b0, CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey % 7 END AS b1, CASE WHEN s_suppkey % 5 <> 2 THEN 3 END AS b2 FROM supplier)"


@query(" UNION ALL ".join(f"SELECT record_id, '{PRICING.names[i]}' AS x_axis, '{PRICING.names[j]}' AS y_axis, b{i}::INTEGER AS x_bin, b{j}::INTEGER AS y_bin FROM {_CHOSEN} WHERE b{i} IS NOT NULL OR b{j} IS NOT NULL" for i, j in ((0, 1), (0, 2), (1, 2))))
def crosshair_markers(spark, sf_dir):
    """A selection for each supplier, on some axes."""
    k = F.col("s_suppkey")
    chosen = table(spark, sf_dir, "supplier").select(k.alias("record_id"), F.when(k % 3 != 0, k % 10).alias("discount"), F.when(k % 4 == 1, k % 7).alias("price"), F.when(k % 5 != 2, F.lit(3)).alias("quantity"))
    return projection.crosshairs(chosen, PRICING, ["record_id"])


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, count(*) OVER () AS n FROM lineitem)
SELECT l_orderkey, l_linenumber FROM o WHERE pos IN (SELECT CAST(floor(i * ((SELECT any_value(n) FROM o) / 5000::DOUBLE)) AS BIGINT) FROM (SELECT unnest(range(5000)) AS i))""")
def tuple_sample(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return projection.sampled(rows, [F.col(c) for c in rows.columns]).select("l_orderkey", "l_linenumber")


_SQL_PREVIEWED = f"(SELECT goal_id, axis, low, CASE WHEN goal_id % 3 = 1 AND axis = 'quantity' THEN 80.0::DOUBLE ELSE high END AS high, CASE WHEN goal_id % 3 = 0 AND axis = 'price' THEN 25.0::DOUBLE ELSE step END AS step FROM ({_SQL_GRIDS}))"


def _previewed(spark, sf_dir) -> DataFrame:
    """Finer prices for some suppliers' goals, a longer axis of quantities for others, an axis that no goal has for the rest."""
    k, none = F.col("s_suppkey"), F.lit(None).cast("double")
    asks = lambda axis, low, high, step: F.struct(F.lit(axis).alias("axis"), low.alias("low"), high.alias("high"), step.alias("step"))
    asked = F.when(k % 3 == 0, asks(" PRICE", none, none, F.lit(25.0))).when(k % 3 == 1, asks("Quantity ", none, F.lit(80.0), none)).otherwise(asks("depth", F.lit(0.0), F.lit(1.0), F.lit(0.1)))
    return grids.with_preview(_grids(spark, sf_dir), table(spark, sf_dir, "supplier").select(k.alias("goal_id"), asked.alias("a")).select("goal_id", "a.*"))


@query(f"SELECT goal_id, count(*)::INTEGER AS axes, CAST(product({_SQL_BINS}) AS BIGINT) AS total_bins, product({_SQL_BINS}) > 500000 AS skipped FROM {_SQL_PREVIEWED} GROUP BY 1")
def preview_skipped(spark, sf_dir):
    return grids.guarded(_previewed(spark, sf_dir)).withColumn("total_bins", F.col("total_bins").cast("long"))


_DRAWN = f"(SELECT b0, b1, b2, key, count(*) FILTER (record_id <> {TARGET}) AS peer, count(*) FILTER (record_id = {TARGET}) AS target FROM {sql_cells(ROLES)} WHERE status = 'valid' GROUP BY ALL)"
_SQL_VISUALS = " UNION ALL ".join(
    [f"SELECT 'pair' AS kind, '{ROLES.names[i]}' AS x_axis, '{ROLES.names[j]}' AS y_axis, b{i} AS x_bin, b{j} AS y_bin, NULL::VARCHAR AS key, sum(peer)::BIGINT AS peer, sum(target)::BIGINT AS target FROM {_DRAWN} GROUP BY b{i}, b{j}" for i, j in ((0, 1), (0, 2), (1, 2))]
    + [f"SELECT 'axis', '{ROLES.names[i]}', NULL, i, NULL, NULL, coalesce(sum(peer), 0)::BIGINT, coalesce(sum(target), 0)::BIGINT FROM (SELECT unnest(range(10))::INTEGER AS i) LEFT JOIN {_DRAWN} ON b{i} = i GROUP BY i" for i in (0, 1)]
    + [f"""SELECT 'tuple', NULL, NULL, NULL, NULL, key, 0, count(*) FROM (SELECT key, row_number() OVER (ORDER BY b0, b1, b2) - 1 AS pos, count(*) OVER () AS n FROM {sql_cells(ROLES)} WHERE status = 'valid' AND record_id = {TARGET})
  WHERE pos IN (SELECT CAST(floor(i * (SELECT count(*) FROM {sql_cells(ROLES)} WHERE status = 'valid' AND record_id = {TARGET}) / 50) AS BIGINT) FROM (SELECT unnest(range(50)) AS i)) GROUP BY key"""]
    + ["SELECT * FROM (VALUES ('cross', 'discount', 'price', 1, 2, NULL, 0, 0), ('cross', 'discount', 'quantity', 1, NULL, NULL, 0, 0), ('cross', 'price', 'quantity', 2, NULL, NULL, 0, 0)) t"]
)


@query(_SQL_VISUALS)
def report_visuals(spark, sf_dir):
    """Pairs, axes, 50 sampled rows and crosshairs of a target and its peers, from one scan."""
    counts = density.split_counts(priced(spark, sf_dir, ROLES), ROLES, F.col("record_id") == TARGET)
    return projection.visuals(counts, ROLES, {"discount": 1, "price": 2}, limit=50)


@query(" UNION ALL ".join(f"SELECT '{_WIDE.names[i]}' AS x_axis, '{_WIDE.names[j]}' AS y_axis, b{i} AS x_bin, b{j} AS y_bin, count(*) AS cnt FROM {sql_cells(_WIDE)} WHERE status = 'valid' GROUP BY ALL" for i, j in ((0, 1), (0, 2), (1, 2))))
def projection_wide_pairs(spark, sf_dir):
    """All pairs, also those of more fields than are drawn."""
    return projection.projected(occupancy.histogram(priced(spark, sf_dir, _WIDE), _WIDE), _WIDE, fields=None)


# Records


_PEER = f"trim(goal_id) = 'pricing' AND list_contains(keys, 'discount') AND list_contains(keys, 'price') AND list_contains(keys, 'quantity')"


@query(f"SELECT record_id FROM {SQL_HEADERS} WHERE {_PEER} AND record_id <> {TARGET}")
def peer_records(spark, sf_dir):
    return records.peers(headers(spark, sf_dir), "pricing", PRICING.names, str(TARGET)).select("record_id")


@query(f"SELECT record_id, list_contains(keys, 'quantity') AS compatible FROM {SQL_HEADERS}")
def peer_axis_compatible(spark, sf_dir):
    return headers(spark, sf_dir).select("record_id", records.has_axes(["Quantity ", "price"]).alias("compatible"))


_REASONS = f"(SELECT record_id, CASE WHEN record_id = {TARGET} THEN 'excluded_self' WHEN trim(goal_id) <> 'pricing' THEN 'different_goal' WHEN NOT list_contains(keys, 'quantity') THEN 'axis_mismatch' ELSE 'peer' END AS reason FROM {SQL_HEADERS})"


@query(f"SELECT r.reason, count(*) AS records, coalesce(any_value(x.ids), '') AS examples FROM {_REASONS} r LEFT JOIN (SELECT reason, string_agg(record_id, ',' ORDER BY record_id) AS ids FROM (SELECT * FROM {_REASONS} WHERE reason <> 'peer' ORDER BY record_id LIMIT 3) GROUP BY 1) x USING (reason) GROUP BY 1")
def peer_filter_diagnostics(spark, sf_dir):
    return records.filter_diagnostics(records.filter_reasons(headers(spark, sf_dir), "pricing", PRICING.names, str(TARGET)))


@query(f"SELECT record_id, trim(goal_id) AS goal, len(keys) AS axes FROM {SQL_HEADERS} WHERE {_PEER}")
def peer_rows(spark, sf_dir):
    return records.peers(headers(spark, sf_dir), " pricing", PRICING.names).select("record_id", F.trim("goal_id").alias("goal"), F.size("axis_names").cast("long").alias("axes"))


@query(f"SELECT goal_id, count(*) AS peers FROM {SQL_HEADERS} WHERE record_id IN (SELECT l_suppkey FROM {SQL_OBSERVATIONS}) GROUP BY 1")
def peer_counts(spark, sf_dir):
    return records.peer_counts(headers(spark, sf_dir), observations(spark, sf_dir))


_SETS = [("discount",), ("price",), ("quantity",), ("discount", "price"), ("discount", "quantity"), ("price", "quantity"), ("discount", "price", "quantity")]


@query(" UNION ALL ".join(f"SELECT '{'|'.join(s)}' AS subset, count(*) AS peers FROM {SQL_HEADERS} WHERE {s != ('quantity',)} AND trim(goal_id) = 'pricing' AND {' AND '.join(f'list_contains(keys, {chr(39)}{n}{chr(39)})' for n in s)} AND record_id IN (SELECT l_suppkey FROM {SQL_OBSERVATIONS})" for s in _SETS))
def peer_subset_counts(spark, sf_dir):
    return records.subset_counts(headers(spark, sf_dir), observations(spark, sf_dir), replace(ROLES, id="pricing"))


_PEER_CELLS = f"(SELECT * FROM {sql_cells(MASKED, source=SQL_OBSERVATIONS)} WHERE record_id IN (SELECT record_id FROM {SQL_HEADERS} WHERE {_PEER}))"


def _peer_density(spark, sf_dir):
    return records.global_counts(records.peers(headers(spark, sf_dir), "pricing", PRICING.names), observations(spark, sf_dir), MASKED, ORDER)


@query(f"SELECT key, count(*) AS cnt FROM {_PEER_CELLS} WHERE status = 'valid' GROUP BY 1")
def global_bin_counts(spark, sf_dir):
    return keyed(_peer_density(spark, sf_dir)[0])


@query(f"SELECT count(DISTINCT record_id) AS eligible_records, (SELECT count(*) FROM {SQL_HEADERS} WHERE {_PEER}) - count(DISTINCT record_id) AS legacy_excluded, count(*) FILTER (status = 'valid') AS observations, count(DISTINCT key) FILTER (status = 'valid') AS occupied_bins, count(*) FILTER (status = 'masked') AS infeasible_rows, count(DISTINCT key) FILTER (status = 'masked') AS infeasible_bins FROM {_PEER_CELLS}")
def infeasible_peer_bins(spark, sf_dir):
    return _peer_density(spark, sf_dir)[1]


@query(f"SELECT key, count(*) AS cnt FROM {sql_cells(PRICING)} WHERE status = 'valid' AND record_id IN (SELECT record_id FROM {SQL_HEADERS} WHERE len(keys) = 3 AND grid_signature IS NOT NULL) GROUP BY 1")
def global_counts_stored(spark, sf_dir):
    maps = keyed(occupancy.histogram(priced(spark, sf_dir), PRICING, ["record_id"]))
    return records.stored_counts(headers(spark, sf_dir), maps, ["Quantity", "price", "discount"])


_HALF = "record_id % 2 = 0"


@query(f"SELECT record_id, key, count(*) AS cnt FROM {sql_cells(FINE)} WHERE status = 'valid' AND {_HALF} GROUP BY ALL UNION ALL SELECT record_id, key, 2 * count(*) FROM {sql_cells(PRICING)} WHERE status = 'valid' AND NOT {_HALF} GROUP BY ALL")
def stored_or_rebinned_counts(spark, sf_dir):
    """All records: every other one has vectors, the others only their stored histogram (with counts that tell them apart)."""
    maps = keyed(occupancy.histogram(priced(spark, sf_dir), PRICING, ["record_id"])).withColumn("cnt", 2 * F.col("cnt"))
    return keyed(records.chosen_counts(observations(spark, sf_dir).where(_HALF), maps, FINE, ORDER))


@query(f"SELECT count(*) AS masked_bins, count(cnt) AS occupied_masked_bins, coalesce(sum(cnt), 0)::BIGINT AS rows FROM {_GRID} LEFT JOIN {_SQL_FILLED} USING (b0, b1, b2) WHERE {_IN_BOX}")
def rule_text_masked_bins(spark, sf_dir):
    """Cells that the rules' text masks, and the rows in them: the same as their boxes do."""
    centres = _centre_columns(MASKED)
    free = cells.all_of([compile_expression(r["text"], centres) for r in normalised(list(MASKED.rules), MASKED)])
    return _every_cell(spark, sf_dir).where(~free).agg(F.count("*").alias("masked_bins"), F.count("cnt").alias("occupied_masked_bins"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"))


@query(f"SELECT 'discount' AS axis, 10 AS total_bins, count(DISTINCT b0) AS occupied_bins FROM {_PEER_CELLS} WHERE status = 'valid' UNION ALL SELECT 'price', 10, count(DISTINCT b1) FROM {_PEER_CELLS} WHERE status = 'valid' UNION ALL SELECT 'quantity', 10, count(DISTINCT b2) FROM {_PEER_CELLS} WHERE status = 'valid' UNION ALL SELECT '*', 1000, count(DISTINCT key) FROM {_PEER_CELLS} WHERE status = 'valid'")
def goal_bin_preview(spark, sf_dir):
    counts = _peer_density(spark, sf_dir)[0]
    parts = F.array(*[F.struct(F.lit(a.name).alias("axis"), F.lit(a.bins).alias("total_bins"), F.col("cell")[k].cast("string").alias("at")) for k, a in enumerate(MASKED.axes)], F.struct(F.lit("*").alias("axis"), F.lit(MASKED.total_bins).alias("total_bins"), cells.bin_key(F.col("cell")).alias("at")))
    return counts.select(F.explode(parts).alias("p")).groupBy("p.axis", "p.total_bins").agg(F.count_distinct("p.at").alias("occupied_bins"))


_HASHES = f"(SELECT record_id, sha256('{{' || string_agg('\"' || key || '\":' || cnt, ',' ORDER BY '\"' || key || '\":' || cnt) || '}}') AS occupancy_hash FROM {_BY_RECORD} GROUP BY 1)"


@query(f"SELECT * FROM {_HASHES}")
def occupancy_hash(spark, sf_dir):
    return records.occupancy_hash(occupancy.histogram(priced(spark, sf_dir), PRICING, ["record_id"]), ["record_id"])


def _summaries(spark, sf_dir) -> DataFrame:
    """Records as they are compared: rows, means (in whole cents, which both engines round alike) and histogram hash."""
    rows = lines(spark, sf_dir)
    means = rows.groupBy("record_id").agg(F.count("*").alias("row_count"), F.array(F.round(F.avg("l_quantity"), 2)).alias("means"))
    return means.join(occupancy_hash(spark, sf_dir), "record_id")


_PRINTS = f"""(SELECT record_id, sha256('pricing|discount|price|quantity|' || format('{{:,.12f}}', m) || '|' || n || '|mean|' || occupancy_hash || '|{PRICING.signature()}') AS fingerprint
 FROM {_HASHES} JOIN (SELECT l_suppkey AS record_id, count(*) AS n, round(avg(l_quantity), 2) AS m FROM lineitem GROUP BY 1) USING (record_id))"""


@query(f"SELECT * FROM {_PRINTS}")
def record_fingerprint(spark, sf_dir):
    return records.fingerprints(_summaries(spark, sf_dir), PRICING)


@query(f"SELECT record_id FROM {_PRINTS}")
def dedupe_in_batch(spark, sf_dir):
    f = records.fingerprints(_summaries(spark, sf_dir), PRICING)
    twice = f.withColumn("place", F.lit(0)).unionByName(f.withColumn("place", F.lit(1)))
    return records.first_of_each(twice, F.struct("place", "record_id")).select("record_id")


@query("SELECT l_suppkey AS record_id FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1")
def dedupe_new_records(spark, sf_dir):
    f = records.fingerprints(_summaries(spark, sf_dir), PRICING)
    return records.new_records(f, f.where("record_id % 3 = 0")).select("record_id")


@query(f"WITH o AS (SELECT DISTINCT key FROM {sql_cells(FINE)} WHERE status = 'valid' AND record_id = {TARGET}), p AS (SELECT DISTINCT key FROM {sql_cells(FINE)} WHERE status = 'valid' AND record_id <> {TARGET}) SELECT (SELECT count(*) FROM o) > 0 AND NOT EXISTS (SELECT 1 FROM o JOIN p USING (key)) AS bin_uniqueness")
def bin_uniqueness(spark, sf_dir):
    counts = density.split_counts(priced(spark, sf_dir, FINE), FINE, F.col("record_id") == TARGET)
    return records.uniqueness(counts.where("target > 0").select("cell"), counts.select("cell", F.col("peer").alias("cnt")))


@query(f"SELECT s.*, h.occupancy_hash, '{PRICING.signature()}' AS grid_signature FROM (SELECT l_suppkey AS record_id, count(*) AS row_count, " + ", ".join(f"round(avg({MAPPING[n]}), 6) AS mean_{n}, round(coalesce(var_samp({MAPPING[n]}), 0), 4) AS var_{n}" for n in PRICING.names) + f" FROM {SQL_OBSERVATIONS} GROUP BY 1) s LEFT JOIN {_HASHES} h USING (record_id)")
def rebuild_records(spark, sf_dir):
    out = records.rebuilt(observations(spark, sf_dir), PRICING, ORDER)
    return out.select(*[F.round(n, 4 if n.startswith("var") else 6).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes])


_LOO = f"""WITH own AS (SELECT record_id, key, count(*) AS o FROM {sql_cells(PRICING)} WHERE status = 'valid' GROUP BY ALL),
pairs AS (SELECT r.record_id, w.key, w.g - coalesce(own.o, 0) AS e, coalesce(own.o, 0) AS o FROM (SELECT DISTINCT record_id FROM own) r CROSS JOIN (SELECT key, sum(o)::BIGINT AS g FROM own GROUP BY 1) w LEFT JOIN own ON own.record_id = r.record_id AND own.key = w.key),
ranked AS (SELECT *, cume_dist() OVER (PARTITION BY record_id ORDER BY e) AS cd FROM pairs WHERE e > 0),
sized AS (SELECT *, sum(e) OVER (PARTITION BY record_id) AS refs FROM pairs),
scored AS (SELECT p.record_id, p.e, p.o, refs, CASE WHEN p.e = 0 THEN 1.0::DOUBLE ELSE 1 - cd END AS s, -ln((p.e + 0.5::DOUBLE) / (refs + 0.5::DOUBLE * 1000)) AS r, CASE WHEN p.e > 0 THEN p.e / refs * ln(p.e / refs + 1e-12) END AS plnp FROM sized p LEFT JOIN ranked USING (record_id, key)),
loo AS (SELECT record_id, sum(o * s) / sum(o) AS specificity_score, max(s) FILTER (o > 0) AS max_specificity, coalesce(sum(o) FILTER (e = 0), 0) / sum(o) AS unseen_bin_rate,
 coalesce(sum(o) FILTER (s >= 0.95 - 1e-12), 0) / sum(o) AS extreme_specificity_rate, sum(o * r) / sum(o) AS mean_rarity, max(r) FILTER (o > 0) AS max_rarity, sum(o)::BIGINT AS valid_rows, any_value(refs)::BIGINT AS reference_rows,
 count(*) FILTER (e > 0) AS occupied_bins, -sum(plnp) / ln(count(*) FILTER (e > 0)) AS e FROM scored GROUP BY 1),
terms AS (SELECT *, reference_rows / (reference_rows + 1000::DOUBLE) AS s, occupied_bins / 1000::DOUBLE AS c FROM loo),
now_ AS (SELECT *, pow(s * c * e, 1.0::DOUBLE / 3) AS confidence FROM terms),
was AS (SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 101) / 100::DOUBLE END AS uploaded_specificity, CASE WHEN s_suppkey % 9 <> 0 THEN (s_suppkey % 10) / 10::DOUBLE END AS uploaded_confidence FROM supplier),
both_ AS (SELECT *, CASE WHEN uploaded_specificity >= 0.75 AND specificity_score <= 0.55 THEN 'fell' WHEN uploaded_specificity IS NULL THEN NULL WHEN specificity_score >= 0.75 THEN 'specific' ELSE 'mild' END AS kind FROM now_ JOIN was USING (record_id))
SELECT record_id, round(specificity_score, 6) AS specificity_score, round(max_specificity, 6) AS max_specificity, round(unseen_bin_rate, 6) AS unseen_bin_rate, round(extreme_specificity_rate, 6) AS extreme_specificity_rate,
 round(mean_rarity, 6) AS mean_rarity, round(max_rarity, 6) AS max_rarity, valid_rows, reference_rows, occupied_bins, round(s, 6) AS s, round(c, 6) AS c, round(e, 6) AS e, round(confidence, 6) AS confidence, uploaded_specificity, uploaded_confidence,
 round(specificity_score - uploaded_specificity, 6) AS specificity_delta, round(confidence - uploaded_confidence, 6) AS confidence_delta,
 CASE WHEN kind IS NULL AND coalesce(uploaded_confidence, 1) >= 0.4 THEN 'similar' ELSE concat_ws(',', kind, CASE WHEN uploaded_confidence < 0.4 THEN 'weak_support' END) END AS interpretation FROM both_"""


@query(_LOO)
def reevaluate_all(spark, sf_dir):
    """Every record against all others, beside what was saved at its upload (here made from its id; some have no score, some no confidence)."""
    now = density.reevaluated(priced(spark, sf_dir), PRICING, "record_id", valid_bins=PRICING.total_bins)
    key = F.col("s_suppkey")
    was = table(spark, sf_dir, "supplier").select(key.alias("record_id"), F.when(key % 7 != 0, (key % 101) / 100.0).alias("specificity_score"), F.when(key % 9 != 0, (key % 10) / 10.0).alias("confidence"))
    return rounded(density.compared_with_upload(now, was, "record_id"))


_LOO_ROLES = f"""WITH own AS (SELECT record_id, key, count(*) AS o FROM {sql_cells(ROLES.design)} WHERE status = 'valid' GROUP BY ALL),
pairs AS (SELECT r.record_id, w.g - coalesce(own.o, 0) AS e FROM (SELECT DISTINCT record_id FROM own) r CROSS JOIN (SELECT key, sum(o)::BIGINT AS g FROM own GROUP BY 1) w LEFT JOIN own ON own.record_id = r.record_id AND own.key = w.key)
SELECT record_id, reference_rows, occupied_bins, {_ROUND_TERMS} FROM {_confidence_sql("(SELECT record_id, e AS cnt FROM pairs)", "100", 1000.0, "record_id")}"""


@query(_LOO_ROLES)
def reevaluate_roles(spark, sf_dir):
    """The confidence of the others of every record, where it is on another grid than the scores: that of the input axes."""
    got = density.reevaluated(priced(spark, sf_dir, ROLES), ROLES, "record_id", priced(spark, sf_dir, ROLES.design), ROLES.design.total_bins)
    return rounded(got.select("record_id", "reference_rows", "occupied_bins", "s", "c", "e", "confidence"))


_TERMS = {"confidence": "confidence", "coverage": "c", "equitability": "e", "specificity": "specificity_score", "mean_rarity": "mean_rarity"}


@query(f"""WITH m AS ({_three_modes_sql(FINE)}), x AS (SELECT * FROM m WHERE mode = 'external'), p AS (SELECT * FROM m WHERE mode = 'pooled'), n AS (SELECT count(*) AS peers FROM {SQL_HEADERS} WHERE {_PEER} AND record_id <> {TARGET})
SELECT {", ".join(f"x.{c} AS all_{t}, x.{c} AS without_{t}, 0.0::DOUBLE AS delta_{t}, round(x.{c} - p.{c}, 6) AS effect_{t}" for t, c in _TERMS.items())}, peers AS peers_all, peers AS peers_without, bin_uniqueness
FROM x CROSS JOIN p CROSS JOIN n CROSS JOIN ({SQL["bin_uniqueness"]})""")
def delete_impact(spark, sf_dir):
    peers = records.peers(headers(spark, sf_dir), "pricing", PRICING.names, str(TARGET))
    return density.delete_impact(_three_modes(spark, sf_dir, FINE), peers, bin_uniqueness(spark, sf_dir))


def _store(spark) -> tables.Store:
    """A store of its own for each run, in the folder that all of the cluster sees."""
    return tables.Store(spark, f"{files.shared_folder(spark)}/store-{uuid.uuid4().hex}")


@query(f"SELECT record_id FROM {SQL_HEADERS} WHERE record_id <> {TARGET}")
def delete_record(spark, sf_dir):
    """Two records are deleted in a store, and one of them is saved again."""
    store, rows = _store(spark), headers(spark, sf_dir).select(F.col("record_id").cast("string").alias("record_id"), F.trim("goal_id").alias("goal_id"))
    store.append("records", rows)
    for record in (TARGET, TARGET + 1):
        store.delete_record(str(record))
    store.append("records", rows.where(F.col("record_id") == str(TARGET + 1)))
    return store.records().select(F.col("record_id").cast("long").alias("record_id"))


@query(f"SELECT record_id, trim(goal_id) AS goal_id, len(keys) AS n_axes, grid_signature IS NOT NULL AS has_grid FROM {SQL_HEADERS}")
def record_summaries(spark, sf_dir):
    return headers(spark, sf_dir).select("record_id", F.trim("goal_id").alias("goal_id"), F.size("axis_names").cast("long").alias("n_axes"), F.col("grid_signature").isNotNull().alias("has_grid"))


@query("""SELECT s_suppkey AS record_id, round(s_acctbal, 2) AS specificity_score, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 10 END::BIGINT AS total_bins, s_suppkey % 3 = 0 AS mask_enabled, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END::INTEGER AS warnings,
  CASE WHEN s_suppkey % 7 <> 0 THEN '{}' END AS modes, CASE WHEN s_suppkey % 6 = 0 THEN s_name END AS note, s_suppkey / 4.0::DOUBLE AS evenness FROM supplier""")
def snapshots_at_upload(spark, sf_dir):
    """Snapshots as JSON, made from suppliers: odd ones in the older spelling, some with both, with keys of no meaning, values of a
    wrong type or explicit nulls."""
    k, old = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 1
    key = lambda new, older, value: F.when(old, F.concat(F.lit(f'"{older}":'), value)).otherwise(F.concat(F.lit(f'"{new}":'), value))
    parts = F.array_compact(F.array(
        F.when(k % 9 == 0, F.lit('"specificity_score":-1')),
        key("specificityScore", "specificity_score", F.round("s_acctbal", 2).cast("string")),
        key("totalBins", "total_bins", F.when(k % 5 == 0, F.lit('"many"')).otherwise((k % 10).cast("string"))),
        key("feasibleMaskEnabled", "feasible_mask_enabled", (k % 3 == 0).cast("string")),
        key("equitabilityE", "equitability_e", (k / 4.0).cast("string")),
        F.when(k % 4 == 0, F.lit('"outOfDomainWarnings":[{"axis":"x"}]')).when(k % 4 == 1, F.lit('"outOfDomainWarnings":3')),
        F.when(k % 7 == 0, F.lit('"referenceModes":null')),
        F.when(k % 6 == 0, F.concat(F.lit('"note":"'), F.col("s_name"), F.lit('"'))),
    ))
    texts = table(spark, sf_dir, "supplier").select(k.alias("record_id"), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("t"))
    got = texts.select("record_id", saved.snapshot(F.col("t")).alias("s"))
    modes = F.when(F.col("s.referenceModes").isNotNull(), F.col("s.referenceModes"))
    return got.select(
        "record_id", F.col("s.specificityScore").alias("specificity_score"), F.col("s.totalBins").alias("total_bins"), F.col("s.feasibleMaskEnabled").alias("mask_enabled"),
        F.size(F.from_json("s.outOfDomainWarnings", "array<string>")).alias("warnings"), modes.alias("modes"), F.col("s.other")["note"].alias("note"), F.col("s.equitabilityE").alias("evenness"),
    )


_SQL_SAVED = """(SELECT s_suppkey AS k, CASE s_suppkey % 11 WHEN 1 THEN 'no_object' WHEN 2 THEN 'no_axis_names' WHEN 3 THEN 'value_no_number' WHEN 4 THEN 'lengths_differ' WHEN 5 THEN 'no_goal' WHEN 6 THEN 'row_count_no_number' WHEN 7 THEN 'no_values' END AS reason FROM supplier)"""


def _saved_texts(spark, sf_dir) -> DataFrame:
    """A store's contents of 50 records each, made from suppliers: lists, and objects with ``clusters``; many records lack something."""
    k = F.col("s_suppkey")
    bad = lambda n, wrong, right: F.when(k % 11 == n, F.lit(wrong)).otherwise(right)
    text = k.cast("string")
    fields = F.array_compact(F.array(
        F.concat(F.lit('"id":"'), text, F.lit('"')),
        F.when(k % 11 != 5, F.lit('"goalId":" g "')),
        bad(2, '"axisNames":7', F.lit('"axisNames":["Price ","discount"]')),
        F.when(k % 11 == 7, F.lit('"values":null')).when(k % 11 == 3, F.lit('"values":[1,"x"]')).when(k % 11 == 4, F.lit('"values":[1]')).otherwise(F.concat(F.lit('"values":["'), text, F.lit('",0.5]'))),
        bad(6, '"rowCount":"many"', F.concat(F.lit('"rowCount":'), (k % 3).cast("string"))),
        F.concat(F.lit('"binOccupancy":{"[0,1]":'), (k % 5).cast("string"), F.lit(',"[1,1]":"2","[2,2]":-1,"[3,3]":"x"}')),
        F.lit('"rowLevelVectors":[[1,2],[3],["4","5"],[6,null],"x"],"further":{"a":1}'),
        F.when(k % 2 == 0, F.lit('"createdAt":"2020","binOccupancyHash":"given"')),
        F.lit('"analysisAtUpload":{"specificity_score":0.25}'),
    ))
    item = F.when(k % 11 == 1, F.lit("[1]")).otherwise(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")))
    lists = table(spark, sf_dir, "supplier").groupBy(F.floor(k / 50).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("l"))
    return lists.select(F.when(F.col("part") % 2 == 0, F.col("l")).otherwise(F.concat(F.lit('{"version":1,"clusters":'), F.col("l"), F.lit("}"))).alias("content"))


@query(f"""SELECT k::VARCHAR AS record_id, 'g' AS goal_id, 'discount|price' AS axes, k::DOUBLE AS first_value, CASE WHEN k % 3 = 0 THEN 1 ELSE k % 3 END AS row_count, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END::INTEGER AS cells, 2 + k % 5 AS valid_rows, 2 AS vectors,
  CASE WHEN k % 2 = 0 THEN 'given' WHEN k % 5 = 0 THEN sha256('{{"[1,1]":2}}') ELSE sha256('{{"[0,1]":' || k % 5 || ',"[1,1]":2}}') END AS occupancy_hash, CASE WHEN k % 2 = 0 THEN '2020' ELSE 'now' END AS created_at, 0.25::DOUBLE AS specificity_at_upload FROM {_SQL_SAVED} WHERE reason IS NULL""")
def saved_records(spark, sf_dir):
    """Records that can be used, of contents in both shapes."""
    got = saved.usable(saved.records(_saved_texts(spark, sf_dir).select(F.explode(saved.items(F.col("content"))).alias("item")), "now"))
    return got.select(
        "record_id", "goal_id", F.col("axis_signature").alias("axes"), F.col("values")[0].alias("first_value"), "row_count", F.size("bin_occupancy").alias("cells"), F.col("meta.valid_rows").alias("valid_rows"), F.size("vectors").alias("vectors"),
        "occupancy_hash", "created_at", F.col("at_upload.specificityScore").alias("specificity_at_upload"),
    )


@query(f"SELECT reason, count(*) AS records FROM {_SQL_SAVED} WHERE reason IS NOT NULL GROUP BY 1")
def saved_records_dropped(spark, sf_dir):
    return saved.dropped(saved.records(_saved_texts(spark, sf_dir).select(F.explode(saved.items(F.col("content"))).alias("item")), "now"))


_SQL_GOALS = """(SELECT s_suppkey AS k, CASE s_suppkey % 13 WHEN 1 THEN 'no_name' WHEN 2 THEN 'no_axes' WHEN 3 THEN 'k_not_positive' WHEN 4 THEN 'axis_twice' WHEN 5 THEN 'axis_no_number' WHEN 6 THEN 'no_input_axis' WHEN 7 THEN 'axis_domain' WHEN 8 THEN 'axis_resolution' WHEN 9 THEN 'no_object' WHEN 10 THEN 'k_no_number' END AS reason FROM supplier)"""


@query(f"""SELECT reason, CASE WHEN reason IS NULL THEN k::VARCHAR END AS goal_id, CASE WHEN reason IS NULL THEN CASE WHEN k % 2 = 0 THEN 10.0::DOUBLE ELSE 5.0 END END AS k, CASE WHEN reason IS NULL THEN 'Depth|salt|yield' END AS axes, CASE WHEN reason IS NULL THEN 2 END::INTEGER AS inputs,
  CASE WHEN reason IS NULL THEN 10 * (1 + k % 4) END::BIGINT AS total_bins, CASE WHEN reason IS NULL THEN 'b > 1;a < 2' || CASE WHEN k % 3 = 0 THEN ';c == 3' ELSE '' END END AS legacy FROM {_SQL_GOALS}""")
def stored_goals(spark, sf_dir):
    """Goals as JSON, made from suppliers: many have something wrong with them."""
    k = F.col("s_suppkey")
    bad = lambda n, wrong, right: F.when(k % 13 == n, F.lit(wrong)).otherwise(right)
    axis = lambda name, low, high, step, more="": F.concat(F.lit(f'{{"name":"{name}","domainMin":{low},"domainMax":'), high, F.lit(',"resolution":'), step, F.lit(f"{more}}}"))
    depth = axis("Depth", 0, bad(7, "0", F.lit('"10"')), F.when(k % 13 == 8, "-1").when(k % 13 == 5, '"x"').otherwise("1"), ',"unit":" m "')
    salt = F.when(k % 13 == 4, axis(" DEPTH ", 0, F.lit("1"), F.lit("1"))).otherwise(axis(" salt", 0, (1 + k % 4).cast("string"), F.lit("1")))
    out = axis("yield", 0, F.lit("1"), F.lit("0.1"), ',"role":"Output"')
    axes = F.when(k % 13 == 2, F.lit("[]")).when(k % 13 == 6, F.concat(F.lit("["), out, F.lit("]"))).otherwise(F.concat(F.lit("["), F.concat_ws(",", out, salt, depth), F.lit("]")))
    text = F.concat(
        F.lit('{"id":"'), k.cast("string"), F.lit('","name":"'), bad(1, "  ", F.lit(" tide ")), F.lit('","axes":'), axes,
        F.when(k % 13 == 3, ',"K_m":0').when(k % 13 == 10, ',"K_m":"many"').when(k % 2 == 1, ',"km":5').otherwise(""),
        F.lit(',"feasibleDomainRules":[{"expression":"own"}],"legacyAdvancedExpressions":[" b > 1",""],"feasibleDomainAdvancedExpressions":["a < 2","b > 1"],"feasibleDomainExpressions":["own"'),
        F.when(k % 3 == 0, ',"c == 3"').otherwise(""), F.lit("]}"),
    )
    got = saved.goals(table(spark, sf_dir, "supplier").select(F.when(k % 13 == 9, F.lit("7")).otherwise(text).alias("goal")))
    good = lambda c: F.when(F.col("reason").isNull(), c)
    return got.select(
        "reason", good(F.col("goal_id")).alias("goal_id"), good(F.col("k")).alias("k"), good(F.array_join(F.transform("axes", lambda a: a["name"]), "|")).alias("axes"), good(F.size("input_axes")).alias("inputs"),
        good(F.col("total_bins").cast("long")).alias("total_bins"), good(F.array_join("legacy", ";")).alias("legacy"),
    )


@query(f"SELECT goal_id, axis, total_bins::BIGINT AS total_bins, CASE axis WHEN 'price' THEN 'price (EUR)' ELSE axis END AS label FROM (SELECT goal_id, axis, {_SQL_BINS} AS total_bins FROM ({_SQL_GRIDS}))")
def axis_meta(spark, sf_dir):
    axes = _grids(spark, sf_dir).withColumn("unit", F.when(F.col("axis") == "price", "EUR").when(F.col("axis") == "discount", ""))
    return grids.meta(axes).select("goal_id", "axis", "total_bins", "label")


_FINER = replace(MASKED, id="pricing").with_axes([{"name": "price", "step": 50.0}])
_FINER_CELLS = f"(SELECT * FROM {sql_cells(_FINER, source=SQL_OBSERVATIONS)} WHERE record_id IN (SELECT record_id FROM {SQL_HEADERS} WHERE {_PEER}))"


@query(f"""SELECT 'axis' AS what, 'discount' AS name, 10::BIGINT AS amount, count(DISTINCT b0) AS occupied, round(count(DISTINCT b0) / 10, 6) AS coverage FROM {_FINER_CELLS} WHERE status = 'valid'
  UNION ALL SELECT 'axis', 'price', 2000, count(DISTINCT b1), round(count(DISTINCT b1) / 2000, 6) FROM {_FINER_CELLS} WHERE status = 'valid' UNION ALL SELECT 'axis', 'quantity', 10, count(DISTINCT b2), round(count(DISTINCT b2) / 10, 6) FROM {_FINER_CELLS} WHERE status = 'valid'
  UNION ALL SELECT 'axis', '*', 200000, count(DISTINCT key), round(count(DISTINCT key) / {feasible_size(_FINER)["valid_bins"]}, 6) FROM {_FINER_CELLS} WHERE status = 'valid'
  UNION ALL SELECT 'warning', 'too_fine', 200000, NULL, NULL UNION ALL SELECT 'warning', 'masked', {feasible_size(_FINER)["masked_bins"]}, NULL, NULL
  UNION ALL SELECT 'warning', 'legacy_excluded', count(*), NULL, NULL FROM {SQL_HEADERS} WHERE {_PEER} AND record_id NOT IN (SELECT l_suppkey FROM lineitem) HAVING count(*) > 0
  UNION ALL SELECT 'warning', 'axes_excluded', count(*), NULL, NULL FROM {SQL_HEADERS} WHERE trim(goal_id) = 'pricing' AND len(keys) < 3 HAVING count(*) > 0""")
def goal_preview_warnings(spark, sf_dir):
    axes, warned = records.goal_preview(headers(spark, sf_dir), observations(spark, sf_dir), _FINER, ORDER)
    shown = axes.select(F.lit("axis").alias("what"), F.col("axis").alias("name"), F.col("total_bins").alias("amount"), F.col("occupied_bins").alias("occupied"), F.round("coverage", 6).alias("coverage"))
    return shown.unionByName(warned.select(F.lit("warning").alias("what"), F.col("kind").alias("name"), "amount"), allowMissingColumns=True)


@query(f"SELECT record_id, key, count(*) AS cnt FROM {sql_cells(ROLES.design)} WHERE status = 'valid' AND {_HALF} GROUP BY ALL")
def stored_or_rebinned_design(spark, sf_dir):
    """On the grid of the input axes: the records without vectors have only histograms of the whole grid, which cannot stand in."""
    maps = keyed(occupancy.histogram(priced(spark, sf_dir), PRICING, ["record_id"]))
    return keyed(records.chosen_design_counts(observations(spark, sf_dir).where(_HALF), maps, ROLES, ORDER))


@query(f"""SELECT specificity_score AS "specificityScore", s AS "observationSupportS", confidence, reference_rows AS "peerObservationCount", out_of_domain_rows AS "outOfDomainRows", eligible AS "peerGroupSize", '{_REPORT_TIME}' AS "analysisTimestamp", FALSE AS "noExternalReference", 3 AS modes,
  (CASE WHEN masked_out_target_rows > 0 THEN 1 ELSE 0 END + CASE WHEN out_of_domain_rows > 0 THEN 1 ELSE 0 END)::INTEGER AS warnings FROM ({_diagnosed_sql("external")}) CROSS JOIN {_REPORT_PEERS}""")
def snapshot_made(spark, sf_dir):
    """The snapshot that a record keeps of its report, as text and read again."""
    row = _report(spark, sf_dir)
    got = row.select(saved.snapshot(saved.at_upload(row)).alias("s"))
    lists = {"modes": "s.referenceModes", "warnings": "s.outOfDomainWarnings"}
    kept = ("specificityScore", "observationSupportS", "confidence", "peerObservationCount", "outOfDomainRows", "peerGroupSize", "analysisTimestamp", "noExternalReference")
    return rounded(got.select(*[f"s.{c}" for c in kept], *[F.size(F.from_json(c, "array<string>")).alias(n) for n, c in lists.items()]))


_BUILT = ", ".join(f"round(avg(v{k}), 6) AS mean_{n}, round(coalesce(var_samp(v{k}), 0), 4) AS var_{n}, round(coalesce(stddev_samp(v{k}), 0), 6) AS std_{n}" for k, n in enumerate(PRICING.names))


@query(f"SELECT r.*, occupancy_hash, 'discount|price|quantity' AS axes, '{PRICING.signature()}' AS grid_signature FROM (SELECT record_id, {_COUNTERS}, count(*) AS row_count, {_BUILT} FROM {sql_cells(PRICING)} GROUP BY 1) r LEFT JOIN {_HASHES} USING (record_id)")
def make_record(spark, sf_dir):
    out = records.built(lines(spark, sf_dir), PRICING, values())
    out = out.withColumn("axes", F.array_join("axis_names", "|")).drop("axis_names")
    return out.select(*[F.round(n, 4 if n.startswith("var") else 6).alias(n) if t == "double" else F.col(n) for n, t in out.dtypes])


@query(f"SELECT l_suppkey AS record_id, round(avg(l_discount), 6) AS mean_discount, round(avg(l_extendedprice), 6) AS mean_price, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem WHERE l_suppkey IN (SELECT record_id FROM {SQL_HEADERS} WHERE {_PEER}) GROUP BY 1")
def peer_mean_vectors(spark, sf_dir):
    got = records.mean_vectors(records.peers(headers(spark, sf_dir), "pricing", PRICING.names), observations(spark, sf_dir), PRICING, ORDER)
    return got.select("record_id", *[F.round(F.col("means")[k], 6).alias(f"mean_{n}") for k, n in enumerate(PRICING.names)])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (2, 3) THEN 0.0::DOUBLE ELSE l_quantity END AS a, CASE WHEN l_linenumber IN (2, 3) THEN 0.0::DOUBLE ELSE l_discount END AS b FROM lineitem""")
def optional_vectors(spark, sf_dir):
    """One part is no number where l_linenumber is 2, one is missing where it is 3."""
    q, d = F.col("l_quantity").cast("string"), F.col("l_discount").cast("string")
    parts = F.when(F.col("l_linenumber") == 2, F.array(q, F.lit("n/a"))).when(F.col("l_linenumber") == 3, F.array(q)).otherwise(F.array(q, d))
    got = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", cells.optional_floats(parts, 2).alias("v"))
    return got.select("l_orderkey", "l_linenumber", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@query("SELECT l_linenumber - 2 AS x, CAST(floor(l_quantity / 10) AS INTEGER) AS y, count(*) AS cnt FROM lineitem WHERE l_linenumber NOT IN (1, 4) GROUP BY ALL")
def sanitize_tuples(spark, sf_dir):
    """Tuples as text: the first part is negative where l_linenumber is 1, the second no number where it is 4."""
    q = F.when(F.col("l_linenumber") == 4, "x").otherwise(F.floor(F.col("l_quantity") / 10).cast("int").cast("string"))
    got = lines(spark, sf_dir).select(cells.tuple_of(F.array((F.col("l_linenumber") - 2).cast("string"), q), 2).alias("t")).where("t IS NOT NULL")
    return got.groupBy(F.col("t")[0].alias("x"), F.col("t")[1].alias("y")).agg(F.count("*").alias("cnt"))


@query(f"SELECT * FROM {_SQL_PREVIEWED}")
def preview_axes_merge(spark, sf_dir):
    return _previewed(spark, sf_dir)


_PREVIEW = PRICING.with_axes([{"name": "discount", "step": 0.02}, {"name": "price", "high": 200000.0}])


@query(_three_modes_sql(_PREVIEW))
def grid_preview(spark, sf_dir):
    return _three_modes(spark, sf_dir, _PREVIEW)


_COARSER = [{"name": " Discount", "step": 0.02}, {"name": "PRICE", "high": 200000.0}]
_LOOKED_AT = replace(MASKED, id="pricing").with_axes(_COARSER)
_ROLES_LOOKED_AT = replace(ROLES, id="pricing").with_axes(_COARSER)
_PEERS_AND_TARGET = f"(SELECT * FROM lineitem WHERE l_suppkey = {TARGET} OR l_suppkey IN (SELECT record_id FROM {SQL_HEADERS} WHERE {_PEER}))"
_TOO_FINE = [{"name": "price", "step": 0.5}]


def _request_sql(name: str, goal: Goal, target: bool) -> str:
    """The peers' part and, with a target, the three modes."""
    size, design = feasible_size(goal.design), goal.design
    mine = f"(SELECT record_id FROM {SQL_HEADERS} WHERE {_PEER} AND record_id <> {TARGET})"
    alone = _confidence_sql(f"(SELECT 1 AS one, key, count(*) AS cnt FROM {sql_cells(design)} WHERE status = 'valid' AND record_id IN {mine} GROUP BY ALL)", str(size["valid_bins"]), goal.k, "one", "0")
    modes = _three_modes_sql(goal, source=_PEERS_AND_TARGET) if target else ""
    terms = "reference_rows AS preview_rows, occupied_bins AS preview_bins, round(s, 6) AS preview_s, round(c, 6) AS preview_c, round(e, 6) AS preview_e, round(confidence, 6) AS preview_confidence"
    scores = "mode, specificity_score, max_specificity, extreme_specificity_rate, unseen_bin_rate, mean_rarity, max_rarity, s, c, e, confidence, reference_rows, occupied_bins, valid_target_rows"
    blank = "CAST(NULL AS VARCHAR) AS mode, " + ", ".join(f"CAST(NULL AS {'BIGINT' if n.strip() in ('reference_rows', 'occupied_bins', 'valid_target_rows') else 'DOUBLE'}) AS {n}" for n in scores.split(", ")[1:])
    known = f"SELECT '{name}' AS request, FALSE AS skipped, {goal.total_bins}::BIGINT AS total_bins, {size['masked_bins']}::BIGINT AS masked_bins, {size['valid_bins']}::BIGINT AS valid_bins, seen AS eligible_records, n - seen AS legacy_excluded, p.* EXCLUDE (one)"
    count = f"(SELECT count(*) AS n, count(*) FILTER (record_id IN (SELECT l_suppkey FROM lineitem)) AS seen FROM {mine})"
    if target:
        return f"{known}, {', '.join(f'm.{c}' for c in scores.split(', '))} FROM (SELECT one, {terms} FROM {alone}) p CROSS JOIN {count} CROSS JOIN ({modes}) m"
    return f"{known}, {blank} FROM (SELECT one, {terms} FROM {alone}) p CROSS JOIN {count}"


_SKIPPED_SQL = "SELECT 'skipped' AS request, TRUE AS skipped, 20000000::BIGINT AS total_bins, 0::BIGINT AS masked_bins, 20000000::BIGINT AS valid_bins, 0 AS eligible_records, 0 AS legacy_excluded, 0 AS preview_rows, 0 AS preview_bins, 0 AS preview_s, NULL AS preview_c, 0 AS preview_e, NULL AS preview_confidence, NULL AS mode, NULL AS specificity_score, NULL AS max_specificity, NULL AS extreme_specificity_rate, NULL AS unseen_bin_rate, NULL AS mean_rarity, NULL AS max_rarity, NULL AS s, NULL AS c, NULL AS e, NULL AS confidence, NULL AS reference_rows, NULL AS occupied_bins, NULL AS valid_target_rows"


@query(" UNION ALL BY NAME ".join(f"(SELECT * FROM ({x}))" for x in (_request_sql("masked", _LOOKED_AT, True), _request_sql("roles", _ROLES_LOOKED_AT, True), _request_sql("peers", _LOOKED_AT, False), _SKIPPED_SQL)))
def preview_request(spark, sf_dir):
    """Previews with a target, on grids with rules and with an output axis; of the peers alone; and one that is too fine to be made."""
    rows, own = observations(spark, sf_dir), observations(spark, sf_dir).where(F.col("record_id") == TARGET).select("v")
    heads, masked, roles = headers(spark, sf_dir), replace(MASKED, id="pricing"), replace(ROLES, id="pricing")
    ask = lambda name, goal, changes, target: preview.request(heads, rows, goal, goal.names, changes, ORDER, target, without=str(TARGET)).withColumn("request", F.lit(name))
    asked = [ask("masked", masked, _COARSER, own), ask("roles", roles, _COARSER, own), ask("peers", masked, _COARSER, None), ask("skipped", replace(PRICING, id="pricing"), _TOO_FINE, own)]
    out = rounded(reduce(DataFrame.unionByName, asked))
    return out.withColumns({c: F.col(c).cast("long") for c in ("total_bins", "masked_bins", "valid_bins")})


@query(f"SELECT record_id, count(*) FILTER (status = 'valid') AS valid_rows, count(DISTINCT key) FILTER (status = 'valid') AS occupied_bins, '{_PREVIEW.signature()}' AS grid_signature FROM {sql_cells(_PREVIEW, source=SQL_OBSERVATIONS)} GROUP BY 1")
def apply_grid(spark, sf_dir):
    rows = occupancy.rebinned(observations(spark, sf_dir), _PREVIEW, ORDER, ["record_id"])
    valid = F.col("status") == "valid"
    return rows.groupBy("record_id").agg(F.count(F.when(valid, 1)).alias("valid_rows"), F.count_distinct(F.when(valid, cells.bin_key(F.col("cell")))).alias("occupied_bins")).withColumn("grid_signature", F.lit(_PREVIEW.signature()))


@query(f"""SELECT record_id, row_count, round(mean_price, 6) AS mean_price, h.occupancy_hash, '{_PREVIEW.signature()}' AS grid_signature FROM (SELECT l_suppkey AS record_id, count(*) AS row_count, avg(l_extendedprice) AS mean_price FROM lineitem WHERE l_suppkey <> {TARGET} GROUP BY 1)
  LEFT JOIN (SELECT record_id, sha256('{{' || string_agg('"' || key || '":' || cnt, ',' ORDER BY '"' || key || '":' || cnt) || '}}') AS occupancy_hash FROM (SELECT record_id, key, count(*) AS cnt FROM {sql_cells(_PREVIEW)} WHERE status = 'valid' GROUP BY ALL) GROUP BY 1) h USING (record_id)""")
def apply_grid_stored(spark, sf_dir):
    """Half of the observations are saved and a grid is applied; then the others, and another grid; a record is deleted.  What
    is read back through the store has all rows, on the second grid."""
    store = _store(spark)
    rows = observations(spark, sf_dir).select(F.col("record_id").cast("string").alias("record_id"), F.lit(PRICING.id).alias("goal_id"), "v")
    store.save_goals([PRICING])
    store.append("records", rows.select("record_id", "goal_id").distinct())
    store.append("observations", rows.where(F.col("v")[2] < 25))
    store.apply_grid(PRICING.id, [{"name": "discount", "step": 0.05}], ORDER)
    store.append("observations", rows.where(F.col("v")[2] >= 25))
    store.delete_record(str(TARGET))
    now = store.apply_grid(PRICING.id, [{"name": "discount", "step": 0.02}, {"name": "price", "high": 200000.0}], ORDER)
    return now.select(F.col("record_id").cast("long").alias("record_id"), "row_count", F.round("mean_price", 6).alias("mean_price"), "occupancy_hash", "grid_signature")


@query("""SELECT event_id::VARCHAR AS log_id, user_id::VARCHAR AS session_id, CASE WHEN event_id % 5 = 2 THEN 1 ELSE greatest(1, event_id % 7) END AS sequence, CASE WHEN event_id % 4 = 0 THEN 'preview_recalculated' ELSE event_type END AS action,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS axes, CASE WHEN event_id % 3 = 0 THEN value END AS step, 2::INTEGER AS modes, CASE WHEN event_id % 6 <> 1 THEN value END AS confidence, event_id % 2 = 0 AS applied FROM events WHERE event_id % 11 <> 5""")
def preview_logs_read(spark, sf_dir):
    """Log entries as JSON, made from events: some have no time, axes without a number, values of a wrong type."""
    k, value = F.col("event_id"), F.col("value").cast("string")
    axes = F.concat(F.lit('[{"name":" depth ","domainMin":0,"domainMax":"9","resolution":'), F.when(k % 3 == 0, value).otherwise(F.lit('"x"')), F.lit("},7]"))
    modes = F.concat(F.lit('{"pooled":{"label":"","confidence":'), F.when(k % 6 == 1, F.lit('"high"')).otherwise(value), F.lit(',"occupiedBins":"3"},"external":{"noExternalReference":1},"internal":4,"other":{}}'))
    text = F.concat(
        F.lit('{"id":"'), k.cast("string"), F.lit('","sessionId":" '), F.col("user_id").cast("string"), F.lit('","sequence":'), F.when(k % 5 == 2, F.lit('"?"')).otherwise((k % 7).cast("string")), F.when(k % 11 != 5, ',"createdAt":"2024"').otherwise(""),
        F.when(k % 4 != 0, F.concat(F.lit(',"action":"'), F.col("event_type"), F.lit('"'))).otherwise(""), F.lit(',"axesAfter":'), axes, F.lit(',"referenceModesAfter":'), modes, F.lit(',"appliedAsGoalDefault":'), (k % 2 == 0).cast("string"), F.lit("}"),
    )
    got = saved.logs(table(spark, sf_dir, "events").select(text.alias("entry")))
    pooled = F.get(F.filter("modes_after", lambda m: m["mode"] == "pooled"), F.lit(0))
    return got.select("log_id", "session_id", "sequence", "action", F.size("axes_after").alias("axes"), F.get("axes_after", F.lit(0))["step"].alias("step"), F.size("modes_after").alias("modes"), pooled["confidence"].alias("confidence"), "applied")


_LOGS = "(SELECT event_id AS log_id, user_id AS session_id, ts AS created_at, CASE WHEN event_type = 'click' THEN event_type END AS axes_before, props AS axes_after, 'goal' AS goal_axes FROM events)"


def _logs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("log_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", F.col("event_type")).alias("axes_before"), F.col("props").alias("axes_after"), F.lit("goal").alias("goal_axes"))


@query(f"SELECT log_id, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, log_id) AS INTEGER) AS sequence FROM {_LOGS}")
def preview_log_sequence(spark, sf_dir):
    return records.previous(_logs(spark, sf_dir)).select("log_id", "session_id", "sequence")


@query(f"SELECT log_id, coalesce(axes_before, lag(axes_after) OVER (PARTITION BY session_id ORDER BY created_at, log_id), goal_axes) AS before FROM {_LOGS}")
def preview_log_previous(spark, sf_dir):
    return records.previous(_logs(spark, sf_dir)).select("log_id", "before")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS name FROM nation UNION ALL SELECT 1000, 'new'")
def goal_upsert(spark, sf_dir):
    """Goals of a store, one for each nation: one is changed, one is new, one comes and goes."""
    store, axes = _store(spark), PRICING.axes
    store.save_goals([Goal(str(r.n_nationkey), axes, name=r.n_name) for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()])  # goals are few
    for goal in (Goal("3", axes, name="changed"), Goal("1000", axes, name="new"), Goal("2000", axes)):
        store.upsert_goal(goal)
    store.delete_goal("2000")
    return spark.createDataFrame([(int(g.id), g.name) for g in store.load_goals()], "id long, name string")
