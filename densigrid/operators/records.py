"""Saved records (one for each uploaded dataset) and their observations.

Two tables: headers, one row for each record ``(record_id, goal_id, axis_names array<string>, ...)``, and observations
``(record_id, v array<double>)``.  Whatever the reference density needs is one aggregation over observations.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.functions import cells
from densigrid.operators.occupancy import binned, cell_counters, counters, from_keys, histogram, per_cell, summary, vector_values
from densigrid.operators.grids import MANY_BINS
from densigrid.plans.grid import Goal, axis_key, peer_key
from densigrid.plans.rules import feasible_size


def has_axes(names: list[str], column: str = "axis_names") -> Column:
    """Does a record have all these axes?"""
    return F.size(F.array_except(F.array(*[F.lit(axis_key(n)) for n in names]), F.transform(column, cells.axis_key))) == 0


def peers(headers: DataFrame, goal_id: str, names: list[str], without: str | None = None) -> DataFrame:
    """Records of the goal that have all selected axes, but for the one that is being looked at."""
    rows = headers.where((F.trim("goal_id") == goal_id.strip()) & has_axes(names))
    return rows if without is None else rows.where(F.col("record_id").cast("string") != without)


def filter_reasons(headers: DataFrame, goal_id: str, names: list[str], without: str | None = None) -> DataFrame:
    """record_id, reason: why each record is or is not a peer; self is tested first, then the goal, then the axes."""
    reason = F.when(F.col("record_id").cast("string") == (without or ""), "excluded_self").when(F.trim("goal_id") != goal_id.strip(), "different_goal").when(~has_axes(names), "axis_mismatch").otherwise("peer")
    return headers.select("record_id", "goal_id", reason.alias("reason"))


def filter_diagnostics(reasons: DataFrame, examples: int = 3) -> DataFrame:
    """reason, records and, of the excluded ones, the first few ids in order."""
    first = reasons.where("reason <> 'peer'").orderBy("record_id").limit(examples)
    shown = first.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("record_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return reasons.groupBy("reason").agg(F.count("*").alias("records")).join(F.broadcast(shown), "reason", "left").select("reason", "records", F.coalesce("examples", F.lit("")).alias("examples"))


def global_counts(headers: DataFrame, observations: DataFrame, goal: Goal, order: list[str], boxes: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """The reference density (cell, cnt), and one row of counters: eligible records (also if none of their rows is
    valid), records left out for want of vectors, observations, occupied cells, infeasible rows and cells."""
    rows = binned(observations.join(headers.select("record_id"), "record_id", "left_semi"), goal, vector_values(goal, order), ["record_id"], boxes)
    inner = cell_counters(per_cell(rows, goal), goal, boxes=boxes).select(
        F.col("valid_rows").alias("observations"), F.col("valid_bins").alias("occupied_bins"), F.col("masked_rows").alias("infeasible_rows"), F.col("masked_bins").alias("infeasible_bins")
    )
    eligible = rows.agg(F.count_distinct("record_id").alias("eligible_records"))
    facts = headers.agg(F.count_distinct("record_id").alias("records")).crossJoin(eligible).crossJoin(inner)  # of one row each
    facts = facts.select("eligible_records", (F.col("records") - F.col("eligible_records")).alias("legacy_excluded"), "observations", "occupied_bins", "infeasible_rows", "infeasible_bins")
    return histogram(rows, goal, boxes=boxes), facts


def stored_counts(headers: DataFrame, maps: DataFrame, names: list[str]) -> DataFrame:
    """Sum of stored histograms (record_id, key, cnt) of records whose axis signature is that of ``names``: no re-binning."""
    from densigrid.plans.grid import subset_key

    same = headers.where((cells.subset_key(F.col("axis_names")) == subset_key(names)) & (F.coalesce("grid_signature", F.lit("")) != ""))
    return maps.where("cnt > 0").join(same.select("record_id"), "record_id", "left_semi").groupBy("key").agg(F.sum("cnt").alias("cnt"))


def chosen_counts(observations: DataFrame, stored: DataFrame, goal: Goal, order: list[str]) -> DataFrame:
    """record_id, cell, cnt: histograms from the vectors of records that have them, on the goal's present grid, and else
    those that were stored (record_id, key, cnt)."""
    made = histogram(binned(observations, goal, vector_values(goal, order), ["record_id"]), goal, ["record_id"])
    old = from_keys(stored.join(observations.select("record_id").distinct(), "record_id", "left_anti"), goal, by=["record_id"])
    return made.unionByName(old)


def chosen_design_counts(observations: DataFrame, stored: DataFrame, goal: Goal, order: list[str]) -> DataFrame:
    """``chosen_counts`` on the grid of the input axes: stored histograms stand in only where that is the whole grid, as they hold
    no other."""
    design = goal.design
    return chosen_counts(observations, stored if design.names == goal.names else stored.limit(0), design, order)


def goal_preview(headers: DataFrame, observations: DataFrame, goal: Goal, order: list[str], boxes: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """How much of a goal's grid of input axes its records fill: (axis, total_bins, occupied_bins, coverage), with a row ``*`` for the
    whole grid (coverage of its valid cells), and (kind, amount) of what the user should know.

    too_fine: the grid has more than MANY_BINS cells; legacy_excluded: records without vectors; axes_excluded: records of the
    goal that lack an axis; masked: the rules mask cells.
    """
    design = goal.design
    mine = peers(headers, goal.id, goal.names)
    counts, facts = global_counts(mine, observations, design, order, boxes)
    size = feasible_size(design)
    parts = [F.struct(F.lit(a.name).alias("axis"), F.col("cell")[k].cast("string").alias("at")) for k, a in enumerate(design.axes)] + [F.struct(F.lit("*").alias("axis"), cells.bin_key(F.col("cell")).alias("at"))]
    met = counts.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.axis").agg(F.count_distinct("p.at").alias("occupied_bins"))
    every = [(a.name, a.bins, float(a.bins)) for a in design.axes] + [("*", design.total_bins, float(size["valid_bins"]))]
    known = counts.sparkSession.createDataFrame(every, "axis string, total_bins long, of double")
    filled = F.coalesce("occupied_bins", F.lit(0)).cast("long")
    axes = known.join(met, "axis", "left").select("axis", "total_bins", filled.alias("occupied_bins"), F.when(F.col("of") > 0, filled / F.col("of")).otherwise(0.0).alias("coverage"))
    lacking = headers.where((F.trim("goal_id") == goal.id) & ~has_axes(goal.names)).agg(F.count("*").alias("axes_excluded"))
    told = facts.crossJoin(lacking)  # of one row each
    fine = F.lit(design.total_bins if design.total_bins > MANY_BINS else 0)
    kinds = {"too_fine": fine, "legacy_excluded": F.col("legacy_excluded"), "axes_excluded": F.col("axes_excluded"), "masked": F.lit(size["masked_bins"])}
    warned = told.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("amount")) for k, v in kinds.items()])).alias("w")).select("w.*").where("amount > 0")
    return axes, warned


def peer_counts(headers: DataFrame, observations: DataFrame) -> DataFrame:
    """goal_id, records that have observations."""
    return headers.join(observations.select("record_id").distinct(), "record_id", "left_semi").groupBy("goal_id").agg(F.count_distinct("record_id").alias("peers"))


def subset_counts(headers: DataFrame, observations: DataFrame, goal: Goal) -> DataFrame:
    """subset, peers: for each non-empty set of the goal's axes, the records that have them all and have vectors.

    Sets without an input axis count none.  Records are read once; the sets are made on the driver (2^d - 1 of them).
    """
    sets = [[a.key for a in s] for n in range(1, len(goal.axes) + 1) for s in combinations(goal.axes, n)]
    inputs = {a.key for a in goal.axes if a.is_input}
    some = headers.where(F.trim("goal_id") == goal.id).join(observations.select("record_id").distinct(), "record_id", "left_semi")
    keys = F.transform("axis_names", cells.axis_key)
    counts = some.agg(*[F.count_distinct(F.when(F.lit(bool(inputs & set(s))) & (F.size(F.array_except(F.array(*[F.lit(k) for k in s]), keys)) == 0), F.col("record_id"))).alias(f"c{i}") for i, s in enumerate(sets)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit("|".join(sorted(s))).alias("subset"), F.col(f"c{i}").alias("peers")) for i, s in enumerate(sets)])).alias("r")).select("r.*")


def occupancy_hash(counts: DataFrame, by: list[str]) -> DataFrame:
    """by..., occupancy_hash: sha256 of the histogram as a compact JSON object with sorted keys.

    A digest of one text needs that text: a record's occupied cells (not its rows) are gathered in one row, some 20 bytes each.
    """
    item = F.concat(F.lit('"'), cells.bin_key(F.col("cell")), F.lit('":'), F.col("cnt").cast("string"))
    return counts.groupBy(*by).agg(F.sha2(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("}")), 256).alias("occupancy_hash"))


def fingerprints(summaries: DataFrame, goal: Goal) -> DataFrame:
    """record_id, fingerprint of records summarised as (record_id, occupancy_hash, row_count, means array<double>)."""
    values = F.array_join(F.transform("means", lambda x: F.format_number(x, 12)), ",")
    text = F.concat_ws("|", F.lit(peer_key(goal.id, goal.names)), values, F.col("row_count").cast("string"), F.lit("mean"), F.col("occupancy_hash"), F.lit(goal.signature()))
    return summaries.select("record_id", F.sha2(text, 256).alias("fingerprint"))


def first_of_each(batch: DataFrame, order: Column) -> DataFrame:
    """Of records with one fingerprint, the first in a stated order: an aggregate, so a large group is not gathered."""
    columns = batch.columns
    best = batch.groupBy("fingerprint").agg(F.min_by(F.struct(*columns), order).alias("r"))
    return best.select("r.*").select(*columns)


def new_records(batch: DataFrame, saved: DataFrame) -> DataFrame:
    return batch.join(saved.select("fingerprint"), "fingerprint", "left_anti")


def uniqueness(own: DataFrame, others: DataFrame) -> DataFrame:
    """bin_uniqueness: does a record have cells, and the others none of them?"""
    met = own.join(others.where("cnt > 0").select("cell").withColumn("met", F.lit(1)), "cell", "left")
    return met.agg(((F.count("*") > 0) & (F.count("met") == 0)).alias("bin_uniqueness"))


def rebuilt(observations: DataFrame, goal: Goal, order: list[str]) -> DataFrame:
    """record_id, row_count, means, variances and occupancy hash of every record on the goal's present grid, in one pass."""
    values = vector_values(goal, order)
    aggs = [F.count("*").alias("row_count")]
    for a in goal.axes:
        aggs += [F.avg(values[a.name]).alias(f"mean_{a.name}"), F.coalesce(F.var_samp(values[a.name]), F.lit(0.0)).alias(f"var_{a.name}")]
    stats = observations.groupBy("record_id").agg(*aggs)
    hashes = occupancy_hash(histogram(binned(observations, goal, values, ["record_id"]), goal, ["record_id"]), ["record_id"])
    return stats.join(hashes, "record_id", "left").withColumn("grid_signature", F.lit(goal.signature()))


def built(rows: DataFrame, goal: Goal, values: dict[str, Column], by: str = "record_id") -> DataFrame:
    """What is saved of each dataset: counters by status, means, variances and deviations of each axis, hash of the histogram,
    signature of the grid, and axis names; datasets without a fully numeric row have null statistics."""
    placed = binned(rows, goal, values, [by])
    record = counters(placed, goal, [by]).join(summary(rows, goal, values, [by]), by, "left").join(occupancy_hash(histogram(placed, goal, [by]), [by]), by, "left")
    return record.withColumns({"axis_names": F.array(*[F.lit(n) for n in goal.names]), "grid_signature": F.lit(goal.signature())})


def mean_vectors(headers: DataFrame, observations: DataFrame, goal: Goal, order: list[str]) -> DataFrame:
    """record_id, means (array in the goal's order of axes) of the given records that have observations."""
    values = vector_values(goal, order)
    means = [F.avg(values[n]) for n in goal.names]
    return observations.join(headers.select("record_id"), "record_id", "left_semi").groupBy("record_id").agg(F.array(*means).alias("means"))


def previous(logs: DataFrame) -> DataFrame:
    """Each log entry of a session with its number, and the axes before it: its own, else those after the entry before, else the goal's."""
    w = Window.partitionBy("session_id").orderBy("created_at", "log_id")
    return logs.withColumns({"sequence": F.row_number().over(w), "before": F.coalesce("axes_before", F.lag("axes_after").over(w), "goal_axes")})
