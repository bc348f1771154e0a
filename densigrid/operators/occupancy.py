"""Rows to cells: status, histograms per cell and per axis, counters, summaries.

A binned frame has the columns asked for, ``status`` and ``cell`` (array<int>, one index for each axis in canonical order,
null where the row is outside the grid).  Histograms are aggregated before they are shuffled; what is shuffled is as many
rows as there are occupied cells, never the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.functions import cells
from densigrid.operators import masks
from densigrid.plans.grid import Axis, Goal, GridError, axis_key
from densigrid.plans.rules import boxes_of


def mapped(df: DataFrame, goal: Goal, mapping: dict[str, str], required: bool = False) -> dict[str, str | None]:
    """Column of each axis; the mapping is looked up by name, then without regard to case and blanks."""
    by_key = {axis_key(k): v for k, v in mapping.items()}
    out: dict[str, str | None] = {}
    for a in goal.axes:
        column = mapping.get(a.name, by_key.get(a.key))
        if column not in df.columns:
            if required:
                raise GridError(f"no column is mapped to axis {a.name}", hint=f"columns: {', '.join(df.columns)}")
            column = None
        out[a.name] = column
    return out


def text_values(df: DataFrame, goal: Goal, mapping: dict[str, str]) -> dict[str, Column]:
    """Cells of text parsed to finite doubles; an axis without a column is invalid in every row."""
    return {n: cells.parsed(F.col(c).cast("string")) if c else F.lit(None).cast("double") for n, c in mapped(df, goal, mapping).items()}


def number_values(df: DataFrame, goal: Goal, mapping: dict[str, str]) -> dict[str, Column]:
    return {n: cells.finite(F.col(c)) for n, c in mapped(df, goal, mapping, required=True).items() if c}


def binned(df: DataFrame, goal: Goal, values: dict[str, Column], keep: list[str] | None = None, boxes: list[dict] | None = None) -> DataFrame:
    """keep..., status, cell, and __invalid: is a value missing?  Above PREDICATE_BOXES boxes the status of rows inside the grid is null:
    which of them are masked is then told for cells, by a join (``histogram``, ``counters``)."""
    boxes = boxes_of(goal) if boxes is None else boxes
    keep = keep or []
    named = df.select(*keep, *[values[a.name].alias(f"__v{k}") for k, a in enumerate(goal.axes)])
    v = {a.name: F.col(f"__v{k}") for k, a in enumerate(goal.axes)}
    placed = named.select("*", *[cells.bin_index(a, v[a.name]).alias(f"__b{k}") for k, a in enumerate(goal.axes)])
    index = {a.name: F.col(f"__b{k}") for k, a in enumerate(goal.axes)}
    many = len(boxes) > masks.PREDICATE_BOXES
    told = cells.status(goal, v, index, [] if many else boxes)
    told = F.when(told != "valid", told) if many else told
    return placed.select(*keep, told.alias("status"), F.array(*index.values()).alias("cell"), cells.any_of([x.isNull() for x in v.values()]).alias("__invalid"))


def indices(goal: Goal) -> list[str]:
    return [f"__b{k}" for k in range(len(goal.axes))]


def in_grid(rows: DataFrame, goal: Goal, *others: Column | str) -> DataFrame:
    """Columns ``others`` and the indices of rows inside the grid, masked cells among them."""
    names = indices(goal)
    flat = rows.select(*others, *[F.col("cell")[k].alias(n) for k, n in enumerate(names)])
    return flat.where(cells.all_of([F.col(n).isNotNull() for n in names]))


def unmasked(counts: DataFrame, goal: Goal, cnt: list[str], boxes: list[dict] | None = None) -> DataFrame:
    """Counts per cell (in index columns) without masked cells, of which there are few: a mask is a function of the cell.

    The test is tied to the counts, so Spark does not move it down to the rows and compute their indices once for each box.
    Many boxes are a join.
    """
    boxes = boxes_of(goal) if boxes is None else boxes
    names = indices(goal)
    if len(boxes) > masks.PREDICATE_BOXES:
        return masks.unmasked(counts.withColumn("cell", F.array(*names)), goal, boxes).drop("cell")
    if not boxes:
        return counts
    free = ~cells.masked(boxes, {a.name: F.col(n) for a, n in zip(goal.axes, names)})
    return counts.where(F.when(free, reduce(lambda a, b: a + b, map(F.col, cnt))).otherwise(0) > 0)


def histogram(rows: DataFrame, goal: Goal, by: list[str] | None = None, boxes: list[dict] | None = None) -> DataFrame:
    """by..., cell, cnt of valid rows: those inside the grid, then without masked cells (``boxes``: as in ``binned``).

    Grouped by plain integers, which aggregate faster than arrays.
    """
    by, names = by or [], indices(goal)
    counts = in_grid(rows, goal, *by).groupBy(*by, *names).agg(F.count("*").alias("cnt"))
    return unmasked(counts, goal, ["cnt"], boxes).select(*by, F.array(*names).alias("cell"), "cnt")


def axis_histogram(rows: DataFrame, goal: Goal, by: list[str] | None = None) -> DataFrame:
    """by..., axis, idx, cnt: one-dimensional histograms of valid rows, from the cells and not from the rows."""
    by = by or []
    counts = histogram(rows, goal, by)
    pairs = F.array(*[F.struct(F.lit(a.name).alias("axis"), F.col("cell")[k].alias("idx")) for k, a in enumerate(goal.axes)])
    return counts.select(*by, F.explode(pairs).alias("p"), "cnt").groupBy(*by, "p.axis", "p.idx").agg(F.sum("cnt").alias("cnt"))


def per_cell(rows: DataFrame, goal: Goal, by: list[str] | None = None) -> DataFrame:
    """by..., the indices (null outside the grid), __invalid, n: the rows of each cell, masked or not, and of what is outside."""
    by, names = by or [], indices(goal)
    inside = cells.all_of([F.col("cell")[k].isNotNull() for k in range(len(names))])
    flat = rows.select(*by, *[F.when(inside, F.col("cell")[k]).alias(n) for k, n in enumerate(names)], "__invalid")
    return flat.groupBy(*by, *names, "__invalid").agg(F.count("*").alias("n"))


def cell_counters(grouped: DataFrame, goal: Goal, by: list[str] | None = None, boxes: list[dict] | None = None) -> DataFrame:
    """by..., total_rows, invalid_rows, out_of_domain_rows, and rows and cells of valid and masked ones, from the rows of
    ``per_cell`` (by the same columns or more); so masks are tested on cells."""
    by, names = by or [], indices(goal)
    boxes = boxes_of(goal) if boxes is None else boxes
    zero, here, n = F.lit(0).cast("long"), F.col(names[0]).isNotNull(), F.col("n")
    amount = lambda on, what, name: F.coalesce(F.sum(F.when(on, what)), zero).cast("long").alias(name)
    apart = [F.coalesce(F.sum("n"), zero).alias("total_rows"), amount(F.col("__invalid"), n, "invalid_rows"), amount(~F.col("__invalid") & ~here, n, "out_of_domain_rows")]
    if len(boxes) <= masks.PREDICATE_BOXES:
        mask = cells.masked(boxes, {a.name: F.col(c) for a, c in zip(goal.axes, names)})
        told = grouped.withColumn("masked", here & mask)
        free = here & ~F.col("masked")
        return told.groupBy(*by).agg(*apart, amount(free, n, "valid_rows"), amount(free, F.lit(1), "valid_bins"), amount(F.col("masked"), n, "masked_rows"), amount(F.col("masked"), F.lit(1), "masked_bins"))
    left = unmasked(grouped.where(here), goal, ["n"], boxes)
    kept = left.groupBy(*by).agg(F.sum("n").alias("valid_rows"), F.count("*").alias("valid_bins"))
    every = grouped.groupBy(*by).agg(*apart, amount(here, n, "in_rows"), amount(here, F.lit(1), "in_bins"))
    out = every.join(kept, by, "left") if by else every.crossJoin(kept)  # of one row each
    valid_rows, valid_bins = F.coalesce("valid_rows", zero), F.coalesce("valid_bins", zero)
    return out.select(*by, "total_rows", "invalid_rows", "out_of_domain_rows", valid_rows.alias("valid_rows"), valid_bins.alias("valid_bins"), (F.col("in_rows") - valid_rows).alias("masked_rows"), (F.col("in_bins") - valid_bins).alias("masked_bins"))


def counters(rows: DataFrame, goal: Goal, by: list[str] | None = None, boxes: list[dict] | None = None) -> DataFrame:
    """Rows by status, in total, and distinct masked cells."""
    return cell_counters(per_cell(rows, goal, by), goal, by, boxes).select(*(by or []), "total_rows", "valid_rows", "invalid_rows", "out_of_domain_rows", "masked_rows", "masked_bins")


def summary(df: DataFrame, goal: Goal, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows in which every axis is numeric, and mean, variance and deviation (n - 1; 0 for one row) of each axis over them."""
    by = by or []
    good = df.select(*by, *[values[a.name].alias(a.name) for a in goal.axes]).na.drop(subset=goal.names)
    stats = [s for n in goal.names for s in (F.avg(n).alias(f"mean_{n}"), F.coalesce(F.var_samp(n), F.lit(0.0)).alias(f"var_{n}"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias(f"std_{n}"))]
    return good.groupBy(*by).agg(F.count("*").alias("row_count"), *stats)


def numeric_counts(df: DataFrame, goal: Goal, values: dict[str, Column]) -> DataFrame:
    """axis, numeric_cells: finite cells of each axis, whatever the others hold."""
    one = df.agg(*[F.count(values[n]).alias(n) for n in goal.names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(n).alias("numeric_cells")) for n in goal.names])).alias("s")).select("s.*")


def vectors(df: DataFrame, goal: Goal, values: dict[str, Column], keep: list[str]) -> DataFrame:
    """keep..., v: the values of fully numeric rows, before any test of domain or mask."""
    good = df.select(*keep, F.array(*[values[n] for n in goal.names]).alias("v"))
    return good.where(F.forall("v", lambda x: x.isNotNull()))


def vector_values(goal: Goal, order: list[str], vector: str = "v") -> dict[str, Column]:
    """Values of stored vectors for a goal's axes, whatever order they were stored in."""
    places = {axis_key(n): i for i, n in enumerate(order)}
    if missing := [a.name for a in goal.axes if a.key not in places]:
        raise GridError(f"the stored vectors lack {', '.join(missing)}")
    return {a.name: F.get(vector, F.lit(places[a.key])) for a in goal.axes}


def rebinned(df: DataFrame, goal: Goal, order: list[str], keep: list[str]) -> DataFrame:
    """Stored vectors on another grid: there is no invalid row among them; what does not fit is out of domain."""
    return binned(df, goal, vector_values(goal, order), keep)


def merged(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Histograms are additive."""
    return reduce(DataFrame.unionByName, parts).where("cnt > 0").groupBy(*by).agg(F.sum("cnt").alias("cnt"))


def from_keys(counts: DataFrame, goal: Goal, key: str = "key", cnt: str = "cnt", by: list[str] | None = None) -> DataFrame:
    """by..., cell, cnt of a stored map of text keys: keys that are no cell of the grid and counts below one are left out."""
    cell = F.from_json(key, "array<int>", {"mode": "PERMISSIVE"})
    fits = cells.all_of([(F.get("cell", F.lit(k)) >= 0) & (F.get("cell", F.lit(k)) < a.bins) for k, a in enumerate(goal.axes)])
    rows = counts.select(*(by or []), cell.alias("cell"), F.col(cnt).cast("long").alias("cnt"))
    return rows.where((F.size("cell") == len(goal.axes)) & fits & (F.col("cnt") > 0)).groupBy(*(by or []), "cell").agg(F.sum("cnt").alias("cnt"))


def distribution(counts: DataFrame, goal: Goal, axis: Axis) -> DataFrame:
    """idx, cnt of every bin of one axis, empty ones too."""
    place = [a.key for a in goal.axes].index(axis.key)
    some = counts.groupBy(F.col("cell")[place].alias("idx")).agg(F.sum("cnt").alias("cnt"))
    every = counts.sparkSession.range(axis.bins).select(F.col("id").cast("int").alias("idx"))
    return every.join(some, "idx", "left").select("idx", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))
