"""Two-dimensional views of histograms and rows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.functions import cells
from densigrid.operators.prefix import BLOCK, running
from densigrid.plans.grid import Goal, GridError, axis_key
from densigrid.sources.files import written

#: Fixed limits of what is drawn.
MOST_PAIRS, MOST_CELLS, MOST_TUPLES = 36, 50_000, 5_000


def pairs(goal: Goal, most: int = MOST_PAIRS) -> list[tuple[str, str]]:
    """The first pairs of axes, in canonical order."""
    return list(combinations(goal.names, 2))[:most]


def skipped(goal: Goal, x: str, y: str, most: int = MOST_CELLS) -> bool:
    bins = {a.name: a.bins for a in goal.axes}
    return bins[x] * bins[y] > most


def place(goal: Goal, name: str) -> int:
    try:
        return [a.key for a in goal.axes].index(axis_key(name))
    except ValueError:
        raise GridError(f"no axis {name!r}") from None


def projected(counts: DataFrame, goal: Goal, by: list[str] | None = None, most: int = MOST_PAIRS, fields: int | None = MOST_CELLS) -> DataFrame:
    """by..., x_axis, y_axis, x_bin, y_bin, cnt of all pairs in one pass over the occupied cells.

    Only occupied fields are rows; pairs with more than ``fields`` fields are left out (None: no pair is).
    """
    chosen = [p for p in pairs(goal, most) if fields is None or not skipped(goal, *p, fields)]
    by = by or []
    if not chosen:
        return counts.select(*by, F.lit("").alias("x_axis"), F.lit("").alias("y_axis"), F.lit(0).alias("x_bin"), F.lit(0).alias("y_bin"), "cnt").limit(0)
    each = F.array(*[F.struct(F.lit(x).alias("x_axis"), F.lit(y).alias("y_axis"), F.col("cell")[place(goal, x)].alias("x_bin"), F.col("cell")[place(goal, y)].alias("y_bin")) for x, y in chosen])
    return counts.select(*by, F.explode(each).alias("p"), "cnt").groupBy(*by, "p.x_axis", "p.y_axis", "p.x_bin", "p.y_bin").agg(F.sum("cnt").alias("cnt"))


def pair_summaries(counts: DataFrame, goal: Goal, most: int = MOST_PAIRS) -> DataFrame:
    """x_axis, y_axis, fields, skipped, max_cnt of every pair: which ones ``projected`` leaves out for their size, and the fullest
    field of the others (0 where there is none)."""
    bins = {a.name: a.bins for a in goal.axes}
    every = counts.sparkSession.createDataFrame([(x, y, bins[x] * bins[y], skipped(goal, x, y)) for x, y in pairs(goal, most)], "x_axis string, y_axis string, fields long, skipped boolean")
    fullest = projected(counts, goal, most=most).groupBy("x_axis", "y_axis").agg(F.max("cnt").alias("max_cnt"))
    return every.join(fullest, ["x_axis", "y_axis"], "left").withColumn("max_cnt", F.coalesce("max_cnt", F.lit(0)).cast("long"))


def cell_number(goal: Goal) -> Column:
    """A cell's place in the order of cells, for grids whose cells a long can number."""
    return reduce(lambda n, ka: n * ka[1].bins + F.col("cell")[ka[0]], enumerate(goal.axes), F.lit(0).cast("long"))


def visuals(counts: DataFrame, goal: Goal, chosen: dict[str, int] | None = None, limit: int = MOST_TUPLES, most: int = MOST_PAIRS) -> DataFrame:
    """All that a report draws of a target and its peers, from one frame of cells (cell, peer, target): kind, x_axis, y_axis, x_bin,
    y_bin, key, peer, target.

    pair: the fields of each pair of axes (the first ``most`` pairs, those of up to MOST_CELLS fields), which have a row in
    them.  axis: every bin of each input axis (of each axis if none is), empty ones too.  tuple: a systematic sample of
    the target's rows in the order of cells, with how many fall in each cell (all rows if they are no more than ``limit``): rows
    floor(i n / limit), so their number is exact and no row is touched.  cross: where the ``chosen`` bins stand in each pair.
    """
    if goal.total_bins >= 1 << 62:
        raise GridError("the grid has too many cells to be drawn", hint="use a coarser resolution")
    spark = counts.sparkSession
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    drawn = [a for a in goal.axes if a.is_input] or list(goal.axes)
    at = lambda name: F.col("cell")[place(goal, name)]
    field = lambda kind, x, y, i, j: F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("x_axis"), (F.lit(y) if y else text).alias("y_axis"), i.alias("x_bin"), j.alias("y_bin"))
    each = [field("pair", x, y, at(x), at(y)) for x, y in pairs(goal, most) if not skipped(goal, x, y)] + [field("axis", a.name, None, at(a.name), none) for a in drawn]
    counts = written(counts)
    sums = counts.select(F.explode(F.array(*each)).alias("p"), "peer", "target")
    empty = [spark.range(a.bins).select(field("axis", a.name, None, F.col("id").cast("int"), none).alias("p"), *[F.lit(0).cast("long").alias(c) for c in ("peer", "target")]) for a in drawn]
    fields = reduce(DataFrame.unionByName, [sums, *empty]).groupBy("p").agg(F.sum("peer").alias("peer"), F.sum("target").alias("target")).select("p.*", text.alias("key"), "peer", "target")

    mine = counts.where("target > 0").withColumn("number", cell_number(goal))
    ranked = running(mine.select("number", "cell", "target"), "number", {"upto": "target"}, block=max(BLOCK, goal.total_bins // (1 << 16) + 1))
    n, b, a = F.col("upto_all"), F.col("upto"), F.col("upto") - F.col("target")
    above = lambda x: F.floor((x * limit + n - 1) / n)  # noqa: E731  how many of the sampled rows stand before row x
    taken = F.when(n <= limit, F.col("target")).otherwise(above(b) - above(a)) if limit > 0 else F.lit(0)
    tuples = ranked.select(F.lit("tuple").alias("kind"), text.alias("x_axis"), text.alias("y_axis"), none.alias("x_bin"), none.alias("y_bin"), cells.bin_key(F.col("cell")).alias("key"), F.lit(0).cast("long").alias("peer"), taken.cast("long").alias("target")).where("target > 0")
    cross = spark.createDataFrame([("cross", x, y, i, j, None, 0, 0) for x, y, i, j in crosshair(goal, chosen or {})], fields.schema)
    return fields.unionByName(tuples).unionByName(cross)


def selected(rows: DataFrame, goal: Goal, x: str, y: str, x_bin: int, y_bin: int) -> DataFrame:
    """Rows whose cell is in one field of a projection."""
    return rows.where((F.get("cell", F.lit(place(goal, x))) == x_bin) & (F.get("cell", F.lit(place(goal, y))) == y_bin))


def crosshair(goal: Goal, bins: dict[str, int]) -> list[tuple[str, str, int | None, int | None]]:
    """For each pair of axes, where a selection of bins stands in it (None where an axis is not selected)."""
    return [(x, y, bins.get(x), bins.get(y)) for x, y in pairs(goal) if x in bins or y in bins]


def crosshairs(chosen: DataFrame, goal: Goal, keep: list[str]) -> DataFrame:
    """keep..., x_axis, y_axis, x_bin, y_bin of every selection (a row with a bin, or null, for each axis) in the pairs of axes of which one
    is selected."""
    each = [F.struct(F.lit(x).alias("x_axis"), F.lit(y).alias("y_axis"), F.col(x).cast("int").alias("x_bin"), F.col(y).cast("int").alias("y_bin")) for x, y in pairs(goal)]
    return chosen.select(*keep, F.explode(F.array(*each)).alias("p")).select(*keep, "p.*").where("x_bin IS NOT NULL OR y_bin IS NOT NULL")


def sampled(rows: DataFrame, order: list[Column], limit: int = MOST_TUPLES) -> DataFrame:
    """Every n/limit-th row in a stated order: rows floor(i * n / limit) for i = 0 .. limit - 1; all rows if they are no more.

    Positions come from counts per range of the order, so no task sees all rows: rows are range-partitioned, numbered in
    their partition, and shifted by the sizes of the partitions before.
    """
    if limit <= 0:
        return rows.limit(0)
    columns = rows.columns
    # Written once: counts and positions must come from the same ranges, also if executors are lost between them.
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    n = parts.count()
    if n <= limit:
        return parts.select(*columns)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    shift = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__shift"))
    placed = parts.join(F.broadcast(shift), "__part").withColumn("__at", F.col("__shift") + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1)
    # A row is taken if some i has floor(i * n / limit) equal to its position.
    step = n / limit
    i = F.ceil(F.col("__at") / F.lit(step))
    near = F.array(i - 1, i, i + 1)
    return placed.where(F.exists(near, lambda k: (k >= 0) & (k < limit) & (F.floor(k * F.lit(step)) == F.col("__at")))).select(*columns)
