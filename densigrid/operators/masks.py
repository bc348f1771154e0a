"""Boxes as rows: masking by join where there are too many for a predicate, and the union's size as a query."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from densigrid.plans.grid import Goal, TooLarge
from densigrid.plans.rules import full
from densigrid.sources.files import written

#: Boxes above which a predicate of literals would bloat the plan.
PREDICATE_BOXES = 200
#: Cells that an operator which looks at each of them visits at most.
FULL_GRID_CELLS = 250_000


def box_table(spark: SparkSession, goal: Goal, boxes: list[dict]) -> DataFrame:
    """box_id, and for each axis k its start s<k> and end e<k>; boxes come from rules that users write, so they are few."""
    rows = [(i, *[v for r in full(b, goal) for v in r]) for i, b in enumerate(boxes)]
    schema = "box_id int, " + ", ".join(f"s{k} int, e{k} int" for k in range(len(goal.axes)))
    return spark.createDataFrame(rows, schema)


def inside_box(goal: Goal):
    return [(F.get("cell", F.lit(k)) >= F.col(f"s{k}")) & (F.get("cell", F.lit(k)) < F.col(f"e{k}")) for k in range(len(goal.axes))]


def in_grid_boxes(boxes: DataFrame, goal: Goal) -> DataFrame:
    """Boxes (s<k>, e<k>; null is unbounded) cut to the grid, each once, without empty ones."""
    ends = [c for k, a in enumerate(goal.axes) for c in (
        F.greatest(F.lit(0), F.least(F.lit(a.bins), F.coalesce(F.col(f"s{k}"), F.lit(0)))).cast("int").alias(f"s{k}"),
        F.greatest(F.lit(0), F.least(F.lit(a.bins), F.coalesce(F.col(f"e{k}"), F.lit(a.bins)))).cast("int").alias(f"e{k}"),
    )]
    return boxes.select(*ends).where(" AND ".join(f"s{k} < e{k}" for k in range(len(goal.axes)))).distinct()


def outside_boxes(counts: DataFrame, goal: Goal, boxes: DataFrame) -> DataFrame:
    """Cells in none of the boxes, which are rows (s<k>, e<k>) of any number.

    A box is known by its most selective axis, the one of which it covers the least share.  That axis is cut in slabs about as
    wide as the boxes known by it, so a box has some two slabs, and cells meet the boxes of their own slab, axis by axis.
    """
    d = range(len(goal.axes))
    cut = in_grid_boxes(boxes, goal)
    share = [(F.col(f"e{k}") - F.col(f"s{k}")) / F.lit(float(goal.axes[k].bins)) for k in d]
    by = F.when(share[0] == F.least(*share), 0) if len(share) > 1 else F.lit(0)
    for k in list(d)[1:]:
        by = by.when(share[k] == F.least(*share), k)
    known = written(cut.withColumn("by", by))
    width = F.lit(0)
    for k in d:
        width = F.when(F.col("by") == k, F.col(f"e{k}") - F.col(f"s{k}")).otherwise(width)
    wide = {r["by"]: max(1, math.ceil(r.w)) for r in known.groupBy("by").agg(F.avg(width).alias("w")).collect()}  # a row for each axis
    left = counts
    for k, w in sorted(wide.items()):
        slabs = F.sequence(F.floor(F.col(f"s{k}") / w), F.floor((F.col(f"e{k}") - 1) / w))
        some = known.where(F.col("by") == k).select(F.explode(slabs).alias("__slab"), *[f"{x}{i}" for i in d for x in "se"])
        asked = left.withColumn("__slab", F.floor(F.get("cell", F.lit(k)) / w))
        left = asked.join(some, [asked["__slab"] == some["__slab"], *inside_box(goal)], "left_anti").drop("__slab")
    return left


def unmasked(counts: DataFrame, goal: Goal, boxes: list[dict]) -> DataFrame:
    """Cells in no box of a list, by an anti join."""
    return outside_boxes(counts, goal, box_table(counts.sparkSession, goal, boxes))


def _set_of(*columns: str) -> list[Column]:
    """What tells a set of rows: its size, and the sums of two halves of a hash of each."""
    h = F.xxhash64(*columns)
    return [F.count("*").alias("m"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("h0"), F.sum(F.shiftrightunsigned(h, 32)).alias("h1")]


def union_volume(boxes: DataFrame, goal: Goal) -> DataFrame:
    """masked_bins (decimal): cells in at least one of the boxes, which are rows (s<k>, e<k>) of any number.

    A sweep, axis by axis.  Along the first axis the boxes' ends cut the grid in slabs, and a slab is a smaller problem: the
    boxes that cover it, without that axis.  Slabs with the same boxes are one problem, whose weight is their width together;
    so there are as many problems as different sets of boxes, and cells are never made.  On the last axis a problem is the
    length of a union of intervals: what each one adds beyond the farthest end before it.
    """
    last = len(goal.axes) - 1
    big = "decimal(38,0)"
    now = in_grid_boxes(boxes, goal).withColumn("p", F.lit("0"))
    weights = now.select("p").distinct().withColumn("w", F.lit(1).cast(big))
    for k in range(last):
        rest = [c for i in range(k + 1, last + 1) for c in (f"s{i}", f"e{i}")]
        now, weights = written(now), written(weights)
        # The cuts of a problem are numbered, so a box gives the numbers of its slabs and no ranges meet.
        cuts = now.select("p", F.explode(F.array(f"s{k}", f"e{k}")).alias("at")).distinct()
        order = Window.partitionBy("p").orderBy("at")
        ranks = cuts.select("p", "at", F.row_number().over(order).alias("n"), (F.lead("at").over(order) - F.col("at")).alias("wide"))
        place = lambda c, name: ranks.select("p", F.col("at").alias(c), F.col("n").alias(name))
        placed = now.join(place(f"s{k}", "n0"), ["p", f"s{k}"]).join(place(f"e{k}", "n1"), ["p", f"e{k}"])
        covered = placed.select("p", *rest, F.explode(F.sequence(F.col("n0"), F.col("n1") - 1)).alias("n")).distinct()
        covered = written(covered)
        sets = covered.groupBy("p", "n").agg(*_set_of(*rest))
        sets = sets.select("p", "n", F.concat_ws("-", "m", "h0", "h1").alias("q"))
        sized = written(sets.join(ranks.select("p", "n", "wide"), ["p", "n"]).join(weights, "p"))
        weights = sized.groupBy(F.col("q").alias("p")).agg(F.sum(F.col("w") * F.col("wide").cast(big)).cast(big).alias("w"))
        one = sized.groupBy("q").agg(F.min(F.struct("p", "n")).alias("of")).select("of.p", "of.n", "q")
        now = covered.join(one, ["p", "n"]).select(F.col("q").alias("p"), *rest)
    s, e = F.col(f"s{last}"), F.col(f"e{last}")
    reached = F.max(e).over(Window.partitionBy("p").orderBy(s, e).rowsBetween(Window.unboundedPreceding, -1))
    lengths = now.select("p", F.greatest(F.lit(0), e - F.greatest(s, F.coalesce(reached, s))).alias("add")).groupBy("p").agg(F.sum("add").cast(big).alias("l"))
    return lengths.join(weights, "p").agg(F.coalesce(F.sum(F.col("l") * F.col("w")), F.lit(0)).cast(big).alias("masked_bins"))


def sizes(boxes: DataFrame, goal: Goal) -> DataFrame:
    """total_bins, masked_bins, valid_bins (decimals, as grids have no bound) of a grid with boxes as rows."""
    total = F.lit(str(goal.total_bins)).cast("decimal(38,0)")
    return union_volume(boxes, goal).select(total.alias("total_bins"), "masked_bins", (total - F.col("masked_bins")).cast("decimal(38,0)").alias("valid_bins"))


def union_size(spark: SparkSession, goal: Goal, boxes: list[dict]) -> DataFrame:
    """masked_bins of a list of boxes."""
    return union_volume(box_table(spark, goal, boxes), goal).select(F.col("masked_bins").cast("long").alias("masked_bins"))


def every_cell(spark: SparkSession, goal: Goal, most: int = FULL_GRID_CELLS) -> DataFrame:
    """cell: all cells of a grid, for the operators that cannot do without; refuses grids beyond ``most``."""
    if goal.total_bins > most:
        raise TooLarge(f"the grid has {goal.total_bins} cells; at most {most} are visited one by one", hint="use a coarser resolution")
    rest, parts = F.col("id"), []
    for a in reversed(goal.axes):
        parts.append((rest % a.bins).cast("int"))
        rest = F.floor(rest / a.bins)
    return spark.range(goal.total_bins).select(F.array(*parts[::-1]).alias("cell"))
