"""Many grids at once: axes as rows (goal_id, axis, low, high, step), one for each axis of each goal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.functions import cells

#: Cells above which a preview is not computed, and above which a goal's own preview warns.
MOST_PREVIEW_BINS, MANY_BINS = 500_000, 100_000


def bins(low: Column, high: Column, step: Column) -> Column:
    """Cells of an axis, one at least."""
    return F.greatest(F.lit(1), F.ceil((high - low) / step)).cast("long")


def with_preview(axes: DataFrame, preview: DataFrame) -> DataFrame:
    """Each goal's axes with low, high and step as previewed for the axis (by name, without regard to case and blanks); what a preview
    lacks stays, and an axis that no goal has is no new one.  Of several previews of an axis any may hold; give one."""
    asked = preview.select("goal_id", cells.axis_key(F.col("axis")).alias("__key"), *[F.col(c).cast("double").alias(f"__{c}") for c in ("low", "high", "step")])
    met = axes.withColumn("__key", cells.axis_key(F.col("axis"))).join(asked, ["goal_id", "__key"], "left")
    return met.select(*[F.coalesce(f"__{c}", c).alias(c) if c in ("low", "high", "step") else F.col(c) for c in axes.columns])


def total_bins(axes: DataFrame) -> DataFrame:
    """goal_id, axes, total_bins of each goal's grid: an exact integer of up to 38 digits (an error beyond)."""
    each = axes.groupBy("goal_id").agg(F.collect_list(bins(F.col("low"), F.col("high"), F.col("step"))).alias("b"))  # a goal has a handful
    product = F.aggregate("b", F.lit(1).cast("decimal(38,0)"), lambda n, b: (n * b.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return each.select("goal_id", F.size("b").alias("axes"), product.alias("total_bins"))


def guarded(axes: DataFrame, most: int = MOST_PREVIEW_BINS) -> DataFrame:
    """goal_id, axes, total_bins, skipped: is a preview of the grid too large to be computed?"""
    return total_bins(axes).withColumn("skipped", F.col("total_bins") > most)


def meta(axes: DataFrame) -> DataFrame:
    """The axes with total_bins, and label: the name, and the unit in brackets where there is one (column ``unit``, if any)."""
    unit = F.coalesce(F.col("unit"), F.lit("")) if "unit" in axes.columns else F.lit("")
    label = F.when(unit != "", F.concat("axis", F.lit(" ("), unit, F.lit(")"))).otherwise(F.col("axis"))
    return axes.withColumns({"total_bins": bins(F.col("low"), F.col("high"), F.col("step")), "label": label})
