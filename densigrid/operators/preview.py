"""A goal's grid with other axes, looked at before it is applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.operators import density, grids, occupancy, records
from densigrid.plans.grid import Goal
from densigrid.plans.rules import feasible_size

_SCORES = ("specificity_score", "max_specificity", "extreme_specificity_rate", "unseen_bin_rate", "mean_rarity", "max_rarity", "s", "c", "e", "confidence")


def previewed_goal(goal: Goal, selected: list[str], changes: list[dict]) -> Goal:
    """The selected axes of a goal, with what the preview changes about them; changes of other axes have no effect."""
    return goal.subset(selected).with_axes(changes)


def request(
    headers: DataFrame, observations: DataFrame, goal: Goal, selected: list[str], changes: list[dict], order: list[str],
    target: DataFrame | None = None, target_order: list[str] | None = None, without: str | None = None, most: int = grids.MOST_PREVIEW_BINS,
) -> DataFrame:
    """What the goal's peers, and a target if there is one, look like on the previewed grid.

    Columns: skipped; total_bins, masked_bins, valid_bins (of the input axes); eligible_records and legacy_excluded, peers with and
    without observations; preview_rows, preview_bins and preview_s, _c, _e, _confidence of the peers alone; then mode and, for each
    of the three, its scores, reference_rows, occupied_bins and valid_target_rows.  Without a target, or one without valid
    rows, there is one row, with a null mode and no scores.

    Above ``most`` cells nothing is counted: one row says so, and the sizes, which need no cells.  ``target`` has
    rows (v array<double>) in ``target_order``; peers and target are read once, in one pass.
    """
    spark, asked = headers.sparkSession, previewed_goal(goal, selected, changes)
    design = asked.design
    size = feasible_size(design)
    sizes = {n: F.lit(str(size[n])).cast("decimal(38,0)").alias(n) for n in ("masked_bins", "valid_bins")}
    head = [F.lit(str(asked.total_bins)).cast("decimal(38,0)").alias("total_bins"), *sizes.values()]
    none, nothing = F.lit(None), F.lit(0).cast("long")
    if asked.total_bins > most:
        blank = [none.cast("double").alias(n) for n in _SCORES] + [none.cast("long").alias(n) for n in ("reference_rows", "occupied_bins", "valid_target_rows")]
        parts = [nothing.alias(n) for n in ("eligible_records", "legacy_excluded", "preview_rows", "preview_bins")]
        shown = [v.cast("double").alias(f"preview_{n}") for n, v in (("s", F.lit(0.0)), ("c", none), ("e", F.lit(0.0)), ("confidence", none))]
        return spark.range(1).select(F.lit(True).alias("skipped"), *head, *parts, *shown, none.cast("string").alias("mode"), *blank)

    peers = records.peers(headers, goal.id, asked.names, without).select("record_id").distinct()
    mine = observations.join(peers, "record_id", "left_semi")
    values = [v.alias(f"v{k}") for k, v in enumerate(occupancy.vector_values(asked, order).values())]
    rows = mine.select(F.lit(False).alias("is_target"), *values)
    if target is not None:
        own = [v.alias(f"v{k}") for k, v in enumerate(occupancy.vector_values(asked, target_order or order).values())]
        rows = rows.unionByName(target.select(F.lit(True).alias("is_target"), *own))
    column = {a.name: F.col(f"v{k}") for k, a in enumerate(asked.axes)}
    split = lambda g: density.split_counts(occupancy.binned(rows, g, {a.name: column[a.name] for a in g.axes}, ["is_target"]), g, F.col("is_target"))
    counts = split(asked)
    design_counts = counts if design.names == asked.names else split(design)
    seen = mine.select("record_id").distinct().agg(F.count("*").alias("eligible_records"))
    known = peers.agg(F.count("*").alias("n")).crossJoin(seen).select("eligible_records", (F.col("n") - F.col("eligible_records")).alias("legacy_excluded"))  # of one row each
    alone = density.confidence(design_counts.select(F.col("peer").alias("cnt")), size["valid_bins"], asked.k, epsilon=0.0)
    alone = alone.select(*[F.col(c).alias(f"preview_{n}") for c, n in (("reference_rows", "rows"), ("occupied_bins", "bins"), ("s", "s"), ("c", "c"), ("e", "e"), ("confidence", "confidence"))])
    shown = known.crossJoin(alone).select(F.lit(False).alias("skipped"), *head, "*")  # of one row each
    modes = density.reference_modes(counts, design_counts, asked, design, size["valid_bins"]).where("valid_target_rows IS NOT NULL")
    return shown.join(modes.select("mode", *_SCORES, "reference_rows", "occupied_bins", "valid_target_rows"), F.lit(True), "left")  # one row by three
