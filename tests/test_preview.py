"""Previews of grids and what a report draws, against plain Python."""

import random
from collections import Counter

import pytest

from densigrid.operators import density, occupancy, preview, projection
from densigrid.plans.grid import Axis, Goal, GridError
from densigrid.sources.tables import Store
from pyspark.sql import functions as F

GOAL = Goal("tide", (Axis("depth", 0.0, 60.0, 5.0), Axis("salt", 0.0, 8.0, 1.0), Axis("yield", 0.0, 1.0, 0.5, role="output")), 4.0)
ORDER = ["depth", "salt", "yield"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    heads = [(f"r{i}", "tide", ["depth", "salt", "yield"]) for i in range(4)] + [("short", "tide", ["depth"]), ("far", "other", ORDER), ("silent", " tide ", ORDER)]
    obs = [(f"r{i}", [rng.uniform(-5, 65), rng.uniform(0, 8), rng.random()]) for i in range(4) for _ in range(30)] + [("far", [1.0, 1.0, 0.1]), ("short", [1.0, 1.0, 0.1])]
    own = [([rng.uniform(0, 60), rng.uniform(0, 8), rng.random()],) for _ in range(20)]
    return spark.createDataFrame(heads, "record_id string, goal_id string, axis_names array<string>"), spark.createDataFrame(obs, "record_id string, v array<double>"), spark.createDataFrame(own, "v array<double>")


def test_preview_with_and_without_target(spark, tables):
    heads, obs, own = tables
    rows = {r.mode: r for r in preview.request(heads, obs, GOAL, ORDER, [{"name": " DEPTH", "step": 20}], ORDER, own).collect()}
    assert set(rows) == {"external", "pooled", "internal"} and {(r.skipped, int(r.total_bins), int(r.valid_bins), r.eligible_records, r.legacy_excluded) for r in rows.values()} == {(False, 48, 24, 4, 1)}
    inside = sum(0 <= r.v[0] <= 60 for r in obs.where("record_id LIKE 'r%'").collect())
    assert rows["external"].reference_rows == inside == rows["external"].preview_rows and rows["pooled"].reference_rows == inside + 20 and rows["internal"].reference_rows == 20
    (alone,) = preview.request(heads, obs, GOAL, ORDER, [{"name": " DEPTH", "step": 20}], ORDER).collect()
    assert alone.mode is None and alone.preview_confidence == rows["internal"].preview_confidence > 0 and alone.specificity_score is None
    (outside,) = preview.request(heads, obs, GOAL, ORDER, [], ORDER, own.select(F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0)).alias("v"))).collect()
    assert outside.mode is None
    (fewer,) = preview.request(heads, obs, GOAL, ["depth"], [{"name": "salt", "step": 0.001}], ORDER).collect()
    assert (int(fewer.total_bins), fewer.eligible_records) == (12, 5)


def test_confidence_to_the_last_digit_in_any_order(spark):
    counts = spark.createDataFrame([(int(1.3**i) + i,) for i in range(60)], "cnt long")
    own = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        seen = set()
        for parts in range(1, 12):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            alone = density.confidence(counts, 90, 4.0, epsilon=0.0).first()
            modes = density.reference_modes(*[counts.select(F.array("cnt").alias("cell"), F.col("cnt").alias("peer"), F.lit(1).cast("long").alias("target"))] * 2, GOAL, GOAL, 90)
            seen.add((alone.e, alone.confidence, *[(r.e, r.confidence) for r in modes.orderBy("mode").collect()]))
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(seen) == 1  # before, several


def test_preview_of_a_grid_too_large(spark, tables):
    heads, obs, own = tables
    broken = obs.withColumn("v", F.raise_error(F.lit("read")).cast("array<double>"))
    (r,) = preview.request(heads, broken, GOAL, ORDER, [{"name": "salt", "step": 1e-12}], ORDER, own).collect()
    assert r.skipped and r.mode is None and int(r.total_bins) == 12 * 8 * 10**12 * 2 and r.preview_confidence is None and r.eligible_records == 0
    for selected, changes in ((["yield"], []), (["none"], []), (ORDER, [{"name": "depth", "step": 0}])):
        with pytest.raises(GridError):
            preview.request(heads, obs, GOAL, selected, changes, ORDER)


def test_preview_through_the_store(spark, tables, tmp_path):
    heads, obs, own = tables
    store = Store(spark, str(tmp_path / "s"))
    store.save_goals([GOAL])
    store.append("records", heads.withColumn("goal_id", F.trim("goal_id")))
    store.append("observations", obs.withColumn("goal_id", F.lit("tide")))
    made, entry = store.preview("tide", ["depth", "salt"], [{"name": "depth", "step": 20}, {"name": "yield", "step": 0.1}], ORDER, own, " s1 ", "2024")
    assert made.count() == 3 and entry["sequence"] == 1 and '"step": 20.0' in entry["axes_after"] and '"step": 0.5' in entry["axes_after"]
    assert store.preview("tide", ORDER, [], ORDER, session="s1")[1]["axes_before"] == entry["axes_after"]
    skipped, none = store.preview("tide", ORDER, [{"name": "salt", "step": 1e-9}], ORDER, session="s1")
    assert skipped.first().skipped and none is None and store.preview("tide", ORDER, [], ORDER)[1] is None
    assert [r.sequence for r in store.read("logs").orderBy("sequence").collect()] == [1, 2]


@pytest.mark.parametrize("limit", [0, 7, 50, 5000])
def test_visuals(spark, limit):
    rng = random.Random(limit)
    rows = [(rng.random() < 0.4, [rng.randrange(12), rng.randrange(8), rng.randrange(2)]) for _ in range(300)]
    df = spark.createDataFrame([(t, [i * 5.0 + 1, j + 0.5, k * 0.5 + 0.1]) for t, (i, j, k) in rows], "t boolean, v array<double>")
    counts = density.split_counts(occupancy.binned(df, GOAL, occupancy.vector_values(GOAL, ORDER), ["t"]), GOAL, F.col("t"))
    got = projection.visuals(counts, GOAL, {"salt": 3}, limit=limit).collect()
    pairs = Counter()
    for t, c in rows:
        for a, b in ((0, 1), (0, 2), (1, 2)):
            pairs[ORDER[a], ORDER[b], c[a], c[b], t] += 1
    assert {(r.x_axis, r.y_axis, r.x_bin, r.y_bin): (r.peer, r.target) for r in got if r.kind == "pair"} == {k[:4]: (pairs[*k[:4], False], pairs[*k[:4], True]) for k in pairs}
    axes = {(n, i): (sum(not t and c[a] == i for t, c in rows), sum(t and c[a] == i for t, c in rows)) for a, (n, b) in enumerate((("depth", 12), ("salt", 8))) for i in range(b)}
    assert {(r.x_axis, r.x_bin): (r.peer, r.target) for r in got if r.kind == "axis"} == axes
    mine = sorted(tuple(c) for t, c in rows if t)
    taken = mine if len(mine) <= limit else [mine[i * len(mine) // limit] for i in range(limit)]
    assert Counter({r.key: r.target for r in got if r.kind == "tuple"}) == Counter("[" + ",".join(map(str, c)) + "]" for c in taken)
    assert {(r.x_axis, r.y_axis, r.x_bin, r.y_bin) for r in got if r.kind == "cross"} == {("depth", "salt", None, 3), ("salt", "yield", 3, None)}


def test_goal_preview_and_its_warnings(spark, tables):
    from dataclasses import replace

    from densigrid.operators import records

    heads, obs, _ = tables
    axes, warned = records.goal_preview(heads, obs, GOAL, ORDER)
    got = {r.axis: r for r in axes.collect()}
    assert set(got) == {"depth", "salt", "*"} and got["*"].total_bins == 96 and got["depth"].coverage == got["depth"].occupied_bins / 12
    assert {r.kind: r.amount for r in warned.collect()} == {"legacy_excluded": 1, "axes_excluded": 1}
    rule = {"type": "focused_2d_mask", "x": "depth", "y": "salt", "x_range": (0, 60), "y_range": (0, 8)}
    shut = replace(GOAL.with_axes([{"name": "depth", "step": 0.001}]), rules=(rule,))
    axes, warned = records.goal_preview(heads.limit(0), obs, shut, ORDER)
    assert {(r.axis, r.occupied_bins, r.coverage) for r in axes.collect()} == {("depth", 0, 0.0), ("salt", 0, 0.0), ("*", 0, 0.0)}
    assert {r.kind: r.amount for r in warned.collect()} == {"too_fine": 480_000, "masked": 480_000}
