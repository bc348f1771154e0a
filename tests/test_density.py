"""Golden values, and one-pass forms against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from densigrid.functions.cells import finite
from densigrid.operators import density, occupancy, projection, records
from densigrid.plans.grid import Axis, Goal, GridError
from densigrid.plans.rules import boxes_of

PEER = {0: 1, 1: 1, 2: 2, 3: 5, 4: 10}
ONE = Goal("g", (Axis("x", 0.0, 10.0, 1.0),), 10.0)


def counts(spark, peer, target):
    rows = [([i], peer.get(i, 0), target.get(i, 0)) for i in sorted(set(peer) | set(target))]
    return spark.createDataFrame(rows, "cell array<int>, peer long, target long")


def result(spark, peer, target, goal=ONE, mode="external", valid=None):
    c = counts(spark, peer, target)
    return density.reference_modes(c, c, goal, goal, valid or goal.total_bins).where(F.col("mode") == mode).first()


@pytest.mark.parametrize("target,score", [({9: 1}, 1.0), ({0: 1}, 0.6), ({4: 1}, 0.0), ({9: 3, 0: 7}, 0.72)])
def test_specificity(spark, target, score):
    r = result(spark, PEER, target)
    assert r.specificity_score == pytest.approx(score)
    assert r.extreme_specificity_rate == pytest.approx(0.3 if len(target) > 1 else float(score == 1.0))


def test_rare_cells_of_a_ramp(spark):
    goal, ramp = Goal("g", (Axis("x", 0.0, 21.0, 1.0),)), {i: i + 1 for i in range(21)}
    assert result(spark, ramp, {20: 1}, goal).extreme_specificity_rate == 0
    assert result(spark, ramp, {0: 1}, goal).extreme_specificity_rate == 1


def test_no_reference(spark):
    r = result(spark, {}, {1: 2, 2: 1})
    assert (r.specificity_score, r.unseen_bin_rate, r.confidence, r.c, r.reference_rows) == (1.0, 1.0, 0.0, 0.0, 0)
    assert r.mean_rarity == pytest.approx(math.log(10))
    assert result(spark, {}, {1: 2, 2: 1}, mode="pooled").reference_rows == 3
    assert result(spark, {}, {1: 2, 2: 1}, mode="internal").reference_rows == 3


def test_no_valid_target_rows_and_no_valid_cells(spark):
    assert result(spark, PEER, {}).specificity_score is None
    with pytest.raises(GridError):
        density.reference_modes(counts(spark, PEER, {0: 1}), counts(spark, PEER, {0: 1}), ONE, ONE, 0)


def test_pending_coverage(spark):
    c = counts(spark, PEER, {0: 1})
    r = density.reference_modes(c, c, ONE, ONE, None).where("mode = 'pooled'").first()
    assert r.c is None and r.confidence is None and r.s == pytest.approx(20 / 30)


def test_confidence(spark):
    c = spark.createDataFrame([([i], n) for i, n in PEER.items()], "cell array<int>, cnt long")
    r = density.confidence(c, 10, 10.0).first()
    e = -sum(n / 19 * math.log(n / 19) for n in PEER.values()) / math.log(5)
    assert (r.s, r.c) == (pytest.approx(19 / 29), 0.5) and r.e == pytest.approx(e) and r.confidence == pytest.approx((19 / 29 * 0.5 * e) ** (1 / 3))
    one = density.confidence(c.limit(1), 10, 10.0).first()
    assert one.e == 0 and one.confidence == 0


def frame(spark, rows, schema="x string, y string"):
    return spark.createDataFrame(rows, schema)


def test_status_precedence_and_edges(spark):
    rule = {"type": "focused_2d_mask", "x": "x", "y": "y", "x_range": (0, 5), "y_range": (0, 5)}
    goal = Goal("g", (Axis("y", 0.0, 10.0, 1.0), Axis("x", 0.0, 10.0, 1.0)), rules=(rule,))
    rows = [("1", "1"), ("10", "7"), ("10.5", "1"), ("a", "99"), (None, "1"), ("nan", "1"), ("inf", "1"), (" 6 ", "6"), ("1e0", "1"), ("1d", "1"), ("", "1"), ("0x1", "1")]
    df = frame(spark, rows).withColumn("status", F.lit("clash"))
    got = occupancy.binned(df, goal, occupancy.text_values(df, goal, {"X": "x", "y": "y"}), ["x"])
    assert [r.status for r in got.select("status").collect()] == ["masked", "valid", "out_of_domain", "invalid", "invalid", "invalid", "invalid", "valid", "masked", "invalid", "invalid", "invalid"]
    assert got.where("x = '10'").first().cell == [9, 7]
    counters = occupancy.counters(got, goal).first()
    assert (counters.total_rows, counters.valid_rows, counters.masked_rows, counters.masked_bins) == (12, 2, 2, 1)


def test_missing_column_is_invalid_in_binning_and_an_error_in_summaries(spark):
    df = frame(spark, [("1", "1")])
    goal = Goal("g", (Axis("x", 0.0, 10.0, 1.0), Axis("z", 0.0, 10.0, 1.0)))
    assert occupancy.binned(df, goal, occupancy.text_values(df, goal, {"x": "x"})).first().status == "invalid"
    with pytest.raises(GridError):
        occupancy.number_values(df, goal, {"x": "x"})


def test_empty_table(spark):
    df = frame(spark, [])
    goal = Goal("g", (Axis("x", 0.0, 10.0, 1.0),))
    rows = occupancy.binned(df, goal, occupancy.text_values(df, goal, {"x": "x"}))
    assert occupancy.histogram(rows, goal).count() == 0 and occupancy.counters(rows, goal).first().total_rows == 0


def test_summary_of_one_row_and_of_rows_outside(spark):
    df = frame(spark, [("1", "10"), ("3", "14"), ("x", "1")])
    goal = Goal("g", (Axis("x", 0.0, 2.0, 1.0), Axis("y", 0.0, 20.0, 1.0)))
    values = occupancy.text_values(df, goal, {"x": "x", "y": "y"})
    r = occupancy.summary(df, goal, values).first()
    assert (r.row_count, r.mean_x, r.mean_y, r.var_x) == (2, 2.0, 12.0, 2.0)
    assert occupancy.summary(df.limit(1), goal, values).first().var_x == 0.0
    assert {r.axis: r.numeric_cells for r in occupancy.numeric_counts(df, goal, values).collect()} == {"x": 2, "y": 3}


def test_regrid(spark):
    obs = spark.createDataFrame([("r", [12.0]), ("r", [1.2]), ("r", [1.7])], "record_id string, v array<double>")
    keys = lambda g: {r.cell[0]: r.cnt for r in occupancy.histogram(occupancy.rebinned(obs, g, ["X "], []), g).collect()}
    assert keys(ONE) == {1: 2}
    assert keys(ONE.with_axes([{"name": "x", "high": 20.0}])) == {1: 2, 12: 1}
    assert keys(ONE.with_axes([{"name": "x", "step": 0.5}])) == {2: 1, 3: 1}
    with pytest.raises(GridError):
        occupancy.rebinned(obs, ONE, ["other"], [])


def test_splitting_records_changes_nothing(spark):
    rng = random.Random(5)
    values = [rng.uniform(-1, 11) for _ in range(300)]
    split = lambda k: spark.createDataFrame([(i % k, [v]) for i, v in enumerate(values)], "record_id int, v array<double>")
    merged = lambda k: sorted((tuple(r.cell), r.cnt) for r in occupancy.merged([occupancy.histogram(occupancy.rebinned(split(k), ONE, ["x"], ["record_id"]), ONE, ["record_id"]).select("cell", "cnt")], ["cell"]).collect())
    assert merged(1) == merged(7)


def test_leave_one_out_against_recomputing(spark):
    rng = random.Random(11)
    goal = Goal("g", (Axis("x", 0.0, 6.0, 1.0), Axis("y", 0.0, 6.0, 1.0)))
    rows = [(rng.randrange(5), [rng.gauss(3, 1.2), rng.gauss(3, 1.2)]) for _ in range(400)] + [(9, [0.5, 5.5])]
    df = spark.createDataFrame(rows, "record_id int, v array<double>")
    got = {r.record_id: r for r in density.reevaluated(occupancy.rebinned(df, goal, ["x", "y"], ["record_id"]), goal, "record_id", valid_bins=36).collect()}
    cells = Counter()
    for rec, v in rows:
        if all(0 <= x <= 6 for x in v):
            cells[rec, tuple(min(5, int(x)) for x in v)] += 1
    for rec in {r for r, _ in cells}:
        own = {c: n for (r, c), n in cells.items() if r == rec}
        ref = Counter()
        for (r, c), n in cells.items():
            if r != rec:
                ref[c] += n
        occupied = sorted(ref.values())
        score = {c: 1 - sum(x <= ref[c] for x in occupied) / len(occupied) if ref[c] else 1.0 for c in own}
        total = sum(own.values())
        r = got[rec]
        assert r.specificity_score == pytest.approx(sum(n * score[c] for c, n in own.items()) / total)
        assert r.max_specificity == pytest.approx(max(score.values()))
        assert r.unseen_bin_rate == pytest.approx(sum(n for c, n in own.items() if not ref[c]) / total)
        assert (r.valid_rows, r.reference_rows, r.occupied_bins) == (total, sum(occupied), len(occupied))
        n = sum(occupied)
        rare = {c: -math.log((ref[c] + 0.5) / (n + 0.5 * 36)) for c in own}
        assert r.mean_rarity == pytest.approx(sum(k * rare[c] for c, k in own.items()) / total) and r.max_rarity == pytest.approx(max(rare.values()))
        e = -sum(x / n * math.log(x / n + 1e-12) for x in occupied) / math.log(len(occupied))
        s, c = n / (n + 10.0), len(occupied) / 36
        assert (r.s, r.c, r.e) == pytest.approx((s, c, e)) and r.confidence == pytest.approx((s * c * e) ** (1 / 3))


def test_leave_one_out_without_others_and_without_a_mask_count(spark):
    goal = Goal("g", (Axis("x", 0.0, 6.0, 1.0),))
    df = spark.createDataFrame([("only", [1.0]), ("only", [5.0])], "record_id string, v array<double>")
    r = density.reevaluated(occupancy.rebinned(df, goal, ["x"], ["record_id"]), goal, "record_id", valid_bins=6).first()
    assert (r.specificity_score, r.unseen_bin_rate, r.confidence, r.reference_rows) == (1.0, 1.0, 0.0, 0) and r.mean_rarity == pytest.approx(math.log(6))
    two = df.unionByName(spark.createDataFrame([("other", [1.0])], "record_id string, v array<double>"))
    pending = density.reevaluated(occupancy.rebinned(two, goal, ["x"], ["record_id"]), goal, "record_id")
    assert all(r.c is None and r.confidence is None and r.s > 0 for r in pending.collect())
    assert density.reevaluated(occupancy.rebinned(df.limit(0), goal, ["x"], ["record_id"]), goal, "record_id").collect() == []


def test_comparison_with_upload(spark):
    now = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.8, None), (3, 0.6, 0.5), (4, 0.6, 0.5), (5, None, None)], "record_id int, specificity_score double, confidence double")
    was = spark.createDataFrame([(1, 0.8, 0.3), (2, 0.9, 0.8), (3, 0.1, None), (5, 0.9, 0.1)], "record_id int, specificity_score double, confidence double")
    got = {r.record_id: (r.specificity_delta, r.confidence_delta, r.interpretation) for r in density.compared_with_upload(now, was, "record_id").collect()}
    assert got == {1: (-0.3, 0.6, "fell,weak_support"), 2: (-0.1, None, "specific"), 3: (0.5, None, "mild"), 4: (None, None, "similar"), 5: (None, None, "weak_support")}


def test_running_sums(spark, monkeypatch):
    """In blocks, also of one value, with groups and without."""
    from densigrid.operators import prefix

    rng = random.Random(2)
    rows = sorted({(rng.randrange(3), rng.choice([0, 1, 2, 50, 4095, 4096, 10**12]) + rng.randrange(4)): rng.randrange(9) for _ in range(60)}.items())
    df = spark.createDataFrame([(g, at, n) for (g, at), n in rows], "g int, at long, n long")
    for block in (1, 3, 4096):
        monkeypatch.setattr(prefix, "BLOCK", block)
        got = {(r.g, r.at): (r.s, r.s_all) for r in prefix.running(df, "at", {"s": "n"}, ["g"]).collect()}
        assert got == {(g, at): (sum(n for (h, b), n in rows if h == g and b <= at), sum(n for (h, _), n in rows if h == g)) for (g, at), _ in rows}
    one = df.groupBy("at").agg(F.sum("n").alias("n"))
    total = sum(n for _, n in rows)
    assert {r.s_all for r in prefix.running(one, "at", {"s": "n"}).collect()} == {total}


def test_many_boxes_by_join(spark):
    from densigrid.operators.masks import TooLarge, every_cell, unmasked

    rule = {"type": "focused_2d_mask", "x": "x", "y": "y", "x_range": (0, 5), "y_range": (2, 5)}
    goal = Goal("g", (Axis("x", 0.0, 10.0, 1.0), Axis("y", 0.0, 10.0, 1.0)), rules=(rule,))
    assert unmasked(every_cell(spark, goal), goal, boxes_of(goal)).count() == 100 - 15
    with pytest.raises(TooLarge):
        every_cell(spark, goal.with_axes([{"name": "x", "step": 1e-5}]))


def test_projection_and_sample(spark):
    goal = Goal("g", tuple(Axis(n, 0.0, 5.0, 1.0) for n in "abc"))
    c = spark.createDataFrame([([1, 2, 3], 5), ([1, 4, 0], 2)], "cell array<int>, cnt long")
    got = {(r.x_axis, r.y_axis, r.x_bin, r.y_bin): r.cnt for r in projection.projected(c, goal).collect()}
    assert got["a", "c", 1, 3] == 5 and got["a", "c", 1, 0] == 2 and got["a", "b", 1, 2] == 5 and len(got) == 6
    many = Goal("g", tuple(Axis(f"a{i}", 0.0, 1.0, 0.5) for i in range(10)))
    assert len(projection.pairs(many, 1000)) == 45 and len(projection.pairs(many)) == 36
    assert projection.skipped(Goal("g", (Axis("x", 0.0, 1000.0, 1.0), Axis("y", 0.0, 1000.0, 1.0))), "x", "y")
    assert projection.crosshair(goal, {"a": 1, "b": 2}) == [("a", "b", 1, 2), ("a", "c", 1, None), ("b", "c", 2, None)]
    rows = spark.range(1003)
    taken = sorted(r.id for r in projection.sampled(rows, [F.col("id")], 100).collect())
    assert taken == [int(i * 1003 / 100) for i in range(100)]
    assert projection.sampled(rows, [F.col("id")], 0).count() == 0 and projection.sampled(rows, [F.col("id")], 2000).count() == 1003


def test_stored_keys(spark):
    goal = Goal("g", (Axis("x", 0.0, 5.0, 1.0), Axis("y", 0.0, 5.0, 1.0)))
    raw = [("[1,2]", "3"), ("[1, 2]", "1"), ("[9,0]", "1"), ("[1]", "1"), ("bad", "1"), ("[1,2]", "-4"), ("[1,3]", "x"), (None, "1")]
    df = spark.createDataFrame(raw, "key string, c string").select("key", F.col("c").try_cast("long").alias("cnt"))
    assert [(r.cell, r.cnt) for r in occupancy.from_keys(df, goal).collect()] == [([1, 2], 4)]


def test_nan_and_infinity_are_invalid(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double")
    assert [r.status for r in occupancy.binned(df, ONE, {"x": finite(F.col("x"))}).collect()] == ["invalid"] * 3 + ["valid"]


def test_dedupe(spark):
    f = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "record_id int, fingerprint string")
    assert sorted(r.record_id for r in records.first_of_each(f, F.col("record_id")).collect()) == [1, 3]
    assert [r.record_id for r in records.new_records(f, f.where("record_id = 1")).collect()] == [3]


def test_masks_by_predicate_and_by_join(spark, monkeypatch):
    from densigrid import queries
    from densigrid.operators import masks
    from conftest import DATA

    cells_of = lambda: sorted((r.key, r.cnt) for r in queries.mask_filter(spark, DATA).collect())
    few = cells_of()
    monkeypatch.setattr(masks, "PREDICATE_BOXES", 1)
    assert cells_of() == few and len(few) > 0


def test_boxes_are_tested_on_cells(spark):
    """The row side of a masked histogram's plan is that of one without masks: no index is computed once for each box."""
    from densigrid import queries
    from conftest import DATA

    cases = lambda name: queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN")
    assert cases("mask_filter") <= cases("bin_occupancy") + 3


def random_boxes(rng, n, bins, width):
    out = []
    for _ in range(n):
        box = []
        for b in bins:
            s = rng.randrange(b)
            box += [s, min(b, s + 1 + rng.randrange(width))]
        out.append(tuple(box))
    return out


def box_frame(spark, boxes, d):
    return spark.createDataFrame(boxes, ", ".join(f"s{k} int, e{k} int" for k in range(d)))


def test_a_hundred_thousand_boxes_by_an_equi_join(spark):
    import numpy as np

    from densigrid.operators.masks import every_cell, outside_boxes

    rng = random.Random(8)
    bins = (60, 40, 50)
    goal = Goal("g", tuple(Axis(n, 0.0, float(b), 1.0) for n, b in zip("abc", bins)))
    boxes = random_boxes(rng, 99_990, (60, 40, 50), 1) + [(s, s + 3, 0, 40, 0, 50) for s in (5, 6)] + [(0, 60, 7, 8, 0, 50)] + random_boxes(rng, 7, bins, 9)
    counts = every_cell(spark, goal, 200_000).withColumn("cnt", F.lit(1))
    left = outside_boxes(counts, goal, box_frame(spark, boxes, 3))
    free = np.ones(bins, bool)
    for s0, e0, s1, e1, s2, e2 in boxes:
        free[s0:e0, s1:e1, s2:e2] = False
    assert 0 < free.sum() < free.size and {tuple(r.cell) for r in left.select("cell").collect()} == set(map(tuple, np.argwhere(free).tolist()))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("n, bins, width", [(1000, (9, 8, 7, 9, 8), 4), (60, (1000, 3, 500), 300), (40, (20,), 4), (0, (5, 5), 2)])
def test_union_of_many_boxes(spark, n, bins, width):
    import numpy as np

    from densigrid.operators.masks import sizes

    boxes = random_boxes(random.Random(n), n, bins, width)
    goal = Goal("g", tuple(Axis(c, 0.0, float(b), 1.0) for c, b in zip("abcde", bins)))
    masked = np.zeros(bins, bool)
    for box in boxes:
        masked[tuple(slice(box[2 * k], box[2 * k + 1]) for k in range(len(bins)))] = True
    r = sizes(box_frame(spark, boxes, len(bins)), goal).first()
    assert (int(r.total_bins), int(r.masked_bins), int(r.valid_bins)) == (masked.size, masked.sum(), (~masked).sum())


def test_union_beyond_longs_and_open_boxes(spark):
    from densigrid.operators.masks import sizes

    goal = Goal("g", tuple(Axis(c, 0.0, 1e6, 1.0) for c in "abcd"))
    boxes = [(None, None, 0, 10**6, 3, 2_000_000, None, 10**6), (5, 5, 0, 1, 0, 1, 0, 1), (0, 1, 0, 1, 0, 1, 0, 1)]
    r = sizes(box_frame(spark, boxes, 4), goal).first()
    assert int(r.total_bins) == 10**24 and int(r.masked_bins) == 10**18 * (10**6 - 3) + 1 and int(r.valid_bins) == 10**24 - int(r.masked_bins)
