import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from densigrid.plans.grid import Axis, Goal, GridError, peer_key, subset_key
from densigrid.plans import rules
from densigrid.plans.rules import boxes_of, cached_valid_bins, centre_range, condition_ranges, feasible_size, union_size

X, Y = Axis("x", 0.0, 10.0, 1.0), Axis("y", 0.0, 10.0, 1.0)


def test_axes_are_checked():
    for bad in ((1.0, 1.0, 1.0), (2.0, 1.0, 1.0), (0.0, 1.0, 0.0), (0.0, math.inf, 1.0)):
        with pytest.raises(GridError):
            Axis("a", *bad)
    with pytest.raises(GridError):
        Goal("g", (X, Axis(" X ", 0.0, 1.0, 0.5)))
    with pytest.raises(GridError):
        Goal("g", (Axis("x", 0.0, 1.0, 1.0, role="output"),))
    with pytest.raises(GridError):
        Goal("g", ())


def test_canonical_order_and_signature():
    assert Goal("g", (Y, X)).names == ["x", "y"]
    assert Goal("g", (Y, X)).signature() == Goal("h", (Axis(" X", 0.0, 10.0, 1.0), Y)).signature()
    assert Goal("g", (X,)).signature() != Goal("g", (Axis("x", 0.0, 10.0, 0.5),)).signature()
    assert subset_key(["B ", "a"]) == "a|b" and peer_key("g", ["b", "A"]) == "g|a|b"
    assert Goal.from_json(Goal("g", (X, Y)).to_json()) == Goal("g", (X, Y))


def test_subset_and_roles():
    rule = {"type": "focused_2d_mask", "x": "x", "y": "y", "x_range": (0, 1), "y_range": (0, 1)}
    goal = Goal("g", (X, Y, Axis("z", 0.0, 1.0, 0.1, role="output")), rules=(rule,))
    assert goal.design.names == ["x", "y"] and goal.design.rules == (rule,)
    assert goal.subset(["X"]).rules == ()
    assert goal.total_bins == 1000 and goal.design.total_bins == 100
    for names in (["nope"], ["z"]):
        with pytest.raises(GridError):
            goal.subset(names)


def test_preview_axes():
    goal = Goal("g", (X, Y)).with_axes([{"name": " X", "step": 0.5}])
    assert goal.total_bins == 200


def test_two_boxes_that_overlap():
    a = {"type": "focused_2d_mask", "x": "x", "y": "y", "x_range": (0, 5), "y_range": (0, 5)}
    b = {"type": "focused_2d_mask", "x": "x", "y": "y", "x_range": (2, 8), "y_range": (2, 7)}
    size = feasible_size(Goal("g", (X, Y), rules=(a, b)))
    assert (size["masked_bins"], size["valid_bins"]) == (46, 54)


def test_large_grid_is_not_visited():
    goal = Goal("g", (Axis("x", 0.0, 1000.0, 1.0), Axis("y", 0.0, 1000.0, 1.0)), rules=({"type": "focused_2d_mask", "x": "x", "y": "y", "x_range": (500, 1000), "y_range": (0, 1000)},))
    assert feasible_size(goal)["valid_bins"] == 500_000


def test_scope_and_third_axis():
    axes = (Axis("depth", 0.0, 60.0, 5.0), Axis("salt", 0.0, 8.0, 2.0), Axis("hour", 0.0, 24.0, 4.0))
    rule = {"type": "focused_2d_mask", "x": "depth", "y": "salt", "x_range": (30, 60), "y_range": (0, 4), "scope": {"hour": {"mode": "all"}}}
    assert feasible_size(Goal("g", axes, rules=(rule,)))["masked_bins"] == 6 * 2 * 6
    narrow = {**rule, "scope": {"hour": {"mode": "range", "min": 0, "max": 8}}}
    assert feasible_size(Goal("g", axes, rules=(narrow,)))["masked_bins"] == 6 * 2 * 2
    with pytest.raises(GridError):
        boxes_of(Goal("g", axes, rules=({**rule, "scope": {"nope": {"mode": "all"}}},)))


def test_conditional_rule_masks_what_is_outside():
    axes = (Axis("depth", 0.0, 60.0, 5.0), Axis("salt", 0.0, 8.0, 1.0))
    rule = {"type": "conditional_range", "if": {"axis": "depth", "op": ">", "value": 45}, "then": {"axis": "salt", "min": 1, "max": 6}}
    assert feasible_size(Goal("g", axes, rules=(rule,)))["masked_bins"] == 3 * (1 + 2)
    assert feasible_size(Goal("g", axes, rules=({**rule, "enabled": False},)))["masked_bins"] == 0


def test_comparisons_at_centres():
    ten, half = Axis("a", 0.0, 100.0, 10.0), Axis("a", 0.0, 10.0, 0.5)
    assert condition_ranges(ten, ">", 45.0) == [(4, 10)]  # the value's tolerance vanishes beside that of bins
    assert condition_ranges(half, ">", 4.75) == [(10, 20)]
    assert condition_ranges(ten, "==", 45.0) == [(4, 5)] and condition_ranges(ten, "==", 44.0) == [(4, 4)]
    assert condition_ranges(ten, "!=", 45.0) == [(0, 4), (5, 10)]
    assert centre_range(ten, 5.0, 4.0) == (0, 0)
    with pytest.raises(GridError):
        condition_ranges(ten, "~", 1.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.tuples(st.integers(0, 6), st.integers(0, 6))] * 3), max_size=6))
def test_union_against_visiting_cells(raw):
    goal = Goal("g", tuple(Axis(n, 0.0, 6.0, 1.0) for n in "abc"))
    boxes = [dict(zip("abc", b)) for b in raw]
    cells = sum(any(all(s <= i < e for i, (s, e) in zip(c, b)) for b in raw) for c in itertools.product(range(6), repeat=3))
    assert union_size(goal, boxes) == cells


def test_cached_count_only_for_the_same_mask():
    rule = {"type": "focused_2d_mask", "x": "x", "y": "y", "x_range": (0, 5), "y_range": (0, 5)}
    goal = Goal("g", (X, Y), rules=(rule,))
    size = feasible_size(goal)
    assert cached_valid_bins(goal, size) == 75
    assert cached_valid_bins(goal, None) is None
    assert cached_valid_bins(goal.with_axes([{"name": "x", "step": 2.0}]), size) is None
    assert cached_valid_bins(Goal("g", (X, Y)), None) == 100


def test_union_query(spark):
    from densigrid.operators.masks import union_size as by_query

    rng = random.Random(3)
    goal = Goal("g", tuple(Axis(n, 0.0, 9.0, 1.0) for n in "ab"))
    boxes = [{n: tuple(sorted((rng.randint(0, 9), rng.randint(0, 9)))) for n in "ab"} for _ in range(5)]
    assert by_query(spark, goal, boxes).first().masked_bins == union_size(goal, boxes)
    assert by_query(spark, goal, []).first().masked_bins == 0


def test_rules_of_a_form():
    goal = Goal("g", (Axis("Heat", 0.0, 90.0, 10.0), Axis("Load", 0.0, 7.0, 0.5), Axis("Wind", 0.0, 30.0, 3.0)))
    when = {"editableMode": "gui", "guiSpec": {"type": "conditional_range", "if": {"axis": "Heat", "op": ">=", "value": "55"}, "then": {"axis": "Load", "min": 1, "max": 3.25}}}
    box = {"id": "mine", "enabled": 0, "guiSpec": {"type": "focused_2d_mask", "xAxis": " Heat", "yAxis": "Wind", "xMin": 10, "xMax": 20, "yMin": 0.1, "yMax": 9, "scope": {"Load": {"mode": "range", "min": 1, "max": 2}, "Heat": {"mode": "all"}}}}
    a, b = rules.normalised([when, box, {"guiSpec": None}, "x", {"guiSpec": {"type": "polygon"}}, {**when, "editableMode": "text"}], goal)
    assert a["text"] == "not (Heat >= 55 and (Load < 1 or Load > 3.25))" and a["enabled"] and a["id"].startswith("rule_") and len(a["id"]) == 17
    assert b["text"] == "not (Heat >= 10 and Heat <= 20 and Wind >= 0.1 and Wind <= 9 and Load >= 1 and Load <= 2)" and b["id"] == "mine" and not b["enabled"]
    assert rules.normalised([when], goal)[0]["id"] == a["id"] and rules.normalised(None, goal) == []
    for wrong in ({"guiSpec": {"type": "conditional_range", "if": {"axis": "Rain", "op": ">", "value": 1}, "then": {"axis": "Load", "min": 1, "max": 2}}}, {"guiSpec": {**when["guiSpec"], "then": {"axis": "Load", "min": 3, "max": 2}}}, {"guiSpec": {**box["guiSpec"], "xMin": "wide"}}):
        with pytest.raises(GridError):
            rules.normalised([wrong], goal)
