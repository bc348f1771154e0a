"""Rules that make cells infeasible, compiled to boxes of bin indices, and the exact size of the boxes' union.

Two kinds of rules, as dicts:

``{"type": "focused_2d_mask", "x", "y", "x_range": (lo, hi), "y_range": (lo, hi), "scope": {axis: {"mode": "all"} |
{"mode": "range", "min", "max"}}}`` masks what lies in both ranges (and in the scopes).

``{"type": "conditional_range", "if": {"axis", "op", "value"}, "then": {"axis", "min", "max"}}`` masks what meets the
condition and lies outside min..max.

Rules as a form sends them (``guiSpec`` with ``xAxis``, ``xMin`` and so on) are brought to this shape by ``from_form``.

A box maps axis names to half-open bin ranges; an axis that it lacks is free.  A cell counts as in a range if its centre is.
"""

from __future__ import annotations

import hashlib
import math

from densigrid.plans.grid import Axis, Goal, GridError, rule_axes

#: Fixed tolerances: of bin positions, and of the values of strict comparisons.
SLACK = 1e-12
OPERATORS = (">", ">=", "<", "<=", "==", "!=")


def centre_range(axis: Axis, low: float | None, high: float | None) -> tuple[int, int]:
    """Bins whose centre lies in [low, high]; None is unbounded."""
    if low is not None and high is not None and low > high:
        return 0, 0
    place = lambda v: (v - axis.low) / axis.step - 0.5
    first = 0 if low is None else math.ceil(place(low) - SLACK)
    after = axis.bins if high is None else math.floor(place(high) + SLACK) + 1
    clamp = lambda i: min(axis.bins, max(0, i))
    return clamp(first), clamp(after)


def condition_ranges(axis: Axis, op: str, value: float) -> list[tuple[int, int]]:
    match op:
        case ">":
            return [centre_range(axis, value + SLACK, None)]
        case ">=":
            return [centre_range(axis, value, None)]
        case "<":
            return [centre_range(axis, None, value - SLACK)]
        case "<=":
            return [centre_range(axis, None, value)]
        case "==":
            return [centre_range(axis, value, value)]
        case "!=":
            first, after = centre_range(axis, value, value)
            return [r for r in ((0, first), (after, axis.bins)) if r[1] > r[0]]
    raise GridError(f"unknown comparison {op!r}", hint=f"one of {' '.join(OPERATORS)}")


def finite(value: object, what: str) -> float:
    try:
        number = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise GridError(f"{what} must be a number") from None
    if not math.isfinite(number):
        raise GridError(f"{what} must be finite")
    return number


def ordered(pair, what: str) -> tuple[float, float]:
    low, high = (finite(v, what) for v in pair)
    if low > high:
        raise GridError(f"{what}: the least value lies above the greatest")
    return low, high


def rule_boxes(rule: dict, goal: Goal) -> list[dict[str, tuple[int, int]]]:
    axes = {a.name: a for a in goal.axes}

    def axis(name: str) -> Axis:
        if name not in axes:
            raise GridError(f"a rule speaks of axis {name!r}, which the goal lacks")
        return axes[name]

    if rule["type"] == "focused_2d_mask":
        if rule["x"] == rule["y"]:
            raise GridError("a focused rule needs two different axes")
        box = {n: centre_range(axis(n), *ordered(rule[r], n)) for n, r in ((rule["x"], "x_range"), (rule["y"], "y_range"))}
        for name, scope in rule.get("scope", {}).items():
            mode = str(scope.get("mode", "all")).strip().lower()
            if mode not in ("all", "range"):
                raise GridError(f"unknown scope mode {mode!r}")
            if axis(name) and name not in box and mode == "range":
                box[name] = centre_range(axes[name], *ordered((scope["min"], scope["max"]), name))
        found = [box]
    elif rule["type"] == "conditional_range":
        if_axis, then_axis = axis(rule["if"]["axis"]), axis(rule["then"]["axis"])
        low, high = ordered((rule["then"]["min"], rule["then"]["max"]), "THEN")
        outside = condition_ranges(then_axis, "<", low) + condition_ranges(then_axis, ">", high)
        met = condition_ranges(if_axis, rule["if"]["op"], finite(rule["if"]["value"], "IF"))
        found = [{if_axis.name: a, then_axis.name: b} for a in met for b in outside]
    else:
        return []  # kinds that were never certified mask nothing
    return [b for b in found if all(end > start for start, end in b.values())]


def boxes_of(goal: Goal) -> list[dict[str, tuple[int, int]]]:
    return [b for rule in goal.rules if rule.get("enabled", True) for b in rule_boxes(rule, goal)]


def full(box: dict[str, tuple[int, int]], goal: Goal) -> tuple[tuple[int, int], ...]:
    """A box's range on each axis, cut to the grid."""
    return tuple((max(0, min(a.bins, s)), max(0, min(a.bins, e))) for a in goal.axes for s, e in [box.get(a.name, (0, a.bins))])


def without(box: tuple, other: tuple) -> list[tuple]:
    """Disjoint boxes that make up ``box`` less ``other``."""
    if any(max(a, c) >= min(b, d) for (a, b), (c, d) in zip(box, other)):
        return [box]
    out, rest = [], list(box)
    for i, ((a, b), (c, d)) in enumerate(zip(box, other)):
        for part in ((a, c), (d, b)):
            if part[1] > part[0]:
                out.append((*rest[:i], part, *rest[i + 1 :]))
        rest[i] = (max(a, c), min(b, d))
    return out


def union_size(goal: Goal, boxes: list[dict[str, tuple[int, int]]]) -> int:
    """Cells in at least one box, without visiting cells: each box is cut down to what earlier ones leave of it."""
    seen: list[tuple] = []
    for box in (full(b, goal) for b in boxes):
        parts = [box] if all(e > s for s, e in box) else []
        for other in seen:
            parts = [p for part in parts for p in without(part, other)]
        seen += parts
    return sum(math.prod(e - s for s, e in box) for box in seen)


def feasible_size(goal: Goal) -> dict:
    """Cells of the grid, masked and valid ones."""
    boxes = boxes_of(goal)
    masked = min(goal.total_bins, union_size(goal, boxes))
    return {"total_bins": goal.total_bins, "masked_bins": masked, "valid_bins": goal.total_bins - masked, "boxes": len(boxes), "signature": goal.mask_signature(boxes)}


def cached_valid_bins(goal: Goal, cache: dict | None) -> int | None:
    """Valid cells if no count is needed (no boxes) or the cached one is of this very mask; else None: pending."""
    boxes = boxes_of(goal)
    if not boxes:
        return goal.total_bins
    if cache and cache.get("signature") == goal.mask_signature(boxes) and cache.get("total_bins") == goal.total_bins:
        return cache["valid_bins"]
    return None


def from_form(rule: dict) -> dict | None:
    """A rule of a form in the shape of this module; None for kinds that were never certified (they mask nothing)."""
    spec = rule.get("guiSpec")
    if not isinstance(spec, dict) or rule.get("editableMode", "gui") != "gui":
        return None
    kept = {k: rule[k] for k in ("id", "enabled") if k in rule}
    name = lambda part, key: str((part or {}).get(key) or "").strip()
    match spec.get("type", "conditional_range"):
        case "focused_2d_mask":
            scope = {str(n).strip(): s for n, s in (spec.get("scope") or {}).items()}
            return {**kept, "type": "focused_2d_mask", "x": name(spec, "xAxis"), "y": name(spec, "yAxis"), "x_range": (spec.get("xMin"), spec.get("xMax")), "y_range": (spec.get("yMin"), spec.get("yMax")), "scope": scope}
        case "conditional_range":
            when, then = spec.get("if") or {}, spec.get("then") or {}
            return {**kept, "type": "conditional_range", "if": {"axis": name(when, "axis"), "op": name(when, "op"), "value": when.get("value")}, "then": {"axis": name(then, "axis"), "min": then.get("min"), "max": then.get("max")}}
    return None


def number_text(value: object) -> str:
    return format(finite(value, "a rule's value"), ".12g")


def rule_text(rule: dict) -> str:
    """The rule in the expression language: true for values that it does not mask."""
    if rule["type"] == "conditional_range":
        when, then = rule["if"], rule["then"]
        low, high = map(number_text, ordered((then["min"], then["max"]), "THEN"))
        return f"not ({when['axis']} {when['op']} {number_text(when['value'])} and ({then['axis']} < {low} or {then['axis']} > {high}))"
    ranges = [(rule["x"], rule["x_range"]), (rule["y"], rule["y_range"])]
    ranges += [(n, (s["min"], s["max"])) for n, s in rule.get("scope", {}).items() if s.get("mode", "all") == "range" and n not in (rule["x"], rule["y"])]
    bounds = [f"{n} {op} {number_text(v)}" for n, pair in ranges for op, v in zip((">=", "<="), ordered(pair, n))]
    return f"not ({' and '.join(bounds)})"


def normalised(rules: list[dict], goal: Goal) -> list[dict]:
    """Rules that the goal can use, each with id, enabled and text: others are left out, wrong ones are errors.

    A rule without an id is named by its text, so that equal rules have equal ids.
    """
    out = []
    for raw in rules if isinstance(rules, list) else []:
        rule = from_form(raw) if isinstance(raw, dict) and "guiSpec" in raw else raw
        if not isinstance(rule, dict) or rule.get("type") not in ("conditional_range", "focused_2d_mask"):
            continue
        if missing := rule_axes(rule) - set(goal.names):
            raise GridError(f"a rule speaks of {', '.join(sorted(missing)) or 'no axis'}, which the goal lacks")
        rule_boxes(rule, goal)  # its own errors
        text = rule_text(rule)
        out.append({**rule, "id": str(rule.get("id") or f"rule_{hashlib.sha1(text.encode()).hexdigest()[:12]}"), "enabled": bool(rule.get("enabled", True)), "text": text})
    return out
