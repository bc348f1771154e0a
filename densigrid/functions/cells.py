"""Columns that place values in grids: parsing, bin indices, row status, masks.  All of them compile to JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from densigrid.plans.grid import Axis, Goal

#: What counts as a number in text cells: plain decimals with an optional exponent, padded with blanks.
NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def parsed(cell: Column) -> Column:
    """A finite double, or null: text that is no number, NaN and infinities are invalid."""
    value = F.when(cell.rlike(NUMBER), F.trim(F.regexp_replace(cell, r"\s", "")).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def finite(value: Column) -> Column:
    """A numeric column with NaN and infinities as null."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def inside(axis: Axis, v: Column) -> Column:
    return (v >= axis.low) & (v <= axis.high)


def bin_index(axis: Axis, v: Column) -> Column:
    """Index of a value inside the domain, null outside it; the domain's end belongs to the last bin.

    The quotient stays in IEEE doubles: (v - low) / step.
    """
    cell = F.least(F.lit(axis.bins - 1), F.greatest(F.lit(0), F.floor((v - F.lit(axis.low)) / F.lit(axis.step)).cast("int")))
    return F.when(inside(axis, v), F.when(v == axis.high, F.lit(axis.bins - 1)).otherwise(cell))


def bin_index_clamped(axis: Axis, v: Column) -> Column:
    """Values outside the domain count as its ends; the upper end is the number just below it."""
    top = axis.high - 2.220446049250313e-16
    return F.floor((F.least(F.greatest(v, F.lit(axis.low)), F.lit(top)) - F.lit(axis.low)) / F.lit(axis.step)).cast("int")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def masked(boxes: list[dict[str, tuple[int, int]]], index: dict[str, Column]) -> Column:
    """Is a cell in any box?  Boxes are few and known on the driver, so they are literals of the plan."""
    return any_of([all_of([(index[n] >= s) & (index[n] < e) for n, (s, e) in box.items()]) for box in boxes])


def status(goal: Goal, values: dict[str, Column], index: dict[str, Column], boxes: list[dict]) -> Column:
    """invalid, then out_of_domain, then masked, then valid."""
    invalid = any_of([values[a.name].isNull() for a in goal.axes])
    outside = any_of([~inside(a, values[a.name]) for a in goal.axes])
    return F.when(invalid, "invalid").when(outside, "out_of_domain").when(masked(boxes, index), "masked").otherwise("valid")


def bin_key(index: Column) -> Column:
    """``[2,7]``: the text form of a cell."""
    return F.concat(F.lit("["), F.array_join(F.transform(index, lambda i: i.cast("string")), ","), F.lit("]"))


def centre(axis: Axis, i: Column) -> Column:
    return F.least(F.lit(axis.low) + (i + F.lit(0.5)) * F.lit(axis.step), F.lit(axis.high))


def reordered(vector: Column, have: list[str], want: list[str]) -> Column:
    """A vector's values in another order of axes, by name; null if an axis is missing, or a value is missing or not finite."""
    places = [next((i for i, h in enumerate(have) if h.strip().lower() == w.strip().lower()), None) for w in want]
    if any(p is None for p in places):
        return F.lit(None).cast("array<double>")
    good = all_of([finite(F.get(vector, F.lit(p))).isNotNull() for p in places])
    return F.when(good, F.array(*[F.get(vector, F.lit(p)) for p in places]))


def optional_floats(cells: Column, n: int, default: float = 0.0) -> Column:
    """An array of text or numbers as finite doubles; the default for each where there are not n of them, or one is no number."""
    values = F.transform(cells, lambda x: parsed(x.cast("string")))
    fits = F.coalesce((F.size(cells) == n) & F.forall(values, lambda x: x.isNotNull()), F.lit(False))
    return F.when(fits, values).otherwise(F.array(*[F.lit(float(default))] * n))


def tuple_of(parts: Column, n: int) -> Column:
    """An array of text as n bin indices; null where it has another length, or a part is no integer of 0 or more."""
    values = F.transform(parts, lambda x: x.cast("string").try_cast("int"))
    return F.when((F.size(parts) == n) & F.forall(values, lambda x: x.isNotNull() & (x >= 0)), values)


def delta(new: Column, old: Column) -> Column:
    """Change to six digits; null where either side is pending."""
    return F.round(new - old, 6)


def axis_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def subset_key(names: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(names, axis_key)), "|")
