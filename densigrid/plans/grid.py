"""Axes, goals (named grids) and what is computed from them alone."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace


class GridError(ValueError):
    """A request that cannot be planned; ``hint`` says what would help, ``recoverable`` whether the user can."""

    def __init__(self, message: str, hint: str = "", recoverable: bool = True):
        super().__init__(message)
        self.hint, self.recoverable = hint, recoverable

    def payload(self) -> dict:
        return {"error": str(self), "type": type(self).__name__, "hint": self.hint, "recoverable": self.recoverable}


class TooLarge(GridError):
    """More cells than an operator that visits each cell may visit."""


def axis_key(name: object) -> str:
    return str(name or "").strip().lower()


@dataclass(frozen=True)
class Axis:
    name: str
    low: float
    high: float
    step: float
    unit: str = ""
    role: str = "input"

    def __post_init__(self):
        if not axis_key(self.name):
            raise GridError("an axis needs a name")
        if not all(map(math.isfinite, (self.low, self.high, self.step))):
            raise GridError(f"axis {self.name}: domain and resolution must be finite")
        if self.high <= self.low:
            raise GridError(f"axis {self.name}: the domain's end must lie above its start")
        if self.step <= 0:
            raise GridError(f"axis {self.name}: the resolution must be positive")

    @property
    def key(self) -> str:
        return axis_key(self.name)

    @property
    def bins(self) -> int:
        return max(1, math.ceil((self.high - self.low) / self.step))

    @property
    def is_input(self) -> bool:
        return self.role != "output"

    def centre(self, i: int) -> float:
        return min(self.low + (i + 0.5) * self.step, self.high)


@dataclass(frozen=True)
class Goal:
    """A grid with a name, the support constant K and the rules that mark infeasible cells.

    Axes are kept in canonical order: by name, trimmed and lower-cased.
    """

    id: str
    axes: tuple[Axis, ...]
    k: float = 10.0
    name: str = ""
    rules: tuple[dict, ...] = field(default=(), hash=False)

    def __post_init__(self):
        axes = tuple(sorted(self.axes, key=lambda a: a.key))
        if not axes:
            raise GridError("a goal needs at least one axis")
        if len({a.key for a in axes}) != len(axes):
            raise GridError("axis names must differ by more than case and blanks")
        if not any(a.is_input for a in axes):
            raise GridError("a goal needs at least one input axis")
        if self.k <= 0:
            raise GridError("K must be positive")
        object.__setattr__(self, "axes", axes)

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.axes]

    @property
    def total_bins(self) -> int:
        return math.prod(a.bins for a in self.axes)

    def subset(self, names: Iterable[str]) -> Goal:
        """The goal on some of its axes.  Rules stay only if all their axes do, as input axes."""
        wanted = {axis_key(n) for n in names}
        axes = tuple(a for a in self.axes if a.key in wanted)
        if not axes:
            raise GridError("none of the selected axes belongs to the goal")
        inputs = {a.name for a in axes if a.is_input}
        if not inputs:
            raise GridError("at least one input axis must be selected")
        return replace(self, axes=axes, rules=tuple(r for r in self.rules if rule_axes(r) and rule_axes(r) <= inputs))

    @property
    def design(self) -> Goal:
        """The goal on its input axes: what confidence, coverage and masks are computed on."""
        return self.subset([a.name for a in self.axes if a.is_input])

    def with_axes(self, changes: Iterable[dict]) -> Goal:
        """Preview axes override low, high and step of the axis with the same key; others stay as they are."""
        by_key = {axis_key(c["name"]): c for c in changes}
        return replace(self, axes=tuple(replace(a, **{k: float(v) for k, v in by_key.get(a.key, {}).items() if k in ("low", "high", "step")}) for a in self.axes))

    def signature(self) -> str:
        """Equal for equal grids, whatever the order and the spelling of axis names."""
        return digest([[a.key, a.low, a.high, a.step] for a in self.axes])

    def mask_signature(self, boxes: list[dict]) -> str:
        """Of the grid and its compiled boxes; here names count as they are written, and the order of boxes counts."""
        return digest([[[a.name, a.low, a.high, a.step] for a in self.axes], [sorted((k, *v) for k, v in b.items()) for b in boxes]])

    def to_json(self) -> str:
        return json.dumps({"id": self.id, "name": self.name, "k": self.k, "axes": [vars(a) for a in self.axes], "rules": list(self.rules)})

    @staticmethod
    def from_json(text: str) -> Goal:
        d = json.loads(text)
        return Goal(d["id"], tuple(Axis(**a) for a in d["axes"]), float(d["k"]), d.get("name", ""), tuple(d.get("rules", ())))


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def rule_axes(rule: dict) -> set[str]:
    """Names of the axes that a rule speaks of; a scope of all values does not bind an axis."""
    if rule["type"] == "conditional_range":
        return {rule["if"]["axis"], rule["then"]["axis"]}
    return {rule["x"], rule["y"], *(n for n, s in rule.get("scope", {}).items() if s.get("mode", "all") == "range")}


def subset_key(names: Iterable[str]) -> str:
    return "|".join(sorted(axis_key(n) for n in names))


def peer_key(goal_id: str, names: Iterable[str]) -> str:
    return f"{goal_id}|{subset_key(names)}"
