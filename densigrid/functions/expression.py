"""The small expression language of older rules, compiled to columns.

Numbers, true and false, axis names; ``+ - * / ** %``, unary ``+ - not``; ``and``, ``or`` between booleans; chained
comparisons; abs, min, max, sqrt, log, exp.  Division by zero, logarithms and roots outside their domain give infinities and NaN
as floating-point arithmetic does, NaN compares as false, and ``%`` takes the divisor's sign.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from densigrid.functions.cells import all_of, any_of
from densigrid.plans.grid import GridError

_NAN, _INF = float("nan"), float("inf")


def _divide(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(_NAN)).when(a > 0, F.lit(_INF)).otherwise(F.lit(-_INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def _modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(_NAN)).otherwise(a - b * F.floor(a / F.when(b != 0, b)))


def _log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)).otherwise(F.log(F.when(x > 0, x)))


def _pick(chosen):
    def of(*xs: Column) -> Column:
        if len(xs) < 2:
            raise GridError("min and max need two arguments or more")
        return F.when(any_of([F.isnan(x) for x in xs]), F.lit(_NAN)).otherwise(chosen(*xs))

    return of


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: _divide, ast.Pow: F.pow, ast.Mod: _modulo}
_CALLS = {"abs": F.abs, "min": _pick(F.least), "max": _pick(F.greatest), "sqrt": F.sqrt, "log": _log, "exp": F.exp}
_ORDER = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def names_in(text: str) -> set[str]:
    return {n.id for n in ast.walk(_parse(text)) if isinstance(n, ast.Name) and n.id not in _CALLS}


def _parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        raise GridError(f"{text!r} is no expression") from None


def compile_expression(text: str, columns: dict[str, Column]) -> Column:
    """A boolean column; anything outside the language, unknown names and results that are no boolean are errors."""
    column, kind = _walk(_parse(text), columns)
    if kind != "boolean":
        raise GridError(f"{text!r} gives a number where a condition is needed")
    return column


def _walk(node: ast.expr, columns: dict[str, Column]) -> tuple[Column, str]:
    def number(part: ast.expr) -> Column:
        value, kind = _walk(part, columns)
        return value if kind == "number" else value.cast("int").cast("double")

    match node:
        case ast.Constant(value=bool() as v):
            return F.lit(v), "boolean"
        case ast.Constant(value=int() | float() as v):
            return F.lit(float(v)), "number"
        case ast.Name(id=name):
            if name.startswith("__") or name not in columns:
                raise GridError(f"unknown name {name!r}", hint=f"axes: {', '.join(columns)}")
            return columns[name], "number"
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return _BINARY[type(op)](number(a), number(b)), "number"
        case ast.UnaryOp(op=ast.Not(), operand=a):
            value, kind = _walk(a, columns)
            return (~value if kind == "boolean" else value == 0), "boolean"
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -number(a), "number"
        case ast.UnaryOp(op=ast.UAdd(), operand=a):
            return number(a), "number"
        case ast.BoolOp(op=op, values=parts):
            made = [_walk(p, columns) for p in parts]
            if any(kind != "boolean" for _, kind in made):
                raise GridError("and / or join conditions, not numbers")
            return (all_of if isinstance(op, ast.And) else any_of)([c for c, _ in made]), "boolean"
        case ast.Compare(left=first, ops=ops, comparators=rest) if all(type(o) in _ORDER for o in ops):
            xs = [number(first), *map(number, rest)]
            each = []
            for op, a, b in zip(ops, xs, xs[1:]):
                odd = F.isnan(a) | F.isnan(b)
                each.append(F.when(odd, F.lit(isinstance(op, ast.NotEq))).otherwise(_ORDER[type(op)](a, b)))
            return all_of(each), "boolean"
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if name in _CALLS:
            return _CALLS[name](*map(number, args)), "number"
    raise GridError(f"{ast.unparse(node)!r} is not part of the expression language")
