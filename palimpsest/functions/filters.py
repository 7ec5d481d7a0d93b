"""The JSON filter language, parsed on the driver and compiled to one two-valued boolean Column.

A leaf on an absent key is false whatever its operator, and NOT of it is true; so every leaf is wrapped
before it meets AND, OR or NOT. A number compares as a number where the payload reads as one, else as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Validation

OPERATORS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "contains", "icontains")
#: Numbers as the payload may write them: no spaces around, no type suffix.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"

Value = str | float | bool


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str  # of OPERATORS, or "any"
    value: Value | tuple[Value, ...] = ""


@dataclass(frozen=True)
class Group:
    kind: str  # "AND", "OR", "NOT"
    items: tuple[Leaf | Group, ...]


Expr = Leaf | Group


def display(value: Value) -> str:
    """A literal as text: whole numbers without decimals, others in full, never with an exponent."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if value == int(value) and abs(value) < 1e15:
        return format(value, ".0f")
    import numpy as np

    return np.format_float_positional(value, trim="-")


def _literal(x: object, what: str) -> Value:
    if isinstance(x, (bool, str)):
        return x
    if isinstance(x, (int, float)):
        return float(x)
    raise Validation(f"{what} needs a text, a number or a truth value")


def parse(spec: object) -> Expr:
    """The expression of a decoded JSON object; several fields, and several operators of a field, all have to hold."""
    if not isinstance(spec, dict):
        raise Validation("a filter is an object")
    items: list[Expr] = []
    for name, what in spec.items():
        if name in ("AND", "OR", "NOT"):
            if not isinstance(what, list):
                raise Validation(f"{name} needs a list")
            items.append(Group(name, tuple(map(parse, what))))
        elif isinstance(what, dict):
            for op, value in what.items():
                if op not in OPERATORS:
                    raise Validation(f"unknown operator {op}")
                if op in ("in", "nin"):
                    if not isinstance(value, list):
                        raise Validation(f"{op} needs a list")
                    items.append(Leaf(name, op, tuple(_literal(v, op) for v in value)))
                elif op in ("contains", "icontains") and not isinstance(value, str):
                    raise Validation(f"{op} needs a text")
                else:
                    items.append(Leaf(name, op, _literal(value, op)))
        else:
            items.append(Leaf(name, "any") if what == "*" else Leaf(name, "eq", _literal(what, name)))
    return items[0] if len(items) == 1 else Group("AND", tuple(items))


def to_json(expr: Expr) -> dict:
    """The object that parses to ``expr``."""
    if isinstance(expr, Group):
        return {expr.kind: [to_json(x) for x in expr.items]}
    if expr.op == "any":
        return {expr.field: "*"}
    return {expr.field: {expr.op: list(expr.value) if isinstance(expr.value, tuple) else expr.value}}


def _number(v: Column) -> Column:
    return F.when(v.rlike(_NUMBER), v.try_cast("double"))


def _compare(v: Column, value: Value, test: Callable[[Column, Column], Column]) -> Column:
    as_text = test(v, F.lit(display(value)))
    if isinstance(value, (bool, str)):
        return as_text
    n = _number(v)
    return F.when(n.isNotNull(), ~F.isnan(n) & test(n, F.lit(value))).otherwise(as_text)


def _leaf(leaf: Leaf, v: Column) -> Column:
    eq = lambda value: _compare(v, value, lambda a, b: a == b)
    among = lambda: reduce(or_, map(eq, leaf.value), F.lit(False))
    match leaf.op:
        case "any":
            return F.lit(True)
        case "eq":
            return eq(leaf.value)
        case "ne":
            return v.isNotNull() & ~eq(leaf.value)
        case "in":
            return among()
        case "nin":
            return v.isNotNull() & ~among()
        case "gt":
            return _compare(v, leaf.value, lambda a, b: a > b)
        case "gte":
            return _compare(v, leaf.value, lambda a, b: a >= b)
        case "lt":
            return _compare(v, leaf.value, lambda a, b: a < b)
        case "lte":
            return _compare(v, leaf.value, lambda a, b: a <= b)
        case "contains":
            return v.contains(leaf.value)
        case _:
            return F.lower(v).contains(F.lower(F.lit(leaf.value)))


def compile_filter(expr: Expr, value_of: Callable[[str], Column]) -> Column:
    """``expr`` over payload values, null where a key is absent."""
    if isinstance(expr, Leaf):
        return F.coalesce(_leaf(expr, value_of(expr.field)), F.lit(False))
    parts = [compile_filter(x, value_of) for x in expr.items]
    if expr.kind == "OR":
        return reduce(or_, parts, F.lit(False))
    both = reduce(and_, parts, F.lit(True))
    return ~both if expr.kind == "NOT" else both


def in_scope(scope: dict[str, str], value_of: Callable[[str], Column]) -> Column:
    """Every key of ``scope`` has its value; a row may have more keys."""
    return reduce(and_, (F.coalesce(value_of(k) == v, F.lit(False)) for k, v in scope.items()), F.lit(True))


def is_live(today: str, expiration: Column) -> Column:
    """Not expired: no date, or one that isn't before ``today`` (YYYY-MM-DD)."""
    return ~F.coalesce(expiration < F.lit(today), F.lit(False))
