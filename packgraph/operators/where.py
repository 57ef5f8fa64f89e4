"""The filter language: JSON objects are checked as a whole and compiled to one Column.

Logic is two-valued. Where a predicate stands positively, its comparison is emitted bare, so that a scan can take it over:
null then drops the row just as false does. Below a negation every comparison is closed with false for null first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions.scalars import DECIMAL, NUMBER
from packgraph.operators.fields import Field, Resolver

#: Operators of the language (fixed values).
OPERATORS = ("eq", "ne", "in", "not_in", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "regex", "wildcard", "exists")
MAX_DEPTH, MAX_CLAUSES = 32, 1024


class InvalidQuery(ValueError):
    """A query that is wrong whatever the data."""


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class Group:
    op: str  # and, or, not
    parts: tuple


def as_number(value: Any) -> Decimal | None:
    """A number, or a string that is one as a whole; booleans are none."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        if not re.match(NUMBER, value):
            return None
        value = value.replace(",", "").strip()
    elif not isinstance(value, (int, float, Decimal)):
        return None
    number = Decimal(str(value))
    return number if number.is_finite() else None


def parse(where: Any) -> Group:
    """The checked tree of a where object; every branch is checked, whether data would reach it or not."""
    count = 0

    def leaf(field: str, op: str, value: Any) -> Leaf:
        nonlocal count
        count += 1
        if count > MAX_CLAUSES:
            raise InvalidQuery(f"more than {MAX_CLAUSES} clauses")
        if op not in OPERATORS:
            raise InvalidQuery(f"unknown operator {op!r}")
        if op == "exists" and not isinstance(value, bool):
            raise InvalidQuery("exists takes true or false")
        if op in ("gt", "gte", "lt", "lte") and as_number(value) is None and not _is_time(value):
            raise InvalidQuery(f"{op} takes a number")
        if op == "regex":
            try:
                re.compile(str(value))
            except re.error as e:
                raise InvalidQuery(f"bad regex: {e}") from e
        return Leaf(field, op, value)

    def walk(node: Any, depth: int) -> Group:
        if depth > MAX_DEPTH:
            raise InvalidQuery(f"nested deeper than {MAX_DEPTH}")
        if not isinstance(node, dict):
            raise InvalidQuery("where takes an object")
        parts: list = []
        for key, value in node.items():
            if key in ("$and", "$or"):
                if not isinstance(value, (list, tuple)):
                    raise InvalidQuery(f"{key} takes a list")
                parts.append(Group(key[1:], tuple(walk(x, depth + 1) for x in value)))
            elif key == "$not":
                parts.append(Group("not", (walk(value, depth + 1),)))
            elif key.startswith("$"):
                raise InvalidQuery(f"unknown operator {key!r}")
            elif isinstance(value, dict):
                parts += [leaf(key, op, v) for op, v in value.items()]
            else:
                name, _, op = key.rpartition("__")
                parts.append(leaf(name, op, value) if name and op in OPERATORS else leaf(key, "eq", value))
        return Group("and", tuple(parts))

    return walk(where or {} if where is None or where == {} else where, 1)


def _is_time(value: Any) -> bool:
    return isinstance(value, str) and re.match(r"^\d{4}-\d\d-\d\d", value) is not None


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression over the whole string; ``.`` matches line breaks."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 1 + (glob[i : i + 1] == "!"))) > 0:
            inside = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{inside[1:]}]" if inside.startswith("!") else f"[{inside}]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)\\A" + "".join(out) + "\\z"


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect: named groups and the absolute end."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern)).replace("\\Z", "\\z")


def _equal(f: Field, expected: Any) -> Column:
    if expected is None:
        return f.exists & f.null
    if isinstance(expected, bool):
        return f.flag == F.lit(expected)
    n = as_number(expected)
    if f.kind == "number":
        return F.lit(False) if n is None else f.native == _literal(n, f)
    if f.kind == "flag":
        return F.lit(False)
    if f.kind == "time":
        return f.native == F.lit(str(expected)).try_cast("timestamp")
    if n is not None:
        return f.num == F.lit(n).cast(DECIMAL)
    if isinstance(expected, str):
        return f.native == expected if f.native is not None else F.when(~f.null & f.flag.isNull(), f.text == expected)
    import json

    return f.text == json.dumps(expected, separators=(",", ":"), ensure_ascii=False)


def _literal(n: Decimal, f: Field) -> Column:
    """A literal that a typed column is compared with in its own kind where that loses nothing."""
    if n == n.to_integral_value() and abs(n) < 1 << 31:
        return F.lit(int(n))
    return F.lit(float(n)) if Decimal(repr(float(n))) == n else F.lit(n)


def _leaf(leaf: Leaf, f: Field) -> Column:
    op, value = leaf.op, leaf.value
    if op == "exists":
        return f.exists if value else ~f.exists
    if op == "eq":
        return _equal(f, value)
    if op == "ne":
        not_equal = ~F.coalesce(_equal(f, value), F.lit(False))
        return F.when(f.exists, not_equal).otherwise(F.lit(value is not None))
    if op in ("in", "not_in"):
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if op == "in" and f.kind == "text" and values and all(isinstance(v, str) and as_number(v) is None for v in values):
            return f.native.isin(values)
        if op == "in" and f.kind == "number" and values and all(as_number(v) is not None for v in values):
            return f.native.isin([int(n) if (n := as_number(v)) == n.to_integral_value() else float(n) for v in values])
        any_of = F.lit(False)
        for v in values:
            any_of = any_of | F.coalesce(_equal(f, v), F.lit(False))
        return f.exists & (any_of if op == "in" else ~any_of)
    if op in ("gt", "gte", "lt", "lte"):
        compare: Callable[[Column, Column], Column] = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}[op]
        if f.kind == "time":
            return compare(f.native, F.lit(str(value)).try_cast("timestamp"))
        n = as_number(value)
        if n is None:
            return F.lit(False)
        return compare(f.native, _literal(n, f)) if f.kind == "number" else compare(f.num, F.lit(n).cast(DECIMAL))
    text = F.when(f.exists, f.text) if f.native is None else f.text
    wanted = "None" if value is None else str(value)
    if op == "regex":
        return text.rlike(java_pattern(wanted))
    if op == "wildcard":
        return text.rlike(glob_pattern(wanted))
    return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op](F.lower(text), F.lit(wanted.lower()))


def compile_where(where: Any, resolve: Callable[[str], Field]) -> Column:
    """The predicate of a where object; never null below a negation, and null only for false otherwise."""

    def emit(node: Leaf | Group, positive: bool) -> Column:
        if isinstance(node, Leaf):
            p = _leaf(node, resolve(node.field))
            return p if positive else F.coalesce(p, F.lit(False))
        if node.op == "not":
            return ~emit(node.parts[0], False)
        out = F.lit(node.op == "and")
        for k, part in enumerate(node.parts):
            p = emit(part, positive)
            out = p if k == 0 else (out & p if node.op == "and" else out | p)
        return out

    return emit(parse(where), True)


def filter_rows(df: DataFrame, where: Any, properties: str | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    return df.filter(compile_where(where, Resolver(df, properties, aliases)))
