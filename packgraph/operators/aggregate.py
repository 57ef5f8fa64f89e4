"""Grouped aggregation with exact sums, first-seen representatives and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions import exact as X
from packgraph.functions.scalars import DECIMAL, half_even, natural_key
from packgraph.operators.fields import Field, Resolver
from packgraph.operators.where import InvalidQuery, compile_where

#: Metrics of the language (fixed values).
METRICS = ("count", "count_distinct", "sum", "avg", "min", "max", "first", "collect_set", "collect_list")


def parse_metrics(metrics: Sequence[dict[str, Any]] | None) -> list[tuple[str, str | None, str]]:
    """(metric, field, output name) of each metric; without any, the row count."""
    out = []
    for m in metrics or [{"agg": "count", "as": "row_count"}]:
        agg, field = m.get("agg", "count"), m.get("field")
        if agg not in METRICS:
            raise InvalidQuery(f"unknown metric {agg!r}")
        if field is None and agg != "count":
            raise InvalidQuery(f"{agg} needs a field")
        out.append((agg, field, m.get("as") or (f"{field}_{agg}" if field else agg)))
    names = [n for _, _, n in out]
    if len(set(names)) < len(names):
        raise InvalidQuery("two metrics have one name")
    return out


def group_key(f: Field) -> Column:
    """A text key: numbers by value, so 1 and 1.0 are one group; text, booleans and null or missing apart from them."""
    if f.kind == "number":
        shown = F.concat(F.lit("n"), f.native.cast("string")) if f.native is not None else None
        return F.coalesce(shown, F.lit("-"))
    if f.kind in ("text", "time"):
        return F.coalesce(F.concat(F.lit("s"), f.native.cast("string")), F.lit("-"))
    tagged = F.when(~f.exists | f.null, "-").when(f.flag.isNotNull(), F.concat(F.lit("b"), f.text))
    if f.kind == "variant":
        is_text = f.num.isNull() | f.string
        return tagged.when(~is_text, F.concat(F.lit("n"), F.regexp_replace(f.num.cast("string"), r"\.?0+$", ""))).otherwise(F.concat(F.lit("s"), f.text))
    return tagged.otherwise(F.concat(F.lit("s"), f.text))


def metric_column(agg: str, f: Field | None, ord_: Column | None) -> Column:
    if agg == "count":
        return F.count(F.lit(1)) if f is None else F.count(f.value)
    assert f is not None
    order = ord_ if ord_ is not None else F.lit(0)
    if agg == "count_distinct":
        return F.countDistinct(f.value)
    if agg == "sum":
        return half_even(F.coalesce(F.sum(f.num), F.lit(0).cast(DECIMAL)))
    if agg == "avg":
        return half_even(F.sum(f.num) / F.count(f.num))
    if agg in ("min", "max"):
        return getattr(F, agg)(f.num)
    if agg == "first":
        return F.min(F.when(f.value.isNotNull(), F.struct(order.alias("o"), f.value.alias("v"))))["v"]
    if agg == "collect_set":
        keyed = F.array_sort(F.collect_set(F.when(f.value.isNotNull(), F.struct(natural_key(f.value).alias("k"), f.value.alias("v")))))
        return F.transform(keyed, lambda s: s["v"])
    keyed = F.array_sort(F.collect_list(F.when(f.value.isNotNull(), F.struct(order.alias("o"), f.value.alias("v")))))
    return F.transform(keyed, lambda s: s["v"])


def aggregate(df: DataFrame, where: Any = None, group_by: Sequence[str] = (), metrics: Sequence[dict[str, Any]] | None = None, properties: str | None = None, order: Column | None = None, skipped: bool = False, exact: bool = False) -> DataFrame:
    """filter, group, aggregate. ``order``: the scan order, for first, collect_list and representatives of groups.

    Typed group columns are grouped as they are, so partial aggregation runs before the shuffle; properties are grouped by
    a canonical key and shown as first seen. ``skipped`` adds, for each numeric metric, how many present values were no
    numbers. ``exact``: sums and averages are text and hold numbers of any size. A global aggregate of nothing is one row, a
    grouped one none.
    """
    resolve = Resolver(df, properties)
    wanted = parse_metrics(metrics)
    rows = df.filter(compile_where(where, resolve)) if where else df
    apart = [(agg, f"__limbs_{n}", n) for agg, _, n in wanted if exact and agg in ("sum", "avg")]
    for agg, f, n in wanted:
        if exact and agg in ("sum", "avg"):
            x = resolve(f)
            rows = X.with_limbs(rows, F.when(x.flag.isNull(), x.value), f"__limbs_{n}")
    columns = [metric_column(agg, resolve(f) if f else None, order).alias(n) for agg, f, n in wanted if not any(n == e for *_, e in apart)]
    columns += [c for _, limbs, n in apart for c in (X.sums(limbs).alias(f"__sum_{n}"), F.count(limbs).alias(f"__n_{n}"))]

    def finished(out: DataFrame) -> DataFrame:
        for agg, _, n in apart:
            out = X.shown(out, f"__sum_{n}", n, f"__n_{n}" if agg == "avg" else None)
        names = [n for _, _, n in wanted]
        return out.select(*[F.col(f"`{c}`") for c in (*[c for c in out.columns if c not in names and not c.startswith("__")][: len(group_by)], *names, *[c for c in out.columns if c.endswith("_skipped") and c not in names])]) if apart else out

    if skipped:
        for agg, f, n in wanted:
            if agg in ("sum", "avg", "min", "max"):
                x = resolve(f)
                known = F.col(f"__limbs_{n}").isNotNull() if exact and agg in ("sum", "avg") else x.num.isNotNull()
                columns.append(F.count_if(x.value.isNotNull() & ~known).alias(f"{n}_skipped"))
    if not group_by:
        return finished(rows.agg(*columns))
    native = [(g, f) for g in group_by if (f := resolve(g)).native is not None]
    dynamic = [(g, f) for g in group_by if (f := resolve(g)).native is None]
    keys = [f.native.alias(g) for g, f in native] + [group_key(f).alias(f"__k_{g}") for g, f in dynamic]
    shown = [metric_column("first", f, order).alias(g) for g, f in dynamic]
    out = rows.groupBy(*keys).agg(*shown, *columns)
    return finished(out.select(*[F.col(f"`{g}`") for g in group_by], *[F.col(f"`{c}`") for c in out.columns if c not in group_by and not c.startswith("__k_")]))


def distinct_values(df: DataFrame, field: str, where: Any = None, properties: str | None = None) -> DataFrame:
    """value: each present value of a field once; arrays count by their elements, one level deep."""
    from pyspark.sql import types as T

    resolve = Resolver(df, properties)
    rows = df.filter(compile_where(where, resolve)) if where else df
    if field in df.schema.names and isinstance(df.schema[field].dataType, T.ArrayType):
        return rows.select(F.explode(F.col(f"`{field}`")).alias("value")).filter("value IS NOT NULL").distinct()
    f = resolve(field)
    if f.native is not None:
        return rows.select(f.native.alias("value")).filter("value IS NOT NULL").distinct()
    items = F.try_variant_get(F.col(properties), "$." + field, "array<string>")
    return rows.select(F.explode(F.coalesce(items, F.array(f.value))).alias("value")).filter("value IS NOT NULL").distinct()


def histogram(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), name)


def nested_totals(df: DataFrame, outer: str, inner: str, value: Column, refs: str) -> DataFrame:
    """Two levels in one shuffle of partial sums: per outer key a total, and an array of its inner keys' totals."""
    low = df.groupBy(outer, inner).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.countDistinct(refs).alias("refs"))
    return low.groupBy(outer).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(inner, "total", "n", "refs"))).alias("items"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n of tables; an empty one counts 0."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
