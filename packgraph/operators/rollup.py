"""Hierarchy roll-ups: part, assembly, module, module type. Measures are added level by level, each over the one below."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANK = "(blank)"


def blank(column: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit(BLANK))


def level(parts: DataFrame, keys: Sequence[str], sums: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """Count, sums and distinct counts of one level."""
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()], *[F.countDistinct(c).alias(n) for n, c in (distinct or {}).items()])


def raise_level(low: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The next level from the one below, so the parts are read once."""
    return low.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums], F.count(F.lit(1)).alias("children"))


def by_value(parts: DataFrame, keys: Sequence[str], column: str, sums: dict[str, Column]) -> DataFrame:
    """Long form of a nested map: one row per key and value of a column, blanks named."""
    return level(parts.withColumn("value", blank(F.col(column))), [*keys, "value"], sums)


def as_map(long: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """The long form as one map per key, for a sink."""
    return long.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", measure)))).alias("by_value"))


def conditional_counts(rows: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def extents(rows: DataFrame, keys: Sequence[str], x: Column, y: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(x).alias("x1"), F.min(y).alias("y1"), F.max(x).alias("x2"), F.max(y).alias("y2"))


def facets(rows: DataFrame, value: str, object_id: str) -> DataFrame:
    """Distinct objects for each value, ignoring case; the name is the least spelling."""
    return rows.groupBy(F.lower(value).alias("facet")).agg(F.countDistinct(object_id).alias("n_objects"), F.min(value).alias("name"))


def fastener_name(diameter_m: Column, length_m: Column) -> Column:
    """M{d}x{l} in whole millimetres."""
    mm = lambda c: F.round(c * 1000).cast("int").cast("string")
    return F.concat(F.lit("M"), mm(diameter_m), F.lit("x"), mm(length_m))


def least_values(rows: DataFrame, keys: Sequence[str], value: Column, most: int, out: str) -> DataFrame:
    """keys and the ``most`` least distinct values of each; they are ranked before any is collected."""
    flat = rows.select(*keys, value.alias("__v")).filter("__v IS NOT NULL").distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__v"))
    return flat.withColumn("__p", place).filter(F.col("__p") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias(out))


def type_rows(rows: DataFrame, keys: Sequence[str], length: Column, area: Column, volume: Column, concrete: Column, sample: Column) -> DataFrame:
    """Quantities per type; volume counts concrete only; three least samples. Types whose key is null have none."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("length"), F.sum(area).alias("area"), F.sum(F.when(concrete, volume).otherwise(0)).alias("volume"))
    return sums.join(least_values(rows, keys, sample, 3, "samples"), list(keys), "left")
