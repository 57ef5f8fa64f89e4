"""Numbers of rows inside groups, in order, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BINS = 64


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, bins: int = BINS) -> DataFrame:
    """rows with their place in each group, from 0 in the order of ``order``.

    The range of the first order column is cut into bins of equal width in each group, bins are sorted on their own, and the
    counts of the bins before come on top. Groups are cut only if that column is a number, a date or a time; other groups are
    one sort each. Nulls come first, as Spark sorts them.
    """
    kind = rows.schema[order[0]].dataType
    if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)):
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    x = (F.col(order[0]).cast("timestamp") if isinstance(kind, T.DateType) else F.col(order[0])).cast("double")
    at = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    ends = rows.groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi")).select(*at, "__lo", "__hi")
    placed = rows.join(ends, same).drop(*[f"__k{i}" for i in range(len(keys))])
    wide = F.col("__hi") - F.col("__lo")
    bin_ = F.when(x.isNull(), -1).when(wide > 0, F.least(F.floor((x - F.col("__lo")) / wide * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    placed = placed.withColumn("__bin", bin_).drop("__lo", "__hi")
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # at most bins + 1 rows
    starts = placed.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n")).select(*at, F.col("__bin").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = placed.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(*order)) - 1)
    found = local.join(starts, same & (F.col("__bin") == F.col("__b"))).withColumn(out, F.col("__start") + F.col("__at"))
    return found.select(*[c for c in rows.columns if c != out], out)
