"""Whole vectors of a table, and joins that spread heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import plain

HEAVY = 1024  # a key is heavy if it has over 1 / HEAVY of all rows, so there are at most HEAVY of them to a position


def whole_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label and vector (array of doubles) of the rows whose vector is there and holds finite numbers only."""
    rows = plain(df, vec_id="long", label="long", **{column: "array<double>"}).withColumnRenamed(column, "vector")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd)


def common_size(rows: DataFrame, column: str = "vector") -> int | None:
    """The most frequent length of the vectors, the greater of two that are; None if there are no rows."""
    found = rows.groupBy(F.size(column).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return found[0]["size"] if found else None


def joined_by(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, row: str) -> DataFrame:
    """The inner join of left with right, which has one row for each key and the number of left rows of it in ``weight``.

    Heavy keys are dealt to as many parts as they have shares of 1 / HEAVY: left rows draw one by the hash of ``row``, right
    rows are repeated. Only heavy keys are broadcast, of which there are at most HEAVY for each time a left row is counted in total.
    """
    heavy = F.col(weight) * HEAVY > F.lit(total)
    parts = F.ceil(F.col(weight) * HEAVY / F.lit(total)).cast("int")
    keys = right.filter(heavy).select(*on, parts.alias("__parts"))
    salted = left.join(F.broadcast(keys), on, "left").withColumn("__salt", F.pmod(F.xxhash64(row), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(heavy, parts - 1).otherwise(0))))
    return salted.join(repeated, [*on, "__salt"]).drop("__salt")
