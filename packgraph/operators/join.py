"""Joins by property: each left row with all its matches nested, never their product."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.operators.fields import Resolver
from packgraph.operators.where import InvalidQuery, compile_where

JOINS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full"}


def _side(df: DataFrame, field: str, where: Any, properties: str | None) -> DataFrame:
    resolve = Resolver(df, properties)
    rows = df.filter(compile_where(where, resolve)) if where else df
    return rows.withColumn("join_key", resolve(field).value).filter("join_key IS NOT NULL")


def join_by_property(left: DataFrame, left_field: str, right: DataFrame, right_field: str, how: str = "inner", left_where: Any = None, right_where: Any = None, properties: str | None = None, summary: list[Column] | None = None, samples: tuple[int, list[str]] | None = None) -> DataFrame:
    """join_key, left (struct of the row, null for a key of the right side only) and the right side's columns.

    Null and missing keys are left out on both sides, in outer joins too. Without ``summary`` the right side is an array of
    its rows; with it, only these aggregates are kept of each key, which a hot key needs. ``samples`` (how many, columns) adds
    the first rows of a key by these columns; each task keeps no more than that of a key before rows are moved.
    """
    if how not in JOINS:
        raise InvalidQuery(f"unknown join {how!r}")
    a = _side(left, left_field, left_where, properties)
    a = a.select("join_key", F.struct(*[c for c in a.columns if c != "join_key"]).alias("left"))
    b = _side(right, right_field, right_where, properties)
    rows = summary or [F.collect_list(F.struct(*[c for c in b.columns if c != "join_key"])).alias("right")]
    right = b.groupBy("join_key").agg(*rows)
    if samples:
        most, columns = samples
        place = F.row_number().over(Window.partitionBy("join_key").orderBy(*columns))
        some = b.select("join_key", *columns).withColumn("__p", place).filter(F.col("__p") <= most)
        right = right.join(some.groupBy("join_key").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("samples")), "join_key")
    return a.join(right, "join_key", JOINS[how])


def key_diagnostics(left: DataFrame, left_field: str, right: DataFrame, right_field: str) -> DataFrame:
    """join_key and side (matched, unmatched_left, unmatched_right) of every key."""
    a = left.select(F.col(left_field).cast("string").alias("join_key")).filter("join_key IS NOT NULL").distinct().withColumn("l", F.lit(True))
    b = right.select(F.col(right_field).cast("string").alias("join_key")).filter("join_key IS NOT NULL").distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("r").isNull(), "unmatched_left").when(F.col("l").isNull(), "unmatched_right").otherwise("matched")
    return a.join(b, "join_key", "full").select("join_key", side.alias("side"))


def enrich(rows: DataFrame, key: str, lookup: DataFrame, lookup_key: str, columns: list[str]) -> DataFrame:
    """Left lookup of further columns by the keys' text."""
    table = lookup.select(F.col(lookup_key).cast("string").alias("__k"), *columns).dropDuplicates(["__k"])
    return rows.join(table, F.col(key).cast("string") == F.col("__k"), "left").drop("__k")


def visible(rows: DataFrame, key: str, access: DataFrame, access_key: str) -> DataFrame:
    """Row-level security: rows whose key the access table has."""
    return rows.join(access.select(F.col(access_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi")


def evidence_first(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """All rows of ``first``, or those of ``fallback`` if there are none."""
    some = first.limit(1).agg(F.count(F.lit(1)).alias("__n"))
    return first.unionByName(fallback.join(F.broadcast(some.filter("__n = 0")), F.lit(True), "left_semi"))
