"""Schema profiles of typed tables and of JSON properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.functions.scalars import number


def json_type(kind: Column) -> Column:
    """null, boolean, number, string, array or object from a VARIANT schema text."""
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def property_profile(df: DataFrame, group: str, json: str, samples: int = 8) -> DataFrame:
    """For each group and property: rows with it, coverage, distinct values, share of numbers, types and a few samples."""
    values = df.select(group, F.explode(F.from_json(json, "map<string,string>")).alias("property", "value"))
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    stats = values.groupBy(group, "property").agg(
        F.count("value").alias("n"),
        F.countDistinct("value").alias("n_distinct"),
        F.count_if(number(F.col("value")).isNotNull()).alias("n_numeric"),
    )
    # Values are told apart as a whole and ranked before any is collected, so a group holds only its samples.
    place = F.row_number().over(Window.partitionBy(group, "property").orderBy("value"))
    some = values.filter("value IS NOT NULL").distinct().withColumn("place", place).filter(F.col("place") <= samples)
    some = some.groupBy(group, "property").agg(F.array_sort(F.collect_list("value")).alias("all")).select(group, "property", F.transform("all", lambda v: F.substring(v, 1, 64)).alias("samples"))
    out = stats.join(total, group).join(some, [group, "property"], "left")
    return out.select(group, "property", "n", "n_distinct", F.round(F.col("n") / F.col("total"), 4).alias("coverage"), F.round(F.col("n_numeric") / F.col("n"), 4).alias("numeric_ratio"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """property, n and n_distinct of typed columns, in one pass over narrow rows."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")).select("p.*")
    return pairs.groupBy("property").agg(F.count("value").alias("n"), F.countDistinct("value").alias("n_distinct"))


def field_types(df: DataFrame, json: str) -> DataFrame:
    """field, type and n over JSON objects."""
    pairs = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("field", "v"), F.col(json).alias("j"))
    typed = pairs.select("field", F.when(F.col("v").isNull(), "null").when(F.col("v").isin("true", "false"), "boolean").when(F.col("v").startswith("{"), "object").when(F.col("v").startswith("["), "array").when(number(F.col("v")).isNotNull(), "number").otherwise("string").alias("type"))
    return typed.groupBy("field", "type").agg(F.count(F.lit(1)).alias("n"))
