"""Plain sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def xml_objects(spark: SparkSession, path: str, tag: str = "Object", schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """value (VARIANT) of each line; strict: a malformed line fails the read, else it is skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if strict:
        return lines.select(F.parse_json("value").alias("value"))
    return lines.select(F.try_parse_json("value").alias("value")).filter("value IS NOT NULL")


def raw_bundle(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle by name; those without a path are empty with their schema."""
    return {name: spark.read.schema(schema).json(paths[name]) if name in paths else spark.createDataFrame([], schema) for name, schema in schemas.items()}


def write_jsonl(df: DataFrame, path: str, most: int = 30_000, sort_keys: bool = False, places: int | None = None) -> None:
    """JSON lines in files of at most ``most`` rows; keys in the order of columns or by name, doubles rounded if asked for."""
    if places is not None:
        df = df.select(*[F.round(n, places).alias(n) if k in ("double", "float") else F.col(n) for n, k in df.dtypes])
    df = df.select(*sorted(df.columns)) if sort_keys else df
    df.write.mode("overwrite").option("maxRecordsPerFile", most).json(path)


def write_graph_csv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges as CSV: arrays joined by semicolons, structs as JSON."""
    from pyspark.sql import types as T

    def flat(df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema}
        return df.select(*[F.array_join(n, ";").alias(n) if isinstance(k, T.ArrayType) else F.to_json(n).alias(n) if isinstance(k, (T.StructType, T.MapType, T.VariantType)) else F.col(n) for n, k in kinds.items()])

    flat(nodes).write.mode("overwrite").option("header", True).csv(f"{path}/nodes")
    flat(edges).write.mode("overwrite").option("header", True).csv(f"{path}/edges")


def markdown_report(rows: DataFrame, key: str, title: str, columns: list[str]) -> DataFrame:
    """A Markdown document for each key: a title and a table of its rows, sorted by the columns."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    body = F.array_join(F.array_sort(F.collect_list(cells)), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit(f"# {title} "), F.first(F.col(key).cast("string")), F.lit(f"\n\n{head}\n"), body).alias("markdown"))
