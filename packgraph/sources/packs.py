"""Packs: ZIP archives of JSONL, JSON and Markdown members, read as tables of lines and documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = 4096  # lines of one batch


def pack_files(spark: SparkSession, path: str) -> DataFrame:
    """pack_id, path, modificationTime and length of ZIP files, one file for each pack id: of a project's before others, then
    the latest, then the last by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    stem = F.regexp_extract("path", r"([^/]+)\.zip$", 1)
    named = files.select(F.element_at(F.split(stem, "__"), -1).alias("pack_id"), F.contains(stem, F.lit("__")).alias("scoped"), "path", "modificationTime", "length")
    place = F.row_number().over(Window.partitionBy("pack_id").orderBy(F.col("scoped").desc(), F.col("modificationTime").desc(), F.col("path").desc()))
    return named.withColumn("p", place).filter("p = 1").drop("p")


def members(spark: SparkSession, path: str) -> DataFrame:
    """path, member, line_no and line of every text member; a document is one line of its own. Archives are read on the
    executors, each as a whole, so a pack should not be much larger than a task's memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "member", "line_no", "line"]
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for member in archive.namelist():
                    if member.endswith((".md", ".json")):
                        text = archive.read(member).decode("utf-8-sig", "replace")
                        yield pa.RecordBatch.from_arrays([pa.array([where]), pa.array([member]), pa.array([1], pa.int64()), pa.array([text])], names)
                    elif member.endswith(".jsonl"):
                        rows: list[tuple[int, str]] = []
                        with archive.open(member) as lines:
                            for n, raw in enumerate(lines, 1):
                                rows.append((n, raw.decode("utf-8-sig" if n == 1 else "utf-8", "replace").rstrip("\r\n")))
                                if len(rows) == LINES:
                                    yield _lines(where, member, rows, names)
                                    rows = []
                        if rows:
                            yield _lines(where, member, rows, names)

    return files.mapInArrow(expand, "path string, member string, line_no long, line string")


def _lines(where: str, member: str, rows: list[tuple[int, str]], names: list[str]) -> pa.RecordBatch:
    numbers, texts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([where] * len(rows)), pa.array([member] * len(rows)), pa.array(numbers, pa.int64()), pa.array(texts)], names)


def records(lines: DataFrame, member: str) -> DataFrame:
    """path, line_no and value (VARIANT) of the well-formed objects of a JSONL member; blank and malformed lines are skipped."""
    parsed = lines.filter(F.col("member") == member).withColumn("value", F.try_parse_json("line"))
    return parsed.filter(F.schema_of_variant("value").startswith("OBJECT")).select("path", "line_no", "value")


def strict_records(lines: DataFrame, member: str) -> DataFrame:
    """As records(), but a line that is neither blank nor an object fails the query, naming member and line."""
    rows = lines.filter((F.col("member") == member) & (F.trim("line") != "")).withColumn("value", F.try_parse_json("line"))
    bad = F.raise_error(F.concat_ws(":", "member", F.col("line_no").cast("string")))
    good = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    return rows.select("path", "line_no", F.try_parse_json(F.when(good, F.col("line")).otherwise(bad)).alias("value"))


def _text(*paths: str):
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get("value", f"$.{p}", "string")), F.lit("")) for p in paths])


def documents(lines: DataFrame) -> DataFrame:
    """path, document and body of Markdown members."""
    return lines.filter(F.col("member").rlike(r"^documents/.*\.md$")).select("path", F.col("member").alias("document"), F.col("line").alias("body"))


def chunks(lines: DataFrame, member: str = "chunks.jsonl") -> DataFrame:
    """Text chunks with their aliases resolved: id, title (or heading, id, a default) and content (or text)."""
    rows = records(lines, member)
    name = _text("chunk_id", "id")
    return rows.select("path", "line_no", F.coalesce(name, F.concat(F.lit(f"{member}#"), F.col("line_no").cast("string"))).alias("chunk_id"), _text("document_id").alias("document_id"), F.coalesce(_text("title", "heading"), name, F.lit("Evidence chunk")).alias("title"), F.coalesce(F.try_variant_get("value", "$.content", "string"), F.try_variant_get("value", "$.text", "string"), F.lit("")).alias("content"), F.try_variant_get("value", "$.metadata", "variant").alias("metadata"))


def nodes(lines: DataFrame, member: str = "graph/nodes.jsonl") -> DataFrame:
    """id, label, type, properties and ord; rows without an id are left out."""
    rows = records(lines, member)
    kind = F.coalesce(F.try_variant_get("value", "$.labels[0]", "string"), _text("type", "properties.type"), F.lit("Element"))
    return rows.select("path", _text("id").alias("id"), F.coalesce(_text("label", "name", "title", "properties.name"), _text("id")).alias("label"), kind.alias("type"), F.coalesce(F.try_variant_get("value", "$.properties", "variant"), F.col("value")).alias("properties"), F.col("line_no").alias("ord")).filter("id IS NOT NULL")


def edges(lines: DataFrame, member: str = "graph/edges.jsonl") -> DataFrame:
    """id, source, target, relation and ord; ends may be strings or objects with an id."""
    rows = records(lines, member)
    return rows.select("path", _text("id").alias("id"), _text("source.id", "source", "from").alias("source"), _text("target.id", "target", "to").alias("target"), F.coalesce(_text("relation", "label", "type"), F.lit("related")).alias("relation"), F.col("line_no").alias("ord")).filter("source IS NOT NULL AND target IS NOT NULL")


def missing_members(lines: DataFrame, required: list[str]) -> DataFrame:
    """path and member of required members that an archive lacks."""
    wanted = lines.select("path").distinct().select("path", F.explode(F.array(*[F.lit(m) for m in required])).alias("member"))
    return wanted.join(lines.select("path", "member").distinct(), ["path", "member"], "left_anti")


def json_member(lines: DataFrame, member: str) -> DataFrame:
    """path and value (VARIANT) of a JSON member; null where it is malformed, which fails nothing."""
    return lines.filter(F.col("member") == member).select("path", F.try_parse_json(F.regexp_replace("line", "^\ufeff", "")).alias("value"))


def line_counts(lines: DataFrame) -> DataFrame:
    """path, member and n: lines that aren't blank."""
    return lines.groupBy("path", "member").agg(F.count_if(F.trim(F.regexp_replace("line", r"[\s\ufeff]", "")) != "").alias("n"))
