"""IFC STEP text: instances, arguments, references and decoded strings, in DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: An instance, one argument at the top level of a list, and a reference (fixed values).
INSTANCE = r"(?s)^\s*#([0-9]+)\s*=\s*([A-Z0-9_]+)\s*\((.*)\)\s*$"
BARE = r"^#[0-9]{1,18}=[A-Z0-9_]+\("
DEPTH = 8  # of nested lists
_nested = r"\((?:[^()']++|'[^']*+')*+\)"
for _ in range(DEPTH - 1):
    _nested = rf"\((?:[^()']++|'[^']*+'|{_nested})*+\)"
ARGUMENT = rf"((?:'[^']*+'|{_nested}|[^,'()]++)++)(?:,|$)"
REFERENCE = r"#([0-9]+)"
WRAPPED = r"^[A-Z0-9_]+\('[^'\\\r\n\u0085\u2028\u2029]*'\)$"  # one string of one type, in which nothing is to be decoded


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, within its block of a file: whether the quotes before it are odd, whether its own are, and how many statements
    have ended before it if the block begins outside quotes, or inside."""
    block, before, ends = None, 0, [0, 0]
    for batch in batches:
        own = pc.count_substring(batch.column(0), "'").to_numpy(zero_copy_only=False).astype(np.int64) % 2
        keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        odd, counts = np.zeros(len(keys), np.int64), np.zeros((2, len(keys)), np.int64)
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if keys[a] != block:
                block, before, ends = keys[a], 0, [0, 0]
            after = (before + np.cumsum(own[a:b])) % 2
            odd[a:b] = np.concatenate(([before], after[:-1]))
            for start in (0, 1):
                done = np.cumsum(after == start)
                counts[start, a:b] = ends[start] + np.concatenate(([0], done[:-1]))
                ends[start] += int(done[-1])
            before = int(after[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd), pa.array(own), pa.array(counts[0]), pa.array(counts[1])], ["value", "file", "block", "at", "before", "own", "ends_0", "ends_1"])


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file and text of each statement, up to a semicolon outside quotes; lines and their ends don't matter.

    Files are read in byte ranges, cut at semicolons. A range doesn't know whether it begins inside a string, so it counts for
    both cases; the quotes of the ranges before it decide. Only pieces of strings that hold semicolons are brought together.
    """
    read = spark.read.option("lineSep", ";").text(path)
    pieces = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    states = pieces.mapInArrow(_states, "value string, file string, block long, at long, before long, own long, ends_0 long, ends_1 long")
    after = F.pmod(F.col("before") + F.col("own"), F.lit(2))
    blocks = states.groupBy("file", "block").agg(F.sum("own").alias("quotes"), F.count_if(after == 0).alias("n_0"), F.count_if(after == 1).alias("n_1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not pieces
    blocks = blocks.withColumn("start", F.pmod(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.lit(2)))
    n = F.when(F.col("start") == 0, F.col("n_0")).otherwise(F.col("n_1"))
    blocks = blocks.withColumn("first", F.coalesce(F.sum(n).over(earlier), F.lit(0))).select("file", "block", "start", "first")
    placed = states.join(blocks, ["file", "block"])
    number = F.col("first") + F.when(F.col("start") == 0, F.col("ends_0")).otherwise(F.col("ends_1"))
    inside = F.pmod(F.col("start") + F.col("before"), F.lit(2)) + F.col("own") > 0
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    cut = placed.filter(inside).groupBy("file", number.alias("number")).agg(F.array_join(F.transform(parts, lambda p: p["value"]), ";").alias("text"))
    return placed.filter(~inside).select("file", F.col("value").alias("text")).unionByName(cut.select("file", "text"))


def parsed(statements: DataFrame) -> DataFrame:
    """id, type, args (strings, nested lists as they are) and refs of the statements (column text) that are instances.

    Statements as they are usually written, without blanks around their parts, are cut at fixed signs, which costs a fraction of a match.
    """
    text = F.col("text")
    one = F.when(F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r")), F.regexp_replace(text, r"[\r\n]+", " ")).otherwise(text)
    line, part = F.col("line"), lambda i: F.regexp_extract("line", INSTANCE, i)
    usual = F.when(line.rlike(BARE) & F.endswith(line, F.lit(")")), F.array(F.split(line, "[=(]", 3)))
    cut = usual.when(line.rlike(INSTANCE), F.array(F.array(F.concat(F.lit("#"), part(1)), part(2), F.concat(part(3), F.lit(")")))))
    # Exploded, so that each statement is looked at once: a filter would be evaluated apart from the columns.
    rows = statements.select(F.trim(one).alias("line")).select(F.explode(cut).alias("cut"))
    rows = rows.select(F.substring(F.col("cut")[0], 2, 1 << 30).cast("long").alias("id"), F.col("cut")[1].alias("type"), F.substr(F.col("cut")[2], F.lit(1), F.length(F.col("cut")[2]) - 1).alias("raw"))
    raw = F.col("raw")
    found = F.regexp_extract_all(raw, F.lit(ARGUMENT), F.lit(1))
    return rows.select("id", "type", F.when(F.contains(raw, F.lit(" ")), F.transform(found, lambda x: F.trim(x))).otherwise(found).alias("args"), references(F.regexp_replace(raw, r"'[^']*+'", "")).alias("refs"))


def instances(spark: SparkSession, path: str) -> DataFrame:
    """id, type, args and refs of each instance of STEP files, over however many lines it goes and over many tasks."""
    return parsed(statements(spark, path))


def decoded(text: Column) -> Column:
    """A quoted string with doubled quotes and ``\\X2\\hex\\X0\\`` runs (UTF-16, big-endian) resolved; most have no runs."""
    unquoted = lambda x: F.replace(x, F.lit("''"), F.lit("'"))
    pieces = F.regexp_extract_all(unquoted(F.regexp_replace(text, r"^'|'$", "")), F.lit(r"(\\X2\\[0-9A-Fa-f]+\\X0\\|[^\\]+|\\)"), F.lit(1))
    hexed = lambda x: F.decode(F.unhex(F.regexp_extract(x, r"^\\X2\\([0-9A-Fa-f]+)\\X0\\$", 1)), "UTF-16BE")
    runs = F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^\\X2\\[0-9A-Fa-f]+\\X0\\$"), hexed(x)).otherwise(x)), "")
    plain = F.startswith(text, F.lit("'")) & F.endswith(text, F.lit("'")) & (F.length(text) > 1) & ~F.contains(text, F.lit("\\"))
    return F.when(plain, unquoted(F.substr(text, F.lit(2), F.length(text) - 2))).otherwise(runs)


def scalar(text: Column) -> Column:
    """A STEP value as text: null for ``$``, true and false for ``.T.`` and ``.F.``, typed wrappers taken off, strings decoded."""
    bare = F.regexp_replace(text, r"^(?:[A-Z0-9_]+\()+(.*?)\)+$", "$1")
    of = lambda x, other: F.when(F.startswith(x, F.lit("'")), decoded(x)).when(x.isin("$", "*"), F.lit(None)).when(x == ".T.", "true").when(x == ".F.", "false").otherwise(other)
    at = F.instr(text, "(")
    wrapped = F.when(text.rlike(WRAPPED) & F.endswith(text, F.lit(")")), F.substr(text, at + 2, F.length(text) - at - 3))
    return of(text, wrapped.when(text.rlike(r"^[A-Z0-9_]+\("), of(bare, bare)).otherwise(text))


def arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def references(c: Column) -> Column:
    """The ids of a list of references."""
    return F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)).cast("array<bigint>")


def reference(c: Column) -> Column:
    """The first id that is referred to."""
    return F.regexp_extract(c, REFERENCE, 1).try_cast("long")


def set_values(rows: DataFrame) -> DataFrame:
    """set_id, pset, key and value of the single values in IfcPropertySet instances."""
    single = rows.filter("type = 'IFCPROPERTYSINGLEVALUE'").select(F.col("id").alias("prop"), scalar(arg(0)).alias("key"), scalar(arg(2)).alias("value"))
    sets = rows.filter("type = 'IFCPROPERTYSET'").select(F.col("id").alias("set_id"), scalar(arg(2)).alias("pset"), F.explode(references(arg(4))).alias("prop"))
    return sets.join(single, "prop").select("set_id", "pset", "key", "value")


def set_links(rows: DataFrame) -> DataFrame:
    """element and set_id of IfcRelDefinesByProperties instances."""
    return rows.filter("type = 'IFCRELDEFINESBYPROPERTIES'").select(F.explode(references(arg(4))).alias("element"), reference(arg(5)).alias("set_id"))


def property_sets(rows: DataFrame) -> DataFrame:
    """element, pset, key and value of IfcRelDefinesByProperties, IfcPropertySet and IfcPropertySingleValue."""
    return set_links(rows).join(set_values(rows), "set_id").select("element", "pset", "key", "value")
