"""Objects of an XML model that is one long document, read over many tasks, and the values that an object holds.

Files are cut where a tag ``<Object`` begins, in byte ranges. A piece adds the objects that it opens less those that it closes to the
depth; sums over ranges and within them tell how deep each piece is, so the pieces of each outermost object are brought together
without reading what is before it. Objects inside an object stay part of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.scratch import Scratch

TAG, CLOSING = "<Object", "</Object>"
#: Characters that are written as entities (fixed values); the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def objects(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at (these two in the order of the file), class and text of each object that stands in no other."""
    pieces = spark.read.option("lineSep", TAG).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    within, earlier = Window.partitionBy("file", "block").orderBy("at"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    first = (F.col("block") == 0) & (F.row_number().over(within) == 1)  # what comes before the first tag
    opens = ~first & F.col("value").rlike(r"^[\s/>]")
    closes = F.floor((F.length("value") - F.length(F.replace("value", F.lit(CLOSING), F.lit("")))) / len(CLOSING))
    step = F.col("opens").cast("int") - (F.col("opens") & F.col("value").rlike("^[^>]*/>")).cast("int") - closes
    placed = pieces.withColumn("opens", opens).withColumn("step", step).withColumn("local", F.coalesce(F.sum("step").over(before), F.lit(0)))
    placed = Scratch(spark, "xml").put("pieces", placed)
    blocks = placed.groupBy("file", "block").agg(F.sum("step").alias("step")).select("file", "block", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("start"))
    depth = F.col("start") + F.col("local")
    found = placed.join(blocks, ["file", "block"]).withColumn("depth", depth).withColumn("top", F.col("opens") & (F.col("depth") == 0))
    ends = found.groupBy("file", "block").agg(F.max(F.when(F.col("top"), F.struct("block", "at"))).alias("last")).select("file", "block", F.max("last").over(earlier).alias("carried"))
    own = F.last(F.when(F.col("top"), F.struct("block", "at")), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = found.withColumn("own", own).join(ends, ["file", "block"]).filter(F.col("top") | (F.col("depth") > 0)).withColumn("object", F.coalesce("own", "carried"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    texts = held.groupBy("file", "object").agg(F.concat(F.lit(TAG), F.array_join(F.transform(parts, lambda p: p["value"]), TAG)).alias("text"))
    return texts.select("file", "object.block", "object.at", class_of(F.col("text")).alias("class"), "text")


def class_of(text: Column | str) -> Column:
    return F.regexp_extract(text, r'^<Object\s[^>]*\bclass\s*=\s*"([^"]*)"', 1)


def attribute(text: Column | str, tag: str, name: str) -> Column:
    """An attribute of the first tag of that name; null if it is not there or empty."""
    return F.nullif(F.regexp_extract(F.regexp_extract(text, rf"<{tag}(\s[^>]*)>", 1), rf'\b{name}\s*=\s*"([^"]*)"', 1), F.lit(""))


def text_of(text: Column | str, tag: str) -> Column:
    """The trimmed string of a tag with its entities resolved; null if it is blank."""
    value = attribute(text, tag, "string")
    for code, char in ENTITIES.items():
        value = F.replace(value, F.lit(code), F.lit(char))
    return F.nullif(F.trim(value), F.lit(""))


def whole(text: Column | str, tag: str) -> Column:
    return attribute(text, tag, "long").try_cast("long")


def real(text: Column | str, tag: str) -> Column:
    return attribute(text, tag, "double").try_cast("double")


def inside(text: Column | str, tag: str) -> Column:
    """What stands between a tag and its end."""
    return F.regexp_extract(text, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def reference(text: Column | str, tag: str) -> Column:
    """The id that stands in a tag; null without one."""
    return whole(inside(text, tag), "m_nID")


def references(text: Column | str, prefix: str) -> Column:
    """The ids in the numbered tags prefix_0 up to the number in prefix_SIZE."""
    size = F.coalesce(whole(text, f"{prefix}_SIZE"), F.lit(0))
    tags = F.regexp_extract_all(text, F.lit(rf"(?s)(<{prefix}_([0-9]+)(?:\s[^>]*)?>.*?</{prefix}_\2>)"), F.lit(1))
    made = F.transform(tags, lambda x: F.struct(F.regexp_extract(x, rf"^<{prefix}_([0-9]+)", 1).try_cast("long").alias("i"), whole(x, "m_nID").alias("id")))
    return F.transform(F.filter(made, lambda x: (x["i"] < size) & x["id"].isNotNull()), lambda x: x["id"])


def point(text: Column | str, tag: str) -> Column:
    """x, y and z in a tag; null unless all three are there."""
    part = inside(text, tag)
    x, y, z = (real(part, t) for t in ("m_dfX", "m_dfY", "m_dfZ"))
    return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
