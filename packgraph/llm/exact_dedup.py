"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg), in DataFrame operations only.

The UTF-8 bytes of a normalised text are cut into blocks of a fixed size. Sorting the distinct blocks gives each an
integer name; then adjacent names are paired, the distinct pairs sorted and named, and so on until each text has one
name. Two texts of as many blocks have the same last name exactly when they are equal. A 64-bit hash only speeds up
finding a block's name; blocks whose hash is shared with another block are looked up by their bytes, so it decides nothing.

Nulls: a null text counts as empty; a null doc_id is kept as it is and comes after all others among ties. Equal rows
(same doc_id and text) are separate members of their group, of which one is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import Scratch, mark, only, plain

#: ASCII white space, which does not count when texts are compared (fixed values).
SPACE = " \t\n\x0b\f\r"
BLOCK_BYTES = 1024


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for ch in SPACE:  # byte search for one character at a time is several times faster than a pattern here
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def _named(scratch: Scratch, name: str, values: DataFrame, key: list[str]) -> DataFrame:
    """An integer for each distinct value of the key columns: values are dealt out by hash once, after each task has
    dropped its own repeats, and sorted; number of the partition and place in it make the name. Written, so names stay."""
    return scratch.put(name, values.select(*key).distinct().sortWithinPartitions(*key).withColumn("name", F.monotonically_increasing_id()))


def _block_names(scratch: Scratch, blocks: DataFrame) -> DataFrame:
    """rid, n_blocks, pos and name of each block."""
    names = _named(scratch, "names-0", blocks, ["h", "block"])
    at = blocks.select("rid", "n_blocks", "pos", "h")
    shared = names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    if shared.isEmpty():
        return at.join(names.select("h", "name"), "h").drop("h")
    alone = at.join(names.select("h", "name").join(shared, "h", "left_anti"), "h").drop("h")
    by_bytes = blocks.select("rid", "n_blocks", "pos", "h", "block").join(names.join(shared, "h", "left_semi"), ["h", "block"])
    return alone.unionByName(by_bytes.select("rid", "n_blocks", "pos", "name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, lookup=F.xxhash64, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs: rid, doc_id, mark, n_points (code points), text_sha256, n_blocks and name; (n_blocks, name) is
    the identity of the normalised text."""
    scratch = scratch or Scratch(docs.sparkSession, "exact-dedup")
    texts = (
        plain(docs, doc_id="long", text="string")
        .withColumn("rid", F.monotonically_increasing_id())
        .withColumn("norm", normalised(F.col("text")).cast("binary"))
        .withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.length("norm") / F.lit(block_bytes)).cast("int")))
    )
    row = F.struct("doc_id", mark().alias("mark"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"), F.sha2("norm", 256).alias("text_sha256"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda i: F.substring(F.col("norm"), i * block_bytes + 1, F.lit(block_bytes)))
    # The only pass over the texts. Bytes are sliced, so the work is linear in a text's length.
    blocks = texts.select("rid", "n_blocks", row.alias("row"), F.posexplode(cut).alias("pos", "block"))
    blocks = scratch.put("blocks", blocks.select("rid", "n_blocks", "pos", lookup("block").alias("h"), "block", F.when(F.col("pos") == 0, F.col("row")).alias("row")))
    rows = blocks.filter("pos = 0").select("rid", "row.*", "n_blocks")
    longest = blocks.agg(F.max("n_blocks")).first()[0] or 1

    level = scratch.put("level-0", _block_names(scratch, blocks))
    finished = level.filter("n_blocks = 1").select("rid", "name")
    depth, width = 0, 1
    while width < longest:
        depth, width = depth + 1, width * 2
        half = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = level.filter(F.col("n_blocks") > width // 2).groupBy("rid", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        pairs = scratch.put(f"pairs-{depth}", pairs.agg(half(0).alias("left"), F.coalesce(half(1), F.lit(-1)).alias("right")))
        names = _named(scratch, f"names-{depth}", pairs, ["left", "right"])
        level = scratch.put(f"level-{depth}", pairs.join(names, ["left", "right"]).select("rid", "n_blocks", "pos", "name"))
        scratch.drop(f"pairs-{depth}")
        finished = finished.unionByName(level.filter((F.col("n_blocks") > width // 2) & (F.col("n_blocks") <= width)).select("rid", "name"))
    return rows.join(finished, "rid")


def _groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """n_blocks, name, group_size and best (the row that stays) of each group; written, so that a large group's rows can
    meet it in several tasks."""
    best = F.min(F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "mark"))
    return scratch.put("groups", rows.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")))


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points stays, then the smallest doc_id (null last), then the
    first read of rows equal in both.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = identities(docs, block_bytes, scratch=scratch)
    groups = _groups(rows, scratch).select("n_blocks", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    return rows.join(groups, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")


def keep(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The row that stays of each group, with all its columns."""
    scratch = Scratch(docs.sparkSession, "exact-keep")
    return only(docs, _groups(identities(docs, block_bytes, scratch=scratch), scratch).select("best.doc_id", "best.mark"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""
