"""Line deduplication by overlapping windows of three lines.

Each three lines in a row are hashed (two 64-bit hashes). A window that occurs more than once in the whole table stays at
its first place, the smallest doc_id (null last) and line, and is removed elsewhere; removed windows of a text that overlap or
touch are merged, and the text is put together from the lines between the merged spans. Of a window that overlaps its own first place in one text, the lines of that first place stay.

Windows without a word are ignored, and texts of fewer lines have none. Nulls: a null text counts as empty. Rows that agree
in doc_id and text are one document and get the same result. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.llm.scratch import Scratch, plain

LINES = 3


def _texts(docs: DataFrame) -> DataFrame:
    texts = plain(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.withColumn("mark", F.xxhash64("text")).withColumn("lines", F.split("text", "\n"))


def _windows(texts: DataFrame, size: int) -> DataFrame:
    def at(i: Column) -> Column:
        lines = [F.get("lines", i + k) for k in range(size)]
        worded = F.exists(F.slice("lines", i + 1, size), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return F.when(worded, F.struct(i.alias("pos"), F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(size), *lines[::-1]).alias("h2")))

    many = texts.filter(F.size("lines") >= size)
    return many.select("doc_id", "mark", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), at)).alias("w")).filter("w IS NOT NULL").select("doc_id", "mark", "w.*")


def line_dedup(docs: DataFrame, size: int = LINES) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, text (what stays)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    texts = _texts(docs)
    windows = scratch.put("windows", _windows(texts, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "pos")).alias("first")
    # A single place needs no struct minimum: the count alone drops most windows before anything else is kept of them.
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), first).filter("n > 1").select("h1", "h2", "first.doc_id", "first.mark", "first.pos")
    again = scratch.put("again", again.toDF("h1", "h2", "first_id", "first_mark", "first_pos"))
    same_text = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    later = windows.join(again, ["h1", "h2"]).filter(~(same_text & (F.col("pos") == F.col("first_pos"))))
    spans = later.select("doc_id", "mark", F.when(same_text, F.greatest("pos", F.col("first_pos") + size)).otherwise(F.col("pos")).alias("start"), (F.col("pos") + size).alias("stop")).filter("start < stop")
    # Spans that begin behind all ends so far begin a new merged span.
    text_order = Window.partitionBy("doc_id", "mark").orderBy("start", "stop")
    apart = F.coalesce(F.col("start") > F.max("stop").over(text_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    merged = spans.withColumn("apart", apart).withColumn("at", F.sum(F.col("apart").cast("int")).over(text_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("doc_id", "mark", "at").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    gone = merged.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gone"))
    gone = scratch.put("gone", gone.select(F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("none"), F.col("mark").alias("mark0"), "gone"))
    keyed = texts.select("doc_id", "mark", "text", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("none"), F.col("mark").alias("mark0"))
    # The spans have no proven bound: the same merge join at every size, rather than a broadcast while they are few.
    out = keyed.join(gone.hint("merge"), ["id0", "none", "mark0"], "left").withColumn("lines", F.split("text", "\n"))
    # What stays: from each span's stop to the next one's start.
    ends = F.concat(F.col("gone.start"), F.array(F.size("lines")))
    left = F.flatten(F.zip_with(F.concat(F.array(F.lit(0)), F.col("gone.stop")), ends, lambda x, y: F.slice("lines", x + 1, y - x)))
    n_gone = F.aggregate("gone", F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    return out.select("doc_id", F.size("lines").alias("n_lines"), F.coalesce(n_gone, F.lit(0)).alias("n_removed"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))


def report(docs: DataFrame, size: int = LINES) -> DataFrame:
    found = line_dedup(docs, size)
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM p),
f AS (SELECT *, first_value(doc_id) OVER o AS fid, first_value(pos) OVER o AS fpos FROM w
      WHERE regexp_matches(win, '[^\x20\x09-\x0D]') WINDOW o AS (PARTITION BY win ORDER BY doc_id, pos)),
s AS (SELECT doc_id, CASE WHEN doc_id = fid THEN greatest(pos, fpos + 3) ELSE pos END AS a, pos + 3 AS b
      FROM f WHERE NOT (doc_id = fid AND pos = fpos)),
c AS (SELECT doc_id, list(DISTINCT line) AS gone FROM (SELECT doc_id, unnest(range(a, b)) AS line FROM s WHERE a < b) GROUP BY doc_id),
k AS (SELECT l.doc_id, ls, coalesce(gone, []) AS gone FROM l LEFT JOIN c USING (doc_id)),
t AS (SELECT doc_id, len(ls) AS n_lines, len(gone) AS n_removed,
             array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) AS text FROM k)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM t
"""
