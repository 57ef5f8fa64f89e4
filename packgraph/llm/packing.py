"""Packing into length buckets whose boundaries minimise padding over the whole corpus.

A global histogram of lengths is made by one aggregation, and dynamic programming over it places the boundaries so that
rounding every length up to its bucket's boundary adds the fewest tokens. Documents of a bucket then fill batches of as
many rows as fit the token budget at the bucket's boundary.

Histogram cells are single lengths up to ``cells`` and cells / 2 to each doubling beyond, so the driver gets a bounded table
for texts of any length; each cell keeps its count, sum and greatest length, and boundaries are greatest lengths of cells.
Up to ``cells`` (65,536) the optimum is over all lengths, beyond over the cells, which are at most 1/32,768 of their length wide: the
padding of a longer document is at most that much more than with the exact optimum. Padding is counted exactly everywhere.

Lengths are byte-level tokens, the UTF-8 bytes of the text and one end token, or those of a column that is named. Nulls: a
null text counts as empty, a null or negative length as 0; a null doc_id is a value like any other. A document longer than the
budget is a batch of its own. Repeated rows get places of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import Scratch, numbered, plain

BUCKETS, BUDGET, CELLS = 16, 1 << 18, 1 << 16


def cell(length: Column, cells: int = CELLS) -> Column:
    """The number of a length's histogram cell; rises with the length."""
    wide = F.greatest(F.length(F.bin(length)) - F.lit(cells.bit_length() - 1), F.lit(0))  # low bits that a cell leaves out
    return F.call_function("shiftright", length, wide) + wide.cast("long") * (cells // 2)


def boundaries(histogram: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """The upper ends, at most ``buckets`` of them, that minimise padding; histogram: (greatest length, count, sum of
    lengths) of each cell, by rising length. Of equal optima, the one with the fewest buckets.

    best[k][j] = min over i < j of best[k - 1][i] + top[j] * (count[j] - count[i]) - (sum[j] - sum[i]), where counts and
    sums are running totals. For a fixed j that is the least of lines with falling slopes -count[i] at top[j], which rises
    with j; the lower envelope gives every minimum in one sweep. All numbers are integers.
    """
    tops, counts, sums = [0], [0], [0]
    for top, count, total in histogram:
        tops.append(top)
        counts.append(counts[-1] + count)
        sums.append(sums[-1] + total)
    n = len(tops) - 1
    if not n:
        return []
    best: list[list[int | None]] = [[0] + [None] * n]
    came: list[list[int]] = [[0] * (n + 1)]
    for k in range(1, min(buckets, n) + 1):
        row, back, hull, at = [None] * (n + 1), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[k - 1][i] is not None:
                line = (-counts[i], best[k - 1][i] + sums[i], i)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            value = lambda h: h[0] * tops[j] + h[1]  # noqa: E731, B023
            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            row[j], back[j] = value(hull[at]) + tops[j] * counts[j] - sums[j], hull[at][2]
        best.append(row)
        came.append(back)
    k = min((k for k in range(1, len(best)) if best[k][n] is not None), key=lambda k: (best[k][n], k))
    out, j = [], n
    while j:
        out.append(tops[j])
        j, k = came[k][j], k - 1
    return out[::-1]


def packed(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, cells: int = CELLS, length: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, bucket, padded_tokens (the bucket's boundary), batch (from 0 in each
    bucket) and place (from 0 in each batch). ``length``: a column with the number of tokens, such as byte_bpe's n_tokens."""
    if length is None:
        sized = plain(docs, doc_id="long", text="string").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("n_tokens"))
    else:
        sized = plain(docs, doc_id="long", **{length: "long"}).select("doc_id", F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"))
    scratch = Scratch(docs.sparkSession, "packing")
    lengths = scratch.put("lengths", sized)
    found = lengths.groupBy(cell(F.col("n_tokens"), cells).alias("cell")).agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"))
    ends = boundaries([(r["top"], r["n"], r["total"]) for r in sorted(found.collect(), key=lambda r: r["cell"])], buckets)
    bucket = sum([(F.col("n_tokens") > end).cast("int") for end in ends[:-1]], F.lit(0))
    table = F.array(*[F.lit(end).cast("long") for end in ends or [0]])
    placed = lengths.withColumn("bucket", bucket).withColumn("padded_tokens", F.get(table, F.col("bucket")))
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("padded_tokens", F.lit(1))))
    slots = numbered(placed, ["bucket"], ["doc_id", "n_tokens"], "slot", scratch)
    return slots.select("doc_id", "n_tokens", "bucket", "padded_tokens", F.floor(F.col("slot") / rows).alias("batch"), (F.col("slot") % rows).alias("place"))
