"""Compression of vectors to codes: product quantisation over distinct integer parts.

Components become integers, and vectors are cut into equal consecutive parts. Equal parts of a position are counted as one
distinct row with a weight. Lloyd's rounds run over the distinct rows: tasks assign each to the nearest entry of its
position's codebook and add weight and weighted components up, so only one row for each entry and component leaves a task, and the
driver holds the codebooks alone. All numbers are integers, so the result doesn't depend on partitions. At the end the distinct
rows' codes and errors are joined back to the vectors; parts that many vectors share are dealt to several tasks.

Nulls: a vector that is null, empty or holds a null or non-finite component is left out. Vectors of another length than the most
frequent one are left out too, since they share no codebook. Parts of a length that doesn't divide are filled up with
zeros. Components beyond LIMIT after scaling count as LIMIT, so that a distance fits a long up to 8,192 dimensions. A null vec_id
comes after all others; of rows that repeat a vec_id, the least vector is a seed. With fewer vec_ids than entries, codebooks are
smaller. Null labels are one label. Repeated rows get a row each, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import Scratch
from packgraph.llm.vectors import common_size, joined_by, whole_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 24
_STRIP = 4096  # distinct parts that are held against the entries at once

Books = np.ndarray  # position, entry, component


def nearest(parts: np.ndarray, positions: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray]:
    """The index of each part's nearest entry, the lower of two, and the squared distance."""
    codes, errors = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), _STRIP):
        some = slice(at, at + _STRIP)
        apart = ((parts[some, None, :] - books[positions[some]]) ** 2).sum(axis=2)
        codes[some] = apart.argmin(axis=1)
        errors[some] = apart.min(axis=1)
    return codes, errors


def _read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    return parts, batch.column(0).to_numpy(zero_copy_only=False)


def _sums(books: Books):
    """For each task: count and summed components of each entry, by place in an array of position, entry, 1 + component."""
    positions, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((positions * entries, 1 + width), np.int64)
        for batch in batches:
            parts, at = _read(batch, width)
            weight = batch.column(2).to_numpy(zero_copy_only=False)[:, None]
            codes, _ = nearest(parts, at, books)
            np.add.at(total, at * entries + codes, np.concatenate((weight, weight * parts), axis=1))
        flat = total.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(flat[used])], ["place", "total"])

    return summed


def _coded(books: Books):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, at = _read(batch, books.shape[2])
            codes, errors = nearest(parts, at, books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes), pa.array(errors)], ["position", "part", "weight", "code", "error"])

    return coded


def lloyd(distinct: DataFrame, books: Books, rounds: int) -> Books:
    """The codebooks after so many rounds; distinct: position, part, weight. An entry that no part is nearest to stays."""
    for _ in range(rounds):
        found = distinct.mapInArrow(_sums(books), "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
        flat = np.zeros(books.shape[0] * books.shape[1] * (1 + books.shape[2]), np.int64)
        flat[[r["place"] for r in found]] = [r["total"] for r in found]
        counts, sums = np.split(flat.reshape(*books.shape[:2], -1), [1], axis=2)
        books = np.where(counts > 0, sums // np.maximum(counts, 1), books)
    return books


def _seeds(rows: DataFrame, entries: int, parts: int) -> Books:
    ids = [r["vec_id"] for r in rows.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    some = rows.filter(F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False)))
    least = some.groupBy("vec_id").agg(F.min("parts").alias("parts")).orderBy(F.asc_nulls_last("vec_id")).collect()
    return np.array([r["parts"] for r in least], np.int64).transpose(1, 0, 2)


def vector_codes(df: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, column: str = "embedding") -> DataFrame:
    """One row for each whole vector of df (vec_id, label and ``column``): vec_id, code (two hex digits for each part), error,
    label_error and codebooks_sha256. At most 256 entries."""
    empty = df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    scratch = Scratch(df.sparkSession, "codes")
    vectors = whole_vectors(df, column)
    size = common_size(vectors)
    if size is None:
        return empty
    width = -(-size // parts)
    whole = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int")
    filled = F.concat(F.transform("vector", whole), F.array_repeat(F.lit(0), parts * width - size))
    cut = F.array(*[F.slice(filled, i * width + 1, width) for i in range(parts)])
    rows = scratch.put("rows", vectors.filter(F.size("vector") == size).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", cut.alias("parts")))
    each = rows.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part")).withColumn("position", F.col("position").cast("long"))
    distinct = scratch.put("distinct", each.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")))
    books = lloyd(distinct, _seeds(rows, entries, parts), rounds)
    coded = scratch.put("coded", distinct.mapInArrow(_coded(books), "position long, part array<int>, weight long, code long, error long"))

    met = joined_by(each, coded, ["position", "part"], "weight", rows.count(), "row")
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: F.lpad(F.lower(F.hex(x["code"])), 2, "0")), "")
    label = F.coalesce(F.col("label").cast("string"), F.lit("null")).alias("label")
    back = scratch.put("back", met.groupBy("row", "vec_id", label).agg(digits.alias("code"), F.sum("error").alias("error")))
    labels = back.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("weight"))
    labels = scratch.put("labels", labels)
    scratch.only(back, labels)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return joined_by(back, labels, ["label"], "weight", back.count(), "row").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, a row for each component."""
    steps = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, embedding AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
component AS MATERIALIZED (
  SELECT r, i // (len(v) // {parts}) AS p, i % (len(v) // {parts}) AS d, CAST(floor({SCALE} * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, v, unnest(range(len(v))) AS i FROM kept)),
seed AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries}),
book0 AS MATERIALIZED (SELECT p, k, d, x AS b FROM component JOIN seed USING (r)),"""
    for i in range(1, rounds + 2):
        steps += f"""
code{i} AS MATERIALIZED (
  SELECT r, p, min(e * {entries} + k) % {entries} AS k, min(e) AS e
  FROM (SELECT r, p, k, CAST(sum((x - b) * (x - b)) AS BIGINT) AS e FROM component JOIN book{i - 1} USING (p, d) GROUP BY r, p, k) GROUP BY r, p),"""
        if i <= rounds:
            steps += f"""
sum{i} AS (SELECT p, k, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM component JOIN code{i} USING (r, p) GROUP BY p, k, d),
book{i} AS MATERIALIZED (SELECT p, k, d, CASE WHEN n IS NULL THEN b ELSE (s - ((s % n) + n) % n) // n END AS b FROM book{i - 1} LEFT JOIN sum{i} USING (p, k, d)),"""
    return (
        steps
        + f"""
back AS (SELECT r, string_agg(lpad(lower(hex(k)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(e) AS BIGINT) AS error FROM code{rounds + 1} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY p, k, d)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN back USING (r) CROSS JOIN digest"""
    )


SQL = _sql()
