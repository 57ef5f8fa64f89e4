"""Whitening of embeddings from the upper triangle of their covariance.

Components become integers. One aggregation gives counts, sums and ranges, and one more, of an SQL expression generated for each
pair of dimensions, sums the products of components that were centred by the whole part of their mean; the rest of the mean, under 1,
is taken off afterwards. All of these sums are integers, so the covariance is exact and doesn't depend on partitions. LAPACK
decomposes it on the driver, and tasks project their rows. The same generated expressions over the whitened columns give the
covariance that the result really has.

Nulls: a vector that is null, empty or holds a null or non-finite component is left out, and so are vectors of another length
than the most frequent one. Components beyond LIMIT count as LIMIT. A null vec_id is a value like any other, repeated rows count each
and get rows each. A component without variance has explained 0 and whitened null; the identity is checked on the others, and
is null if there are none. ``deviation`` is null if it doesn't fit a long. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import Scratch
from packgraph.llm.vectors import common_size, whole_vectors

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LIMIT = 1 << 20
AT_ONCE = 4096  # pairs of an aggregation; 90 dimensions make as many
_LONG = 1 << 63


def pair_sums(rows: DataFrame, centres: dict[str, int | float], exact: str | None = None) -> dict[tuple[str, str], int | float]:
    """For each pair of columns the sum of the products of what they are apart from their centres; exact: a type for products."""
    centred = rows.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in centres.items()])
    pairs = list(combinations_with_replacement(centres, 2))
    found: dict[tuple[str, str], int | float] = {}
    for at in range(0, len(pairs), AT_ONCE):
        some = pairs[at : at + AT_ONCE]
        product = lambda a, b: F.expr(f"sum(cast({a} AS {exact}) * {b})" if exact else f"sum({a} * {b})")
        got = centred.agg(*[product(a, b).alias(f"s{i}") for i, (a, b) in enumerate(some)]).first()
        found |= {pair: got[f"s{i}"] for i, pair in enumerate(some)}
    return found


def covariance(rows: DataFrame, names: list[str]) -> tuple[int, list[int], np.ndarray, int]:
    """n, the sums, the covariance with divisor n, and a bound on how far n * x is from a sum; all columns are longs."""
    parts = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")).alias(f"s_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))
    first = rows.agg(F.count(F.lit(1)).alias("n"), *[x for c in names for x in parts(c)]).first()
    n, sums = first["n"], [int(first[f"s_{c}"] or 0) for c in names]
    if not n:
        return 0, sums, np.zeros((len(names), len(names))), 0
    centres = {c: s // n for c, s in zip(names, sums)}
    most = max(max(first[f"hi_{c}"] - m, m - first[f"lo_{c}"]) for c, m in centres.items())
    found = pair_sums(rows, centres, None if n * most * most < _LONG else "decimal(20,0)")
    left = {c: s - n * centres[c] for c, s in zip(names, sums)}  # n times what the centre is short of the mean
    matrix = np.zeros((len(names), len(names)))
    for (a, b), total in found.items():
        i, j = names.index(a), names.index(b)
        matrix[i, j] = matrix[j, i] = (n * int(total) - left[a] * left[b]) / (n * n)  # of integers: rounded once
    return n, sums, matrix, max(max(abs(n * first[f"hi_{c}"] - s), abs(n * first[f"lo_{c}"] - s)) for c, s in zip(names, sums))


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues, 0 if there is no variance but rounding, and their unit vectors as columns; of both signs, the
    one whose greatest entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    values = np.where(values > max(values[0], 0) * len(matrix) * np.finfo(float).eps, values, 0.0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def _projected(n: int, sums: list[int], most: int, values: np.ndarray, vectors: np.ndarray):
    mean = np.array([s / n for s in sums])
    scaled = vectors / np.sqrt(np.where(values > 0, values, 1.0))
    fits = len(sums) * most * most < _LONG  # a bound on the deviations decides the type of their numbers, not their values

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(np.int64)
            off = (n if fits else np.array(n, object)) * x - np.array(sums, np.int64 if fits else object)
            deviation = [int(d) if d < _LONG else None for d in (off * off).sum(axis=1)]
            white = (x - mean) @ scaled
            columns = [pa.array(white[:, i]) if values[i] > 0 else pa.nulls(len(x), pa.float64()) for i in range(len(values))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), *columns], ["vec_id", "deviation", *[f"w{i}" for i in range(len(values))]])

    return projected


def _identity_error(white: DataFrame, names: list[str], n: int) -> float | None:
    if not names:
        return None
    means = white.agg(*[F.avg(c).alias(c) for c in names]).first().asDict()
    return max(abs(s / n - (a == b)) for (a, b), s in pair_sums(white, means).items())


def whitened(df: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, column: str = "embedding") -> DataFrame:
    """One row for each whole vector of df (vec_id and ``column``) and component from 1 to k: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    empty = df.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    scratch = Scratch(df.sparkSession, "whitening")
    vectors = whole_vectors(df, column)
    size = common_size(vectors)
    if size is None:
        return empty
    names = [f"x{i}" for i in range(size)]
    whole = lambda x: F.floor(F.least(F.greatest(x, F.lit(float(-LIMIT))), F.lit(float(LIMIT))) * scale) + shift
    rows = vectors.filter(F.size("vector") == size).select("vec_id", *[whole(F.get("vector", F.lit(i))).alias(c) for i, c in enumerate(names)])
    rows = scratch.put("rows", rows)
    n, sums, matrix, most = covariance(rows, names)
    values, directions = components(matrix, min(k, size))
    whites = [f"w{i}" for i in range(len(values))]
    schema = ", ".join(["vec_id long", "deviation long", *[f"{w} double" for w in whites]])
    white = scratch.put("white", rows.mapInArrow(_projected(n, sums, most, values, directions), schema))
    error = _identity_error(white, [w for w, e in zip(whites, values) if e > 0], n)
    scratch.only(white)
    trace = float(np.trace(matrix))
    share = [float(e) / trace if trace > 0 else 0.0 for e in values]
    each: Column = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col(w).alias("whitened"), F.lit(share[i]).alias("explained")) for i, w in enumerate(whites)]))
    found = white.select("vec_id", "deviation", each.alias("c"))
    return found.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
