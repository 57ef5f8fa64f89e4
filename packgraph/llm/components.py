"""Connected components of an edge table by repeated contraction; nothing but whether edges are left comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import Scratch

AT_ONCE = 100_000  # edges that a task joins before it writes stars


def stars_of(edges: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(vertex, centre) for each vertex but the centres of what these edges connect."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        parent[find(a)] = find(b)
    return ((v, c) for v in list(parent) if (c := find(v)) != v)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's edges connect as stars, so many edges at a time that its memory is bounded."""
    some: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        pairs = list(stars_of(e for batch in some for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        some.clear()
        return pa.RecordBatch.from_arrays([pa.array([v for v, _ in pairs], pa.int64()), pa.array([c for _, c in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        some.append(batch)
        if sum(x.num_rows for x in some) >= AT_ONCE:
            yield flush()
    if some:
        yield flush()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vertex of a task's edges with the root of its component, the roots too."""
    found = dict(stars_of(e for batch in batches for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
    found |= {c: c for c in found.values()}
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["v", "root"])


def components(edges: DataFrame, scratch: Scratch, name: str, few: int = 0) -> DataFrame | None:
    """(v, root) for every vertex of ``edges`` (columns a, b, both long): root is one vertex of v's component. None: no edges.
    As soon as no more than ``few`` edges are left, one task solves them.

    In each round tasks first turn their own edges into stars. Then every vertex moves to the neighbour, or itself, that comes
    first, centres of stars before other vertices and each kind in the round's own random order, and edges are redrawn between
    where their ends moved. Stars that don't touch each other vanish at once; what is spread over tasks shrinks by a
    constant factor, chains as well, so rounds grow with the logarithm of the number of vertices. Each round is written, so a lost
    executor costs no earlier round.
    """
    left = scratch.put(f"{name}-edges-0", edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    turn = 0
    while not left.isEmpty():
        turn += 1
        if few and left.limit(few + 1).count() <= few:
            solved = left.coalesce(1).mapInArrow(_solved, "v long, root long")
            if roots is not None:
                solved = roots.join(solved.select(F.col("v").alias("root"), F.col("root").alias("p")), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
            return scratch.put(f"{name}-roots-{turn}", solved)
        stars = scratch.put(f"{name}-stars-{turn}", left.mapInArrow(_stars, "a long, b long"))
        draw = lambda v, other: F.struct(F.lit(other).alias("other"), F.xxhash64(F.lit(turn), F.col(v)).alias("o"), F.col(v).alias("v"))  # noqa: E731, B023
        ends = stars.select(F.explode(F.array(F.struct(F.col("a").alias("v"), draw("b", 1).alias("to"), F.lit(True).alias("leaf")), F.struct(F.col("b").alias("v"), draw("a", 2).alias("to"), F.lit(False).alias("leaf")))).alias("e")).select("e.*")
        best = ends.groupBy("v").agg(F.min("to").alias("to"), F.min("leaf").alias("leaf"))
        own = F.struct(F.when(F.col("leaf"), 2).otherwise(1).alias("other"), F.xxhash64(F.lit(turn), F.col("v")).alias("o"), F.col("v"))
        moved = scratch.put(f"{name}-moved-{turn}", best.select("v", F.least("to", own)["v"].alias("p")))
        moves = moved.hint("merge") if few else moved  # more than few, and small in a file: not to be broadcast
        to = lambda c: moves.select(F.col("v").alias(c), F.col("p").alias(f"p{c}"))  # noqa: E731, B023
        redrawn = stars.join(to("a"), "a").join(to("b"), "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        if roots is None:
            roots = moved.select("v", F.col("p").alias("root"))
        else:
            step = roots.join(moves.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
            roots = scratch.put(f"{name}-roots-{turn}", step)
            scratch.drop(f"{name}-roots-{turn - 1}")
        left = scratch.put(f"{name}-edges-{turn}", redrawn)
        scratch.drop(f"{name}-edges-{turn - 1}", f"{name}-stars-{turn}")
    return roots
