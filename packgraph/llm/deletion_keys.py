"""Deletion-variant keys of 64-bit fingerprints, and the links that they find."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm.linking import Wave, link
from packgraph.llm.scratch import Scratch

FIRST, SECOND = 8, 32  # kinds of keys in the first and second wave


def segments(distance: int, bits: int = 64) -> list[tuple[int, int]]:
    """First bit and length of each segment. For an even distance the last has no variants, so it is twice as long."""
    n = distance // 2 + 1
    short = bits // (n + (distance % 2 == 0 and n > 1))
    edges = [short * i for i in range(n)] + [bits]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def masks(distance: int, bits: int = 64, enough: int = 32) -> list[int]:
    """One mask for each kind of key: which bits of a fingerprint the key holds, as signed longs.

    If no segment is equal, each differs; at most ``distance`` bits over distance // 2 + 1 segments then leave at least two
    segments (one, for an odd distance) with exactly one bit, so for an even distance the last needs no variants.

    A segment alone makes short keys, under which ever more fingerprints meet by chance as a corpus grows. The bits outside
    it differ in no more places than are left, so of one block more than that one is equal: keys of under ``enough`` bits
    take one such block along.
    """

    def extended(mask: int, segment: int, left: int) -> list[int]:
        if mask.bit_count() >= enough:
            return [mask]
        rest = [i for i in range(bits) if not segment >> i & 1]
        edges = [len(rest) * i // (left + 1) for i in range(left + 2)]
        return [mask | sum(1 << i for i in rest[x:y]) for x, y in zip(edges, edges[1:])]

    cut = segments(distance, bits)
    out = []
    for k, (a, n) in enumerate(cut):
        whole = ((1 << n) - 1) << a
        out += extended(whole, whole, distance)
        if distance and (distance % 2 or k < len(cut) - 1):
            for i in range(a, a + n):
                out += extended(whole & ~(1 << i), whole, distance - 1)
    return [m - (1 << bits) if m >> (bits - 1) else m for m in out]


def apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all shuffle partitions: each becomes as many as there are kinds of keys, so it takes more tasks than small rows
    get by themselves. By a hash of the node, since dealing out by the node itself is left out after a join on it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("node"))


def _table(masks: list[int], first: int = 0) -> Column:
    return F.array(*[F.struct(F.lit(first + i).alias("kind"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)])


def kinds(distance: int, equal: bool = False) -> list[int]:
    """The masks in a fixed shuffled order. ``equal``: fingerprints may repeat, so the first kind is the whole of one."""
    found = masks(distance)
    return [-1] * equal + [found[i] for i in np.random.default_rng(distance).permutation(len(found))]


def waves(distance: int, sizes: tuple[int, ...] = (FIRST, SECOND)) -> list[Wave]:
    """The kinds of keys, few of them in the first waves."""
    found = kinds(distance)

    def wave(a: int, b: int) -> Wave:
        def index(rows: DataFrame) -> DataFrame:
            return spread(rows).select("*", F.explode(_table(found[a:b], a)).alias("k")).select("node", "root", "k.kind", F.col("node").bitwiseAND(F.col("k.mask")).alias("key"))

        return index

    edges = [min(sum(sizes[:i]), len(found)) for i in range(len(sizes) + 1)] + [len(found)]
    return [wave(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def refiner(distance: int, fp: str = "node"):
    """Deals the rows of a key to distance + 1 finer ones. Each level cuts all bits into as many blocks, in another random
    way; of two fingerprints that differ in at most ``distance`` bits, one block is equal."""

    def refine(rows: DataFrame, level: int) -> DataFrame:
        bits = np.random.default_rng(1000 + level).permutation(64)
        blocks = [sum(1 << int(b) for b in x) for x in np.array_split(bits, distance + 1)]
        table = _table([m - (1 << 64) if m >> 63 else m for m in blocks])
        dealt = rows.select("*", F.explode(table).alias("k"))
        return dealt.select("node", (F.col("kind") * (distance + 1) + F.col("k.kind")).alias("kind"), F.xxhash64("key", F.col(fp).bitwiseAND(F.col("k.mask"))).alias("key"))

    return refine


def linked(fps: DataFrame, scratch: Scratch, distance: int = 4) -> DataFrame:
    """(fp, root) of every fingerprint; fps: distinct fingerprints in a column fp. Equal roots: linked."""
    roots = scratch.put("roots", fps.select(F.col("fp").alias("node"), F.col("fp").alias("root")))
    found = link(roots, waves(distance), apart("node_a", "node_b") <= distance, scratch, refine=refiner(distance))
    return found.select(F.col("node").alias("fp"), "root")
