"""Links of texts whose sets of word shingles are alike: the sets of candidates, the check of pairs and finer keys for crowds.

Sets are those of 64-bit hashes. Only candidates' sets are made, from their texts, and each is written once.

Finer keys are those of a prefix filter. All sets put their shingles in one order, rare ones first. Two sets of which a share of p
of the union is common have at least o = max(p * larger, 2p / (1 + p) * smaller) shingles in common, so they share one of their
first n - o + 1 each; the smaller set's part is shorter still and is its core. A crowd of texts that only share a template has its own
shingles in the cores, so no core row meets it. A shingle's place follows from counts of 2^18 buckets of shingles: any order
that all sets have in common loses no pair, and a bucket that is used once has no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import Scratch
from packgraph.llm.shingles import shingle_set

FEW_NODES = 1 << 18  # ids and marks that are broadcast, 6 MB; more of them are joined
BUCKET_BITS = 18
REFINED = 2  # levels: one shingle in common, then two
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HASHES = 1 << 20  # that a task counts at once


def at_least(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """Whether sets of a and b shingles with so many in common are alike."""
    return 100 * common >= percent * (a + b - common)


def _mixed(hashes: np.ndarray, key: int) -> np.ndarray:
    x = (hashes ^ np.uint64(key)) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def _buckets(hashes: np.ndarray, key: int) -> np.ndarray:
    return (_mixed(hashes, key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """node, key and hashes of each row."""
    for batch in batches:
        nodes, keys, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, (node, key) in enumerate(zip(nodes, keys)):
            yield node, key % (1 << 64), np.frombuffer(sets[i].as_py(), np.uint64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, some, held = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
    for _, key, hashes in _rows(batches):
        some.append(_buckets(hashes, key))
        held += len(hashes)
        if held >= _HASHES:
            total += np.bincount(np.concatenate(some), minlength=len(total))
            some, held = [], 0
    if some:
        total += np.bincount(np.concatenate(some), minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def prefix(hashes: np.ndarray, key: int, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The first hashes of a set, one of which it shares with each set that is alike, and which of them are its core. A hash equal
    to key is shared by all and left out."""
    n = len(hashes)
    count = counts[_buckets(hashes, key)]
    order = np.lexsort((hashes, count))
    if key:
        order = order[hashes[order] != np.uint64(key)]
    length, core = n + 1 - -(-percent * n // 100), n + 1 - -(-2 * percent * n // (100 + percent))
    order = order[:length]
    used = count[order] > 1
    return hashes[order][used], (np.arange(len(order)) < core)[used]


def _prefixes(counts: np.ndarray, percent: int, kind: int):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, keys, cores, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            node = np.repeat(np.array([n for n, _ in nodes], np.int64), [k for _, k in nodes])
            key, core = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (cores, bool)))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(core)], ["node", "kind", "key", "core"])

        for node, key, hashes in _rows(batches):
            first, core = prefix(hashes, key, counts, percent)
            nodes.append((node, len(first)))
            keys.append(_mixed(first, key) if key else first)
            cores.append(core)
            held += len(first)
            if held >= _HASHES:
                yield flush()
                nodes, keys, cores, held = [], [], [], 0
        if nodes:
            yield flush()

    return prefixes


class Sets:
    """The shingle sets of nodes. texts: doc_id, mark, text; rows: doc_id, mark, node."""

    def __init__(self, texts: DataFrame, rows: DataFrame, scratch: Scratch, width: int, percent: int):
        self.texts, self.rows, self.scratch, self.width, self.percent = texts, rows, scratch, width, percent
        self.parts: list[DataFrame] = []

    def all(self) -> DataFrame:
        """node and shingles (8 bytes each, in order) of all nodes that were asked for."""
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out

    def add(self, placed: DataFrame, name: str) -> None:
        """Makes the sets of the rows' nodes that have none yet, in one pass over the texts."""
        width = self.width

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [shingle_set(t or b"", width).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

        nodes = placed.select("node").distinct()
        for part in self.parts:
            nodes = nodes.join(part.select("node"), "node", "left_anti")
        needed = self.rows.join(nodes, "node").select(F.col("doc_id").alias("own"), F.col("mark").alias("own_mark"), "node")
        needed = self.scratch.put(f"needed-{name}", needed)
        n = needed.count()
        if n or not self.parts:
            same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark"))
            some = self.texts.join(F.broadcast(needed) if n <= FEW_NODES else needed, same).select("node", "text")
            # A text that is in the table twice is needed once.
            self.parts.append(self.scratch.put(f"sets-{name}", some.mapInArrow(made, "node long, shingles binary").dropDuplicates(["node"])))
        self.scratch.drop(f"needed-{name}")

    def check(self, pairs: DataFrame, name: str, likely=None) -> DataFrame | None:
        """root_a, root_b of the pairs whose sets are alike, None if there are no pairs. ``likely(pairs)`` may leave out some of
        them first."""
        percent = self.percent

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = (batch.column(2), batch.column(3))
                near, last, a = [], None, None
                for i in range(batch.num_rows):
                    own = sets[0][i].as_py()
                    if own != last:  # pairs come by one of their nodes
                        last, a = own, np.frombuffer(own, np.uint64)
                    b = np.frombuffer(sets[1][i].as_py(), np.uint64)
                    common = np.isin(b, a, assume_unique=True, kind="sort").sum() if len(b) else 0
                    near.append(bool(at_least(int(common), len(a), len(b), percent)))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["root_a", "root_b"]).filter(pa.array(near, pa.bool_()))

        # One order for each pair, so that a pair that meets under many keys is decided once.
        swap = F.col("node_a") > F.col("node_b")
        at = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c)).alias(c)
        once = pairs.select(at("node_a", "node_b"), at("node_b", "node_a"), at("root_a", "root_b"), at("root_b", "root_a")).dropDuplicates(["node_a", "node_b"])
        once = self.scratch.put(f"pairs-{name}", once if likely is None else likely(once))
        if once.isEmpty():
            self.scratch.drop(f"pairs-{name}")
            return None
        a, b = (self.all().select(F.col("node").alias(f"node_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        both = once.join(a, "node_a").join(b, "node_b").select("root_a", "root_b", F.col("set_b").alias("set_a"), F.col("set_a").alias("set_b"))
        found = self.scratch.put(f"links-{name}", both.mapInArrow(similar, "root_a long, root_b long").distinct())
        self.scratch.drop(f"pairs-{name}")
        return found

    def refine(self, rows: DataFrame, level: int) -> DataFrame:
        """Rows (node, kind, key, core) for the shingles of all rows' prefixes at the first level, then for a second shingle in
        common beside that of the key."""
        nodes = rows.select("node", F.lit(0).cast("long").alias("key") if level == 1 else F.col("key")).distinct()
        crowd = self.scratch.put(f"refined-{level}", nodes.join(self.all(), "node").select("node", "key", "shingles"))
        found = crowd.mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        counts[found["bucket"].to_numpy()] = np.minimum(found["n"].to_numpy(), (1 << 32) - 1)
        return crowd.mapInArrow(_prefixes(counts, self.percent, -level), "node long, kind int, key long, core boolean")
