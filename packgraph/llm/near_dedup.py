"""Near-duplicates by the similarity of whole texts: SimHash candidates first, then what SimHash can't reach.

Texts are near copies if their sets of lower-case word shingles have ``percent`` of their union in common or more. Candidates
share a deletion-variant key of their fingerprints at ``distance`` bits, which joins the closest
copies. Texts at 0.8 usually differ in 8 to 14 of 64 bits, out of reach of any key of useful length, so MinHash keys propose
the rest: BANDS keys of ROWS minima each; texts at similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS, 0.99993 at 0.8 and more above. Every
link is decided from the two texts' whole shingle sets (as 64-bit hashes), so keys that meet by chance link nothing.

All candidates go through ``linking``. Its joins leave out what can't be similar: each set has a sketch of bits, of which
each shingle flips one. Two sketches differ in no more bits than the sets differ in shingles, and sets of n shingles together
may differ in n * (100 - percent) / (100 + percent) at most. Crowds under a key that are not linked get the finer keys of ``set_joins``.
Texts are read once more for each wave of keys, for the sets of its candidates.

Nulls: a null text counts as empty, and empty texts are alike; a text of fewer words than a shingle is one shingle. A null
doc_id comes last. Rows that repeat doc_id and text are one node. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm import deletion_keys
from packgraph.llm.linking import Wave, link
from packgraph.llm.scratch import Scratch, mark, only, plain
from packgraph.llm.set_joins import REFINED, Sets
from packgraph.llm.shingles import BANDS, SKETCH, band_keys, fingerprint_of, set_of, shingle_hashes, sketch

WIDTH, PERCENT, DISTANCE = 5, 80, 2
FIRST_MASKS, FIRST_BANDS = 6, 2  # kinds of keys in the first wave


def _measured(width: int):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sketches, sizes = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                parts = list(shingle_hashes(text or b"", width))
                hashes = set_of(iter(parts))
                fps.append(fingerprint_of(iter(parts)))
                keys.append(band_keys(hashes))
                sketches.append(sketch(hashes))
                sizes.append(len(hashes))
            longs = pa.list_(pa.int64())
            made = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, longs), pa.array(sketches, longs), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["doc_id", "mark", "fp", "keys", "sketch", "n"])

    return measured


def _waves(rows: DataFrame, distance: int) -> list[Wave]:
    """A few kinds of keys of either sort first, which contract the clusters, then all others. rows: node, fp, keys."""
    masks = deletion_keys.kinds(distance, True)

    def wave(first: int, last: int, a: int, b: int) -> Wave:
        key = lambda i, c: F.struct(F.lit(i).alias("kind"), c.alias("key"))
        made = [key(i, F.col("fp").bitwiseAND(F.lit(masks[i]).cast("long"))) for i in range(first, last)] + [key(len(masks) + i, F.get("keys", F.lit(i))) for i in range(a, b)]
        return lambda roots: deletion_keys.spread(rows.join(roots, "node")).select("node", "root", F.explode(F.array(*made)).alias("k")).select("node", "root", "k.*")

    return [wave(0, FIRST_MASKS, 0, FIRST_BANDS), wave(FIRST_MASKS, len(masks), FIRST_BANDS, BANDS)]


def unlike(n: int = SKETCH) -> Column:
    """How many bits of two sketches differ."""
    return sum((F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(n)), F.lit(0))


def maybe_alike(percent: int) -> Column:
    """False only for pairs whose sketches show that they are not alike."""
    return unlike() * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def near_copies(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a hash of the text), node and root of each different row; equal roots: linked by near copies."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = plain(docs, doc_id="long", text="string").select("doc_id", mark().alias("mark"), "text")
    made = texts.mapInArrow(_measured(width), "doc_id long, mark long, fp long, keys array<long>, sketch array<long>, n long")
    rows = scratch.put("rows", made.dropDuplicates(["doc_id", "mark"]).withColumn("node", F.monotonically_increasing_id()))
    roots = scratch.put("roots", rows.select("node", F.col("node").alias("root")))
    sets = Sets(texts, rows.select("doc_id", "mark", "node"), scratch, width, percent)
    roots = link(
        roots, _waves(rows.select("node", "fp", "keys"), distance), maybe_alike(percent), scratch, rows.select("node", "sketch", "n"), sets.check,
        refine=sets.refine, levels=REFINED, settles=True, prepare=sets.add, leaders=2,
    )
    reached = scratch.put("reached", rows.select("doc_id", "mark", "node").join(roots, "node"))
    scratch.only(reached)
    return reached


def keep(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, percent: int = PERCENT) -> DataFrame:
    """The row of smallest doc_id of each component, with all its columns."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best")
    return only(docs, near_copies(docs, width, distance, percent).groupBy("root").agg(best).select("best.doc_id", "best.mark").distinct())
