"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits, each set if it is set in over half of the hashes of the text's word shingles. To find all pairs
at distance d or less, fingerprints are cut into d // 2 + 1 segments, so that one segment differs by at most one bit:
either it is equal, or it is equal once that bit is left out. Each fingerprint is indexed under its exact segments and
under every segment with one bit left out; equal keys meet in a join, and the whole distance is verified there.

Equal fingerprints are joined as one. Keys are joined in waves (``linking``), so that no cluster and no crowd under one key
is expanded into its pairs, and no link is lost.

``keep`` can also ask for a similarity of whole texts (``near_dedup``): a link of fingerprints is then only a candidate that
the shingle sets decide, and pairs beyond the reach of the fingerprints are found too.

Nulls: a null text counts as empty, whose fingerprint is zero and linked like any other; a null doc_id keeps its row and
gives a component no name. Repeated rows get the same answer each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packgraph.llm import near_dedup
from packgraph.llm.deletion_keys import linked
from packgraph.llm.scratch import Scratch, mark, only, plain
from packgraph.llm.shingles import fingerprint

WIDTH, DISTANCE = 4, 4


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (the fingerprint as a signed long) of each row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or b"", width) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "mark", "fp"])

    texts = plain(docs, doc_id="long", text="string").select("doc_id", mark().alias("mark"), "text")
    return texts.mapInArrow(made, "doc_id long, mark long, fp long")


def simhash_groups(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as doc_id, mark and fp; and fp, component_id (smallest doc_id that links reach) and best (the row
    of smallest doc_id, null last, as a struct) of each fingerprint."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put("rows", fingerprints(docs, width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best")
    fps = scratch.put("fps", rows.groupBy("fp").agg(least))
    roots = scratch.put("reached-roots", fps.join(linked(fps.select("fp"), scratch, distance), "fp"))
    groups = scratch.put("groups", roots.groupBy("root").agg(F.min("best").alias("best")))
    reached = scratch.put("reached", roots.select("fp", "root").join(groups, "root").select("fp", F.col("best.doc_id").alias("component_id"), "best"))
    scratch.only(rows, reached)
    return rows, reached


def report(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    rows, reached = simhash_groups(docs, width, distance)
    return rows.join(reached, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, percent: int | None = None) -> DataFrame:
    """The row of smallest doc_id of each component, with all its columns. With ``percent``, texts are linked by that similarity
    of their sets of shingles, in hundredths, instead of their fingerprints' distance."""
    if percent is not None:
        return near_dedup.keep(docs, width, distance, percent)
    return only(docs, simhash_groups(docs, width, distance)[1].select("best.doc_id", "best.mark").distinct())
