"""MinHash near-duplicates with SetSketch registers.

A document's set holds its distinct lower-case word shingles; texts with equal sets are one node. Each node has ``setsketch``
registers, 40 bands of 5, and nodes that share a band are candidates: at a similarity of 0.8 a pair shares none with a
probability of 1.3e-7. Of candidates the similarity is estimated from all registers by its likelihood; those over SLACK below the
threshold are left out (a linked pair is with a probability of about 1e-9), and the whole sets decide the others.

Bands go through ``linking``: clusters are contracted between waves, and crowds that are not linked are dealt to the shingles of
a prefix filter (``set_joins``). Nothing is capped.

Nulls: a null text, or one without a word, has an empty set and is linked with nothing: its component is its own doc_id. A text of
fewer words than a shingle is one shingle. A null doc_id comes last in a component; a component without any other has a null
name, and its rows are kept. Rows that repeat a doc_id get a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packgraph.llm.deletion_keys import spread
from packgraph.llm.linking import Wave, link
from packgraph.llm.near_dedup import maybe_alike
from packgraph.llm.scratch import Scratch, mark, plain
from packgraph.llm.set_joins import REFINED, Sets
from packgraph.llm.setsketch import BAND_BYTES, BANDS, registers, similarity
from packgraph.llm.shingles import set_of, shingle_hashes, sketch
from packgraph.llm.vectors import joined_by

WIDTH, PERCENT = 4, 80
SLACK = 20  # hundredths
WAVES = (0, 3, 10, BANDS)  # clusters are contracted by the first bands


def _measured(width: int):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, sizes, regs, sketches = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = set_of(shingle_hashes(text or b"", width))
                same.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                regs.append(registers(hashes).tobytes())
                sketches.append(sketch(hashes))
            made = [pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(regs, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["doc_id", "mark", "same", "n", "registers", "sketch"])

    return measured


def _band_waves(nodes: DataFrame) -> list[Wave]:
    def wave(a: int, b: int) -> Wave:
        band = lambda i: F.struct(F.lit(i).alias("kind"), F.xxhash64(F.substring("registers", i * BAND_BYTES + 1, BAND_BYTES)).alias("key"))
        return lambda roots: spread(nodes.join(roots, "node")).select("node", "root", F.explode(F.array(*[band(i) for i in range(a, b)])).alias("k")).select("node", "root", "k.*")

    return [wave(a, b) for a, b in zip(WAVES, WAVES[1:])]


def _likely(nodes: DataFrame, percent: int):
    """Leaves out pairs whose registers make so high a similarity unlikely."""

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 6))
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (5, 7))
            found = similarity((a > b).sum(axis=1), (a < b).sum(axis=1), n_a, n_b)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["node_a", "node_b", "root_a", "root_b"]).filter(pa.array(100 * found >= percent - SLACK))

    def likely(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(f"node_{x}"), F.col("registers").alias(f"registers_{x}"), F.col("n").alias(f"n_{x}")), f"node_{x}")
        names = ["node_a", "node_b", "root_a", "root_b", "registers_a", "n_a", "registers_b", "n_b"]
        return pairs.select(*names).mapInArrow(estimated, "node_a long, node_b long, root_a long, root_b long")

    return likely


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (the component's own)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = plain(docs, doc_id="long", text="string").select("doc_id", mark().alias("mark"), "text")
    rows = scratch.put("rows", texts.mapInArrow(_measured(width), "doc_id long, mark long, same binary, n long, registers binary, sketch array<long>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("best")
    groups = rows.filter("n > 0").groupBy("same").agg(first, F.count(F.lit(1)).alias("weight"), *[F.any_value(c).alias(c) for c in ("n", "registers", "sketch")])
    nodes = scratch.put("nodes", groups.withColumn("node", F.monotonically_increasing_id()))
    roots = scratch.put("roots", nodes.select("node", F.col("node").alias("root")))
    sets = Sets(texts, nodes.select("best.doc_id", "best.mark", "node"), scratch, width, percent)
    likely = _likely(nodes, percent)
    roots = link(
        roots, _band_waves(nodes.select("node", "registers")), maybe_alike(percent), scratch, nodes.select("node", "sketch", "n"), lambda pairs, name: sets.check(pairs, name, likely),
        refine=sets.refine, levels=REFINED, settles=True, prepare=sets.add, leaders=2,
    )
    placed = scratch.put("placed", nodes.select("same", "weight", "best", "node").join(roots, "node"))
    least = placed.groupBy("root").agg(F.min("best").alias("least"))
    reached = scratch.put("reached", placed.join(least, "root").select("same", "weight", F.col("least.doc_id").alias("component_id")))
    scratch.only(rows, reached)
    met = joined_by(rows.filter("n > 0").select("doc_id", "same", "n"), reached, ["same"], "weight", rows.count(), "doc_id")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = met.select("doc_id", "n", "component_id").unionByName(alone)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Pairs are counted by the shingles that they have in common, and components by what each row reaches.
SQL = r"""
WITH RECURSIVE word AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1 : i + 4], ' '))) END AS s FROM word),
shingle AS MATERIALIZED (SELECT r, n, unnest(s) AS x FROM (SELECT min(r) AS r, len(s) AS n, list_sort(s) AS s FROM shingles GROUP BY list_sort(s), len(s))),
pair AS (SELECT a.r AS a, b.r AS b, a.n + b.n - count(*) AS u, count(*) AS c FROM shingle AS a JOIN shingle AS b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.n, b.n),
link AS MATERIALIZED (SELECT a, b FROM pair WHERE 100 * c >= 80 * u UNION ALL SELECT b, a FROM pair WHERE 100 * c >= 80 * u),
node AS (SELECT r, doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN r ELSE min(r) OVER (PARTITION BY list_sort(s)) END AS v FROM shingles),
reach AS (SELECT DISTINCT v, v AS t FROM node UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.t),
least AS (SELECT reach.v, min(node.doc_id) AS component_id FROM reach JOIN node ON node.v = reach.t GROUP BY reach.v)
SELECT doc_id, n AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM node JOIN least USING (v)"""
