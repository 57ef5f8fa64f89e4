"""Packs as whole units: the members of each shard, a tree of digests over them, what a pack lacks, and whether files are what the
catalogue says.

Digests are of the JSON lines as they are written, so a written pack can be held against its catalogue without knowing its schema.
Rows add up to a member's digest, members to a pack's and packs to the suite's; every step is an aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packgraph.operators import rows as RW
from packgraph.operators.suite import digest, suite

MEMBERS = ("rows", "chunks", "nodes", "edges")


def members(rows: DataFrame, source_file: str, split: str, order: Sequence[str], keys: Sequence[str], most: int = 30_000) -> dict[str, DataFrame]:
    """The members of the packs that rows are cut into, each with a column pack_id: rows as they are, a chunk of evidence for each, and a
    graph in which a pack contains rows and rows have evidence."""
    placed = suite(rows, source_file, split, order, most)
    columns = [c for c in rows.columns if c not in ("pack_id",)]
    name = source_file.removesuffix(".jsonl")
    section = RW.identity([F.col(k) for k in keys], *[F.col(c) for c in columns])
    made = placed.select("pack_id", section.alias("section"), RW.row_text(columns).alias("content"))
    node, pack = F.concat(F.lit(f"{name}:"), "section"), F.concat(F.lit("pack:"), "pack_id")
    chunk = F.concat(F.lit("chunk:"), node)
    nodes = made.select("pack_id", node.alias("id"), F.lit(name).alias("type"), F.col("section").alias("label")).distinct()
    top = made.select("pack_id", pack.alias("id"), F.lit("pack").alias("type"), F.col("pack_id").alias("label")).distinct()
    ends = F.explode(F.array(F.struct(pack.alias("source"), F.lit("contains").alias("relation"), node.alias("target")), F.struct(node.alias("source"), F.lit("has_evidence").alias("relation"), chunk.alias("target"))))
    return {
        "rows": placed.select("pack_id", *columns), "chunks": made.select("pack_id", chunk.alias("chunk_id"), F.col("section").alias("title"), "content"),
        "nodes": nodes.unionByName(top), "edges": made.select("pack_id", ends.alias("e")).select("pack_id", "e.*").distinct(),
    }


def lines(df: DataFrame) -> DataFrame:
    """pack_id and line: each row as the JSON line that ``write`` makes of it."""
    return df.select(F.col("pack_id").cast("string").alias("pack_id"), F.to_json(F.struct(*[c for c in df.columns if c != "pack_id"])).alias("line"))


def _listed(by_member: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, found in by_member.items():
        one = found.groupBy("pack_id").agg(F.count(F.lit(1)).alias("rows"), digest(["line"]).alias("digest")).select("pack_id", F.lit(name).alias("member"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def catalogue(parts: dict[str, DataFrame]) -> DataFrame:
    """pack_id, member, rows and digest of each member of each pack."""
    return _listed({name: lines(df) for name, df in parts.items()})


def _tree(listed: DataFrame, keys: Sequence[str], name: str) -> list[Column]:
    each = F.array_sort(F.collect_list(F.concat_ws(":", name, F.col("rows").cast("string"), "digest")))
    return [F.sum("rows").alias("rows"), F.sha2(F.array_join(each, "\n"), 256).alias("digest")]


def pack_digests(listed: DataFrame) -> DataFrame:
    """pack_id, members, rows and a digest over the members' digests."""
    return listed.groupBy("pack_id").agg(F.count(F.lit(1)).alias("members"), *_tree(listed, ["pack_id"], "member"))


def suite_digest(packs: DataFrame) -> DataFrame:
    """One row over all packs: packs, rows and a digest that adds the packs' up, however many there are."""
    return packs.agg(F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), digest(["pack_id", "digest"]).alias("digest"))


def quality(parts: dict[str, DataFrame]) -> DataFrame:
    """What each pack lacks: rows, empty chunks, nodes that repeat, ends of edges that are neither a node nor a chunk, and whether it is whole."""
    known = parts["nodes"].select("pack_id", "id").unionByName(parts["chunks"].select("pack_id", F.col("chunk_id").alias("id"))).distinct()
    ends = parts["edges"].select("pack_id", F.explode(F.array("source", "target")).alias("id")).distinct()
    n = lambda df, name: df.groupBy("pack_id").agg(F.count(F.lit(1)).alias(name))
    out = n(parts["rows"], "rows")
    for more, name in (
        (parts["chunks"].filter("content IS NULL OR content = ''"), "empty_chunks"), (parts["nodes"].groupBy("pack_id", "id").count().filter("count > 1"), "repeated_nodes"), (ends.join(known, ["pack_id", "id"], "left_anti"), "unknown_ends"),
    ):
        out = out.join(n(more, name), "pack_id", "left").fillna(0, [name])
    return out.withColumn("whole", (F.col("empty_chunks") + F.col("repeated_nodes") + F.col("unknown_ends")) == 0)


def write(parts: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each member and pack, and the catalogue beside them."""
    for name, df in parts.items():
        lines(df).withColumnRenamed("line", "value").write.mode("overwrite").partitionBy("pack_id").text(f"{path}/members/{name}")
    catalogue(parts).write.mode("overwrite").json(f"{path}/catalogue")


def differences(spark: SparkSession, path: str) -> DataFrame:
    """pack_id, member and fault (missing, changed or unlisted) where the written members are not what the catalogue says."""
    said = spark.read.schema("pack_id string, member string, rows long, digest string").json(f"{path}/catalogue")
    found = _listed({name: spark.read.schema("value string, pack_id string").text(f"{path}/members/{name}").select("pack_id", F.col("value").alias("line")) for name in MEMBERS})
    both = said.alias("a").join(found.alias("b"), ["pack_id", "member"], "full")
    fault = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "unlisted").when((F.col("a.digest") != F.col("b.digest")) | (F.col("a.rows") != F.col("b.rows")), "changed")
    return both.select("pack_id", "member", fault.alias("fault")).filter("fault IS NOT NULL")
