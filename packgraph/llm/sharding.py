"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends from the root: at each level every child draws, for the row's key, a waiting time that is exponential at a
rate of the child's summed weight, and the least time wins. Draws depend on the key and the child's name only. Where a
child's weight grows, only its own times get shorter, so rows enter its subtree and none moves between the others; where it
falls, rows only leave it. Below an unchanged node nothing changes at all.

Rows that enter a subtree descend in it like all others, to any of its shards. So growth opens a subtree of its own: a tree
is built with some number of shards, and each further shard is a region of its own, which alone takes rows. The key, the
number of shards built with and the number of shards now decide, so one law holds, ``key``. Nulls: a null key is a key like
any other, and a null text has no bytes. Repeated rows go to the same shard, in slots of their own. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import Scratch, numbered, plain

SHARDS, RACK, REGION = 16, 4, 2  # shards that the tree is built with, in a rack; racks in a region
SALT = 20_240_101


@dataclass(frozen=True)
class Shard:
    number: int
    weight: float = 1.0

    @property
    def name(self) -> str:
        return f"shard {self.number}"


@dataclass(frozen=True)
class Node:
    """A region or a rack; names must be unlike in a tree."""

    name: str
    below: tuple[Node | Shard, ...]

    @property
    def weight(self) -> float:
        return sum(x.weight for x in self.below)


def even_tree(shards: int, rack: int = RACK, region: int = REGION) -> Node:
    """Regions of racks of shards of weight 1, filled in order."""
    racks = [Node(f"rack {a // rack}", tuple(Shard(i) for i in range(a, min(a + rack, shards)))) for a in range(0, shards, rack)]
    return Node("root", tuple(Node(f"region {a // region}", tuple(racks[a : a + region])) for a in range(0, len(racks), region)))


def grown(tree: Node, shard: Shard) -> Node:
    """The tree with one shard more, in a region and a rack of its own, into which alone rows move."""
    return Node(tree.name, (*tree.below, Node(f"region of {shard.name}", (Node(f"rack of {shard.name}", (shard,)),))))


def tree_of(shards: int, built: int = SHARDS) -> Node:
    """The tree of so many shards that was built with ``built`` of them."""
    tree = even_tree(min(shards, built))
    for i in range(built, shards):
        tree = grown(tree, Shard(i))
    return tree


def _levels(tree: Node) -> Iterator[list[Node]]:
    level: list[Node] = [tree]
    while level:
        yield level
        level = [x for node in level for x in node.below if isinstance(x, Node)]


def _winner(key: Column, node: Node, ids: dict[str, int]) -> Column:
    """The id of the child with the least time; equal times go to the smaller id."""

    def time(child: Node | Shard) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(SALT), F.lit(child.name), key), 11)
        return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / F.lit(float(child.weight))

    draws = [F.struct(time(x).alias("time"), F.lit(ids[x.name]).alias("id")) for x in node.below if x.weight > 0]
    return (draws[0] if len(draws) == 1 else F.least(*draws))["id"]


def with_shard(df: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """df with the shard of each row's key in ``out``: one step down the tree for each of its levels."""
    levels = list(_levels(tree))
    parts = [tree, *[x for level in levels for node in level for x in node.below]]
    ids = {x.name: i for i, x in enumerate(parts)}
    if len(ids) < len(parts) or tree.weight <= 0:
        raise ValueError("a tree needs names that are unlike and a shard of some weight")
    at = f"__at_{out}"
    df = df.withColumn(at, F.lit(0))
    for level in levels:
        step = F.col(at)  # a row that has come to a shard stays
        for node in (x for x in level if x.weight > 0):
            step = F.when(F.col(at) == ids[node.name], _winner(F.col(key), node, ids)).otherwise(step)
        df = df.withColumn(at, step)
    return df.withColumn(out, F.get(F.array(*[F.lit(x.number if isinstance(x, Shard) else None).cast("int") for x in parts]), F.col(at))).drop(at)


def shards(docs: DataFrame, n: int = SHARDS, built: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    text = F.coalesce("text", F.lit(""))
    sized = plain(docs, doc_id="long", text="string").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    tree = tree_of(n, min(n, built))
    placed = with_shard(with_shard(sized, "doc_id", tree, "shard"), "doc_id", grown(tree, Shard(n)), "grown_shard")
    scratch = Scratch(docs.sparkSession, "shards")
    return numbered(placed, ["shard"], ["doc_id", "size", "text_crc32"], "slot", scratch).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
