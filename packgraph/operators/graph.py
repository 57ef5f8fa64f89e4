"""Directed graphs with typed parallel edges as two tables: nodes (id, ...) and edges (id, source, target, relation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.functions.scalars import edge_id
from packgraph.operators.dealing import distinct
from packgraph.operators.numbering import numbered
from packgraph.scratch import Scratch


MOST_PACKS = 1 << 16  # that share a budget; the shares are broadcast, 2 MB

def dedupe_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One row per id: the last row's content at the first row's place; rows without an id are left out."""
    rest = [c for c in nodes.columns if c not in ("id", order)]
    last = F.max_by(F.struct(*rest), order).alias("m")
    return nodes.filter("id IS NOT NULL").groupBy("id").agg(F.min(order).alias(order), last).select("id", order, *[f"m.{c}" for c in rest])


def edges_from(df: DataFrame, source: Column, target: Column, relation: str) -> DataFrame:
    """Edges between ids such as ``order:7`` that key columns imply; without self-loops and null ends."""
    ends = df.select(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))
    return ends.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")


def node_key(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def union_edges(explicit: DataFrame | None, inferred: Sequence[DataFrame], once: bool = False) -> DataFrame:
    """Explicit edges and those inferred edges that no explicit one has the source, relation and target of. ``once``: the
    inferred parts have no repeats and no edge in common, so nothing is moved to find any."""
    triple = ["source", "relation", "target"]
    out = inferred[0]
    for more in inferred[1:]:
        out = out.unionByName(more)
    out = out if once else out.distinct()
    return out if explicit is None else explicit.select(*triple).distinct().unionByName(out.join(explicit, triple, "left_anti").select(*triple))


def keyed_edges(df: DataFrame, source: tuple[str, str], target: tuple[str, str], relation: str, unique: bool = False, tasks: int | None = None) -> DataFrame:
    """Edges between ids such as ``order:7`` that two key columns (kind, column) imply, each once. Repeats are found on the keys
    themselves, before any id is made, in so many ``tasks``; ``unique``: there are none, since a key of the table is among the two."""
    pairs = df.select(F.col(source[1]).alias("a"), F.col(target[1]).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return edges_from(pairs if unique else distinct(pairs, tasks), node_key(source[0], "a"), node_key(target[0], "b"), relation)


def with_ids(edges: DataFrame, pack: str) -> DataFrame:
    return edges.withColumn("id", edge_id(F.lit(pack), F.col("source"), F.col("relation"), F.col("target")))


def induced(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges with both ends visible; a budget comes after this."""
    ids = visible.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree_out, degree_in, degree; a self-loop adds two. Hubs are summed before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("degree_out"), F.sum("i").alias("degree_in"), F.count(F.lit(1)).alias("degree"))


def lanes(edges: DataFrame) -> DataFrame:
    """A centred lane number for parallel edges: -0.5 and 0.5 for two, 0 for a single one."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"))
    return edges.withColumn("lane", F.row_number().over(pair.orderBy("relation", "source", "target")) - (F.count(F.lit(1)).over(pair) + 1) / 2.0)


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, neighbour, relation, direction of every edge that touches a seed (column id)."""
    ids = seeds.select(F.col("id").alias("seed")).distinct()
    out = edges.join(ids, F.col("source") == F.col("seed")).select("seed", F.col("target").alias("neighbour"), "relation", F.lit("out").alias("direction"))
    back = edges.join(ids, F.col("target") == F.col("seed")).select("seed", F.col("source").alias("neighbour"), "relation", F.lit("in").alias("direction"))
    return out.unionByName(back)


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id and hop (least number of undirected steps) of all nodes within so many steps. Circles end at visited nodes.

    Only edges that touch the frontier are taken in a hop, so nothing is done to the others, and each frontier is written:
    the next hop reads it instead of computing all hops before it again.
    """
    scratch = Scratch(edges.sparkSession, "k-hop")
    frontier = scratch.put("hop-0", seeds.select("id").filter("id IS NOT NULL").distinct().withColumn("hop", F.lit(0)))
    seen = frontier
    for hop in range(1, hops + 1):
        out = edges.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
        back = edges.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))
        frontier = scratch.put(f"hop-{hop}", out.unionByName(back).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def merge_packs(packs: dict[str, DataFrame], aliases: dict[str, str] | None = None) -> DataFrame:
    """Nodes of several packs under ids such as ``pack::id``, with the pack and the id they had. A pack that is an alias of
    another one that is there, or of the same one as an earlier pack, is merged once."""
    chosen: dict[str, str] = {}
    for name in sorted(packs, key=lambda p: (aliases or {}).get(p, p) != p):  # packs under their own name first
        chosen.setdefault((aliases or {}).get(name, name), name)
    parts = [packs[n].withColumn("pack_id", F.lit(p)).withColumn("original_id", F.col("id")).withColumn("id", F.concat_ws("::", F.lit(p), "id")) for p, n in chosen.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def stub_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and kind of the ends that no node has; the kind is what the id begins with."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti").withColumn("kind", F.substring_index("id", ":", 1))


def budget(rows: DataFrame, pack: str, order: list[str], total: int, packs: int) -> DataFrame:
    """Rows of each pack up to its share of the total, in order, with numbers from 1 in ``place``.

    Packs are gone through by rising number of rows, each with an even share, rounded up, of what is left for it and those
    after it, so slots that a small pack leaves unused go to the others.
    """
    sizes = [(r[pack], r["n"]) for r in rows.groupBy(pack).agg(F.count(F.lit(1)).alias("n")).limit(MOST_PACKS + 1).collect()]
    if len(sizes) > MOST_PACKS:
        raise ValueError(f"a budget is shared among {MOST_PACKS} packs at most")
    left, open_, shares = max(0, total), max(packs, len(sizes)), []
    for name, n in sorted(sizes, key=lambda x: (x[1], str(x[0]))):
        share = min(n, -(-left // open_))
        shares.append((name, share))
        left, open_ = left - share, open_ - 1
    kind = rows.schema[pack].dataType.simpleString()
    allowed = F.broadcast(rows.sparkSession.createDataFrame(shares, f"__pack {kind}, __share long"))
    placed = numbered(rows, [pack], order, "place").withColumn("place", F.col("place") + 1)
    return placed.join(allowed, F.col(pack).eqNullSafe(F.col("__pack"))).filter("place <= __share").drop("__pack", "__share")


def shard(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Slices of at most ``size`` rows inside each value of the key: a column shard from 0."""
    return numbered(rows, [key], order, "shard").withColumn("shard", F.floor(F.col("shard") / size).cast("int"))


def visible_nodes(ranked: DataFrame, limit: int, min_degree: int = 0, hidden_types: Sequence[str] = (), focus: DataFrame | None = None, forced: DataFrame | None = None, search: str = "") -> DataFrame:
    """The forced nodes and, for what is left of the limit, the others by falling degree, then id: their columns, forced, and
    capped (others were left out). ranked: id, label, type, degree; focus and forced: id."""
    must = ranked.join(forced.select("id").distinct(), "id", "left_semi") if forced is not None else ranked.limit(0)
    rest = ranked.join(forced.select("id").distinct(), "id", "left_anti") if forced is not None else ranked
    rest = rest.filter((F.col("degree") >= min_degree) & ~F.coalesce(F.col("type").isin(list(hidden_types)), F.lit(False)))
    rest = rest.join(focus.select("id").distinct(), "id", "left_semi") if focus is not None else rest
    if search.strip():
        has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(search.strip().lower())), F.lit(False))
        rest = rest.filter(has("id") | has("label"))
    room = max(0, limit - must.count())
    some = Scratch(ranked.sparkSession, "visible").put("some", rest.orderBy(F.col("degree").desc(), "id").limit(room + 1))
    capped = some.count() > room
    shown = some.orderBy(F.col("degree").desc(), "id").limit(room)
    return must.withColumn("forced", F.lit(True)).unionByName(shown.withColumn("forced", F.lit(False))).withColumn("capped", F.lit(capped))


def resolve_references(nodes: DataFrame, pack: str, referenced: DataFrame | None, text: str = "", limit: int = 300) -> DataFrame:
    """id of the shown nodes of one pack that an answer refers to, by their source ids or, without a list, by whole mentions in
    its text. nodes: id, label, pack_id (null: unknown), original_id (null: the id without the pack's prefix), ord."""
    prefix = f"{pack}::"
    own = F.col("id").startswith(prefix)
    rows = nodes.filter(F.coalesce(F.col("pack_id") == pack, own | ~F.contains("id", F.lit("::"))))
    rows = rows.withColumn("__source", F.coalesce("original_id", F.when(own, F.substring("id", len(prefix) + 1, 1 << 20)), F.col("id")))
    if referenced is not None:
        ids = referenced.select(F.col("id").alias("__ref")).distinct()
        hits = rows.join(ids, (F.col("__ref") == F.col("__source")), "left_semi").unionByName(rows.join(ids, F.col("__ref") == F.col("id"), "left_semi")).dropDuplicates(["id"])
    else:
        quoted = lambda c: F.concat(F.lit(r"(?s)(^|[^0-9A-Za-z\uAC00-\uD7A3])"), F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.lit(r"($|[^0-9A-Za-z\uAC00-\uD7A3])"))
        said = lambda c, least: (F.length(c) >= least) & F.contains(F.lit(text), F.col(c)) & F.lit(text).rlike(quoted(F.col(c)))
        hits = rows.filter(F.coalesce(said("label", 4), F.lit(False)) | said("id", 1) | said("__source", 6))
    return hits.orderBy("ord").limit(limit).select("id")


def merge_references(rows: DataFrame, keys: Sequence[str], refs: str, order: str) -> DataFrame:
    """One row for each key: the first row's columns and the references (an array) of all of them, in order, each once."""
    rest = [c for c in rows.columns if c not in (*keys, refs, order)]
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(refs, F.array()).alias("r"))))
    merged = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("m"), F.min(order).alias(order), F.array_distinct(F.flatten(F.transform(parts, lambda p: p["r"]))).alias(refs))
    return merged.select(*keys, *[f"m.{c}" for c in rest], order, refs)


def scaffold(rows: DataFrame, dims: Sequence[str], key: str, dataset: str) -> tuple[DataFrame, DataFrame]:
    """A graph over the dimensions of rows: nodes (id, type, label, evidence: the first key with that value) for the dataset
    and each value, and edges from the dataset to each value and from each value of a dimension to those of the next that
    occur with it."""
    spark, root = rows.sparkSession, f"dataset:{dataset}"
    blank = lambda d: F.nullif(F.trim(F.col(d).cast("string")), F.lit(""))
    node = lambda d: F.concat(F.lit(f"{d}:"), blank(d))
    nodes = spark.createDataFrame([(root, "dataset", dataset, None)], "id string, type string, label string, evidence string")
    edges = None
    for i, d in enumerate(dims):
        values = rows.filter(blank(d).isNotNull()).groupBy(node(d).alias("id"), blank(d).alias("label")).agg(F.min(key).cast("string").alias("evidence"))
        nodes = nodes.unionByName(values.select("id", F.lit(d).alias("type"), "label", "evidence"))
        found = values.select(F.lit(root).alias("source"), F.col("id").alias("target"), F.lit(f"has_{d}").alias("relation"))
        if i:
            last = dims[i - 1]
            pairs = rows.filter(blank(d).isNotNull() & blank(last).isNotNull()).select(node(last).alias("source"), node(d).alias("target")).distinct()
            found = found.unionByName(pairs.withColumn("relation", F.lit(f"{last}_has_{d}")))
        edges = found if edges is None else edges.unionByName(found)
    return nodes, edges


def ancestors(tree: DataFrame, start: DataFrame) -> DataFrame:
    """The ids (column id) of start and of everything above it in a tree (id, parent), at any depth and with circles.

    Pointers are doubled: a round adds those 2^k levels above all that is kept, so rounds grow with the logarithm of the depth. As
    soon as a round adds nothing, nothing is missing, which also ends circles.
    """
    scratch = Scratch(tree.sparkSession, "tree")
    kept = scratch.put("kept-0", start.select("id").filter("id IS NOT NULL").distinct())
    jump = scratch.put("jump-0", tree.select("id", F.col("parent").alias("up")).filter("id IS NOT NULL AND up IS NOT NULL").distinct())
    level = 0
    while True:
        level += 1
        above = jump.join(kept, "id", "left_semi").select(F.col("up").alias("id")).distinct()
        new = scratch.put(f"new-{level}", above.join(kept, "id", "left_anti"))
        if new.isEmpty():
            return kept
        kept = scratch.put(f"kept-{level}", kept.unionByName(new))
        step = jump.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jump = scratch.put(f"jump-{level}", jump.join(step, "up").select("id", F.col("next").alias("up")).distinct())
        scratch.drop(f"new-{level}", f"kept-{level - 1}", f"jump-{level - 1}")


def nearest_above(tree: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """id and, in a column for each kind, the nearest node of that kind at or above it. tree: id, parent (null at the top), kind.

    Pointers are doubled, and each round a node takes what its pointer's end has found; so rounds grow with the logarithm of the
    depth, and no pair of node and ancestor is made. Circles end when pointers have gone over as many nodes as there are.
    """
    scratch = Scratch(tree.sparkSession, "above")
    found = [F.when(F.col("kind") == k, F.col("id")).alias(k) for k in kinds]
    state = scratch.put("state-0", tree.filter("id IS NOT NULL").select("id", F.col("parent").alias("__up"), *found))
    n, level = state.count(), 0
    missing = F.lit(False)
    for k in kinds:
        missing = missing | F.col(k).isNull()
    while 1 << level <= n and not state.filter(F.col("__up").isNotNull() & missing).isEmpty():
        ends = state.select(F.col("id").alias("__up"), F.col("__up").alias("__next"), *[F.col(k).alias(f"__{k}") for k in kinds])
        step = state.join(ends, "__up", "left").select("id", F.col("__next").alias("__up"), *[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in kinds])
        level += 1
        state = scratch.put(f"state-{level}", step)
        scratch.drop(f"state-{level - 1}")
    return state.drop("__up")


def tree_filter(tree: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of a tree (id, parent) that match or have a match below them, however far, with matched."""
    found = tree.join(ancestors(tree, matches), "id", "left_semi")
    return found.join(matches.select("id").distinct().withColumn("matched", F.lit(True)), "id", "left").fillna({"matched": False})


def merge_local(parts: Sequence[tuple[DataFrame, DataFrame]], tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of several loaded graphs as one: a node of a later part does not replace one of an earlier, ends without
    a node become placeholders until a part has the real one, edges count once by source, relation and target, and a node's
    size comes from its degree (4 to 24). ``tasks``: that find the different edges."""
    nodes, edges = None, None
    for i, (n, e) in enumerate(parts):
        n = n.select("id", "label", "type", F.lit(i).alias("part"), F.lit(False).alias("placeholder"))
        nodes = n if nodes is None else nodes.unionByName(n)
        e = e.select("source", "relation", "target")
        edges = e if edges is None else edges.unionByName(e)
    edges = edges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target")
    edges = distinct(edges, tasks)
    # Every end is a placeholder with its degree, which a node of the same id takes over.
    stubs = degrees(edges).select("id", F.col("id").alias("label"), F.lit("Element").alias("type"), F.lit(len(parts)).alias("part"), F.lit(True).alias("placeholder"), "degree")
    every = nodes.withColumn("degree", F.lit(0).cast("long")).unionByName(stubs).filter("id IS NOT NULL")
    best = F.min(F.struct("placeholder", "part", "label", "type")).alias("m")
    sized = every.groupBy("id").agg(best, F.sum("degree").alias("degree")).select("id", "m.label", "m.type", "m.placeholder", "degree")
    return sized.withColumn("size", F.least(F.lit(24), 4 + F.col("degree"))), edges
