"""Components of nodes that are linked if they share a key and pass a check, without expanding crowded keys into pairs.

Kinds of keys are gone through in waves. After each wave the nodes that it links are contracted to one root, and the next
wave's index takes only keys under which there is still more than one root: a large cluster meets under all of its keys in
the first, small wave and is one root afterwards.

Within a wave, a key whose rows outside its main root are few is joined directly. Of a crowded key the rows outside the main root
are first held against a few of its own nodes, twice, which joins clusters with as many rows as they have members; a
cluster that is known already is held against nothing again. Only rows outside the main root are joined with their key and written. What is still crowded then is a crowd
of nodes that are mostly not linked: its rows are dealt to finer keys (``refine``), of which each linked pair still shares
one, until no key is crowded. Finer keys may tell core rows from others, so that only pairs with a core row meet. Nothing is
capped or left out: a key that can't be refined further is joined directly.

Most keys that are shared have two or three rows. Their counts alone tell these rows, so no join looks them up in the index, and
the few larger keys are sent to it instead of shuffling it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm.components import AT_ONCE, components
from packgraph.llm.scratch import Scratch

FEW, CROWD = 8, 256  # rows outside the main root that are joined directly, before and after a key's leaders were tried
LEADERS, TURNS = 4, 2
LEVELS = 8  # of finer keys
FEW_KEYS = 1 << 16  # larger keys that are sent to the index, some 3 MB; more of them are joined
MANY = 1 << 18  # nodes of which no table is broadcast: ids take so little room in files that the planner would send millions

Wave = Callable[[DataFrame], DataFrame]


def joined(roots: DataFrame, step: DataFrame) -> DataFrame:
    """roots (node, root) after the step's (v, root) is applied to them."""
    found = roots.join(step.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left")
    return found.select("node", F.coalesce("next", "root").alias("root"))


def _shared(index: DataFrame) -> DataFrame:
    """Keys of more than one root: most (one of their roots), n and, if they have two or three rows, these rows' node and root."""
    at = lambda f, x: F.struct(f("node").alias("node"), x.alias("root"))
    third = lambda c, lo, hi: F.bit_xor(c).bitwiseXOR(lo).bitwiseXOR(hi)
    lo, hi = (F.min("node"), F.min_by("root", "node")), (F.max("node"), F.max_by("root", "node"))
    ends = [at(F.min, lo[1]), at(F.max, hi[1])]
    n, between = F.count(F.lit(1)), F.struct(third("node", lo[0], hi[0]).alias("node"), third("root", lo[1], hi[1]).alias("root"))
    known = F.when(n == 2, F.array(*ends)).when(n == 3, F.array(*ends, between))
    keys = index.groupBy("kind", "key").agg(F.min("root").alias("most"), F.max("root").alias("hi"), n.alias("n"), known.alias("known"))
    return keys.filter("most <> hi").drop("hi")


def _placed(index: DataFrame, shared: DataFrame) -> DataFrame:
    """The index rows (node, root, kind, key) of shared keys, with most and n."""
    known = shared.filter("known IS NOT NULL").select(F.explode("known").alias("at"), "kind", "key", "most", "n").select("at.node", "at.root", "kind", "key", "most", "n")
    more = shared.filter("known IS NULL").drop("known")
    keys = more.limit(FEW_KEYS + 1).count()
    return known.unionByName(index.join(F.broadcast(more) if keys <= FEW_KEYS else more.hint("merge"), ["kind", "key"])) if keys else known


def _draw(salt: int) -> Column:
    return F.struct(F.xxhash64(F.lit(salt), "node").alias("draw"), "node", "root")


def _mixed(placed: DataFrame, few: int, salt: int, n: int) -> DataFrame:
    """Keys (kind, key) of placed rows that hold more than one root and a core row, with most (the root of most of their rows),
    crowded (more than ``few`` rows have another root, or would meet core rows that do) and n leaders (node and root), drawn at
    random, one of them from that root."""
    drawn = [F.min(_draw(salt + i)).alias(f"d{i}") for i in [*range(n - 1), n]]
    sizes = placed.groupBy("kind", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("cores"), *drawn)
    most = F.max(F.struct("n", "root", "cores", F.col(f"d{n}").alias("own"))).alias("most")
    mixed = sizes.groupBy("kind", "key").agg(most, F.sum("n").alias("n"), F.sum("cores").alias("cores"), F.count(F.lit(1)).alias("roots"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(n - 1)])
    out, out_core = F.col("n") - F.col("most.n"), F.col("cores") - F.col("most.cores")
    crowded = (out_core > few) | (F.least(out - out_core, F.col("cores")) > few)
    leaders = F.array(*[F.col(d) for d in [*[f"d{i}" for i in range(n - 1)], "most.own"]])
    return mixed.filter("roots > 1 AND cores > 0").select("kind", "key", F.col("most.root").alias("most"), crowded.alias("crowded"), F.when(crowded, leaders).alias("leaders"))


def _direct(outside: DataFrame, placed: DataFrame, with_payload, more: list[str], maybe: Column, all_core: bool) -> DataFrame:
    """Pairs of different roots within the keys of ``outside``, one of them at least a core row: each of these rows, which are outside
    their key's main root (most), against all placed ones if it is one, else against the core rows."""
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "root", *more)]
    met = F.lit(True) if all_core else F.explode(F.when(F.col("core"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    # Of two rows that are both outside the main root, one order is enough.
    once = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("most")) | (F.col("node_a") < F.col("node_b")))
    own = with_payload(outside).select("kind", "key", "most", met.alias("core"), *side("a"))
    pairs = own.join(with_payload(placed).select("kind", "key", "core", *side("b")), ["kind", "key", *["core"] * (not all_core)])
    return pairs.filter(once & maybe).select("node_a", "node_b", "root_a", "root_b")


def _star(crowd: DataFrame, payload: DataFrame | list, maybe: Column, salt: int, n: int) -> DataFrame:
    """Pairs of a crowded key's core rows outside the main root and its n leaders, which come with the rows (``_mixed``) or else are
    drawn from them. payload: what ``maybe`` takes of each node, or nothing."""
    if "leaders" not in crowd.columns:
        drawn = [F.min(_draw(salt + i)) for i in range(n - 1)] + [F.min(F.when(F.col("root") == F.col("most"), _draw(salt + n)))]
        crowd = crowd.join(crowd.groupBy("kind", "key").agg(F.array(*drawn).alias("leaders")), ["kind", "key"])
    met = crowd.filter("core AND root <> most").select(F.col("node").alias("node_a"), F.col("root").alias("root_a"), F.explode("leaders").alias("l"))
    pairs = met.select("node_a", F.col("l.node").alias("node_b"), "root_a", F.col("l.root").alias("root_b")).filter("root_a <> root_b")
    if isinstance(payload, DataFrame):
        pairs = pairs.distinct()  # many keys have the same leaders
        for x in "ab":
            pairs = pairs.join(payload.toDF(*[f"{c}_{x}" for c in payload.columns]), f"node_{x}")
    return pairs.filter(maybe).select("node_a", "node_b", "root_a", "root_b")


def link(
    roots: DataFrame,
    waves: list[Wave],
    maybe: Column,
    scratch: Scratch,
    payload: DataFrame | None = None,
    check: Callable[[DataFrame, str], DataFrame | None] | None = None,
    refine: Callable[[DataFrame, int], DataFrame] | None = None,
    levels: int = LEVELS,
    settles: bool = False,
    prepare: Callable[[DataFrame, str], None] | None = None,
    leaders: int = LEADERS,
    few_links: int = AT_ONCE,
) -> DataFrame:
    """(node, root) of each node: equal roots are linked. roots: node and the root known so far, a table of ``scratch``, which is
    deleted when there are newer ones.

    Each wave makes rows of node, root, kind (int) and key (long) from roots. ``maybe`` is a condition on node_a and node_b
    and on the payload's columns with the same endings; ``check(pairs, name)`` gives those of the pairs (node_a, node_b,
    root_a, root_b) that are linked, or None. ``prepare(rows, name)`` sees the rows of each wave that share a key before that.

    ``refine(rows, level)`` deals rows (node, kind, key) to finer keys, up to ``levels`` times. Its rows may have a boolean column
    core: two rows then meet only if one of them is core. ``settles``: it deals all rows without regard to their keys, so that every
    link among their nodes is found; in later waves these nodes meet only others.
    """
    more = [c for c in payload.columns if c != "node"] if payload is not None else []
    with_payload = lambda df: df.join(payload, "node") if more else df
    all_of = lambda df: df if "core" in df.columns else df.withColumn("core", F.lit(True))
    many = roots.count() > MANY
    whole = lambda df: df.hint("merge") if many else df
    settled: DataFrame | None = None
    for w, wave in enumerate(waves):
        index = wave(whole(roots))
        rows, all_core = _placed(index, scratch.put(f"shared-{w}", _shared(index))), settled is None
        if settled is not None:
            rows = rows.join(whole(settled.withColumn("settled", F.lit(True))), "node", "left").withColumn("core", F.col("settled").isNull()).drop("settled")
        placed, level = scratch.put(f"placed-{w}-0", all_of(rows)), 0
        scratch.drop(f"shared-{w}")
        if prepare is not None:
            prepare(placed, str(w))
        while True:
            name = f"{w}-{level}"
            last = level >= TURNS and (refine is None or level - TURNS >= levels)
            # A key of few rows has few outside any root, so only larger ones are looked at for the main one.
            larger = placed if level else placed.filter(F.col("n") > FEW + 1)
            mixed = scratch.put(f"mixed-{name}", _mixed(larger, FEW if level < TURNS else CROWD, 100 * level, leaders))
            if mixed.isEmpty() and (level or placed.isEmpty()):
                scratch.drop(f"placed-{name}", f"mixed-{name}")
                break
            # Most rows have their key's main root; they are not written again, and of crowded keys they take no payload along.
            outside = scratch.put(f"outside-{name}", larger.drop("most", "n").join(mixed, ["kind", "key"]).filter("root <> most"))
            own, crowd_keys = (outside if last else outside.filter("NOT crowded")).drop("crowded", "leaders"), mixed.filter("crowded")
            met = larger.join(mixed if last else mixed.filter("NOT crowded"), ["kind", "key"], "left_semi") if more else placed
            if not level:
                small = placed.filter(F.col("n") <= FEW + 1)
                own = own.unionByName(small.filter("root <> most").drop("n"))
                met = met.unionByName(small) if more else met
            pairs = _direct(own, met.drop("most", "n"), with_payload, more, maybe, all_core)
            more_levels = not last and not crowd_keys.isEmpty()
            if more_levels:
                pairs = pairs.unionByName(_star(outside.filter("crowded"), payload if more else [], maybe, 100 * level, leaders))
            links = check(pairs, name) if check else pairs
            step = None if links is None else components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), scratch, f"step-{name}", few_links)
            if step is not None:
                before, roots = roots, scratch.put(f"roots-{name}", joined(roots, whole(step)))
                scratch.forget(before)
            scratch.drop_all(f"step-{name}-")
            scratch.drop(f"links-{name}", f"outside-{name}")
            if not more_levels:
                scratch.drop(f"placed-{name}", f"mixed-{name}")
                break
            level += 1
            crowd = larger.select("node", "kind", "key", "core").join(crowd_keys, ["kind", "key"], "left_semi")
            rows = crowd.select("node", "kind", "key", "core")
            if refine is not None and level > TURNS:
                if settles and level == TURNS + 1:
                    nodes = crowd.select("node") if settled is None else crowd.select("node").unionByName(settled)
                    settled = scratch.put(f"settled-{w}", nodes.distinct())
                rows = refine(rows.drop("core"), level - TURNS)
                all_core = "core" not in rows.columns
                rows = all_of(rows)
            placed = scratch.put(f"placed-{w}-{level}", rows.join(whole(roots), "node"))
            scratch.drop(f"placed-{name}", f"mixed-{name}")
    return whole(roots)
