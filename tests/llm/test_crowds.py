"""Crowds of fingerprints under one key: all links are found, and joins don't grow with the square of a crowd."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packgraph.llm import linking, scratch, simhash
from test_small import components


def family(n, least, most, seed=3):
    r = random.Random(seed)
    centre = r.getrandbits(64)
    return sorted({centre ^ sum(1 << i for i in r.sample(range(64), r.randint(least, most))) for _ in range(n)})


def table(spark, fps):
    return spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")


def brute(fps):
    a, links = np.array(fps, np.uint64), []
    for i in range(len(a)):
        links += [(fps[i], fps[i + 1 + j]) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4)]
    return components(fps, links)


@pytest.mark.parametrize("least,most", [(1, 4), (4, 8)])
def test_a_family_has_the_components_of_brute_force(spark, monkeypatch, least, most):
    monkeypatch.setattr(linking, "CROWD", 12)  # so that finer keys are made of small families
    fps = family(400, least, most)
    want = brute(fps)
    got = {q["fp"] % (1 << 64): q["root"] for q in simhash.linked(table(spark, fps), scratch.Scratch(spark, "t")).collect()}
    assert set(got) == set(fps)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[x], want[x]) for x in fps})


@pytest.mark.parametrize("level", [1, 2, 5])
def test_finer_keys_meet_for_every_pair_in_reach(spark, level):
    from packgraph.llm import deletion_keys

    r = random.Random(level)
    pairs = [(x, x ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 4)))) for x in (r.getrandbits(64) for _ in range(200))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x), 7, 99) for x in itertools.chain(*pairs)], "node long, kind int, key long")
    keys = {}
    for q in deletion_keys.refiner(4)(rows, level).collect():
        keys.setdefault(q["node"] % (1 << 64), set()).add((q["kind"], q["key"]))
    assert all(keys[a] & keys[b] for a, b in pairs)


def test_waves_keep_a_large_cluster_out_of_later_indexes(spark, monkeypatch):
    seen, put = {}, scratch.Scratch.put

    def counted(self, name, df):
        out = put(self, name, df)
        if name.startswith("placed-"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(scratch.Scratch, "put", counted)
    fps = family(1500, 1, 4)
    simhash.linked(table(spark, fps), scratch.Scratch(spark, "t")).collect()
    assert sum(seen.values()) < 30 * len(fps)  # of 139 keys each, nearly all of which are shared


@pytest.mark.parametrize("at_once", [2, 100_000])
def test_components_of_chains_stars_and_circles(spark, monkeypatch, at_once):
    from packgraph.llm import components as C

    monkeypatch.setattr(C, "AT_ONCE", at_once)
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2000 + (i + 1) % 40) for i in range(40)] + [(r.randrange(3000, 3200), r.randrange(3000, 3200)) for _ in range(120)] + [(5, 5)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    s = scratch.Scratch(spark, "c")
    touched = sorted({v for a, b in edges if a != b for v in (a, b)})
    want = components(touched, edges)
    for few in (0, 60, 100_000):
        got = {x["v"]: x["root"] for x in C.components(df, s, f"c{few}", few).collect()}
        assert set(got) == set(touched) and len(set(got.values())) == len(set(want.values())) == len({(got[v], want[v]) for v in touched})
    assert C.components(df.limit(0), s, "none") is None


def test_stars_of_edges():
    from packgraph.llm.components import stars_of

    found = dict(stars_of(iter([(1, 2), (2, 3), (7, 8), (4, 4)])))
    assert set(found) | set(found.values()) == {1, 2, 3, 7, 8} and len(set(found.values())) == 2


def sharing(n, shared=120, own=60, seed=5):
    """Texts around one template, of which none is linked: two have half of their shingles in common or less."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    template = " ".join(word() for _ in range(shared))
    return [(i, template + " " + " ".join(word() for _ in range(own))) for i in range(n)]


def test_a_template_is_no_square_of_pairs(spark, monkeypatch):
    """Twice the texts make about twice the pairs, not four times as many."""
    from packgraph.llm import near_dedup
    from test_small import table as texts

    monkeypatch.setattr(linking, "CROWD", 32)
    seen, direct = [], linking._direct

    def counted(placed, keys, with_payload, more, maybe, all_core):
        seen.append(direct(placed, keys, lambda df: df, [], linking.F.lit(True), all_core).count())
        return direct(placed, keys, with_payload, more, maybe, all_core)

    monkeypatch.setattr(linking, "_direct", counted)
    pairs = {}
    for n in (150, 300):
        seen.clear()
        got = near_dedup.near_copies(texts(spark, sharing(n))).collect()
        assert len({r["root"] for r in got}) == n
        pairs[n] = sum(seen)
    assert pairs[300] < 3 * pairs[150] + 500 and pairs[300] < 100 * 300


def test_links_within_crowds_of_templates_are_found(spark, monkeypatch):
    """Near copies hidden among texts of one template, which must come from the finer keys: brute force has the same links."""
    from packgraph.llm import near_dedup
    from test_near_dedup import brute, edited
    from test_small import table as texts

    monkeypatch.setattr(linking, "CROWD", 8)
    rows = sharing(90)
    rows += [(1000 + i, edited(t, 1 + i % 9, i)) for i, t in rows[:40]] + [(2000 + i, t + f" more{i}") for i, t in rows[20:50]]
    comp = brute(rows)
    got = {r["doc_id"]: r["root"] for r in near_dedup.near_copies(texts(spark, rows)).collect()}
    assert len(set(got.values())) == len(set(comp.values())) == len({(got[d], comp[i]) for i, (d, _) in enumerate(rows)}) < len(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_prefixes_of_alike_sets_meet(percent):
    """One of the common first shingles is in the core of the smaller set, whatever the order and beside a common key."""
    from packgraph.llm import set_joins

    r, g = random.Random(percent), np.random.default_rng(percent)
    counts = g.integers(0, 5, 1 << set_joins.BUCKET_BITS).astype(np.uint32) + 2
    met = 0
    for _ in range(3000):
        n = r.randint(1, 60)
        pool = [r.getrandbits(64) for _ in range(2 * n)]
        a, b = sorted(pool[: n + r.randint(0, n // 4)]), sorted(pool[r.randint(0, n // 4) : n])
        if not b or not set_joins.at_least(len({*a} & {*b}), len(a), len(b), percent):
            continue
        met += 1
        small, large = sorted((a, b), key=len)
        for key in (0, min({*a} & {*b})):
            if key and len({*a} & {*b}) == 1:
                continue
            x, core = set_joins.prefix(np.array(small, np.uint64), key, counts, percent)
            y, _ = set_joins.prefix(np.array(large, np.uint64), key, counts, percent)
            assert {*x[core].tolist()} & {*y.tolist()}
    assert met > 100


def test_a_known_cluster_is_held_against_no_leader(spark):
    rows = [(i, 1, 0, 7, True, 1) for i in range(50)] + [(100 + i, 100 + i, 0, 7, i < 5, 1) for i in range(10)]
    crowd = spark.createDataFrame(rows, "node long, root long, kind int, key long, core boolean, most long")
    pairs = linking._star(crowd, [], F.lit(True), 0, 2).collect()
    assert {p["node_a"] for p in pairs} == set(range(100, 105)) and len(pairs) <= 10


def test_tables_of_many_nodes_are_not_broadcast_and_few_links_take_one_task(spark, monkeypatch):
    monkeypatch.setattr(linking, "MANY", 10)
    written = []
    put = scratch.Scratch.put
    monkeypatch.setattr(scratch.Scratch, "put", lambda self, name, df: written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or put(self, name, df))
    fps = family(60, 1, 4)
    got = simhash.linked(table(spark, fps), scratch.Scratch(spark, "t"))
    assert "SortMergeJoin" in got.join(got.limit(3).select("fp"), "fp")._jdf.queryExecution().toString()
    assert not any("-stars-" in name for name, _ in written)
    assert all("strategy=merge" in plan for name, plan in written if name.startswith("roots-"))


def test_rows_of_crowded_keys_take_no_payload_to_direct_pairs(spark, monkeypatch):
    seen, direct = [], linking._direct
    monkeypatch.setattr(linking, "_direct", lambda outside, placed, *rest: seen.append(placed.count()) or direct(outside, placed, *rest))
    s, nodes = scratch.Scratch(spark, "t"), spark.range(200).select(F.col("id").alias("node"))
    roots, payload = s.put("roots", nodes.withColumn("root", F.col("node"))), s.put("payload", nodes.withColumn("x", F.lit(1)))
    key = lambda rows, kind, k: rows.select("node", "root", F.lit(kind).alias("kind"), k.cast("long").alias("key"))
    wave = lambda r: key(r, 0, F.lit(7)).unionByName(key(r.filter("node < 20"), 1, F.floor(F.col("node") / 2)))
    assert linking.link(roots, [wave], F.lit(True), s, payload).select("root").distinct().count() == 1
    assert seen[0] == 20


def test_rows_of_small_keys_come_from_their_counts(spark, monkeypatch):
    """Keys of two and three rows are told by their counts, so the index is joined only for larger ones, and only if there are any."""
    r = random.Random(4)
    rows = [(node, r.randrange(3), kind, key) for kind in range(3) for key in range(200) for node in r.sample(range(-500, 500), r.randint(1, 3))]
    index = spark.createDataFrame(rows, "node long, root long, kind int, key long")
    s = scratch.Scratch(spark, "t")
    many = {}
    for row in rows:
        many.setdefault(row[2:], []).append(row)
    want = sorted(x for group in many.values() if len({g[1] for g in group}) > 1 for x in group)
    placed = linking._placed(index, s.put("shared", linking._shared(index)))
    assert sorted(tuple(q)[:4] for q in placed.select("node", "root", "kind", "key").collect()) == want and "Join" not in placed._jdf.queryExecution().optimizedPlan().toString()
    crowd = [(i, i % 2, 9, 9) for i in range(40)]
    both = index.unionByName(spark.createDataFrame(crowd, index.schema))
    for few in (0, 10):
        monkeypatch.setattr(linking, "FEW_KEYS", few)
        placed = linking._placed(both, s.put(f"shared-{few}", linking._shared(both)))
        got = placed.collect()
        assert sorted(tuple(q[c] for c in ("node", "root", "kind", "key")) for q in got) == sorted(want + crowd) and {q["n"] for q in got} == {2, 3, 40}


def test_rows_of_a_known_cluster_are_not_written_again(spark, monkeypatch):
    """Keys that a cluster of 300 shares with few others: only the others are joined with their keys, under as many as there are."""
    written, put = {}, scratch.Scratch.put
    monkeypatch.setattr(scratch.Scratch, "put", lambda self, name, df: written.setdefault(name, put(self, name, df)))
    seen, drop = {}, scratch.Scratch.drop
    monkeypatch.setattr(scratch.Scratch, "drop", lambda self, *names: seen.update({n: written[n].count() for n in names if n in written and n not in seen}) or drop(self, *names))
    s = scratch.Scratch(spark, "t")
    roots = put(s, "roots", spark.range(310).select(F.col("id").alias("node"), F.greatest("id", F.lit(299)).alias("root")))
    wave = lambda r: r.select("node", "root", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("kind"), F.lit(7).cast("long").alias("key"))
    linked = linking.link(roots, [wave], F.abs(F.col("node_a") - F.col("node_b")) == 1, s)
    assert linked.select("root").distinct().count() == 1
    assert sum(n for name, n in seen.items() if name.split("-")[0] in ("outside", "held")) <= 5 * 10 * (linking.TURNS + 1)
