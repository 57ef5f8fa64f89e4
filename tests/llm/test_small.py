"""The operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
import xxhash

from packgraph.llm import byte_bpe, chat_format, deletion_keys, exact_dedup, line_dedup, packing, quality_cnn, quality_rules, scratch, sharding, simhash, url_filter

SCHEMA = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = prose(1, 4000)
ROWS = [
    (1, "a b c d e"), (2, "ab cd\te"), (3, None), (4, ""), (5, " \n"), (6, LONG), (7, LONG + " "), (8, LONG[:-1] + "Z"), (9, "x" * 5000), (9, "x" * 5000),
    (10, "same"), (10, "other"), (None, "no id"), (None, "no  id"), (11, "é中 \U0001f600"), (12, "é中\U0001f600  "),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def wide(spark):
    """The same with columns that clash with those the operators make, and with each other."""
    t = table(spark)
    return t.selectExpr("'z' AS rid", "doc_id", "text", "1 AS name", "2 AS n_blocks", "3 AS fp", "4 AS bucket", "'q' AS shard", "'T' AS TEXT2", "5 AS kept", "6 AS good")


# --- exact dedup ---------------------------------------------------------------------------------------------------------------


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 1024])
def test_exact_dedup(spark, block):
    got = exact_dedup.exact_dedup(wide(spark), block).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute_exact(ROWS)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_exact_dedup_does_not_trust_its_hash(spark):
    from pyspark.sql import functions as F

    rows = exact_dedup.identities(table(spark), 64, lookup=lambda c: F.length(F.col(c)).cast("long")).collect()
    by_name = collections.defaultdict(set)
    for r in rows:
        by_name[r["n_blocks"], r["name"]].add(r["text_sha256"])
    assert all(len(x) == 1 for x in by_name.values()) and len(by_name) == len({r["text_sha256"] for r in rows})


def test_keep_has_all_columns_and_one_row_of_each(spark):
    kept = exact_dedup.keep(wide(spark))
    assert kept.columns == wide(spark).columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ROWS})


# --- simhash -------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_fingerprints_whatever_the_piece():
    for _, t in ROWS:
        for piece in (5, 100, 1 << 20):
            assert simhash.fingerprint((t or "").encode(), piece=piece) == brute_fingerprint(t)
    assert simhash.fingerprint("Straße ÄÖ\xa0x y z w".encode()) == brute_fingerprint("Straße ÄÖ\xa0x y z w")


@pytest.mark.parametrize("distance", range(6))
def test_keys_meet_for_every_pair_in_reach(distance):
    masks = [m % (1 << 64) for m in deletion_keys.masks(distance)]
    r = random.Random(distance)
    for _ in range(3000):
        apart = sum(1 << i for i in r.sample(range(64), r.randint(0, distance)))
        assert any(not apart & m for m in masks)


def test_links_of_fingerprints(spark):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = set(centres)
    for c in centres[:3]:  # clouds and chains
        for _ in range(60):
            fps.add(c ^ sum(1 << i for i in r.sample(range(64), r.randint(1, 4))))
        x = c
        for _ in range(20):
            x ^= sum(1 << i for i in r.sample(range(64), 3))
            fps.add(x)
    fps = sorted(fps)
    want = components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {q["fp"] % (1 << 64): q["root"] for q in simhash.linked(df, scratch.Scratch(spark, "t")).collect()}
    assert set(got) == set(fps)
    assert len(set(got.values())) == len(set(want.values())) == len({(got[x], want[x]) for x in fps})


def test_simhash_report(spark):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(wide(spark)).collect()), key=repr)
    fp = {i: brute_fingerprint(t) for i, (_, t) in enumerate(ROWS)}
    comp = components(set(fp.values()), [(a, b) for a, b in itertools.combinations(sorted(set(fp.values())), 2) if (a ^ b).bit_count() <= 4])
    low = {c: min((ROWS[i][0] for i in fp if comp[fp[i]] == c and ROWS[i][0] is not None), default=None) for c in set(comp.values())}
    assert got == sorted(((ROWS[i][0], f"{fp[i]:016x}", low[comp[fp[i]]]) for i in fp), key=repr)
    assert simhash.report(table(spark, [])).count() == 0
    kept = simhash.keep(wide(spark))
    assert kept.columns == wide(spark).columns and kept.count() == len(set(comp.values()))


# --- quality -------------------------------------------------------------------------------------------------------------------


def brute_measures(t):
    t = t or ""
    w = WORDS.findall(t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rows = [*ROWS, (20, "a b c d e f a b c d e g a b c d e"), (21, "x x x x x x x"), (22, "l\nl\n \nl #*$%&|<>\nl"), (23, "é é é é é é")]
    got = quality_rules.quality_rules(table(spark, rows), spark.createDataFrame([(6, 1), (6, 1), (7, None), (1, 0), (1, 1)], "doc_id long, quality int"))
    found = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect()), key=repr)
    assert found == sorted(((d, *brute_measures(t)) for d, t in rows), key=repr)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)


def test_quality_ratio_is_what_the_counts_say(spark):
    import numpy as np

    rows = [(1, "a b a"), (2, "b c"), (3, "c c c")]
    got = quality_rules.log_ratios(table(spark, rows), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), buckets=97)
    raw, good = np.zeros(97), np.zeros(97)
    for d, t in rows:
        h = np.array([xxhash.xxh64_intdigest(w) for w in t.split()], np.uint64)
        for b in quality_rules.ngram_buckets(h, 97):
            raw[b] += 1
            good[b] += d == 1
    assert np.allclose(got, np.log((good + 16) / (raw * good.sum() / raw.sum() + 16)))
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert not quality_rules.log_ratios(table(spark, rows), empty).any()
    assert quality_rules.keep(table(spark, []), empty).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_verdicts_are_those_of_plain_counts(spark, monkeypatch, few):
    """Words and pairs are counted in plain dictionaries by bucket; few: the two ways of joining the trusted ids."""
    monkeypatch.setattr(quality_rules, "FEW_IDS", few)
    rows = [(i, prose(i, 40) if i % 2 else " ".join(prose(i, 10).upper().split() * 2 + ["spam"] * 5)) for i in range(60)] + [(None, prose(3, 30)), (99, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(1, 40, 2)] + [(0, 0)], "doc_id long, quality int")
    buckets, mask = 211, (1 << 64) - 1

    def of(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in WORDS.findall(text or "")]
        mix = [int(x) for x in quality_rules._MIX]
        pairs = [(a * mix[0] + b * mix[1]) & mask for a, b in zip(h, h[1:])]
        pairs = [((p ^ p >> 29) * mix[3]) & mask for p in pairs]
        return [x % buckets for x in [*h, *(p ^ p >> 32 for p in pairs)]]

    raw, good = collections.Counter(), collections.Counter()
    for d, t in rows:
        raw.update(of(t))
        good.update(of(t) if d is not None and d < 40 and d % 2 else [])
    share = sum(good.values()) / sum(raw.values())
    ratio = {b: math.log((good[b] + 16) / (raw[b] * share + 16)) for b in range(buckets)}
    got = sorted(((r["doc_id"], r["score"], r["kept"]) for r in quality_rules.quality_rules(table(spark, rows), labels, -0.02, buckets).collect()), key=repr)
    want = []
    for d, t in rows:
        n, *_, repeated = brute_measures(t)
        value = sum(ratio[b] for b in of(t)) / len(of(t)) if of(t) else 0.0
        want.append((d, value, n >= 10 and 100 * repeated <= 20 * n and value >= -0.02))
    want.sort(key=repr)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 and a[2] == b[2] for a, b in zip(sorted(got, key=lambda x: (x[0] is None, x[0] or 0)), sorted(want, key=lambda x: (x[0] is None, x[0] or 0))))
    assert {k for _, _, k in want} == {True, False}


def test_network_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    net = quality_cnn.Network(r)
    net.parts = [p.astype(np.float64) for p in net.parts]
    rows = r.integers(0, 256, (5, quality_cnn.CHUNK)).astype(np.uint8)
    doc, label, weight = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        z = np.bincount(doc, net.logits(rows)) / np.bincount(doc)
        return ((np.log1p(np.exp(-z)) * label + np.log1p(np.exp(z)) * (1 - label)) * weight).sum() / weight.sum()

    for p, g in zip(net.parts, net.gradients(rows, doc, label, weight)):
        for at in [tuple(r.integers(0, n) for n in p.shape) for _ in range(6)]:
            if p.shape == (256, quality_cnn.VECTOR):
                at = (int(rows[0, at[0]]), at[1])
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def plain_score(net, text):
    """The network's score of one text in plain loops."""
    vectors, filters, bias, out, out_bias = (p.tolist() for p in net.parts)
    data, logits, at = text or b"", [], 0
    while True:
        chunk = data[at : at + quality_cnn.CHUNK].ljust(quality_cnn.CHUNK, b"\0")
        total = out_bias[0]
        for f in range(quality_cnn.FILTERS):
            most = 0.0
            for p in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                x = bias[f]
                for w in range(quality_cnn.WIDTH):
                    for v in range(quality_cnn.VECTOR):
                        x += vectors[chunk[p + w]][v] * filters[w * quality_cnn.VECTOR + v][f]
                most = max(most, x)
            total += most * out[f]
        logits.append(total)
        if at + quality_cnn.CHUNK >= len(data):
            break
        at += quality_cnn.STEP
    return 1 / (1 + math.exp(-sum(logits) / len(logits)))


def test_scores_are_those_of_plain_loops(spark):
    import numpy as np

    net = quality_cnn.Network(np.random.default_rng(5))
    net.parts[2] += np.linspace(-0.2, 0.2, quality_cnn.FILTERS, dtype=np.float32)
    rows = [(1, None), (2, ""), (3, "abc é"), (4, prose(8, 120)), (5, "x" * 449), (6, "y" * 256), (6, "y" * 257)]
    got = quality_cnn.quality_scores(table(spark, rows).selectExpr("'s' AS score", "doc_id", "text", "1 AS predicted", "2 AS held_out"), None, net).collect()
    want = sorted((d, plain_score(net, (t or "").encode())) for d, t in rows)
    assert all(a == r["doc_id"] and abs(b - r["score"]) < 1e-5 for (a, b), r in zip(want, sorted(got, key=lambda r: (r["doc_id"], r["score"]))))
    assert quality_cnn.keep(wide(spark), None, net).columns == wide(spark).columns


def test_the_sample_is_bounded_by_its_chunks(spark):
    rows = spark.createDataFrame([(i, i % 2, "x" * (i * 300)) for i in range(40)] + [(50, 1, "y" * 300_000), (51, 1, None)], "doc_id long, label int, text string")
    ids = quality_cnn._chosen(rows, 60)
    sizes = {r["doc_id"]: (r["label"], len(quality_cnn.chunks((r["text"] or "").encode()))) for r in rows.collect()}
    for label in (0, 1):
        assert 20 < sum(sizes[i][1] for i in ids if sizes[i][0] == label) <= 60
    assert 50 not in ids and len(ids) == len(set(ids))


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        rows = quality_cnn.chunks(data)
        assert len(rows) == quality_cnn.n_chunks(n)
        back = bytearray(len(rows) * quality_cnn.STEP + quality_cnn.CHUNK)
        for k, row in enumerate(rows):
            back[k * quality_cnn.STEP : k * quality_cnn.STEP + quality_cnn.CHUNK] = row.tobytes()
        assert bytes(back).rstrip(b"\0") == data


def test_classifier_learns_and_holds_out(spark):
    rows = [(i, prose(i, 30) if i % 2 else " ".join(w.upper() + "!!" for w in prose(i, 30).split())) for i in range(240)] + [(1000, None), (None, "abc"), (1001, LONG)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(3, 0), (None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_cnn.quality_scores(table(spark, rows), labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    out = [r for i, r in got.items() if r["held_out"] and i is not None and i < 240]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in out) / len(out) > 0.9
    one = quality_cnn.quality_scores(table(spark, rows), labels.filter("quality = 1")).collect()
    assert len({r["score"] for r in one}) == 1
    assert quality_cnn.keep(table(spark, []), labels).count() == 0


# --- sharding, packing, lines ---------------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [*ROWS, *[(i, str(i)) for i in range(100, 1100)]]
    got = sharding.shards(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 9}) == 1
    assert sharding.shards(table(spark, [])).count() == 0


def xx(*parts):
    """Spark's xxhash64 of an int, a string and a long (or null), unsigned."""
    h = 42
    for x in parts:
        if x is not None:
            data = x.encode() if isinstance(x, str) else x.to_bytes(4 if parts[0] is x else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h


def plain_descent(key, tree):
    """The shard of a key by going down the tree, without Spark."""
    while isinstance(tree, sharding.Node):
        time = lambda x: -math.log(((xx(sharding.SALT, x.name, key) >> 11) + 0.5) / 2**53) / x.weight
        tree = min((x for x in tree.below if x.weight > 0), key=time)
    return tree.number


def placed(spark, tree, n=3000):
    return {r["id"]: r["s"] for r in sharding.with_shard(spark.range(n), "id", tree, "s").collect()}


def a_tree(w=1.0, at=1):
    s = lambda i: sharding.Shard(i, w if i == at else 1.0 + i % 3)
    return sharding.Node("root", (
        sharding.Node("a", (sharding.Node("a1", (s(0), s(1))), sharding.Node("a2", (s(2),)))), sharding.Node("b", (sharding.Node("b1", (s(3), s(4), s(5))), sharding.Node("b2", (s(6),)))), sharding.Node("c", (s(7), s(8))),
    ))


@pytest.mark.parametrize("tree", [sharding.even_tree(16), sharding.tree_of(18), a_tree(2.5), a_tree(0.0)])
def test_shards_are_those_of_a_plain_descent(spark, tree):
    assert placed(spark, tree) == {i: plain_descent(i, tree) for i in range(3000)}
    none = sharding.with_shard(spark.createDataFrame([(None,)], "id long"), "id", tree, "s").first()["s"]
    assert none == plain_descent(None, tree)


@pytest.mark.parametrize("n", [1, 3, 5, 8, 16, 17, 20])
def test_a_grown_tree_takes_rows_only_into_the_new_shard(spark, n):
    tree = sharding.tree_of(n, min(n, 16))
    a, b = placed(spark, tree), placed(spark, sharding.grown(tree, sharding.Shard(n)))
    assert {b[i] for i in a if a[i] != b[i]} == {n}
    assert n < 16 or sharding.grown(tree, sharding.Shard(n)) == sharding.tree_of(n + 1)


def test_the_shape_of_the_tree_matters(spark):
    assert placed(spark, sharding.even_tree(16, 4, 2)) != placed(spark, sharding.even_tree(16, 8, 1))


def test_changed_weights_move_rows_only_into_or_out_of_their_subtree(spark):
    for at, sub in ((1, {0, 1, 2}), (4, {3, 4, 5, 6}), (7, {7, 8})):
        one, more = placed(spark, a_tree(1.0, at), 6000), placed(spark, a_tree(4.0, at), 6000)
        moved = {(one[i], more[i]) for i in one if one[i] != more[i]}
        assert moved and all(b in sub for _, b in moved)  # more weight: only into the subtree
        assert all(a not in sub or b == at for a, b in moved if at in (1, 7) and {a, b} <= ({0, 1} if at == 1 else sub))
        total = sum(x.weight for x in a_tree(4.0, at).below)
        assert abs(sum(s == at for s in more.values()) / 6000 - 4 / total) < 0.04


def test_boundaries_are_optimal():
    r = random.Random(3)
    for _ in range(200):
        hist = [(x, n, n * x) for x in sorted({r.randint(1, 40) for _ in range(r.randint(1, 8))}) for n in [r.randint(1, 5)]]
        k, top = r.randint(1, 5), hist[-1][0]
        cost = lambda ends: sum(n * min(e for e in ends if e >= x) - s for x, n, s in hist)  # noqa: E731, B023
        got = packing.boundaries(hist, k)
        assert len(got) <= k and cost(got) == min(cost((*c, top)) for m in range(k) for c in itertools.combinations([h[0] for h in hist[:-1]], m))
    assert packing.boundaries([]) == []


def brute_packed(rows, buckets, budget):
    """The least padding over all choices of boundaries, and the number of batches that each bucket's rows need."""
    sizes = sorted(len((t or "").encode()) + 1 for _, t in rows)
    tops = sorted(set(sizes))
    best = min(((sum(min(e for e in (*c, tops[-1]) if e >= s) - s for s in sizes), c) for m in range(buckets) for c in itertools.combinations(tops[:-1], m)), key=lambda x: x[0])
    return best[0]


@pytest.mark.parametrize("buckets,budget", [(1, 12), (3, 12), (3, 9000), (5, 1)])
def test_packing(spark, buckets, budget):
    got = packing.packed(wide(spark), buckets=buckets, budget=budget).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted(((d, len((t or "").encode()) + 1) for d, t in ROWS), key=repr)
    assert sum(r["padded_tokens"] - r["n_tokens"] for r in got) == brute_packed(ROWS, buckets, budget)
    rows = collections.defaultdict(list)
    for r in got:
        rows[r["bucket"]].append(r)
    tops = {b: max(r["n_tokens"] for r in x) for b, x in rows.items()}
    assert [tops[b] for b in sorted(tops)] == sorted(tops.values())
    for b, x in rows.items():
        fit = max(1, budget // tops[b])
        assert {r["padded_tokens"] for r in x} == {tops[b]}
        assert sorted((r["batch"], r["place"]) for r in x) == [(i // fit, i % fit) for i in range(len(x))]
    assert packing.packed(table(spark, [])).count() == 0


def test_packing_by_a_column_of_lengths(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -4), (4, 70)], "doc_id long, n_tokens int")
    assert sorted((r["doc_id"], r["n_tokens"], r["padded_tokens"]) for r in packing.packed(df, buckets=2, length="n_tokens").collect()) == [(1, 5, 5), (2, 0, 5), (3, 0, 5), (4, 70, 70)]


def test_numbers_have_no_gaps_whatever_the_copies(spark):
    df = spark.range(3000).selectExpr("id % 3 AS g", "if(id % 2 = 0, 1L, id) AS x")
    s = scratch.Scratch(spark, "numbers")
    got = scratch.numbered(s.put("t", scratch.binned(df, ["x"], bins=16)), ["g"], ["x"], "at", s).collect()
    for g in range(3):
        assert sorted(r["at"] for r in got if r["g"] == g) == list(range(1000))


def test_histogram_cells_rise_and_are_bounded(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 1 << 16).select("id", packing.cell(F.col("id"), 64).alias("c")).orderBy("id").collect()
    cells = [r["c"] for r in rows]
    assert cells == sorted(cells) and cells[:64] == list(range(1, 65)) and len(set(cells)) <= 64 + 32 * 11
    widths = collections.Counter(cells)
    assert all(widths[c] <= max(1, r["id"] // 32) for r, c in zip(rows, cells))


def brute_lines(rows, size=3):
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    first, gone = {}, collections.defaultdict(set)
    order = sorted(docs, key=lambda x: (x[0], x[1]))
    for key in order:
        lines = key[2].split("\n")
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if not any(WORDS.search(x) for x in w):
                continue
            if w not in first:
                first[w] = (key, p)
            else:
                start = max(p, first[w][1] + size) if first[w][0] == key else p
                gone[key] |= set(range(start, p + size))
    return {k: [x for i, x in enumerate(k[2].split("\n")) if i not in gone[k]] for k in docs}


def test_line_dedup(spark):
    rows = [*ROWS, (30, "a\nb\nc\nd"), (31, "z\na\nb\nc\nd\ny"), (32, "q\nq\nq\nq\nq"), (33, "\n\n\n\n"), (34, "b\nc\nd\n\n\n\nb\nc\nd")]
    want = brute_lines(rows)
    for r in line_dedup.line_dedup(table(spark, rows)).collect():
        options = ["\n".join(v) for k, v in want.items() if (k[0], k[1]) == (r["doc_id"] is None, r["doc_id"] or 0)]
        assert r["text"] in options
    assert line_dedup.line_dedup(table(spark, rows)).count() == len(rows)
    assert line_dedup.report(table(spark, [])).count() == 0


# --- tokens, chats, URLs ---------------------------------------------------------------------------------------------------------


def test_byte_bpe_is_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = byte_bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(2)
    rows = [*ROWS, *[(100 + i, "".join(r.choice("abcdeinrstouéäñ'd  \n\t!!#123中日の\u3000\u0301²") for _ in range(r.randint(0, 200)))) for i in range(200)], (500, "abé" * 40000)]
    got = byte_bpe.byte_bpe(table(spark, rows), path, P.PATTERN).collect()
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(x) for x in got), key=repr) == sorted(want, key=repr)
    assert byte_bpe.byte_bpe(table(spark, []), path, P.PATTERN).count() == 0


def test_parts_of_long_texts(monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(byte_bpe, "PIECES", 7)
    e = byte_bpe.Encoder(byte_bpe.Vocabulary(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))), P.PATTERN)
    text = prose(4, 200)
    parts = list(e.encode(text))
    assert len(parts) > 5 and b"".join(map(e.decode, parts)) == text.encode()


@pytest.mark.parametrize("text", ["", "a", "\\### Assistant: </turn> ok", "####", "\\#\\##</turn</turn>", "\\n\n", "#\\##", "\\\\", "### user\nx</turn>\n"])
def test_escapes_are_reversible(text):
    shown = chat_format.escape(text)
    assert "###" not in shown and "</turn>" not in shown and chat_format.unescape(shown) == text
    turns = [("user", text), ("assistant", text), ("a\nb#" + text, text), ("assistant", "")]
    out, spans = chat_format.format_turns(turns)
    assert chat_format.read_turns(out) == turns
    assert [chat_format.unescape(out[a:b]) for a, b in spans] == [text, ""]


def test_reply_trees(spark):
    #      1           tree 7: branches 1-2-4 (score 6), 1-3 (9), 1-5-6 (9); tree 8: a circle 1-2 and a root 3; null tree: 1
    rows = [
        (7, 1, None, "user", "q", 1.0), (7, 2, 1, "assistant", "x", 2.0), (7, 4, 2, "user", "y", 3.0), (7, 3, 1, "assistant", "best", 8.0), (7, 5, 1, None, None, 4.0), (7, 6, 5, "assistant", "z", 4.0), (7, 6, 5, "assistant", "zz", 4.0),
        (8, 1, 2, "user", "c", 0.0), (8, 2, 1, "user", "c", 0.0), (8, 3, 99, "user", "root", None), (8, 4, 4, "user", "self", 1.0), (None, 1, None, "assistant", "n", 0.0), (7, None, 1, "user", "none", 50.0),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["rank"]): (r["leaf"], chat_format.read_turns(r["formatted"])) for r in chat_format.format_trees(df, branches=2).collect()}
    assert got == {
        (7, 1): (3, [("user", "q"), ("assistant", "best")]), (7, 2): (6, [("user", "q"), ("", ""), ("assistant", "z")]), (8, 1): (3, [("user", "root")]), (None, 1): (1, [("assistant", "n")]),
    }
    assert chat_format.format_trees(df.limit(0)).count() == 0


def test_long_chains_and_repeated_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", str(i)) for i in range(70)] + [(2, 5, "user", "b"), (2, 5, "user", "a"), (2, None, None, None), (2, 5, "user", "a"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_trees(chat_format.as_messages(df))).collect()}
    assert got[1]["n_turns"] == 70 and got[2]["n_turns"] == 4 and got[None]["n_turns"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:70]).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("".join(str(i) for i in range(1, 70, 2)).encode()).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest()


def test_urls_as_of_their_fetch(spark):
    from datetime import datetime as dt

    entries = spark.createDataFrame([("bad.org", "spam", "add", dt(2020, 1, 1)), ("bad.org", "spam", "remove", dt(2021, 6, 1)), ("sub.bad.org", "ads", "add", dt(2021, 1, 1)), ("tie.org", "a", "add", dt(2020, 1, 1)), ("tie.org", "a", "remove", dt(2020, 1, 1)), (None, "x", "add", dt(2020, 1, 1)), ("bad.org", "x", "add", None)], "pattern string, list string, action string, at timestamp")
    seen = [
        (1, "http://bad.org/", dt(2019, 12, 31)), (2, "http://bad.org/", dt(2020, 1, 1)), (3, "https://u:p@WWW.Sub.Bad.org.:8080/x", dt(2021, 3, 1)), (4, "http://bad.org", dt(2021, 6, 1)), (5, "http://notbad.org/", dt(2020, 5, 5)),
        (6, None, dt(2020, 5, 5)), (7, "http://bad.org/", None), (8, "no url", dt(2020, 5, 5)), (9, "http://tie.org", dt(2020, 5, 5)), (2, "http://bad.org/", dt(2020, 1, 1)), (None, "http://bad.org/", dt(2020, 2, 2)),
    ]
    df = spark.createDataFrame(seen, "page_id long, url string, fetched_at timestamp")
    got = sorted((r["page_id"] or 0, r["n_active"], r["pattern"]) for r in url_filter.url_filter(df, entries).collect() if r["blocked"])
    assert got == [(0, 1, "bad.org"), (2, 1, "bad.org"), (2, 1, "bad.org"), (3, 2, "sub.bad.org")]
    assert url_filter.url_filter(df, entries).count() == len(seen)
    assert url_filter.url_filter(df, entries.limit(0)).filter("blocked").count() == 0
    assert url_filter.url_filter(df.limit(0), entries).count() == 0


def test_a_task_holds_few_words_at_once():
    from packgraph.llm.words import WordIds

    ids = WordIds()
    for i in range(100):
        at = ids.of(b" ".join(b"w%d" % j for j in range(2000 * i, 2000 * i + 2000)))
        assert len(set(at.tolist())) == 2000 and len(ids) <= (1 << 15) + 2000
