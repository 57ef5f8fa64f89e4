"""The pipeline's near-dedup stage against a brute-force comparison of five-word shingle sets."""

import itertools
import random

import pytest

import corpus_pipeline
from compare import DATA
from packgraph.llm import near_dedup
from packgraph.llm import shingles as shingles_of
from test_small import ROWS, WORDS, components, prose, table, wide


def shingles(text, k=5):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, least=0.8):
    """The component of each row, by its place."""
    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: len(a & b) >= least * len(a | b)
    return components(range(len(rows)), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if alike(sets[i], sets[j])])


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for at in r.sample(range(len(words)), n):
        words[at] = f"new{r.random()}"
    return " ".join(words)


def copies():
    """Copies around a similarity of 0.8, a chain and a large group whose members are far from each other."""
    rows = [(i, prose(i, 120)) for i in range(30)]
    rows += [(100 + i, edited(rows[i][1], 1 + i % 4, i)) for i in range(30)]
    for i in range(12):
        rows.append((200 + i, edited(rows[-1][1] if i else prose(77, 200), 3, 500 + i)))
    base = prose(99, 150)
    return rows + [(300 + i, edited(base, 1 + i % 5, 900 + i)) for i in range(80)]


@pytest.mark.parametrize("piece", [5, 100, 1 << 20])
def test_shingle_sets_whatever_the_piece(piece):
    for _, t in ROWS:
        assert len(shingles_of.shingle_set((t or "").encode(), piece=piece)) == len(shingles(t))


def test_sketches_differ_no_more_than_the_sets():
    texts = [t for _, t in copies()]
    for a, b in itertools.combinations(texts[::7], 2):
        x, y = (shingles_of.shingle_set(t.encode()) for t in (a, b))
        apart = sum(((p ^ q) % (1 << 64)).bit_count() for p, q in zip(shingles_of.sketch(x), shingles_of.sketch(y)))
        assert apart <= len(shingles(a) ^ shingles(b))


def test_near_copies_are_those_of_brute_force(spark):
    rows = [*ROWS, *copies()]
    comp = brute(rows)
    assert 1 < len(set(comp.values())) < len(rows)
    got = near_dedup.near_copies(table(spark, rows)).collect()
    find = {(d, t): c for (d, t), c in zip(rows, (comp[i] for i in range(len(rows))))}
    kept = near_dedup.keep(table(spark, rows)).collect()
    assert len(got) == len({(d, t or "") for d, t in rows}) and len({r["root"] for r in got}) == len(set(comp.values()))
    assert sorted(find[r["doc_id"], r["text"]] for r in kept) == sorted(set(comp.values()))
    least = {c: min((d is None, d or 0) for (d, t), k in find.items() if k == c) for c in set(comp.values())}
    assert all(least[find[r["doc_id"], r["text"]]] == (r["doc_id"] is None, r["doc_id"] or 0) for r in kept)
    assert near_dedup.keep(wide(spark)).columns == wide(spark).columns
    assert near_dedup.keep(table(spark, [])).count() == 0


def test_stage_links_all_pairs_of_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    comp = brute(rows)
    want = {min(rows[i][0] for i in comp if comp[i] == c) for c in set(comp.values())}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()} == want
