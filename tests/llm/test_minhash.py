"""SetSketch registers, their estimates, and near copies against a brute-force comparison of four-word shingle sets."""

import itertools
import random

import numpy as np
import pytest

from packgraph.llm import linking, minhash, setsketch
from test_columns import odd
from test_crowds import sharing
from test_near_dedup import copies, edited, shingles
from test_small import ROWS, components, prose, table, wide


def brute(rows):
    """doc_id, set size, component and kept of each row."""
    sets = [shingles(t, 4) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = components(range(len(rows)), links)
    name = {c: min((rows[i][0] for i in comp if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp.values())}
    return sorted(((d, len(s), name[comp[i]], d == name[comp[i]]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pair(n, common, seed):
    draw = np.random.default_rng((7, seed)).integers(0, 1 << 64, 2 * n - common, np.uint64)
    return draw[:n], draw[n - common :]


def test_registers_of_a_union_are_the_greater_ones():
    for n in (1, 3, 1500, 5000):
        a, b = pair(n, n // 2, n)
        x, y = setsketch.registers(a), setsketch.registers(b)
        assert np.array_equal(setsketch.merged(x, y), setsketch.registers(np.union1d(a, b)))
    assert not setsketch.registers(a[:0]).any() and np.array_equal(setsketch.merged(x, setsketch.registers(a[:0])), x)


def test_registers_follow_their_law():
    """Of n elements, a register is at level k or below with the probability exp(-n * RATE * BASE ** -k)."""
    seen = np.concatenate([setsketch.registers(np.random.default_rng((8, i)).integers(0, 1 << 64, 300, np.uint64)) for i in range(60)])
    for share in (0.1, 0.5, 0.9):
        level = np.quantile(seen, share)
        assert abs(np.exp(-300 * setsketch.RATE * setsketch.BASE ** -float(level)) - share) < 0.03


@pytest.mark.parametrize("common", [100, 500, 800, 890])
def test_likely_similarities_are_near_the_true_ones(common):
    estimates = []
    for seed in range(40):
        a, b = pair(1000, common, seed)
        b = np.concatenate((b, np.random.default_rng(seed + 999).integers(0, 1 << 64, 100, np.uint64)))
        x, y = setsketch.registers(a), setsketch.registers(b)
        estimates.append(setsketch.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([1000.0]), np.array([1100.0]))[0])
    true = common / (2100 - common)
    assert abs(np.mean(estimates) - true) < 0.02 and max(abs(e - true) for e in estimates) < 0.13
    same = setsketch.similarity(np.array([0, 200]), np.array([0, 0]), np.array([5.0, 9.0]), np.array([5.0, 3.0]))
    assert same[0] > 0.999 and 0 <= same[1] <= 1 / 3


def test_near_copies_are_those_of_brute_force(spark):
    rows = [*ROWS, *copies(), (700, "A b C d"), (701, "a B c D"), (701, "a B c D"), (702, "a b c"), (703, "A b c"), (None, prose(1, 4000) + " end")]
    want = brute(rows)
    assert 1 < sum(k for *_, k in want) < len(rows)
    for n in (1, 5):
        got = found(minhash.near_groups(table(spark, rows).repartition(n)))
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert all(k == (d == c) for d, _, c, k in got)
    assert found(minhash.near_groups(odd(spark))) == found(minhash.near_groups(table(spark))) == found(minhash.near_groups(wide(spark)))
    assert minhash.near_groups(table(spark, [])).count() == 0


def test_crowds_of_one_template_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(linking, "CROWD", 8)
    rows = sharing(80) + [(500 + i, "  ".join(prose(3, 60).split()) if i % 2 else prose(3, 60).upper()) for i in range(60)]
    rows += [(1000 + i, edited(t, 1 + i % 9, i)) for i, t in rows[:40]]
    assert found(minhash.near_groups(table(spark, rows))) == brute(rows)


def test_estimates_leave_out_no_link(spark):
    """Pairs just over the threshold, of short and long texts, pass the estimate."""
    low = 1.0
    for seed in range(300):
        n = random.Random(seed).randint(20, 3000)
        common = -(-160 * n // 180)  # the fewest of two sets of n that are alike
        x, y = (setsketch.registers(h) for h in pair(n, common, seed))
        low = min(low, setsketch.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(n)]), np.array([float(n)]))[0])
    assert 100 * low > minhash.PERCENT - minhash.SLACK + 5
