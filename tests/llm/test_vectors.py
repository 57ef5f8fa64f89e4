"""Codes and whitening of vectors against plain versions, on odd rows and on crowds of equal parts."""

import hashlib
import math
import random

import numpy as np
import pytest

from packgraph.llm import vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def some(n, size=16, seed=1):
    r = random.Random(seed)
    return [(i * 7 % n, [float(np.float32(r.gauss(0, 0.3))) for _ in range(size)], r.choice([0, 1, None])) for i in range(n)]


ODD = [(500, None, 1), (501, [], 1), (502, [0.1] * 15 + [None], 1), (503, [0.1] * 15 + [NAN], 0), (504, [INF] + [0.1] * 15, 0), (505, [0.5] * 4, 0)]
REST = [(None, [0.25] * 16, 2), (7, [-0.25] * 16, None), (7, [-0.25] * 16, None), (600, [3e38, -3e38] + [0.0] * 14, 1)]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    names = ("row", "position", "part", "weight", "code", "error", "parts", "n", "x0", "w0", "deviation", "size", "vector")
    return df.selectExpr(*[f"'{c}' AS {c}" for c in names], "*", "'z' AS LABEL2").toDF(*names, "vec_id", "embedding", "label", "Embedding")


def limited(x, most):
    return max(-most, min(most, x))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    size = len(rows[0][1])
    width = -(-size // parts)
    whole = [[math.floor(limited(4096 * x, 1 << 24)) for x in v] + [0] * (parts * width - size) for _, v, _ in rows]
    seeds = {}
    for (i, _, _), v in zip(rows, whole):
        seeds[i] = min(v, seeds.get(i, v))
    first = sorted(seeds, key=lambda i: (i is None, i or 0))[:entries]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(parts):
        book = [seeds[i][p * width : (p + 1) * width] for i in first]
        mine = [v[p * width : (p + 1) * width] for v in whole]
        dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        for step in range(rounds + 1):
            best = [min((dist(x, b), k) for k, b in enumerate(book)) for x in mine]
            if step < rounds:
                for k in range(len(book)):
                    own = [x for x, (_, j) in zip(mine, best) if j == k]
                    if own:
                        book[k] = [sum(c) // len(own) for c in zip(*own)]
        for i, (e, k) in enumerate(best):
            codes[i].append(f"{k:02x}")
            errors[i] += e
        books += [x for b in book for x in b]
    label = {}
    for (_, _, name), e in zip(rows, errors):
        label[name] = label.get(name, 0) + e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return sorted(((i, "".join(c), e, label[name], digest) for (i, _, name), c, e in zip(rows, codes, errors)), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("heavy", [2, 1024])
def test_codes_are_those_of_plain_loops(spark, monkeypatch, heavy):
    monkeypatch.setattr(vectors, "HEAVY", heavy)
    rows = some(90) + REST + [(1000 + i, [0.125] * 16, 5) for i in range(60)]  # a crowd under every part and one label
    random.Random(4).shuffle(rows)
    want = plain_codes(rows)
    for n in (1, 5):
        assert found(vector_codes.vector_codes(clashing(table(spark, rows + ODD)).repartition(n))) == want


def test_codes_of_few_and_of_uneven_vectors(spark):
    rows = some(9, 13, 2)
    assert found(vector_codes.vector_codes(table(spark, rows))) == plain_codes(rows)
    rows = some(300, 20, 3)
    assert found(vector_codes.vector_codes(table(spark, rows), parts=4, entries=40, rounds=2)) == plain_codes(rows, 4, 40, 2)
    assert vector_codes.vector_codes(table(spark, ODD[:5])).count() == vector_codes.vector_codes(table(spark, [])).count() == 0


def check_white(got, rows, k=8):
    x = np.array([[math.floor(1024 * limited(c, 1 << 20)) + 100_000 for c in v] for _, v, _ in rows], object)
    n, sums = len(x), x.sum(axis=0)
    mean = (x - np.array([s / n for s in sums])).astype(float)
    cov = mean.T @ mean / n
    values, vecs = np.linalg.eigh(cov)
    deviation = sorted((d if d < 1 << 63 else None for d in (int(((n * row - sums) ** 2).sum()) for row in x)), key=repr)
    for c in range(1, min(k, len(sums)) + 1):
        mine = [r for r in got if r["component"] == c]
        e = values[-c]
        assert len(mine) == n and sorted((r["deviation"] for r in mine), key=repr) == deviation
        assert all(r["n"] == n and abs(r["explained"] - e / np.trace(cov)) < 1e-6 and r["identity_error"] < 1e-6 for r in mine)
        want = np.sort(mean @ vecs[:, -c] / math.sqrt(e))
        have = np.sort([r["whitened"] for r in mine])
        assert np.allclose(have, want, atol=1e-6) or np.allclose(have, np.sort(-want), atol=1e-6)


@pytest.mark.parametrize("at_once", [7, 4096])
def test_whitening_is_that_of_plain_numbers(spark, monkeypatch, at_once):
    monkeypatch.setattr(whitening, "AT_ONCE", at_once)
    rows = some(120, 12)
    got = whitening.whitened(clashing(table(spark, rows + [(505, [0.5] * 4, 0), *ODD[:5]]))).collect()
    check_white(got, rows)
    one = {r["component"]: r["whitened"] for r in got if r["vec_id"] == 5}
    again = {r["component"]: r["whitened"] for r in whitening.whitened(table(spark, rows).repartition(5)).collect() if r["vec_id"] == 5}
    assert all(abs(one[c] - again[c]) < 1e-9 for c in one) and len(one) == 8


def test_covariance_is_exact_where_longs_end(spark):
    rows = [(i, [(-1) ** i * 1e30, float(i), 0.5 * i], 0) for i in range(6)]
    df = whitening.whitened(table(spark, rows)).collect()
    check_white(df, rows, 1)
    huge = spark.createDataFrame([((1 << 61) * (-1) ** i, 1 << 40) for i in range(4)], "x0 long, x1 long")
    n, sums, matrix, most = whitening.covariance(huge, ["x0", "x1"])
    assert (n, sums) == (4, [0, 1 << 42]) and matrix.tolist() == [[float(1 << 122), 0.0], [0.0, 0.0]] and most == 1 << 63


def test_whitening_without_variance(spark):
    got = whitening.whitened(table(spark, [(i, [1.0, float(i), 2.0], 0) for i in range(5)])).collect()
    assert len(got) == 15 and {(r["component"], r["whitened"] is None, r["explained"] > 0) for r in got} == {(1, False, True), (2, True, False), (3, True, False)}
    assert all(r["identity_error"] < 1e-9 for r in got)
    got = whitening.whitened(table(spark, [(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)])).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    assert whitening.whitened(table(spark, ODD[:5])).count() == whitening.whitened(table(spark, [])).count() == 0
