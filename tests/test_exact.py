"""Sums of any size against Python's integers, and labels near dimensions against brute force."""

import random
from decimal import ROUND_HALF_UP, Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from packgraph.operators.aggregate import aggregate

getcontext().prec = 800


def shown(x):
    text = format(x, "f")
    return (text.rstrip("0").rstrip(".") if "." in text else text).replace("-0", "0") if not x else (text.rstrip("0").rstrip(".") if "." in text else text)


@pytest.mark.parametrize("seed", range(3))
def test_sums_and_means_of_any_size(spark, seed):
    r = random.Random(seed)
    texts = [f"{r.choice('+-') if r.random() < 0.5 else ''}{r.randrange(10 ** r.randint(0, 60))}{'.' + str(r.randrange(10**14)) if r.random() < 0.4 else ''}{'e' + str(r.randint(-20, 80)) if r.random() < 0.3 else ''}" for _ in range(200)]
    texts += ["1,234.5", "M100", "nan", "", None, "1e400", "-0.00000000005", ".5"]
    rows = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "g long, q string").repartition(3)
    got = {x["g"]: x for x in aggregate(rows, None, ["g"], [{"agg": "sum", "field": "q", "as": "s"}, {"agg": "avg", "field": "q", "as": "a"}], skipped=True, exact=True).collect()}
    for g in range(4):
        own = [t for i, t in enumerate(texts) if i % 4 == g]
        numbers = []
        for t in own:
            try:
                x = Decimal((t or "x").replace(",", ""))
            except ArithmeticError:
                continue
            if x.is_finite() and abs(x) < Decimal(10) ** 350:
                numbers.append(x.quantize(Decimal(1).scaleb(-10), ROUND_HALF_UP))
        total = sum(numbers, Decimal(0))
        assert got[g]["s"] == shown(total)
        mean = (abs(total) / len(numbers)).quantize(Decimal(1).scaleb(-10), "ROUND_DOWN")
        assert got[g]["a"] == shown(mean if total >= 0 or not mean else -mean)
        assert got[g]["s_skipped"] == sum(t is not None for t in own) - len(numbers)


def test_sums_of_typed_and_open_fields(spark):
    rows = spark.createDataFrame([('{"q": 10000000000000000000000000000000000000000}', 1.5), ('{"q": 2}', -2.0), ('{"q": true}', None)], "p string, x double").withColumn("p", F.parse_json("p"))
    got = aggregate(rows, None, [], [{"agg": "sum", "field": "q", "as": "s"}, {"agg": "avg", "field": "q", "as": "a"}, {"agg": "sum", "field": "x", "as": "x"}], "p", exact=True).first()
    assert got["s"] == str(10**40 + 2) and got["a"] == str(10**40 // 2 + 1) and got["x"] == "-0.5"
    none = aggregate(rows.limit(0), None, [], [{"agg": "sum", "field": "q", "as": "s"}, {"agg": "avg", "field": "q", "as": "a"}], "p", exact=True).first()
    assert none["s"] == "0" and none["a"] is None
