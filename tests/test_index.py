"""The versioned index: publications that replace packs as a whole, faults, conflicts, going back; and labels near boxes."""

import math
import random

import pytest

from packgraph.operators import drawing
from packgraph.sources.index import Conflict, Index, Rejected


def packs(spark, content):
    """content: pack -> (documents, nodes, edges) as lists."""
    make = spark.createDataFrame
    d = [(p, path, body, i) for p, (docs, _, _) in content.items() for i, (path, body) in enumerate(docs)]
    n = [(p, i, label, k) for p, (_, nodes, _) in content.items() for k, (i, label) in enumerate(nodes)]
    e = [(p, f"{a}>{b}", a, b, k) for p, (_, _, edges) in content.items() for k, (a, b) in enumerate(edges)]
    return {
        "packs": make([(p, p.upper()) for p in content], "pack_id string, title string"), "documents": make(d, "pack_id string, path string, body string, ord int"), "nodes": make(n, "pack_id string, id string, label string, ord int"),
        "edges": make(e, "pack_id string, id string, source string, target string, ord int"),
    }


def bodies(version):
    return {(r["pack_id"], r["path"]): r["body"] for r in version.table("documents").collect()}


def test_packs_are_replaced_as_a_whole_or_not_at_all(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert index.open().number == 0 and index.open().table("nodes") is None
    first = index.publish(packs(spark, {"007": ([("a", "1"), ("b", "2"), ("a", "3")], [("x", "X")], [("x", "far")]), "q": ([("a", "q")], [], [])}))
    assert first.number == 1 and bodies(first) == {("007", "a"): "3", ("007", "b"): "2", ("q", "a"): "q"}  # of a repeated key the last
    assert [(r["source"], r["target"]) for r in first.table("edges").collect()] == [("x", "far")]
    second = index.publish(packs(spark, {"007": ([("c", "4")], [], []), "r": ([("a", "r")], [], [])}))
    assert bodies(second) == {("007", "c"): "4", ("q", "a"): "q", ("r", "a"): "r"} and second.table("nodes").count() == 0
    assert bodies(first) == {("007", "a"): "3", ("007", "b"): "2", ("q", "a"): "q"}  # a reader keeps its version
    for bad in ({"007": ([("", "no path")], [], [])}, {"s": ([], [(None, "no id")], [])}):
        with pytest.raises(Rejected):
            index.publish(packs(spark, bad))
    stray = packs(spark, {"s": ([], [], [])}) | {"nodes": packs(spark, {"t": ([], [("x", "X")], [])})["nodes"]}
    with pytest.raises(Rejected, match="unknown pack"):
        index.publish(stray)
    with pytest.raises(Rejected, match="empty"):
        index.publish(packs(spark, {"s": ([], [], [])}), lambda t: t["packs"].selectExpr("'empty' AS fault", "pack_id", "0L AS n"))
    assert index.open().number == 2 and bodies(index.open()) == bodies(second)
    assert len(list((tmp_path / "index/data").iterdir())) == 2  # what was rejected is gone


def test_going_back_removal_conflicts_and_vacuum(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    for text in ("1", "2", "3"):
        index.publish(packs(spark, {"p": ([("a", text)], [], [])}))
    back = index.roll_back(1)
    assert back.number == 4 and bodies(back) == {("p", "a"): "1"} and bodies(index.open(3)) == {("p", "a"): "3"}
    with pytest.raises(Conflict):
        index._claim(4, "other")
    assert len(index.vacuum(keep=1)) == 2 and bodies(index.open()) == {("p", "a"): "1"}
    assert index.remove(["p"]).table("documents") is None or index.open().table("documents").count() == 0
    with pytest.raises(KeyError):
        index.open(99)


@pytest.mark.parametrize("crowd", [4096, 12])
def test_labels_near_boxes_are_those_of_brute_force(spark, crowd):
    r = random.Random(crowd)
    at = lambda: (r.uniform(-50, 50), r.uniform(-50, 50)) if r.random() < 0.6 else (r.gauss(3, 0.5), r.gauss(3, 0.5))
    boxes = [(s, i, *at()) for s in ("A", "B") for i in range(60)] + [("A", 900, None, 1.0), ("B", 901, float("nan"), 1.0)]
    labels = [(s, i, *at()) for s in ("A", "B", "C") for i in range(150)] + [("A", 500 + i, 7.0, 7.0) for i in range(30)] + [("A", 999, None, None)]
    make = lambda rows, key: spark.createDataFrame(rows, f"sheet string, {key} long, x double, y double")
    got = {}
    for q in drawing.nearby_labels(make(boxes, "box_id"), make(labels, "label_id"), ["sheet"], 8.0, 5, crowd).collect():
        got[q["sheet"], q["box_id"], q["place"]] = (q["label_id"], round(q["distance"], 9))
    want = {}
    for s, i, x, y in boxes:
        if x is not None and not math.isnan(x):
            near = sorted((d, k) for t, k, a, b in labels if t == s and a is not None and (d := math.hypot(x - a, y - b)) <= 8)
            want |= {(s, i, p): (k, round(d, 9)) for p, (d, k) in enumerate(near[:5], 1)}
    assert got == want and len(got) > 200
