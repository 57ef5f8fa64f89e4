"""Archives, STEP text, streams, anchors and search goldens."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from packgraph.functions import scalars as S
from packgraph.operators import anchors, graph, search
from packgraph.sources import ingest, packs, step, tables
from packgraph.streaming import incremental


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_pack_members(spark, tmp_path):
    lines = "\n".join(["", "not json", "[]", "null", json.dumps({"chunk_id": "c1", "content": "Beam\n evidence", "title": "Detail", "document_id": "d1"}), json.dumps({"id": "alias", "text": "beam", "heading": "H"}), json.dumps({"text": "anonymous"})])
    nodes = "\n".join(json.dumps(x) for x in (None, {}, {"id": None}, {"id": "a", "labels": ["Beam", "Element"]}))
    edges = json.dumps({"source": {"id": "a"}, "target": "b", "relation": "has"})
    archive(tmp_path / "demo.zip", {"documents/Beam.md": "﻿BOM", "chunks.jsonl": lines, "graph/nodes.jsonl": nodes, "graph/edges.jsonl": edges})
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    got = packs.members(spark, str(tmp_path))
    assert packs.documents(got).first()["body"] == "BOM"
    assert {(r["chunk_id"], r["title"]) for r in packs.chunks(got).collect()} == {("c1", "Detail"), ("alias", "H"), ("chunks.jsonl#7", "Evidence chunk")}
    assert [(r["id"], r["type"]) for r in packs.nodes(got).collect()] == [("a", "Beam")]
    assert [(r["source"], r["target"]) for r in packs.edges(got).collect()] == [("a", "b")]
    assert packs.missing_members(got, ["manifest.json"]).count() == 1
    assert packs.pack_files(spark, str(tmp_path)).count() == 2


def test_step(spark, tmp_path):
    text = "#1=IFCWALL('gid',$,'A ''b'' \\X2\\AC15\\X0\\',(#2,#3),.T.);\n#4=IFCPROPERTYSINGLEVALUE('Width',$,IFCLENGTHMEASURE(200.),$);\n#5=IFCPROPERTYSET('g',$,'Pset',$,(#4));\n#6=IFCRELDEFINESBYPROPERTIES('g',$,$,$,(#1),#5);\nHEADER;\n"
    (tmp_path / "m.ifc").write_text(text)
    rows = step.instances(spark, str(tmp_path / "m.ifc"))
    wall = rows.filter("id = 1").select("args", "refs", step.scalar(F.col("args")[2]).alias("name"), step.scalar(F.col("args")[4]).alias("flag")).first()
    assert wall["args"][3] == "(#2,#3)" and wall["refs"] == [2, 3] and wall["name"] == "A 'b' 강" and wall["flag"] == "true"
    assert step.property_sets(rows).collect() == [(1, "Pset", "Width", "200.")]


def test_step_instances_over_several_lines(spark, tmp_path):
    text = "#1=IFCWALL('a;b',\n  $,('x;y'),\n#2); #2=IFCDOOR('long " + "z" * 9000 + "',((((1.,2.))))\n);\n#3=IFCSLAB($);\r\nDATA;\n"
    (tmp_path / "m.ifc").write_bytes(text.encode())
    rows = {r["id"]: r for r in step.instances(spark, str(tmp_path / "m.ifc")).collect()}
    assert {i: r["type"] for i, r in rows.items()} == {1: "IFCWALL", 2: "IFCDOOR", 3: "IFCSLAB"}
    assert rows[1]["args"] == ["'a;b'", "$", "('x;y')", "#2"] and rows[1]["refs"] == [2] and len(rows[2]["args"]) == 2


def test_numbers_in_order(spark):
    from packgraph.operators.numbering import numbered

    rows = spark.range(500).selectExpr("id % 3 AS g", "if(id % 50 = 0, NULL, (id * 37) % 200) AS x", "id AS y", "string(id) AS s")
    for order in (["x", "y"], ["s"], ["y"]):
        got = numbered(rows, ["g"], order, "at", bins=7).collect()
        for g in range(3):
            some = sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])
            assert [r["at"] for r in some] == list(range(len(some)))
            keys = [tuple((r[o] is not None, r[o]) for o in order) for r in some]
            assert keys == sorted(keys, key=lambda k: tuple((a, b if a else 0) for a, b in k))


def test_budget_hands_unused_slots_on(spark):
    rows = spark.createDataFrame([(p, i) for p, n in (("a", 2), ("b", 9), ("c", 9)) for i in range(n)], "pack string, i int")
    got = graph.budget(rows, "pack", ["i"], 11, 3).groupBy("pack").count().collect()
    assert {r["pack"]: r["count"] for r in got} == {"a": 2, "b": 5, "c": 4}


def test_search_scores(spark):
    df = spark.createDataFrame([("Beam\t evidence beam",), ("other",)], "t string")
    assert search.query_terms("The beam 강재 7") == ["beam", "강재", "7"]
    assert search.query_terms("the please 설명") == ["설명"]  # a stop word as a pair of syllables is a term
    assert search.expand("모듈 3층") == "모듈 3층 module modules module_id module_type documents/modules 3- 3F 3층"
    found = search.search(df, F.col("t"), "beam", None, ["t"]).collect()
    assert len(found) == 1 and abs(found[0]["score"] - (1 + 0.4 * 3) * 1.4 * 1.5) < 1e-9
    one = search.snippet(F.lit("x" * 150 + "BEAM" + "y" * 300), ["beam"])
    assert df.select(one).first()[0] == "x" * 120 + "BEAM" + "y" * 256


def test_anchors(spark):
    rows = spark.createDataFrame([(1, '{"element_id":5,"unique_id":"u"}'), (2, '{"source_sheet":"S","source_row":0}'), (3, '{"pdf_file_name":"a.pdf"}'), (4, "{}")], "i int, j string").withColumn("properties", F.parse_json("j"))
    got = rows.select("i", anchors.anchors(rows, "properties").alias("a")).select("i", "a", anchors.status(F.col("a")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == ["exact", "exact", "partial", "unresolvable"]
    assert got[1]["a"][0]["ids"]["row"] == "0"


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "r")], "source string, target string, relation string")
    got = graph.k_hop(edges, spark.createDataFrame([("a",)], "id string"), 3)
    assert {r["id"]: r["hop"] for r in got.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_streams_and_reindex(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"pack_id":"p","v":1}\n{"pack_id":"q","v":2}\n')
    run = lambda: incremental.index_new_files(spark, str(tmp_path / "in"), "pack_id string, v int", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text('{"pack_id":"p","v":3}\n')
    run()
    (tmp_path / "in/more").mkdir()
    (tmp_path / "in/more/a.json").write_text('{"pack_id":"p","v":4}\n')
    run()
    rows = {(r["pack_id"], r["source_file"].split("-")[0], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # A pack keeps the rows of all its files, also of those with one name in several folders.
    assert rows == {("p", "a.json", 1), ("q", "a.json", 2), ("p", "b.json", 3), ("p", "a.json", 4)}
    whole = str(tmp_path / "whole")
    for some in ([("p", 3), ("q", 2)], [("q", 9)]):
        ingest.reindex(spark.createDataFrame(some, "pack_id string, v int"), whole)
    assert {(r["pack_id"], r["v"]) for r in spark.read.parquet(whole).collect()} == {("p", 3), ("q", 9)}


def test_scalars_and_reports(spark, tmp_path):
    r = spark.range(1).select(S.safe_path(F.lit("../x")).alias("a"), S.safe_path(F.lit("documents/a.md")).alias("b"), S.redact(F.lit("key sk-abcdefghijk")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (False, True, "key sk-***")
    md = tables.markdown_report(spark.createDataFrame([("m", 2), ("m", 1)], "k string, v int"), "k", "Module", ["v"]).first()["markdown"]
    assert md == "# Module m\n\n| v |\n|---|\n| 1 |\n| 2 |"
    tables.write_graph_csv(spark.createDataFrame([("a", ["x", "y"])], "id string, labels array<string>"), spark.createDataFrame([("a", "b")], "source string, target string"), str(tmp_path / "g"))
    assert spark.read.option("header", True).csv(str(tmp_path / "g/nodes")).first()["labels"] == "x;y"
