"""The service's tools on a small graph."""

import pytest
from pyspark.sql import functions as F

from packgraph.plans.tools import Engine

NODES = [
    ("p", "a1", "Assembly A1", "Assembly", '{"module_id":"1-05-ST","weight":10}'),
    ("p", "e1", "Column 1", "Element", '{"module_type":"1-05-ST","quantity":"12 mm","item_name":"Bolt","unit":"EA","source_row":"3","code":"M1","source_element_id":"e10"}'),
    ("p", "e2", "Column 2", "Element", '{"module_type":"1-05-ST","quantity":2,"item_name":"Bolt","unit":"EA","source_row":"4","code":"M2","source_element_id":"e2"}'),
    ("p", "e3", "Beam", "Element", '{"quantity":5,"item_name":"Nut","unit":"EA","code":"M2"}'),
    ("q", "m1", "Module", "Module", '{"tags":["x","y"],"code":"M2"}'),
]
ENTITIES = [("p", 0, "TEXT", "room", "Office 12.5 m2", "A-1", 0.0, 0.0, 2.0, 1.0), ("p", 1, "DIMENSION", "dim", "3,000", "A-1", 0.0, 0.0, 9.0, 1.0), ("p", 2, "DIMENSION", "dim", "4000", "A-1", 0.0, 0.0, 1.0, 9.0), ("p", 3, "LINE", "wall", None, "A-2", 5.0, 5.0, 6.0, 6.0)]


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame([(p, i, l, t, j, k) for k, (p, i, l, t, j) in enumerate(NODES)], "pack_id string, id string, label string, type string, j string, ord long")
    edges = spark.createDataFrame([("p", "x1", "a1", "e1", "has", 0), ("p", "x2", "a1", "e2", "has", 1), ("p", "x3", "e1", "zz", "near", 2)], "pack_id string, id string, source string, target string, relation string, ord long")
    documents = spark.createDataFrame([("p", "documents/a.md", "A", "The column rests on a bolt. " * 3, 0), ("p", "../x.md", "X", "secret", 1)], "pack_id string, path string, title string, body string, ord long")
    chunks = spark.createDataFrame([("p", "one", "d", "t", "c", '{"value":20,"display":"20 m2","element_id":1,"unique_id":"u"}', 0), ("p", "two", "d", "t", "c", '{"value":10,"display":"10 m2"}', 1), ("p", "wrong", "d", "t", "c", '{"value":"M30"}', 2)], "pack_id string, chunk_id string, document_id string, title string, content string, j string, ord long")
    packs = spark.createDataFrame([("p", "Pack P", "s", "steel"), ("q", "Pack Q", "s", "wood")], "pack_id string, title string, source string, description string")
    entities = spark.createDataFrame(ENTITIES, "pack_id string, ord long, entity_type string, layer string, text string, sheet_no string, x1 double, y1 double, x2 double, y2 double").withColumn("bbox", F.struct("x1", "y1", "x2", "y2")).withColumn("source_file", F.lit("a.dxf"))
    return Engine(nodes.withColumn("properties", F.parse_json("j")).drop("j"), edges, documents, chunks.withColumn("metadata", F.parse_json("j")).drop("j"), packs, entities)


def test_filtered_search(engine):
    page = engine.filtered_search_nodes("p", "element", {"item_name": "Bolt"}, ["id", "properties.code"], "-quantity", limit=1).envelope()
    assert page["count"] == 2 and page["truncated"] and page["rows"] == [{"id": "e1", "code": "M1"}]


def test_aggregate_and_distinct(engine):
    rows = engine.aggregate_nodes("p", "Element", None, ["unit"], [{"agg": "sum", "field": "quantity", "as": "q"}]).envelope()["rows"]
    assert float(rows[0]["q"]) == 7 and rows[0]["q_skipped"] == 1
    assert [r["value"] for r in engine.distinct_property_values(["p", "q"], "tags").collect()] == ["x", "y"]


def test_join(engine):
    got = engine.join_by_property({"pack_id": "p", "join_field": "code"}, {"pack_id": "q", "join_field": "code"}, "left").collect()
    assert [(r["join_key"], r["left"]["id"], r["count"]) for r in got] == [("M1", "e1", None), ("M2", "e2", 1), ("M2", "e3", 1)]


def test_join_values(engine):
    got = engine.join_values({"pack_id": "p", "join_field": "code"}, ["item_name", "unit"]).collect()
    assert {(r["join_key"], r["field"]): r["samples"] for r in got} == {("M1", "item_name"): ["Bolt"], ("M1", "unit"): ["EA"], ("M2", "item_name"): ["Bolt", "Nut"], ("M2", "unit"): ["EA"]}


def test_graph(engine):
    nodes, edges = engine.graph_get("p", 3, 5)
    assert [r["id"] for r in nodes.collect()] == ["a1", "e3", "e1"] and [r["id"] for r in edges.collect()] == ["x1"]
    assert {(r["other"], r["direction"], r["label"]) for r in engine.node_context("p", "e1").collect()} == {("a1", "in", "Assembly A1"), ("zz", "out", None)}
    assert engine.edge_list("p", relation="HAS").count() == 2
    assert [(r["key"], r["n"]) for r in engine.relation_type_list("p").collect()] == [("has", 2), ("near", 1)]
    assert engine.node_search("p", "column").count() == 2


def test_evidence_and_documents(engine):
    assert [r["path"] for r in engine.document_list("p").collect()] == ["documents/a.md"]
    assert engine.document_read("p", "../x.md").count() == 0
    assert engine.document_read("p", "documents/a.md", 5).first()["truncated"]
    assert engine.evidence_search("p", "bolt").first()["ref"] == "documents/a.md"
    assert {r["kind"] for r in engine.question_answer("p", "column").collect()} == {"evidence", "node"}
    assert {r["kind"] for r in engine.question_answer("p", "nothing").collect()} == {"context"}
    assert engine.anchor_resolve("p", "one").first()["confidence"] == "exact"
    assert engine.anchor_coverage("p").first()["exact"] == 1
    assert engine.project_search(["p"], "bolt").count() == 1


def test_quantities_and_modules(engine):
    page = engine.quantity_facts_query("p", {"value__gte": 10, "display__contains": "m2"}, ["chunk_id"], "value", 1).envelope()
    assert page["count"] == 2 and page["rows"] == [{"chunk_id": "two"}]
    total = engine.query_quantity_evidence("p", item_name="*").first()
    assert float(total["quantity_sum"]) == 7 and total["row_count"] == 3
    by = engine.aggregate_quantity_by_module("p").collect()
    assert [(r["module_type"], float(r["total"]), r["n"]) for r in by] == [("1-05-ST", 14.0, 2)]
    assert [(r["module_id"], r["sources"], r["n"]) for r in engine.list_project_modules("p").collect()] == [("1-05-ST", ["module_id", "module_type"], 3)]
    assert [r["id"] for r in engine.list_module_elements("p", "1-05-ST", fields=["id"]).collect()][:2] == ["e2", "e1"]


def test_drawings(engine):
    assert engine.dxf_text_search("p", "office").count() == 1
    assert engine.dxf_dimension_search("p", sheet_no="a-1").count() == 2
    assert [r["ord"] for r in engine.dxf_bbox_query("p", (4, 4, 7, 7), "within").collect()] == [3]
    assert engine.room_area_tag_extract("p").first()["area"] == 12.5
    assert engine.area_from_dimensions_calculate("p").first()["area_m2"] == 12.0
    assert {(r["value"], r["n"]) for r in engine.dxf_entity_summary("p").filter("facet = 'layer'").collect()} == {("room", 1), ("dim", 2), ("wall", 1)}
    assert engine.drawing_text_search("p", "office").first()["score"] > 5


def test_scope_of_a_principal(spark, engine):
    from dataclasses import replace

    seen = replace(engine, access=spark.createDataFrame([("x", "q")], "principal string, pack_id string"), principal="x")
    assert [r["pack_id"] for r in seen.pack_list().collect()] == ["q"] and seen.node_list("p").count() == 0
    assert engine.pack_search("steel").first()["pack_id"] == "p" and engine.pack_overview().count() == 2


def test_projects(spark, engine):
    got = engine.project_pack_list(spark.createDataFrame([("q", "pr")], "pack_id string, project_id string")).collect()
    assert [(r["pack_id"], r["project_id"]) for r in got] == [("q", "pr"), ("p", None)]
    f = lambda rows: spark.createDataFrame(rows, "folder_id string, name string")
    states = {r["folder_id"]: r["state"] for r in engine.reconcile(f([("1", "a"), ("2", "b"), ("3", "c")]), f([("1", "a"), ("2", "B2"), ("4", "d"), ("5", "D")])).collect()}
    assert states == {"1": "unchanged", "2": "renamed", "3": "deleted", "4": "conflict", "5": "conflict"}


@pytest.fixture(scope="module")
def documented(spark, engine):
    from dataclasses import replace

    body = "# M\n**요약**: one\n## Summary\n| 항목 | 값 |\n|---|---|\n| 객체 수 | 12 |\n## End\ntotal weight kg: 5\nmodule_type: ST\n"
    docs = [("p", "documents/modules/1-05-ST.md", "m", body, 0), ("p", "documents/assembly_marks/A1.md", "a", "kg: 7", 1), ("p", "documents/section_weight_index.md", "s", "## All Sections\n| section | kg |\n|---|---|\n| H100 | 3 |\n", 2)]
    meta = ['{"join_keys":{"schedule_name":"Doors"},"compact_row":{"row":1,"row_role":"column_header","values":[{"text":"No"},{"text":"Name"}]}}', '{"join_keys":{"schedule_name":"Doors"},"compact_row":{"row":2,"row_role":"data_row","values":[{"text":"1"},{"text":"D1"}]}}', '{"join_keys":{"schedule_name":"Doors"},"compact_row":{"row":3,"row_role":"data_row","values":[{"text":"x"}]}}']
    chunks = spark.createDataFrame([("p", f"s{i}", "d", "t", "c", m, i) for i, m in enumerate(meta)], "pack_id string, chunk_id string, document_id string, title string, content string, j string, ord long")
    return replace(engine, documents=spark.createDataFrame(docs, "pack_id string, path string, title string, body string, ord long"), chunks=chunks.withColumn("metadata", F.parse_json("j")).drop("j"))


def test_documents_that_hold_facts(engine, documented):
    found = documented.module_list("p").first()
    assert (found["module_id"], found["module_type"], found["summary"], found["element_count"]) == ("1-05-ST", "ST", "one", 12.0)
    assert [r["module_id"] for r in engine.module_list("p").collect()] == ["1-05-ST"]  # named by elements, without documents
    got = documented.module_get("p", "1-05-st", 5).first()
    assert (got["kind"], got["content"], got["truncated"], got["facts"]["total_weight_kg"]) == ("document", "# M\n*", True, "5")
    assert {r["kind"] for r in documented.module_get("p", "column").collect()} == {"evidence", "node"}
    assert [r["mark"] for r in documented.assembly_list("p").collect()] == ["A1"] and documented.assembly_get("p", "a1").first()["facts"] == {"kg": "7"}
    assert documented.section_weight_index("p").first()["cells"] == {"section": "H100", "kg": "3"}
    assert [t.count() for t in documented.fastener_summary("p")] == [0, 0, 0]
    assert [r["data"] for r in documented.schedule_table_extract("p", "door").collect()] == [{"No": "1", "Name": "D1"}, {"column_0": "x"}]


def test_catalogue_of_tools(spark, engine):
    names = {t["name"] for t in engine.tool_manifest()}
    assert {"server_status", "tool_manifest", "module_get", "evidence_trace", "graph_get"} <= names and not any(n.startswith("_") for n in names)
    status = {r["name"]: r["n"] for r in engine.server_status().collect()}
    assert status["nodes"] == 5 and status["tools"] == len(names)
    assert {(r["source_type"], r["relation"], r["target_type"], r["n"]) for r in engine.pack_schema("p").collect()} == {("Assembly", "has", "Element", 2), ("Element", "near", None, 1)}
    assert [(r["pack_id"], r["documents"], r["chunks"]) for r in engine.source_list().collect()] == [("p", 2, 3), ("q", 0, 0)]
    assert {r["kind"] for r in engine.evidence_trace("p", "column", include_answer=True).collect()} == {"evidence", "node", "edge", "answer"}
    links = spark.createDataFrame([("x", "p"), ("x", "none")], "project_id string, pack_id string")
    projects = spark.createDataFrame([("x", "X"), ("y", "Y")], "project_id string, name string")
    assert [(r["project_id"], r["packs"]) for r in engine.project_list(projects, links).collect()] == [("x", 1), ("y", 0)]
    assert [r["pack_id"] for r in engine.project_overview("x", links).collect()] == ["p"]


def test_drawing_text_of_chunks(engine):
    found = engine.drawing_text_search("p", "c").collect()
    assert {r["kind"] for r in found} <= {"chunk", "entity"}


def test_module_elements_query_has_no_limit(spark, tmp_path):
    from packgraph.plans.catalogue import QUERIES

    spark.range(5100).selectExpr("id AS p_partkey", "'n' AS p_name", "'t' AS p_type", "'b' AS p_brand", "7 AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, [0.0] * 4, 1)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["tool_module_elements"](spark, str(tmp_path)).count() == 5100
