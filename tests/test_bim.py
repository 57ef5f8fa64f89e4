"""Derived tables of a small raw bundle."""

import pytest
from pyspark.sql import functions as F

from packgraph.operators import bim


@pytest.fixture(scope="module")
def raw(spark):
    make = spark.createDataFrame
    return {
        "elements": make([(1, "Column C1", "Structural Columns", "FamilyInstance", 0), (2, "Thing", None, "X", None)], "element_id long, name string, category string, class_name string, row int"),
        "materials": make([(7, "Concrete C30", "Concrete")], "material_id long, name string, material_class string"),
        "quantities": make([(1, 1, "Area", "20 m2", None, 10.0, None), (2, 9, "Volume", "3 m³", None, None, 3.0)], "quantity_id long, element_id long, parameter string, display string, area_m2 double, area_ft2 double, volume_m3 double"),
        "schedule_cells": make([(5, 0, 0, "Doors"), (5, 1, 1, "Name"), (5, 1, 0, "No"), (5, 2, 0, "1"), (5, 2, 1, "D1")], "schedule_id long, row int, column int, text string"),
        "graph_edges": make([("1", "2", "hosts"), ("1", "3", "hosts")], "source string, target string, relation string"),
    }


def test_derived_tables(raw):
    out = bim.build_derived(raw)
    objects = {r["element_id"]: r for r in out["bim_objects"].collect()}
    assert objects[1]["label"] == "core_bim_object" and objects[2]["label"] == "unknown_element" and objects[1]["source_ref"]["row"] == "0" and "row" not in objects[2]["source_ref"]
    assert out["material_facts"].first()["label"] == "concrete_mortar_masonry"
    facts = {r["quantity_id"]: r for r in out["quantity_facts"].collect()}
    assert abs(facts[1]["area_m2"] - 0.9290304) < 1e-9 and facts[1]["measure"] == "area" and facts[1]["category"] == "Structural Columns"
    assert facts[2]["measure"] == "volume" and facts[2]["category"] is None
    assert {r["row"]: (r["row_text"], r["role"]) for r in out["schedule_rows"].collect()} == {0: ("Doors", "column_header"), 1: ("No | Name", "column_header"), 2: ("1 | D1", "data_row")}
    assert {r["target"]: r["resolved"] for r in out["relationships"].collect()} == {"2": True, "3": False}
    decided = {(r["source_file"], r["source_id"]): r["review_required"] for r in out["classification_decisions"].collect()}
    assert decided == {("elements.jsonl", "1"): False, ("elements.jsonl", "2"): True, ("materials.jsonl", "7"): False, ("quantities.jsonl", "1"): False, ("quantities.jsonl", "2"): False}
    assert {r["key"]: r["status"] for r in out["source_coverage"].collect()} == {"elements:1": "mapped", "elements:2": "classified_only", "materials:7": "mapped", "quantities:1": "mapped", "quantities:2": "mapped"}
    assert bim.project_profile(raw).filter("counter = 'elements_by_category' AND key = '(blank)'").first()["n"] == 1
    assert len(out) == 10 and out["drawing_evidence"].count() == 0


def test_materials_and_quantities_by_name_and_type(spark, raw):
    names = [("Default", "Generic"), ("##Default Wall", "wall"), ("DEFAULT", None), ("Default Wall 2", "x"), ("Glass", "Hidden line"), ("Clear glass", None), (None, None)]
    rows = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "material_id long, name string, material_class string")
    got = [r["label"] for r in bim.material_facts(rows).orderBy("material_id").collect()]
    assert got == ["default_or_hidden"] * 3 + ["metal", "default_or_hidden", "glass", "unclassified_material"]
    quantities = raw["quantities"].withColumn("record_type", F.when(F.col("quantity_id") == 1, "element_material_quantity"))
    decided = {r["source_id"]: r["label"] for r in bim.build_derived({**raw, "quantities": quantities})["classification_decisions"].filter("source_file = 'quantities.jsonl'").collect()}
    assert decided == {"1": "material_area_volume", "2": "volume"}


def test_drawings_and_schedules(spark, raw):
    more = {
        "sheets": spark.createDataFrame([(3, "A-101", "1F Floor Plan"), (4, "A-000", "표지")], "sheet_id long, sheet_number string, name string"), "schedules": spark.createDataFrame([(5, "Door finish", "No")], "schedule_id long, name string, fields string"),
        "sheet_pdfs": spark.createDataFrame([("n1", "A-101", "Plan", "/x/a.pdf", "a.pdf", "exported")], bim.OPTIONAL["sheet_pdfs"]),
        "drawing_entities": spark.createDataFrame([("k1", "text", "room", "Office", "a.dxf", "A-101", "v", None)], bim.OPTIONAL["drawing_entities"]),
    }
    out = bim.build_derived({**raw, **more})
    assert {r["sheet_id"]: r["drawing_category"] for r in out["drawing_documents"].collect()} == {3: "core_drawing_sheet", 4: "document_admin_sheet"}
    named = {**raw, "schedules": spark.createDataFrame([(5, "Doors", "No")], "schedule_id long, name string, fields string")}
    assert [r["role"] for r in bim.build_derived(named)["schedule_rows"].orderBy("row").collect()] == ["schedule_title", "column_header", "data_row"]
    assert [(r["schedule_category"], r["rows"], r["cells"]) for r in out["schedule_tables"].collect()] == [("finish_schedule", 3, 5)]
    assert {(r["derived_id"], r["importance"]) for r in out["drawing_evidence"].collect()} == {("drawing_evidence:drawing_entities:k1", "medium"), ("drawing_evidence:sheet_pdfs:n1", "high")}
    assert len({r["counter"] for r in bim.project_profile({**raw, **more}).collect()}) == 14


def test_quality_and_groups(spark):
    nodes = spark.createDataFrame([("1",), ("2",)], "id string")
    edges = spark.createDataFrame([("e", "1", "2", "r"), ("f", "1", "9", "r")], "id string, source string, target string, relation string")
    r = bim.pack_quality(nodes, edges, spark.createDataFrame([("1",)], "node_id string"), cap=2).first()
    assert (r["nodes"], r["edges"], r["broken_edges"], r["nodes_without_evidence"], r["capped"]) == (2, 2, 1, 1, True)
    e = spark.createDataFrame([("1-05-ST", "IFCDOOR", "t"), ("Shared Grids", "IFCWALLSTANDARD", "u")], "workset string, ifc_type string, type_name string")
    assert [x["k"] for x in e.select(bim.module_kind(F.col("workset")).alias("k")).collect()] == ["module", "non_module_workset"]
    assert {x["workset"]: x["doors"] for x in bim.storey_groups(e, ["workset"]).collect()} == {"1-05-ST": 1, "Shared Grids": 0}
