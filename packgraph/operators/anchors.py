"""Source anchors: where a fact comes from, with what confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions import texts as X
from packgraph.operators.fields import Resolver


def _anchor(kind: str, source: str, ids: dict[str, Column], confidence: Column) -> Column:
    pairs = F.map_filter(F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    return F.struct(F.lit(kind).alias("anchor_type"), F.lit(source).alias("source_kind"), pairs.alias("ids"), confidence.alias("confidence"))


def _sure(*needed: Column) -> Column:
    out = F.lit(True)
    for c in needed:
        out = out & c.isNotNull()
    return F.when(out, "exact").otherwise("partial")


def anchors(df: DataFrame, properties: str | None = None) -> Column:
    """The anchors of a row in the order of detectors, each once; one unknown anchor if there are none. Zeros are values."""
    r = Resolver(df, properties)
    v = lambda n: F.nullif(r(n).value, F.lit(""))
    found = [
        (v("element_id").isNotNull() | v("unique_id").isNotNull(), _anchor("revit_element", "revit", {"element_id": v("element_id"), "unique_id": v("unique_id")}, _sure(v("element_id"), v("unique_id")))),
        (v("source_sheet").isNotNull(), _anchor("boq_sheet_row", "boq", {"sheet": v("source_sheet"), "row": v("source_row")}, _sure(v("source_row")))),
        (v("sheet_id").isNotNull(), _anchor("revit_sheet", "revit", {"sheet_id": v("sheet_id"), "sheet_number": v("sheet_number")}, _sure(v("sheet_id")))),
        (v("view_id").isNotNull(), _anchor("revit_view", "revit", {"view_id": v("view_id")}, _sure(v("view_id")))),
        (v("schedule_id").isNotNull(), _anchor("revit_schedule_row", "revit", {"schedule_id": v("schedule_id"), "row": v("row")}, _sure(v("row")))),
        (F.lower(v("dxf_file_name")).endswith(".dxf"), _anchor("dxf_entity", "dxf", {"file": v("dxf_file_name"), "handle": v("handle")}, _sure(v("handle")))),
        (F.lower(v("pdf_file_name")).endswith(".pdf"), _anchor("pdf_page", "pdf", {"file": v("pdf_file_name"), "page": v("page")}, _sure(v("page")))),
    ]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), a) for c, a in found]))
    unknown = F.array(_anchor("unknown", "unknown", {"none": F.lit(None).cast("string")}, F.lit("unresolvable")))
    return F.when(F.size(listed) > 0, listed).otherwise(unknown)


def status(found: Column) -> Column:
    """exact if one anchor is, else partial if one is, else unresolvable."""
    has = lambda c: F.exists(found, lambda a: a["confidence"] == c)
    return F.when(has("exact"), "exact").when(has("partial"), "partial").otherwise("unresolvable")


def coverage(rows: DataFrame, keys: list[str], state: Column) -> DataFrame:
    """Counts, rates and the gate (pass from 0.8, warn above 0, else fail) of each key."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(state == "exact").alias("exact"), F.count_if(state == "partial").alias("partial"))
    out = out.withColumn("resolvable", F.col("exact") + F.col("partial")).withColumn("resolvable_rate", F.round(F.col("resolvable") / F.col("total"), 4)).withColumn("exact_rate", F.round(F.col("exact") / F.col("total"), 4))
    return out.withColumn("gate", F.when(F.col("resolvable_rate") >= 0.8, "pass").when(F.col("resolvable_rate") > 0, "warn").otherwise("fail"))


#: Where a node's id names an element, sheet or view (fixed values).
NODE_IDS = (("revit_element", "element_id", r"(?i)element:([0-9]+)"), ("revit_sheet", "sheet_id", r"(?i)sheet:([0-9]+)"), ("revit_view", "view_id", r"(?i)view:([0-9]+)"))
TABLE_ANCHORS = 20  # of a text's tables


def node_id_anchors(node_id: Column, source_file: Column) -> Column:
    """A partial anchor for what a source node's id names, as an array."""
    found = [F.when(node_id.rlike(p), _anchor(kind, "revit", {key: F.regexp_extract(node_id, p, 1), "source_file": source_file}, F.lit("partial"))) for kind, key, p in NODE_IDS]
    return F.array_compact(F.array(*found))


def reference_anchors(refs: Column) -> Column:
    """Anchors of source references (an array of structs of source_file, source_id, source_node_id and page), in order, each
    once: what the node id names, else a page of a PDF."""

    def of(ref: Column) -> Column:
        pdf = F.when(F.lower(ref["source_file"]).endswith(".pdf"), F.array(_anchor("pdf_page", "pdf", {"source_file": ref["source_file"], "page": ref["page"]}, _sure(ref["page"]))))
        named = node_id_anchors(ref["source_node_id"], ref["source_file"])
        return F.when(F.size(named) > 0, named).otherwise(F.coalesce(pdf, F.slice(named, 1, 0)))

    return _once(F.flatten(F.transform(refs, of)))


def _once(found: Column) -> Column:
    """Anchors without repeats; maps can't be compared, so they are told apart by their entries."""
    marked = F.transform(found, lambda a: F.to_json(a))
    return F.filter(found, lambda a, i: F.array_position(marked, F.to_json(a)) == i + 1)


def table_anchors(text: Column, document: Column) -> Column:
    """Elements that Markdown tables with an element id column name, at most TABLE_ANCHORS of a text, all partial. A row without
    any number ends its table, rows of another length are left out."""
    rows = X.table_cells(F.split(text, r"\r?\n"))
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\s_]", "")
    is_head = lambda r: F.exists(r, lambda c: F.contains(bare(c), F.lit("elementid")))
    start = F.struct(F.array().cast("array<string>").alias("head"), F.array().cast("array<struct<element_id:string,ifc_guid:string>>").alias("out"))
    at = lambda head, names: F.array_position(F.transform(head, lambda c: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: bare(c) == n)), True)

    def step(acc: Column, row: Column) -> Column:
        cell = lambda names: F.when(at(acc["head"], names) > 0, F.try_element_at(row, at(acc["head"], names).cast("int")))
        element = F.nullif(F.regexp_extract(cell(["revitelementid", "elementid"]), r"^\s*([0-9]+)\s*$", 1), F.lit(""))
        fits = (F.size(acc["head"]) > 0) & (F.size(row) == F.size(acc["head"]))
        plain = ~F.exists(row, lambda c: c.rlike(r"^\s*[+-]?[0-9]+\s*$"))
        head = F.when(is_head(row), row).when(fits & plain, F.array().cast("array<string>")).otherwise(acc["head"])
        new = F.struct(element.alias("element_id"), F.nullif(cell(["ifcguid", "guid"]), F.lit("")).alias("ifc_guid"))
        out = F.when(~is_head(row) & fits & element.isNotNull() & (F.size(acc["out"]) < TABLE_ANCHORS), F.array_append(acc["out"], new)).otherwise(acc["out"])
        return F.struct(head.alias("head"), out.alias("out"))

    found = F.aggregate(rows, start, step, lambda acc: acc["out"])
    return _once(F.transform(found, lambda e: _anchor("revit_element", "revit", {"element_id": e["element_id"], "ifc_guid": e["ifc_guid"], "source_path": document}, F.lit("partial"))))


def open_hint(anchor: Column, document: Column | None = None) -> Column:
    """How a person opens what an anchor names. The sentences are the contract of the service (fixed values)."""
    doc = document if document is not None else F.lit(None).cast("string")
    v = lambda k: F.nullif(F.try_element_at(anchor["ids"], F.lit(k)), F.lit(""))
    or_ = lambda *c: F.coalesce(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    row = F.coalesce(F.concat(F.lit("row "), v("row")), F.lit("행 미상"))
    place = F.concat(F.coalesce(F.concat(v("section"), F.lit(" > ")), F.lit("")), row, F.coalesce(F.concat(F.lit(", cell "), v("cell")), F.lit("")))
    kind = anchor["anchor_type"]
    return (
        F.when((kind == "revit_element") & v("unique_id").isNotNull(), F.concat(F.lit("Revit > Add-in > UniqueId로 선택: "), v("unique_id")))
        .when((kind == "revit_element") & v("element_id").isNotNull(), F.concat(F.lit("Revit > 관리 > ID로 선택: "), v("element_id")))
        .when(kind == "revit_element", "Revit > 요소 앵커는 있으나 선택 ID가 없습니다.")
        .when(kind == "revit_sheet", F.concat(F.lit("Revit > 시트 열기: "), or_(v("sheet_number"), v("sheet_id"), doc, "알 수 없음")))
        .when(kind == "revit_view", F.concat(F.lit("Revit > 뷰 열기: "), or_(v("view_name"), v("view_id"), doc, "알 수 없음")))
        .when(kind == "revit_schedule_row", F.concat(F.lit("Revit > 일람표 확인: "), or_(v("schedule_name"), doc, "일람표 미상"), F.lit(" > "), place))
        .when(kind == "boq_sheet_row", F.concat(F.lit("BOQ/산출근거 > "), or_(v("sheet"), doc, "시트 미상"), F.lit(" > row "), or_(v("row"), "미상")))
        .when(kind == "dxf_entity", F.concat(F.lit("DXF > "), or_(v("file"), doc, "파일 미상"), F.coalesce(F.concat(F.lit(" > entity "), v("handle")), F.lit("")), F.coalesce(F.concat(F.lit(" > layer "), v("layer")), F.lit(""))))
        .when(kind == "pdf_page", F.concat(F.lit("PDF > "), or_(v("file"), v("source_file"), doc, "파일 미상"), F.lit(" > page "), or_(v("page"), "미상")))
        .otherwise("원본 앵커 없음: 원본 파일/행/요소로 되돌아갈 수 있는 식별자가 부족합니다.")
    )
