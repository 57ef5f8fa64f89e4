"""Derived tables of a raw building export, and groupings of IFC elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions.scalars import short_id, square_metres
from packgraph.operators import derive as D
from packgraph.operators import join as J
from packgraph.operators import rules as RU
from packgraph.operators import suite as SU
from packgraph.operators.dealing import distinct

#: Columns that name where a row comes from, in the order they are shown (fixed values).
REFERENCE_FIELDS = ("element_id", "unique_id", "ifc_guid", "sheet_id", "sheet_number", "view_id", "view_name", "schedule_id", "schedule_name", "section", "row", "column", "page", "dxf_file_name", "entity_key", "handle", "entity_type")
#: What a quantity measures by the unit of its display text (fixed values).
MEASURES = (("m²|m2|㎡", "area"), ("m³|m3", "volume"), ("mm|cm|m", "length"))


def source_ref(source_file: str, key: str, columns: list[str]) -> Column:
    """A map of where a row comes from: file, id, and those reference fields that it has; zeros are kept, empties dropped."""
    pairs = [F.lit("source_file"), F.lit(source_file), F.lit("source_id"), F.col(key).cast("string")]
    for c in REFERENCE_FIELDS:
        if c in columns:
            pairs += [F.lit(c), F.nullif(F.col(c).cast("string"), F.lit(""))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def bim_objects(elements: DataFrame) -> DataFrame:
    """One classified object for each raw element."""
    c = RU.classified("element", *_element_text())
    ref = source_ref("elements.jsonl", "element_id", elements.columns)
    return elements.withColumn("c", c).select(short_id(F.lit("object"), F.col("element_id")).alias("object_id"), "element_id", "name", "category", F.col("c.label").alias("label"), F.col("c.importance").alias("importance"), F.col("c.confidence").alias("confidence"), ref.alias("source_ref"))


def _element_text() -> list[Column]:
    return [F.col("category"), F.col("name"), F.col("class_name")]


def material_facts(materials: DataFrame) -> DataFrame:
    c = RU.material_kind(F.col("name"), F.col("material_class"))
    return materials.withColumn("c", c).select(short_id(F.lit("material"), F.col("material_id")).alias("fact_id"), "material_id", "name", F.col("c.label").alias("label"), F.col("c.confidence").alias("confidence"))


def drawing_documents(sheets: DataFrame) -> DataFrame:
    """One classified document for each sheet (sheet_id, sheet_number, name)."""
    c = RU.classified("sheet", F.col("sheet_number"), F.col("name"))
    return sheets.withColumn("c", c).select(short_id(F.lit("sheet"), F.col("sheet_id")).alias("document_id"), "sheet_id", "sheet_number", "name", F.col("c.label").alias("drawing_category"), F.col("c.importance").alias("importance"), F.col("c.confidence").alias("confidence"))


def schedule_tables(schedules: DataFrame, cells: DataFrame) -> DataFrame:
    """One classified table for each schedule (schedule_id, name, fields as text) with its numbers of rows and cells."""
    c = RU.classified("schedule", F.col("name"), F.col("fields"))
    sizes = cells.groupBy("schedule_id").agg(F.countDistinct("row").alias("rows"), F.count(F.lit(1)).alias("cells"))
    out = schedules.withColumn("c", c).join(sizes, "schedule_id", "left").fillna(0, ["rows", "cells"])
    return out.select("schedule_id", "name", F.col("c.label").alias("schedule_category"), F.col("c.importance").alias("importance"), F.col("c.confidence").alias("confidence"), "rows", "cells")


def decided(rows: DataFrame, source: str, key: str, verdict: Column) -> DataFrame:
    """One decision for each raw row from its classification; review is asked for below a confidence."""
    c = rows.select(F.lit(source).alias("source_file"), F.col(key).cast("string").alias("source_id"), verdict.alias("c"))
    return c.select("source_file", "source_id", "c.label", "c.decision", "c.confidence", (F.col("c.confidence") < D.REVIEW_BELOW).alias("review_required"))


def quantity_facts(quantities: DataFrame, elements: DataFrame) -> DataFrame:
    """Quantities in square and cubic metres with their element's category and name. An area in square feet is converted
    where no metric one is given."""
    measure = F.lit("other")
    for pattern, kind in reversed(MEASURES):
        measure = F.when(F.col("display").rlike(rf"[0-9]\s*(?:{pattern})\s*$"), kind).otherwise(measure)
    rows = quantities.select("quantity_id", F.col("element_id"), "parameter", "display", square_metres(F.col("area_m2"), F.col("area_ft2")).alias("area_m2"), "volume_m3", measure.alias("measure"))
    return J.enrich(rows, "element_id", elements.withColumnRenamed("name", "element_name"), "element_id", ["category", "element_name"])


def relationships(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with hashed ids, their category and whether both ends are known nodes (column id)."""
    ids = known.select("id").distinct()
    out = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    whole = F.coalesce(F.col("s") & F.col("t"), F.lit(False))
    return out.select(short_id(F.col("source"), F.col("relation"), F.col("target")).alias("relationship_id"), "source", "target", "relation", RU.classified("relation", F.col("relation"))["label"].alias("category"), whole.alias("resolved"))


#: Raw tables of a bundle that may be absent, with the columns that are read (fixed values).
OPTIONAL = {
    "sheets": "sheet_id long, sheet_number string, name string", "schedules": "schedule_id long, name string, fields string",
    "drawing_entities": "entity_key string, entity_type string, layer string, text string, dxf_file_name string, sheet_number string, view_name string, measurement double",
    "sheet_pdfs": "node_id string, sheet_number string, sheet_name string, pdf_path string, pdf_file_name string, status string",
}


def build_derived(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The ten derived tables of a raw bundle (elements, materials, quantities, schedule_cells, graph_edges and those of OPTIONAL):
    eight kinds of facts, a decision for each raw row that is classified, and the coverage of each of these rows."""
    spark = raw["elements"].sparkSession
    raw = {**{k: spark.createDataFrame([], s) for k, s in OPTIONAL.items()}, **raw}
    if "record_type" not in raw["quantities"].columns:
        raw["quantities"] = raw["quantities"].withColumn("record_type", F.lit(None).cast("string"))
    cells = raw["schedule_cells"]
    if "schedule_name" not in cells.columns:
        cells = cells.join(raw["schedules"].select("schedule_id", F.col("name").alias("schedule_name")), "schedule_id", "left")
    facts = quantity_facts(raw["quantities"], raw["elements"])
    verdicts = {
        "elements": ("element_id", RU.classified("element", *_element_text())), "materials": ("material_id", RU.material_kind(F.col("name"), F.col("material_class"))),
        "quantities": ("quantity_id", RU.quantity_kind(F.col("record_type"), F.col("parameter"))), "sheets": ("sheet_id", RU.classified("sheet", F.col("sheet_number"), F.col("name"))), "schedules": ("schedule_id", RU.classified("schedule", F.col("name"), F.col("fields"))),
    }
    decisions, keys = None, None
    for name, (key, verdict) in verdicts.items():
        one, own = decided(raw[name], f"{name}.jsonl", key, verdict), raw[name].select(F.concat_ws(":", F.lit(name), F.col(key).cast("string")).alias("key"))
        decisions, keys = (one, own) if decisions is None else (decisions.unionByName(one), keys.unionByName(own))
    of = lambda df, name, key: df.select(F.concat_ws(":", F.lit(name), F.col(key).cast("string")).alias("made"))
    sheets, tables, materials = drawing_documents(raw["sheets"]), schedule_tables(raw["schedules"], raw["schedule_cells"]), material_facts(raw["materials"])
    made = of(facts, "elements", "element_id").unionByName(of(facts, "quantities", "quantity_id")).unionByName(of(materials, "materials", "material_id")).unionByName(of(sheets, "sheets", "sheet_id")).unionByName(of(tables, "schedules", "schedule_id"))
    judged = decisions.select(F.concat_ws(":", F.regexp_replace("source_file", r"\.jsonl$", ""), "source_id").alias("judged"))
    evidence = SU.entity_evidence(raw["drawing_entities"]).select("derived_id", "evidence_type", "text", "importance", "confidence").unionByName(SU.export_evidence(raw["sheet_pdfs"], "sheet_pdfs").select("derived_id", "evidence_type", "text", "importance", "confidence"))
    return {
        "bim_objects": bim_objects(raw["elements"]), "material_facts": materials, "quantity_facts": facts, "drawing_documents": sheets, "drawing_evidence": evidence, "schedule_tables": tables,
        "schedule_rows": D.schedule_rows(cells, "schedule_id", "row", "column", "text", "schedule_name"), "relationships": relationships(raw["graph_edges"], raw["elements"].select(F.col("element_id").cast("string").alias("id"))),
        "classification_decisions": decisions, "source_coverage": D.coverage(keys, "key", judged, "judged", made, "made"),
    }


#: What a profile of a raw bundle counts: its name, table and column (fixed values).
COUNTERS = (
    ("elements_by_category", "elements", "category"), ("elements_by_class", "elements", "class_name"), ("materials_by_class", "materials", "material_class"), ("quantities_by_parameter", "quantities", "parameter"),
    ("edges_by_relation", "graph_edges", "relation"), ("sheets_by_number", "sheets", "sheet_number"), ("schedules_by_name", "schedules", "name"), ("cells_by_schedule", "schedule_cells", "schedule_id"),
    ("entities_by_type", "drawing_entities", "entity_type"), ("entities_by_layer", "drawing_entities", "layer"), ("entities_by_file", "drawing_entities", "dxf_file_name"), ("entities_by_sheet", "drawing_entities", "sheet_number"),
    ("entities_by_view", "drawing_entities", "view_name"), ("exports_by_status", "sheet_pdfs", "status"),
)


def project_profile(raw: dict[str, DataFrame]) -> DataFrame:
    """counter, key and n: how many rows have each value of the counted columns; tables that are absent count nothing."""
    out = None
    for name, table, column in COUNTERS:
        if table in raw:
            part = raw[table].groupBy(F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("(blank)")).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("counter"), "key", "n")
            out = part if out is None else out.unionByName(part)
    return out


def pack_quality(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, cap: int = 50_000, tasks: int | None = None) -> DataFrame:
    """One row: nodes, edges, edges with an unknown end, nodes without evidence, the largest relation and whether it stands at
    the exporter's cap. ``tasks``: that find the different edges with an unknown end."""
    ids = nodes.select("id").distinct()
    known = lambda c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}"))
    ends = edges.select("id", "source", "target").join(known("source"), "source", "left").join(known("target"), "target", "left")
    broken = distinct(ends.filter("__source IS NULL OR __target IS NULL").select("id"), tasks)
    bare = ids.join(evidence.select(F.col("node_id").alias("id")).distinct(), "id", "left_anti")
    sizes = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_relation"))
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    out = one(nodes, "nodes")
    for more in (sizes, one(broken, "broken_edges"), one(bare, "nodes_without_evidence")):
        out = out.join(F.broadcast(more), F.lit(True))  # single rows
    return out.select("nodes", "edges", "broken_edges", "nodes_without_evidence", "largest_relation", (F.col("largest_relation") >= cap).alias("capped"))


def module_kind(workset: Column) -> Column:
    """What a workset's name says: a module, work on the site, neither, or nothing."""
    site = workset.startswith("현장공사분-") | (workset == "분리발주공사")
    return F.when(F.coalesce(workset, F.lit("")) == "", "missing_workset").when(workset.rlike(r"^[12]-[0-9]{2}-[A-Z]+$"), "module").when(site, "site_work").otherwise("non_module_workset")


def ifc_family(object_type: Column, name: Column) -> Column:
    """family and type of an element: the first and last part of its object type, or else its name, around colons."""
    source = F.coalesce(F.nullif(object_type, F.lit("")), F.nullif(name, F.lit("")))
    parts = F.split(source, ":")
    return F.struct(F.when(F.size(parts) >= 2, F.nullif(F.get(parts, F.lit(0)), F.lit(""))).alias("family"), F.nullif(F.element_at(parts, -1), F.lit("")).alias("type"))


def clean_material(value: Column) -> Column:
    """A material's name without marks; null for empty ones and dashes."""
    bare = F.trim(F.regexp_replace(value, "[#;]", ""))
    return F.when(F.trim(value) != "-", F.nullif(bare, F.lit("")))


def is_concrete(*texts: Column) -> Column:
    low = F.lower(F.concat_ws(" ", *texts))
    return F.contains(low, F.lit("콘크리트")) | F.contains(low, F.lit("concrete"))


def storey_groups(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Elements by module, storey, category or type with conditional counts."""
    kinds = {"doors": "IFCDOOR", "windows": "IFCWINDOW", "walls": "IFCWALL", "slabs": "IFCSLAB"}
    return elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("ifc_type").startswith(t)).alias(n) for n, t in kinds.items()], F.countDistinct("type_name").alias("types"))
