"""Tables that a building export is derived into, beyond its elements: quantity roles, drawings and their evidence, objects of
an XML model, and the packs that the tables are cut into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions.scalars import short_id
from packgraph.functions.texts import safe_file
from packgraph.operators import derive as D
from packgraph.operators import rows as RW
from packgraph.operators import rules as RU

#: What a quantity parameter measures: part of its data type, part of its unit, its built-in name, parts of its name, in order
#: (fixed values).
MEASURE_SIGNS = (("area", "area", "square", "HOST_AREA_COMPUTED", ("면적",)), ("volume", "volume", "cubic", "HOST_VOLUME_COMPUTED", ("체적",)), ("length", "length", "millimeters", None, ("길이", "높이")))
#: Drawing exports by file: the evidence's type, its path and file name columns (fixed values).
EXPORTS = {"sheet_pdfs": ("sheet_pdf", "pdf_path", "pdf_file_name"), "sheet_dxfs": ("sheet_dxf", "dxf_path", "dxf_file_name"), "view_dxfs": ("view_dxf", "dxf_path", "dxf_file_name")}
#: Files of drawing context with the category and the confidence of their rows (fixed values).
CONTEXTS = {
    "element_representation_index": ("drawing_element_representation_index", 0.9), "remaining_revit_elements": ("drawing_unmatched_revit_element", 0.82),
    "semantic_only_revit_elements": ("drawing_semantic_only_revit_element", 0.86), "element_topology_groups": ("drawing_element_topology_group", 0.82),
}
#: Module columns of an XML object's user attributes (fixed values).
USER_ATTRIBUTES = {"module_id": 0, "module_type": 1}


# --- quantities ------------------------------------------------------------------------------------------------------------


def measure_kind(data_type: Column, unit_type: Column, built_in: Column, name: Column) -> Column:
    """area, volume, length or null for a quantity parameter."""
    has = lambda c, part: F.coalesce(F.contains(F.lower(c), F.lit(part)), F.lit(False))
    out = F.lit(None).cast("string")
    for kind, data, unit, known, words in reversed(MEASURE_SIGNS):
        test = has(data_type, data) | has(unit_type, unit)
        test = test | F.coalesce(built_in == known, F.lit(False)) if known else test
        for w in words:
            test = test | has(name, w)
        out = F.when(test, kind).otherwise(out)
    return out


def quantity_roles(rows: DataFrame) -> DataFrame:
    """Quantities (record_type, element_id, material_id, area_m2, volume_m3, parameter_id, parameter, built_in, data_type,
    unit_type) with measure_kind, aggregation_scope, quantity_role, is_primary_measure, dedup_key and dedup_precedence."""
    material = F.coalesce(F.col("record_type") == "element_material_quantity", F.lit(False))
    of_material = F.when(F.col("area_m2").isNotNull(), "area").when(F.col("volume_m3").isNotNull(), "volume").otherwise("material_quantity")
    of_parameter = F.coalesce(measure_kind(F.col("data_type"), F.col("unit_type"), F.col("built_in"), F.col("parameter")), RU.classified("quantity", F.col("parameter"))["label"])
    rows = rows.withColumn("measure_kind", F.when(material, of_material).otherwise(of_parameter))
    named = lambda built_in, name: F.coalesce(F.col("built_in") == built_in, F.lit(False)) | F.coalesce(F.col("parameter") == name, F.lit(False))
    length = (F.col("measure_kind") == "length") & F.col("parameter").isin("길이", "Length")
    key = lambda *parts: F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts])
    e = F.col("element_id")
    made = lambda role, dedup, precedence: F.struct(role.alias("role"), dedup.alias("key"), F.lit(precedence).alias("precedence"))
    role = (
        F.when(material, made(F.concat(F.lit("material_"), "measure_kind"), key("material", e, F.col("material_id"), F.col("measure_kind")), 60))
        .when(named("HOST_AREA_COMPUTED", "면적"), made(F.lit("primary_element_area"), key("element", e, "area"), 100))
        .when(named("HOST_VOLUME_COMPUTED", "체적"), made(F.lit("primary_element_volume"), key("element", e, "volume"), 100))
        .when(length, made(F.lit("primary_element_length"), key("element", e, "length"), 90))
        .otherwise(made(F.lit("element_parameter"), key("element", e, "parameter", F.coalesce(F.col("parameter_id").cast("string"), F.col("parameter"))), 40))
    )
    rows = rows.withColumn("__r", role).withColumn("aggregation_scope", F.when(material, "material").otherwise("element"))
    return rows.select("*", F.col("__r.role").alias("quantity_role"), F.col("__r.role").startswith("primary_").alias("is_primary_measure"), F.col("__r.key").alias("dedup_key"), F.col("__r.precedence").alias("dedup_precedence")).drop("__r")


def deduplicated(quantities: DataFrame, tie: str) -> DataFrame:
    """Of quantities of one dedup_key the one of highest precedence, then of least ``tie``."""
    return D.precedence(quantities, "dedup_key", [F.col("dedup_precedence").desc(), F.col(tie)])


# --- drawings ----------------------------------------------------------------------------------------------------------------


def export_evidence(rows: DataFrame, source: str) -> DataFrame:
    """One evidence row for each exported sheet or view: derived_id, evidence_type, text, status, file_path, file_name,
    importance, confidence and source_ref."""
    kind, path, file = EXPORTS[source]
    col = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    status = F.coalesce(F.nullif(col("status"), F.lit("")), F.lit("unknown"))
    shown = lambda c: F.coalesce(col(c), F.lit("None"))
    what = F.concat(F.lit("View DXF "), shown("view_name"), F.lit(" ("), shown("view_type"), F.lit(")")) if kind == "view_dxf" else F.concat(F.lit("Sheet PDF " if kind == "sheet_pdf" else "Sheet DXF "), shown("sheet_number"), F.lit(" "), shown("sheet_name"))
    text = F.concat(what, F.lit(" status="), status, F.lit(" file="), shown(file))
    sure = status == "exported"
    name = F.concat(F.lit(f"drawing_evidence:{source}:"), F.coalesce(col("node_id"), short_id(*[F.col(c) for c in sorted(rows.columns)])))
    return rows.select(name.alias("derived_id"), F.lit(kind).alias("evidence_type"), text.alias("text"), status.alias("status"), col(path).alias("file_path"), col(file).alias("file_name"), col("sheet_number").alias("sheet_number"), col("view_name").alias("view_name"), F.when(sure, "high").otherwise("low").alias("importance"), F.when(sure, 0.9).otherwise(0.35).alias("confidence"), RW.compact(rows.columns).alias("source_ref"))


def entity_evidence(rows: DataFrame) -> DataFrame:
    """One evidence row for each drawing entity (entity_key, entity_type, layer, text, dxf_file_name, sheet_number, view_name,
    measurement): texts and dimensions count more than lines."""
    kind = F.upper(F.coalesce("entity_type", F.lit("UNKNOWN")))
    typed = kind.isin("TEXT", "MTEXT", "DIMENSION")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    text = F.trim(F.concat(F.lit("DXF "), kind, F.lit(" sheet="), shown("sheet_number"), F.lit(" view="), shown("view_name"), F.lit(" file="), shown("dxf_file_name"), F.lit(" layer="), shown("layer"), F.lit(" text="), F.coalesce("text", F.lit(""))))
    value = F.when(kind == "DIMENSION", F.col("measurement"))
    name = F.concat(F.lit("drawing_evidence:drawing_entities:"), F.coalesce(F.col("entity_key").cast("string"), short_id(*[F.col(c) for c in sorted(rows.columns)])))
    return rows.select(name.alias("derived_id"), F.lit("dxf_entity").alias("evidence_type"), text.alias("text"), F.col("text").alias("raw_text"), kind.alias("entity_type"), "layer", "dxf_file_name", "sheet_number", "view_name", value.alias("value_mm"), F.when(value.isNotNull(), "mm").alias("unit"), F.when(typed, "medium").otherwise("low").alias("importance"), F.when(typed, 0.84).otherwise(0.7).alias("confidence"))


def context_class(source: str, confidence: Column, priority: Column) -> Column:
    """label, importance and confidence of a row of drawing context."""
    made = lambda label, importance, sure: F.struct(F.lit(label).alias("label"), importance.alias("importance"), sure.cast("double").alias("confidence"))
    if source == "element_representation_links":
        c = F.coalesce(confidence, F.lit(0.0))
        return made("drawing_element_representation_link", F.when(c >= 0.75, "high").otherwise("medium"), F.greatest(F.lit(0.45), F.least(F.lit(0.95), c)))
    label, sure = CONTEXTS.get(source, ("drawing_element_topology_group_member", 0.78))
    if source == "element_representation_index":
        importance = F.lit("high")
    elif source in ("remaining_revit_elements", "element_topology_groups"):
        importance = F.when(F.coalesce(priority, F.lit("")).startswith("high"), "high").otherwise("medium")
    else:
        importance = F.lit("medium")
    return made(label, importance, F.lit(sure))


# --- XML objects --------------------------------------------------------------------------------------------------------------


def listed(fields: Column, prefix: str) -> Column:
    """Values of an object's numbered fields (a map of text): prefix_0 up to the number in prefix_SIZE; missing ones left out."""
    size = F.coalesce(F.try_element_at(fields, F.lit(f"{prefix}_SIZE")).try_cast("int"), F.lit(0))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, lambda i: F.try_element_at(fields, F.concat(F.lit(f"{prefix}_"), i.cast("string")))), lambda v: F.coalesce(v != "", F.lit(False)))


def user_attribute(fields: Column, name: str) -> Column:
    """module_id or module_type of an object, from its first two user attributes; null if it is empty."""
    return F.nullif(F.trim(F.try_element_at(fields, F.lit(f"m_UserAttributes_{USER_ATTRIBUTES[name]}"))), F.lit(""))


def object_id(prefix: str, raw: Column) -> Column:
    return F.concat(F.lit(f"as:{prefix}:"), raw.cast("string"))


def view_id(prefix: str, *parts: Column) -> Column:
    """A stable id of a view over some values, blank for empty ones; separators inside values become dashes."""
    safe = lambda p: F.replace(F.regexp_replace(F.trim(F.coalesce(F.nullif(p.cast("string"), F.lit("")), F.lit("blank"))), r"[:/\\]", "-"), F.lit(" "), F.lit("_"))
    return F.concat(F.lit(f"view:{prefix}:"), F.concat_ws(":", *[safe(p) for p in parts]))


def user_views(parts: DataFrame, views: dict[str, Sequence[str]], measures: Sequence[str]) -> DataFrame:
    """Totals of parts by the columns of each view, in one table: view_id, view, n and the sums. Each view is one aggregation."""
    out = None
    for name, keys in views.items():
        sums = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures])
        one = sums.select(view_id(name, *[F.col(k) for k in keys]).alias("view_id"), F.lit(name).alias("view"), "n", *measures)
        out = one if out is None else out.unionByName(one)
    return out


# --- packs ---------------------------------------------------------------------------------------------------------------------


def suite(rows: DataFrame, source_file: str, split: str, order: Sequence[str], most: int = 30_000) -> DataFrame:
    """Rows with the pack that each goes to: groups of the split column, largest first, cut into shards of at most so many rows."""
    named = rows.withColumn("__split", F.coalesce(F.nullif(F.trim(F.col(split).cast("string")), F.lit("")), F.lit("unclassified")))
    placed = D.sharded_by_size(named, "__split", order, most)
    pack = F.concat(F.lit(source_file.removesuffix(".jsonl") + "-"), F.lpad(F.col("shard").cast("string"), 4, "0"), F.lit("-"), safe_file(F.col("__split")))
    return placed.withColumn("pack_id", pack).drop("__split")


def digest(columns: Sequence[str]) -> Column:
    """An aggregate: a checksum of a table's rows in any order. Rows' hashes are added up, so that equal rows don't cancel; nulls
    and where they stand count."""
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in columns])
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), nulls, *columns).cast("decimal(38,0)"))
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total(1).cast("string"), total(2).cast("string")), 256)


def manifest(placed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """pack_id, rows and digest of each pack; the digest is the same whatever the order of rows, and tells repeated rows."""
    return placed.groupBy("pack_id").agg(F.count(F.lit(1)).alias("rows"), digest(columns).alias("digest"))


def write_suite(placed: DataFrame, path: str) -> None:
    """A folder of JSON lines for each pack, written by the executors; what was there before is replaced."""
    placed.write.mode("overwrite").partitionBy("pack_id").json(path)


def combined(tables: dict[str, DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and the evidence registry of several derived tables as one pack: node_id, type and the evidence of each row; equal
    evidence is registered once with the nodes that it stands for."""
    nodes, evidence = None, None
    for name, rows in tables.items():
        columns = sorted(rows.columns)
        made = RW.evidence_records(rows, f"{name}.jsonl", keys, columns).withColumn("node_id", F.concat(F.lit(f"{name}:"), "section"))
        n = made.select("node_id", F.lit(name).alias("type"), "evidence_id")
        e = made.select("evidence_id", "source_file", "section", "content", "node_id")
        nodes, evidence = (n, e) if nodes is None else (nodes.unionByName(n), evidence.unionByName(e))
    registry = evidence.groupBy("evidence_id").agg(F.first("source_file").alias("source_file"), F.first("section").alias("section"), F.first("content").alias("content"), F.array_sort(F.collect_set("node_id")).alias("node_ids"))
    return nodes.groupBy("node_id", "type").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids")), registry


def shape_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What is wrong with a graph pack: fault, id and n for nodes without an id, ids that repeat, and ends without a node."""
    none = nodes.filter("id IS NULL").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("node_without_id").alias("fault"), F.lit(None).cast("string").alias("id"), "n")
    twice = nodes.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_id").alias("fault"), "id", "n")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    loose = ends.join(nodes.select("id").distinct(), "id", "left_anti").select(F.lit("unknown_end").alias("fault"), "id", "n")
    return none.unionByName(twice).unionByName(loose)
