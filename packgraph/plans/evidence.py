"""Named queries of documents, rows, packs, anchors, rules and graph views, with the SQL that says the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions import texts as X
from packgraph.operators import anchors as AN
from packgraph.operators import bim as B
from packgraph.operators import drawing as DR
from packgraph.operators import graph as G
from packgraph.operators import lookups as L
from packgraph.operators import packs as P
from packgraph.operators import rows as RW
from packgraph.operators import rules as RU
from packgraph.operators import search as H
from packgraph.operators import steel as ST
from packgraph.operators import suite as SU
from packgraph.operators.dealing import tasks_for
from packgraph.plans.registry import _EDGES, Tables, _score_sql, big, dbl, query, spread, star_edges
from packgraph.plans.tools import Engine
from packgraph.sources import packs as SP

# --- names and numbers ----------------------------------------------------------------------------------------------------

query("name_file_parts", "SELECT p_partkey, p_brand AS scope, p_type AS category, trim(regexp_replace(p_name, '[_-]+', ' ', 'g')) AS title FROM part")(
    lambda t: t.part.select("p_partkey", X.file_parts(F.concat(F.concat_ws("__", "p_brand", "p_type", "p_name"), F.lit(".zip"))).alias("f")).select("p_partkey", "f.*")
)
query("name_project", "SELECT p_partkey, trim(regexp_replace(p_name || ' x', '\\s+', ' ', 'g')) AS name FROM part")(
    lambda t: t.part.select("p_partkey", X.project_name(F.concat(F.lit("Atlas "), "p_name", F.lit(" Evidence pack x.zip")), words=["Atlas"]).alias("name"))
)
query("name_project_stated", "SELECT p_partkey, p_brand AS name FROM part")(lambda t: t.part.select("p_partkey", X.project_name(F.col("p_name"), [F.lit(""), F.col("p_brand")]).alias("name")))
query("name_file", "SELECT p_partkey, regexp_replace(regexp_replace(p_name || '/' || p_brand, '[^0-9A-Za-z._-]+', '_', 'g'), '^[._]+|_+$', '', 'g') AS name FROM part")(
    lambda t: t.part.select("p_partkey", X.safe_file(F.concat_ws("/", "p_name", "p_brand")).alias("name"))
)
query("format_short_number", "SELECT o_orderkey, regexp_replace(regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0+$', ''), '\\.$', '') AS s FROM orders")(
    lambda t: t.orders.select("o_orderkey", X.short_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("s"))
)
query("measurement", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size * 1000.5 END::DOUBLE AS value, CASE WHEN p_size % 2 = 0 THEN 'm2' ELSE 'mm' END AS unit FROM part")(
    lambda t: t.part.select("p_partkey", X.measurement({"area_m2": F.when(F.col("p_size") % 2 == 0, dbl(F.col("p_size")))}, F.concat(F.format_number(F.col("p_size") * 1000.5, 1), F.lit(" mm"))).alias("m")).select("p_partkey", "m.*")
)
_RANGE = "lpad(CAST(({0}) AS VARCHAR), CAST(greatest(3, length(CAST(({0}) AS VARCHAR))) AS INTEGER), '0')"
query("mark_ranges", f"SELECT c_custkey, CASE WHEN c_custkey < 1 THEN 'other' ELSE {_RANGE.format('(c_custkey - 1) // 20 * 20 + 1')} || '-' || {_RANGE.format('(c_custkey - 1) // 20 * 20 + 20')} END AS mark_range FROM customer")(
    lambda t: t.customer.select("c_custkey", X.number_range(F.concat(F.lit("B"), F.col("c_custkey").cast("string"))).alias("mark_range"))
)
query("question_floors", "SELECT n_nationkey, n_nationkey AS floor, n_nationkey || '-05-ST' AS module FROM nation")(
    lambda t: t.nation.select("n_nationkey", F.concat(F.lit("weight of "), F.col("n_nationkey").cast("string"), F.lit("-05-st on floor "), F.col("n_nationkey").cast("string"), F.lit(" 층?")).alias("q"))
    .select("n_nationkey", big(F.get(X.floors(F.regexp_replace("q", "on floor ", "")), F.lit(0))).alias("floor"), F.get(X.module_ids(F.col("q")), F.lit(0)).alias("module"))
)
query("question_expanded", "SELECT n_nationkey, n_name || ' 단면 section profile section name' AS q FROM nation")(lambda t: t.nation.select("n_nationkey", X.expanded(F.concat("n_name", F.lit(" 단면"))).alias("q")))

# --- Markdown documents -------------------------------------------------------------------------------------------------------


def module_documents(t: Tables) -> DataFrame:
    """A document for each customer as a module, one for each segment's fasteners and one index of section weights."""
    lines = lambda *parts: F.concat_ws("\n", *parts)
    text = lambda c: F.col(c).cast("string")
    modules = spread(t.customer, "c_custkey").select(
        F.lit("p").alias("pack_id"), F.concat(F.lit(L.MODULES), text("c_custkey"), F.lit("-05-ST.md")).alias("path"),
        lines(F.concat(F.lit("# Module "), "c_name"), F.concat(F.lit("**요약**: "), "c_mktsegment"), F.lit("## Summary"), F.lit("| 항목 | 값 |"), F.lit("| --- | --- |"), F.concat(F.lit("| 객체 수 | "), text("c_nationkey"), F.lit(" |")), F.lit("## More"), F.concat(F.lit("assembly count: "), text("c_custkey")), F.lit("total_weight_kg: 1,250.5")).alias("body"),
    )
    row = lambda kind, standard: F.concat_ws(" | ", F.lit(f"| {kind}"), "c_mktsegment", F.lit("4"), F.lit("8.8"), F.lit(f"{standard} |"))
    fasteners = t.customer.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("pack_id"), F.lit(L.FASTENERS + "model_fasteners.md").alias("path"), lines(F.lit("bolt_quantity: 11"), F.lit("anchor_quantity: 8"), F.lit("| kind | description | quantity | grade | standard |"), F.lit("| --- | --- | --- | --- | --- |"), row("bolt", "DIN"), row("anchor", "Anchor A"), row("anchor", "Anchor A"), F.lit('```json\n{"fastener_type": "Bolt", "by_spec": [{"spec": "M8"}, {"spec": "M10"}]}\n```')).alias("body"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("| "), x["n_name"], F.lit(" | "), x["n_nationkey"].cast("string"), F.lit(" |"))), "\n")
    sections = t.nation.groupBy("n_regionkey").agg(cells.alias("rows")).select(text("n_regionkey").alias("pack_id"), F.lit(L.SECTIONS).alias("path"), lines(F.lit("## Other\n| section | kg |\n| --- | --- |\n| no | 1 |\n## All Sections\n| section | kg |\n| --- | --- |"), "rows", F.lit("| short |")).alias("body"))
    return modules.unionByName(fasteners).unionByName(sections)


query("module_documents", "SELECT c_custkey || '-05-ST' AS module_id, 'ST' AS module_type, c_mktsegment AS summary, c_custkey::DOUBLE AS assembly_count, c_nationkey::DOUBLE AS element_count, 1250.5::DOUBLE AS total_weight_kg FROM customer")(
    lambda t: L.modules(module_documents(t)).select("module_id", "module_type", "summary", "assembly_count", "element_count", "total_weight_kg")
)
query("module_document_facts", "SELECT 'documents/modules/7-05-ST.md' AS path, '7' AS assembly_count")(lambda t: L.by_stem(module_documents(t), L.MODULES, "7-05-st").select("path", F.try_element_at("facts", F.lit("assembly_count")).alias("assembly_count")))
query("fastener_documents", "SELECT DISTINCT c_mktsegment AS pack_id, 11 AS bolt_quantity, 8 AS anchor_quantity FROM customer")(lambda t: L.fastener_totals(module_documents(t)).select("pack_id", "bolt_quantity", "anchor_quantity"))
query("fastener_anchors", "SELECT DISTINCT c_mktsegment AS pack_id, c_mktsegment AS description, '8.8' AS grade, 'Anchor A' AS standard, 8 AS quantity FROM customer")(lambda t: L.anchors_by_spec(module_documents(t)))
query("fastener_bolts", "SELECT DISTINCT c_mktsegment AS pack_id, s AS spec FROM customer, (VALUES ('{\"spec\":\"M8\"}'), ('{\"spec\":\"M10\"}')) v(s)")(lambda t: L.bolts_by_spec(module_documents(t)))
query("section_weights", "SELECT CAST(n_regionkey AS VARCHAR) AS pack_id, n_name AS section, CAST(n_nationkey AS VARCHAR) AS kg FROM nation")(lambda t: L.section_weights(module_documents(t)).select("pack_id", F.try_element_at("cells", F.lit("section")).alias("section"), F.try_element_at("cells", F.lit("kg")).alias("kg")))
query("markdown_key_values", "SELECT c_custkey, 'assembly_count' AS key, CAST(c_custkey AS VARCHAR) AS value FROM customer UNION ALL SELECT c_custkey, 'total_weight_kg', '1,250.5' FROM customer")(
    lambda t: module_documents(t).filter(F.col("path").startswith(L.MODULES)).select(F.regexp_extract("path", "([0-9]+)-05", 1).cast("long").alias("c_custkey"), F.explode(X.key_values(F.col("body"))).alias("p")).select("c_custkey", "p.*")
)
query("schedule_table", """
WITH h AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS above FROM conversations)
SELECT h.conv_id, h.turn, coalesce(u.text, 'column_0') AS title, h.text AS value FROM h LEFT JOIN conversations u ON u.conv_id = h.conv_id AND u.turn = h.above AND u.text <> '' WHERE h.role <> 'user'""")(
    lambda t: L.schedule_table(t.conversations.select(F.lit("p").alias("pack_id"), F.col("conv_id").cast("string").alias("schedule_name"), F.col("turn").alias("row"), F.when(F.col("role") == "user", "column_header").otherwise("data_row").alias("role"), F.array("text").alias("texts"), F.lit("c").alias("ref")))
    .select(F.col("schedule_name").cast("long").alias("conv_id"), F.col("row").alias("turn"), F.explode("data").alias("title", "value"))
)

# --- rules -------------------------------------------------------------------------------------------------------------------


def _rules_sql(kind: str, text: str) -> str:
    cases = []
    for g in RU.GROUPS[kind]:
        tests = [f"contains({text}, '{w}')" for w in g.words] + ([f"{text} IN ({', '.join(repr(n) for n in g.names)})"] if g.names else [])
        tests += [f"regexp_matches({text}, '{g.pattern}')"] if g.pattern and "(?" not in g.pattern else []
        tests += [f"((contains({text}, '도면') OR contains({text}, 'sheet')) AND (contains({text}, '뷰') OR contains({text}, 'view')))"] if g.pattern and "(?s)" in g.pattern else []
        tests += [f"regexp_matches({text}, '^default( wall)?\\s*$')"] if g.pattern and g.pattern.startswith("^default") else []
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{g.label}|{g.importance}|{g.decision}'")
    label, importance, _, decision = RU.DEFAULTS[kind]
    return f"CASE {' '.join(cases)} ELSE '{label}|{importance}|{decision}' END"


def _said(c: Column) -> Column:
    return F.concat_ws("|", c["label"], c["importance"], c["decision"])


_NAMED = "lower(p_name || ' ' || p_type)"
for _kind in ("element", "material", "quantity", "sheet", "schedule"):
    query(f"rules_{_kind}", f"SELECT p_partkey, {_rules_sql(_kind, _NAMED)} AS said FROM part")(
        lambda t, kind=_kind: t.part.select("p_partkey", _said(RU.classified(kind, F.col("p_name"), F.col("p_type"))).alias("said"))
    )
query("rules_relation", f"WITH {_EDGES} SELECT source, target, 'unclassified_relationship|medium|keep' AS said FROM e WHERE relation <> 'has_nation' UNION ALL SELECT source, target, 'schedule_table_edge|high|keep' FROM e WHERE relation = 'has_nation'")(
    lambda t: star_edges(t).select("source", "target", _said(RU.classified("relation", F.when(F.col("relation") == "has_nation", "SCHEDULE_HAS_CELL").otherwise(F.col("relation")))).alias("said"))
)

# --- rows --------------------------------------------------------------------------------------------------------------------


def chunk_table(t: Tables) -> DataFrame:
    """A chunk for each part: measures and names in its metadata."""
    keys = F.to_json(F.struct(F.struct(F.col("p_brand").alias("family_name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("area_m2"), F.concat(F.col("p_size").cast("string"), F.lit(" mm")).alias("parameter_display")).alias("join_keys"), F.struct(F.col("p_type").alias("type_name"), F.lit("x").alias("family_name")).alias("compact_row"), F.lit("quantity").alias("evidence_type")))
    return t.part.select(F.lit("p").alias("pack_id"), F.col("p_partkey").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"), F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.parse_json(keys).alias("metadata"), F.col("p_partkey").alias("ord"))


query("chunk_rows", "SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, p_type AS text, p_brand AS family_name, p_type AS type_name, p_size::DOUBLE AS value, CASE WHEN p_size > 25 THEN 'm2' ELSE 'mm' END AS unit, p_size || ' mm' AS display FROM part")(
    lambda t: RW.chunk_rows(chunk_table(t)).select("chunk_id", "text", "family_name", "type_name", "value", "unit", "display")
)
query("payload_aliases", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS sheet_number, o_totalprice AS value, NULL::INTEGER AS missing FROM orders")(
    lambda t: RW.with_alias(t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("sheet_no"), F.col("o_totalprice").alias("value_mm")), ["o_orderkey", "sheet_number", "value", "missing"]).withColumn("missing", F.col("missing").cast("int"))
)
query("node_label_kind_size", """
SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 25 THEN '' ELSE p_name END, ''), p_type) AS label, CASE WHEN p_size > 40 THEN 'Module' WHEN p_size > 25 THEN 'Category' ELSE 'Assembly' END AS kind, CASE WHEN p_size > 40 THEN 11 ELSE 8 END AS size FROM part""")(
    lambda t: t.part.select("p_partkey", RW.node_label({"label": F.when(F.col("p_size") > 25, "").otherwise(F.col("p_name")), "module_type": F.col("p_type")}, F.lit("?")).alias("label"), RW.node_kind(F.when(F.col("p_size") > 40, "a:module:1").when(F.col("p_size") > 25, "a:1").otherwise("a:assembly:2"), category=F.lit("c")).alias("kind")).withColumn("size", RW.node_size(F.col("kind")))
)
query("row_text", "SELECT o_orderkey, 'o_custkey: ' || o_custkey || CASE WHEN o_orderpriority <> '5-LOW' THEN chr(10) || 'priority: ' || o_orderpriority ELSE '' END || chr(10) || 'o_orderstatus: ' || o_orderstatus AS text FROM orders")(
    lambda t: t.orders.withColumn("priority", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("")).select("o_orderkey", RW.row_text(["o_custkey", "priority", "o_orderstatus"]).alias("text"))
)
query("evidence_records", "SELECT CAST(n_nationkey AS VARCHAR) AS section, 'nations.jsonl' AS source_file, 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS content, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS record_hash FROM nation")(
    lambda t: RW.evidence_records(t.nation, "nations.jsonl", ["n_nationkey"], ["n_name", "n_regionkey"]).select("section", "source_file", "content", "record_hash")
)
query("dimension_lines", "SELECT p_partkey, CASE WHEN p_size > 25 THEN '폭=' || p_size || ', 높이=2.5, Zone=north' ELSE 'Length=' || p_size || ', Width=' || p_size || ', Height=2.5, Zone=north' END AS text FROM part")(
    lambda t: t.part.select("p_partkey", RW.dimension_text(F.when(F.col("p_size") > 25, "Door").otherwise("Unknown"), F.create_map(F.lit("Zone"), F.lit("north"), F.lit("Area"), F.lit("9"), F.lit("Width"), F.col("p_size").cast("string"), F.lit("Height"), F.lit("2.500"), F.lit("Length"), F.when(F.col("p_size") <= 25, F.col("p_size").cast("string")).otherwise("-"))).alias("text"))
)
query("dependency_lines", "SELECT s_suppkey, 'Host Id=' || s_nationkey || ', ' || n_name || ' / wall' AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda t: t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", RW.dependency_text(F.col("s_nationkey").cast("string"), [F.col("n_name"), F.lit(""), F.lit("wall")], F.lit("x")).alias("text"))
)
query("floor_totals", "SELECT c_nationkey AS floor, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY 1")(
    lambda t: RW.floor_totals(t.customer.select(F.concat(F.col("c_nationkey").cast("string"), F.lit("-05-ST")).alias("m"), F.col("c_acctbal").cast("decimal(18,2)").alias("total")), F.col("m"), ["total"]).select(big(F.col("floor")).alias("floor"), "n", dbl(F.col("total")).alias("total"))
)
query("line_counts", "SELECT source AS path, lang AS member, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '[\\s\\x{feff}]*')))) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")(
    lambda t: SP.line_counts(t.documents.select(F.col("source").alias("path"), F.col("lang").alias("member"), F.explode(F.split("text", "\n")).alias("line")))
)
query("json_member", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")(
    lambda t: SP.json_member(t.events.select(F.col("event_id").cast("string").alias("path"), F.lit("a.json").alias("member"), F.concat(F.lit("﻿"), "props").alias("line")), "a.json").select(F.col("path").cast("long").alias("event_id"), F.try_variant_get("value", "$.k", "int").alias("k"))
)

# --- anchors -----------------------------------------------------------------------------------------------------------------


def _refs(t: Tables) -> DataFrame:
    ref = lambda file, node, page: F.struct(F.lit(file).alias("source_file"), F.lit("1").alias("source_id"), node.alias("source_node_id"), page.alias("page"))
    none = F.lit(None).cast("string")
    node = F.concat(F.lit("revit:element:"), F.col("n_nationkey").cast("string"))
    return t.nation.select("n_nationkey", F.array(ref("a.jsonl", node, none), ref("a.jsonl", node, none), ref("b.PDF", none, F.col("n_regionkey").cast("string")), ref("c.txt", F.lit("other"), none)).alias("refs"))


query("anchor_references", "SELECT n_nationkey, 'revit_element' AS anchor_type, 'partial' AS confidence, CAST(n_nationkey AS VARCHAR) AS id FROM nation UNION ALL SELECT n_nationkey, 'pdf_page', 'exact', CAST(n_regionkey AS VARCHAR) FROM nation")(
    lambda t: _refs(t).select("n_nationkey", F.explode(AN.reference_anchors(F.col("refs"))).alias("a")).select("n_nationkey", "a.anchor_type", "a.confidence", F.coalesce(F.try_element_at("a.ids", F.lit("element_id")), F.try_element_at("a.ids", F.lit("page"))).alias("id"))
)
query("anchor_tables", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS element_id, n_name AS ifc_guid FROM nation UNION ALL SELECT n_nationkey, '7', 'g' FROM nation")(
    lambda t: t.nation.select("n_nationkey", F.explode(AN.table_anchors(F.concat(F.lit("# T\n| Revit ElementId | IFC GUID |\n| --- | --- |\n| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |\n| 7 | g |\n| 7 | g |\n| a | b |\n| 9 | lost |")), F.lit("d"))).alias("a"))
    .select("n_nationkey", F.try_element_at("a.ids", F.lit("element_id")).alias("element_id"), F.try_element_at("a.ids", F.lit("ifc_guid")).alias("ifc_guid"))
)
query("anchor_open_hint", "SELECT n_nationkey, 'PDF > b.PDF > page ' || n_regionkey AS hint FROM nation UNION ALL SELECT n_nationkey, 'Revit > 관리 > ID로 선택: ' || n_nationkey FROM nation")(
    lambda t: _refs(t).select("n_nationkey", F.explode(AN.reference_anchors(F.col("refs"))).alias("a")).select("n_nationkey", AN.open_hint(F.col("a")).alias("hint"))
)
query("source_ref", "SELECT n_nationkey, 'nations.jsonl' AS source_file, CAST(n_regionkey AS VARCHAR) AS sheet_id FROM nation")(
    lambda t: t.nation.withColumn("sheet_id", F.col("n_regionkey")).withColumn("section", F.lit("")).select("n_nationkey", B.source_ref("nations.jsonl", "n_nationkey", ["sheet_id", "section"]).alias("r")).select("n_nationkey", F.col("r")["source_file"].alias("source_file"), F.col("r")["sheet_id"].alias("sheet_id"))
)

# --- drawings -----------------------------------------------------------------------------------------------------------------

query("bbox_extracted", "SELECT vec_id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y2 FROM embeddings WHERE label % 2 = 0 UNION ALL SELECT vec_id, embedding[3]::DOUBLE, embedding[4]::DOUBLE FROM embeddings WHERE label % 2 <> 0")(
    lambda t: _extracted(t)
)


def _extracted(t: Tables) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    none = F.lit(None).cast("double")
    even = F.col("label") % 2 == 0
    corner = lambda x, y: point(F.when(even, x).otherwise(none), F.when(even, y).otherwise(none))
    box = DR.box_of(F.array(at(0)), corner(at(0), at(0)), corner(at(1), at(1)), [point(none, none), point(at(2), at(3))])
    return t.embeddings.select("vec_id", box.alias("b")).select("vec_id", "b.x1", "b.y2")


query("entity_text", "SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) || '.5' ELSE p_name END AS text FROM part")(
    lambda t: t.part.select("p_partkey", DR.entity_text(F.when(F.col("p_size") > 25, "DIMENSION").otherwise("TEXT"), (F.col("p_size") + F.lit(0.5)).cast("string"), [F.lit(None).cast("string"), F.col("p_name")]).alias("text"))
)
query("rectangle_area", "SELECT o_custkey, CASE WHEN count(*) > 1 THEN (list(v ORDER BY v DESC))[1] * (list(v ORDER BY v DESC))[2] END::DOUBLE AS area_m2 FROM (SELECT o_custkey, o_orderkey % 97 + 1 AS v FROM orders) GROUP BY 1")(
    lambda t: DR.rectangle(t.orders.select("o_custkey", dbl((F.col("o_orderkey") % 97 + 1) * 1000).alias("value_mm"), F.lit("horizontal").alias("direction"), F.lit(0.5).alias("confidence")), ["o_custkey"]).select("o_custkey", "area_m2")
)
query("entity_source", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'export' ELSE 'index' END AS source FROM orders")(
    lambda t: _entity_source(t)
)


def _entity_source(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("pack_id"), F.lit("TEXT").alias("entity_type"))
    return P.text_entities(rows.filter("pack_id = 'F'").withColumn("source", F.lit("export")), rows.withColumn("source", F.lit("index"))).select("o_orderkey", "source")


# --- packs --------------------------------------------------------------------------------------------------------------------


def pack_table(t: Tables) -> DataFrame:
    """Suppliers as packs, of which those of region 1's nations are shards of quantity facts and the first of each other nation
    says its part by a file name."""
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.concat(F.when(F.col("n_regionkey") == 1, "suite-quantity_facts-").otherwise("other-"), F.col("s_suppkey").cast("string")).alias("pack_id"), "s_suppkey", F.when(F.col("n_regionkey") == 2, "Schedule rows.zip").otherwise("x").alias("names"))
    return rows.withColumn("logical", P.logical_name(F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("pack_id"), F.col("names")))


_PACKS = "p AS (SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN 'suite-quantity_facts-' ELSE 'other-' END || s_suppkey AS pack_id, CASE WHEN n_regionkey = 1 THEN 'quantity_facts' WHEN n_regionkey = 2 THEN 'schedule_rows' ELSE '' END AS logical FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
query("pack_logical", f"WITH {_PACKS} SELECT s_suppkey, logical FROM p")(lambda t: pack_table(t).select("s_suppkey", "logical"))
query("pack_shards", f"WITH {_PACKS} SELECT pack_id FROM p WHERE logical = 'quantity_facts' UNION SELECT pack_id FROM p WHERE pack_id = 'other-1'")(
    lambda t: P.resolved(pack_table(t), "other-1", logical="quantity_facts").select("pack_id").unionByName(pack_table(t).filter("pack_id = 'other-1'").select("pack_id")).distinct()
)
query("pack_summary", "SELECT CAST(c_custkey AS VARCHAR) AS pack_id, coalesce(nullif(n, 0), nullif(c_nationkey, 0), 0) AS rows FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")(
    lambda t: P.summary(t.customer.select(F.col("c_custkey").cast("string").alias("pack_id"), F.lit(0).alias("manifest_rows"), big(F.col("c_nationkey")).alias("bim_objects")), t.orders.groupBy(F.col("o_custkey").cast("string").alias("pack_id")).agg(F.count(F.lit(1)).alias("n")))
)
query("project_ids", "SELECT p_partkey, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS project_id FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') AS s FROM part))")(
    lambda t: P.project_ids(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "project_id")
)
query("project_seeds", f"WITH {_PACKS} SELECT 'a' AS project_id, pack_id FROM p WHERE contains(pack_id, 'quantity')")(lambda t: P.seeded(pack_table(t), {"QUANTITY": "a", "nothing": "b"}, t.region.limit(0)))

# --- graph views ----------------------------------------------------------------------------------------------------------------


def _ranked(t: Tables) -> DataFrame:
    return G.degrees(star_edges(t)).select("id", F.col("id").alias("label"), F.substring_index("id", ":", 1).alias("type"), "degree")


query("visible_nodes", f"""
WITH {_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id)
SELECT id, degree, true AS forced FROM d WHERE id IN ('region:1', 'part:1') UNION ALL (SELECT id, degree, false FROM d WHERE id NOT IN ('region:1', 'part:1') AND degree >= 2 AND split_part(id, ':', 1) <> 'nation' ORDER BY degree DESC, id LIMIT 38)""")(
    lambda t: G.visible_nodes(_ranked(t), 40, 2, ["nation"], forced=t.spark.createDataFrame([("region:1",), ("part:1",)], "id string")).select("id", "degree", "forced")
)
query("graph_references", "SELECT 'a::' || n_name AS id FROM nation WHERE n_name LIKE '%A%'")(
    lambda t: G.resolve_references(t.nation.select(F.concat(F.lit("a::"), "n_name").alias("id"), F.col("n_name").alias("label"), F.lit("a").alias("pack_id"), F.lit(None).cast("string").alias("original_id"), F.col("n_nationkey").alias("ord")), "a", t.nation.filter("n_name LIKE '%A%'").select(F.col("n_name").alias("id")))
)
query("merged_references", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS refs FROM orders GROUP BY 1")(
    lambda t: G.merge_references(t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", F.array(F.col("o_orderkey").cast("string"), F.col("o_orderkey").cast("string")).alias("refs")), ["o_custkey"], "refs", "o_orderkey").select("o_custkey", F.col("o_orderstatus").alias("status"), F.array_join("refs", ",").alias("refs"))
)
query("scaffold_nodes", "SELECT 'p_brand:' || p_brand AS id, 'p_brand' AS type, CAST(min(p_partkey) AS VARCHAR) AS evidence FROM part GROUP BY p_brand UNION ALL SELECT 'p_type:' || p_type, 'p_type', CAST(min(p_partkey) AS VARCHAR) FROM part GROUP BY p_type UNION ALL SELECT 'dataset:d', 'dataset', NULL")(
    lambda t: G.scaffold(t.part, ["p_brand", "p_type"], "p_partkey", "d")[0].select("id", "type", "evidence")
)
query("scaffold_edges", "SELECT DISTINCT 'p_brand:' || p_brand AS source, 'p_type:' || p_type AS target, 'p_brand_has_p_type' AS relation FROM part UNION ALL SELECT DISTINCT 'dataset:d', 'p_brand:' || p_brand, 'has_p_brand' FROM part UNION ALL SELECT DISTINCT 'dataset:d', 'p_type:' || p_type, 'has_p_type' FROM part")(
    lambda t: G.scaffold(t.part, ["p_brand", "p_type"], "p_partkey", "d")[1]
)
query("tree_filter", """
WITH t AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent, c_acctbal < 0 AS hit FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, false FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL, false FROM region),
m AS (SELECT id, parent FROM t WHERE hit), n AS (SELECT parent AS id FROM m), r AS (SELECT parent AS id FROM t WHERE id IN (SELECT id FROM n))
SELECT id, hit AS matched FROM t WHERE hit OR id IN (SELECT id FROM n UNION SELECT id FROM r)""")(
    lambda t: _tree(t)
)


def _tree(t: Tables) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    tree = t.customer.select(name("c", "c_custkey").alias("id"), name("n", "c_nationkey").alias("parent")).unionByName(t.nation.select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent"))).unionByName(t.region.select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")))
    return G.tree_filter(tree, t.customer.filter("c_acctbal < 0").select(name("c", "c_custkey").alias("id"))).select("id", "matched")


query("local_merge", f"""
WITH {_EDGES}, ends AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e)
SELECT id, coalesce('N ' || n_name, id) AS label, n_name IS NULL AS placeholder, least(24, 4 + count(*)) AS size FROM ends LEFT JOIN nation ON id = 'nation:' || n_nationkey GROUP BY ALL""")(
    lambda t: G.merge_local([(t.nation.limit(0).select(F.lit("x").alias("id"), F.lit("x").alias("label"), F.lit("x").alias("type")), star_edges(t)), (t.nation.select(G.node_key("nation", "n_nationkey").alias("id"), F.concat(F.lit("N "), "n_name").alias("label"), F.lit("Nation").alias("type")), star_edges(t))], tasks_for(t.lineitem, 3))[0].select("id", "label", "placeholder", "size")
)

# --- tools --------------------------------------------------------------------------------------------------------------------


def engine(t: Tables) -> Engine:
    """Documents as evidence of the packs of their source; nations and regions as nodes."""
    node = lambda kind, df, key, name: df.select(F.lit("p").alias("pack_id"), G.node_key(kind, key).alias("id"), F.col(name).alias("label"), F.lit(kind.title()).alias("type"), F.parse_json(F.to_json(F.struct(F.col(key).alias("key")))).alias("properties"), F.col(key).alias("ord"))
    nodes = node("region", t.region, "r_regionkey", "r_name").unionByName(node("nation", t.nation, "n_nationkey", "n_name"))
    edges = G.edges_from(t.nation, G.node_key("region", "n_regionkey"), G.node_key("nation", "n_nationkey"), "has_nation").select(F.lit("p").alias("pack_id"), F.concat_ws(">", "source", "target").alias("id"), "source", "target", "relation", F.monotonically_increasing_id().alias("ord"))
    documents = t.documents.select(F.col("source").alias("pack_id"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.col("doc_id").alias("ord"))
    packs = t.documents.select(F.col("source").alias("pack_id")).distinct().select("pack_id", F.col("pack_id").alias("title"), F.lit("s").alias("source"), F.lit("").alias("description"))
    return Engine(nodes, edges, documents, chunk_table(t), packs)


query("tool_pack_schema", "SELECT 'Region' AS source_type, 'has_nation' AS relation, 'Nation' AS target_type, count(*) AS n FROM nation")(lambda t: engine(t).pack_schema("p"))
query("tool_ontology_manifest", "SELECT 'node_type' AS part, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node_type', 'Nation', count(*) FROM nation UNION ALL SELECT 'relation', 'has_nation', count(*) FROM nation")(lambda t: engine(t).ontology_manifest())
query("tool_source_list", "SELECT source AS pack_id, 's' AS source, count(*) AS documents, 0 AS chunks FROM documents GROUP BY 1")(lambda t: engine(t).source_list())
query("tool_node_type_list", "SELECT 'Region' AS key, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation")(lambda t: engine(t).node_type_list("p"))
query("tool_edge_list", "SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation WHERE n_regionkey = 2")(lambda t: engine(t).edge_list("p", source="region:2").select("source", "target"))
query("tool_node_context", "SELECT 'nation:' || n_nationkey AS other, n_name AS label, 'out' AS direction FROM nation WHERE n_regionkey = 3")(lambda t: engine(t).node_context("p", "region:3").select("other", "label", "direction"))
query("tool_document_list", "SELECT 'documents/' || doc_id || '.md' AS path, coalesce(length(text), 0) AS chars FROM documents")(lambda t: engine(t).document_list("", limit=1 << 30).select("path", big(F.col("chars")).alias("chars")))
query("tool_pack_overview", "SELECT source AS pack_id, 0 AS nodes, count(*) AS documents FROM documents GROUP BY 1 UNION ALL SELECT 'p', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), 0")(lambda t: engine(t).pack_overview().select("pack_id", "nodes", "documents"))
query("tool_chunk_read", "SELECT p_name AS title, p_type AS content FROM part WHERE p_partkey = 3")(lambda t: engine(t).chunk_read("p", "3").select("title", "content"))
query("node_search", "SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_nationkey IN (7, 17) UNION ALL SELECT 'region:' || r_regionkey FROM region WHERE r_regionkey IN (7, 17)")(lambda t: engine(t).node_search("p", "7", 50).select("id"))
query("search_pack", "SELECT 'documents/' || doc_id || '.md' AS ref FROM documents WHERE contains(lower(text), 'licensed') UNION ALL SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE contains(lower(p_type || p_name), 'licensed')")(
    lambda t: engine(t).evidence_search("", "licensed", 1 << 30).select("ref")
)
query("quantity_chunks", "SELECT CAST(p_partkey AS VARCHAR) AS chunk_id FROM part WHERE p_size > 25 AND p_brand = 'Brand#13'")(lambda t: engine(t).quantity_facts_query("p", {"metadata.join_keys.area_m2__gt": 25, "metadata.join_keys.family_name": "Brand#13"}, limit=None).rows.select("chunk_id"))

# --- derived tables and suites ---------------------------------------------------------------------------------------------------


def quantity_table(t: Tables) -> DataFrame:
    none = lambda k: F.lit(None).cast(k)
    by_material = F.col("l_linenumber") == 1
    return t.lineitem.select(
        F.when(by_material, "element_material_quantity").otherwise("parameter").alias("record_type"), F.col("l_orderkey").alias("element_id"), F.col("l_partkey").alias("material_id"), F.when(by_material, F.col("l_quantity")).alias("area_m2"), none("double").alias("volume_m3"),
        F.col("l_suppkey").alias("parameter_id"), F.when(F.col("l_returnflag") == "A", "면적").when(F.col("l_returnflag") == "R", "Length").otherwise("Zone").alias("parameter"), none("string").alias("built_in"), none("string").alias("data_type"), F.when(F.col("l_returnflag") == "R", "autodesk.unit.millimeters").alias("unit_type"), "l_linenumber",
    )


_ROLES = """q AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'material_area' WHEN l_returnflag = 'A' THEN 'primary_element_area' WHEN l_returnflag = 'R' THEN 'primary_element_length' ELSE 'element_parameter' END AS quantity_role,
  CASE WHEN l_linenumber = 1 THEN 'material:' || l_orderkey || ':' || l_partkey || ':area' WHEN l_returnflag = 'A' THEN 'element:' || l_orderkey || ':area' WHEN l_returnflag = 'R' THEN 'element:' || l_orderkey || ':length' ELSE 'element:' || l_orderkey || ':parameter:' || l_suppkey END AS dedup_key FROM lineitem)"""
query("quantity_roles", f"WITH {_ROLES} SELECT l_orderkey AS element_id, l_linenumber, quantity_role, dedup_key, starts_with(quantity_role, 'primary') AS is_primary_measure FROM q")(
    lambda t: SU.quantity_roles(quantity_table(t)).select("element_id", "l_linenumber", "quantity_role", "dedup_key", "is_primary_measure")
)
query("quantity_deduplicated", f"WITH {_ROLES} SELECT dedup_key, min(l_linenumber) AS l_linenumber FROM q GROUP BY 1")(lambda t: SU.deduplicated(SU.quantity_roles(quantity_table(t)), "l_linenumber").select("dedup_key", "l_linenumber"))
query("drawing_exports", "SELECT 'drawing_evidence:sheet_pdfs:' || o_orderkey AS derived_id, 'Sheet PDF ' || o_custkey || ' ' || o_orderpriority || ' status=' || CASE o_orderstatus WHEN 'F' THEN 'exported' ELSE o_orderstatus END || ' file=None' AS text, CASE o_orderstatus WHEN 'F' THEN 'high' ELSE 'low' END AS importance FROM orders")(
    lambda t: SU.export_evidence(t.orders.select(F.col("o_orderkey").cast("string").alias("node_id"), F.col("o_custkey").alias("sheet_number"), F.col("o_orderpriority").alias("sheet_name"), F.when(F.col("o_orderstatus") == "F", "exported").otherwise(F.col("o_orderstatus")).alias("status")), "sheet_pdfs").select("derived_id", "text", "importance")
)
query("drawing_entities", "SELECT 'drawing_evidence:drawing_entities:' || p_partkey AS derived_id, 'DXF ' || CASE WHEN p_size > 25 THEN 'DIMENSION' ELSE 'LINE' END || ' sheet=None view=' || p_brand || ' file=a.dxf layer=' || p_type || ' text=' || p_name AS text, CASE WHEN p_size > 25 THEN p_size::DOUBLE END AS value_mm, CASE WHEN p_size > 25 THEN 'medium' ELSE 'low' END AS importance FROM part")(
    lambda t: SU.entity_evidence(t.part.select(F.col("p_partkey").alias("entity_key"), F.when(F.col("p_size") > 25, "dimension").otherwise("line").alias("entity_type"), F.col("p_type").alias("layer"), F.col("p_name").alias("text"), F.lit("a.dxf").alias("dxf_file_name"), F.lit(None).cast("string").alias("sheet_number"), F.col("p_brand").alias("view_name"), dbl(F.col("p_size")).alias("measurement"))).select("derived_id", "text", "value_mm", "importance")
)
query("drawing_context", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.75 THEN 'high' ELSE 'medium' END AS importance, round(greatest(0.45, least(0.95, l_discount * 10)), 4)::DOUBLE AS confidence FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", SU.context_class("element_representation_links", F.col("l_discount") * 10, F.lit(None).cast("string")).alias("c")).select("l_orderkey", "l_linenumber", "c.importance", F.round("c.confidence", 4).alias("confidence"))
)
query("xml_lists", "SELECT n_nationkey, n_name || ',z' AS refs, CAST(n_regionkey AS VARCHAR) AS module_id, 'as:part:' || n_nationkey AS id FROM nation")(
    lambda t: t.nation.withColumn("m", F.create_map(F.lit("m_Refs_SIZE"), F.lit("3"), F.lit("m_Refs_0"), F.col("n_name"), F.lit("m_Refs_1"), F.lit(""), F.lit("m_Refs_2"), F.lit("z"), F.lit("m_Refs_3"), F.lit("late"), F.lit("m_UserAttributes_0"), F.col("n_regionkey").cast("string")))
    .select("n_nationkey", F.array_join(SU.listed(F.col("m"), "m_Refs"), ",").alias("refs"), SU.user_attribute(F.col("m"), "module_id").alias("module_id"), SU.object_id("part", F.col("n_nationkey")).alias("id"))
)
query("user_views", "SELECT 'view:brand:' || replace(p_brand, ' ', '_') AS view_id, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS p_size FROM part GROUP BY p_brand UNION ALL SELECT 'view:brand_type:' || replace(p_brand, ' ', '_') || ':' || replace(p_type, ' ', '_'), count(*), CAST(sum(p_size) AS BIGINT) FROM part GROUP BY p_brand, p_type")(
    lambda t: SU.user_views(t.part, {"brand": ["p_brand"], "brand_type": ["p_brand", "p_type"]}, ["p_size"]).select("view_id", "n", "p_size")
)
query("suite_shards", """
WITH s AS (SELECT c_mktsegment, count(*) AS n, ceil(count(*) / 64.0) AS slices FROM customer GROUP BY 1),
b AS (SELECT c_mktsegment, coalesce(sum(slices) OVER (ORDER BY n DESC, c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
p AS (SELECT c_custkey, c_mktsegment, CAST(start + (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 64 AS INTEGER) AS shard FROM customer JOIN b USING (c_mktsegment))
SELECT 'bim_objects-' || lpad(CAST(shard AS VARCHAR), 4, '0') || '-' || c_mktsegment AS pack_id, count(*) AS rows FROM p GROUP BY 1""")(
    lambda t: SU.manifest(SU.suite(t.customer, "bim_objects.jsonl", "c_mktsegment", ["c_custkey"], 64), ["c_custkey"]).select("pack_id", "rows")
)
query("combined_pack", "SELECT 'nation:' || n_nationkey AS node_id, 'nation' AS type, 1 AS evidence FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', 1 FROM region")(
    lambda t: SU.combined({"nation": t.nation.withColumn("key", F.col("n_nationkey")), "region": t.region.withColumn("key", F.col("r_regionkey"))}, ["key"])[0].select("node_id", "type", big(F.size("evidence_ids")).alias("evidence"))
)
query("shape_faults", f"WITH {_EDGES}, n AS (SELECT 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1) SELECT 'repeated_id' AS fault, id, count(*) AS n FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown_end', id, count(*) FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) WHERE id NOT IN (SELECT id FROM n) GROUP BY id")(
    lambda t: SU.shape_faults(t.nation.unionByName(t.nation.filter("n_regionkey = 1")).select(G.node_key("nation", "n_nationkey").alias("id")), star_edges(t))
)

# --- tools over elements and entities ---------------------------------------------------------------------------------------------


def elements(t: Tables) -> Engine:
    """Parts as elements of modules and vectors as drawing entities."""
    props = F.parse_json(F.to_json(F.struct(F.concat(F.col("p_size").cast("string"), F.lit("-05-ST")).alias("module_type"), F.col("p_type").alias("item_name"), F.col("p_size").alias("quantity"), F.col("p_brand").alias("unit"), F.col("p_partkey").alias("source_row"), F.col("p_partkey").alias("source_element_id"))))
    nodes = t.part.select(F.lit("p").alias("pack_id"), G.node_key("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("Element").alias("type"), props.alias("properties"), F.col("p_partkey").alias("ord"))
    edges = nodes.limit(0).select("pack_id", "id", F.col("id").alias("source"), F.col("id").alias("target"), F.lit("r").alias("relation"), "ord")
    x = lambda i: dbl(F.get("embedding", F.lit(i)))
    entities = t.embeddings.select(F.lit("p").alias("pack_id"), F.col("vec_id").alias("ord"), F.when(F.col("label") % 2 == 0, "TEXT").otherwise("LINE").alias("entity_type"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("layer"), F.concat(F.lit("room "), F.col("label").cast("string")).alias("text"), F.lit("A-1").alias("sheet_no"), F.lit("v").alias("view_name"), F.lit("a.dxf").alias("source_file"), DR.box(x(0), x(1), x(2), x(3)).alias("bbox"))
    return Engine(nodes, edges, entities=entities)


query("tool_project_modules", "SELECT p_size || '-05-ST' AS module_id, 'module_type' AS sources, count(*) AS n FROM part GROUP BY 1")(lambda t: elements(t).list_project_modules("p").withColumn("sources", F.array_join("sources", ",")))
query("tool_module_elements", "SELECT 'part:' || p_partkey AS id FROM part WHERE p_size = 7")(lambda t: elements(t).list_module_elements("p", "7-05-ST", fields=["id"], limit=None))
query("tool_quantity_by_module", "SELECT p_size || '-05-ST' AS module_type, sum(p_size)::DOUBLE AS total, count(*) AS n FROM part GROUP BY p_size")(lambda t: elements(t).aggregate_quantity_by_module("p").select("module_type", dbl(F.col("total")).alias("total"), "n"))
query("tool_quantity_evidence", "SELECT p_brand AS unit, sum(p_size)::DOUBLE AS quantity_sum, count(*) AS row_count FROM part WHERE contains(p_type, 'SMALL') GROUP BY 1")(
    lambda t: elements(t).query_quantity_evidence("p", include_item_regex="SMALL", group_by=["unit"]).select("unit", dbl(F.col("quantity_sum")).alias("quantity_sum"), "row_count")
)
query("tool_filtered_nodes", "SELECT 'part:' || p_partkey AS id, p_size::VARCHAR AS quantity FROM part WHERE p_size >= 20 AND p_type LIKE '%SMALL%'")(
    lambda t: elements(t).filtered_search_nodes("p", "element", {"quantity__gte": 20, "item_name__contains": "small"}, ["id", "quantity"], limit=None).rows
)
query("tool_distinct_values", "SELECT DISTINCT p_brand AS value FROM part")(lambda t: elements(t).distinct_property_values("p", "unit").select("value"))
query("tool_entity_search", "SELECT vec_id AS ord FROM embeddings WHERE label % 2 = 0 AND contains('l' || label, '4')")(lambda t: elements(t).dxf_entity_search("p", entity_type=["text"], layer="4", limit=1 << 30).select("ord"))
query("tool_text_search", "SELECT vec_id AS ord FROM embeddings WHERE label % 2 = 0 AND contains(CAST(label AS VARCHAR), '4')")(lambda t: elements(t).dxf_text_search("p", "4", limit=1 << 30).select("ord"))
query("tool_bbox_query", "SELECT vec_id AS ord FROM embeddings WHERE least(embedding[1], embedding[3])::DOUBLE >= -0.2 AND greatest(embedding[1], embedding[3])::DOUBLE <= 0.2 AND least(embedding[2], embedding[4])::DOUBLE >= -0.2 AND greatest(embedding[2], embedding[4])::DOUBLE <= 0.2")(
    lambda t: elements(t).dxf_bbox_query("p", (-0.2, -0.2, 0.2, 0.2), "within", limit=1 << 30).select("ord")
)
query("tool_drawing_text", "SELECT CAST(vec_id AS VARCHAR) AS ref, 1.2 * 1.5 + 5 + 2 AS score FROM embeddings WHERE label % 2 = 0 AND contains(CAST(label AS VARCHAR), '4') AND NOT contains(CAST(label AS VARCHAR), '44')")(
    lambda t: elements(t).drawing_text_search("p", "4", limit=1 << 30).filter("NOT contains(text, '44')").select("ref", F.round("score", 4).alias("score"))
)
query("tool_entity_summary", "SELECT 'layer' AS facet, 'L' || label AS value, count(*) AS n FROM embeddings GROUP BY label")(lambda t: elements(t).dxf_entity_summary("p").filter("facet = 'layer'"))
query("tool_graph_get", "SELECT id FROM (SELECT 'nation:' || n_nationkey AS id, 0 AS o, n_name AS l FROM nation UNION ALL SELECT 'region:' || r_regionkey, 1, r_name FROM region) ORDER BY o, l, id LIMIT 27")(lambda t: engine(t).graph_get("p", 27, 100)[0].select("id"))
query("tool_document_read", "SELECT substr(text, 1, 40) AS content, length(text) > 40 AS truncated FROM documents WHERE doc_id = 5")(lambda t: engine(t).document_read("", "documents/5.md", 40).select("content", "truncated"))
query("tool_project_search", f"SELECT source AS pack_id, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY round({_score_sql('lower(text)', ['licensed'])}, 6) DESC, doc_id) AS place FROM documents WHERE contains(lower(text), 'licensed')) WHERE place <= 3")(
    lambda t: replace(engine(t), chunks=None).project_search("", "licensed").select("pack_id", F.regexp_extract("ref", "([0-9]+)", 1).cast("long").alias("doc_id"), big(F.col("place")).alias("place"))
)


# --- sections and materials ----------------------------------------------------------------------------------------------------------

query("profile_groups", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'C-Channel' WHEN p_size < 20 THEN 'H-Beam' WHEN p_size < 30 THEN 'Angle' WHEN p_size < 40 THEN 'Tube' END AS profile,
  CASE WHEN p_size < 10 THEN 3 WHEN p_size < 20 THEN 3 WHEN p_size < 30 THEN 3 WHEN p_size < 40 THEN 3 ELSE 0 END AS names FROM part""")(
    lambda t: t.part.select("p_partkey", ST.profile_group(F.when(F.col("p_size").between(10, 19), F.concat(F.lit("H "), "p_name")).when(F.col("p_size") >= 30, F.concat(F.when(F.col("p_size") < 40, "Q").otherwise("x"), "p_name")), F.when(F.col("p_size") < 10, "Korea C-Channels").when(F.col("p_size").between(20, 29), "Equal Angle 3")).alias("profile"))
    .withColumn("names", F.size(ST.profile_names(F.col("profile"))))
)
query("ifc_families", "SELECT p_partkey, p_brand AS family, p_name AS type, p_type AS material, contains(lower(p_type), 'concrete') AS concrete FROM part")(
    lambda t: t.part.select("p_partkey", B.ifc_family(F.concat_ws(":", "p_brand", F.lit("x"), "p_name"), F.lit(None).cast("string")).alias("f"), B.clean_material(F.concat(F.lit("#"), "p_type", F.lit(" ;"))).alias("material"), B.is_concrete(F.col("p_type")).alias("concrete")).select("p_partkey", "f.*", "material", "concrete")
)
query("merge_aliases", "SELECT 'a::' || n_name AS id, n_name AS original_id FROM nation UNION ALL SELECT 'b::' || r_name, r_name FROM region")(
    lambda t: G.merge_packs({"old": t.nation.select(F.col("n_name").alias("id")), "a": t.nation.select(F.col("n_name").alias("id")), "b": t.region.select(F.col("r_name").alias("id"))}, {"old": "a"}).select("id", "original_id")
)

query("tool_node_list", "SELECT 'nation:' || n_nationkey AS id, n_name AS label FROM nation")(lambda t: engine(t).node_list("p", "Nation", 1 << 30).select("id", "label"))
query("tool_relation_type_list", "SELECT 'has_nation' AS key, count(*) AS n FROM nation")(lambda t: engine(t).relation_type_list("p"))
query("tool_aggregate_nodes", "SELECT p_brand AS unit, sum(p_size)::DOUBLE AS quantity, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1")(
    lambda t: elements(t).aggregate_nodes("p", "Element", {"quantity__gt": 10}, ["unit"], [{"agg": "sum", "field": "quantity", "as": "quantity"}, {"agg": "count", "as": "n"}], limit=None).rows.select("unit", dbl(F.col("quantity")).alias("quantity"), "n")
)
query("tool_dxf_layer_summary", "SELECT 'L' || label AS layer, count(*) AS n FROM embeddings GROUP BY 1")(lambda t: elements(t).dxf_layer_summary("p").select("layer", "n"))
query("tool_pack_list", "SELECT DISTINCT source AS pack_id, source AS title FROM documents")(lambda t: engine(t).pack_list().select("pack_id", "title"))
