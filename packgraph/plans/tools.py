"""The tools of the evidence-graph service as methods over tables; each gives a DataFrame, or a page of one with counts.

Nodes: pack_id, id, label, type, properties (VARIANT), ord. Edges: pack_id, id, source, target, relation, ord. Documents:
pack_id, path, title, body, ord. Chunks: pack_id, chunk_id, document_id, title, content, metadata (VARIANT), ord. Packs:
pack_id, title, source, description. Entities: pack_id, entity_type, layer, text, sheet_no, view_name, source_file, bbox.
A principal sees the packs that the access table gives them, all if there is none.
"""

from __future__ import annotations

import inspect
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.functions import scalars as S
from packgraph.operators import aggregate as A
from packgraph.operators import anchors as AN
from packgraph.operators import drawing as DR
from packgraph.operators import graph as G
from packgraph.operators import join as J
from packgraph.operators import lookups as L
from packgraph.operators import ordering as O
from packgraph.operators import profile as P
from packgraph.operators import rollup as R
from packgraph.operators import search as H
from packgraph.operators.fields import Resolver
from packgraph.operators.where import InvalidQuery, compile_where

#: Chunk fields that stand for the first of several that exists (fixed values).
CHUNK_ALIASES = {"category": ["metadata.category", "metadata.quantity_category", "metadata.category_name", "metadata.element_category", "metadata.evidence_type"]}
#: Fields of an element that can name its module (fixed values).
MODULE_FIELDS = ("module_id", "module", "module_type", "workset_module", "assembly_module")


#: Node types in the order in which a search prefers them (fixed values).
TYPE_RANKS = ("Module", "Assembly", "SinglePart", "Document")


@dataclass
class Page:
    """Rows of a page with how many there are before paging."""

    rows: DataFrame
    all_rows: DataFrame
    limit: int | None
    offset: int = 0

    def envelope(self) -> dict[str, Any]:
        """count (before paging), truncated and the rows: two jobs, and only the page comes to the driver."""
        count = self.all_rows.count()
        _, truncated = O.clamp_count(count, self.limit, self.offset)
        return {"count": count, "rows": [r.asDict(recursive=True) for r in self.rows.collect()], "truncated": truncated}


@dataclass
class Engine:
    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame | None = None
    chunks: DataFrame | None = None
    packs: DataFrame | None = None
    entities: DataFrame | None = None
    access: DataFrame | None = None  # principal, pack_id
    principal: str | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    # --- scopes ----------------------------------------------------------------------------------------------------------

    def _seen(self, table: DataFrame, pack_id: str | Sequence[str] | None = None) -> DataFrame:
        if pack_id:
            ids = [pack_id] if isinstance(pack_id, str) else list(pack_id)
            table = table.filter(F.col("pack_id").isin(ids))
        if self.access is None or self.principal is None:
            return table
        return J.visible(table, "pack_id", self.access.filter(F.col("principal") == self.principal), "pack_id")

    def _nodes(self, pack_id, node_type: str | None = None, where: Any = None) -> DataFrame:
        rows = self._seen(self.nodes, pack_id)
        if node_type:
            rows = rows.filter(F.lower("type") == node_type.lower())
        return rows.filter(compile_where(where, Resolver(rows, "properties"))) if where else rows

    # --- catalogue -----------------------------------------------------------------------------------------------------------

    def pack_list(self) -> DataFrame:
        return self._seen(self.packs).orderBy("pack_id")

    def pack_search(self, search_text: str = "", limit: int = 20) -> DataFrame:
        rows = self._seen(self.packs)
        if not H.query_terms(search_text):
            return rows.orderBy("pack_id").limit(limit)
        return H.search(rows, F.concat_ws(" ", "pack_id", "title", "source", "description"), search_text, limit, ["pack_id"])

    def pack_overview(self) -> DataFrame:
        """Nodes, edges and documents of each pack."""
        parts = [self._seen(t).groupBy("pack_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(n)) for n, t in (("nodes", self.nodes), ("edges", self.edges), ("documents", self.documents)) if t is not None]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out.groupBy("pack_id").pivot("part", ["nodes", "edges", "documents"]).agg(F.sum("n")).fillna(0)

    def document_list(self, pack_id: str, prefix: str = "documents/", suffix: str = ".md", limit: int = 200) -> DataFrame:
        rows = self._seen(self.documents, pack_id).filter(F.col("path").startswith(prefix) & F.col("path").endswith(suffix) & S.safe_path(F.col("path")))
        return rows.select("pack_id", "path", "title", F.length("body").alias("chars")).orderBy("path").limit(limit)

    def document_read(self, pack_id: str, path: str, max_chars: int = 12_000) -> DataFrame:
        rows = self._seen(self.documents, pack_id).filter((F.col("path") == path) & S.safe_path(F.col("path")))
        return rows.select("path", F.substring("body", 1, max_chars).alias("content"), (F.length("body") > max_chars).alias("truncated"))

    def chunk_read(self, pack_id: str, chunk_id: str) -> DataFrame:
        return self._seen(self.chunks, pack_id).filter(F.col("chunk_id") == chunk_id)

    # --- structured queries -------------------------------------------------------------------------------------------------

    def filtered_search_nodes(self, pack_id, node_type=None, where=None, fields: Sequence[str] | None = None, order_by=None, limit: int | None = 1000, offset: int = 0, include_heavy_fields: bool = False) -> Page:
        rows = self._nodes(pack_id, node_type, where)
        page = O.page(rows, order_by, limit, offset, ["ord"], "properties")
        return Page(O.project(page, fields, "properties", include_heavy_fields), rows, limit, offset)

    def distinct_property_values(self, pack_id, property: str, node_type=None, where=None, order: str = "asc", limit: int = 1000) -> DataFrame:  # noqa: A002
        values = A.distinct_values(self._nodes(pack_id, node_type, where), property, None, "properties")
        key = S.natural_key(F.col("value").cast("string"))
        return values.orderBy(key.desc() if order == "desc" else key.asc()).limit(limit)

    def aggregate_nodes(self, pack_id, node_type=None, where=None, group_by: Sequence[str] = (), metrics=None, order_by=None, limit: int | None = 5000, offset: int = 0) -> Page:
        out = A.aggregate(self._nodes(pack_id, node_type, where), None, group_by, metrics, "properties", F.col("ord"), skipped=True)
        return Page(O.page(out, order_by, limit, offset, list(group_by)), out, limit, offset)

    def join_by_property(self, left: dict[str, Any], right: dict[str, Any], join_type: str = "inner", limit: int | None = 10_000, summarize_right: bool = True) -> DataFrame:
        """left and right: pack_id, join_field, node_type, where. The summary holds a count and five samples of a key."""
        for side in (left, right):
            if not side.get("join_field"):
                raise InvalidQuery("join_field is needed")
        a = self._nodes(left.get("pack_id"), left.get("node_type"))
        b = self._nodes(right.get("pack_id"), right.get("node_type"))
        summary = [F.count(F.lit(1)).alias("count")] if summarize_right else None
        out = J.join_by_property(a, left["join_field"], b, right["join_field"], join_type, left.get("where"), right.get("where"), "properties", summary, (5, ["ord", "id", "label"]) if summarize_right else None)
        out = out.orderBy(S.natural_key(F.col("join_key")), F.col("left.ord"))
        return out if limit is None else out.limit(limit)

    def join_values(self, right: dict[str, Any], fields: Sequence[str], most: int = 5) -> DataFrame:
        """join_key, field and the least ``most`` distinct values that a join's right side has of each field for that key."""
        rows = self._nodes(right.get("pack_id"), right.get("node_type"), right.get("where"))
        r = Resolver(rows, "properties")
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), r(f).value.alias("value")) for f in fields])).alias("p")
        flat = rows.select(r(right["join_field"]).value.alias("join_key"), pairs).filter("join_key IS NOT NULL").select("join_key", "p.*")
        return R.least_values(flat, ["join_key", "field"], F.col("value"), most, "samples")

    def schema_profile(self, pack_id) -> DataFrame:
        return P.property_profile(self._nodes(pack_id).withColumn("json", F.to_json("properties")), "type", "json")

    def node_type_list(self, pack_id) -> DataFrame:
        return A.histogram(self._nodes(pack_id), F.col("type"))

    def relation_type_list(self, pack_id) -> DataFrame:
        return A.histogram(self._seen(self.edges, pack_id), F.col("relation"))

    # --- graph ---------------------------------------------------------------------------------------------------------------

    def graph_get(self, pack_id, max_nodes: int = 250, max_edges: int = 500) -> tuple[DataFrame, DataFrame]:
        """The first nodes by type, label and id, and the first edges among them: the budget comes last."""
        shown = G.dedupe_nodes(self._nodes(pack_id), "ord").orderBy("type", "label", "id").limit(max(0, max_nodes))
        return shown, G.induced(self._seen(self.edges, pack_id), shown).orderBy("id").limit(max(0, max_edges))

    def node_list(self, pack_id, node_type=None, limit: int = 100) -> DataFrame:
        return self._nodes(pack_id, node_type).orderBy("ord").limit(limit)

    def node_search(self, pack_id, search_text: str, limit: int = 20, by_type: bool = False) -> DataFrame:
        """By score, then modules before others, or with ``by_type`` the kinds of TYPE_RANKS in order, then short labels."""
        text = F.concat_ws(" ", "id", "label", F.to_json("properties"))
        rank = F.when(F.col("type") == "Module", 0).otherwise(1)
        if by_type:
            rank = F.lit(len(TYPE_RANKS))
            for i, kind in enumerate(TYPE_RANKS):
                rank = F.when(F.col("type") == kind, i).otherwise(rank)
        rows = self._nodes(pack_id).withColumn("rank", rank).withColumn("label_chars", F.length("label"))
        return H.search(rows, text, search_text, limit, ["rank", "label_chars", "ord"]).drop("rank", "label_chars")

    def node_context(self, pack_id, node_id: str, limit: int = 50) -> DataFrame:
        """The node's edges with the nodes at their other ends, and whether each node was found."""
        edges = self._seen(self.edges, pack_id)
        near = edges.filter(F.col("source") == node_id).select("id", "relation", F.col("target").alias("other"), F.lit("out").alias("direction")).unionByName(edges.filter(F.col("target") == node_id).select("id", "relation", F.col("source").alias("other"), F.lit("in").alias("direction")))
        found = self._nodes(pack_id).select(F.col("id").alias("other"), "label", "type", F.lit(True).alias("found"))
        return near.orderBy("id", "direction").limit(limit).join(found, "other", "left").fillna({"found": False})

    def edge_list(self, pack_id, source=None, target=None, relation=None, limit: int = 200) -> DataFrame:
        rows = self._seen(self.edges, pack_id)
        for column, value in (("source", source), ("target", target)):
            rows = rows.filter(F.col(column) == value) if value else rows
        rows = rows.filter(F.lower("relation") == relation.lower()) if relation else rows
        return rows.orderBy("ord").limit(limit)

    # --- evidence ---------------------------------------------------------------------------------------------------------------

    def _evidence(self, pack_id) -> DataFrame:
        docs = self._seen(self.documents, pack_id).select("pack_id", F.col("path").alias("ref"), "title", F.col("body").alias("shown"), F.concat_ws(" ", "body", "title", "path").alias("all"), "ord", F.lit(0).alias("part"))
        if self.chunks is None:
            return docs
        meta = F.coalesce(F.to_json("metadata"), F.lit(""))
        return docs.unionByName(self._seen(self.chunks, pack_id).select("pack_id", F.col("chunk_id").alias("ref"), "title", F.col("content").alias("shown"), F.concat_ws(" ", "content", "title", "chunk_id", "document_id", meta).alias("all"), "ord", F.lit(1).alias("part")))

    def evidence_search(self, pack_id, search_text: str, limit: int = 8) -> DataFrame:
        found = H.search(self._evidence(pack_id), F.col("all"), search_text, limit, ["part", "ord"], F.col("shown"))
        return found.orderBy(F.col("score").desc(), "part", "ord").select("pack_id", "ref", "title", "score", "snippet")

    def project_search(self, pack_ids: Sequence[str], search_text: str, limit_per_pack: int = 3) -> DataFrame:
        return H.top_per_pack(self._evidence(pack_ids), F.col("all"), search_text, "pack_id", limit_per_pack, ["part", "ord"]).select("pack_id", "ref", "title", "score", "place")

    def anchor_resolve(self, pack_id, chunk_id: str) -> DataFrame:
        rows = self.chunk_read(pack_id, chunk_id)
        return rows.select("chunk_id", F.explode(AN.anchors(rows, "metadata")).alias("anchor")).select("chunk_id", "anchor.*")

    def anchor_coverage(self, pack_id) -> DataFrame:
        rows = self._seen(self.chunks, pack_id)
        return AN.coverage(rows.withColumn("a", AN.anchors(rows, "metadata")), ["document_id"], AN.status(F.col("a")))

    def question_answer(self, pack_id, question: str, limit: int = 6) -> DataFrame:
        """Evidence and nodes for a question in one ranked table: kind, ref, title, score, snippet; the fixed template answer is
        its first row's snippet. Without any hit, the first documents."""
        question = H.expand(question)
        found = self.evidence_search(pack_id, question, limit).select(F.lit("evidence").alias("kind"), "ref", "title", "score", "snippet")
        nodes = self.node_search(pack_id, question, limit).select(F.lit("node").alias("kind"), F.col("id").alias("ref"), F.col("label").alias("title"), "score", "snippet")
        fallback = self._evidence(pack_id).orderBy("part", "ord").limit(limit).select(F.lit("context").alias("kind"), "ref", "title", F.lit(0.0).alias("score"), S.collapse(F.substring("shown", 1, H.AFTER)).alias("snippet"))
        return J.evidence_first(found.unionByName(nodes), fallback)

    # --- quantities and modules ----------------------------------------------------------------------------------------------------

    def quantity_facts_query(self, pack_ids, where=None, select: Sequence[str] = ("chunk_id",), order_by=None, limit: int | None = 100, offset: int = 0) -> Page:
        rows = self._seen(self.chunks, pack_ids)
        rows = rows.filter(compile_where(where, Resolver(rows, "metadata", CHUNK_ALIASES))) if where else rows
        return Page(O.project(O.page(rows, order_by, limit, offset, ["ord"], "metadata"), select, "metadata"), rows, limit, offset)

    def query_quantity_evidence(
        self, pack_id, module_type: str = "*", work_category: str = "", item_name: str = "", unit: str = "", normalized_unit: str = "", group_by: Sequence[str] = (), sum_field: str = "quantity",
        include_item_regex: str = "", exclude_item_regex: str = "", exclude_items: Sequence[str] = (),
    ) -> DataFrame:
        """Sums of a field over elements; the item patterns are searched in item_name and specification together, of which a
        missing one is empty."""
        clauses: list[dict] = [{f"module_type__{'wildcard' if any(c in module_type for c in '*?[') else 'eq'}": module_type}] if module_type != "*" else []
        clauses += [{"item_name__wildcard": item_name}] if item_name else []
        clauses += [{f: v} for f, v in (("work_category", work_category), ("unit", unit), ("normalized_unit", normalized_unit)) if v]
        clauses += [{"item_name__not_in": list(exclude_items)}] if exclude_items else []
        rows = self._nodes(pack_id, "Element", {"$and": clauses})
        r = Resolver(rows, "properties")
        item = F.concat_ws(" ", F.coalesce(r("item_name").value, F.lit("")), F.coalesce(r("specification").value, F.lit("")))
        rows = rows.filter(item.rlike(include_item_regex)) if include_item_regex else rows
        rows = rows.filter(~item.rlike(exclude_item_regex)) if exclude_item_regex else rows
        metrics = [{"agg": "sum", "field": sum_field, "as": "quantity_sum"}, {"agg": "collect_set", "field": "source_row", "as": "source_rows"}, {"agg": "count", "as": "row_count"}]
        return A.aggregate(rows, None, group_by, metrics, "properties", F.col("ord"), skipped=True)

    def aggregate_quantity_by_module(self, pack_id, unit: str = "") -> DataFrame:
        """Totals of each module with its items nested. A missing quantity is skipped, a missing module is no module."""
        rows = self._nodes(pack_id, "Element", {"unit": unit} if unit else None)
        r = Resolver(rows, "properties")
        flat = rows.select(r("module_type").value.alias("module_type"), F.coalesce(r("item_name").value, F.lit("")).alias("item_name"), S.lenient_number(r("quantity").value).cast(S.DECIMAL).alias("quantity"), r("source_row").value.alias("source_row")).filter("module_type IS NOT NULL AND quantity IS NOT NULL")
        return A.nested_totals(flat, "module_type", "item_name", F.col("quantity"), "source_row")

    def list_project_modules(self, pack_ids, module_pattern: str = r"\d+-\d+-[A-Z]+") -> DataFrame:
        """module_id and the fields it was found in."""
        rows = self._nodes(pack_ids)
        r = Resolver(rows, "properties")
        named = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("source"), r(f).value.alias("module_id")) for f in MODULE_FIELDS])).alias("m")).select("m.*")
        return named.filter(F.col("module_id").rlike(f"^(?:{module_pattern})$")).groupBy("module_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("n")).orderBy(S.natural_key(F.col("module_id")))

    def list_module_elements(self, pack_id, module_id: str, category: str = "", fields: Sequence[str] = ("id", "label", "type"), limit: int | None = 5000) -> DataFrame:
        """Sorted before projection, so the order needs no field of the result; all of them without a limit."""
        where: dict[str, Any] = {"$or": [{f: module_id} for f in MODULE_FIELDS]}
        rows = self._nodes(pack_id, None, {"$and": [where, *([{"category": category}] if category else [])]})
        return O.project(O.page(rows, {"field": "source_element_id", "natural": True}, limit, 0, ["ord"], "properties"), fields, "properties")

    # --- drawings -------------------------------------------------------------------------------------------------------------------

    def _entities(self, pack_ids, types=None, sheet_no="", source_file="", layer="", where=None) -> DataFrame:
        rows = DR.filtered(self._seen(self.entities, pack_ids), types, sheet_no, source_file, layer)
        return rows.filter(compile_where(where, Resolver(rows))) if where else rows

    def dxf_entity_summary(self, pack_ids, sheet_no: str = "", source_file: str = "") -> DataFrame:
        return DR.summaries(self._entities(pack_ids, None, sheet_no, source_file))

    def dxf_layer_summary(self, pack_ids, sheet_no: str = "", source_file: str = "") -> DataFrame:
        return DR.layer_summary(self._entities(pack_ids, None, sheet_no, source_file))

    def dxf_entity_search(self, pack_ids, query: str = "", sheet_no: str = "", source_file: str = "", entity_type=None, layer: str = "", where=None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = self._entities(pack_ids, entity_type, sheet_no, source_file, layer, where)
        if query:
            rows = H.search(rows, F.concat_ws(" ", "text", "layer", "entity_type"), query, None, ["ord"])
        return (rows if query else rows.orderBy("ord")).offset(offset).limit(limit)

    def dxf_text_search(self, pack_ids, query: str, **filters: Any) -> DataFrame:
        return self.dxf_entity_search(pack_ids, query, entity_type=["TEXT", "MTEXT"], **filters)

    def dxf_dimension_search(self, pack_ids, **filters: Any) -> DataFrame:
        return self.dxf_entity_search(pack_ids, entity_type=["DIMENSION"], **filters)

    def dxf_bbox_query(self, pack_ids, bbox: tuple[float, float, float, float], mode: str = "intersects", limit: int = 100, offset: int = 0, **filters: Any) -> DataFrame:
        return self._entities(pack_ids, **filters).filter(DR.relates(F.col("bbox"), *bbox, mode)).orderBy("ord").offset(offset).limit(limit)

    def drawing_text_search(self, pack_ids, query: str, sheet_no: str = "", view_name: str = "", text_type: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
        """Scored texts of entities and of chunks: kind, ref, text, entity_type, sheet_no, view_name, score. A text that is the
        query gains ten, one that contains it five; typed texts of entities gain two."""
        types = [t.upper() for t in text_type] if text_type else list(DR.TEXT_TYPES)
        rows = self._entities(pack_ids, types, sheet_no)
        rows = rows if "view_name" in rows.columns else rows.withColumn("view_name", F.lit(None).cast("string"))
        rows = rows.select(F.lit("entity").alias("kind"), F.col("ord").cast("string").alias("ref"), "text", "entity_type", "sheet_no", "view_name", "ord")
        if self.chunks is not None:
            chunks = self._seen(self.chunks, pack_ids)
            r = Resolver(chunks, "metadata")
            part = chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("ref"), F.col("content").alias("text"), r("entity_type").value.alias("entity_type"), F.coalesce(r("sheet_no").value, r("sheet_number").value).alias("sheet_no"), r("view_name").value.alias("view_name"), "ord")
            part = part.filter(F.upper("entity_type").isin(types)) if text_type else part
            rows = rows.unionByName(part.filter(F.lower("sheet_no") == sheet_no.lower()) if sheet_no else part)
        rows = rows.filter(F.contains(F.lower("view_name"), F.lit(view_name.lower()))) if view_name else rows
        low, q = F.lower("text"), query.lower()
        typed = (F.col("kind") == "entity") & F.col("entity_type").isin("TEXT", "MTEXT")
        boost = F.when(low == q, 10.0).when(F.contains(low, F.lit(q)), 5.0).otherwise(0.0) + F.when(typed, 2.0).otherwise(0.0)
        found = H.search(rows, F.col("text"), query, None, ["ord"]).withColumn("score", F.col("score") + boost)
        return found.orderBy(F.col("score").desc(), "kind", "ord").limit(limit)

    def room_area_tag_extract(self, pack_ids, room_name: str = "", sheet_no: str = "", limit: int = 50) -> DataFrame:
        rows = DR.room_areas(self._entities(pack_ids, ["TEXT", "MTEXT"], sheet_no))
        rows = rows.filter(F.contains(F.lower("label"), F.lit(room_name.lower()))) if room_name else rows
        return rows.orderBy("ord").limit(limit)

    def dimensions_extract(self, pack_ids, sheet_no: str = "", limit: int = 100) -> DataFrame:
        return DR.dimensions(self._entities(pack_ids, ["DIMENSION"], sheet_no)).orderBy("ord").limit(limit)

    def area_from_dimensions_calculate(self, pack_ids, sheet_no: str = "") -> DataFrame:
        return DR.area_from_dimensions(DR.dimensions(self._entities(pack_ids, ["DIMENSION"], sheet_no)), ["sheet_no"])

    # --- documents that hold facts ------------------------------------------------------------------------------------------------

    def module_list(self, pack_id, limit: int = 300) -> DataFrame:
        """Modules of the module documents, by id; without any such document, those that elements name."""
        found = L.modules(self._seen(self.documents, pack_id)).select("module_id", "module_type", "summary", *L.MODULE_NUMBERS, "evidence_path")
        named = self.list_project_modules(pack_id).select("module_id", F.nullif(F.regexp_extract("module_id", "-([A-Z]+)$", 1), F.lit("")).alias("module_type"), F.lit(None).cast("string").alias("summary"), *[F.lit(None).cast("double").alias(n) for n in L.MODULE_NUMBERS], F.lit(None).cast("string").alias("evidence_path"))
        return J.evidence_first(found, named).orderBy("module_id").limit(limit)

    def module_get(self, pack_id, module_id: str, max_chars: int = 18_000) -> DataFrame:
        """ref, kind, content, truncated and facts of the module's document, whatever its case; without one, evidence and up to
        eight nodes that name it."""
        doc = L.by_stem(self._seen(self.documents, pack_id), L.MODULES, module_id)
        shown = doc.select(F.lit("document").alias("kind"), F.col("path").alias("ref"), F.substring("body", 1, max_chars).alias("content"), (F.length("body") > max_chars).alias("truncated"), "facts")
        none = F.lit(None).cast("map<string,string>").alias("facts")
        evidence = self.evidence_search(pack_id, module_id, 3).select(F.lit("evidence").alias("kind"), "ref", F.col("snippet").alias("content"), F.lit(False).alias("truncated"), none)
        has = lambda c: F.contains(F.lower(c), F.lit(module_id.lower()))
        nodes = self._nodes(pack_id).filter(has("id") | has("label")).orderBy("ord").limit(8).select(F.lit("node").alias("kind"), F.col("id").alias("ref"), F.col("label").alias("content"), F.lit(False).alias("truncated"), none)
        return J.evidence_first(shown, evidence.unionByName(nodes))

    def assembly_list(self, pack_id, limit: int = 300) -> DataFrame:
        rows = self._seen(self.documents, pack_id).filter(F.col("path").startswith(L.ASSEMBLIES) & F.col("path").endswith(".md"))
        return rows.select(L.stem(F.col("path")).alias("mark"), F.col("path").alias("evidence_path")).orderBy("evidence_path").limit(limit)

    def assembly_get(self, pack_id, mark: str, max_chars: int = 14_000) -> DataFrame:
        doc = L.by_stem(self._seen(self.documents, pack_id), L.ASSEMBLIES, mark)
        return doc.select(L.stem(F.col("path")).alias("mark"), F.col("path").alias("evidence_path"), F.substring("body", 1, max_chars).alias("content"), (F.length("body") > max_chars).alias("truncated"), "facts")

    def fastener_summary(self, pack_id) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Totals, anchors by specification and bolts by specification."""
        docs = self._seen(self.documents, pack_id)
        return L.fastener_totals(docs), L.anchors_by_spec(docs).orderBy("description"), L.bolts_by_spec(docs)

    def section_weight_index(self, pack_id) -> DataFrame:
        return L.section_weights(self._seen(self.documents, pack_id)).orderBy("pack_id", "place")

    def schedule_table_extract(self, pack_ids, schedule_name: str = "", limit: int = 5000) -> DataFrame:
        """Rows of schedules as maps from column to text, from the chunks that hold schedule rows."""
        chunks = self._seen(self.chunks, pack_ids)
        r = Resolver(chunks, "metadata", {"schedule": ["metadata.join_keys.schedule_name", "metadata.schedule_name", "metadata.compact_row.schedule_name"], "role": ["metadata.compact_row.row_role", "metadata.row_role"]})
        values = F.from_json(F.to_json(F.try_variant_get("metadata", "$.compact_row.values", "variant")), "array<struct<text:string>>")
        rows = chunks.select("pack_id", r("schedule").value.alias("schedule_name"), F.try_variant_get("metadata", "$.compact_row.row", "int").alias("row"), r("role").value.alias("role"), F.transform(values, lambda v: F.coalesce(v["text"], F.lit(""))).alias("texts"), F.col("chunk_id").alias("ref"))
        rows = rows.filter(F.contains(F.lower("schedule_name"), F.lit(schedule_name.lower()))) if schedule_name else rows
        return L.schedule_table(rows.filter("texts IS NOT NULL")).orderBy("schedule_name", "row").limit(limit)

    # --- catalogue of what there is -----------------------------------------------------------------------------------------------

    @staticmethod
    def tool_manifest() -> list[dict[str, Any]]:
        """Name, parameters and first line of the description of every tool."""
        tools = [(n, f) for n, f in vars(Engine).items() if not n.startswith("_") and (callable(f) or isinstance(f, staticmethod))]
        tools = [(n, f.__func__ if isinstance(f, staticmethod) else f) for n, f in tools]
        return [{"name": n, "parameters": [str(p) for p in inspect.signature(f).parameters.values() if p.name != "self"], "description": (f.__doc__ or "").strip().split("\n")[0]} for n, f in sorted(tools)]

    def server_status(self) -> DataFrame:
        """name and n: rows of each table that the principal sees, and the number of tools."""
        tables = {"nodes": self.nodes, "edges": self.edges, "documents": self.documents, "chunks": self.chunks, "packs": self.packs, "entities": self.entities}
        counted = A.table_counts({k: self._seen(t) for k, t in tables.items() if t is not None})
        return counted.unionByName(self.nodes.sparkSession.createDataFrame([("tools", len(self.tool_manifest()))], "name string, n long"))

    def pack_schema(self, pack_id) -> DataFrame:
        """source_type, relation, target_type and n of the edges; an end without a node has no type."""
        kinds = self._nodes(pack_id).select("pack_id", "id", "type")
        end = lambda c: kinds.select("pack_id", F.col("id").alias(c), F.col("type").alias(f"{c}_type"))
        edges = self._seen(self.edges, pack_id).join(end("source"), ["pack_id", "source"], "left").join(end("target"), ["pack_id", "target"], "left")
        return edges.groupBy("source_type", "relation", "target_type").agg(F.count(F.lit(1)).alias("n"))

    def ontology_manifest(self, pack_id="") -> DataFrame:
        """part (node_type or relation), name and n over one pack or all of them."""
        nodes = self.node_type_list(pack_id).select(F.lit("node_type").alias("part"), F.col("key").alias("name"), "n")
        return nodes.unionByName(self.relation_type_list(pack_id).select(F.lit("relation").alias("part"), F.col("key").alias("name"), "n")).orderBy("part", F.col("n").desc(), "name")

    def source_list(self, pack_id=None) -> DataFrame:
        """pack_id, source, documents and chunks of each pack."""
        count = lambda t, n: self._seen(t, pack_id).groupBy("pack_id").agg(F.count(F.lit(1)).alias(n))
        out = self._seen(self.packs, pack_id).select("pack_id", "source")
        for t, n in ((self.documents, "documents"), (self.chunks, "chunks")):
            out = out.join(count(t, n), "pack_id", "left") if t is not None else out.withColumn(n, F.lit(None).cast("long"))
        return out.fillna(0, ["documents", "chunks"]).orderBy("pack_id")

    def evidence_trace(self, pack_id, search_text: str, limit: int = 5, include_answer: bool = False) -> DataFrame:
        """kind, ref, title, score and snippet of evidence and nodes, the edges of the best three nodes (at most eight each), and
        the answer where it is asked for."""
        evidence = self.evidence_search(pack_id, search_text, limit).select(F.lit("evidence").alias("kind"), "ref", "title", "score", "snippet")
        nodes = self.node_search(pack_id, search_text, limit).select(F.lit("node").alias("kind"), F.col("id").alias("ref"), F.col("label").alias("title"), "score", "snippet")
        near = G.neighbours(self._seen(self.edges, pack_id), nodes.orderBy(F.col("score").desc(), "ref").limit(3).select(F.col("ref").alias("id")))
        place = F.row_number().over(Window.partitionBy("seed").orderBy("relation", "neighbour", "direction"))
        edges = near.withColumn("p", place).filter("p <= 8").select(F.lit("edge").alias("kind"), F.col("seed").alias("ref"), F.col("neighbour").alias("title"), F.lit(0.0).alias("score"), F.concat_ws(" ", "direction", "relation").alias("snippet"))
        out = evidence.unionByName(nodes).unionByName(edges)
        return out.unionByName(self.question_answer(pack_id, search_text, 1).withColumn("kind", F.lit("answer"))) if include_answer else out

    # --- projects -----------------------------------------------------------------------------------------------------------------

    def project_list(self, projects: DataFrame, project_packs: DataFrame) -> DataFrame:
        """Projects (project_id, name) with how many packs that are seen each has; those without packs count none."""
        packs = self._seen(project_packs).join(self._seen(self.packs).select("pack_id"), "pack_id", "left_semi").groupBy("project_id").agg(F.count(F.lit(1)).alias("packs"))
        return projects.join(packs, "project_id", "left").fillna(0, ["packs"]).orderBy("name", "project_id")

    def project_overview(self, project_id: str, project_packs: DataFrame) -> DataFrame:
        """pack_id, title and the nodes, edges and documents of each pack of a project."""
        own = self._seen(self.packs).join(project_packs.filter(F.col("project_id") == project_id).select("pack_id").distinct(), "pack_id", "left_semi")
        return own.select("pack_id", "title").join(self.pack_overview(), "pack_id", "left").fillna(0).orderBy("pack_id")

    def project_pack_list(self, project_packs: DataFrame) -> DataFrame:
        """Packs with their projects; those without one come last, under no project."""
        return self._seen(self.packs).join(project_packs.select("pack_id", "project_id"), "pack_id", "left").orderBy(F.col("project_id").asc_nulls_last(), "pack_id")

    def reconcile(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Folders (folder_id, name) by what became of them: created, renamed, deleted, unchanged, or conflict where two
        folders now have one name."""
        a, b = before.select("folder_id", F.col("name").alias("old")), after.select("folder_id", F.col("name").alias("new"))
        twice = F.count(F.lit(1)).over(Window.partitionBy(F.lower("new"))) > 1
        b = b.withColumn("twice", twice)
        state: Column = F.when(F.col("new").isNull(), "deleted").when(F.col("twice"), "conflict").when(F.col("old").isNull(), "created").when(F.col("old") == F.col("new"), "unchanged").otherwise("renamed")
        return a.join(b, "folder_id", "full").select("folder_id", "old", "new", state.alias("state"))
