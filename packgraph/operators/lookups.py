"""Facts that Markdown documents of a pack hold: modules, assemblies, fasteners, section weights, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions import texts as X
from packgraph.functions.scalars import lenient_number, number
from packgraph.operators.derive import carried_headers

MODULES, ASSEMBLIES, FASTENERS, SECTIONS = "documents/modules/", "documents/assembly_marks/", "documents/fasteners/", "documents/section_weight_index.md"
#: Names of rows in a summary table and what they count (fixed values).
SUMMARY_NAMES = {"객체 수": "element_count", "층 수": "storey_count", "카테고리 수": "category_count", "타입 수": "type_count"}
#: Counts and sums that a module's document can state (fixed values).
MODULE_NUMBERS = ("assembly_count", "single_part_count", "element_count", "total_weight_kg", "total_length_m")


def stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def facts(body: Column) -> Column:
    """A map of what a document's summary table and its ``key: value`` lines state; lines win, and of equal keys the last."""
    rows = F.filter(X.table_cells(X.section_lines(body, "Summary")), lambda r: (F.size(r) >= 2) & (F.get(r, F.lit(0)) != "항목"))

    def named(row: Column) -> Column:
        key = F.get(row, F.lit(0))
        for said, name in SUMMARY_NAMES.items():
            key = F.when(F.get(row, F.lit(0)) == said, F.lit(name)).otherwise(key)
        return F.struct(key.alias("key"), F.get(row, F.lit(1)).alias("value"))

    pairs = F.reverse(F.concat(F.transform(rows, named), X.key_values(body)))
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_entries(last)


def modules(documents: DataFrame) -> DataFrame:
    """One row for each module document (pack_id, path, body): module_id, module_type, summary, its numbers and its path."""
    rows = documents.filter(F.col("path").startswith(MODULES) & F.col("path").endswith(".md")).withColumn("f", facts(F.col("body")))
    said = lambda k: F.nullif(F.try_element_at("f", F.lit(k)), F.lit(""))
    empty = lambda c: F.nullif(c, F.lit(""))
    name = stem(F.col("path"))
    kind = F.coalesce(said("module_type"), empty(F.regexp_extract(name, "-([A-Z]+)$", 1)))
    summary = empty(F.trim(F.regexp_extract("body", r"\*\*요약\*\*:\s*(.+)", 1)))
    return rows.select("pack_id", F.coalesce(said("module_id"), name).alias("module_id"), kind.alias("module_type"), summary.alias("summary"), *[number(said(n)).cast("double").alias(n) for n in MODULE_NUMBERS], F.col("path").alias("evidence_path"))


def by_stem(documents: DataFrame, folder: str, name: str) -> DataFrame:
    """The document of a folder with that name: as it is written, in capitals, in small letters, or else without regard to
    case; pack_id, path, body and facts."""
    rank = F.when(stem(F.col("path")) == name, 0).when(stem(F.col("path")) == name.upper(), 1).when(stem(F.col("path")) == name.lower(), 2).otherwise(3)
    rows = documents.filter(F.col("path").startswith(folder) & F.col("path").endswith(".md") & (F.lower(stem(F.col("path"))) == name.lower()))
    return rows.orderBy(rank, "path").limit(1).select("pack_id", "path", "body", facts(F.col("body")).alias("facts"))


def fastener_totals(documents: DataFrame) -> DataFrame:
    """pack_id, bolt, anchor and total quantities that fastener documents state."""
    rows = documents.filter(F.col("path").startswith(FASTENERS)).withColumn("f", facts(F.col("body")))
    return rows.select("pack_id", *[number(F.try_element_at("f", F.lit(k))).cast("long").alias(k) for k in ("bolt_quantity", "anchor_quantity", "fastener_total_quantity")], F.col("path").alias("evidence_path"))


def anchors_by_spec(documents: DataFrame) -> DataFrame:
    """pack_id, description, grade, standard and quantity of the anchors in fastener tables (kind, description, quantity, grade,
    standard); other rows of these tables are no anchors."""
    rows = documents.filter(F.col("path").startswith(FASTENERS)).select("pack_id", F.explode(X.table_cells(F.split("body", r"\r?\n"))).alias("r"))
    at = lambda i: F.get("r", F.lit(i))
    cells = rows.filter(F.size("r") >= 5).filter((at(0) != "kind") & F.contains(F.lower(at(4)), F.lit("anchor")))
    return cells.groupBy("pack_id", at(1).alias("description"), at(3).alias("grade"), at(4).alias("standard")).agg(F.sum(F.coalesce(lenient_number(at(2)).cast("long"), F.lit(0))).alias("quantity"))


def bolts_by_spec(documents: DataFrame) -> DataFrame:
    """pack_id, spec (JSON) of the bolts that a fastener document's JSON blocks list."""
    rows = documents.filter(F.col("path").startswith(FASTENERS)).select("pack_id", F.explode(X.json_blocks(F.col("body"))).alias("j")).withColumn("v", F.try_parse_json("j"))
    listed = rows.filter(F.lower(F.try_variant_get("v", "$.fastener_type", "string")) == "bolt")
    return listed.select("pack_id", F.explode(F.from_json(F.get_json_object("j", "$.by_spec"), "array<string>")).alias("spec"))


def table_of(documents: DataFrame, path: str, heading: str) -> DataFrame:
    """pack_id, place (from 0) and cells (a map from the header) of the rows of a document's table below a heading."""
    rows = documents.filter(F.col("path") == path)
    return rows.select("pack_id", F.posexplode(X.table_rows(X.section_lines(F.col("body"), heading))).alias("place", "cells"))


def section_weights(documents: DataFrame) -> DataFrame:
    return table_of(documents, SECTIONS, "All Sections")


def schedule_table(rows: DataFrame) -> DataFrame:
    """Data rows of schedules as maps from their column's name to text: pack_id, schedule_name, row, data, columns, ref.

    rows: pack_id, schedule_name, row, role (column_header or data_row), texts (array), ref. A header holds for the rows below
    it, of its own pack and schedule only. Rows that are as long as the header are named by it, others ``column_0`` and so on.
    """
    some = F.col("role") == "column_header"
    titled = carried_headers(rows.withColumn("__of", F.struct("pack_id", "schedule_name")), "__of", "row", some, F.filter("texts", lambda x: x != ""))
    data = titled.filter((F.col("role") == "data_row") & (F.size("texts") > 0))
    fits = F.coalesce((F.size("header") == F.size("texts")) & (F.size(F.array_distinct("header")) == F.size("header")), F.lit(False))
    names = F.when(fits, F.col("header")).otherwise(F.transform(F.sequence(F.lit(0), F.size("texts") - 1), lambda i: F.concat(F.lit("column_"), i.cast("string"))))
    return data.select("pack_id", "schedule_name", "row", F.map_from_arrays(names, F.transform("texts", lambda x: F.coalesce(x, F.lit("")))).alias("data"), F.coalesce("header", F.array().cast("array<string>")).alias("columns"), "ref")
