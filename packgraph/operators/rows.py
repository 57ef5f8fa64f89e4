"""Rows of chunks, elements and evidence: names, measures, compact forms and their text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions import texts as X
from packgraph.functions.scalars import number, short_id
from packgraph.operators.fields import Resolver

#: Fields of a chunk row that are shown if none are asked for (fixed values).
ROW_FIELDS = (
    "pack_id", "chunk_id", "text", "workset_name", "element_id", "element_name", "family_name", "family_and_type", "type_name", "parameter", "display", "value", "unit", "area_m2", "volume_m3",
    "sheet_number", "view_name", "evidence_type", "source_refs",
)
#: Other names of an entity's fields (fixed values).
PAYLOAD_ALIASES = {"sheet_number": "sheet_no", "file": "source_file", "dxf_file_name": "source_file", "insert_point": "insert", "insertion_point": "insert", "value": "value_mm", "measurement": "value_mm"}
#: Where a node's label can stand, in order (fixed values).
LABELS = ("label", "title", "name", "module_id", "module_type", "assembly_mark", "single_part_mark", "material_name", "section_name", "properties.title", "properties.name", "properties.path")
#: Parts of a node id and the type that they say, in order (fixed values).
ID_TYPES = ((":module_type:", "ModuleType"), (":module:", "Module"), (":assembly:", "Assembly"), (":single_part:", "SinglePart"), (":material:", "Material"), (":section:", "Section"))
#: How large nodes are drawn; others are 5 (fixed values).
SIZES = {"Module": 11, "Document": 11, "Assembly": 8, "Category": 8, "Chunk": 4}
#: Dimensions that are not shown, those that come first by category, and what they are called (fixed values).
NOISE = (
    "Area", "Volume", "Elevation at Bottom", "Elevation at Top", "Elevation at Bottom Core", "Elevation at Top Core", "Weight", "Base Offset", "Top Offset", "Base Extension Distance",
    "Top Extension Distance", "Reference Level Elevation", "Offset from Host",
)
FIRST = {
    "Wall": ("Length", "Thickness", "Unconnected Height", "Height"),
    "Door": ("Width", "Height", "Head Height", "Sill Height", "문틀 두께", "문틀 두께 2", "문틀 폭", "문 패널 두께", "문 패널 폭", "하부 문틀", "A", "B", "H1"),
    "Window": ("Width", "Height", "Head Height", "Sill Height", "문틀 두께", "문짝 두께", "유리 두께", "유리 두께1", "유리 두께2", "문틀 폭", "A", "B", "H1"),
    "Slab": ("Thickness", "Perimeter", "Length", "Width"),
    "Beam": ("Length", "Cut Length", "Width", "Height"),
    "Column": ("Length", "Cut Length", "Width", "Height"),
    "Proxy": ("Length", "Width", "Height", "Thickness", "길이", "폭"),
    "Covering": ("Perimeter", "Thickness", "Length", "Width"),
    "Furnishing": ("Length", "Width", "Height"),
}
FIRST_OF_OTHERS = ("Length", "Width", "Height", "Thickness")
CALLED = {"Door": {"Width": "폭", "Height": "높이", "Head Height": "상단 높이", "Sill Height": "하단 높이"}, "Window": {"Width": "폭", "Height": "높이", "Head Height": "상단 높이", "Sill Height": "창대 높이"}}
SHOWN = 8  # dimensions of an element's text


def with_alias(rows: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The asked fields of entity rows under the names they were asked by; without any, all of them. A field that the rows lack
    is a null column."""
    if not fields:
        return rows
    at = lambda f: PAYLOAD_ALIASES.get(f, f)
    return rows.select(*[(F.col(at(f)) if at(f) in rows.columns else F.lit(None)).alias(f) for f in dict.fromkeys(fields)])


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks (pack_id, chunk_id, content, metadata as VARIANT) as rows with the default fields: join keys of the metadata win
    over its other fields, and value and unit come from the first measure that there is."""
    fields = {f: [f"metadata.join_keys.{f}", f"metadata.compact_row.{f}", f"metadata.{f}"] for f in ROW_FIELDS}
    fields["parameter"] += ["metadata.join_keys.parameter_name", "metadata.parameter_name"]
    fields["display"] += ["metadata.join_keys.parameter_display", "metadata.parameter_display"]
    fields["length_m"] = ["metadata.join_keys.length_m", "metadata.compact_row.length_m", "metadata.length_m"]
    r = Resolver(chunks, "metadata", fields)
    own = {"pack_id": F.col("pack_id"), "chunk_id": F.col("chunk_id"), "text": F.col("content")}
    measured = X.measurement({c: number(r(c).value).cast("double") for c, _ in X.MEASURE_COLUMNS}, r("display").value)
    own["value"] = F.coalesce(number(r("value").value).cast("double"), measured["value"])
    own["unit"] = F.coalesce(r("unit").value, measured["unit"])
    return chunks.select(*[own.get(f, r(f).value).alias(f) for f in ROW_FIELDS])


def node_label(columns: dict[str, Column], fallback: Column) -> Column:
    """The first label that isn't empty."""
    return F.coalesce(*[F.nullif(columns[n].cast("string"), F.lit("")) for n in LABELS if n in columns], fallback)


def node_kind(node_id: Column, labels: Column | None = None, kind: Column | None = None, category: Column | None = None) -> Column:
    """A node's type: its first label, its type, what its id says, Category if it has one, else Element."""
    out = F.when(category.isNotNull(), "Category").otherwise("Element") if category is not None else F.lit("Element")
    for part, name in reversed(ID_TYPES):
        out = F.when(F.contains(node_id, F.lit(part)), name).otherwise(out)
    first = [F.get(labels, F.lit(0))] if labels is not None else []
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in [*first, *([kind] if kind is not None else [])]], out)


def node_size(kind: Column) -> Column:
    out = F.lit(5)
    for name, size in SIZES.items():
        out = F.when(kind == name, size).otherwise(out)
    return out


def compact(columns: Sequence[str]) -> Column:
    """The columns of a row that hold something, as a map in their order; zeros and false are something, empty text is not."""
    pairs = F.create_map(*[x for c in columns for x in (F.lit(c), F.nullif(F.col(c).cast("string"), F.lit("")))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def row_text(columns: Sequence[str]) -> Column:
    """``column: value`` lines of what a row holds, for search."""
    return F.array_join(F.transform(F.map_entries(compact(columns)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def identity(columns: Sequence[Column], *content: Column) -> Column:
    """The first id that a row has, else a digest of its content."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], short_id(*content))


def evidence_records(rows: DataFrame, source_file: str, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One evidence record for each row: evidence_id, kind, source_file, section (its id), record_hash and content. Equal rows
    give the same id."""
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    made = rows.select(identity([F.col(k) for k in keys], *[F.col(c) for c in columns]).alias("section"), digest.alias("record_hash"), row_text(columns).alias("content"))
    name = F.concat(F.lit("evidence:"), short_id(F.lit(source_file), F.col("section"), F.col("record_hash")))
    return made.select(name.alias("evidence_id"), F.lit("derived_record").alias("kind"), F.lit(source_file).alias("source_file"), "section", "record_hash", "content")


def dimension_text(category: Column, dimensions: Column) -> Column:
    """The first eight dimensions of an element (a map of text) as ``name=value``: those of its category first, the others by
    name, without noise; a dash if there are none. Numbers lose their trailing zeros."""
    order = F.array(*[F.lit(k) for k in FIRST_OF_OTHERS])
    for name, keys in FIRST.items():
        order = F.when(category == name, F.array(*[F.lit(k) for k in keys])).otherwise(order)
    keys = F.concat(order, F.array_sort(F.array_except(F.map_keys(dimensions), order)))
    some = F.filter(keys, lambda k: ~k.isin(list(NOISE)) & F.coalesce(~F.try_element_at(dimensions, k).isin("", "-", "true", "false"), F.lit(False)))

    def shown(key: Column) -> Column:
        label, value = key, F.try_element_at(dimensions, key)
        for kind, names in CALLED.items():
            for k, called in names.items():
                label = F.when((category == kind) & (key == k), called).otherwise(label)
        return F.concat(label, F.lit("="), F.coalesce(X.short_number(number(value)), value))

    return F.coalesce(F.nullif(F.array_join(F.transform(F.slice(some, 1, SHOWN), shown), ", "), F.lit("")), F.lit("-"))


def dependency_text(host_id: Column, parts: Sequence[Column], host: Column) -> Column:
    """What an element depends on: its host's id and the host's names, or else the host; a dash without either."""
    names = F.concat_ws(" / ", *[F.nullif(p, F.lit("")) for p in parts])
    said = F.concat_ws(", ", F.concat(F.lit("Host Id="), F.nullif(host_id, F.lit(""))), F.coalesce(F.nullif(names, F.lit("")), F.concat(F.lit("Host="), F.nullif(host, F.lit("")))))
    return F.coalesce(F.nullif(said, F.lit("")), F.lit("-"))


def floor_totals(rows: DataFrame, module: Column, measures: Sequence[str]) -> DataFrame:
    """Totals of each floor, which is the number before a module id's first dash: floor, n and the sums; modules without a
    floor are left out."""
    floor = F.regexp_extract(module, r"^([0-9]+)-", 1).try_cast("int")
    return rows.withColumn("floor", floor).filter("floor IS NOT NULL").groupBy("floor").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures])
