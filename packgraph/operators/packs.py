"""Packs as a catalogue: which part of a suite each is, its shards, its project, and where its entities are read from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.functions.scalars import slug
from packgraph.operators.drawing import TEXT_TYPES

#: Parts that a pack suite is cut into, in the order in which a name is searched for them (fixed values).
LOGICAL = ("drawing_evidence", "drawing_documents", "schedule_rows", "schedule_tables", "quantity_facts", "material_facts", "bim_objects", "relationships")
#: Counters of a pack whose sum stands for its rows where nothing else says them (fixed values).
COUNTERS = ("bim_objects", "material_facts", "quantity_facts", "drawing_documents", "drawing_evidence", "schedule_tables", "schedule_rows", "relationships")


def logical_name(stated: Column, derived_file: Column, pack_id: Column, names: Column) -> Column:
    """The part of its suite that a pack is: what it states, the file it was derived from, or a part's name in its id or in its
    other names (there with spaces too); empty if nothing says it."""
    out = F.lit("")
    for name in reversed(LOGICAL):
        out = F.when(F.contains(F.lower(names), F.lit(name)) | F.contains(F.lower(names), F.lit(name.replace("_", " "))), name).otherwise(out)
    for name in reversed(LOGICAL):
        out = F.when(F.contains(F.lower(pack_id), F.lit(name)), name).otherwise(out)
    return F.coalesce(F.nullif(stated, F.lit("")), F.nullif(F.regexp_replace(derived_file, r"\.jsonl$", ""), F.lit("")), out)


def resolved(packs: DataFrame, pack_id: str = "", pack_ids: Sequence[str] | None = None, project: DataFrame | None = None, logical: str = "", siblings: bool = True) -> DataFrame:
    """Packs (pack_id, logical) that a request means, each once: those listed, or one with the other shards of its part, or
    those of a project, or all; ``logical`` keeps one part only, and the pack that was named if nothing says its part."""
    pool = packs.dropDuplicates(["pack_id"])
    if project is not None:
        pool = pool.join(project.select("pack_id").distinct(), "pack_id", "left_semi")
    if pack_ids:
        found = packs.dropDuplicates(["pack_id"]).filter(F.col("pack_id").isin(list(pack_ids)))
    elif pack_id:
        found = packs.dropDuplicates(["pack_id"]).filter(F.col("pack_id") == pack_id)
        if siblings:
            part = [logical] if logical else [r["logical"] for r in found.select("logical").collect()]  # one row
            found = found.unionByName(pool.filter(F.col("logical").isin([p for p in part if p]))).dropDuplicates(["pack_id"])
    else:
        found = pool
    if logical:
        found = found.filter((F.col("logical") == logical) | ((F.col("pack_id") == pack_id) & (F.col("logical") == "")))
    return found


def summary(packs: DataFrame, lines: DataFrame) -> DataFrame:
    """pack_id and rows of each pack: what its manifest counts, else the lines of its members (pack_id, n), else the sum of its
    counters; zeros count as not said."""
    counted = packs.join(lines.select("pack_id", F.col("n").alias("__n")), "pack_id", "left")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in COUNTERS if c in packs.columns), F.lit(0).cast("long"))
    return counted.select("pack_id", F.coalesce(F.nullif("manifest_rows", F.lit(0)), F.nullif("__n", F.lit(0)), F.nullif(total, F.lit(0)), F.lit(0)).cast("long").alias("rows"))


def project_ids(names: DataFrame, name: str, order: str) -> DataFrame:
    """A project_id for each row: the slug of its name, with -2, -3 ... for later rows of equal slugs."""
    own = F.coalesce(F.nullif(slug(F.col(name)), F.lit("")), F.lit("project"))
    place = F.row_number().over(Window.partitionBy("__slug").orderBy(order))
    numbered = names.withColumn("__slug", own).withColumn("__place", place)
    return numbered.withColumn("project_id", F.when(F.col("__place") == 1, F.col("__slug")).otherwise(F.concat_ws("-", "__slug", "__place"))).drop("__slug", "__place")


def seeded(packs: DataFrame, groups: dict[str, str], existing: DataFrame) -> DataFrame:
    """project_id and pack_id for packs whose id contains one of the words; nothing if any project exists."""
    out = F.lit(None).cast("string")
    for word, project in reversed(groups.items()):
        out = F.when(F.contains(F.lower("pack_id"), F.lit(word.lower())), project).otherwise(out)
    none = F.broadcast(existing.agg(F.count(F.lit(1)).alias("__n")).filter("__n = 0"))  # one row
    return packs.select(out.alias("project_id"), "pack_id").filter("project_id IS NOT NULL").join(none, F.lit(True), "left_semi")


def entity_rows(exported: DataFrame, indexed: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Entities of packs (pack_id, entity_type, ...): exported rows where a pack has any, else its rows in the index."""
    out = exported.unionByName(indexed.join(exported.select("pack_id").distinct(), "pack_id", "left_anti"))
    return out if types is None else out.filter(F.upper("entity_type").isin([t.upper() for t in types]))


def text_entities(exported: DataFrame, indexed: DataFrame) -> DataFrame:
    """The entities that a search looks through."""
    return entity_rows(exported, indexed, TEXT_TYPES)
