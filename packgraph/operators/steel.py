"""A steel model: parts with their materials and sections, fasteners, and the tables of the hierarchy above them.

Parts: id, module_type, module_id, assembly_id, is_main, role, category, material_id, section_id, length_m, weight_kg, x, y, z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.operators import graph as G
from packgraph.operators import rollup as R
from packgraph.operators.dealing import dealt, distinct

#: Profile groups in the order in which they are tried: the standard as a whole, parts of the standard, beginnings of the
#: name, and the group's Korean names, which searches use too (fixed values).
PROFILES = (
    ("C-Channel", ("Korea C-Channels",), (), (), ("씨찬넬", "씨잔넬")),
    ("Channel", ("Korea Channels",), (), (), ("찬넬", "잔넬", "ㄷ형강")),
    ("H-Beam", ("Korea H-Beam",), (), ("H ",), ("H형강", "에이치형강")),
    ("Angle", (), ("Angle",), ("L ",), ("앵글", "ㄱ형강")),
    ("Tube", (), ("Square", "Rectangular"), ("Q", "RHS", "SQ"), ("각관", "사각관")),
    ("Plate", (), (), ("PL ",), ("플레이트", "철판", "판재")),
)


def profile_group(name: Column, standard: Column | None = None) -> Column:
    """The first group that a section's standard or name says, else null."""
    standard = F.coalesce(standard, F.lit("")) if standard is not None else F.lit("")
    name = F.coalesce(name, F.lit(""))
    out = F.lit(None).cast("string")
    for group, whole, parts, begins, _ in reversed(PROFILES):
        test = standard.isin(list(whole)) if whole else F.lit(False)
        for x in parts:
            test = test | F.contains(standard, F.lit(x))
        for x in begins:
            test = test | name.startswith(x)
        out = F.when(test, group).otherwise(out)
    return out


def profile_names(group: Column) -> Column:
    """The words by which a group is searched, as an array; empty without a group."""
    out = F.array().cast("array<string>")
    for name, *_, korean in PROFILES:
        out = F.when(group == name, F.array(F.lit(name), *[F.lit(k) for k in korean])).otherwise(out)
    return out


def enriched_parts(parts: DataFrame, materials: DataFrame, sections: DataFrame, tasks: int | None = None) -> DataFrame:
    """Parts that have a module id and type, with names of their material and section, which so many ``tasks`` look up."""
    known = parts.filter("module_id IS NOT NULL AND module_type IS NOT NULL")
    m = materials.select(F.col("id").alias("material_id"), F.col("name").alias("material_name"))
    s = sections.select(F.col("id").alias("section_id"), F.col("name").alias("section_name"), profile_group(F.col("name"), F.col("standard") if "standard" in sections.columns else None).alias("profile_group"))
    return dealt(known.join(m, "material_id", "left"), tasks, "section_id").join(dealt(s, tasks, "section_id"), "section_id", "left")


def _sums() -> dict[str, Column]:
    return {"weight_kg": F.col("weight_kg").cast("decimal(28,6)"), "length_m": F.col("length_m").cast("decimal(28,6)")}


def assemblies(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per assembly: counts and sums, main and attached weight, and what is attached. ``tasks``: that group the parts."""
    main = F.coalesce("is_main", F.lit(False))
    keys = ["module_type", "module_id", "assembly_id"]
    alike = dealt(parts, tasks, *keys).groupBy(*keys, main.alias("main"), "role", "material_name", "section_name").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in _sums().items()])
    kg, item = F.col("weight_kg"), F.struct("role", "material_name", "section_name", "n", F.col("weight_kg").alias("kg"))
    lists = F.array_sort(F.collect_list(F.when(~F.col("main"), item)))
    sums = [F.sum(n).alias(n) for n in _sums()]
    weights = [F.sum(F.when(m, kg).otherwise(0)).alias(n) for n, m in (("main_kg", F.col("main")), ("attached_kg", ~F.col("main")))]
    found = alike.groupBy(*keys).agg(F.sum("n").alias("n"), *sums, *weights, lists.alias("attached"))
    return found.withColumn("attached", F.when(F.size("attached") > 0, F.col("attached")))


def modules(by_assembly: DataFrame) -> DataFrame:
    return R.raise_level(by_assembly, ["module_type", "module_id"], ["weight_kg", "length_m"]).withColumnRenamed("children", "assemblies")


def module_types(by_module: DataFrame) -> DataFrame:
    return R.raise_level(by_module, ["module_type"], ["weight_kg", "length_m"]).withColumnRenamed("children", "modules")


def breakdown(parts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Counts and sums by a column, one of category, role, material_name, section_name, profile_group."""
    return R.by_value(parts, keys, column, _sums())


def usage(parts: DataFrame, key: str) -> DataFrame:
    """Parts, weight and distinct modules of each section or material."""
    return R.level(parts, [key], _sums(), {"modules": F.struct("module_type", "module_id")})


def fasteners(patterns: DataFrame) -> DataFrame:
    """By description, grade, standard, diameter and length: patterns and pieces. A grid has nx * ny pieces, an anchor as many
    as it has locations; patterns where both are known and differ are counted. patterns: kind, nx, ny, n_locations, ..."""
    grid = F.col("nx") * F.col("ny")
    pieces = F.when(F.col("kind") == "anchor", F.col("n_locations")).otherwise(F.coalesce(grid, F.col("n_locations")))
    named = patterns.withColumn("spec", F.coalesce(F.col("description"), R.fastener_name(F.col("diameter_m"), F.col("length_m")), F.col("standard")))
    return named.groupBy("kind", "spec", "grade", "standard", "diameter_m", "length_m").agg(F.count(F.lit(1)).alias("patterns"), F.sum(pieces).alias("pieces"), F.count_if(grid != F.col("n_locations")).alias("mismatches"))


def model_totals(parts: DataFrame) -> DataFrame:
    """One row: counts, weight, extents and how many rows lack something."""
    lacks = {c: F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("assembly_id", "material_id", "section_id", "weight_kg")}
    ends = [f(F.col(a)).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return parts.agg(F.count(F.lit(1)).alias("n"), F.sum(_sums()["weight_kg"]).alias("weight_kg"), F.countDistinct("module_type", "module_id").alias("modules"), *ends, *lacks.values())


def hierarchy_edges(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """module type, module, assembly, part, and the parts' materials and sections, each once: made in one pass over the parts, and
    repeats are found by so many ``tasks``."""
    made = [
        (("module_type", "module_type"), ("module", "module_id"), "has_module"), (("module", "module_id"), ("assembly", "assembly_id"), "has_assembly"), (("assembly", "assembly_id"), ("part", "id"), "has_single_part"),
        (("part", "id"), ("material", "material_id"), "uses_material"), (("part", "id"), ("section", "section_id"), "uses_section"),
    ]
    each = parts.select(F.explode(F.array(*[F.struct(G.node_key(*a).alias("source"), F.lit(r).alias("relation"), G.node_key(*b).alias("target")) for a, b, r in made])).alias("e")).select("e.*")
    return distinct(each.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").select("source", "target", "relation"), tasks)
