"""The package of a steel model: its objects become materials, sections, parts, assemblies, modules, fasteners, edges and views.

Input are outermost objects (class, text, and block and at for their order) as ``sources.steel_xml`` reads them. References may point
forward: they are ids that are joined, and those without an object are reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.operators import steel as ST
from packgraph.operators.dealing import dealt, distinct, tasks_for
from packgraph.operators.numbering import numbered
from packgraph.operators.suite import object_id, view_id
from packgraph.scratch import Scratch
from packgraph.sources import steel_xml as X

#: Classes of parts with their categories (fixed values).
PARTS = {"CGREXBeam": "Beam", "CGREXColumn": "Column", "CGREXPlate": "Plate", "CGREXFoldedPlate": "FoldedPlate"}
MATERIAL, SECTION, BOLT, BOLTS, ANCHORS = "CGREXMaterial", "CGREXSection", "CGREXBolt", "CGREXBoltPattern", "CGREXAnchorPattern"
#: Texts, numbers and points of a part by column (fixed values).
PART_TEXTS = {"name": "m_strName", "mark": "m_strMark", "single_part_mark": "m_strSinglePartMark", "role": "m_strRole", "module_id": "m_UserAttributes_0", "module_type": "m_UserAttributes_1", "joint_transfer_id": "m_strJointTransferID"}
PART_NUMBERS = {"length_m": "m_Length", "width_m": "m_Width", "height_m": "m_Height", "volume_m3": "m_Volume", "painted_area_m2": "m_PaintedArea"}
PART_POINTS = {"cad_start": "m_pCADStart", "cad_end": "m_pCADEnd", "gravity_center": "m_GravityCenter", "normal": "m_pNormal"}
_T = "text"


def raw_parts(objects: DataFrame) -> DataFrame:
    """One row for each part with the ids that it refers to; a part without an id is left out."""
    category = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])[F.col("class")]
    positive = lambda c: F.when(c != 0, c)
    weight = F.coalesce(positive(X.real(_T, "m_ExactWeight")), positive(X.real(_T, "m_dfWeight")), F.lit(0.0))
    assembly = X.reference(_T, "m_pMainPartEx")
    rows = objects.filter(F.col("class").isin(*PARTS)).withColumn("source_id", X.whole(_T, "m_nID")).filter("source_id IS NOT NULL")
    return rows.select(
        object_id("single_part", F.col("source_id")).alias("id"), "source_id", F.col("class").alias("source_class"), category.alias("category"), "block", "at", *[X.text_of(_T, t).alias(c) for c, t in PART_TEXTS.items()],
        assembly.alias("main_part_id"), object_id("assembly", F.coalesce(assembly.cast("string"), F.concat(F.lit("orphan-"), F.col("source_id").cast("string")))).alias("assembly_id"),
        F.coalesce(X.whole(_T, "m_bIsMainPart") != 0, F.lit(False)).alias("is_main"), (X.whole(_T, "m_bIsStructuralPart") != 0).alias("is_structural"), X.reference(_T, "m_pMaterial").alias("material_ref"),
        F.coalesce(X.reference(_T, "m_pSectionStart"), X.reference(_T, "m_pSectionEnd")).alias("section_ref"), *[X.real(_T, t).alias(c) for c, t in PART_NUMBERS.items()], weight.alias("weight_kg"), *[X.point(_T, t).alias(c) for c, t in PART_POINTS.items()],
    )


def raw_materials(objects: DataFrame) -> DataFrame:
    numbers = {"density_kg_m3": "m_dfDensity", "young_modulus_pa": "m_dfYoung", "fy_pa": "m_dfFy", "fu_pa": "m_dfFu"}
    return _last(objects.filter(F.col("class") == MATERIAL).select(X.whole(_T, "m_nID").alias("source_id"), "block", "at", X.text_of(_T, "m_strName").alias("name"), X.whole(_T, "m_nType").alias("material_type"), *[X.real(_T, t).alias(c) for c, t in numbers.items()]))


def raw_sections(objects: DataFrame) -> DataFrame:
    texts = {"section_name": "m_strName", "standard": "m_strStandard", "internal_name": "m_strInternalName", "section_class": "m_strClass"}
    return _last(objects.filter(F.col("class") == SECTION).select(X.whole(_T, "m_nID").alias("source_id"), "block", "at", *[X.text_of(_T, t).alias(c) for c, t in texts.items()], X.whole(_T, "m_Family").alias("family")))


def _last(rows: DataFrame) -> DataFrame:
    """Of rows with one id, the last of the file."""
    rest = [c for c in rows.columns if c not in ("source_id", "block", "at")]
    return rows.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.max_by(F.struct(*rest), F.struct("block", "at")).alias("m")).select("source_id", "m.*")


def named_parts(parts: DataFrame, materials: DataFrame, sections: DataFrame) -> DataFrame:
    """Parts with the names of their material and section, and their profile group."""
    m = materials.select(F.col("source_id").alias("material_ref"), F.col("name").alias("material_name"), F.lit(True).alias("has_material"))
    s = sections.select(F.col("source_id").alias("section_ref"), F.col("section_name").alias("named"), F.col("standard").alias("section_standard"), F.lit(True).alias("has_section"))
    met = parts.join(m, "material_ref", "left").join(s, "section_ref", "left").withColumn("section_name", F.when(F.col("has_section"), F.col("named")).otherwise(F.col("name")))
    group = ST.profile_group(F.col("section_name"), F.col("section_standard"))
    return met.withColumns({"material_id": object_id("material", F.col("material_ref")), "section_id": object_id("section", F.col("section_ref")), "profile_group": group}).drop("named")


def unresolved(parts: DataFrame, patterns: DataFrame) -> DataFrame:
    """kind, id and n: references of parts (named) and fastener patterns to objects that are not there."""
    of = lambda kind, ref, has: parts.filter(F.col(ref).isNotNull() & F.col(has).isNull()).groupBy(F.lit(kind).alias("kind"), F.col(ref).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    each = patterns.select(F.explode("connected").alias("id")).join(parts.select(F.col("source_id").alias("id")), "id", "left_anti")
    return of("material", "material_ref", "has_material").unionByName(of("section", "section_ref", "has_section")).unionByName(each.groupBy(F.lit("part").alias("kind"), "id").agg(F.count(F.lit(1)).alias("n")))


def quality(parts: DataFrame) -> DataFrame:
    """One row: parts, and how many lack a module, a type, an assembly or a weight, or are left out for want of the first two."""
    lacks = {"missing_module_id": F.col("module_id").isNull(), "missing_module_type": F.col("module_type").isNull(), "orphans": F.col("main_part_id").isNull(), "zero_weight": F.col("weight_kg") == 0}
    return parts.agg(F.count(F.lit(1)).alias("parts"), *[F.count_if(c).alias(n) for n, c in lacks.items()], F.count_if(lacks["missing_module_id"] | lacks["missing_module_type"]).alias("excluded"))


def _total(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(28,6)"))


def _totals() -> list[Column]:
    main = F.col("is_main")
    return [F.count(F.lit(1)).alias("parts"), F.count_if(main).alias("main_parts"), F.count_if(~main).alias("attached_parts"), _total("weight_kg").alias("weight_kg"), F.coalesce(_total("length_m"), F.lit(0)).alias("length_m")]


def assemblies(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each assembly: its main part (the first one, or else the first part), modules, types and sums. ``tasks``: that group the parts."""
    facts = F.struct("id", "is_main", "mark", "role", "category", "name", "single_part_mark", "material_name", "section_name", F.col("weight_kg").alias("kg"))
    first = F.min_by(facts, F.struct((~F.col("is_main")).alias("rest"), "block", "at"))
    only = lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))
    sums = [F.coalesce(F.sum(F.when(F.col("is_main") == m, F.col("weight_kg").cast("decimal(28,6)"))), F.lit(0)).alias(n) for n, m in (("main_weight_kg", True), ("attached_weight_kg", False))]
    rows = dealt(parts, tasks, "assembly_id").groupBy("assembly_id").agg(first.alias("m"), F.array_sort(F.collect_set("module_id")).alias("module_ids"), F.array_sort(F.collect_set("module_type")).alias("module_types"), *_totals(), *sums)
    main = F.when(F.col("m.is_main"), F.col("m.id"))
    return rows.select("assembly_id", F.col("m.mark").alias("assembly_mark"), F.col("m.role").alias("assembly_role"), main.alias("main_single_part_id"), F.col("m.name").alias("main_part_name"), F.col("m.section_name").alias("main_section"), only(F.col("module_ids")).alias("module_id"), "module_ids", only(F.col("module_types")).alias("module_type"), "module_types", "parts", "main_parts", "attached_parts", "weight_kg", "main_weight_kg", "attached_weight_kg", "length_m")


def modules(parts: DataFrame) -> DataFrame:
    only = F.when(F.countDistinct("module_type") == 1, F.min("module_type"))
    return parts.groupBy("module_id").agg(only.alias("module_type"), F.countDistinct("assembly_id").alias("assemblies"), *_totals())


def module_types(parts: DataFrame) -> DataFrame:
    """One row for each type with whole modules: a module counts under each type that one of its parts has."""
    pairs = parts.select("module_id", "module_type").distinct()
    of_module = parts.groupBy("module_id").agg(*_totals())
    sums = pairs.join(of_module, "module_id").groupBy("module_type").agg(F.count(F.lit(1)).alias("modules"), *[F.sum(c).alias(c) for c in ("parts", "main_parts", "attached_parts", "weight_kg", "length_m")])
    made = pairs.join(parts.select("module_id", "assembly_id").distinct(), "module_id").groupBy("module_type").agg(F.countDistinct("assembly_id").alias("assemblies"))
    return sums.join(made, "module_type")


def used(things: DataFrame, parts: DataFrame, ref: str, prefix: str) -> DataFrame:
    """Materials or sections with the parts, modules and weight that use them."""
    uses = parts.groupBy(F.col(ref).alias("source_id")).agg(F.count(F.lit(1)).alias("used_by_parts"), F.countDistinct("module_id").alias("used_by_modules"), _total("weight_kg").alias("weight_kg"))
    return things.join(uses, "source_id", "left").fillna(0, ["used_by_parts", "used_by_modules", "weight_kg"]).withColumn("id", object_id(prefix, F.col("source_id")))


def fastener_patterns(objects: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each bolt or anchor pattern: what it is made of, how many pieces, and the modules and assemblies of the parts that
    it connects. An anchor has as many pieces as locations if they are given, else as its grid."""
    kind = F.when(F.col("class") == ANCHORS, "anchor").otherwise("bolt")
    nx, ny, places = X.whole(_T, "m_nNumberOnX"), X.whole(_T, "m_nNumberOnY"), X.whole(_T, "m_tabLocations_SIZE")
    grid = F.coalesce(nx, F.lit(0)) * F.coalesce(ny, F.lit(0))
    rows = objects.filter(F.col("class").isin(BOLTS, ANCHORS)).select(kind.alias("kind"), "block", "at", *_spec(), nx.alias("nx"), ny.alias("ny"), grid.alias("grid"), places.alias("locations"), X.point(_T, "m_pOrigin").alias("origin"), X.references(_T, "m_tabConnectedObjects").alias("connected"))
    rows = rows.withColumn("quantity", F.when((F.col("kind") == "anchor") & F.col("locations").isNotNull(), F.col("locations")).otherwise(F.col("grid")))
    named = numbered(rows, ["kind"], ["block", "at"], "n").withColumn("id", view_id("fastener_pattern", F.col("kind"), F.col("n") + 1)).drop("n")
    reached = named.select("id", F.explode("connected").alias("source_id")).join(parts.select("source_id", "module_id", "assembly_id"), "source_id")
    sets = reached.groupBy("id").agg(F.array_sort(F.collect_set("module_id")).alias("module_ids"), F.array_sort(F.collect_set("assembly_id")).alias("assembly_ids"))
    none = F.array().cast("array<string>")
    return named.join(sets, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("module_ids", "assembly_ids")})


def _spec() -> list[Column]:
    mm = lambda t: F.bround(X.real(_T, t) * 1000, 0).cast("long")
    d, n = mm("m_dfDiameter"), mm("m_dfLength")
    standard = F.coalesce(X.text_of(_T, "m_strNorm"), X.text_of(_T, "m_strAnchorType"), F.lit("(blank)"))
    name = F.when((d != 0) & (n != 0), F.concat(F.lit("M"), d.cast("string"), F.lit("x"), n.cast("string")))
    return [name.alias("description"), d.alias("diameter_mm"), n.alias("length_mm"), X.text_of(_T, "m_strMaterial").alias("grade"), standard.alias("standard"), F.coalesce(X.text_of(_T, "m_strBoltSet"), X.text_of(_T, "m_strAnchorSet")).alias("set_name")]


def fastener_specs(objects: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pieces by kind (bolt objects, bolt and anchor patterns) and description, grade, standard, diameter and length, with patterns whose
    grid lacks a number or, of anchors, differs from their locations."""
    keys = ["description", "grade", "standard", "diameter_mm", "length_mm"]
    single = objects.filter(F.col("class") == BOLT).select(F.lit("bolt_object").alias("kind"), *_spec()).groupBy("kind", *keys).agg(F.count(F.lit(1)).alias("quantity"), F.lit(0).cast("long").alias("no_grid"), F.lit(0).cast("long").alias("mismatches"))
    odd = (F.col("kind") == "anchor") & F.col("locations").isNotNull() & (F.col("grid") != 0) & (F.col("locations") != F.col("grid"))
    made = patterns.groupBy(F.concat("kind", F.lit("_pattern")).alias("kind"), *keys).agg(F.sum("quantity").alias("quantity"), F.count_if(F.col("nx").isNull() | F.col("ny").isNull()).alias("no_grid"), F.count_if(odd).alias("mismatches"))
    return single.unionByName(made)


def edges(parts: DataFrame, built: DataFrame, tasks: int | None = None) -> DataFrame:
    """source, relation and target of the hierarchy and of what parts are made of, each once. ``tasks``: that find repeats."""
    module, kind = object_id("module", F.col("module_id")), object_id("module_type", F.col("module_type"))
    made = [
        (kind, "has_module", module), (module, "has_assembly", F.col("assembly_id")), (F.col("assembly_id"), "has_single_part", F.col("id")), (F.col("id"), "part_of_assembly", F.col("assembly_id")),
        (F.col("id"), "belongs_to_module", module), (F.col("id"), "has_material", F.col("material_id")), (F.col("id"), "has_section", F.col("section_id")),
    ]
    each = parts.select(F.explode(F.array(*[F.struct(a.alias("source"), F.lit(r).alias("relation"), b.alias("target")) for a, r, b in made])).alias("e")).select("e.*")
    main = built.filter("main_single_part_id IS NOT NULL").select(F.col("assembly_id").alias("source"), F.lit("has_main_part").alias("relation"), F.col("main_single_part_id").alias("target"))
    return distinct(each.filter("source IS NOT NULL AND target IS NOT NULL").unionByName(main), tasks)


def _view(rows: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return rows.select(view_id(name, *[F.col(k) for k in keys]).alias("view_id"), "*")


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("(blank)")).alias(c)


def _by_mark(built: DataFrame) -> DataFrame:
    marks = built.select(F.explode("module_ids").alias("module_id"), _blank("assembly_mark"), "assembly_role", "parts", F.col("weight_kg"))
    return marks.groupBy("module_id", "assembly_mark").agg(F.min("assembly_role").alias("assembly_role"), F.count(F.lit(1)).alias("assemblies"), F.sum("parts").alias("parts"), F.sum("weight_kg").alias("weight_kg"))


#: The tables of a model, of its objects, all parts with their names (every), those with a module and type (single_parts) and one another,
#: and its seven views for users: modules, assemblies, assemblies by mark, profiles and materials of modules, fasteners, and the words by
#: which profiles are searched.
TABLES: dict[str, Callable[[Package], DataFrame]] = {
    "materials": lambda t: used(raw_materials(t.objects), t["single_parts"], "material_ref", "material"), "sections": lambda t: used(raw_sections(t.objects), t["single_parts"], "section_ref", "section"),
    "single_parts": lambda t: t.every.filter("module_id IS NOT NULL AND module_type IS NOT NULL"), "assemblies": lambda t: t.put("assemblies", assemblies(t["single_parts"], tasks_for(t.every))),
    "modules": lambda t: modules(t["single_parts"]), "module_types": lambda t: module_types(t["single_parts"]), "fastener_patterns": lambda t: t.put("patterns", fastener_patterns(t.objects, t["single_parts"])),
    "edges": lambda t: edges(t["single_parts"], t["assemblies"], tasks_for(t.every, 8)), "fastener_specs": lambda t: fastener_specs(t.objects, t["fastener_patterns"]),
    "unresolved": lambda t: unresolved(t.every, t["fastener_patterns"]), "quality": lambda t: quality(t.every),
    "module_user_view": lambda t: _view(t["modules"], "module", ["module_id"]), "assembly_user_view": lambda t: _view(t["assemblies"], "assembly", ["assembly_id"]),
    "assembly_mark_summary_view": lambda t: _view(_by_mark(t["assemblies"]), "assembly_mark", ["module_id", "assembly_mark"]),
    "module_profile_summary_view": lambda t: _view(t["single_parts"].groupBy("module_id", _blank("profile_group"), _blank("section_name")).agg(*_totals()), "module_profile", ["module_id", "profile_group", "section_name"]),
    "module_material_summary_view": lambda t: _view(t["single_parts"].groupBy("module_id", _blank("material_name")).agg(*_totals()), "module_material", ["module_id", "material_name"]),
    "model_fastener_user_view": lambda t: _view(t["fastener_specs"], "fastener", ["kind", "description", "grade", "standard"]),
    "query_aliases": lambda t: t["single_parts"].filter("profile_group IS NOT NULL").select("profile_group").distinct().select("profile_group", ST.profile_names(F.col("profile_group")).alias("words")),
}


class Package(Mapping[str, DataFrame]):
    """The tables and views of a model by name. The objects and their parts' facts are written once; everything else is made of them when
    it is first asked for."""

    def __init__(self, objects: DataFrame):
        self._scratch, self._made = Scratch(objects.sparkSession, "steel"), {}
        self.objects = self.put("objects", objects.select("class", "text", "block", "at"))
        self.every = self.put("parts", named_parts(raw_parts(self.objects), raw_materials(self.objects), raw_sections(self.objects)))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        return self._scratch.put(name, df)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = TABLES[name](self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def package(objects: DataFrame) -> Package:
    """The tables and views of a model. Parts without a module or type are counted in ``quality`` and left out of the others."""
    return Package(objects)
