"""The tables of a building model in STEP text: elements with their storey, building, type, properties and host, and their groups.

Input are instances (id, type, args) as ``sources.step`` reads them. Where several instances say the same, that of the greatest id
holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.operators import graph as G
from packgraph.operators.bim import ifc_family, module_kind
from packgraph.scratch import Scratch
from packgraph.sources.step import arg, reference, references, scalar, set_links, set_values

#: Categories of element types (fixed values).
CATEGORIES = {
    "IFCWALLSTANDARDCASE": "Wall", "IFCWALL": "Wall", "IFCDOOR": "Door", "IFCWINDOW": "Window", "IFCSLAB": "Slab", "IFCBEAM": "Beam", "IFCCOLUMN": "Column", "IFCPLATE": "Plate",
    "IFCBUILDINGELEMENTPROXY": "Proxy", "IFCCOVERING": "Covering", "IFCROOF": "Roof", "IFCSTAIR": "Stair", "IFCSTAIRFLIGHT": "Stair", "IFCRAILING": "Railing", "IFCFURNISHINGELEMENT": "Furnishing",
    "IFCMEMBER": "Member", "IFCFLOWSEGMENT": "MEP", "IFCFLOWFITTING": "MEP", "IFCFLOWTERMINAL": "MEP", "IFCDISTRIBUTIONELEMENT": "MEP",
}
#: Types of an element's style (fixed values).
STYLES = ("IFCDOORSTYLE", "IFCWINDOWSTYLE")
#: Levels of the spatial tree (fixed values).
LEVELS = {"storey": "IFCBUILDINGSTOREY", "building": "IFCBUILDING", "site": "IFCSITE", "project": "IFCPROJECT"}
#: Property names that are left out, property sets of a style that are named apart, and those with quantities and their names (fixed values).
LEFT_OUT = ("Module Number", "Module Type", "Module Type(AR)")
OF_TYPE = ("Dimensions", "Other", "Construction", "Identity Data", "Analytical Properties")
QUANTITY_SETS = ("Dimensions", "Structural", "Pset_QuantityTakeOff")
QUANTITY_KEYS = ("length", "area", "volume", "width", "height", "weight", "cut length")
#: Relations that put a child below a parent: type, place of the children, place of the parent, rank (fixed values).
RELATIONS = (
    ("IFCRELCONTAINEDINSPATIALSTRUCTURE", 4, 5, 4), ("IFCRELAGGREGATES", 5, 4, 3), ("IFCRELFILLSELEMENT", 5, 4, 2), ("IFCRELVOIDSELEMENT", 5, 4, 1),
)
UNASSIGNED, NO_STOREY, NO_TYPE = "__UNASSIGNED__", "__NO_STOREY__", "__NO_TYPE__"


def parents(rows: DataFrame) -> DataFrame:
    """id and parent of whatever is contained, part of a whole, filling an opening or an opening in an element; containment comes
    first of several."""
    out = None
    for kind, child, parent, rank in RELATIONS:
        part = rows.filter(F.col("type") == kind).select(F.explode(references(arg(child))).alias("id"), F.struct(F.lit(rank).alias("rank"), F.col("id").alias("by"), reference(arg(parent)).alias("parent")).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out.filter("p.parent IS NOT NULL").groupBy("id").agg(F.max("p").alias("p")).select("id", F.col("p.parent").alias("parent"))


def spatial(rows: DataFrame) -> DataFrame:
    """id and the nearest storey, building, site and project above it, for every instance that has a parent or is one of them."""
    kinds = rows.filter(F.col("type").isin(*LEVELS.values()) | F.col("type").isin(*CATEGORIES) | (F.col("type") == "IFCOPENINGELEMENT")).select("id", "type")
    kind = F.lit(None).cast("string")
    for name, t in LEVELS.items():
        kind = F.when(F.col("type") == t, name).otherwise(kind)
    return G.nearest_above(kinds.join(parents(rows), "id", "left").select("id", "parent", kind.alias("kind")), list(LEVELS))


def storeys(rows: DataFrame) -> DataFrame:
    number = scalar(arg(9)).try_cast("double")
    return rows.filter("type = 'IFCBUILDINGSTOREY'").select(F.concat(F.lit("ifc:storey:"), F.col("id").cast("string")).alias("storey_id"), "id", scalar(arg(0)).alias("guid"), scalar(arg(2)).alias("name"), scalar(arg(7)).alias("long_name"), number.alias("elevation"))


def properties(rows: DataFrame) -> DataFrame:
    """element, pset, key and value: an element's own property sets, and below them those of the style whose tag is its type id."""
    values = set_values(rows).filter(~F.col("key").isin(*LEFT_OUT))
    last = lambda df, *keys: df.groupBy(*keys, "pset", "key").agg(F.max_by("value", "set_id").alias("value"))
    products = rows.filter(F.col("type").isin(*CATEGORIES)).select(F.col("id").alias("element"))
    own = last(set_links(rows).join(products, "element", "left_semi").join(values, "set_id"), "element")
    styles = rows.filter(F.col("type").isin(*STYLES)).select(scalar(arg(7)).alias("type_id"), F.explode(references(arg(5))).alias("set_id")).filter("type_id IS NOT NULL")
    named = F.when(F.col("pset").isin(*OF_TYPE), F.concat("pset", F.lit("(Type)"))).otherwise(F.col("pset"))
    of_style = last(styles.join(values.withColumn("pset", named), "set_id"), "type_id")
    typed = own.filter("pset = 'Other' AND key = 'Type Id'").select("element", F.col("value").alias("type_id"))
    both = own.withColumn("rank", F.lit(0)).unionByName(typed.join(of_style, "type_id").select("element", "pset", "key", "value", F.lit(1).alias("rank")))
    return both.groupBy("element", "pset", "key").agg(F.max_by("value", "rank").alias("value"))  # a style's value replaces an equal name


def _maps(props: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The properties of each element as maps by property set, and its quantities as a map."""
    sets = props.groupBy("element", "pset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("values"))
    named = sets.groupBy("element").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pset", F.col("values"))), lambda a, b: F.when(a["pset"] < b["pset"], -1).when(a["pset"] > b["pset"], 1).otherwise(0))).alias("properties"))
    measured = props.filter(F.col("pset").isin(*QUANTITY_SETS) & F.lower("key").isin(*QUANTITY_KEYS)).groupBy("element", "key").agg(F.max_by("value", "pset").alias("value"))
    quantities = measured.groupBy("element").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("quantities"))
    return named, quantities


def elements(rows: DataFrame, props: DataFrame, maps: bool = True) -> DataFrame:
    """One row for each element with its place, module, type, properties (as maps by property set), quantities and host. props: as
    ``properties`` gives them. Without ``maps``, properties and quantities are left out, which need three groupings of all values."""
    of = lambda pset, key: F.max(F.when((F.col("pset") == pset) & (F.col("key") == key), F.col("value")))
    facts = props.groupBy("element").agg(of("Identity Data", "Workset").alias("workset"), of("Other", "Host Id").alias("host_tag"), of("Constraints", "Host").alias("host"), F.count(F.lit(1)).alias("n_properties"))
    made = rows.filter(F.col("type").isin(*CATEGORIES)).select(F.col("id").alias("element"), F.col("type").alias("ifc_type"), scalar(arg(0)).alias("guid"), scalar(arg(2)).alias("name"), scalar(arg(4)).alias("object_type"), scalar(arg(7)).alias("tag"))
    category = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[F.col("ifc_type")]
    for more in (facts, *(_maps(props) if maps else ())):
        made = made.join(more, "element", "left")
    place = spatial(rows).select(F.col("id").alias("element"), "storey", "building")
    named = storeys(rows).select(F.col("id").alias("storey"), F.col("name").alias("storey_name"))
    buildings = rows.filter("type = 'IFCBUILDING'").select(F.col("id").alias("building"), scalar(arg(2)).alias("building_name"))
    found = made.join(place, "element", "left").join(named, "storey", "left").join(buildings, "building", "left")
    f = ifc_family(F.col("object_type"), F.col("name"))
    module = F.coalesce(F.nullif("workset", F.lit("")), F.lit(UNASSIGNED))
    host = lambda c: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", "-"), F.col(c))
    empty = {"properties": "map<string, map<string, string>>", "quantities": "map<string, string>"} if maps else {}
    held = [F.coalesce(c, F.expr(f"CAST(map() AS {t})")).alias(c) for c, t in empty.items()]
    return found.select(
        F.concat(F.lit("ifc:element:"), F.col("element").cast("string")).alias("id"), "element", "guid", "tag", "ifc_type", category.alias("category"), "name", f["family"].alias("family"), f["type"].alias("type_name"), "object_type",
        F.col("storey_name").alias("storey"), F.concat(F.lit("ifc:storey:"), F.col("storey").cast("string")).alias("storey_id"), F.col("building_name").alias("building"), module.alias("module_id"),
        F.when(module == UNASSIGNED, "missing_workset").otherwise("Workset").alias("module_source"), module_kind(F.col("workset")).alias("module_kind"), F.coalesce("n_properties", F.lit(0)).alias("n_properties"),
        *held, host("host_tag").alias("host_tag"), host("host").alias("host"),
    )


def hosts(found: DataFrame) -> DataFrame:
    """element, host_tag, host and, of the element that has the tag (the last one), category, family and type of those elements that name
    a host. Many elements may name one host: its row is looked up by tag, with a row for each tag."""
    tags = found.filter("tag <> ''").groupBy("tag").agg(F.max(F.struct("element", "category", "family", "type_name")).alias("h"))
    named = found.filter("host_tag IS NOT NULL OR host IS NOT NULL").select("element", "host_tag", "host")
    met = named.join(tags.withColumnRenamed("tag", "host_tag"), "host_tag", "left")
    return met.select("element", "host_tag", "host", F.col("h.category").alias("host_category"), F.col("h.family").alias("host_family"), F.col("h.type_name").alias("host_type_name"))


def of_users(found: DataFrame) -> DataFrame:
    """Elements of modules and of work on the site."""
    return found.filter(F.col("module_kind").isin("module", "site_work"))


#: Counted kinds of elements of a group (fixed values).
COUNTED = {"doors": "Door", "windows": "Window", "walls": "Wall", "slabs": "Slab", "beams": "Beam", "columns": "Column"}


def _keys(by: Sequence[str]) -> list[Column]:
    blank = {"storey": NO_STOREY, "type_name": NO_TYPE}
    return [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(blank[c])).alias(c) if c in blank else F.col(c) for c in by]


def groups(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Users' elements by module_id, storey, category or type_name, or several of them: how many, of which kinds, and how many
    storeys, categories, types and modules."""
    distinct = [F.countDistinct(F.nullif(F.col(c), F.lit(""))).alias(n) for c, n in (("storey", "storeys"), ("category", "categories"), ("type_name", "types"), ("module_id", "modules")) if c not in by]
    kinds = [F.count_if(F.col("category") == c).alias(n) for n, c in COUNTED.items()]
    named = of_users(found).select("*", *[k.alias(f"__{c}") for k, c in zip(_keys(by), by)])
    return named.groupBy(*[F.col(f"__{c}").alias(c) for c in by]).agg(F.count(F.lit(1)).alias("elements"), *kinds, *distinct)


def group_counts(found: DataFrame, by: str, of: str) -> DataFrame:
    """For each value of ``by``, how many users' elements have each value of ``of``: one row for each pair."""
    return of_users(found).groupBy(*_keys([by, of])).agg(F.count(F.lit(1)).alias("n"))


def workset_audit(found: DataFrame) -> DataFrame:
    """Worksets that are neither a module nor work on the site, with their elements."""
    return found.filter("module_kind = 'non_module_workset'").groupBy(F.col("module_id").alias("workset")).agg(F.count(F.lit(1)).alias("elements"))


def edges(found: DataFrame, project: str) -> DataFrame:
    """source, relation and target between project, modules, storeys, elements, categories and types of users' elements, each once."""
    rows = of_users(found)
    root, module = F.lit(f"ifc:project:{project}"), F.concat(F.lit("ifc:module:"), "module_id")
    storey, kind = F.concat(F.lit("ifc:storey_name:"), F.nullif(F.col("storey"), F.lit(""))), F.concat(F.lit("ifc:type:"), F.nullif(F.col("type_name"), F.lit("")))
    made = [(root, "has_module", module), (module, "has_storey", storey), (storey, "has_element", F.col("id")), (module, "has_element", F.col("id")), (F.col("id"), "has_category", F.concat(F.lit("ifc:category:"), "category")), (F.col("id"), "has_type", kind)]
    each = rows.select(F.explode(F.array(*[F.struct(a.alias("source"), F.lit(r).alias("relation"), b.alias("target")) for a, r, b in made])).alias("e")).select("e.*")
    return each.filter("source IS NOT NULL AND target IS NOT NULL").distinct()


class Model:
    """The tables of one model's instances. The instances are written once, since each table goes over them several times, and each
    table when it is first asked for. ``maps``: as ``elements`` takes it."""

    def __init__(self, rows: DataFrame, maps: bool = True):
        self._maps, self._scratch = maps, Scratch(rows.sparkSession, "ifc")
        self._rows = self._scratch.put("instances", rows.select("id", "type", "args"))

    @cached_property
    def properties(self) -> DataFrame:
        return self._scratch.put("properties", properties(self._rows))

    @cached_property
    def elements(self) -> DataFrame:
        return self._scratch.put("elements", elements(self._rows, self.properties, self._maps))

    @cached_property
    def storeys(self) -> DataFrame:
        return storeys(self._rows)

    def summary(self) -> DataFrame:
        """One row: elements in all, of users, with and without a workset, modules, sites and other worksets."""
        e = self.elements
        kinds = lambda k: F.count_if(F.col("module_kind") == k)
        named = lambda k: F.countDistinct(F.when(F.col("module_kind") == k, F.col("module_id")))
        return e.agg(
            F.count(F.lit(1)).alias("elements"), (kinds("module") + kinds("site_work")).alias("user_elements"), F.count_if(F.col("module_kind") != "missing_workset").alias("with_workset"), kinds("missing_workset").alias("without_workset"),
            named("module").alias("modules"), named("site_work").alias("sites"), kinds("non_module_workset").alias("other_workset_elements"),
        )


def model(rows: DataFrame, maps: bool = True) -> Model:
    return Model(rows, maps)
