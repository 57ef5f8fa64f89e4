"""Drawing entities: boxes, spatial predicates, dimensions, room tags, layer summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.functions.scalars import dimension_mm, orientation, room_tag
from packgraph.functions.texts import short_number
from packgraph.scratch import Scratch

#: Entity types that hold text (fixed values).
TEXT_TYPES = ("TEXT", "MTEXT", "DIMENSION", "LAYER")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))


def relates(b: Column, x1: float, y1: float, x2: float, y2: float, mode: str = "intersects") -> Column:
    """Whether a box is within, contains or intersects a rectangle; borders belong to both."""
    lo_x, hi_x, lo_y, hi_y = min(x1, x2), max(x1, x2), min(y1, y2), max(y1, y2)
    if mode == "within":
        return (b["x1"] >= lo_x) & (b["x2"] <= hi_x) & (b["y1"] >= lo_y) & (b["y2"] <= hi_y)
    if mode == "contains":
        return (b["x1"] <= lo_x) & (b["x2"] >= hi_x) & (b["y1"] <= lo_y) & (b["y2"] >= hi_y)
    return (b["x1"] <= hi_x) & (b["x2"] >= lo_x) & (b["y1"] <= hi_y) & (b["y2"] >= lo_y)


def box_orientation(b: Column) -> Column:
    return orientation(b["x2"] - b["x1"], b["y2"] - b["y1"])


def entity_class(kind: Column, layer: Column) -> Column:
    k = F.upper(kind)
    return (
        F.when(k == "DIMENSION", "dimension").when(k.isin("TEXT", "MTEXT") & F.lower(layer).contains("room"), "room_tag").when(k.isin("TEXT", "MTEXT"), "annotation")
        .when(k == "INSERT", "symbol").when(k == "HATCH", "hatch").when(k.isin("LINE", "LWPOLYLINE", "POLYLINE", "ARC", "CIRCLE"), "graphic").when(k == "LAYER", "layer").otherwise("drawing_entity")
    )


def filtered(rows: DataFrame, types: list[str] | None = None, sheet: str = "", source: str = "", layer: str = "") -> DataFrame:
    """Basic filters: types without case, the sheet as a whole, parts of source name or path and of the layer."""
    if types:
        rows = rows.filter(F.upper("entity_type").isin([t.upper() for t in types]))
    if sheet:
        rows = rows.filter(F.lower("sheet_no") == sheet.lower())
    if source:
        rows = rows.filter(F.contains(F.lower("source_file"), F.lit(source.lower())))
    return rows.filter(F.contains(F.lower("layer"), F.lit(layer.lower()))) if layer else rows


def summaries(rows: DataFrame) -> DataFrame:
    """Histograms by type, layer, source file and sheet in one pass: facet, value, n."""
    names = ["entity_type", "layer", "source_file", "sheet_no"]
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in names])).alias("p")).select("p.*")
    return pairs.filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def layer_summary(rows: DataFrame) -> DataFrame:
    low = rows.groupBy("layer", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return low.groupBy("layer").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("by_type"))


def dimensions(rows: DataFrame) -> DataFrame:
    """Rows whose text gives a length, with its value and direction."""
    return rows.withColumn("value_mm", dimension_mm(F.col("text"))).filter("value_mm IS NOT NULL").withColumn("direction", box_orientation(F.col("bbox")))


def area_from_dimensions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Square metres of the largest horizontal times the largest vertical length of each key."""
    sides = rows.groupBy(*keys).agg(F.max(F.when(F.col("direction") == "horizontal", F.col("value_mm"))).alias("w"), F.max(F.when(F.col("direction") == "vertical", F.col("value_mm"))).alias("h"))
    return sides.withColumn("area_m2", F.round(F.col("w") * F.col("h") / 1_000_000, 4))


def room_areas(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tag", room_tag(F.col("text"))).filter("tag IS NOT NULL").select(*[c for c in rows.columns], "tag.label", "tag.area", "tag.unit")


def box_of(bbox: Column, low: Column, high: Column, points: list[Column]) -> Column:
    """A box from an array of four numbers, else from its two corners (structs of x and y), else from the first point; null if
    nothing is whole."""
    at = lambda i: F.get(bbox, F.lit(i)).cast("double")
    listed = F.when((F.size(bbox) >= 4) & at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull(), F.struct(at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2")))
    whole = lambda *c: F.forall(F.array(*[x.cast("double") for x in c]), lambda x: x.isNotNull())
    d = lambda c: c.cast("double")
    cornered = F.when(whole(low["x"], low["y"], high["x"], high["y"]), F.struct(d(low["x"]).alias("x1"), d(low["y"]).alias("y1"), d(high["x"]).alias("x2"), d(high["y"]).alias("y2")))
    single = [F.when(whole(p["x"], p["y"]), F.struct(d(p["x"]).alias("x1"), d(p["y"]).alias("y1"), d(p["x"]).alias("x2"), d(p["y"]).alias("y2"))) for p in points]
    return F.coalesce(listed, cornered, *single)


def entity_text(kind: Column, measurement: Column, texts: list[Column]) -> Column:
    """What an entity says: a dimension's measured number, else the first text that it has, else nothing."""
    return F.coalesce(F.when(kind == "DIMENSION", short_number(measurement.try_cast("double"), 6)), *[t.cast("string") for t in texts], F.lit(""))


def rectangle(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Square metres of each key: its largest horizontal times its largest vertical length, or, where one of these is missing,
    its two lengths of highest confidence (then the largest)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("confidence").desc_nulls_last(), F.col("value_mm").desc()))
    top = rows.withColumn("__p", place)
    sides = top.groupBy(*keys).agg(*[F.max(F.when(F.col("direction") == d, F.col("value_mm"))).alias(n) for d, n in (("horizontal", "w"), ("vertical", "h"))], *[F.max(F.when(F.col("__p") == i, F.col("value_mm"))).alias(f"d{i}") for i in (1, 2)])
    both = F.col("w").isNotNull() & F.col("h").isNotNull()
    area = F.when(both, F.col("w") * F.col("h")).otherwise(F.col("d1") * F.col("d2"))
    return sides.select(*keys, F.round(area / 1_000_000, 4).alias("area_m2"), F.when(both, "directions").when(F.col("d2").isNotNull(), "confidence").alias("method"))


def nearby_labels(boxes: DataFrame, labels: DataFrame, sheet: list[str], radius: float, most: int = 5, crowd: int = 4096) -> DataFrame:
    """Each box with its nearest labels: the columns of sheet, box_id, label_id, distance and place (from 1, at most ``most``).

    boxes: sheet, box_id, x, y; labels: sheet, label_id, x, y; x and y are centres. A plane is cut into cells as wide as the radius, a box looks into
    its own cell and the eight around it, so no product of a sheet is made. Cells with over ``crowd`` labels are cut on into quarters, again and
    again, down to a 64th of their width; there, each box reads only the quarters that its circle can touch.
    """
    levels = 6
    cell = lambda c, width: F.floor(F.col(c) / F.lit(width))
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    labels = labels.filter(whole("x") & whole("y")).select(*sheet, "label_id", F.col("x").cast("double").alias("lx"), F.col("y").cast("double").alias("ly"))
    boxes = boxes.filter(whole("x") & whole("y")).select(*sheet, "box_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    scratch = Scratch(boxes.sparkSession, "nearby")
    labels = scratch.put("labels", labels)
    rest, found = labels, None
    for level in range(levels + 1):
        width = radius / (1 << level)
        placed = rest.withColumns({"cx": cell("lx", width), "cy": cell("ly", width)})
        last = level == levels
        if not last:
            full = scratch.put(f"full-{level}", placed.groupBy(*sheet, "cx", "cy").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).drop("n"))
            last = full.isEmpty()
        here = placed if last else placed.join(full, [*sheet, "cx", "cy"], "left_anti")
        reach = 1 << level
        near = lambda c: F.explode(F.sequence(cell(c, width) - reach, cell(c, width) + reach))  # noqa: B023, E731
        # Of the cells in the square around a box, those whose nearest corner is within the radius.
        gap = lambda c, k: F.greatest(F.col(k) * width - F.col(c), F.col(c) - (F.col(k) + 1) * width, F.lit(0.0))  # noqa: B023, E731
        looked = boxes.withColumn("cx", near("x")).withColumn("cy", near("y")).filter(F.hypot(gap("x", "cx"), gap("y", "cy")) <= radius)
        used = here.select(*sheet, "cx", "cy").distinct()
        met = looked.join(used, [*sheet, "cx", "cy"], "left_semi").join(here, [*sheet, "cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))).filter(F.col("distance") <= radius)
        met = met.select(*sheet, "box_id", "label_id", "distance")
        found = met if found is None else found.unionByName(met)
        if last:
            break
        rest = scratch.put(f"rest-{level}", placed.join(full, [*sheet, "cx", "cy"], "left_semi").drop("cx", "cy"))
    place = F.row_number().over(Window.partitionBy(*sheet, "box_id").orderBy("distance", "label_id"))
    return found.withColumn("place", place).filter(F.col("place") <= most)
