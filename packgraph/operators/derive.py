"""Derivation of facts from raw rows: rule classifiers, decisions, schedules, coverage, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.functions.scalars import short_id
from packgraph.operators.numbering import numbered

REVIEW_BELOW = 0.65


@dataclass(frozen=True)
class Rule:
    """A label for texts that contain one of the tokens, or match the pattern."""

    label: str
    tokens: tuple[str, ...] = ()
    pattern: str | None = None
    confidence: float = 0.9

    def matches(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        out = low.rlike(self.pattern) if self.pattern else F.lit(False)
        for t in self.tokens:
            out = out | F.contains(low, F.lit(t))
        return out


#: Rules for building elements, materials and quantities, first match wins (fixed values).
ELEMENTS = (Rule("structural", ("column", "beam", "brace", "foundation", "slab")), Rule("opening", ("door", "window", "curtain")), Rule("envelope", ("wall", "roof", "facade")), Rule("service", ("duct", "pipe", "cable", "fixture")))
MATERIALS = (Rule("concrete", ("concrete", "cement", "mortar")), Rule("steel", ("steel", "nickel", "brass", "copper", "tin")), Rule("wood", ("wood", "timber", "plywood")), Rule("glass", ("glass",)), Rule("coating", ("polished", "brushed", "plated", "anodized", "burnished")))
QUANTITIES = (Rule("area", ("area",), r"m2|㎡|m²"), Rule("volume", ("volume",), r"m3|m³"), Rule("length", ("length", "perimeter"), r"\bmm\b|\bm\b"), Rule("count", ("count", "number")))


def classify(text: Column, rules: Sequence[Rule], default: str = "unclassified") -> Column:
    """label, rule (its place, -1 for none) and confidence of the first rule that matches."""
    out = F.struct(F.lit(default).alias("label"), F.lit(-1).alias("rule"), F.lit(0.3).alias("confidence"))
    for i, r in reversed(list(enumerate(rules))):
        out = F.when(r.matches(text), F.struct(F.lit(r.label).alias("label"), F.lit(i).alias("rule"), F.lit(r.confidence).alias("confidence"))).otherwise(out)
    return out


def decisions(rows: DataFrame, source: str, key: str, text: Column, rules: Sequence[Rule]) -> DataFrame:
    """One decision for each raw row; review is asked for below a confidence."""
    c = rows.select(F.lit(source).alias("source_file"), F.col(key).cast("string").alias("source_id"), classify(text, rules).alias("c"))
    return c.select("source_file", "source_id", "c.label", "c.rule", "c.confidence", (F.col("c.confidence") < REVIEW_BELOW).alias("review_required"))


def schedule_rows(cells: DataFrame, schedule: str, row: str, column: str, text: str, name: str | None = None) -> DataFrame:
    """Cells of a row joined in column order, and the row's role: schedule_title if its first cell in row 0 is the schedule's name
    (the column ``name``), else column_header for rows 0 and 1, else data_row."""
    parts = F.array_sort(F.collect_list(F.struct(column, F.col(text).alias("t"))))
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    title = (F.col(row) == 0) & (F.col(column) == 0) & (said(text) == said(name)) if name else F.lit(False)
    rows = cells.groupBy(schedule, row).agg(F.array_join(F.transform(parts, lambda s: s["t"]), " | ").alias("row_text"), F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.bool_or(title), F.lit(False)).alias("titled"))
    role = F.when(F.col("titled"), "schedule_title").when(F.coalesce(F.col(row), F.lit(0)) <= 1, "column_header").otherwise("data_row")
    return rows.withColumn("role", role).drop("titled")


def carried_headers(cells: DataFrame, schedule: str, row: str, is_header: Column, value: Column) -> DataFrame:
    """Each row with the last header before it, in its own schedule only."""
    before = Window.partitionBy(schedule).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("header", F.last(F.when(is_header, value), ignorenulls=True).over(before))


def coverage(raw: DataFrame, key: str, decided: DataFrame, decided_key: str, derived: DataFrame, derived_key: str) -> DataFrame:
    """Each raw row with what came of it: mapped, classified_only or missing."""
    d = decided.select(F.col(decided_key).alias("__d")).distinct()
    m = derived.groupBy(F.col(derived_key).alias("__m")).agg(F.count(F.lit(1)).alias("n_derived"))
    out = raw.join(d, F.col(key) == F.col("__d"), "left").join(m, F.col(key) == F.col("__m"), "left")
    status = F.when(F.col("n_derived") > 0, "mapped").when(F.col("__d").isNotNull(), "classified_only").otherwise("missing")
    return out.select(key, F.coalesce("n_derived", F.lit(0)).alias("n_derived"), status.alias("status"))


def lineage(rows: DataFrame, source: str, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """A stable record id from the keys and a digest of the content; zeros are kept, nulls are empty."""
    return rows.withColumn("record_id", short_id(F.lit(source), *[F.col(k) for k in keys])).withColumn("record_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256))


def precedence(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first."""
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__p = 1").drop("__p")


def latest_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("m")).select(*keys, "m.*")


def orphans(edges: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return edges.join(parents.select(F.col(parent_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def sharded_by_size(rows: DataFrame, key: str, order: Sequence[str], most: int) -> DataFrame:
    """Groups, largest first, cut into slices of at most ``most`` rows: a global shard number."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("slices", F.ceil(F.col("n") / most))
    before = Window.orderBy(F.col("n").desc(), key).rowsBetween(Window.unboundedPreceding, -1)  # over groups, not rows
    starts = sizes.select(F.col(key).alias("__k"), F.coalesce(F.sum("slices").over(before), F.lit(0)).alias("start"))
    return numbered(rows, [key], list(order), "__p").join(starts, F.col(key) == F.col("__k")).withColumn("shard", (F.col("start") + F.floor(F.col("__p") / most)).cast("int")).drop("__p", "__k", "start")
