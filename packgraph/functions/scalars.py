"""Column functions of the query language: numbers in text, ordering keys, names, measures and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole string that is a number: optional sign, thousands groups or plain digits, fraction, exponent (fixed values).
NUMBER = r"^\s*[+-]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
DECIMAL = "decimal(38,10)"
SQFT_TO_SQM = 0.09290304  # square metres in a square foot


def number(text: Column, kind: str = DECIMAL) -> Column:
    """A string that is a number as a whole, else null; digits inside other text, NaN and infinity are no numbers."""
    return F.when(text.rlike(NUMBER), F.trim(F.regexp_replace(text, ",", "")).try_cast(kind))


def lenient_number(text: Column) -> Column:
    """The first number anywhere in a string, for values shown with units."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?[0-9]+(\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def half_even(value: Column, places: int = 6) -> Column:
    return F.bround(value, places)


def natural_key(text: Column) -> Column:
    """Runs of digits as integers before runs of other text, ignoring case: an array that orders as people do."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.when(r.rlike("^[0-9]"), 0).otherwise(1).alias("k"), r.try_cast("decimal(38,0)").alias("n"), r.alias("t")))


def value_key(text: Column) -> list[Column]:
    """Numbers, in text too, before other text; text ignores case."""
    n = number(text)
    return [F.when(text.isNull(), F.lit(None)).when(n.isNull(), 1).otherwise(0), n, F.when(n.isNull(), F.lower(text))]


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower-case letters, digits and single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9\uAC00-\uD7A3]+", "-"), r"^-+|-+$", "")


def short_id(*parts: Column) -> Column:
    """Sixteen hex digits of a digest over the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def edge_id(pack: Column, source: Column, relation: Column, target: Column) -> Column:
    """Sixteen hex digits over the JSON array of the parts, so that no two triples read the same."""
    return F.substring(F.sha1(F.to_json(F.array(pack, source, relation, target)).cast("binary")), 1, 16)


def orientation(width: Column, height: Column, ratio: float = 1.5) -> Column:
    """horizontal or vertical if one side is over ratio times the other, else unknown."""
    return F.when(width > height * ratio, "horizontal").when(height > width * ratio, "vertical").otherwise("unknown")


def dimension_mm(text: Column, low: int = 50, high: int = 20_000) -> Column:
    """The first number of a drawing text that can be a length in millimetres."""
    found = F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda v: (v >= low) & (v <= high)), F.lit(0))


def room_tag(text: Column) -> Column:
    """label, area and unit of a room tag such as ``Office 12.5 m2``, or null."""
    pattern = r"^\s*(.*?)[\s:]*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(㎡|m²|m2|sqm)\s*$"
    area = F.regexp_replace(F.regexp_extract(text, pattern, 2), ",", "").try_cast("double")
    return F.when(text.rlike(pattern), F.struct(F.trim(F.regexp_extract(text, pattern, 1)).alias("label"), area.alias("area"), F.regexp_extract(text, pattern, 3).alias("unit")))


def module_parts(module_id: Column) -> Column:
    """floor (an integer or null), module_code and type_code of an id such as ``1-05-ST``."""
    parts = F.split(module_id, "-", 3)
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("floor"), F.get(parts, F.lit(1)).alias("module_code"), F.get(parts, F.lit(2)).alias("type_code"))


def family_type(text: Column) -> Column:
    """family and type around the first colon, of either width."""
    parts = F.split(text, "[:：]", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("family"), F.trim(F.get(parts, F.lit(1))).alias("type"))


def markdown_pairs(text: Column) -> Column:
    """``- key: value`` lines of a document as an array of structs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[-*]\s*[^:]+:\s*.*$"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*[-*]\s*([^:]+):\s*(.*)$", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^\s*[-*]\s*([^:]+):\s*(.*)$", 2)).alias("value")))


def safe_path(path: Column) -> Column:
    """Whether a document path stays inside its pack: relative, without drive letters, NUL and parent steps."""
    return ~path.rlike(r"^(?:/|\\|[A-Za-z]:)|\x00|(?:^|[/\\])\.\.(?:[/\\]|$)") & (F.length(path) > 0)


def redact(text: Column) -> Column:
    """Secrets of keys such as ``sk-...`` and bearer tokens replaced."""
    return F.regexp_replace(F.regexp_replace(text, r"sk-[A-Za-z0-9_-]{8,}", "sk-***"), r"(?i)(bearer\s+)[A-Za-z0-9._-]{8,}", "$1***")


def square_metres(metric: Column, square_feet: Column) -> Column:
    """An area in square metres: the metric one if there is one, else the one in square feet converted."""
    return F.coalesce(metric, square_feet * F.lit(SQFT_TO_SQM))


def url_host(url: Column) -> Column:
    """The host of a URL as it is written, with its port; empty if there is none."""
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
