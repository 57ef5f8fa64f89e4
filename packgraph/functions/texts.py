"""Column functions over names, Markdown documents, displayed numbers and questions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from packgraph.functions.scalars import collapse

#: Words that say what kind of file a pack is, not what project it is of (fixed values).
PACK_WORDS = ("BM25", "Evidence", "Pack", "IFC", "Workset", "Module")
#: Summary fields that hold a project's name, in order (fixed values).
NAME_FIELDS = ("project_name", "projectName", "model_name", "modelName", "building_name", "buildingName")
#: Keywords of a question and the search words that they stand for (fixed values).
EXPANSIONS = {
    "모듈": ("module", "modules", "module_id", "module_type", "documents/modules"),
    "모듈리스트": ("module list", "module overview", "documents/modules"),
    "중량": ("weight", "total_weight_kg", "kg", "module_weight_index"),
    "무게": ("weight", "total_weight_kg", "kg", "module_weight_index"),
    "총중량": ("total weight", "total_weight_kg", "module_weight_index"),
    "어셈블리": ("assembly", "assembly_count", "assembly mark"),
    "부재": ("single part", "element", "section", "material"),
    "단면": ("section", "profile", "section name"),
    "자재": ("material", "grade"),
}
#: Module ids and floors in a question (fixed values).
MODULE_ID = r"(?i)\b([0-9]+-[0-9]{2}-[A-Z][A-Z0-9-]*)\b"
FLOOR = r"(?i)(?<![0-9])([0-9]+)\s*(?:층|floor\b|f\b)"
#: Units that a quantity can be given in, with the column that holds it, in order (fixed values).
MEASURE_COLUMNS = (("area_m2", "m2"), ("volume_m3", "m3"), ("length_m", "m"))


def file_parts(name: Column) -> Column:
    """scope, category and title of a cached file name such as ``scope__category__some-title.zip``; without both of the first
    two there is neither, and the title is what comes after the last double underscore, with spaces for dashes."""
    parts = F.split(name, "__", 3)
    whole = (F.size(parts) == 3) & (F.trim(F.get(parts, F.lit(0))) != "") & (F.trim(F.get(parts, F.lit(1))) != "")
    shown = F.coalesce(F.nullif(F.element_at(F.split(name, "__"), -1), F.lit("")), name)
    stem = F.regexp_replace(shown, r"(?<=.)\.[^./]+$", "")
    title = F.nullif(F.trim(F.regexp_replace(stem, "[_-]+", " ")), F.lit(""))
    at = lambda i: F.when(whole, F.trim(F.get(parts, F.lit(i))))
    return F.struct(at(0).alias("scope"), at(1).alias("category"), title.alias("title"))


def project_name(title: Column, named: Sequence[Column] = (), words: Sequence[str] = ()) -> Column:
    """The first name that is given, else the title without the words of its kind and those of the caller, else ``Project``."""
    bare = F.regexp_replace(title, rf"(?i)\b(?:{'|'.join(re.escape(w) for w in (*PACK_WORDS, *words))})\b", " ")
    bare = F.nullif(collapse(F.replace(bare, F.lit(".zip"), F.lit(""))), F.lit(""))
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in named], bare, F.lit("Project"))


def safe_file(name: Column, fallback: str = "pack") -> Column:
    """A file name of letters, digits, dots, dashes and underscores, without a leading dot."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z가-힣._-]+", "_"), r"^[._]+|_+$", ""), F.lit("")), F.lit(fallback))


def short_number(value: Column, places: int = 3, thousands: bool = False) -> Column:
    """A number with at most so many places and no trailing zeros; null stays null."""
    text = F.format_number(value.cast("double"), places)
    text = text if thousands else F.replace(text, F.lit(","), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def measurement(columns: dict[str, Column], display: Column) -> Column:
    """value and unit of a quantity: the first measured column that has a number, else what its display text shows."""
    shown = F.replace(display, F.lit(","), F.lit(""))
    pattern = r"(-?[0-9]+(?:\.[0-9]+)?)\s*([^0-9\s]+)?"
    out = F.when(shown.rlike(pattern), F.struct(F.regexp_extract(shown, pattern, 1).try_cast("double").alias("value"), F.nullif(F.regexp_extract(shown, pattern, 2), F.lit("")).alias("unit")))
    for name, unit in reversed(MEASURE_COLUMNS):
        if name in columns:
            out = F.when(columns[name].isNotNull(), F.struct(columns[name].cast("double").alias("value"), F.lit(unit).alias("unit"))).otherwise(out)
    return out


def number_range(value: Column, size: int = 20) -> Column:
    """The range of numbers from 1 that a mark's digits fall in, such as ``021-040``; ``other`` without digits."""
    n = F.nullif(F.regexp_extract(value, "([0-9]+)", 1), F.lit("")).try_cast("long")
    low = F.floor((n - 1) / size) * size + 1
    pad = lambda c: F.when(F.length(c.cast("string")) >= 3, c.cast("string")).otherwise(F.lpad(c.cast("string"), 3, "0"))
    return F.coalesce(F.when(n >= 1, F.concat_ws("-", pad(low), pad(low + size - 1))), F.lit("other"))


# --- Markdown ----------------------------------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))


def key_values(text: Column) -> Column:
    """``key: value`` lines as an array of (key, value); spaces of keys become underscores."""
    pattern = r"^([A-Za-z0-9가-힣_ -]+):\s*(.+?)\s*$"
    lines = F.filter(_lines(text), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.replace(F.trim(F.regexp_extract(x, pattern, 1)), F.lit(" "), F.lit("_")).alias("key"), F.regexp_extract(x, pattern, 2).alias("value")))


def section_lines(text: Column, heading: str) -> Column:
    """The lines below ``## `` headings that contain some words, up to the next such heading."""
    pattern = rf"(?ims)^[ \t]*## [^\n]*{re.escape(heading)}[^\n]*\n(.*?)(?=^[ \t]*## |\z)"
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), _lines))


def table_cells(lines: Column) -> Column:
    """The rows of a Markdown table as arrays of cells, the header first, rules left out."""
    rows = F.filter(lines, lambda x: x.startswith("|"))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))
    return F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike(r"^:?-*:?$")))


def table_rows(lines: Column) -> Column:
    """The rows of a Markdown table as maps from the header's cells; rows of another length are left out."""
    cells = table_cells(lines)
    head = F.get(cells, F.lit(0))
    data = F.filter(F.slice(cells, 2, 1 << 30), lambda r: F.size(r) == F.size(head))
    return F.when(F.size(F.array_distinct(head)) == F.size(head), F.transform(data, lambda r: F.map_from_arrays(head, r)))


def json_blocks(text: Column) -> Column:
    """The texts of fenced JSON blocks that are well-formed."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)```json\s*(.*?)```"), F.lit(1))
    return F.filter(found, lambda x: F.try_parse_json(x).isNotNull())


# --- questions ----------------------------------------------------------------------------------------------------------


def module_ids(question: Column) -> Column:
    """Module ids of a question in order, upper-case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(MODULE_ID), F.lit(1)), lambda x: F.upper(x)))


def floors(question: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(FLOOR), F.lit(1)), lambda x: x.cast("long")))


def has_term(question: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(question), F.lit(t.lower()))
    return out


def expanded(question: Column) -> Column:
    """A question with the words that its keywords and floors stand for, each once, in order."""
    parts = [F.array(question)]
    for word, more in EXPANSIONS.items():
        parts.append(F.when(F.contains(F.lower(question), F.lit(word)), F.array(*[F.lit(m) for m in more])).otherwise(F.array().cast("array<string>")))
    floor = lambda n: F.array(F.concat(n.cast("string"), F.lit("-")), F.concat(n.cast("string"), F.lit("F")), F.concat(n.cast("string"), F.lit("층")))
    parts.append(F.flatten(F.transform(floors(question), floor)))
    return F.array_join(F.array_distinct(F.concat(*parts)), " ")
