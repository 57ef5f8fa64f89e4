"""Sorting, paging and projection of rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions.scalars import natural_key
from packgraph.operators.fields import Field, Resolver
from packgraph.operators.where import InvalidQuery

#: Fields that are left out of a projection unless asked for (fixed values).
HEAVY = ("bim_references", "content", "embedding", "formula", "formula_details", "formula_source", "raw", "raw_json", "raw_text", "source_text")
#: Fields of a node that are shown if none are asked for (fixed values).
NODE_FIELDS = (
    "id", "label", "type", "module_id", "module_type", "workset_name", "category", "class", "family_name", "family_and_type", "type_name", "work_category", "item_name", "specification", "quantity", "unit",
    "normalized_unit", "source_sheet", "source_row", "source_element_id", "ifc_guid",
)


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False
    nulls_first: bool = False
    natural: bool = False


def parse_order(order_by: Any) -> list[Order]:
    """Orders from ``"f"``, ``"-f"``, ``"a,-b"``, an object with field, direction, nulls and natural, or a list of these."""
    if order_by is None:
        return []
    if isinstance(order_by, str):
        return [Order(p.lstrip("-"), p.startswith("-")) for p in (x.strip() for x in order_by.split(",")) if p.strip("-")]
    if isinstance(order_by, dict):
        field, direction, nulls, natural = order_by.get("field"), order_by.get("direction", "asc"), order_by.get("nulls", "last"), order_by.get("natural", False)
        if not isinstance(field, str) or not field or direction not in ("asc", "desc") or nulls not in ("first", "last") or not isinstance(natural, bool):
            raise InvalidQuery(f"bad order {order_by!r}")
        return [Order(field.lstrip("-"), (direction == "desc") != field.startswith("-"), nulls == "first", natural)]
    if isinstance(order_by, (list, tuple)):
        return [o for part in order_by for o in parse_order(part if part is not None else 0)]
    raise InvalidQuery(f"bad order {order_by!r}")


def order_columns(order_by: Any, resolve: Callable[[str], Field], tie: Sequence[Column] = ()) -> list[Column]:
    """Sort columns: numbers before text, missing and null last whichever the direction, ties in the order of ``tie``."""
    out: list[Column] = []
    for o in parse_order(order_by):
        f = resolve(o.field)
        absent = ~f.exists | f.null
        out.append(absent.desc() if o.nulls_first else absent.asc())
        if o.natural:
            keys = [natural_key(f.value)]
        elif f.kind in ("number", "time", "flag"):
            keys = [f.native]
        else:
            keys = [f.num.isNull(), f.num, F.lower(f.value)]
        out += [k.desc() if o.descending else k.asc() for k in keys]
    return [*out, *(c.asc() for c in tie)]


def page(df: DataFrame, order_by: Any, limit: int | None, offset: int = 0, tie: Sequence[str] = (), properties: str | None = None) -> DataFrame:
    """Sorted rows from offset on; fields of the order need not be projected afterwards."""
    columns = order_columns(order_by, Resolver(df, properties), [F.col(t) for t in tie])
    out = df.orderBy(*columns) if columns else df
    out = out.offset(max(0, offset)) if offset > 0 else out
    return out if limit is None else out.limit(max(0, limit))


def projection_names(fields: Sequence[str]) -> dict[str, str]:
    """Output name of each asked field: what follows the first dot, unless another field would have that name too."""
    fields = list(dict.fromkeys(fields))
    short = [f.split(".", 1)[-1] for f in fields]
    return {f: s if short.count(s) == 1 and (s == f or s not in fields) else f for f, s in zip(fields, short)}


def project(df: DataFrame, fields: Sequence[str] | None, properties: str | None = None, heavy: bool = False) -> DataFrame:
    """The asked fields, NODE_FIELDS without any, under their short names; a field that is missing from a row is null there."""
    fields = fields or NODE_FIELDS
    resolve = Resolver(df, properties)
    chosen = {f: n for f, n in projection_names(fields).items() if heavy or f.split(".")[-1] not in HEAVY}
    return df.select(*[(g.native if (g := resolve(f)).native is not None else g.value).alias(n) for f, n in chosen.items()])


def clamp_count(rows: int, limit: int | None, offset: int) -> tuple[int, bool]:
    """How many rows a page shows, and whether rows are left after it."""
    shown = max(0, rows - max(0, offset))
    return (shown, False) if limit is None else (min(shown, max(0, limit)), shown > max(0, limit))
