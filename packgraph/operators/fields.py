"""Fields of a query resolved against typed columns or a VARIANT of properties.

A missing field and a null field are different states: a typed column always exists, a property only where it is set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packgraph.functions.scalars import DECIMAL, number


@dataclass(frozen=True)
class Field:
    """One field as columns. ``native``: the typed column itself, for comparisons that a scan can take over."""

    exists: Column
    null: Column
    text: Column  # as query text operators see it: null is None, booleans are True and False
    num: Column
    flag: Column
    native: Column | None = None
    kind: str = "variant"  # or number, text, flag, time, other
    string: Column | None = None  # whether a property is a string

    @property
    def value(self) -> Column:
        """The value as text, null where it is missing or null."""
        return F.when(self.exists & ~self.null, self.text)


def missing() -> Field:
    return Field(F.lit(False), F.lit(False), F.lit(None).cast("string"), F.lit(None).cast(DECIMAL), F.lit(None).cast("boolean"), None, "missing")


def _shown(text: Column, null: Column) -> Column:
    return F.when(null, F.lit("None")).otherwise(text)


def typed(column: Column, kind: T.DataType) -> Field:
    null = column.isNull()
    none = lambda t: F.lit(None).cast(t)
    if isinstance(kind, T.BooleanType):
        return Field(F.lit(True), null, _shown(F.initcap(column.cast("string")), null), none(DECIMAL), column, column, "flag")
    if isinstance(kind, T.NumericType):
        return Field(F.lit(True), null, _shown(column.cast("string"), null), column.try_cast(DECIMAL), none("boolean"), column, "number")
    if isinstance(kind, T.StringType):
        return Field(F.lit(True), null, _shown(column, null), number(column), none("boolean"), column, "text")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Field(F.lit(True), null, _shown(column.cast("string"), null), none(DECIMAL), none("boolean"), column, "time")
    return Field(F.lit(True), null, _shown(F.to_json(column), null), none(DECIMAL), none("boolean"), column, "other")


def variant(value: Column) -> Field:
    """value: the VARIANT at a path, SQL null where the path is missing."""
    null = F.coalesce(F.is_variant_null(value), F.lit(False))
    kind = F.schema_of_variant(value)
    raw = F.try_variant_get(value, "$", "string")
    flag = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    is_number = kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    num = F.when(is_number, F.try_variant_get(value, "$", DECIMAL)).when(kind == "STRING", number(raw))
    text = F.when(null, F.lit("None")).when(kind == "BOOLEAN", F.initcap(raw)).otherwise(raw)
    return Field(value.isNotNull(), null, text, num, flag, string=F.coalesce(kind == "STRING", F.lit(False)))


class Resolver:
    """Field names against a DataFrame: top-level columns and struct paths first, then the VARIANT column of properties.

    ``aliases``: names that stand for the first of several fields that exists.
    """

    def __init__(self, df: DataFrame, properties: str | None = None, aliases: dict[str, list[str]] | None = None):
        self.schema, self.properties, self.aliases = df.schema, properties, aliases or {}

    def _typed(self, name: str) -> Field | None:
        kind: T.DataType = self.schema
        column: Column | None = None
        for part in [name] if name in self.schema.names else name.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            kind = kind[part].dataType
        return None if column is None or isinstance(kind, T.VariantType) else typed(column, kind)

    def __call__(self, name: str) -> Field:
        if name in self.aliases:
            return first_existing([self(n) for n in self.aliases[name]])
        found = self._typed(name)
        if found is not None:
            return found
        if self.properties is None:
            return missing()
        path = name.removeprefix("properties.").removeprefix(f"{self.properties}.")
        steps = "".join(f"['{p}']" for p in path.replace("'", "\\'").split("."))
        return variant(F.try_variant_get(F.col(self.properties), "$" + steps, "variant"))


def first_existing(fields: list[Field]) -> Field:
    """The first field that exists, which need not be the first that isn't null."""

    def pick(part: str) -> Column:
        out = F.lit(None)
        for f in reversed(fields):
            out = F.when(f.exists, getattr(f, part)).otherwise(out)
        return out

    exists = F.lit(False)
    for f in fields:
        exists = exists | f.exists
    is_string = F.lit(False)
    for f in reversed(fields):
        is_string = F.when(f.exists, F.lit(f.kind == "text") if f.string is None else f.string).otherwise(is_string)
    return Field(exists, F.coalesce(pick("null"), F.lit(False)), pick("text"), pick("num").cast(DECIMAL), pick("flag").cast("boolean"), string=is_string)
