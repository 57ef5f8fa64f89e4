"""Sums and averages of numbers of any size: limbs of 18 digits are summed apart and carried at the end, shown as text.

A number has PLACES decimals (further ones round half up, as a cast to a decimal does) and at most 18 * LIMBS digits with them, which
is more than a double can hold; others count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.functions.scalars import NUMBER

PLACES, LIMBS, DIGITS = 10, 20, 18
WIDE = "decimal(38,0)"
_BASE = 10**DIGITS


def with_limbs(rows: DataFrame, text: Column, out: str) -> DataFrame:
    """rows with the limbs of the number in ``text`` in an array ``out``, the lowest first, each with the number's sign; null if there is
    no number. The steps are columns of their own, so that none is computed twice."""
    n = lambda c: f"__{c}_{out}"
    col = lambda c: F.col(n(c))
    part = lambda pattern: F.regexp_extract(col("clean"), pattern, 1)
    rows = rows.withColumn(n("clean"), F.when(text.rlike(NUMBER), F.regexp_replace(F.trim(text), ",", "")))
    rows = rows.withColumns({n("fraction"): part(r"^[+-]?[0-9]*\.([0-9]*)"), n("exponent"): F.coalesce(part(r"[eE]([+-]?[0-9]+)$").try_cast("int"), F.lit(0)), n("digits"): part(r"^[+-]?([0-9]*)")})
    rows = rows.withColumns({n("digits"): F.concat(col("digits"), col("fraction")), n("shift"): col("exponent") - F.length(col("fraction")) + PLACES})
    rows = rows.withColumn(n("kept"), F.length(col("digits")) + col("shift"))
    whole = F.concat(col("digits"), F.repeat(F.lit("0"), F.least(col("shift"), F.lit(2 * DIGITS * LIMBS))))
    body = F.when(col("shift") >= 0, whole).otherwise(F.substring(col("digits"), F.lit(1), F.greatest(col("kept"), F.lit(0))))
    up = (col("shift") < 0) & (col("kept") >= 0) & (F.substring(col("digits"), col("kept") + 1, F.lit(1)) >= "5")
    rows = rows.withColumns({n("body"): F.regexp_replace(body, "^0+", ""), n("up"): F.coalesce(up, F.lit(False)).cast("int")})
    padded = F.lpad(col("body"), DIGITS * LIMBS, "0")
    rows = rows.withColumn(n("padded"), F.when(F.length(col("body")) <= DIGITS * LIMBS, padded))
    rows = rows.withColumn(n("limbs"), F.transform(F.sequence(F.lit(LIMBS - 1), F.lit(0)), lambda k: F.substring(col("padded"), k * DIGITS + 1, F.lit(DIGITS)).cast("long")))
    sign = F.when(col("clean").startswith("-"), -1).otherwise(1)
    signed = F.transform(col("limbs"), lambda x, i: (x + F.when(i == 0, col("up")).otherwise(0)) * sign)
    rows = rows.withColumn(out, F.when(col("padded").isNotNull(), signed))
    return rows.drop(*[n(c) for c in ("clean", "fraction", "exponent", "digits", "shift", "kept", "body", "up", "padded", "limbs")])


def sums(limbs: str) -> Column:
    """An aggregate: the sums of the limbs, each apart."""
    return F.array(*[F.coalesce(F.sum(F.get(limbs, F.lit(k)).cast("decimal(19,0)")).cast(WIDE), F.lit(0).cast(WIDE)) for k in range(LIMBS)])


def _carried(limbs: Column) -> Column:
    """limbs from 0 to the base less 1, the lowest first, and what is carried over the last; the total is their value."""
    base = F.lit(_BASE).cast(WIDE)
    start = F.struct(F.lit(0).cast(WIDE).alias("carry"), F.array().cast(f"array<{WIDE}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        rest = F.pmod((x + state["carry"]).cast(WIDE), base).cast(WIDE)
        return F.struct(F.call_function("div", (x + state["carry"] - rest).cast(WIDE), base).cast(WIDE).alias("carry"), F.concat(state["out"], F.array(rest)).alias("out"))

    return F.aggregate(limbs, start, step)


def _divided(m: Column, n: Column) -> Column:
    start = F.struct(F.lit(0).cast(WIDE).alias("rest"), F.array().cast(f"array<{WIDE}>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        part = (state["rest"] * F.lit(_BASE).cast("decimal(19,0)") + x).cast(WIDE)
        return F.struct(F.pmod(part, n).cast(WIDE).alias("rest"), F.concat(state["out"], F.array(F.call_function("div", part, n).cast(WIDE))).alias("out"))

    return F.aggregate(F.concat(F.array(m["carry"]), F.reverse(m["out"])), start, step)["out"]


def shown(rows: DataFrame, limbs: str, out: str, count: str | None = None) -> DataFrame:
    """rows with the total of summed limbs as text in ``out``; with a column ``count``, divided by it, cut off after PLACES decimals, and null
    where it is 0."""
    n = lambda c: f"__{c}_{out}"
    rows = rows.withColumn(n("below"), _carried(F.col(limbs))["carry"] < 0)
    rows = rows.withColumn(n("m"), _carried(F.transform(limbs, lambda x: F.when(F.col(n("below")), -x).otherwise(x).cast(WIDE))))
    high = F.concat(F.array(F.col(n("m"))["carry"]), F.reverse(F.col(n("m"))["out"]))
    if count:
        high = F.when(F.col(count) > 0, _divided(F.col(n("m")), F.greatest(F.col(count), F.lit(1)).cast(WIDE)))
    rows = rows.withColumn(n("text"), F.array_join(F.transform(high, lambda x: F.lpad(x.cast("string"), DIGITS, "0")), ""))
    text = F.col(n("text"))
    rows = rows.withColumns({n("whole"): F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - PLACES), "^0+(?=[0-9])", ""), n("rest"): F.regexp_replace(F.substring(text, F.length(text) - PLACES + 1, F.lit(PLACES)), "0+$", "")})
    rows = rows.withColumn(n("text"), F.when(F.col(n("rest")) == "", F.col(n("whole"))).otherwise(F.concat(n("whole"), F.lit("."), n("rest"))))
    rows = rows.withColumn(out, F.when(F.col(n("below")) & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text))
    return rows.drop(*[n(c) for c in ("below", "m", "text", "whole", "rest")])
