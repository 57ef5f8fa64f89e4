"""Lexical search: terms of a query, scores, snippets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.functions.scalars import collapse, occurrences
from packgraph.functions.texts import EXPANSIONS, FLOOR

#: Words that are no search terms (fixed values).
STOP_WORDS = (
    "the", "and", "for", "with", "what", "which", "how", "are", "is", "of", "to", "this", "that", "from", "about", "tell", "show", "list", "give", "please",
    "설명", "알려", "무엇", "어떤", "어떻게", "그리고", "그것", "대해", "해줘", "주세요", "입니까", "인가요",
)
BEFORE, AFTER = 120, 260  # characters of a snippet around the first hit


def query_terms(query: str) -> list[str]:
    """Terms in order, each once: ASCII words of two letters or more that are no stop words, all digits, Hangul runs of two
    to four characters that are no stop words, and the pairs in all of them."""
    out: list[str] = []
    for token in re.findall(r"[a-z0-9]+|[가-힣]+", query.lower()):
        if token[0] >= "가":
            if 2 <= len(token) <= 4 and token not in STOP_WORDS:
                out.append(token)
            out += [token[i : i + 2] for i in range(len(token) - 1)]
        elif token.isdigit() or (len(token) >= 2 and token not in STOP_WORDS):
            out.append(token)
    return list(dict.fromkeys(out))


def expand(question: str) -> str:
    """A question with the words that its keywords and floors stand for, each once, in order."""
    low, parts = question.casefold(), [question]
    for word, more in EXPANSIONS.items():
        parts += more if word in low else ()
    for n in dict.fromkeys(int(x) for x in re.findall(FLOOR, question)):
        parts += [f"{n}-", f"{n}F", f"{n}층"]
    return " ".join(dict.fromkeys(p for p in parts if p))


def _score(low: Column, terms: Sequence[str]) -> Column:
    total, matched = F.lit(0.0), F.lit(0)
    for t in terms:
        n = F.least(occurrences(low, t), F.lit(5))
        total = total + F.when(n > 0, (1 + 0.4 * (len(t) - 1)) * (1 + 0.2 * n)).otherwise(0.0)
        matched = matched + (n > 0).cast("int")
    return total * (1 + 0.5 * matched)


def score(text: Column, terms: Sequence[str]) -> Column:
    """Sum over matched terms of (1 + 0.4 (length - 1)) (1 + 0.2 min(count, 5)), times 1 + 0.5 matched; 0 without a match."""
    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: _score(low, terms)), F.lit(0))


def scored(rows: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """Rows that match, with score and hit (where the first term stands). A text is put in small letters once for all of it."""

    def measured(low: Column) -> Column:
        return F.struct(F.round(_score(low, terms), 6).alias("score"), _first_hit(low, terms).alias("hit"))

    found = F.filter(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), measured), lambda s: s["score"] > 0)
    return rows.select("*", F.explode(found).alias("__s")).select(*rows.columns, "__s.score", "__s.hit")


def _first_hit(low: Column, terms: Sequence[str]) -> Column:
    hits = [F.nullif(F.instr(low, t), F.lit(0)) for t in terms]
    return F.coalesce(F.least(*hits) if len(hits) > 1 else hits[0], F.lit(1)) if hits else F.lit(1)


def any_term(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(text), F.lit(t))
    return out


def _around(text: Column, hit: Column) -> Column:
    start = F.greatest(hit - BEFORE, F.lit(1))
    return collapse(F.substring(text, start, hit + AFTER - start))


def snippet(text: Column, terms: Sequence[str]) -> Column:
    """The text around the earliest hit, white space collapsed; from the start if there is no hit."""
    hit = F.get(F.transform(F.array(F.lower(text)), lambda low: _first_hit(low, terms)), F.lit(0))
    return _around(text, hit)


def search(rows: DataFrame, text: Column, query: str, limit: int | None, tie: Sequence[str], shown: Column | None = None) -> DataFrame:
    """Rows that match, with their columns, score and snippet: the best by score if there is a limit, else all of them in no
    order, since nothing asks for one."""
    terms = query_terms(query)
    if not terms:
        return rows.withColumn("score", F.lit(0.0)).withColumn("snippet", F.lit("")).limit(0)
    found = scored(rows, text, terms)
    if limit is not None:
        found = found.orderBy(F.col("score").desc(), *tie).limit(max(0, limit))
    return found.withColumn("snippet", _around(text, F.col("hit")) if shown is None else snippet(shown, terms)).drop("hit")


def top_per_pack(rows: DataFrame, text: Column, query: str, pack: str, limit: int, tie: Sequence[str]) -> DataFrame:
    """The best rows of each pack, numbered in ``place``."""
    found = scored(rows, text, query_terms(query)).drop("hit")
    place = F.row_number().over(Window.partitionBy(pack).orderBy(F.col("score").desc(), *tie))
    return found.withColumn("place", place).filter(F.col("place") <= limit)


def merge_evidence(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all parts, each key once, from the earliest part that has it."""
    tagged = [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.min(F.struct("priority", *[c for c in rest if c != "priority"])).alias("m")).select(*keys, "m.*")
