"""Quality rules: word statistics and a hashed n-gram log-likelihood ratio, thresholded for every document.

Two multinomials over hashed word unigrams and bigrams are compared: one of trusted texts, one of the whole raw corpus.
A document's score is the mean over its n-grams of log p_trusted - log p_raw, so its length doesn't matter; it is kept if
the score reaches the threshold and the base rules hold. Nothing is drawn at random. Before the ratio is taken, the trusted
counts and the counts that the raw corpus makes expect are both raised by ``prior``: rare n-grams say little. From
prior / SHARE trusted n-grams on it rises with their number, so that more texts of the same kind leave the ratios as they are.

The raw counts cover every row, the trusted counts every row that is labelled good. Labels meet the texts in an ordinary
join; the two tables have ``buckets`` entries whatever the corpus.

Nulls: a null text has no words, so it fails the base rules; a null doc_id is kept in the output and is never trusted.
Labels that are null or disagree about a doc_id are left out. Repeated rows count each time they occur. Without trusted
texts every score is 0, which passes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import plain, with_texts
from packgraph.llm.words import SPACE, WordIds

BUCKETS = 1 << 16
THRESHOLD = -0.06  # nats for each n-gram
PRIOR = 16.0  # occurrences, at least
SHARE = PRIOR / 20_000_000  # of the trusted n-grams
FEW_IDS = 1 << 20  # that are broadcast, about 32 MB
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
WINDOW = 5
#: Symbols that are counted (fixed values).
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def ngram_buckets(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each word and of each pair of neighbouring words, from the words' hashes."""
    pairs = hashes[:-1] * _MIX[0] + hashes[1:] * _MIX[1]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * _MIX[3]
    both = np.concatenate((hashes, pairs ^ (pairs >> np.uint64(32))))
    return (both % np.uint64(buckets)).astype(np.int64)


def repeated_words(ids: np.ndarray, hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a window of so many words that occurs twice or more in the text, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys += hashes[k : k + n] * _MIX[k % len(_MIX)] * np.uint64(2 * k + 1)
    order = np.argsort(keys, kind="stable")
    run = keys[order]
    same = run[1:] == run[:-1]
    if not same.any():
        return 0
    a, b = order[:-1][same], order[1:][same]
    if not all((ids[a + k] == ids[b + k]).all() for k in range(window)):  # two windows share a hash: compare the words
        order = np.lexsort([ids[k : k + n] for k in range(window)])
        same = np.all([ids[order[1:] + k] == ids[order[:-1] + k] for k in range(window)], axis=0)
        a, b = order[:-1][same], order[1:][same]
    marks = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate((a, b)))
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def measures(text: bytes, ids: WordIds) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words' hashes."""
    at = ids.of(text)
    hashes = ids.hashes(at)
    lines = [x for x in text.split(b"\n") if x.strip()]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(at), len(text.translate(None, SPACE + CONTINUATION)), symbols, len(lines) - len(set(lines)), repeated_words(at, hashes), hashes


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids that are labelled good."""
    agreed = plain(labels, doc_id="long", quality="int").filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    return agreed.filter("lo = 1 AND hi = 1").select("doc_id")


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, share: float = SHARE) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket, from one pass over every text."""
    trusted = trusted_ids(labels).withColumn("good", F.lit(True))
    # Few ids go to the texts; of more, the texts go to the ids, which are held while texts pass unsorted.
    trusted = F.broadcast(trusted) if trusted.count() <= FEW_IDS else trusted.hint("shuffle_hash")
    texts = plain(docs, doc_id="long", text="string")
    marked = texts.filter("doc_id IS NOT NULL").join(trusted, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    marked = marked.unionByName(texts.filter("doc_id IS NULL").select("text", F.lit(False).alias("good")))  # not dealt out by id

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, good = WordIds(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(b, minlength=buckets) if len(b := ngram_buckets(ids.hashes(ids.of(text or b"")), buckets)) > buckets // 4 else None
                for table in (raw, good)[: 1 + is_good]:
                    if found is None:
                        np.add.at(table, b, 1)
                    else:
                        table += found
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    sums = marked.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    table = sums.toPandas()  # a row for each bucket at most
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[table["bucket"]], good[table["bucket"]] = table["raw"], table["good"]
    if not good.sum():
        return np.zeros(buckets)
    prior = max(prior, share * good.sum())
    return np.log((good + prior) / (raw * (good.sum() / raw.sum()) + prior))


def score(hashes: np.ndarray, ratios: np.ndarray) -> float:
    return float(ratios[ngram_buckets(hashes, len(ratios))].mean()) if len(hashes) else 0.0


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    ratios = log_ratios(docs, labels, buckets)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                *counts, hashes = measures(text or b"", ids)
                failed, value = base_failed(counts[0], counts[4]), score(hashes, ratios)
                rows.append((*counts, failed, value, not failed and value >= threshold))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return plain(docs, doc_id="long", text="string").mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that are kept, with all their columns; no row is moved between tasks."""
    ratios = log_ratios(docs, labels, buckets)

    def verdicts() -> object:
        ids = WordIds()

        def verdict(texts: list[bytes | None]) -> list[bool]:
            out = []
            for text in texts:
                n, _, _, _, repeated, hashes = measures(text or b"", ids)
                out.append(not base_failed(n, repeated) and score(hashes, ratios) >= threshold)
            return out

        return verdict

    return with_texts(docs, verdicts)
