"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned filters
slide over every chunk, each filter's largest response in a chunk is taken, and a weighted sum makes the chunk's logit. The
mean over the chunks is the document's logit, its logistic the probability of label 1.

The network is fitted on the driver to all chunks of a bounded sample of labelled documents that aren't held out: of each
label, in the order of a hash of doc_id, at most ``sample_rows`` documents and as many as have ``sample_chunks`` chunks together; a
document of over LONGEST chunks is not learned from. Classes are weighted back to their shares. Scoring reads every chunk of
every document; only chunks of a fixed size are in memory at once. Labels, language, source and doc_id are no inputs of a score.

Nulls: a null text counts as empty, which is one chunk of padding; a null doc_id is not held out and never learned from.
Labels that are null, not 0 or 1, or disagree about a doc_id are left out. If a label has no sample, every score is the
share of label 1 among the sample, smoothed by one of each. Repeated rows get the same score. An empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packgraph.llm.scratch import plain, with_texts

CHUNK, STEP = 256, 192  # bytes of a chunk, and from one chunk's start to the next one's
WIDTH, STRIDE, VECTOR, FILTERS = 8, 4, 8, 32
SLAB = 512  # chunks that are scored at once
SAMPLE_ROWS, SAMPLE_CHUNKS, LONGEST = 2000, 12_000, 1024  # of each label; chunks of one document
FOLDS, HELD_OUT = 3, 1


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def n_chunks(size):
    """How many chunks cover so many bytes; for numbers and arrays."""
    return np.maximum(-(-(size - CHUNK) // STEP), 0) + 1


def chunks(text: bytes) -> np.ndarray:
    """The chunks of a text, one a row, the last padded with zero bytes; a view of as many rows as cover the text."""
    padded = np.zeros((n_chunks(len(text)) - 1) * STEP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    """vectors (256 bytes x VECTOR), filters (WIDTH * VECTOR x FILTERS), their biases, and the weights and bias of the sum."""

    def __init__(self, rng: np.random.Generator):
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.parts = [draw(256, VECTOR, scale=0.5), draw(WIDTH * VECTOR, FILTERS, scale=(WIDTH * VECTOR) ** -0.5), np.zeros(FILTERS, np.float32), draw(FILTERS, scale=FILTERS**-0.5), np.zeros(1, np.float32)]

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """The bytes under each place of a filter: chunks x places x WIDTH."""
        return sliding_window_view(rows, WIDTH, axis=1)[:, ::STRIDE]

    def responses(self, rows: np.ndarray) -> np.ndarray:
        vectors, filters, bias, _, _ = self.parts
        under = np.ascontiguousarray(sliding_window_view(vectors[rows].reshape(len(rows), -1), WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR])
        return (under.reshape(-1, WIDTH * VECTOR) @ filters).reshape(len(rows), -1, FILTERS) + bias

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """The logit of each chunk."""
        return np.maximum(self.responses(rows).max(axis=1), 0) @ self.parts[3] + self.parts[4]

    def gradients(self, rows: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean log loss of documents; doc: which document, from 0, each chunk is of."""
        vectors, filters, _, out, out_bias = self.parts
        found = self.responses(rows)
        place = found.argmax(axis=1)  # chunks x filters
        pooled = np.maximum(np.take_along_axis(found, place[:, None], axis=1)[:, 0], 0)
        size = np.bincount(doc, minlength=len(label))
        logit = np.bincount(doc, pooled @ out + out_bias, len(label)) / size
        error = ((1 / (1 + np.exp(-logit)) - label) * weight / weight.sum() / size)[doc].astype(np.float32)
        back = error[:, None] * out * (pooled > 0)
        best = self.windows(rows)[np.arange(len(rows))[:, None], place]  # the bytes that each filter chose: chunks x filters x WIDTH
        under = vectors[best].reshape(len(rows), FILTERS, WIDTH * VECTOR)
        to_filters = np.einsum("cf,cfk->kf", back, under)
        to_bytes = (back[:, :, None] * filters.T).reshape(-1, VECTOR)
        to_vectors = np.zeros_like(vectors)
        flat = best.reshape(-1)
        for k in range(VECTOR):
            to_vectors[:, k] = np.bincount(flat, to_bytes[:, k], 256)
        return [to_vectors, to_filters, back.sum(axis=0), pooled.T @ error, error.sum(keepdims=True)]


def fit(rows: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over batches of documents; ``doc`` must be sorted."""
    rng = np.random.default_rng(seed)
    net = Network(rng)
    mean, square, t = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts], 0
    starts = np.searchsorted(doc, np.arange(len(label) + 1))
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in some])
            own = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
            t += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, m, s in zip(net.parts, net.gradients(rows[at], own, label[some], weight[some]), mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (pace * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return net


def labelled(labels: DataFrame, sample_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and label of the sample, at most sample_rows of each label; and how many rows have each label."""
    agreed = plain(labels, doc_id="long", quality="int").filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("hi"))
    usable = agreed.filter((F.col("label") == F.col("hi")) & (fold(F.col("doc_id")) != HELD_OUT)).select("doc_id", "label")
    few = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    return few[0].unionByName(few[1]), {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}


def _chosen(texts: DataFrame, sample_chunks: int) -> list[int]:
    """Of the sample's rows (doc_id, label, text; one size for each doc_id, so at most the sample's ids come to the driver) the
    ids that are learned from."""
    sizes = texts.groupBy("doc_id", "label").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"), F.xxhash64("doc_id").alias("draw")).toPandas()
    sizes["n"] = n_chunks(sizes["size"].to_numpy(np.int64))
    sizes = sizes[sizes["n"] <= LONGEST].sort_values(["draw", "doc_id"], kind="stable")
    return sizes[sizes.groupby("label")["n"].cumsum() <= sample_chunks]["doc_id"].tolist()


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chunks: int = SAMPLE_CHUNKS, epochs: int = 8) -> Network | float:
    """The fitted network, or the one score for all documents if there is nothing to learn from."""
    sample, shares = labelled(labels, sample_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, label in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)))):
                out += [(i, k, label, row.tobytes()) for k, row in enumerate(chunks(text or b""))]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "k", "label", "chunk"])

    # Of rows that repeat a doc_id, the text that comes last counts.
    texts = plain(docs, doc_id="long", text="string").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")  # at most 2 * sample_rows ids
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in _chosen(texts, sample_chunks)], "doc_id long"))
    one = texts.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")
    found = one.mapInArrow(cut, "doc_id long, k long, label int, chunk binary").toPandas()
    found = found.sort_values(["doc_id", "k", "chunk"], kind="stable")
    if found["label"].nunique() < 2:
        return (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    rows = np.frombuffer(b"".join(found["chunk"]), np.uint8).reshape(-1, CHUNK)
    ids, doc = np.unique(found["doc_id"].to_numpy(), return_inverse=True)
    label = found.groupby("doc_id")["label"].first().loc[ids].to_numpy().astype(float)
    weight = np.where(label == 1, shares[1] / (label == 1).sum(), shares[0] / (label == 0).sum())
    return fit(rows, doc, label, weight / weight.mean(), epochs)


def scorer(net: Network | float) -> Callable[[list[bytes | None]], np.ndarray]:
    """From texts to scores; chunks of many texts, or parts of a long one, are scored together."""

    def scores(texts: list[bytes | None]) -> np.ndarray:
        if not isinstance(net, Network):
            return np.full(len(texts), net)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        waiting, owner, n = [], [], 0

        def flush() -> None:
            nonlocal waiting, owner, n
            if n:
                own = np.repeat(*np.array(owner).T)
                np.add.at(total, own, net.logits(np.concatenate(waiting)))
                waiting, owner, n = [], [], 0

        for i, text in enumerate(texts):
            rows = chunks(text or b"")
            count[i] = len(rows)
            at = 0
            while at < len(rows):
                some = rows[at : at + SLAB - n]
                waiting.append(some)
                owner.append((i, len(some)))
                n, at = n + len(some), at + len(some)
                if n == SLAB:
                    flush()
        flush()
        return 1 / (1 + np.exp(-total / count)) if len(texts) else total

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame, net: Network | float | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels) if net is None else net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).cast(pa.binary()).to_pylist()))], ["doc_id", "score"])

    found = plain(docs, doc_id="long", text="string").mapInArrow(judge, "doc_id long, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, net: Network | float | None = None) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns; no row is moved between tasks."""
    score = scorer(train(docs, labels) if net is None else net)
    return with_texts(docs, lambda: lambda texts: (score(texts) >= 0.5).tolist())
