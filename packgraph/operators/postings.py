"""A search index that answers as a scan of the texts does, without reading them.

A search term is a run of letters and digits or of Hangul, so wherever it stands in a text it stands inside one of the text's own runs.
The index keeps, for each run and text, how often it occurs; a term's occurrences in a text are those inside its runs, and the score
follows from them. A search goes over the vocabulary, which grows much slower than the texts, for the runs that hold a term, and
reads only the buckets of postings that these runs are in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packgraph.functions.scalars import occurrences
from packgraph.operators.search import query_terms

RUN = "([a-z0-9]+|[가-힣]+)"  # the runs that terms are made of
BUCKETS = 256
FEW_RUNS = 1 << 17  # that are broadcast, some 10 MB; more of them are joined


def postings(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """bucket, run, the keys and n: how often each run occurs in the texts of a key."""
    runs = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(RUN), F.lit(1))).alias("run"))
    counted = runs.groupBy("run", *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.pmod(F.xxhash64("run"), F.lit(BUCKETS)).cast("int").alias("bucket"), "run", *keys, "n")


def write(found: DataFrame, path: str) -> None:
    """Postings by bucket, in the order of runs, and the vocabulary beside them."""
    found.repartition("bucket", F.pmod(F.xxhash64("run", *[c for c in found.columns if c not in ("bucket", "run", "n")]), F.lit(16))).sortWithinPartitions("bucket", "run").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    written = found.sparkSession.read.parquet(f"{path}/postings")
    written.groupBy("run", "bucket").agg(F.count(F.lit(1)).alias("texts")).write.mode("overwrite").parquet(f"{path}/vocabulary")


def matching(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """run, bucket and, for each term, how often it occurs in the run; runs with at least one."""
    counts = [occurrences(F.col("run"), t).alias(f"t{i}") for i, t in enumerate(terms)]
    holds = F.lit(False)
    for t in terms:
        holds = holds | F.contains("run", F.lit(t))
    return spark.read.parquet(f"{path}/vocabulary").filter(holds).select("run", "bucket", *counts)


def hits(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """The keys of texts with a match and, for each term, how often it occurs (t0, t1 ...). Only buckets of matching runs are read."""
    runs = matching(spark, path, terms)
    buckets = [r["bucket"] for r in runs.select("bucket").distinct().collect()]  # BUCKETS at most
    read = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets))
    keys = [c for c in read.columns if c not in ("bucket", "run", "n")]
    some = runs.limit(FEW_RUNS + 1).count() <= FEW_RUNS
    met = read.join(F.broadcast(runs.drop("bucket")) if some else runs.drop("bucket"), "run")
    return met.groupBy(*keys).agg(*[F.sum(F.col("n") * F.col(f"t{i}")).alias(f"t{i}") for i in range(len(terms))])


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The keys and score of every text that matches, as ``search.scored`` has them; nothing for a query without terms."""
    terms = query_terms(query)
    if not terms:
        return hits(spark, path, ["0"]).limit(0).drop("t0").withColumn("score", F.lit(0.0))
    total, matched = F.lit(0.0), F.lit(0)
    for i, t in enumerate(terms):
        n = F.least(F.col(f"t{i}"), F.lit(5))
        total = total + F.when(n > 0, (1 + 0.4 * (len(t) - 1)) * (1 + 0.2 * n)).otherwise(0.0)
        matched = matched + (n > 0).cast("int")
    found = hits(spark, path, terms)
    keys = [c for c in found.columns if not (c[0] == "t" and c[1:].isdigit())]
    return found.select(*keys, F.round(total * (1 + 0.5 * matched), 6).alias("score"))
