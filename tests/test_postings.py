"""The search index against a scan of the texts, and what it reads."""

import random

import pytest
from pyspark.sql import functions as F

from packgraph.operators import postings, search

QUERIES = ["beam", "the bea column 12", "강재 보 모듈리스트", "aa", "zzz nothing", "1", "Straße ünder", "the please"]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    r = random.Random(6)
    words = ["Beam", "beams-beam", "aaaa", "aaa", "column12", "12", "1121", "강재", "강재보모듈", "모듈리스트는", "é", "STRASSE", "Straße", "x_beam", "\n", "bea", "m"]
    rows = [(i, r.choice("pq"), "".join(r.choice(words) + r.choice([" ", "", ".", "  "]) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(900, "p", None), (901, None, "beam"), (901, None, "beam beam")]
    df = spark.createDataFrame(rows, "id long, pack string, text string")
    path = str(tmp_path_factory.mktemp("postings"))
    postings.write(postings.postings(df.filter("id < 901"), ["pack", "id"], "text"), path)
    return df.filter("id < 901"), path


@pytest.mark.parametrize("query", QUERIES)
def test_the_index_answers_as_a_scan(spark, texts, query):
    df, path = texts
    want = sorted((r["id"], r["score"]) for r in search.scored(df, F.col("text"), search.query_terms(query)).collect())
    assert sorted((r["id"], r["score"]) for r in postings.search(spark, path, query).collect()) == want
    if query == "beam":
        assert len(want) > 50


def test_only_buckets_of_matching_runs_are_read(spark, texts):
    _, path = texts
    every = spark.read.parquet(f"{path}/postings").inputFiles()
    runs = postings.matching(spark, path, ["column"]).collect()
    plan = postings.hits(spark, path, ["column"])._jdf.queryExecution().executedPlan().toString()
    assert [r["run"] for r in runs] == ["column12"] or all("column" in r["run"] for r in runs)
    buckets = {r["bucket"] for r in runs}
    used = [f for f in every if int(f.split("bucket=")[1].split("/")[0]) in buckets]
    assert 0 < len(used) < len(every) and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
