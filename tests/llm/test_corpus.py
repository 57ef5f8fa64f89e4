"""The registered queries on the smallest tables, and the pipeline against plain versions of its stages."""

import pytest

from compare import DATA, duck, same
from packgraph.llm import quality_cnn, quality_rules
from packgraph.llm.queries import ORACLES, QUERIES

import corpus_pipeline
from test_near_dedup import brute
from test_small import brute_exact


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, DATA), duck(), ORACLES[name])


def test_all_are_registered(spark):
    import __spark_entry__ as e

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(e.queries())


def test_pipeline_stages(spark):
    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), []
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, DATA)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r["doc_id"] for r in out.collect()}
        if k == 0:
            assert kept == {r["doc_id"] for r in quality_cnn.quality_scores(docs, labels).filter("predicted = 1").collect()}
        elif k == 1:
            assert kept == {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).filter("kept").collect()}
        elif k == 2:
            assert kept == {keep for _, keep, _, _ in brute_exact(before)}
        elif k == 3:
            comp = brute(before)  # the contract of stages: five words, a similarity of 0.8
            assert kept == {min(before[i][0] for i in comp if comp[i] == c) for c in set(comp.values())}
        else:
            assert kept == {d for d, _ in before}
        sizes.append(len(kept))
        if k < 4:
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert sizes == sorted(sizes, reverse=True)
    assert corpus_pipeline.run(spark, DATA).count() == sizes[-1]


def test_good_documents_stay(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_cnn.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.9
    ruled = quality_rules.quality_rules(docs, labels).filter("NOT base_failed").join(labels, "doc_id").toPandas()
    assert ruled[ruled["quality"] == 1]["kept"].mean() > 0.95 and ruled[ruled["quality"] == 0]["kept"].mean() < 0.2
