"""Trusted n-grams of the quality rules on tables of different sizes."""

import numpy as np

from packgraph.llm import quality_rules


def test_every_good_label_is_trusted(spark):
    labels = spark.range(50_000).selectExpr("id AS doc_id", "1 AS quality")
    assert quality_rules.trusted_ids(labels).count() == 50_000


def test_more_of_the_same_texts_leave_the_ratios(spark):
    def ratios(times):
        docs = spark.range(4 * times).selectExpr("id AS doc_id", "if(id % 4 = 0, 'a b a c', 'b d d e f') AS text").unionByName(spark.createDataFrame([(None, "z z")] * times, "doc_id long, text string"))
        return quality_rules.log_ratios(docs, spark.range(0, 4 * times, 4).selectExpr("id AS doc_id", "1 AS quality"), buckets=97, share=0.01)

    few, many = ratios(500), ratios(2000)
    assert few.any() and np.allclose(few, many)
