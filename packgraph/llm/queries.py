"""The registered queries of this subpackage and, where SQL can say the same, their SQL for DuckDB.

Each query reads its whole tables through its operator with the parameters meant for production.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packgraph.llm import byte_bpe, chat_format, exact_dedup, line_dedup, minhash, packing, quality_cnn, quality_rules, sharding, simhash, url_filter, vector_codes, whitening

ODD = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(ODD))
    return chat_format.digest(chat_format.format_trees(chat_format.as_messages(table.unionByName(odd))))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_filter.sample_captures(_table(spark, sf_dir, "pages"))
    return url_filter.url_filter(captures, url_filter.sample_entries(captures))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_url_filter, op3_packing, op4_sharding, op5_byte_bpe, op6_simhash, op7_quality_rules, op8_quality_cnn, op9_line_dedup, op10_exact_dedup, op11_vector_codes, op12_minhash, op13_whitening)
}
ORACLES: dict[str, str] = {"op1_chat_format": chat_format.SQL, "op2_url_filter": url_filter.SQL, "op9_line_dedup": line_dedup.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_vector_codes": vector_codes.SQL, "op12_minhash": minhash.SQL}
