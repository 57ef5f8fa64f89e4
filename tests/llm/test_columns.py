"""Further columns whose names clash, nulls everywhere, empty tables and long inputs, for each operator and for the pipeline."""

import time

import pytest

import corpus_pipeline
from packgraph.llm import byte_bpe, chat_format, exact_dedup, line_dedup, packing, quality_cnn, quality_rules, sharding, simhash, url_filter
from test_small import ROWS, table, wide

EXTRA = ("rid", "mark", "fp", "shard", "slot", "n_words", "score", "kept", "n_lines", "gone", "host", "pattern", "t", "leaf", "turns", "__bin", "__n", "h1", "n_tokens", "bucket", "cell", "block", "name", "n_blocks", "component_id")


def odd(spark, rows=ROWS):
    """doc_id and text behind columns with the names that operators use themselves, and a second TEXT."""
    t = table(spark, rows).selectExpr(*[f"'{c}' AS {c}" for c in EXTRA], "doc_id", "text")
    return t.toDF(*t.columns[:-2], "doc_id", "text").selectExpr("*", "'other' AS Text2").toDF(*EXTRA, "doc_id", "text", "TEXT")


def labels(spark):
    return spark.createDataFrame([(6, 1), (1, 0), (None, None), (7, 1)], "doc_id long, quality int")


def digest(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("name", ["shards", "packing", "bpe", "rules", "lines", "simhash", "simhash-report", "exact"])
def test_clashing_columns_change_nothing(spark, name):
    import public_tokenizers as P

    run = {
        "shards": lambda t: sharding.shards(t), "bpe": lambda t: byte_bpe.byte_bpe(t, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
        "rules": lambda t: quality_rules.quality_rules(t, labels(spark)), "lines": line_dedup.report, "simhash": simhash.fingerprints,
        "packing": packing.packed, "simhash-report": simhash.report, "exact": exact_dedup.exact_dedup,
    }[name]
    assert digest(run(odd(spark))) == digest(run(table(spark)))


@pytest.mark.parametrize("run", [packing.packed, sharding.shards])
def test_numbers_are_the_same_under_any_partitioning(spark, monkeypatch, run):
    from packgraph.llm import scratch

    monkeypatch.setattr(scratch, "REPEATS", 7)  # so that some rows alike are dealt to several tasks
    rows = [*ROWS, *[(i, "t" * (i % 90)) for i in range(1500)], *[(3000, "again")] * 40]
    found = [digest(run(table(spark, rows).repartition(n))) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    assert digest(run(table(spark, rows[::-1]).coalesce(2))) == found[0]


def test_stages_of_quality_keep_clashing_columns(spark):
    net = 0.9
    for kept in (quality_cnn.keep(odd(spark), labels(spark), net), quality_rules.keep(wide(spark), labels(spark))):
        assert set(kept.columns) >= {"doc_id", "text"} and kept.count() >= 0
    assert quality_cnn.keep(odd(spark), labels(spark), net).columns == odd(spark).columns


def test_messages_and_captures_with_clashing_columns(spark):
    from datetime import datetime as dt

    rows = [(1, 0, "user", "q" * 200_000), (1, 1, "assistant", "a\n" * 100_000), (2, None, None, None)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    other = plain.selectExpr("'x' AS tree", "1 AS node", "2 AS t", "*", "3 AS leaf", "4 AS rank")
    got = [digest(chat_format.digest(chat_format.format_trees(chat_format.as_messages(t)))) for t in (plain, other)]
    assert got[0] == got[1] and len(got[0]) == 2
    messages = chat_format.as_messages(plain).selectExpr("1 AS t", "'s' AS steps", "*", "2 AS up")
    assert chat_format.format_trees(messages).count() == 2
    captures = spark.createDataFrame([(1, "http://a.org", dt(2020, 5, 1)), (None, None, None)], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([("a.org", "spam", "add", dt(2020, 1, 1)), (None, None, None, None)], "pattern string, list string, action string, at timestamp")
    odd_captures = captures.selectExpr("'h' AS host", "'p' AS pattern", "1 AS at", "2 AS capture", "3 AS until", "*")
    assert digest(url_filter.url_filter(odd_captures, entries.selectExpr("1 AS since", "2 AS until", "*"))) == digest(url_filter.url_filter(captures, entries))


def test_long_copied_texts_take_time_in_proportion(spark):
    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        df = table(spark, [(1, text), (2, "top\n" + text), (3, text + "\nend")])
        start = time.perf_counter()
        got = {r["doc_id"]: r for r in line_dedup.line_dedup(df).collect()}
        assert got[2]["n_removed"] == n and got[2]["text"] == "top" and got[3]["text"] == "end"
        return time.perf_counter() - start

    seconds(1000)
    short, long = seconds(20_000), seconds(80_000)
    assert long < 8 * short + 5


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def write(docs, quality):
        path = str(tmp_path_factory.mktemp("tables"))
        spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(quality, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return write


def test_pipeline_of_empty_and_null_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(None, None, None, None, None), (None, good, None, None, None), (5, good + " end", "en", None, 3), (5, good + " end", "en", None, 3), (6, "", "en", "s", 0), (7, None, None, None, None)]
    got = corpus_pipeline.run(spark, folder(rows, [(5, 1, 0), (None, None, None)])).collect()
    assert [r["doc_id"] for r in got] == [5]  # one of the near copies and no text without words
