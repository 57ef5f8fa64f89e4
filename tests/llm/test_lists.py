"""Dated lists that overlap."""

from datetime import datetime as dt

from packgraph.llm import url_filter


def test_lists_of_one_pattern_do_not_end_each_other(spark):
    rows = [
        ("bad.org", "adult", "add", dt(2020, 1, 1)), ("bad.org", "spam", "add", dt(2020, 3, 1)), ("bad.org", "spam", "remove", dt(2020, 5, 1)), ("BAD.org", "adult", "remove", dt(2020, 9, 1)),
        ("same.org", "a", "add", dt(2020, 1, 1)), ("same.org", "b", "add", dt(2020, 1, 1)), ("same.org", "b", "remove", dt(2020, 2, 1)), ("swap.org", "a", "add", dt(2020, 1, 1)), ("swap.org", "a", "remove", dt(2020, 6, 1)), ("swap.org", "b", "add", dt(2020, 6, 1)),
    ]
    entries = spark.createDataFrame(rows, "pattern string, list string, action string, at timestamp")
    seen = [("bad.org", 2, "adult"), ("bad.org", 4, "spam"), ("bad.org", 6, "adult"), ("bad.org", 10, None), ("same.org", 1, "b"), ("same.org", 3, "a"), ("swap.org", 3, "a"), ("swap.org", 6, "b"), ("swap.org", 12, "b")]
    captures = spark.createDataFrame([(i, f"http://{h}/", dt(2020, m, 1)) for i, (h, m, _) in enumerate(seen)], "page_id long, url string, fetched_at timestamp")
    got = {r["page_id"]: (r["n_active"], r["blocked"], r["list"]) for r in url_filter.url_filter(captures, entries).collect()}
    assert got == {i: (int(x is not None), x is not None, x) for i, (_, _, x) in enumerate(seen)}


def test_a_removal_of_one_list_leaves_the_other(spark):
    rows = [("bad.org", "spam", "add", dt(2020, 1, 1)), ("bad.org", "adult", "add", dt(2020, 2, 1)), ("bad.org", "spam", "remove", dt(2020, 3, 1)), ("bad.org", None, "add", dt(2019, 1, 1))]
    entries = spark.createDataFrame(rows, "pattern string, list string, action string, at timestamp")
    seen = spark.createDataFrame([(1, "http://bad.org/", dt(2020, 6, 1)), (2, "http://bad.org/", dt(2019, 6, 1))], "page_id long, url string, fetched_at timestamp")
    assert {r["page_id"]: (r["blocked"], r["list"]) for r in url_filter.url_filter(seen, entries).collect()} == {1: (True, "adult"), 2: (False, None)}


def test_a_pattern_that_flips_often_and_has_many_captures(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(url_filter, "CAPTURES", 50)
    start = F.lit("2020-01-01").cast("timestamp")
    entries = spark.range(2000).select(F.lit("bad.org").alias("pattern"), F.lit("spam").alias("list"), F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("action"), (start + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("at"))
    seen = spark.range(5000).select(F.col("id").alias("page_id"), F.lit("https://www.bad.org").alias("url"), (start + F.make_dt_interval(F.lit(0), (F.col("id") % 2500).cast("int"), F.lit(30))).alias("fetched_at"))
    wide = seen.selectExpr("'h' AS host", "1 AS pattern", "'x' AS list", "*", "2 AS until", "3 AS at")
    got = url_filter.url_filter(wide, entries).collect()
    assert len(got) == 5000 and all(r["blocked"] == (r["page_id"] % 2500 < 2000 and r["page_id"] % 2 == 0) for r in got)


def test_hosts_in_brackets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("http://[2001:DB8::1]:80/x",), ("ftp://u@[::1]",), ("http://a.b.c:8/",), ("http:///x",)], "u string")
    got = df.select(url_filter.domains(url_filter.host(F.col("u"))).alias("d")).collect()
    assert [r["d"] for r in got] == [["[2001:db8::1]"], ["[::1]"], ["a.b.c", "b.c", "c"], None]
