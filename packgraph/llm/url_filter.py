"""URL filters by a temporal join with dated lists, in DataFrame operations only.

List entries say that a pattern was added to a list or removed from it at some time. They become validity intervals, each
from an addition to the next entry of the same pattern and list. A capture is held against the entries of its host and of every parent
domain that were active when it was fetched, by an as-of join: captures and the starts of intervals are put in one order of
time, and each capture takes the last interval that started before it. So a pattern costs its captures and its entries,
not their product, however often it flips. A pattern with many captures is dealt to several orders, each with its own copy
of the intervals and at least as many captures as intervals.

Lists don't touch each other: a pattern stays active as long as one list has it. Of several entries of a pattern and list at
one time, a removal wins over an addition; of several lists that have the longest pattern, the largest name is given.
An interval contains its start, not its end. Hosts in brackets have no parent domains. Nulls: entries without pattern, list,
action or time are ignored; a capture without a URL, a host or a time matches nothing and is kept in the output. Repeated captures
get the same answer each, as page_id, URL and time decide it. Empty tables: without entries nothing matches, without
captures there are no rows. The entries of one pattern and list are sorted by one task, which may spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packgraph.llm.scratch import Scratch, plain

FOREVER = "9999-12-31 00:00:00"
CAPTURES = 256  # of a pattern and list that go through one order, or as many as there are intervals if these are more


def host(url: Column) -> Column:
    """The lower-case host of a URL with a scheme, without user, port and trailing dots; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.+$", ""), F.lit(""))


def domains(name: Column) -> Column:
    """A host and each of its parent domains, longest first."""
    labels = F.split(name, r"\.")
    return F.when(name.startswith("["), F.array(name)).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, list, since and until of each addition; entries: pattern, list, action (add or remove), at."""
    dated = plain(entries, pattern="string", list="string", action="string", at="timestamp").filter("pattern IS NOT NULL AND list IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    single = dated.groupBy(F.lower("pattern").alias("pattern"), "list", "at").agg(F.max("action").alias("action"))
    until = F.coalesce(F.lead("at").over(Window.partitionBy("pattern", "list").orderBy("at")), F.lit(FOREVER).cast("timestamp"))
    return single.withColumn("until", until).filter("action = 'add'").select("pattern", "list", F.col("at").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of captures (page_id, url, fetched_at): page_id, url, fetched_at, host, n_active, blocked, pattern and
    list; the last two of the longest active pattern."""
    seen = plain(captures, page_id="long", url="string", fetched_at="timestamp").withColumn("host", host(F.col("url")))
    scratch = Scratch(captures.sparkSession, "url-filter")
    spans = scratch.put("intervals", intervals(entries))
    asked = seen.filter("fetched_at IS NOT NULL").select("page_id", "url", "fetched_at", F.explode(domains(F.col("host"))).alias("pattern"))
    sizes = spans.groupBy("pattern", "list").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("pattern").agg(F.count(F.lit(1)).alias("captures")), "pattern")
    orders = scratch.put("orders", sizes.select("pattern", "list", F.ceil(F.col("captures") / F.greatest("n", F.lit(CAPTURES))).cast("int").alias("orders")))
    own = F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.col("orders")).cast("int")
    placed = asked.join(orders, "pattern").select("pattern", "list", own.alias("order"), F.col("fetched_at").alias("at"), F.lit(1).alias("capture"), "page_id", "url", F.lit(None).cast("timestamp").alias("until")).distinct()
    copies = spans.join(orders, ["pattern", "list"]).select("pattern", "list", F.explode(F.sequence(F.lit(0), F.col("orders") - 1)).alias("order"), F.col("since").alias("at"), F.lit(0).alias("capture"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "until")
    before = Window.partitionBy("pattern", "list", "order").orderBy("at", "capture").rowsBetween(Window.unboundedPreceding, 0)
    held = placed.unionByName(copies).withColumn("until", F.last("until", ignorenulls=True).over(before))
    met = held.filter("capture = 1 AND at < until").select("page_id", "url", F.col("at").alias("fetched_at"), "pattern", "list")
    best = met.groupBy("page_id", "url", "fetched_at").agg(F.countDistinct("pattern").alias("n_active"), F.max(F.struct(F.length("pattern").alias("n"), "pattern", "list")).alias("best"))
    best = best.select(*[F.col(c).alias(f"b_{c}") for c in ("page_id", "url", "fetched_at")], "n_active", "best")
    same = F.col("page_id").eqNullSafe(F.col("b_page_id")) & (F.col("url") == F.col("b_url")) & (F.col("fetched_at") == F.col("b_fetched_at"))
    out = seen.join(best, same, "left")
    return out.select("page_id", "url", "fetched_at", "host", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"), F.col("best.list").alias("list"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time, spread over the hours of 2022 to 2024 by page_id."""
    hours = F.pmod(F.col("page_id") * 7919, F.lit(3 * 365 * 24)).cast("int")
    return pages.select("page_id", "url", (F.lit("2022-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), hours)).alias("fetched_at"))


def sample_entries(captures: DataFrame) -> DataFrame:
    """Dated entries for a third of the captures' hosts and parent domains: spam from the start to day 200, adult from day 100 to
    day 400, so that the two overlap and end apart, and both again from day 500 on."""
    names = captures.select(F.explode(domains(host(F.col("url")))).alias("pattern")).distinct().withColumn("n", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 4), 16, 10).cast("int"))
    start = F.lit("2022-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("n") % 500)
    step = lambda days, action, of: F.struct((start + F.make_dt_interval(F.lit(days))).alias("at"), F.lit(action).alias("action"), F.lit(of).alias("list"))
    return names.filter("n % 3 = 0 AND contains(pattern, '.')").select("pattern", F.explode(F.array(step(0, "add", "spam"), step(100, "add", "adult"), step(200, "remove", "spam"), step(400, "remove", "adult"), step(500, "add", "adult"), step(500, "add", "spam"))).alias("e")).select("pattern", "e.*")


SQL = r"""
WITH c AS (SELECT page_id, url, TIMESTAMP '2022-01-01 00:00:00' + to_hours(CAST((page_id * 7919) % (3 * 365 * 24) AS INTEGER)) AS fetched_at,
             nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '\.+$', ''), '') AS host FROM pages),
d AS (SELECT *, CASE WHEN starts_with(host, '[') THEN [host] ELSE string_split(host, '.') END AS ls FROM c),
n AS (SELECT page_id, url, fetched_at, array_to_string(ls[i:], '.') AS name FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
p AS (SELECT DISTINCT name AS pattern, CAST('0x' || substr(md5(name), 1, 4) AS INTEGER) AS n FROM n),
e AS (SELECT pattern, TIMESTAMP '2022-01-01 00:00:00' + to_days(n % 500 + s.days) AS dt, s.action, s.list
      FROM p, (VALUES (0, 'add', 'spam'), (100, 'add', 'adult'), (200, 'remove', 'spam'), (400, 'remove', 'adult'), (500, 'add', 'adult'), (500, 'add', 'spam')) s(days, action, list)
      WHERE n % 3 = 0 AND contains(pattern, '.')),
g AS (SELECT pattern, list, dt, max(action) AS action FROM e GROUP BY pattern, list, dt),
v AS (SELECT pattern, list, action, dt AS since, coalesce(lead(dt) OVER (PARTITION BY pattern, list ORDER BY dt), TIMESTAMP '9999-12-31 00:00:00') AS until FROM g),
m AS (SELECT n.page_id, n.url, count(DISTINCT pattern) AS n_active, arg_max(pattern, length(pattern)) AS pattern, arg_max(list, (length(pattern), list)) AS list
      FROM n JOIN v ON n.name = v.pattern AND v.action = 'add' AND v.since <= n.fetched_at AND n.fetched_at < v.until GROUP BY n.page_id, n.url)
SELECT c.page_id, c.url, c.fetched_at, c.host, coalesce(m.n_active, 0) AS n_active, m.pattern IS NOT NULL AS blocked, m.pattern, m.list
FROM c LEFT JOIN m ON c.page_id = m.page_id AND c.url = m.url
"""
