"""Named queries over the star-schema tables and the SQL that says the same.

Each query applies one operator of the package to whole tables; outputs are flat and cast, so both engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packgraph.functions import scalars as S
from packgraph.operators import aggregate as A
from packgraph.operators import anchors as AN
from packgraph.operators import bim as B
from packgraph.operators import derive as D
from packgraph.operators import drawing as DR
from packgraph.operators import graph as G
from packgraph.operators import join as J
from packgraph.operators import ordering as O
from packgraph.operators import profile as P
from packgraph.operators import rollup as R
from packgraph.operators import search as H
from packgraph.operators import steel as ST
from packgraph.operators.dealing import tasks_for
from packgraph.operators.fields import Resolver
from packgraph.operators.where import filter_rows
from packgraph.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def big(c: Column) -> Column:
    return c.cast("long")


def dbl(c: Column) -> Column:
    return c.cast("double")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over all shuffle partitions: a file of small rows is read by few tasks, too few where each row becomes texts that are parsed."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- filters -----------------------------------------------------------------------------------------------------------

LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
_LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE "
WHERES: dict[str, tuple[dict, str]] = {
    "eq": ({"l_quantity": 17}, "l_quantity = 17"),
    "eq_text_number": ({"l_quantity": "17.0"}, "l_quantity = 17"),
    "ne": ({"l_returnflag__ne": "N"}, "NOT coalesce(l_returnflag = 'N', false)"),
    "in": ({"l_returnflag__in": ["A", "R"]}, "l_returnflag IN ('A', 'R')"),
    "not_in": ({"l_returnflag": {"not_in": ["A", "R"]}}, "NOT coalesce(l_returnflag IN ('A', 'R'), false)"),
    "range": ({"l_quantity": {"gte": 10, "lt": 20}}, "l_quantity >= 10 AND l_quantity < 20"),
    "gt_lte_suffix": ({"l_quantity__gt": 45, "l_discount__lte": 0.02}, "l_quantity > 45 AND l_discount <= 0.02"),
    "contains": ({"l_returnflag__contains": "n"}, "contains(lower(l_returnflag), 'n')"),
    "startswith": ({"l_linestatus__startswith": "o"}, "starts_with(lower(l_linestatus), 'o')"),
    "endswith": ({"l_linestatus__endswith": "F"}, "ends_with(lower(l_linestatus), 'f')"),
    "regex": ({"l_returnflag__regex": "^[AR]$"}, "regexp_matches(l_returnflag, '^[AR]$')"),
    "wildcard": ({"l_returnflag__wildcard": "[!N]*"}, "regexp_full_match(l_returnflag, '[^N].*')"),
    "exists": ({"l_tax__exists": True, "absent__exists": False, "l_quantity": 3}, "l_quantity = 3"),
    "null": ({"$or": [{"l_tax": None}, {"l_quantity": 50}]}, "l_tax IS NULL OR l_quantity = 50"),
    "and_or_not": ({"$and": [{"$or": [{"l_returnflag": "R"}, {"l_quantity__gte": 49}]}, {"$not": {"l_linestatus": "F"}}]}, "(l_returnflag = 'R' OR l_quantity >= 49) AND NOT coalesce(l_linestatus = 'F', false)"),
    "empty_or": ({"$or": []}, "false"),
    "empty_and": ({"$and": [], "l_linenumber": 7}, "l_linenumber = 7"),
    "not_missing": ({"$not": {"absent__gt": 3}, "l_linenumber": 6}, "l_linenumber = 6"),
    "time": ({"l_shipdate": {"gte": "1997-01-01", "lt": "1997-02-01"}}, "l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-02-01'"),
}
for _name, (_where, _sql) in WHERES.items():
    query(f"where_{_name}", _LINE_SQL + f"({_sql})")(lambda t, w=_where: filter_rows(t.lineitem, w).select(*LINE))

query("where_numeric_string", "SELECT p_partkey, p_brand FROM part WHERE try_cast(regexp_extract(p_brand, '[0-9]+') AS INTEGER) BETWEEN 20 AND 30")(
    lambda t: filter_rows(t.part.withColumn("code", F.regexp_extract("p_brand", "[0-9]+", 0)), {"code": {"gte": 20, "lte": "30"}}).select("p_partkey", "p_brand")
)
query("where_property", "SELECT event_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND NOT coalesce(event_type = 'click', false)")(
    lambda t: filter_rows(t.events.withColumn("properties", F.parse_json("props")), {"k__gte": 50, "$not": {"event_type": "click"}}, "properties").select("event_id", "event_type")
)
query("where_property_exists", "SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.absent') IS NULL")(
    lambda t: filter_rows(t.events.withColumn("properties", F.parse_json("props")), {"properties.k__exists": True, "properties.absent__exists": False}, "properties").select("event_id")
)
query("where_property_in", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) IN (1, 2, 3)")(
    lambda t: filter_rows(t.events.withColumn("properties", F.parse_json("props")), {"k__in": ["1", 2, 3.0]}, "properties").select("event_id")
)

# --- projections, order, pages --------------------------------------------------------------------------------------------

query("project_short_names", "SELECT s.id AS id, s.name AS name, s.label AS label FROM (SELECT n_nationkey AS id, n_name AS name, n_name AS label FROM nation) s")(
    lambda t: O.project(t.nation.select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("a"), F.struct(F.col("n_name").alias("label")).alias("b")), ["a.id", "a.name", "b.label"])
)
query("page_sorted", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")(
    lambda t: O.page(t.orders, "-o_totalprice", 25, 10, ["o_orderkey"]).select("o_orderkey", "o_totalprice")
)
query("order_nulls_last", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 40")(
    lambda t: O.page(t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p")), "-p", 40, 0, ["o_orderkey"])
)
query("order_natural", "SELECT p_partkey, p_brand FROM part ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER), p_partkey LIMIT 60")(
    lambda t: O.page(t.part, {"field": "p_brand", "natural": True}, 60, 0, ["p_partkey"]).select("p_partkey", "p_brand")
)
query("order_mixed", "SELECT p_partkey, v FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS v FROM part) ORDER BY try_cast(v AS INTEGER) IS NULL, try_cast(v AS INTEGER), lower(v), p_partkey LIMIT 80")(
    lambda t: O.page(t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("v")), "v", 80, 0, ["p_partkey"])
)

# --- aggregation ------------------------------------------------------------------------------------------------------------

query("aggregate_where_grouped", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
       CAST(round_even(sum(CAST(l_extendedprice AS DECIMAL(18,4))) / count(*), 2) AS DOUBLE) AS price
FROM lineitem WHERE l_quantity >= 10 AND NOT coalesce(l_returnflag = 'N', false) GROUP BY ALL""")(
    lambda t: A.aggregate(t.lineitem, {"$and": [{"l_quantity__gte": 10}, {"$not": {"l_returnflag": "N"}}]}, ["l_returnflag", "l_linestatus"], [{"agg": "count", "as": "n"}, {"agg": "sum", "field": "l_quantity", "as": "qty"}, {"agg": "avg", "field": "l_extendedprice", "as": "price"}])
    .select("l_returnflag", "l_linestatus", "n", dbl(F.col("qty")).alias("qty"), dbl(F.bround("price", 2)).alias("price"))
    .orderBy("l_returnflag", F.col("l_linestatus").desc())
)
query("agg_global", "SELECT count(*) AS row_count, count(DISTINCT o_custkey) AS customers, CAST(min(o_totalprice) AS DOUBLE) AS low, CAST(max(o_totalprice) AS DOUBLE) AS high FROM orders")(
    lambda t: A.aggregate(t.orders, metrics=[{"agg": "count", "as": "row_count"}, {"agg": "count_distinct", "field": "o_custkey", "as": "customers"}, {"agg": "min", "field": "o_totalprice", "as": "low"}, {"agg": "max", "field": "o_totalprice", "as": "high"}])
    .select("row_count", "customers", dbl(F.col("low")).alias("low"), dbl(F.col("high")).alias("high"))
)
query("agg_empty_global", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total")(
    lambda t: A.aggregate(t.orders, {"o_orderkey__lt": -1}, metrics=[{"agg": "count", "as": "n"}, {"agg": "sum", "field": "o_totalprice", "as": "total"}]).select("n", dbl(F.col("total")).alias("total"))
)
query("agg_empty_grouped", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE false GROUP BY 1")(
    lambda t: A.aggregate(t.orders, {"o_orderkey__lt": -1}, ["o_orderstatus"], [{"agg": "count", "as": "n"}])
)
query("agg_first_lists", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status, string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS all_status, (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT unnest(list(o.o_orderstatus)) AS s)) AS set_status FROM orders o GROUP BY o_custkey")(
    lambda t: A.aggregate(t.orders, None, ["o_custkey"], [{"agg": "first", "field": "o_orderstatus", "as": "f"}, {"agg": "collect_list", "field": "o_orderstatus", "as": "l"}, {"agg": "collect_set", "field": "o_orderstatus", "as": "s"}], order=F.col("o_orderkey"))
    .select("o_custkey", F.col("f").alias("first_status"), F.array_join("l", "|").alias("all_status"), F.array_join("s", "|").alias("set_status"))
)
query("agg_skipped", "SELECT p_type, CAST(sum(try_cast(v AS INTEGER)) AS DOUBLE) AS total, count(*) FILTER (WHERE try_cast(v AS INTEGER) IS NULL) AS total_skipped FROM (SELECT p_type, CASE WHEN p_size % 3 = 0 THEN 'M' || p_size ELSE CAST(p_size AS VARCHAR) END AS v FROM part) GROUP BY p_type")(
    lambda t: A.aggregate(t.part.withColumn("v", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("M"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))), None, ["p_type"], [{"agg": "sum", "field": "v", "as": "total"}], skipped=True)
    .select("p_type", dbl(F.col("total")).alias("total"), "total_skipped")
)
query("agg_property_group", "SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, count(*) AS n, CAST(round_even(sum(CAST(value AS DECIMAL(28,10))), 4) AS DOUBLE) AS total FROM events GROUP BY 1")(
    lambda t: A.aggregate(t.events.withColumn("properties", F.parse_json("props")), None, ["k"], [{"agg": "count", "as": "n"}, {"agg": "sum", "field": "value", "as": "total"}], "properties", F.col("event_id")).select("k", "n", dbl(F.bround("total", 4)).alias("total"))
)
query("distinct_values", "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F'")(lambda t: A.distinct_values(t.orders, "o_orderpriority", {"o_orderstatus": "F"}))
query("distinct_array_values", "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS value FROM part")(lambda t: A.distinct_values(t.part.withColumn("words", F.split("p_type", " ")), "words"))
query("histogram", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")(lambda t: A.histogram(t.events, F.col("event_type")))
query("nested_totals", """
WITH low AS (SELECT c_mktsegment, o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, count(*) AS n, count(DISTINCT o_orderkey) AS refs FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, CAST(sum(total) AS DOUBLE) AS total, CAST(sum(n) AS BIGINT) AS n, string_agg(o_orderpriority || '=' || n || '/' || refs, ';' ORDER BY o_orderpriority) AS items FROM low GROUP BY 1""")(
    lambda t: A.nested_totals(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)"), "o_orderkey")
    .select("c_mktsegment", dbl(F.col("total")).alias("total"), "n", F.array_join(F.transform("items", lambda i: F.concat(i["o_orderpriority"], F.lit("="), i["n"].cast("string"), F.lit("/"), i["refs"].cast("string"))), ";").alias("items"))
)

# --- joins --------------------------------------------------------------------------------------------------------------------

for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    query(f"join_{_how}", f"""
WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name FROM customer WHERE c_mktsegment <> 'BUILDING'),
o AS (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) AS n_right, min(o_orderkey) AS first_right FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT coalesce(c.k, o.k) AS join_key, c_name, n_right, first_right FROM c {_join} o ON c.k = o.k""")(
        lambda t, how=_how: J.join_by_property(t.customer, "c_custkey", t.orders, "o_custkey", how, {"c_mktsegment__ne": "BUILDING"}, {"o_orderstatus": "F"}, summary=[F.count(F.lit(1)).alias("n_right"), F.min("o_orderkey").alias("first_right")])
        .select("join_key", "left.c_name", "n_right", "first_right")
    )
query("join_nested", "SELECT CAST(n_nationkey AS VARCHAR) AS join_key, n_name, count(*) AS n, string_agg(s_name, '|' ORDER BY s_name) AS names FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY ALL")(
    lambda t: J.join_by_property(t.nation, "n_nationkey", t.supplier, "s_nationkey").select("join_key", "left.n_name", F.size("right").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("right", lambda r: r["s_name"])), "|").alias("names"))
)
query("join_keys", """
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS join_key, CASE WHEN b.k IS NULL THEN 'unmatched_left' WHEN a.k IS NULL THEN 'unmatched_right' ELSE 'matched' END AS side
FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k""")(
    lambda t: J.key_diagnostics(t.customer, "c_custkey", t.orders, "o_custkey")
)
query("join_enrich", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")(lambda t: J.enrich(t.supplier, "s_nationkey", t.nation, "n_nationkey", ["n_name"]).select("s_suppkey", "n_name"))
query("join_visible", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(lambda t: J.visible(t.customer, "c_nationkey", t.nation.filter("n_regionkey = 1"), "n_nationkey").select("c_custkey"))
query("join_unassigned", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")(lambda t: D.orphans(t.part.select("p_partkey"), "p_partkey", t.lineitem.filter("l_quantity > 48").select("l_partkey").distinct(), "l_partkey"))
query("evidence_fallback", "SELECT n_name FROM nation")(lambda t: J.evidence_first(t.nation.filter("n_nationkey < 0").select("n_name"), t.nation.select("n_name")))

# --- graph --------------------------------------------------------------------------------------------------------------------


def star_edges(t: Tables) -> DataFrame:
    return G.union_edges(None, [
        G.keyed_edges(t.lineitem, ("order", "l_orderkey"), ("part", "l_partkey"), "has_part", tasks=tasks_for(t.lineitem)),
        G.keyed_edges(t.orders, ("customer", "o_custkey"), ("order", "o_orderkey"), "has_order", unique=True),
        G.keyed_edges(t.customer, ("nation", "c_nationkey"), ("customer", "c_custkey"), "has_customer", unique=True),
        G.keyed_edges(t.supplier, ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "has_supplier", unique=True),
        G.keyed_edges(t.nation, ("region", "n_regionkey"), ("nation", "n_nationkey"), "has_nation", unique=True),
    ], once=True)


_EDGES = """
e AS (SELECT DISTINCT * FROM (
  SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'has_part' AS relation FROM lineitem
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'has_order' FROM orders
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'has_customer' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'has_supplier' FROM supplier
  UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, 'has_nation' FROM nation))"""
query("edges_inferred", f"WITH {_EDGES} SELECT source, target, relation FROM e")(lambda t: star_edges(t).select("source", "target", "relation"))
query("edges_explicit_first", f"WITH {_EDGES} SELECT relation, count(*) AS n FROM (SELECT source, relation, target FROM e UNION SELECT 'region:0', 'has_nation', 'nation:0' UNION SELECT 'region:0', 'near', 'region:1') GROUP BY 1")(
    lambda t: G.union_edges(t.spark.createDataFrame([("region:0", "has_nation", "nation:0"), ("region:0", "near", "region:1")], "source string, relation string, target string"), [star_edges(t).select("source", "relation", "target")]).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
query("edge_ids", f"WITH {_EDGES} SELECT source, target, substr(sha1('[\"demo\",\"' || source || '\",\"' || relation || '\",\"' || target || '\"]'), 1, 16) AS id FROM e")(
    lambda t: G.with_ids(star_edges(t), "demo").select("source", "target", "id")
)
query("degree", f"WITH {_EDGES} SELECT id, CAST(sum(o) AS BIGINT) AS degree_out, CAST(sum(i) AS BIGINT) AS degree_in, count(*) AS degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY id")(lambda t: G.degrees(star_edges(t)))
query("neighbours", f"WITH {_EDGES} SELECT source AS seed, target AS neighbour, relation, 'out' AS direction FROM e WHERE source IN ('nation:1', 'nation:2') UNION ALL SELECT target, source, relation, 'in' FROM e WHERE target IN ('nation:1', 'nation:2')")(
    lambda t: G.neighbours(star_edges(t), t.spark.createDataFrame([("nation:1",), ("nation:2",)], "id string"))
)
query("k_hop", f"""
WITH {_EDGES}, u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e),
h0 AS (SELECT 'nation:3' AS id UNION SELECT 'supplier:1'), h1 AS (SELECT DISTINCT b AS id FROM u JOIN h0 ON a = id), h2 AS (SELECT DISTINCT b AS id FROM u JOIN h1 ON a = id)
SELECT id, min(hop) AS hop FROM (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""")(
    lambda t: G.k_hop(star_edges(t), t.spark.createDataFrame([("nation:3",), ("supplier:1",)], "id string"), 2)
)
query("induced_subgraph", f"WITH {_EDGES} SELECT source, target, relation FROM e WHERE (source LIKE 'region:%' OR source LIKE 'nation:%' OR source LIKE 'supplier:%') AND (target LIKE 'nation:%' OR target LIKE 'supplier:%')")(
    lambda t: G.induced(star_edges(t), t.nation.select(G.node_key("nation", "n_nationkey").alias("id")).unionByName(t.region.select(G.node_key("region", "r_regionkey").alias("id"))).unionByName(t.supplier.select(G.node_key("supplier", "s_suppkey").alias("id")))).select("source", "target", "relation")
)
query("stub_nodes", f"WITH {_EDGES} SELECT DISTINCT id, split_part(id, ':', 1) AS kind FROM (SELECT unnest([source, target]) AS id FROM e) WHERE id NOT IN (SELECT 'nation:' || n_nationkey FROM nation)")(
    lambda t: G.stub_nodes(star_edges(t), t.nation.select(G.node_key("nation", "n_nationkey").alias("id")))
)
query("merge_packs", "SELECT 'a::' || n_name AS id, 'a' AS pack_id FROM nation UNION ALL SELECT 'b::' || r_name, 'b' FROM region")(
    lambda t: G.merge_packs({"a": t.nation.select(F.col("n_name").alias("id")), "b": t.region.select(F.col("r_name").alias("id"))}).select("id", "pack_id")
)
query("node_dedupe", "SELECT id, min(event_id) AS ord, arg_max(event_type, event_id) AS label FROM (SELECT 'u' || user_id AS id, event_id, event_type FROM events) GROUP BY id")(
    lambda t: G.dedupe_nodes(t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("ord"), F.col("event_type").alias("label")), "ord")
)
query("parallel_lanes", "SELECT source, target, relation, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY relation, source, target) - (count(*) OVER (PARTITION BY least(source, target), greatest(source, target)) + 1) / 2.0 AS lane FROM (SELECT DISTINCT 'c' || o_custkey AS source, o_orderstatus AS target, o_orderpriority AS relation FROM orders)")(
    lambda t: G.lanes(t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderstatus").alias("target"), F.col("o_orderpriority").alias("relation")).distinct()).withColumn("lane", dbl(F.col("lane")))
)
query("pack_budget", """
WITH RECURSIVE s AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*), CAST(c_nationkey AS VARCHAR)) AS i FROM customer GROUP BY 1),
r AS (SELECT 0::BIGINT AS i, 100::BIGINT AS rest, 25::BIGINT AS packs, 0::BIGINT AS share UNION ALL
  SELECT s.i, rest - least(n, CAST(ceil(rest / packs) AS BIGINT)), packs - 1, least(n, CAST(ceil(rest / packs) AS BIGINT)) FROM r JOIN s ON s.i = r.i + 1)
SELECT c_nationkey, c_custkey, place FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer) JOIN s USING (c_nationkey) JOIN r USING (i) WHERE place <= share""")(
    lambda t: G.budget(t.customer, "c_nationkey", ["c_custkey"], 100, 25).select("c_nationkey", "c_custkey", big(F.col("place")).alias("place"))
)

# --- search --------------------------------------------------------------------------------------------------------------------


def _score_sql(text: str, terms: list[str]) -> str:
    n = {t: f"least((length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}, 5)" for t in terms}
    total = " + ".join(f"CASE WHEN {n[t]} > 0 THEN {1 + 0.4 * (len(t) - 1)}::DOUBLE * (1 + 0.2::DOUBLE * {n[t]}) ELSE 0 END" for t in terms)
    hits = " + ".join(f"CAST({n[t]} > 0 AS INTEGER)" for t in terms)
    return f"({total}) * (1 + 0.5::DOUBLE * ({hits}))"


_TERMS = H.query_terms("the apache license and garantie 2.0")
query("search_documents", f"SELECT doc_id, round({_score_sql('lower(text)', _TERMS)}, 3) AS score FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{t}')" for t in _TERMS))(
    lambda t: H.search(t.documents, F.col("text"), "the apache license and garantie 2.0", None, ["doc_id"]).select("doc_id", F.round("score", 3).alias("score"))
)
query("search_top", f"SELECT doc_id, score FROM (SELECT doc_id, round({_score_sql('lower(text)', ['thation', 'licensed'])}, 3) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")(
    lambda t: H.search(t.documents, F.col("text"), "thation licensed", 20, ["doc_id"]).select("doc_id", F.round("score", 3).alias("score"))
)
query("search_snippet", "SELECT item_id, trim(regexp_replace(substr(text, greatest(h - 120, 1), h + 260 - greatest(h - 120, 1)), '\\s+', ' ', 'g')) AS snippet FROM (SELECT item_id, text, coalesce(nullif(instr(lower(text), 'tion'), 0), 1) AS h FROM benchmark)")(
    lambda t: t.benchmark.select("item_id", H.snippet(F.col("text"), ["tion"]).alias("snippet"))
)
query("search_top_per_pack", f"SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY round({_score_sql('lower(text)', ['licensed'])}, 6) DESC, doc_id) AS place FROM documents WHERE contains(lower(text), 'licensed')) WHERE place <= 3")(
    lambda t: H.top_per_pack(t.documents, F.col("text"), "licensed", "source", 3, ["doc_id"]).select("source", "doc_id", big(F.col("place")).alias("place"))
)
query("search_conversations", f"SELECT conv_id, turn, round({_score_sql('lower(text)', ['schen', 'nicht'])}, 3) AS score FROM conversations WHERE contains(lower(text), 'schen') OR contains(lower(text), 'nicht')")(
    lambda t: H.search(t.conversations, F.col("text"), "schen nicht", None, ["conv_id", "turn"]).select("conv_id", "turn", F.round("score", 3).alias("score"))
)
query("search_catalogue", f"SELECT p_partkey, round({_score_sql('''lower(p_name || ' ' || p_brand || ' ' || p_type)''', ['brand', '13', 'steel'])}, 3) AS score FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '13') OR contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'steel')")(
    lambda t: H.search(t.part, F.concat_ws(" ", "p_name", "p_brand", "p_type"), "brand#13 steel", None, ["p_partkey"]).select("p_partkey", F.round("score", 3).alias("score"))
)
query("search_merge_evidence", "SELECT doc_id, CASE WHEN contains(lower(text), 'apache') THEN 0 ELSE 1 END AS priority FROM documents WHERE contains(lower(text), 'apache') OR contains(lower(text), 'schtz')")(
    lambda t: H.merge_evidence([t.documents.filter(H.any_term(F.col("text"), [w])).select("doc_id", "lang") for w in ("apache", "schtz")], ["doc_id"]).select("doc_id", "priority")
)

# --- profiles ------------------------------------------------------------------------------------------------------------------

query("schema_profile", """
WITH v AS (SELECT event_type, unnest(json_keys(props)) AS property, props FROM events),
x AS (SELECT event_type, property, json_extract_string(props, '$.' || property) AS value FROM v),
s AS (SELECT event_type, property, count(value) AS n, count(DISTINCT value) AS n_distinct, count(try_cast(value AS DOUBLE)) AS n_numeric, array_to_string(list_sort(list(DISTINCT value))[:8], '|') AS samples FROM x GROUP BY ALL)
SELECT event_type, property, n, n_distinct, round(n / total, 4) AS coverage, round(n_numeric / n, 4) AS numeric_ratio, samples FROM s JOIN (SELECT event_type, count(*) AS total FROM events GROUP BY 1) USING (event_type)""")(
    lambda t: P.property_profile(t.events, "event_type", "props").withColumn("samples", F.array_join("samples", "|"))
)
query("column_profile", "SELECT 'p_brand' AS property, count(p_brand) AS n, count(DISTINCT p_brand) AS n_distinct FROM part UNION ALL SELECT 'p_type', count(p_type), count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', count(p_size), count(DISTINCT p_size) FROM part")(
    lambda t: P.column_profile(t.part, ["p_brand", "p_type", "p_size"])
)
query("field_types", "SELECT field, CASE json_type(props, '$.' || field) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS field FROM events) GROUP BY ALL")(lambda t: P.field_types(t.events, "props"))
query("relation_types", f"WITH {_EDGES} SELECT relation AS key, count(*) AS n FROM e GROUP BY 1")(lambda t: A.histogram(star_edges(t), F.col("relation")))
query("table_counts", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")(
    lambda t: A.table_counts({"nation": t.nation, "orders": t.orders, "part": t.part})
)

# --- roll-ups ------------------------------------------------------------------------------------------------------------------

_MONEY = "CAST(l_extendedprice AS DECIMAL(18,2))"


def parts_with_owners(t: Tables) -> DataFrame:
    n = tasks_for(t.lineitem)
    lines, orders = t.lineitem.repartition(n, "l_orderkey"), t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).repartition(n, "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


_OWNED = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
query("rollup_order", f"SELECT o_orderkey, count(*) AS n, CAST(sum({_MONEY}) AS DOUBLE) AS price FROM {_OWNED} GROUP BY 1")(
    lambda t: R.level(parts_with_owners(t), ["o_orderkey"], {"price": F.col("l_extendedprice").cast("decimal(18,2)")}).select("o_orderkey", "n", dbl(F.col("price")).alias("price"))
)
query("rollup_customer_segment", f"SELECT c_mktsegment, count(*) AS n, CAST(sum({_MONEY}) AS DOUBLE) AS price, count(DISTINCT o_orderkey) AS children FROM {_OWNED} GROUP BY 1")(
    lambda t: R.raise_level(R.level(parts_with_owners(t), ["c_mktsegment", "o_orderkey"], {"price": F.col("l_extendedprice").cast("decimal(18,2)")}), ["c_mktsegment"], ["price"]).select("c_mktsegment", "n", dbl(F.col("price")).alias("price"), "children")
)
query("rollup_by_value", f"SELECT c_mktsegment, coalesce(nullif(l_returnflag, 'N'), '(blank)') AS value, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM {_OWNED} GROUP BY ALL")(
    lambda t: R.by_value(parts_with_owners(t).withColumn("flag", F.nullif("l_returnflag", F.lit("N"))), ["c_mktsegment"], "flag", {"qty": F.col("l_quantity").cast("decimal(18,2)")}).select("c_mktsegment", "value", "n", dbl(F.col("qty")).alias("qty"))
)
query("conditional_counts", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1")(
    lambda t: R.conditional_counts(t.orders, ["o_orderpriority"], {"large": F.col("o_totalprice") > 100000, "done": F.col("o_orderstatus") == "F"})
)
query("extents", "SELECT label, CAST(min(embedding[1]) AS DOUBLE) AS x1, CAST(min(embedding[2]) AS DOUBLE) AS y1, CAST(max(embedding[1]) AS DOUBLE) AS x2, CAST(max(embedding[2]) AS DOUBLE) AS y2 FROM embeddings GROUP BY 1")(
    lambda t: R.extents(t.embeddings, ["label"], dbl(F.get("embedding", F.lit(0))), dbl(F.get("embedding", F.lit(1))))
)
query("facets", "SELECT lower(lang) AS facet, count(DISTINCT doc_id) AS n_objects, min(lang) AS name FROM documents GROUP BY 1")(lambda t: R.facets(t.documents, "lang", "doc_id"))
query("fasteners", "SELECT 'M' || CAST(p_size AS INTEGER) || 'x' || CAST(p_size * 4 AS INTEGER) AS spec, count(*) AS n, CAST(sum(p_size * 2) AS BIGINT) AS quantity FROM part GROUP BY 1")(
    lambda t: R.level(t.part.withColumn("spec", R.fastener_name(F.col("p_size") / 1000.0, F.col("p_size") * 4 / 1000.0)), ["spec"], {"quantity": big(F.col("p_size") * 2)})
)
query("type_rows", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS length, CAST(sum(p_size * 2) AS BIGINT) AS area, CAST(sum(CASE WHEN p_type LIKE '%STEEL%' THEN p_size ELSE 0 END) AS BIGINT) AS volume, array_to_string(list_sort(list(DISTINCT p_type))[:3], '|') AS samples FROM part GROUP BY 1")(
    lambda t: R.type_rows(t.part, ["p_brand"], big(F.col("p_size")), big(F.col("p_size") * 2), big(F.col("p_size")), F.col("p_type").contains("STEEL"), F.col("p_type")).withColumn("samples", F.array_join("samples", "|"))
)
query("quality_counters", f"""
WITH {_EDGES}, n AS (SELECT 'nation:' || n_nationkey AS id, n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e WHERE source NOT IN (SELECT id FROM n) OR target NOT IN (SELECT id FROM n)) AS broken_edges,
  (SELECT count(*) FROM n WHERE n_name LIKE '%A%') AS nodes_without_evidence, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY relation)) AS largest_relation""")(
    lambda t: _quality(t)
)


def _quality(t: Tables) -> DataFrame:
    nodes = t.nation.select(G.node_key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(t.region.select(G.node_key("region", "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    edges = star_edges(t).withColumn("id", F.concat_ws(">", "source", "relation", "target"))
    return B.pack_quality(nodes, edges, nodes.filter("name NOT LIKE '%A%'").select(F.col("id").alias("node_id")), tasks=tasks_for(t.lineitem)).drop("capped")


# --- derivations ---------------------------------------------------------------------------------------------------------------


def _rules_sql(text: str, rules) -> str:
    cases = []
    for r in rules:
        tests = [f"contains(lower({text}), '{x}')" for x in r.tokens] + ([f"regexp_matches(lower({text}), '{r.pattern}')"] if r.pattern else [])
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{r.label}'")
    return f"CASE {' '.join(cases)} ELSE 'unclassified' END"


for _rules, _set in (("materials", D.MATERIALS), ("elements", D.ELEMENTS), ("quantities", D.QUANTITIES)):
    query(f"classify_{_rules}", f"SELECT p_partkey, {_rules_sql('''p_type || ' ' || p_name''', _set)} AS label FROM part")(
        lambda t, rules=_set: t.part.select("p_partkey", D.classify(F.concat_ws(" ", "p_type", "p_name"), rules)["label"].alias("label"))
    )
query("decisions", f"SELECT 'part' AS source_file, CAST(p_partkey AS VARCHAR) AS source_id, {_rules_sql('p_type', D.MATERIALS)} AS label, {_rules_sql('p_type', D.MATERIALS)} = 'unclassified' AS review_required FROM part")(
    lambda t: D.decisions(t.part, "part", "p_partkey", F.col("p_type"), D.MATERIALS).select("source_file", "source_id", "label", "review_required")
)
query("schedule_rows", "SELECT conv_id, string_agg(role || ' ' || coalesce(text, ''), ' | ' ORDER BY turn) AS row_text, count(*) AS n_cells FROM conversations GROUP BY 1")(
    lambda t: D.schedule_rows(t.conversations.select("conv_id", F.lit(2).alias("row"), "turn", F.concat_ws(" ", "role", F.coalesce("text", F.lit(""))).alias("cell")), "conv_id", "row", "turn", "cell").select("conv_id", "row_text", "n_cells")
)
query("schedule_headers", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS header FROM conversations")(
    lambda t: D.carried_headers(t.conversations, "conv_id", "turn", F.col("role") == "user", big(F.length("text"))).select("conv_id", "turn", "header")
)
query("source_coverage", """
SELECT doc_id, coalesce(n, 0) AS n_derived, CASE WHEN n > 0 THEN 'mapped' WHEN lang = 'en' THEN 'classified_only' ELSE 'missing' END AS status
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) USING (doc_id)""")(
    lambda t: D.coverage(t.documents.select("doc_id", "lang"), "doc_id", t.documents.filter("lang = 'en'").select("doc_id"), "doc_id", t.labels, "doc_id")
)
query("orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: D.orphans(t.documents.select("doc_id"), "doc_id", t.labels.select("doc_id").distinct(), "doc_id"))
query("lineage_hash", "SELECT o_orderkey, substr(sha256('orders' || chr(31) || o_orderkey), 1, 16) AS record_id, sha256(o_orderstatus || '|' || o_orderpriority) AS record_hash FROM orders")(
    lambda t: D.lineage(t.orders, "orders", ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "record_id", "record_hash")
)
query("precedence", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey DESC) AS p FROM orders) WHERE p = 1")(
    lambda t: D.precedence(t.orders, "o_custkey", [F.col("o_orderpriority"), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")
)
query("latest_wins", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")(lambda t: D.latest_wins(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id"))
query("shard_rows", "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 100 AS INTEGER) AS shard FROM customer")(lambda t: G.shard(t.customer, "c_mktsegment", ["c_custkey"], 100).select("c_custkey", "shard"))
query("shard_by_size", """
WITH s AS (SELECT c_mktsegment, count(*) AS n, ceil(count(*) / 64.0) AS slices FROM customer GROUP BY 1),
b AS (SELECT c_mktsegment, coalesce(sum(slices) OVER (ORDER BY n DESC, c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT c_custkey, CAST(start + (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 64 AS INTEGER) AS shard FROM customer JOIN b USING (c_mktsegment)""")(
    lambda t: D.sharded_by_size(t.customer, "c_mktsegment", ["c_custkey"], 64).select("c_custkey", "shard")
)
query("incremental_diff", """
WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT'), b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'created' WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.o_orderstatus = b.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")(
    lambda t: ingest.diff(t.orders.filter("o_orderpriority <> '1-URGENT'"), t.orders.filter("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "2-HIGH", "X").otherwise(F.col("o_orderstatus"))), "o_orderkey", ["o_orderstatus"])
)

# --- drawings and anchors ----------------------------------------------------------------------------------------------------------


def boxes(t: Tables) -> DataFrame:
    x = lambda i: dbl(F.get("embedding", F.lit(i)))
    return t.embeddings.select("vec_id", "label", DR.box(x(0), x(1), x(2), x(3)).alias("bbox"))


_BOX = "SELECT vec_id, label, least(embedding[1], embedding[3])::DOUBLE AS x1, least(embedding[2], embedding[4])::DOUBLE AS y1, greatest(embedding[1], embedding[3])::DOUBLE AS x2, greatest(embedding[2], embedding[4])::DOUBLE AS y2 FROM embeddings"
for _mode, _test in (("within", "x1 >= -0.3 AND x2 <= 0.3 AND y1 >= -0.3 AND y2 <= 0.3"), ("contains", "x1 <= -0.02 AND x2 >= 0.02 AND y1 <= -0.02 AND y2 >= 0.02"), ("intersects", "x1 <= 0.05 AND x2 >= -0.05 AND y1 <= 0.05 AND y2 >= -0.05")):
    _r = {"within": 0.3, "contains": 0.02, "intersects": 0.05}[_mode]
    query(f"bbox_{_mode}", f"SELECT vec_id FROM ({_BOX}) WHERE {_test}")(lambda t, m=_mode, r=_r: boxes(t).filter(DR.relates(F.col("bbox"), r, -r, -r, r, m)).select("vec_id"))
query("bbox_orientation", f"SELECT vec_id, CASE WHEN x2 - x1 > (y2 - y1) * 1.5 THEN 'horizontal' WHEN y2 - y1 > (x2 - x1) * 1.5 THEN 'vertical' ELSE 'unknown' END AS direction FROM ({_BOX})")(
    lambda t: boxes(t).select("vec_id", DR.box_orientation(F.col("bbox")).alias("direction"))
)
query("dimension_text", "SELECT p_partkey, CASE WHEN p_size >= 5 THEN p_size * 10.0::DOUBLE END AS value_mm FROM part")(
    lambda t: t.part.select("p_partkey", S.dimension_mm(F.concat(F.lit("L="), (F.col("p_size") * 10).cast("string"), F.lit(" mm"))).alias("value_mm"))
)
query("area_from_dimensions", f"""
WITH d AS (SELECT label, vec_id, 50.0 + vec_id % 900 AS mm, CASE WHEN x2 - x1 > (y2 - y1) * 1.5 THEN 'h' WHEN y2 - y1 > (x2 - x1) * 1.5 THEN 'v' END AS dir FROM ({_BOX}))
SELECT label, round(max(mm) FILTER (WHERE dir = 'h') * max(mm) FILTER (WHERE dir = 'v') / 1000000::DOUBLE, 4)::DOUBLE AS area_m2 FROM d GROUP BY 1""")(
    lambda t: DR.area_from_dimensions(DR.dimensions(boxes(t).withColumn("text", F.concat(F.lit("dim "), (50 + F.col("vec_id") % 900).cast("string")))), ["label"]).select("label", "area_m2")
)
query("room_tags", "SELECT p_partkey, p_name AS label, p_size + 0.5::DOUBLE AS area, 'm2' AS unit FROM part")(
    lambda t: DR.room_areas(t.part.select("p_partkey", F.concat(F.col("p_name"), F.lit(" : "), (F.col("p_size") + F.lit(0.5).cast("double")).cast("string"), F.lit(" m2")).alias("text"))).select("p_partkey", "label", "area", "unit")
)
query("entity_summary", "SELECT 'entity_type' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'layer', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'source_file', 'a.dxf', count(*) FROM orders UNION ALL SELECT 'sheet_no', CAST(o_custkey % 5 AS VARCHAR), count(*) FROM orders GROUP BY ALL")(
    lambda t: DR.summaries(t.orders.select(F.col("o_orderstatus").alias("entity_type"), F.col("o_orderpriority").alias("layer"), F.lit("a.dxf").alias("source_file"), (F.col("o_custkey") % 5).cast("string").alias("sheet_no")))
)
query("layer_summary", "SELECT layer, CAST(sum(n) AS BIGINT) AS n, string_agg(entity_type || '=' || n, ';' ORDER BY entity_type) AS by_type FROM (SELECT o_orderpriority AS layer, o_orderstatus AS entity_type, count(*) AS n FROM orders GROUP BY ALL) GROUP BY layer")(
    lambda t: DR.layer_summary(t.orders.select(F.col("o_orderpriority").alias("layer"), F.col("o_orderstatus").alias("entity_type"))).select("layer", "n", F.array_join(F.transform(F.array_sort(F.map_entries("by_type")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias("by_type"))
)
query("anchor_coverage", """
WITH s AS (SELECT lang, CASE WHEN l.doc_id IS NOT NULL AND n_chars > 500 THEN 'exact' WHEN l.doc_id IS NOT NULL OR n_chars > 500 THEN 'partial' ELSE 'unresolvable' END AS st FROM documents LEFT JOIN labels l USING (doc_id)),
c AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE st = 'exact') AS exact, count(*) FILTER (WHERE st = 'partial') AS partial FROM s GROUP BY 1)
SELECT lang, total, exact, partial, round((exact + partial) / total, 4) AS resolvable_rate, CASE WHEN round((exact + partial) / total, 4) >= 0.8 THEN 'pass' WHEN exact + partial > 0 THEN 'warn' ELSE 'fail' END AS gate FROM c""")(
    lambda t: _anchored(t)
)


def _anchored(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id", F.col("doc_id").alias("element_id")), "doc_id", "left")
    rows = rows.withColumn("unique_id", F.when(F.col("n_chars") > 500, F.concat(F.lit("u"), F.col("doc_id").cast("string"))))
    return AN.coverage(rows.withColumn("a", AN.anchors(rows)), ["lang"], AN.status(F.col("a"))).select("lang", "total", "exact", "partial", "resolvable_rate", "gate")


# --- scalar functions ---------------------------------------------------------------------------------------------------------------

query("scalar_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")(lambda t: t.part.select("p_partkey", S.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug")))
query("scalar_module_parts", "SELECT p_partkey, p_size AS floor, lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') AS module_code, replace(p_type, ' ', '-') AS type_code FROM part")(
    lambda t: t.part.select("p_partkey", S.module_parts(F.concat_ws("-", F.col("p_size").cast("string"), F.lpad((F.col("p_partkey") % 90).cast("string"), 2, "0"), F.replace("p_type", F.lit(" "), F.lit("-")))).alias("m")).select("p_partkey", "m.*")
)
query("scalar_lenient_number", "SELECT p_partkey, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS v FROM part")(lambda t: t.part.select("p_partkey", S.lenient_number(F.col("p_brand")).alias("v")))
query("scalar_family_type", "SELECT p_partkey, p_brand AS family, p_type AS type FROM part")(lambda t: t.part.select("p_partkey", S.family_type(F.concat_ws(" : ", "p_brand", "p_type")).alias("f")).select("p_partkey", "f.*"))
query("scalar_area_units", "SELECT p_partkey, round(p_size * 0.09290304::DOUBLE, 6) AS m2 FROM part")(lambda t: t.part.select("p_partkey", F.round(S.square_metres(F.lit(None).cast("double"), F.col("p_size")), 6).alias("m2")))
query("scalar_url_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")(lambda t: t.pages.select("page_id", S.url_host(F.col("url")).alias("host")))
query("markdown_pairs", "SELECT n_nationkey, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation")(
    lambda t: t.nation.select("n_nationkey", F.explode(S.markdown_pairs(F.concat(F.lit("# Nation\n- name: "), F.col("n_name"), F.lit("\n* region: "), F.col("n_regionkey").cast("string"), F.lit("\nend")))).alias("p")).select("n_nationkey", "p.*")
)


@query("resolve_first_existing", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), event_type) AS v FROM events")
def _first_existing(t: Tables) -> DataFrame:
    rows = t.events.withColumn("properties", F.parse_json("props"))
    r = Resolver(rows, "properties", {"v": ["properties.absent", "properties.k", "event_type"]})
    return rows.select("event_id", r("v").value.alias("v"))


# --- steel hierarchy ---------------------------------------------------------------------------------------------------------------


def steel_parts(t: Tables) -> DataFrame:
    """Line items as parts of orders (assemblies) of customers (modules) of segments (module types)."""
    rows = parts_with_owners(t)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("c_mktsegment").alias("module_type"), F.col("c_custkey").alias("module_id"), F.col("o_orderkey").alias("assembly_id"), (F.col("l_linenumber") == 1).alias("is_main"),
        F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("category"), F.col("l_suppkey").alias("material_id"), F.col("l_partkey").alias("section_id"), F.col("l_quantity").alias("length_m"), F.col("l_extendedprice").alias("weight_kg"),
        F.col("l_tax").alias("x"), F.col("l_discount").alias("y"), F.col("l_quantity").alias("z"),
    )


def steel_enriched(t: Tables) -> DataFrame:
    return ST.enriched_parts(steel_parts(t), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), tasks_for(t.lineitem))


_W = "CAST(l_extendedprice AS DECIMAL(28,6))"
query("steel_assemblies", f"""
SELECT c_mktsegment AS module_type, c_custkey AS module_id, o_orderkey AS assembly_id, count(*) AS n, CAST(sum({_W}) AS DOUBLE) AS weight_kg,
  CAST(sum(CASE WHEN l_linenumber = 1 THEN {_W} ELSE 0 END) AS DOUBLE) AS main_kg, CAST(sum(CASE WHEN l_linenumber <> 1 THEN {_W} ELSE 0 END) AS DOUBLE) AS attached_kg,
  count(DISTINCT CASE WHEN l_linenumber <> 1 THEN l_returnflag || '|' || l_suppkey || '|' || p_brand END) AS n_attached
FROM {_OWNED} JOIN part ON l_partkey = p_partkey GROUP BY ALL""")(
    lambda t: ST.assemblies(steel_enriched(t), tasks_for(t.lineitem)).select("module_type", "module_id", "assembly_id", "n", dbl(F.col("weight_kg")).alias("weight_kg"), dbl(F.col("main_kg")).alias("main_kg"), dbl(F.col("attached_kg")).alias("attached_kg"), big(F.coalesce(F.size(F.coalesce("attached", F.array())), F.lit(0))).alias("n_attached"))
)
query("steel_modules", f"SELECT c_mktsegment AS module_type, c_custkey AS module_id, count(*) AS n, CAST(sum({_W}) AS DOUBLE) AS weight_kg, count(DISTINCT o_orderkey) AS assemblies FROM {_OWNED} GROUP BY ALL")(
    lambda t: ST.modules(ST.assemblies(steel_enriched(t), tasks_for(t.lineitem))).select("module_type", "module_id", "n", dbl(F.col("weight_kg")).alias("weight_kg"), "assemblies")
)
query("steel_module_types", f"SELECT c_mktsegment AS module_type, count(*) AS n, CAST(sum({_W}) AS DOUBLE) AS weight_kg, count(DISTINCT c_custkey) AS modules FROM {_OWNED} GROUP BY 1")(
    lambda t: ST.module_types(ST.modules(ST.assemblies(steel_enriched(t), tasks_for(t.lineitem)))).select("module_type", "n", dbl(F.col("weight_kg")).alias("weight_kg"), "modules")
)
query("steel_breakdown", f"SELECT c_mktsegment AS module_type, CASE WHEN p_brand LIKE 'Q%' OR p_brand LIKE 'RHS%' OR p_brand LIKE 'SQ%' THEN 'Tube' ELSE '(blank)' END AS value, count(*) AS n, CAST(sum({_W}) AS DOUBLE) AS weight_kg FROM {_OWNED} JOIN part ON l_partkey = p_partkey GROUP BY ALL")(
    lambda t: ST.breakdown(steel_enriched(t), ["module_type"], "profile_group").select("module_type", "value", "n", dbl(F.col("weight_kg")).alias("weight_kg"))
)
query("steel_usage", f"SELECT p_brand AS section_name, count(*) AS n, CAST(sum({_W}) AS DOUBLE) AS weight_kg, count(DISTINCT c_custkey) AS modules FROM {_OWNED} JOIN part ON l_partkey = p_partkey GROUP BY 1")(
    lambda t: ST.usage(steel_enriched(t), "section_name").select("section_name", "n", dbl(F.col("weight_kg")).alias("weight_kg"), "modules")
)
query("steel_fasteners", "SELECT CASE WHEN p_size % 2 = 0 THEN 'anchor' ELSE 'bolt' END AS kind, 'M' || (p_size + 5) || 'x' || (p_size * 3) AS spec, count(*) AS patterns, CAST(sum(CASE WHEN p_size % 2 = 0 THEN 4 ELSE p_size * 2 END) AS BIGINT) AS pieces, count(*) FILTER (WHERE p_size * 2 <> 4) AS mismatches FROM part GROUP BY ALL")(
    lambda t: ST.fasteners(t.part.select(F.when(F.col("p_size") % 2 == 0, "anchor").otherwise("bolt").alias("kind"), F.col("p_size").alias("nx"), F.lit(2).alias("ny"), F.lit(4).alias("n_locations"), F.lit(None).cast("string").alias("description"), F.lit("8.8").alias("grade"), F.lit("s").alias("standard"), ((F.col("p_size") + 5) / 1000.0).alias("diameter_m"), (F.col("p_size") * 3 / 1000.0).alias("length_m")))
    .select("kind", "spec", "patterns", "pieces", "mismatches")
)
query("steel_totals", f"SELECT count(*) AS n, CAST(sum({_W}) AS DOUBLE) AS weight_kg, count(DISTINCT c_custkey) AS modules, min(l_tax) AS min_x, max(l_quantity) AS max_z, count(*) FILTER (WHERE l_suppkey IS NULL) AS no_material_id FROM {_OWNED}")(
    lambda t: ST.model_totals(steel_enriched(t)).select("n", dbl(F.col("weight_kg")).alias("weight_kg"), "modules", "min_x", "max_z", "no_material_id")
)
query("steel_edges", f"SELECT relation, count(*) AS n FROM (SELECT DISTINCT 'has_module' AS relation, c_mktsegment || '>' || c_custkey AS k FROM {_OWNED} UNION SELECT 'has_assembly', c_custkey || '>' || o_orderkey FROM {_OWNED} UNION SELECT 'has_single_part', o_orderkey || '>' || l_linenumber FROM {_OWNED} UNION SELECT 'uses_material', l_orderkey || '-' || l_linenumber || '>' || l_suppkey FROM lineitem UNION SELECT 'uses_section', l_orderkey || '-' || l_linenumber || '>' || l_partkey FROM lineitem) GROUP BY 1")(
    lambda t: ST.hierarchy_edges(steel_parts(t), tasks_for(t.lineitem, 5)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
