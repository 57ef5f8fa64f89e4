"""What one task groups stays as large as it is, however large the table."""

import re

from pyspark.sql import functions as F

from packgraph.operators import bim as B
from packgraph.operators import graph as G
from packgraph.operators import steel as ST
from packgraph.operators.dealing import LEAST_ROWS, TASK_ROWS, tasks_for


def parts(spark, n=3000):
    return spark.range(n).selectExpr(
        "cast(id AS string) AS id", "concat('T', id div 5 % 3) AS module_type", "id div 5 % 3 AS module_id", "id div 5 AS assembly_id", "id % 5 = 0 AS is_main", "concat('r', id % 2) AS role", "'c' AS category",
        "id % 7 AS material_id", "id % 11 AS section_id", "1.5D AS length_m", "if(id % 9 = 0, null, id * 0.25D) AS weight_kg", "0D AS x", "0D AS y", "0D AS z",
    )


def first_grouping_is_dealt(df, tasks):
    """No grouping comes before rows are dealt out, that is none makes a map of what a task happens to read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex(f", {tasks})") if f", {tasks})" in plan else 0 :]
    return f", {tasks})" in plan and not re.search(r"(Hash|Sort)Aggregate", below)


def test_tasks_follow_the_rows(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "few"))
    spark.range(3 * LEAST_ROWS).write.parquet(str(tmp_path / "some"))
    few, some = (spark.read.parquet(str(tmp_path / n)) for n in ("few", "some"))
    assert tasks_for(few) == 1 and tasks_for(some) == 3
    assert tasks_for(some, 800) == 800 * 3 * LEAST_ROWS // TASK_ROWS


def test_assemblies_and_edges_of_steel_are_dealt_and_the_same(spark):
    rows = parts(spark)
    named = ST.enriched_parts(rows, spark.range(7).selectExpr("id", "concat('m', id % 2) AS name"), spark.range(9).selectExpr("id", "concat('s', id) AS name"), 37)
    got = ST.assemblies(named, 37)
    assert first_grouping_is_dealt(got, 37) and first_grouping_is_dealt(ST.hierarchy_edges(rows, 37), 37)
    assert sorted(map(str, got.collect())) == sorted(map(str, ST.assemblies(named).collect()))
    one = got.filter("assembly_id = 0").first()
    assert (one["n"], float(one["main_kg"]), float(one["attached_kg"]), len(one["attached"])) == (5, 0.0, 2.5, 4)
    alone = ST.assemblies(rows.filter("is_main").selectExpr("*", "role AS material_name", "role AS section_name"), 37).filter("attached IS NOT NULL")
    assert alone.isEmpty()
    assert sorted(ST.hierarchy_edges(rows, 37).collect()) == sorted(ST.hierarchy_edges(rows).collect())


def test_keyed_edges_and_broken_edges_are_dealt(spark):
    pairs = spark.range(2000).selectExpr("id div 2 % 300 AS a", "id % 5 AS b")
    edges = G.keyed_edges(pairs, ("x", "a"), ("y", "b"), "r", tasks=37)
    assert first_grouping_is_dealt(edges, 37) and sorted(edges.collect()) == sorted(G.keyed_edges(pairs, ("x", "a"), ("y", "b"), "r").collect())
    nodes = spark.range(5).select(F.concat(F.lit("y:"), F.col("id").cast("string")).alias("id"))
    row = B.pack_quality(nodes, edges.withColumn("id", F.concat_ws(">", "source", "target")), nodes.selectExpr("id AS node_id").limit(2), tasks=37).first()
    assert (row["edges"], row["broken_edges"], row["nodes_without_evidence"]) == (edges.count(), edges.count(), 3)
    empty = B.pack_quality(nodes, edges.withColumn("id", F.lit("x")).limit(0), nodes.selectExpr("id AS node_id"), tasks=2).first()
    assert (empty["edges"], empty["broken_edges"], empty["largest_relation"]) == (0, 0, 0)


def test_a_placeholder_gives_its_degree_to_the_node(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("a", "r", "b"), ("b", "r", "c")], "source string, relation string, target string")
    nodes = spark.createDataFrame([("a", "A", "t"), ("z", "Z", "t")], "id string, label string, type string")
    got = {r["id"]: (r["label"], r["placeholder"], r["degree"], r["size"]) for r in G.merge_local([(nodes, edges)], 3)[0].collect()}
    assert got == {"a": ("A", False, 1, 5), "z": ("Z", False, 0, 4), "b": ("b", True, 2, 6), "c": ("c", True, 1, 5)}
