"""Canonical relations bound to the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-31 00:00:00"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of lineitem in a task of changes.
TASK_ROWS = 1 << 18


def changes(spark, sf_dir) -> DataFrame:
    """commit = order, member = brand; dealt by commit, which all further steps by commit keep to, into as
    many parts as the table asks for (parts sized by shuffled bytes grow with the input up to what a task holds)."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    parts = max(spark.sparkContext.defaultParallelism, li.count() // TASK_ROWS + 1)
    named = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "p_brand").repartition(parts, "l_orderkey").distinct()
    dated = o.repartition(parts, "o_orderkey")
    return named.join(dated.hint("merge"), named.l_orderkey == dated.o_orderkey).select(F.col("l_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts"), F.col("p_brand").alias("member")).distinct()


CHANGES = "changes AS (SELECT DISTINCT l_orderkey AS commit_id, o_orderdate AS ts, p_brand AS member FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def accesses(spark, sf_dir) -> DataFrame:
    """class = nation, method = supplier, field = order."""
    li = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey")
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = li.join(s, li.l_suppkey == s.s_suppkey)
    return joined.select(F.col("s_nationkey").alias("class_id"), F.col("l_suppkey").alias("method"), F.concat(F.lit("o"), "l_orderkey").alias("field")).distinct()


ACCESSES = "accesses AS (SELECT DISTINCT s_nationkey AS class_id, l_suppkey AS method, 'o' || l_orderkey AS field FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def methods(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("class_id"), F.col("s_suppkey").alias("method"))


METHODS = "methods AS (SELECT s_nationkey AS class_id, s_suppkey AS method FROM supplier)"


def flows(spark, sf_dir) -> DataFrame:
    """Directed dependencies: customer nation -> supplier nation, weight = lineitem rows / 100."""
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg((F.count(F.lit(1)) / 100).alias("weight"))


FLOWS = "flows AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) / 100.0 AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
EDGES = f"{FLOWS}, edges AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight FROM flows WHERE src <> dst GROUP BY 1, 2)"


def partition(spark, sf_dir) -> DataFrame:
    """A given partition of nations: their regions."""
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("cluster_id"))


PARTITION = "part_of AS (SELECT n_nationkey AS node, n_regionkey AS cluster_id FROM nation)"


def ratings(spark, sf_dir) -> DataFrame:
    """Oracle labels: quality is the truth, long text the prediction."""
    d, lab = t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), t(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(F.col("lang").alias("project"), F.col("source").alias("instance"), F.col("quality").alias("truth"), (F.col("n_chars") > 1000).cast("int").alias("predicted"))


RATINGS = "ratings AS (SELECT lang AS project, source AS instance, quality AS truth, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id))"


def graphs(spark, sf_dir) -> DataFrame:
    """Many graphs: one for each hundred customers; nations of suppliers that ship for one order, weight = such orders."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey div 100").alias("graph_id"))
    s = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("node"))
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    x = li.join(s, li.l_suppkey == s.s_suppkey).join(o, li.l_orderkey == o.o_orderkey).select("graph_id", "o_orderkey", "node").distinct()
    a, b = x.withColumnRenamed("node", "src"), x.withColumnRenamed("node", "dst")
    return a.join(b, ["graph_id", "o_orderkey"]).filter("src < dst").groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


GRAPHS = """shipped AS (SELECT DISTINCT o_custkey // 100 AS graph_id, o_orderkey, s_nationkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
graphs AS (SELECT a.graph_id, a.node AS src, b.node AS dst, count(*) AS weight FROM shipped a JOIN shipped b ON a.o_orderkey = b.o_orderkey AND a.node < b.node GROUP BY 1, 2, 3)"""
