"""Queries on community detection over many graphs and on extracting what it finds, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import clusters as C
from weftline.operators import extraction as E
from weftline.operators.lineage import cut
from weftline.plans import bindings as B
from weftline.plans.registry import query, r6

_REGIONS = "regions AS (SELECT graph_id, node, n_regionkey AS community FROM (SELECT graph_id, src AS node FROM graphs UNION SELECT graph_id, dst FROM graphs) JOIN nation ON n_nationkey = node)"


def _ends(edges):
    return edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()


@query()
def g02_leiden(spark, d):
    return r6(C.leiden(B.graphs(spark, d)), "quality")


@query(f"WITH {B.GRAPHS} SELECT graph_id, count(DISTINCT node) AS nodes, 0 AS disconnected, true AS at_least_louvain, true AS quality_agrees FROM (SELECT graph_id, src AS node FROM graphs UNION SELECT graph_id, dst FROM graphs) GROUP BY 1")
def g02_leiden_checks(spark, d):
    """What holds of every graph: all nodes placed, no community in parts, no worse than Louvain, quality as the edges have it."""
    edges = cut(B.graphs(spark, d))
    found = cut(C.leiden(edges))  # all checks are of one partition
    n = found.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"), F.first("quality").alias("quality"))
    parts = C.apart(edges, found).groupBy("graph_id").agg(F.count_if(F.col("parts") > 1).alias("disconnected"))
    own = C.graph_quality(edges, found).select("graph_id", F.col("raw_quality").alias("q"))
    other = C.graph_quality(edges, C.louvain(edges)).select("graph_id", F.col("raw_quality").alias("o"))
    x = n.join(parts, "graph_id").join(own, "graph_id").join(other, "graph_id")
    return x.select("graph_id", "nodes", "disconnected", (F.col("q") >= F.col("o") - 1e-9).alias("at_least_louvain"), (F.abs(F.col("q") - F.col("quality")) < 1e-6).alias("quality_agrees"))


@query(
    f"""WITH {B.GRAPHS}, {_REGIONS}, x AS (SELECT g.graph_id, a.community AS c1, b.community AS c2, weight FROM graphs g JOIN regions a ON a.graph_id = g.graph_id AND a.node = src JOIN regions b ON b.graph_id = g.graph_id AND b.node = dst),
    k AS (SELECT graph_id, c, sum(weight) AS k FROM (SELECT graph_id, c1 AS c, weight FROM x UNION ALL SELECT graph_id, c2, weight FROM x) GROUP BY 1, 2),
    m AS (SELECT graph_id, sum(k) AS m2, sum(k * k) AS kk FROM k GROUP BY 1), i AS (SELECT graph_id, sum(CASE WHEN c1 = c2 THEN 2 * weight ELSE 0 END) AS i FROM x GROUP BY 1)
    SELECT graph_id, round(i - kk / m2, 6) AS raw_quality, round((i - kk / m2) / m2, 6) AS modularity FROM m JOIN i USING (graph_id)"""
)
def g03_graph_quality(spark, d):
    edges = B.graphs(spark, d)
    nation = B.t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("community"))
    return r6(C.graph_quality(edges, _ends(edges).join(nation, "node")), "raw_quality", "modularity")


_MEMBERS = "members AS (SELECT c_custkey // 100 AS graph_id, c_custkey AS node, c_mktsegment || 'Get' || n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _members(spark, d):
    c, n = B.t(spark, d, "customer"), B.t(spark, d, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.expr("c_custkey div 100").alias("graph_id"), F.col("c_custkey").alias("node"), F.concat("c_mktsegment", F.lit("Get"), "n_name").alias("name"))


@query(
    f"""WITH {_MEMBERS}, g AS (SELECT *, CASE WHEN regexp_extract(name, '^({C.VERBS})[A-Z]', 1) <> '' THEN regexp_extract(name, '^({C.VERBS})[A-Z]', 1) WHEN regexp_extract(name, '[A-Z][a-z]*') <> '' THEN lower(regexp_extract(name, '[A-Z][a-z]*')) ELSE 'other' END AS g,
    count(*) OVER (PARTITION BY graph_id) AS n FROM members WHERE graph_id % 3 > 0 OR node % 100 < 20), k AS (SELECT *, count(*) OVER (PARTITION BY graph_id, g) AS m FROM g)
    SELECT graph_id, node, CASE WHEN n > 30 THEN min(node) OVER (PARTITION BY graph_id, g) ELSE min(node) OVER (PARTITION BY graph_id) END AS community, CASE WHEN n > 30 THEN 'names' ELSE 'single' END AS source FROM k WHERE n <= 30 OR m >= 3"""
)
def g14_fallback(spark, d):
    """Graphs without edges; every third one is small."""
    return C.fallback(_members(spark, d).filter("graph_id % 3 > 0 or node % 100 < 20"))


@query(
    f"""WITH {B.GRAPHS}, linked AS (SELECT DISTINCT graph_id FROM graphs), every AS (SELECT graph_id, n_nationkey AS node FROM (SELECT DISTINCT o_custkey // 100 AS graph_id FROM orders UNION SELECT DISTINCT c_custkey // 100 FROM customer), nation)
    SELECT graph_id, count(*) AS nodes, CASE WHEN graph_id IN (SELECT graph_id FROM linked) THEN 'communities' ELSE 'single' END AS source FROM every GROUP BY 1"""
)
def g04_detect(spark, d):
    """Every graph's nodes are placed, those without edges by the fallback."""
    n = B.t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("name"))
    ids = B.t(spark, d, "orders").select(F.expr("o_custkey div 100").alias("graph_id")).union(B.t(spark, d, "customer").select(F.expr("c_custkey div 100"))).distinct()
    nodes = ids.join(F.broadcast(n))  # 25 nations
    return C.detect(nodes, B.graphs(spark, d)).groupBy("graph_id", "source").agg(F.count(F.lit(1)).alias("nodes"))


# --- extraction ---

# a class is forty customers; names repeat within it, every third is private, some are abstract
METHODS = "methods AS (SELECT c_custkey // 40 AS class_id, c_custkey AS method, 'n' || c_custkey % 31 AS name, c_custkey AS ord, c_custkey % 3 = 0 AS is_private, c_custkey % 40 = 7 AS is_abstract FROM customer)"
CALLS = "calls AS (SELECT DISTINCT o_custkey // 40 AS class_id, o_custkey AS method, 'n' || o_orderkey % 31 AS name FROM orders)"
CLUSTERS = "clusters AS (SELECT c_custkey // 40 AS class_id, c_custkey % 8 AS cluster_id, c_custkey AS method FROM customer WHERE c_acctbal > 0)"
REACH = f"""{METHODS}, {CALLS}, {CLUSTERS},
    hidden AS (SELECT class_id, name, min(method) AS helper, max(method) AS last FROM methods WHERE is_private GROUP BY 1, 2),
    edges AS (SELECT DISTINCT class_id, method, helper, last FROM calls JOIN hidden USING (class_id, name)),
    reach AS (SELECT class_id, cluster_id, method, 0 AS level FROM clusters
      UNION SELECT r.class_id, r.cluster_id, helper, level + 1 FROM reach r JOIN edges e ON e.class_id = r.class_id AND e.method = r.method WHERE level < 10 AND NOT EXISTS (SELECT 1 FROM clusters c WHERE c.class_id = r.class_id AND c.cluster_id = r.cluster_id AND c.method = e.last)),
    members AS (SELECT class_id, cluster_id, method, min(level) AS level FROM reach GROUP BY 1, 2, 3)"""
ISSUES = f"""{REACH}, settled AS (SELECT class_id, cluster_id FROM members GROUP BY 1, 2 HAVING max(level) < 10),
    refs AS (SELECT DISTINCT o_custkey // 40 AS class_id, o_custkey AS method, o_orderpriority AS name FROM orders WHERE o_orderstatus = 'F'),
    issues AS (SELECT m.class_id, m.cluster_id, 'error' AS severity, 'abstract_method_call' AS issue_type, m.method, c.name FROM members m JOIN settled USING (class_id, cluster_id) JOIN calls c ON c.class_id = m.class_id AND c.method = m.method
        WHERE EXISTS (SELECT 1 FROM methods a WHERE a.class_id = c.class_id AND a.name = c.name AND a.is_abstract)
      UNION ALL SELECT m.class_id, m.cluster_id, 'warning', 'inner_class_reference', m.method, r.name FROM members m JOIN settled USING (class_id, cluster_id) JOIN refs r ON r.class_id = m.class_id AND r.method = m.method)"""


def _extraction(spark, d):
    c, o = B.t(spark, d, "customer"), B.t(spark, d, "orders")
    methods = c.select(F.expr("c_custkey div 40").alias("class_id"), F.col("c_custkey").alias("method"), F.expr("concat('n', c_custkey % 31)").alias("name"), F.col("c_custkey").alias("ord"), F.expr("c_custkey % 3 = 0").alias("is_private"), F.expr("c_custkey % 40 = 7").alias("is_abstract"))
    calls = o.select(F.expr("o_custkey div 40").alias("class_id"), F.col("o_custkey").alias("method"), F.expr("concat('n', o_orderkey % 31)").alias("name"))
    clusters = c.filter("c_acctbal > 0").select(F.expr("c_custkey div 40").alias("class_id"), F.expr("c_custkey % 8").alias("cluster_id"), F.col("c_custkey").alias("method"))
    refs = o.filter("o_orderstatus = 'F'").select(F.expr("o_custkey div 40").alias("class_id"), F.col("o_custkey").alias("method"), F.col("o_orderpriority").alias("name"))
    return methods, calls, E.with_helpers(clusters, methods, calls), refs


@query(f"WITH RECURSIVE {REACH} SELECT class_id, cluster_id, method, level FROM members")
def g13_with_helpers(spark, d):
    return _extraction(spark, d)[2]


@query(f"WITH RECURSIVE {ISSUES} SELECT * FROM issues")
def g13b_issues(spark, d):
    methods, calls, members, refs = _extraction(spark, d)
    return E.issues(members, methods, calls, refs)


_VERDICTS = f"""{ISSUES}, verdicts AS (SELECT m.class_id, m.cluster_id, members, added, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid
    FROM (SELECT class_id, cluster_id, count(*) AS members, count_if(level > 0) AS added FROM members GROUP BY 1, 2) m
    LEFT JOIN (SELECT class_id, cluster_id, count_if(severity = 'error') AS errors, count_if(severity = 'warning') AS warnings FROM issues GROUP BY 1, 2) e USING (class_id, cluster_id))"""


@query(f"WITH RECURSIVE {_VERDICTS} SELECT * FROM verdicts")
def g13_verdicts(spark, d):
    methods, calls, members, refs = _extraction(spark, d)
    return E.verdicts(members, E.issues(members, methods, calls, refs))


@query(
    f"""WITH RECURSIVE {_VERDICTS}, n AS (SELECT class_id, count(*) AS class_methods FROM methods GROUP BY 1), x AS (SELECT *, members % 7 / 7.0 AS cohesion, members % 3 AS modularity, added / 10.0 AS quality, CASE WHEN cluster_id = 5 THEN 0 WHEN cluster_id = 6 THEN 35 ELSE members END AS methods FROM verdicts JOIN n USING (class_id))
    SELECT class_id, cluster_id, CASE WHEN members < 3 THEN 'too small' WHEN members > 30 THEN 'too large' WHEN methods >= 0.8 * class_methods THEN 'whole class' WHEN modularity > 0 AND cohesion < 0.35 THEN 'low cohesion'
    WHEN quality < 0.1 THEN 'low quality' WHEN methods = 0 THEN 'no methods' WHEN NOT valid THEN 'not extractable' END AS reason FROM x"""
)
def g12_rejection(spark, d):
    methods, calls, members, refs = _extraction(spark, d)
    v = E.verdicts(members, E.issues(members, methods, calls, refs)).join(methods.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_methods")), "class_id")
    own = F.when(F.col("cluster_id") == 5, 0).when(F.col("cluster_id") == 6, 35).otherwise(F.col("members"))
    c = F.col
    return v.select("class_id", "cluster_id", E.rejection(c("members"), own, c("class_methods"), c("members") % 7 / 7, c("members") % 3, c("added") / 10, c("valid"), min_quality=0.1).alias("reason"))
