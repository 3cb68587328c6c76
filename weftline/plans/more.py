"""Queries on class bundles, histories, answers and comparisons, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import evaluate as K
from weftline.operators import evolution as V
from weftline.operators import gates as J
from weftline.operators import graph as G
from weftline.operators import structure as D
from weftline.operators import suggest as I
from weftline.plans import bindings as B
from weftline.plans.registry import _SEDGES, _SQL, WEIGHTED, _nodes, _rows, _strong, query, r6

_BOTH = f"SELECT class_id, lcom5, tcc FROM ({_SQL['d03_lcom5']}) JOIN ({_SQL['d04_tcc']}) USING (class_id)"


@query(f"WITH {B.FLOWS}, p AS (SELECT dst AS src, src AS dst FROM flows) SELECT p.src, p.dst, coalesce(f.weight, 0) AS weight FROM p LEFT JOIN flows f ON f.src = p.src AND f.dst = p.dst")
def d02_strengths(spark, d):
    f = B.flows(spark, d)
    return D.strengths(f.select(F.col("dst").alias("src"), F.col("src").alias("dst")), f)


@query(_BOTH)
def d05_cohesion(spark, d):
    return r6(D.cohesion(B.methods(spark, d), B.accesses(spark, d)), "lcom5", "tcc")


@query(
    f"""WITH both_ AS ({_BOTH}), {B.ACCESSES}, {B.METHODS}, {B.FLOWS}, ce AS (SELECT src AS class_id, count(*) AS ce FROM flows WHERE src <> dst GROUP BY 1),
    ca AS (SELECT dst AS class_id, count(*) AS ca FROM flows WHERE src <> dst GROUP BY 1), m AS (SELECT class_id, count(DISTINCT method) AS num_methods FROM methods GROUP BY 1),
    f AS (SELECT class_id, count(DISTINCT field) AS num_fields FROM accesses GROUP BY 1)
    SELECT class_id, lcom5, tcc, num_methods, coalesce(num_fields, 0) AS num_fields, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca,
    round(CASE WHEN coalesce(ce, 0) + coalesce(ca, 0) = 0 THEN 0 ELSE coalesce(ce, 0) / (coalesce(ce, 0) + coalesce(ca, 0)) END, 6) AS instability
    FROM both_ JOIN m USING (class_id) LEFT JOIN f USING (class_id) LEFT JOIN ce USING (class_id) LEFT JOIN ca USING (class_id)"""
)
def d09_class_metrics(spark, d):
    f = B.flows(spark, d).filter("src <> dst")
    ce = f.groupBy(F.col("src").alias("class_id")).agg(F.count(F.lit(1)).alias("ce"))
    ca = f.groupBy(F.col("dst").alias("class_id")).agg(F.count(F.lit(1)).alias("ca"))
    return r6(D.class_metrics(B.methods(spark, d), B.accesses(spark, d), ce, ca), "lcom5", "tcc", "instability")


@query(
    f"""WITH {WEIGHTED}, names AS (SELECT DISTINCT p_brand AS name, p_brand || '(' || p_type || ')' AS signature FROM part), nodes AS (SELECT DISTINCT p_brand || '(' || p_type || ')' AS signature FROM part WHERE p_size > 25),
    known AS (SELECT name, signature FROM names JOIN nodes USING (signature))
    SELECT least(a.signature, b.signature) AS src, greatest(a.signature, b.signature) AS dst, round(max(coupling), 6) AS weight FROM coupled JOIN known a ON a.name = m1 JOIN known b ON b.name = m2 WHERE a.signature <> b.signature GROUP BY 1, 2"""
)
def f02_evolutionary_graph(spark, d):
    rows = _rows(spark, d)
    coupled = V.coupling(V.cochange(rows), V.member_commits(rows), 0.0)
    part = B.t(spark, d, "part").select("p_size", F.col("p_brand").alias("name"), F.concat("p_brand", F.lit("("), "p_type", F.lit(")")).alias("signature"))
    nodes = part.filter("p_size > 25").select(F.col("signature").alias("node")).distinct()
    return r6(G.evolutionary(coupled, part.select("name", "signature").distinct(), nodes), "weight")


@query("WITH c AS (SELECT o_custkey AS graph_id, count(*) AS commits, count(DISTINCT o_orderpriority) - 1 AS edges, count(*) % 3 * 0.48 AS alpha FROM orders GROUP BY 1) SELECT graph_id, round(CASE WHEN commits < 5 AND edges > 0 THEN greatest(alpha, 0.95) ELSE alpha END, 6) AS alpha FROM c")
def f05_history_alpha(spark, d):
    o = B.t(spark, d, "orders").groupBy(F.col("o_custkey").alias("graph_id")).agg(F.count(F.lit(1)).alias("commits"), (F.countDistinct("o_orderpriority") - 1).alias("edges"))
    return r6(o.select("graph_id", G.history_alpha(F.col("commits") % 3 * 0.48, F.col("commits"), F.col("edges")).alias("alpha")), "alpha")


@query()
def f08_eigenvector(spark, d):
    return r6(G.eigenvector(B.graphs(spark, d)), "score")


@query(f"WITH {_SEDGES}, s AS (SELECT node, count(*) / 24.0 AS score FROM sends GROUP BY 1) SELECT n_nationkey AS node, round(coalesce(score, 0), 6) AS degree FROM nation LEFT JOIN s ON node = n_nationkey")
def f11_node_centrality(spark, d):
    scores = G.degree_centrality(_nodes(spark, d), _strong(spark, d)).filter("score > 0")
    return r6(G.with_centrality(_nodes(spark, d), scores, "degree"), "degree")


_BASKETS = "c AS (SELECT DISTINCT l_orderkey AS commit_id, p_brand AS member FROM lineitem JOIN part ON l_partkey = p_partkey), pairs AS (SELECT a.member AS m1, b.member AS m2, count(*) AS cochange FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.member < b.member GROUP BY 1, 2)"


@query(
    f"""WITH {_BASKETS}, own AS (SELECT DISTINCT length(p_brand) AS cluster_id, p_brand AS name FROM part), x AS (SELECT cluster_id, m1 || ' ' || m2 AS pair FROM pairs JOIN own a ON a.name = m1 JOIN own b USING (cluster_id) WHERE b.name = m2 AND cochange >= 2)
    SELECT cluster_id, count(*) AS n, array_to_string(list_sort(list(pair))[1:3], ';') AS examples FROM x GROUP BY 1"""
)
def b15_cluster_context(spark, d):
    li, p = B.t(spark, d, "lineitem"), B.t(spark, d, "part")
    c = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("commit_id"), F.col("p_brand").alias("member")).distinct()
    c = V.capped(c).drop("basket")
    pairs = c.withColumnRenamed("member", "m1").join(c.withColumnRenamed("member", "m2"), "commit_id").filter("m1 < m2").groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("cochange"))
    clusters = p.select(F.length("p_brand").cast("long").alias("cluster_id"), F.concat("p_brand", F.lit("(int x)")).alias("member"))
    return V.cluster_context(pairs, clusters).withColumn("examples", F.array_join("examples", ";"))


@query(
    """WITH x AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 11 = 0 THEN 'Impl' ELSE 'Part' || p_partkey END AS class_name, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS rationale,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE least(1.0, p_size / 25.0) END AS confidence FROM part)
    SELECT id, class_name, rationale, round(confidence, 6) AS confidence FROM x WHERE regexp_matches(class_name, '^[A-Z][a-zA-Z0-9_]*$') AND class_name <> 'Impl' AND rationale <> ''"""
)
def c21_suggestion(spark, d):
    size, p = F.col("p_size"), B.t(spark, d, "part")
    name = F.when(size % 3 == 0, F.col("p_brand")).when(size % 11 == 0, "Impl").otherwise(F.concat(F.lit("Part"), "p_partkey"))
    sure = F.when(size % 5 == 0, "unsure").otherwise((size / 25).cast("string"))
    answer = F.concat(F.lit("Well: <class_name> "), name, F.lit(" </class_name>\n<rationale>"), F.when(size % 7 == 0, " ").otherwise(F.col("p_name")), F.lit("</rationale><confidence>"), sure, F.lit("</confidence>"))
    found = p.select(F.col("p_partkey").alias("id"), T.suggestion(answer).alias("s")).filter("s is not null")
    return r6(found.select("id", "s.*"), "confidence")


@query("SELECT l_orderkey AS id, count(*) AS n, sum(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS members FROM lineitem GROUP BY 1")
def c22_suggestions(spark, d):
    block = F.concat(F.lit("<suggestion><methods> a"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, " , b,").otherwise(", ,"), F.lit("</methods></suggestion>"))
    answers = B.t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("Here:\n"), F.array_join(F.collect_list(block), "\nand\n")).alias("text"))
    each = answers.select("id", F.explode(T.suggestions(F.col("text"))).alias("s")).select("id", F.size(T.listed(F.col("s"), "methods")).alias("m"))
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("members"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 > 0 AND o_orderkey % 7 > 0 AND o_custkey % 10 > o_orderkey % 7 THEN o_custkey % 10 ELSE o_orderkey % 7 END AS confidence FROM orders")
def i08_refined(spark, d):
    return B.t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), I.refined(F.col("o_orderkey") % 7, F.col("o_custkey") % 10).alias("confidence"))


@query("SELECT l_orderkey AS item, bool_and(coalesce(CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_returnflag <> 'R' END, true)) AS passed FROM lineitem GROUP BY 1")
def j08_all_versions(spark, d):
    passed = F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("l_returnflag") != "R")
    return J.all_versions(B.t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), passed.alias("passed")))


@query(
    """WITH x AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'verified' WHEN 'P' THEN 'verified_after_repair' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'failed' END END AS status FROM orders)
    SELECT id, status, 'verified' AS list FROM x WHERE status LIKE 'verified%' UNION ALL SELECT id, status, 'rejected' FROM x WHERE status <> 'verified'"""
)
def j14_status_lists(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "verified").when(F.col("o_orderstatus") == "P", "verified_after_repair").when(F.col("o_custkey") % 2 == 0, "failed")
    return J.status_lists(B.t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status")))


@query(
    """WITH truth AS (SELECT p_brand AS instance, p_partkey AS id, p_name AS name FROM part), s AS (SELECT DISTINCT p_brand AS instance, p_name AS name FROM part WHERE p_size < 3 AND p_type = 'ECONOMY'),
    c AS (SELECT DISTINCT p_brand AS instance, p_name AS name FROM part WHERE p_size > 45), n AS (SELECT * FROM s UNION SELECT * FROM c WHERE instance NOT IN (SELECT instance FROM s)) SELECT instance, id FROM truth SEMI JOIN n USING (instance, name)"""
)
def k05_named_ids(spark, d):
    p = B.t(spark, d, "part").select(F.col("p_brand").alias("instance"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size", "p_type")
    return K.named_ids(p.filter("p_size < 3 and p_type = 'ECONOMY'"), p.filter("p_size > 45"), p.select("instance", "id", "name"))


@query(
    """WITH t AS (SELECT l_returnflag AS system, count(*) AS suggestions, avg(l_quantity) AS members FROM lineitem GROUP BY 1), o AS (SELECT a.system, avg(b.suggestions) AS s, avg(b.members) AS m FROM t a JOIN t b ON a.system <> b.system GROUP BY 1)
    SELECT system, suggestions, round(members, 6) AS members, round(suggestions - s, 6) AS more_suggestions, round(members - m, 6) AS more_members FROM t LEFT JOIN o USING (system)"""
)
def k20_system_totals(spark, d):
    rows = B.t(spark, d, "lineitem").select(F.col("l_returnflag").alias("system"), F.col("l_quantity").alias("members"))
    return r6(K.system_totals(rows), "members", "more_suggestions", "more_members")


@query("SELECT p_brand AS system, count(*) AS total, count_if(p_size > 20) AS compilable, round(avg(p_size), 6) AS methods, round(avg(p_size % 4), 6) AS fields, round(count_if(p_size > 20) / count(*), 3) AS rate FROM part GROUP BY 1")
def k23_compile_rates(spark, d):
    p = B.t(spark, d, "part").select(F.col("p_brand").alias("system"), (F.col("p_size") > 20).alias("compiles"), F.col("p_size").alias("methods"), (F.col("p_size") % 4).alias("fields"))
    return r6(K.compile_rates(p), "methods", "fields")
