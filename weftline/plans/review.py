"""Queries on naming, selecting, verifying and judging clusters, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import clusters as C
from weftline.operators import evaluate as K
from weftline.operators import gates as J
from weftline.operators import graph as G
from weftline.operators import structure as D
from weftline.operators import suggest as I
from weftline.plans import bindings as B
from weftline.plans.registry import _SEDGES, _strong, query, r6


def _chosen(spark, d):
    """The methods an extraction takes: suppliers in debt."""
    return B.t(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("class_id"), F.col("s_suppkey").alias("method"))


_CHOSEN = "chosen AS (SELECT s_nationkey AS class_id, s_suppkey AS method FROM supplier WHERE s_acctbal < 0)"


# --- text ---


@query("SELECT event_id, CAST(4 AS INTEGER) AS n_arguments FROM events")
def c10_argument_count(spark, d):
    e = B.t(spark, d, "events")
    text = F.concat("event_type", F.lit(', "a,\\",'), "event_id", F.lit('", f('), "user_id", F.lit(", 2), "), "props")
    return e.select("event_id", T.argument_count(text).alias("n_arguments"))


@query("SELECT event_id, 'N' || event_id AS inner_type FROM events")
def c15_inner_types(spark, d):
    e = B.t(spark, d, "events")
    source = F.concat(F.lit("class Outer { // class Hidden\n/* enum Gone\n*/ String s = \"record Not\"; static class N"), "event_id", F.lit(" {} }"))
    return e.select("event_id", F.explode(T.inner_types(source, F.lit("Outer"))).alias("inner_type"))


@query("SELECT event_id, event_type = 'click' AS valid, CASE WHEN event_type = 'view' THEN 0.5 ELSE CAST(user_id AS DOUBLE) END AS confidence, event_type || chr(10) || 'more' AS reasoning, CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 2 END AS INTEGER) AS n_modifications FROM events")
def c27_verdict(spark, d):
    kind = F.col("event_type")
    text = F.concat(F.lit("VALID: "), F.when(kind == "click", "Yes").otherwise("no"), F.lit("\nCONFIDENCE: "), F.when(kind == "view", "high").otherwise(F.col("user_id").cast("string")), F.lit("\nREASONING: "), kind, F.lit("\nmore\nMODIFICATIONS: "), F.when(kind == "click", "none").otherwise("a, b"))
    x = B.t(spark, d, "events").select("event_id", T.verdict(text).alias("v"))
    return x.select("event_id", "v.valid", "v.confidence", "v.reasoning", F.size("v.modifications").alias("n_modifications"))


# --- structure after an extraction ---

_LEFT = f"{B.ACCESSES}, {_CHOSEN}, {B.METHODS}, lm AS (SELECT * FROM methods ANTI JOIN chosen USING (class_id, method)), la AS (SELECT * FROM accesses ANTI JOIN chosen USING (class_id, method)), m AS (SELECT class_id, count(*) AS m FROM lm GROUP BY 1), a AS (SELECT class_id, count(*) AS ma, count(DISTINCT field) AS a FROM la GROUP BY 1), p AS (SELECT DISTINCT x.class_id, x.method AS m1, y.method AS m2 FROM la x JOIN la y ON x.class_id = y.class_id AND x.field = y.field AND x.method < y.method), c AS (SELECT class_id, count(*) AS c FROM p GROUP BY 1)"


@query(f"WITH {_LEFT} SELECT class_id, coalesce(m, 0) AS remaining, round(CASE WHEN coalesce(m, 0) < 2 OR coalesce(a, 0) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (m - ma / a) / (m - 1))) END, 6) AS lcom5, round(CASE WHEN coalesce(m, 0) < 2 THEN 1.0 ELSE coalesce(c, 0) / (m * (m - 1) / 2.0) END, 6) AS tcc FROM (SELECT DISTINCT class_id FROM methods) LEFT JOIN m USING (class_id) LEFT JOIN a USING (class_id) LEFT JOIN c USING (class_id)")
def d10_after_extraction(spark, d):
    return r6(D.after_extraction(B.methods(spark, d), B.accesses(spark, d), _chosen(spark, d)), "lcom5", "tcc")


@query(f"WITH {_CHOSEN}, {B.METHODS} SELECT class_id, round(100.0 * count(DISTINCT c.method) / count(DISTINCT m.method), 6) AS coverage FROM methods m LEFT JOIN chosen c USING (class_id, method) GROUP BY 1")
def d11_coverage(spark, d):
    return r6(D.extraction_coverage(B.methods(spark, d), _chosen(spark, d)), "coverage")


# --- clusters ---


@query(f"WITH RECURSIVE {_SEDGES}, {B.PARTITION}, i AS (SELECT src, dst FROM strong JOIN part_of a ON src = a.node JOIN part_of b ON dst = b.node WHERE a.cluster_id = b.cluster_id), both_ AS (SELECT src AS a, dst AS b FROM i UNION SELECT dst, src FROM i), reach AS (SELECT node, node AS other FROM part_of UNION SELECT node, b FROM reach JOIN both_ ON other = a), c AS (SELECT node, min(other) AS component FROM reach GROUP BY 1), x AS (SELECT node, cluster_id, dense_rank() OVER (PARTITION BY cluster_id ORDER BY component) - 1 AS i FROM c JOIN part_of USING (node)) SELECT node, CAST(CASE WHEN max(i) OVER (PARTITION BY cluster_id) = 0 THEN cluster_id ELSE cluster_id * 1000 + i END AS BIGINT) AS cluster_id FROM x")
def g05_connected_parts(spark, d):
    return C.connected_parts(_strong(spark, d), B.partition(spark, d))


@query()
def g06_multi_resolution(spark, d):
    return C.multi_resolution(B.graphs(spark, d))


@query()
def g07_consensus(spark, d):
    return C.consensus(B.graphs(spark, d))


@query(f"SELECT class_id, name_group, count(*) AS n FROM (SELECT DISTINCT p_type AS class_id, p_name AS method, CASE WHEN regexp_extract(p_name, '^({C.VERBS})[A-Z]', 1) <> '' THEN regexp_extract(p_name, '^({C.VERBS})[A-Z]', 1) WHEN regexp_extract(p_name, '[A-Z][a-z]*') <> '' THEN lower(regexp_extract(p_name, '[A-Z][a-z]*')) ELSE 'other' END AS name_group FROM part) GROUP BY 1, 2 HAVING count(*) >= 3")
def g15_name_groups(spark, d):
    g = C.name_groups(B.t(spark, d, "part").select(F.col("p_type").alias("class_id"), F.col("p_name").alias("method")))
    return g.select("class_id", "name_group", F.size("members").cast("long").alias("n"))


@query(f"WITH RECURSIVE a AS (SELECT DISTINCT c_nationkey AS class_id, 'm:' || c_nationkey || ':' || o_custkey AS src, 'f:' || c_nationkey || ':' || o_orderkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey), both_ AS (SELECT class_id, src AS a, dst AS b FROM a UNION SELECT class_id, dst, src FROM a), reach AS (SELECT DISTINCT class_id, a AS node, a AS other FROM both_ UNION SELECT r.class_id, node, b FROM reach r JOIN both_ x ON r.class_id = x.class_id AND other = a), c AS (SELECT class_id, node, min(other) AS component FROM reach GROUP BY 1, 2) SELECT class_id, component, count_if(node LIKE 'm:%') AS n_methods, count_if(node LIKE 'f:%') AS n_fields FROM c GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 15")
def g18_field_groups(spark, d):
    o, c = B.t(spark, d, "orders"), B.t(spark, d, "customer")
    return C.field_groups(o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("class_id"), F.col("o_custkey").alias("method"), F.col("o_orderkey").alias("field")))


@query()
def g19_random_groups(spark, d):
    return C.random_groups(B.methods(spark, d))


@query()
def h06_average_linkage(spark, d):
    e = B.t(spark, d, "embeddings").select(F.col("label").alias("class_id"), F.col("vec_id").alias("member"), F.col("embedding").cast("array<double>").alias("x"))
    return C.average_linkage(e, 1.2)


# --- suggestions ---


def _regions(spark, d):
    n = B.t(spark, d, "nation")
    return n.groupBy(F.lit(0).alias("class_id"), F.col("n_regionkey").alias("cluster_id")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))


_NAMED = "g AS (SELECT 0 AS class_id, n_regionkey AS cluster_id, list_sort(list(n_name)) AS names FROM nation GROUP BY 2), auto AS (SELECT *, list_filter(range(1, least(length(names[1]), length(names[-1])) + 1), lambda k: left(names[1], k) = left(names[-1], k)) AS same FROM g), named AS (SELECT class_id, cluster_id, CASE WHEN len(same) >= 3 THEN upper(names[1][1]) || substr(names[1], 2, len(same) - 1) || 'Operations' ELSE upper(names[1][1]) || substr(names[1], 2) || 'Group' END AS name FROM auto)"


@query(f"WITH {_NAMED} SELECT cluster_id, name FROM named")
def i01_auto_name(spark, d):
    return _regions(spark, d).select("cluster_id", I.auto_name(F.col("names")).alias("name"))


@query(f"WITH {_NAMED}, given AS (SELECT r_regionkey AS cluster_id, r_name AS name, 0.9 AS confidence FROM region WHERE r_name LIKE 'A%') SELECT 0 AS class_id, cluster_id, name, CAST(confidence AS DOUBLE) AS confidence FROM given UNION ALL SELECT class_id, cluster_id, name, 0.5 FROM named WHERE cluster_id NOT IN (SELECT cluster_id FROM given)")
def i02_filled(spark, d):
    given = B.t(spark, d, "region").filter("r_name LIKE 'A%'").select(F.lit(0).alias("class_id"), F.col("r_regionkey").alias("cluster_id"), F.col("r_name").alias("name"), F.lit(0.9).alias("confidence"))
    return I.filled(_regions(spark, d), given)


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1")
def i03_confident(spark, d):
    doc, lab = B.t(spark, d, "documents").select("doc_id"), B.t(spark, d, "labels").select("doc_id", F.col("quality").alias("confidence"))
    return I.confident(doc.join(lab, "doc_id", "left"), 1).select("doc_id")


@query(f"WITH RECURSIVE {_CHOSEN}, own AS (SELECT DISTINCT l_orderkey, l_suppkey AS method, s_nationkey AS class_id, s_acctbal FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), calls AS (SELECT DISTINCT a.class_id, a.method AS src, b.method AS dst FROM own a JOIN own b ON a.l_orderkey = b.l_orderkey AND a.class_id = b.class_id AND a.method < b.method WHERE b.s_acctbal > 5000), reach AS (SELECT class_id, method FROM chosen UNION SELECT r.class_id, dst FROM reach r JOIN calls c ON r.class_id = c.class_id AND method = src) SELECT class_id, method FROM reach")
def i11_helper_closure(spark, d):
    li, m = B.t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct(), B.methods(spark, d)
    own = li.join(m, li.l_suppkey == m.method).select("l_orderkey", "class_id", "method")
    calls = own.join(own.withColumnRenamed("method", "other"), ["l_orderkey", "class_id"]).filter("method < other").select("class_id", F.col("method").alias("src"), F.col("other").alias("dst"))
    hidden = B.t(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("class_id"), F.col("s_suppkey").alias("method"))
    return I.helper_closure(_chosen(spark, d), calls, hidden)


@query(f"WITH {_CHOSEN}, {B.METHODS}, x AS (SELECT class_id, count(c.method) AS k, count(*) AS n FROM methods m LEFT JOIN chosen c USING (class_id, method) GROUP BY 1) SELECT class_id, k > 1 AND k > 0.2 * n AS rejected FROM x")
def i13_size_guard(spark, d):
    x = B.methods(spark, d).join(_chosen(spark, d).withColumn("taken", F.lit(1)), ["class_id", "method"], "left").groupBy("class_id").agg(F.count("taken").alias("k"), F.count(F.lit(1)).alias("n"))
    return x.select("class_id", I.too_much(F.col("k"), F.col("n"), 1, 0.2).alias("rejected"))


@query("WITH x AS (SELECT n_regionkey AS cluster_id, list_sort(list(n_name)) AS names FROM nation GROUP BY 1) SELECT cluster_id, 'Extract R' || cluster_id || chr(10) || 'Methods: ' || array_to_string(list_transform(names, lambda n: n || '()')[1:5], ', ') || chr(10) || 'Fields: ' || array_to_string(names[1:5], ', ') || chr(10) || chr(10) || left(repeat('why ', 100), 200) AS message FROM x")
def a27_message(spark, d):
    members = F.concat("names", F.transform("names", lambda n: F.concat(n, F.lit("()"))))
    return _regions(spark, d).select("cluster_id", I.message(F.concat(F.lit("R"), "cluster_id"), members, F.repeat(F.lit("why "), F.lit(100))).alias("message"))


# --- gates ---


def _names(spark, d, least, most=1e12):
    s = B.t(spark, d, "supplier").filter((F.col("s_acctbal") >= least) & (F.col("s_acctbal") < most)).select(F.col("s_suppkey").alias("method"))
    return B.accesses(spark, d).join(s, "method").select("class_id", F.col("field").alias("name"))


@query(f"WITH {B.ACCESSES}, x AS (SELECT class_id, field AS name, s_acctbal AS v FROM accesses JOIN supplier ON method = s_suppkey), n AS (SELECT class_id, name, count_if(v < 0) AS k, count_if(v >= -500) AS o, count_if(v < 2000) AS w, count_if(v >= -300) AS m FROM x GROUP BY 1, 2 HAVING count_if(v < 0) > 0) SELECT class_id, count_if(o = 0) AS missing, count_if(w = 0) AS lost, count_if(m > greatest(o - k, 0)) AS doubled FROM n GROUP BY 1")
def j02_extraction_gate(spark, d):
    return J.extraction_gate(_names(spark, d, -1e12, 0), _names(spark, d, -500), _names(spark, d, -1e12, 2000), _names(spark, d, -300))


@query("SELECT event_id, event_type <> 'click' AS delegates FROM events")
def j03_delegates(spark, d):
    body = F.when(F.col("event_type") == "click", F.concat(F.lit("{ int a = "), "event_id", F.lit("; helper.run(a); }"))).otherwise(F.concat(F.lit("{\n  return this.helper."), "event_type", F.lit("();\n}")))
    return B.t(spark, d, "events").select("event_id", J.delegates(body).alias("delegates"))


@query("SELECT event_id, CAST(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS INTEGER) AS n_errors FROM events")
def j04_true_errors(spark, d):
    log = F.concat(F.lit("A.java:1: error: cannot find symbol\nnote: "), "event_type", F.when(F.col("event_type") == "click", "\nA.java:2: Error: Raw Type").otherwise("\nA.java:2: error: ';' expected"))
    return B.t(spark, d, "events").select("event_id", F.size(J.true_errors(log)).alias("n_errors"))


def _runs(spark, d):
    o = B.t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("test"), (F.col("o_totalprice") > 100000).alias("passed")), o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("test"), (F.col("o_totalprice") > 110000).alias("passed"))


_RUNS = "b AS (SELECT o_orderkey AS test, o_totalprice > 100000 AS passed FROM orders), a AS (SELECT o_orderkey AS test, o_totalprice > 110000 AS now FROM orders WHERE o_orderpriority <> '5-LOW'), v AS (SELECT test, CASE WHEN now IS NULL THEN 'missing' WHEN now <> passed THEN 'changed' ELSE 'same' END AS verdict FROM b LEFT JOIN a USING (test))"


@query(f"WITH {_RUNS} SELECT test, verdict FROM v")
def j05_test_differences(spark, d):
    return J.test_differences(*_runs(spark, d))


@query(f"WITH {_RUNS} SELECT count(*) AS tests, count_if(verdict <> 'same') AS differences, (SELECT count_if(passed) FROM b) AS passed_before, (SELECT count_if(now) FROM a) AS passed_after, count_if(verdict <> 'same') = 0 AS equivalent FROM v")
def j16_equivalence(spark, d):
    return J.equivalence(*_runs(spark, d))


@query("WITH t AS (SELECT DISTINCT l_partkey AS target, l_linenumber AS tier, l_orderkey AS test, CAST(l_quantity AS BIGINT) % 7 AS n_methods FROM lineitem), x AS (SELECT target, tier, count(*) AS n, CAST(30 + 2 * sum(CASE WHEN n_methods > 0 THEN n_methods ELSE 10 END) AS BIGINT) AS seconds FROM t GROUP BY 1, 2 HAVING count(*) >= 3) SELECT target, tier, n, seconds FROM x QUALIFY row_number() OVER (PARTITION BY target ORDER BY tier) = 1")
def j09_chosen_tests(spark, d):
    t = B.t(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("tier"), F.col("l_orderkey").alias("test"), (F.col("l_quantity").cast("long") % 7).alias("n_methods"))
    return J.chosen_tests(t, 3)


# --- judging ---


def _judged(spark, d):
    """Suppliers in debt hold the truth, the others suggest; members are brands."""
    a = B.accesses(spark, d).join(B.t(spark, d, "supplier").select(F.col("s_suppkey").alias("method"), "s_acctbal"), "method")
    sets = lambda rows, name: rows.groupBy("class_id", F.col("method").alias(name)).agg(F.array_sort(F.collect_set("field")).alias("members"))
    return sets(a.filter("s_acctbal >= 0"), "suggestion"), sets(a.filter("s_acctbal < 0"), "truth")


_NEAREST = f"{B.ACCESSES}, j AS (SELECT a.*, s_acctbal FROM accesses a JOIN supplier ON method = s_suppkey), s AS (SELECT class_id, method AS suggestion, list(field) AS x FROM j WHERE s_acctbal >= 0 GROUP BY 1, 2), t AS (SELECT class_id, method AS truth, list(field) AS y FROM j WHERE s_acctbal < 0 GROUP BY 1, 2), nearest AS (SELECT class_id, suggestion, truth, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS similarity FROM s JOIN t USING (class_id) QUALIFY row_number() OVER (PARTITION BY class_id, suggestion ORDER BY similarity DESC, truth) = 1)"


@query(f"WITH {_NEAREST} SELECT class_id, suggestion, truth, round(similarity, 6) AS similarity FROM nearest")
def k09_nearest_truth(spark, d):
    return r6(K.nearest_truth(*_judged(spark, d)), "similarity")


@query(f"WITH {_NEAREST} SELECT CAST(threshold AS DOUBLE) AS threshold, count_if(similarity >= threshold) AS tp, count_if(similarity < threshold) AS fp FROM nearest, (SELECT unnest([0.1, 0.3, 0.5]) AS threshold) GROUP BY 1")
def k09_at_thresholds(spark, d):
    return K.at_thresholds(K.nearest_truth(*_judged(spark, d)), (0.1, 0.3, 0.5))


@query()
def k02_greedy_match(spark, d):
    s, t = _judged(spark, d)
    return K.greedy_match(s.withColumn("tool", F.lit("all")), t, 0.2)


@query()
def k10_compare(spark, d):
    s, t = _judged(spark, d)
    both = s.withColumn("tool", F.lit("all")).union(s.filter(F.size("members") >= 5).withColumn("tool", F.lit("large")))
    return K.prf(K.matched_counts(K.greedy_match(both, t, 0.2), t).withColumn("tn", F.lit(0)))


@query("WITH x AS (SELECT CASE WHEN p_size < 15 THEN 'should' WHEN p_size < 30 THEN 'could' ELSE 'potential' END AS tier, p_retailprice > 1000 AS verified FROM part) SELECT tier, count(*) AS total, count_if(verified) AS verified, round(100.0 * count_if(verified) / count(*), 6) AS rate FROM x GROUP BY 1")
def k15_rates(spark, d):
    tier = F.when(F.col("p_size") < 15, "should").when(F.col("p_size") < 30, "could").when(F.col("p_size") < 45, "potential").otherwise("none")
    return r6(K.rates(B.t(spark, d, "part").select(tier.alias("tier"), (F.col("p_retailprice") > 1000).alias("verified"))), "rate")


@query("WITH x AS (SELECT p_brand, p_size % 5 + 1 AS v FROM part) SELECT p_brand, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS low, max(v) AS high, round(avg(CASE WHEN v >= 4 THEN 1 ELSE 0 END), 6) AS at_least_4, round(avg(CASE WHEN v >= 3 THEN 1 ELSE 0 END), 6) AS at_least_3 FROM x GROUP BY 1")
def k17_ratings(spark, d):
    return r6(K.ratings_summary(B.t(spark, d, "part").select("p_brand", (F.col("p_size") % 5 + 1).alias("v")), "v", "p_brand"), "mean", "sd", "at_least_4", "at_least_3")
