"""Queries on measures of code and of results: line folds, features, names in types, p-values, variants, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.operators import containing as N
from weftline.operators import evaluate as K
from weftline.operators import evolution as V
from weftline.operators import features as H
from weftline.operators import grid as R
from weftline.operators import javasource as J
from weftline.plans import bindings as B
from weftline.plans.code import PARTS, sources
from weftline.plans.registry import WEIGHTED, query, r6

# pages as if they were code: a tag opens a block on a line of its own, markup comments are code comments
BODY = r"replace(replace(replace(replace(html, '<!--', '/*'), '-->', '*/'), '<', chr(10) || '{'), '>', '}' || chr(10))"


def _bodies(spark, d):
    body = "replace(replace(replace(replace(html, '<!--', '/*'), '-->', '*/'), '<', '\\n{'), '>', '}\\n')"
    return B.t(spark, d, "pages").select("page_id", F.expr(body).alias("body"))


_HITS = " + ".join(f"regexp_matches(line, '{p}')::INT" for p in H.DECISIONS[:5])
_LINES = f"lines AS (SELECT page_id, unnest(string_split({BODY}, chr(10))) AS line, generate_subscripts(string_split({BODY}, chr(10)), 1) AS i FROM pages)"


@query(
    f"""WITH {_LINES}, c AS (SELECT page_id, i, len(line) - len(replace(line, '{{', '')) AS o, len(line) - len(replace(line, '}}', '')) AS c, {_HITS} AS hits FROM lines),
    s AS (SELECT page_id, hits, sum(o) OVER w AS so, sum(c) OVER w AS sc, c FROM c WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING))
    SELECT page_id, CAST(sum(hits * (so - sc + 1)) AS BIGINT) AS cognitive, CAST(greatest(0, max(so - sc + c)) AS BIGINT) AS max_depth FROM s GROUP BY 1"""
)
def h01b_nesting(spark, d):
    return _bodies(spark, d).select("page_id", H.nesting(F.col("body")).alias("n")).select("page_id", "n.cognitive", "n.max_depth")


@query(
    f"""WITH {_LINES}, t AS (SELECT page_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM lines), m AS (SELECT *, CASE WHEN contains(s, '*/') THEN 0 WHEN contains(s, '/*') THEN 1 END AS mark FROM t),
    x AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS inside FROM m)
    SELECT page_id, count(*) AS loc, count_if(s <> '' AND NOT contains(s, '*/') AND inside = 0 AND NOT starts_with(s, '//')) AS sloc FROM x GROUP BY 1"""
)
def h01c_source_lines(spark, d):
    return _bodies(spark, d).select("page_id", F.size(F.split("body", "\n")).alias("loc"), H.source_lines(F.col("body")).alias("sloc"))


@query(
    f"""WITH {PARTS}, own AS (SELECT k, count(*) AS all_methods FROM (SELECT k FROM parts UNION ALL SELECT k FROM parts WHERE v = 2) GROUP BY 1), f AS (SELECT k, count(*) AS users FROM parts WHERE v <> 1 GROUP BY 1),
    x AS (SELECT k, 'm' || p || '(int,Map,String[])' AS method, 1 AS complexity, 0 AS cognitive_complexity, 1 AS nesting_depth, 5 AS loc, 4 AS sloc, 3 AS parameters, 1 AS field_usage, (p + 1) // 8 = k AND p + 1 IN (SELECT p FROM parts) AS calls, 1 AS statements, 0 AS is_void FROM parts WHERE v = 0
      UNION ALL SELECT k, 'm' || p || '(int)', 2, 1, 2, 1, 1, 1, 0, NULL, 3, 1 FROM parts WHERE v = 1
      UNION ALL SELECT k, '<init>(T' || p || '[])', 1, 0, 1, 3, 3, 1, 1, false, 1, 0 FROM parts WHERE v = 2
      UNION ALL SELECT k, 'n' || p || '()', 1, 0, 0, 1, 1, 0, 0, false, 1, 0 FROM parts WHERE v = 2)
    SELECT k AS class_id, method, CAST(complexity AS DOUBLE) AS complexity, CAST(cognitive_complexity AS DOUBLE) AS cognitive_complexity, CAST(nesting_depth AS DOUBLE) AS nesting_depth, CAST(loc AS DOUBLE) AS loc, CAST(sloc AS DOUBLE) AS sloc, CAST(parameters AS DOUBLE) AS parameters, CAST(field_usage AS DOUBLE) AS field_usage,
    CASE WHEN calls IS NULL THEN 1.0 + CASE WHEN CAST(regexp_extract(method, '[0-9]+') AS BIGINT) - 1 IN (SELECT p FROM parts q WHERE q.k = x.k) THEN 1 ELSE 0 END WHEN calls THEN 1.0 ELSE 0.0 END AS method_calls, CAST(statements AS DOUBLE) AS statements, CAST(is_void AS DOUBLE) AS is_void FROM x"""
)
def h07_features(spark, d):
    m = J.members(sources(spark, d))
    c = m.filter("kind <> 'field'")
    acc = J.accesses(c, m.filter("kind = 'field'")).select(F.col("file").alias("class_id"), F.col("signature").alias("method"), "field")
    calls = J.internal_calls(J.calls(c), c.select("file", "name", "signature", F.size("parameters").alias("n_params"))).select(F.col("file").alias("class_id"), F.col("signature").alias("method"), "target")
    methods = c.select(F.col("file").alias("class_id"), F.col("signature").alias("method"), "type", "modifiers", "parameters", "body")
    return H.method_features(methods, acc, calls).select("class_id", "method", *(f for f in H.FEATURES if f not in ("local_vars", "shared_fields", "is_static")))


# --- names within types ---

_NAMES = "names AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT substr(n_name, 1, 2) FROM nation)"
_TYPES = "types AS (SELECT p_partkey AS class_id, 'List<' || p_brand || ',' || p_name || '>' AS type FROM part UNION ALL SELECT p_partkey, p_type FROM part)"


def _named_types(spark, d):
    p, n = B.t(spark, d, "part"), B.t(spark, d, "nation")
    names = p.select(F.col("p_brand").alias("name")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(2)))).union(n.select(F.substring("n_name", 1, 2))).distinct()
    key = F.col("p_partkey").alias("class_id")
    return names, p.select(key, F.concat(F.lit("List<"), "p_brand", F.lit(","), "p_name", F.lit(">")).alias("type")).union(p.select(key, "p_type"))


@query(f"WITH {_NAMES}, {_TYPES} SELECT name, count(DISTINCT class_id) AS ca FROM names LEFT JOIN types ON contains(type, name) GROUP BY 1")
def d07_afferent(spark, d):
    names, types = _named_types(spark, d)
    return N.afferent(types, names)


@query(f"WITH {_NAMES}, truth AS (SELECT p_partkey AS truth, p_name || '.' || p_brand AS source_class FROM part) SELECT name AS class_id, truth FROM names JOIN truth ON contains(source_class, name)")
def k03_class_matches(spark, d):
    names, _ = _named_types(spark, d)
    truth = B.t(spark, d, "part").select(F.col("p_partkey").alias("truth"), F.concat("p_name", F.lit("."), "p_brand").alias("source_class"), F.array("p_type").alias("members"))
    return N.truth_for(names.select(F.col("name").alias("class_id")), truth).select("class_id", "truth")


@query()
def k03_matched(spark, d):
    """Suggestions of a class (brand) against the truth of all classes whose names contain it, each taken once."""
    p = B.t(spark, d, "part")
    suggested = p.groupBy("p_brand", "p_size").agg(F.collect_set("p_name").alias("members")).select(F.lit("tool").alias("tool"), F.col("p_brand").alias("class_id"), F.col("p_size").alias("suggestion"), "members")
    truth = p.groupBy("p_brand", "p_type").agg(F.collect_set("p_name").alias("members"), F.min("p_partkey").alias("truth")).select("truth", F.concat("p_brand", F.lit("."), "p_type").alias("source_class"), "members")
    return K.greedy_match(suggested, N.truth_for(suggested, truth), 0.3)


# --- p-values ---

_SIGNED = "z AS (SELECT o_custkey, o_orderstatus, o_totalprice - 150000 AS d FROM orders WHERE o_totalprice <> 150000), r AS (SELECT *, rank() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY abs(d)) AS rk FROM z), g AS (SELECT o_custkey, o_orderstatus, count(*) AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)) AS w, count(DISTINCT abs(d)) AS sizes FROM r GROUP BY 1, 2)"


@query(
    f"""WITH RECURSIVE {_SIGNED}, ways AS (SELECT 0 AS k, 0 AS s UNION ALL SELECT k + 1, s + e * (k + 1) FROM ways, (VALUES (0), (1)) AS t(e) WHERE k < 16), c AS (SELECT k, s, count(*) AS c FROM ways GROUP BY 1, 2)
    SELECT o_custkey, o_orderstatus, n, round(w, 6) AS w, round(CASE WHEN n < 2 THEN 1 ELSE least(1, 2 * (SELECT sum(c) FROM c WHERE c.k = n AND c.s <= w) / pow(2, n)) END, 6) AS p FROM g WHERE n <= 16 AND sizes = n"""
)
def k12_p_values(spark, d):
    """Exact p of every customer's orders of a status against a price, where sizes do not tie."""
    pairs = B.t(spark, d, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("x"), F.lit(150000.0).alias("y"))
    return r6(K.signed_ranks(pairs, "o_custkey", "o_orderstatus").filter("n <= 16 and ties = 0").drop("ties"), "w", "p")


@query()
def k11_p_values(spark, d):
    pairs = B.t(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("x"), F.lit(150000.0).alias("y"))
    return r6(K.paired_t(pairs, "o_custkey"), "mean", "t", "d", "p")


@query(
    """WITH v AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM supplier), b AS (SELECT i // n AS round, ((i * 1103515245 + 12345) % 2147483648) % n AS k FROM n, range(200 * (SELECT n FROM n)) t(i)), m AS (SELECT round, avg(v) AS mean FROM b JOIN v USING (k) GROUP BY 1)
    SELECT round((SELECT avg(v) FROM v), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m"""
)
def k14_interval(spark, d):
    v = B.t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return r6(K.bootstrap_interval(K.bootstrap(v, 200, v.count()), v), "mean", "low", "high")


# --- variants and reports ---

_GRID = {"full": (0.8, 0.03, 30), "no_decay": (1.0, 0.03, 30), "strict": (0.8, 0.1, 30), "pairs_only": (0.8, 0.03, 2)}


def _grid_sql(name, decay, threshold, cap):
    body = WEIGHTED.replace("pow(0.8,", f"pow({decay},").replace("basket <= 30", f"basket <= {cap}")
    return f"SELECT '{name}' AS variant, count(*) AS pairs, round(coalesce(sum(coupling), 0), 6) AS total FROM (WITH {body} SELECT * FROM coupled WHERE coupling >= {threshold})"


@query(" UNION ALL ".join(_grid_sql(k, *v) for k, v in _GRID.items()))
def k18_variants(spark, d):
    base = {"evolution": {"decay": 0.8, "cap": 30}, "fusion": {"threshold": 0.03}}
    variants = {"full": {}, "no_decay": {"evolution": {"decay": 1.0}}, "strict": {"fusion": {"threshold": 0.1}}, "pairs_only": {"evolution": {"cap": 2}}}

    def plan(inputs, p):
        rows = V.weighted(inputs["changes"], B.AS_OF, p["evolution"]["decay"], p["evolution"]["cap"])
        found = V.coupling(V.cochange(rows), V.member_commits(rows), p["fusion"]["threshold"])
        return found.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("coupling"), F.lit(0.0)).alias("total"))

    return r6(R.run_variants(base, variants, {"changes": B.changes(spark, d)}, plan), "total")


@query(
    f"""WITH {B.CHANGES}, w AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY commit_id) AS basket FROM changes) WHERE basket <= 30)
    SELECT 'changes' AS stage, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS value FROM changes UNION ALL SELECT 'changes', 'members', CAST(max(strlen(member)) AS DOUBLE) FROM changes
    UNION ALL SELECT 'capped', 'rows', CAST(count(*) AS DOUBLE) FROM w UNION ALL SELECT 'capped', 'largest', CAST(max(basket) AS DOUBLE) FROM w
    UNION ALL SELECT '', 'stages', 2.0 UNION ALL SELECT '', 'events', 1.0 UNION ALL SELECT '', 'failures', 0.0"""
)
def a16_stage_report(spark, d):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="weftline-")
    base, report = f"{base}/stages-{uuid.uuid4().hex}", R.StageReport("cochange")
    changes = report.write("changes", B.changes(spark, d), f"{base}/changes", members=F.max(F.octet_length("member")))
    report.event("capping", "30")
    report.write("capped", V.capped(changes, 30), f"{base}/capped", largest=F.max("basket"))
    return report.report(spark).filter("measure <> 'seconds'").drop("run")
