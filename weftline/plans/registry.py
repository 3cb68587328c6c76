"""All queries of the library's own operators, each beside the SQL an oracle runs on the same tables.

Floats are rounded to six places here, at the boundary, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import clusters as C
from weftline.operators import evaluate as K
from weftline.operators import evolution as V
from weftline.operators import features as H
from weftline.operators import gates as J
from weftline.operators import graph as G
from weftline.operators import structure as D
from weftline.operators import suggest as I
from weftline.operators.prefix import ranked
from weftline.plans import bindings as B
from weftline.sources import files as S
from weftline.streaming import cochange as X

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


WEIGHTED = f"""{B.CHANGES}, baskets AS (SELECT *, count(*) OVER (PARTITION BY commit_id) AS basket FROM changes),
weighted AS (SELECT commit_id, member, 1 / sqrt(greatest(basket, 1)) * pow(0.8, greatest(0, floor((epoch(TIMESTAMP '{B.AS_OF}') - epoch(ts)) / 86400)) / 30.0 / 12) AS w FROM baskets WHERE basket <= 30),
pairs AS (SELECT a.member AS m1, b.member AS m2, sum(a.w) AS cochange FROM weighted a JOIN weighted b ON a.commit_id = b.commit_id AND a.member < b.member GROUP BY 1, 2),
counts AS (SELECT member, count(DISTINCT commit_id) AS n FROM weighted GROUP BY 1),
coupled AS (SELECT m1, m2, cochange, cochange / sqrt(x.n * y.n) * CASE WHEN split_part(m1, '(', 1) = split_part(m2, '(', 1) THEN 0.5 ELSE 1 END AS coupling FROM pairs JOIN counts x ON m1 = x.member JOIN counts y ON m2 = y.member)"""


def _rows(spark, d):
    return V.weighted(B.changes(spark, d), B.AS_OF)


def _coupled(spark, d, threshold=0.03):
    return V.mine(B.changes(spark, d), B.AS_OF, threshold=threshold)


# --- scans and sinks ---


@query("SELECT l_suppkey AS member, l_orderkey AS commit_id, rank FROM (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY o_orderdate DESC, l_orderkey) AS rank FROM (SELECT DISTINCT l_suppkey, l_orderkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01')) WHERE rank <= 500")
def a02_commit_log(spark, d):
    li, o = B.t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), B.t(spark, d, "orders").select("o_orderkey", "o_orderdate").filter("o_orderdate >= '1997-01-01'")
    c = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("member"), F.col("l_orderkey").alias("commit_id"), F.col("o_orderdate").alias("ts")).distinct()
    return V.top_commits(c).select("member", "commit_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def a06_nested_json(spark, d):
    e = B.t(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {B.EDGES} SELECT src AS source, dst AS target, round(weight, 6) AS weight FROM edges")
def a13_edge_list(spark, d):
    return r6(G.undirected(B.flows(spark, d)), "weight").select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")


@query(f"WITH {B.EDGES}, e AS (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) SELECT n_nationkey AS node, CAST(coalesce(count(e.node), 0) AS DOUBLE) AS degree, round(coalesce(sum(weight), 0), 6) AS strength FROM nation LEFT JOIN e ON node = n_nationkey GROUP BY 1")
def a14_centrality_pivot(spark, d):
    e = G.ends(G.undirected(B.flows(spark, d)))
    rows = e.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("degree"), F.sum("weight").alias("strength"))
    long = rows.select("node", F.explode(F.create_map(F.lit("degree"), "degree", F.lit("strength"), "strength")).alias("metric", "score"))
    nodes = B.t(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return r6(nodes.join(S.wide_centrality(long, ["degree", "strength"]), "node", "left").na.fill(0.0), "strength")


@query("SELECT coalesce(r_name, 'Total') AS class, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP(r_name)")
def a19_totals_table(spark, d):
    s, n, r = B.t(spark, d, "supplier"), B.t(spark, d, "nation"), B.t(spark, d, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance")).select(F.coalesce("r_name", F.lit("Total")).alias("class"), "suppliers", "balance")


@query("WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderdate AS mtime, CAST(o_totalprice AS BIGINT) AS bytes FROM orders), f AS (SELECT key, sum(bytes) OVER (ORDER BY mtime DESC, key ROWS UNBOUNDED PRECEDING) AS room FROM e WHERE mtime >= TIMESTAMP '2001-12-31' - INTERVAL 365 DAY) SELECT key FROM e WHERE mtime < TIMESTAMP '2001-12-31' - INTERVAL 365 DAY UNION ALL SELECT key FROM f WHERE room > 1000000")
def a20_cache_eviction(spark, d):
    e = B.t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderdate").alias("mtime"), F.round("o_totalprice").cast("long").alias("bytes"))
    return S.evicted(e, "2001-12-31", 365, 1_000_000)


@query("SELECT o_orderkey AS id, md5(concat_ws(':', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS key FROM orders")
def a20_cache_key(spark, d):
    o = B.t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), S.cache_key(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("key"))


# --- co-change mining ---


@query(f"WITH {WEIGHTED} SELECT commit_id, count(*) AS basket FROM changes GROUP BY 1 HAVING count(*) <= 7")
def b03_basket_cap(spark, d):
    return V.capped(B.changes(spark, d), 7).select("commit_id", "basket").distinct()


@query(f"WITH {WEIGHTED} SELECT commit_id, member, round(w, 6) AS w FROM weighted")
def b05_weights(spark, d):
    return r6(_rows(spark, d).select("commit_id", "member", "w"), "w")


@query(f"WITH {WEIGHTED} SELECT m1, m2, round(cochange, 6) AS cochange FROM pairs")
def b06_cochange(spark, d):
    return r6(V.cochange(_rows(spark, d)), "cochange")


@query(f"WITH {WEIGHTED} SELECT member, n FROM counts")
def b07_member_commits(spark, d):
    return V.member_commits(_rows(spark, d))


@query(f"WITH {WEIGHTED} SELECT member, n FROM counts WHERE n >= 500")
def b08_min_support(spark, d):
    return V.supported(V.member_commits(_rows(spark, d)), 500)


_OVER = "WITH every AS (SELECT DISTINCT l_orderkey AS commit_id, p_type || '(' || p_brand || ')' AS member FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT * FROM every QUALIFY count(*) OVER (PARTITION BY commit_id) <= 30), p AS (SELECT a.member AS m1, b.member AS m2, count(*) AS cochange FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.member < b.member GROUP BY 1, 2), n AS (SELECT member, count(*) AS n FROM c GROUP BY 1) SELECT m1, m2, CAST(cochange AS DOUBLE) AS cochange, round(cochange / sqrt(x.n * y.n) * CASE WHEN split_part(m1, '(', 1) = split_part(m2, '(', 1) THEN 0.5 ELSE 1 END, 6) AS coupling FROM p JOIN n x ON m1 = x.member JOIN n y ON m2 = y.member"


@query(_OVER)
def b09_overload_coupling(spark, d):
    li, p = B.t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), B.t(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    c = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("commit_id"), F.concat("p_type", F.lit("("), "p_brand", F.lit(")")).alias("member")).distinct()
    c = V.capped(c)
    return r6(V.coupling(V.cochange(c, F.lit(1.0)), V.member_commits(c), 0.0), "coupling")


@query(f"WITH {WEIGHTED}, m AS (SELECT DISTINCT member FROM changes) SELECT x.member AS a, y.member AS b, round(coalesce(coupling, 0), 6) AS coupling FROM m x CROSS JOIN m y LEFT JOIN (SELECT * FROM coupled WHERE coupling >= 0.03) ON m1 = least(x.member, y.member) AND m2 = greatest(x.member, y.member)")
def b10_coupling_lookup(spark, d):
    m = B.t(spark, d, "part").select("p_brand").distinct()
    asked = m.select(F.col("p_brand").alias("a")).join(m.select(F.col("p_brand").alias("b")))
    return r6(V.lookup(asked, _coupled(spark, d)), "coupling")


@query("WITH every AS (SELECT DISTINCT l_orderkey AS commit_id, CAST(s_nationkey AS VARCHAR) || '::' || p_type AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey), c AS (SELECT * FROM every QUALIFY count(*) OVER (PARTITION BY commit_id) <= 30) SELECT a.member AS m1, b.member AS m2, CAST(count(*) AS DOUBLE) AS cochange FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.member < b.member GROUP BY 1, 2")
def b11_cross_file(spark, d):
    li, s, p = (B.t(spark, d, x) for x in ("lineitem", "supplier", "part"))
    c = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("commit_id"), F.concat_ws("::", F.col("s_nationkey").cast("string"), "p_type").alias("member")).distinct()
    return V.cochange(V.capped(c), F.lit(1.0))


@query(f"WITH {WEIGHTED}, e AS (SELECT m1 AS member, coupling FROM coupled WHERE coupling >= 0.03 UNION ALL SELECT m2, coupling FROM coupled WHERE coupling >= 0.03) SELECT member, round(sum(coupling), 6) AS soc FROM e GROUP BY 1")
def b12_sum_of_coupling(spark, d):
    return r6(V.sum_of_coupling(_coupled(spark, d)), "soc")


@query(f"WITH {WEIGHTED}, e AS (SELECT m1 AS member, coupling FROM coupled WHERE coupling >= 0.03 UNION ALL SELECT m2, coupling FROM coupled WHERE coupling >= 0.03), s AS (SELECT member, n * coalesce((SELECT sum(coupling) FROM e WHERE e.member = counts.member), 0) AS raw FROM counts WHERE n >= 3) SELECT member, round(raw / (SELECT max(raw) FROM s), 6) AS score FROM s ORDER BY raw DESC, member LIMIT 10")
def b13_hotspots(spark, d):
    return r6(V.hotspots(_coupled(spark, d), V.member_commits(_rows(spark, d))), "score")


@query(f"WITH {WEIGHTED} SELECT m1, m2, round(cochange, 6) AS cochange, round(coupling, 6) AS coupling, rank() OVER (ORDER BY round(coupling, 6) DESC, m1, m2) AS rank FROM coupled WHERE coupling >= 0.03")
def b14_cochange_mining(spark, d):
    x = r6(_coupled(spark, d), "cochange", "coupling")
    return ranked(x, [F.desc("coupling"), F.col("m1"), F.col("m2")])


@query("SELECT l_orderkey AS commit_id, l_linenumber AS start, l_linenumber + CAST(l_quantity AS INTEGER) - 1 AS stop FROM lineitem")
def b01_hunks(spark, d):
    li = B.t(spark, d, "lineitem")
    diff = F.concat(F.lit("@@ -1,2 +"), F.col("l_linenumber").cast("string"), F.lit(","), F.col("l_quantity").cast("int").cast("string"), F.lit(" @@ x"))
    return V.hunks(li.select(F.col("l_orderkey").alias("commit_id"), diff.alias("diff")))


@query("WITH m AS (SELECT DISTINCT o_orderkey AS commit_id, o_orderpriority AS member, 10 AS start, 20 AS stop FROM orders), h AS (SELECT l_orderkey AS commit_id, CAST(l_quantity AS INTEGER) AS cs, CAST(l_quantity AS INTEGER) + l_linenumber AS ce FROM lineitem) SELECT DISTINCT commit_id, member FROM m JOIN h USING (commit_id) WHERE stop >= cs AND start <= ce")
def b02_line_overlap(spark, d):
    m = B.t(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderpriority").alias("member"), F.lit(10).alias("start"), F.lit(20).alias("stop"))
    q = F.col("l_quantity").cast("int")
    h = B.t(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), q.alias("start"), (q + F.col("l_linenumber")).alias("stop"))
    return V.overlapping(m, h)


# --- text ---


@query("SELECT lower(regexp_extract(r_name, '^[A-Z]', 0)) AS first, count(*) AS n FROM region GROUP BY 1")
def c16_first_letter(spark, d):
    return B.t(spark, d, "region").groupBy(F.lower(F.regexp_extract("r_name", "^[A-Z]", 0)).alias("first")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages")
def c20_tag(spark, d):
    return B.t(spark, d, "pages").select("page_id", T.tag(F.col("html"), "title").alias("title"))


@query("SELECT p_partkey AS id, regexp_matches(p_type, '^[A-Z][a-zA-Z0-9_]*$') AND length(p_type) >= 3 AS valid FROM part")
def c24_class_name(spark, d):
    return B.t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.valid_class_name(F.col("p_type")).alias("valid"))


@query("SELECT p_partkey AS id, p_type || 'Of' || p_brand AS bare FROM part")
def c25_bare_name(spark, d):
    sig = F.concat(F.lit("void "), "p_type", F.lit("Of"), "p_brand", F.lit("(int,String)"))
    return B.t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.bare_name(sig).alias("bare"))


@query("SELECT p_partkey AS id, replace(p_brand, '#', '') AS kind FROM part")
def c13_base_type(spark, d):
    return B.t(spark, d, "part").select(F.col("p_partkey").alias("id"), T.base_type(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("<List<int>>[]"))).alias("kind"))


@query("SELECT page_id, line, CAST(sum(len(s) - len(replace(s, '<', '')) - len(s) + len(replace(s, '>', ''))) OVER (PARTITION BY page_id ORDER BY line) AS BIGINT) AS depth FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS s, CAST(generate_subscripts(string_split(html, chr(10)), 1) - 1 AS INTEGER) AS line FROM pages)")
def c05_line_depth(spark, d):
    x = T.line_depth(B.t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), "<", ">")
    return x.select(F.col("id").alias("page_id"), "line", F.col("depth").cast("long").alias("depth"))


_TOK = r"tok AS (SELECT item_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM benchmark)"
_TFIDF = f"{_TOK}, tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2), terms AS (SELECT term, sum(tf) AS c, count(*) AS df FROM tf GROUP BY 1 ORDER BY c DESC, term LIMIT 500), w AS (SELECT doc, term, tf * (ln((1 + (SELECT count(DISTINCT doc) FROM tok)) / (1.0 + df)) + 1) AS w FROM tf JOIN terms USING (term)), vec AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM w)"


def _vectors(spark, d):
    x = B.t(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0)).alias("term"))
    return T.tfidf(x)


@query(f"WITH {_TFIDF} SELECT doc, term, round(weight, 6) AS weight FROM vec")
def e03_tfidf(spark, d):
    return r6(_vectors(spark, d), "weight")


@query(f"WITH {_TFIDF} SELECT a.doc AS src, b.doc AS dst, round(sum(a.weight * b.weight), 6) AS weight FROM vec a JOIN vec b ON a.term = b.term AND a.doc < b.doc GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.1")
def e05_conceptual_graph(spark, d):
    return r6(T.similar(_vectors(spark, d)), "weight")


@query(r"SELECT p_partkey AS id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(p_name, '([A-Z])', ' \1', 'g')), '[\s_]+'), lambda x: length(x) > 1), ' ') AS tokens FROM part")
def e01_camel_tokens(spark, d):
    return B.t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(T.camel_tokens(F.col("p_name")), " ").alias("tokens"))


@query("SELECT page_id, CASE WHEN length(html) <= 300 THEN html WHEN strpos(left(html, 300), chr(10)) > 0 AND 300 - strpos(reverse(left(html, 300)), chr(10)) > 150 THEN left(html, 300 - strpos(reverse(left(html, 300)), chr(10))) ELSE left(html, 300) END AS cut FROM pages")
def e07_truncate(spark, d):
    return B.t(spark, d, "pages").select("page_id", T.truncated(F.col("html"), 300).alias("cut"))


# --- structure ---

_DEP = f"""{B.ACCESSES}, dep AS (SELECT class_id, src, dst, max(weight) AS weight FROM (
SELECT s_nationkey AS class_id, CAST(a.l_suppkey AS VARCHAR) AS src, CAST(b.l_suppkey AS VARCHAR) AS dst, 1.0 AS weight FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b USING (l_orderkey) JOIN supplier s ON a.l_suppkey = s.s_suppkey JOIN supplier t ON b.l_suppkey = t.s_suppkey WHERE s.s_nationkey = t.s_nationkey AND a.l_suppkey < b.l_suppkey
UNION ALL SELECT class_id, CAST(method AS VARCHAR), field, 0.8 FROM accesses
UNION ALL SELECT DISTINCT a.class_id, CAST(a.method AS VARCHAR), CAST(b.method AS VARCHAR), 0.9 FROM accesses a JOIN accesses b ON a.class_id = b.class_id AND a.field = b.field AND a.method <> b.method) GROUP BY 1, 2, 3)"""


@query(f"WITH {_DEP.replace('SELECT s_nationkey AS class_id, CAST', 'SELECT s.s_nationkey AS class_id, CAST')} SELECT class_id, src, dst, CAST(weight AS DOUBLE) AS weight FROM dep")
def d01_dependency_weights(spark, d):
    li = B.t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    m = B.methods(spark, d)
    own = li.join(m, li.l_suppkey == m.method).select("l_orderkey", "class_id", "method")
    calls = own.join(own.withColumnRenamed("method", "other"), ["l_orderkey", "class_id"]).filter("method < other").select("class_id", F.col("method").cast("string").alias("src"), F.col("other").cast("string").alias("dst")).distinct()
    a = B.accesses(spark, d).withColumn("method", F.col("method").cast("string"))
    return D.dependency_weights(calls, calls.limit(0), a)


@query(f"WITH {B.ACCESSES}, {B.METHODS}, m AS (SELECT class_id, count(*) AS m FROM methods GROUP BY 1), a AS (SELECT class_id, count(*) AS ma, count(DISTINCT field) AS a FROM accesses GROUP BY 1) SELECT class_id, round(CASE WHEN m <= 1 OR coalesce(a, 0) = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (m - ma / a) / (m - 1))) END, 6) AS lcom5 FROM m LEFT JOIN a USING (class_id)")
def d03_lcom5(spark, d):
    return r6(D.lcom5(B.methods(spark, d), B.accesses(spark, d)), "lcom5")


@query(f"WITH {B.ACCESSES}, {B.METHODS}, p AS (SELECT DISTINCT a.class_id, a.method AS m1, b.method AS m2 FROM accesses a JOIN accesses b ON a.class_id = b.class_id AND a.field = b.field AND a.method < b.method), c AS (SELECT class_id, count(*) AS c FROM p GROUP BY 1), m AS (SELECT class_id, count(*) AS m FROM methods GROUP BY 1) SELECT class_id, round(CASE WHEN m < 2 THEN 0.0 ELSE coalesce(c, 0) / (m * (m - 1) / 2.0) END, 6) AS tcc FROM m LEFT JOIN c USING (class_id)")
def d04_tcc(spark, d):
    return r6(D.tcc(B.methods(spark, d), B.accesses(spark, d)), "tcc")


@query("SELECT CAST(s_nationkey AS VARCHAR) AS class_id, count(DISTINCT p_partkey) AS cbo FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def d06_cbo(spark, d):
    li, s, p = B.t(spark, d, "lineitem"), B.t(spark, d, "supplier"), B.t(spark, d, "part")
    return D.cbo(li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey).select(F.col("s_nationkey").cast("string").alias("class_id"), F.concat(F.lit("P"), "p_partkey").alias("type")))


@query(f"WITH {B.FLOWS}, ce AS (SELECT src AS class_id, count(*) AS ce FROM flows WHERE src <> dst AND weight >= 0.9 GROUP BY 1), ca AS (SELECT dst AS class_id, count(*) AS ca FROM flows WHERE src <> dst AND weight >= 0.9 GROUP BY 1) SELECT class_id, coalesce(ce, 0) AS ce, coalesce(ca, 0) AS ca, round(coalesce(ce, 0) / (coalesce(ce, 0) + coalesce(ca, 0)), 6) AS instability FROM ce FULL JOIN ca USING (class_id)")
def d08_instability(spark, d):
    f = B.flows(spark, d).filter("src <> dst and weight >= 0.9")
    ce, ca = f.groupBy(F.col("src").alias("class_id")).agg(F.count(F.lit(1)).alias("ce")), f.groupBy(F.col("dst").alias("class_id")).agg(F.count(F.lit(1)).alias("ca"))
    return r6(D.instability(ce, ca), "instability")


@query(f"WITH {B.ACCESSES}, x AS (SELECT class_id, method, count(*) OVER (PARTITION BY class_id, field) - 1 AS others FROM accesses), m AS (SELECT class_id, count(DISTINCT method) AS m FROM accesses GROUP BY 1) SELECT class_id, method, count(*) AS fields, round(sum(others) / (count(*) * greatest(1, max(m) - 1)), 6) AS shared_ratio FROM x JOIN m USING (class_id) GROUP BY 1, 2")
def h01e_field_sharing(spark, d):
    return r6(D.field_sharing_ratio(B.accesses(spark, d)), "shared_ratio")


# --- graphs ---


@query(f"WITH {B.EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def f01_static_graph(spark, d):
    return r6(G.undirected(B.flows(spark, d)), "weight")


_EVO = "evo AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, (a.n_regionkey + b.n_regionkey + 1) / 10.0 AS weight FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey)"


def _evo(spark, d):
    n = B.t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return n.select(F.col("n_nationkey").alias("src"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("dst"), "n_regionkey"), "n_regionkey").filter("src < dst").select("src", "dst", ((2 * F.col("n_regionkey") + 1) / 10).alias("weight"))


def _fused_sql(alpha: float, threshold: float) -> str:
    return f"WITH {B.EDGES}, {_EVO} SELECT src, dst, round(w, 6) AS weight FROM (SELECT coalesce(e.src, v.src) AS src, coalesce(e.dst, v.dst) AS dst, {alpha} * coalesce(e.weight / (SELECT max(weight) FROM edges), 0) + {round(1 - alpha, 6)} * coalesce(v.weight / (SELECT max(weight) FROM evo), 0) AS w FROM edges e FULL JOIN evo v ON e.src = v.src AND e.dst = v.dst) WHERE w >= {threshold}"


@query(_fused_sql(0.6, 0.1))
def f03_fusion(spark, d):
    return r6(G.fuse(G.undirected(B.flows(spark, d)), _evo(spark, d)), "weight")


@query(f"WITH {B.EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges WHERE weight >= 0.1")
def f03_fusion_without_history(spark, d):
    return r6(G.fuse(G.undirected(B.flows(spark, d)), _evo(spark, d).filter("weight < 0")), "weight")


@query(f"WITH {B.EDGES} SELECT src, dst, round(0.8 - 0.3 * (src / 24.0 + dst / 24.0), 6) AS alpha FROM edges")
def f04_adaptive_alpha(spark, d):
    heat = B.t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") / 24).alias("score"))
    return r6(G.adaptive_alpha(G.undirected(B.flows(spark, d)), heat).select("src", "dst", "alpha"), "alpha")


_STRONG = "quantile_cont(weight, 0.8)"


def _strong(spark, d):
    e = G.undirected(B.flows(spark, d))
    return e.join(F.broadcast(e.agg(F.percentile("weight", F.lit(0.8)).alias("q")))).filter("weight >= q").drop("q")


_SEDGES = f"{B.EDGES}, strong AS (SELECT * FROM edges WHERE weight >= (SELECT quantile_cont(weight, 0.8) FROM edges)), sends AS (SELECT src AS node, dst AS other, weight FROM strong UNION ALL SELECT dst, src, weight FROM strong)"


def _nodes(spark, d):
    return B.t(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


@query(f"WITH {_SEDGES} SELECT n_nationkey AS node, round(count(other) / 24.0, 6) AS score FROM nation LEFT JOIN sends ON node = n_nationkey GROUP BY 1")
def f06_degree_centrality(spark, d):
    return r6(G.degree_centrality(_nodes(spark, d), _strong(spark, d)), "score")


@query()
def f07_betweenness(spark, d):
    return r6(C.betweenness(B.graphs(spark, d)), "score")


_PR = f"WITH RECURSIVE {_SEDGES}, share AS (SELECT node, other, weight / sum(weight) OVER (PARTITION BY node) AS s FROM sends), loose AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT node FROM sends)), pr AS (SELECT 0 AS step, n_nationkey AS node, 1 / 25.0 AS r FROM nation UNION ALL SELECT * FROM (WITH p AS (SELECT * FROM pr) SELECT (SELECT max(step) FROM p) + 1 AS step, n_nationkey AS node, 0.15 / 25 + 0.85 * (coalesce((SELECT sum(p.r * s) FROM share JOIN p ON share.node = p.node WHERE share.other = n_nationkey), 0) + coalesce((SELECT sum(r) FROM p WHERE node IN (SELECT node FROM loose)), 0) / 25) AS r FROM nation WHERE (SELECT max(step) FROM p) < 20)) SELECT node, round(r, 6) AS score FROM pr WHERE step = 20"


@query(_PR)
def f09_pagerank(spark, d):
    return r6(G.pagerank(_nodes(spark, d), _strong(spark, d)), "score")


@query(f"WITH {_SEDGES}, d AS (SELECT node, count(*) AS degree FROM sends GROUP BY 1) SELECT node, degree, rank FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM d) WHERE rank <= 5")
def f10_top_nodes(spark, d):
    x = G.ends(_strong(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    top = x.orderBy(F.desc("degree"), "node").limit(5)  # five rows a task; the window below sees five
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("degree"), "node")).cast("long"))


_WEAK = "WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey + 100000000 AS b FROM orders), both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ UNION SELECT node, b FROM reach JOIN both_ ON other = a) SELECT node, min(other) AS component FROM reach GROUP BY 1"


@query(_WEAK)
def f12_components(spark, d):
    e = B.t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 100000000).alias("dst"), F.lit(1.0).alias("weight"))
    return G.components(G.ends(e).select("node").distinct(), e)


_TRI = "tri AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM strong a JOIN strong b ON a.dst = b.src JOIN strong x ON x.src = a.src AND x.dst = b.dst), t AS (SELECT node, count(*) AS t FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1), dg AS (SELECT node, count(*) AS d FROM sends GROUP BY 1), cl AS (SELECT n_nationkey AS node, CASE WHEN coalesce(d, 0) < 2 THEN 0.0 ELSE 2.0 * coalesce(t, 0) / (d * (d - 1)) END AS clustering FROM nation LEFT JOIN dg ON dg.node = n_nationkey LEFT JOIN t ON t.node = n_nationkey)"


@query(f"WITH {_SEDGES}, {_TRI} SELECT 25 AS n, (SELECT count(*) FROM strong) AS m, round(2.0 * (SELECT count(*) FROM strong) / (25 * 24), 6) AS density, round(2.0 * (SELECT count(*) FROM strong) / 25, 6) AS avg_degree, round(avg(clustering), 6) AS avg_clustering FROM cl")
def f13_graph_metrics(spark, d):
    return r6(G.summary(_nodes(spark, d), _strong(spark, d)), "density", "avg_degree", "avg_clustering")


@query(f"WITH {_SEDGES}, {_TRI} SELECT node, round(clustering, 6) AS clustering FROM cl")
def f14_clustering(spark, d):
    return r6(G.clustering(_nodes(spark, d), _strong(spark, d)), "clustering")


# --- clusters ---


@query()
def g01_louvain(spark, d):
    return C.louvain(B.graphs(spark, d))


@query(f"WITH {B.EDGES}, {B.PARTITION}, e AS (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges), k AS (SELECT cluster_id, sum(weight) AS k FROM e JOIN part_of USING (node) GROUP BY 1), i AS (SELECT a.cluster_id, 2 * sum(weight) AS w FROM edges JOIN part_of a ON src = a.node JOIN part_of b ON dst = b.node WHERE a.cluster_id = b.cluster_id GROUP BY 1), q AS (SELECT coalesce(w, 0) - k * k / (SELECT 2 * sum(weight) FROM edges) AS q FROM k LEFT JOIN i USING (cluster_id)) SELECT round(sum(q), 6) AS raw_quality, round(sum(q) / (SELECT 2 * sum(weight) FROM edges), 6) AS modularity FROM q")
def g03_modularity(spark, d):
    return r6(C.quality(G.undirected(B.flows(spark, d)), B.partition(spark, d)), "raw_quality", "modularity")


_MET = f"WITH {B.EDGES}, {B.PARTITION}, p AS (SELECT a.cluster_id AS c1, b.cluster_id AS c2, weight FROM edges JOIN part_of a ON src = a.node JOIN part_of b ON dst = b.node), s AS (SELECT c1 AS cluster_id, weight, c1 = c2 AS inside FROM p UNION ALL SELECT c2, weight, false FROM p WHERE c1 <> c2), m AS (SELECT cluster_id, avg(CASE WHEN inside THEN weight END) AS coh, avg(CASE WHEN NOT inside THEN weight END) AS o, sum(CASE WHEN inside THEN 2 * weight ELSE 0 END) AS internal, sum(CASE WHEN inside THEN 0 ELSE weight END) AS cutw FROM s GROUP BY 1), x AS (SELECT cluster_id, (SELECT count(*) FROM part_of q WHERE q.cluster_id = m.cluster_id) AS size, coh, least(1.0, o / coh) AS coup, cutw / internal AS cond FROM m)"


@query(f"{_MET} SELECT cluster_id, size, round(coh, 6) AS cohesion, round(coup, 6) AS coupling, round(coh * (1 - coup), 6) AS score, round(cond, 6) AS conductance FROM x")
def g08_cluster_metrics(spark, d):
    return r6(C.metrics(G.undirected(B.flows(spark, d)), B.partition(spark, d)), "cohesion", "coupling", "score", "conductance")


@query(f"WITH {B.EDGES}, {B.PARTITION} SELECT round(avg(CASE WHEN a.cluster_id = b.cluster_id THEN 1.0 ELSE 0 END), 6) AS coverage FROM edges JOIN part_of a ON src = a.node JOIN part_of b ON dst = b.node")
def g08c_coverage(spark, d):
    return r6(C.coverage(G.undirected(B.flows(spark, d)), B.partition(spark, d)), "coverage")


@query(f"{_MET} SELECT cluster_id, round(0.35 * coh + 0.15 * (1 - coup) + 0.1 * greatest(0, least(1, 1 - abs(size - 6) / 24.0)), 6) AS rank_score, CASE WHEN size > 30 THEN 'too large' WHEN size < 3 THEN 'too small' END AS reject_reason FROM x")
def g09_rank(spark, d):
    m = C.metrics(G.undirected(B.flows(spark, d)), B.partition(spark, d))
    s = C.rank_score(F.lit(0.0), F.col("cohesion"), F.col("coupling"), F.col("size"))
    return r6(m.select("cluster_id", s.alias("rank_score"), C.reject_reason(F.col("size"), F.col("cohesion"), F.lit(0.0)).alias("reject_reason")), "rank_score")


@query(f"{_MET}, y AS (SELECT cluster_id, 5 + CASE WHEN coh > 0.7 THEN 35 WHEN coh > 0.5 THEN 25 WHEN coh > 0.3 THEN 15 ELSE 5 END + CASE WHEN coup < 0.3 THEN 25 WHEN coup < 0.5 THEN 15 WHEN coup < 0.7 THEN 5 ELSE 0 END + CASE WHEN size BETWEEN 3 AND 10 THEN 10 WHEN size > 10 THEN 5 ELSE 0 END AS points FROM x) SELECT cluster_id, points, CASE WHEN points >= 70 THEN 'should' WHEN points >= 40 THEN 'could' ELSE 'potential' END AS tier FROM y")
def g11_tier(spark, d):
    m = C.metrics(G.undirected(B.flows(spark, d)), B.partition(spark, d))
    points, name = C.tier(F.lit(None).cast("double"), F.col("cohesion"), F.col("coupling"), F.col("size"))
    return m.select("cluster_id", points.alias("points"), name.alias("tier"))


# --- features ---


@query("SELECT page_id, 1 + len(regexp_extract_all(html, '\\bfor\\b')) + len(regexp_extract_all(html, '\\bif\\b')) + len(regexp_extract_all(html, '\\bwhile\\b')) + len(regexp_extract_all(html, '\\bcase\\b')) + len(regexp_extract_all(html, '\\bcatch\\b')) + len(regexp_extract_all(html, '\\belse\\s+if\\b')) + len(regexp_extract_all(html, '\\b\\?\\s*')) + len(regexp_extract_all(html, '\\b&&\\b')) + len(regexp_extract_all(html, '\\b\\|\\|\\b')) AS cyclomatic, length(html) - length(replace(html, ';', '')) AS statements FROM pages".replace("\\\\", "\\"))
def h01a_complexity(spark, d):
    return B.t(spark, d, "pages").select("page_id", H.cyclomatic(F.col("html")).alias("cyclomatic"), H.statements(F.col("html")).alias("statements"))


@query("SELECT p_partkey AS id, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def h02_zscore(spark, d):
    return r6(H.normalise(B.t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


@query("SELECT p_partkey AS id, round((p_size - (SELECT quantile_cont(p_size, 0.5) FROM part)) / (SELECT quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) FROM part), 6) AS p_size FROM part")
def h02_robust(spark, d):
    return r6(H.normalise(B.t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), ["p_size"], "robust"), "p_size")


@query("WITH v AS (SELECT var_pop(p_size) AS a, var_pop(p_retailprice) AS b FROM part) SELECT 'p_size' AS feature, round(a / greatest(a, b), 6) AS score FROM v UNION ALL SELECT 'p_retailprice', round(b / greatest(a, b), 6) FROM v")
def h03_importance(spark, d):
    return r6(H.importance(B.t(spark, d, "part"), ["p_size", "p_retailprice"]), "score")


@query()
def h04_silhouette(spark, d):
    e = B.t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return r6(H.silhouette(e), "silhouette")


# --- suggestions ---


@query("WITH w AS (SELECT conv_id AS cluster_id, role AS name, count(*) AS votes, max(length(text) / 1000.0) AS confidence FROM conversations GROUP BY 1, 2), x AS (SELECT *, sum(votes) OVER (PARTITION BY cluster_id) AS total, row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, confidence DESC, name) AS k FROM w) SELECT cluster_id, name, votes, round(votes / total, 6) AS agreement FROM x WHERE k = 1")
def i07_vote(spark, d):
    b = B.t(spark, d, "conversations").select(F.col("conv_id").alias("cluster_id"), F.col("role").alias("name"), (F.length("text") / 1000).alias("confidence"))
    return r6(I.vote(b), "agreement")


@query(f"WITH {B.ACCESSES} SELECT DISTINCT class_id, field FROM accesses a WHERE method % 2 = 0 AND NOT EXISTS (SELECT 1 FROM accesses b WHERE a.class_id = b.class_id AND a.field = b.field AND b.method % 2 = 1)")
def i10_exclusive_fields(spark, d):
    return I.exclusive_fields(B.accesses(spark, d), B.methods(spark, d).filter("method % 2 = 0"))


def _suggestions(spark, d):
    a = B.accesses(spark, d)
    return a.groupBy("class_id", F.col("method").alias("cluster_id")).agg(F.array_sort(F.collect_set("field")).alias("members")).withColumn("confidence", F.size("members") / 25)


@query()
def i04_distinct_suggestions(spark, d):
    return I.distinct_suggestions(_suggestions(spark, d))


@query()
def i05_disjoint_suggestions(spark, d):
    return I.disjoint_suggestions(_suggestions(spark, d))


@query(f"WITH {B.ACCESSES}, s AS (SELECT class_id, method AS cluster_id, count(*) / 25.0 AS confidence FROM accesses GROUP BY 1, 2) SELECT class_id, cluster_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, cluster_id) AS rank FROM s) WHERE rank <= 3")
def i06_limit(spark, d):
    return I.first_per_class(_suggestions(spark, d), 3).select("class_id", "cluster_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {B.ACCESSES}, s AS (SELECT count(*) / 25.0 AS confidence FROM accesses GROUP BY class_id, method) SELECT round(avg(confidence), 6) AS mean, CAST(min(confidence) AS DOUBLE) AS low, CAST(max(confidence) AS DOUBLE) AS high, count(*) FILTER (WHERE confidence >= 0.8) AS strong FROM s")
def i09_confidence(spark, d):
    return r6(I.confidence_summary(_suggestions(spark, d)), "mean")


# --- gates ---


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'FAILED_syntax' WHEN o_totalprice < 1000 THEN 'FAILED_semantic' ELSE 'PASSED_ALL' END AS status FROM orders")
def j01_cascade(spark, d):
    o = B.t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), J.cascade([("syntax", F.col("o_orderstatus") != "F"), ("semantic", F.col("o_totalprice") >= 1000), ("behaviour", F.lit(None).cast("boolean"))]).alias("status"))


@query("WITH a AS (SELECT CAST(l_suppkey AS VARCHAR) AS subject, CASE WHEN l_returnflag = 'R' THEN 'after' ELSE 'before' END AS variant, l_quantity AS t FROM lineitem), s AS (SELECT subject, avg(t) FILTER (variant = 'before') AS b, avg(t) FILTER (variant = 'after') AS a, stddev_samp(t) FILTER (variant = 'before') AS sd FROM a GROUP BY 1) SELECT subject, round((a - b) * 100 / b, 6) AS change, round(sd, 6) AS before_sd FROM s")
def j07_performance(spark, d):
    li = B.t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("subject"), F.when(F.col("l_returnflag") == "R", "after").otherwise("before").alias("variant"), F.col("l_quantity").alias("t"))
    return r6(J.performance(li).select("subject", "change", "before_sd"), "change", "before_sd")


# --- evaluation ---

_BRANDS = "s AS (SELECT s_nationkey AS class_id, list(DISTINCT l_partkey) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"


@query(f"WITH {_BRANDS} SELECT x.class_id AS a, y.class_id AS b, round(len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))), 6) AS jaccard FROM s x JOIN s y ON x.class_id < y.class_id")
def k01_jaccard(spark, d):
    li, s = B.t(spark, d, "lineitem"), B.t(spark, d, "supplier")
    x = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("group"), F.col("l_partkey").alias("item"))
    return r6(K.shared_jaccard(x), "jaccard")


_CONF = "count(*) FILTER (WHERE truth = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE truth = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE truth = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE truth = 0 AND predicted = 0) AS tn"
_PRF = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy"
_INST = f"WITH {B.RATINGS}, c AS (SELECT project, instance, {_CONF} FROM ratings GROUP BY 1, 2), i AS (SELECT *, {_PRF} FROM c)"


def _instances(spark, d):
    return K.prf(K.confusion(B.ratings(spark, d), "project", "instance"))


@query(f"{_INST} SELECT project, instance, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM i")
def k04_metrics(spark, d):
    return r6(_instances(spark, d), "precision", "recall", "f1", "accuracy")


@query(f"{_INST}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf FROM i) SELECT round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(tp / (tp + fp), 6) AS micro_precision, round(tp / (tp + fn), 6) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1 FROM s")
def k06_macro_micro(spark, d):
    return r6(K.macro_micro(_instances(spark, d)), "macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1")


@query(f"{_INST} SELECT project, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM i GROUP BY 1")
def k07_per_project(spark, d):
    return r6(_instances(spark, d).groupBy("project").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))), "precision", "recall", "f1")


_PAIRS = "pr AS (SELECT CAST(l_linenumber AS DOUBLE) AS x, l_quantity / 10 AS y FROM lineitem)"


def _pairs(spark, d):
    return B.t(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("x"), (F.col("l_quantity") / 10).alias("y"))


@query(f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(x - y), 6) AS mean, round(avg(x - y) / stddev_samp(x - y) * sqrt(count(*)), 6) AS t, round(avg(x - y) / stddev_samp(x - y), 6) AS d FROM pr")
def k11_paired_t(spark, d):
    return r6(K.paired_t(_pairs(spark, d)).drop("p"), "mean", "t", "d")


@query(f"WITH {_PAIRS}, z AS (SELECT x - y AS d FROM pr WHERE x <> y), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM z) SELECT count(*) AS n, round(least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END)), 6) AS w FROM r")
def k12_signed_ranks(spark, d):
    return r6(K.signed_ranks(_pairs(spark, d)).select("n", "w"), "w")


@query("WITH x AS (SELECT s_acctbal AS x FROM supplier), y AS (SELECT c_acctbal AS y FROM customer), q AS (SELECT avg(sign(x - y)) AS delta FROM x CROSS JOIN y) SELECT round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS size FROM q")
def k13_cliffs_delta(spark, d):
    return r6(K.cliffs_delta(B.t(spark, d, "supplier").select(F.col("s_acctbal").alias("x")), B.t(spark, d, "customer").select(F.col("c_acctbal").alias("y"))), "delta")


@query("WITH v AS (SELECT s_suppkey AS k, s_acctbal AS v FROM supplier), n AS (SELECT count(*) AS n FROM supplier), b AS (SELECT i // n AS round, ((i * 1103515245 + 12345) % 2147483648) % n AS k FROM n, range(200 * (SELECT n FROM n)) t(i)) SELECT round, round(avg(v), 6) AS mean FROM b JOIN v USING (k) GROUP BY 1")
def k14_bootstrap(spark, d):
    v = B.t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return r6(K.bootstrap(v, 200, v.count()), "mean")


@query("SELECT l_returnflag AS tier, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, quantile_cont(l_quantity, 0.5) AS median, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def k16_descriptive(spark, d):
    return r6(K.described(B.t(spark, d, "lineitem"), "l_quantity", "l_returnflag").withColumnRenamed("l_returnflag", "tier"), "mean", "sd")


@query("SELECT alpha, count(*) AS edges, round(sum(weight), 6) AS total FROM (" + " UNION ALL ".join(f"SELECT {a} AS alpha, * FROM ({_fused_sql(a, 0.05)})" for a in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)) + ") GROUP BY 1")
def k19_alpha_sweep(spark, d):
    s, e, out = G.undirected(B.flows(spark, d)), _evo(spark, d), None
    for a in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0):
        x = r6(G.fuse(s, e, a, 0.05), "weight").withColumn("alpha", F.lit(a))
        out = x if out is None else out.union(x)
    return r6(out.groupBy("alpha").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total")), "total")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def k21_skip_existing(spark, d):
    c, o = B.t(spark, d, "customer").select(F.col("c_custkey").alias("id")), B.t(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return c.join(o, "id", "left_anti")


# --- streaming operators on a table ---


@query("WITH c AS (SELECT DISTINCT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, user_id, event_type FROM events) SELECT a.window_start, a.event_type AS m1, b.event_type AS m2, count(*) AS n FROM c a JOIN c b ON a.window_start = b.window_start AND a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2, 3")
def m01_windowed_cochange(spark, d):
    e = B.t(spark, d, "events").select(F.col("user_id").alias("commit_id"), "ts", F.col("event_type").alias("member"))
    return X.pair_counts(e, length="1 day")


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type AS member, count(*) AS n FROM events GROUP BY 1, 2")
def m02_windowed_counts(spark, d):
    e = B.t(spark, d, "events").select(F.col("user_id").alias("commit_id"), "ts", F.col("event_type").alias("member"))
    return X.member_counts(e, length="7 days")


from weftline.plans import code, measures, more, partitions, review, texts  # noqa: E402,F401  (add their queries to these)
