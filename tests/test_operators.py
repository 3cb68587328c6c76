"""Hand-checked values, identities and invariants of the operators."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import clusters as C
from weftline.operators import evaluate as K
from weftline.operators import evolution as V
from weftline.operators import graph as G
from weftline.operators import kernels
from weftline.operators import structure as D
from weftline.operators import suggest as I
from weftline.sources import files, gitlog
from weftline.streaming import cochange as X


def one(spark, expr, **cols):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items()))
    return df.select(expr).first()[0]


@pytest.mark.parametrize("name,want", [("getUserName", ["get", "user", "name"]), ("URL", []), ("get_user", ["get", "user"]), ("a", [])])
def test_camel_tokens(spark, name, want):
    assert one(spark, T.camel_tokens(F.col("s")), s=name) == want


def test_text(spark):
    assert one(spark, T.base_type(F.col("s")), s="List<String>[]") == ""
    assert one(spark, T.base_type(F.col("s")), s="Account<String>[]") == "Account"
    assert not one(spark, T.valid_class_name(F.col("s")), s="Impl") and one(spark, T.valid_class_name(F.col("s")), s="Class")
    assert one(spark, T.called_names(F.col("s")), s="default (x); instanceof (y)") == ["instanceof"]
    assert one(spark, T.base_type(F.col("s")), s="INT") == ""
    assert one(spark, T.strip_declaration(F.col("s")), s="void a() { b(); { } }") == " b(); { } "
    assert one(spark, T.strip_declaration(F.col("s")), s="no body") == "no body"
    assert one(spark, T.called_names(F.col("s")), s="if (a(b)) { c (1); a(2); }") == ["a", "c"]
    assert one(spark, T.tag(F.col("s"), "n"), s="x <n> y\nz </n>") == "y\nz"
    assert one(spark, T.answer_line(F.col("s"), "VALID"), s="x\nVALID: yes ") == "yes"
    assert one(spark, T.truncated(F.col("s"), 8), s="abcdef\nghijk") == "abcdef"
    assert one(spark, T.bare_name(F.col("s")), s="int f(long)") == "f"
    assert not one(spark, T.valid_class_name(F.col("s")), s="Manager")


def test_hunks(spark):
    df = spark.createDataFrame([("a", "@@ -1 +10,5 @@ x\n@@ -9,2 +22,1 @@\n@@ -3 +5 @@"), ("b", "")], "commit_id string, diff string")
    assert sorted((r.start, r.stop) for r in V.hunks(df).collect()) == [(5, 5), (10, 14), (22, 22)]


def metric(spark, f, methods, accesses):
    m = spark.createDataFrame([("c", x) for x in methods], "class_id string, method string")
    a = spark.createDataFrame([("c", x, y) for x, y in accesses], "class_id string, method string, field string")
    return f(m, a).first()[1]


@pytest.mark.parametrize("methods,accesses,want", [("ab", [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], 0.0), ("ab", [("a", "x"), ("b", "y")], 1.0), ("a", [("a", "x")], 0.0), ("ab", [], 0.0), ("abc", [("a", "x"), ("a", "y"), ("b", "x"), ("c", "y")], 0.5)])
def test_lcom5(spark, methods, accesses, want):
    assert metric(spark, D.lcom5, methods, accesses) == pytest.approx(want)


@pytest.mark.parametrize("methods,accesses,want", [("ab", [("a", "x"), ("b", "x")], 1.0), ("ab", [("a", "x"), ("b", "y")], 0.0), ("abc", [("a", "x"), ("b", "x"), ("c", "y")], 1 / 3), ("a", [], 0.0)])
def test_tcc(spark, methods, accesses, want):
    assert metric(spark, D.tcc, methods, accesses) == pytest.approx(want)


def test_coupling(spark):
    pairs = spark.createDataFrame([("f(int)", "f(long)", 5.0), ("a", "b", 5.0)], "m1 string, m2 string, cochange double")
    counts = spark.createDataFrame([(m, 10) for m in ("f(int)", "f(long)", "a", "b")], "member string, n int")
    assert {r.m1: r.coupling for r in V.coupling(pairs, counts, 0.0).collect()} == {"f(int)": 0.25, "a": 0.5}
    assert V.coupling(pairs, counts, 0.4).count() == 1


def test_weights(spark):
    rows = spark.createDataFrame([("a", "2000-01-01 00:00:00"), ("b", None)], "k string, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    got = {r[0]: r[1] for r in rows.select("k", V.recency_weight(F.col("ts"), "2000-12-26 00:00:00", 0.8)).collect()}
    assert got["a"] == pytest.approx(0.8) and got["b"] == 0.5
    assert one(spark, V.basket_weight(F.col("n")), n=2) == pytest.approx(0.70710678)


def graph(spark, *edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")


def test_fusion(spark):
    s, e = graph(spark, (1, 2, 0.8)), graph(spark, (1, 2, 4), (2, 3, 1))
    none = graph(spark, (0, 0, 0)).limit(0)
    assert G.fuse(s, none, 0.6, 0.1).first().weight == 0.8
    assert G.fuse(none, graph(spark, (1, 2, 1)), 0.6, 0.1).first().weight == pytest.approx(0.4)
    assert {r.weight for r in G.fuse(s, e, 1.0, 0.5).collect()} == {1.0}
    assert G.fuse(s, e, 0.0, 0.0).count() == 2
    assert G.fuse(none, none).count() == 0


def test_components_and_louvain(spark):
    e = graph(spark, (1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 0.1))
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    assert {r.node: r.component for r in G.components(nodes, e).collect()} == {**dict.fromkeys(range(1, 7), 1), 7: 7}
    part = C.louvain(e.withColumn("graph_id", F.lit(0).cast("long")))
    groups = {}
    for r in part.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6]]
    q = C.quality(e, part.select("node", F.col("community").alias("cluster_id"))).first()
    assert q.modularity > 0.4
    assert G.clustering(nodes, e).filter("node = 1").first().clustering == 1.0


def test_betweenness():
    import numpy as np

    nodes, score = kernels.brandes(np.array([1, 2]), np.array([2, 3]), np.array([1.0, 1.0]))
    assert dict(zip(nodes, score, strict=True)) == {1: 0.0, 2: 1.0, 3: 0.0}


def test_greedy():
    assert kernels.greedy_distinct([{1, 2, 3}, {1, 2, 3}, {4}]) == [True, False, True]
    assert kernels.greedy_disjoint([{1, 2, 3, 4, 5}, {5, 6, 7, 8, 9}, {1, 2}]) == [True, True, False]


def test_evaluate(spark):
    e = F.array().cast("array<int>")
    assert one(spark, K.jaccard(e, e), s=1) == 1.0
    assert one(spark, K.jaccard(e, F.array(F.lit(1))), s=1) == 0.0
    x = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "x double, y double")
    assert tuple(K.signed_ranks(x).select("n", "w").first()) == (2, 1.0)
    assert K.paired_t(x.select("x", F.col("x").alias("y"))).first().t == 0.0
    assert kernels.wilcoxon_normal(20.0, 22, []) < 0.001


def test_auto_name(spark):
    assert one(spark, I.auto_name(F.array(F.lit("readFile"), F.lit("readLine"))), s=1) == "ReadOperations"
    assert one(spark, I.auto_name(F.array(F.lit("open"), F.lit("close"))), s=1) == "OpenGroup"


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    pick = lambda df: df.select(F.col("user_id").alias("commit_id"), "ts", F.col("event_type").alias("member"))
    batch = spark.read.parquet(src)
    folder = tmp_path / "in"
    batch.write.parquet(str(folder))
    stream = pick(spark.readStream.schema(batch.schema).parquet(str(folder)))
    got = X.run_available(X.member_counts(stream, "1 day"), "counts", str(tmp_path / "ck"))
    want = X.member_counts(pick(batch), "1 day")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert X.bursts(pick(batch)).agg(F.sum("n")).first()[0] == batch.count()


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"commits": [{"sha1": "s", "refactorings": [{"type": "Extract Class", "description": "d", "extractedMembers": [{"name": "m"}]}, {"type": "Move"}]}]}')
    assert files.refactorings(spark, str(tmp_path / "r.json")).first().members == ["m"]
    (tmp_path / "inst").mkdir()
    (tmp_path / "inst" / "oracle.csv").write_text("1,f,2,3,1\n2,g,4\n3,h,5,6,0\n")
    assert [r.instance for r in files.oracle_members(spark, str(tmp_path / "inst")).collect()] == ["inst", "inst"]
    nodes, e = spark.createDataFrame([(1,), (2,)], "node long"), graph(spark, (1, 2, 0.5))
    for form in ("csv", "json", "graphml", "gml", "dot", "adjlist"):
        files.export_graph(nodes, e, str(tmp_path / form), form)
    assert spark.read.text(str(tmp_path / "dot")).count() == 5
    with pytest.raises(ValueError):
        files.export_graph(nodes, e, str(tmp_path / "x"), "x")


def test_git_source(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    for k in range(2):
        (tmp_path / "f.txt").write_text("a\n" * (k + 1))
        run("add", ".")
        run("commit", "-m", str(k))
    rows = gitlog.read_git(spark, [str(tmp_path)]).collect()
    assert sorted(r.root for r in rows) == [False, True] and {r.file for r in rows} == {"f.txt"}


def test_argument_count(spark):
    from weftline.functions.text import argument_count

    want = {"": 0, "  ": 0, "a": 1, "a, b": 2, "f(a, b), c": 2, '"x,y", z': 2, "'\\',', z": 2, "new int[]{1, 2}, Map<K, V> m": 2}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", argument_count(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == want


def test_greedy_match(spark):
    from weftline.operators import evaluate as K

    s = spark.createDataFrame([("x", 1, 1, ["a", "b", "c"]), ("x", 1, 2, ["a", "b"]), ("x", 1, 3, ["z"]), ("y", 1, 2, ["a", "b"])], "tool string, class_id int, suggestion int, members array<string>")
    t = spark.createDataFrame([(1, 7, ["a", "b"]), (1, 8, ["b", "c"]), (2, 9, ["q"])], "class_id int, truth int, members array<string>")
    got = {(r.tool, r.suggestion): r.truth for r in K.greedy_match(s, t, 0.5).collect()}
    assert got == {("x", 1): 7, ("x", 2): None, ("x", 3): None, ("y", 2): 7}
    counts = {r.tool: (r.tp, r.fp, r.fn) for r in K.matched_counts(K.greedy_match(s, t, 0.5), t).collect()}
    assert counts == {"x": (1, 2, 2), "y": (1, 0, 2)}
    assert K.greedy_match(s.limit(0), t).count() == 0


def test_linkage_groups():
    import numpy as np

    from weftline.operators.kernels import linkage_groups

    assert linkage_groups(np.array([[0.0], [1.0], [10.0], [11.0], [30.0]]), 5).tolist() == [0, 0, 1, 1, 2]
    assert linkage_groups(np.array([[0.0]]), 5).tolist() == [0]
    # 1 and 2 merge first (1 apart), then 0 joins them at a mean distance of 2.5
    assert len(set(linkage_groups(np.array([[0.0], [2.0], [3.0]]), 2.4).tolist())) == 2
    assert len(set(linkage_groups(np.array([[0.0], [2.0], [3.0]]), 2.6).tolist())) == 1


def two_cliques(spark):
    e = [(0, a + o, b + o, 1.0) for o in (0, 4) for a in range(4) for b in range(a + 1, 4)] + [(0, 3, 4, 0.1)]
    return spark.createDataFrame(e, "graph_id long, src long, dst long, weight double")


def test_consensus_and_resolutions(spark):
    from weftline.operators import clusters as C

    rows = C.consensus(two_cliques(spark)).collect()
    label = {r.node: r.community for r in rows}
    assert len(set(label.values())) == 2 and label[0] == label[3] != label[4] == label[7] and {r.stability for r in rows} == {1.0}
    best = C.multi_resolution(two_cliques(spark)).collect()
    assert len({r.gamma for r in best}) == 1 and len({r.community for r in best}) == 2


def test_random_groups(spark):
    from weftline.operators import clusters as C

    m = spark.createDataFrame([(c, i) for c, n in ((1, 18), (2, 2), (3, 21)) for i in range(n)], "class_id int, method int")
    sizes = sorted((r.class_id, r["count"]) for r in C.random_groups(m).groupBy("class_id", "cluster_id").count().collect())
    assert sizes == [(1, 8), (1, 10), (2, 2), (3, 5), (3, 8), (3, 8)]


def test_helper_closure_ends_in_cycles(spark):
    from weftline.operators import suggest as I

    calls = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (1, "c", "open"), (1, "open", "d"), (2, "a", "b")], "class_id int, src string, dst string")
    hidden = spark.createDataFrame([(1, "b"), (1, "c"), (1, "d")], "class_id int, method string")
    got = I.helper_closure(spark.createDataFrame([(1, "a"), (2, "a")], "class_id int, method string"), calls, hidden).collect()
    assert sorted((r.class_id, r.method) for r in got) == [(1, "a"), (1, "b"), (1, "c"), (2, "a")]


def test_eigenvector(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0), (1, 7, 8, 2.0)], "graph_id long, src long, dst long, weight double")
    got = {(r.graph_id, r.node): r.score for r in G.eigenvector(edges).collect()}
    assert got[0, 2] == pytest.approx(2**-0.5, abs=1e-4) and got[0, 1] == pytest.approx(0.5, abs=1e-4) and got[1, 7] == pytest.approx(got[1, 8])
    assert G.eigenvector(edges, most=1).count() == 0


def test_suggestion(spark):
    made = lambda s: one(spark, T.suggestion(F.col("s")), s=s)
    assert made("<class_name>Impl</class_name><rationale>x</rationale>") is None and made("<class_name>Store</class_name>") is None
    assert made("<class_name>Store</class_name><rationale>x</rationale><confidence>7</confidence>").confidence == 1.0
    assert made("<class_name>Store</class_name><rationale>x</rationale>").confidence is None
