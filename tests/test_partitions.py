"""Community detection over many graphs, its dispatch, and the extraction of clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import clusters as C
from weftline.operators import extraction as E
from weftline.operators import kernels as K


def random_graph(rng):
    n = int(rng.integers(2, 30))
    edges = {}
    for _ in range(int(rng.integers(1, n * 3))):
        a, b = sorted(rng.integers(0, n, 2).tolist())
        edges[a, b] = float(rng.integers(1, 20)) / 4
    src, dst = map(np.array, zip(*edges, strict=True))
    return src, dst, np.array(list(edges.values()))


@pytest.mark.parametrize("gamma", [0.5, 1.0, 2.0])
def test_leiden_is_connected_and_no_worse_than_louvain(gamma):
    rng = np.random.default_rng(int(gamma * 10))
    for _ in range(80):
        src, dst, weight = random_graph(rng)
        nodes, com, score = K.leiden_partition(src, dst, weight, gamma)
        names, near = K._adjacency(src, dst, weight)
        assert names == nodes and K.split_apart(near, com) == com
        other = dict(zip(*K.louvain_partition(src, dst, weight, gamma), strict=True))
        assert score >= K.quality_of(near, [other[x] for x in nodes], gamma) - 1e-9
        assert score == pytest.approx(K.quality_of(near, com, gamma))
        if gamma == 1.0 and not (src == dst).any():
            assert score / (2 * weight.sum()) == pytest.approx(K.modularity_of(src, dst, weight, dict(zip(nodes, com, strict=True))))


def test_leiden_finds_planted_groups():
    src, dst = map(np.array, zip(*[(10 * g + i, 10 * g + j) for g in range(4) for i in range(6) for j in range(i + 1, 6)], (5, 10), (15, 20), (25, 30), strict=True))
    nodes, com, _ = K.leiden_partition(src, dst, np.ones(len(src)))
    groups = {}
    for n, c in zip(nodes, com, strict=True):
        groups.setdefault(c, set()).add(n // 10)
    assert sorted(groups.values(), key=min) == [{0}, {1}, {2}, {3}]


def test_a_graph_of_loops_or_no_weight():
    assert K.leiden_partition(np.array([1, 2]), np.array([1, 2]), np.array([1.0, 2.0]))[1] == [0, 1]
    assert K.leiden_partition(np.array([1]), np.array([2]), np.array([0.0]))[2] == 0.0


@pytest.fixture(scope="module")
def many(spark):
    edges = [(1, 0, 1, 1.0), (1, 1, 2, 1.0), (1, 0, 2, 1.0), (1, 3, 4, 2.0), (2, 0, 1, 1.0)]
    nodes = [(1, i, f"getA{i}") for i in range(6)] + [(2, 0, "a"), (2, 1, "b")] + [(3, i, f"set{'XY'[i % 2]}") for i in range(4)] + [(4, i, ["getA", "parseB", "Zed", "zed"][min(i // 9, 3)]) for i in range(31)]
    return spark.createDataFrame(nodes, "graph_id long, node long, name string"), spark.createDataFrame(edges, "graph_id long, src long, dst long, weight double")


@pytest.mark.parametrize("options", [{}, {"algorithm": "louvain"}, {"gammas": (1.0, 1.5)}, {"stable": True}])
def test_detect(many, options):
    nodes, edges = many
    got = {(r.graph_id, r.node): (r.community, r.source) for r in C.detect(nodes, edges, **options).collect()}
    assert {n: got[1, n] for n in range(6)} == {0: (0, "communities"), 1: (0, "communities"), 2: (0, "communities"), 3: (3, "communities"), 4: (3, "communities"), 5: (5, "communities")}
    assert got[2, 0] == got[2, 1] == (0, "communities")
    assert {got[3, n] for n in range(4)} == {(0, "single")}
    assert {got[4, n] for n in range(31)} == {(0, "names"), (9, "names"), (18, "names"), (27, "names")}


def test_detect_without_nodes_and_records(spark, many):
    nodes, edges = many
    assert C.detect(nodes.limit(0), edges).count() == 0
    with pytest.raises(ValueError):
        C.detect(nodes, edges, algorithm="other")
    kinds = nodes.withColumn("kind", F.when(F.col("node") == 1, "field"))
    rows = {(r.graph_id, r.community): r for r in C.records(kinds, C.detect(nodes, edges)).collect()}
    r = rows[1, 0]
    assert (r.members, r.methods, r.fields) == (["getA0", "getA1", "getA2"], 2, 1)


def test_apart(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 2, 3, 1.0), (2, 0, 1, 1.0)], "graph_id long, src long, dst long, weight double")
    part = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, 7), (1, 3, 7), (2, 0, 1), (2, 1, 2)], "graph_id long, node long, community long")
    assert {(r.graph_id, r.community): r.parts for r in C.apart(edges, part).collect()} == {(1, 7): 2, (2, 1): 1, (2, 2): 1}


def relations(spark, methods, calls, clusters):
    m = spark.createDataFrame([("c", x, x.split("(")[0], i, p, a) for i, (x, p, a) in enumerate(methods)], "class_id string, method string, name string, ord int, is_private boolean, is_abstract boolean")
    c = spark.createDataFrame([("c", *x) for x in calls], "class_id string, method string, name string")
    k = spark.createDataFrame([("c", *x) for x in clusters], "class_id string, cluster_id long, method string")
    return m, c, k


def settle(spark, methods, calls, clusters, **options):
    m, c, k = relations(spark, methods, calls, clusters)
    members = E.with_helpers(k, m, c, **options)
    found = E.issues(members, m, c, rounds=options.get("rounds", 10))
    return {(r.cluster_id, r.method): r.level for r in members.collect()}, {r.cluster_id: (r.members, r.added, r.errors, r.valid) for r in E.verdicts(members, found).collect()}


def test_helpers_are_included_transitively(spark):
    methods = [("a()", False, False), ("h1()", True, False), ("h2()", True, False), ("abs()", False, True), ("other()", False, False)]
    calls = [("a()", "h1"), ("a()", "other"), ("h1()", "h2"), ("h2()", "h1"), ("h2()", "abs")]
    members, found = settle(spark, methods, calls, [(1, "a()"), (2, "other()"), (3, "gone()")])
    assert members == {(1, "a()"): 0, (1, "h1()"): 1, (1, "h2()"): 2, (2, "other()"): 0, (3, "gone()"): 0}
    assert found == {1: (3, 2, 1, False), 2: (1, 0, 0, True), 3: (1, 0, 0, True)}


def test_overloads_add_the_first(spark):
    methods = [("a()", False, False), ("h(int)", True, False), ("h(long)", True, False)]
    calls = [("a()", "h")]
    assert settle(spark, methods, calls, [(1, "a()")])[0] == {(1, "a()"): 0, (1, "h(int)"): 1}
    assert settle(spark, methods, calls, [(1, "a()"), (1, "h(long)")])[0] == {(1, "a()"): 0, (1, "h(long)"): 0}


def test_a_chain_past_the_rounds_is_not_settled(spark):
    methods = [("a()", False, False), *((f"h{i}()", True, False) for i in range(13)), ("abs()", False, True)]
    calls = [("a()", "h0"), ("a()", "abs"), *((f"h{i}()", f"h{i + 1}") for i in range(12))]
    members, found = settle(spark, methods, calls, [(1, "a()")])
    assert len(members) == 11 and found == {1: (11, 10, 0, True)}
    members, found = settle(spark, methods[:10] + methods[-1:], calls, [(1, "a()")])
    assert len(members) == 10 and found == {1: (10, 9, 1, False)}


def test_finders(spark):
    bodies = spark.createDataFrame([("c", "f()", "void f() { g (1); Inner x = h(Inner.y); }"), ("c", "n()", None), ("c", "m()", "Innermost z;")], "class_id string, method string, body string")
    inner = spark.createDataFrame([("c", "Inner"), ("d", "Innermost")], "class_id string, name string")
    assert {(r.method, r.name) for r in E.named_calls(bodies).collect()} == {("f()", "f"), ("f()", "g"), ("f()", "h")}
    assert {(r.method, r.name) for r in E.references(bodies, inner).collect()} == {("f()", "Inner")}


@pytest.mark.parametrize("row,want", [((2, 2, 9, 1.0, 1.0, 1.0, True), "too small"), ((31, 2, 9, 1.0, 1.0, 1.0, True), "too large"), ((5, 8, 10, 1.0, 1.0, 1.0, True), "whole class"), ((5, 7, 10, 0.3, 1.0, 1.0, True), "low cohesion"), ((5, 7, 10, 0.3, 0.0, 1.0, True), None), ((5, 7, 10, 0.5, 1.0, 0.1, True), "low quality"), ((5, 0, 10, 0.5, 1.0, 0.9, True), "no methods"), ((5, 3, 0, 0.5, 1.0, 0.9, False), "not extractable"), ((5, 3, 10, 0.5, 1.0, 0.9, True), None)])
def test_rejection(spark, row, want):
    df = spark.createDataFrame([row], "size int, m int, c int, coh double, q double, s double, ok boolean")
    assert df.select(E.rejection(*(F.col(c) for c in df.columns), min_quality=0.2)).first()[0] == want
