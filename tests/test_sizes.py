"""Operators whose cost or result once hung on the size of groups or the order of rows."""

import numpy as np


def test_partitions_do_not_hang_on_the_order_of_edges():
    from weftline.operators.kernels import leiden_partition, louvain_partition

    rng = np.random.default_rng(5)
    for _ in range(20):
        pairs = np.array([(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.15])
        weight = np.ones(len(pairs))
        for f in (leiden_partition, louvain_partition):
            want = f(pairs[:, 0], pairs[:, 1], weight)
            for _ in range(4):
                o = rng.permutation(len(pairs))
                assert f(pairs[o, 0], pairs[o, 1], weight[o]) == want


def test_sources_are_dealt_before_they_are_cut(spark):
    from weftline.operators import javasource as J

    rows = J.declarations(J.blocks(J.tokens(spark.createDataFrame([(1, "class A { int a; }")], "file int, source string"))))
    lines = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x or "Generate" in x]
    assert "Exchange" in lines[-1] and not any("Exchange" in x for x in lines[:-1])


def test_silhouette_of_blocks(spark):
    from weftline.operators import features as H

    rng = np.random.default_rng(3)
    for n, labels in ((2500, 3), (1500, 900), (40, 1), (5, 5)):
        v, label = rng.normal(size=(n, 3)), rng.integers(0, labels, n)
        v[: n // 8] = v[0]  # copies
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
        names, at = np.unique(label, return_inverse=True)
        one = np.eye(len(names))[at]
        sums, count = d @ one, one.sum(0)
        a = sums[np.arange(n), at] / np.maximum(count[at] - 1, 1)
        mean = sums / count
        mean[np.arange(n), at] = np.inf
        b = mean.min(1)
        s = np.where((count[at] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0), (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1), 0.0) if len(names) > 1 else np.zeros(n)
        points = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(label, v, strict=True))], "id long, label int, v array<double>")
        assert abs(H.silhouette(points).first()[0] - s.mean()) < 1e-7


def test_linkage_holds_a_distance_once():
    import tracemalloc

    from weftline.operators.kernels import linkage_groups

    x = np.random.default_rng(1).normal(size=(700, 64))
    tracemalloc.start()
    linkage_groups(x, 8.0)
    assert tracemalloc.get_traced_memory()[1] < 50 * (1 << 20)  # of which 34 MB are for a step of rows; all differences would be 251 MB
    tracemalloc.stop()


def test_nearest_truth_meets_in_members(spark):
    from weftline.operators import evaluate as K

    rows = lambda name, x: spark.createDataFrame(x, f"class_id int, {name} int, members array<string>")
    s = rows("suggestion", [(1, 1, ["a", "b"]), (1, 2, ["q"]), (1, 3, []), (2, 1, []), (2, 2, ["a", None]), (3, 1, ["a"])])
    t = rows("truth", [(1, 5, ["b", "c"]), (1, 4, ["a", "d"]), (1, 9, []), (2, 7, ["z"]), (2, 8, [None])])
    found = K.nearest_truth(s, t)
    got = {tuple(r)[:2]: (r.truth, round(r.similarity, 6)) for r in found.collect()}
    assert got == {(1, 1): (4, 0.333333), (1, 2): (4, 0.0), (1, 3): (9, 1.0), (2, 1): (7, 0.0), (2, 2): (8, 0.5)}
    assert "array_union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_changes_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    from weftline.operators import evolution as V
    from weftline.plans import bindings as B

    monkeypatch.setattr(B, "TASK_ROWS", 300, raising=False)
    rows = V.capped(B.changes(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 300 + 1
    dealt = [x for x in plan.splitlines() if f", {n}), REPARTITION_BY_NUM" in x]
    assert len(dealt) == 2 and sum("SortMergeJoin" in x for x in plan.splitlines()) == 1


def test_suggestions_are_chosen_as_by_the_kernels(spark):
    from weftline.operators import kernels as K
    from weftline.operators import suggest as I

    r, rows = np.random.default_rng(0), []
    for k in range(150):
        base = int(r.integers(0, 5)) * 5
        rows.append((k // 25, k % 25, [None, 0.5, 0.8, float(r.random())][r.integers(0, 4)], sorted({f"x{base + v}" for v in r.integers(0, 7, r.integers(0, 9))})))
    df = spark.createDataFrame(rows, "class_id int, cluster_id int, confidence double, members array<string>")
    for choose, kernel, most in ((I.distinct_suggestions, K.greedy_distinct, 0.5), (I.disjoint_suggestions, K.greedy_disjoint, 0.4)):
        want = []
        for c in range(6):
            of = sorted((x for x in rows if x[0] == c), key=lambda x: (-(x[2] or 0), x[1]))
            want += [x[:2] for x, ok in zip(of, kernel([set(x[3]) for x in of], most), strict=True) if ok]
        found = choose(df, most)
        assert sorted(tuple(x)[:2] for x in found.collect()) == sorted(want)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()  # no class in one task


def test_pairs_are_made_from_one_reading_of_changes(spark):
    from weftline.operators import evolution as V
    from weftline.plans import bindings as B

    rows = V.weighted(B.changes(spark, "/root/testdata/sf0.001"), B.AS_OF)
    plan = V.cochange(rows)._jdf.queryExecution().executedPlan().toString()
    assert sum("lineitem" in x or "[l_orderkey" in x and "FileScan" in x for x in plan.splitlines()) == 1
    few = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (1, "a", 4.0), (1, None, 1.0), (2, "a", 0.5), (2, "b", 8.0), (None, "a", 1.0), (None, "b", 1.0), (3, "c", 1.0)], "commit_id int, member string, w double")
    assert [tuple(x) for x in V.cochange(few).collect()] == [("a", "b", 5.5)]


def test_linkage_of_large_classes_is_that_of_the_kernel(spark, monkeypatch):
    from weftline.operators import clusters as C
    from weftline.operators import kernels as K
    from weftline.operators import linkage as L

    rng = np.random.default_rng(4)
    near = rng.normal(size=64)
    sets = {
        1: np.r_[rng.normal(size=(70, 6)), np.zeros((20, 6)), np.full((9, 6), 3.0)],  # copies
        2: np.r_[near + rng.normal(size=(40, 64)) * 0.08, rng.normal(size=(60, 64))],  # a dense part that grows past a block
        3: rng.integers(0, 60, (70, 1)).astype(float),  # ties
        4: rng.normal(size=(20, 3)),
        None: rng.normal(size=(60, 3)),
    }
    rows = [(c, 1000 - i, v.tolist()) for c, x in sets.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "class_id int, member long, x array<double>").repartition(7)
    monkeypatch.setattr(L, "BLOCK", 16)
    seen = []
    monkeypatch.setattr(L, "blocks_of", lambda *a, f=L.blocks_of: seen.append(f(*a)) or seen[-1])
    got = {}
    for r in C.average_linkage(df, 1.9, most=30).collect():
        got.setdefault(r.class_id, {})[r.member] = r.community
    assert len(seen) > 2 and max(len(r.c) for b in seen for r in b.collect()) < 64  # no class in one task
    for c, x in sets.items():
        want = K.linkage_groups(x[::-1], 1.9)
        assert [got[c][m] for m in sorted(got[c])] == want.tolist(), c
