"""Line folds, features, containing names, running sums, p-values, variants and stage reports."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import probability as P
from weftline.operators import containing as N
from weftline.operators import evaluate as K
from weftline.operators import features as H
from weftline.operators import grid as R
from weftline.operators.prefix import ranked, running_sums


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in row.items()))
    return df.select(column).first()[0]


@pytest.mark.parametrize("body,cognitive,deep", [
    ("", 0, 0), ("x = 1;", 0, 0), ("if (a) b();", 1, 0), ("void f() {\n  if (a) {\n    for (;;) {\n      g();\n    }\n  } else if (b) { }\n}", 3 + 4 + 2 * 2, 3),
    ("} } while (x) {", 0, 1), ("switch (x) {\ncase 1: {\ncase 2: } }", 3 + 1, 2),
])
def test_nesting(spark, body, cognitive, deep):
    r = one(spark, H.nesting(F.col("b")), b=body)
    assert (r.cognitive, r.max_depth) == (cognitive, deep)


@pytest.mark.parametrize("body,n", [("", 0), ("a\n\n  \t\nb", 2), ("// c\n  //d\na // e", 1), ("/* x\ny\n*/ z\na", 1), ("a /* b\nc\n\nd */\ne", 1), ("/* one line */\nx", 1), ("/*\n// */\nx\n/* y", 1)])
def test_source_lines(spark, body, n):
    assert one(spark, H.source_lines(F.col("b")), b=body) == n


def test_local_variables_and_signature(spark):
    assert one(spark, H.local_variables(F.col("b")), b="int a = 1; String s; s = t; long a; return x; Map m= y; List<String> l = z;") == 3
    df = spark.createDataFrame([("void", ["public", "static"], [1, 2]), ("", [], []), ("int", ["@Override", "private"], None)], "k string, m array<string>, p array<int>")
    got = [r[0] for r in df.select(H.signature_measures(F.col("k"), F.col("m"), F.col("p"))).collect()]
    assert [(r.num_parameters, r.is_void, r.is_public, r.is_private, r.is_static) for r in got] == [(2, True, True, False, True), (0, False, False, False, False), (0, False, False, True, False)]


def test_features_and_vectors(spark):
    m = spark.createDataFrame([("c", "a()", "void", ["static"], "a() { if (x) y = 1; }"), ("c", "b()", "int", [], "b() { }"), ("c", "d()", "int", [], "int d();")], "class_id string, method string, type string, modifiers array<string>, body string").withColumn("parameters", F.array().cast("array<string>"))
    acc = spark.createDataFrame([("c", "a()", "x"), ("c", "a()", "y"), ("c", "b()", "x")], "class_id string, method string, field string")
    calls = spark.createDataFrame([("c", "b()", "a()"), ("c", "b()", "a()")], "class_id string, method string, target string")
    rows = H.method_features(m, acc, calls)
    got = {r.method: r for r in rows.collect()}
    assert (got["a()"].complexity, got["a()"].field_usage, got["a()"].shared_fields, got["a()"].is_static, got["a()"].is_void) == (2, 2, 1 / 4, 1, 1)
    assert (got["b()"].method_calls, got["b()"].shared_fields, got["d()"].field_usage, got["d()"].shared_fields) == (1, 1 / 2, 0, 0)
    x = {r.member: r.x for r in H.feature_vector(rows, ("loc", "nothing", "field_usage")).collect()}
    assert x["a()"] == [1.0, 0.0, 2.0] and len(H.feature_vector(rows).first().x) == 8


def test_containing(spark):
    random.seed(4)
    names = ["", None, "a", "ab", "abc", "abcd", "zz", "漢", "bca", "%", "_b"] + ["".join(random.choices("abc", k=random.randint(1, 6))) for _ in range(40)]
    texts = ["", None, "x", "_b%", "漢字"] + ["".join(random.choices("abc", k=random.randint(1, 12))) for _ in range(120)]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in texts], "text string")
    found = N.containing(n, t)
    assert sorted(map(tuple, found.collect())) == sorted({(x, y) for x in names for y in texts if x and y and x in y})
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert N.containing(n.limit(0), t).count() == 0


def test_afferent_and_truth(spark):
    types = spark.createDataFrame([("Order", "List<Item>"), ("Order", "Item[]"), ("ItemList", "Item"), ("Item", "Item"), ("X", "int"), ("X", None)], "class_id string, type string")
    names = spark.createDataFrame([("Item",), ("Order",), ("ItemList",), ("It",)], "name string")
    assert {r.name: r.ca for r in N.afferent(types, names).collect()} == {"Item": 2, "Order": 0, "ItemList": 0, "It": 3}
    truth = spark.createDataFrame([(1, "org.Items", ["a", "b"]), (2, "org.Item", ["a"]), (3, "org.Other", ["a"])], "truth long, source_class string, members array<string>")
    suggested = spark.createDataFrame([("t", "Item", 1, ["a"]), ("t", "Item", 2, ["a", "b"]), ("t", "Zed", 1, ["a"])], "tool string, class_id string, suggestion long, members array<string>")
    matched = {(r.class_id, r.suggestion): r.truth for r in K.greedy_match(suggested, N.truth_for(suggested, truth), 0.5).collect()}
    assert matched == {("Item", 1): 2, ("Item", 2): 1, ("Zed", 1): None}


def test_running_sums(spark):
    random.seed(9)
    rows = [(random.randint(0, 50), i, random.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(7)
    for ranges in (None, 13):
        got = {(r.k, r.i): (r.before_v, r["rank"]) for r in ranked(running_sums(df, [F.desc("k"), F.col("i")], ["v"], ranges), [F.desc("k"), F.col("i")], ranges=ranges).collect()}
        total = 0
        for place, (k, i, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])), 1):
            assert got[k, i] == (total, place)
            total += v or 0
    assert running_sums(df.limit(0), [F.col("k")], ["v"]).count() == 0


#: Student's distribution: two-sided 0.05 and 0.001 points of printed tables, and closed forms for 1 and 2 degrees.
@pytest.mark.parametrize("t,df,p", [(12.706204736, 1, 0.05), (4.302652730, 2, 0.05), (2.228138852, 10, 0.05), (2.042272456, 30, 0.05), (3.646, 30, 0.001), (4.586894, 10, 0.001)])
def test_t_tables(t, df, p):
    assert P.t_two_sided(np.array([t, -t]), np.array([df, df])) == pytest.approx([p, p], rel=2e-4)


def test_t_closed_forms():
    for t in (0.0, 1e-6, 0.3, 1.0, 7.5, 1e4):
        one_, two, four = (float(P.t_two_sided(np.array([t]), np.array([d]))[0]) for d in (1, 2, 4))
        assert one_ == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-9)
        assert two == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-9)
        s = t / math.sqrt(4 + t * t)
        assert four == pytest.approx(1 - s * (1 + (1 - s * s) / 2), abs=1e-9)
    assert np.isnan(P.t_two_sided(np.array([1.0]), np.array([0.0]))[0])


def test_rank_sums_are_counted_out():
    for n in range(2, 13):
        sums = sorted(sum(k + 1 for k in range(n) if m >> k & 1) for m in range(1 << n))
        for w in range(n * (n + 1) // 4 + 1):
            want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
            assert P.signed_rank_p(n, w, 0) == pytest.approx(want, abs=1e-12)
    # printed table: the greatest w with a two-sided p of 0.05 or less
    for n, w in {6: 0, 8: 3, 10: 8, 15: 25, 20: 52, 25: 89, 30: 137}.items():
        assert P.signed_rank_p(n, w, 0) <= 0.05 < P.signed_rank_p(n, w + 1, 0)
    assert P.signed_rank_p(1, 0, 0) == 1.0 and P.signed_rank_p(40, 410, 0) == 1.0
    assert P.signed_rank_p(50, 400, 0) == pytest.approx(P.signed_rank_p(50, 400, 1e-9), rel=0.05)


def test_signed_ranks_and_paired_t(spark):
    x = [(g, float(a), 0.0) for g, values in {"u": [1, -2, 3, 4, 0, 5], "v": [1, 1, -1], "w": [2]}.items() for a in values]
    df = spark.createDataFrame(x, "g string, x double, y double")
    got = {r.g: r for r in K.signed_ranks(df, "g").collect()}
    assert (got["u"].n, got["u"].w, got["u"].ties, got["u"].p) == (5, 2.0, 0.0, pytest.approx(2 * 3 / 32))
    assert (got["v"].n, got["v"].w, got["v"].ties) == (3, 2.0, 24.0) and (got["w"].n, got["w"].p) == (1, 1.0)
    whole = K.signed_ranks(df).first()
    assert whole.n == 9 and 0 < whole.p < 1
    t = {r.g: r for r in K.paired_t(df, "g").collect()}
    d = np.array([1, -2, 3, 4, 0, 5.0])
    assert t["u"].t == pytest.approx(d.mean() / d.std(ddof=1) * math.sqrt(6)) and t["u"].p == pytest.approx(0.1496, abs=1e-4)
    assert (t["w"].t, t["w"].p) == (0.0, None)


def test_shared_jaccard(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "c"), (3, "z")], "group long, item string")
    assert {(r.a, r.b): r.jaccard for r in K.shared_jaccard(df).collect()} == {(1, 2): 1 / 3, (1, 3): 0.0, (2, 3): 0.0}


def test_variants(spark):
    base = {"a": {"x": 1, "y": {"z": 2}}, "b": 3}
    assert R.merged(base, {"a": {"y": {"z": 5}}, "b": {"c": 1}, "d": 4}) == {"a": {"x": 1, "y": {"z": 5}}, "b": {"c": 1}, "d": 4}
    assert base == {"a": {"x": 1, "y": {"z": 2}}, "b": 3}
    out = R.run_variants(base, {"full": {}, "half": {"b": 6}}, {"n": spark.range(12)}, lambda i, p: i["n"].filter(f"id % {p['b']} = 0").agg(F.count(F.lit(1)).alias("c")))
    assert {r.variant: r.c for r in out.collect()} == {"full": 4, "half": 2}
    assert {r.variant: (r.runs, r.change) for r in R.against(out, "c").collect()} == {"full": (1, 0.0), "half": (1, -50.0)}
    with pytest.raises(ValueError):
        R.run_variants(base, {}, {}, None)


def test_stage_report(spark):
    base, report = tempfile.mkdtemp(), R.StageReport("r")
    out = report.write("one", spark.range(10), f"{base}/one", most=F.max("id"))
    assert out.count() == 10
    report.event("e", "x")
    with pytest.raises(Exception, match="."):
        report.write("two", spark.range(3).select(F.raise_error(F.lit("no"))), f"{base}/two")
    got = {(r.stage, r.measure): r.value for r in report.report(spark).collect()}
    assert (got["one", "rows"], got["one", "most"], got["", "stages"], got["", "events"], got["", "failures"]) == (10.0, 9.0, 1.0, 1.0, 1.0) and got["one", "seconds"] > 0
