"""What is left of a class after an extraction: overloads go with their names, emptied classes stay."""

import pytest

from weftline.operators import structure as D


def test_after_extraction(spark):
    m = spark.createDataFrame([("a", x) for x in ("f(int)", "f(long)", "g()", "h()", "k()")] + [("b", "f()"), ("c", "x()"), ("c", "y()"), ("c", "z()")], "class_id string, method string")
    acc = spark.createDataFrame([("a", "f(long)", "u"), ("a", "g()", "u"), ("a", "h()", "u"), ("a", "k()", "v"), ("b", "f()", "u"), ("c", "x()", "u")], "class_id string, method string, field string")
    chosen = spark.createDataFrame([("a", "f(int)"), ("b", "f()"), ("c", "x()"), ("c", "y()")], "class_id string, method string")
    got = {r.class_id: (r.remaining, r.lcom5, r.tcc) for r in D.after_extraction(m, acc, chosen).collect()}
    assert got["a"] == (3, pytest.approx((3 - 3 / 2) / 2), pytest.approx(1 / 3))
    assert got["b"] == (0, 0.0, 1.0) and got["c"] == (1, 0.0, 1.0)
