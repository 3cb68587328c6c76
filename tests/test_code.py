"""Source text functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import code as C
from weftline.functions import text as T


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


@pytest.mark.parametrize("name,want", [("Order", True), ("Map", False), ("int", False), ("", False), (None, False), ("T", False), ("Tt", True)])
def test_project_type(spark, name, want):
    assert one(spark, C.is_project_type(F.col("c0")), name) is want


@pytest.mark.parametrize("source,name,want", [
    ("/** Does it. Twice. */ void f() {}", "f", "Does it."), ("/** Does it */\n@A @B(\"x\")\nprivate static List<String> f(int a) {}", "f", "Does it."), ("/** A. */ int x;\nvoid f() {}", "f", None),
    ("/** A. */ void g() {}\n/** B\n * c. */ void f() {}", "f", "B c."), ("/* no */ void f() {}", "f", None), ("/** */ void f() {}", "f", None), ("/** a$b */ void a$b() {}", "a$b", "a$b."), ("", "f", None),
])
def test_javadoc_summary(spark, source, name, want):
    assert one(spark, C.javadoc_summary(F.col("c0"), F.col("c1")), source, name) == want


def test_long_comment(spark):
    assert one(spark, C.javadoc_summary(F.col("c0"), F.col("c1")), "/** " + "word * " * 20_000 + "end. */ void f() {}", "f").endswith("end.")


@pytest.mark.parametrize("source,path,want", [("package a.b;", "x/y/CTest.java", "a.b.CTest"), ("class X", "CTest.java", "CTest"), ("", "d.e/f", "f"), ("package a;", ".hidden", "a..hidden")])
def test_qualified_name(spark, source, path, want):
    assert one(spark, C.qualified_name(F.col("c0"), F.col("c1")), source, path) == want


def test_missing_types_and_stubs(spark):
    found = C.missing_types(F.col("c0"), F.array(F.lit("Known")))
    assert one(spark, found, "Order o = new Item(1); List<Part> p; Known k; MAX = 1; Ab(); String s") == ["Item", "Order", "Part"]
    assert one(spark, found, "") == []
    assert one(spark, C.stub(F.col("c0"), F.col("c1")), "Order", "a.b").startswith("package a.b;\n") and "package" not in one(spark, C.stub(F.col("c0"), F.col("c1")), "Order", None)


@pytest.mark.parametrize("text,want", [
    ("", []), ("   ", []), ("int x", ["int"]), ("int x, String y", ["int", "String"]), ("List<String> items", ["List<String>"]), ("Map<String, Integer> map", ["Map<String,Integer>"]),
    ("Map<String, List<Map<K,  V>>> m, int y", ["Map<String,List<Map<K,V>>>", "int"]), ("final @A int x", ["@A int"]), ("@A @B final int x", ["int"]), ("String... rest", ["String[]"]), ("int[] a", ["int[]"]), ("Foo", ["Foo"]), ("var x", ["x"]), ("a, , b", ["a", "b"]), ("int x,", ["int"]),
])
def test_parameter_types(spark, text, want):
    assert one(spark, T.parameter_types(F.col("c0")), text) == want
