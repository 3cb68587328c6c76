"""Java sources: members, lines, calls and accesses of hand-counted classes."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import javasource as js

SIMPLE = """\
package com.example;

public class SimpleClass {
    private int count;
    private String name;

    public int getCount() {
        return count;
    }

    public void setName(String name) {
        this.name = name;
    }

    public void process() {
        setName("test");
        int c = getCount();
    }
}
"""
RICH = r'''/* class Fake { } */
package org . test.deep;
import java.util.*;
@interface Marker { String value() default "{"; }
@Marker("class X { ;")
public abstract class Outer<T extends Comparable<T>> extends Base<Map<String, T>> implements Runnable, java.io.Serializable, Comparable<Outer<T>> {
    // } a comment; with { braces
    private static final int CONST = 42, LIMIT = f(1, 2), rest[] = {1, 2, 3};
    protected Map<String, List<int[]>> map = new HashMap<String, List<int[]>>() {{ put("a;}", null); }};
    @Deprecated @SuppressWarnings({"unchecked", "a;b{"}) volatile String s = "quote \" } ; {", t;
    char brace = '}', quote = '\'';
    Runnable later = () -> { run(); };
    static { System.out.println("init {"); }

    public Outer(final int x, @Marker("q,(r") String... names) throws Exception {
        this.count = x; }  /* after } */

    public <K extends Comparable<K>, V> Map<K, List<V>> build(Map<K, List<V>> in, int[] sizes, Outer.Inner[][] deep) {
        Runnable r = new Runnable() {
            @Override public void run() { build(in, null, deep); }
        };
        if (a < b && c > d) { return null; }
        helper(1, "x,)y", 'c', g(2, 3));
        return new HashMap<K, List<V>>();
    }
    abstract int size();
    default void helper(int a) {}
    @Override
    public void run() { for (int i = 0; i < LIMIT; i++) { helper(i); this.helper(i); super.toString(); } }
    enum Color { RED(1) { void paint() {} }, GREEN; int shade; Color() {} Color next(int by) { return RED; } }
    record Point(int px, int py) { static int zero = 0; int sum() { return px + py; } }
    interface Shape { double area(); }
    class Inner { private int b; Inner(int b) { this.b = b; } public void innerMethod() {} }
    synchronized void record(Object o) { lambda(x -> { y(x); }, 2); }
}
class Second { int other; }
'''
FILES = [("simple", SIMPLE), ("rich", RICH), ("empty", "public class Empty {}"), ("none", None), ("blank", ""), ("garbage", "not valid java }{"), ("é", "class É { String größe; int länge(String ü) { return größe.length(); } }"), ("fields", "class OnlyFields { private int x; protected double y; public String z; }"), ("only", "interface I { void f(); } enum E { A }")]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(FILES, "file string, source string")


@pytest.fixture(scope="module")
def found(sources):
    return {(r.file, r.owner, r.kind, r.signature): r for r in js.members(sources).collect()}


def test_simple_class(found):
    own = [(k[2], r.name, r.type, r.line, r.end_line) for k, r in found.items() if k[0] == "simple"]
    assert sorted(own) == [("field", "count", "int", 4, 4), ("field", "name", "String", 5, 5), ("method", "getCount", "int", 7, 9), ("method", "process", "void", 15, 18), ("method", "setName", "void", 11, 13)]
    r = found["simple", "SimpleClass", "method", "setName(String)"]
    assert (r.package, r.class_name, r.modifiers) == ("com.example", "SimpleClass", ["public"]) and [tuple(p) for p in r.parameters] == [("name", "String")]
    assert r.body == "public void setName(String name) {\n        this.name = name;\n    }"


def test_files_without_members(found):
    assert {k[0] for k in found} == {"simple", "rich", "é", "fields"}
    assert sorted(k[3] for k in found if k[0] == "é") == ["größe", "länge(String)"]
    assert sorted((k[3], r.type) for k, r in found.items() if k[0] == "fields") == [("x", "int"), ("y", "double"), ("z", "String")]


def test_rich_class(found):
    own = {(k[1], k[2], k[3]): r.type for k, r in found.items() if k[0] == "rich"}
    assert own == {
        ("Outer", "field", "CONST"): "int", ("Outer", "field", "LIMIT"): "int", ("Outer", "field", "rest"): "int",
        ("Outer", "field", "map"): "Map<String,List<int[]>>", ("Outer", "field", "s"): "String", ("Outer", "field", "t"): "String",
        ("Outer", "field", "brace"): "char", ("Outer", "field", "quote"): "char", ("Outer", "field", "later"): "Runnable",
        ("Outer", "constructor", "<init>(int,String[])"): "",
        ("Outer", "method", "build(Map,int[],Outer.Inner[][])"): "Map<K,List<V>>",
        (None, "method", "run()"): "void",
        ("Outer", "method", "size()"): "int", ("Outer", "method", "helper(int)"): "void", ("Outer", "method", "run()"): "void",
        ("Color", "field", "shade"): "int", ("Color", "constructor", "<init>()"): "", ("Color", "method", "next(int)"): "Color",
        ("Point", "field", "zero"): "int", ("Point", "method", "sum()"): "int", ("Shape", "method", "area()"): "double",
        ("Inner", "field", "b"): "int", ("Inner", "constructor", "<init>(int)"): "", ("Inner", "method", "innerMethod()"): "void",
        ("Outer", "method", "record(Object)"): "void",
    }
    at = lambda *k: found[("rich", *k)]
    assert at("Outer", "field", "CONST").modifiers == ["private", "static", "final"]
    assert at("Outer", "field", "s").modifiers == ["@Deprecated", "@SuppressWarnings", "volatile"]
    assert [tuple(p) for p in at("Outer", "constructor", "<init>(int,String[])").parameters] == [("x", "int"), ("names", "String[]")]
    ctor, build, run = at("Outer", "constructor", "<init>(int,String[])"), at("Outer", "method", "build(Map,int[],Outer.Inner[][])"), at("Outer", "method", "run()")
    lines = RICH.split("\n")
    for r, n in ((ctor, 2), (build, 8), (run, 2)):
        assert r.end_line - r.line + 1 == n and r.body.split("\n")[0].strip() == lines[r.line - 1].strip()
    assert at("Outer", "method", "size()").body == "abstract int size();"


def test_types(sources):
    rows = js.blocks(js.tokens(sources))
    t = {(r.file, r.type_name): r for r in js.types(rows, js.declarations(rows)).collect()}
    r = t["rich", "Outer"]
    assert r.package == "org.test.deep"
    assert r["extends"] == "Base<Map<String,T>>" and r.implements == ["Runnable", "java.io.Serializable", "Comparable"] and r.order == 0
    assert {n for f, n in t if f == "rich"} == {"Marker", "Outer", "Color", "Point", "Shape", "Inner", "Second", None}
    assert t["only", "I"].order is None


def test_own_members_only(sources):
    got = {r.signature for r in js.members(sources.filter("file = 'rich'"), inner=False).collect()}
    assert "innerMethod()" not in got and "area()" not in got and "size()" in got and "record(Object)" in got


def test_calls_and_accesses(spark, sources):
    m = js.members(sources)
    bodies = m.filter("kind <> 'field' and owner = 'Outer' or owner = 'SimpleClass' and kind <> 'field'")
    got = sorted((r.signature, r.place, r.name, r.argc) for r in js.calls(bodies).collect())
    by = lambda s: [(n, a) for x, _, n, a in got if x == s]
    assert by("process()") == [("setName", 1), ("getCount", 0)]
    assert by("build(Map,int[],Outer.Inner[][])") == [("run", 0), ("build", 3), ("helper", 4), ("g", 2)]
    assert by("run()") == [("helper", 1), ("helper", 1), ("toString", 0)]
    assert by("record(Object)") == [("lambda", 2), ("y", 1)]
    acc = {(r.signature, r.field) for r in js.accesses(bodies.filter("file = 'simple'"), m.filter("kind = 'field'")).collect()}
    assert acc == {("getCount()", "count"), ("setName(String)", "name")}


def test_internal_calls(spark):
    calls = spark.createDataFrame([("f", "a()", 5, "b", 1), ("f", "a()", 3, "b", 2), ("f", "a()", 9, "c", 0), ("f", "a()", 1, "b", 2), ("f", "a()", 2, "other", 0), ("f", "a()", 7, "b", None), ("g", "a()", 1, "b", 1)], "file string, signature string, place long, name string, argc int")
    methods = spark.createDataFrame([("f", "b", "b(int)", 1), ("f", "b", "b(int,int)", 2), ("f", "b", "b(int,String)", 2), ("f", "c", "c()", 0), ("g", "c", "c()", 0)], "file string, name string, signature string, n_params int")
    got = js.internal_calls(calls, methods).orderBy("place").collect()
    assert [(r.target, r.place) for r in got] == [("b", 1), ("b(int)", 5), ("c()", 9)]


def test_counts(sources):
    r = js.parse_counts(sources, js.members(sources)).first()
    assert (r.files, r.parsed, r.failed) == (9, 4, 5) and abs(r.rate - 4 / 9) < 1e-12


def test_long_literals(spark):
    text = "class A { String s = \"" + "x\\n" * 30_000 + "\"; int f() { /*" + "y" * 100_000 + "*/ return 1; } }"
    rows = js.members(spark.createDataFrame([("a", text)], "file string, source string")).select("signature", F.length("body").alias("n")).collect()
    assert sorted(r.signature for r in rows) == ["f()", "s"]
