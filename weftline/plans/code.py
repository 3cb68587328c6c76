"""Queries over Java sources that are built from the part table: a class of eight parts each.

The SQL never sees the sources: it lists what each part wrote into its class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import history as H
from weftline.operators import javasource as J
from weftline.operators.lineage import cut
from weftline.plans import bindings as B
from weftline.plans.registry import query

FIELD = "    private static final Map<String, List<Integer>> F{p} = new HashMap<>(), G{p};\n"
#: What a part adds after its field, by its key modulo 3.
TEXTS = (
    FIELD + '    @Deprecated\n    public <T extends Comparable<T>> List<T> m{p}(final int a, Map<String, List<T>> b, String... rest) {{\n        // }} "\n        return m{q}(F{p}, "x,)y", \'c\');\n    }}\n',
    FIELD + "    void m{p}(int a) {{ if (a > {z}) {{ m{p}(a - 1); m{o}(a, null, \"s\"); g(1, f(2, 3)); }} }}\n",
    FIELD + "    C{k}(T{p}[] a) {{\n        this.G{p} = a;\n    }}\n    abstract int n{p}();\n",
)


def _filled(template: str) -> F.Column:
    """The template as a column: {p} the part's key, {q} and {o} the next and the one before, {z} its size, {k} its class."""
    import re

    values = {"p": F.col("p"), "q": F.col("p") + 1, "o": F.col("p") - 1, "z": F.col("p_size"), "k": F.col("k")}
    parts = re.split(r"\{(\w)\}", template)
    return F.concat(*(values[x].cast("string") if i % 2 else F.lit(x.replace("{{", "{").replace("}}", "}")) for i, x in enumerate(parts)))


def sources(spark, d) -> DataFrame:
    """file, source: class k holds the parts with keys 8 k to 8 k + 7."""
    part = B.t(spark, d, "part").select(F.col("p_partkey").alias("p"), "p_size", F.expr("p_partkey div 8").alias("k"))
    text = F.when(F.col("p") % 3 == 0, _filled(TEXTS[0])).when(F.col("p") % 3 == 1, _filled(TEXTS[1])).otherwise(_filled(TEXTS[2]))
    bodies = part.select("k", F.struct("p", text.alias("t")).alias("x")).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("t"))
    k = F.col("k").cast("string")
    head = F.concat(F.lit("package org.p"), k, F.lit(";\n\n/* class Not"), k, F.lit(" { */\npublic class C"), k, F.lit(" extends Base<C"), k, F.lit("> implements Runnable {\n"))
    return bodies.select(F.col("k").alias("file"), F.concat(head, "t", F.lit("}\n")).alias("source"))


PARTS = """parts AS (SELECT p_partkey AS p, p_size AS z, p_partkey // 8 AS k, p_partkey % 3 AS v,
  5 + coalesce(sum(CASE p_partkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 5 END) OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM part)"""
MEMBERS = f"""{PARTS}, found AS (
  SELECT k, 'field' AS kind, 'F' || p AS name, 'F' || p AS signature, 'Map<String,List<Integer>>' AS type, 'private,static,final' AS modifiers, line, line AS end_line FROM parts
  UNION ALL SELECT k, 'field', 'G' || p, 'G' || p, 'Map<String,List<Integer>>', 'private,static,final', line, line FROM parts
  UNION ALL SELECT k, 'method', 'm' || p, 'm' || p || '(int,Map,String[])', 'List<T>', '@Deprecated,public', line + 1, line + 5 FROM parts WHERE v = 0
  UNION ALL SELECT k, 'method', 'm' || p, 'm' || p || '(int)', 'void', '', line + 1, line + 1 FROM parts WHERE v = 1
  UNION ALL SELECT k, 'constructor', 'C' || k, '<init>(T' || p || '[])', '', '', line + 1, line + 3 FROM parts WHERE v = 2
  UNION ALL SELECT k, 'method', 'n' || p, 'n' || p || '()', 'int', 'abstract', line + 4, line + 4 FROM parts WHERE v = 2)"""


@query(f"WITH {MEMBERS} SELECT k AS file, 'org.p' || k AS package, 'C' || k AS class_name, 'C' || k AS owner, kind, name, signature, type, modifiers, line, end_line FROM found")
def c01_members(spark, d):
    m = J.members(sources(spark, d))
    return m.select("file", "package", "class_name", "owner", "kind", "name", "signature", "type", F.array_join("modifiers", ",").alias("modifiers"), "line", "end_line")


@query("SELECT p_partkey // 8 AS file, 'C' || p_partkey // 8 AS type_name, 'org.p' || p_partkey // 8 AS package, 'Base<C' || p_partkey // 8 || '>' AS extends, 'Runnable' AS implements, 'public' AS modifiers FROM part GROUP BY p_partkey // 8")
def c02_types(spark, d):
    t = J.types(None, cut(J.declarations(J.blocks(J.tokens(sources(spark, d))))))
    return t.select("file", "type_name", "package", "extends", F.array_join("implements", ",").alias("implements"), F.array_join("modifiers", ",").alias("modifiers"))


@query("SELECT count(DISTINCT p_partkey // 8) AS files, count(DISTINCT p_partkey // 8) AS parsed, 0 AS failed, 1.0 AS rate FROM part")
def c04_parse_counts(spark, d):
    s = sources(spark, d)
    return J.parse_counts(s, J.members(s))


CALLED = f"""{PARTS}, called AS (
  SELECT k, 'm' || p || '(int,Map,String[])' AS signature, 'm' || (p + 1) AS name, 3 AS argc FROM parts WHERE v = 0
  UNION ALL SELECT k, 'm' || p || '(int)', 'm' || p, 1 FROM parts WHERE v = 1
  UNION ALL SELECT k, 'm' || p || '(int)', 'm' || (p - 1), 3 FROM parts WHERE v = 1
  UNION ALL SELECT k, 'm' || p || '(int)', 'g', 2 FROM parts WHERE v = 1
  UNION ALL SELECT k, 'm' || p || '(int)', 'f', 2 FROM parts WHERE v = 1)"""


@query(f"WITH {CALLED} SELECT k AS file, signature, name, argc FROM called")
def c09_calls(spark, d):
    return J.calls(J.members(sources(spark, d)).filter("kind <> 'field'")).select("file", "signature", "name", "argc")


@query(f"WITH {PARTS} SELECT k AS file, 'm' || p || '(int,Map,String[])' AS signature, 'F' || p AS field FROM parts WHERE v = 0 UNION ALL SELECT k, '<init>(T' || p || '[])', 'G' || p FROM parts WHERE v = 2")
def c11_accesses(spark, d):
    m = J.members(sources(spark, d))
    return J.accesses(m.filter("kind <> 'field'"), m.filter("kind = 'field'"))


@query(
    f"""WITH {CALLED}, own AS (SELECT k, 'm' || p AS name, 'm' || p || CASE v WHEN 0 THEN '(int,Map,String[])' ELSE '(int)' END AS to_, CASE v WHEN 0 THEN 3 ELSE 1 END AS n FROM parts WHERE v < 2)
    SELECT DISTINCT c.k AS file, c.signature, CASE WHEN o.n = c.argc THEN o.to_ ELSE c.name END AS target FROM called c JOIN own o ON o.k = c.k AND o.name = c.name"""
)
def c12_internal_calls(spark, d):
    m = J.members(sources(spark, d)).filter("kind <> 'field'")
    names = m.select("file", "name", "signature", F.size("parameters").alias("n_params"))
    return J.internal_calls(J.calls(m), names).select("file", "signature", "target")


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 4
    WHEN 0 THEN 'Map<String,List<T' || p_size || '>>;int[];String[]' WHEN 1 THEN 'T' || p_partkey || ';Map.Entry<K,V>' WHEN 2 THEN '' ELSE 'List<A,B,C' || p_size || '>[];x' END AS types FROM part"""
)
def c07_parameter_types(spark, d):
    part = B.t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("p"), F.col("p_size").cast("string").alias("z"))
    text = (
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("@Nullable final Map<String,  List<T"), "z", F.lit(">> a"), "p", F.lit(", int[] b , String... rest")))
        .when(F.col("id") % 4 == 1, F.concat(F.lit(" T"), "p", F.lit("  a,Map.Entry<K, V> e")))
        .when(F.col("id") % 4 == 2, F.lit(" "))
        .otherwise(F.concat(F.lit("var List<A, B,  C"), "z", F.lit(">... v, x")))
    )
    return part.select("id", F.array_join(T.parameter_types(text), ";").alias("types"))


# a lineitem is a commit that touches the class of its part: the first of an order a root, the second adds the file
_LOG = """log AS (SELECT l_orderkey * 10 + l_linenumber AS commit_id, l_partkey // 8 AS k, l_shipdate AS ts, l_linenumber = 1 AS root, l_linenumber = 2 AS added,
  l_linenumber * 5 AS from_line, l_linenumber * 5 + CAST(l_quantity AS INTEGER) % 12 - 1 AS to_line FROM lineitem)"""


def _log(spark, d):
    li = B.t(spark, d, "lineitem")
    k = F.expr("cast(l_partkey div 8 as string)")
    diff = F.format_string("@@ -1,2 +%d,%d @@ x", F.col("l_linenumber") * 5, F.col("l_quantity").cast("int") % 12)
    return li.select(F.lit("r").alias("repository"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("commit_id"), F.col("l_shipdate").alias("ts"), (F.col("l_linenumber") == 1).alias("root"), k.alias("file"), diff.alias("diff"), k.alias("blob"), F.when(F.col("l_linenumber") != 2, k).alias("old_blob"))


@query(
    f"""WITH {MEMBERS}, {_LOG}, m AS (SELECT * FROM found WHERE kind <> 'field'), roots AS (SELECT commit_id, l.k, ts, signature FROM log l JOIN m ON m.k = l.k WHERE root),
    met AS (SELECT DISTINCT commit_id, l.k, ts, signature FROM log l JOIN m ON m.k = l.k WHERE NOT root AND NOT added AND end_line >= from_line AND line <= to_line),
    few AS (SELECT commit_id, k FROM met GROUP BY 1, 2 HAVING count(*) <= 3)
    SELECT commit_id, CAST(k AS VARCHAR) AS file, ts, signature AS member FROM (SELECT * FROM roots UNION ALL SELECT met.* FROM met JOIN few USING (commit_id, k))"""
)
def b03_method_changes(spark, d):
    lines = H.method_lines(sources(spark, d).select(F.col("file").cast("string").alias("blob"), "source"))
    return H.method_changes(_log(spark, d), lines, 3).drop("repository")
