"""Queries of the source text functions, on texts built from the part table; the SQL has what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import code as C
from weftline.functions import text as T
from weftline.plans import bindings as B
from weftline.plans.registry import query


def _part(spark, d):
    k = F.col("p_partkey")
    return B.t(spark, d, "part").select(k.alias("id"), k.cast("string").alias("p"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("cls"), "p_name", "p_type", "p_brand")


@query(
    """SELECT DISTINCT t AS type, t NOT IN ('Map', 'List', 'String', 'K', 'URI') AS project FROM (SELECT unnest(['Map', 'List', 'String', 'K', 'URI', 'T' || p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2, 2)]) AS t FROM part)"""
)
def c14_project_types(spark, d):
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 2))
    kinds = F.array(*(F.lit(x) for x in ("Map", "List", "String", "K", "URI")), F.concat(F.lit("T"), "p"), name)
    return _part(spark, d).select(F.explode(kinds).alias("type")).distinct().select("type", C.is_project_type(F.col("type")).alias("project"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 'Makes a ' || p_name || ' of v1.5.' END AS summary FROM part")
def c16_javadoc(spark, d):
    own = F.concat(F.lit("    /**\n     * Makes a "), "p_name", F.when(F.col("id") % 3 == 0, F.lit(" of v1.5. And *more*.\n     * @return it\n     */\n    @Deprecated @Named(\"m\")\n    public static <T> Map<K, V[]> m")).otherwise(F.lit("\n     * of v1.5\n     */\n    int m")), "p", F.lit("(int a) {}\n"))
    none = F.concat(F.lit("    /** Of another. */ int x; /* no */\n    void m"), "p", F.lit("() {}\n"))
    text = F.concat(F.lit("/** The file. Its head. */\nclass A {\n    /** First. */ void first() {}\n"), F.when(F.col("id") % 3 == 2, none).otherwise(own), F.lit("}\n"))
    named = C.javadoc_summary(text, F.concat(F.lit("m"), "p"))
    return _part(spark, d).select("id", named.alias("summary"))


@query("SELECT p_partkey AS id, 'test' || p_partkey AS name, ' if (a) { b(\"' || p_name || '\"); ' AS body FROM part UNION ALL SELECT p_partkey, 'other', '' FROM part WHERE p_partkey % 2 = 0")
def c17_test_methods(spark, d):
    text = F.concat(F.lit("class T {\n  void helper() { }\n  @Test(timeout = 3)\n  public void test"), "p", F.lit("() throws A, B { if (a) { b(\""), "p_name", F.lit("\"); } }\n"), F.when(F.col("id") % 2 == 0, "  @Test\n  @Slow void other() {}\n").otherwise(""), F.lit("  void last() {}\n}\n"))
    return _part(spark, d).select("id", F.explode(C.test_methods(text)).alias("t")).select("id", "t.name", "t.body")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'org.p' || p_partkey || '.' ELSE '' END || 'Part' || p_partkey || 'Test' AS name FROM part")
def c18_test_names(spark, d):
    source = F.when(F.col("id") % 2 == 0, F.concat(F.lit("// x\npackage  org.p"), "p", F.lit(" ;\nclass X {}"))).otherwise("class X {}")
    return _part(spark, d).select("id", C.qualified_name(source, F.concat(F.lit("src/test.d/Part"), "p", F.lit("Test.java"))).alias("name"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Item' || p_partkey || ';' ELSE '' END || 'Part' || p_partkey AS missing FROM part")
def c19_missing_types(spark, d):
    code = F.concat(F.lit("List<Item"), "p", F.lit("> a = new ArrayList<>(); MAX = 3; T t; Part"), "p", F.lit("(1); Known (2); Ab = 1;"))
    known = F.when(F.col("id") % 2 == 0, F.array(F.lit("Known"))).otherwise(F.array(F.lit("Known"), F.concat(F.lit("Item"), "p")))
    return _part(spark, d).select("id", F.array_join(C.missing_types(code, known), ";").alias("missing"))


@query(
    """WITH t AS (SELECT p_brand AS class_id, 'T' || p_partkey % 40 AS kind FROM part UNION ALL SELECT p_brand, 'String' FROM part UNION ALL SELECT p_brand, p_brand FROM part)
    SELECT class_id, count(DISTINCT kind) AS cbo FROM t WHERE kind <> 'String' AND kind <> class_id GROUP BY 1"""
)
def d06_project_cbo(spark, d):
    """Coupling over declared types: base types of fields, returns and parameters that may be the project's."""
    from weftline.operators.structure import cbo

    part = _part(spark, d)
    kinds = F.array(F.concat(F.lit("T"), (F.col("id") % 40).cast("string"), F.lit("<String>[]")), F.lit("String"), F.lit("List<X>"), F.lit("int"), F.col("p_brand"), F.lit("BufferedReader"))
    base = part.select(F.col("p_brand").alias("class_id"), F.explode(kinds).alias("kind")).select("class_id", T.base_type(F.col("kind")).alias("type"))
    return cbo(base.filter(C.is_project_type(F.col("type"))))
