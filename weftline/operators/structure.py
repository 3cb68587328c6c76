"""Dependency weights and class metrics over members, accesses and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dependency_weights(calls: DataFrame, ambiguous: DataFrame, accesses: DataFrame, call: float = 1.0, access: float = 0.8, shared: float = 0.9) -> DataFrame:
    """class_id, src, dst, weight: the largest of call, ambiguous call (a fifth), access, shared field."""
    a = accesses.select("class_id", F.col("method").alias("src"), F.col("field").alias("dst"))
    b = a.withColumnRenamed("src", "other")
    both = a.join(b, ["class_id", "dst"]).filter("src <> other").select("class_id", "src", F.col("other").alias("dst")).distinct()
    edges = calls.select("class_id", "src", "dst", F.lit(call).alias("weight"))
    for rows, w in ((ambiguous, call * 0.2), (a, access), (both, shared)):
        edges = edges.unionByName(rows.select("class_id", "src", "dst", F.lit(w).alias("weight")))
    return edges.filter("src <> dst").groupBy("class_id", "src", "dst").agg(F.max("weight").alias("weight"))


def lcom5(methods: DataFrame, accesses: DataFrame) -> DataFrame:
    """(m - accesses / fields) / (m - 1) within 0..1; 0 for one method or no field."""
    m = methods.groupBy("class_id").agg(F.count(F.lit(1)).alias("m"))
    a = accesses.distinct().groupBy("class_id").agg(F.count(F.lit(1)).alias("ma"), F.countDistinct("field").alias("a"))
    x = (F.col("m") - F.try_divide(F.col("ma"), F.col("a"))) / F.nullif(F.col("m") - 1, F.lit(0))
    guard = (F.col("m") <= 1) | F.coalesce(F.col("a"), F.lit(0)).eqNullSafe(0)
    return m.join(a, "class_id", "left").select("class_id", F.when(guard, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).alias("lcom5"))


def tcc(methods: DataFrame, accesses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Connected pairs of methods over all pairs; connected by a shared field or a call."""
    a = accesses.select("class_id", F.col("method").alias("m1"), "field")
    pairs = a.join(a.withColumnRenamed("m1", "m2"), ["class_id", "field"]).filter("m1 < m2").select("class_id", "m1", "m2")
    if calls is not None:
        pairs = pairs.union(calls.filter("src <> dst").select("class_id", F.least("src", "dst"), F.greatest("src", "dst")))
    n = pairs.distinct().groupBy("class_id").agg(F.count(F.lit(1)).alias("c"))
    m = methods.groupBy("class_id").agg(F.count(F.lit(1)).alias("m"))
    return m.join(n, "class_id", "left").select("class_id", F.coalesce(F.try_divide(F.coalesce("c", F.lit(0)), F.col("m") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("tcc"))


def cbo(types: DataFrame) -> DataFrame:
    """Distinct project types each class names, itself aside (class_id, type)."""
    return types.filter("type <> '' and type <> class_id").groupBy("class_id").agg(F.countDistinct("type").alias("cbo"))


def instability(efferent: DataFrame, afferent: DataFrame) -> DataFrame:
    """Ce / (Ca + Ce); 0 where both are 0."""
    j = efferent.join(afferent, "class_id", "full")
    ce, ca = F.coalesce("ce", F.lit(0)), F.coalesce("ca", F.lit(0))
    return j.select("class_id", ce.alias("ce"), ca.alias("ca"), F.coalesce(F.try_divide(ce, ca + ce), F.lit(0.0)).alias("instability"))


def field_sharing_ratio(accesses: DataFrame) -> DataFrame:
    """For each method the mean share of other methods that use its fields."""
    users = F.count(F.lit(1)).over(Window.partitionBy("class_id", "field")) - 1
    m = accesses.select("class_id", "method").distinct().groupBy("class_id").agg(F.count(F.lit(1)).alias("m"))
    x = accesses.withColumn("others", users).groupBy("class_id", "method").agg(F.count(F.lit(1)).alias("fields"), F.sum("others").alias("others"))
    return x.join(m, "class_id").select("class_id", "method", "fields", (F.col("others") / (F.col("fields") * F.greatest(F.lit(1), F.col("m") - 1))).alias("shared_ratio"))


def after_extraction(methods: DataFrame, accesses: DataFrame, chosen: DataFrame) -> DataFrame:
    """class_id, remaining, lcom5, tcc of what is left without the chosen methods and all others of their
    names (overloads go too); below two methods, or with none left, 0 and 1."""
    name = F.substring_index(F.col("method").cast("string"), "(", 1)
    gone = chosen.select("class_id", name.alias("name")).distinct()
    without = lambda rows: rows.withColumn("name", name).join(gone, ["class_id", "name"], "left_anti").drop("name")
    left, used = without(methods), without(accesses)
    n = methods.select("class_id").distinct().join(left.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")), "class_id", "left").fillna(0, ["n"])
    j = n.join(lcom5(left, used), "class_id", "left").join(tcc(left, used), "class_id", "left")
    few = F.col("n") < 2
    return j.select("class_id", F.col("n").alias("remaining"), F.when(few, 0.0).otherwise(F.col("lcom5")).alias("lcom5"), F.when(few, 1.0).otherwise(F.col("tcc")).alias("tcc"))


def extraction_coverage(methods: DataFrame, chosen: DataFrame) -> DataFrame:
    """class_id, coverage: chosen methods in per cent of all."""
    j = methods.distinct().join(chosen.distinct().withColumn("taken", F.lit(1)), ["class_id", "method"], "left")
    return j.groupBy("class_id").agg((100 * F.count("taken") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("coverage"))


def strengths(pairs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Each pair (src, dst) with the weight of its dependency, 0 where there is none."""
    return pairs.join(dependencies.select("src", "dst", "weight"), ["src", "dst"], "left").fillna(0.0, ["weight"])


def cohesion(methods: DataFrame, accesses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """class_id, lcom5, tcc."""
    return lcom5(methods, accesses).join(tcc(methods, accesses, calls), "class_id")


def class_metrics(methods: DataFrame, accesses: DataFrame, efferent: DataFrame, afferent: DataFrame) -> DataFrame:
    """Cohesion, coupling (ce, ca, instability) and numbers of methods and fields of each class with methods."""
    counts = methods.groupBy("class_id").agg(F.countDistinct("method").alias("num_methods"))
    fields = accesses.groupBy("class_id").agg(F.countDistinct("field").alias("num_fields"))
    joined = cohesion(methods, accesses).join(counts, "class_id").join(fields, "class_id", "left")
    coupled = joined.join(instability(efferent, afferent), "class_id", "left")
    return coupled.fillna(0, ["num_fields", "ce", "ca"]).fillna(0.0, ["instability"])
