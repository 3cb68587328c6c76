"""Whether clusters can be taken out of their classes: hidden helpers they need, and what stands against it.

methods has class_id, method (its signature), name, ord (place in the source), is_private,
is_abstract; calls has class_id, method and the name called; clusters has class_id, cluster_id and
method. All clusters of all classes are settled together, a level of helpers a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import cut

CLUSTER = ["class_id", "cluster_id"]


def named_calls(bodies: DataFrame) -> DataFrame:
    """class_id, method, name: names before a parenthesis in bodies (class_id, method, body), its own among them."""
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([a-zA-Z_]\w*)\s*\("), 1))
    return bodies.filter("body is not null").select("class_id", "method", F.explode(names).alias("name"))


def references(bodies: DataFrame, inner: DataFrame) -> DataFrame:
    """class_id, method, name: inner types (class_id, name) whose names are words of a body."""
    words = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\w+"), 0))).alias("name")
    return bodies.filter("body is not null").select("class_id", "method", words).join(inner.select("class_id", "name").distinct(), ["class_id", "name"]).select("class_id", "method", "name")


def helper_edges(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """class_id, method, helper, last: the first private method of a called name, and the last of that name.

    A name counts as already there while the last private method of the name is in the cluster.
    """
    hidden = methods.filter("is_private").groupBy("class_id", "name").agg(F.min_by("method", "ord").alias("helper"), F.max_by("method", "ord").alias("last"))
    return calls.select("class_id", "method", "name").distinct().join(hidden, ["class_id", "name"]).select("class_id", "method", "helper", "last").distinct()


def with_helpers(clusters: DataFrame, methods: DataFrame, calls: DataFrame, rounds: int = 10) -> DataFrame:
    """clusters with level: 0 for their own methods, n for helpers that the n-th round adds.

    Rounds end when none adds anything, or after so many; only a frontier is joined in each. Names whose
    last private method is the cluster's own at the start add nothing. Methods that are not of the
    class call nothing.
    """
    edges = cut(helper_edges(methods, calls.join(methods.select("class_id", "method"), ["class_id", "method"], "left_semi")))
    every = frontier = cut(clusters.select(*CLUSTER, "method").distinct().withColumn("level", F.lit(0)))
    own = every.drop("level").withColumnRenamed("method", "last")
    for level in range(1, rounds + 1):
        step = frontier.drop("level").join(edges, ["class_id", "method"]).join(own, [*CLUSTER, "last"], "left_anti")
        found = step.select(*CLUSTER, F.col("helper").alias("method")).distinct()
        frontier = cut(found.join(every, [*CLUSTER, "method"], "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        every = every.unionByName(frontier)
    return every


def issues(members: DataFrame, methods: DataFrame, calls: DataFrame, inner_references: DataFrame | None = None, rounds: int = 10) -> DataFrame:
    """class_id, cluster_id, severity, issue_type, method, name of members (of with_helpers).

    Calls of abstract names are errors, inner types warnings. Clusters that the last round still
    enlarged have none: they were not settled.
    """
    open_ = members.groupBy(*CLUSTER).agg(F.max("level").alias("most")).filter(F.col("most") >= rounds).select(*CLUSTER)
    settled = members.join(open_, CLUSTER, "left_anti").join(methods.select("class_id", "method"), ["class_id", "method"], "left_semi")
    abstract = methods.filter("is_abstract").select("class_id", "name").distinct()
    wrong = calls.select("class_id", "method", "name").distinct().join(abstract, ["class_id", "name"])
    out = settled.join(wrong, ["class_id", "method"]).select(*CLUSTER, F.lit("error").alias("severity"), F.lit("abstract_method_call").alias("issue_type"), "method", "name")
    if inner_references is not None:
        refs = settled.join(inner_references.select("class_id", "method", "name").distinct(), ["class_id", "method"])
        out = out.unionByName(refs.select(*CLUSTER, F.lit("warning").alias("severity"), F.lit("inner_class_reference").alias("issue_type"), "method", "name"))
    return out


def verdicts(members: DataFrame, found: DataFrame) -> DataFrame:
    """class_id, cluster_id, members, added, errors, warnings, valid (no errors)."""
    n = members.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("level") > 0).alias("added"))
    e = found.groupBy(*CLUSTER).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = n.join(e, CLUSTER, "left").fillna(0, ["errors", "warnings"])
    return joined.withColumn("valid", F.col("errors") == 0)


def rejection(size: Column, methods: Column, class_methods: Column, cohesion: Column, modularity: Column, quality: Column, valid: Column, least: int = 3, most: int = 30, share: float = 0.8, min_cohesion: float = 0.35, min_quality: float = 0.0) -> Column:
    """The first rule that a cluster fails, or null: size, a share of all methods that makes it a
    renamed class, cohesion (where modularity is above 0), quality (where a bound is set), methods at
    all, extraction. A class without methods has no share."""
    return (
        F.when(size < least, "too small")
        .when(size > most, "too large")
        .when((class_methods > 0) & (methods >= share * class_methods), "whole class")
        .when((modularity > 0) & (cohesion < min_cohesion), "low cohesion")
        .when((F.lit(min_quality) > 0) & (quality < min_quality), "low quality")
        .when(methods == 0, "no methods")
        .when(~valid, "not extractable")
    )
