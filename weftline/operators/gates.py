"""Verification gates as expressions over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(layers: list[tuple[str, Column]]) -> Column:
    """FAILED_<layer> of the first layer that is false; null (skipped) passes; else PASSED_ALL."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(True)), F.lit(f"FAILED_{name}")) for name, ok in layers), F.lit("PASSED_ALL"))


def test_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """test, verdict: missing, changed or same (test, passed)."""
    j = before.join(after.withColumnRenamed("passed", "now"), "test", "left")
    return j.select("test", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("passed"), "changed").otherwise("same").alias("verdict"))


def quality_delta(bugs: Column, smells: Column, complexity: Column, strict: bool = False) -> tuple[Column, Column]:
    """Points lost and whether the gate passes."""
    return -10 * bugs - 2 * smells - complexity, (bugs <= 0) & (smells <= (0 if strict else 2)) & (complexity <= 5)


def performance(rows: DataFrame, most: float = 5.0) -> DataFrame:
    """Run times of each subject (subject, variant, t): means, sample deviations, per cent change."""
    s = rows.groupBy("subject").agg(*(f(F.when(F.col("variant") == v, F.col("t"))).alias(f"{v}_{n}") for v in ("before", "after") for n, f in (("mean", F.avg), ("median", F.median), ("sd", F.stddev_samp), ("low", F.min), ("high", F.max))))
    change = F.try_divide((F.col("after_mean") - F.col("before_mean")) * 100, F.col("before_mean"))
    return s.withColumn("change", change).withColumn("passed", F.col("change") <= most)


def override(static_ok: Column, valid: Column, confidence: Column, least: float = 0.7) -> Column:
    return static_ok | (F.coalesce(valid, F.lit(False)) & (F.coalesce(confidence, F.lit(0.0)) >= least))


#: What a missing class path makes a compiler say, matched as plain text in lower case.
CLASS_PATH_ERRORS = (
    "cannot find symbol", "does not exist", "package .* does not exist", "does not override or implement", "does not take parameters",
    "is not abstract and does not override", "unreported exception", "cannot access", "cannot be accessed from outside", "has private access",
    "is not public", "non-static .* cannot be referenced", "method does not override", "cannot infer type", "raw type", "unchecked",
    "uses or overrides a deprecated",
)


def true_errors(log: Column) -> Column:
    """Lines of a compiler's log that report an error other than a missing class path."""
    def counts(line):
        low = F.lower(line)
        known = F.lit(False)
        for p in CLASS_PATH_ERRORS:
            known = known | low.contains(p)
        return low.contains("error:") & ~known

    return F.filter(F.split(log, "\n"), counts)


def delegates(body: Column) -> Column:
    """Whether a method body is one statement that calls another object's method."""
    inner = F.regexp_extract(body, r"(?s)^[^{]*\{\s*(.*?)\s*\}\s*;?\s*$", 1)
    return F.coalesce(inner.rlike(r"^(return\s+)?(this\.)?\w+\.\w+\([^;]*\)\s*;?$"), F.lit(False))


def chosen_tests(tests: DataFrame, least: int = 1) -> DataFrame:
    """target, tier, n, seconds: the surest tier (target, tier, test, n_methods) that has least tests or more.

    Tiers: 1 calls, 2 imports, 3 names, 4 package. Files without a known count are taken as ten methods.
    """
    n = F.sum(F.when(F.coalesce("n_methods", F.lit(0)) > 0, F.col("n_methods")).otherwise(10))
    t = tests.distinct().groupBy("target", "tier").agg(F.count(F.lit(1)).alias("n"), (30 + 2 * n).alias("seconds")).filter(F.col("n") >= least)
    return t.groupBy("target").agg(F.min(F.struct("tier", "n", "seconds")).alias("m")).select("target", "m.*")


def extraction_gate(chosen: DataFrame, original: DataFrame, new: DataFrame, left: DataFrame) -> DataFrame:
    """class_id, missing, lost, doubled: chosen names (class_id, name) not in the original class, not in
    the new one, or still in what is left of the original beyond its other overloads."""
    count = lambda rows, c: rows.groupBy("class_id", "name").agg(F.count(F.lit(1)).alias(c))
    j = count(chosen, "k")
    for rows, c in ((original, "o"), (new, "w"), (left, "m")):
        j = j.join(count(rows, c), ["class_id", "name"], "left").withColumn(c, F.coalesce(c, F.lit(0)))
    allowed = F.greatest(F.col("o") - F.col("k"), F.lit(0))
    return j.groupBy("class_id").agg(F.count_if(F.col("o") == 0).alias("missing"), F.count_if(F.col("w") == 0).alias("lost"), F.count_if(F.col("m") > allowed).alias("doubled"))


def equivalence(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: tests, passed before and after, differences, and whether behaviour is the same (no tests: yes)."""
    d = test_differences(before, after).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("verdict") != "same").alias("differences"))
    return d.crossJoin(before.agg(F.count_if("passed").alias("passed_before"))).crossJoin(after.agg(F.count_if("passed").alias("passed_after"))).withColumn("equivalent", F.col("differences") == 0)


def all_versions(results: DataFrame) -> DataFrame:
    """item, passed: whether every version's run passed; a missing compiler (null) counts as passed."""
    return results.groupBy("item").agg(F.bool_and(F.coalesce("passed", F.lit(True))).alias("passed"))


def status_lists(rows: DataFrame) -> DataFrame:
    """The rows of both lists: verified (verified, also after a repair) and rejected (any status but verified
    or none; one verified after a repair is in both)."""
    verified = rows.filter(F.col("status").isin("verified", "verified_after_repair")).withColumn("list", F.lit("verified"))
    rejected = rows.filter(F.col("status").isNotNull() & (F.col("status") != "verified")).withColumn("list", F.lit("rejected"))
    return verified.unionByName(rejected)
