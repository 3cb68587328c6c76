"""Scoring against truth: set similarity, precision and recall, non-parametric statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    t, p = F.col("truth") == 1, F.col("predicted") == 1
    return rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def prf(c: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy of counts; 0 where a denominator is."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def macro_micro(instances: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    x = instances.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), *sums)
    m = prf(x)
    return m.select("macro_precision", "macro_recall", "macro_f1", F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"), F.col("f1").alias("micro_f1"))


def signed_ranks(pairs: DataFrame, *by: str) -> DataFrame:
    """by, n, w, ties, p: non-zero differences (x - y) of each group, the smaller sum of their average
    ranks, the sum of t^3 - t over tied sizes, and the two-sided p (see functions.probability).

    Equal sizes are counted first, so that ranks run over distinct sizes; without groups they run in
    ranges, not in one task.
    """
    from weftline.functions.probability import signed_rank_p_value
    from weftline.operators.prefix import running_sums

    d = pairs.select(*by, (F.col("x") - F.col("y")).alias("d")).filter("d <> 0")
    g = d.groupBy(*by, F.abs("d").alias("a")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    if by:
        before = F.sum("c").over(Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
        g = g.withColumn("before_c", F.coalesce(before, F.lit(0)))
    else:
        g = running_sums(g, [F.col("a")], ["c"])
    r = g.withColumn("rank", F.col("before_c") + (F.col("c") + 1) / 2)
    up, down, c = F.sum(F.col("rank") * F.col("up")), F.sum(F.col("rank") * (F.col("c") - F.col("up"))), F.col("c").cast("double")
    s = r.groupBy(*by).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.least(up, down).alias("w"), F.coalesce(F.sum(c * c * c - c), F.lit(0.0)).alias("ties"))
    return s.withColumn("p", signed_rank_p_value("n", "w", "ties"))


def cliffs_delta(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """(more - less) / (nx * ny) by counts of values: pairs meet as distinct values in order, never as rows."""
    from weftline.operators.prefix import running_sums

    a = xs.groupBy(F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("cx"))
    b = ys.groupBy(F.col("y").alias("v")).agg(F.count(F.lit(1)).alias("cy"))
    j = a.join(b, "v", "full").select("v", F.coalesce("cx", F.lit(0)).alias("cx"), F.coalesce("cy", F.lit(0)).alias("cy"))
    below = running_sums(j, [F.col("v")], ["cy"])
    t = below.agg(F.sum(F.col("cx") * F.col("before_cy")).alias("more"), F.sum(F.col("cx") * F.col("cy")).alias("equal"), F.sum("cx").alias("nx"), F.sum("cy").alias("ny"))
    less = F.col("nx") * F.col("ny") - F.col("more") - F.col("equal")
    d = (F.col("more") - less) / (F.col("nx") * F.col("ny"))
    return t.select(d.alias("delta")).withColumn("size", effect("delta"))


def effect(delta: str) -> Column:
    a = F.abs(F.col(delta))
    return F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium").otherwise("large")


def described(rows: DataFrame, value: str, *by: str, sample: bool = False) -> DataFrame:
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), sd.alias("sd"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def bootstrap(values: DataFrame, rounds: int, n: int) -> DataFrame:
    """round, mean of n draws from values (k 0..n-1, v): draw i of round r is k = a linear congruence of both."""
    spark = values.sparkSession
    draws = spark.range(rounds * n).select((F.col("id") / n).cast("long").alias("round"), F.pmod((F.col("id") * 1103515245 + 12345) % 2147483648, F.lit(n)).alias("k"))
    return draws.join(values, "k").groupBy("round").agg(F.avg("v").alias("mean"))


def bootstrap_interval(means: DataFrame, values: DataFrame, share: float = 0.95) -> DataFrame:
    """mean of values (v), and the percentiles of bootstrap means (mean) that hold that share between them."""
    edge = (1 - share) / 2
    q = means.agg(F.percentile("mean", F.array(F.lit(edge), F.lit(1 - edge))).alias("q"))
    return values.agg(F.avg("v").alias("mean")).join(F.broadcast(q)).select("mean", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))


def shared_jaccard(rows: DataFrame) -> DataFrame:
    """a < b and the Jaccard similarity of the items of every two groups (group, item): shared items are
    counted by joining on them, and pairs that share none are 0. Groups must be few; items need not."""
    x = rows.select("group", "item").distinct()
    n = x.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    both = x.select(F.col("group").alias("a"), "item").join(x.select(F.col("group").alias("b"), "item"), "item").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    one, other = n.select(F.col("group").alias("a"), F.col("n").alias("na")), n.select(F.col("group").alias("b"), F.col("n").alias("nb"))
    pairs = one.join(other, F.col("a") < F.col("b")).join(both, ["a", "b"], "left")
    c = F.coalesce("c", F.lit(0))
    return pairs.select("a", "b", (c / (F.col("na") + F.col("nb") - c)).alias("jaccard"))


def mismatch(j: Column, methods: Column, size: Column) -> Column:
    """Why a suggestion misses: by similarity, then by its share of methods."""
    share = F.try_divide(methods, size)
    return F.when(j >= 0.8, "naming_only").when(j < 0.3, "no_match").when((share > 0.7) | (share < 0.3), "behavioral_vs_data").otherwise("partial")


def paired_t(pairs: DataFrame, *by: str) -> DataFrame:
    """by, n, mean difference, t, Cohen's d (both 0 without spread) and the two-sided p of each group (1
    without spread and difference, null below two pairs)."""
    from weftline.functions.probability import t_p_value

    d = pairs.select(*by, (F.col("x") - F.col("y")).alias("d")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    zero = F.coalesce(F.col("sd"), F.lit(0.0)) == 0
    cohen = F.when(zero, 0.0).otherwise(F.try_divide("mean", "sd"))
    t = cohen * F.sqrt("n")
    return d.select(*by, "n", "mean", t.alias("t"), cohen.alias("d"), t_p_value(t, (F.col("n") - 1).cast("double")).alias("p"))


def greedy_match(suggested: DataFrame, truth: DataFrame, least: float = 0.8) -> DataFrame:
    """tool, class_id, suggestion, truth, similarity: each suggestion in order takes the most similar truth
    of its class not yet taken, if that is least or more; else it stays without one.

    suggested (tool, class_id, suggestion, members), truth (class_id, truth, members). Only pairs that
    share a member meet; a task holds one class's suggestions of one tool.
    """
    a, b = suggested.withColumn("m", F.explode("members")), truth.select("class_id", "truth", F.size("members").alias("nt"), F.explode("members").alias("m"))
    met = a.select("tool", "class_id", "suggestion", F.size("members").alias("ns"), "m").join(b, ["class_id", "m"]).groupBy("tool", "class_id", "suggestion", "truth", "ns", "nt").agg(F.count(F.lit(1)).alias("both"))
    near = met.select("tool", "class_id", "suggestion", "truth", (F.col("both") / (F.col("ns") + F.col("nt") - F.col("both"))).alias("similarity"))
    rows = suggested.select("tool", "class_id", "suggestion").join(near, ["tool", "class_id", "suggestion"], "left")
    kind = dict(rows.dtypes)

    def run(pdf):
        taken, out = set(), []
        for (s,), g in pdf.sort_values(["suggestion", "similarity", "truth"], ascending=[True, False, True]).groupby(["suggestion"], sort=True):
            free = g[g["similarity"].notna() & ~g["truth"].isin(taken)]
            hit = len(free) and free["similarity"].iloc[0] >= least
            if hit:
                taken.add(free["truth"].iloc[0])
            out.append((pdf["tool"].iloc[0], pdf["class_id"].iloc[0], s, free["truth"].iloc[0] if hit else None, free["similarity"].iloc[0] if hit else None))
        import pandas as pd

        return pd.DataFrame(out, columns=["tool", "class_id", "suggestion", "truth", "similarity"]).astype({"truth": object})

    return rows.groupBy("tool", "class_id").applyInPandas(run, f"tool {kind['tool']}, class_id {kind['class_id']}, suggestion {kind['suggestion']}, truth {kind['truth']}, similarity double")


def matched_counts(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """tool, tp, fp, fn of greedy matches; truth of classes no tool suggests for counts as missed."""
    n = truth.agg(F.count(F.lit(1)).alias("n"))
    m = matches.groupBy("tool").agg(F.count("truth").alias("tp"), F.count_if(F.col("truth").isNull()).alias("fp"))
    return m.crossJoin(n).select("tool", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"))


def nearest_truth(suggested: DataFrame, truth: DataFrame) -> DataFrame:
    """suggestion, truth, similarity: the most similar truth of the class (ties: the first), shared or not.

    Sets meet in the members that they share, never as pairs of sets; a suggestion that shares none has
    the class's first truth at 0, or, if empty itself, the first empty one at 1.
    """
    key = ["class_id", "suggestion"]
    sets = lambda rows, name, size: rows.select("class_id", name, F.array_distinct("members").alias("m")).select("class_id", name, F.size("m").alias(size), "m")
    s, t = sets(suggested, "suggestion", "ns"), sets(truth, "truth", "nt")
    a, b = s.select(*key, "ns", F.explode("m").alias("x")), t.select("class_id", "truth", "nt", F.explode("m").alias("y"))
    met = a.alias("a").join(b.alias("b"), (F.col("a.class_id") == F.col("b.class_id")) & F.col("x").eqNullSafe(F.col("y")))
    both = met.groupBy("a.class_id", "suggestion", "truth", "ns", "nt").agg(F.count(F.lit(1)).alias("both"))
    similarity = F.col("both") / (F.col("ns") + F.col("nt") - F.col("both"))
    best = both.groupBy(*key).agg(F.max(F.struct(similarity.alias("similarity"), (-F.col("truth")).alias("k"))).alias("best"))
    first = t.groupBy("class_id").agg(F.min(F.when(F.col("nt") == 0, F.col("truth"))).alias("empty"), F.min(F.when(F.col("nt").isNotNull(), F.col("truth"))).alias("known"), F.min("truth").alias("first"))
    x = s.select(*key, "ns").distinct().join(first, "class_id").join(best, key, "left")
    none = (F.col("ns") == 0) & F.col("empty").isNotNull()
    unknown = F.col("ns").isNull() | F.col("known").isNull()
    found = F.when(F.col("best").isNotNull(), -F.col("best.k")).when(none, F.col("empty")).when(unknown, F.col("first")).otherwise(F.col("known"))
    return x.select(*key, found.alias("truth"), F.when(F.col("best").isNotNull(), F.col("best.similarity")).when(none, 1.0).when(~unknown, 0.0).alias("similarity"))


def at_thresholds(nearest: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.8)) -> DataFrame:
    """threshold, tp, fp of nearest similarities."""
    x = nearest.select("similarity", F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    return x.groupBy("threshold").agg(F.count_if(F.col("similarity") >= F.col("threshold")).alias("tp"), F.count_if(F.col("similarity") < F.col("threshold")).alias("fp"))


def ratings_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, quartile range, mean, sample deviation, range and acceptance (4 or more, 3 or more) of 1..5 ratings."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*by).agg(q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg((F.col(value) >= 4).cast("int")).alias("at_least_4"), F.avg((F.col(value) >= 3).cast("int")).alias("at_least_3"))


def rates(rows: DataFrame, tiers: tuple[str, ...] = ("should", "could", "potential")) -> DataFrame:
    """tier, total, verified, rate in per cent (tier, verified); unknown tiers count as the last."""
    spark = rows.sparkSession
    known = rows.select(F.when(F.col("tier").isin(*tiers), F.col("tier")).otherwise(tiers[-1]).alias("tier"), "verified")
    n = known.groupBy("tier").agg(F.count(F.lit(1)).alias("total"), F.count_if("verified").alias("verified"))
    every = F.broadcast(n)
    out = spark.createDataFrame([(t,) for t in tiers], "tier string").join(every, "tier", "left").na.fill(0)
    return out.withColumn("rate", 100 * F.col("verified") / F.greatest("total", F.lit(1)))


def named_ids(suggested: DataFrame, clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """instance, id: the truth's members (instance, id, name) that are named; all overloads of a name.

    Names come from the suggestions (instance, name), or, for instances without any, from the clusters.
    """
    rest = clusters.join(suggested.select("instance").distinct(), "instance", "left_anti")
    names = suggested.select("instance", "name").unionByName(rest.select("instance", "name")).distinct()
    return truth.join(names, ["instance", "name"], "left_semi").select("instance", "id").distinct()


def system_totals(records: DataFrame) -> DataFrame:
    """system, suggestions, members a suggestion, and the difference of both to the other systems' mean."""
    totals = records.groupBy("system").agg(F.count(F.lit(1)).alias("suggestions"), F.avg("members").alias("members"))
    other = totals.select(F.col("system").alias("other"), F.col("suggestions").alias("s"), F.col("members").alias("m"))
    mean = totals.select("system").join(other, F.col("system") != F.col("other")).groupBy("system").agg(F.avg("s").alias("s"), F.avg("m").alias("m"))
    return totals.join(mean, "system", "left").select("system", "suggestions", "members", (F.col("suggestions") - F.col("s")).alias("more_suggestions"), (F.col("members") - F.col("m")).alias("more_members"))


def compile_rates(suggestions: DataFrame) -> DataFrame:
    """system, total, compilable, rate (three places) and mean numbers of methods and fields of suggestions."""
    rows = suggestions.groupBy("system").agg(F.count(F.lit(1)).alias("total"), F.count_if("compiles").alias("compilable"), F.avg("methods").alias("methods"), F.avg("fields").alias("fields"))
    return rows.withColumn("rate", F.round(F.col("compilable") / F.col("total"), 3))
