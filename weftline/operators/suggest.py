"""Suggestions: names, votes, deduplication, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common_prefix(names: Column) -> Column:
    """Longest common prefix of an array of strings: that of its least and greatest."""
    a, b = F.array_min(names), F.array_max(names)
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.substring(a, F.lit(1), F.array_max(same))


def auto_name(names: Column) -> Column:
    p = common_prefix(names)
    cap = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1000))
    return F.when(F.length(p) >= 3, F.concat(cap(p), F.lit("Operations"))).otherwise(F.concat(cap(F.element_at(names, 1)), F.lit("Group")))


def vote(ballots: DataFrame) -> DataFrame:
    """cluster_id, name, agreement: the name most ballots have; ties by confidence, then name."""
    n = ballots.groupBy("cluster_id", "name").agg(F.count(F.lit(1)).alias("votes"), F.max("confidence").alias("confidence"))
    w = Window.partitionBy("cluster_id")
    order = w.orderBy(F.desc("votes"), F.desc("confidence"), "name")
    x = n.withColumn("total", F.sum("votes").over(w)).withColumn("k", F.row_number().over(order)).filter("k = 1")
    return x.select("cluster_id", "name", "votes", (F.col("votes") / F.col("total")).alias("agreement"))


def first_per_class(rows: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("class_id").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), "cluster_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def confidence_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("confidence").alias("mean"), F.min("confidence").alias("low"), F.max("confidence").alias("high"), F.count_if(F.col("confidence") >= 0.8).alias("strong"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with rid, ord (the order in which a class's rows are judged: best first) and m, their set."""
    from weftline.operators.lineage import cut

    sure = F.coalesce(F.nanvl(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.0))
    x = rows.select("class_id", "cluster_id", F.col("confidence").cast("double").alias("confidence"), F.array_sort(F.array_distinct("members")).alias("m"), F.monotonically_increasing_id().alias("rid"))
    return cut(x.withColumn("ord", F.struct((-sure).alias("c"), "cluster_id", "rid")).withColumn("n", F.size("m")))


def distinct_suggestions(rows: DataFrame, most: float = 0.7) -> DataFrame:
    """Rows (class_id, cluster_id, confidence, members) that stay, best first, when each is dropped that has
    Jaccard most or more with one kept before (most above 0, at most 1).

    Of equal sets the first alone is judged. Two sets meet in their rarest members, of which one as similar
    must share one; each round keeps what no undecided earlier row is close to.
    """
    from weftline.operators.lineage import cut

    x = _numbered(rows)
    first = cut(x.groupBy("class_id", "m", "n").agg(F.min("ord").alias("ord")).withColumn("rid", F.col("ord.rid")))
    each = first.select("class_id", "rid", F.explode("m").alias("x"))
    often = each.groupBy("class_id", "x").agg(F.count(F.lit(1)).alias("f"))
    rare = F.array_sort(F.collect_list(F.struct("f", "x")))
    ordered = each.join(often.filter("f > 1"), ["class_id", "x"]).groupBy("class_id", "rid").agg(rare.alias("s"))
    # members that no other set has come first in the order: they use up places, and join nothing
    lone = F.col("n") - F.size("s")
    left = F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(most) * F.col("n") - 1e-9) + 1 - lone).cast("int")
    heads = ordered.join(first.select("rid", "n", "ord"), "rid").select("class_id", "rid", "n", "ord", F.explode(F.slice("s", F.lit(1), left)).alias("h"))
    heads = cut(heads.select("class_id", "rid", "n", "ord", F.col("h.x").alias("x")))
    a, b = (heads.select("class_id", "x", *(F.col(c).alias(f"{c}{k}") for c in ("rid", "n", "ord"))) for k in (1, 2))
    near = F.least("n1", "n2") >= F.lit(most) * F.greatest("n1", "n2") - 1e-9
    met = a.join(b, ["class_id", "x"]).filter((F.col("ord1") < F.col("ord2")) & near).select("rid1", "rid2").distinct()
    m1, m2 = (first.select(F.col("rid").alias(f"rid{k}"), F.col("m").alias(f"m{k}")) for k in (1, 2))
    both = F.size(F.array_intersect("m1", "m2"))
    links = cut(met.join(m1, "rid1").join(m2, "rid2").filter(both / (F.size("m1") + F.size("m2") - both) >= most).select("rid1", "rid2"))
    dropped = None
    while not links.isEmpty():
        kept = links.select("rid1").distinct().join(links.select(F.col("rid2").alias("rid1")).distinct(), "rid1", "left_anti")
        gone = cut(links.join(kept, "rid1", "left_semi").select("rid2").distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        links = cut(links.join(gone, "rid2", "left_anti").join(gone.select(F.col("rid2").alias("rid1")), "rid1", "left_anti"))
    stay = first.select("rid") if dropped is None else first.select("rid").join(dropped.select(F.col("rid2").alias("rid")), "rid", "left_anti")
    return x.join(stay, "rid", "left_semi").select("class_id", "cluster_id", "confidence")


def disjoint_suggestions(rows: DataFrame, most: float = 0.2) -> DataFrame:
    """Rows (class_id, cluster_id, confidence, members) that stay, best first, when each is dropped of which
    more than that share of members is in rows kept before.

    Only members of several rows are looked at. A round keeps rows that stay even if all undecided earlier
    ones do, and drops those that go even if none does; a class's first undecided row is always settled.
    """
    from weftline.operators.lineage import cut

    x = _numbered(rows)
    each = x.select("class_id", "rid", "ord", "n", F.explode("m").alias("x"))
    shared = each.groupBy("class_id", "x").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").drop("f")
    open_ = cut(each.join(shared, ["class_id", "x"]).withColumn("kept", F.lit(False)))
    earlier = Window.partitionBy("class_id", "x").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    dropped = None
    while not open_.filter("not kept").isEmpty():
        used = open_.withColumn("sure", F.coalesce(F.max(F.col("kept").cast("int")).over(earlier), F.lit(0))).withColumn("may", F.count(F.lit(1)).over(earlier) > 0)
        share = used.filter("not kept").groupBy("rid", "n").agg(F.sum("sure").alias("low"), F.count_if("may").alias("high"))
        state = F.when(F.col("low") / F.col("n") > most, "go").when(F.col("high") / F.col("n") <= most, "stay")
        settled = cut(share.select("rid", state.alias("state")).filter("state is not null"))
        gone = settled.filter("state = 'go'").select("rid")
        dropped = gone if dropped is None else dropped.union(gone)
        now = open_.join(settled, "rid", "left").filter("state is null or state <> 'go'")
        open_ = cut(now.select(*open_.columns[:-1], (F.col("kept") | F.coalesce(F.col("state") == "stay", F.lit(False))).alias("kept")))
    stay = x if dropped is None else x.join(dropped, "rid", "left_anti")
    return stay.select("class_id", "cluster_id", "confidence")


def exclusive_fields(accesses: DataFrame, chosen: DataFrame) -> DataFrame:
    """Fields that chosen methods use and no other method of the class does."""
    inside = accesses.join(chosen, ["class_id", "method"], "left_semi").select("class_id", "field").distinct()
    outside = accesses.join(chosen, ["class_id", "method"], "left_anti").select("class_id", "field")
    return inside.join(outside, ["class_id", "field"], "left_anti")


def without_accessors(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """Methods (class_id, signature) but the getters and setters of the fields (class_id, field)."""
    cap = F.concat(F.upper(F.substring("field", 1, 1)), F.substring("field", 2, 1000))
    names = fields.select("class_id", F.explode(F.array(*(F.concat(F.lit(p), cap) for p in ("get", "set", "is")))).alias("name"))
    m = methods.withColumn("name", F.substring_index("signature", "(", 1))
    return m.join(names, ["class_id", "name"], "left_anti").select("class_id", "signature")


def filled(clusters: DataFrame, named: DataFrame, confidence: float = 0.5) -> DataFrame:
    """named (class_id, cluster_id, name, confidence) and, for clusters (with names) it lacks, a name made from theirs."""
    missing = clusters.join(named, ["class_id", "cluster_id"], "left_anti")
    made = missing.select("class_id", "cluster_id", auto_name("names").alias("name"), F.lit(confidence).alias("confidence"))
    return named.select(*made.columns).unionByName(made)


def confident(rows: DataFrame, least: float) -> DataFrame:
    """Rows of that confidence or more; unknown confidence passes."""
    return rows.filter(F.col("confidence").isNull() | (F.col("confidence") >= least))


def helper_closure(chosen: DataFrame, calls: DataFrame, hidden: DataFrame) -> DataFrame:
    """chosen (class_id, method) with the hidden methods it calls (class_id, src, dst), directly or not.

    A level a round; the frontier alone is joined, and rounds end when it is empty.
    """
    from weftline.operators.lineage import cut

    reach = cut(calls.select("class_id", "src", "dst").join(hidden.select("class_id", F.col("method").alias("dst")), ["class_id", "dst"], "left_semi").distinct())  # read every round
    every = frontier = cut(chosen.select("class_id", "method").distinct())
    while not frontier.isEmpty():
        step = frontier.join(reach, (frontier["class_id"] == reach["class_id"]) & (frontier["method"] == reach["src"])).select(reach["class_id"], reach["dst"].alias("method")).distinct()
        frontier = cut(step.join(every, ["class_id", "method"], "left_anti"))
        every = cut(every.union(frontier))
    return every


def too_much(chosen: Column, total: Column, most: int = 40, share: float = 0.5) -> Column:
    """An extraction that takes more than most methods and more than that share of them."""
    return (chosen > most) & (chosen > share * total)


def message(name: Column, members: Column, rationale: Column, most: int = 5, length: int = 200) -> Column:
    """A commit text: name, the first methods (with a parenthesis) and fields, the rationale cut."""
    methods = F.filter(members, lambda m: m.contains("("))
    fields = F.filter(members, lambda m: ~m.contains("("))
    listed = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(f"\n{label}: "), F.array_join(F.slice(a, 1, most), ", "))).otherwise("")
    return F.concat(F.lit("Extract "), name, listed("Methods", methods), listed("Fields", fields), F.lit("\n\n"), F.substring(rationale, 1, length))


def refined(first: Column, second: Column) -> Column:
    """The second confidence if both are known and above 0 and it is the higher one, else the first."""
    return F.when((first > 0) & (second > 0) & (second > first), second).otherwise(first)
