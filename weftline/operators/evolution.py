"""Co-change mining: what changes together, weighted by basket size and recency.

changes has one row for each (commit_id, ts, member). All functions are lazy; pair expansion comes
after the basket cap, which bounds its fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_commits(changes: DataFrame, newest: int = 500) -> DataFrame:
    """The newest commits of every member (ties by commit_id)."""
    order = Window.partitionBy("member").orderBy(F.desc("ts"), "commit_id")
    return changes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= newest)


def capped(changes: DataFrame, cap: int = 30) -> DataFrame:
    """Changes of commits of at most cap members; larger commits count as having changed nothing."""
    basket = F.count(F.lit(1)).over(Window.partitionBy("commit_id"))  # a sort, not a second reading and a join
    return changes.filter("commit_id is not null").withColumn("basket", basket).filter(F.col("basket") <= cap)


def basket_weight(basket: Column) -> Column:
    return 1 / F.sqrt(F.greatest(basket, F.lit(1)))


def recency_weight(ts: Column, as_of: str, decay: float) -> Column:
    """decay to the power of the age in years of 12 months of 30 whole days; unknown dates: 0.5."""
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)) / 86400)
    return F.when(ts.isNull(), 0.5).otherwise(F.pow(F.lit(decay), F.greatest(F.lit(0), days) / 30 / 12))


def weighted(changes: DataFrame, as_of: str, decay: float = 0.8, cap: int = 30) -> DataFrame:
    c = capped(changes, cap)
    return c.withColumn("w", basket_weight(F.col("basket")) * recency_weight(F.col("ts"), as_of, decay))


def cochange(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """m1 < m2 and the summed weight of commits that have both (capped rows: a commit's are held as one array,
    so that they are made once, where a join with themselves would make, sort and hold them twice in a task)."""
    w = weight if weight is not None else F.col("w")
    kept = rows.filter("commit_id is not null and member is not null")
    baskets = kept.groupBy("commit_id").agg(F.collect_list(F.struct("member", w.alias("w"))).alias("basket"))
    first = baskets.select(F.explode("basket").alias("x"), "basket")
    later = F.filter("basket", lambda y: y["member"] > F.col("x.member"))
    pairs = first.select(F.col("x.member").alias("m1"), F.col("x.w").alias("w"), F.explode(later).alias("y"))
    return pairs.groupBy("m1", F.col("y.member").alias("m2")).agg(F.sum("w").alias("cochange"))


def member_commits(changes: DataFrame) -> DataFrame:
    return changes.groupBy("member").agg(F.countDistinct("commit_id").alias("n"))


def supported(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n") >= least)


def base_name(member: Column) -> Column:
    return F.substring_index(member, "(", 1)


def coupling(pairs: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """cochange / sqrt(n1 * n2), halved between overloads of one name."""
    n1 = counts.select(F.col("member").alias("m1"), F.col("n").alias("n1"))
    n2 = counts.select(F.col("member").alias("m2"), F.col("n").alias("n2"))
    s = F.col("cochange") / F.sqrt(F.col("n1") * F.col("n2"))
    s = F.when(base_name(F.col("m1")) == base_name(F.col("m2")), s * 0.5).otherwise(s)
    return pairs.join(n1, "m1").join(n2, "m2").withColumn("coupling", s).filter(F.col("coupling") >= threshold).select("m1", "m2", "cochange", "coupling")


def mine(changes: DataFrame, as_of: str, decay: float = 0.8, cap: int = 30, threshold: float = 0.03) -> DataFrame:
    rows = weighted(changes, as_of, decay, cap)
    return coupling(cochange(rows), member_commits(rows), threshold)


def ends(couplings: DataFrame) -> DataFrame:
    return couplings.select(F.explode(F.array("m1", "m2")).alias("member"), "coupling")


def sum_of_coupling(couplings: DataFrame) -> DataFrame:
    return ends(couplings).groupBy("member").agg(F.sum("coupling").alias("soc"))


def hotspots(couplings: DataFrame, counts: DataFrame, top: int = 10, least: int = 3) -> DataFrame:
    """commits * sum of coupling over the largest such product; normalised before the top is taken."""
    s = counts.filter(F.col("n") >= least).join(sum_of_coupling(couplings), "member", "left").select("member", (F.col("n") * F.coalesce("soc", F.lit(0.0))).alias("raw"))
    most = s.agg(F.max("raw").alias("most"))
    return s.join(F.broadcast(most)).select("member", F.when(F.col("most") > 0, F.col("raw") / F.col("most")).otherwise(F.col("raw")).alias("score")).orderBy(F.desc("score"), "member").limit(top)


def lookup(pairs: DataFrame, couplings: DataFrame) -> DataFrame:
    """Coupling of any two members in any order; 0 for equal or unknown ones."""
    k = pairs.withColumn("m1", F.least("a", "b")).withColumn("m2", F.greatest("a", "b"))
    return k.join(couplings.select("m1", "m2", "coupling"), ["m1", "m2"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.coalesce("coupling", F.lit(0.0))).alias("coupling"))


HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def hunks(diffs: DataFrame) -> DataFrame:
    """commit_id, start, stop of every changed range in unified diffs (commit_id, diff)."""
    z = F.arrays_zip(F.expr(f"regexp_extract_all(diff, r'{HUNK}', 1)").alias("s"), F.expr(f"regexp_extract_all(diff, r'{HUNK}', 2)").alias("c"))
    x = diffs.select("commit_id", F.explode(z).alias("h"))
    start = F.col("h")["0"] if "0" in x.schema["h"].dataType.names else F.col("h.s")
    count = F.col("h")["1"] if "1" in x.schema["h"].dataType.names else F.col("h.c")
    s = start.cast("int")
    return x.select("commit_id", s.alias("start"), (s + F.coalesce(F.nullif(count, F.lit("")), F.lit("1")).cast("int") - 1).alias("stop"))


def overlapping(methods: DataFrame, changed: DataFrame) -> DataFrame:
    """Members whose lines (start, stop) meet a changed range of their commit; an equi-join with a residual."""
    h = changed.select("commit_id", F.col("start").alias("cs"), F.col("stop").alias("ce"))
    return methods.join(h, "commit_id").filter((F.col("stop") >= F.col("cs")) & (F.col("start") <= F.col("ce"))).select("commit_id", "member").distinct()


def cluster_context(pairs: DataFrame, clusters: DataFrame, least: float = 2.0, examples: int = 3) -> DataFrame:
    """cluster_id, n, examples: co-changing pairs (m1, m2, cochange) of least or more inside each cluster.

    Members (cluster_id, member) meet by bare name; examples are the first pairs in order of their names.
    """
    own = clusters.select("cluster_id", base_name(F.col("member")).alias("name")).distinct()
    a, b = own.withColumnRenamed("name", "m1"), own.withColumnRenamed("name", "m2")
    inside = pairs.filter(F.col("cochange") >= least).join(a, "m1").join(b, ["cluster_id", "m2"])
    firsts = F.slice(F.array_sort(F.collect_list(F.concat_ws(" ", "m1", "m2"))), 1, examples)
    return inside.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), firsts.alias("examples"))
