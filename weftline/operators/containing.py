"""Which texts contain which names, without comparing each with each.

Every name is looked up by one of its grams of three characters (shorter names by all of theirs), the
one that the fewest texts have. Texts meet a name through that gram only and are then held against the
whole name. Each side is exploded and joined by gram; neither is broadcast or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import cut

GRAM = 3


def grams(text: Column, size: Column) -> Column:
    """Distinct substrings of so many characters."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def containing(names: DataFrame, texts: DataFrame) -> DataFrame:
    """name, text: distinct names (name) within distinct texts (text). Nulls and empty names are in none."""
    own = cut(names.select("name").filter("name is not null and name <> ''").distinct())
    every = cut(texts.select("text").filter("text is not null and text <> ''").distinct())
    size = F.least(F.length("name"), F.lit(GRAM))
    sizes = [r[0] for r in own.select(size.alias("s")).distinct().collect()]  # three values at most
    if not sizes:
        return own.select("name", F.lit("").alias("text")).limit(0)
    of_text = every.select("text", F.explode(F.concat(*(grams(F.col("text"), F.lit(s)) for s in sizes))).alias("gram"))
    seen = of_text.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    of_name = own.select("name", F.explode(grams(F.col("name"), size)).alias("gram")).join(seen, "gram", "left")
    best = of_name.groupBy("name").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return best.join(of_text, "gram").filter(F.col("text").contains(F.col("name"))).select("name", "text")


def afferent(types: DataFrame, names: DataFrame) -> DataFrame:
    """name, ca: how many other classes (types: class_id, type) name a class (name) anywhere in a type; none is 0.

    A class is another one if its class_id differs from the name.
    """
    pairs = containing(names, types.select(F.col("type").alias("text")))
    hit = types.select("class_id", F.col("type").alias("text")).distinct().join(pairs, "text").filter(F.col("class_id").cast("string") != F.col("name"))
    n = hit.select("name", "class_id").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("ca"))
    return names.select("name").distinct().join(n, "name", "left").fillna(0, ["ca"])


def truth_for(suggested: DataFrame, truth: DataFrame) -> DataFrame:
    """class_id, truth, members: the truth (truth, source_class, members) that each suggested class is held
    against: that whose class name contains its own."""
    pairs = containing(suggested.select(F.col("class_id").alias("name")), truth.select(F.col("source_class").alias("text")))
    return truth.withColumnRenamed("source_class", "text").join(pairs, "text").select(F.col("name").alias("class_id"), "truth", "members")
