"""Which methods every commit changed, from diffs and the contents they lead to.

Contents are addressed by their hash: each is read and parsed once, however many commits and files
have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.evolution import hunks
from weftline.operators.javasource import members


def method_lines(blobs: DataFrame) -> DataFrame:
    """blob, member (signature), start, stop of methods and constructors of contents (blob, source)."""
    once = blobs.groupBy("blob").agg(F.first("source").alias("source"))
    m = members(once.withColumnRenamed("blob", "file")).filter("kind <> 'field'")
    return m.groupBy(F.col("file").alias("blob"), F.col("signature").alias("member")).agg(F.max(F.struct("line", "end_line")).alias("x")).select("blob", "member", F.col("x.line").alias("start"), F.col("x.end_line").alias("stop"))


def method_changes(log: DataFrame, lines: DataFrame, most: int = 30) -> DataFrame:
    """repository, commit_id, ts, file, member: methods (lines: blob, member, start, stop) that a commit of
    the log changed in a file.

    A root commit changes all methods that it brings. Any other changes those whose lines in the new
    content meet a hunk, if there was a content before (an added or deleted file changes none), unless
    they are more than most in the file, which counts as none.
    """
    key = ["repository", "commit_id", "file"]
    roots = log.filter("root and blob is not null").select(*key, "ts", "blob").distinct().join(lines.select("blob", "member"), "blob")
    later = log.filter("not root and blob is not null and old_blob is not null")
    ranges = hunks(later.select(F.struct(*key, "ts", "blob").alias("commit_id"), "diff")).select("commit_id.*", F.col("start").alias("from_line"), F.col("stop").alias("to_line"))
    met = ranges.join(lines, "blob").filter((F.col("stop") >= F.col("from_line")) & (F.col("start") <= F.col("to_line"))).select(*key, "ts", "member").distinct()
    few = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).drop("n")
    return roots.select(*key, "ts", "member").unionByName(met.join(few, key).select(*key, "ts", "member"))
