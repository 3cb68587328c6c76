"""Co-change counts over event-time windows of a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(changes: DataFrame, late: str) -> DataFrame:
    """changes with an event time, and on a stream a watermark."""
    x = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if x.isStreaming else x


def baskets(changes: DataFrame, length: str = "30 days", late: str = "1 day") -> DataFrame:
    """Members of each commit in each window; works on streams and on tables (commit_id, ts, member)."""
    x = timed(changes, late)
    return x.groupBy(F.window("ts", length).alias("w"), "commit_id").agg(F.array_sort(F.collect_set("member")).alias("members"))


def pair_rows(rows: DataFrame) -> DataFrame:
    """window_start, m1 < m2 of each basket."""
    a = rows.select(F.col("w.start").alias("window_start"), "members", F.explode("members").alias("m1"))
    return a.select("window_start", "m1", F.explode(F.filter("members", lambda m: m > F.col("m1"))).alias("m2"))


def pair_counts(changes: DataFrame, **how) -> DataFrame:
    return pair_rows(baskets(changes, **how)).groupBy("window_start", "m1", "m2").agg(F.count(F.lit(1)).alias("n"))


def member_counts(changes: DataFrame, length: str = "30 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Changes of each member in tumbling or, with slide, sliding windows."""
    x = timed(changes, late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return x.groupBy(w.alias("w"), "member").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "member", "n")


def bursts(changes: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each member: changes no further apart than gap."""
    x = timed(changes, late)
    return x.groupBy(F.session_window("ts", gap).alias("w"), "member").agg(F.count(F.lit(1)).alias("n")).select("member", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now into a table in memory (tests, small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
