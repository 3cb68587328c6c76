"""Variants of one run: merged parameters, shared inputs computed once, one result; and reports of stages."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.operators.lineage import cut


def merged(base: dict, changes: dict) -> dict:
    """base with changes, maps within maps merged, anything else replaced; neither is altered."""
    out = dict(base)
    for k, v in changes.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def run_variants(base: dict, variants: dict[str, dict], shared: dict[str, DataFrame], plan: Callable[[dict[str, DataFrame], dict], DataFrame]) -> DataFrame:
    """variant and what plan gives for it: plan(inputs, parameters) with the base's parameters changed by
    the variant's. The shared inputs are written once; every variant reads them, and all are one plan."""
    inputs = {k: cut(v) for k, v in shared.items()}
    out = None
    for name, changes in variants.items():
        one = plan(inputs, merged(base, changes)).withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no variants")
    return out


def against(results: DataFrame, measure: str, reference: str = "full") -> DataFrame:
    """variant, runs, mean of measure, and its difference to the reference variant's mean in per cent (null without one)."""
    m = results.groupBy("variant").agg(F.count(F.lit(1)).alias("runs"), F.avg(measure).alias("mean"))
    own = m.filter(F.col("variant") == reference).select(F.col("mean").alias("base"))
    return m.join(F.broadcast(own), how="left").select("variant", "runs", "mean", (100 * F.try_divide(F.col("mean") - F.col("base"), F.col("base"))).alias("change"))


class StageReport:
    """What the stages of a run did: times, measures that Spark gathers while a stage is written (no second
    scan), events and failures; report() is one row a measure."""

    def __init__(self, run: str):
        self.run, self.began = run, time.monotonic()
        self.measures: list[tuple[str, str, float]] = []
        self.events: list[tuple[str, str]] = []
        self.failures: list[tuple[str, str]] = []

    def write(self, stage: str, rows: DataFrame, path: str, **measures: Column) -> DataFrame:
        """Writes rows as Parquet and reads them back; measures (aggregates by name) are observed on the way.
        A stage that fails is noted and its error raised."""
        seen, began = Observation(), time.monotonic()
        aggregates = {"rows": F.count(F.lit(1)), **measures}
        try:
            rows.observe(seen, *(c.alias(n) for n, c in aggregates.items())).write.parquet(path)
        except Exception as error:
            self.failures.append((stage, type(error).__name__))
            raise
        self.measures += [(stage, n, None if v is None else float(v)) for n, v in seen.get.items()]
        self.measures.append((stage, "seconds", time.monotonic() - began))
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def event(self, name: str, data: str = "") -> None:
        self.events.append((name, data))

    def report(self, spark: SparkSession) -> DataFrame:
        """run, stage, measure, value; the stage '' has the totals."""
        stages = len({s for s, _, _ in self.measures})
        totals = [("", "seconds", time.monotonic() - self.began), ("", "stages", float(stages)), ("", "events", float(len(self.events))), ("", "failures", float(len(self.failures)))]
        return spark.createDataFrame([(self.run, *m) for m in self.measures + totals], "run string, stage string, measure string, value double")
