"""Cutting lineage in iterative operators through the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


#: Row groups and pages of a few rows of megabytes each.
WIDE = {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


def cut(df: DataFrame, wide: bool = False) -> DataFrame:
    """df written and read back; wide: rows of megabytes, of which Parquet would hold 100 before it looks at their size."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftline-")
    path = f"{base}/lineage-{uuid.uuid4().hex}"
    df.write.options(**(WIDE if wide else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
