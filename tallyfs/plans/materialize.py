"""Lineage cuts and size-checked broadcasts.

Intermediate results that are reused, or whose recomputation would re-read
content, are written as Parquet to a fresh folder below the shared
``spark.checkpoint.dir`` and read back: the lineage ends there and a lost
executor costs a re-read of that table, not a re-run of the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.session import scratch_path


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the re-read table."""
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows.

    Returns the (possibly hinted) DataFrame and whether it was broadcast. The
    count is one job; call it on a materialized table so it is cheap.
    """
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False
