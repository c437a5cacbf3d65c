"""Written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.sources.shared import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there, columns can be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, most_rows: int) -> DataFrame:
    """A table of short rows (a few numbers or a short text each) with a broadcast hint if its row count,
    taken from the written files, is within the bound; beyond it the join is shuffled."""
    return F.broadcast(table) if table.count() <= most_rows else table
