"""Resource samples: processor, memory and accelerator use of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.measures import positive_only


def resource_aggregates(columns: list[str], order: str, ts: str) -> list[Column]:
    """The aggregates of ``resource_stats``; usable on batch and streaming groups alike.

    ``order`` is one plain column, so that hash aggregation applies; a composite order would
    make Spark sort all samples first.
    """
    zero = F.lit(0.0)
    cpu = positive_only(F.col("cpu_percent"))
    memory = positive_only(F.col("memory_percent"))
    used = positive_only(F.col("npu_utilization"))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    card = [
        F.max_by(c, order).alias(alias)
        for c, alias in (
            ("npu_memory_used_mb", "current_memory_mb"),
            ("npu_memory_total_mb", "total_memory_mb"),
        )
        if c in columns
    ]
    return [
        F.count(F.lit(1)).alias("samples"),
        ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("duration_seconds"),
        F.struct(
            F.coalesce(F.avg(cpu), zero).alias("avg"),
            F.coalesce(F.max(cpu), zero).alias("max"),
            F.coalesce(F.min(cpu), zero).alias("min"),
        ).alias("cpu"),
        F.struct(
            F.coalesce(F.avg(memory), zero).alias("avg_percent"),
            F.coalesce(F.max(memory), zero).alias("max_percent"),
            F.max_by("memory_used_mb", order).alias("current_mb"),
            F.max_by("memory_total_mb", order).alias("total_mb"),
        ).alias("memory"),
        F.when(
            F.count(used) > 0,
            F.struct(
                F.avg(used).alias("avg_utilization"),
                F.max(used).alias("max_utilization"),
                F.min(used).alias("min_utilization"),
                *card,
            ),
        ).alias("npu"),
    ]


def resource_stats(
    df: DataFrame, keys: list[str], order: str, ts: str = "ts", with_accelerator: bool = True
) -> DataFrame:
    """Averages and extremes over samples that were taken, plus the newest memory reading.

    ``order`` is the arrival number (or time) of a sample, unique per run. Every aggregate combines on the map side, so a run of any size costs one row per task.
    The accelerator block is null when no sample of the run saw it in use.
    """
    found = df.groupBy(*keys).agg(*resource_aggregates(df.columns, order, ts))
    return found if with_accelerator else found.drop("npu")
