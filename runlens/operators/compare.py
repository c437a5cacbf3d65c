"""Strategy rows against their baseline, unions of results and comparison tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.measures import parallel_efficiency, speedup
from runlens.operators.slicing import first_rows, null_safe_join, with_keys


def first_baseline(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first baseline row per group in input order; ``order`` is unique per group."""
    rows, group = with_keys(df.filter(F.array_contains("strategies", "baseline")), keys)
    return first_rows(rows, group, order).select(*df.columns)


def compare_to_baseline(
    df: DataFrame, baseline: DataFrame, keys: list[str], fps: str = "fps"
) -> DataFrame:
    """Add baseline rate, speedup and efficiency to every strategy row.

    ``baseline`` has at most one row per ``keys`` (null keys match). Without a baseline
    its rate is 0 and the speedup 1.
    """
    base = baseline.select(*keys, F.col(fps).alias("baseline_fps"))
    joined = null_safe_join(df, base, keys, "left").withColumn(
        "baseline_fps", F.coalesce("baseline_fps", F.lit(0.0))
    )
    gain = speedup(F.col(fps), F.col("baseline_fps"))
    return joined.withColumn("speedup", gain).withColumn(
        "parallel_efficiency", parallel_efficiency(gain, F.col("theoretical_speedup"))
    )


def union_results(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered_distinct(df: DataFrame, keys: list[str], column: str, position: str) -> DataFrame:
    """Distinct names per group with the position of their first appearance."""
    return df.groupBy(*keys, column).agg(F.min(position).alias("first_position"))


def comparison_table(df: DataFrame, order: str) -> DataFrame:
    """One row per result in input order; a baseline compares as 1.0 and 100 %."""
    is_base = F.array_contains("strategies", "baseline")
    name = F.when(is_base, "baseline").otherwise(
        F.coalesce(F.try_element_at("strategies", F.lit(1)), F.lit("unknown"))
    )
    pure = F.coalesce("pure_fps", F.lit(0.0))
    return (
        df.select(
            order,
            "model_name",
            F.coalesce("execute_avg", F.lit(0.0)).alias("execute_avg"),
            pure.alias("pure_fps"),
            F.coalesce("e2e_fps", F.lit(0.0)).alias("e2e_fps"),
            name.alias("strategy"),
            F.when(is_base, pure).otherwise(F.coalesce("strategy_fps", pure)).alias("throughput"),
            F.when(is_base, 1.0).otherwise(F.coalesce("speedup", F.lit(1.0))).alias("speedup"),
            F.when(is_base, 100.0)
            .otherwise(F.coalesce("parallel_efficiency", F.lit(0.0)))
            .alias("efficiency"),
        )
        .orderBy(order)
    )
