"""Ordered work on groups of any size.

A window over a key puts all rows of that key into one task. The helpers here sort all rows into ranges of
keys and order columns, so that a large group is cut into consecutive slices, run the window inside each
slice, and carry what crosses a slice border in a summary with one row per slice.

There is one plan for every size: a small group lies in one slice. The ranges come from Spark's range
partitioning, which takes any type that has an order and cuts by row counts, not by values, so neither outliers nor
clusters fill a slice. The ranged rows are written once, so a task that is run again after a lost executor
finds every row in the same slice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.sources.shared import checkpointed, written

ROWS_PER_SLICE = 1_000_000
#: Cells of values divide what lies between these quantiles; the first and the last also take what lies
#: beyond, so a few outliers cannot squeeze all other rows into one.
CENTRE = [0.001, 0.999]
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class LargeGroups:
    """Groups above a size limit: ``frame`` has their keys, ``_n`` and the order's central bounds."""

    frame: DataFrame
    groups: int
    rows: int


def sized(frame: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side of known size; a larger one is left to a shuffled join."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def large_groups(df: DataFrame, keys: list[str], limit: int) -> LargeGroups | None:
    """The groups with more than ``limit`` rows, or None; at most (all rows / limit) of them."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).persist()
    try:
        if found.isEmpty():
            return None
        kept = checkpointed(found)
    finally:
        found.unpersist()
    groups, rows = kept.agg(F.count(F.lit(1)), F.sum("_n")).first()
    return LargeGroups(kept, groups, rows)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join that also matches null keys and keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"__right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` (unique per group) of every group.

    The minimum is a hash aggregate with one row per group; the rows themselves are neither
    sorted nor grouped.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    found = null_safe_join(df, first, keys, "inner").filter(F.col(order) == F.col("_first"))
    return found.select(*df.columns)


def sliced(
    df: DataFrame, keys: list[str], order: list[str], rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, int]:
    """``df``, written once, with ``_slice``, which grows with keys and order; and the number of slices.

    A slice holds about two thirds of ``rows_per_slice`` rows or fewer; rows that are equal in keys and order stay together.
    """
    slices = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * df.count() // (2 * rows_per_slice)))
    ranged = df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id().cast("bigint"))
    return written(ranged, "slices"), slices


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "position",
    rows_per_slice: int = ROWS_PER_SLICE,
    tie: list[str] | None = None,
) -> DataFrame:
    """1-based row number per key. ``order`` with ``tie`` is unique per key and of any types that have an order."""
    order = order + (tie or [])
    keyed, keys = with_keys(df, keys)
    cut, slices = sliced(keyed, keys, order, rows_per_slice)
    local = keys + ["_slice"]
    counts = cut.groupBy(*local).agg(F.count(F.lit(1)).alias("_c"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    # A group that began in an earlier slice goes on in this one: at most one for each slice.
    offsets = counts.select(*local, (F.sum("_c").over(across) - F.col("_c")).alias("_before")).filter(F.col("_before") != 0)
    within = Window.partitionBy(*local).orderBy(*order)
    return (
        null_safe_join(cut, sized(offsets, slices), local, "left")
        .withColumn(name, F.row_number().over(within) + F.coalesce("_before", F.lit(0)))
        .select(*df.columns, name)
    )


def with_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """A frame without keys is one group; give it a constant key."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def with_halo(
    df: DataFrame, position: str, before: int, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Cut numbered rows into slices and repeat the last ``before`` rows in the next slice.

    Repeated rows carry ``_halo = true``; a window over ``_slice`` that looks back
    ``before`` rows then sees all it needs.
    """
    size = max(rows_per_slice, before)
    own = F.floor((F.col(position) - 1) / size)
    left_over = size - 1 - F.pmod(F.col(position) - 1, F.lit(size))
    targets = F.when(left_over < before, F.array(own, own + 1)).otherwise(F.array(own))
    return (
        df.select("*", F.posexplode(targets).alias("_copy", "_slice"))
        .withColumn("_halo", F.col("_copy") == 1)
        .drop("_copy")
    )
