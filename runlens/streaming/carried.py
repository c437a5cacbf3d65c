"""Streams whose per-key state is a small table carried from one trigger to the next.

Each trigger runs as an ordinary batch job, so a key that holds most of the rows is spread by
the same operators as in batch. The state has a row or a few per key. A trigger that is run
again starts from the same previous state and overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.batching import adaptive_batch_trace
from runlens.operators.slicing import null_safe_join, with_position
from runlens.sources.shared import scratch_path

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_carried(
    stream: DataFrame, name: str, step: Step, state_schema: str, base: str | None = None
) -> DataFrame:
    """Run ``step(rows, state) -> (output, new state)`` per trigger until the input is exhausted.

    ``base`` is the folder of progress, state and output: a query that is started again with the same
    folder goes on where it was. Without one each call starts anew in a scratch folder.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    empty = step(spark.createDataFrame([], stream.schema), spark.createDataFrame([], state_schema))[0]
    empty.write.mode("overwrite").parquet(f"{base}/out/trigger=-1")

    def each(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        rows.persist()
        try:
            if batch_id:
                state = session.read.schema(state_schema).parquet(f"{base}/state/{batch_id - 1}")
            else:
                state = session.createDataFrame([], state_schema)
            output, new_state = step(rows, state)
            new_state.write.mode("overwrite").parquet(f"{base}/state/{batch_id}")
            output.write.mode("overwrite").parquet(f"{base}/out/trigger={batch_id}")
        finally:
            rows.unpersist()

    started = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("trigger")


def live_warmup_drop(stream: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The stream without the first ``n`` rows (at least one) of every run."""
    wanted = max(1, n)

    def step(rows: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
        first = Window.partitionBy(*keys).orderBy(order)
        head = (
            rows.select(*keys, order)
            .withColumn("_rn", F.row_number().over(first))
            .filter(F.col("_rn") <= wanted)
        )
        missing = wanted - F.coalesce("seen", F.lit(0))
        dropped = (
            null_safe_join(head, seen, keys, "left")
            .filter(F.col("_rn") <= missing)
            .groupBy(*keys)
            .agg(F.max(order).alias("_last"), F.count(F.lit(1)).alias("seen"))
        )
        later = F.col("_last").isNull() | (F.col(order) > F.col("_last"))
        kept = null_safe_join(rows, dropped.drop("seen"), keys, "left").filter(later).drop("_last")
        counted = seen.unionByName(dropped.select(*keys, "seen")).groupBy(*keys)
        return kept, counted.agg(F.sum("seen").alias("seen"))

    schema = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return run_carried(stream, "live_warmup_drop", step, f"{schema}, seen bigint")


def live_adaptive_batch(
    stream: DataFrame,
    keys: list[str],
    order: str,
    latency: str,
    start: int = 4,
    low: int = 1,
    high: int = 16,
    every: int = 10,
) -> DataFrame:
    """The batch size after every ``every`` latencies of a run.

    The state of a run is its size, its number of steps and fewer than ``every`` open latencies.
    """

    def step(rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        waiting = state.select(*keys, F.inline("open"))
        work = rows.select(*keys, order, latency).unionByName(waiting)
        trace = adaptive_batch_trace(
            work, keys, order, latency, start, low, high, every,
            state.select(*keys, F.col("size").alias("start")),
        )
        done = state.select(*keys, "steps")
        output = null_safe_join(trace, done, keys, "left").select(
            *keys, (F.col("step") + F.coalesce("steps", F.lit(0))).alias("step"), "batch_size"
        )
        counts = work.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        numbered = null_safe_join(with_position(work, keys, [order], "_pos"), counts, keys, "left")
        full = F.col("_n") - F.pmod(F.col("_n"), F.lit(every))
        still_open = (
            numbered.filter(F.col("_pos") > full)
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(order, latency))).alias("open"))
        )
        moved = trace.groupBy(*keys).agg(
            F.max_by("batch_size", "step").alias("_size"), F.count(F.lit(1)).alias("_steps")
        )
        known = state.select(*keys, "size", "steps")
        everyone = work.select(*keys).unionByName(state.select(*keys)).distinct()
        for side in (known, moved, still_open):
            everyone = null_safe_join(everyone, side, keys, "left")
        empty = F.array().cast(state.schema["open"].dataType)
        new_state = everyone.select(
            *keys,
            F.coalesce("_size", "size", F.lit(start)).cast("bigint").alias("size"),
            (F.coalesce("steps", F.lit(0)) + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.coalesce("open", empty).alias("open"),
        )
        return output, new_state

    def typed(column: str) -> str:
        return stream.schema[column].dataType.simpleString()

    schema = ", ".join(f"{k} {typed(k)}" for k in keys)
    open_rows = f"array<struct<{order}:{typed(order)},{latency}:{typed(latency)}>>"
    return run_carried(
        stream, "live_adaptive_batch", step, f"{schema}, size bigint, steps bigint, open {open_rows}"
    )
