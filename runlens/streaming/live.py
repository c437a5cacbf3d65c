"""Windowed streaming twins of the batch statistics, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.measures import to_ms
from runlens.operators.quantiles import PROBS
from runlens.operators.resources import resource_aggregates
from runlens.operators.slicing import null_safe_join
from runlens.operators.timing import STAGES, counted_stats
from runlens.sources.shared import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a zoned timestamp (watermarks refuse others) with a watermark on it."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _bounds() -> list:
    return [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]


def _stage_counts(stream: DataFrame, keys: list[str], window: str, delay: str, ts: str) -> DataFrame:
    rows = F.explode(
        F.array(
            *[F.struct(F.lit(s).alias("stage"), to_ms(F.col(f"{s}_s")).alias("ms")) for s in STAGES]
        )
    )
    return (
        timed(stream, ts, delay)
        .select(*keys, ts, rows.alias("_r"))
        .groupBy(F.window(ts, window), *keys, F.col("_r.stage").alias("stage"), F.col("_r.ms").alias("ms"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def live_stage_counts(
    stream: DataFrame, keys: list[str], window: str, delay: str, ts: str = "ts"
) -> DataFrame:
    """How often every latency occurred per tumbling window, run and stage.

    Equal values combine before the shuffle and the groups are spread by value, so a busy run is
    not one group.
    """
    counted = _stage_counts(stream, keys, window, delay, ts)
    return counted.select(*_bounds(), *keys, "stage", "ms", "occurrences")


def live_stage_stats(
    stream: DataFrame, keys: list[str], window: str, delay: str, ts: str = "ts"
) -> DataFrame:
    """Statistics of all five stages per closed window and run: a stream in, a stream out.

    The first aggregation counts values, spread by value; the second takes the counts of a closed window, which is
    what its state holds: one entry for each distinct latency. Where a window has too many of them for one
    task, use ``released_stage_stats``.
    """
    counted = _stage_counts(stream, keys, window, delay, ts).filter(F.col("ms").isNotNull())
    n, value = F.col("count"), F.col("ms") * F.col("occurrences")
    gathered = counted.groupBy(F.window(F.window_time("window"), window), *keys, "stage").agg(
        F.sum(value).alias("sum"),
        F.min("ms").alias("min"),
        F.max("ms").alias("max"),
        F.sum("occurrences").alias("count"),
        F.percentile("ms", list(PROBS), F.col("occurrences")).alias("_p"),
        F.collect_list(F.struct("ms", "occurrences")).alias("_values"),
    )
    mean = F.col("sum") / n
    squares = F.aggregate(
        "_values", F.lit(0.0), lambda a, v: a + v["occurrences"] * (v["ms"] - F.col("avg")) * (v["ms"] - F.col("avg"))
    )
    return gathered.withColumn("avg", mean).select(
        *_bounds(), *keys, "stage", "avg", "min", "max", F.sqrt(squares / n).alias("std"),
        *[F.col("_p")[i].alias(name) for i, name in enumerate(("p50", "p95", "p99"))], "sum", "count",
    )


def released_stage_stats(
    stream: DataFrame, keys: list[str], window: str, delay: str, ts: str = "ts", base: str | None = None
) -> DataFrame:
    """``live_stage_stats`` for windows of any number of distinct latencies: each trigger turns the counts it
    releases into statistics with the batch operator. Runs the stream to the end of what is there."""
    group = ["window_start", "window_end", *keys, "stage"]
    counts = live_stage_counts(stream, keys, window, delay, ts)
    return run_released(
        counts, "live_stage_stats", lambda rows: counted_stats(rows, group, "ms", "occurrences"), base
    )


def live_throughput(
    stream: DataFrame, keys: list[str], window: str, delay: str, ts: str = "ts"
) -> DataFrame:
    """Completed tasks and tasks per second of every tumbling window."""
    found = timed(stream, ts, delay).groupBy(F.window(ts, window), *keys).agg(
        F.count(F.lit(1)).alias("completed_tasks")
    )
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return found.select(
        *_bounds(), *keys, "completed_tasks", (F.col("completed_tasks") / seconds).alias("throughput_fps")
    )


def live_resource_stats(
    stream: DataFrame,
    keys: list[str],
    window: str,
    slide: str,
    delay: str,
    ts: str = "ts",
    order: str | None = None,
) -> DataFrame:
    """``resource_stats`` over sliding windows."""
    source = timed(stream, ts, delay)
    found = source.groupBy(F.window(ts, window, slide), *keys).agg(
        *resource_aggregates(source.columns, order or ts, ts)
    )
    return found.select(*_bounds(), *[c for c in found.columns if c != "window"])


def live_gap_sessions(
    stream: DataFrame, keys: list[str], gap: str, delay: str, size: int, ts: str = "ts"
) -> DataFrame:
    """Arrivals without a gap, and the batches of at most ``size`` they are cut into.

    Under the settings of ``run_available`` sessions are merged in each map task first, so a busy key sends
    sessions, not rows.
    """
    found = timed(stream, ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(
        F.min(ts).alias("first_arrival"),
        F.max(ts).alias("last_arrival"),
        F.count(F.lit(1)).alias("items"),
    )
    return found.select(
        *keys,
        "first_arrival",
        "last_arrival",
        "items",
        F.ceil(F.col("items") / size).alias("batches"),
    )


def with_open_windows(
    operator: Callable[[DataFrame], DataFrame], released: DataFrame, rows: DataFrame, ts: str = "ts"
) -> DataFrame:
    """What a windowed stream released and, by the same operator in batch, the windows that were still open.

    All keys share the watermark, so the open windows are those that start after the newest released one. Only
    ``rows`` (the stream's input as a table) after that start are read again.
    """
    newest = released.agg(F.max("window_start")).first()[0]
    if newest is None:
        return released.unionByName(operator(rows))
    later = operator(rows.filter(F.col(ts) > F.lit(newest))).filter(F.col("window_start") > F.lit(newest))
    return released.unionByName(later)


def with_open_sessions(
    operator: Callable[[DataFrame], DataFrame], released: DataFrame, rows: DataFrame, keys: list[str], ts: str = "ts"
) -> DataFrame:
    """Released sessions and those still open: of each key, the rows after its last released arrival."""
    last = released.groupBy(*keys).agg(F.max("last_arrival").alias("_last"))
    later = null_safe_join(rows, last, keys, "left").filter(F.col("_last").isNull() | (F.col(ts) > F.col("_last")))
    return released.unionByName(operator(later.drop("_last")))


def on_result_stream(stream: DataFrame, callback: Callable, checkpoint: str, output_mode: str = "append"):
    """Start a stream that calls ``callback(row, batch_id)`` for every row, on the executors.

    A batch may be delivered again after a failure; ``batch_id`` lets the callback tell.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        def each(rows):
            for row in rows:
                callback(row, batch_id)

        batch.foreachPartition(each)

    return (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each_batch)
        .trigger(availableNow=True)
        .start()
    )


@contextmanager
def _settings(spark: SparkSession):
    """What these streams are planned with; the session has its own settings back afterwards."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, LOCAL_SESSIONS: "true"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _start(stream: DataFrame, base: str):
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
    )


def run_released(
    stream: DataFrame, name: str, finish: Callable[[DataFrame], DataFrame], base: str | None = None
) -> DataFrame:
    """Apply a batch operator to the rows each trigger releases, and return all of its output.

    A trigger that is run again overwrites its own folder. ``base`` as in ``run_available``.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    empty = finish(spark.createDataFrame([], stream.schema))
    empty.write.mode("overwrite").parquet(f"{base}/out/trigger=-1")

    def each(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            finish(rows).write.mode("overwrite").parquet(f"{base}/out/trigger={batch_id}")
        finally:
            rows.unpersist()

    with _settings(spark):
        _start(stream, base).foreachBatch(each).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("trigger")


def run_available(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Process all available input in append mode and return what was written.

    ``base`` is the folder of progress and output: a query that is started again with the same folder goes
    on where it was. Without one each call starts anew in a scratch folder.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, name)
    sink = _start(stream, base).format("parquet").option("path", f"{base}/out")
    with _settings(spark):
        sink.start().awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], stream.schema)  # no trigger wrote anything
