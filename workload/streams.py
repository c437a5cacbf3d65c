"""Streaming family: every query reads its table as a stream until the input is exhausted.

A window is released once the watermark has passed its end. What is still open when the input ends is
finished from the newest rows, so results cover the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators.timing import STAGES, with_total
from runlens.streaming import carried, live, stateful
from workload.base import VIEWS, query, raw_timing, rounded, table
from workload.batching import ADAPTIVE_TRACE_SQL
from workload.results import resources


class _Streamed:
    """Hands table readers a stream instead of a batch."""

    def __init__(self, spark):
        self.spark = spark

    @property
    def read(self):
        return self

    def parquet(self, path: str):
        """A stream refuses the plain path of one file, so the path is a pattern that only fits itself: a file or a
        folder of files."""
        schema = self.spark.read.parquet(path).schema
        return self.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def timing_stream(spark, sf_dir):
    return with_total(raw_timing(_Streamed(spark), sf_dir))


def timing_table(spark, sf_dir):
    """The rows of ``timing_stream`` as a table, with the zoned event time of the streams."""
    return with_total(raw_timing(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))


VIEWS["day_v"] = """
SELECT *, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end
FROM timing_v"""

_STATS = """round(avg({0}_s * 1000), 8) AS avg, round(min({0}_s * 1000), 8) AS min,
  round(max({0}_s * 1000), 8) AS max, round(stddev_pop({0}_s * 1000), 8) AS std,
  round(quantile_cont({0}_s * 1000, 0.5), 8) AS p50, round(quantile_cont({0}_s * 1000, 0.95), 8) AS p95,
  round(quantile_cont({0}_s * 1000, 0.99), 8) AS p99, round(sum({0}_s * 1000), 8) AS sum,
  count(*) AS count"""


@query(
    " UNION ALL ".join(
        f"SELECT epoch_us(window_start) AS window_us, run_id, '{s}' AS stage, {_STATS.format(s)} "
        "FROM day_v GROUP BY window_start, run_id"
        for s in STAGES
    )
)
def live_stage_stats(spark, sf_dir):
    def stats(rows):
        return live.live_stage_stats(rows, ["run_id"], "1 day", "1 hour")

    released = live.run_available(stats(timing_stream(spark, sf_dir)), "live_stage_stats")
    done = live.with_open_windows(stats, released, timing_table(spark, sf_dir))
    return rounded(
        done.select(
            F.unix_micros("window_start").alias("window_us"), *done.columns[2:]
        ),
        8,
    )


@query(
    """SELECT epoch_us(window_start) AS window_us, run_id, count(*) AS completed_tasks,
      count(*) / 86400.0::DOUBLE AS throughput_fps FROM day_v GROUP BY window_start, run_id"""
)
def live_throughput(spark, sf_dir):
    def rates(rows):
        return live.live_throughput(rows, ["run_id"], "1 day", "1 hour")

    released = live.run_available(rates(timing_stream(spark, sf_dir)), "live_throughput")
    done = live.with_open_windows(rates, released, timing_table(spark, sf_dir))
    return done.select(
        F.unix_micros("window_start").alias("window_us"), "run_id", "completed_tasks", "throughput_fps"
    )


@query(
    """SELECT epoch_us(window_start) AS window_us, run_id, count(*) AS samples,
      round(coalesce(avg(cpu_percent) FILTER (WHERE cpu_percent > 0), 0), 6) AS cpu_avg,
      round(coalesce(max(memory_percent) FILTER (WHERE memory_percent > 0), 0), 6) AS memory_max,
      arg_max(memory_used_mb, ts) AS current_mb,
      round(avg(npu_utilization) FILTER (WHERE npu_utilization > 0), 6) AS npu_avg
    FROM (SELECT *, unnest([date_trunc('day', ts) + (CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR
        ELSE INTERVAL 0 HOUR END), date_trunc('day', ts) + (CASE WHEN hour(ts) >= 12 THEN INTERVAL 0 HOUR
        ELSE INTERVAL (-12) HOUR END)]) AS window_start FROM resource_v)
    GROUP BY window_start, run_id"""
)
def live_resource_stats(spark, sf_dir):
    def stats(rows):
        return live.live_resource_stats(rows, ["run_id"], "1 day", "12 hours", "1 hour")

    released = live.run_available(stats(resources(_Streamed(spark), sf_dir)), "live_resource_stats")
    done = live.with_open_windows(stats, released, resources(spark, sf_dir))
    return rounded(
        done.select(
            F.unix_micros("window_start").alias("window_us"),
            "run_id",
            "samples",
            F.col("cpu.avg").alias("cpu_avg"),
            F.col("memory.max_percent").alias("memory_max"),
            "memory.current_mb",
            F.col("npu.avg_utilization").alias("npu_avg"),
        )
    )


@query(
    """SELECT event_id, run_id FROM timing_v
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id) > 5"""
)
def live_warmup_drop(spark, sf_dir):
    stream = timing_stream(spark, sf_dir).select("event_id", "run_id", "execute_s")
    return carried.live_warmup_drop(stream, ["run_id"], "event_id", 5).select("event_id", "run_id")


@query(
    """SELECT run_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS items,
      ceil(count(*) / 8)::BIGINT AS batches
    FROM (SELECT *, (sum(opens) OVER (PARTITION BY run_id ORDER BY ts)) AS session_no
      FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts))
          < 3600000000 THEN 0 ELSE 1 END AS opens FROM timing_v))
    GROUP BY run_id, session_no"""
)
def live_gap_sessions(spark, sf_dir):
    def sessions(rows):
        return live.live_gap_sessions(rows.select("run_id", "ts"), ["run_id"], "1 hour", "2 hours", 8)

    released = live.run_available(sessions(timing_stream(spark, sf_dir)), "live_gap_sessions")
    done = live.with_open_sessions(sessions, released, timing_table(spark, sf_dir), ["run_id"])
    return done.select(
        "run_id",
        F.unix_micros("first_arrival").alias("first_us"),
        F.unix_micros("last_arrival").alias("last_us"),
        "items",
        "batches",
    )


@query(ADAPTIVE_TRACE_SQL)
def live_adaptive_batch(spark, sf_dir):
    stream = timing_stream(spark, sf_dir).select("run_id", "event_id", "execute_s")
    return carried.live_adaptive_batch(stream, ["run_id"], "event_id", "execute_s")


@query(
    """SELECT conv_id AS batch_id, turn AS sub_batch_id, md5(text) AS result,
      CASE WHEN conv_id % 5 = 0 THEN 'timeout' ELSE 'complete' END AS status
    FROM conversations"""
)
def live_reassemble(spark, sf_dir):
    """Every fifth conversation expects a part that never arrives, so its timer or the end of the input releases
    it."""
    sizes = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("parts")
    )
    missing = F.when(F.col("batch_id") % 5 == 0, 1).otherwise(0)

    def parts(reader):
        found = table(reader, sf_dir, "conversations").select(
            F.col("conv_id").alias("batch_id"),
            F.col("turn").alias("sub_batch_id"),
            F.md5("text").alias("result"),
            F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 60 + F.col("turn")).alias("ts"),
        )
        expected = (F.col("parts") + missing).alias("expected")
        return found.join(sizes, "batch_id").select("batch_id", "sub_batch_id", "result", expected, "ts")

    stream = parts(_Streamed(spark)).withWatermark("ts", "60 seconds")
    released = live.run_available(stateful.live_reassemble(stream, 120_000), "live_reassemble")
    return stateful.with_open_batches(released, parts(spark))


@query(
    """SELECT run_id, event_id AS item, session_no, ((row_number() OVER (PARTITION BY run_id, session_no
        ORDER BY ts, event_id) - 1) // 8)::BIGINT AS batch_no, 'numbered' AS status
    FROM (SELECT *, (sum(opens) OVER (PARTITION BY run_id ORDER BY ts, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS session_no
      FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts, event_id))
          < 3600000000 THEN 0 ELSE 1 END AS opens FROM timing_v))"""
)
def live_gap_batches(spark, sf_dir):
    """Session and batch of every single arrival."""
    stream = timing_stream(spark, sf_dir).select("run_id", "event_id", "ts")
    numbered = stateful.live_gap_batches(stream, ["run_id"], "event_id", 3600.0, 8)
    return live.run_available(numbered, "live_gap_batches")
