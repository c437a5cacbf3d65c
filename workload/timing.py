"""Timing family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import batch_fps, fps, parallel_efficiency, speedup, to_ms
from runlens.operators import timing as ops
from workload.base import VIEWS, query, raw_timing, raw_timing_big, rounded

WARMUP = 5


def timing(spark, sf_dir):
    return ops.with_total(raw_timing(spark, sf_dir))


def timing_big(spark, sf_dir):
    return ops.with_total(raw_timing_big(spark, sf_dir))


def phased(spark, sf_dir):
    return ops.mark_auto_warmup(timing(spark, sf_dir), ["run_id"], "event_id", WARMUP)


VIEWS["phased_v"] = f"""
SELECT *, CASE WHEN row_number() OVER (PARTITION BY run_id ORDER BY event_id) <= {WARMUP}
  THEN 'warmup' ELSE 'test' END AS phase
FROM timing_v"""


def attempts(spark, sf_dir):
    return timing(spark, sf_dir).select(
        "*",
        (F.col("device_id") + 1).alias("num_threads"),
        (F.col("queue_wait_s") < 0.006).alias("success"),
        F.when(F.col("device_id") == 0, "640x640")
        .when(F.col("device_id") == 1, "1k2k")
        .when(F.col("device_id") == 2, "4k6k")
        .otherwise("bad")
        .alias("resolution"),
    )


def _stats_sql(ms: str, exact: bool = False) -> str:
    """With ``exact`` values are added as decimals: a sum of doubles leaves its last digits to the order of rows."""
    total = f"sum(({ms})::DECIMAL(28, 9))::DOUBLE" if exact else f"sum({ms})"
    mean = f"{total} / count(*)" if exact else f"avg({ms})"
    return f"""round({mean}, 6) AS avg, round(min({ms}), 6) AS min, round(max({ms}), 6) AS max,
      round(stddev_pop({ms}), 6) AS std, round(quantile_cont({ms}, 0.5), 6) AS p50,
      round(quantile_cont({ms}, 0.95), 6) AS p95, round(quantile_cont({ms}, 0.99), 6) AS p99,
      round({total}, 6) AS sum, count(*) AS count"""


def _wide_sql(stage: str) -> str:
    ms = f"{stage}_s * 1000"
    parts = {
        "avg": f"avg({ms})",
        "min": f"min({ms})",
        "max": f"max({ms})",
        "std": f"stddev_pop({ms})",
        "p50": f"quantile_cont({ms}, 0.5)",
        "p95": f"quantile_cont({ms}, 0.95)",
        "p99": f"quantile_cont({ms}, 0.99)",
        "sum": f"sum({ms})",
    }
    return ", ".join(
        f"round(coalesce({body} FILTER (WHERE phase = 'test'), 0), 6) AS {stage}_{name}"
        for name, body in parts.items()
    )


@query(
    f"""
    SELECT run_id, {", ".join(_wide_sql(s) for s in ops.STAGES)},
      {", ".join(
          f"round(sum({s}_s) FILTER (WHERE phase = 'test') / "
          f"sum(total_s) FILTER (WHERE phase = 'test') * 100, 6) AS {s}_ratio"
          for s in ops.PARTS)},
      round(1000 / (avg(execute_s * 1000) FILTER (WHERE phase = 'test')), 6) AS pure_fps,
      round(1000 / (avg(total_s * 1000) FILTER (WHERE phase = 'test')), 6) AS e2e_fps,
      count(*) FILTER (WHERE phase = 'warmup') AS warmup_iterations,
      count(*) FILTER (WHERE phase = 'test') AS test_iterations,
      count(*) AS total_iterations
    FROM phased_v GROUP BY run_id"""
)
def run_statistics(spark, sf_dir):
    stats = ops.run_statistics(phased(spark, sf_dir), ["run_id"], sizes=timing(spark, sf_dir))
    flat = [
        F.col(f"{s}.{m}").alias(f"{s}_{m}")
        for s in ops.STAGES
        for m in ("avg", "min", "max", "std", "p50", "p95", "p99", "sum")
    ]
    flat += [F.col(f"ratios.{s}").alias(f"{s}_ratio") for s in ops.PARTS]
    flat += [F.col(f"fps.{s}").alias(f"{s}_fps") for s in ("pure", "e2e")]
    flat += [F.col(f"iterations.{s}").alias(f"{s}_iterations") for s in ("warmup", "test", "total")]
    return rounded(stats.select("run_id", *flat))


@query(
    f"SELECT run_id, device_id, {_stats_sql('execute_s * 1000', exact=True)} "
    "FROM timing_v GROUP BY run_id, device_id"
)
def stage_stats(spark, sf_dir):
    return rounded(ops.stage_stats(timing(spark, sf_dir), ["run_id", "device_id"], "execute_s"))


@query(f"SELECT run_id, {_stats_sql('total_s * 1000')} FROM timing_big_v GROUP BY run_id")
def stage_stats_many_runs(spark, sf_dir):
    return rounded(ops.stage_stats(timing_big(spark, sf_dir), ["run_id"], "total_s"))


@query(
    " UNION ALL ".join(
        f"SELECT run_id, '{s}' AS stage, {_stats_sql(f'{s}_s * 1000')} "
        "FROM timing_v GROUP BY run_id"
        for s in ops.STAGES
    )
)
def stage_stats_long(spark, sf_dir):
    return rounded(ops.stage_stats_long(timing(spark, sf_dir), ["run_id"]))


@query(
    "SELECT run_id, "
    + ", ".join(f"round(sum({s}_s) / sum(total_s) * 100, 6) AS {s}" for s in ops.PARTS)
    + " FROM timing_v GROUP BY run_id"
)
def stage_ratios(spark, sf_dir):
    return rounded(ops.stage_ratios(timing(spark, sf_dir), ["run_id"]))


@query(
    """SELECT run_id, count(*) FILTER (WHERE phase = 'warmup') AS warmup,
      count(*) FILTER (WHERE phase = 'test') AS test, count(*) AS total
    FROM phased_v GROUP BY run_id"""
)
def iteration_counts(spark, sf_dir):
    return ops.iteration_counts(phased(spark, sf_dir), ["run_id"])


@query(
    """SELECT run_id, round(sum(total_s * 1000), 6) AS test_time_ms,
      round(avg(total_s * 1000), 6) AS avg_iteration_ms
    FROM phased_v WHERE phase = 'test' GROUP BY run_id"""
)
def run_duration(spark, sf_dir):
    kept = ops.drop_warmup_phase(phased(spark, sf_dir))
    return rounded(ops.run_duration(kept, ["run_id"]))


@query(
    f"""SELECT *, round(completed_tasks / total_time, 6) AS throughput_fps FROM (
      SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS total_time,
        count(*) AS completed_tasks, {_stats_sql('total_s * 1000').replace(', count(*) AS count', '')}
      FROM timing_v GROUP BY run_id)"""
)
def throughput_stats(spark, sf_dir):
    stats = ops.throughput_stats(timing(spark, sf_dir), ["run_id"])
    flat = stats.select("run_id", "total_time", "completed_tasks", "throughput_fps", "latency.*")
    return rounded(flat.drop("count"))


@query(
    """SELECT event_id, run_id, round(total_s, 6) AS total_s, round(execute_s * 1000, 6) AS execute_ms
    FROM timing_v"""
)
def total_and_milliseconds(spark, sf_dir):
    return rounded(
        timing(spark, sf_dir).select(
            "event_id", "run_id", "total_s", to_ms(F.col("execute_s")).alias("execute_ms")
        )
    )


@query("SELECT event_id, run_id, phase FROM phased_v")
def mark_auto_warmup(spark, sf_dir):
    return phased(spark, sf_dir).select("event_id", "run_id", "phase")


@query(
    """SELECT run_id, round(1000 / avg(execute_s * 1000), 6) AS pure,
      round(1000 / avg(total_s * 1000), 6) AS e2e,
      round(1000 / avg(execute_s * 1000) * 4, 6) AS batch_pure, count(*) * 4 AS effective_images
    FROM timing_v GROUP BY run_id"""
)
def frame_rates(spark, sf_dir):
    averages = timing(spark, sf_dir).groupBy("run_id").agg(
        F.avg(to_ms(F.col("execute_s"))).alias("exe"),
        F.avg(to_ms(F.col("total_s"))).alias("total"),
        F.count(F.lit(1)).alias("n"),
    )
    pure = fps(F.col("exe"))
    return rounded(
        averages.select(
            "run_id",
            pure.alias("pure"),
            fps(F.col("total")).alias("e2e"),
            batch_fps(pure, 4).alias("batch_pure"),
            (F.col("n") * 4).alias("effective_images"),
        )
    )


@query(
    """SELECT event_id, CASE WHEN preprocess_s > 0 THEN execute_s / preprocess_s ELSE 1 END AS speedup,
      CASE WHEN postprocess_s > 0 THEN (CASE WHEN preprocess_s > 0
        THEN execute_s / preprocess_s ELSE 1 END) / postprocess_s * 100 ELSE 0 END AS efficiency
    FROM timing_v"""
)
def speedup_and_efficiency(spark, sf_dir):
    gain = speedup(F.col("execute_s"), F.col("preprocess_s"))
    return timing(spark, sf_dir).select(
        "event_id",
        gain.alias("speedup"),
        parallel_efficiency(gain, F.col("postprocess_s")).alias("efficiency"),
    )


@query(
    """SELECT run_id, device_id, round(avg(total_s), 6) AS avg_time, round(min(total_s), 6) AS min_time,
      round(max(total_s), 6) AS max_time, count(*) AS total_iterations,
      round(1 / avg(total_s), 6) AS fps
    FROM attempts_v WHERE success GROUP BY run_id, device_id"""
)
def single_run_stats(spark, sf_dir):
    return rounded(ops.single_run_stats(attempts(spark, sf_dir), ["run_id", "device_id"]))


_SWEEP = """avg(total_s) FILTER (WHERE success) AS avg_time,
  min(total_s) FILTER (WHERE success) AS min_time, max(total_s) FILTER (WHERE success) AS max_time,
  sum(total_s) FILTER (WHERE success) AS total_time, count(*) AS iterations,
  count(*) / sum(total_s) FILTER (WHERE success) AS fps"""

VIEWS["thread_sweep_v"] = (
    f"SELECT run_id, num_threads, {_SWEEP} FROM attempts_v GROUP BY run_id, num_threads"
)
VIEWS["resolution_sweep_v"] = f"""
SELECT resolution, {_SWEEP} FROM attempts_v SEMI JOIN resolutions_v USING (resolution)
GROUP BY resolution"""
_ROUND_SWEEP = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("avg_time", "min_time", "max_time", "total_time", "fps")
)


@query(f"SELECT run_id, num_threads, iterations, {_ROUND_SWEEP} FROM thread_sweep_v")
def thread_sweep(spark, sf_dir):
    return rounded(ops.thread_sweep(attempts(spark, sf_dir), ["run_id"]))


@query(
    f"""SELECT run_id, num_threads, iterations, {_ROUND_SWEEP},
      round(fps / first_value(fps) OVER (PARTITION BY run_id ORDER BY num_threads), 6) AS improvement
    FROM thread_sweep_v"""
)
def sweep_improvement(spark, sf_dir):
    sweep = ops.thread_sweep(attempts(spark, sf_dir), ["run_id"])
    return rounded(ops.sweep_improvement(sweep, ["run_id"]))


@query(
    f"""SELECT resolution, iterations, {_ROUND_SWEEP}, width::BIGINT * height AS pixels,
      round(fps / (width * height / 1e6), 6) AS fps_per_million_pixels
    FROM resolution_sweep_v JOIN resolutions_v USING (resolution)"""
)
def resolution_sweep(spark, sf_dir):
    return rounded(ops.resolution_sweep(attempts(spark, sf_dir)))


@query(
    "SELECT resolution, round(fps, 6) AS fps FROM resolution_sweep_v ORDER BY fps DESC, resolution"
)
def rank_resolutions(spark, sf_dir):
    ranked = ops.rank_resolutions(ops.resolution_sweep(attempts(spark, sf_dir)))
    return rounded(ranked.select("resolution", "fps"))


@query(
    """SELECT round(avg(execute_s), 6) AS avg_inference, round(min(execute_s), 6) AS min_inference,
      round(max(execute_s), 6) AS max_inference, round(1 / avg(execute_s), 6) AS inference_fps,
      round(avg(total_s), 6) AS avg_total, round(count(*) / sum(total_s), 6) AS images_per_second,
      round(sum(preprocess_s) / sum(total_s) * 100, 6) AS preprocess_ratio,
      round(sum(execute_s) / sum(total_s) * 100, 6) AS execute_ratio,
      round(sum(postprocess_s) / sum(total_s) * 100, 6) AS result_ratio
    FROM timing_v"""
)
def batch_run_stats(spark, sf_dir):
    return rounded(ops.batch_run_stats(timing(spark, sf_dir), []))


@query(
    """SELECT event_id, run_id,
      round(avg(execute_s) OVER (PARTITION BY run_id ORDER BY event_id
        ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 12) AS avg_last_10,
      round(avg(execute_s) OVER (PARTITION BY run_id ORDER BY event_id
        ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 12) AS avg_last_100
    FROM timing_v"""
)
def rolling_latency(spark, sf_dir):
    rolled = ops.rolling_avg(
        timing(spark, sf_dir).select("run_id", "event_id", "execute_s"),
        ["run_id"],
        "event_id",
        "execute_s",
    )
    return rounded(rolled.drop("execute_s"), 12)


@query(
    """SELECT event_id, run_id, count(*) OVER (PARTITION BY run_id ORDER BY ts
      ROWS UNBOUNDED PRECEDING) AS completed FROM timing_v"""
)
def throughput_series(spark, sf_dir):
    done = timing(spark, sf_dir).select("event_id", "run_id", "ts")
    return ops.throughput_series(done, ["run_id"]).select("event_id", "run_id", "completed")
