"""Literal cases of the timing family and its edge rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runlens.functions import fps, parallel_efficiency, speedup, theoretical_speedup
from runlens.operators import compare, resources, timing

TIMING = (
    "run_id string, seq int, preprocess_s double, execute_s double, postprocess_s double, "
    "queue_wait_s double, total_s double"
)


def latencies(spark, values):
    return spark.createDataFrame([("r", v) for v in values], "run_id string, s double")


def test_five_latencies(spark):
    got = timing.stage_stats(latencies(spark, [0.01, 0.02, 0.03, 0.04, 0.05]), ["run_id"], "s").first()
    assert (got.avg, got.min, got.max, got["count"]) == pytest.approx((30, 10, 50, 5))
    assert got.std == pytest.approx(200**0.5)
    assert got.p95 == pytest.approx(48)


def test_single_latency_and_no_latency(spark):
    got = timing.stage_stats(latencies(spark, [0.01]), ["run_id"], "s").first()
    assert (got.avg, got.p50, got.p99, got.std) == pytest.approx((10, 10, 10, 0))
    empty = timing.stage_stats(latencies(spark, [None]), ["run_id"], "s").first()
    assert (empty.avg, empty.sum, empty["count"]) == (0, 0, 0)


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    values = [1e12, -1e12] + [0.0003] * 1000
    for ordered in (values, values[::-1], values[1:] + values[:1]):
        got = timing.stage_stats(latencies(spark, ordered).coalesce(1), ["run_id"], "s").first()
        assert (got["sum"], got["avg"], got["count"]) == (300.0, 300.0 / 1002, 1002)
    odd = timing.stage_stats(latencies(spark, [0.01, float("inf")]), ["run_id"], "s").first()
    assert odd["sum"] == odd["avg"] == float("inf")
    assert timing.stage_stats(latencies(spark, [1e30, 1e30]), ["run_id"], "s").first()["sum"] == pytest.approx(2e33)


def test_global_statistics(spark):
    got = timing.stage_stats(latencies(spark, [0.01, 0.03]), [], "s").collect()
    assert len(got) == 1 and got[0].avg == pytest.approx(20)


def test_total_is_filled_only_when_zero(spark):
    df = spark.createDataFrame(
        [("r", 1, 0.01, 0.02, 0.005, 0.001, 0.0), ("r", 2, 0.01, 0.02, 0.0, 0.0, 0.5)], TIMING
    )
    got = [r.total_s for r in timing.with_total(df).orderBy("seq").collect()]
    assert got == pytest.approx([0.036, 0.5])


def ten_records(spark):
    return spark.createDataFrame(
        [("r", i, 0.01, 0.02 + i * 0.001, 0.005, 0.0, 0.035 + i * 0.001) for i in range(10)], TIMING
    )


def test_ten_records(spark):
    df = ten_records(spark).withColumn("phase", F.lit("test"))
    got = timing.run_statistics(df, ["run_id"]).first()
    assert got.iterations.asDict() == {"warmup": 0, "test": 10, "total": 10}
    assert got.execute.avg == pytest.approx(24.5)
    assert got.fps.pure == pytest.approx(1000 / 24.5)
    assert got.fps.e2e == pytest.approx(1000 / 39.5)
    assert got.ratios.execute == pytest.approx(24.5 / 39.5 * 100)
    assert got.duration.test_time_ms == pytest.approx(395)


@pytest.mark.parametrize("n, dropped", [(3, 3), (0, 1), (1, 1), (50, 10)])
def test_auto_warmup(spark, n, dropped):
    marked = timing.mark_auto_warmup(ten_records(spark), ["run_id"], "seq", n)
    got = [r.seq for r in marked.filter("phase = 'warmup'").orderBy("seq").collect()]
    assert got == list(range(dropped))


def test_warmup_limit_is_applied_before_the_shuffle(spark):
    plan = timing.mark_auto_warmup(ten_records(spark), ["run_id"], "seq", 3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_run_with_only_warmup_has_zeros(spark):
    df = ten_records(spark).withColumn("phase", F.lit("warmup"))
    got = timing.run_statistics(df, ["run_id"]).first()
    assert got.iterations.asDict() == {"warmup": 10, "test": 0, "total": 10}
    assert got.execute.avg == 0 and got.fps.pure == 0 and got.ratios.execute == 0


def test_all_zero_totals(spark):
    df = spark.createDataFrame([("r", 1, 0.0, 0.0, 0.0, 0.0, 0.0)], TIMING)
    got = timing.stage_ratios(df, ["run_id"]).first()
    assert tuple(got)[1:] == (0, 0, 0, 0)


@pytest.mark.parametrize(
    "base, rate, theory, gain, efficiency",
    [(100.0, 400.0, 4.0, 4.0, 100.0), (100.0, 300.0, 4.0, 3.0, 75.0), (0.0, 400.0, 4.0, 1.0, 25.0),
     (100.0, 300.0, 0.0, 3.0, 0.0)],
)
def test_speedup(spark, base, rate, theory, gain, efficiency):
    row = spark.range(1).select(
        speedup(F.lit(rate), F.lit(base)).alias("s"),
        parallel_efficiency(speedup(F.lit(rate), F.lit(base)), F.lit(theory)).alias("e"),
        fps(F.lit(0.0)).alias("none"),
    ).first()
    assert tuple(row) == pytest.approx((gain, efficiency, 0.0))


def test_theoretical_speedup(spark):
    names = ["multithread", "batch", "pipeline", "memory_pool", "high_res_tiling", "cache"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "s string, i int").orderBy("i")
    got = [r[0] for r in df.select(theoretical_speedup(F.col("s"), F.lit(3), F.lit(8))).collect()]
    assert got == [3.0, 8.0, 4.0, 1.1, 1.0, None]


def test_sweeps_count_attempts(spark):
    df = spark.createDataFrame(
        [(1, 0.1, True), (1, 0.1, False), (2, 0.05, True), (2, 0.05, True), (4, 0.2, False)],
        "num_threads int, total_s double, success boolean",
    )
    sweep = timing.thread_sweep(df)
    got = {r.num_threads: r.fps for r in sweep.collect()}
    assert got == pytest.approx({1: 20.0, 2: 20.0})
    gains = {r.num_threads: r.improvement for r in timing.sweep_improvement(sweep).collect()}
    assert gains == pytest.approx({1: 1.0, 2: 1.0})


def test_throughput_of_one_completion_is_zero(spark):
    df = spark.createDataFrame([("r", 1, 0.02)], "run_id string, at long, total_s double")
    got = timing.throughput_stats(df.withColumn("ts", F.timestamp_seconds("at")), ["run_id"]).first()
    assert (got.total_time, got.throughput_fps, got.completed_tasks) == (0, 0, 1)
    assert got.latency.avg == pytest.approx(20)


def test_baseline_comparison(spark):
    rows = spark.createDataFrame(
        [("multithread", None, 400.0, 4.0), ("batch", "tiled_route", 200.0, 4.0)],
        "strategy string, route_type string, fps double, theoretical_speedup double",
    )
    base = spark.createDataFrame([(None, 100.0)], "route_type string, fps double")
    got = {r.strategy: r for r in compare.compare_to_baseline(rows, base, ["route_type"]).collect()}
    assert got["multithread"].speedup == 4.0 and got["multithread"].parallel_efficiency == 100.0
    assert got["batch"].speedup == 1.0 and got["batch"].baseline_fps == 0.0


def test_resource_stats_ignore_missing_samples(spark):
    df = spark.createDataFrame(
        [("r", 1, 0.0, 0.0, 10.0, 100.0, 0.0), ("r", 3, 50.0, 20.0, 30.0, 100.0, 0.0)],
        "run_id string, at long, cpu_percent double, memory_percent double, memory_used_mb double, "
        "memory_total_mb double, npu_utilization double",
    ).withColumn("ts", F.timestamp_seconds("at"))
    got = resources.resource_stats(df, ["run_id"], "ts").first()
    assert got.cpu.asDict() == {"avg": 50.0, "max": 50.0, "min": 50.0}
    assert got.memory.current_mb == 30.0 and got.duration_seconds == 2.0 and got.npu is None
    assert "npu" not in resources.resource_stats(df, ["run_id"], "ts", with_accelerator=False).columns


def test_counted_spread_of_large_values(spark):
    df = spark.createDataFrame([("a", 1e8, 1), ("a", 1e8 + 1, 1), ("a", 1e8 + 2, 1), ("b", 5.0, 3), ("c", None, 2)], "k string, ms double, n long")
    got = {r.k: r for r in timing.counted_stats(df, ["k"], "ms", "n").collect()}
    assert abs(got["a"].std - 0.816497) < 1e-6 and got["a"].avg == 1e8 + 1
    assert (got["b"].std, got["b"]["count"], got["c"].std) == (0.0, 3, 0.0)
