"""Plans for large groups must give what the plain plans give."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.operators import batching, quantiles, slicing, timing


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """Run 'a' holds most rows, with clustered times; one run has a null key."""
    rng = random.Random(7)
    data = []
    for run, n in (("a", 900), ("b", 40), ("c", 1), (None, 150)):
        ts = 0.0
        for i in range(n):
            ts += rng.choice([0.001, 0.5, 5.0, 300.0])
            data.append((run, i * 3, int(ts * 1000), rng.randint(0, 2), rng.choice([0.002, 0.02, 0.2])))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "run_id string, seq long, ms long, priority int, lat double")
    return df.withColumn("ts", F.timestamp_millis("ms")).cache()


@pytest.mark.parametrize("size", [7, 64, 500])
def test_position(skewed, size):
    found = slicing.with_position(skewed, ["run_id"], ["seq"], "p", size)
    plain = skewed.withColumn("p", F.row_number().over(Window.partitionBy("run_id").orderBy("seq")))
    assert rows(found.select("run_id", "seq", "p"), "run_id", "seq") == rows(
        plain.select("run_id", "seq", "p"), "run_id", "seq"
    )


def test_position_with_repeating_prefix(skewed):
    found = slicing.with_position(skewed, ["run_id"], ["priority", "seq"], "p", 30)
    window = Window.partitionBy("run_id").orderBy("priority", "seq")
    plain = skewed.withColumn("p", F.row_number().over(window))
    assert rows(found.select("run_id", "seq", "p"), "run_id", "seq") == rows(
        plain.select("run_id", "seq", "p"), "run_id", "seq"
    )


def test_position_over_everything(skewed):
    numbered = slicing.with_position(skewed, [], ["ms"], "p", 50, tie=["run_id", "seq"])
    found = sorted(r.p for r in numbered.collect())
    assert found == list(range(1, 1092))
    assert "_all" not in numbered.columns


LIMITS = (10, 1_000_000)


@pytest.mark.parametrize("keys", [["run_id"], []])
def test_any_order_and_no_keys_give_the_same_at_every_limit(skewed, keys):
    """String order, with and without keys, by a limit far below and far above the number of rows."""
    named = skewed.withColumn("name", F.format_string("%s-%05d", F.coalesce("run_id", F.lit("z")), "seq"))
    results = []
    for limit in LIMITS:
        rolled = timing.rolling_avg(named, keys, "name", "lat", (3,), limit)
        chunks = batching.chunk_with_padding(named, keys, "name", "seq", 7, limit)
        gaps = batching.gap_batches(named, keys, "ts", 4, 5.0, limit, tie=["name"])
        places = slicing.with_position(named, keys, ["name"], "p", limit)
        assert rolled.columns == [*named.columns, "avg_last_3"] and "_all" not in gaps.columns
        results.append((
            rows(rolled.select("name", F.round("avg_last_3", 12)), "name"), rows(chunks, *keys, "chunk_no"),
            rows(gaps.select("name", "session_no", "batch_no"), "name"), rows(places.select("name", "p"), "name"),
        ))
    assert results[0] == results[1]


@pytest.mark.parametrize("kind", ["cluster", "outlier", "strings", "ties"])
def test_slices_stay_within_twice_the_limit(spark, kind):
    """Slices divide rows, not values."""
    at = {
        "cluster": F.when(F.col("id") % 100 < 97, F.col("id") / 1e6).otherwise(F.col("id") * 60.0),
        "outlier": F.when(F.col("id") == 0, -1e9).otherwise(F.col("id").cast("double")),
        "strings": F.format_string("%06d", "id"),
        "ties": F.lit(1),
    }[kind]
    df = spark.range(10_000).select(F.lit("a").alias("run"), "id", at.alias("at"))
    cut, slices = slicing.sliced(df, ["run"], ["at", "id"], 100)
    sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) <= 200 and slices == 150
    wanted = df.withColumn("p", F.row_number().over(Window.partitionBy("run").orderBy("at", "id")))
    found = slicing.with_position(df, ["run"], ["at"], "p", 100, tie=["id"])
    assert rows(found.select("id", "p"), "id") == rows(wanted.select("id", "p"), "id")


@pytest.mark.parametrize("size", [5, 33])
def test_rolling_average(skewed, size):
    found = timing.rolling_avg(skewed, ["run_id"], "seq", "lat", (3, 10), size)
    plain = timing.rolling_avg(skewed, ["run_id"], "seq", "lat", (3, 10))
    kept = ["run_id", "seq", F.round("avg_last_3", 12), F.round("avg_last_10", 12)]
    assert rows(found.select(*kept), "run_id", "seq") == rows(plain.select(*kept), "run_id", "seq")


@pytest.mark.parametrize("size", [6, 100])
def test_gap_batches(skewed, size):
    def batches(rows_per_slice):
        return rows(
            batching.gap_batches(skewed, ["run_id"], "ts", 4, 5.0, rows_per_slice, tie=["seq"]).select(
                "run_id", "seq", "session_no", "batch_no"
            ),
            "run_id",
            "seq",
        )

    assert batches(size) == batches(10_000)


def test_priority_batches(skewed):
    few = batching.priority_batches(skewed, ["run_id"], 8, 25)
    plain = batching.priority_batches(skewed, ["run_id"], 8)
    kept = ["run_id", "seq", "batch_no", "slot"]
    assert rows(few.select(*kept), "run_id", "seq") == rows(plain.select(*kept), "run_id", "seq")


def walk(latencies, start, low, high, every):
    size, out = start, []
    for i in range(len(latencies) // every):
        mean = sum(latencies[i * every : (i + 1) * every]) / every
        if mean < 0.01:
            size = min(size + 1, high)
        elif mean > 0.05:
            size = max(size - 1, low)
        out.append(size)
    return out


@pytest.mark.parametrize("start", [1, 4, 6])
def test_adaptive_trace_in_blocks(skewed, monkeypatch, start):
    monkeypatch.setattr(batching, "_STEPS_PER_BLOCK", 5)
    found = batching.adaptive_batch_trace(
        skewed, ["run_id"], "seq", "lat", start, 2, 6, 3, rows_per_slice=40
    )
    got: dict = {}
    for r in found.orderBy("step").collect():
        got.setdefault(r.run_id, []).append(r.batch_size)
    want = {}
    for run in ("a", "b", None):
        values = [
            r.lat for r in skewed.filter(F.col("run_id").eqNullSafe(run)).orderBy("seq").collect()
        ]
        want[run] = walk(values, start, 2, 6, 3)
    assert got == want


def test_chunks_of_a_large_submission(skewed):
    def chunks(rows_per_slice):
        return rows(
            batching.chunk_with_padding(skewed, ["run_id"], "seq", "seq", 7, rows_per_slice),
            "run_id",
            "chunk_no",
        )

    assert chunks(20) == chunks(10_000)
    last = [r for r in chunks(20) if r[0] == "c"][0]
    assert last[2] == 1 and last[3] == [0] * 7


@pytest.mark.parametrize(
    "values",
    [
        [0.0] * 400,
        [0.0] * 300 + [float(i) for i in range(100)],
        [float(i % 3) for i in range(500)],
        list(np.random.default_rng(3).lognormal(2, 1.5, 700)),
        list(np.random.default_rng(4).normal(0, 5, 333)),
    ],
)
def test_selected_percentiles(spark, values):
    df = spark.createDataFrame([("x", float(v)) for v in values], "k string, v double")
    got = quantiles.selected_percentiles(df, ["k"], ["v"], limit=50).collect()[0]["_q_v"]
    assert got == pytest.approx(np.percentile(values, [50, 95, 99]), rel=1e-12)


def test_selected_percentiles_with_weights(spark):
    values = [(1.0, 5), (2.0, 40), (7.5, 3), (9.0, 2)]
    df = spark.createDataFrame([("x", v, w) for v, w in values], "k string, v double, w long")
    got = quantiles.selected_percentiles(df, ["k"], ["v"], limit=10, weight="w").collect()[0]["_q_v"]
    flat = [v for v, w in values for _ in range(w)]
    assert got == pytest.approx(np.percentile(flat, [50, 95, 99]))


def test_counted_stats_equal_plain_stats(spark):
    values = [0.001 * (i % 17) for i in range(300)]
    plain = spark.createDataFrame([("x", v) for v in values], "k string, v double")
    counted = plain.groupBy("k", (F.col("v") * 1000).alias("ms")).agg(F.count("*").alias("n"))
    a = timing.stage_stats(plain, ["k"], "v").collect()[0].asDict()
    for limit in (100_000, 10):
        b = timing.counted_stats(counted, ["k"], "ms", "n", limit).collect()[0].asDict()
        assert {k: v for k, v in b.items() if k != "k"} == pytest.approx(
            {k: v for k, v in a.items() if k != "k"}
        )


def test_run_statistics_of_large_runs(skewed):
    base = skewed.select(
        F.coalesce("run_id", F.lit("n")).alias("run_id"),
        "seq",
        F.col("lat").alias("preprocess_s"),
        (F.col("ms") / 1000).alias("execute_s"),
        F.lit(0.0).alias("postprocess_s"),
        (F.col("priority") / 7).alias("queue_wait_s"),
        F.lit(0.0).alias("total_s"),
    )
    marked = timing.mark_auto_warmup(timing.with_total(base), ["run_id"], "seq", 4)
    plain = timing.run_statistics(marked, ["run_id"])
    split = timing.run_statistics(marked, ["run_id"], large_group=60)
    for a, b in zip(plain.orderBy("run_id").collect(), split.orderBy("run_id").collect()):
        for stage in timing.STAGES:
            assert a[stage].asDict() == pytest.approx(b[stage].asDict())
        assert a["iterations"] == b["iterations"]


def test_reassembly_continues_in_further_rows(spark):
    parts = spark.range(2500).select(
        F.lit(1).alias("batch_id"), F.col("id").alias("sub_batch_id"), F.col("id").cast("string").alias("result")
    )
    found = batching.reassemble_batches(parts, 1000).orderBy("part_no").collect()
    assert [len(r.results) for r in found] == [1000, 1000, 500]


def test_reassembly_keeps_the_later_delivery(spark):
    df = spark.createDataFrame(
        [(1, 0, "old", 1), (1, 0, "new", 2), (1, 1, "x", 1)],
        "batch_id int, sub_batch_id long, result string, at int",
    )
    assert batching.reassemble_batches(df, order=["at"]).collect()[0].results == {0: "new", 1: "x"}


def test_one_huge_value_does_not_fill_a_cell(spark):
    values = [(i % 5003) / 5003 for i in range(20_000)] + [1e9]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    got = quantiles.selected_percentiles(df, ["k"], ["v"], limit=100).first()._q_v
    assert [round(x, 9) for x in got] == [round(float(x), 9) for x in np.percentile(values, [50, 95, 99])]


def test_percentiles_hold_when_approximate_bounds_vary(spark, monkeypatch):
    """Every evaluation of the bounds finds others, as on a cluster where partial results arrive in any order."""
    moved = F.udf(lambda: random.SystemRandom().uniform(0, 200), "double").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda column, *_: F.array(F.min(column) + moved(), F.max(column) - moved()))
    values = [float(i % 3001) for i in range(12_000)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    want = pytest.approx(np.percentile(values, [50, 95, 99]))
    for _ in range(3):
        assert quantiles.selected_percentiles(df, ["k"], ["v"], limit=100).first()._q_v == want
