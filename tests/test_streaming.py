"""Streams in several triggers against their batch twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import batching, timing
from runlens.sources.shared import scratch_path
from runlens.streaming import carried, live, stateful

SCHEMA = "run_id string, seq long, lat double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five files that arrive one after the other; run 'a' holds most rows."""
    rng = random.Random(5)
    path = tmp_path_factory.mktemp("stream")
    seq = {"a": 0, "b": 0, "c": 0}
    for part in range(5):
        rows = []
        for run, n in (("a", 37), ("b", 3), ("c", 8 if part == 4 else 0)):
            for _ in range(n):
                rows.append((run, seq[run], rng.choice([0.001, 0.03, 0.2])))
                seq[run] += 1
        rng.shuffle(rows)
        target = path / f"{part}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(target))
        for file in target.glob("*.parquet"):
            file.rename(path / f"{part}.parquet")
    return path


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False)
    return reader.option("pathGlobFilter", "*.parquet").parquet(str(folder))


def batch(spark, folder):
    return spark.read.schema(SCHEMA).parquet(*[str(folder / f"{i}.parquet") for i in range(5)])


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_warmup_over_triggers(spark, folder):
    got = carried.live_warmup_drop(stream(spark, folder), ["run_id"], "seq", 5)
    marked = timing.mark_auto_warmup(batch(spark, folder), ["run_id"], "seq", 5)
    assert rows(got, "run_id", "seq") == rows(marked.filter("phase = 'test'"), "run_id", "seq")


def test_adaptive_size_over_triggers(spark, folder):
    got = carried.live_adaptive_batch(stream(spark, folder), ["run_id"], "seq", "lat", 3, 1, 6, 4)
    want = batching.adaptive_batch_trace(batch(spark, folder), ["run_id"], "seq", "lat", 3, 1, 6, 4)
    columns = ("run_id", "step", "batch_size")
    assert rows(got, *columns) == rows(want, *columns)


PARTS = "batch_id long, sub_batch_id long, result string, expected long, at long"


def write_parts(spark, path, *files):
    for i, part in enumerate(files):
        spark.createDataFrame(part, PARTS).coalesce(1).write.parquet(f"{path}/w{i}")
        for file in (path / f"w{i}").glob("*.parquet"):
            file.rename(path / f"{i}.parquet")


def test_reassembly(spark, tmp_path):
    """1 completes, 2 times out, 3 completes and gets a late part, 4 stays open."""
    write_parts(
        spark,
        tmp_path,
        [(1, 0, "a", 2, 1000), (2, 0, "x", 3, 1000), (3, 0, "p", 1, 1001)],
        [(1, 1, "b", 2, 1005), (3, 7, "late", 1, 1006)],
        [(4, 0, "o", 2, 9000)],
        [(4, 1, "x", 3, 9001)],
    )
    reader = spark.readStream.schema(PARTS).option("maxFilesPerTrigger", 1)
    parts = (
        reader.option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))
        .select("batch_id", "sub_batch_id", "result", "expected", F.timestamp_seconds("at").alias("ts"))
        .withWatermark("ts", "10 seconds")
    )
    got = live.run_available(stateful.live_reassemble(parts, 60_000), "reassembly")
    assert rows(got, "batch_id", "sub_batch_id", "result", "status") == [
        (1, 0, "a", "complete"),
        (1, 1, "b", "complete"),
        (2, 0, "x", "timeout"),
        (3, 0, "p", "complete"),
        (3, 7, "late", "late"),
    ]


def test_callback_per_row(spark, folder):
    seen = spark.sparkContext.accumulator(0)
    query = live.on_result_stream(
        stream(spark, folder), lambda row, batch_id: seen.add(1), scratch_path(spark, "callback")
    )
    query.awaitTermination()
    assert seen.value == batch(spark, folder).count()


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_labels_do_not_depend_on_arrow_batches(spark, tmp_path, size):
    """40 parts of a batch that expects 25, one of them twice, in one trigger."""
    sent = [(1, i, f"r{i}", 25, 5) for i in range(20)] + [(1, 3, "again", 25, 5)] + [(1, i, f"r{i}", 25, 6) for i in range(20, 40)]
    schema = "batch_id long, sub_batch_id long, result string, expected int, at long"
    spark.createDataFrame(sent, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    parts = (
        spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        .select("batch_id", "sub_batch_id", "result", "expected", F.timestamp_seconds("at").alias("ts"))
        .withWatermark("ts", "10 seconds")
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = rows(live.run_available(stateful.live_reassemble(parts, 60_000), "arrow"), "sub_batch_id", "result", "status")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    complete = [(i, "again" if i == 3 else f"r{i}", "complete") for i in range(25)]
    assert got == complete + [(i, f"r{i}", "late") for i in range(25, 40)]


def test_restart_goes_on(spark, tmp_path):
    """A second start with the same folder takes only what is new, and keeps the state of the first."""
    source, base = tmp_path / "in", str(tmp_path / "base")
    want = []
    for part in range(2):
        sent = [("a", part * 4 + i, 0.5) for i in range(4)]
        spark.createDataFrame(sent, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        rows_in = spark.readStream.schema(SCHEMA).parquet(str(source))
        got = carried.run_carried(rows_in, "restart", _count_rows, "run_id string, seen bigint", base)
        want.append(rows(got, "run_id", "seen"))
    assert want == [[("a", 4)], [("a", 4), ("a", 8)]]


def _count_rows(new, state):
    both = state.unionByName(new.groupBy("run_id").agg(F.count("*").alias("seen"))).groupBy("run_id").agg(F.sum("seen").alias("seen"))
    return both, both


def test_empty_stream(spark, tmp_path):
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert carried.live_warmup_drop(empty, ["run_id"], "seq", 5).columns == ["run_id", "seq", "lat"]
    assert live.run_available(empty, "empty").count() == 0


TIMES = "run_id string, seq long, at double, preprocess_s double, execute_s double, postprocess_s double, queue_wait_s double, total_s double"


@pytest.fixture(scope="module")
def timed_folder(spark, tmp_path_factory):
    """Four files of rows in order of time; run 'a' holds most of them."""
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("timed")
    at, seq = 1_700_000_000.0, 0
    for part in range(4):
        rows_in = []
        for _ in range(120):
            at += rng.choice([0.5, 7.0, 60.0])
            parts = [rng.choice([0.001, 0.02, rng.random()]) for _ in range(4)]
            rows_in.append((rng.choice("aaaab"), seq, at, *parts, sum(parts)))
            seq += 1
        spark.createDataFrame(rows_in, TIMES).coalesce(1).write.parquet(str(path / f"{part}"))
        for file in (path / f"{part}").glob("*.parquet"):
            file.rename(path / f"{part}.parquet")
    return path


def timed_rows(reader):
    return reader.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))


def timed_stream(spark, folder, files):
    reader = spark.readStream.schema(TIMES).option("maxFilesPerTrigger", files)
    return timed_rows(reader.option("pathGlobFilter", "*.parquet").parquet(str(folder)))


def timed_batch(spark, folder):
    return timed_rows(spark.read.schema(TIMES).parquet(*[str(folder / f"{i}.parquet") for i in range(4)]))


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[-1] == b[-1]
        assert all(abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(a[3:-1], b[3:-1]))


@pytest.mark.parametrize("files", [1, 4])
def test_stage_statistics_equal_batch_over_the_whole_table(spark, timed_folder, files):
    def stats(frame):
        return live.live_stage_stats(frame, ["run_id"], "10 minutes", "1 minute")

    streamed = stats(timed_stream(spark, timed_folder, files))
    assert streamed.isStreaming
    released = live.run_available(streamed, "stats")
    table = timed_batch(spark, timed_folder)
    got = live.with_open_windows(stats, released, table)
    columns = ("window_start", "run_id", "stage", "avg", "min", "max", "std", "p50", "p95", "p99", "sum", "count")
    long = table.withColumn("window_start", F.window("ts", "10 minutes")["start"])
    want = timing.stage_stats_long(long, ["window_start", "run_id"]).select(*columns)
    close(rows(got, *columns), rows(want, *columns))
    assert 0 < released.count() < want.count()
    slow = live.released_stage_stats(timed_stream(spark, timed_folder, files), ["run_id"], "10 minutes", "1 minute")
    close(rows(slow, *columns), rows(released, *columns))


def test_stage_statistics_go_on_after_a_restart(spark, timed_folder, tmp_path):
    """The second start sees two more files and keeps the state of the first."""
    source, base = tmp_path / "in", str(tmp_path / "base")
    source.mkdir()

    def stats(frame):
        return live.live_stage_stats(frame, ["run_id"], "10 minutes", "1 minute")

    for part in ((0, 1), (2, 3)):
        for i in part:
            (source / f"{i}.parquet").write_bytes((timed_folder / f"{i}.parquet").read_bytes())
        released = live.run_available(stats(timed_stream(spark, source, 1)), "restarted", base)
    got = live.with_open_windows(stats, released, timed_batch(spark, timed_folder))
    whole = stats(timed_batch(spark, timed_folder))
    columns = ("window_start", "run_id", "stage", "sum", "count")
    assert [r[:3] + r[4:] for r in rows(got, *columns)] == [r[:3] + r[4:] for r in rows(whole, *columns)]


@pytest.mark.parametrize("files", [1, 4])
def test_gap_batches_number_every_arrival(spark, timed_folder, files):
    stream_in = timed_stream(spark, timed_folder, files)
    got = live.run_available(stateful.live_gap_batches(stream_in, ["run_id"], "seq", 50.0, 4), "gaps")
    want = batching.gap_batches(timed_batch(spark, timed_folder), ["run_id"], "ts", 4, 50.0, tie=["seq"])
    assert {r.status for r in got.select("status").distinct().collect()} == {"numbered"}
    found = rows(got, "run_id", "item", "session_no", "batch_no")
    assert found == rows(want.withColumnRenamed("seq", "item"), "run_id", "item", "session_no", "batch_no")


def test_late_arrivals_get_no_numbers(spark, tmp_path):
    for i, sent in enumerate([[("a", 1, 100), ("a", 2, 103)], [("a", 3, 50), ("a", 4, 103), ("a", 5, 300)]]):
        spark.createDataFrame(sent, "run_id string, seq long, at long").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        for file in (tmp_path / f"w{i}").glob("*.parquet"):
            file.rename(tmp_path / f"{i}.parquet")
    reader = spark.readStream.schema("run_id string, seq long, at long").option("maxFilesPerTrigger", 1)
    arrivals = reader.option("pathGlobFilter", "*.parquet").parquet(str(tmp_path)).withColumn("ts", F.timestamp_seconds("at"))
    got = live.run_available(stateful.live_gap_batches(arrivals, ["run_id"], "seq", 10.0, 2), "late")
    assert rows(got.fillna(-1), "item", "session_no", "batch_no", "status") == [
        (1, 1, 0, "numbered"), (2, 1, 0, "numbered"), (3, -1, -1, "late"), (4, 1, 1, "numbered"), (5, 2, 0, "numbered"),
    ]


def test_open_sessions_and_batches_are_finished(spark, timed_folder):
    def sessions(frame):
        return live.live_gap_sessions(frame.select("run_id", "ts"), ["run_id"], "50 seconds", "1 minute", 4)

    released = live.run_available(sessions(timed_stream(spark, timed_folder, 1)), "sessions")
    table = timed_batch(spark, timed_folder)
    got = live.with_open_sessions(sessions, released, table, ["run_id"])
    assert rows(got, *got.columns) == rows(sessions(table), *got.columns) and released.count() < got.count()
    parts = spark.createDataFrame([(1, 0, "a", 5), (1, 0, "b", 6), (2, 0, "c", 5)], "batch_id long, sub_batch_id long, result string, ts int")
    done = spark.createDataFrame([(2, 0, "c", "complete")], "batch_id long, sub_batch_id long, result string, status string")
    finished = stateful.with_open_batches(done, parts)
    assert rows(finished, *finished.columns) == [(1, 0, "b", "timeout"), (2, 0, "c", "complete")]


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    import duckdb

    from tests.oracle import difference
    from workload import ORACLES, QUERIES

    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    given.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    (tmp_path / "file").mkdir()
    given.toPandas().to_parquet(tmp_path / "file" / "conversations.parquet")
    for kind, files in (("folder", "/*.parquet"), ("file", "")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/{kind}/conversations.parquet{files}'")
        assert difference(QUERIES["live_reassemble"](spark, str(tmp_path / kind)), con, ORACLES["live_reassemble"]) is None
