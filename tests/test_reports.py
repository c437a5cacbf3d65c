"""Metric maps, report rows and lines, sinks and logs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from runlens.functions import deep_merge, sanitize_segment, split_metrics
from runlens.operators import compare, reports
from runlens.sources import configs, logs, sinks

METRICS = "map<string,map<string,double>>"


def test_split_and_merge_back(spark):
    metrics = {"execute": {"avg": 12.0}, "fps": {"pure": 83.3, "e2e": 55.5, "peak": 90.0}, "iterations": {"test": 100.0}}
    df = spark.createDataFrame([(metrics,)], f"m {METRICS}").select(split_metrics(F.col("m")).alias("s"), "m")
    row = df.first()
    assert row.s.model_metrics == {"execute": {"avg": 12.0}, "fps": {"pure": 83.3, "peak": 90.0}}
    assert row.s.system_metrics == {"fps": {"e2e": 55.5}, "iterations": {"test": 100.0}}
    back = df.select(deep_merge(F.col("s.model_metrics"), F.col("s.system_metrics")).alias("b")).first().b
    assert back == metrics


def test_merge_prefers_right(spark):
    df = spark.createDataFrame([({"a": {"x": 1.0, "y": 2.0}}, {"a": {"y": 9.0}, "b": {}})], f"l {METRICS}, r {METRICS}")
    got = df.select(deep_merge(F.col("l"), F.col("r")).alias("m")).first().m
    assert got == {"a": {"x": 1.0, "y": 9.0}, "b": {}}


def test_segments(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), (" a/b\\c ",)], "s string")
    got = [r[0] for r in df.select(sanitize_segment(F.col("s"))).collect()]
    assert got == ["standard", "standard", "standard", "a_b_c"]


RESULT = (
    f"n int, scenario_name string, model_name string, route_type string, strategies array<string>, "
    f"metrics {METRICS}, resource_stats {METRICS}, config map<string,string>, timestamp double"
)


def results(spark):
    stage = {"avg": 1.0, "p50": 1.5, "p95": 2.0, "p99": 2.5, "min": 0.5, "max": 3.0}
    return spark.createDataFrame(
        [
            (1, "s1", "small.om", "tiled_route", ["baseline"],
             {"fps": {"pure": 30.0, "e2e": 20.0}, "total": stage, "strategy": {"speedup": 4.0, "parallel_efficiency": 100.0}},
             {"cpu": {"avg": 10.0, "max": 20.0}, "npu": {"avg_utilization": 5.0}}, None, 1.0),
            (2, "s1", "6k.om", None, None, None, None, {"route_type": "large_input_route"}, 2.0),
        ],
        RESULT,
    )


def test_report_rows(spark):
    got = reports.to_report_row(results(spark)).orderBy("n").collect()
    assert [r.route_type for r in got] == ["tiled_route", "large_input_route"]
    assert got[1].strategies == [] and got[1].metrics == {} and got[1].config["route_type"]


def test_route_comparison(spark):
    rows = reports.to_report_row(results(spark))
    got = reports.route_comparison(rows).collect()
    assert [(r.route, r.result_count, r.models, r.strategies) for r in got] == [
        ("large_input_route", 1, ["6k.om"], []),
        ("tiled_route", 1, ["small.om"], ["baseline"]),
    ]
    lines = [r.line for r in reports.route_table_lines(reports.route_comparison(rows)).collect()]
    assert "| large_input_route | 1 | 6k.om | - |" in lines


def text_of(lines):
    return [r.line for r in lines.orderBy("result_no", "line_no").collect()]


def test_text_lines(spark):
    got = text_of(reports.report_lines(reports.to_report_row(results(spark)), "n", "text"))
    assert got[0] == "[1] s1" and "strategies: baseline" in got
    assert "  pure FPS: 30.00" in got and "  speedup: 4.00x" in got
    assert "  total: avg=1.00ms, p50=1.50ms, p95=2.00ms, p99=2.50ms" in got
    assert "  cpu: avg=10.0%, max=20.0%" in got and "  accelerator: avg=5.0%, max=0.0%" in got
    assert "[2] s1" in got and "strategies: none" in got
    assert got.count("performance:") == 1 and got.count("resources:") == 1


def test_other_styles(spark):
    rows = reports.to_report_row(results(spark))
    assert "- Strategies: baseline" in text_of(reports.report_lines(rows, "n", "markdown"))
    assert text_of(reports.report_lines(rows, "n", "html")) == [
        "<tr><td>total</td><td>1.00</td><td>0.50</td><td>3.00</td><td>1.50</td><td>2.00</td><td>2.50</td></tr>"
    ]
    table = text_of(reports.report_lines(rows, "n", "table"))
    assert len(table) == 2 and table[0].split() == ["small.om", "0.00", "30.00", "20.00"]


def test_comparison_table_and_first_baseline(spark):
    rows = spark.createDataFrame(
        [(2, "m", ["multithread"], 400.0, 400.0, 4.0, 100.0), (1, "m", ["baseline"], 100.0, None, None, None),
         (3, "m", ["baseline"], 90.0, None, None, None), (4, "m", [], 7.0, None, None, None)],
        "n int, model_name string, strategies array<string>, pure_fps double, strategy_fps double, "
        "speedup double, parallel_efficiency double",
    ).withColumns({"execute_avg": F.lit(1.0), "e2e_fps": F.lit(2.0)})
    got = [(r.strategy, r.throughput, r.speedup, r.efficiency) for r in compare.comparison_table(rows, "n").collect()]
    assert got == [
        ("baseline", 100.0, 1.0, 100.0), ("multithread", 400.0, 4.0, 100.0),
        ("baseline", 90.0, 1.0, 100.0), ("unknown", 7.0, 1.0, 0.0),
    ]
    assert compare.first_baseline(rows, [], "n").first().n == 1


def test_archive_replaces_only_its_partitions(spark, tmp_path):
    root = str(tmp_path / "archive")

    def rows(*values):
        return spark.createDataFrame(list(values), "task_name string, route_type string, v int")

    sinks.write_archive(rows(("model/selection", "tiled_route", 1), ("other", None, 2)), root)
    sinks.write_archive(rows(("model/selection", "tiled_route", 3)), root)
    got = {(r.task_name, r.route_type, r.v) for r in spark.read.parquet(root).collect()}
    assert got == {("model_selection", "tiled_route", 3), ("other", "standard", 2)}
    assert (tmp_path / "archive" / "task_name=model_selection" / "route_type=tiled_route").is_dir()


def test_report_json(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report_json(reports.to_report_row(results(spark)), path)
    meta = spark.read.json(f"{path}/metadata").first()
    assert meta.result_count == 2 and meta.version == "1.0"
    models = {json.loads(r.value)["model_name"] for r in spark.read.text(f"{path}/results").collect()}
    assert models == {"small.om", "6k.om"}


def test_report_line_files(spark, tmp_path):
    lines = reports.report_lines(reports.to_report_row(results(spark)), "n", "text")
    path = str(tmp_path / "lines")
    sinks.write_report_lines(lines, path)
    parts = sorted((tmp_path / "lines").glob("part-*"))
    written = "".join(p.read_text() for p in parts).splitlines()
    assert written == text_of(lines)


def test_inference_results(spark, tmp_path):
    df = spark.createDataFrame(
        [("a/x.png", [1.0, 2.0], [0.1]), ("a/y.png", None, [0.1]), ("a/z.png", [1.0], [])],
        "image string, result array<double>, inference_times array<double>",
    )
    path = str(tmp_path / "r")
    sinks.write_inference_results(df, path)
    got = {r.image: (r.status, r.shape) for r in spark.read.schema("image string, status string, shape array<int>").json(path).collect()}
    assert got == {"x.png": ("success", [2]), "y.png": ("failed", None)}


def test_log_lines(spark, tmp_path):
    lines = [
        {"timestamp": "t", "level": "ERROR", "logger": "l", "message": "é", "line": 3, "task": "7"},
        {"level": "INFO", "line": 4},
    ]
    (tmp_path / "a.log").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines))
    got = logs.read_structured_logs(spark, str(tmp_path)).orderBy("line").collect()
    assert got[0].message == "é" and got[0].extra == {"task": "7"} and got[1].extra == {}


def test_sampling_is_stable_and_keeps_errors(spark):
    df = spark.range(10_000).withColumn("level", F.when(F.col("id") % 100 == 0, "ERROR").otherwise("INFO"))
    a = {r.id for r in logs.sample_logs(df, 0.2, F.col("id")).collect()}
    b = {r.id for r in logs.sample_logs(df.repartition(7), 0.2, F.col("id")).collect()}
    assert a == b and {i for i in range(0, 10_000, 100)} <= a and 1800 < len(a) < 2500
    assert logs.sample_logs(df, 1.0, F.col("id")).count() == 10_000


def test_registry_document(spark, tmp_path):
    doc = {
        "models": [{"name": "m", "input_specs": [{"tier": "720p", "width": 1280, "height": 720}], "supported_routes": ["tiled_route"]}],
        "devices": [{"name": "d", "supported_tiers": ["720p"], "supported_routes": ["tiled_route"]}],
        "scenarios": [],
    }
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    models, devices, scenarios = configs.read_registry(spark, str(tmp_path))
    assert models.first().input_specs[0].channels == 3
    assert devices.first().name == "d" and scenarios.count() == 0


def test_experiment_specs(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"model": "m", "images": ["a", "b"], "routes": ["tiled_route"]}))
    got = configs.expand_experiments(configs.read_experiment_specs(spark, str(tmp_path))).collect()
    assert {(r.model_path, r.image_path, r.route_type, r.image_size_tier) for r in got} == {
        ("m", "a", "tiled_route", None), ("m", "b", "tiled_route", None),
    }


def test_merge_with_a_missing_map(spark):
    df = spark.createDataFrame([(None, {"b": {"x": 1.0}}), ({"a": {}}, None), (None, None)], f"l {METRICS}, r {METRICS}")
    got = [r.m for r in df.select(deep_merge(F.col("l"), F.col("r")).alias("m")).collect()]
    assert got == [{"b": {"x": 1.0}}, {"a": {}}, None]


def test_missing_speedup_is_one(spark):
    df = spark.createDataFrame([(1, "s", "m", "r", [], {"strategy": {"parallel_efficiency": 50.0}}, {}, {}, 0.0)], RESULT)
    lines = [r.line for r in reports.report_lines(reports.to_report_row(df), "n", "text").orderBy("line_no").collect()]
    assert "  speedup: 1.00x" in lines


def test_low_sampling_rates(spark):
    df = spark.range(1000).select("id", F.lit("INFO").alias("level"))
    assert logs.sample_logs(df, 0.0, F.col("id")).count() == 0
    assert logs.sample_logs(df, -1.0, F.col("id")).count() == 0
    assert 400 < logs.sample_logs(df, 0.5, F.col("id")).count() < 600
