"""Resource, comparison and report family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.dims import LARGE_INPUT_ROUTE, TILED_ROUTE, lookup
from runlens.functions import (
    basename,
    deep_merge,
    resolve_route,
    sanitize_segment,
    split_metrics,
    theoretical_speedup,
)
from runlens.operators import compare, reports
from runlens.operators.resources import resource_stats as resource_stats_op
from runlens.operators.timing import last_n, mark_auto_warmup, run_statistics, stage_stats
from runlens.plans.strategies import expand_valid_strategies
from runlens.sources.shared import checkpointed
from workload.base import VIEWS, query, rounded, table
from workload.timing import timing

VIEWS["resource_v"] = """
SELECT event_type AS run_id, event_id, ts,
  regexp_extract(props, '([0-9]+)', 1)::DOUBLE AS cpu_percent,
  (user_id % 100)::DOUBLE AS memory_percent, value AS memory_used_mb, 512.0::DOUBLE AS memory_total_mb,
  CASE WHEN event_type = 'error' THEN (event_id % 50)::DOUBLE ELSE 0 END AS npu_utilization
FROM events"""


def resources(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        "event_id",
        "ts",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("cpu_percent"),
        (F.col("user_id") % 100).cast("double").alias("memory_percent"),
        F.col("value").alias("memory_used_mb"),
        F.lit(512.0).alias("memory_total_mb"),
        F.when(F.col("event_type") == "error", (F.col("event_id") % 50).cast("double"))
        .otherwise(0.0)
        .alias("npu_utilization"),
    )


_RESOURCE_SQL = """
SELECT run_id, count(*) AS samples,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds,
  round(coalesce(avg(cpu_percent) FILTER (WHERE cpu_percent > 0), 0), 6) AS cpu_avg,
  coalesce(max(cpu_percent) FILTER (WHERE cpu_percent > 0), 0) AS cpu_max,
  coalesce(min(cpu_percent) FILTER (WHERE cpu_percent > 0), 0) AS cpu_min,
  round(coalesce(avg(memory_percent) FILTER (WHERE memory_percent > 0), 0), 6) AS memory_avg,
  coalesce(max(memory_percent) FILTER (WHERE memory_percent > 0), 0) AS memory_max,
  arg_max(memory_used_mb, event_id) AS current_mb,
  arg_max(memory_total_mb, event_id) AS total_mb,
  round(avg(npu_utilization) FILTER (WHERE npu_utilization > 0), 6) AS npu_avg,
  max(npu_utilization) FILTER (WHERE npu_utilization > 0) AS npu_max,
  min(npu_utilization) FILTER (WHERE npu_utilization > 0) AS npu_min
FROM {source} GROUP BY run_id"""


def _flat_resources(df):
    stats = resource_stats_op(df, ["run_id"], "event_id")
    return rounded(
        stats.select(
            "run_id",
            "samples",
            "duration_seconds",
            *[F.col(f"cpu.{m}").alias(f"cpu_{m}") for m in ("avg", "max", "min")],
            F.col("memory.avg_percent").alias("memory_avg"),
            F.col("memory.max_percent").alias("memory_max"),
            "memory.current_mb",
            "memory.total_mb",
            *[F.col(f"npu.{m}_utilization").alias(f"npu_{m}") for m in ("avg", "max", "min")],
        )
    )


@query(_RESOURCE_SQL.format(source="resource_v"))
def resource_stats(spark, sf_dir):
    return _flat_resources(resources(spark, sf_dir))


@query(
    _RESOURCE_SQL.format(
        source="""(SELECT * FROM resource_v QUALIFY row_number() OVER
          (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) <= 100)"""
    )
)
def resource_stats_recent(spark, sf_dir):
    return _flat_resources(last_n(resources(spark, sf_dir), ["run_id"], ["ts", "event_id"], 100))


VIEWS["strategy_rows_v"] = """
SELECT run_id AS strategy, device_id, (device_id + 1)::DOUBLE AS theoretical_speedup,
  1000 / avg(execute_s * 1000) AS fps
FROM timing_v GROUP BY run_id, device_id"""


def strategy_rows(spark, sf_dir):
    stats = stage_stats(timing(spark, sf_dir), ["run_id", "device_id"], "execute_s")
    rows = stats.select(
        F.col("run_id").alias("strategy"),
        "device_id",
        (F.col("device_id") + 1).cast("double").alias("theoretical_speedup"),
        (1000.0 / F.col("avg")).alias("fps"),
    )
    # One row per run, used as strategies and as baseline: compute it once.
    return checkpointed(rows)


_COMPARED_SQL = """
SELECT s.strategy, s.device_id, s.theoretical_speedup, round(s.fps, 6) AS fps,
  round(coalesce(b.fps, 0), 6) AS baseline_fps,
  round(CASE WHEN coalesce(b.fps, 0) > 0 THEN s.fps / b.fps ELSE 1 END, 6) AS speedup,
  round(CASE WHEN coalesce(b.fps, 0) > 0 THEN s.fps / b.fps ELSE 1 END / s.theoretical_speedup * 100, 6)
    AS parallel_efficiency
FROM strategy_rows_v s
LEFT JOIN (SELECT * FROM strategy_rows_v WHERE strategy = 'view' AND device_id < 3) b
  ON s.device_id = b.device_id"""


@query(f"{_COMPARED_SQL} WHERE s.strategy <> 'view'")
def compare_to_baseline(spark, sf_dir):
    rows = strategy_rows(spark, sf_dir)
    baseline = rows.filter("strategy = 'view' AND device_id < 3")
    tested = rows.filter("strategy <> 'view'")
    return rounded(compare.compare_to_baseline(tested, baseline, ["device_id"]))


@query(
    f"""SELECT strategy, device_id, theoretical_speedup, round(fps, 6) AS fps,
      NULL::DOUBLE AS baseline_fps, NULL::DOUBLE AS speedup, NULL::DOUBLE AS parallel_efficiency
    FROM strategy_rows_v WHERE strategy = 'view' AND device_id < 3
    UNION ALL {_COMPARED_SQL} WHERE s.strategy <> 'view'"""
)
def union_results(spark, sf_dir):
    rows = strategy_rows(spark, sf_dir)
    baseline = rows.filter("strategy = 'view' AND device_id < 3")
    tested = rows.filter("strategy <> 'view'")
    compared = compare.compare_to_baseline(tested, baseline, ["device_id"])
    return rounded(compare.union_results(baseline, compared))


VIEWS["results_v"] = """
SELECT o_orderkey AS result_idx, c_nationkey AS scenario_no, c_mktsegment AS model_name,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'baseline' ELSE o_orderpriority END AS strategy,
  CASE WHEN o_orderstatus = 'F' THEN 'tiled_route' WHEN o_orderstatus = 'O' THEN 'large_input_route'
    ELSE '' END AS route_type,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 1000 END AS pure_fps,
  o_totalprice / 100 AS execute_avg
FROM orders JOIN customer ON o_custkey = c_custkey"""


def results(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    priority = F.col("o_orderpriority")
    strategy = F.when(F.startswith(priority, F.lit("1")), "baseline").otherwise(priority)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("result_idx"),
        F.col("c_nationkey").alias("scenario_no"),
        F.concat(F.lit("scenario-"), F.col("c_nationkey").cast("string")).alias("scenario_name"),
        F.col("c_mktsegment").alias("model_name"),
        F.array(strategy).alias("strategies"),
        F.when(F.col("o_orderstatus") == "F", TILED_ROUTE)
        .when(F.col("o_orderstatus") == "O", LARGE_INPUT_ROUTE)
        .otherwise("")
        .alias("route_type"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 1000).alias("pure_fps"),
        (F.col("o_totalprice") / 100).alias("execute_avg"),
    )


def with_metrics(df):
    """Results with their open metric maps."""

    def group(**values):
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])

    return df.withColumns(
        {
            "metrics": F.map_filter(
                F.create_map(
                    F.lit("execute"), group(avg=F.col("execute_avg"), p50=F.col("execute_avg") / 2),
                    F.lit("fps"), group(pure=F.coalesce("pure_fps", F.lit(0.0)), e2e=F.col("execute_avg") / 4),
                    F.lit("strategy"), group(speedup=F.lit(2.0)),
                ),
                lambda k, _: (k != "strategy") | (F.col("scenario_no") > 10),
            ),
            "resource_stats": F.create_map(
                F.lit("cpu"), group(avg=F.col("scenario_no").cast("double"), max=F.lit(50.0))
            ),
            "config": F.create_map(F.lit("route_type"), F.lit("config_route")),
            "timestamp": F.col("result_idx").cast("double"),
        }
    )


@query(
    """SELECT route_type, result_idx, model_name, round(execute_avg, 6) AS execute_avg FROM results_v
    WHERE strategy = 'baseline'
    QUALIFY row_number() OVER (PARTITION BY route_type ORDER BY result_idx) = 1"""
)
def first_baseline(spark, sf_dir):
    first = compare.first_baseline(results(spark, sf_dir), ["route_type"], "result_idx")
    return rounded(first.select("route_type", "result_idx", "model_name", "execute_avg"))


@query(
    """SELECT result_idx, model_name, execute_avg, coalesce(pure_fps, 0) AS pure_fps,
      execute_avg / 4 AS e2e_fps, strategy,
      CASE WHEN strategy = 'baseline' THEN coalesce(pure_fps, 0) ELSE execute_avg / 3 END AS throughput,
      CASE WHEN strategy = 'baseline' OR scenario_no > 12 THEN 1 ELSE 3.5 END::DOUBLE AS speedup,
      CASE WHEN strategy = 'baseline' THEN 100 WHEN scenario_no > 12 THEN 0 ELSE 87.5 END::DOUBLE
        AS efficiency
    FROM results_v ORDER BY result_idx"""
)
def comparison_table(spark, sf_dir):
    measured = F.col("scenario_no") <= 12
    rows = results(spark, sf_dir).select(
        "*",
        (F.col("execute_avg") / 4).alias("e2e_fps"),
        (F.col("execute_avg") / 3).alias("strategy_fps"),
        F.when(measured, 3.5).alias("speedup"),
        F.when(measured, 87.5).alias("parallel_efficiency"),
    )
    return compare.comparison_table(rows, "result_idx")


@query(
    """SELECT CASE WHEN route_type = '' THEN 'standard' ELSE route_type END AS route,
      count(*) AS result_count, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models,
      string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies
    FROM results_v GROUP BY 1 ORDER BY 1"""
)
def route_comparison(spark, sf_dir):
    found = reports.route_comparison(results(spark, sf_dir))
    return found.select(
        "route",
        "result_count",
        F.array_join("models", ",").alias("models"),
        F.array_join("strategies", ",").alias("strategies"),
    )


@query(
    """SELECT '| ' || CASE WHEN route_type = '' THEN 'standard' ELSE route_type END || ' | ' || count(*)
      || ' | ' || string_agg(DISTINCT model_name, ', ' ORDER BY model_name) || ' | '
      || string_agg(DISTINCT strategy, ', ' ORDER BY strategy) || ' |' AS line
    FROM results_v GROUP BY route_type"""
)
def route_table_lines(spark, sf_dir):
    comparison = reports.route_comparison(results(spark, sf_dir))
    return reports.route_table_lines(comparison).select("line")


@query(
    """SELECT count(*) AS results, count(DISTINCT scenario_no) AS scenarios,
      count(DISTINCT model_name) AS models, round(sum(coalesce(pure_fps, 0)) / count(*), 6) AS avg_fps
    FROM results_v"""
)
def report_summary(spark, sf_dir):
    return rounded(reports.report_summary(results(spark, sf_dir)))


@query(
    """SELECT scenario_no, CASE WHEN count(DISTINCT route) = 1 THEN min(route) ELSE 'mixed' END
      AS route_label
    FROM (SELECT scenario_no, CASE WHEN route_type = '' THEN 'standard' ELSE route_type END AS route
      FROM results_v) GROUP BY scenario_no"""
)
def archive_route_label(spark, sf_dir):
    return reports.archive_route_label(results(spark, sf_dir), ["scenario_no"])


@query(
    """SELECT result_idx, 'scenario-' || scenario_no AS scenario_name, model_name,
      CASE WHEN route_type = '' THEN 'config_route' ELSE route_type END AS route_type,
      strategy AS strategies, coalesce(pure_fps, 0) AS pure_fps, 0::BIGINT AS usage_groups,
      result_idx::DOUBLE AS "timestamp"
    FROM results_v"""
)
def to_report_row(spark, sf_dir):
    rows = reports.to_report_row(with_metrics(results(spark, sf_dir)).drop("resource_stats"))
    return rows.select(
        "result_idx",
        "scenario_name",
        "model_name",
        "route_type",
        F.array_join("strategies", ",").alias("strategies"),
        F.col("metrics")["fps"]["pure"].alias("pure_fps"),
        F.size("resource_stats").cast("bigint").alias("usage_groups"),
        "timestamp",
    )


@query(
    """SELECT result_idx, CASE WHEN route_type = '' THEN 'standard' ELSE route_type END AS route_only,
      CASE WHEN route_type = '' THEN 'config_route' ELSE route_type END AS with_config
    FROM results_v"""
)
def resolve_routes(spark, sf_dir):
    route = F.col("route_type")
    return results(spark, sf_dir).select(
        "result_idx",
        resolve_route(route).alias("route_only"),
        resolve_route(route, F.lit("config_route")).alias("with_config"),
    )


@query(
    r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, replace(url, '/', '_') AS segment
    FROM pages"""
)
def page_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        basename(F.col("url")).alias("name"),
        sanitize_segment(F.col("url")).alias("segment"),
    )


@query(
    """SELECT result_idx, coalesce(pure_fps, 0) AS pure, execute_avg / 8 AS e2e,
      execute_avg AS execute_avg, execute_avg / 2 AS execute_p50, 7.0::DOUBLE AS batch_size,
      CASE WHEN scenario_no > 10 THEN 2.0 END::DOUBLE AS speedup
    FROM results_v"""
)
def deep_merge_metrics(spark, sf_dir):
    newer = F.create_map(
        F.lit("fps"), F.create_map(F.lit("e2e"), F.col("execute_avg") / 8),
        F.lit("batch"), F.create_map(F.lit("batch_size"), F.lit(7.0)),
    )
    merged = with_metrics(results(spark, sf_dir)).select(
        "result_idx", deep_merge(F.col("metrics"), newer).alias("m")
    )
    return merged.select(
        "result_idx",
        F.col("m")["fps"]["pure"].alias("pure"),
        F.col("m")["fps"]["e2e"].alias("e2e"),
        F.col("m")["execute"]["avg"].alias("execute_avg"),
        F.col("m")["execute"]["p50"].alias("execute_p50"),
        F.col("m")["batch"]["batch_size"].alias("batch_size"),
        F.try_element_at(F.try_element_at("m", F.lit("strategy")), F.lit("speedup")).alias("speedup"),
    )


@query(
    """SELECT result_idx, 'execute,fps' AS model_groups,
      CASE WHEN scenario_no > 10 THEN 'fps,strategy' ELSE 'fps' END AS system_groups,
      'pure' AS model_fps, 'e2e' AS system_fps, execute_avg / 4 AS e2e
    FROM results_v"""
)
def split_metric_sides(spark, sf_dir):
    sides = with_metrics(results(spark, sf_dir)).select(
        "result_idx", split_metrics(F.col("metrics")).alias("s")
    )

    def names(c):
        return F.array_join(F.array_sort(F.map_keys(c)), ",")

    model, system = F.col("s.model_metrics"), F.col("s.system_metrics")
    return sides.select(
        "result_idx",
        names(model).alias("model_groups"),
        names(system).alias("system_groups"),
        names(model["fps"]).alias("model_fps"),
        names(system["fps"]).alias("system_fps"),
        system["fps"]["e2e"].alias("e2e"),
    )


def _two(value):
    """SQL of a number with two digits, halves rounded away from zero."""
    return f"round(({value})::DECIMAL(24, 12), 2)::DECIMAL(24, 2)::VARCHAR"


@query(
    f"""SELECT result_no, unnest(range(len(lines)))::INT AS line_no, unnest(lines) AS line FROM (
      SELECT result_no, list_concat(['[' || result_no || '] scenario-' || scenario_no, repeat('-', 60),
        'model: ' || model_name, 'strategies: ' || strategy, '', 'performance:',
        '  pure FPS: ' || {_two("coalesce(pure_fps, 0)")}, '  end-to-end FPS: ' || {_two("execute_avg / 4")},
        '  execute: avg=' || {_two("execute_avg")} || 'ms, p50=' || {_two("execute_avg / 2")} || 'ms, p95=0.00ms'],
        CASE WHEN scenario_no > 10 THEN ['  speedup: 2.00x', '  efficiency: 0.0%'] ELSE [] END,
        ['resources:', '  cpu: avg=' || scenario_no || '.0%, max=50.0%', '']) AS lines
      FROM (SELECT *, row_number() OVER (ORDER BY result_idx) AS result_no FROM results_v))"""
)
def report_lines_text(spark, sf_dir):
    """Every line of every result."""
    rows = reports.to_report_row(with_metrics(results(spark, sf_dir)))
    lines = reports.report_lines(rows, "result_idx", "text")
    return lines.withColumn("line_no", F.col("line_no").cast("int"))


def with_stages(df):
    """Metrics of three stages, one of them only for some results."""
    stage = {m: F.col("execute_avg") / 2**k for k, m in enumerate(("avg", "min", "max", "p50", "p95", "p99"))}
    group = F.create_map(*[x for k, v in stage.items() for x in (F.lit(k), v)])
    fps = F.create_map(F.lit("pure"), F.coalesce("pure_fps", F.lit(0.0)))
    metrics = F.create_map(F.lit("preprocess"), group, F.lit("execute"), group, F.lit("fps"), fps)
    return df.withColumn("metrics", F.map_filter(metrics, lambda k, _: (k != "preprocess") | (F.col("scenario_no") > 10)))


_CELLS = "".join(f"'<td>' || {_two(f'execute_avg / {2**k}')} || '</td>' || " for k in range(6))


@query(
    f"""SELECT result_no, unnest(range(len(lines)))::INT AS line_no, unnest(lines) AS line FROM (
      SELECT result_idx AS result_no, list_concat(
        CASE WHEN scenario_no > 10 THEN ['<tr><td>preprocess</td>' || {_CELLS} '</tr>'] ELSE [] END,
        ['<tr><td>execute</td>' || {_CELLS} '</tr>']) AS lines FROM results_v)"""
)
def report_lines_html(spark, sf_dir):
    rows = with_stages(results(spark, sf_dir)).select("result_idx", "metrics")
    lines = reports.report_lines(rows, "result_idx", "html")
    return lines.withColumn("line_no", F.col("line_no").cast("int"))


@query(
    f"""SELECT result_idx AS result_no, 0 AS line_no, rpad(model_name, 30, ' ') || ' '
      || rpad({_two("execute_avg")}, 15, ' ') || ' ' || rpad({_two("coalesce(pure_fps, 0)")}, 15, ' ') || ' '
      || rpad('0.00', 15, ' ') AS line FROM results_v"""
)
def report_lines_table(spark, sf_dir):
    rows = with_stages(results(spark, sf_dir)).select("result_idx", "model_name", "metrics")
    lines = reports.report_lines(rows, "result_idx", "table")
    return lines.withColumn("line_no", F.col("line_no").cast("int"))


@query(
    """SELECT result_idx AS result_no, unnest([0, 1, 2, 3, 4, 5, 6]) AS line_no,
      unnest(['### ' || model_name, '',
        '- Route: ' || CASE WHEN route_type = '' THEN 'config_route' ELSE route_type END,
        '- Strategies: ' || strategy,
        '- Pure FPS: ' || coalesce(pure_fps, 0)::VARCHAR,
        '- E2E FPS: ' || (execute_avg / 4)::VARCHAR, '']) AS line
    FROM results_v"""
)
def report_lines_markdown(spark, sf_dir):
    rows = reports.to_report_row(with_metrics(results(spark, sf_dir)))
    return reports.report_lines(rows, "result_idx", "markdown")


@query(
    """WITH runs AS (
      SELECT run_id, device_id, min(event_id) AS run_no, avg(execute_s * 1000) AS execute_avg,
        1000 / avg(execute_s * 1000) AS pure_fps, 1000 / avg(total_s * 1000) AS e2e_fps,
        CASE run_id WHEN 'view' THEN 'baseline' WHEN 'click' THEN 'multithread' WHEN 'error' THEN 'batch'
          WHEN 'purchase' THEN 'pipeline' ELSE 'high_res' END AS strategy,
        CASE device_id % 2 WHEN 0 THEN 'tiled_route' ELSE 'large_input_route' END AS route_type
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id, device_id ORDER BY event_id) AS rn
        FROM timing_v) WHERE rn > 5 GROUP BY run_id, device_id),
    joined AS (
      SELECT r.*, b.pure_fps AS base, CASE strategy_name WHEN 'multithread' THEN 4 WHEN 'batch' THEN 4
        WHEN 'pipeline' THEN 5 WHEN 'high_res_tiling' THEN 1 END AS theoretical
      FROM (SELECT *, CASE strategy WHEN 'high_res' THEN 'high_res_tiling' ELSE strategy END
          AS strategy_name FROM runs) r
      JOIN (SELECT device_id, pure_fps FROM runs WHERE strategy = 'baseline') b USING (device_id)
      WHERE strategy <> 'high_res' OR route_type = 'tiled_route')
    SELECT device_id, run_id AS model_name, strategy_name AS strategy,
      round(execute_avg, 6) AS execute_avg, round(pure_fps, 6) AS pure_fps, round(e2e_fps, 6) AS e2e_fps,
      round(pure_fps, 6) AS throughput,
      CASE WHEN strategy = 'baseline' THEN 1 ELSE round(pure_fps / base, 6) END::DOUBLE AS speedup,
      CASE WHEN strategy = 'baseline' THEN 100 ELSE round(pure_fps / base / theoretical * 100, 6)
        END::DOUBLE AS efficiency
    FROM joined"""
)
def strategy_comparison(spark, sf_dir):
    """End to end: warmup, run statistics, valid strategies, baseline, comparison table."""
    keys = ["run_id", "device_id"]
    records = timing(spark, sf_dir)
    phased = mark_auto_warmup(records, keys, "event_id", 5)
    stats = checkpointed(run_statistics(phased, keys, sizes=records))
    names = {"view": "baseline", "click": "multithread", "error": "batch", "purchase": "pipeline"}
    runs = stats.select(
        *keys,
        F.coalesce(lookup(names, F.col("run_id")), F.lit("high_res")).alias("strategy"),
        F.when(F.col("device_id") % 2 == 0, TILED_ROUTE).otherwise(LARGE_INPUT_ROUTE).alias("route_type"),
        F.col("execute.avg").alias("execute_avg"),
        F.col("fps.pure").alias("fps"),
        F.col("fps.e2e").alias("e2e_fps"),
    )
    baseline = runs.filter("strategy = 'baseline'")
    tested = expand_valid_strategies(runs).withColumn(
        "theoretical_speedup", theoretical_speedup(F.col("strategy"), F.lit(4), F.lit(4))
    )
    compared = compare.compare_to_baseline(tested, baseline, ["device_id"])
    rows = compare.union_results(baseline, compared).select(
        "device_id",
        F.col("run_id").alias("model_name"),
        F.array("strategy").alias("strategies"),
        "execute_avg",
        F.col("fps").alias("pure_fps"),
        "e2e_fps",
        F.col("fps").alias("strategy_fps"),
        "speedup",
        "parallel_efficiency",
    )
    return rounded(compare.comparison_table(rows, "device_id"))
