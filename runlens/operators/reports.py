"""Report rollups and report lines over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import resolve_route
from runlens.operators.slicing import ROWS_PER_SLICE, null_safe_join, with_position

REPORT_COLUMNS = (
    "scenario_name",
    "model_name",
    "route_type",
    "strategies",
    "metrics",
    "resource_stats",
    "config",
    "timestamp",
)
METRIC_MAP = "map<string,map<string,double>>"


def to_report_row(df: DataFrame) -> DataFrame:
    """The report columns of a result: absent or null parts become empty ones."""
    have = set(df.columns)

    def part(name: str, kind: str, empty: Column) -> Column:
        value = F.col(name) if name in have else F.lit(None)
        return F.coalesce(value.cast(kind), empty.cast(kind)).alias(name)

    config = F.col("config") if "config" in have else F.lit(None).cast("map<string,string>")
    route = F.col("route_type") if "route_type" in have else F.lit(None).cast("string")
    return df.select(
        *[c for c in df.columns if c not in REPORT_COLUMNS],
        F.col("scenario_name"),
        part("model_name", "string", F.lit("unknown")),
        resolve_route(route, F.try_element_at(config, F.lit("route_type"))).alias("route_type"),
        part("strategies", "array<string>", F.array()),
        part("metrics", METRIC_MAP, F.create_map()),
        part("resource_stats", METRIC_MAP, F.create_map()),
        part("config", "map<string,string>", F.create_map()),
        F.col("timestamp"),
    )


def route_comparison(df: DataFrame) -> DataFrame:
    """Results, sorted distinct models and sorted distinct strategies per route.

    Names are made distinct per route before they are collected, so what one task
    collects is the list of names, not the rows.
    """
    route = resolve_route(F.col("route_type"))
    base = df.select(route.alias("route"), "model_name", "strategies")
    names = F.explode(
        F.concat(
            F.array(F.struct(F.lit("m").alias("kind"), F.col("model_name").alias("name"))),
            F.transform(
                F.coalesce("strategies", F.array().cast("array<string>")),
                lambda s: F.struct(F.lit("s").alias("kind"), s.alias("name")),
            ),
        )
    )
    counted = (
        base.select("route", names.alias("_n"))
        .groupBy("route", "_n.kind", "_n.name")
        .agg(F.count(F.lit(1)).alias("_c"))
    )

    def listed(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name"))))

    return (
        counted.groupBy("route")
        .agg(
            F.sum(F.when(F.col("kind") == "m", F.col("_c"))).alias("result_count"),
            listed("m").alias("models"),
            listed("s").alias("strategies"),
        )
        .orderBy("route")
    )


def report_summary(df: DataFrame) -> DataFrame:
    """Counts of results, scenarios and models, and the mean rate with a missing one as 0."""
    rate = F.coalesce("pure_fps", F.lit(0.0))
    found = df.agg(
        F.count(F.lit(1)).alias("results"),
        F.count_distinct("scenario_name").alias("scenarios"),
        F.count_distinct("model_name").alias("models"),
        F.sum(rate).alias("_sum"),
    )
    mean = F.when(F.col("results") > 0, F.col("_sum") / F.col("results")).otherwise(F.lit(0.0))
    return found.select("results", "scenarios", "models", mean.alias("avg_fps"))


def archive_route_label(df: DataFrame, keys: list[str]) -> DataFrame:
    """The single route of a report, or ``mixed``; routes are made distinct before comparing."""
    routes = df.select(*keys, resolve_route(F.col("route_type")).alias("_route")).distinct()
    label = F.when(F.count(F.lit(1)) == 1, F.min("_route")).otherwise(F.lit("mixed"))
    return routes.groupBy(*keys).agg(label.alias("route_label"))


def _metric(group: str, name: str, missing: float = 0.0) -> Column:
    inner = F.try_element_at("metrics", F.lit(group))
    return F.coalesce(F.try_element_at(inner, F.lit(name)), F.lit(missing))


def _usage(group: str, name: str) -> Column:
    inner = F.try_element_at("resource_stats", F.lit(group))
    return F.coalesce(F.try_element_at(inner, F.lit(name)), F.lit(0.0))


def _if_group(maps: str, group: str, *lines: Column) -> list[Column]:
    present = F.map_contains_key(maps, group)
    return [F.when(present, line) for line in lines]


def _strategy_list(empty: str) -> Column:
    return F.when(F.size("strategies") > 0, F.array_join("strategies", ", ")).otherwise(F.lit(empty))


def _stage_line(label: str, stage: str, with_p99: bool = False) -> Column:
    figures = [_metric(stage, m) for m in ("avg", "p50", "p95")]
    form = label + "avg=%.2fms, p50=%.2fms, p95=%.2fms"
    if with_p99:
        form, figures = form + ", p99=%.2fms", figures + [_metric(stage, "p99")]
    return F.format_string(form, *figures)


def _text_lines() -> list[Column]:
    fixed = F.lit
    head = [
        F.format_string("[%d] %s", F.col("result_no"), F.col("scenario_name")),
        fixed("-" * 60),
        F.format_string("model: %s", F.col("model_name")),
        F.concat(fixed("strategies: "), _strategy_list("none")),
        fixed(""),
        F.when(F.size("metrics") > 0, fixed("performance:")),
    ]
    metrics = (
        _if_group(
            "metrics",
            "fps",
            F.format_string("  pure FPS: %.2f", _metric("fps", "pure")),
            F.format_string("  end-to-end FPS: %.2f", _metric("fps", "e2e")),
        )
        + _if_group("metrics", "preprocess", _stage_line("  preprocess: ", "preprocess"))
        + _if_group("metrics", "execute", _stage_line("  execute: ", "execute"))
        + _if_group("metrics", "postprocess", _stage_line("  postprocess: ", "postprocess"))
        + _if_group("metrics", "total", _stage_line("  total: ", "total", True))
        + _if_group(
            "metrics",
            "strategy",
            F.format_string("  speedup: %.2fx", _metric("strategy", "speedup", 1.0)),
            F.format_string("  efficiency: %.1f%%", _metric("strategy", "parallel_efficiency")),
        )
    )
    usage = (
        [F.when(F.size("resource_stats") > 0, fixed("resources:"))]
        + _if_group(
            "resource_stats",
            "cpu",
            F.format_string("  cpu: avg=%.1f%%, max=%.1f%%", _usage("cpu", "avg"), _usage("cpu", "max")),
        )
        + _if_group(
            "resource_stats",
            "memory",
            F.format_string(
                "  memory: %.1fMB / %.1fMB (%.1f%%)",
                _usage("memory", "current_mb"),
                _usage("memory", "total_mb"),
                _usage("memory", "avg_percent"),
            ),
        )
        + _if_group(
            "resource_stats",
            "npu",
            F.format_string(
                "  accelerator: avg=%.1f%%, max=%.1f%%",
                _usage("npu", "avg_utilization"),
                _usage("npu", "max_utilization"),
            ),
        )
    )
    return head + metrics + usage + [fixed("")]


def _markdown_lines() -> list[Column]:
    return [
        F.concat(F.lit("### "), F.col("model_name")),
        F.lit(""),
        F.concat(F.lit("- Route: "), F.col("route_type")),
        F.concat(F.lit("- Strategies: "), _strategy_list("baseline")),
        F.concat(F.lit("- Pure FPS: "), _metric("fps", "pure").cast("string")),
        F.concat(F.lit("- E2E FPS: "), _metric("fps", "e2e").cast("string")),
        F.lit(""),
    ]


def _html_lines() -> list[Column]:
    cells = "".join(["<td>%.2f</td>"] * 6)
    return [
        F.when(
            F.map_contains_key("metrics", stage),
            F.format_string(
                f"<tr><td>{stage}</td>{cells}</tr>",
                *[_metric(stage, m) for m in ("avg", "min", "max", "p50", "p95", "p99")],
            ),
        )
        for stage in ("preprocess", "execute", "postprocess", "total")
    ]


def _table_lines() -> list[Column]:
    return [
        F.format_string(
            "%-30s %-15.2f %-15.2f %-15.2f",
            F.col("model_name"),
            _metric("execute", "avg"),
            _metric("fps", "pure"),
            _metric("fps", "e2e"),
        )
    ]


STYLES = {
    "text": _text_lines,
    "markdown": _markdown_lines,
    "html": _html_lines,
    "table": _table_lines,
}


def report_lines(
    df: DataFrame, order: str, style: str = "text", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """The readable lines of every result as rows ``(result_no, line_no, line)``.

    ``df`` holds report rows plus the unique ``order`` column that numbers them. The lines
    stay distributed; sort by both numbers to print them.
    """
    if style == "text":
        # Only the order column is numbered; the wide rows keep their tasks if numbers are few.
        numbers = with_position(df.select(order), [], [order], "result_no", rows_per_slice)
        numbered = null_safe_join(df, numbers, [order], "left")
    else:
        numbered = df.withColumn("result_no", F.col(order))
    lines = F.array_compact(F.array(*STYLES[style]()))
    # The outer form: for the inner one Spark adds a filter on the size of the array, which
    # would format every line twice.
    exploded = numbered.select("result_no", F.posexplode_outer(lines).alias("line_no", "line"))
    return exploded.filter(F.col("line_no").isNotNull())


def route_table_lines(comparison: DataFrame) -> DataFrame:
    """Markdown rows of the route comparison."""

    def names(column: str) -> Column:
        return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise(F.lit("-"))

    line = F.format_string(
        "| %s | %d | %s | %s |", F.col("route"), F.col("result_count"), names("models"), names("strategies")
    )
    return comparison.select("route", line.alias("line"))
