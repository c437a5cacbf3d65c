"""Timing records of runs: latency distributions, shares, throughput and sweeps.

A timing frame has one row per iteration with the seconds spent per stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.dims import is_supported_resolution, resolution_height, resolution_width
from runlens.functions.measures import fps, fps_per_mpix, pixels, to_ms
from runlens.operators.quantiles import (
    LARGE_GROUP,
    PROBS,
    percentiles,
    selected_percentiles,
)
from runlens.operators.slicing import (
    ROWS_PER_SLICE,
    large_groups,
    null_safe_join,
    sized,
    with_halo,
    with_keys,
    with_position,
)

STAGES = ("preprocess", "execute", "postprocess", "queue_wait", "total")
PARTS = STAGES[:4]


def with_total(df: DataFrame) -> DataFrame:
    """A total of zero was not measured and becomes the sum of the four stages."""
    parts = sum((F.col(f"{s}_s") for s in PARTS[1:]), F.col(f"{PARTS[0]}_s"))
    return df.withColumn("total_s", F.when(F.col("total_s") == 0, parts).otherwise(F.col("total_s")))


def drop_warmup_phase(df: DataFrame) -> DataFrame:
    return df.filter(F.col("phase") == "test")


def successful_only(df: DataFrame, result: str = "result") -> DataFrame:
    return df.filter(F.col(result).isNotNull())


def mark_auto_warmup(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Mark the first ``n`` records of every run as warmup, at least one.

    The first records are found with a limited window (each map task keeps at most
    ``n`` rows per run before the shuffle); the rows themselves are not shuffled by run.
    """
    by_order = Window.partitionBy(*keys).orderBy(order)
    last = (
        df.select(*keys, order)
        .withColumn("_rn", F.row_number().over(by_order))
        .filter(F.col("_rn") <= max(1, n))
        .groupBy(*keys)
        .agg(F.max(order).alias("_last"))
    )
    phase = F.when(F.col(order) <= F.col("_last"), "warmup").otherwise("test")
    return null_safe_join(df, last, keys, "left").withColumn("phase", phase).drop("_last")


def _moments(name: str, weight: str | None = None, exact: bool = False) -> list[Column]:
    """With ``exact`` sum and mean are those of the milliseconds taken to nine decimals, added without rounding, so
    they do not depend on the order of rows; a group with a value that is no such number is added as doubles."""
    value = f"_ms_{name}"
    found = {
        "avg": f"avg({value})",
        "min": f"min({value})",
        "max": f"max({value})",
        "std": f"stddev_pop({value})",
        "sum": f"sum({value})",
        "count": f"count({value})",
    }
    if exact:
        decimal = f"try_cast({value} AS DECIMAL(28, 9))"
        total = f"if(count({decimal}) = count({value}), CAST(sum({decimal}) AS DOUBLE), sum({value}))"
        found.update(avg=f"try_divide({total}, CAST(count({value}) AS DOUBLE))", sum=total)
    if weight:
        total, count = f"sum({value} * {weight})", f"sum(if({value} IS NULL, 0, {weight}))"
        # Deviations from the group's mean: a difference of large squares would cancel.
        square = f"sum(({value} - _mean_{name}) * ({value} - _mean_{name}) * {weight})"
        found.update(
            avg=f"if({count} > 0, {total} / {count}, NULL)",
            std=f"if({count} > 0, sqrt({square} / {count}), NULL)",
            sum=total,
            count=count,
        )
    return [F.expr(f"{formula} AS _{name}_{m}") for m, formula in found.items()]


def _stats_struct(name: str) -> Column:
    parts = [f"coalesce(_{name}_{m}, 0D) AS {m}" for m in ("avg", "min", "max", "std")]
    parts += [f"coalesce(_p_{name}[{i}], 0D) AS {p}" for i, p in enumerate(("p50", "p95", "p99"))]
    parts += [f"coalesce(_{name}_sum, 0D) AS sum", f"_{name}_count AS count"]
    return F.expr(f"struct({', '.join(parts)}) AS {name}")


def _distributions(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    extra: list[Column] | None = None,
    large_group: int = LARGE_GROUP,
    weight: str | None = None,
    sizes: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """One struct of statistics per named value and group; one pass when no group is large.

    With ``weight`` a row stands for that many equal values.
    """
    prepared = df.select("*", *[v.alias(f"_ms_{n}") for n, v in values.items()])
    if weight:
        means = [
            F.try_divide(F.sum(F.col(f"_ms_{n}") * F.col(weight)), F.sum(F.when(F.col(f"_ms_{n}").isNotNull(), F.col(weight))))
            .alias(f"_mean_{n}")
            for n in values
        ]
        prepared = null_safe_join(prepared, prepared.groupBy(*keys).agg(*means), keys, "left")
    aggs = list(extra or [])
    for name in values:
        aggs += _moments(name, weight, exact)
    large = large_groups(df if sizes is None else sizes, keys, large_group)
    if large is not None:
        known = sized(large.frame, large.groups)
        flagged = null_safe_join(prepared, known, keys, "left")
        aggs += [percentiles(f"_ms_{n}", weight, large=True).alias(f"_small_{n}") for n in values]
        hot_rows = null_safe_join(prepared, known, keys, "inner").drop("_n")
        names = [f"_ms_{n}" for n in values]
        hot = selected_percentiles(
            hot_rows, keys, names, PROBS, large_group, weight, large.groups
        )
        both = null_safe_join(
            flagged.groupBy(*keys).agg(*aggs), sized(hot, large.groups), keys, "left"
        )
        both = both.withColumns(
            {f"_p_{n}": F.expr(f"coalesce(_small_{n}, _q__ms_{n})") for n in values}
        )
    else:
        aggs += [percentiles(f"_ms_{n}", weight).alias(f"_p_{n}") for n in values]
        both = prepared.groupBy(*keys).agg(*aggs)
    scratch = {c for c in both.columns if c.startswith("_")} - set(keys)
    kept = [F.col(c) for c in both.columns if c not in scratch]
    return both.select(*kept, *[_stats_struct(n) for n in values])


def stage_stats(
    df: DataFrame, keys: list[str], seconds: str, large_group: int = LARGE_GROUP
) -> DataFrame:
    """avg, min, max, population std, p50/p95/p99, sum (milliseconds) and count per group.

    Sum and mean are exact for milliseconds of up to nine decimals, in any order of the rows.
    """
    df, group = with_keys(df, keys)
    values = {"stats": to_ms(F.col(seconds))}
    stats = _distributions(df, group, values, large_group=large_group, exact=True)
    return stats.select(*keys, "stats.*")


def counted_stats(
    df: DataFrame, keys: list[str], ms: str, count: str, large_group: int = LARGE_GROUP
) -> DataFrame:
    """``stage_stats`` of a table of millisecond values and how often each occurred."""
    values = {"stats": F.col(ms)}
    stats = _distributions(df, keys, values, large_group=large_group, weight=count)
    return stats.select(*keys, "stats.*")


def run_statistics(
    df: DataFrame,
    keys: list[str],
    large_group: int = LARGE_GROUP,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """The full metrics record of a run: five stage structs, ratios, fps, iterations, duration.

    Expects the ``phase`` column; runs that only have warmup rows come back with zeros.
    ``sizes`` may be the records before warmup was marked: counting their groups is cheaper.
    """
    test = F.col("phase") == "test"
    values = {s: F.when(test, to_ms(F.col(f"{s}_s"))) for s in STAGES}
    counts = [
        F.count_if(F.col("phase") == "warmup").alias("warmup"),
        F.count_if(test).alias("test"),
        F.count(F.lit(1)).alias("all_iterations"),
    ]
    stats = _distributions(df, keys, values, counts, large_group, sizes=sizes)
    return stats.select(
        *keys,
        *STAGES,
        F.struct(
            *[share(F.col(f"{s}.sum"), F.col("total.sum")).alias(s) for s in PARTS]
        ).alias("ratios"),
        F.struct(
            fps(F.col("execute.avg")).alias("pure"), fps(F.col("total.avg")).alias("e2e")
        ).alias("fps"),
        F.struct("warmup", "test", F.col("all_iterations").alias("total")).alias("iterations"),
        F.struct(
            F.col("total.sum").alias("test_time_ms"), F.col("total.avg").alias("avg_iteration_ms")
        ).alias("duration"),
    )


def stage_stats_long(df: DataFrame, keys: list[str], large_group: int = LARGE_GROUP) -> DataFrame:
    """The five stages of ``run_statistics`` as rows; one wide aggregation, then unpivot."""
    values = {s: to_ms(F.col(f"{s}_s")) for s in STAGES}
    wide = _distributions(df, keys, values, large_group=large_group)
    rows = F.explode(
        F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("stats")) for s in STAGES])
    )
    return wide.select(*keys, rows.alias("_r")).select(*keys, "_r.stage", "_r.stats.*")


def share(part: Column, whole: Column) -> Column:
    """Percentage of a sum; 0 when the whole is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def stage_ratios(df: DataFrame, keys: list[str]) -> DataFrame:
    sums = df.groupBy(*keys).agg(*[F.sum(f"{s}_s").alias(f"_{s}") for s in STAGES])
    return sums.select(*keys, *[share(F.col(f"_{s}"), F.col("_total")).alias(s) for s in PARTS])


def iteration_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(F.col("phase") == "warmup").alias("warmup"),
        F.count_if(F.col("phase") == "test").alias("test"),
        F.count(F.lit(1)).alias("total"),
    )


def run_duration(df: DataFrame, keys: list[str]) -> DataFrame:
    ms = to_ms(F.col("total_s"))
    return df.groupBy(*keys).agg(
        F.sum(ms).alias("test_time_ms"), F.avg(ms).alias("avg_iteration_ms")
    )


def throughput_stats(
    df: DataFrame, keys: list[str], large_group: int = LARGE_GROUP
) -> DataFrame:
    """Completed tasks per second of a run's time span, with its latency distribution."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = [
        ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("total_time"),
        F.count("total_s").alias("completed_tasks"),
    ]
    stats = _distributions(df, keys, {"latency": to_ms(F.col("total_s"))}, span, large_group)
    rate = F.when(F.col("total_time") > 0, F.col("completed_tasks") / F.col("total_time"))
    return stats.select(
        *keys,
        "total_time",
        "completed_tasks",
        F.coalesce(rate, F.lit(0.0)).alias("throughput_fps"),
        F.when(F.col("latency.count") > 0, F.col("latency")).alias("latency"),
    )


def _sweep(df: DataFrame, keys: list[str]) -> DataFrame:
    """Averages over successful iterations; the rate counts every attempted iteration."""
    ok = F.when(F.col("success"), F.col("total_s"))
    found = df.groupBy(*keys).agg(
        F.avg(ok).alias("avg_time"),
        F.min(ok).alias("min_time"),
        F.max(ok).alias("max_time"),
        F.sum(ok).alias("total_time"),
        F.count(F.lit(1)).alias("iterations"),
    )
    return found.filter(F.col("total_time").isNotNull()).withColumn(
        "fps",
        F.when(F.col("total_time") > 0, F.col("iterations") / F.col("total_time")).otherwise(
            F.lit(0.0)
        ),
    )


def single_run_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    found = df.filter("success").groupBy(*keys).agg(
        F.avg("total_s").alias("avg_time"),
        F.min("total_s").alias("min_time"),
        F.max("total_s").alias("max_time"),
        F.count(F.lit(1)).alias("total_iterations"),
    )
    return found.withColumn(
        "fps", F.when(F.col("avg_time") > 0, 1.0 / F.col("avg_time")).otherwise(F.lit(0.0))
    )


def thread_sweep(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _sweep(df, (keys or []) + ["num_threads"])


def resolution_sweep(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sweep over known resolutions with pixel counts and frames per megapixel."""
    width, height = resolution_width(F.col("resolution")), resolution_height(F.col("resolution"))
    known = df.filter(is_supported_resolution(F.col("resolution")))
    return _sweep(known, (keys or []) + ["resolution"]).select(
        "*",
        pixels(width, height).alias("pixels"),
        fps_per_mpix(F.col("fps"), width, height).alias("fps_per_million_pixels"),
    )


def batch_run_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of a run over many images: inference times, images per second, stage shares."""
    df, group = with_keys(df, keys)
    found = df.groupBy(*group).agg(
        F.avg("execute_s").alias("avg_inference"),
        F.min("execute_s").alias("min_inference"),
        F.max("execute_s").alias("max_inference"),
        F.avg("total_s").alias("avg_total"),
        F.sum("total_s").alias("_total"),
        F.sum("preprocess_s").alias("_pre"),
        F.sum("execute_s").alias("_exe"),
        F.sum("postprocess_s").alias("_post"),
        F.count(F.lit(1)).alias("_n"),
    )

    def rate(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return found.select(
        *keys,
        "avg_inference",
        "min_inference",
        "max_inference",
        rate(F.lit(1.0), F.col("avg_inference")).alias("inference_fps"),
        "avg_total",
        rate(F.col("_n"), F.col("_total")).alias("images_per_second"),
        share(F.col("_pre"), F.col("_total")).alias("preprocess_ratio"),
        share(F.col("_exe"), F.col("_total")).alias("execute_ratio"),
        share(F.col("_post"), F.col("_total")).alias("result_ratio"),
    )


def sweep_improvement(sweep: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rate against the smallest thread count; the input has one row per thread count."""
    sweep, group = with_keys(sweep, keys or [])
    base = F.first_value("fps").over(Window.partitionBy(*group).orderBy("num_threads"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("num_threads"))
    gain = (
        F.when(rank == 1, F.lit(1.0))
        .when(base > 0, F.col("fps") / base)
        .otherwise(F.lit(0.0))
    )
    return sweep.withColumn("improvement", gain).drop("_all")


def rank_resolutions(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("fps"), "resolution")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int = 100) -> DataFrame:
    """The newest ``n`` rows per run; every map task keeps at most ``n`` per run."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def rolling_avg(
    df: DataFrame,
    keys: list[str],
    order: str,
    column: str,
    sizes: tuple[int, ...] = (10, 100),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Mean of the last n values of a run, for each n in ``sizes``."""

    def averages(window) -> list[Column]:
        return [
            F.avg(column).over(window.rowsBetween(1 - n, 0)).alias(f"avg_last_{n}") for n in sizes
        ]

    keyed, keys = with_keys(df, keys)
    numbered = with_position(keyed, keys, [order], "_pos", rows_per_slice)
    haloed = with_halo(numbered, "_pos", max(sizes) - 1, rows_per_slice)
    averaged = haloed.select("*", *averages(Window.partitionBy(*keys, "_slice").orderBy("_pos")))
    return averaged.filter(~F.col("_halo")).select(*df.columns, *[f"avg_last_{n}" for n in sizes])


def throughput_series(
    df: DataFrame, keys: list[str], order: str = "ts", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Completed tasks so far at every completion of a run."""
    return with_position(df, keys, [order], "completed", rows_per_slice)
