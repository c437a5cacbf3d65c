"""Evaluation matrices: what to run, in which order.

Images are the data side and stay distributed. Models, tiers, routes and resolutions are
short lists given by the caller; they become array literals that are exploded per image,
so building a matrix needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.dims import (
    DEFAULT_SIZE_TIERS,
    LARGE_INPUT_ROUTE,
    RESOLUTIONS,
    ROUTES,
    TIERS,
    is_supported_resolution,
    tier_resolution,
)


def _positions(values: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])


def _known(values, allowed, what: str) -> list[str]:
    unknown = [v for v in values if v not in allowed]
    if unknown:
        raise ValueError(f"unsupported {what}: {', '.join(map(str, unknown))}")
    return list(values)


def build_matrix(images: DataFrame, models: list[str], tiers=tuple(TIERS)) -> DataFrame:
    """models x images x tiers, with the runtime resolution of each tier.

    ``model_no`` and ``tier_no`` together with the order of images give the run order.
    """
    tiers = _known(tiers, TIERS, "input tier")
    return (
        images.select("*", F.explode(_positions(models)).alias("_m"))
        .select("*", F.explode(_positions(tiers)).alias("_t"))
        .select(
            *images.columns,
            F.col("_m.i").alias("model_no"),
            F.col("_m.v").alias("model_path"),
            F.col("_t.i").alias("tier_no"),
            F.col("_t.v").alias("input_tier"),
            tier_resolution(F.col("_t.v")).alias("runtime_resolution"),
        )
    )


def route_defaults(routes, size_tiers) -> tuple[list[str | None], list[str | None]]:
    """Routes and size tiers of a strategy run where either list may be left out."""
    routes, size_tiers = list(routes or []), list(size_tiers or [])
    if size_tiers and not routes:
        routes = list(ROUTES)
    if LARGE_INPUT_ROUTE in routes and not size_tiers:
        size_tiers = list(DEFAULT_SIZE_TIERS)
    return routes or [None], size_tiers or [None]


def build_route_matrix(
    images: DataFrame, models: list[str], size_tiers=DEFAULT_SIZE_TIERS, routes=ROUTES
) -> DataFrame:
    """models x images x size tiers x routes; only the large-input route fixes a resolution."""
    routes = _known(routes or ROUTES, ROUTES, "route type")
    size_tiers = list(size_tiers or DEFAULT_SIZE_TIERS)
    resolution = F.when(F.col("_r.v") == LARGE_INPUT_ROUTE, F.lower("_s.v"))
    return (
        images.select("*", F.explode(_positions(models)).alias("_m"))
        .select("*", F.explode(_positions(size_tiers)).alias("_s"))
        .select("*", F.explode(_positions(routes)).alias("_r"))
        .select(
            *images.columns,
            F.col("_m.i").alias("model_no"),
            F.col("_m.v").alias("model_path"),
            F.col("_s.i").alias("size_no"),
            F.col("_s.v").alias("image_size_tier"),
            F.col("_r.i").alias("route_no"),
            F.col("_r.v").alias("route_type"),
            resolution.alias("runtime_resolution"),
        )
    )


def augment_matrix(images: DataFrame, resolutions=tuple(RESOLUTIONS), count: int = 1) -> DataFrame:
    """Every image x copy x known resolution, with the file name of the resized copy."""
    name = F.element_at(F.split("path", "/"), -1)
    has_suffix = F.expr("instr(substring(element_at(split(path, '/'), -1), 2), '.') > 0")
    stem = F.when(has_suffix, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    suffix = F.when(has_suffix, F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise(F.lit(".jpg"))
    copy = F.explode(F.sequence(F.lit(1), F.lit(count))).alias("copy")
    parts = [stem, F.col("copy").cast("string"), F.col("resolution")]
    if count == 1:
        del parts[1]
    return (
        images.select("*", copy)
        .select("*", F.explode(F.array(*[F.lit(r) for r in resolutions])).alias("resolution"))
        .filter(is_supported_resolution(F.col("resolution")))
        .select(
            *images.columns,
            "copy",
            "resolution",
            F.concat(F.concat_ws("_", *parts), suffix).alias("output_name"),
        )
    )
