"""Tasks from scenarios and models, device capability, and registry checks.

``models``: name, input_specs array<struct<tier,width,height,channels>>, supported_routes
``devices``: name, supported_tiers, supported_routes
``scenarios``: name, model_name, input_tier, route_type
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.dims import ROUTES, TIERS


def build_tasks(scenarios: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks of the scenarios whose model offers the tier and route, and the violations.

    One left join by model name; the matching input spec is picked from the model's own
    array. A model that many scenarios name is split by adaptive skew handling.
    """
    specs = models.select(
        F.col("name").alias("_model"), "input_specs", F.col("supported_routes").alias("_routes")
    )
    joined = scenarios.join(specs, F.col("model_name") == F.col("_model"), "left")
    matching = F.filter("input_specs", lambda s: s["tier"] == F.col("input_tier"))
    problem = (
        F.when(~F.coalesce(F.col("input_tier").isin(*TIERS), F.lit(False)), "unsupported input tier")
        .when(
            ~F.coalesce(F.col("route_type").isin(*ROUTES), F.lit(False)), "unsupported route type"
        )
        .when(F.col("_model").isNull(), "unknown model")
        .when(~F.array_contains("_routes", F.col("route_type")), "model does not support route")
        .when(F.size(matching) == 0, "model has no spec for tier")
    )
    judged = joined.withColumn("violation", problem).withColumn(
        "input_spec", F.try_element_at(matching, F.lit(1))
    )
    tasks = judged.filter(F.col("violation").isNull()).select(*scenarios.columns, "input_spec")
    bad = judged.filter(F.col("violation").isNotNull()).select(*scenarios.columns, "violation")
    return tasks, bad


def device_support(devices: DataFrame) -> DataFrame:
    """One row per device, tier and route it supports."""
    return (
        devices.select("name", F.explode(F.array_distinct("supported_tiers")).alias("tier"), "supported_routes")
        .select("name", "tier", F.explode(F.array_distinct("supported_routes")).alias("route_type"))
    )


def device_capability(scenarios: DataFrame, devices: DataFrame) -> DataFrame:
    """Number of devices that can run each scenario.

    Devices are counted per (tier, route) first. Only known tiers and routes count, so the
    joined side has at most ``len(TIERS) * len(ROUTES)`` rows.
    """
    support = device_support(devices).filter(
        F.col("tier").isin(*TIERS) & F.col("route_type").isin(*ROUTES)
    )
    counted = support.groupBy(F.col("tier").alias("input_tier"), "route_type").agg(
        F.count_distinct("name").alias("devices")
    )
    return scenarios.join(F.broadcast(counted), ["input_tier", "route_type"], "left").select(
        *scenarios.columns,
        F.coalesce("devices", F.lit(0).cast("bigint")).alias("devices"),
        F.col("devices").isNotNull().alias("supported"),
    )


def registry_duplicates(df: DataFrame, name: str = "name") -> DataFrame:
    return (
        df.groupBy(name).agg(F.count(F.lit(1)).alias("registrations")).filter("registrations > 1")
    )


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _no_items(c: Column) -> Column:
    return c.isNull() | (F.size(c) <= 0)


def _any_unknown(items: Column, known) -> Column:
    return F.exists(items, lambda x: ~F.coalesce(x.isin(*known), F.lit(False)))


def _problems(df: DataFrame, kind: str, rules: list[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in rules]))
    return df.select(
        F.lit(kind).alias("kind"), F.col("name"), F.explode(found).alias("violation")
    )


def validate_registry(models: DataFrame, devices: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Violations ``(kind, name, violation)`` of the three registry tables."""
    specs, routes = F.col("input_specs"), F.col("supported_routes")

    def bad_size(side: str):
        return F.exists(specs, lambda s: F.coalesce(s[side], F.lit(0)) <= 0)

    of_models = _problems(
        models,
        "model",
        [
            ("name is required", F.col("name").isNull() | (F.col("name") == "")),
            ("at least one input spec is required", _no_items(specs)),
            ("at least one supported route is required", _no_items(routes)),
            (
                "unsupported input tier",
                F.exists(specs, lambda s: ~F.coalesce(s["tier"].isin(*TIERS), F.lit(False))),
            ),
            ("width must be positive", bad_size("width")),
            ("height must be positive", bad_size("height")),
            ("unsupported route type", _any_unknown(routes, ROUTES)),
        ],
    )
    tiers = F.col("supported_tiers")
    of_devices = _problems(
        devices,
        "device",
        [
            ("name is required", _blank(F.col("name"))),
            ("supported_tiers must not be empty", _no_items(tiers)),
            ("supported_routes must not be empty", _no_items(routes)),
            ("unsupported input tier", _any_unknown(tiers, TIERS)),
            ("unsupported route type", _any_unknown(routes, ROUTES)),
        ],
    )
    of_scenarios = _problems(
        scenarios,
        "scenario",
        [
            ("name is required", _blank(F.col("name"))),
            ("model_name is required", _blank(F.col("model_name"))),
            (
                "unsupported input tier",
                ~F.coalesce(F.col("input_tier").isin(*TIERS), F.lit(False)),
            ),
            (
                "unsupported route type",
                ~F.coalesce(F.col("route_type").isin(*ROUTES), F.lit(False)),
            ),
        ],
    )
    return of_models.unionByName(of_devices).unionByName(of_scenarios)
