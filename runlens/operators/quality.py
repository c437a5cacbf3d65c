"""Value checks: rules are data, violations are rows.

All checks are row-local expressions, so a check of any number of rules is one narrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.dims import (
    MAX_CORES,
    RECOMMENDED_RESOLUTIONS,
    RESOLUTIONS,
    ROUTES,
    TIERS,
    element_bytes,
    resolution_height,
    resolution_width,
    tier_resolution,
)
from runlens.plans.strategies import enabled_strategies


@dataclass(frozen=True)
class Rule:
    """A column check: ``violated`` maps the column to a condition."""

    column: str
    code: int
    message: str
    violated: callable


def in_range(column: str, low, high) -> Rule:
    return Rule(
        column,
        3021,
        f"{column} must be in [{low}, {high}]",
        lambda c: F.coalesce((c < low) | (c > high), F.lit(True)),
    )


def positive_integer(column: str, low: int = 1) -> Rule:
    return Rule(
        column,
        3022,
        f"{column} must be an integer of at least {low}",
        lambda c: F.coalesce(c < low, F.lit(True)),
    )


def one_of(column: str, allowed) -> Rule:
    allowed = list(allowed)
    return Rule(
        column,
        3030,
        f"{column} must be one of {', '.join(map(str, allowed))}",
        lambda c: ~F.coalesce(c.isin(*allowed), F.lit(False)),
    )


def supported_resolution(column: str = "resolution") -> Rule:
    return one_of(column, RESOLUTIONS)


def device_id(column: str = "device_id") -> Rule:
    return in_range(column, 0, MAX_CORES - 1)


def batch_size(column: str = "batch_size") -> Rule:
    return positive_integer(column)


def thread_count(column: str = "num_threads") -> Rule:
    return in_range(column, 1, MAX_CORES * 2)


def image_backend(column: str = "backend") -> Rule:
    return one_of(column, ("pil", "opencv"))


def inference_mode(column: str = "mode") -> Rule:
    return one_of(column, ("base", "multithread", "high_res"))


def iterations(column: str = "iterations") -> Rule:
    return positive_integer(column)


def warmup(column: str = "warmup") -> Rule:
    return Rule(
        column, 3021, f"{column} must not be negative", lambda c: F.coalesce(c < 0, F.lit(True))
    )


def check_values(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row per violated rule: keys, column, error code, message and the value found."""
    found = F.array(
        *[
            F.when(
                r.violated(F.col(r.column)),
                F.struct(
                    F.lit(r.column).alias("column_name"),
                    F.lit(r.code).alias("error_code"),
                    F.lit(r.message).alias("message"),
                    F.col(r.column).cast("string").alias("value"),
                ),
            )
            for r in rules
        ]
    )
    return df.select(*keys, F.explode(F.array_compact(found)).alias("_v")).select(*keys, "_v.*")


def normalized_path(path: Column) -> Column:
    """The path with ``.`` and ``..`` segments resolved, as text."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.array_append(acc, p)),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def check_paths(df: DataFrame, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """First problem of every path: 3001 empty, 3002 outside ``root``, 3005 wrong suffix."""
    base = "/" + root.strip("/")
    path = F.col("path")
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(base + "/"), path))
    resolved = normalized_path(full)
    inside = (resolved == base) | F.startswith(resolved, F.lit(base.rstrip("/") + "/"))
    code = F.when(path.isNull() | (path == ""), 3001).when(~inside, 3002)
    if suffixes:
        name = F.element_at(F.split(resolved, "/"), -1)
        suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
        code = code.when(~suffix.isin(*[s.lower() for s in suffixes]), 3005)
    return df.withColumn("error_code", code).filter(F.col("error_code").isNotNull())


def input_mismatch(df: DataFrame) -> DataFrame:
    """Inputs whose declared size or sides differ from the model's: 3120 bytes, 3121 sides."""
    expected = (
        F.col("width").cast("bigint") * F.col("height") * F.col("channels")
        * element_bytes(F.col("element_type"))
    )
    sides = (F.col("width") != F.col("model_width")) | (F.col("height") != F.col("model_height"))
    code = F.when(F.col("input_bytes") != expected, 3120).when(sides, 3121)
    return (
        df.withColumn("expected_bytes", expected)
        .withColumn("error_code", code)
        .filter(F.col("error_code").isNotNull())
    )


def check_tensor_size(df: DataFrame, input_bytes: int, tensor: str = "tensor") -> DataFrame:
    """Tensors larger than the model input, code 2305."""
    actual = F.size(tensor).cast("bigint") * 4
    return (
        df.withColumn("actual_bytes", actual)
        .filter(F.col("actual_bytes") > input_bytes)
        .withColumn("error_code", F.lit(2305))
    )


ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class ConfigRule:
    """``needs`` lists the columns a rule reads; it is skipped where one is absent."""

    severity: str
    message: str
    needs: tuple[str, ...]
    violated: callable


def _rule(severity: str, message: str, columns: tuple[str, ...], test: callable, switch: str | None = None) -> ConfigRule:
    """A rule over columns; with ``switch`` it only holds where that flag is on."""

    def violated() -> Column:
        broken = test(*map(F.col, columns))
        return broken if switch is None else F.coalesce(F.col(switch), F.lit(False)) & broken

    return ConfigRule(severity, message, (switch, *columns) if switch else columns, violated)


def below(column: str, least: float, switch: str | None = None) -> ConfigRule:
    return _rule(ERROR, f"{column} below {least}", (column,), lambda c: c < least, switch)


def above(column: str, most: float, severity: str = WARNING, switch: str | None = None) -> ConfigRule:
    return _rule(severity, f"{column} above {most}", (column,), lambda c: c > most, switch)


def empty(column: str) -> ConfigRule:
    return _rule(ERROR, f"{column} is empty", (column,), lambda c: F.coalesce(c, F.lit("")) == "")


def outside(column: str, allowed: tuple, severity: str = ERROR) -> ConfigRule:
    """A value that is given and none of ``allowed``."""
    said = f"{column} not in {', '.join(allowed)}"
    return _rule(severity, said, (column,), lambda c: (c != "") & ~c.isin(*allowed))


def missing_or_outside(column: str, allowed: tuple) -> ConfigRule:
    said = f"{column} not in {', '.join(allowed)}"
    return _rule(ERROR, said, (column,), lambda c: ~F.coalesce(c.isin(*allowed), F.lit(False)))


def reaches(column: str, other: str, switch: str | None = None) -> ConfigRule:
    return _rule(ERROR, f"{column} not below {other}", (column, other), lambda c, o: c >= o, switch)


def given(rule: ConfigRule, *conditions: ConfigRule) -> ConfigRule:
    """``rule`` where none of ``conditions`` is violated."""
    needs = tuple(dict.fromkeys(c for r in (*conditions, rule) for c in r.needs))

    def violated() -> Column:
        holds = reduce(lambda x, y: x & y, [~F.coalesce(r.violated(), F.lit(False)) for r in conditions])
        return holds & rule.violated()

    return ConfigRule(rule.severity, rule.message, needs, violated)


def _size_differs(tier: Column, resolution: Column) -> Column:
    wanted = tier_resolution(tier)
    return (resolution_width(wanted) != resolution_width(resolution)) | (
        resolution_height(wanted) != resolution_height(resolution)
    )


#: Settings with their least value, the greatest that is not suspicious, and the flag that makes
#: them count.
NUMBERS = (
    ("device_id", 0, MAX_CORES - 1, None),
    ("num_threads", 1, MAX_CORES, None),
    ("tile_size", 64, 2048, None),
    ("overlap", 0, None, None),
    ("multithread_threads", 1, MAX_CORES, "multithread_on"),
    ("batch_size", 1, 32, "batch_on"),
    ("timeout_ms", 0, None, "batch_on"),
    ("queue_size", 1, 100, "pipeline_on"),
    ("pool_size", 1, None, "memory_pool_on"),
    ("max_buffers", 1, None, "memory_pool_on"),
    ("high_res_tile_size", 64, None, "high_res_on"),
    ("high_res_overlap", 0, None, "high_res_on"),
)
#: Names a setting may have.
BACKENDS, REPORT_FORMATS, MODEL_SUFFIX = ("opencv", "pil", "cv2"), ("text", "json", "markdown"), ".om"

_TIER, _ROUTE = missing_or_outside("input_tier", tuple(TIERS)), missing_or_outside("route_type", tuple(ROUTES))
_EVALUATED = (
    empty("report_format"),
    outside("report_format", REPORT_FORMATS),
    _rule(ERROR, "resolution is not that of input_tier", ("input_tier", "resolution"), _size_differs),
)

RUNTIME_RULES = (
    *(below(column, least, switch) for column, least, _, switch in NUMBERS),
    *(above(column, most, switch=switch) for column, _, most, switch in NUMBERS if most is not None),
    empty("model_path"),
    empty("resolution"),
    missing_or_outside("backend", BACKENDS),
    reaches("overlap", "tile_size"),
    reaches("high_res_overlap", "high_res_tile_size", "high_res_on"),
    _TIER,
    given(_ROUTE, _TIER),
    *(given(rule, _TIER, _ROUTE) for rule in _EVALUATED),
    _rule(WARNING, f"model_path without {MODEL_SUFFIX}", ("model_path",), lambda c: (c != "") & ~F.endswith(c, F.lit(MODEL_SUFFIX))),
    outside("resolution", tuple(RECOMMENDED_RESOLUTIONS), WARNING),
    _rule(WARNING, "multithread and pipeline are both on", ("pipeline_on",), lambda c: F.coalesce(c, F.lit(False)), "multithread_on"),
)

COMMAND_RULES = (
    below("device_id", 0),
    *(rule for column, least, most in (("num_threads", 1, MAX_CORES), ("conf_threshold", 0, 1), ("iou_threshold", 0, 1))
      for rule in (below(column, least), above(column, most, ERROR))),
    missing_or_outside("resolution", tuple(RESOLUTIONS)),
    missing_or_outside("backend", ("pil", "opencv")),
)


def validate_configs(df: DataFrame, rules=RUNTIME_RULES) -> DataFrame:
    """Add ``errors``, ``warnings``, ``is_valid`` and ``unchecked`` to a table of run configurations.

    ``unchecked`` lists the rules whose columns the table lacks: they can neither pass nor fail.
    """
    have = set(df.columns)
    usable = [r for r in rules if have.issuperset(r.needs)]

    def listed(severity: str) -> Column:
        hits = [F.when(r.violated(), F.lit(r.message)) for r in usable if r.severity == severity]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    return (
        df.withColumn("errors", listed(ERROR))
        .withColumn("warnings", listed(WARNING))
        .withColumn("is_valid", F.size("errors") == 0)
        .withColumn(
            "unchecked",
            F.array(*[F.lit(r.message) for r in rules if r not in usable]).cast("array<string>"),
        )
    )


def with_enabled_strategies(df: DataFrame) -> DataFrame:
    """Add the list of enabled strategies from the ``<name>_on`` columns."""
    flags = {c[:-3]: F.col(c) for c in df.columns if c.endswith("_on")}
    return df.withColumn("enabled", enabled_strategies(flags)).withColumn(
        "any_enabled", F.size("enabled") > 0
    )
