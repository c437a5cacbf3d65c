"""Which strategies may run together on a route.

The catalogue of strategy units is a short constant, so names are resolved and checked
with expressions on the row's own array; no join or shuffle is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.dims import STRATEGY_UNITS, StrategyUnit, lookup


def resolve_alias(name: Column, units=STRATEGY_UNITS) -> Column:
    """Canonical unit name; an unknown name is kept."""
    aliases = {a: u.name for u in units for a in u.aliases}
    return F.coalesce(lookup(aliases, name), name) if aliases else name


def resolve_aliases(df: DataFrame, units=STRATEGY_UNITS) -> DataFrame:
    """Add ``unit``, the canonical name of the ``strategy`` column."""
    return df.withColumn("unit", resolve_alias(F.col("strategy"), units))


def normalize_strategies(names: Column, units=STRATEGY_UNITS) -> Column:
    """Canonical names, each once, in order of first appearance."""
    return F.array_distinct(F.transform(names, lambda n: resolve_alias(n, units)))


def supports_route(routes: Column, route: Column) -> Column:
    """No route or an empty list of routes means any."""
    return route.isNull() | (F.size(routes) <= 0) | F.array_contains(routes, route)


def unit_supports_route(unit: Column, route: Column, units=STRATEGY_UNITS) -> Column:
    fits = F.lit(True)
    for u in units:
        if u.routes:
            fits = F.when(unit == u.name, route.isNull() | route.isin(*u.routes)).otherwise(fits)
    return fits


def _conflicts(units: tuple[StrategyUnit, ...], chosen: Column) -> list[Column]:
    return [
        F.when(
            F.array_contains(chosen, u.name) & F.array_contains(chosen, other),
            F.lit(f"{u.name} and {other} cannot be enabled together"),
        )
        for u in units
        for other in u.conflicts
    ]


def validate_strategies(df: DataFrame, units=STRATEGY_UNITS) -> DataFrame:
    """Add ``normalized``, ``errors`` and ``is_valid`` to rows with ``names`` and ``route_type``."""
    known = [u.name for u in units]
    route = F.col("route_type")

    def name_error(name: Column) -> Column:
        unit = resolve_alias(name, units)
        return F.when(~unit.isin(*known), F.concat(F.lit("unknown strategy unit: "), name)).when(
            ~unit_supports_route(unit, route, units),
            F.concat(unit, F.lit(" is not compatible with route "), route),
        )

    normalized = F.filter(normalize_strategies(F.col("names"), units), lambda n: n.isin(*known))
    named = F.array_compact(F.transform("names", name_error))
    checked = df.withColumn("normalized", normalized)
    clashes = _conflicts(units, F.col("normalized"))
    errors = F.concat(named, F.array_compact(F.array(*clashes))) if clashes else named
    return checked.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def expand_valid_strategies(df: DataFrame, units=STRATEGY_UNITS) -> DataFrame:
    """Keep the (strategy, route) rows that may run; ``strategy`` becomes its canonical name."""
    known = [u.name for u in units]
    unit = resolve_alias(F.col("strategy"), units)
    ok = unit.isin(*known) & unit_supports_route(unit, F.col("route_type"), units)
    return df.filter(ok).withColumn("strategy", unit)


# Order in which enabled strategies are listed.
ENABLE_ORDER = (
    "multithread",
    "batch",
    "pipeline",
    "memory_pool",
    "high_res",
    "async_io",
    "cache",
)


def enabled_strategies(flags: dict[str, Column], as_units: bool = False) -> Column:
    """Names of enabled strategies in the fixed order; as unit names if asked."""
    names = []
    for name in ENABLE_ORDER:
        if name in flags:
            shown = "high_res_tiling" if as_units and name == "high_res" else name
            names.append(F.when(F.coalesce(flags[name], F.lit(False)), shown))
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
