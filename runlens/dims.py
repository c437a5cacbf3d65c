"""Fixed values of the domain and lookups over them.

The lookups are map literals: a few entries, constant-folded by Catalyst and
evaluated inside whole-stage codegen, so they need no join at any data size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Input tier -> runtime resolution name.
TIERS = {
    "720p": "640x640",
    "1080p": "1k2k",
    "4K": "4k6k",
}

# Resolution name -> (width, height).
RESOLUTIONS = {
    "640x640": (640, 640),
    "1k": (1024, 1024),
    "1k2k": (1024, 2048),
    "2k": (2048, 2048),
    "2k4k": (2048, 4096),
    "4k": (4096, 4096),
    "4k6k": (4096, 6144),
    "3k6k": (3072, 6144),
    "6k": (6144, 6144),
}
DEFAULT_SIZE = (640, 640)

# Evaluation routes.
TILED_ROUTE = "tiled_route"
LARGE_INPUT_ROUTE = "large_input_route"
ROUTES = (TILED_ROUTE, LARGE_INPUT_ROUTE)
DEFAULT_SIZE_TIERS = ("6K",)

# Cores of one accelerator card.
MAX_CORES = 4

# Image file suffixes of the inference scan and of the throughput scan.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp")
THROUGHPUT_IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff")

# Bytes per tensor element; any other type counts as 1 byte.
ELEMENT_BYTES = {
    "float32": 4,
    "float16": 2,
    "int8": 1,
    "uint8": 1,
    "int16": 2,
    "uint16": 2,
    "int32": 4,
    "uint32": 4,
    "int64": 8,
    "uint64": 8,
    "bool": 1,
}

# Resolutions a validated run configuration should use.
RECOMMENDED_RESOLUTIONS = (
    "320x320",
    "416x416",
    "512x512",
    "608x608",
    "640x640",
    "768x768",
    "800x800",
    "1024x1024",
    "1280x1280",
)


@dataclass(frozen=True)
class StrategyUnit:
    """One acceleration strategy; empty ``routes`` means every route."""

    name: str
    executor: str = "simple"
    routes: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    conflicts: tuple[str, ...] = ()


# The built-in strategy units.
STRATEGY_UNITS = (
    StrategyUnit("multithread", "multithread"),
    StrategyUnit("batch", "batch"),
    StrategyUnit("pipeline", "pipeline"),
    StrategyUnit("memory_pool"),
    StrategyUnit("high_res_tiling", "high_res", routes=(TILED_ROUTE,), aliases=("high_res",)),
    StrategyUnit("async_io"),
    StrategyUnit("cache"),
)


def lookup(mapping: dict, key: Column) -> Column:
    """Value of ``key`` in a small constant dict, null when it is absent."""
    entries = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), key)


def tier_resolution(tier: Column) -> Column:
    """Runtime resolution name of an input tier, null for an unknown tier."""
    return lookup(TIERS, tier)


def resolution_width(resolution: Column) -> Column:
    widths = {name: size[0] for name, size in RESOLUTIONS.items()}
    return F.coalesce(lookup(widths, resolution), F.lit(DEFAULT_SIZE[0]))


def resolution_height(resolution: Column) -> Column:
    heights = {name: size[1] for name, size in RESOLUTIONS.items()}
    return F.coalesce(lookup(heights, resolution), F.lit(DEFAULT_SIZE[1]))


def is_supported_resolution(resolution: Column) -> Column:
    return F.coalesce(resolution.isin(*RESOLUTIONS), F.lit(False))


def element_bytes(type_name: Column) -> Column:
    return F.coalesce(lookup(ELEMENT_BYTES, type_name), F.lit(1))
