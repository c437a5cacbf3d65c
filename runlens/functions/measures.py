"""Arithmetic of timings, throughput, speedup and tiling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    return seconds * F.lit(1000.0)


def fps(avg_ms: Column) -> Column:
    """Frames per second of an average latency; 0 when nothing was measured."""
    return F.when(avg_ms > 0, F.lit(1000.0) / avg_ms).otherwise(F.lit(0.0))


def batch_fps(one_fps: Column, batch_size: Column | int) -> Column:
    """A batch run finishes ``batch_size`` images per timed iteration."""
    size = batch_size if isinstance(batch_size, Column) else F.lit(batch_size)
    return one_fps * size


def speedup(strategy_fps: Column, baseline_fps: Column) -> Column:
    """Ratio to the baseline; 1.0 without a usable baseline."""
    return F.when(baseline_fps > 0, strategy_fps / baseline_fps).otherwise(F.lit(1.0))


def parallel_efficiency(measured: Column, theoretical: Column) -> Column:
    """Share of the theoretical speedup that was reached, in percent."""
    return F.when(theoretical > 0, measured / theoretical * 100).otherwise(F.lit(0.0))


def theoretical_speedup(strategy: Column, threads: Column, batch_size: Column) -> Column:
    """Best possible speedup of a strategy; null for a strategy that is never run."""
    return (
        F.when(strategy == "multithread", threads.cast("double"))
        .when(strategy == "batch", batch_size.cast("double"))
        .when(strategy == "pipeline", F.greatest(F.lit(1), threads + 1).cast("double"))
        .when(strategy == "memory_pool", F.lit(1.1))
        .when(strategy == "high_res_tiling", F.lit(1.0))
    )


def unit_theoretical_speedup(
    strategy: Column, threads: Column, preprocess: Column, infer: Column, postprocess: Column
) -> Column:
    """Variant stated by a single unit: its own threads, or all pipeline threads."""
    return F.when(strategy == "multithread", threads.cast("double")).when(
        strategy == "pipeline",
        F.greatest(F.lit(1), preprocess + infer + postprocess).cast("double"),
    )


def pixels(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def fps_per_mpix(frames: Column, width: Column, height: Column) -> Column:
    area = pixels(width, height) / F.lit(1e6)
    return F.when(area > 0, frames / area).otherwise(F.lit(0.0))


def overlap_ratio(overlap: Column, tile_size: Column) -> Column:
    """Overlaps above 1 are pixels and become a share of the tile."""
    return F.when(overlap > 1, overlap / tile_size).otherwise(overlap.cast("double"))


def estimate_tiles(width: Column, height: Column, tile: int, ratio: float) -> Column:
    """Planned number of tiles; edge tiles pushed inside can make the real grid larger."""
    overlap = int(tile * ratio)
    step = tile - overlap
    if step <= 0:
        raise ValueError("overlap must leave a positive step")

    def along(extent: Column) -> Column:
        return F.greatest(F.lit(1).cast("bigint"), F.floor((extent - overlap + step - 1) / step))

    return along(width) * along(height)


def positive_only(value: Column) -> Column:
    """Null for samples that were never taken (zero or below), so aggregates skip them."""
    return F.when(value > 0, value)
