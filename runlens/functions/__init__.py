from runlens.functions.measures import (
    batch_fps,
    estimate_tiles,
    fps,
    fps_per_mpix,
    overlap_ratio,
    parallel_efficiency,
    pixels,
    positive_only,
    speedup,
    theoretical_speedup,
    to_ms,
    unit_theoretical_speedup,
)
from runlens.functions.metrics import deep_merge, merge_levels, split_metrics
from runlens.functions.text import basename, resolve_route, sanitize_segment
from runlens.functions.vectors import (
    decode_output,
    hann,
    hann_weight,
    normalize_pixels,
    split_batch_output,
    truncate_vector,
)

__all__ = [
    "basename",
    "batch_fps",
    "decode_output",
    "deep_merge",
    "estimate_tiles",
    "fps",
    "fps_per_mpix",
    "hann",
    "hann_weight",
    "merge_levels",
    "normalize_pixels",
    "overlap_ratio",
    "parallel_efficiency",
    "pixels",
    "positive_only",
    "resolve_route",
    "sanitize_segment",
    "speedup",
    "split_batch_output",
    "split_metrics",
    "theoretical_speedup",
    "to_ms",
    "truncate_vector",
    "unit_theoretical_speedup",
]
