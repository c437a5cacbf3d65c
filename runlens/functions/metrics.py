"""Open metric maps: ``map<string, map<string, double>>`` per result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric groups that describe the model alone.
MODEL_GROUPS = ("preprocess", "execute", "postprocess", "queue_wait", "total", "ratios")


def merge_levels(left: Column, right: Column) -> Column:
    """Merge flat maps; the right side wins."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))


def deep_merge(left: Column, right: Column) -> Column:
    """Merge maps of maps; the right side wins per inner key, a missing side (or map) keeps the other."""
    merged = F.map_zip_with(
        left,
        right,
        lambda _, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge_levels(a, b)),
    )
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(merged)


def split_metrics(metrics: Column) -> Column:
    """Struct of ``model_metrics`` and ``system_metrics``.

    The ``fps`` group is divided: its ``e2e`` figure belongs to the system, the
    rest to the model. Groups not known as model groups belong to the system.
    """

    def fps_without(keep_e2e: bool):
        def inner(group: Column) -> Column:
            return F.map_filter(group, lambda k, _: (k == "e2e") if keep_e2e else (k != "e2e"))

        return inner

    def side(keep_e2e: bool, belongs) -> Column:
        cut = F.transform_values(
            metrics, lambda k, v: F.when(k == "fps", fps_without(keep_e2e)(v)).otherwise(v)
        )
        return F.map_filter(
            cut, lambda k, v: F.when(k == "fps", F.size(v) > 0).otherwise(belongs(k))
        )

    return F.struct(
        side(False, lambda k: k.isin(*MODEL_GROUPS)).alias("model_metrics"),
        side(True, lambda k: ~k.isin(*MODEL_GROUPS)).alias("system_metrics"),
    )
