"""Exact, linearly interpolated quantiles for groups of any size.

Small groups use the built-in ``percentile``. Its buffer holds every distinct
value of the group, so a large group is answered by rank selection instead:
count values per cell, find the cells that hold the wanted ranks, and look only
inside those. Only per-cell counts and a sliver of the values are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.slicing import BROADCAST_ROWS, CENTRE, null_safe_join, sized
from runlens.sources.shared import written

PROBS = (0.5, 0.95, 0.99)
LARGE_GROUP = 100_000


def percentiles(column: str, weight: str | None = None, probs=PROBS, large: bool = False) -> Column:
    """Built-in percentiles; with ``large`` they skip rows of a large group (``_n`` is set)."""
    value = F.when(F.col("_n").isNull(), F.col(column)) if large else F.col(column)
    wanted = [float(p) for p in probs]
    return F.percentile(value, wanted, F.col(weight)) if weight else F.percentile(value, wanted)


def _ranks(n: Column, probs) -> Column:
    at = [(n - 1) * F.lit(float(p)) for p in probs]
    both = [edge(h).cast("bigint") for h in at for edge in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*both))


def selected_percentiles(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    probs=PROBS,
    limit: int = LARGE_GROUP,
    weight: str | None = None,
    groups: int = BROADCAST_ROWS + 1,
) -> DataFrame:
    """Percentile arrays ``_q_<column>`` of every group in ``df`` by rank selection.

    With ``weight`` a row stands for that many equal values. ``groups`` is the number of groups
    where it is known; the tables of bounds and wanted cells have a few rows per group.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    times = (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w")
    long = df.select(
        *keys, times, F.expr(f"stack({len(columns)}, {pairs}) AS (_name, _v)")
    ).filter(F.col("_v").isNotNull())
    group = keys + ["_name"]
    # Approximate bounds depend on the order in which partial results arrive, so they are written: counts of cells and
    # rows of wanted cells must come from the same cells.
    bounds = (
        long.groupBy(*group)
        .agg(F.sum("_w").alias("_n"), F.percentile_approx("_v", CENTRE, F.lit(10_000)).alias("_c"))
        .select(*group, "_n", F.col("_c")[0].alias("_lo"), F.col("_c")[1].alias("_hi"))
        .withColumn("_cells", F.ceil(F.col("_n") * 10 / limit))
    )
    bounds = written(bounds, "percentile-bounds")
    # Latencies crowd near their minimum and have a long tail, so the cells are
    # logarithmic. log1p never decreases, hence cells keep the order of values.
    reach = 1e6
    centred = F.least(F.greatest("_v", "_lo"), F.col("_hi"))
    share = (centred - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    cell = F.when(
        F.col("_hi") > F.col("_lo"),
        F.floor(F.log1p(share * reach) / math.log1p(reach) * F.col("_cells")),
    ).otherwise(F.lit(0))
    facts = groups * len(columns)
    placed = null_safe_join(long, sized(bounds, facts), group, "inner").select(
        *group, "_v", "_w", "_n", cell.cast("bigint").alias("_cell")
    )

    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_cell"))
    cells = (
        placed.groupBy(*group, "_cell")
        .agg(F.sum("_w").alias("_c"), F.first("_n").alias("_n"))
        .withColumn("_before", upto - F.col("_c"))
        .withColumn("_wanted", _ranks(F.col("_n"), probs))
        .filter(
            F.exists(
                "_wanted",
                lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")),
            )
        )
        .select(*group, "_cell", "_before", "_wanted")
    )
    inside = Window.partitionBy(*group, "_cell").orderBy("_v")
    hits = (
        null_safe_join(
            placed.drop("_n"), sized(cells, 2 * len(probs) * facts), group + ["_cell"], "inner"
        )
        .groupBy(*group, "_cell", "_v")
        .agg(
            F.sum("_w").alias("_c"),
            F.first("_before").alias("_before"),
            F.first("_wanted").alias("_wanted"),
        )
        .withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
        .select(
            *group,
            "_v",
            F.explode(
                F.filter(
                    "_wanted", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_c"))
                )
            ).alias("_rank"),
        )
    )
    # At most two ranks per probability reach this point for each group.
    ranked = hits.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )
    joined = null_safe_join(ranked, bounds.select(*group, "_n"), group, "inner")

    def interpolated(p: float) -> Column:
        h = (F.col("_n") - 1) * F.lit(float(p))
        low = F.try_element_at("_at", F.floor(h).cast("bigint"))
        high = F.try_element_at("_at", F.ceil(h).cast("bigint"))
        return low + (high - low) * (h - F.floor(h))

    answered = joined.withColumn("_q", F.array(*[interpolated(p) for p in probs]))
    return answered.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(f"_q_{c}") for c in columns]
    )
