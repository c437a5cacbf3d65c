"""How queued items are grouped into batches, and how the batch size adapts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.slicing import (
    ROWS_PER_SLICE,
    first_rows,
    null_safe_join,
    sized,
    sliced,
    with_keys,
    with_position,
)
from runlens.sources.shared import written


def priority_batches(
    df: DataFrame, keys: list[str], size: int, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Take items by (priority, arrival) and cut them into batches of ``size`` per queue."""
    numbered = with_position(df, keys, ["priority", "seq"], "_pos", rows_per_slice)
    return numbered.select(
        *df.columns,
        F.floor((F.col("_pos") - 1) / size).alias("batch_no"),
        F.pmod(F.col("_pos") - 1, F.lit(size)).alias("slot"),
    )


def chunk_with_padding(
    df: DataFrame,
    keys: list[str],
    order: str,
    item: str,
    size: int,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Fixed chunks per submission (all rows without keys); the last one is filled up with the first item."""
    keyed, group = with_keys(df, keys)
    first = first_rows(keyed, group, order).select(*group, F.col(item).alias("_first"))
    numbered = with_position(keyed, group, [order], "_pos", rows_per_slice)
    chunks = numbered.groupBy(*group, F.floor((F.col("_pos") - 1) / size).alias("chunk_no")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col(item).alias("v")))).alias("_items")
    )
    filled = F.size("_items")
    padding = F.array_repeat("_first", F.greatest(F.lit(0), size - filled))
    return null_safe_join(chunks, first, group, "left").select(
        *keys,
        "chunk_no",
        filled.alias("filled"),
        F.concat(F.col("_items.v"), padding).alias("items"),
    )


def gap_batches(
    df: DataFrame,
    keys: list[str],
    order: str,
    size: int,
    gap_seconds: float,
    rows_per_slice: int = ROWS_PER_SLICE,
    tie: list[str] | None = None,
) -> DataFrame:
    """A batch closes when it is full or nothing arrived for ``gap_seconds``.

    Adds ``session_no`` (1-based, runs of arrivals without a gap) and ``batch_no`` (0-based
    inside the session).
    """
    gap = int(round(gap_seconds * 1_000_000))
    keyed, keys = with_keys(df, keys)
    timed = keyed.withColumn("_us", F.unix_micros(F.col(order).cast("timestamp")))
    opens = F.coalesce(F.col("_us") - F.col("_prev") >= gap, F.lit(True)).cast("bigint")

    # Inside a slice: does a row open a session, how many did so far, where did the last open.
    order_by = [order, *(tie or [])]
    cut, slices = sliced(timed, keys, order_by, rows_per_slice)
    local = keys + ["_slice"]
    ends = cut.groupBy(*local).agg(F.max("_us").alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    # A group that goes on from an earlier slice is the first of its slice: at most one for each slice.
    before = ends.select(*local, F.lag("_end").over(across).alias("_before_end")).filter("_before_end IS NOT NULL")
    inside = Window.partitionBy(*local).orderBy(*order_by)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        null_safe_join(cut, sized(before, slices), local, "left")
        .withColumn("_prev", F.coalesce(F.lag("_us").over(inside), F.col("_before_end")))
        .withColumns({"_opens": opens, "_row": F.row_number().over(inside).cast("bigint")})
        .withColumns(
            {
                "_opened": F.sum("_opens").over(so_far),
                "_start": F.max(F.when(F.col("_opens") == 1, F.col("_row"))).over(so_far),
            }
        )
    )
    # Across slices: rows and sessions of earlier slices, and the row where the open session began.
    totals = marked.groupBy(*local).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_opens").alias("_o"), F.max("_start").alias("_s")
    )
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        totals.withColumn("_rows", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumns(
            {
                "_sessions": F.sum("_o").over(earlier),
                "_began": F.max(F.col("_rows") + F.col("_s")).over(earlier),
            }
        )
        .filter("_sessions IS NOT NULL")
        .select(*local, "_rows", "_sessions", "_began")
    )
    rows_before = F.coalesce("_rows", F.lit(0))
    start = F.coalesce(rows_before + F.col("_start"), F.col("_began"))
    return null_safe_join(marked, sized(carried, slices), local, "left").select(
        *df.columns,
        (F.col("_opened") + F.coalesce("_sessions", F.lit(0))).alias("session_no"),
        F.floor((rows_before + F.col("_row") - start) / size).alias("batch_no"),
    )


def reassemble_batches(
    df: DataFrame, parts_per_row: int = 1000, order: list[str] | None = None
) -> DataFrame:
    """Results of a batch as maps keyed by sub-batch id.

    A batch with more than ``parts_per_row`` sub-batches continues in further rows
    (``part_no``), so no row grows with the batch. A sub-batch that was delivered twice
    keeps the later delivery by ``order``, or the largest result without one.
    """
    newest = F.max_by("result", F.struct(*order)) if order else F.max("result")
    unique = df.groupBy("batch_id", "sub_batch_id").agg(newest.alias("result"))
    entry = F.struct("sub_batch_id", "result")
    return (
        unique.withColumn("part_no", F.floor(F.col("sub_batch_id") / parts_per_row))
        .groupBy("batch_id", "part_no")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("results"))
    )


# One adjustment maps a size x to min(max(x + add, floor), top). Such maps compose into maps
# of the same form, so a long run of adjustments is folded block by block in parallel.
_FREE = 1 << 40
_STEPS_PER_BLOCK = 200

#: Mean latencies in seconds below which a batch grows and above which it shrinks.
GROW_BELOW_S, SHRINK_ABOVE_S = 0.01, 0.05


def _apply(x: Column, f: Column) -> Column:
    return F.least(F.greatest(x + f["add"], f["floor"]), f["top"])


def _compose(f: Column, g: Column) -> Column:
    def through(c: Column) -> Column:
        return F.least(F.greatest(c + g["add"], g["floor"]), g["top"])

    return F.struct(
        (f["add"] + g["add"]).alias("add"),
        through(f["floor"]).alias("floor"),
        through(f["top"]).alias("top"),
    )


def _step_map(add: int, floor: int, top: int) -> Column:
    return F.struct(
        *[
            F.lit(v).cast("bigint").alias(n)
            for n, v in (("add", add), ("floor", floor), ("top", top))
        ]
    )


def _blocks(maps: DataFrame, keys: list[str]) -> DataFrame:
    return maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "f"))).alias("fs"))


def _walk(start: Column) -> Column:
    """Sizes before and after every map of a block that begins with ``start``."""
    visits = F.array().cast("array<struct<idx:bigint,before:bigint,after:bigint>>")
    walked = F.aggregate(
        "fs",
        F.struct(start.cast("bigint").alias("x"), visits.alias("seen")),
        lambda acc, e: F.struct(
            _apply(acc["x"], e["f"]).alias("x"),
            F.array_append(
                acc["seen"],
                F.struct(
                    e["idx"].alias("idx"),
                    acc["x"].alias("before"),
                    _apply(acc["x"], e["f"]).alias("after"),
                ),
            ).alias("seen"),
        ),
    )
    return walked["seen"]


def _trace(maps: DataFrame, keys: list[str], starts: DataFrame | None, default: int) -> DataFrame:
    """(keys, idx, before, after) for maps numbered 0, 1, 2 ... per key.

    ``starts`` holds ``start`` for keys that do not begin with ``default``. Blocks of maps fold to one map each,
    which are folded in blocks again until a key has one block; then sizes are walked through from the top down.
    """

    def in_blocks(found: DataFrame) -> DataFrame:
        numbered = found.withColumn("_block", F.floor(F.col("idx") / _STEPS_PER_BLOCK))
        return written(_blocks(numbered, keys + ["_block"]), "blocks")

    folded = F.aggregate("fs", _step_map(0, -_FREE, _FREE), lambda acc, e: _compose(acc, e["f"]))
    levels = [in_blocks(maps)]
    last = levels[0].agg(F.max("_block")).first()[0]
    while last:
        levels.append(in_blocks(levels[-1].select(*keys, F.col("_block").alias("idx"), folded.alias("f"))))
        last //= _STEPS_PER_BLOCK
    top = levels.pop().withColumn("_entry", F.lit(default))
    if starts is not None:
        top = null_safe_join(top, starts, keys, "left").withColumn("_entry", F.coalesce("start", "_entry"))
    sizes = top.select(*keys, F.explode(_walk(F.col("_entry"))).alias("_s")).select(*keys, "_s.*")
    for blocks in reversed(levels):
        entries = sizes.select(*keys, F.col("idx").alias("_block"), F.col("before").alias("_entry"))
        entered = null_safe_join(blocks, entries, keys + ["_block"], "inner")
        sizes = entered.select(*keys, F.explode(_walk(F.col("_entry"))).alias("_s")).select(*keys, "_s.*")
    return sizes


def latency_steps(
    numbered: DataFrame, keys: list[str], latency: str, low: int, high: int, every: int
) -> DataFrame:
    """The adjustment after every full group of ``every`` rows, from rows with ``_pos``."""
    mean = F.avg(latency)
    return (
        numbered.groupBy(*keys, F.floor((F.col("_pos") - 1) / every).alias("idx"))
        .agg(
            F.when(mean < GROW_BELOW_S, _step_map(1, -_FREE, high))
            .when(mean > SHRINK_ABOVE_S, _step_map(-1, low, _FREE))
            .otherwise(_step_map(0, -_FREE, _FREE))
            .alias("f"),
            F.count(F.lit(1)).alias("_n"),
        )
        .filter(F.col("_n") == every)
        .drop("_n")
    )


def adaptive_batch_trace(
    df: DataFrame,
    keys: list[str],
    order: str,
    latency: str,
    start: int = 4,
    low: int = 1,
    high: int = 16,
    every: int = 10,
    starts: DataFrame | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Batch size after every ``every`` latencies.

    A mean below 10 ms grows the size by one, above 50 ms shrinks it by one, within bounds.
    ``starts`` may give other first sizes per key (column ``start``).
    """
    numbered = with_position(df.select(*keys, order, latency), keys, [order], "_pos", rows_per_slice)
    steps = latency_steps(numbered, keys, latency, low, high, every)
    sizes = _trace(steps, keys, starts, start)
    return sizes.select(*keys, F.col("idx").alias("step"), F.col("after").alias("batch_size"))
