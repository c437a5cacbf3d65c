"""Overlapping tile grids over images, their weights and the merge of tile results.

A grid is the product of the starts along both axes, so it is kept as two short arrays per
image until tiles are needed as rows. Nothing here shuffles except the final merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.vectors import hann_weight, truncate_vector
from runlens.sources.shared import spread


def _step(tile: int, overlap: float) -> int:
    step = tile - int(tile * overlap)
    if step <= 0:
        raise ValueError("overlap must be below 1 so that tiles advance")
    return step


def axis_tiles(extent: Column, tile: int, overlap: float) -> Column:
    """Tiles along one axis as ``array<struct<start, length>>``; the last ones are pushed inside."""
    step = _step(tile, overlap)
    begins = F.when(
        extent > 0, F.sequence(F.lit(0), extent.cast("int") - 1, F.lit(step))
    ).otherwise(F.array().cast("array<int>"))

    def piece(begin: Column) -> Column:
        end = F.least(begin + tile, extent.cast("int"))
        start = F.greatest(F.lit(0), end - tile)
        return F.struct(start.alias("start"), (end - start).alias("length"))

    return F.transform(begins, piece)


def tile_grid(
    images: DataFrame, tile: int | tuple[int, int] = 640, overlap: float = 0.25
) -> DataFrame:
    """All tiles of all images in row-major order; ``tile`` is one side or (height, width)."""
    tile_h, tile_w = (tile, tile) if isinstance(tile, int) else tile
    axes = images.select(
        "image_id",
        axis_tiles(F.col("height"), tile_h, overlap).alias("_ys"),
        axis_tiles(F.col("width"), tile_w, overlap).alias("_xs"),
    )
    rows = axes.select(
        "image_id", "_xs", F.size("_ys").alias("_ny"), F.posexplode("_ys").alias("_yi", "_y")
    )
    return rows.select(
        "image_id", "_yi", "_y", "_ny", F.size("_xs").alias("_nx"), F.posexplode("_xs").alias("_xi", "_x")
    ).select(
        "image_id",
        (F.col("_yi") * F.col("_nx") + F.col("_xi")).alias("tile_id"),
        F.col("_x.start").alias("x"),
        F.col("_y.start").alias("y"),
        F.col("_x.length").alias("w"),
        F.col("_y.length").alias("h"),
        (F.col("_ny") * F.col("_nx")).alias("num_tiles"),
    )


def tiles_per_image(tiles: DataFrame) -> DataFrame:
    """Total tiles, images and the average number of tiles of an image."""
    found = tiles.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.sum("_n").alias("total_tiles"), F.count(F.lit(1)).alias("total_images")
    )
    mean = F.when(F.col("total_images") > 0, F.col("total_tiles") / F.col("total_images"))
    return found.select(
        F.coalesce("total_tiles", F.lit(0).cast("bigint")).alias("total_tiles"),
        "total_images",
        F.coalesce(mean, F.lit(0.0)).alias("avg_tiles_per_image"),
    )


def merge_tile_results(tiles: DataFrame, results: DataFrame, keep: int = 10) -> DataFrame:
    """One row per tile that has a result: position and the first ``keep`` values.

    The merged result stays a table keyed by (image_id, tile_id) instead of one nested row per
    image, so a huge image is spread over tasks; ``num_tiles`` is the size of its grid. Both sides are
    shuffled: Spark takes a grid for as small as its images and would gather it on the driver to broadcast it.
    """
    kept = truncate_vector(F.col("result"), keep).alias("result")
    found = results.filter(F.col("result").isNotNull()).select("image_id", "tile_id", kept)
    return tiles.hint("merge").join(found, ["image_id", "tile_id"], "inner").select(
        "image_id",
        "tile_id",
        "x",
        "y",
        "w",
        "h",
        "result",
        "num_tiles",
    )


def _axis_weights(extent: Column, tile: int, overlap: float) -> Column:
    """Summed weight of every position along one axis.

    Tiles begin at multiples of the step while they fit; all others are pushed to the same last
    start. So a position is covered by at most ``ceil(tile / step)`` fitting tiles and by the
    pushed ones, which needs no search through the grid.
    """
    step = _step(tile, overlap)
    size = extent.cast("int")
    fitting = F.greatest(F.lit(0), F.floor((size - tile) / step) + 1)
    pushed = F.ceil(size / step) - fitting
    last = F.greatest(F.lit(0), size - tile)

    def at(pos: Column) -> Column:
        total = F.when(pos >= last, pushed * hann_weight(pos - last, tile)).otherwise(F.lit(0.0))
        for back in range(-(-tile // step)):
            number = F.floor(pos / step) - back
            offset = pos - number * step
            covers = (number >= 0) & (number < fitting) & (offset < tile)
            total = total + F.when(covers, hann_weight(offset, tile)).otherwise(F.lit(0.0))
        return total

    return F.transform(F.sequence(F.lit(0), size - 1), at)


def tile_weight_map(images: DataFrame, tile: int = 640, overlap: float = 0.25) -> DataFrame:
    """Summed Hann weight of every pixel over the tiles that cover it; tiny sums become 1.

    The grid is a product, so the weight is the product of two one-dimensional sums. Both are
    row-local arrays; pixels appear only in the output. Image sizes are spread by image before
    they grow into pixels, which also places the rows for a later grouping by image.
    """
    sized = images.filter((F.col("width") > 0) & (F.col("height") > 0))
    axes = spread(sized.select("image_id", "height", "width"), "image_id").select(
        "image_id",
        _axis_weights(F.col("height"), tile, overlap).alias("_wy"),
        _axis_weights(F.col("width"), tile, overlap).alias("_wx"),
    )
    weight = F.col("_a") * F.col("_b")
    # Arrays are never empty here; the outer form spares the size filter Spark would add, which
    # computes them a second time.
    return (
        axes.select("image_id", "_wx", F.posexplode_outer("_wy").alias("y", "_a"))
        .select("image_id", "y", "_a", F.posexplode_outer("_wx").alias("x", "_b"))
        .select("image_id", "y", "x", F.when(weight < 1e-6, 1.0).otherwise(weight).alias("weight"))
    )
