"""Pixel work: cutting, resizing and preparing images.

Images are rows ``(…, height, width, channels, data)`` with interleaved bytes. Pixels are
touched by NumPy inside Arrow batches and are never a shuffle payload of these operators;
keep batches small with ``spark.sql.execution.arrow.maxRecordsPerBatch`` when images are large.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.tiles import axis_tiles

METHODS = ("nearest", "bilinear", "bicubic")
BLOCK_COLUMNS = ["image_id", "tile_id", "x", "y", "w", "h", "channels", "data"]
BYTES_PER_FRAME = 32 << 20
ROWS_PER_FRAME = 10_000


def result_status(df: DataFrame, result: str = "result") -> DataFrame:
    """``status`` and ``shape`` of an output vector."""
    present = F.col(result).isNotNull()
    return df.withColumn("status", F.when(present, "success").otherwise("failed")).withColumn(
        "shape", F.when(present, F.array(F.size(result)))
    )


def _taps(size_in: int, size_out: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Source positions and weights of every output position along one axis."""
    center = (np.arange(size_out) + 0.5) * size_in / size_out
    if method == "nearest":
        at = np.floor(center).astype(int)[:, None]
        weight = np.ones_like(at, dtype=float)
    else:
        reach = 1 if method == "bilinear" else 2
        base = np.floor(center - 0.5).astype(int)
        at = base[:, None] + np.arange(1 - reach, reach + 1)
        gap = np.abs(center[:, None] - 0.5 - at)
        if method == "bilinear":
            weight = np.clip(1 - gap, 0, None)
        else:
            near = 1.5 * gap**3 - 2.5 * gap**2 + 1
            far = -0.5 * gap**3 + 2.5 * gap**2 - 4 * gap + 2
            weight = np.where(gap <= 1, near, np.where(gap < 2, far, 0.0))
    return np.clip(at, 0, size_in - 1), weight / weight.sum(axis=1, keepdims=True)


def _blend(pixels: np.ndarray, axis: int, size_out: int, method: str) -> np.ndarray:
    at, weight = _taps(pixels.shape[axis], size_out, method)
    shape = [1] * pixels.ndim
    shape[axis] = size_out
    return sum(
        np.take(pixels, at[:, k], axis=axis) * weight[:, k].reshape(shape)
        for k in range(at.shape[1])
    )


def resize_pixels(pixels: np.ndarray, height: int, width: int, method: str) -> np.ndarray:
    """Resize an H x W x C byte array; pixel centres are at half positions."""
    if method == "nearest":
        rows, _ = _taps(pixels.shape[0], height, method)
        cols, _ = _taps(pixels.shape[1], width, method)
        return pixels[rows[:, 0]][:, cols[:, 0]]
    blended = _blend(_blend(pixels.astype(np.float64), 0, height, method), 1, width, method)
    return np.clip(np.rint(blended), 0, 255).astype(np.uint8)


def _array(raw: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(height, width, channels)


def resize_images(df: DataFrame, method: str = "bilinear") -> DataFrame:
    """Replace every image by one of ``target_height`` x ``target_width``."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")

    @F.pandas_udf(T.BinaryType())
    def resized(
        data: pd.Series,
        height: pd.Series,
        width: pd.Series,
        channels: pd.Series,
        to_height: pd.Series,
        to_width: pd.Series,
    ) -> pd.Series:
        rows = zip(data, height, width, channels, to_height, to_width)
        return pd.Series(
            [resize_pixels(_array(d, h, w, c), th, tw, method).tobytes() for d, h, w, c, th, tw in rows]
        )

    cells = [F.col(c) for c in ("data", "height", "width", "channels", "target_height", "target_width")]
    return df.withColumn("data", resized(*cells)).withColumns(
        {"height": F.col("target_height"), "width": F.col("target_width")}
    )


def cut_tiles(images: DataFrame, tile: int = 640, overlap: float = 0.25) -> DataFrame:
    """The pixel block of every grid tile of every image.

    The grid rides along as two short arrays, so an image is cut where it already is; no join
    moves its bytes.
    """
    planned = images.select(
        "image_id",
        "height",
        "width",
        "channels",
        "data",
        axis_tiles(F.col("height"), tile, overlap).alias("ys"),
        axis_tiles(F.col("width"), tile, overlap).alias("xs"),
    )

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for image in batch.itertuples(index=False):
                pixels = _array(image.data, image.height, image.width, image.channels)
                spots = ((y, x) for y in image.ys for x in image.xs)
                for tile_id, (y, x) in enumerate(spots):
                    top, left, h, w = y["start"], x["start"], y["length"], x["length"]
                    block = pixels[top : top + h, left : left + w].tobytes()
                    rows.append((image.image_id, tile_id, left, top, w, h, image.channels, block))
                    held += len(block)
                    if held > BYTES_PER_FRAME or len(rows) >= ROWS_PER_FRAME:
                        yield pd.DataFrame(rows, columns=BLOCK_COLUMNS)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=BLOCK_COLUMNS)

    key = images.schema["image_id"].dataType.simpleString()
    return planned.mapInPandas(
        blocks,
        f"image_id {key}, tile_id int, x int, y int, w int, h int, channels int, data binary",
    )


def preprocess_images(df: DataFrame, width: int, height: int, method: str = "bilinear") -> DataFrame:
    """Resize and normalise every image: tensor, success, error and latency per row.

    A bad image is a failed row, never a failed task.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")

    @F.pandas_udf("tensor array<float>, success boolean, error string, latency double")
    def prepared(
        data: pd.Series, h: pd.Series, w: pd.Series, channels: pd.Series
    ) -> pd.DataFrame:
        def one(row):
            start = time.perf_counter()
            try:
                pixels = resize_pixels(_array(*row), height, width, method)
                tensor = np.moveaxis(pixels, 2, 0).astype(np.float32).ravel() / np.float32(255)
                return tensor, True, None, time.perf_counter() - start
            except Exception as problem:  # becomes the row's error
                return None, False, f"{type(problem).__name__}: {problem}", time.perf_counter() - start

        return pd.DataFrame(
            [one(row) for row in zip(data, h, w, channels)],
            columns=["tensor", "success", "error", "latency"],
        )

    done = df.withColumn("_p", prepared("data", "height", "width", "channels"))
    return done.select(*[c for c in df.columns if c != "data"], "_p.*")


def split_failed(df: DataFrame, index: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Successful rows, and the index and error of failed ones."""
    error = [c for c in ("error",) if c in df.columns]
    return df.filter("success"), df.filter("NOT success").select(index, *error)


def preprocess_stats(df: DataFrame) -> DataFrame:
    """Processed and failed counts, total latency and latency per processed image."""
    found = df.agg(
        F.count_if("success").alias("total_processed"),
        F.count_if(~F.col("success")).alias("total_errors"),
        F.coalesce(F.sum("latency"), F.lit(0.0)).alias("total_latency"),
    )
    mean = F.when(F.col("total_processed") > 0, F.col("total_latency") / F.col("total_processed"))
    return found.select("*", F.coalesce(mean, F.lit(0.0)).alias("avg_latency_per_image"))


def results_in_input_order(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every input with its result or null, in input order."""
    return inputs.join(results, key, "left").orderBy(key)
