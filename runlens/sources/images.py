"""Image files as rows: finding them and decoding them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.dims import IMAGE_SUFFIXES

IMAGE_SCHEMA = "origin string, height int, width int, channels int, data binary"


def has_suffix(path: Column, suffixes=IMAGE_SUFFIXES) -> Column:
    """Case-insensitive suffix test on a path; suffixes are plain text, with or without their point."""
    ends = [F.lower(path).endswith("." + s.lstrip(".").lower()) for s in suffixes]
    return reduce(or_, ends) if ends else F.lit(False)


def scan_images(spark: SparkSession, paths: list[str], suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """Image files directly inside the given folders, or the given files: path, time, length.

    Only file listings are read; the content column is never selected.
    """
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "modificationTime", "length").filter(
        has_suffix(F.col("path"), suffixes)
    )


def load_images(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Decoded RGB images, and the files that could not be decoded.

    The built-in source decodes to interleaved BGR bytes; swapping to RGB is the only Python
    step. Undecodable files come back with a negative height.
    """
    read = (
        spark.read.format("image").option("dropInvalid", False).load(paths).select("image.*")
    )
    decoded = read.filter(F.col("height") > 0).select(
        "origin",
        "height",
        "width",
        F.col("nChannels").alias("channels"),
        _bgr_to_rgb(F.col("data"), F.col("nChannels")).alias("data"),
    )
    failed = read.filter(F.col("height") <= 0).select(
        "origin", F.lit(2202).alias("error_code"), F.lit("image cannot be decoded").alias("error")
    )
    return decoded, failed


@F.pandas_udf(T.BinaryType())
def _bgr_to_rgb(data, channels):
    import numpy as np
    import pandas as pd

    def one(raw, c):
        if c < 3:
            return raw
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(-1, c)
        return pixels[:, [2, 1, 0, *range(3, c)]].tobytes()

    return pd.Series([one(raw, c) for raw, c in zip(data, channels)])
