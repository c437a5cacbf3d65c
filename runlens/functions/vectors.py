"""Model tensors, outputs and window weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truncate_vector(vector: Column, n: int = 10) -> Column:
    return F.slice(vector, 1, n)


def hann_weight(i: Column, n: int) -> Column:
    """Weight ``i`` of a Hann window with ``n`` points."""
    if n == 1:
        return F.lit(1.0)
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * i / F.lit(n - 1))


def hann(n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: hann_weight(i, n))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode_float32(data: pd.Series) -> pd.Series:
    return data.map(lambda raw: None if raw is None else np.frombuffer(raw, dtype="<f4"))


def decode_output(data: Column) -> Column:
    """Model output bytes as float32 values."""
    return _decode_float32(data)


def split_batch_output(vector: Column, parts: Column | int) -> Column:
    """Cut the output of a batch into ``parts`` equal vectors.

    ``vector`` is a column of the frame; decode bytes in an earlier step, since Python functions
    cannot run inside an array function.
    """
    count = parts if isinstance(parts, Column) else F.lit(parts)
    length = F.floor(F.size(vector) / count).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.slice(vector, i.cast("int") * length + 1, length)
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _planar_unit_range(
    data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series
) -> pd.Series:
    def one(raw, h, w, c):
        if raw is None:
            return None
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, c)
        return np.moveaxis(pixels, 2, 0).astype(np.float32).ravel() / np.float32(255.0)

    return pd.Series([one(*row) for row in zip(data, height, width, channels)])


def normalize_pixels(data: Column, height: Column, width: Column, channels: Column) -> Column:
    """Interleaved bytes to planar float32 in 0..1; a grey image has one channel."""
    return _planar_unit_range(data, height, width, channels)
