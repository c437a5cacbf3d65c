"""Running a model over rows in fixed batches, and user stages and callbacks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.images import cut_tiles
from runlens.operators.tiles import merge_tile_results, tile_grid
from runlens.sources.shared import spread, written


def score(
    df: DataFrame,
    column: str,
    make_predict: Callable,
    batch_size: int = 64,
    result: str = "result",
    return_type: T.DataType | None = None,
    input_tensor_shapes: list | None = None,
) -> DataFrame:
    """Add the model output for ``column``; the model is loaded once per Python worker."""
    predict = predict_batch_udf(
        make_predict,
        return_type=return_type or T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=input_tensor_shapes,
    )
    return df.withColumn(result, predict(F.col(column)))


def score_timed(
    df: DataFrame,
    run_id: str,
    column: str,
    make_predict: Callable,
    batch_size: int = 64,
    prepare: Callable | None = None,
) -> DataFrame:
    """Timing rows of a scoring run: one per batch, with the seconds of each stage.

    A batch is identified by the first and last key of its rows; batches never mix tasks.
    """

    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict()
        for batch in batches:
            rows = []
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                t0 = time.perf_counter()
                values = part[column].tolist()
                tensor = np.stack(values) if prepare is None else prepare(values)
                t1 = time.perf_counter()
                output = predict(tensor)
                t2 = time.perf_counter()
                size = len(np.asarray(output))
                t3 = time.perf_counter()
                rows.append((part[run_id].iloc[0], part[run_id].iloc[-1], size, t1 - t0, t2 - t1, t3 - t2))
            yield pd.DataFrame(
                [(*r[:6], 0.0, r[3] + r[4] + r[5]) for r in rows],
                columns=[
                    "first_key", "last_key", "images", "preprocess_s", "execute_s",
                    "postprocess_s", "queue_wait_s", "total_s",
                ],
            )

    key = df.schema[run_id].dataType.simpleString()
    return df.select(run_id, column).mapInPandas(
        timed,
        f"first_key {key}, last_key {key}, images int, preprocess_s double, execute_s double, "
        "postprocess_s double, queue_wait_s double, total_s double",
    )


def pipeline_of(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply stages in order; each takes and returns a DataFrame, so the plan stays one plan."""
    for stage in stages:
        df = df.transform(stage)
    return df


def map_stages(df: DataFrame, column: str, stages: list[Callable], return_type: str) -> DataFrame:
    """Apply plain Python functions in order to every value of ``column``, in one Arrow pass."""

    @F.pandas_udf(return_type)
    def run(values: pd.Series) -> pd.Series:
        def through(value):
            for stage in stages:
                value = stage(value)
            return value

        return values.map(through)

    return df.withColumn(column, run(F.col(column)))


def on_result(df: DataFrame, callback: Callable) -> DataFrame:
    """Call user code for every result row, on the executors, and tell what became of it.

    One row a task: ``partition``, rows ``delivered``, rows ``failed`` (the callback raised), the ``total`` of
    the numbers it returned, and the first ``error``. The outcome is written once, so reading it calls nothing
    again, and of a retried task only the attempt that succeeded counts. That task has called for its rows
    before, so the callback should be idempotent.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, failed, total, error = 0, 0, 0.0, None
        for batch in batches:
            for values in batch.to_pylist():
                try:
                    told = callback(Row(**values))
                except Exception as raised:  # user code may raise anything; the other rows are still delivered
                    failed, error = failed + 1, error or f"{type(raised).__name__}: {raised}"
                else:
                    done, total = done + 1, total + (told or 0)
        yield pa.RecordBatch.from_pydict({
            "partition": [TaskContext.get().partitionId()], "delivered": [done], "failed": [failed],
            "total": [float(total)], "error": pa.array([error], pa.string()),
        })

    outcome = df.mapInArrow(each, "partition long, delivered long, failed long, total double, error string")
    return written(outcome, "outcome")


def tiled_inference(
    images: DataFrame,
    make_predict: Callable,
    tile: int = 640,
    overlap: float = 0.25,
    batch_size: int = 16,
    keep: int = 10,
    tasks: int | None = None,
) -> DataFrame:
    """Cut images into tiles, score every tile and merge by tile.

    Tiles are spread over tasks by (image, tile) before scoring, so one huge image does not
    hold up one task. The model sees each tile's bytes.
    """
    blocks = cut_tiles(images, tile, overlap).select("image_id", "tile_id", "data")
    placed = (
        blocks.repartition(tasks, "image_id", "tile_id")
        if tasks
        else spread(blocks, "image_id", "tile_id")
    )

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predict()
        for data in parts:
            out = []
            for at in range(0, len(data), batch_size):
                tiles = [np.frombuffer(raw, dtype=np.uint8) for raw in data.iloc[at : at + batch_size]]
                out.extend(np.asarray(v, dtype=np.float32) for v in predict(tiles))
            yield pd.Series(out, index=data.index)

    results = placed.select("image_id", "tile_id", scored("data").alias("result"))
    return merge_tile_results(tile_grid(images, tile, overlap), results, keep)
