"""Writers of results, reports and the archive. All of them write from the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import basename, sanitize_segment
from runlens.operators.images import result_status

REPORT_VERSION = "1.0"


def inference_results(df: DataFrame) -> DataFrame:
    """File name, status and output shape of every image with at least one timed run."""
    timed = df.filter(F.size("inference_times") > 0)
    return result_status(timed).select(
        basename(F.col("image")).alias("image"), "status", "shape"
    )


def write_inference_results(df: DataFrame, path: str) -> None:
    inference_results(df).write.mode("overwrite").json(path)


def write_archive(df: DataFrame, root: str, format: str = "parquet") -> None:
    """Store rows per task and route; only the partitions present in ``df`` are replaced.

    Rows of a partition are gathered first, so few files are written; a partition that holds most rows is split
    over many writers.
    """
    named = df.withColumns(
        {
            "task_name": sanitize_segment(F.coalesce("task_name", F.lit("evaluation"))),
            "route_type": sanitize_segment(F.col("route_type")),
        }
    )
    (
        named.hint("rebalance", "task_name", "route_type")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("task_name", "route_type")
        .format(format)
        .save(root)
    )


def write_report_json(df: DataFrame, path: str) -> None:
    """A report as two folders: ``results`` with one JSON object per row, and ``metadata``.

    One document with all results in an array would pass through a single task; JSON lines
    hold the same content and are written in parallel.
    """
    df.write.mode("overwrite").json(f"{path}/results")
    written = df.sparkSession.read.text(f"{path}/results")
    metadata = written.agg(F.count(F.lit(1)).alias("result_count")).select(
        F.current_timestamp().cast("string").alias("generated_at"),
        "result_count",
        F.lit(REPORT_VERSION).alias("version"),
    )
    metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Report lines as text files whose order is the report order."""
    lines.orderBy("result_no", "line_no").select("line").write.mode("overwrite").text(path)
