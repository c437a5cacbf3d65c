"""Registration of queries and the frames they share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the equivalent SQL if there is one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles: sums of doubles depend on the order of addition."""
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# The SQL side of the shared frames.
VIEWS: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prepend the views a statement mentions, and the views those mention, in order."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in wanted:
                    wanted.append(name)

    visit(sql)
    if not wanted:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    head = re.match(r"\s*WITH RECURSIVE\s", sql)
    if head:
        return f"WITH RECURSIVE {ctes}, {sql[head.end():]}"
    head = re.match(r"\s*WITH\s", sql)
    if head:
        return f"WITH {ctes}, {sql[head.end():]}"
    return f"WITH {ctes} {sql}"


VIEWS["timing_v"] = """
SELECT event_type AS run_id, CAST(user_id % 4 AS INT) AS device_id, event_id, ts,
  regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 1000 AS preprocess_s,
  value / 1000 AS execute_s,
  (event_id % 10)::DOUBLE / 1000 AS postprocess_s,
  (user_id % 7)::DOUBLE / 1000 AS queue_wait_s,
  regexp_extract(props, '([0-9]+)', 1)::DOUBLE / 1000 + value / 1000
    + (event_id % 10)::DOUBLE / 1000 + (user_id % 7)::DOUBLE / 1000 AS total_s
FROM events"""


def raw_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as timing records whose totals were not measured."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        (F.col("user_id") % 4).cast("int").alias("device_id"),
        "event_id",
        "ts",
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 1000).alias("preprocess_s"),
        (F.col("value") / 1000).alias("execute_s"),
        ((F.col("event_id") % 10).cast("double") / 1000).alias("postprocess_s"),
        ((F.col("user_id") % 7).cast("double") / 1000).alias("queue_wait_s"),
        F.lit(0.0).alias("total_s"),
    )


VIEWS["timing_big_v"] = """
SELECT l_suppkey AS run_id, l_tax AS preprocess_s, l_quantity / 1000 AS execute_s,
  l_discount AS postprocess_s, 0.0::DOUBLE AS queue_wait_s,
  l_tax + l_quantity / 1000 + l_discount AS total_s
FROM lineitem"""


def raw_timing_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_tax").alias("preprocess_s"),
        (F.col("l_quantity") / 1000).alias("execute_s"),
        F.col("l_discount").alias("postprocess_s"),
        F.lit(0.0).alias("queue_wait_s"),
        F.lit(0.0).alias("total_s"),
    )


# Records that waited six ticks failed.
VIEWS["attempts_v"] = """
SELECT *, device_id + 1 AS num_threads, queue_wait_s < 0.006 AS success,
  CASE device_id WHEN 0 THEN '640x640' WHEN 1 THEN '1k2k' WHEN 2 THEN '4k6k' ELSE 'bad' END
    AS resolution
FROM timing_v"""

VIEWS["resolutions_v"] = """
SELECT * FROM (VALUES ('640x640', 640, 640), ('1k', 1024, 1024), ('1k2k', 1024, 2048),
  ('2k', 2048, 2048), ('2k4k', 2048, 4096), ('4k', 4096, 4096), ('4k6k', 4096, 6144),
  ('3k6k', 3072, 6144), ('6k', 6144, 6144)) AS r(resolution, width, height)"""
