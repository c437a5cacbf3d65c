"""Session settings this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Timestamps without a zone are read as UTC; watermarks need zoned timestamps.
    "spark.sql.session.timeZone": "UTC",
    # Sizes joins and partitions from what stages really produced, and splits skewed joins.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Image rows are large; small Arrow batches bound the memory of a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder
