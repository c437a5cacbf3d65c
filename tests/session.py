"""The Spark session of the tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from runlens.session import configured


def test_session() -> SparkSession:
    builder = (
        configured(SparkSession.builder).master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
