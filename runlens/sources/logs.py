"""Structured log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_FIELDS = ("timestamp", "level", "logger", "message", "module", "function")
LOG_SCHEMA = (
    "timestamp string, level string, logger string, message string, module string, "
    "function string, line int, exception string"
)
# Levels that sampling never drops.
ALWAYS_KEPT = ("ERROR", "CRITICAL")


def parse_log_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Typed fields of each JSON line; other keys go to the ``extra`` map."""
    known = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
    every = F.from_json(column, "map<string,string>")
    return (
        df.withColumn("_f", F.from_json(column, LOG_SCHEMA))
        .withColumn("extra", F.map_filter(every, lambda k, _: ~k.isin(*known)))
        .select(*[c for c in df.columns if c != column], "_f.*", "extra")
    )


def read_structured_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def sample_bound(rate: float) -> str:
    """The first 16 hexadecimal digits of a hash are below this for a share ``rate`` of all hashes."""
    return f"{int(max(rate, 0.0) * 2**64):016x}"


def sample_logs(df: DataFrame, rate: float, ident: Column, seed: int = 0) -> DataFrame:
    """Keep errors always and other rows at ``rate``, decided by a hash of ``ident``.

    A hash instead of a random number gives the same rows when a task runs again.
    """
    if rate >= 1.0:
        return df
    drawn = F.substring(F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed)))), 1, 16)
    keep = F.col("level").isin(*ALWAYS_KEPT) | (drawn < sample_bound(rate))
    return df.filter(F.coalesce(keep, F.lit(False)))
