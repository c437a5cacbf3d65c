"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import langid, neardup, packing, phrase_index, pseudonyms
from runlens.sources.shared import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that belong to a language the documents are in. The model learns from all documents with a given
    language; without any, every text with a letter stays. Null texts and texts without a letter go, repeated
    rows are judged alike, no rows give no rows."""
    model = langid.fit(docs, bounded=True)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(langid.accepted(F.col("text"), model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, and one row of a repeated id; rows without an id stay, null texts are
    alone."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item. Null texts hold none; repeated rows go or stay
    together."""
    return phrase_index.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the new text. Null texts stay null, repeated rows change alike."""
    found = docs.select("*", pseudonyms.pseudonymised(F.col("text")).alias("pseudonyms_found"))
    new = {"text": F.col("pseudonyms_found.text")}
    if "n_chars" in docs.columns:
        changed = F.col("pseudonyms_found.n_values") > 0
        new["n_chars"] = F.when(changed, F.length("pseudonyms_found.text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers live on between stages and keep what they remember, so they remember less here."""
    return packing.pack_documents(docs, remembered=100_000)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: The language model, the pseudonyms and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
