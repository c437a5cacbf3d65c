from __future__ import annotations

import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from runlens.llm import sharding


def law_holds(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards))
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


@pytest.mark.parametrize(("total", "marked", "drawn"), [(50, 20, 10), (12, 12, 5), (9, 0, 4), (7, 3, 7), (1, 1, 1), (30, 25, 20)])
def test_hypergeometric_frequencies(spark, total, marked, drawn):
    whole = [F.lit(x).cast("bigint") for x in (total, marked, drawn)]
    n = 8000
    rows = spark.range(n).select(sharding.hypergeometric(*whole, sharding.uniform("id")).alias("x")).groupBy("x").count().collect()
    seen = {r.x: r["count"] for r in rows}
    for x in range(marked + 1):
        chance = comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn) if 0 <= drawn - x <= total - marked else 0
        assert abs(seen.pop(x, 0) - n * chance) <= 5 * (n * chance * (1 - chance)) ** 0.5 + 1e-9
    assert not seen


def test_hypergeometric_of_large_numbers(spark):
    total, marked, drawn = 2_000_000_000, 80_000_000, 1_000_000
    whole = [F.lit(x).cast("bigint") for x in (total, marked, drawn)]
    x = spark.range(300).select(sharding.hypergeometric(*whole, sharding.uniform("id")).alias("x"))
    mean, spread = x.agg(F.avg("x"), F.stddev("x")).first()
    deviation = (drawn * 0.04 * 0.96) ** 0.5
    assert abs(mean - 40_000) < 5 * deviation / 300**0.5 and 0.8 < spread / deviation < 1.2


def test_matrix_has_the_given_margins(spark):
    sizes = [1, 50, 7, 300, 12, 64, 90, 3, 3, 200, 1]
    total, shards = sum(sizes), 7
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    parts = spark.createDataFrame([(100 + 5 * k, n) for k, n in enumerate(sizes)], "part long, n long")
    rows = sorted(sharding.communication_matrix(parts, quota).collect())
    assert [r.part for r in rows] == [100 + 5 * k for k in range(len(sizes))]
    assert [sum(r.sent) for r in rows] == sizes and [sum(c) for c in zip(*(r.sent for r in rows))] == quota
    assert all(x >= 0 for r in rows for x in r.sent)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    law_holds(rows, 24)
    told = sorted((r.doc_id, r.size, r.text_crc32) for r in rows)
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    assert told == sorted((d, len(t) + 8, zlib.crc32(t)) for d, t in texts)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_small_parts_and_cells_are_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BITS", 5)
    monkeypatch.setattr(sharding, "CELL_ROWS", 16)
    frame = spark.range(3000).repartition(3).select("id", F.lit(1).alias("shard"), F.lit("a").alias("__shard_x"))
    rows = sharding.assign(frame, 6).collect()
    law_holds(rows, 6)
    assert sorted(r.id for r in rows) == list(range(3000))
    # Neither the shard nor the slot follows the row's place in the input.
    by_half = Counter((r.id < 1500, r.shard) for r in rows)
    assert all(190 < by_half[True, s] < 310 for s in range(6))
    mean = sum(r.slot for r in rows if r.id < 1500) / 1500
    assert abs(mean - 249.5) < 25


def test_same_layout_same_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(sharding.shard_documents(docs).collect()) == sorted(sharding.shard_documents(docs).collect())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_rows_than_shards_repeated_rows_and_nulls(spark, n):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, None), (2, ""), (1, "x" * 100_000)][:n], "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == n
    law_holds(rows, 24)


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sharding.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
