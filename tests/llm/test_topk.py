from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every):
    """All pairs of different rows, rows of one id included."""
    whole = [(n, i, [math.floor(1024 * float(np.float32(x))) for x in v]) for n, (i, v, _) in enumerate(rows)
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, a in whole:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, i, b in whole if m != n)[:k]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)]
    return sorted(out)


def found(spark, rows, k, every):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.top_products(table, F.col("id") % every == 0, k).collect())


@pytest.mark.parametrize("block", [16, 4096])
def test_equals_all_products(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * rng.choice([0.01, 1, 30])], "clash") for i in range(150)]
    rows += [(200 + i, rows[3][1], "copy") for i in range(30)]  # ties
    rows += [(140, rows[7][1], "repeated"), (140, rows[0][1], "repeated"), (3, rows[3][1], "repeated"), (330, [], "empty")]
    rows += [(300, None, ""), (301, [], ""), (302, [1.0, None], ""), (303, [float("nan")] * 8, ""), (304, [float("inf")] * 8, ""),
             (None, [1.0] * 8, ""), (310, [0.0] * 8, ""), (320, [2.0, 3.0], "short")]
    assert found(spark, rows, 10, 10) == brute(rows, 10, 10)


def test_few_or_no_rows(spark):
    assert found(spark, [], 10, 1) == []
    assert found(spark, [(0, [1.0, 2.0], "")], 10, 1) == []
    two = [(0, [1.0, 2.0], ""), (1, [0.5, 0.0], "")]
    assert found(spark, two, 10, 1) == brute(two, 10, 1)


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**30), 2**30, (5, 16)), rng.integers(-(2**30), 2**30, (5, 16))
    assert topk.exact_products(a, b).tolist() == [sum(x * y for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())]


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    """A few long vectors settle the queries; the many short ones never meet them."""
    monkeypatch.setattr(topk, "BLOCK", 20)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (100 if i < 60 else 0.01)], "") for i in range(400)]
    rows = [(i, [abs(x) for x in v], s) for i, v, s in rows]
    sent = []
    compare = topk.compared

    def told(queries, *rest):
        sent.append(queries.selectExpr("sum(greatest(last - first + 1, 0)) AS n").first().n)
        return compare(queries, *rest)

    monkeypatch.setattr(topk, "compared", told)
    assert found(spark, rows, 5, 40) == brute(rows, 5, 40)
    assert sent[0] == 10 and sent[1] <= 10 * 6


def test_only_empty_vectors(spark):
    rows = [(0, [], ""), (1, [], ""), (2, None, "")]
    assert found(spark, rows, 3, 1) == brute(rows, 3, 1)


def test_few_queries_meet_every_vector_once(spark, monkeypatch):
    """Copies of the vectors follow the number of queries, not the number of vectors."""
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "") for i in range(200)]
    parts = []
    compare = topk.compared

    def told(queries, others, n, *rest):
        parts.append(n)
        return compare(queries, others, n, *rest)

    monkeypatch.setattr(topk, "compared", told)
    assert found(spark, rows, 5, 100) == brute(rows, 5, 100)
    assert parts == [1, 1]


@pytest.mark.parametrize("decay", [1.0, 0.6])
def test_only_vectors_out_of_reach_are_dropped(decay):
    rng = np.random.default_rng(13)
    scale = decay ** np.arange(16)
    queries, others = rng.normal(size=(40, 16)) * scale, rng.normal(size=(300, 16)) * scale
    product = queries @ others.T
    least = np.sort(product, axis=1)[:, -3] - 1e-9
    kept = topk.wanted(queries, others, least)
    assert set(np.flatnonzero((product >= least[:, None]).any(axis=0))) <= set(kept)
    assert len(kept) < 300 if decay < 1 else len(kept) <= 300


def test_products_beyond_doubles_are_ranked_exactly(spark):
    """Scores near 2^58 that differ by less than doubles tell apart."""
    rng = np.random.default_rng(14)
    rows = [(i, [2.0**19, *(float(x) for x in rng.integers(-3, 4, 5))], "") for i in range(60)]
    assert found(spark, rows, 7, 20) == brute(rows, 7, 20)
