from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import whitening


def brute(rows, components=4):
    """From numpy's solver in doubles."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in good}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        deviation = sum((n * c - int(s)) ** 2 for c, s in zip(v, sums))
        for k in range(min(components, len(values))):
            along = (np.array(v) - sums / n) @ vectors[:, k] / np.sqrt(values[k])
            out[i, k + 1] = n, deviation, along, values[k] / values.sum()
    return out


def same(found, wanted):
    assert {(r.vec_id, r.component) for r in found} == set(wanted)
    for k in {r.component for r in found}:
        mine = [r for r in found if r.component == k]
        sign = np.sign(sum(r.whitened * wanted[r.vec_id, k][2] for r in mine))
        for r in mine:
            n, deviation, along, explained = wanted[r.vec_id, k]
            assert (r.n, r.deviation) == (n, deviation)
            assert abs(sign * r.whitened - along) < 1e-8 and abs(r.explained / explained - 1) < 1e-9
    assert len({r.identity_error for r in found}) <= 1 and all(r.identity_error < 1e-9 for r in found)


def test_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    same(whitening.whiten(table).collect(), brute(rows))


def test_nulls_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(40)]
    rows += [(100, rows[0][1]), (101, None), (102, [None, *rows[0][1][1:]]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5), (105, [])]
    frame = spark.createDataFrame(rows * 2, "vec_id long, embedding array<double>")
    frame = frame.select("*", F.lit("a").alias("x"), F.lit(0).alias("component"), F.lit("b").alias("n"))
    found = whitening.whiten(frame).collect()
    assert len(found) == 2 * 4 * 41
    same(found, brute(rows))


def test_nothing_to_fit(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0


def test_components_without_variance_are_left_out(spark):
    rows = [(k, [float(k), 2.0 * k, 1.0]) for k in range(10)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12


def test_large_values_are_exact(spark):
    rows = [(k, [130_000.0 + k / 256, -130_000.0 + k * k / 256]) for k in range(50)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    wanted = brute([(k, [v[0] - 130_000, v[1] + 130_000]) for k, v in rows])
    same(found, wanted)


def test_what_is_refused(spark):
    kind = "vec_id long, embedding array<double>"
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], kind))
    with pytest.raises(Exception, match="beyond this operator"):
        whitening.whiten(spark.createDataFrame([(1, [1e9, 2.0])], kind))


@pytest.mark.parametrize(
    "values",
    [[1.0], [3.0, 2.0, 1.0], [1.0] * 3 + [0.5] * 2 + [0.1] * 20, [1.0, 1 - 1e-9, 1 - 1e-12] + [0.1 + 1e-8 * k for k in range(30)],
     [0.0] * 5 + [1.0], np.linspace(1, 0.01, 64).tolist()],
)
def test_refinement_beyond_doubles(values):
    d = len(values)
    turn = whitening.orthonormal(np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0].astype(np.longdouble))
    a = whitening.symmetric(turn * np.array(values, np.longdouble) @ turn.T)
    found, vectors = whitening.refined(a, np.linalg.eigh(a.astype(np.float32))[1])
    assert np.abs(found - np.sort(np.array(values, np.longdouble))[::-1]).max() < 1e-16
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-16
    assert np.abs(a @ vectors - vectors * found).max() < 1e-16


def test_product_is_more_than_double():
    rng = np.random.default_rng(8)
    a, b = (rng.standard_normal((20, 20)).astype(np.longdouble) + 1e-18 for _ in range(2))
    assert np.abs(whitening.product(a, b) - a @ b).max() < 1e-17
