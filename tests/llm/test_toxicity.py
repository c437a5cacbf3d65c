from __future__ import annotations

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import toxicity


def maximal_segments(scores):
    """By definition: the best segment (shortest of equal ones), then the same left and right of it."""
    if not scores:
        return []
    best = max(((sum(scores[a : b + 1]), -(b - a), -a) for a in range(len(scores)) for b in range(a, len(scores))))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    left, right = maximal_segments(scores[:a]), maximal_segments(scores[b + 1 :])
    return left + [(a, b, best[0])] + [(x + b + 1, y + b + 1, s) for x, y, s in right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-1, -1, -1, 2, 3, 5]), max_size=14))
def test_segments_equal_the_definition(scores):
    places = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.segments(places, [float(scores[i]) for i in places], 1.0)
    assert sum(s for _, _, s in got) == sum(s for _, _, s in maximal_segments(scores))
    assert max((s for _, _, s in got), default=0) == max((s for _, _, s in maximal_segments(scores)), default=0)


def corpus(n=1500):
    rng = random.Random(2)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 200]))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.choice([1, 3])):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["Idiot", "moron!!", "scum***"]))
        rows.append((i, " ".join(words), toxic))
    copy = "some peculiar copied words stand here " * 3
    return rows + [(n + i, copy + str(i), 1) for i in range(60)]


def test_learns_words_not_copies(spark):
    rows = corpus()
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(labelled.where("doc_id % 4 != 2"))
    assert {"idiot", "moron", "scum"} <= set(model.weights) and not {"peculiar", "copied"} & set(model.weights)
    held = labelled.where(f"doc_id % 4 = 2 AND doc_id < {len(rows) - 60}").withColumn("score", F.lit("clash"))
    got = toxicity.score_toxicity(held, model).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.98 * len(got)
    words = "fine " * 2000 + "you idiot moron here " + "fine " * 2000
    found = spark.createDataFrame([(words,), (None,), ("",)], "text string").select(toxicity.toxic_passages(F.col("text"), model).alias("p")).collect()
    assert [(s.first, s.last) for s in found[0].p] == [(2001, 2002)] and found[1].p == found[2].p == []


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    docs = spark.createDataFrame([(1, None), (1, ""), (2, "words")], "doc_id long, text string")
    for rows in (none, spark.createDataFrame([(1, "a", 0), (2, None, 1), (3, "b", None)], none.schema)):
        model = toxicity.fit(rows)
        assert [r.predicted for r in toxicity.score_toxicity(docs, model).collect()] == [0, 0, 0]
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0


def test_few_rows_that_hold_a_signal(spark):
    rows = [r for r in corpus(400) if r[0] < 400]
    model = toxicity.fit(spark.createDataFrame(rows[:300], "doc_id long, text string, toxic int"))
    assert model.slope > 0
    got = toxicity.score_toxicity(spark.createDataFrame(rows[300:], "doc_id long, text string, toxic int"), model).collect()
    hit = sum(r.predicted for r in got if r.toxic)
    assert hit >= 0.8 * sum(r.toxic for r in got) and sum(r.predicted for r in got if not r.toxic) <= 2


def test_many_common_words_that_stand_out_weakly(spark):
    """Common words a little more frequent in toxic rows, which are longer too: the score of clean text still falls."""
    rng = random.Random(9)
    plain = [f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    rows = []
    for i in range(1200):
        toxic = int(rng.random() < 0.3)
        pool = plain[:50] * (3 if toxic else 2) + plain[50:] * 2
        rows.append((i, " ".join(rng.choice(pool) for _ in range(120 if toxic else 40)) + " idiot" * toxic, toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.where("doc_id < 900"))
    assert model.lam > 0.01 and model.slope > 0
    got = toxicity.score_toxicity(frame.where("doc_id >= 900"), model).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)


def test_a_law_exists_even_where_every_word_weighs():
    drain, lam = toxicity.chance_law({10: 900, 200: 50}, 1000)
    assert 0 < lam <= toxicity.STEEPEST
    mean = (10 * 900 + 200 * 50) * toxicity.STEP / 1000
    assert mean - 0.05 * drain <= -toxicity.LEAST_FALL + 1e-9
    assert toxicity.chance_law({}, 0)[1] == toxicity.STEEPEST


def test_label_shares_of_the_sample(spark):
    frame = spark.range(4000).selectExpr("id AS doc_id", "'a' AS text", "int(id % 100 = 0) AS toxic")
    sample, shares = toxicity.sampled_by_label(frame, 400)
    assert shares[1] == 1.0 and abs(shares[0] * 3960 - 360) < 1
    assert sample.where("toxic = 1").count() == 40 and abs(sample.count() - 400) < 80


def score_by_definition(model, text):
    """Segments by their definition over the weights of all words, then law and curve."""
    tokens = toxicity.words(text)
    scores = [model.weights.get(t) or model.weights.get(toxicity.stem(t)) or -model.drain for t in tokens]
    found = maximal_segments(scores)
    evidence = sum(max(0.0, model.lam * s - math.log(model.k * len(tokens))) for _, _, s in found)
    return 1 / (1 + math.exp(-model.offset - model.slope * min(evidence, toxicity.BIN * toxicity.LAST_BIN)))


def test_scores_equal_the_definition(spark):
    rows = corpus(600)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame)
    short = [r for r in rows if len(r[1].split()) <= 40][:60]
    got = toxicity.score_toxicity(spark.createDataFrame(short, frame.schema), model).collect()
    assert all(abs(r.score - score_by_definition(model, r.text)) < 1e-9 for r in got)
