from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import langid

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_folds_follow_crc32(spark):
    got = spark.range(50).withColumn("f", langid.in_fold("id", 3, 1)).collect()
    assert all(r.f == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    assert spark.createDataFrame([(None,)], "id long").select(langid.in_fold("id", 3, 1).alias("f")).first().f is False


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCUMENTS).withColumn("held", langid.in_fold("doc_id", 3, 1))
    model = langid.fit(docs.where(~F.col("held")), bounded=True)
    got = langid.identify(docs.where("held"), model)
    assert got.columns == [*docs.columns, "lang_pred", "score", "ambiguous"]
    rows = got.collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    kept = docs.where(langid.accepted(F.col("text"), model)).count()
    assert kept >= 0.99 * docs.count()


def test_odd_texts_and_clashing_columns(spark):
    train = spark.createDataFrame([(1, "the and of " * 9, "en"), (2, "der und das " * 9, "de"), (3, None, "de"), (4, "x", None), (5, "", "en")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    odd = [None, "", "123 !?", "²", "a", "der und das " * 50_000, "日本"]
    docs = spark.createDataFrame([(t, "old") for t in odd], "text string, score string")
    got = langid.identify(docs, model).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, True, False, False, False]
    assert got[5].lang_pred == "de" and got[0].score == 0.0
    assert langid.identify(docs.where("false"), model).count() == 0


def test_no_or_one_language(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, langid.fit(docs)).first().lang_pred == "und"
    one = langid.fit(docs.withColumn("lang", F.lit("xx")))
    assert langid.identify(docs, one).first()[-3:] == ("xx", 1.0, False)


@pytest.mark.parametrize("languages", [2, 3, 5, 6, 30])
def test_codewords_differ(languages):
    code = langid.codewords(languages)
    assert (np.abs(code.sum(axis=0)) < languages).all()
    apart = min((code[i] != code[j]).sum() for i in range(languages) for j in range(i))
    assert apart >= (1 if languages == 2 else 2 if languages == 3 else 4)


def test_margins_do_not_depend_on_chunks(spark, monkeypatch):
    text = "ein langer Text mit äöü " * 40
    whole = np.concatenate(list(langid.trigram_buckets(text)))
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (np.concatenate(list(langid.trigram_buckets(text))) == whole).all()


def test_foreign_texts_and_noise_are_rejected(spark):
    docs = spark.read.parquet(DOCUMENTS)
    foreign = [
        "Это совершенно другой язык, которого нет в корпусе", "これは日本語の文章です。漢字とかな", "zxqj kkvw qqqq xzzk vvwq jjqx kkzx",
        "Ελληνικά γράμματα σε ένα κείμενο", "x" * 500,
    ]
    texts = spark.createDataFrame([(t,) for t in foreign], "text string")
    for languages in (["en", "de"], ["en"], ["en", "de", "fr", "es"]):
        model = langid.fit(docs.where(F.col("lang").isin(languages)), bounded=True)
        assert texts.where(langid.accepted(F.col("text"), model)).count() == 0
        own = docs.where(F.col("lang").isin(languages))
        assert own.where(langid.accepted(F.col("text"), model)).count() >= 0.995 * own.count()
    odd = spark.createDataFrame([(None,), ("",), ("12 !",)], "text string")
    assert odd.where(langid.accepted(F.col("text"), model)).count() == 0
    assert odd.where("false").where(langid.accepted(F.col("text"), model)).count() == 0


def test_repeated_rows_are_judged_alike(spark):
    docs = spark.read.parquet(DOCUMENTS).limit(50)
    model = langid.fit(spark.read.parquet(DOCUMENTS))
    twice = langid.identify(docs.unionByName(docs), model).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("score").alias("k"))
    assert all(r.n == 2 and r.k == 1 for r in twice.collect())


def test_every_row_is_learned_from(spark):
    """Counts, weights and the bound follow from all rows: fitted in numpy and on many more rows than one batch."""
    texts = {"en": "the house of words and winds ", "de": "das haus der worte und winde "}
    rows = [(i, texts[lang] * 2 if i % 5000 else "odd " + "xq" * (i // 5000 + 1), lang) for i in range(1, 20_001) for lang in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs, bounded=True)
    assert model.languages == ["de", "en"]
    counts = np.zeros((2, 1 << langid.BUCKET_BITS))
    known = {t: np.bincount(np.concatenate(list(langid.trigram_buckets(t))), minlength=1 << langid.BUCKET_BITS) for t in {r[1] for r in rows}}
    for _, text, lang in rows:
        counts[model.languages.index(lang)] += known[text]
    share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    assert np.allclose(model.likely, np.log(share).T, atol=1e-5)
    for k, lang in enumerate(model.languages):
        likely = {t: langid.means(t, model.likely)[0][k] for t in known}
        reached = np.quantile([likely[t] for _, t, x in rows if x == lang], langid.FEW)
        unrelated = model.likely.mean(axis=0, dtype=np.float64)[k]
        assert model.least[k] == pytest.approx(unrelated + langid.UNLIKE * max(0.0, reached - unrelated), abs=1e-6)


def test_texts_counted_together_are_all_counted(monkeypatch):
    texts = ["", "a", "some words ", "ein langer Text mit äöü " * 9, "12 !"] * 5
    want = np.zeros(1 << langid.BUCKET_BITS)
    for text in texts:
        for buckets in langid.trigram_buckets(text):
            np.add.at(want, buckets, 1)
    for together in (1, 50, 1 << 20):
        monkeypatch.setattr(langid, "COUNTED", together)
        assert (langid.bucket_counts(texts) == want).all()
    assert not langid.bucket_counts([]).any()


def test_texts_of_a_batch_are_decoded_as_one_by_one(spark):
    docs = spark.read.parquet(DOCUMENTS)
    model = langid.fit(docs)
    texts = [r.text for r in docs.where("length(text) > 0").limit(40).collect()] + ["12 !", "x"]
    margins = model.margins(texts)
    for text, row, language, score, ambiguous in zip(texts, margins, *model.decode(margins)):
        rows = [model.weights[b].astype(float) for b in langid.trigram_buckets(text)]
        mean = sum(r.sum(axis=0) for r in rows) / max(1, sum(map(len, rows)))
        assert row == pytest.approx(mean, abs=1e-9)
        loss = [sum(t * math.log1p(math.exp(-c * m)) for t, c, m in zip(trust, code, mean)) for trust, code in zip(model.trust, model.code)]
        likely = [math.exp(-x * model.code.shape[1]) for x in loss]
        best = sorted(((-x / sum(likely), k) for k, x in enumerate(likely)))
        assert (language, score) == (best[0][1], pytest.approx(-best[0][0]))
        assert ambiguous == (best[1][0] - best[0][0] < langid.CLOSE)
    assert [len(x) for x in model.decode(model.margins([]))] == [0, 0, 0]


def test_texts_are_searched_for_letters_once(spark):
    """The text goes to Python and is not kept for a second look."""
    docs = spark.read.parquet(DOCUMENTS)
    found = langid.identify(docs, langid.fit(docs)).select("doc_id", "lang_pred", "score")
    plan = found._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("rlike") == 1
