"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier over hashed byte trigrams tells
the languages with a one from those with a zero (a naive Bayes weight per bucket, averaged over the text).
Decoding picks the codeword with the least logistic loss, each bit weighted by how well its classifier did
on the training rows of that language; a near tie flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.staging import staged
from runlens.operators.quantiles import selected_percentiles

BUCKET_BITS = 15
#: Up to so many languages get every possible bit; more get random bits, this many per doubling.
EXHAUSTIVE_LANGUAGES = 5
BITS_PER_DOUBLING = 12
#: Trigrams looked up at once; bounds memory for long texts.
CHUNK = 1 << 15
#: Trigrams counted at once.
COUNTED = 1 << 20
#: Texts whose two best languages are closer than this (difference of scores) are ambiguous.
CLOSE = 0.1
#: A corpus rejects texts less likely than this: so far from what unrelated trigrams get, towards the likelihood a
#: trigram that all but a few texts of the language reach.
UNLIKE, FEW = 0.5, 0.002

_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def trigram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all byte trigrams of the lower-cased text, a chunk at a time; no letter, no trigram."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace").translate(_LETTERS), np.uint8)
    for at in range(0, len(raw) - 2, CHUNK):
        part = raw[at : at + CHUNK + 2].astype(np.uint32)
        pairs = part[:-1] << np.uint32(8) | part[1:]
        code = (pairs[:-1] << np.uint32(8) | part[2:])[pairs[:-1] != 0x2020]
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def bucket_counts(texts: Iterable[str]) -> np.ndarray:
    """How many trigrams of the texts fall into each bucket; short texts are counted together."""
    total = np.zeros(1 << BUCKET_BITS)
    held, size = [], 0
    for text in texts:
        for buckets in trigram_buckets(text):
            held.append(buckets)
            size += len(buckets)
        if size >= COUNTED:
            total += np.bincount(np.concatenate(held), minlength=len(total))
            held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=len(total))
    return total


def means(text: str, *tables: np.ndarray) -> list[np.ndarray]:
    """Mean over the text's trigrams of their rows in each table; a table of doubles in row order is fastest."""
    totals, count = [np.zeros(table.shape[1]) for table in tables], 0
    for buckets in trigram_buckets(text):
        ones = np.ones(len(buckets))
        for total, table in zip(totals, tables):
            total += ones @ table.take(buckets, axis=0)
        count += len(buckets)
    return [total / max(count, 1) for total in totals]


def codewords(languages: int) -> np.ndarray:
    """One row of +1/-1 per language: all splits in two for a few languages, else the random
    columns (of a fixed seed) whose closest two rows differ most."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= EXHAUSTIVE_LANGUAGES:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(languages)])
    bits = BITS_PER_DOUBLING * int(np.ceil(np.log2(languages)))
    draw = np.random.default_rng(11)
    best, most = None, -1
    for _ in range(50):
        code = draw.choice([-1, 1], (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        apart = min((code[i] != code[:i]).sum(axis=1).min() for i in range(1, languages))
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    """languages: names in order; code: +1/-1; weights: bucket x bit; trust: language x bit, rows sum to 1.

    With a calibrated bound also likely: bucket x language, log-likelihood of a trigram; least: the mean of it
    that a text of the language has at least.
    """

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    likely: np.ndarray | None = None
    least: np.ndarray | None = None

    def margins(self, texts: Iterable[str]) -> np.ndarray:
        """A row a text, a column a bit."""
        weights = self.weights.astype(np.float64)
        found = [means(t, weights)[0] for t in texts]
        return np.array(found).reshape(len(found), self.code.shape[1])

    def belong(self, texts: Iterable[str]) -> np.ndarray:
        """Whether each text is likely enough in the language it is decoded to."""
        weights, likely = self.weights.astype(np.float64), self.likely.astype(np.float64)
        found = [means(t, weights, likely) for t in texts]
        language = self.decode(np.array([margins for margins, _ in found]).reshape(len(found), self.code.shape[1]))[0]
        likelihood = np.array([likelihood[k] for k, (_, likelihood) in zip(language, found)])
        return likelihood >= self.least[language]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the language, score, ambiguous for each row; the first name wins a tie."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
        loss = [(trust * np.logaddexp(0, -code * margins)).sum(axis=1) for code, trust in zip(self.code, self.trust)]
        likely = np.exp(-np.stack(loss, axis=1) * self.code.shape[1])
        likely /= likely.sum(axis=1, keepdims=True)
        two = np.argsort(-likely, axis=1, kind="stable")[:, :2]
        first, second = np.take_along_axis(likely, two, axis=1).T
        return two[:, 0], first, first - second < CLOSE


def in_fold(row_id: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit(""))) % folds == fold


def fit(labelled: DataFrame, bounded: bool = False) -> Model:
    """Fit on every row of (text, lang); rows with a null text or language are left out. The rows are read twice,
    counted and then tried. What comes to the driver is one count per language and bucket, and one mean per
    language and bit; with ``bounded`` also one quantile per language, from which the least likelihood follows."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                sums[lang] = sums.get(lang, 0) + bucket_counts(texts)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    rows = (
        usable.mapInPandas(counted, "lang string, bucket long, n double")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    )
    languages = sorted({r.lang for r in rows})
    code = codewords(len(languages))
    bits = code.shape[1]
    place = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    for r in rows:
        counts[place[r.lang], r.bucket] += r.n
    share = (counts + 0.05) / (counts + 0.05).sum(axis=1, keepdims=True)
    weights = np.zeros((1 << BUCKET_BITS, bits), np.float32)
    if bits:
        ones = (code > 0).astype(float)
        log = lambda on: np.log((on / on.sum(axis=0)).T @ share).T  # noqa: E731  a language counts once, however many rows it has
        weights = (log(ones) - log(1 - ones)).astype(np.float32, order="C")  # a row a bucket, in one piece
    model = Model(languages, code, weights, np.zeros(code.shape), np.log(share).T.astype(np.float32, order="C") if bounded else None)
    if not languages or not (bits or bounded):
        return model
    tables = [t.astype(np.float64) for t in ([model.weights, model.likely] if bounded else [model.weights])]

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Of a batch one row per language and bit, and of each text with a letter its likelihood in its language.
        for frame in frames:
            found = [means(t, *tables) for t in frame["text"]]
            lang = frame["lang"].map(place).to_numpy(np.int64)
            right = np.array([f[0] for f in found]).reshape(len(frame), bits) * code[lang]
            for k in np.unique(lang):
                mine = right[lang == k]
                yield pd.DataFrame({
                    "lang": languages[k], "bit": np.arange(bits), "hits": (mine > 0).sum(axis=0).astype(float),
                    "size": np.abs(mine).sum(axis=0), "n": len(mine), "own": None,
                })
            if bounded:
                own = np.array([f[1][k] for f, k in zip(found, lang)], float)
                lettered = frame["lettered"].to_numpy(bool)
                yield pd.DataFrame({
                    "lang": frame["lang"][lettered], "bit": None, "hits": None, "size": None, "n": None, "own": own[lettered],
                })

    texts = usable.where(F.length("text") > 0)
    if bounded:
        texts = texts.withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    told = staged(texts.mapInPandas(tried, "lang string, bit long, hits double, size double, n long, own double"), "langid-tried")
    if bounded:
        model.least = least_likelihood(model, told.where(F.col("own").isNotNull()).select("lang", "own"))
    if not bits:
        return model
    trust, size = np.full(code.shape, 0.5), np.ones(bits)
    sums = told.where(F.col("bit").isNotNull()).groupBy("lang", "bit").agg(*(F.sum(c).alias(c) for c in ("hits", "size", "n")))
    sizes: dict[int, list[float]] = {}
    for r in sums.collect():
        trust[place[r.lang], r.bit] = max(r.hits / r.n, 0.01)
        sizes.setdefault(r.bit, []).append(r["size"] / r.n)
    for bit, found in sizes.items():
        size[bit] = max(float(np.mean(found)), 1e-9)
    model.weights = (model.weights / size).astype(np.float32)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def least_likelihood(model: Model, own: DataFrame) -> np.ndarray:
    """The least mean log-likelihood of each language, from (lang, own) of all training rows: what all but a few of
    them reach is an exact quantile, by rank."""
    unrelated = model.likely.mean(axis=0, dtype=np.float64)
    least = unrelated.copy()
    for r in selected_percentiles(own, ["lang"], ["own"], (FEW,), groups=len(model.languages)).collect():
        k = model.languages.index(r.lang)
        least[k] += UNLIKE * max(0.0, r["_q_own"][0] - unrelated[k])
    return least


def predicted(text: Column, model: Model) -> Column:
    """struct(lang_pred, score, ambiguous) of a text column; ``und`` for null and empty texts."""
    names = np.array([*model.languages, "und"], object)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = batch.map(bool).to_numpy(bool)
            place, score, ambiguous = np.full(len(batch), -1), np.zeros(len(batch)), np.zeros(len(batch), bool)
            place[told], score[told], ambiguous[told] = model.decode(model.margins(batch[told]))
            yield pd.DataFrame({"lang_pred": names[place], "score": score, "ambiguous": ambiguous})

    return decoded(text)


def accepted(text: Column, model: Model) -> Column:
    """Whether a text belongs to a language: some letter, and trigrams as likely as the model's bound asks for."""
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))

    @F.pandas_udf("boolean")
    def belongs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            told = batch.map(bool).to_numpy(bool)
            told[told] = model.belong(batch[told])
            yield pd.Series(told)

    return F.when(lettered, belongs(F.when(lettered, text))).otherwise(False)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with lang_pred, score (0 to 1) and ambiguous.

    A null text or one without a letter is ``und`` with score 0, and so is every text if the model knows no
    language. Columns of those names are replaced, others stay; repeated rows are judged each.
    """
    found = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    if model.languages:
        found = predicted(F.when(F.col(text).rlike(r"\p{L}"), F.col(text)), model)
    kept = docs.drop("lang_pred", "score", "ambiguous").withColumn("langid_found", found)
    return kept.select(*(c for c in kept.columns if c != "langid_found"), "langid_found.*")
