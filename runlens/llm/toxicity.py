"""Toxic passages as maximum-scoring segments of token log-odds.

Word weights are log-odds between toxic and clean training rows under a Dirichlet prior, shrunken by their own
uncertainty towards none; a word without weight pulls a running score down a little. A linear scan finds
every maximal scoring segment of a text. Extreme-value statistics of clean texts tell how high chance alone
gets in a text of that length; what segments have beyond that is the evidence, which a logistic curve turns
into a probability. How strongly weights are shrunken is chosen by cross-validation inside the training rows,
and the extreme-value law and the curve are fitted on rows that did not take part in the weights they get.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.staging import staged

#: Weights and calibration are fitted on about so many labelled rows, half of them of either label, chosen by a
#: hash of their ids; all if fewer.
SAMPLE_ROWS = 24_000
#: Parts of the training rows for cross-validation; rows that are near copies lie in one part.
FOLDS = 5
#: Choices of (standard errors taken off a log-odds ratio, rows the prior counts for).
CHOICES = ((1.5, 3.0), (2.0, 1.0), (3.0, 1.0), (4.5, 1.0))
#: Groups of near copies among toxic rows that a word needs: what one group says cannot be told from chance.
LEAST_GROUPS = 2
#: A longer word that weighs less than its first letters, which its inflections share, weighs as they do.
STEM = 4
#: What a word without weight takes off the running score, at least, and how far a clean text's score falls a
#: word at least.
DRAIN, LEAST_FALL = 0.1, 0.05
#: Weights in clean text are counted in steps of this.
STEP = 0.02
#: The extreme-value law is not steeper than this.
STEEPEST = 16.0
#: Words of a text that rows are compared by: rows of one smallest run of so many words count once.
RUN = 3
#: Width of the evidence bins the curve is fitted on; evidence is cut off at the last.
BIN, LAST_BIN = 0.5, 200

# Letters and digits, with signs inside that stand for letters.
_WORD = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def stem(word: str) -> str:
    """A mark for the first letters of a longer word; the word itself otherwise."""
    return f"{word[:STEM]}*" if len(word) > STEM else word


def segments(places: list[int], weights: list[float], drain: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text whose word at each of ``places`` has a
    positive weight and whose other words have -drain. Linear in the number of places.

    A stack holds candidate segments with the running score before and after each; a new one absorbs
    those down to the nearest with a lower start, as long as that raises its score.
    """
    found: list[tuple[int, int, float, float]] = []
    total, after = 0.0, -1
    for place, weight in zip(places, weights):
        total -= drain * (place - after - 1)
        start, low = place, total
        total += weight
        after = place
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= total:
                break
            start, low = found[k][0], found[k][2]
            del found[k:]
        found.append((start, place, low, total))
    return [(a, b, high - low) for a, b, low, high in found]


@dataclass
class Model:
    """weights by word and by stem, drain; lam and k of the extreme-value law; offset and slope of the curve."""

    weights: dict[str, float]
    drain: float
    lam: float
    k: float
    offset: float
    slope: float

    def hits(self, tokens: list[str]) -> tuple[list[int], list[float]]:
        """Places and weights of the words that weigh."""
        get = self.weights.get
        found = [(i, w) for i, t in enumerate(tokens) if (w := get(t) or get(stem(t)))]
        return [i for i, _ in found], [w for _, w in found]

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        return segments(*self.hits(tokens), self.drain)

    def evidence(self, tokens: list[str]) -> float:
        """What the segments have beyond chance, in natural log units."""
        found = self.passages(tokens)
        if not found:
            return 0.0
        chance = np.log(self.k * len(tokens))
        return float(sum(max(0.0, self.lam * score - chance) for _, _, score in found))

    def probability(self, evidence: float) -> float:
        x = self.offset + self.slope * min(evidence, BIN * LAST_BIN)
        return float(1 / (1 + np.exp(-x)))


def word_weights(
    names: list[str], toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float, errors: float, prior: float
) -> dict[str, float]:
    """Positive weights by word or stem: the log-odds ratio under a prior of ``prior`` rows a word, which are split as
    all counted words are, less ``errors`` standard errors. A word whose stem weighs more gets its stem's weight."""
    share = all_toxic / (all_toxic + all_clean)
    a, b = toxic + prior * share, clean + prior * (1 - share)
    ratio = np.log(a / all_toxic) - np.log(b / all_clean)
    weight = ratio - errors * np.sqrt(1 / a + 1 / b)
    own = {n: float(w) for n, w in zip(names, weight) if w > 0}
    return {n: max(w, own.get(stem(n), 0.0)) for n, w in own.items()}


def chance_law(steps: dict[int, int], words_seen: int) -> tuple[float, float]:
    """(drain, lam) for clean text in which weight ``STEP * s`` was met ``steps[s]`` times among all its words: the
    drain lets the running score fall on average, lam > 0 solves E exp(lam * step of the score) = 1."""
    weights = STEP * np.array(list(steps), float)
    rates = np.array(list(steps.values()), float) / max(words_seen, 1)
    plain = max(0.0, 1 - rates.sum())
    # Weight w adds w, all other words take off the drain: their mean is to be -LEAST_FALL or less.
    drain = max(DRAIN, (float((rates * weights).sum()) + LEAST_FALL) / max(plain, 1e-9))
    over = lambda lam: (rates * np.exp(lam * weights)).sum() + plain * np.exp(-lam * drain) - 1
    low, high = 0.0, 1e-3
    while over(high) <= 0 and high < STEEPEST:
        low, high = high, min(2 * high, STEEPEST)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if over(middle) <= 0 else (low, middle)
    return drain, high


def logistic_curve(evidence: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> tuple[float, float, float]:
    """Offset and slope (not negative) by Newton steps with a weak ridge, and the loss a row; counts by evidence."""
    beta = np.zeros(2)
    x = np.stack([np.ones_like(evidence), evidence], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (toxic - rows * p) - 1e-3 * beta
        hessian = (x * (rows * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    if beta[1] <= 0:
        share = (toxic.sum() + 1e-3) / (rows.sum() + 2e-3)
        beta = np.array([np.log(share / (1 - share)), 0.0])
    z = x @ beta
    loss = (rows * np.logaddexp(0, z) - toxic * z).sum() / max(rows.sum(), 1e-9)
    return float(beta[0]), float(beta[1]), float(loss)


def sampled_by_label(usable: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(sample, share of each label's rows that is in it): up to about most / 2 rows of a label, or what the
    other label leaves."""
    found = {int(r.toxic): r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = min(found.values(), default=0)
    shares = {label: min(1.0, max(most / 2, most - few) / n) for label, n in found.items()}
    if len(shares) < 2:
        return usable, shares
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) / 1_000_003
    bound = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    return usable.where(drawn < bound), shares


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on (doc_id, text, toxic); rows with a null text or label are left out.

    Rows that share their smallest hashed run of words are near copies mostly and count once a label, so a large
    group of copies cannot make its words look toxic. The driver gets the words that may weigh, and counts
    by weight and by evidence. Without rows of both labels, or if nothing that weighs helps to predict rows
    outside of its own fit, every text gets the share of toxic rows.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "text", "toxic")
    drawn, shares = sampled_by_label(usable, sample_rows)
    sample = staged(drawn, "toxicity-sample")

    def group_of(found: list[str]) -> int:
        plain = [w for w in found if w.isalpha()]  # copies often differ in a number
        runs = (" ".join(plain[i : i + RUN]) for i in range(max(1, len(plain) - RUN + 1)))
        return min(map(xxhash.xxh3_64_intdigest, runs)) >> 1

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                found = words(text)
                once = sorted({*found, *map(stem, found)})
                yield pd.DataFrame({"grp": np.full(len(once), group_of(found), np.int64), "toxic": int(toxic), "word": once})

    rows = sample.mapInPandas(told, "grp long, toxic int, word string").distinct()
    mine = lambda label, fold: F.count_if((F.col("toxic") == label) & (F.col("grp") % FOLDS == fold)).cast("double")
    in_folds = [mine(label, fold).alias(f"{'ba'[label]}{fold}") for label in (0, 1) for fold in range(FOLDS)]
    counts = staged(rows.groupBy("word").agg(*in_folds), "toxicity-words")
    names = [f"{side}{fold}" for side in "ab" for fold in range(FOLDS)]
    totals = np.array(counts.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in names]).first(), float).reshape(2, FOLDS)
    weigh = {label: 1 / share for label, share in shares.items()}
    sizes = {int(r.toxic): r.n * weigh[int(r.toxic)] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (sizes.get(1, 0) + 1e-3) / (sum(sizes.values()) + 2e-3) if sizes else 0.0
    base = float(np.log(share / (1 - share))) if sizes else -5.0
    nothing = Model({}, DRAIN, 1.0, 1.0, base, 0.0)
    if not totals.sum(axis=1).all():
        return nothing

    toxic_groups = sum((F.col(f"a{fold}") for fold in range(FOLDS)), F.lit(0.0))
    clean_groups = sum((F.col(f"b{fold}") for fold in range(FOLDS)), F.lit(0.0))
    all_toxic, all_clean = totals.sum(axis=1)
    often = counts.where((toxic_groups >= LEAST_GROUPS) & (toxic_groups / float(all_toxic) > clean_groups / float(all_clean)))
    found = [tuple(r) for r in often.select("word", *names).toLocalIterator()]
    vocabulary = [r[0] for r in found]
    table = np.array([r[1:] for r in found], float).reshape(len(found), 2, FOLDS)
    # Weights for a row come from all parts but its own; the last are those of all parts.
    weights: list[list[dict[str, float]]] = []
    for errors, prior in CHOICES:
        without = [[k for k in range(FOLDS) if k != fold] for fold in range(FOLDS)] + [list(range(FOLDS))]
        weights.append([
            word_weights(vocabulary, table[:, 0, kept].sum(axis=1), table[:, 1, kept].sum(axis=1), *np.maximum(totals[:, kept].sum(axis=1), 1), errors, prior)
            for kept in without
        ])
    models = [[Model(w, DRAIN, 1.0, 1.0, 0.0, 1.0) for w in folds] for folds in weights]

    def in_clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], int] = {}
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                if not toxic and (tokens := words(text)):
                    fold = group_of(tokens) % FOLDS
                    for c, folds in enumerate(models):
                        for w in folds[fold].hits(tokens)[1]:
                            at = (c, int(np.ceil(w / STEP)))
                            seen[at] = seen.get(at, 0) + 1
                        seen[c, 0] = seen.get((c, 0), 0) + len(tokens)
        yield pd.DataFrame([(c, s, n) for (c, s), n in seen.items()], columns=["c", "s", "n"], dtype="int64")

    met: list[dict[int, int]] = [{} for _ in CHOICES]
    for r in sample.mapInPandas(in_clean, "c long, s long, n long").groupBy("c", "s").agg(F.sum("n").alias("n")).collect():
        met[r.c][r.s] = r.n
    for steps, folds in zip(met, models):
        words_seen = steps.pop(0, 0)
        drain, lam = chance_law(steps, words_seen)
        for model in folds:
            model.drain, model.lam = drain, lam

    def extremes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, e = np.zeros(len(CHOICES)), np.zeros(len(CHOICES))
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"]):
                if not toxic and (tokens := words(text)):
                    fold = group_of(tokens) % FOLDS
                    for c, folds in enumerate(models):
                        best = max((s for _, _, s in folds[fold].passages(tokens)), default=0.0)
                        n[c], e[c] = n[c] + 1, e[c] + len(tokens) * np.exp(-folds[fold].lam * best)
        yield pd.DataFrame({"c": np.arange(len(CHOICES)), "n": n, "e": e})

    for r in sample.mapInPandas(extremes, "c long, n double, e double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).collect():
        for model in models[r.c]:
            model.k = r.n / r.e if r.e else 1.0

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = []
            for text, toxic in zip(frame["text"], frame["toxic"]):
                tokens = words(text)
                fold = group_of(tokens) % FOLDS
                for c, folds in enumerate(models):
                    seen.append((c, min(int(folds[fold].evidence(tokens) / BIN), LAST_BIN), int(toxic)))
            yield pd.DataFrame(seen, columns=["c", "bin", "toxic"])

    bins = sample.mapInPandas(binned, "c long, bin long, toxic long").groupBy("c", "bin", "toxic").agg(F.count("*").alias("n")).collect()
    best, least = nothing, np.inf
    for c, folds in enumerate(models):
        mine_bins = [r for r in bins if r.c == c]
        rows_of = np.array([r.n * weigh[r.toxic] for r in mine_bins], float)
        curve = logistic_curve(np.array([r.bin * BIN for r in mine_bins], float), rows_of * [r.toxic for r in mine_bins], rows_of)
        if curve[1] and curve[2] < least:
            least, best = curve[2], folds[-1]
            best.offset, best.slope = curve[:2]
    return best


def score(text: Column, model: Model) -> Column:
    """Probability (0 to 1) that a text is toxic; a null or empty text has no evidence."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.probability(model.evidence(words(t))) for t in batch], dtype="float64")

    return scored(text)


def toxic_passages(text: Column, model: Model) -> Column:
    """array(first word, last word, score) of the significant segments of a text, in order."""

    @F.pandas_udf("array<struct<first: long, last: long, score: double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                tokens = words(text)
                chance = np.log(model.k * max(len(tokens), 1))
                kept = [(a, b, s) for a, b, s in model.passages(tokens) if model.lam * s > chance]
                out.append([{"first": a, "last": b, "score": s} for a, b, s in kept])
            yield pd.Series(out)

    return found(text)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """Every row with ``score`` and ``predicted`` (1 from ``least`` on). Columns of those names are replaced,
    others stay; repeated rows are scored each; texts are scored whole."""
    return docs.withColumn("score", score(F.col(text), model)).withColumn("predicted", (F.col("score") >= least).cast("int"))
