"""Near duplicates by MinHash bands with sequential Bayesian verification.

1. Every text becomes a set of shingles, a digest of the set and band keys. Texts of equal sets form a class,
   named by its smallest id; only classes are compared.
2. Classes that share a band are candidates. The candidates' connected groups are cut into blocks of
   bounded size, which are compared within and in pairs, so no pair leaves a task unless it is a link.
   Between blocks signatures are compared first and only the texts of what they leave are sent.
3. In a block, candidate pairs compare signatures batch by batch. A pair goes as soon as the posterior
   probability of similarity >= THRESHOLD falls below MISS. Survivors are verified on the full sets, most
   similar first, unless other links join them already: what is emitted spans the same components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import shingles
from runlens.llm.components import components
from runlens.llm.staging import broadcast_if_small, staged

#: Links need a similarity of so many hundredths.
PERCENT = 75
#: A pair is dropped unverified when the probability of a link is below this.
MISS = 1e-5
#: Signature places compared at once.
BATCH = 40
#: A block holds about so many classes and shingles at most (one longer text is a block of its own).
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_500_000
#: Tables of two or three numbers a row are broadcast up to so many rows (under 20 MB).
BROADCAST_ROWS = 500_000
#: Pairs whose signatures are compared at once.
PAIRS = 100_000


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For each number of compared places, the fewest matches that leave a link probable enough.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m). Places keep one
    byte of a hash, so t is raised by the chance of equal bytes.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    least = {}
    for n in range(BATCH, shingles.HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        least[n] = m
    return least


class Forest:
    """Which members are joined already."""

    def __init__(self, labels: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(label, k) for k, label in enumerate(labels)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k


def candidates(labels: np.ndarray, sides: np.ndarray, bands: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first, second, matches) of the pairs that share a band, are not joined already and may be links by what
    their signatures say.

    sides: 0 and 1 in a pair of blocks, where only pairs across are compared; all 0 within a block.
    """
    n = len(labels)
    share = np.zeros((n, n), bool)
    for band in bands.T:
        order = np.argsort(band, kind="stable")
        cuts = np.flatnonzero(np.diff(band[order])) + 1
        for same in np.split(order, cuts):
            if len(same) > 1:
                share[np.ix_(same, same)] = True
    if sides.any():
        share &= sides[:, None] != sides[None, :]
    share &= labels[:, None] != labels[None, :]
    first, second = np.nonzero(np.triu(share, 1))
    least = least_matches()
    kept = []
    for at in range(0, len(first), PAIRS):
        a, b = first[at : at + PAIRS], second[at : at + PAIRS]
        matches = np.zeros(len(a), np.int64)
        for start in range(0, shingles.HASHES, BATCH):
            matches += (places[a, start : start + BATCH] == places[b, start : start + BATCH]).sum(axis=1)
            on = matches >= least[start + BATCH]
            a, b, matches = a[on], b[on], matches[on]
        kept.append((a, b, matches))
    if not kept:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(map(np.concatenate, zip(*kept)))


def block_links(frame: pd.DataFrame, texts: Callable[[int], str]) -> list[tuple[int, int]]:
    """Links that, with the labels given, join the same members as all links would."""
    labels, sizes, ids = frame["label"].tolist(), frame["n"].tolist(), frame["id"].tolist()
    a, b, matches = candidates(np.array(labels), frame["side"].to_numpy(), *signed(frame))
    forest, links = Forest(labels), []
    as_sets: dict[int, frozenset] = {}
    for k in np.argsort(-matches, kind="stable"):
        i, j = int(a[k]), int(b[k])
        r, s = forest.root(i), forest.root(j)
        small, large = sorted((sizes[i], sizes[j]))
        if r == s or 100 * small < PERCENT * large:
            continue
        for x in (i, j):
            if x not in as_sets:
                as_sets[x] = frozenset(shingles.shingle_set(texts(x)).tolist())
        both = len(as_sets[i] & as_sets[j])
        if 100 * both >= PERCENT * (small + large - both):
            forest.up[max(r, s)] = min(r, s)
            links.append((ids[i], ids[j]))
    return links


def signed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and signature bytes as matrices."""
    bands = np.array(frame["bands"].tolist(), np.int64).reshape(-1, shingles.BANDS)
    places = np.frombuffer(b"".join(frame["places"]), np.uint8).reshape(-1, shingles.HASHES)
    return bands, places


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, places): sizes, set digests, band keys and low bytes of the
    signatures of all texts."""

    @F.pandas_udf("n long, d1 long, d2 long, bands array<long>, places binary")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch:
                found = shingles.shingle_set(text)
                if len(found):
                    signature = shingles.signature(found)
                    places = (signature & np.uint32(255)).astype(np.uint8).tobytes()
                    rows.append((len(found), *shingles.digest(found), shingles.band_keys(signature), places))
                else:
                    rows.append((0, None, None, None, None))
            frame = pd.DataFrame(rows, columns=["n", "d1", "d2", "bands", "places"])
            yield frame.astype({"d1": "Int64", "d2": "Int64"})

    found = docs.select("doc_id", told(F.col("text")).alias("t"))
    return found.select("doc_id", F.col("t.n").alias("n_shingles"), "t.d1", "t.d2", "t.bands", "t.places")


def sided(frame: pd.DataFrame) -> pd.DataFrame:
    """One row a class in a fixed order, with ``side`` told by the block."""
    frame = frame.drop_duplicates(["id", "d1", "d2"]).sort_values(["id", "d1", "d2"], kind="stable").reset_index(drop=True)
    return frame.assign(side=(frame["block"] != frame["block"].min()).astype(int))


def of_class(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows joined by id whose text is that of their class; only an id with several texts or classes needs a look."""
    frame = frame.drop_duplicates(["id", "d1", "d2", "text"])
    several = frame.groupby("id")["id"].transform("size") > 1
    same = [shingles.digest(shingles.shingle_set(t)) == (d1, d2) for t, d1, d2 in frame.loc[several, ["text", "d1", "d2"]].itertuples(index=False)]
    keep = np.ones(len(frame), bool)
    keep[several.to_numpy()] = same
    return frame[keep]


def verified_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(u, v) from ``members`` (id, d1, d2, n, bands, places, label, part, block, lo, hi), compared within each
    (part, lo, hi); texts are joined by id."""

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        frame = sided(of_class(frame))
        texts = frame["text"].tolist()
        return pd.DataFrame(block_links(frame, texts.__getitem__), columns=["u", "v"], dtype="int64")

    texts = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull())
    # The count is given because adaptive execution would merge partitions by their bytes, not by their work.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.join(members, "id").repartition(tasks, "part", "lo", "hi")
    return rows.groupBy("part", "lo", "hi").applyInPandas(compared, "u long, v long")


def in_pairs(members: DataFrame) -> DataFrame:
    """Members of groups of several blocks, once for each other block, as one side of a pair of blocks."""
    other = F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x != block)"))
    return members.where("blocks > 1").withColumn("other", other).select(
        *(c for c in members.columns if c != "blocks"),
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    )


def shortlisted(paired: DataFrame, best: bool) -> DataFrame:
    """(part, lo, hi, id) of members of pairs of blocks that signatures leave as candidates; with ``best`` only
    the most similar pair of each two labels."""

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        frame = sided(frame)
        labels = frame["label"].to_numpy()
        a, b, matches = candidates(labels, frame["side"].to_numpy(), *signed(frame))
        if best and len(a):
            low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
            order = np.lexsort((-matches, high, low))
            new = np.append(True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0))
            a, b = a[order[new]], b[order[new]]
        ids = np.unique(frame["id"].to_numpy()[np.concatenate([a, b])])
        first = frame.iloc[0]
        return pd.DataFrame({"part": first["part"], "lo": first["lo"], "hi": first["hi"], "id": ids}).astype({"id": "int64"})

    return paired.groupBy("part", "lo", "hi").applyInPandas(chosen, "part long, lo int, hi int, id long")


def relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with the labels that links have given them so far, their own ids otherwise."""
    known = members.drop("label").join(labels, "id", "left")
    return known.withColumn("label", F.coalesce("label", "id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Texts are linked at a similarity of PERCENT / 100 or more of their sets of five-word shingles;
    component_id is the smallest id that links reach, kept marks it. Texts without words are linked with
    nothing. Rows of one id count as one document, each with its own n_shingles. A row without an id stands
    alone: its component is null, it is kept. No rows give no rows.
    """
    rows = staged(shingled(docs), "shingled")
    classes = (
        rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
        .groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    )
    classes = staged(classes, "classes")
    ids = rows.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"])
    of_rep = staged(
        rows.join(classes, ["d1", "d2"]).where(F.col("doc_id") == F.col("rep"))
        .select(F.col("rep").alias("id"), "d1", "d2", F.col("n_shingles").alias("n"), "bands", "places"),
        "representatives",
    )
    banded = of_rep.select("id", F.explode("bands").alias("band"))
    shared = staged(
        banded.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead != last").drop("last"),
        "shared",
    )
    led = banded.join(broadcast_if_small(shared, BROADCAST_ROWS), "band").where("id != lead")
    # A class hangs on its smallest lead, and so do its other leads: no more links than classes and leads.
    hooks = led.groupBy("id").agg(F.collect_set("lead").alias("leads"))
    hooked = hooks.select(F.explode(F.array_append("leads", F.col("id"))).alias("u"), F.array_min("leads").alias("v"))
    parts = components(hooked.where("u != v").distinct())
    placed = staged(parts.withColumnRenamed("label", "part").join(of_rep, "id"), "parts")
    blocks = placed.groupBy("part").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    members = staged(
        placed.join(blocks, "part").withColumns({"block": F.pmod(F.xxhash64("id"), "blocks").cast("int"), "label": F.col("id")}),
        "blocks",
    )
    one_id = ids.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("hi")).where("u != hi")
    within = members.drop("blocks").withColumns({"lo": F.col("block"), "hi": F.col("block")})
    links = staged(
        verified_links(docs, within).unionByName(
            ids.join(one_id.select("doc_id", "u"), "doc_id").select("u", F.col("rep").alias("v"))
        ),
        "links",
    )
    labels = components(links)
    if members.where("blocks > 1").take(1):
        # Between blocks only signatures travel, and the texts of what they leave. The most similar pair of each two
        # labels joins most of a group; what is still apart then is compared in full.
        for best in (True, False):
            paired = in_pairs(relabelled(members, labels))
            wanted = staged(shortlisted(paired, best), "shortlist")
            if wanted.isEmpty():
                break
            more = staged(verified_links(docs, paired.join(wanted, ["part", "lo", "hi", "id"])), "more-links")
            links = links.unionByName(more)
            labels = components(links)
    named = rows.drop("bands", "places").join(classes, ["d1", "d2"], "left").join(labels, F.col("rep") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the one of the smallest id, one row if it is
    repeated. Rows without an id stay."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_doc_id")).distinct()
    named = docs.join(kept, docs["doc_id"] == F.col("kept_doc_id"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
