"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes, a space and the text. A byte offset where tokens of both end is a shared
cut. An interval of tokens is divided at the shared cut nearest to its middle: ends of one tokenizer are probed from the
middle outwards, each by bisecting the ends of the other. Both halves go on alike; an interval without
a shared cut is a leaf group. The texts of a batch are divided together, all open intervals a round at once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.neardup import BROADCAST_ROWS
from runlens.llm.staging import broadcast_if_small, staged
from runlens.llm.tokens import tokenizer_path
from runlens.llm.words import REMEMBERED, Bytewise, WordIds, grouped, words_of

#: Texts of about so many characters are aligned at once.
GROUP_CHARS = 1 << 19
#: A link is the id of A times this plus the id of B.
PAIR = 1 << 32

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, links array<long>"


class Pieces:
    """A sentence piece model (.model) that puts a space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        if any("▁" in name.lstrip("▁") for name in names):
            raise ValueError("pieces that reach into the next word cannot be encoded word by word")
        space = [model.piece_to_id("▁")]
        # The model itself adds the first space; of a lone space it would make nothing.
        self.encode = lambda pieces: [
            ids if ids else space for ids in model.encode([p[1:] for p in pieces], num_threads=1)
        ]
        self.bytes = [
            bytes([int(name[3:5], 16)]) if model.is_byte(i)
            else b"" if model.is_control(i) or model.is_unknown(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]


class Aligner:
    """Tokens, shared cuts and groups of texts under tokenizers a and b."""

    def __init__(self, a: str, b: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.sides = [Bytewise(tokenizer_path(a)), Pieces(tokenizer_path(b))]
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
        # Each id as text, followed by the mark for a next token or for a group's end.
        self.inner = [np.array([f"{i}," for i in range(len(n))], object) for n in self.lengths]
        self.last = [np.array([f"{i}{mark}" for i in range(len(n))], object) for n, mark in zip(self.lengths, "|;")]
        self.words = WordIds(self.sides, remembered)

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each side, the ids of a space and each text, one after another, and how many a text has. Ids of
        words whose tokens do not spell them are left out, so their texts come out too short."""
        words: list[str] = []
        sizes = []
        for text in texts:
            before = len(words)
            if text:
                words += words_of(" " + text)
            sizes.append(len(words) - before)
        owner = np.repeat(np.arange(len(texts)), sizes)
        found = self.words.look_up(words)
        return [ids.astype(np.int64) for ids, _ in found], [np.bincount(owner, n, len(texts)).astype(np.int64) for _, n in found]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """(tokens of a, tokens of b, groups, groups as text, links) of each text; nothing where tokens do not
        spell a space and the text."""
        ids, counts = self.encoded(texts)
        sizes = np.array([len(t.encode()) + 1 if t else 0 for t in texts], np.int64)
        spelt = np.ones(len(texts), bool)
        for flat, n, lengths in zip(ids, counts, self.lengths):
            owner = np.repeat(np.arange(len(texts)), n)
            spelt &= np.bincount(owner, lengths[flat], len(texts)).astype(np.int64) == sizes
        ends = []
        for k in range(2):
            ids[k] = ids[k][np.repeat(spelt, counts[k])]
            counts[k] = np.where(spelt, counts[k], 0)
            ends.append(np.cumsum(self.lengths[k][ids[k]]))
        cut_a, cut_b = shared_cuts(ends[0], ends[1], np.cumsum(counts[0]))
        at_a, at_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        links = ids[0][at_a] * PAIR + ids[1][at_b]
        # A token of a comes after the earlier ones and all of b in groups before its own; of b, also a's of its own.
        before_b = np.concatenate([[0], at_b + 1])[np.cumsum(cut_a) - cut_a]
        through_a = (at_a + 1)[np.cumsum(cut_b) - cut_b] if len(at_a) else np.zeros(0, np.int64)
        spelled = np.empty(len(ids[0]) + len(ids[1]), object)
        spelled[np.arange(len(ids[0])) + before_b] = np.where(cut_a, self.last[0][ids[0]], self.inner[0][ids[0]])
        spelled[np.arange(len(ids[1])) + through_a] = np.where(cut_b, self.last[1][ids[1]], self.inner[1][ids[1]])
        parts = spelled.tolist()
        group_of_end = np.concatenate([[0], np.cumsum(cut_a)])
        at, token, group = 0, 0, 0
        for n_a, n_b in zip(counts[0].tolist(), counts[1].tolist()):
            token += n_a
            to = int(group_of_end[token])
            yield n_a, n_b, to - group, "".join(parts[at : at + n_a + n_b])[:-1], links[group:to]
            at, group = at + n_a + n_b, to


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a and of b end at a shared cut; both end arrays rise.

    ``bounds``: numbers of a's tokens up to the end of each text, where both tokenizers end. Every round
    probes two ends of each open interval [low, high) of a's tokens, ``left`` and ``right`` of what was
    probed before. A hit splits the interval there; without one the probes move on outwards.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    starts = np.concatenate([[0], bounds[:-1]]).astype(np.int64)
    filled = bounds > starts
    final = bounds[filled] - 1
    cut_a[final] = True
    cut_b[np.searchsorted(ends_b, ends_a[final])] = True

    def probed(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(at), bool)
        asked = at[inside]
        found = np.searchsorted(ends_b, ends_a[asked])
        same = ends_b[found] == ends_a[asked]
        cut_a[asked[same]] = True
        cut_b[found[same]] = True
        hit[inside] = same
        return hit

    def opened(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        kept = high > low
        low, high = low[kept], high[kept]
        middle = (low + high - 1) // 2
        return low, high, middle, middle + 1

    low, high, left, right = opened(starts[filled], final)
    while len(low):
        hit = probed(left, left >= low) | probed(right, right < high)
        waiting = ~hit & ((left > low) | (right < high - 1))
        split = opened(np.concatenate([low[hit], right[hit] + 1]), np.concatenate([left[hit], high[hit]]))
        outwards = low[waiting], high[waiting], left[waiting] - 1, right[waiting] + 1
        low, high, left, right = (np.concatenate(x) for x in zip(split, outwards))
    return cut_a, cut_b


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The aligner of this worker process; loaded once."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def align_documents(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups, links) of each row of ``docs`` (doc_id, text).

    ``groups`` lists the ids of the groups, ``a1,a2|b1;a3|b2,b3``; ``links`` has an entry for each pair of
    tokens whose byte ranges end together, the id of a times PAIR plus the id of b. ``row`` tells rows of one
    id apart. A text that is null, empty or not spelt by both tokenizers has no tokens. Texts are aligned whole, strings of
    special tokens in them are plain text. Other columns are not read; no rows give no rows.
    """

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = aligner(a, b)
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc_id")
            at = 0
            for group in grouped([t or "" for t in batch.column("text").to_pylist()], GROUP_CHARS):
                found = list(use.align(group))
                n_a, n_b, n_groups, texts, links = zip(*found)
                offsets = pa.array(np.cumsum([0, *n_groups]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(at, len(group)), ids.slice(at, len(group)),
                        *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)),
                        pa.array(texts, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(links))),
                    ],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "links"],
                )
                at += len(group)

    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return told.mapInArrow(aligned, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(link, count, best): how many links of the corpus hold each pair of ids, and whether no other pair of
    its b id has more."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count"))
    of_b = Window.partitionBy(F.pmod("link", F.lit(PAIR)))
    return staged(counts.withColumn("best", F.col("count") == F.max("count").over(of_b)), "pair-counts")


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """The rows of a written table of ``align_documents`` with ``n_links``, ``n_best`` (links of a best pair) and
    ``count_sum`` (the counts of all links) instead of row and links."""
    pairs = broadcast_if_small(pair_counts(aligned), BROADCAST_ROWS)
    summed = (
        aligned.select("row", F.explode("links").alias("link")).join(pairs, "link").groupBy("row")
        .agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    )
    counted = aligned.drop("links").join(summed, "row", "left").drop("row")
    return counted.fillna(0, ["n_links", "n_best", "count_sum"])


def alignment_digests(docs: DataFrame) -> DataFrame:
    """One row a document: counts of tokens, groups and links, and a digest of the groups ('' without tokens)."""
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = staged(align_documents(docs).withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return with_link_counts(aligned).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
