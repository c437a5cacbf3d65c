"""Packing along a space-filling curve: similar documents share training sequences.

A document becomes a vector of hashed byte trigrams, projected to a few dimensions by a fixed random
matrix. The Hilbert key of that point orders the corpus; one range shuffle brings neighbours together, and
each range is cut into full sequences as it streams by. Documents are encoded after the shuffle, once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.tokens import encoder, splits_at_spaces, tokenizer_path
from runlens.llm.words import Bytewise, WordIds, grouped, start_and_rest, words_of

BUCKETS = 256
DIMENSIONS = 4
BITS = 15
#: Bytes hashed at once; bounds memory for long texts and stays in the processor's cache.
CHUNK = 1 << 14
#: How strongly a projection is stretched before it is cut to BITS bits.
STRETCH = 3.0
#: Sequence ids count up from the partition's number times this.
SEQUENCES_PER_PARTITION = 1 << 40

#: Ranges are bounded by keys of about so many rows, chosen by a hash; only the balance of tasks depends on it.
SAMPLE_ROWS = 20_000
#: Bytes of text a range holds at most on average, and below which more ranges would not help.
RANGE_BYTES, LEAST_RANGE_BYTES = 64 << 20, 1 << 20
#: Words a worker remembers; only speed and memory depend on it.
REMEMBERED = 1_000_000
#: Characters of text whose ids are gathered at once.
GROUP_CHARS = 1 << 20

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection(dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, dimensions))


def document_vector(raw: np.ndarray) -> np.ndarray:
    """Unit vector of square-rooted hashed trigram counts of UTF-8 bytes; zeros without a trigram."""
    counts = np.zeros(BUCKETS)
    for at in range(0, len(raw) - 2, CHUNK):
        part = raw[at : at + CHUNK + 2].astype(np.uint32)
        mixed = part[:-2] * np.uint32(2654435761) + part[1:-1] * np.uint32(2246822519) + part[2:] * np.uint32(3266489917)
        counts += np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of whole points in [0, 2**bits), one row each.

    The usual transformation of coordinates to the transposed index: undo the excess rotations from the
    highest bit down, Gray-encode, then interleave the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(n):
            high = (x[i] & step) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn ^= np.where((x[n - 1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_key(text: Column) -> Column:
    """Hilbert key of each text; null counts as empty."""

    @F.arrow_udf("long")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        onto = projection()
        for batch in batches:
            large = batch.cast(pa.large_string())
            _, offsets, data = large.buffers()
            raw = np.frombuffer(data or b"", np.uint8)
            ends = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1].tolist()
            vectors = np.array([document_vector(raw[i:j]) for i, j in zip(ends, ends[1:])]).reshape(-1, BUCKETS)
            squashed = (np.tanh(vectors @ onto * STRETCH) + 1) / 2
            cells = np.minimum(squashed * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            yield pa.array(hilbert_key(cells))

    return keys(text)


class Packer:
    """Fills sequences one after another; ids wait only for the sequence that is open."""

    def __init__(self, size: int, first: int) -> None:
        self.size, self.sequence, self.filled = size, first, 0
        self.open: list[tuple[int, int, int, memoryview]] = []
        self.done: list[tuple] = []

    def add(self, doc: int, ids: bytes) -> None:
        total, start, view = len(ids) // 4, 0, memoryview(ids)
        while start < total:
            take = min(self.size - self.filled, total - start)
            self.open.append((doc, total, start, view[4 * start : 4 * (start + take)]))
            start += take
            self.filled += take
            if self.filled == self.size:
                self.close([self.size])

    def close(self, lengths: list[int]) -> None:
        """Write the open ids as sequences of these lengths."""
        waiting = self.open[::-1]
        for length in lengths:
            offset = 0
            while offset < length:
                doc, total, start, view = waiting.pop()
                take = min(length - offset, len(view) // 4)
                if 4 * take < len(view):
                    waiting.append((doc, total, start + take, view[4 * take :]))
                crc = zlib.crc32(view[: 4 * take])
                self.done.append((doc, start, take, crc, total, self.sequence, offset))
                offset += take
            self.sequence += 1
        self.open, self.filled = [], 0

    def end(self) -> None:
        """The rest of a range goes to sequences of a power of two, which need no padding."""
        self.close([1 << b for b in range(self.filled.bit_length() - 1, -1, -1) if self.filled >> b & 1])


class TextIds:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes: a text's start by itself, the rest as spaces and
    words."""

    def __init__(self, path: str, remembered: int) -> None:
        self.whole = Bytewise(path, special=True)
        self.words = WordIds([self.whole], remembered, spelt=False, letters=True)

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for group in grouped(texts, GROUP_CHARS):
            starts, words, sizes = [], [], []
            for text in group:
                start, rest = start_and_rest(text)
                starts.append(start)
                found = words_of(rest) if rest else []
                words += found
                sizes.append(len(found))
            ((ids, n),) = self.words.look_up(words)
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes])].tolist()
            raw = ids.astype("<u4").tobytes()
            for start, told, i, j in zip(starts, self.whole.encode(starts), ends, ends[1:]):
                yield (np.array(told, "<u4").tobytes() if start else b"") + raw[4 * i : 4 * j]


_text_ids: dict[tuple[str, int], Callable[[list[str]], Iterator[bytes]]] = {}


def text_ids(tokenizer: str, remembered: int) -> Callable[[list[str]], Iterator[bytes]]:
    """What encodes texts in this worker process: by words where the tokenizer allows for it; made once."""
    if (tokenizer, remembered) not in _text_ids:
        path = tokenizer_path(tokenizer)
        by_words = path.endswith(".json") and splits_at_spaces(path)
        _text_ids[tokenizer, remembered] = TextIds(path, remembered) if by_words else encoder(path, remembered).ids
    return _text_ids[tokenizer, remembered]


def pack_documents(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = 1024, end_id: int = 0, remembered: int = REMEMBERED
) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens, neighbours on the curve together.

    A document is the ids of its whole text and ``end_id``; a null or empty text is ``end_id`` alone.
    Repeated rows are packed each. Equal keys are spread by id and text, so a large group of copies is no
    single range. No padding is needed: a sequence has ``size`` tokens or, at the end of a range, a
    power of two. Only doc_id and text are read. No rows, no pieces. ``remembered`` bounds what a worker keeps
    of encoded words; only speed and memory depend on it.
    """
    schema = pa.schema([(name.split()[0], pa.int64()) for name in PIECES.split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = text_ids(tokenizer, remembered)
        packer = Packer(size, TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION)
        last = int(end_id).to_bytes(4, "little")

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.done)) or [[]] * len(schema)
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), use(texts)):
                packer.add(doc, ids + last)
                if len(packer.done) >= 10_000:
                    yield rows()
        packer.end()
        yield rows()

    keyed = docs.select("doc_id", "text", curve_key(F.col("text")).alias("curve"))
    order = ["curve", "doc_id", F.xxhash64("text")]
    return in_ranges(docs, keyed).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(packed, PIECES)


def range_place(curve: Column) -> Column:
    """The leading bits of a key, then 16 hashed bits of id and text, so that equal keys can be cut too."""
    return F.shiftleft(F.shiftright(curve, BITS * DIMENSIONS - 47), 16) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 16))


def in_ranges(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """``keyed`` shuffled into consecutive ranges of the curve with about equal numbers of rows.

    Their bounds are quantiles of a bounded sample, for which keys are computed before the shuffle; every other key is
    computed once. The number of ranges follows from the bytes of all texts.
    """
    told = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    size = told.bytes or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-size // RANGE_BYTES), min(tasks, size // LEAST_RANGE_BYTES))
    share = min(1.0, SAMPLE_ROWS / max(told.n, 1))
    drawn = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1_000_003)) < int(share * 1_000_003)
    sample = docs.where(drawn).select("doc_id", "text", curve_key(F.col("text")).alias("curve"))
    at = [(k + 1) / ranges for k in range(ranges - 1)]
    bounds = sample.agg(F.percentile_approx(range_place(F.col("curve")), at, 10_000)).first()[0] if at else []
    if not bounds:
        return keyed.repartition(1) if ranges == 1 else keyed.repartition(ranges)
    passed = F.aggregate(F.lit(bounds), F.lit(0), lambda k, b: k + (b < F.col("place")).cast("int"))
    return keyed.withColumn("place", range_place(F.col("curve"))).repartitionById(ranges, passed)
