from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from runlens.llm import alignment

TEXTS = [
    "Plain words, and more words.", "", None, " ", "  two  spaces ", "<|endoftext|> and </s>", "▁marked", "line\n\n next\tone",
    "日本語のテキスト 漢字", "é 　 🎉🎊", "x" * 4000, "the the the " * 500, "\x00 nul", "Plain words, and more words.",
]


def brute(texts):
    """Whole-text encodings, ends as sets, counts as a Counter."""
    one = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = {c: b for b, c in bytes_to_letters().items()}
    found = []
    for text in texts:
        spaced = (" " + text).encode() if text else b""
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        as_bytes = [bytes(alphabet[c] for c in one.id_to_token(i)) for i in a]
        pieces = [two.id_to_piece(i) for i in b]
        bs_bytes = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if b"".join(as_bytes) != spaced or b"".join(bs_bytes) != spaced:
            a, b, as_bytes, bs_bytes = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in as_bytes]), np.cumsum([len(x) for x in bs_bytes])
        groups, links, i, j = [], [], 0, 0
        for cut in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
            k, m = int((ends_a <= cut).sum()), int((ends_b <= cut).sum())
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        found.append((len(a), len(b), groups, links))
    counts = Counter(x for *_, links in found for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for n_a, n_b, groups, links in found
    ]


def bytes_to_letters():
    letters = {b: chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + sum(1 for x in letters.values() if ord(x) > 255))
    return letters


def results(frame):
    return {r.doc_id: tuple(r)[1:] for r in alignment.alignment_digests(frame).collect()}


def test_equals_whole_texts_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    assert results(docs) == dict(enumerate(brute(TEXTS)))


def test_given_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    local = rows.select("doc_id", "text").collect()
    assert results(rows) == dict(zip([r.doc_id for r in local], brute([r.text for r in local])))


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert results(docs) == dict(enumerate(brute(TEXTS)))


def test_repeated_and_null_ids_extra_columns_and_no_rows(spark):
    rows = [(1, "some words", 3, "x"), (1, "some words", 3, "x"), (None, "other", 4, "y"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, links string")
    found = alignment.alignment_digests(docs).collect()
    one, _, other, nothing = brute([r[1] for r in rows])
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, [(1, *one), (1, *one), (None, *other), (None, *nothing)]))
    assert alignment.alignment_digests(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), max_size=30), st.lists(st.integers(1, 4), max_size=30)), min_size=1, max_size=5))
def test_shared_cuts_are_the_common_ends(texts):
    at, a, b, bounds, common = 0, [], [], [], set()
    for x, y in texts:
        size = max(sum(x), sum(y))
        if not size:
            bounds.append(len(a))
            continue
        x, y = x + [size - sum(x)] * (sum(x) < size), y + [size - sum(y)] * (sum(y) < size)
        ends_x, ends_y = (np.cumsum(x) + at).tolist(), (np.cumsum(y) + at).tolist()
        common |= set(ends_x) & set(ends_y)
        a, b, at = a + ends_x, b + ends_y, at + size
        bounds.append(len(a))
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    cut_a, cut_b = alignment.shared_cuts(a, b, np.array(bounds))
    assert a[cut_a].tolist() == b[cut_b].tolist() == sorted(common)


def test_forgetting_changes_nothing():
    words = [f"word{i} and {'y' * i}" for i in range(60)]
    small = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", remembered=5)
    large = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    for at in range(0, 60, 10):
        for x, y in zip(small.align(words[at : at + 10]), large.align(words[at : at + 10])):
            assert x[:4] == y[:4] and (x[4] == y[4]).all()


def test_other_models_are_refused():
    with pytest.raises(Exception):
        alignment.Aligner("piece_bpe_32k.model", "byte_bpe_50k.json")
