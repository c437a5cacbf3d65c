from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import packing, tokens

SCHEMA = "doc_id long, text string, n_tokens string, source string"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b \n c"), (5, "it's <|endoftext|> 12 <|endoftext|>"), (6, "x" * 5000),
    (7, "word " * 3000 + "  　 end"), (7, "word " * 3000 + "  　 end"), (None, "no id"), (9, "ü\x85 \x1c z"),
]


def library(name="byte_bpe_50k.json"):
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokens.tokenizer_path(name))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab' .\n\t 　\x85\x1c​é9!<|endoftext|>s"), max_size=60))
def test_pieces_encode_to_the_same_ids(text):
    use = tokens.encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    got = np.frombuffer(next(use.ids([text])), "<u4").tolist()
    assert got == library().encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab' .\n\t 　\x85\x1c​é²39!,<|endoftext|>s"), max_size=40), max_size=4))
def test_words_gather_to_the_same_ids(texts):
    """Also right after words were forgotten."""
    use = packing.text_ids("byte_bpe_50k.json", 20)
    got = [np.frombuffer(x, "<u4").tolist() for x in use(texts)]
    model = library()
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    docs = spark.createDataFrame([(i, t, "old", "s") for i, t in ODD], SCHEMA)
    got = tokens.count_tokens(docs, tokenizer=name).collect()
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path(name))
        count = lambda t: len(model.encode(t))
    else:
        count = lambda t: len(library(name).encode(t, add_special_tokens=False).ids)
    want = sorted((str(i), len((t or "").encode()), count(t) if t else 0) for i, t in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) and r.source == "s" for r in got)


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tokens.count_tokens(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0


def check_packing(rows, texts):
    """Each id in exactly one piece, sequences gapless and without padding."""
    tok = library()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_keeps_every_id(spark):
    texts = {i: t for i, t in ODD if i is not None}
    docs = spark.createDataFrame([(i, t, "old", "s") for i, t in texts.items()], SCHEMA)
    check_packing(packing.pack_documents(docs).collect(), texts)


def test_packing_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_packing(packing.pack_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_curve_visits_neighbours_one_step_apart():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = packing.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_copies_share_sequences(spark):
    docs = spark.createDataFrame([(i, f"{'alpha beta' if i % 2 else 'zwei äpfel'} " * 40) for i in range(40)], "doc_id long, text string")
    rows = packing.pack_documents(docs.withColumn("curve", F.lit("clash")).coalesce(1)).orderBy("sequence_id", "offset").collect()
    kinds = [r.doc_id % 2 for r in rows]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) <= 2
