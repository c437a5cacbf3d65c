from __future__ import annotations

import random
import re

import numpy as np
import pytest

from runlens.llm import neardup, shingles
from runlens.llm.components import components

SCHEMA = "doc_id long, text string, component_id string"


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(doc_id, size, smallest id reached) of each row with an id, all pairs compared."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, s in sets:
            for b, t in sets:
                both = len(s & t)
                if (s and 100 * both >= 75 * (len(s) + len(t) - both)) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted((i, len(s), label[i]) for i, s in sets)


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    out = neardup.near_duplicates(docs).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None), out


def varied(rng, base, share):
    return " ".join(w if rng.random() > share else f"n{rng.randrange(10**6)}" for w in base)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    rows = [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE  two"), (105, "one two three"), (None, "one two"),
            (110, "a\x0bb\x1cc d e f"), (111, "ü Ü ü Ü ü Ü"), (103, "one two")]
    at = 1000
    for size, share in ((12, 0.01), (30, 0.03), (25, 0.05), (8, 0.0)):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 150]))]
        for _ in range(size):
            rows.append((at, varied(rng, base, share)))
            at += rng.choice([1, 2])
    rows += [(5, varied(rng, [f"w{rng.randrange(4000)}" for _ in range(6000)], 0)), (9000, "x" * 40_000)]
    rng.shuffle(rows)
    return rows


def test_components_equal_all_pairs(spark, texts):
    got, out = found(spark, texts)
    assert got == brute(texts)
    alone = next(r for r in out if r.doc_id is None)
    assert (alone.n_shingles, alone.component_id, alone.kept) == (1, None, True)


def test_small_blocks_give_the_same(spark, texts, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    assert found(spark, texts)[0] == brute(texts)


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    got, _ = found(spark, [(3, a), (7, a), (7, b), (5, b), (9, "other words stand here alone")])
    assert {(i, c) for i, _, c in got} == {(3, 3), (7, 3), (5, 3), (9, 9)}


def test_no_documents(spark):
    assert found(spark, [])[0] == []


def test_one_of_each_keeps_columns(spark):
    rows = [(4, "a b c d e f", "x"), (2, "A b c d e f", "y"), (2, "A b c d e f", "y"), (None, None, "z"), (8, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_doc_id string")
    out = neardup.one_of_each(docs.withColumnRenamed("kept_doc_id", "source"))
    assert sorted((str(r.doc_id), r.source) for r in out.collect()) == [("2", "y"), ("8", "w"), ("None", "z")]


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (71, 70), (70, 71)], "u long, v long")
    got = dict(tuple(r) for r in components(links).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 70: 70, 71: 70}


def test_rounds_are_logarithmic(spark, monkeypatch):
    from runlens.llm import components as module

    rounds = []
    star = module.large_star
    monkeypatch.setattr(module, "large_star", lambda edges: rounds.append(1) or star(edges))
    order = list(range(10_000))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    assert {r.label for r in components(links).collect()} == {0}
    chain = spark.range(10_000).selectExpr("id AS u", "id + 1 AS v")
    assert {r.label for r in components(chain).collect()} == {0}
    assert len(rounds) <= 40


def test_a_group_keeps_few_links(spark):
    """n classes that share bands with several leads hang on stars of n - 1 links."""
    from runlens.llm.components import small_star

    leads = [(u, v) for u in range(40, 400) for v in range(u % 7, 40, 7)]
    edges = spark.createDataFrame(leads, "u long, v long")
    once = small_star(edges)
    assert once.count() == 360 + 33 and small_star(once).count() <= 393


def test_text_travels_between_blocks_only_where_needed(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 10)
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    rows = [(i, varied(rng, base, 0.003)) for i in range(60)]
    sent = []
    list_for = neardup.shortlisted

    def told(paired, best):
        found = list_for(paired, best)
        sent.append((paired.count(), found.count()))
        return found

    monkeypatch.setattr(neardup, "shortlisted", told)
    assert found(spark, rows)[0] == brute(rows)
    assert len(sent) == 2 and 0 < sent[0][1] < sent[0][0] / 2 and sent[1][1] == 0


def test_pruning_keeps_what_is_similar_enough():
    least = neardup.least_matches()
    rng = np.random.default_rng(1)
    for n, m in least.items():
        assert (rng.binomial(n, 0.75, 20_000) < m).mean() < 1e-3
    assert least[shingles.HASHES] > 0.55 * shingles.HASHES
