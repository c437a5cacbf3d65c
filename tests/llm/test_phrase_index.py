from __future__ import annotations

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from runlens.llm import phrase_index

DOCS = "doc_id long, text string, n_words string"
ITEMS = "item_id long, text string, doc_id long"
LONG = " ".join(f"t{i}" for i in range(14))
DOC_ROWS = [
    (1, f"before {LONG} after"), (2, LONG.upper().replace(" ", "--")), (3, "t0 t1 t2 t3 t4 t5 t6 t7 t8 x t9"), (4, None), (5, ""),
    (6, "...!"), (7, "short item here and short item"), (8, "no"), (9, "né né né né né né né né né né né né"), (1, f"before {LONG} after"),
    (None, LONG), (11, "t4 t5 t6 t7 t8 t9 t10 t11 t12 t13 t0 t1 t2 t3 t4 t5 t6 t7 t8 t9"), (12, "words " * 30_000 + "short item"), (1, "other text"),
]
ITEM_ROWS = [(10, LONG), (2, "Short, item"), (3, None), (4, " . "), (5, "NÉ né né né né né né né né né"), (5, "né né né né né né né né né né"), (6, "no")]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    doc, hit, ids = words(text), set(), set()
    for item, told in items:
        w = words(told)
        k = min(10, len(w))
        for s in range(len(w) - k + 1) if w else ():
            for p in range(len(doc) - k + 1):
                if doc[p : p + k] == w[s : s + k]:
                    hit |= set(range(p, p + k))
                    ids.add(str(item))
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_hits_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in DOC_ROWS], DOCS)
    items = spark.createDataFrame([(*r, 1) for r in ITEM_ROWS], ITEMS)
    got = sorted(map(str, (tuple(r) for r in phrase_index.contamination(docs, items).collect())))
    assert got == sorted(str((i, *brute(t, ITEM_ROWS))) for i, t in DOC_ROWS)
    kept = phrase_index.without_hits(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, t in DOC_ROWS if not brute(t, ITEM_ROWS)[-1])


def test_empty_tables(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in DOC_ROWS], DOCS)
    items = spark.createDataFrame([(*r, 1) for r in ITEM_ROWS], ITEMS)
    assert phrase_index.contamination(docs.where("false"), items).count() == 0
    assert phrase_index.contamination(docs, items.where("false")).where("contaminated OR n_hit > 0").count() == 0


def test_oracle_agrees(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(map(str, con.execute(phrase_index.ORACLE).fetchall()))
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    assert sorted(map(str, (tuple(r) for r in phrase_index.contamination(docs, items).collect()))) == want


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "c x b y a"), (2, "a b"), (3, "a x x x b x x c"), (4, "b a c"), (5, "a b b"), (6, "c b " + "z " * 9 + "a c b a")], "doc_id long, text string"
    )
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    index, cut = phrase_index.build_index(docs, items)
    near = lambda slop: sorted(r.doc for r in phrase_index.proximity_matches(index, cut, slop).collect())
    assert near(0) == [4, 6] and near(2) == [1, 4, 6] and near(5) == [1, 3, 4, 6]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(DOC_ROWS, "doc_id long, text string")
    items = spark.createDataFrame(ITEM_ROWS, "item_id long, text string")
    index, cut = phrase_index.build_index(docs, items)
    plan = phrase_index.phrase_matches(index, cut).select(F.col("item"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
