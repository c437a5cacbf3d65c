from __future__ import annotations

import corpus_pipeline
from tests.llm.test_neardup import brute as components
from tests.llm.test_phrase_index import brute as hits
from tests.llm.test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "packing":
            check_packing(out.collect(), {i: r.text for i, r in before.items()})
            break
        assert out.columns == columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
        if name == "near_duplicates":
            assert set(after) == {c for _, _, c in components([(i, r.text) for i, r in before.items()])}
        if name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not hits(r.text, items)[-1]}
        if name == "personal_data":
            assert set(after) == set(before)
            changed = {i for i in after if after[i].text != before[i].text}
            assert changed and all("@mail" in before[i].text or any(c.isdigit() for c in before[i].text) for i in changed)
            assert all(after[i].n_chars == len(after[i].text) for i in changed)
        before = after


def test_odd_rows_pass_through(spark):
    rows = [(None, None, "en", None, 1), (1, "", None, "s", 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "ein zwei drei", "de", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    foreign = spark.createDataFrame([(-1, "Это другой язык, его нет в корпусе", None, "s", 1)], docs.schema)
    stayed = corpus_pipeline.language(spark, given.select(docs.columns).unionByName(foreign), FOLDER)
    assert stayed.where("doc_id = -1").count() == 0 and stayed.count() >= 0.99 * given.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), FOLDER).count() == 0
