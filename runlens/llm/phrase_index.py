"""Benchmark decontamination on a distributed positional inverted index.

``build_index`` writes one posting (document, term, position) for every occurrence of a benchmark term in
the corpus. A window of an item is searched from its rarest terms: the offset-adjusted postings of the two
rarest positions are intersected, which leaves few candidate alignments of item and document; these are
then intersected with the postings of all other positions of the item. Only DataFrame operations are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.staging import broadcast_if_small, staged

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Tables of a few numbers or one term a row are broadcast up to so many rows (under 20 MB).
BROADCAST_ROWS = 300_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after the last word of each document; no word holds this character.
END = "\x00"
END_TERM = -1


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and all characters beyond ASCII; none for null."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.filter(cut, lambda w: w != "")


@dataclass
class Items:
    """words: (item, place, term, length); windows: (item, start, size); names: (item, item_id)."""

    words: DataFrame
    windows: DataFrame
    names: DataFrame


@dataclass
class Index:
    """postings: (doc, text_hash, term, pos), with one END_TERM at each document row's end; terms: (term, word)."""

    postings: DataFrame
    terms: DataFrame


def cut_items(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, item_id), (item, place, word, length) and (item, start, size); an item without words has no window."""
    names = staged(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", words(F.col("text")).alias("w")), "items")
    placed = names.select("item", F.size("w").alias("length"), F.posexplode("w").alias("place", "word"))
    size = F.least(F.size("w"), F.lit(window))
    windows = names.where(F.size("w") > 0).select(
        "item", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("start")
    )
    return names.select("item", "item_id"), placed, windows


def build_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[Index, Items]:
    names, placed, windows = cut_items(benchmark, window)
    terms = staged(placed.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    end = docs.sparkSession.createDataFrame([(END, END_TERM)], "word string, term long")
    looked_up = broadcast_if_small(staged(terms.unionByName(end), "lookup"), BROADCAST_ROWS)
    # The hash is taken before the words become rows; in one select it would be taken for every word.
    split = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text_hash"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w")
    )
    occurring = split.select("doc", "text_hash", F.posexplode("w").alias("pos", "word"))
    postings = occurring.join(looked_up, "word").select("doc", "text_hash", "term", "pos")
    spelled = placed.join(terms, "word").select("item", "place", "term", "length")
    return Index(staged(postings, "postings"), terms), Items(staged(spelled, "item-words"), windows, names)


def rarest_places(index: Index, items: Items, most: int = 2) -> DataFrame:
    """(item, start, place, term, rank, ranks): the places of each window whose terms occur least, ``ranks`` of them."""
    often = index.postings.where(F.col("term") != END_TERM).groupBy("term").agg(F.count("*").alias("n"))
    inside = items.windows.join(items.words, "item").where("place >= start AND place < start + size")
    counted = inside.join(often, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("n", "place"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select(
        "item", "start", "place", "term", "rank", F.least("size", F.lit(most)).alias("ranks")
    )


def alignments(index: Index, items: Items) -> DataFrame:
    """(doc, text_hash, item, shift): where the two rarest places of some window both stand in the document,
    position = place + shift."""
    rare = broadcast_if_small(staged(rarest_places(index, items), "rarest"), BROADCAST_ROWS)
    lists = index.postings.join(rare, "term").select(
        "doc", "text_hash", "item", "start", "ranks", "rank", (F.col("pos") - F.col("place")).alias("shift")
    )
    key = ["doc", "text_hash", "item", "shift"]
    both = lists.groupBy(*key, "start", "ranks").agg(F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("seen"))
    return both.where(F.bit_count("seen") == F.col("ranks")).select(*key).distinct()


def phrase_matches(index: Index, items: Items) -> DataFrame:
    """(doc, text_hash, item, first, size): every occurrence of every window, first being a document position."""
    found = staged(alignments(index, items), "alignments")
    some = broadcast_if_small(found.select("doc", "text_hash").distinct(), BROADCAST_ROWS)
    same_doc = F.col("p.doc").eqNullSafe(F.col("s.doc")) & (F.col("p.text_hash") == F.col("s.text_hash"))
    near = index.postings.alias("p").join(some.alias("s"), same_doc, "left_semi").where(F.col("term") != END_TERM)
    probes = broadcast_if_small(items.words, BROADCAST_ROWS)
    wanted = found.join(probes, "item").withColumn("pos", F.col("place") + F.col("shift"))
    here = (
        F.col("w.doc").eqNullSafe(F.col("p.doc")) & (F.col("w.text_hash") == F.col("p.text_hash"))
        & (F.col("w.pos") == F.col("p.pos")) & (F.col("w.term") == F.col("p.term"))
    )
    hits = wanted.alias("w").join(near.alias("p"), here).select("w.doc", "w.text_hash", "item", "shift", "place", "length")
    places = hits.groupBy("doc", "text_hash", "item", "shift", "length").agg(F.collect_set("place").alias("places"))
    size = F.least(F.col("length"), F.lit(WINDOW))
    starts = F.filter(
        F.sequence(F.lit(0), F.col("length") - size),
        lambda s: F.size(F.filter("places", lambda x: (x >= s) & (x < s + size))) == size,
    )
    first = F.explode(F.transform(starts, lambda s: s + F.col("shift")))
    return places.select("doc", "text_hash", "item", first.alias("first"), size.alias("size"))


def proximity_matches(index: Index, items: Items, slop: int) -> DataFrame:
    """(doc, text_hash, item, start): windows all of whose terms occur, in any order and each as often as in the
    window, within size + slop words around an occurrence of the window's rarest term."""
    anchors = rarest_places(index, items, 1).select("item", "start", F.col("term").alias("anchor"))
    inside = items.windows.join(items.words, "item").where("place >= start AND place < start + size")
    need = inside.groupBy("item", "start", "size", "term").agg(F.count("*").alias("need"))
    terms = need.groupBy("item", "start").agg(F.count("*").alias("terms"))
    at = index.postings.join(anchors, F.col("term") == F.col("anchor")).select(
        "doc", "text_hash", "item", "start", F.col("pos").alias("at")
    )
    around = at.join(need, ["item", "start"]).join(index.postings.withColumnsRenamed({"doc": "d", "text_hash": "h"}), "term").where(
        F.col("d").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("text_hash"))
        & (F.abs(F.col("pos") - F.col("at")) < F.col("size") + slop)
    )
    key = ["doc", "text_hash", "item", "start", "at"]
    # Every span that holds the anchor starts at one of the found positions.
    spans = around.select(*key, "size", F.col("pos").alias("from")).distinct().where("from <= at")
    held = around.join(spans, [*key, "size"]).where(
        (F.col("pos") >= F.col("from")) & (F.col("pos") < F.col("from") + F.col("size") + slop)
        & (F.col("at") < F.col("from") + F.col("size") + slop)
    )
    enough = held.groupBy(*key, "from", "term", "need").agg(F.count_distinct("pos").alias("n")).where("n >= need")
    full = enough.groupBy(*key, "from").agg(F.count("*").alias("met")).join(terms, ["item", "start"]).where("met = terms")
    return full.select("doc", "text_hash", "item", "start").distinct()


def hit_documents(index: Index, items: Items) -> DataFrame:
    """(doc, text_hash, n_hit, ids): documents with a window of some item, the words in them, and the items' ids."""
    matches = staged(phrase_matches(index, items), "matches")
    key = ["doc", "text_hash"]
    hit = (
        matches.select(*key, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("pos"))
        .distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    )
    named = (
        matches.select(*key, "item").distinct().join(items.names, "item")
        .groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    same = F.col("a.doc").eqNullSafe(F.col("b.doc")) & (F.col("a.text_hash") == F.col("b.text_hash"))
    return staged(hit.alias("a").join(named.alias("b"), same, "left").select("a.*", "ids"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs`` (doc_id, text).

    A word is hit if it lies in an occurrence of any window of WINDOW consecutive item words. Null or empty
    texts have no words; items without words have no windows; an item without an id hits words but is not
    named or counted. Repeated rows are judged each, by their own text. Without items nothing is hit.
    """
    index, items = build_index(docs, benchmark)
    told = broadcast_if_small(hit_documents(index, items), BROADCAST_ROWS)
    rows = index.postings.where(F.col("term") == END_TERM).select("doc", "text_hash", F.col("pos").alias("n_words"))
    same = F.col("r.doc").eqNullSafe(F.col("t.doc")) & (F.col("r.text_hash") == F.col("t.text_hash"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.alias("r").join(told.alias("t"), same, "left").select(
        F.col("r.doc").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with all their columns."""
    told = broadcast_if_small(hit_documents(*build_index(docs, benchmark)), BROADCAST_ROWS)
    same = docs["doc_id"].eqNullSafe(F.col("t.doc")) & (F.xxhash64(docs["text"]) == F.col("t.text_hash"))
    return docs.join(told.alias("t"), same, "left_anti")


def _sql_words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_words('text')} AS w FROM documents),
b AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k
      FROM (SELECT item_id, {_sql_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
         FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
spans AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT r, s, k, item_id FROM spans JOIN wins USING (k, phrase)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hits) GROUP BY r),
i AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
