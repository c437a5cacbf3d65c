"""Exact top-k inner products with norm-sorted blocks and Cauchy-Schwarz pruning.

Vectors become whole numbers and are rotated by the right singular vectors of all vectors, which gathers
most of a product in the first dimensions. Candidates are cut into blocks by descending length. The block of the
longest vectors gives each query a first threshold; every other block bounds its products by the partial
sum over the first dimensions plus the product of the residual lengths, and only vectors that may reach the
threshold of some query are multiplied in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.staging import staged

SCALE = 1024
#: Candidates of a block, and queries that meet it at once.
BLOCK, QUERIES = 4096, 512
#: Shares of the rotated dimensions that the partial sums take in, one after another.
HEADS = (0.25, 0.5, 0.75, 1.0)
#: Queries whose bounds are taken together.
ASKED_AT_ONCE = 16
#: The sum of outer products is collected: 134 MB at this many dimensions.
MOST_DIMENSIONS = 4096
#: Doubles add whole numbers exactly below this.
EXACT = 2.0**53
#: Columns of a scored pair.
PAIR = ("query_row", "query_id", "vec_id", "vec_row", "score")
#: Rounding of the rotated bounds, relative to the product of lengths.
SLACK = 1e-9


def whole_vectors(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): floor(SCALE * x) of each component; rows with a null or non-finite component, vector or id go."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(c.between(-1.7976931348623157e308, 1.7976931348623157e308) & ~F.isnan(c), F.lit(False)))
    rows = table.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(row_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def rotation(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Right singular vectors (columns, strongest first) from the sum of outer products, which each task
    adds up: dimensions x dimensions numbers a task."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dimensions, dimensions))
        for frame in frames:
            m = matrix(frame["v"], dimensions).astype(float)
            total += m.T @ m
        at = np.arange(dimensions * dimensions)
        yield pd.DataFrame({"at": at, "x": total.ravel()})

    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"{dimensions} dimensions; at most {MOST_DIMENSIONS} fit a driver")
    if not dimensions:
        return np.eye(0)
    gram = np.zeros(dimensions * dimensions)
    for r in vectors.mapInPandas(summed, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        gram[r["at"]] = r["x"]
    gram = gram.reshape(dimensions, dimensions)
    if not np.isfinite(gram).all():
        return np.eye(dimensions)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def matrix(rows: pd.Series, dimensions: int) -> np.ndarray:
    """Whole numbers, one vector a row; shorter vectors are filled with zeros."""
    out = np.zeros((len(rows), dimensions), np.int64)
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def exact_products(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whole-number products of matching rows; Python's integers where 64 bits might not do."""
    lengths = np.linalg.norm(queries.astype(float), axis=1) * np.linalg.norm(others.astype(float), axis=1)
    if not len(lengths) or lengths.max() < EXACT:
        return np.einsum("ij,ij->i", queries.astype(float), others.astype(float)).astype(np.int64)
    return np.array([sum(a * b for a, b in zip(q, o)) for q, o in zip(queries.tolist(), others.tolist())], object)


def wanted(queries: np.ndarray, others: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The places of the others (rotated) that some query may bring to its least score: over growing heads, the partial
    sum and the product of the lengths of the rest bound a product. One query is enough to keep another vector, so
    the queries are asked a few at a time, and only about vectors that none has asked for yet."""
    places = np.arange(len(others))
    dimensions = others.shape[1]
    for share in HEADS[:-1]:
        head = max(1, round(dimensions * share))
        rest_q, rest_o = np.linalg.norm(queries[:, head:], axis=1), np.linalg.norm(others[places, head:], axis=1)
        asked = np.zeros(len(places), bool)
        for at in range(0, len(queries), ASKED_AT_ONCE):
            open_, few = np.flatnonzero(~asked), slice(at, at + ASKED_AT_ONCE)
            if not len(open_):
                break
            most = queries[few, :head] @ others[places[open_], :head].T + np.outer(rest_q[few], rest_o[open_])
            asked[open_] = (most >= least[few, None]).any(axis=0)
        places = places[asked]
    return places


def best_of_block(queries: pd.DataFrame, others: pd.DataFrame, turn: np.ndarray, k: int) -> pd.DataFrame:
    """The pairs of a block that may be among the k best of their query: (query_row, query_id, vec_id, vec_row, score).

    ``queries`` has row, id, v and least, a score that k others reach (null if there is none yet).
    """
    if queries.empty or others.empty:
        return pd.DataFrame({name: [] for name in PAIR})
    dimensions = len(turn)
    others = others.sort_values(["id", "row"], kind="stable")
    ids, rows, whole = others["id"].to_numpy(), others["row"].to_numpy(), matrix(others["v"], dimensions)
    floats = whole.astype(float)
    turned, longest = floats @ turn, np.linalg.norm(floats, axis=1).max()
    found = []
    for at in range(0, len(queries), QUERIES):
        part = queries.iloc[at : at + QUERIES]
        q_ids, q_rows, q_whole = part["id"].to_numpy(), part["row"].to_numpy(), matrix(part["v"], dimensions)
        q_floats = q_whole.astype(float)
        most = np.linalg.norm(q_floats, axis=1) * longest
        least = part["least"].astype(float).fillna(-np.inf).to_numpy() - most * SLACK
        columns = wanted(q_floats @ turn, turned, least)
        # Products of whole numbers: exact, whatever the order of addition, while lengths keep them below EXACT.
        product = q_floats @ floats[columns].T
        own = pd.Index(rows[columns]).get_indexer(q_rows)
        product[own >= 0, own[own >= 0]] = -np.inf
        if len(columns) >= k and np.isinf(least).any():
            least = np.maximum(least, np.partition(product, -k, axis=1)[:, -k] - most * SLACK)
        row, column = np.nonzero((product >= least[:, None]) & (product > -np.inf))
        score, column = product[row, column], columns[column]
        score = score.astype(np.int64) if most.max() < EXACT else exact_products(q_whole[row], whole[column])
        order = np.lexsort((rows[column], ids[column], -score, row)) if score.dtype != object else np.array(
            sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[column[i]], rows[column[i]])), int
        )
        row, column, score = row[order], column[order], score[order]
        first = np.searchsorted(row, row, side="left")
        top = np.arange(len(row)) - first < k
        row, column = row[top], column[top]
        kept = (q_rows[row], q_ids[row], ids[column], rows[column], score[top])
        found.append(pd.DataFrame(dict(zip(PAIR, kept))))
    return pd.concat(found)


def compared(queries: DataFrame, others: DataFrame, parts: int, turn: np.ndarray, k: int) -> DataFrame:
    """Blocks of ``others`` (block, row, id, v) with the queries (part, row, id, v, least, first, last) that name
    them, a part of the queries at a time."""
    blocks = F.when(F.col("first") <= F.col("last"), F.sequence("first", F.greatest("first", "last")))
    left = queries.select(F.explode(blocks).alias("block"), "part", "row", "id", "v", "least")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    wanted = left.select("block", "part").distinct()
    right = others.select("block", every_part, "row", "id", "v").join(wanted, ["block", "part"], "left_semi")

    def best(q: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        return best_of_block(q, o, turn, k)

    pairs = ", ".join(f"{name} long" for name in PAIR)
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(best, pairs)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def reached(length: Column, least: Column, longest: list[float]) -> Column:
    """The last block whose longest vector can bring a query of this length to its least score; blocks fall in
    length, so earlier ones can too."""
    enough = lambda most: length * most * (1 + SLACK) >= least  # noqa: E731  Cauchy-Schwarz
    passed = F.size(F.filter(F.lit(longest), enough)) - 1
    return F.when(least.isNull(), len(longest) - 1).otherwise(passed)


def top_products(table: DataFrame, is_query: Column, k: int = 10, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` (of ``id``) holds, the k other rows of
    the highest whole-number inner product, ties to the smaller id; all, if there are fewer.

    Rows with a null id or vector or a null or non-finite component take no part. Vectors of different length, empty
    ones too, are filled with zeros. Rows of one id are rows of their own: each is a query and a candidate, also
    for the others of its id. Components and products must fit 64 bits. Only blocks whose longest vector can reach a
    query's least score are sent to it.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    found = whole_vectors(table, row_id, vector).withColumns({"length": length, "row": F.monotonically_increasing_id()})
    vectors = staged(found, "vectors")
    seen = vectors.agg(F.max(F.size("v")).alias("dimensions"), F.count("*").alias("n")).first()
    if not seen.n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(vectors, seen.dimensions)
    blocks = -(-seen.n // BLOCK)
    by_length = vectors.repartitionByRange(blocks, F.desc("length"), "row").withColumn("block", F.spark_partition_id())
    others = staged(by_length.select("block", "row", "id", "v", "length"), "by-length")
    # One number a block of thousands of vectors; a block that got no rows has length 0.
    tops = {r.block: r.most for r in others.groupBy("block").agg(F.max("length").alias("most")).collect()}
    start = min(tops)
    longest = [tops.get(b, 0.0) for b in range(max(tops) + 1)]
    longest = [max(longest[b:]) for b in range(len(longest))]
    queries = staged(vectors.where(is_query).select("row", "id", "v", "length"), "queries")
    # Every part of the queries costs a copy of the other vectors.
    parts = max(1, -(-queries.count() // (BLOCK * 16)))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    asked = queries.withColumns({"least": F.lit(None).cast("long"), "first": F.lit(start), "last": F.lit(start)})
    first = staged(compared(asked, others, parts, turn, k), "longest")
    least = ranked(first, k).groupBy("query_row").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    informed = queries.join(least.select(F.col("query_row").alias("row"), "least"), "row", "left")
    informed = informed.withColumns({"first": F.lit(start + 1), "last": reached(F.col("length"), F.col("least"), longest)})
    more = compared(informed, others, parts, turn, k)
    return ranked(first.unionByName(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
