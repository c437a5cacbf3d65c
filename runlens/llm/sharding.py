"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source parts of bounded size. How many rows each part sends to each shard is drawn first: a
matrix whose rows sum to the part sizes and whose columns sum to the shard sizes, distributed as in a uniform
shuffle. Then each part is permuted on its own and cut by its row of the matrix, the pieces are exchanged,
and each shard is permuted again. Only columns and SQL functions are used.

The matrix is drawn down a binary tree over the parts: a node has a quota of rows for each shard; what its
left half gets of them is multivariate hypergeometric, the right half gets the rest. Nodes of a level are
independent of each other, so they are drawn in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.staging import staged

SHARDS = 24
#: A source part holds at most 2 ** PART_BITS rows, whatever the input's partitions are.
PART_BITS = 17
#: A shard is permuted in cells of about so many rows.
CELL_ROWS = 1 << 16
#: Levels of the tree between written tables.
LEVELS = 6
SEED = 20_240
#: Name of the row number while rows are dealt.
_ROW = "__shard_row"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) of 53 hashed bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11) * F.lit(2.0**-53)


def counting(first: Column, last: Column) -> Column:
    """The whole numbers from first to last, none if last is smaller."""
    return F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among the ``marked`` ones, by inversion of the uniform
    number ``u``.

    Outcomes are ordered from the mode upwards, then from below it downwards; their weights relative to
    the mode follow from the ratios of neighbours. Outcomes further away than 12 deviations and 60 weigh less
    together than the step of ``u``.
    """
    share = marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(F.lit(0.0), drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1))))
    asked = F.struct(
        total.alias("t"), marked.alias("g"), drawn.alias("n"), F.ceil(12 * spread + 60).alias("reach"),
        F.greatest(F.lit(0), drawn + marked - total).alias("least"), F.least(drawn, marked).alias("most"),
        F.floor((drawn + 1.0) * (marked + 1.0) / (total + 2.0)).alias("mean"), u.alias("u"),
    )

    def from_mode(p: Column) -> Column:
        mode = F.least(p["most"], F.greatest(p["least"], p["mean"]))
        return let(mode, lambda m: drawn_from(p, m))

    def drawn_from(p: Column, mode: Column) -> Column:
        rest = p["t"] - p["g"] - p["n"]
        ups = counting(mode, F.least(p["most"], mode + p["reach"]) - 1)
        downs = F.reverse(counting(F.greatest(p["least"], mode - p["reach"]) + 1, mode))
        up = lambda k: (p["g"] - k).cast("double") * (p["n"] - k) / ((k + 1).cast("double") * (rest + k + 1))
        down = lambda k: k.cast("double") * (rest + k) / ((p["g"] - k + 1).cast("double") * (p["n"] - k + 1))

        def weights(steps: Column, ratio: Callable[[Column], Column]) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
            grown = lambda a, k: let(a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum")))
            return F.aggregate(steps, start, grown, lambda a: a["sum"])

        def walked(steps: Column, ratio: Callable[[Column], Column], goal: Column, move: int) -> Column:
            """The outcome at which the weights beyond the mode reach the goal."""
            start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), mode.alias("x"))
            grown = lambda a, k: let(
                a["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), (k + move).alias("x"))
            )
            return F.aggregate(steps, start, lambda a, k: F.when(a["sum"] > goal, a).otherwise(grown(a, k)), lambda a: a["x"])

        above_below = F.struct(weights(ups, up).alias("above"), weights(downs, down).alias("below"))
        return let(
            above_below,
            lambda q: let(
                p["u"] * (1 + q["above"] + q["below"]) - 1,
                lambda goal: F.when(goal < 0, mode)
                .when(goal < q["above"], walked(ups, up, goal, 1))
                .otherwise(walked(downs, down, goal - q["above"], -1)),
            ),
        )

    return let(asked, from_mode)


def drawn_row(quota: Column, drawn: Column, *key: Column | str) -> Column:
    """How many of ``drawn`` rows fall to each shard of a pool with ``quota`` rows for each: shard after shard
    from what the earlier ones leave."""
    total = F.aggregate(quota, F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.struct(
        total.alias("pool"), drawn.alias("left"), F.lit(0).alias("at"), F.array().cast("array<bigint>").alias("out")
    )

    def next_shard(a: Column, marked: Column) -> Column:
        return let(
            hypergeometric(a["pool"], marked, a["left"], uniform(*key, a["at"])),
            lambda x: F.struct(
                (a["pool"] - marked).alias("pool"), (a["left"] - x).alias("left"), (a["at"] + 1).alias("at"),
                F.concat(a["out"], F.array(x)).alias("out"),
            ),
        )

    return F.aggregate(quota, start, next_shard, lambda a: a["out"])


def communication_matrix(parts: DataFrame, quota: list[int]) -> DataFrame:
    """(part, sent array) from ``parts`` (part, n) of one or more rows; the n sum to the quota's sum."""
    numbered = staged(
        parts.select("part", "n", (F.row_number().over(Window.orderBy("part")) - 1).cast("bigint").alias("leaf")), "parts"
    )
    depth = max(numbered.count() - 1, 0).bit_length()
    spark = parts.sparkSession
    nodes = spark.range(1).select(
        F.col("id").alias("node"), F.array(*[F.lit(q).cast("bigint") for q in quota]).alias("quota")
    )
    for level in range(1, depth + 1):
        sizes = numbered.groupBy(F.shiftright("leaf", depth - level).alias("child")).agg(F.sum("n").alias("size"))
        lefts = sizes.where("child % 2 = 0").select(F.shiftright("child", 1).alias("node"), "size")
        left = drawn_row(F.col("quota"), F.col("size"), F.lit(level), F.col("node"))
        drawn = nodes.join(lefts, "node").select("node", "quota", left.alias("left"))
        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quota")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("quota", "left", lambda q, x: q - x).alias("quota")),
        )
        nodes = drawn.select(F.explode(halves).alias("half")).select("half.*")
        if level % LEVELS == 0 or level == depth:
            nodes = staged(nodes, "matrix")
    return nodes.join(numbered, F.col("node") == F.col("leaf")).select("part", F.col("quota").alias("sent"))


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of ``rows`` with ``shard`` and ``slot``: a uniform shuffle in which the shards' counts differ by
    one at most and the slots of a shard are gapless from 0.

    No column is read, so nulls, ties, repeated rows and texts of any length have no effect; columns named shard
    or slot are replaced, others stay. Fewer rows than shards leave the last shards empty; no rows give no
    rows. The input is written once with its row numbers, from which all random keys come: a task that is
    run again deals alike. Another layout of the input's files gives another uniform shuffle.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    numbered = staged(rows.drop("shard", "slot").withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    names = [c for c in numbered.columns if c != _ROW]
    part = F.shiftright(_ROW, PART_BITS).alias("__shard_part")
    parts = staged(numbered.groupBy(part).agg(F.count("*").alias("n")).withColumnRenamed("__shard_part", "part"), "sizes")
    total = parts.agg(F.sum("n")).first()[0] or 0
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    if not total:
        return numbered.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    matrix = communication_matrix(parts, quota).select(F.col("part").alias("__shard_part"), "sent")

    # Permuted within a part, the first sent[0] rows go to shard 0, the next sent[1] to shard 1, and so on.
    local = Window.partitionBy("__shard_part").orderBy(F.xxhash64(F.lit(SEED + 1), _ROW), _ROW)
    permuted = numbered.select("*", part).withColumn("__shard_place", F.row_number().over(local))
    passed = F.aggregate(
        "sent",
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("shard")),
        lambda a, n: F.struct((a["sum"] + n).alias("sum"), (a["shard"] + (a["sum"] + n < F.col("__shard_place")).cast("int")).alias("shard")),
        lambda a: a["shard"],
    )
    sent = permuted.join(matrix, "__shard_part").select(*names, _ROW, passed.alias("shard"))

    # The second permutation orders a shard by hashed keys; their high bits cut it into cells of bounded size.
    cells = max(1, -(-quota[0] // CELL_ROWS))
    cell = F.floor(uniform(F.lit("cell"), _ROW) * cells).cast("int")
    exchanged = staged(sent.withColumn("__shard_cell", cell), "exchanged")
    across = Window.partitionBy("shard").orderBy("__shard_cell")
    sizes = exchanged.groupBy("shard", "__shard_cell").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "__shard_cell", (F.sum("n").over(across) - F.col("n")).alias("__shard_before"))
    within = Window.partitionBy("shard", "__shard_cell").orderBy(F.xxhash64(F.lit(SEED + 2), _ROW), _ROW)
    placed = exchanged.withColumn("slot", (F.row_number().over(within) - 1).cast("bigint"))
    return placed.join(before, ["shard", "__shard_cell"]).select(
        *names, "shard", (F.col("slot") + F.col("__shard_before")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row of ``docs`` (doc_id, text).

    The law is ``rows``: counts at most one apart. size is the text's UTF-8 bytes and 8; a null text has no
    bytes, its checksum is that of an empty one. Only these numbers travel, texts stay where they are.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    told = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    return assign(told, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
