"""Batching and tile family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import hann, split_batch_output, truncate_vector
from runlens.operators import batching as ops
from runlens.operators import tiles as tile_ops
from workload.base import VIEWS, query, rounded, table
from workload.planning import images
from workload.timing import timing

VIEWS["queue_v"] = """
SELECT o_orderkey AS seq, o_custkey % 8 AS shard, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority
FROM orders"""


def queue(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") % 8).alias("shard"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
    )


@query(
    """SELECT seq, shard, priority, (rn - 1) // 16 AS batch_no, (rn - 1) % 16 AS slot
    FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY priority, seq) AS rn FROM queue_v)"""
)
def priority_batches(spark, sf_dir):
    return ops.priority_batches(queue(spark, sf_dir), ["shard"], 16)


@query(
    """SELECT batch_id, chunk_no, count(*)::INT AS filled,
      string_agg(md5(result), ',' ORDER BY rn)
        || repeat(',' || any_value(first_item), (4 - count(*))::INT) AS items
    FROM (SELECT *, (rn - 1) // 4 AS chunk_no FROM (
      SELECT conv_id AS batch_id, text AS result,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
        md5(first_value(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS first_item
      FROM conversations))
    GROUP BY batch_id, chunk_no"""
)
def chunk_with_padding(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"), "turn", F.md5("text").alias("result")
    )
    chunks = ops.chunk_with_padding(items, ["batch_id"], "turn", "result", 4)
    return chunks.select(
        "batch_id", "chunk_no", "filled", F.array_join("items", ",").alias("items")
    )


@query(
    """SELECT event_id, run_id, session_no,
      (row_number() OVER (PARTITION BY run_id, session_no ORDER BY ts) - 1) // 8 AS batch_no
    FROM (SELECT *, (sum(opens) OVER (PARTITION BY run_id ORDER BY ts))::BIGINT AS session_no
      FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY ts))
          < 3600000000 THEN 0 ELSE 1 END AS opens FROM timing_v))"""
)
def gap_batches(spark, sf_dir):
    arrivals = timing(spark, sf_dir).select("event_id", "run_id", "ts")
    return ops.gap_batches(arrivals, ["run_id"], "ts", 8, 3600.0, tie=["event_id"]).drop("ts")


ADAPTIVE_TRACE_SQL = """WITH RECURSIVE steps AS (
      SELECT run_id, (rn - 1) // 10 AS step, avg(execute_s) AS mean
      FROM (SELECT run_id, execute_s, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS rn
        FROM timing_v) GROUP BY ALL HAVING count(*) = 10),
    walk AS (
      SELECT run_id, -1::BIGINT AS step, 4::BIGINT AS batch_size FROM (SELECT DISTINCT run_id FROM steps)
      UNION ALL
      SELECT s.run_id, s.step, CASE WHEN s.mean < 0.01 THEN least(batch_size + 1, 16)
        WHEN s.mean > 0.05 THEN greatest(batch_size - 1, 1) ELSE batch_size END
      FROM walk w JOIN steps s ON s.run_id = w.run_id AND s.step = w.step + 1)
    SELECT run_id, step, batch_size FROM walk WHERE step >= 0"""


@query(ADAPTIVE_TRACE_SQL)
def adaptive_batch_trace(spark, sf_dir):
    return ops.adaptive_batch_trace(timing(spark, sf_dir), ["run_id"], "event_id", "execute_s")


@query(
    """SELECT conv_id AS batch_id, turn // 1000 AS part_no, count(*) AS parts,
      string_agg(turn || ':' || md5(text), ',' ORDER BY turn) AS results
    FROM conversations GROUP BY ALL"""
)
def reassemble_batches(spark, sf_dir):
    delivered = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("batch_id"),
        F.col("turn").alias("sub_batch_id"),
        F.md5("text").alias("result"),
    )
    entries = F.transform(
        F.array_sort(F.map_entries("results")),
        lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]),
    )
    return ops.reassemble_batches(delivered).select(
        "batch_id",
        "part_no",
        F.size("results").cast("bigint").alias("parts"),
        F.array_join(entries, ",").alias("results"),
    )


VIEWS["tiles_v"] = """
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY y0, x0) - 1)::INT AS tile_id,
  greatest(0, least(x0 + 640, width) - 640)::INT AS x, greatest(0, least(y0 + 640, height) - 640)::INT AS y,
  least(640, width)::INT AS w, least(640, height)::INT AS h, (nx * ny)::INT AS num_tiles
FROM (SELECT image_id, width, height, unnest(range(0, width, 480)) AS x0, y0,
    len(range(0, width, 480)) AS nx, ny
  FROM (SELECT image_id, width, height, unnest(range(0, height, 480)) AS y0,
    len(range(0, height, 480)) AS ny FROM images_v))"""


def tiles(spark, sf_dir):
    return tile_ops.tile_grid(images(spark, sf_dir), 640, 0.25)


@query("SELECT image_id, tile_id, x, y, w, h, num_tiles FROM tiles_v")
def tile_grid(spark, sf_dir):
    return tiles(spark, sf_dir)


@query(
    """SELECT sum(n)::BIGINT AS total_tiles, count(*) AS total_images,
      round(sum(n) / count(*), 6) AS avg_tiles_per_image
    FROM (SELECT image_id, count(*) AS n FROM tiles_v GROUP BY image_id)"""
)
def tiles_per_image(spark, sf_dir):
    return rounded(tile_ops.tiles_per_image(tiles(spark, sf_dir)))


@query(
    """SELECT image_id, tile_id, x, y, w, h, num_tiles, len(embedding[1:10])::INT AS kept,
      embedding[1]::DOUBLE AS first_value, embedding[10]::DOUBLE AS last_value
    FROM tiles_v JOIN (SELECT vec_id // 8 + 1 AS image_id, (vec_id % 8)::INT AS tile_id, embedding
      FROM embeddings WHERE label <> 3) USING (image_id, tile_id)"""
)
def merge_tile_results(spark, sf_dir):
    results = table(spark, sf_dir, "embeddings").select(
        (F.floor(F.col("vec_id") / 8) + 1).alias("image_id"),
        (F.col("vec_id") % 8).cast("int").alias("tile_id"),
        F.when(F.col("label") != 3, F.col("embedding")).alias("result"),
    )
    merged = tile_ops.merge_tile_results(tiles(spark, sf_dir), results)
    return merged.select(
        "image_id", "tile_id", "x", "y", "w", "h", "num_tiles",
        F.size("result").alias("kept"),
        F.col("result")[0].cast("double").alias("first_value"),
        F.col("result")[9].cast("double").alias("last_value"),
    )


VIEWS["small_images_v"] = """
SELECT p_partkey AS image_id, CAST(8 + p_size AS INT) AS width, CAST(8 + p_partkey % 20 AS INT) AS height
FROM part"""


def small_images(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"),
        (8 + F.col("p_size")).cast("int").alias("width"),
        (8 + F.col("p_partkey") % 20).cast("int").alias("height"),
    )


@query(
    """SELECT image_id, count(*) AS pixels, round(sum(weight), 5) AS total, round(max(weight), 6) AS top,
      round(sum(weight * (y * 100 + x)), 5) AS placed
    FROM (SELECT image_id, y, x, CASE WHEN sum(wt) < 1e-6 THEN 1 ELSE sum(wt) END AS weight
      FROM (SELECT image_id, y1 + dy AS y, x1 + dx AS x,
          (0.5 - 0.5 * cos(2 * pi() * dy / 15)) * (0.5 - 0.5 * cos(2 * pi() * dx / 15)) AS wt
        FROM (SELECT *, unnest(range(0, w)) AS dx FROM (SELECT *, unnest(range(0, h)) AS dy FROM (
          SELECT image_id, greatest(0, least(x0 + 16, width) - 16) AS x1,
            greatest(0, least(y0 + 16, height) - 16) AS y1, least(16, width) AS w, least(16, height) AS h
          FROM (SELECT *, unnest(range(0, width, 12)) AS x0 FROM (
            SELECT *, unnest(range(0, height, 12)) AS y0 FROM small_images_v))))))
      GROUP BY image_id, y, x)
    GROUP BY image_id"""
)
def tile_weight_map(spark, sf_dir):
    weights = tile_ops.tile_weight_map(small_images(spark, sf_dir), 16, 0.25)
    found = weights.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.sum("weight").alias("total"),
        F.max("weight").alias("top"),
        F.sum(F.col("weight") * (F.col("y") * 100 + F.col("x"))).alias("placed"),
    )
    return found.select(
        "image_id",
        "pixels",
        F.round("total", 5).alias("total"),
        F.round("top", 6).alias("top"),
        F.round("placed", 5).alias("placed"),
    )


@query(
    """SELECT image_id, unnest(range(0, 16)) AS i,
      unnest(list_transform(range(0, 16), lambda i: round(0.5 - 0.5 * cos(2 * pi() * i / 15), 9)))
        * width AS weight
    FROM small_images_v"""
)
def hann_weights(spark, sf_dir):
    rows = small_images(spark, sf_dir).select("image_id", "width", F.posexplode(hann(16)).alias("i", "w"))
    return rows.select(
        "image_id",
        F.col("i").cast("bigint").alias("i"),
        (F.round("w", 9) * F.col("width")).alias("weight"),
    )


@query(
    """SELECT vec_id, len(embedding[1:10])::INT AS kept,
      array_to_string(list_transform(embedding[1:10], lambda x: floor(x * 1000)::INT), ',') AS head
    FROM embeddings"""
)
def truncate_vectors(spark, sf_dir):
    head = truncate_vector(F.col("embedding"), 10)
    scaled = F.transform(head, lambda x: F.floor(x * F.lit(1000.0).cast("float")).cast("string"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(head).alias("kept"), F.array_join(scaled, ",").alias("head")
    )


@query(
    """SELECT vec_id, part, list_aggregate(v, 'max')::DOUBLE AS high, len(v)::INT AS length
    FROM (SELECT vec_id, part, embedding[part * 16 + 1 : part * 16 + 16] AS v
      FROM (SELECT *, unnest([0, 1, 2, 3]) AS part FROM embeddings))"""
)
def split_batch_outputs(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(split_batch_output(F.col("embedding"), 4)).alias("part", "v")
    )
    return parts.select(
        "vec_id",
        "part",
        F.array_max("v").cast("double").alias("high"),
        F.size("v").alias("length"),
    )
