"""Sources, sinks, logs, images and scoring over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from runlens.functions import decode_output, normalize_pixels
from runlens.operators import images as image_ops
from runlens.operators import quality, scoring
from runlens.operators.timing import successful_only
from runlens.sources import configs as config_source
from runlens.sources import images as image_source
from runlens.sources import logs, sinks
from runlens.sources.shared import scratch_path, spread
from workload.base import VIEWS, query, rounded, table
from workload.planning import configs, devices, models, scenarios
from workload.results import results


@query("SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '\\.(com|org)/[a-z]+/[0-9]+$')")
def scan_by_suffix(spark, sf_dir):
    cut = F.regexp_replace("url", r"^(.*\.(com|org))/[a-z]+/[0-9]+$", "$1")
    pages = table(spark, sf_dir, "pages")
    return pages.filter(image_source.has_suffix(cut, (".COM", ".org"))).select("page_id", "url")


VIEWS["preproc_v"] = """
SELECT d.doc_id AS idx, l.quality AS result, l.doc_id IS NOT NULL AS success,
  CAST(d.n_chars AS DOUBLE) / 1000000 AS latency
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def preprocessed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), (F.col("n_chars").cast("double") / 1000000).alias("latency")
    )
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("idx"), F.col("quality").alias("result"), F.lit(True).alias("success")
    )
    return docs.join(labels, "idx", "left").withColumn(
        "success", F.coalesce("success", F.lit(False))
    )


@query("SELECT idx, result, latency FROM preproc_v WHERE result IS NOT NULL")
def successful_only_rows(spark, sf_dir):
    return successful_only(preprocessed(spark, sf_dir)).select("idx", "result", "latency")


@query("SELECT idx, CASE WHEN success THEN 'kept' ELSE 'failed' END AS side FROM preproc_v")
def split_failed(spark, sf_dir):
    good, bad = image_ops.split_failed(preprocessed(spark, sf_dir))
    return good.select("idx", F.lit("kept").alias("side")).union(
        bad.select("idx", F.lit("failed").alias("side"))
    )


@query(
    """SELECT count(*) FILTER (WHERE success) AS total_processed,
      count(*) FILTER (WHERE NOT success) AS total_errors, round(sum(latency), 6) AS total_latency,
      round(sum(latency) / count(*) FILTER (WHERE success), 6) AS avg_latency_per_image
    FROM preproc_v"""
)
def preprocess_stats(spark, sf_dir):
    return rounded(image_ops.preprocess_stats(preprocessed(spark, sf_dir)))


@query("SELECT doc_id AS idx, quality AS result FROM documents LEFT JOIN labels USING (doc_id)")
def results_in_input_order(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    found = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("idx"), F.col("quality").alias("result")
    )
    return image_ops.results_in_input_order(inputs, found, "idx")


@query(
    """SELECT doc_id || '.png' AS image, CASE WHEN quality IS NULL THEN 'failed' ELSE 'success' END AS status,
      CASE WHEN quality IS NOT NULL THEN 2 END AS length
    FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 500"""
)
def write_inference_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels")
    runs = docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"),
        F.when(F.col("quality").isNotNull(), F.array("quality", "toxic")).alias("result"),
        F.when(F.col("n_chars") > 500, F.array(F.col("n_chars") / 1000))
        .otherwise(F.array().cast("array<double>"))
        .alias("inference_times"),
    )
    path = scratch_path(spark, "results")
    sinks.write_inference_results(runs, path)
    back = spark.read.schema("image string, status string, shape array<int>").json(path)
    return back.select("image", "status", F.col("shape")[0].alias("length"))


@query(
    """SELECT 'scenario-' || scenario_no AS task_name,
      CASE WHEN route_type = '' THEN 'standard' ELSE route_type END AS route_type, result_idx, model_name, pure_fps
    FROM results_v"""
)
def write_archive(spark, sf_dir):
    rows = results(spark, sf_dir).select(
        F.col("scenario_name").alias("task_name"), "route_type", "result_idx", "model_name", "pure_fps"
    )
    root = scratch_path(spark, "archive")
    sinks.write_archive(rows, root)
    return spark.read.parquet(root).select("task_name", "route_type", "result_idx", "model_name", "pure_fps")


@query(
    """SELECT result_idx, scenario_no, model_name, CASE WHEN route_type = '' THEN '' ELSE route_type END AS route_type,
      pure_fps, execute_avg, count(*) OVER () AS result_count, '1.0' AS version FROM results_v"""
)
def write_report_json(spark, sf_dir):
    """Every written result read back, with what the metadata says of them."""
    path = scratch_path(spark, "report")
    sinks.write_report_json(results(spark, sf_dir), path)
    meta = spark.read.schema("result_count long, version string").json(f"{path}/metadata").first()
    schema = "result_idx long, scenario_no int, model_name string, route_type string, pure_fps double, execute_avg double"
    read = spark.read.schema(schema).json(f"{path}/results")
    return read.withColumns({"result_count": F.lit(meta.result_count), "version": F.lit(meta.version)})


def groups(rows):
    """So many documents that each holds some 250 rows."""
    return max(1, -(-rows.count() // 250))


def by_document(rows, key):
    """Rows grouped by their document, documents dealt over all tasks of a shuffle: each becomes a file, which costs
    the same however short it is, so a number of tasks that follows from bytes would be too small."""
    document = F.pmod(F.xxhash64(key), F.lit(groups(rows)))
    return spread(rows.withColumn("document", document), "document").groupBy("document")


def file_each(documents):
    """A writer that puts every row into a file of its own; all files lie in one folder, which is listed at once."""
    return documents.write.mode("append").option("maxRecordsPerFile", 1)


@query(
    """SELECT config_id, device_id, num_threads, CASE WHEN backend = 'other' THEN 'pil' ELSE backend END
        AS backend,
      resolution, multithread_on, CASE WHEN batch_on THEN batch_size ELSE 4 END AS batch_size,
      CASE WHEN batch_on THEN timeout_ms ELSE 10 END::DOUBLE AS timeout_ms, 0.5::DOUBLE AS iou_threshold,
      '720p' AS input_tier, false AS unreadable
    FROM configs_v
    UNION ALL SELECT NULL, 0, 4, 'pil', '640x640', false, 4, 10, 0.5, '720p', true"""
)
def read_run_configs(spark, sf_dir):
    """JSON documents that each hold many configurations, and a broken one, through the reader."""
    batch = F.when(F.col("batch_on"), F.struct(F.lit(True).alias("enabled"), "batch_size", "timeout_ms"))
    documents = configs(spark, sf_dir).select(
        F.col("config_id").cast("string").alias("model_path"),
        "device_id",
        "num_threads",
        F.when(F.col("backend") != "other", F.col("backend")).alias("backend"),
        "resolution",
        F.struct(
            F.struct(F.col("multithread_on").alias("enabled")).alias("multithread"), batch.alias("batch")
        ).alias("strategies"),
    )
    path = scratch_path(spark, "configs")
    whole = by_document(documents, "model_path").agg(F.to_json(F.collect_list(F.struct(*documents.columns))).alias("value"))
    broken = spark.range(1).select(F.lit('{"model_path": ').alias("value"))
    file_each(whole.select("value").unionByName(broken)).text(path)
    flat = config_source.flat_configs(config_source.read_run_configs(spark, path))
    return flat.select(
        F.col("model_path").try_cast("bigint").alias("config_id"),
        "device_id",
        "num_threads",
        "backend",
        "resolution",
        "multithread_on",
        "batch_size",
        "timeout_ms",
        "iou_threshold",
        "input_tier",
        "unreadable",
    )


@query(
    """SELECT 'model' AS kind, name, has_720::INT + has_1080::INT + has_4k::INT AS items FROM models_v
    UNION ALL SELECT 'device', name, 1 FROM devices_v
    UNION ALL SELECT 'scenario', name, 1 FROM scenarios_v"""
)
def read_registry(spark, sf_dir):
    """Registry documents of many entries each, through the reader."""
    path = scratch_path(spark, "registry")
    parts = [
        ("models", models(spark, sf_dir)),
        ("devices", devices(spark, sf_dir)),
        ("scenarios", scenarios(spark, sf_dir).drop("scenario_id")),
    ]
    for name, rows in parts:
        many = by_document(rows, "name").agg(F.collect_list(F.struct(*rows.columns)).alias(name))
        file_each(many.select(name)).json(path)
    found_models, found_devices, found_scenarios = config_source.read_registry(spark, path)
    return (
        found_models.select(F.lit("model").alias("kind"), "name", F.size("input_specs").alias("items"))
        .union(found_devices.select(F.lit("device"), "name", F.size("supported_tiers")))
        .union(found_scenarios.select(F.lit("scenario"), "name", F.lit(1)))
    )


VIEWS["log_v"] = """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'DEBUG'
  ELSE 'INFO' END AS level, event_type AS logger, user_id AS line
FROM events"""


def log_lines(spark, sf_dir):
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "view", "DEBUG").otherwise("INFO")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.to_json(
            F.struct(
                level.alias("level"),
                kind.alias("logger"),
                F.col("user_id").alias("line"),
                F.col("event_id").cast("string").alias("request_id"),
            )
        ).alias("value"),
    )


@query(
    """SELECT event_id, level, logger, line::INT AS line, event_id::VARCHAR AS request_id,
      1 AS extra_keys FROM log_v"""
)
def read_structured_logs(spark, sf_dir):
    path = scratch_path(spark, "logs")
    log_lines(spark, sf_dir).select("value").write.text(path)
    parsed = logs.read_structured_logs(spark, path)
    return parsed.select(
        F.col("extra")["request_id"].cast("bigint").alias("event_id"),
        "level",
        "logger",
        "line",
        F.col("extra")["request_id"].alias("request_id"),
        F.size("extra").alias("extra_keys"),
    )


@query("SELECT event_id, level FROM log_v WHERE level = 'ERROR'")
def sample_logs_errors(spark, sf_dir):
    parsed = logs.parse_log_lines(log_lines(spark, sf_dir))
    kept = logs.sample_logs(parsed, 0.1, F.col("event_id"))
    return kept.filter("level = 'ERROR'").select("event_id", "level")


@query(
    f"""SELECT event_id, level FROM log_v
    WHERE level = 'ERROR' OR md5(event_id::VARCHAR || ':0')[1:16] < '{logs.sample_bound(0.1)}'"""
)
def sample_logs(spark, sf_dir):
    parsed = logs.parse_log_lines(log_lines(spark, sf_dir))
    return logs.sample_logs(parsed, 0.1, F.col("event_id")).select("event_id", "level")


# Images derived from the embeddings: 8 x 8 grey pixels per vector.

VIEWS["vector_pixels_v"] = """
SELECT vec_id, list_transform(embedding,
  lambda v: least(255, greatest(0, floor(v::DOUBLE * 100 + 128)))::INT) AS px
FROM embeddings"""


def vector_images(spark, sf_dir):
    @F.pandas_udf("binary")
    def as_bytes(vectors):
        return vectors.map(
            lambda v: np.clip(np.floor(np.asarray(v, dtype=np.float64) * 100 + 128), 0, 255)
            .astype(np.uint8)
            .tobytes()
        )

    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.col("vec_id").alias("image_id"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("channels"),
        as_bytes("embedding").alias("data"),
    )


def _hex_sql(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda b: printf('%02X', b)), '')"


@query(
    f"""SELECT image_id, tile_id, x, y, w, h, {_hex_sql('px')} AS bytes FROM (
      SELECT vec_id AS image_id, (yi * 3 + xi)::INT AS tile_id, x, y, 4 AS w, 4 AS h,
        list_transform(range(0, 16), lambda i: px[((y + i // 4) * 8 + x + i % 4 + 1)::INT]) AS px
      FROM vector_pixels_v,
        (VALUES (0, 0), (1, 3), (2, 4)) ys(yi, y), (VALUES (0, 0), (1, 3), (2, 4)) xs(xi, x))"""
)
def cut_tiles(spark, sf_dir):
    cut = image_ops.cut_tiles(vector_images(spark, sf_dir), 4, 0.25)
    return cut.select("image_id", "tile_id", "x", "y", "w", "h", F.hex("data").alias("bytes"))


@query(
    f"""SELECT vec_id AS image_id, 5 AS height, 12 AS width, {_hex_sql(
        "list_transform(range(0, 60), lambda i: px[(floor(((i // 12) + 0.5) * 8 / 5) * 8 "
        "+ floor(((i % 12) + 0.5) * 8 / 12) + 1)::INT])")} AS bytes
    FROM vector_pixels_v"""
)
def resize_nearest(spark, sf_dir):
    sized = vector_images(spark, sf_dir).withColumns(
        {"target_height": F.lit(5), "target_width": F.lit(12)}
    )
    done = image_ops.resize_images(sized, "nearest")
    return done.select("image_id", "height", "width", F.hex("data").alias("bytes"))


@query()
def resize_bilinear(spark, sf_dir):
    sized = vector_images(spark, sf_dir).withColumns(
        {"target_height": F.lit(16), "target_width": F.lit(12)}
    )
    return image_ops.resize_images(sized, "bilinear")


@query()
def resize_bicubic(spark, sf_dir):
    sized = vector_images(spark, sf_dir).withColumns(
        {"target_height": F.lit(6), "target_width": F.lit(10)}
    )
    return image_ops.resize_images(sized, "bicubic")


@query(
    """SELECT vec_id AS image_id, len(px)::INT AS length, round(list_sum(px) / 255.0, 3) AS total,
      round(list_max(px) / 255.0, 6) AS high FROM vector_pixels_v"""
)
def normalize_pixel_values(spark, sf_dir):
    tensor = normalize_pixels(F.col("data"), F.col("height"), F.col("width"), F.col("channels"))
    rows = vector_images(spark, sf_dir).select("image_id", tensor.alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.select(
        "image_id",
        F.size("t").alias("length"),
        F.round(total, 3).alias("total"),
        F.round(F.array_max("t").cast("double"), 6).alias("high"),
    )


@query(
    """SELECT vec_id AS image_id, 64 AS length, true AS success,
      round(list_sum(px) / 255.0, 3) AS total FROM vector_pixels_v"""
)
def preprocess_images(spark, sf_dir):
    done = image_ops.preprocess_images(vector_images(spark, sf_dir), 8, 8, "nearest")
    total = F.aggregate("tensor", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return done.select(
        "image_id", F.size("tensor").alias("length"), "success", F.round(total, 3).alias("total")
    )


@query(
    """SELECT doc_id, len(words)::BIGINT * 4 AS actual_bytes, 2305 AS error_code
    FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents) WHERE len(words) * 4 > 800"""
)
def check_tensor_size(spark, sf_dir):
    """The word lengths of every whole document as a tensor of any size."""
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w).cast("float"))
    tensors = table(spark, sf_dir, "documents").select("doc_id", lengths.alias("tensor"))
    return quality.check_tensor_size(tensors, 800).drop("tensor")


def _fixed_model():
    weights = np.stack([np.arange(64) % 7 - 3, np.arange(64) % 5 - 2], axis=1).astype(np.float64)

    def predict(inputs: np.ndarray) -> np.ndarray:
        return inputs.astype(np.float64) @ weights

    return predict


_DOT = (
    "list_sum(list_transform(range(0, 64), "
    "lambda i: embedding[i + 1]::DOUBLE * (i % {m} - {o})::DOUBLE))"
)


@query(
    f"""SELECT vec_id, round({_DOT.format(m=7, o=3)}, 5) AS out_0, round({_DOT.format(m=5, o=2)}, 5) AS out_1
    FROM embeddings"""
)
def score(spark, sf_dir):
    from pyspark.sql.types import ArrayType, DoubleType

    scored = scoring.score(
        table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
        "embedding",
        _fixed_model,
        32,
        return_type=ArrayType(DoubleType()),
        input_tensor_shapes=[[64]],
    )
    return scored.select(
        "vec_id",
        F.round(F.col("result")[0], 5).alias("out_0"),
        F.round(F.col("result")[1], 5).alias("out_1"),
    )


@query("SELECT count(*) AS images, true AS consistent FROM embeddings")
def score_timed(spark, sf_dir):
    """Times differ from run to run; every row is in one batch, and the stages add up."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    timing = scoring.score_timed(vectors, "vec_id", "embedding", _fixed_model, 32)
    parts = F.col("preprocess_s") + F.col("execute_s") + F.col("postprocess_s")
    adds_up = (F.col("execute_s") > 0) & (F.abs(F.col("total_s") - parts) < 1e-9)
    return timing.agg(F.sum("images").cast("bigint").alias("images"), F.bool_and(adds_up).alias("consistent"))


@query("SELECT vec_id, len(embedding)::INT AS length, floor(embedding[64] * 1000)::BIGINT AS last FROM embeddings")
def decode_outputs(spark, sf_dir):
    @F.pandas_udf("binary")
    def encode(vectors):
        return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes())

    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", decode_output(encode("embedding")).alias("v")
    )
    return rows.select(
        "vec_id",
        F.size("v").alias("length"),
        F.floor(F.col("v")[63] * F.lit(1000.0).cast("float")).alias("last"),
    )


@query(
    """SELECT idx, result * 2 + 1 AS result, latency FROM preproc_v WHERE success"""
)
def pipeline_of_stages(spark, sf_dir):
    return scoring.pipeline_of(
        preprocessed(spark, sf_dir),
        [
            successful_only,
            lambda df: scoring.map_stages(df, "result", [lambda v: v * 2, lambda v: v + 1], "int"),
            lambda df: df.select("idx", "result", "latency"),
        ],
    )


def _tile_mean():
    def predict(tiles):
        return [[float(t.sum()), float(len(t))] for t in tiles]

    return predict


@query(
    """SELECT image_id, tile_id, x, y, num_tiles, list_sum(px)::DOUBLE AS total, 16.0::DOUBLE AS size
    FROM (SELECT vec_id AS image_id, (yi * 3 + xi)::INT AS tile_id, x, y, 9 AS num_tiles,
        list_transform(range(0, 16), lambda i: px[((y + i // 4) * 8 + x + i % 4 + 1)::INT]) AS px
      FROM vector_pixels_v,
        (VALUES (0, 0), (1, 3), (2, 4)) ys(yi, y), (VALUES (0, 0), (1, 3), (2, 4)) xs(xi, x))"""
)
def tiled_inference(spark, sf_dir):
    merged = scoring.tiled_inference(vector_images(spark, sf_dir), _tile_mean, 4, 0.25)
    return merged.select(
        "image_id",
        "tile_id",
        "x",
        "y",
        "num_tiles",
        F.col("result")[0].cast("double").alias("total"),
        F.col("result")[1].cast("double").alias("size"),
    )


def _png(pixels: np.ndarray) -> bytes:
    """A grey PNG file."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels)
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def image_files(spark, sf_dir) -> str:
    """Write the vectors as PNG files, 16 vectors below each other per file; the folder.

    The text writer stores the bytes of a value as they are, so the tasks write image files to
    any file system Spark can reach; decoders ignore the line end after the image.
    """

    @F.pandas_udf("binary")
    def encoded(data):
        return data.map(lambda raw: _png(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)))

    stacked = (
        vector_images(spark, sf_dir)
        .groupBy(F.floor(F.col("image_id") / 16).alias("image_id"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("image_id").alias("at"), "data"))).alias("v"))
        .select(
            "image_id",
            F.aggregate("v", F.lit(b""), lambda acc, e: F.concat(acc, e["data"])).alias("data"),
        )
    )
    path = scratch_path(spark, "images")
    files = stacked.select("image_id", encoded("data").cast("string").alias("value"))
    files.write.partitionBy("image_id").text(path)
    return path


def _image_id(path_column: str):
    return F.regexp_extract(path_column, r"image_id=(\d+)/", 1).cast("bigint").alias("image_id")


@query(
    f"""SELECT vec_id // 16 AS image_id, (8 * count(*))::INT AS height, 8 AS width, 1 AS channels,
      string_agg({_hex_sql('px')}, '' ORDER BY vec_id) AS bytes
    FROM vector_pixels_v GROUP BY vec_id // 16"""
)
def load_images(spark, sf_dir):
    decoded, _ = image_source.load_images(spark, [f"{image_files(spark, sf_dir)}/*"])
    return decoded.select(
        _image_id("origin"), "height", "width", "channels", F.hex("data").alias("bytes")
    )


@query("SELECT DISTINCT vec_id // 16 AS image_id FROM embeddings")
def scan_images(spark, sf_dir):
    found = image_source.scan_images(spark, [f"{image_files(spark, sf_dir)}/*"], (".TXT",))
    return found.filter("length > 0").select(_image_id("path"))


@query("SELECT count(*) AS results, sum(result)::BIGINT AS total, 0 AS failed FROM preproc_v WHERE success")
def on_result(spark, sf_dir):
    """The outcome rows of all tasks, summed by Spark."""
    good, _ = image_ops.split_failed(preprocessed(spark, sf_dir))
    outcome = scoring.on_result(good, lambda row: row.result)
    return outcome.agg(
        F.sum("delivered").alias("results"), F.sum("total").cast("bigint").alias("total"), F.sum("failed").cast("int").alias("failed")
    )


@query(
    """SELECT p_partkey AS spec, 'm' || p_partkey || '.om' AS model_path, i.image AS image_path, r.route
        AS route_type, CASE WHEN p_size % 2 = 0 THEN '6K' END AS image_size_tier, p_size AS iterations
    FROM part, (VALUES ('a.png'), ('b.png')) i(image),
      (VALUES ('tiled_route'), ('large_input_route')) r(route)
    WHERE p_size > 25 OR i.image = 'a.png'"""
)
def expand_experiments(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "experiments")
    part.select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".om")).alias("model"),
        F.when(F.col("p_size") <= 25, "a.png").alias("image"),
        F.when(F.col("p_size") > 25, F.array(F.lit("a.png"), F.lit("b.png"))).alias("images"),
        F.array(F.lit("tiled_route"), F.lit("large_input_route")).alias("routes"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("6K"))).alias("image_size_tiers"),
        F.col("p_size").alias("iterations"),
        F.col("p_partkey").cast("int").alias("device"),
    ).write.json(path)
    specs = config_source.experiment_lists(
        spark.read.schema(config_source.EXPERIMENT_SCHEMA).json(path)
    )
    return config_source.expand_experiments(specs).select(
        F.col("device").cast("bigint").alias("spec"),
        "model_path",
        "image_path",
        "route_type",
        "image_size_tier",
        "iterations",
    )
