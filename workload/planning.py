"""Planning, registry and data-quality family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens import dims
from runlens.functions import (
    estimate_tiles,
    fps_per_mpix,
    overlap_ratio,
    pixels,
    theoretical_speedup,
    unit_theoretical_speedup,
)
from runlens.operators import quality
from runlens.operators.compare import ordered_distinct as ordered_distinct_op
from runlens.plans import matrix, registry, strategies
from workload.base import VIEWS, query, table

MODELS = ["small.om", "large.om"]


def part_images(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("image_path")
    )


VIEWS["part_images_v"] = "SELECT 'img/' || p_partkey || '.png' AS image_path FROM part"


@query(
    """SELECT image_path, model_no, model_path, tier_no, input_tier, runtime_resolution
    FROM part_images_v, (VALUES (0, 'small.om'), (1, 'large.om')) m(model_no, model_path),
      (VALUES (0, '720p', '640x640'), (1, '1080p', '1k2k'), (2, '4K', '4k6k'))
        t(tier_no, input_tier, runtime_resolution)"""
)
def build_matrix(spark, sf_dir):
    return matrix.build_matrix(part_images(spark, sf_dir), MODELS)


@query(
    """SELECT image_path, model_no, model_path, size_no, image_size_tier, route_no, route_type,
      CASE WHEN route_type = 'large_input_route' THEN lower(image_size_tier) END AS runtime_resolution
    FROM part_images_v, (VALUES (0, 'small.om'), (1, 'large.om')) m(model_no, model_path),
      (VALUES (0, '4K'), (1, '6K')) s(size_no, image_size_tier),
      (VALUES (0, 'tiled_route'), (1, 'large_input_route')) r(route_no, route_type)"""
)
def build_route_matrix(spark, sf_dir):
    return matrix.build_route_matrix(part_images(spark, sf_dir), MODELS, ["4K", "6K"])


@query(
    """SELECT page_id, copy, resolution,
      (CASE WHEN instr(name, '.') > 1 THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END)
        || '_' || copy || '_' || resolution
        || (CASE WHEN instr(name, '.') > 1 THEN regexp_extract(name, '\\.[^.]*$') ELSE '.jpg' END)
        AS output_name
    FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages),
      (VALUES (1), (2)) c(copy), (VALUES ('1k'), ('6k')) r(resolution)""".replace("\\\\", "\\")
)
def augment_matrix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    rows = matrix.augment_matrix(pages, ["1k", "6k", "9k"], 2)
    return rows.drop("path")


VIEWS["plan_v"] = """
SELECT o_orderkey AS plan_id, o_custkey AS owner_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'multithread' WHEN 1 THEN 'batch' WHEN 2 THEN 'pipeline'
    WHEN 3 THEN 'memory_pool' WHEN 4 THEN 'high_res' WHEN 5 THEN 'high_res_tiling' ELSE 'unknown' END
    AS strategy,
  CASE o_custkey % 3 WHEN 0 THEN 'tiled_route' WHEN 1 THEN 'large_input_route' END AS route_type,
  CAST(o_custkey % 9 AS INT) AS threads, CAST(o_custkey % 17 AS INT) AS batch_size
FROM orders"""


def _pick(number, names):
    chosen = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        chosen = F.when(number == i, name).otherwise(chosen)
    return chosen


def plan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("plan_id"),
        F.col("o_custkey").alias("owner_id"),
        _pick(
            F.col("o_orderkey") % 7,
            ["multithread", "batch", "pipeline", "memory_pool", "high_res", "high_res_tiling", "unknown"],
        ).alias("strategy"),
        _pick(F.col("o_custkey") % 3, ["tiled_route", "large_input_route", None]).alias("route_type"),
        (F.col("o_custkey") % 9).cast("int").alias("threads"),
        (F.col("o_custkey") % 17).cast("int").alias("batch_size"),
    )


VIEWS["unit_v"] = """
SELECT *, CASE WHEN strategy = 'high_res' THEN 'high_res_tiling' ELSE strategy END AS unit FROM plan_v"""


@query("SELECT plan_id, strategy, unit FROM unit_v")
def resolve_aliases(spark, sf_dir):
    return strategies.resolve_aliases(plan(spark, sf_dir)).select("plan_id", "strategy", "unit")


@query(
    """SELECT plan_id, CASE unit WHEN 'multithread' THEN threads WHEN 'batch' THEN batch_size
      WHEN 'pipeline' THEN threads + 1 WHEN 'memory_pool' THEN 1.1 WHEN 'high_res_tiling' THEN 1 END::DOUBLE
      AS theoretical,
      CASE unit WHEN 'multithread' THEN threads WHEN 'pipeline' THEN greatest(1, threads + 2) END::DOUBLE
      AS by_unit
    FROM unit_v"""
)
def theoretical_speedups(spark, sf_dir):
    rows = strategies.resolve_aliases(plan(spark, sf_dir))
    unit, threads = F.col("unit"), F.col("threads")
    return rows.select(
        "plan_id",
        theoretical_speedup(unit, threads, F.col("batch_size")).alias("theoretical"),
        unit_theoretical_speedup(unit, threads, threads, F.lit(1), F.lit(1))
        .alias("by_unit"),
    )


@query(
    """SELECT plan_id, route_type, strategy NOT IN ('high_res', 'high_res_tiling') OR route_type IS NULL
      OR route_type = 'tiled_route' AS supported
    FROM plan_v"""
)
def supports_route(spark, sf_dir):
    rows = strategies.resolve_aliases(plan(spark, sf_dir))
    routes = F.when(F.col("unit") == "high_res_tiling", F.array(F.lit("tiled_route"))).otherwise(
        F.array().cast("array<string>")
    )
    return rows.select(
        "plan_id",
        "route_type",
        strategies.supports_route(routes, F.col("route_type")).alias("supported"),
    )


@query(
    """SELECT owner_id, strategy, min(plan_id) AS first_position FROM plan_v
    GROUP BY owner_id, strategy"""
)
def ordered_distinct(spark, sf_dir):
    return ordered_distinct_op(plan(spark, sf_dir), ["owner_id"], "strategy", "plan_id")


VIEWS["owner_names_v"] = """
SELECT owner_id, any_value(route_type) AS route_type,
  string_agg(strategy, ',' ORDER BY first_position) AS names
FROM (SELECT owner_id, route_type, strategy, min(plan_id) AS first_position FROM plan_v
  GROUP BY owner_id, route_type, strategy) GROUP BY owner_id"""


def owner_names(spark, sf_dir):
    """Distinct strategy names of every owner; made distinct first, so a list has at most 7."""
    found = ordered_distinct_op(plan(spark, sf_dir), ["owner_id", "route_type"], "strategy", "plan_id")
    return found.groupBy("owner_id", "route_type").agg(
        F.array_sort(F.collect_list(F.struct("first_position", "strategy"))).alias("_n")
    ).select("owner_id", "route_type", F.col("_n.strategy").alias("names"))


@query(
    """SELECT owner_id, names,
      (names LIKE '%unknown%')::INT + (CASE WHEN route_type = 'large_input_route'
        THEN len(list_filter(string_split(names, ','), lambda x: x LIKE 'high_res%')) ELSE 0 END)::INT
        AS error_count,
      NOT (names LIKE '%unknown%') AND NOT (coalesce(route_type, '') = 'large_input_route'
        AND names LIKE '%high_res%') AS is_valid,
      array_to_string(list_sort(list_distinct(list_filter(string_split(
        replace(replace(names, 'high_res_tiling', 'high_res'), 'high_res', 'high_res_tiling'), ','),
        lambda x: x <> 'unknown'))), ',') AS normalized
    FROM owner_names_v"""
)
def validate_strategies(spark, sf_dir):
    checked = strategies.validate_strategies(owner_names(spark, sf_dir))
    return checked.select(
        "owner_id",
        F.array_join("names", ",").alias("names"),
        F.size("errors").alias("error_count"),
        "is_valid",
        F.array_join(F.array_sort("normalized"), ",").alias("normalized"),
    )


@query(
    """SELECT plan_id, unit AS strategy, route_type FROM unit_v
    WHERE unit <> 'unknown' AND (unit <> 'high_res_tiling' OR route_type IS NULL
      OR route_type = 'tiled_route')"""
)
def expand_valid_strategies(spark, sf_dir):
    rows = strategies.expand_valid_strategies(plan(spark, sf_dir))
    return rows.select("plan_id", "strategy", "route_type")


# Registry tables.

VIEWS["models_v"] = """
SELECT 'm' || p_partkey AS name, p_size > 5 AS has_720, p_size % 2 = 0 AS has_1080,
  p_retailprice > 1500 AS has_4k, p_size = 48 AS zero_width, p_brand <> 'Brand#11' AS tiled,
  p_size < 45 AS large
FROM part"""


def models(spark, sf_dir):
    def spec(tier, width, height):
        return F.struct(
            F.lit(tier).alias("tier"),
            (width if not isinstance(width, int) else F.lit(width)).alias("width"),
            F.lit(height).alias("height"),
            F.lit(3).alias("channels"),
        )

    size = F.col("p_size")
    wide = F.when(size == 48, 0).otherwise(4096)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"),
        F.array_compact(
            F.array(
                F.when(size > 5, spec("720p", 1280, 720)),
                F.when(size % 2 == 0, spec("1080p", 1920, 1080)),
                F.when(F.col("p_retailprice") > 1500, spec("4K", wide, 4096)),
            )
        ).alias("input_specs"),
        F.array_compact(
            F.array(
                F.when(F.col("p_brand") != "Brand#11", "tiled_route"),
                F.when(size < 45, "large_input_route"),
            )
        ).alias("supported_routes"),
    )


VIEWS["devices_v"] = """
SELECT 'd' || s_suppkey AS name,
  CASE s_nationkey % 3 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' ELSE '8K' END AS tier,
  CASE s_nationkey % 2 WHEN 0 THEN 'tiled_route' ELSE 'large_input_route' END AS route_type
FROM supplier"""


def devices(spark, sf_dir):
    nation = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("name"),
        F.array(_pick(nation % 3, ["720p", "1080p", "8K"])).alias("supported_tiers"),
        F.array(_pick(nation % 2, ["tiled_route", "large_input_route"])).alias("supported_routes"),
    )


VIEWS["scenarios_v"] = """
SELECT o_orderkey AS scenario_id, 's' || o_orderkey % 14000 AS name,
  'm' || (o_orderkey % 2200 + 1) AS model_name,
  CASE o_custkey % 4 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' WHEN 2 THEN '4K' ELSE '8K' END AS input_tier,
  CASE o_orderkey % 2 WHEN 0 THEN 'tiled_route' ELSE 'large_input_route' END AS route_type
FROM orders"""


def scenarios(spark, sf_dir):
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("scenario_id"),
        F.concat(F.lit("s"), (key % 14000).cast("string")).alias("name"),
        F.concat(F.lit("m"), (key % 2200 + 1).cast("string")).alias("model_name"),
        _pick(owner % 4, ["720p", "1080p", "4K", "8K"]).alias("input_tier"),
        _pick(key % 2, ["tiled_route", "large_input_route"]).alias("route_type"),
    )


VIEWS["judged_v"] = """
SELECT s.*, CASE WHEN input_tier = '8K' THEN 'unsupported input tier'
  WHEN m.name IS NULL THEN 'unknown model'
  WHEN NOT (CASE WHEN route_type = 'tiled_route' THEN tiled ELSE large END)
    THEN 'model does not support route'
  WHEN NOT (CASE input_tier WHEN '720p' THEN has_720 WHEN '1080p' THEN has_1080 ELSE has_4k END)
    THEN 'model has no spec for tier' END AS violation,
  CASE input_tier WHEN '720p' THEN 1280 WHEN '1080p' THEN 1920
    ELSE CASE WHEN zero_width THEN 0 ELSE 4096 END END AS width
FROM scenarios_v s LEFT JOIN models_v m ON s.model_name = m.name"""


@query(
    """SELECT scenario_id, model_name, input_tier, route_type, width FROM judged_v
    WHERE violation IS NULL"""
)
def build_tasks(spark, sf_dir):
    tasks, _ = registry.build_tasks(scenarios(spark, sf_dir), models(spark, sf_dir))
    return tasks.select(
        "scenario_id", "model_name", "input_tier", "route_type", F.col("input_spec.width").alias("width")
    )


@query("SELECT scenario_id, violation FROM judged_v WHERE violation IS NOT NULL")
def task_violations(spark, sf_dir):
    _, bad = registry.build_tasks(scenarios(spark, sf_dir), models(spark, sf_dir))
    return bad.select("scenario_id", "violation")


@query(
    """SELECT scenario_id, coalesce(devices, 0) AS devices, devices IS NOT NULL AS supported
    FROM scenarios_v LEFT JOIN (SELECT tier, route_type, count(*) AS devices FROM devices_v
      WHERE tier <> '8K' GROUP BY ALL) d
      ON input_tier = d.tier AND scenarios_v.route_type = d.route_type"""
)
def device_capability(spark, sf_dir):
    found = registry.device_capability(scenarios(spark, sf_dir), devices(spark, sf_dir))
    return found.select("scenario_id", "devices", "supported")


@query("SELECT name, tier, route_type FROM devices_v")
def device_support(spark, sf_dir):
    return registry.device_support(devices(spark, sf_dir))


@query(
    "SELECT name, count(*) AS registrations FROM scenarios_v GROUP BY name HAVING count(*) > 1"
)
def registry_duplicates(spark, sf_dir):
    return registry.registry_duplicates(scenarios(spark, sf_dir))


@query(
    """SELECT 'model' AS kind, name, 'at least one input spec is required' AS violation FROM models_v
      WHERE NOT (has_720 OR has_1080 OR has_4k)
    UNION ALL SELECT 'model', name, 'at least one supported route is required' FROM models_v
      WHERE NOT (tiled OR large)
    UNION ALL SELECT 'model', name, 'width must be positive' FROM models_v
      WHERE has_4k AND zero_width
    UNION ALL SELECT 'device', name, 'unsupported input tier' FROM devices_v WHERE tier = '8K'
    UNION ALL SELECT 'scenario', name, 'unsupported input tier' FROM scenarios_v
      WHERE input_tier = '8K'"""
)
def validate_registry(spark, sf_dir):
    return registry.validate_registry(
        models(spark, sf_dir), devices(spark, sf_dir), scenarios(spark, sf_dir)
    )


# Data quality.

VIEWS["configs_v"] = """
SELECT o_orderkey AS config_id, CAST(o_orderkey % 7 - 1 AS INT) AS device_id,
  CAST(o_custkey % 21 AS INT) AS num_threads,
  CASE o_orderkey % 4 WHEN 0 THEN 'pil' WHEN 1 THEN 'opencv' WHEN 2 THEN 'cv2' ELSE 'other' END AS backend,
  CASE o_orderkey % 5 WHEN 0 THEN '640x640' WHEN 1 THEN '1k2k' WHEN 2 THEN '4k6k' WHEN 3 THEN '6k'
    ELSE 'bad' END AS resolution,
  CASE o_custkey % 4 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' WHEN 2 THEN '4K' ELSE '8K' END AS input_tier,
  CASE o_orderkey % 3 WHEN 0 THEN 'tiled_route' WHEN 1 THEN 'large_input_route' ELSE 'other' END
    AS route_type,
  CAST((o_orderkey % 41) * 64 AS INT) AS tile_size, CAST(o_custkey % 700 - 20 AS INT) AS overlap,
  o_orderkey % 2 = 0 AS multithread_on, o_orderkey % 3 = 0 AS batch_on, o_orderkey % 5 = 0 AS pipeline_on,
  o_orderkey % 11 = 0 AS high_res_on,
  CAST(o_custkey % 40 AS INT) AS batch_size, CAST(o_orderkey % 12 - 1 AS DOUBLE) AS timeout_ms,
  CAST(o_custkey % 11 AS DOUBLE) / 8 AS conf_threshold
FROM orders"""


def configs(spark, sf_dir):
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("config_id"),
        (key % 7 - 1).cast("int").alias("device_id"),
        (owner % 21).cast("int").alias("num_threads"),
        _pick(key % 4, ["pil", "opencv", "cv2", "other"]).alias("backend"),
        _pick(key % 5, ["640x640", "1k2k", "4k6k", "6k", "bad"]).alias("resolution"),
        _pick(owner % 4, ["720p", "1080p", "4K", "8K"]).alias("input_tier"),
        _pick(key % 3, ["tiled_route", "large_input_route", "other"]).alias("route_type"),
        (key % 41 * 64).cast("int").alias("tile_size"),
        (owner % 700 - 20).cast("int").alias("overlap"),
        (key % 2 == 0).alias("multithread_on"),
        (key % 3 == 0).alias("batch_on"),
        (key % 5 == 0).alias("pipeline_on"),
        (key % 11 == 0).alias("high_res_on"),
        (owner % 40).cast("int").alias("batch_size"),
        (key % 12 - 1).cast("double").alias("timeout_ms"),
        ((owner % 11).cast("double") / 8).alias("conf_threshold"),
    )


VIEWS["full_configs_v"] = """
SELECT *, CASE config_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'm.onnx' WHEN 2 THEN NULL ELSE 'm.om' END AS model_path,
  CAST(config_id % 8 - 1 AS INT) AS multithread_threads, CAST(config_id % 130 AS INT) AS queue_size,
  config_id % 4 = 1 AS memory_pool_on, CAST(config_id % 3 AS INT) AS pool_size,
  CAST(config_id % 7 - 2 AS INT) AS max_buffers, CAST(config_id % 200 AS INT) AS high_res_tile_size,
  CAST(config_id % 150 - 9 AS INT) AS high_res_overlap,
  CASE config_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'xml' WHEN 2 THEN 'json' ELSE 'text' END AS report_format,
  CAST(config_id % 13 AS DOUBLE) / 8 - 0.25 AS iou_threshold,
  CASE config_id % 9 WHEN 0 THEN 'base' WHEN 1 THEN 'high_res' WHEN 2 THEN NULL ELSE 'turbo' END AS mode,
  CAST(config_id % 10 - 3 AS INT) AS iterations, CASE WHEN config_id % 17 = 0 THEN NULL
    ELSE CAST(config_id % 6 - 2 AS INT) END AS warmup
FROM configs_v"""


def full_configs(spark, sf_dir):
    """Configurations with every column a rule reads."""
    key = F.col("config_id")

    def whole(column):
        return column.cast("int")

    return configs(spark, sf_dir).select(
        "*",
        F.when(key % 6 == 0, "").when(key % 6 == 1, "m.onnx").when(key % 6 != 2, "m.om").alias("model_path"),
        whole(key % 8 - 1).alias("multithread_threads"),
        whole(key % 130).alias("queue_size"),
        (key % 4 == 1).alias("memory_pool_on"),
        whole(key % 3).alias("pool_size"),
        whole(key % 7 - 2).alias("max_buffers"),
        whole(key % 200).alias("high_res_tile_size"),
        whole(key % 150 - 9).alias("high_res_overlap"),
        _pick(key % 5, ["", "xml", "json", "text", "text"]).alias("report_format"),
        ((key % 13).cast("double") / 8 - 0.25).alias("iou_threshold"),
        F.when(key % 9 == 0, "base").when(key % 9 == 1, "high_res").when(key % 9 != 2, "turbo").alias("mode"),
        whole(key % 10 - 3).alias("iterations"),
        F.when(key % 17 != 0, whole(key % 6 - 2)).alias("warmup"),
    )


@query(
    """SELECT config_id, concat_ws(',', CASE WHEN multithread_on THEN 'multithread' END,
      CASE WHEN batch_on THEN 'batch' END, CASE WHEN pipeline_on THEN 'pipeline' END,
      CASE WHEN high_res_on THEN 'high_res' END) AS enabled,
      concat_ws(',', CASE WHEN multithread_on THEN 'multithread' END,
      CASE WHEN batch_on THEN 'batch' END, CASE WHEN pipeline_on THEN 'pipeline' END,
      CASE WHEN high_res_on THEN 'high_res_tiling' END) AS units,
      multithread_on OR batch_on OR pipeline_on OR high_res_on AS any_enabled
    FROM configs_v"""
)
def enabled_strategies(spark, sf_dir):
    rows = quality.with_enabled_strategies(configs(spark, sf_dir))
    flags = {n: F.col(f"{n}_on") for n in ("multithread", "batch", "pipeline", "high_res")}
    return rows.select(
        "config_id",
        F.array_join("enabled", ",").alias("enabled"),
        F.array_join(strategies.enabled_strategies(flags, as_units=True), ",").alias("units"),
        "any_enabled",
    )


_KNOWN = ", ".join(f"'{r}'" for r in dims.RESOLUTIONS)


@query(
    f"""SELECT config_id, column_name, error_code, value FROM (
      SELECT config_id, 'device_id' AS column_name, 3021 AS error_code, device_id::VARCHAR AS value
        FROM configs_v WHERE device_id NOT BETWEEN 0 AND 3
      UNION ALL SELECT config_id, 'num_threads', 3021, num_threads::VARCHAR FROM configs_v
        WHERE num_threads NOT BETWEEN 1 AND 8
      UNION ALL SELECT config_id, 'backend', 3030, backend FROM configs_v
        WHERE backend NOT IN ('pil', 'opencv')
      UNION ALL SELECT config_id, 'resolution', 3030, resolution FROM configs_v
        WHERE resolution NOT IN ({_KNOWN})
      UNION ALL SELECT config_id, 'batch_size', 3022, batch_size::VARCHAR FROM configs_v
        WHERE batch_size < 1
      UNION ALL SELECT config_id, 'mode', 3030, mode FROM full_configs_v
        WHERE mode IS NULL OR mode NOT IN ('base', 'multithread', 'high_res')
      UNION ALL SELECT config_id, 'iterations', 3022, iterations::VARCHAR FROM full_configs_v WHERE iterations < 1
      UNION ALL SELECT config_id, 'queue_size', 3022, queue_size::VARCHAR FROM full_configs_v WHERE queue_size < 1
      UNION ALL SELECT config_id, 'warmup', 3021, warmup::VARCHAR FROM full_configs_v
        WHERE warmup IS NULL OR warmup < 0)"""
)
def check_values(spark, sf_dir):
    rules = [
        quality.device_id(),
        quality.thread_count(),
        quality.image_backend(),
        quality.supported_resolution(),
        quality.batch_size(),
        quality.inference_mode(),
        quality.iterations(),
        quality.positive_integer("queue_size"),
        quality.warmup(),
    ]
    found = quality.check_values(full_configs(spark, sf_dir), ["config_id"], rules)
    return found.select("config_id", "column_name", "error_code", "value")


def _listed(cases):
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in cases) + ")"


_EVALUABLE = "input_tier <> '8K' AND route_type <> 'other'"
_WANTED = "CASE input_tier WHEN '720p' THEN '640x640' WHEN '1080p' THEN '1k2k' ELSE '4k6k' END"
_USED = "CASE WHEN resolution = 'bad' THEN '640x640' ELSE resolution END"


_RECOMMENDED = ", ".join(dims.RECOMMENDED_RESOLUTIONS)
_TIERS, _ROUTES = ", ".join(dims.TIERS), ", ".join(dims.ROUTES)


@query(
    f"""SELECT config_id, {_listed([
        ("device_id < 0", "device_id below 0"),
        ("num_threads < 1", "num_threads below 1"),
        ("tile_size < 64", "tile_size below 64"),
        ("overlap < 0", "overlap below 0"),
        ("multithread_on AND multithread_threads < 1", "multithread_threads below 1"),
        ("batch_on AND batch_size < 1", "batch_size below 1"),
        ("batch_on AND timeout_ms < 0", "timeout_ms below 0"),
        ("pipeline_on AND queue_size < 1", "queue_size below 1"),
        ("memory_pool_on AND pool_size < 1", "pool_size below 1"),
        ("memory_pool_on AND max_buffers < 1", "max_buffers below 1"),
        ("high_res_on AND high_res_tile_size < 64", "high_res_tile_size below 64"),
        ("high_res_on AND high_res_overlap < 0", "high_res_overlap below 0"),
        ("coalesce(model_path, '') = ''", "model_path is empty"),
        ("backend = 'other'", "backend not in opencv, pil, cv2"),
        ("overlap >= tile_size", "overlap not below tile_size"),
        ("high_res_on AND high_res_overlap >= high_res_tile_size", "high_res_overlap not below high_res_tile_size"),
        ("input_tier = '8K'", f"input_tier not in {_TIERS}"),
        ("input_tier <> '8K' AND route_type = 'other'", f"route_type not in {_ROUTES}"),
        (f"{_EVALUABLE} AND report_format = ''", "report_format is empty"),
        (f"{_EVALUABLE} AND report_format = 'xml'", "report_format not in text, json, markdown"),
        (f"{_EVALUABLE} AND {_WANTED} <> {_USED}", "resolution is not that of input_tier"),
    ])} AS errors, {_listed([
        ("device_id > 3", "device_id above 3"),
        ("num_threads > 4", "num_threads above 4"),
        ("tile_size > 2048", "tile_size above 2048"),
        ("multithread_on AND multithread_threads > 4", "multithread_threads above 4"),
        ("batch_on AND batch_size > 32", "batch_size above 32"),
        ("pipeline_on AND queue_size > 100", "queue_size above 100"),
        ("model_path = 'm.onnx'", "model_path without .om"),
        ("resolution <> '640x640'", f"resolution not in {_RECOMMENDED}"),
        ("multithread_on AND pipeline_on", "multithread and pipeline are both on"),
    ])} AS warnings, '' AS unchecked FROM full_configs_v"""
)
def validate_configs(spark, sf_dir):
    return quality.validate_configs(full_configs(spark, sf_dir)).select(
        "config_id", *[F.array_join(c, "; ").alias(c) for c in ("errors", "warnings", "unchecked")]
    )


@query(
    f"""SELECT config_id, errors, errors = '' AS is_valid FROM (SELECT config_id, {_listed([
        ("device_id < 0", "device_id below 0"),
        ("num_threads < 1", "num_threads below 1"),
        ("num_threads > 4", "num_threads above 4"),
        ("conf_threshold > 1", "conf_threshold above 1"),
        ("iou_threshold < 0", "iou_threshold below 0"),
        ("iou_threshold > 1", "iou_threshold above 1"),
        ("resolution = 'bad'", f"resolution not in {', '.join(dims.RESOLUTIONS)}"),
        ("backend NOT IN ('pil', 'opencv')", "backend not in pil, opencv"),
    ])} AS errors FROM full_configs_v)"""
)
def validate_configs_command(spark, sf_dir):
    checked = quality.validate_configs(full_configs(spark, sf_dir), quality.COMMAND_RULES)
    return checked.select("config_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query(
    r"""SELECT page_id, path, CASE WHEN path LIKE '../%' THEN 3002 ELSE 3005 END AS error_code
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '../' || host WHEN 1 THEN 'a/../b/' || host
        ELSE './c/' || host END AS path
      FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages))
    WHERE path LIKE '../%' OR NOT path LIKE '%.com'"""
)
def check_paths(spark, sf_dir):
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    number = F.col("page_id") % 3
    prefix = F.when(number == 0, "../").when(number == 1, "a/../b/").otherwise("./c/")
    paths = table(spark, sf_dir, "pages").select("page_id", F.concat(prefix, host).alias("path"))
    return quality.check_paths(paths, "/data/run", [".COM"])


# Image sizes.

VIEWS["images_v"] = """
SELECT p_partkey AS image_id, CAST(640 + p_size * 40 AS INT) AS width,
  CAST(480 + (p_partkey % 37) * 60 AS INT) AS height, 3 AS channels,
  CASE p_size % 3 WHEN 0 THEN '720p' WHEN 1 THEN '1080p' ELSE '4K' END AS tier,
  CASE p_size % 4 WHEN 0 THEN '1k' WHEN 1 THEN '6k' WHEN 2 THEN '2k4k' ELSE 'bad' END AS resolution
FROM part"""


def images(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"),
        (640 + size * 40).cast("int").alias("width"),
        (480 + (F.col("p_partkey") % 37) * 60).cast("int").alias("height"),
        F.lit(3).alias("channels"),
        _pick(size % 3, ["720p", "1080p", "4K"]).alias("tier"),
        _pick(size % 4, ["1k", "6k", "2k4k", "bad"]).alias("resolution"),
    )


@query(
    """SELECT image_id, tier, CASE tier WHEN '720p' THEN '640x640' WHEN '1080p' THEN '1k2k'
        ELSE '4k6k' END AS tier_resolution,
      coalesce(r.width, 640) AS resolution_width, coalesce(r.height, 640) AS resolution_height
    FROM images_v LEFT JOIN resolutions_v r USING (resolution)"""
)
def tier_and_resolution(spark, sf_dir):
    resolution = F.col("resolution")
    return images(spark, sf_dir).select(
        "image_id",
        "tier",
        dims.tier_resolution(F.col("tier")).alias("tier_resolution"),
        dims.resolution_width(resolution).alias("resolution_width"),
        dims.resolution_height(resolution).alias("resolution_height"),
    )


@query("SELECT image_id, resolution FROM images_v SEMI JOIN resolutions_v USING (resolution)")
def supported_resolutions(spark, sf_dir):
    known = dims.is_supported_resolution(F.col("resolution"))
    return images(spark, sf_dir).filter(known).select("image_id", "resolution")


@query(
    """SELECT image_id, width::BIGINT * height AS pixels, 30 / (width::BIGINT * height / 1e6) AS fps_per_mpix,
      CASE WHEN height % 200 > 1 THEN (height % 200) / 640 ELSE height % 200 END::DOUBLE AS overlap_ratio,
      greatest(1, (width - 160 + 479) // 480)::BIGINT * greatest(1, (height - 160 + 479) // 480) AS tiles
    FROM images_v"""
)
def image_measures(spark, sf_dir):
    width, height = F.col("width"), F.col("height")
    return images(spark, sf_dir).select(
        "image_id",
        pixels(width, height).alias("pixels"),
        fps_per_mpix(F.lit(30.0), width, height).alias("fps_per_mpix"),
        overlap_ratio(height % 200, F.lit(640)).alias("overlap_ratio"),
        estimate_tiles(width, height, 640, 0.25).alias("tiles"),
    )


@query(
    """SELECT image_id, expected_bytes, CASE WHEN input_bytes <> expected_bytes THEN 3120 ELSE 3121 END
      AS error_code
    FROM (SELECT *, width::BIGINT * height * channels * CASE element_type WHEN 'float32' THEN 4
        WHEN 'float16' THEN 2 ELSE 1 END AS expected_bytes
      FROM (SELECT *, CASE WHEN tier = '720p' THEN 'float32' WHEN tier = '1080p' THEN 'float16'
          ELSE 'odd' END AS element_type, width::BIGINT * height * 12 AS input_bytes,
        CASE WHEN height > 2000 THEN width + 1 ELSE width END AS model_width FROM images_v))
    WHERE input_bytes <> expected_bytes OR model_width <> width"""
)
def input_mismatch(spark, sf_dir):
    declared = images(spark, sf_dir).select(
        "*",
        F.when(F.col("tier") == "720p", "float32")
        .when(F.col("tier") == "1080p", "float16")
        .otherwise("odd")
        .alias("element_type"),
        (F.col("width").cast("bigint") * F.col("height") * 12).alias("input_bytes"),
        (F.col("width") + (F.col("height") > 2000).cast("int")).alias("model_width"),
        F.col("height").alias("model_height"),
    )
    return quality.input_mismatch(declared).select("image_id", "expected_bytes", "error_code")
