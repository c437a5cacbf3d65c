"""Run configurations, experiment specs and registry documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default run configuration.
CONFIG_DEFAULTS = {
    "model_path": "models/yolov8s.om",
    "device_id": 0,
    "resolution": "640x640",
    "tile_size": 640,
    "overlap": 100,
    "num_threads": 4,
    "backend": "pil",
    "conf_threshold": 0.4,
    "iou_threshold": 0.5,
    "max_detections": 100,
    "enable_logging": True,
    "log_level": "info",
    "enable_profiling": False,
    "warmup": 5,
    "warmup_iterations": 5,
    "strategies": {
        "multithread": {
            "enabled": False,
            "num_threads": 4,
            "work_stealing": True,
            "dynamic_scaling": False,
            "min_threads": 1,
            "max_threads": 4,
            "scale_up_threshold": 0.7,
            "scale_down_threshold": 0.2,
        },
        "batch": {
            "enabled": False,
            "batch_size": 4,
            "timeout_ms": 10.0,
            "dynamic_batch": False,
            "max_batch_size": 16,
        },
        "pipeline": {
            "enabled": False,
            "queue_size": 10,
            "num_preprocess_threads": 2,
            "num_infer_threads": 1,
            "num_postprocess_threads": 1,
            "batch_size": 4,
        },
        "memory_pool": {
            "enabled": False,
            "pool_size": 10,
            "growth_factor": 1.5,
            "max_buffers": 20,
            "device": "host",
        },
        "high_res": {
            "enabled": False,
            "tile_size": 640,
            "overlap": 100,
            "weight_fusion": True,
            "overlap_ratio": 0.25,
        },
        "async_io": {"enabled": False, "prefetch_size": 5, "num_workers": 2},
        "cache": {"enabled": False, "max_size": 100, "ttl_seconds": 300.0},
    },
    "benchmark": {
        "iterations": 100,
        "warmup": 5,
        "enable_profiling": True,
        "enable_monitoring": True,
        "output_format": "text",
        "output_path": None,
    },
    "model_info": {
        "collect_input_size": True,
        "collect_output_size": True,
        "collect_params": False,
        "collect_flops": False,
    },
    "evaluation": {
        "input_tier": "720p",
        "route_type": "tiled_route",
        "report_format": "text",
        "archive_enabled": False,
    },
}

_TYPES = {bool: T.BooleanType(), int: T.IntegerType(), float: T.DoubleType(), str: T.StringType()}


def _schema(defaults: dict) -> T.StructType:
    return T.StructType(
        [
            T.StructField(
                name,
                _schema(value) if isinstance(value, dict) else _TYPES.get(type(value), T.StringType()),
            )
            for name, value in defaults.items()
        ]
    )


CONFIG_SCHEMA = _schema(CONFIG_DEFAULTS)


def _filled(column, defaults: dict):
    """The struct with the default of every key that is absent."""
    fields = []
    for name, value in defaults.items():
        current = column[name]
        if isinstance(value, dict):
            fields.append(_filled(current, value).alias(name))
        else:
            default = F.lit(value).cast(_TYPES.get(type(value), T.StringType()))
            fields.append(F.coalesce(current, default).alias(name))
    return F.struct(*fields)


def read_run_configs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per JSON document: ``path``, ``unreadable`` and all settings with defaults.

    A document that is not valid JSON yields a row of defaults. One file is one document, so
    a file is read whole and never split; files are spread over tasks.
    """
    schema = T.StructType(CONFIG_SCHEMA.fields + [T.StructField("_corrupt", T.StringType())])
    read = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    unreadable = F.col("_corrupt").isNotNull()
    readable = [F.when(~unreadable, F.col(n)).alias(n) for n in CONFIG_DEFAULTS]
    return with_config_defaults(read.select("path", unreadable.alias("unreadable"), *readable))


def with_config_defaults(df: DataFrame) -> DataFrame:
    """Fill every absent setting of parsed configurations (any JSON layout) with its default."""
    others = [c for c in df.columns if c not in CONFIG_DEFAULTS]
    document = F.struct(*[F.col(n) for n in CONFIG_DEFAULTS])
    filled = df.select(*others, _filled(document, CONFIG_DEFAULTS).alias("_c"))
    return filled.select(*others, "_c.*")


def flat_configs(configs: DataFrame) -> DataFrame:
    """The columns the configuration rules read, from typed configurations."""
    s = "strategies"
    return configs.select(
        *[c for c in configs.columns if c not in ("strategies", "benchmark", "model_info", "evaluation")],
        *[F.col(f"{s}.{n}.enabled").alias(f"{n}_on") for n in CONFIG_DEFAULTS[s]],
        F.col(f"{s}.multithread.num_threads").alias("multithread_threads"),
        F.col(f"{s}.batch.batch_size").alias("batch_size"),
        F.col(f"{s}.batch.timeout_ms").alias("timeout_ms"),
        F.col(f"{s}.pipeline.queue_size").alias("queue_size"),
        F.col(f"{s}.memory_pool.pool_size").alias("pool_size"),
        F.col(f"{s}.memory_pool.max_buffers").alias("max_buffers"),
        F.col(f"{s}.high_res.tile_size").alias("high_res_tile_size"),
        F.col(f"{s}.high_res.overlap").alias("high_res_overlap"),
        "evaluation.*",
    )


EXPERIMENT_SCHEMA = (
    "models array<string>, images array<string>, model string, image string, "
    "input_tiers array<string>, routes array<string>, image_size_tiers array<string>, "
    "strategies array<string>, iterations int, warmup int, threads int, batch_size int, "
    "device int, backend string, output string"
)


def read_experiment_specs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Experiment documents with their list options; a single model or image is a list of one."""
    read = spark.read.schema(EXPERIMENT_SCHEMA).option("multiLine", True).json(path)
    return experiment_lists(read.withColumn("path", F.col("_metadata.file_path")))


def experiment_lists(read: DataFrame) -> DataFrame:
    one = {"models": "model", "images": "image"}
    lists = [
        F.coalesce(many, F.array_compact(F.array(single))).alias(many) for many, single in one.items()
    ]
    rest = [c for c in read.columns if c not in (*one, *one.values())]
    return read.select(*lists, *rest)


def expand_experiments(specs: DataFrame) -> DataFrame:
    """One row per (spec, model, image, route, size tier) of the specs' own lists."""
    def each(column: str):
        filled = F.when(F.size(column) > 0, F.col(column)).otherwise(F.array(F.lit(None).cast("string")))
        return F.explode(filled)

    return (
        specs.withColumn("model_path", each("models"))
        .withColumn("image_path", each("images"))
        .withColumn("image_size_tier", each("image_size_tiers"))
        .withColumn("route_type", each("routes"))
        .drop("models", "images", "image_size_tiers", "routes")
    )


_SPEC = "struct<tier:string,width:int,height:int,channels:int,metadata:map<string,string>>"
REGISTRY_SCHEMA = (
    f"models array<struct<name:string,input_specs:array<{_SPEC}>,supported_routes:array<string>,"
    "metadata:map<string,string>>>, "
    "devices array<struct<name:string,device_id:string,supported_tiers:array<string>,"
    "supported_routes:array<string>,metadata:map<string,string>>>, "
    "scenarios array<struct<name:string,model_name:string,input_tier:string,route_type:string,"
    "metadata:map<string,string>>>"
)


def read_registry(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, devices and scenarios of registry documents; channels default to 3.

    Pass many documents (or JSON lines) to spread a large registry over tasks.
    """
    doc = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(path)
    return registry_tables(doc)


def registry_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    models, devices, scenarios = (
        doc.select(F.inline(name)) for name in ("models", "devices", "scenarios")
    )
    specs = F.transform(
        "input_specs", lambda s: s.withField("channels", F.coalesce(s["channels"], F.lit(3)))
    )
    return models.withColumn("input_specs", specs), devices, scenarios
