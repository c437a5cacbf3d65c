"""Matrices, strategy checks, registry and configuration rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from runlens.dims import StrategyUnit
from runlens.operators import quality
from runlens.plans import matrix, registry, strategies
from runlens.sources import configs


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([("a.jpg",)], "image_path string")


def test_matrix_literal(images):
    got = matrix.build_matrix(images, ["m.om"], ["720p", "4K"]).orderBy("tier_no").collect()
    assert [(r.input_tier, r.runtime_resolution) for r in got] == [("720p", "640x640"), ("4K", "4k6k")]
    assert matrix.build_matrix(images, ["m.om"]).count() == 3
    with pytest.raises(ValueError):
        matrix.build_matrix(images, ["m.om"], ["8K"])


def test_route_matrix_literal(images):
    got = matrix.build_route_matrix(images, ["m.om"]).orderBy("route_no").collect()
    assert [(r.route_type, r.runtime_resolution) for r in got] == [
        ("tiled_route", None),
        ("large_input_route", "6k"),
    ]
    with pytest.raises(ValueError):
        matrix.build_route_matrix(images, ["m.om"], routes=["side_route"])


def test_route_defaults():
    assert matrix.route_defaults(None, None) == ([None], [None])
    assert matrix.route_defaults(None, ["4K"]) == (["tiled_route", "large_input_route"], ["4K"])
    assert matrix.route_defaults(["large_input_route"], None) == (["large_input_route"], ["6K"])
    assert matrix.route_defaults(["tiled_route"], None) == (["tiled_route"], [None])


def test_matrix_needs_no_shuffle(images):
    plan = matrix.build_route_matrix(images, ["a", "b"])._jdf.queryExecution().executedPlan()
    assert "Exchange" not in plan.toString() and "Join" not in plan.toString()


def test_augmented_names(spark):
    df = spark.createDataFrame([("x/a.b.png",), ("y/noext",), ("z/.hidden",)], "path string")
    once = {r.output_name for r in matrix.augment_matrix(df, ["1k"]).collect()}
    assert once == {"a.b_1k.png", "noext_1k.jpg", ".hidden_1k.jpg"}
    twice = matrix.augment_matrix(df.limit(1), ["1k", "bad"], 2).collect()
    assert {r.output_name for r in twice} == {"a.b_1_1k.png", "a.b_2_1k.png"}


def check(spark, names, route, **kw):
    df = spark.createDataFrame([(names, route)], "names array<string>, route_type string")
    return strategies.validate_strategies(df, **kw).first()


def test_strategy_checks(spark):
    assert not check(spark, ["high_res_tiling"], "large_input_route").is_valid
    got = check(spark, ["high_res", "high_res_tiling"], "tiled_route")
    assert got.is_valid and got.normalized == ["high_res_tiling"]
    assert check(spark, ["high_res"], None).is_valid
    bad = check(spark, ["nope", "batch"], None)
    assert bad.errors == ["unknown strategy unit: nope"] and bad.normalized == ["batch"]
    assert check(spark, [], None).is_valid


def test_conflicting_units(spark):
    units = (StrategyUnit("a", conflicts=("b",)), StrategyUnit("b"))
    got = check(spark, ["b", "a"], None, units=units)
    assert got.errors == ["a and b cannot be enabled together"]
    assert check(spark, ["a"], None, units=units).is_valid


MODEL = (
    "name string, input_specs array<struct<tier:string,width:int,height:int,channels:int>>, "
    "supported_routes array<string>"
)


def test_tasks_and_violations(spark):
    models = spark.createDataFrame([("m", [("720p", 1280, 720, 3)], ["tiled_route"])], MODEL)
    scenarios = spark.createDataFrame(
        [("ok", "m", "720p", "tiled_route"), ("route", "m", "720p", "large_input_route"),
         ("tier", "m", "4K", "tiled_route"), ("model", "x", "720p", "tiled_route"),
         ("odd", "m", "8K", "tiled_route")],
        "name string, model_name string, input_tier string, route_type string",
    )
    tasks, bad = registry.build_tasks(scenarios, models)
    assert [(r.name, r.input_spec.width) for r in tasks.collect()] == [("ok", 1280)]
    assert {r.name: r.violation for r in bad.collect()} == {
        "route": "model does not support route",
        "tier": "model has no spec for tier",
        "model": "unknown model",
        "odd": "unsupported input tier",
    }


def test_registry_violations(spark):
    models = spark.createDataFrame(
        [("", [("720p", 0, 720, 3)], ["tiled_route"]), ("n", None, []), ("u", [("x", 1, 1, 3)], ["y"])], MODEL
    )
    devices = spark.createDataFrame(
        [(" ", ["720p"], ["tiled_route"]), ("d", [], None)],
        "name string, supported_tiers array<string>, supported_routes array<string>",
    )
    scenarios = spark.createDataFrame(
        [("s", "", "720p", "tiled_route")],
        "name string, model_name string, input_tier string, route_type string",
    )
    got = registry.validate_registry(models, devices, scenarios)
    found = {(r.kind, r.name, r.violation) for r in got.collect()}
    assert found == {
        ("model", "", "name is required"),
        ("model", "", "width must be positive"),
        ("model", "n", "at least one input spec is required"),
        ("model", "n", "at least one supported route is required"),
        ("model", "u", "unsupported input tier"),
        ("model", "u", "unsupported route type"),
        ("device", " ", "name is required"),
        ("device", "d", "supported_tiers must not be empty"),
        ("device", "d", "supported_routes must not be empty"),
        ("scenario", "s", "model_name is required"),
    }


def test_default_config_is_valid(spark, tmp_path):
    (tmp_path / "empty.json").write_text("{}")
    (tmp_path / "broken.json").write_text("{not json")
    (tmp_path / "some.json").write_text(
        '{"device_id": 9,\n "strategies": {"multithread": {"enabled": true}},'
        ' "evaluation": {"route_type": "x"}}'
    )
    read = configs.read_run_configs(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.unreadable for r in read.collect()} == {
        "empty.json": False, "broken.json": True, "some.json": False,
    }
    checked = quality.validate_configs(configs.flat_configs(read))
    got = {r.path.rsplit("/", 1)[1]: r for r in checked.collect()}
    assert got["empty.json"].is_valid and got["broken.json"].is_valid
    assert got["empty.json"].num_threads == 4 and got["broken.json"].resolution == "640x640"
    assert not got["some.json"].is_valid
    assert got["some.json"].errors == ["route_type not in tiled_route, large_input_route"]
    assert "device_id above 3" in got["some.json"].warnings
    assert got["some.json"].multithread_on


def test_value_rules(spark):
    df = spark.createDataFrame([(0, -1, "base"), (None, 0, "fast")], "iterations int, warmup int, mode string")
    rules = [quality.iterations(), quality.warmup(), quality.inference_mode()]
    got = {(r.column_name, r.error_code, r.value) for r in quality.check_values(df, [], rules).collect()}
    assert got == {
        ("iterations", 3022, "0"), ("iterations", 3022, None), ("warmup", 3021, "-1"), ("mode", 3030, "fast"),
    }


def test_paths(spark):
    df = spark.createDataFrame(
        [("",), (None,), ("a/b.om",), ("../b.om",), ("a/../../data2/x.om",), ("/data/c.om",), ("a.txt",), ("/data",)],
        "path string",
    )
    got = {r.path: r.error_code for r in quality.check_paths(df, "/data", [".om"]).collect()}
    assert got == {
        "": 3001, None: 3001, "../b.om": 3002, "a/../../data2/x.om": 3002, "a.txt": 3005, "/data": 3005,
    }


def test_device_capability(spark):
    devices = spark.createDataFrame(
        [("d1", ["720p", "4K"], ["tiled_route"]), ("d2", ["720p"], ["tiled_route", "tiled_route"])],
        "name string, supported_tiers array<string>, supported_routes array<string>",
    )
    scenarios = spark.createDataFrame(
        [(1, "720p", "tiled_route"), (2, "1080p", "tiled_route")], "id int, input_tier string, route_type string"
    )
    got = {r.id: (r.devices, r.supported) for r in registry.device_capability(scenarios, devices).collect()}
    assert got == {1: (2, True), 2: (0, False)}


def test_rules_without_their_columns_are_named(spark):
    df = spark.createDataFrame([(-1,)], "device_id int")
    row = quality.validate_configs(df, quality.COMMAND_RULES).first()
    assert row.errors == ["device_id below 0"] and "backend not in pil, opencv" in row.unchecked
    assert "device_id below 0" not in row.unchecked
