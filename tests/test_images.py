"""Tiles, pixels, files and scoring."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import decode_output, estimate_tiles, hann, split_batch_output
from runlens.operators import images, scoring, tiles
from runlens.sources.images import load_images, scan_images
from workload.sources import _png


def sizes(spark, *wh):
    return spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(wh)], "image_id int, width int, height int")


def grid_by_loop(w, h, tile, overlap):
    step = tile - int(tile * overlap)
    out = []
    for y in range(0, h, step):
        for x in range(0, w, step):
            right, bottom = min(x + tile, w), min(y + tile, h)
            left, top = max(0, right - tile), max(0, bottom - tile)
            out.append((left, top, right - left, bottom - top))
    return out


@pytest.mark.parametrize("overlap", [0.25, 0.0, 0.15625])
def test_grid(spark, overlap):
    shapes = [(3000, 2000), (640, 640), (100, 50), (641, 1), (1280, 700)]
    got = tiles.tile_grid(sizes(spark, *shapes), 640, overlap).orderBy("image_id", "tile_id").collect()
    for i, (w, h) in enumerate(shapes):
        mine = [r for r in got if r.image_id == i]
        want = grid_by_loop(w, h, 640, overlap)
        assert [(r.x, r.y, r.w, r.h) for r in mine] == want
        assert [r.tile_id for r in mine] == list(range(len(want)))
        assert {r.num_tiles for r in mine} == {len(want)}


def test_edge_tiles_repeat_but_estimate_does_not(spark):
    got = tiles.tile_grid(sizes(spark, (3000, 640)), 640, 0.25).filter("y = 0").orderBy("tile_id").collect()
    row = [r.x for r in got][:7]
    assert row == [0, 480, 960, 1440, 1920, 2360, 2360]
    guess = spark.range(1).select(estimate_tiles(F.lit(3000), F.lit(640), 640, 0.25)).first()[0]
    assert guess == 6


def test_grid_of_nothing_and_full_overlap(spark):
    assert tiles.tile_grid(sizes(spark, (0, 10)), 4, 0.5).count() == 0
    with pytest.raises(ValueError):
        tiles.tile_grid(sizes(spark, (10, 10)), 4, 1.0)


@pytest.mark.parametrize("shape", [(30, 20), (16, 16), (10, 9), (25, 50)])
def test_weight_map(spark, shape):
    w, h = shape
    want = np.zeros((h, w))
    window = np.outer(np.hanning(16), np.hanning(16))
    for x, y, tw, th in grid_by_loop(w, h, 16, 0.25):
        want[y : y + th, x : x + tw] += window[:th, :tw]
    want[want < 1e-6] = 1.0
    got = np.zeros((h, w))
    for r in tiles.tile_weight_map(sizes(spark, shape), 16, 0.25).collect():
        got[r.y, r.x] = r.weight
    assert got == pytest.approx(want, abs=1e-9)


def test_hann(spark):
    row = spark.range(1).select(hann(5).alias("five"), hann(1).alias("one")).first()
    assert row.five == pytest.approx(list(np.hanning(5))) and row.one == [1.0]


def test_merge_drops_missing_results(spark):
    grid = tiles.tile_grid(sizes(spark, (8, 4)), 4, 0.0)
    results = spark.createDataFrame(
        [(0, 0, [float(i) for i in range(100)]), (0, 1, None)], "image_id int, tile_id int, result array<float>"
    )
    got = tiles.merge_tile_results(grid, results).collect()
    assert len(got) == 1 and got[0].result == [float(i) for i in range(10)] and got[0].num_tiles == 2


def test_merge_gathers_no_grid_on_the_driver(spark):
    grid = tiles.tile_grid(sizes(spark, (400, 400)), 4, 0.0)
    results = spark.range(10_000).selectExpr("0 AS image_id", "int(id) AS tile_id", "array(float(id)) AS result")
    merged = tiles.merge_tile_results(grid, results)
    assert merged.count() == 10_000 and merged.filter("result[0] != tile_id OR num_tiles != 10000").isEmpty()
    assert "Broadcast" not in merged._jdf.queryExecution().executedPlan().toString()


def picture(rng, h, w, c=3):
    return rng.integers(0, 256, (h, w, c), dtype=np.uint8)


def frame(spark, arrays):
    rows = [(i, *a.shape, bytearray(a.tobytes())) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_id int, height int, width int, channels int, data binary")


def test_cut_tiles_returns_the_pixels(spark):
    arrays = [picture(np.random.default_rng(1), 50, 70), picture(np.random.default_rng(2), 20, 20, 1)]
    for r in images.cut_tiles(frame(spark, arrays), 32, 0.25).collect():
        a = arrays[r.image_id]
        block = a[r.y : r.y + r.h, r.x : r.x + r.w]
        assert bytes(r.data) == block.tobytes()


def test_resize_keeps_identity_and_constants():
    a = picture(np.random.default_rng(5), 9, 7)
    for method in images.METHODS:
        assert (images.resize_pixels(a, 9, 7, method) == a).all()
        flat = np.full((6, 5, 3), 77, dtype=np.uint8)
        assert (images.resize_pixels(flat, 11, 3, method) == 77).all()


def test_bilinear_halves_a_ramp():
    ramp = np.array([[[0], [10], [20], [30]]], dtype=np.uint8)
    assert images.resize_pixels(ramp, 1, 8, "bilinear")[0, :, 0].tolist() == [0, 2, 8, 12, 18, 22, 28, 30]
    assert images.resize_pixels(ramp, 1, 2, "nearest")[0, :, 0].tolist() == [10, 30]


def test_preprocess_reports_bad_rows(spark):
    good = picture(np.random.default_rng(8), 4, 6)
    df = frame(spark, [good]).union(
        spark.createDataFrame([(1, 4, 6, 3, bytearray(b"short"))], frame(spark, [good]).schema)
    )
    done = images.preprocess_images(df, 6, 4, "nearest").orderBy("image_id").collect()
    assert done[0].success and done[0].tensor == pytest.approx(
        (np.moveaxis(good, 2, 0).ravel() / 255).tolist(), abs=1e-6
    )
    assert not done[1].success and done[1].tensor is None and "ValueError" in done[1].error
    assert done[0].latency >= 0
    ok, bad = images.split_failed(images.preprocess_images(df, 6, 4), "image_id")
    assert [r.image_id for r in ok.collect()] == [0] and [r.image_id for r in bad.collect()] == [1]


def test_files(spark, tmp_path):
    grey = np.arange(48, dtype=np.uint8).reshape(6, 8)
    (tmp_path / "a.PNG").write_bytes(_png(grey))
    (tmp_path / "broken.png").write_bytes(b"not an image")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "old.tiff").write_bytes(b"x")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "b.png").write_bytes(_png(grey))

    def names(df):
        return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())

    assert names(scan_images(spark, [str(tmp_path)])) == ["a.PNG", "broken.png"]
    assert names(scan_images(spark, [str(tmp_path)], (".tiff",))) == ["old.tiff"]
    assert names(scan_images(spark, [str(tmp_path / "a.PNG")])) == ["a.PNG"]
    ok, failed = load_images(spark, [str(tmp_path / "a.PNG"), str(tmp_path / "broken.png")])
    row = ok.first()
    assert (row.height, row.width, row.channels) == (6, 8, 1) and bytes(row.data) == grey.tobytes()
    assert [r.origin.rsplit("/", 1)[1] for r in failed.collect()] == ["broken.png"]


def test_colour_files_are_rgb(spark, tmp_path):
    import struct
    import zlib

    rgb = picture(np.random.default_rng(3), 3, 5)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\x00" + row.tobytes() for row in rgb)
    head = struct.pack(">IIBBBBB", 5, 3, 8, 2, 0, 0, 0)
    (tmp_path / "c.png").write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )
    ok, _ = load_images(spark, [str(tmp_path)])
    assert bytes(ok.first().data) == rgb.tobytes()


def _sum_model():
    return lambda batch: batch.sum(axis=1, keepdims=True)


def test_score_batches(spark):
    df = spark.range(10).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    got = scoring.score(df, "v", _sum_model, 3, input_tensor_shapes=[[2]]).orderBy("id").collect()
    assert [r.result for r in got] == [[i + 1.0] for i in range(10)]


def test_score_timed_covers_all_rows(spark):
    df = spark.range(100, numPartitions=3).select("id", F.array(F.col("id").cast("float")).alias("v"))
    got = scoring.score_timed(df, "id", "v", _sum_model, 16).collect()
    assert sum(r.images for r in got) == 100 and max(r.images for r in got) <= 16
    assert all(r.total_s == pytest.approx(r.preprocess_s + r.execute_s + r.postprocess_s) for r in got)


def test_tiled_inference_scores_every_tile(spark):
    a = picture(np.random.default_rng(4), 20, 30, 1)

    def model():
        return lambda blocks: [[float(b.sum())] for b in blocks]

    got = scoring.tiled_inference(frame(spark, [a]), model, 16, 0.25, 2, tasks=3).collect()
    assert len(got) == got[0].num_tiles == 6
    for r in got:
        assert r.result == [float(a[r.y : r.y + r.h, r.x : r.x + r.w].sum())]


def test_outputs(spark):
    raw = np.arange(12, dtype="<f4").tobytes()
    df = spark.createDataFrame([(bytearray(raw),)], "b binary")
    decoded = df.select(decode_output(F.col("b")).alias("v"))
    got = decoded.select(split_batch_output(F.col("v"), 3).alias("p")).first().p
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_stages_and_callbacks(spark):
    df = spark.range(5).withColumn("v", F.col("id").cast("int"))
    staged = scoring.pipeline_of(
        df, [lambda d: scoring.map_stages(d, "v", [lambda v: v + 1, lambda v: v * 10], "int")]
    )
    assert [r.v for r in staged.orderBy("id").collect()] == [10, 20, 30, 40, 50]


def test_outcomes_of_callbacks_are_rows(spark, tmp_path):
    """A callback that fails costs its own row only; reading the outcome twice calls nothing again."""

    def callback(row):
        with open(tmp_path / f"{row.id}", "a") as file:
            file.write("x")
        return 1 // (row.id % 5) + row.id

    outcome = scoring.on_result(spark.range(20).repartition(3), callback)
    for _ in range(2):
        got = outcome.agg(F.sum("delivered"), F.sum("failed"), F.sum("total"), F.count("*"), F.min("error")).first()
        assert tuple(got)[:4] == (16, 4, sum(i + (i % 5 == 1) for i in range(20) if i % 5), 3)
        assert got[4].startswith("ZeroDivisionError")
    assert all((tmp_path / f"{i}").read_text() == "x" for i in range(20))


def test_suffixes_are_plain_text(spark):
    from runlens.sources.images import has_suffix

    df = spark.createDataFrame([("a.PNG",), ("b.q.z",), ("b.q9z",), ("apng",)], "p string")
    names = lambda suffixes: [r.p for r in df.filter(has_suffix(F.col("p"), suffixes)).collect()]
    assert names((".PNG",)) == names(("png",)) == ["a.PNG"]
    assert names((".q.z",)) == ["b.q.z"]
    assert names(()) == []
