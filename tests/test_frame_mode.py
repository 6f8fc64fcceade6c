"""Frame mode: literal cases, pictures measured by region, and a stream that equals its batch form."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import strips
from leafmill.streaming import live

SHARP, BLURRED = 90.0, 10.0


def frame(i, *values, sharp=(SHARP, SHARP), editing=False, automatic=True, seconds=None, stream=1):
    """A frame whose regions have constant signatures of 4 cells."""
    regions = [(s, None if v is None else [v] * 4) for v, s in zip(values, sharp, strict=False)]
    return (i, stream, datetime(2024, 1, 1) + timedelta(seconds=i if seconds is None else seconds), editing, automatic, regions)


def run(spark, rows):
    got = live.frame_mode_batch(spark.createDataFrame(rows, live.MODE_FRAMES), cells=2).orderBy("frame_id").collect()
    return [(r["status"], r["stable_count"], r["triggered"]) for r in got]


def test_a_settled_page_is_captured_once(spark):
    rows = [frame(i, 10, 20) for i in range(6)] + [frame(6, 10, 200), *[frame(i, 10, 200) for i in range(7, 10)]]
    assert run(spark, rows) == [("HOLD STILL", 1, False), ("HOLD STILL", 2, False), ("CAPTURING", 0, True), ("HOLD STILL", 1, False), ("HOLD STILL", 2, False), ("SWAP PAGE", 3, False),
                                ("HOLD STILL", 1, False), ("HOLD STILL", 2, False), ("CAPTURING", 0, True), ("HOLD STILL", 1, False)]


def test_the_least_sharp_region_holds_the_capture(spark):
    rows = [frame(0, 1, 2), frame(1, 1, 2), frame(2, 1, 2, sharp=(SHARP, BLURRED)), frame(3, 1, 2), frame(4, 1, 2), frame(5, 1, 2)]
    assert run(spark, rows) == [("HOLD STILL", 1, False), ("HOLD STILL", 2, False), ("FOCUSING", 0, False), ("HOLD STILL", 1, False), ("HOLD STILL", 2, False), ("CAPTURING", 0, True)]


def test_editing_and_manual_mode_pause(spark):
    rows = [frame(0, 1, 2), frame(1, 1, 2, editing=True), frame(2, 1, 2, automatic=False), frame(3, 1, 2), frame(4, 1, 2), frame(5, 1, 2)]
    # What is seen while editing still counts as the last look.
    assert run(spark, rows)[1:] == [("EDITING FRAMES", 0, False), ("PRESS CAPTURE", 0, False), ("HOLD STILL", 1, False), ("HOLD STILL", 2, False), ("CAPTURING", 0, True)]


def test_missing_regions_signatures_and_early_frames(spark):
    rows = [frame(0, 5, None), frame(1, 5, None, seconds=0.3), frame(2, 5, 0, seconds=1), frame(3, seconds=2), frame(4, 5, seconds=3), (5, 1, datetime(2024, 1, 1, 0, 0, 4), False, True, None)]
    # Frame 1 comes too soon; no signature is zeros; another number of regions is another content.
    assert run(spark, rows) == [("HOLD STILL", 1, False), ("HOLD STILL", 2, False), ("WAITING FOR LIVE VIEW", 0, False), ("HOLD STILL", 1, False), ("WAITING FOR LIVE VIEW", 0, False)]


def pictures(spark, n):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 256, (30, 40)) for _ in range(3)]
    rows = []
    for i in range(n):
        page = pages[i // 12 % 3] if i % 7 else pages[i % 3]
        rows.append((i, i % 3, datetime(2024, 1, 1) + timedelta(milliseconds=217 * i), None if i == 10 else page.tolist()))
    return spark.createDataFrame(rows, "frame_id long, stream_id long, ts timestamp, picture array<array<int>>")


def batches(spark):
    rows = [(0, "Active", "0,0,20,30;20,0,20,30", 40, 30), (1, "Completed", "4,4,30,20", 40, 30), (2, "Active", None, 0, 0), (7, "Active", "1,2,oops,4", 40, 30)]
    return live.frame_mode_batches(spark.createDataFrame(rows, "batch_id long, status string, fixed_frames string, frame_ref_w int, frame_ref_h int"))


def test_pictures_are_measured_as_stored_images_are(spark):
    got = live.check_regions(pictures(spark, 12), batches(spark), cells=6)
    assert {r["stream_id"] for r in got.collect()} == {0, 1}  # the others have no frames
    lines = pictures(spark, 12).where("picture IS NOT NULL").select(F.col("frame_id").alias("image_id"), F.posexplode("picture").alias("y", "gray"))
    frames = spark.createDataFrame([(i, 0, 0.0, 0.0, 0.5, 1.0) for i in range(0, 12, 3)] + [(i, 1, 0.5, 0.0, 0.5, 1.0) for i in range(0, 12, 3)], "image_id long, frame_no int, x double, y double, w double, h double")
    want = {(r["image_id"], r["frame_no"]): r for r in strips.region_measure(lines, frames, cells=6).collect()}
    for r in got.where("stream_id = 0").collect():
        for k, region in enumerate(r["regions"]):
            assert region["sharpness"] == pytest.approx(want[r["frame_id"], k]["sharpness"]) and region["signature"] == want[r["frame_id"], k]["signature"]


def test_stream_equals_batch(spark, tmp_path):
    df, static = pictures(spark, 120), batches(spark)
    want = live.frame_mode_batch(live.check_regions(df, static, cells=6), cells=6).collect()
    assert any(r["triggered"] for r in want) and {r["status"] for r in want} >= {"HOLD STILL", "CAPTURING", "EDITING FRAMES"}
    for k in range(3):
        df.where(F.col("frame_id").between(40 * k, 40 * k + 39)).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.frame_mode_stream(live.check_regions(source, static, cells=6), cells=6).writeStream.format("memory").queryName("frame_mode").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("SELECT * FROM frame_mode").collect())) == sorted(map(str, want))


def test_one_stream_may_hold_most_frames(spark):
    rng = random.Random(1)
    rows = [frame(i, rng.choice([10, 10, 90]), 20, stream=1 if i % 10 else 2) for i in range(3000)]
    got = live.frame_mode_batch(spark.createDataFrame(rows, live.MODE_FRAMES).repartition(7), cells=2).collect()
    alone = live.FrameWatch(2)
    want = [alone.check(i * 1000, {"frame_id": i, "stream_id": 1, "ts": None, "editing": False, "automatic": True, "regions": [{"sharpness": s, "signature": v} for s, v in r[5]]}) for i, r in enumerate(rows) if r[1] == 1]
    assert sorted((r["frame_id"], r["status"]) for r in got if r["stream_id"] == 1) == sorted((w["frame_id"], w["status"]) for w in want)
