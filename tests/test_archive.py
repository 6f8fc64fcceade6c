"""Literal cases: status rules, sources, and streams that equal their batch form."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators.ledger import PLANS
from leafmill.sources import archive
from leafmill.streaming import live

AT = [datetime(2024, 1, 1, 0, 0, s) for s in range(10)]


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, job_id long, status_type string, new_status string")


def test_superseded_jobs_take_no_more(spark):
    rows = [(1, AT[0], 1, "processing", "InProgress"), (2, AT[1], 1, "supersede", "Superseded"), (3, AT[2], 1, "processing", "Completed"), (4, AT[0], 2, "Processing", "Completed"), (5, AT[1], 2, "colour", "x")]
    for order in (rows, rows[::-1]):
        got = {r["job_id"]: r for r in PLANS["a07_fold_status"].apply(job_event=events(spark, order)).collect()}
        assert got[1]["processing_status"] == "Superseded" and got[2]["processing_status"] == "Completed" and got[2]["qc_status"] == "Pending"


def test_plan_names_missing_tables(spark):
    with pytest.raises(ValueError, match="listing"):
        PLANS["a06_delete_capture"].apply(capture_job=spark.range(1))


def test_align_schema_adds_defaults(spark):
    df = archive.align_schema(spark.createDataFrame([("a", "X")], "JOB_ID string, capture_format string"), "capture_job")
    r = df.first()
    assert r["capture_format"] == "X" and r["processing_status"] == "Pending" and r["processed_path"] is None and "job_id" not in df.columns


def test_ocr_tables_skip_malformed_rows(spark, tmp_path):
    head = "\t".join("level page_num block_num par_num line_num word_num left top width height conf text".split())
    row = lambda level, left, text: "\t".join(map(str, [level, 1, 1, 1, 1, 1, left, 2, 3, 4, 96, text]))
    (tmp_path / "a.tsv").write_text("\n".join([head, row(5, 10, "word"), row(4, 10, "line"), row(5, "x", "bad"), row(5, 1, " "), "5\tshort"]))
    got = archive.read_ocr_tsv(spark, str(tmp_path)).collect()
    assert [(r["left_px"], r["text"]) for r in got] == [(10, "word")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.txt").write_text("one\r\ntwo")
    assert [r["line"] for r in archive.read_ocr_text(spark, str(tmp_path / "t")).orderBy("i").collect()] == ["one", "two"]


def test_missing_and_empty_targets(spark):
    manifest = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "batch_id long, target string")
    listing = spark.createDataFrame([("a", 10), ("b", 0)], "path string, length long")
    assert sorted(r["target"] for r in archive.verify_export(manifest, listing).collect()) == ["b", "c"]


def test_images_become_scanlines(spark, tmp_path):
    import struct
    import zlib

    rgb = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3) * 10
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    (tmp_path / "p.png").write_bytes(png)
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {(r["path"].rsplit("/", 1)[1], r["y"]): r for r in archive.read_scanlines(spark, str(tmp_path)).collect()}
    assert set(got) == {("p.png", 0), ("p.png", 1), ("broken.png", None)}
    want = np.rint(rgb.astype(float) @ [0.299, 0.587, 0.114]).astype(int)
    for y in (0, 1):
        r = got["p.png", y]
        assert [r["r"], r["g"], r["b"]] == [rgb[y, :, k].tolist() for k in range(3)] and r["gray"] == want[y].tolist() and (r["width"], r["height"]) == (3, 2)
    bad = got["broken.png", None]
    assert (bad["width"], bad["height"], bad["r"], bad["gray"]) == (0, 0, None, None)
    assert archive.list_files(spark, str(tmp_path)).count() == 2


def frames(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, datetime(2024, 1, 1, 0, i // 60, i % 60, (i * 137 % 10) * 100_000), bool(rng.random() > 0.1), 100.0, 80.0, 400.0, 300.0, float(rng.choice([20, 60, 60, 60])), [int(40 * (i // 12))] * 4) for i in range(120)]
    return spark.createDataFrame(rows, live.FRAMES)


def test_stream_equals_batch(spark, tmp_path):
    df = frames(spark)
    want = sorted(map(str, live.watch_batch(df).collect()))
    assert any(r["triggered"] for r in live.watch_batch(df).collect())
    for k, (lo, hi) in enumerate(((0, 40), (40, 80), (80, 120))):
        df.where((F.col("frame_id") >= lo) & (F.col("frame_id") < hi)).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live.watch_stream(source).writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("SELECT * FROM watched").collect())) == want


def test_severity_of_page_labels(spark):
    row = lambda p, q, o: ("j", 1, p, q, o, "Pending")
    jobs = spark.createDataFrame([row("Failed", "PASS", "Completed"), row("Completed", "PASS", "Failed"), row("Completed", "FAIL", "Completed"), row("Completed", "WARNING", "Completed"), row("Completed", "PASS", "Completed"), row("Pending", "Pending", "Pending")], "job_id string, batch_id long, processing_status string, qc_status string, ocr_status string, export_status string")
    got = {r["status"]: r["severity"] for r in PLANS["a25_severity"].apply(capture_job=jobs).collect()}
    want = {"Processing failed": "Fail", "OCR failed": "Warning", "QC fail": "Fail", "Needs review": "Warning", "Processed": "Success", "Processing": "InProgress", "Failed": "Neutral", "PASS": "Neutral", "Completed": "Neutral", "Pending": "Neutral", "FAIL": "Neutral", "WARNING": "Neutral"}
    assert got == want


def test_crops_are_held_at_zero_only(spark):
    from leafmill.functions.settings import PLANS as settings

    rows = [(1, "-5.5,10.9,300.7,900"), (2, "1200,10,50,50"), (3, "1,2,3"), (4, "1,2,3,4,5,6,7,8")]
    got = {r["job_id"]: [r[c] for c in ("kind", "x1", "y1", "x3", "y3")] for r in settings["b03_parse_crop"].apply(capture_job=spark.createDataFrame(rows, "job_id long, left_crop_box string")).collect()}
    assert got == {1: ["rect", 0, 10, 300, 800], 2: ["rect", 1200, 10, 1000, 60], 3: ["whole", 0, 0, 1000, 800], 4: ["quad", 1, 2, 5, 6]}


def test_outputs_are_resolved_by_tiers(spark):
    from leafmill.functions.settings import PLANS as settings

    job = lambda i, original, recorded=None: (i, 1, i, AT[0], original, recorded, "Completed", "Pending")
    jobs = spark.createDataFrame([job(1, "d/a.jpg", "d/x.tif;d/gone.tif"), job(2, "d/b.jpg", "d/gone.tif"), job(3, "d/c.jpg"), job(4, "d/e.jpg"), job(5, "d/none.jpg")], "job_id long, batch_id long, page_number long, ts timestamp, original_path string, processed_path string, processing_status string, export_status string")
    files = "d/a.jpg d/x.tif d/b.jpg d/b_1_left.TIF d/b_2_right.tif d/b_R_2024.jpg d/b.txt d/c.jpg d/Processed/c.png d/e.jpg".split()
    listing = spark.createDataFrame([(f, 1) for f in files], "path string, length long")
    got = sorted((r["job_id"], r["path"], r["tier"]) for r in settings["b11_resolve_outputs"].apply(capture_job=jobs, listing=listing).collect())
    assert got == [(1, "d/x.tif", 1), (2, "d/b_1_left.TIF", 2), (2, "d/b_2_right.tif", 2), (3, "d/Processed/c.png", 3), (4, "d/e.jpg", 4)]


def test_boxes_are_steady_within_a_share_of_the_picture(spark):
    box = lambda i, x, sharp=60.0, w=400.0: (i, 1, datetime(2024, 1, 1, 0, 0, i), True, x, 80.0, w, 300.0, sharp, [1] * 4)
    rows = [box(0, 100.0), box(1, 118.0), box(2, 140.0), box(3, 141.0, 10.0), box(4, 142.0), box(5, 142.0, 60.0, 100.0)]
    got = {r["frame_id"]: (r["stable"], r["stable_count"], r["smooth_x"]) for r in live.watch_batch(spark.createDataFrame(rows, live.FRAMES)).collect()}
    assert got[1] == (True, 2, pytest.approx(106.3))  # 18 of 640 is below 3 %
    assert got[2][:2] == (False, 1)
    assert got[3] == (False, 0, 141.0)  # too blurred: the new box stays
    assert got[4][:2] == (True, 1)
    assert got[5] == (False, 0, None)  # under a fifth of the picture
