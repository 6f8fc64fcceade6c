"""Ledger operators on requests that a user brings: literal cases."""

from datetime import datetime

import pytest

from leafmill.operators.ledger import ADJUSTMENTS, PLANS

JOB = "job_id string, batch_id int, page_number int, ts timestamp, processing_status string, qc_status string, ocr_status string, export_status string, original_path string, processed_path string, rotation_degrees int, flip_horizontal boolean, flip_vertical boolean, brightness double, contrast double, saturation double, sharpness double, white_balance double, left_crop_box string, manual_crop boolean"


def job(i, batch=1, page=None, status="Completed", export="Pending", rotation=0, tone=0.0, crop=None, manual=False):
    return (i, batch, page or 1, datetime(2024, 1, 1), status, "PASS", "Completed", export, f"{i}.jpg", None, rotation, rotation > 0, False, tone, tone, tone, tone, tone, crop, manual)


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [job("a", 1, 1, rotation=90, tone=0.5), job("b", 1, 2, "Superseded", "Superseded"), job("c", 1, 3), job("d", 2, 1, rotation=180), job("e", 2, 2), job("f", 3, 1, "Pending"), job("g", 4, 1, "Failed", crop="1,2,3,4"), job("h", 4, 2, crop="5,6,7,8", manual=True), job("i", 4, 3)]
    return spark.createDataFrame(rows, JOB)


def test_bulk_adjust(spark, jobs):
    asked = spark.createDataFrame([(1, "a", None), (2, "d", "e"), (2, "a", "e"), (2, "nobody", "d"), (1, "a", "a")], "batch_id int, template_id string, job_id string")
    got = {r["job_id"]: r for r in PLANS["a11_bulk_adjust"].apply(capture_job=jobs, adjust_request=asked).collect()}
    assert len(got) == 9 and {j for j, r in got.items() if r["changed"]} == {"b", "c", "e"}
    assert [got["b"][c] for c in ADJUSTMENTS] == [90, True, False, 0.5, 0.5, 0.5, 0.5, 0.5]  # superseded ones too
    assert {got[j][f"{s}_status"] for j in "bce" for s in ("processing", "qc", "ocr", "export")} == {"Pending"}
    assert got["e"]["rotation_degrees"] == 90 and got["a"]["processing_status"] == "Completed"  # of two templates the smaller


def test_export_lists(spark, jobs):
    batches = spark.createDataFrame([(b,) for b in range(1, 6)], "batch_id int")
    lists = spark.createDataFrame([(4, 1, "i"), (4, 2, "gone"), (4, 3, "g"), (4, 4, "a"), (4, 9, "i"), (3, 1, "f")], "batch_id int, position int, job_id string")
    got = sorted((r["batch_id"], r["state"], r["position"], r["job_id"]) for r in PLANS["a17_export_plan"].apply(capture_job=jobs, batch=batches, export_request=lists).collect())
    assert got == [(1, "ready", 1, "a"), (1, "ready", 2, "c"), (2, "ready", 1, "d"), (2, "ready", 2, "e"), (3, "blocked", 1, None), (4, "ready", 1, "i"), (4, "ready", 2, "g"), (5, "no captures", 1, None)]


def test_batches_are_resumed_or_made(spark):
    batches = spark.createDataFrame([(1, 1, "B1", "Active", True, 300), (2, 1, "B1", "Active", False, 200), (3, 1, "B2", "Exported", True, 300)], "batch_id int, project_id int, batch_code string, status string, split_book_pages boolean, dpi int")
    asked = spark.createDataFrame([(1, 1, "B1", True, "1,2,3,4", 150), (2, 1, "B2", True, None, 150), (3, 2, "B1", True, "1,2,3,4", 150)], "request_id int, project_id int, batch_code string, split_book_pages boolean, fixed_frames string, dpi int")
    got = {r["request_id"]: (r["batch_id"], r["created"], r["dpi"], r["split_book_pages"]) for r in PLANS["a13_resume_or_create"].apply(batch=batches, batch_request=asked).collect()}
    assert got == {1: (2, False, 200, False), 2: (None, True, 150, True), 3: (None, True, 150, False)}


def test_edited_crops(spark, jobs):
    edits = spark.createDataFrame([("g", "1,2,3,4"), ("h", "9,9,9,9"), ("i", "1,1,1,1"), ("gone", "1,1,1,1"), ("a", None)], "job_id string, left_crop_box string")
    got = {r["job_id"]: (r["left_crop_box"], r["manual_crop"], r["ocr_status"]) for r in PLANS["a23_crop_requeue"].apply(capture_job=jobs, crop_edit=edits).collect()}
    assert got == {"g": ("1,2,3,4", False, "Pending"), "h": ("9,9,9,9", True, "Pending"), "i": ("1,1,1,1", True, "Pending"), "a": (None, False, "Pending")}


def test_outputs_follow_the_log(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    events = spark.createDataFrame([(1, at(5), 1, "Supersede"), (2, at(1), 2, "qc"), (3, at(1), 3, "qc")], "event_id int, ts timestamp, job_id int, status_type string")
    writes = spark.createDataFrame([(10, at(1), 1, "a"), (11, at(4), 1, "b;c"), (12, at(5), 1, "late"), (13, at(2), 2, "x"), (14, at(2), 2, "y"), (15, at(1), 9, "z")], "event_id int, ts timestamp, job_id int, paths string")
    got = {r["job_id"]: (r["processed_path"], r["n_outputs"]) for r in PLANS["a08_set_outputs"].apply(job_event=events, output_event=writes).collect()}
    assert got == {1: ("b;c", 2), 2: ("y", 1), 3: (None, 0), 9: ("z", 1)}


def test_text_engine_by_site(spark, jobs):
    sites = spark.createDataFrame([(1, False), (2, True)], "batch_id int, engine boolean")
    got = {r["batch_id"]: (r["missing"], r["completed"], r["skipped"], r["message"]) for r in PLANS["a16_ocr_summary"].apply(capture_job=jobs, ocr_site=sites).collect()}
    assert got[1] == (True, 0, 2, "engine missing") and got[2] == (False, 2, 0, "all pages read") and not got[4][0]
