"""Queries whose steps must not grow faster than their tables."""

from datetime import datetime, timedelta

import duckdb
import pytest

from leafmill.operators import search
from leafmill.plans import catalog
from leafmill.plans.plan import deal, run_sql
from leafmill.plans.views import VIEWS

PLANS = catalog.plans()


def most_joined(df):
    """Rows of the largest join of a query."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        plan = again._jdf.queryExecution().executedPlan()
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            found = max(found, node.metrics().get("numOutputRows").get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def joins_on_ranges(df):
    """Joins that compare by order: each row meets all rows of its keys."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line for line in lines if "Join" in line and ("<" in line or ">" in line)]


def same_as_sql(spark, name, tables):
    """Rows of the query and of its SQL over the same rows: name -> (rows, DDL); equal, or the test fails."""
    plan = PLANS[name]
    frames = {t: spark.createDataFrame(rows, ddl) for t, (rows, ddl) in tables.items()}
    df = plan.apply(**frames)
    con = duckdb.connect()
    for t, f in frames.items():
        arrow = f.toArrow()  # noqa: F841
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM arrow")
    found = con.execute((plan.duckdb or plan.sql))
    names = [d[0] for d in found.description]
    plain = lambda v: str(v.replace(tzinfo=None)) if isinstance(v, datetime) else f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*sorted(names)).collect()) == want
    return df


def test_ledger_tables_do_not_multiply(spark):
    batch = [(i, f"B{i}", i % 3 if i % 10 else None) for i in range(300)] + [(7, "B7", 1)]
    project = [(0, "a"), (1, "b"), (1, "b"), (1, "c")]
    calibration = [(i if i % 7 else None, i % 2 if i % 5 else None) for i in range(400)]
    df = same_as_sql(spark, "s01_read_ledger", {"batch": (batch, "batch_id long, batch_code string, project_id int"), "project": (project, "project_id int, name string"), "calibration": (calibration, "calibration_id long, project_id int")})
    assert most_joined(df) <= 500


@pytest.mark.parametrize("name", ["d21_local_stats", "d23_sauvola", "d24_ink_coverage"])
def test_windows_of_long_images_are_those_of_the_sql(spark, name):
    image = [[(y * y * 31 + x * 17 + y % 13 * 40) % 256 for x in range(5)] for y in range(1300)]
    scanline = ([(3, y, row) for y, row in enumerate(image)], "image_id int, y int, gray array<int>")
    pixel = ([(3, y, x, v) for y, row in enumerate(image) for x, v in enumerate(row)], "image_id int, y int, x int, v int")
    same_as_sql(spark, name, {"scanline": scanline, "pixel": pixel})


DAY = datetime(2024, 1, 1)
CALIBRATIONS = [(i, None if i % 50 == 0 else i % 2, None if i % 41 == 0 else DAY + timedelta(hours=i // 3 * 5), 8.5 if i % 3 else None, 11.0, 2000.0, None if i % 4 == 0 else 2600.0) for i in range(300)] + [(900, 1, DAY, 8.5, 11.0, 1.0, 1.0), (899, 1, DAY, None, 11.0, 1.0, 1.0)]
BATCHES = [(i, None if i % 30 == 0 else i % 3, None if i % 29 == 0 else DAY + timedelta(minutes=i * 90 - 3000), "1,2,3,4" if i % 2 else None) for i in range(400)]
CALIBRATION = "calibration_id long, project_id int, calibrated_utc timestamp, target_w_in double, target_h_in double, pixel_w double, pixel_h double"
BATCH = "batch_id long, project_id int, start_time timestamp, fixed_frames string"


def test_batches_do_not_meet_all_calibrations(spark):
    df = same_as_sql(spark, "a14_calibration_at_start", {"batch": (BATCHES, BATCH), "calibration": (CALIBRATIONS, CALIBRATION)})
    assert df.where("calibration_id IS NOT NULL").count() > 200
    assert not joins_on_ranges(df)


def test_jobs_do_not_meet_all_calibrations(spark):
    jobs = [(f"j{i}", i % 410, "Completed" if i % 3 else "Failed", "/a" if i % 5 else None, "PASS") for i in range(500)]
    df = same_as_sql(spark, "a26_worker_route", {"capture_job": (jobs, "job_id string, batch_id long, processing_status string, processed_path string, qc_status string"), "batch": (BATCHES, BATCH), "calibration": (CALIBRATIONS, CALIBRATION)})
    assert not joins_on_ranges(df)


def test_pages_of_a_validation_do_not_meet_in_one_task(spark):
    rows = [(None if i % 40 == 0 else i // 2, i % 7, "current" if i % 3 else "previous", *["FLAG" if i * k % 11 == 0 else "OK" for k in (1, 2, 3, 4)], "NONE") for i in range(1, 600)]
    names = "top_status string, bottom_status string, left_status string, right_status string, gutter_status string"
    df = same_as_sql(spark, "a29_validation_report", {"validation": (rows, f"image long, page int, run string, {names}")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def exchanges(df):
    """Shuffles of a query, those of its broadcast sides included."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_corners_move_once(spark):
    crops = ["10,10,250,12,210,150,8,148", "5,5,300,120", "not,a,box", None, "1,1,1,1,1,1,1,1", "0,0,10,0,0,10,10,10", "3,4,-5,1,2,2,9,9"]
    rows = [(f"j{i % 50}" if i % 50 else None, c) for i, c in zip(range(1, 50), crops * 9)]
    df = same_as_sql(spark, "c02_order_corners", {"capture_job": (rows, "job_id string, left_crop_box string")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Union" not in plan and exchanges(df) == 1


def test_contours_move_once(spark):
    edge = [(i, x, float((x * 7 + i * 5) % 45) if x % 9 else None) for i in (0, 1, 4, 77) for x in range(0, 64, 1 + i % 3)]
    contour = [(f"c{i % 390}", i % 23, i * 7 % 600, i * 13 % 500) for i in range(400)] + [("odd", None, 3, 3), ("none", 4, None, 5)]
    tables = {"contour": (contour, "contour_id string, image_id long, x int, y int"), "edge": (edge, "image_id int, pos int, row_val double")}
    df = same_as_sql(spark, "e35_nearest_edge_point", tables)
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_an_index_grow_with_its_words(spark):
    boxes = spark.range(3000).selectExpr("id AS doc_id", "5 AS level", "1 AS line_num", "1 AS word_num", "1 AS left_px", "1 AS top_px", "concat('tion', id) AS text")
    index = search.build_index(boxes, part_words=20)
    assert index.grams.selectExpr("max(size(ids))").first()[0] < 80
    assert index.search("tion").count() == 3000


def moves(df):
    """How often rows are dealt out by a key in a query."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")


# Pages of 2 to 9 lines of 3 to 20 samples, bent; some samples twice or in one column, and a page whose lines are all too short.
SAMPLES = [(d, n, float(9 * i + d % 5 + 30 * (n % 2)) + 0.25 * (i % 3), 24.0 * n + 0.002 * d * (i - 8) ** 2 + i % 4) for d in range(60) for n in range(2 + d % 8) for i in range(3 if d == 7 else 3 + (5 * d + 7 * n) % 18 * (1 if d % 6 else 3))]
SAMPLES += SAMPLES[::17] + [(d, n, x + 0.3, y + 1.5) for d, n, x, y in SAMPLES[::11]]


@pytest.mark.parametrize("name", ["e25_page_curve", "e27_mesh_gate"])
def test_samples_of_a_page_move_once(spark, name):
    df = same_as_sql(spark, name, {"line_sample": (SAMPLES, "doc_id long, line_num int, x double, y double")})
    assert df.count() > 10
    assert moves(df) == 1


def test_a_curve_without_a_spine_is_that_of_its_sql(spark, monkeypatch):
    from leafmill.operators import fits

    monkeypatch.setitem(PLANS, "curve", fits.page_curve(spine=None))
    assert moves(same_as_sql(spark, "curve", {"line_sample": (SAMPLES, "doc_id long, line_num int, x double, y double")})) == 1


@pytest.mark.parametrize("name", ["e18_margin_shear", "e19_rotation_field", "e20_deskew_decision"])
def test_pages_pass_in_order_whatever_the_batches(spark, name):
    rows = [(d, n, float(40 * i + (d % 9 - 4) * n * 0.7), 24.0 * n + i * 0.3 * (d % 4) + 0.05 * d * n * i % 7) for d in range(30) for n in range(6 + d % 8) for i in range(6 + (d + n) % 9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = same_as_sql(spark, name, {"line_sample": (rows, "doc_id long, line_num int, x double, y double")})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert df.count() > 10
    assert "FlatMapGroupsInArrow" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["t02_text_lines", "t03_page_text"])
def test_words_of_a_page_do_not_move(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert moves(df) == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # texts move, before they are taken apart


def test_parts_of_pages_grow_with_their_number(spark):
    pages = deal(spark.range(90), "id", rows=10)
    assert pages.rdd.getNumPartitions() == 9 and pages.count() == 90
    assert deal(spark.range(3), "id").rdd.getNumPartitions() == 4


JOB = "job_id string, batch_id long, page_number int, ts timestamp, processing_status string, export_status string, original_path string, processed_path string"
# Jobs beside what they may resolve to: recorded outputs, here and elsewhere; derived images; folders named Processed, one in another; names without an ending or of another case.
PATHS = [f"{d}{b}{s}{e}" for d in ("", "/a/", "/a/Processed/", "/a/Processed/Processed/", "/xProcessed/", "/x") for b in ("p1", "P2", "p3_1_left", "n.o") for s in ("", "_processed", "_frame07", "_2_right") for e in ("", ".", ".tif", ".JPG", ".txt")]
JOBS = [(f"j{i}", i, 1, DAY, "Completed", "Pending", None if i % 50 == 49 else PATHS[i * 7 % len(PATHS)], [None, "", f"{PATHS[i % len(PATHS)]};/gone", "/gone", f";{PATHS[i % len(PATHS)]};{PATHS[(i * 11 + 5) % len(PATHS)]}"][i % 5]) for i in range(400)]


def test_a_job_looks_once_for_what_derives_from_its_original(spark):
    listing = [(p, 1) for i, p in enumerate(PATHS) if i % 3 and p]
    df = same_as_sql(spark, "b11_resolve_outputs", {"capture_job": (JOBS, JOB), "listing": (listing, "path string, length long")})
    assert {r["tier"] for r in df.collect()} == {1, 2, 3, 4}
    few = spark.createDataFrame([(f"j{i}", i, 1, DAY, "Completed", "Pending", f"/a/q{i}.tif", f"/a/r{i}.tif") for i in range(50)], JOB)
    files = spark.createDataFrame([(f"/a/{k}{i}.tif", 1) for i in range(50) for k in "qr"], "path string, length long")
    assert most_generated(PLANS["b11_resolve_outputs"].apply(capture_job=few, listing=files)) <= 100


def most_generated(df):
    """Rows of the largest explode of a query."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        plan = again._jdf.queryExecution().executedPlan()
    finally:
        conf.set("spark.sql.adaptive.enabled", "true")
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "Generate" in node.nodeName():
            found = max(found, node.metrics().get("numOutputRows").get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_edges_of_halves_hold_no_image_in_one_task(spark):
    # Rows of several lengths, without pixels, of one image alone, and of no image.
    rows = [(i, y, [(y * y * 7 + x * 31 + (i or 3) * y * x) % 256 if (x + y) % 11 else None for x in range(6 + y * 5 % 4 * ((i or 0) % 2))]) for i in (0, 1, 2, None) for y in range(40 + 3 * (i or 0))]
    rows += [(7, 0, [1, 2, 3]), (8, 0, [5, 5, 5]), (8, 1, [5, 5, 5]), (9, 0, []), (9, 1, None), (1, 90, []), (2, 99, None), (6, 0, [4]), (6, 1, [9]), (6, 2, [200]), (6, 3, [1])]
    lines = spark.createDataFrame(rows, "image_id int, y int, gray array<int>")
    sql = VIEWS["edge_pair"][0]
    df = run_sql(spark, sql["spark"], {"scanline": lines})
    pixels = lines.selectExpr("image_id", "y", "posexplode(gray) AS (x, v)").toArrow()  # noqa: F841
    want = duckdb.connect().execute(f"WITH pixel AS (SELECT * FROM pixels) SELECT image_id, pos, top, bottom FROM ({sql['duckdb']}) e").fetchall()
    assert len(want) > 20
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select("image_id", "pos", "top", "bottom").collect())
    assert str(df._jdf.queryExecution().executedPlan()).count("Window ") == 1


def test_requests_of_a_job_do_not_meet_jobs_twice(spark):
    jobs = [(f"j{i}" if i % 37 else None, i % 12, *(i % 7 for _ in range(8)), *(f"s{i}" for _ in range(4))) for i in range(1, 200)]
    asked = [(i % 14 if i % 9 else None, f"j{i * 5 % 220}" if i % 11 else None, f"j{i * 3 % 230}" if i % 3 else None) for i in range(120)]
    ddl = "job_id string, batch_id long, rotation_degrees int, flip_horizontal int, flip_vertical int, brightness int, contrast int, saturation int, sharpness int, white_balance int, processing_status string, qc_status string, ocr_status string, export_status string"
    df = same_as_sql(spark, "a11_bulk_adjust", {"capture_job": (jobs, ddl), "adjust_request": (asked, "batch_id long, template_id string, job_id string")})
    assert df.where("changed").count() > 20
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3


def test_pages_with_boxes_meet_texts_once(spark):
    words = [(d if d else None, 5 if w % 7 else 4, w, w, 8 * (w % 3), 9, " " if w % 5 == 0 else f"w{w}") for d in range(0, 40, 2) for w in range(d % 9)]
    pages = [(d if d else None, [f"a\r\nb{d}", " ", None, "one"][d % 4 if d % 3 else 3]) for d in range(45)]
    df = same_as_sql(spark, "t01_text_layer", {"ocr_box": (words, "doc_id long, level int, left_px int, top_px int, width int, height int, text string"), "documents": (pages, "doc_id long, text string")})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("LeftAnti") :]


def test_what_derives_from_originals_is_that_of_the_sql(spark):
    # Originals twice, without a path or an ending, of another case; files that answer to two names, that are listed twice, or have no path.
    listing = [(p, 1) for i, p in enumerate(PATHS) if i % 3] + [(p, 2) for p in PATHS[::7]] + [(None, 1), (".tif", 1), ("_processed.tif", 1)]
    jobs = [*JOBS, *[(f"k{i}", i, 1, DAY, "Completed", "Pending", p, None) for i, p in enumerate(["", ".jpg", "/a/", "/A/P1.tif", None, *PATHS[::5]])]]
    df = same_as_sql(spark, "b10_is_derivative", {"capture_job": (jobs, JOB), "listing": (listing, "path string, length long")})
    assert df.count() > 100


def test_paths_are_not_made_anew_to_see_that_they_are_there(spark):
    plan = catalog.queries()["b10_is_derivative"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.splitlines() if "Filter" in line]
    assert tests and not [line for line in tests if "concat" in line or "substring" in line]


def test_files_are_told_apart_by_short_keys(spark):
    rows = [(None if i % 97 == 0 else i % 40, i % 90, i % 26, None if i % 89 == 0 else (i % 3) * 1234567 - 5 * (i % 7 == 0), [None, "R", "N"][i % 3]) for i in range(3000)]
    lineitem = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string")
    sql = VIEWS["listing"][0]
    con = duckdb.connect()
    arrow = lineitem.toArrow()  # noqa: F841
    con.execute("CREATE TABLE lineitem AS SELECT * FROM arrow")
    df = run_sql(spark, sql["spark"], {"lineitem": lineitem})
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(sql["duckdb"]).fetchall())
    assert df.schema.simpleString() == "struct<path:string,length:bigint>"
    keys = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert len(keys) == 1 and "l_orderkey" in keys[0].split("]")[0]  # not by whole paths
