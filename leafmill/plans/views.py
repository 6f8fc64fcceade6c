"""Canonical tables of a page archive, derived from the driver's tables; in SQL that Spark and DuckDB both take unless noted."""

from __future__ import annotations

PROJECT = "SELECT n_nationkey AS project_id, n_name AS name, concat('/archive/', n_name) AS output_directory FROM nation"

CALIBRATION = """SELECT s_suppkey AS calibration_id, s_nationkey AS project_id,
       TIMESTAMP '2023-01-01 00:00:00' + s_suppkey * INTERVAL '1' DAY AS calibrated_utc,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(8.5 AS DOUBLE) END AS target_w_in,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(11.0 AS DOUBLE) END AS target_h_in,
       CASE WHEN s_suppkey % 9 = 0 THEN CAST(50.0 AS DOUBLE) ELSE 2000.0 + abs(s_acctbal) / 10 END AS pixel_w,
       CASE WHEN s_suppkey % 9 = 0 THEN CAST(60.0 AS DOUBLE) ELSE 2600.0 + abs(s_acctbal) / 10 END AS pixel_h,
       (s_suppkey % 20) / CAST(10.0 AS DOUBLE) AS reprojection_error_px
FROM supplier"""

BATCH = """SELECT o_orderkey AS batch_id, CAST(o_custkey % 25 AS INT) AS project_id, concat('B', CAST(o_orderkey AS STRING)) AS batch_code,
       CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'P' THEN 'Completed' ELSE 'Exported' END AS status,
       o_orderdate AS start_time,
       o_orderkey % 3 = 1 AS split_book_pages, o_orderkey % 2 = 0 AS dewarp_enabled, o_orderkey % 5 = 0 AS binarize_enabled,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('10.0,20.0,300.0,200.0;',
            CAST(o_orderkey % 500 AS STRING), ',50.0,400.0,500.0',
            CASE WHEN o_orderkey % 12 = 0 THEN ';1,2,oops,4' ELSE '' END) END AS fixed_frames,
       CASE WHEN o_orderkey % 4 = 0 THEN 960 ELSE 0 END AS frame_ref_w,
       CASE WHEN o_orderkey % 4 = 0 THEN 640 ELSE 0 END AS frame_ref_h,
       CASE o_orderkey % 4 WHEN 0 THEN 150 WHEN 1 THEN 200 WHEN 2 THEN 300 ELSE 400 END AS dpi
FROM orders"""

JOB_KEY = "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(l_quantity AS INT) AS STRING))"

CAPTURE_JOB = f"""SELECT {JOB_KEY} AS job_id,
       l_orderkey AS batch_id, l_linenumber AS page_number, l_shipdate AS ts,
       CASE l_partkey % 10 WHEN 0 THEN 'Pending' WHEN 1 THEN 'InProgress' WHEN 2 THEN 'Failed' WHEN 3 THEN 'Superseded' ELSE 'Completed' END AS processing_status,
       CASE l_partkey % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'PASS' ELSE 'Pending' END AS qc_status,
       CASE l_suppkey % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Skipped' ELSE 'Pending' END AS ocr_status,
       CASE WHEN l_partkey % 10 = 3 OR l_partkey % 11 = 0 THEN 'Superseded' WHEN l_suppkey % 7 = 0 THEN 'Completed' ELSE 'Pending' END AS export_status,
       concat('/archive/B', CAST(l_orderkey AS STRING), '/B', CAST(l_orderkey AS STRING), '_', lpad(CAST(l_linenumber AS STRING), 6, '0'),
              CASE WHEN l_returnflag = 'R' THEN '_R' ELSE '' END, '.jpg') AS original_path,
       CASE WHEN l_partkey % 10 IN (4, 5, 6) THEN concat('/archive/B', CAST(l_orderkey AS STRING), '/p', CAST(l_partkey AS STRING), '_1_left.tif;/archive/B',
              CAST(l_orderkey AS STRING), '/p', CAST(l_partkey AS STRING), '_2_right.tif') END AS processed_path,
       CASE l_suppkey % 3 WHEN 0 THEN 'TIFF' WHEN 1 THEN 'JPG' ELSE 'PNG' END AS capture_format,
       CAST((l_partkey % 21 - 10) * 45 AS INT) AS rotation_degrees,
       l_discount * 30 - 1.5 AS brightness, l_tax * 30 - 1.2 AS contrast, l_discount * 20 - 1.0 AS saturation,
       l_tax * 20 AS sharpness, l_discount * 10 - 0.5 AS white_balance, l_partkey % 3 = 0 AS flip_horizontal, l_partkey % 5 = 0 AS flip_vertical, l_partkey % 6 = 1 AS manual_crop,
       CASE l_partkey % 4 WHEN 0 THEN concat('10.0,10.0,', CAST(200 + l_partkey % 100 AS STRING), '.0,12.0,210.0,150.0,8.0,148.0')
                          WHEN 1 THEN concat('5,5,', CAST(100 + l_partkey % 900 AS STRING), ',120')
                          WHEN 2 THEN 'not,a,box' END AS left_crop_box
FROM lineitem"""

#: What operators ask for: adjustments of a whole batch (no job_id) or of some jobs, batches to resume, ordered lists of pages (one id unknown), edited crops, and where the text engine is installed.
ADJUST_REQUEST = """SELECT b.batch_id, f.template_id, CAST(NULL AS STRING) AS job_id FROM (SELECT DISTINCT batch_id FROM capture_job WHERE batch_id % 3 = 0) b JOIN (SELECT batch_id, min(job_id) AS template_id FROM capture_job GROUP BY batch_id) f ON f.batch_id = b.batch_id
UNION ALL SELECT j.batch_id, f.template_id, j.job_id FROM capture_job j JOIN (SELECT batch_id, min(job_id) AS template_id FROM capture_job GROUP BY batch_id) f ON f.batch_id = j.batch_id WHERE j.batch_id % 3 = 1 AND j.page_number <= 3"""
BATCH_REQUEST = """SELECT batch_id AS request_id, project_id, CASE WHEN batch_id % 7 = 0 THEN concat('N', batch_code) ELSE batch_code END AS batch_code, split_book_pages, fixed_frames, dpi FROM batch WHERE batch_id % 2 = 0"""
EXPORT_REQUEST = """SELECT batch_id, 100 - page_number AS position, job_id FROM capture_job WHERE batch_id % 5 = 0 AND page_number <> 2 UNION ALL SELECT batch_id, 0, concat('gone-', CAST(batch_id AS STRING)) FROM batch WHERE batch_id % 5 = 0"""
CROP_EDIT = "SELECT job_id, edited AS left_crop_box FROM (SELECT job_id, lead(left_crop_box) OVER w AS edited, lead(job_id) OVER w AS next FROM capture_job WINDOW w AS (PARTITION BY batch_id, page_number ORDER BY ts, job_id)) e WHERE next IS NOT NULL"
OCR_SITE = "SELECT batch_id, batch_id % 7 <> 0 AS engine FROM batch"
#: Writes of output paths.
OUTPUT_EVENT = "SELECT event_id, ts, user_id AS job_id, concat('/archive/', CAST(event_id AS STRING), '.tif', CASE WHEN event_id % 2 = 0 THEN concat(';/archive/', CAST(event_id AS STRING), '_2.tif') ELSE '' END) AS paths FROM events WHERE event_id % 3 = 0"

#: Settings as stored or typed: curves and calibrations, some of them malformed, names that no file may have, and codes that a camera reports.
CURVE_TEXT = """SELECT job_id, concat('top:0,', CAST(page_number AS STRING), ',500,12', CASE WHEN batch_id % 5 = 0 THEN ',7' WHEN batch_id % 7 = 0 THEN ',x,1' ELSE '' END, CASE WHEN batch_id % 11 = 0 THEN '' ELSE concat(';bottom:0,', CAST(batch_id % 900 AS STRING), ',500,880') END) AS txt FROM capture_job"""
CALIBRATION_TEXT = """SELECT calibration_id, concat('3000,3010,', CAST(calibration_id AS STRING), ',900', CASE WHEN calibration_id % 4 = 0 THEN ',1' ELSE '' END, ';0.1,-0.2', CASE WHEN calibration_id % 10 = 1 THEN ',?' ELSE '' END, CASE WHEN calibration_id % 3 = 0 THEN '' WHEN calibration_id % 10 = 2 THEN ';4000,x' ELSE ';4000,3000' END) AS txt FROM calibration"""
GIVEN_NAME = "SELECT c_custkey AS id, concat(CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END, CASE WHEN c_custkey % 3 = 0 THEN ':a/b?' ELSE '' END) AS name FROM customer"
SETTING_CODE = "SELECT * FROM (VALUES ('iso', 1, 'ISO 100'), ('iso', 2, 'ISO 200'), ('iso', 3, 'ISO 400'), ('av', 1, 'f/4'), ('av', 2, 'f/5.6'), ('av', 4, 'f/8'), ('tv', 1, '1/60'), ('tv', 3, '1/125'), ('tv', 5, '1/250')) AS t(setting, code, name)"
SETTING_READING = "SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'iso' WHEN 1 THEN 'av' ELSE 'tv' END AS setting, l_linenumber AS code FROM lineitem"

JOB_EVENT = """SELECT event_id, ts, user_id AS job_id,
       CASE WHEN event_type = 'signup' AND event_id % 17 = 0 THEN 'supersede'
            WHEN event_type IN ('view', 'purchase', 'error') THEN 'processing'
            WHEN event_type = 'click' THEN 'qc' ELSE 'ocr' END AS status_type,
       CASE WHEN event_type = 'signup' AND event_id % 17 = 0 THEN 'Superseded'
            WHEN event_type = 'view' THEN 'InProgress' WHEN event_type = 'purchase' THEN 'Completed'
            WHEN event_type = 'error' THEN 'Failed' WHEN event_type = 'click' THEN 'PASS' ELSE 'Completed' END AS new_status
FROM events"""

LIVE_FRAME = """SELECT event_id AS frame_id, user_id AS stream_id, ts, event_type <> 'error' AS detected,
       CAST(100 + event_id % 3 * 15 AS DOUBLE) AS x, CAST(80 AS DOUBLE) AS y, CAST(400 AS DOUBLE) AS w, CAST(300 AS DOUBLE) AS h,
       value AS sharpness, event_id % 500 AS vec_id
FROM events"""

_GRAY = "CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT)"
SCANLINE = {
    "spark": f"SELECT label AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS y, transform(embedding, v -> {_GRAY}) AS gray FROM embeddings",
    "duckdb": f"SELECT label AS image_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS y, list_transform(embedding, lambda v: {_GRAY}) AS gray FROM embeddings",
}
PIXEL = {
    "spark": "SELECT image_id, y, posexplode(gray) AS (x, v) FROM scanline",
    "duckdb": "SELECT image_id, y, CAST(unnest(range(len(gray))) AS INT) AS x, unnest(gray) AS v FROM scanline",
}
#: Colour from three images of the table: red its own, green and blue the next two of ten.
COLOUR_LINE = """SELECT r.image_id, r.y, r.gray AS r, g.gray AS g, b.gray AS b FROM scanline r JOIN scanline g ON g.image_id = (r.image_id + 1) % 10 AND g.y = r.y JOIN scanline b ON b.image_id = (r.image_id + 2) % 10 AND b.y = r.y"""
COLOUR_PIXEL = {
    "spark": "SELECT image_id, y, p.x, p.v.r, p.v.g, p.v.b FROM (SELECT image_id, y, posexplode(arrays_zip(r, g, b)) AS (x, v) FROM colour_line) p",
    "duckdb": "SELECT image_id, y, CAST(unnest(range(len(r))) AS INT) AS x, unnest(r) AS r, unnest(g) AS g, unnest(b) AS b FROM colour_line",
}
#: Tone settings of an image: those of the first job of its number.
TONE_SETTING = f"""SELECT image_id, white_balance, brightness, contrast, saturation FROM (SELECT l_partkey % 10 AS image_id, l_discount * 10 - 0.5 AS white_balance, l_discount * 3 - 0.15 AS brightness, l_tax * 10 - 0.4 AS contrast,
    CASE WHEN l_partkey % 10 = 4 THEN 0e0 ELSE l_discount * 20 - 1.0 END AS saturation, row_number() OVER (PARTITION BY l_partkey % 10 ORDER BY {JOB_KEY}) AS place FROM lineitem) t WHERE place = 1"""
#: A straight line down each image, aslant.
BRIDGE = "SELECT image_id, y, (20 + image_id) + 3e-1 * (y % 40) AS guess FROM scanline"
_FRAMES = "CAST(CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 0.55e0 WHEN 2 THEN 0.2e0 ELSE 0.99e0 END AS DOUBLE) AS x, CAST(CASE k WHEN 2 THEN 0.1e0 WHEN 3 THEN 0.99e0 ELSE 0e0 END AS DOUBLE) AS y, CAST(CASE k WHEN 2 THEN 0.5e0 + image_id * 0.01e0 WHEN 3 THEN 0.5e0 ELSE 0.45e0 END AS DOUBLE) AS w, CAST(CASE k WHEN 2 THEN 0.6e0 WHEN 3 THEN 0.5e0 ELSE 1e0 END AS DOUBLE) AS h"
#: Four frames of each image: the halves, one over both, and a corner too small to measure.
IMAGE_FRAME = {
    "spark": f"SELECT image_id, k AS frame_no, {_FRAMES} FROM (SELECT image_id, explode(sequence(0, 3)) AS k FROM (SELECT DISTINCT image_id FROM scanline) i) f",
    "duckdb": f"SELECT image_id, CAST(k AS INT) AS frame_no, {_FRAMES} FROM (SELECT image_id, unnest(range(4)) AS k FROM (SELECT DISTINCT image_id FROM scanline) i) f",
}
#: Calibration photos: the batches of a project; some can't be decoded, some are of another size. Markers: three for each job's line.
CALIBRATION_IMAGE = """SELECT CAST(o_custkey % 500 AS INT) AS set_id, o_orderkey AS image_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 3000 ELSE 4000 END AS width, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 3000 END AS height,
    (o_custkey % 500 % 20) / CAST(10 AS DOUBLE) AS error_px FROM orders"""
MARKER = " UNION ALL ".join(f"SELECT l_orderkey AS image_id, CAST((l_partkey + {k} * l_linenumber) % 9 AS INT) AS marker_id FROM lineitem" for k in range(3))
#: Pages that someone asked to split, some at a place of their own.
SPLIT_REQUEST = "SELECT image_id, image_id % 3 = 0 AS requested, CASE WHEN image_id % 2 = 0 THEN CAST(20 * image_id - 10 AS INT) END AS percent FROM (SELECT DISTINCT image_id FROM scanline) i WHERE image_id <> 9"
PROFILE = "SELECT image_id, x AS pos, avg(v) AS val FROM pixel GROUP BY image_id, x"

SOBEL_PASSES = """n AS (SELECT image_id, y, x, v, 2 * v + coalesce(lag(v) OVER wx, lead(v) OVER wx) + coalesce(lead(v) OVER wx, lag(v) OVER wx) AS s,
                  coalesce(lead(v) OVER wx, lag(v) OVER wx) - coalesce(lag(v) OVER wx, lead(v) OVER wx) AS d
           FROM pixel WINDOW wx AS (PARTITION BY image_id, y ORDER BY x)),
     g AS (SELECT image_id, y, x, v, coalesce(lead(s) OVER wy, lag(s) OVER wy) - coalesce(lag(s) OVER wy, lead(s) OVER wy) AS gy,
                  2 * d + coalesce(lag(d) OVER wy, lead(d) OVER wy) + coalesce(lead(d) OVER wy, lag(d) OVER wy) AS gx
           FROM n WINDOW wy AS (PARTITION BY image_id, x ORDER BY y))"""

#: Down the columns in Spark, with the sums along a row taken in its array: pixels move and are sorted once, by column, and the strongest row comes from a largest key of (strength, upper row first).
_SOBEL_DOWN = """n AS (SELECT image_id, y, posexplode(transform(gray, (v, x) -> 2 * v + coalesce(get(gray, x - 1), get(gray, x + 1)) + coalesce(get(gray, x + 1), get(gray, x - 1)))) AS (x, s) FROM scanline),
     g AS (SELECT image_id, y, x, coalesce(lead(s) OVER wy, lag(s) OVER wy) - coalesce(lag(s) OVER wy, lead(s) OVER wy) AS gy FROM n WINDOW wy AS (PARTITION BY image_id, x ORDER BY y))"""
_KEY, _ROW = "CAST(coalesce(abs(gy), -1) AS BIGINT) * 4294967296 - y", "CAST(ceil({k} / 4294967296D) AS BIGINT) * 4294967296 - {k}"

EDGE = f"""WITH {SOBEL_PASSES},
     r AS (SELECT *, row_number() OVER (PARTITION BY image_id, x ORDER BY abs(gy) DESC, y) AS rn FROM g)
SELECT image_id, x AS pos, CAST(y AS DOUBLE) AS row_val, CAST(abs(gy) AS DOUBLE) AS strength FROM r WHERE rn = 1"""

#: Strongest row of each column in the upper and in the lower half.
EDGE_PAIR = {
    "spark": f"""WITH {_SOBEL_DOWN}, z AS (SELECT image_id, max(y) + 1 AS h FROM scanline WHERE size(gray) > 0 GROUP BY image_id),
     k AS (SELECT g.image_id, x, max(CASE WHEN 2 * y < h THEN {_KEY} END) AS upper, max(CASE WHEN NOT 2 * y < h THEN {_KEY} END) AS lower FROM g JOIN z ON g.image_id <=> z.image_id GROUP BY g.image_id, x)
SELECT image_id, x AS pos, CAST({_ROW.format(k="upper")} AS DOUBLE) AS top, CAST({_ROW.format(k="lower")} AS DOUBLE) AS bottom FROM k WHERE upper IS NOT NULL AND lower IS NOT NULL""",
    "duckdb": f"""WITH {SOBEL_PASSES},
     h AS (SELECT *, CASE WHEN 2 * y < max(y) OVER (PARTITION BY image_id) + 1 THEN 0 ELSE 1 END AS half FROM g),
     r AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, half ORDER BY abs(gy) DESC, y) AS rn FROM h)
SELECT image_id, x AS pos, CAST(max(CASE WHEN half = 0 THEN y END) AS DOUBLE) AS top, CAST(max(CASE WHEN half = 1 THEN y END) AS DOUBLE) AS bottom FROM r WHERE rn = 1 GROUP BY image_id, x HAVING count(*) = 2""",
}

#: Points of strong gradient, thinned evenly to 5000 an image.
EDGE_POINT = f"""WITH {SOBEL_PASSES},
     m AS (SELECT image_id, y, x FROM g WHERE gx * gx + gy * gy > 90000),
     r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM m)
SELECT image_id, x, y FROM r WHERE k % CAST(ceil(n / 5000.0) AS INT) = 0"""

#: Sides 0 to 3 of each image's outline, clockwise, each from the corner of its number; a little aslant.
SEGMENT = """WITH b AS (SELECT image_id, min(x) + 1e0 AS x0, max(x) - 1e0 AS x1, min(y) + 2e0 AS y0, max(y) - 2e0 AS y1 FROM edge_point GROUP BY image_id)
SELECT image_id, 0 AS side, x0 AS ax, y0 AS ay, x1 AS ex, y0 + 1 AS ey FROM b UNION ALL SELECT image_id, 1, x1, y0 + 1, x1 - 1, y1 FROM b
UNION ALL SELECT image_id, 2, x1 - 1, y1, x0, y1 - 1 FROM b UNION ALL SELECT image_id, 3, x0, y1 - 1, x0, y0 FROM b"""

_WORD = """SELECT doc_id, CASE WHEN pos % 13 = 12 THEN 4 ELSE 5 END AS level, 1 AS block_num, 1 AS par_num,
       CAST(floor(pos / 10.0) AS INT) AS line_num, CAST(pos % 10 AS INT) AS word_num,
       CAST(pos % 10 * 80 + 2 * floor(pos / 10.0) AS INT) AS left_px,
       CAST(24 * floor(pos / 10.0) + pos % 10 AS INT) AS top_px,
       CAST(length(w) * 8 AS INT) AS width, 18 AS height, CAST(96.0 AS DOUBLE) AS conf, w AS text
FROM u"""
OCR_WORD = {
    "spark": "WITH u AS (SELECT doc_id, posexplode(split(text, ' ')) AS (pos, w) FROM documents) " + _WORD,
    "duckdb": "WITH t AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), u AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS w FROM t) " + _WORD,
}

#: Boxes of a text layer: every tenth page was not read into boxes.
OCR_BOX = "SELECT * FROM ocr_word WHERE doc_id % 10 <> 0"

LISTING = {
    "duckdb": """WITH b AS (SELECT l_partkey, l_suppkey, concat('/archive/B', CAST(l_orderkey AS STRING), '/') AS dir,
                  concat('B', CAST(l_orderkey AS STRING), '_', lpad(CAST(l_linenumber AS STRING), 6, '0'), CASE WHEN l_returnflag = 'R' THEN '_R' ELSE '' END) AS base
           FROM lineitem),
     f AS (SELECT concat(dir, base, '.jpg') AS path, l_partkey FROM b WHERE l_suppkey % 13 <> 0
           UNION ALL SELECT concat(dir, 'p', CAST(l_partkey AS STRING), '_1_left.tif'), l_partkey FROM b WHERE l_partkey % 10 = 4
           UNION ALL SELECT concat(dir, 'p', CAST(l_partkey AS STRING), '_2_right.tif'), l_partkey FROM b WHERE l_partkey % 10 = 4
           UNION ALL SELECT concat(dir, base, '_processed.tif'), l_partkey FROM b WHERE l_partkey % 10 = 7
           UNION ALL SELECT concat(dir, 'Processed/', base, '.tif'), l_partkey FROM b WHERE l_partkey % 10 = 8)
SELECT path, CAST(min(CASE WHEN l_partkey % 50 = 8 THEN 0 ELSE 1000 + l_partkey END) AS BIGINT) AS length FROM f GROUP BY path""",
    # The same, but files are told apart by folder and name before their paths are made: short keys, and each path is made once. concat_ws leaves out nulls as DuckDB's concat does.
    "spark": """WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, concat_ws('', lpad(CAST(l_linenumber AS STRING), 6, '0'), CASE WHEN l_returnflag = 'R' THEN '_R' END) AS page FROM lineitem),
     f AS (SELECT l_orderkey, 0 AS kind, page AS name, l_partkey FROM b WHERE l_suppkey % 13 <> 0
           UNION ALL SELECT l_orderkey, CAST(l_partkey % 10 AS INT), CASE WHEN l_partkey % 10 = 4 THEN CAST(l_partkey AS STRING) ELSE page END, l_partkey FROM b WHERE l_partkey % 10 IN (4, 7, 8)),
     g AS (SELECT l_orderkey, kind, name, CAST(min(CASE WHEN l_partkey % 50 = 8 THEN 0 ELSE 1000 + l_partkey END) AS BIGINT) AS length FROM f GROUP BY l_orderkey, kind, name),
     d AS (SELECT kind, name, length, CAST(l_orderkey AS STRING) AS code FROM g)
SELECT explode(CASE kind WHEN 4 THEN array(concat_ws('', '/archive/B', code, '/p', name, '_1_left.tif'), concat_ws('', '/archive/B', code, '/p', name, '_2_right.tif'))
    WHEN 7 THEN array(concat_ws('', '/archive/B', code, '/B', code, '_', name, '_processed.tif')) WHEN 8 THEN array(concat_ws('', '/archive/B', code, '/Processed/B', code, '_', name, '.tif'))
    ELSE array(concat_ws('', '/archive/B', code, '/B', code, '_', name, '.jpg')) END) AS path, length FROM d""",
}

VALIDATION = """SELECT l_orderkey AS image, l_linenumber AS page, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS image_id,
       CASE WHEN l_linestatus = 'F' THEN 'current' ELSE 'previous' END AS run,
       CASE WHEN l_partkey % 9 = 0 THEN 'FLAG' ELSE 'OK' END AS top_status, CASE WHEN l_partkey % 11 = 0 THEN 'FLAG' ELSE 'OK' END AS bottom_status,
       CASE WHEN l_suppkey % 7 = 0 THEN 'FLAG' ELSE 'OK' END AS left_status, CASE WHEN l_suppkey % 8 = 0 THEN 'FLAG' ELSE 'OK' END AS right_status,
       CASE WHEN l_linenumber % 3 = 0 THEN 'NONE' ELSE 'OK' END AS gutter_status
FROM lineitem"""

CONTOUR = f"""SELECT l_orderkey AS image_id, CAST(l_partkey % 3 AS INT) AS pass, {JOB_KEY} AS contour_id,
       50000 + 5 * l_extendedprice AS area, (50000 + 5 * l_extendedprice) * (1 + l_tax) AS rect_area,
       CAST(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 20 + l_partkey % 400 END AS INT) AS x, CAST(30 + l_suppkey % 40 AS INT) AS y,
       CAST(200 + l_partkey % 380 AS INT) AS w, CAST(300 + l_suppkey % 400 AS INT) AS h
FROM lineitem"""

LINE_SAMPLE = "SELECT doc_id, line_num, left_px + width / CAST(2 AS DOUBLE) AS x, top_px + height / CAST(2 AS DOUBLE) AS y FROM ocr_word WHERE level = 5 AND trim(text) <> ''"

#: name -> (SQL or SQL by dialect, tables it reads)
VIEWS: dict[str, tuple[str | dict[str, str], tuple[str, ...]]] = {
    "project": (PROJECT, ("nation",)), "calibration": (CALIBRATION, ("supplier",)), "batch": (BATCH, ("orders",)), "capture_job": (CAPTURE_JOB, ("lineitem",)),
    "curve_text": (CURVE_TEXT, ("capture_job",)), "calibration_text": (CALIBRATION_TEXT, ("calibration",)), "given_name": (GIVEN_NAME, ("customer",)), "setting_code": (SETTING_CODE, ()), "setting_reading": (SETTING_READING, ("lineitem",)),
    "adjust_request": (ADJUST_REQUEST, ("capture_job",)), "batch_request": (BATCH_REQUEST, ("batch",)), "export_request": (EXPORT_REQUEST, ("capture_job", "batch")), "crop_edit": (CROP_EDIT, ("capture_job",)), "ocr_site": (OCR_SITE, ("batch",)), "output_event": (OUTPUT_EVENT, ("events",)),
    "job_event": (JOB_EVENT, ("events",)), "live_frame": (LIVE_FRAME, ("events",)), "scanline": (SCANLINE, ("embeddings",)), "pixel": (PIXEL, ("scanline",)),
    "colour_line": (COLOUR_LINE, ("scanline",)), "colour_pixel": (COLOUR_PIXEL, ("colour_line",)), "tone_setting": (TONE_SETTING, ("lineitem",)), "bridge": (BRIDGE, ("scanline",)), "split_request": (SPLIT_REQUEST, ("scanline",)), "calibration_image": (CALIBRATION_IMAGE, ("orders",)), "marker": (MARKER, ("lineitem",)), "image_frame": (IMAGE_FRAME, ("scanline",)),
    "profile": (PROFILE, ("pixel",)), "edge": (EDGE, ("pixel",)), "ocr_word": (OCR_WORD, ("documents",)), "ocr_box": (OCR_BOX, ("ocr_word",)), "listing": (LISTING, ("lineitem",)),
    "validation": (VALIDATION, ("lineitem",)), "contour": (CONTOUR, ("lineitem",)), "line_sample": (LINE_SAMPLE, ("ocr_word",)),
    "edge_pair": (EDGE_PAIR, ("scanline", "pixel")), "edge_point": (EDGE_POINT, ("pixel",)), "segment": (SEGMENT, ("edge_point",)),
}
