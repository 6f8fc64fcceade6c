"""The job ledger: latest attempts, superseding, gates, manifests."""

from __future__ import annotations

from ..plans.plan import Plan

#: Newest completed attempt of each page that was not superseded; ties on time go to the smaller job id.
FINAL = """f AS (SELECT * FROM (SELECT j.*, row_number() OVER (PARTITION BY batch_id, page_number ORDER BY ts DESC, job_id) AS rn
             FROM capture_job j WHERE processing_status = 'Completed' AND export_status <> 'Superseded') q WHERE rn = 1)"""

#: Status events with the moment from which a job takes no more: the first supersede.
FOLD = """s AS (SELECT *, min(CASE WHEN lower(status_type) = 'supersede' THEN ts END) OVER (PARTITION BY job_id) AS cut FROM job_event),
     e AS (SELECT *, lower(status_type) AS field FROM s WHERE lower(status_type) IN ('processing', 'qc', 'ocr', 'export') AND (cut IS NULL OR ts < cut)),
     l AS (SELECT *, row_number() OVER (PARTITION BY job_id, field ORDER BY ts DESC, event_id DESC) AS rn FROM e),
     k AS (SELECT job_id, max(CASE WHEN field = 'processing' THEN new_status END) AS processing, max(CASE WHEN field = 'qc' THEN new_status END) AS qc,
                  max(CASE WHEN field = 'ocr' THEN new_status END) AS ocr, max(CASE WHEN field = 'export' THEN new_status END) AS export FROM l WHERE rn = 1 GROUP BY job_id),
     a AS (SELECT job_id, max(CASE WHEN cut IS NOT NULL THEN 1 ELSE 0 END) AS gone FROM s GROUP BY job_id)"""

def _as_of(*more: str) -> str:
    """known(project_id, start_time, cal): the calibration, with `more` of its columns, that was active at each time at which a batch of the project started.

    The last calibration of earlier days and the last up to that time of the same day are found apart, so that no batch meets all calibrations of its project and no window holds all of them.
    """
    cal = ", ".join(("calibrated_utc", "calibration_id", *more))
    return f"""cd AS (SELECT project_id, date_trunc('DAY', calibrated_utc) AS day, struct({cal}) AS cal FROM calibration WHERE project_id IS NOT NULL AND calibrated_utc IS NOT NULL),
    asked AS (SELECT DISTINCT project_id, start_time, date_trunc('DAY', start_time) AS day FROM batch WHERE project_id IS NOT NULL AND start_time IS NOT NULL),
    days AS (SELECT project_id, day, max(cal) AS cal FROM (SELECT project_id, day, cal FROM cd UNION ALL SELECT DISTINCT project_id, day, NULL FROM asked) u GROUP BY project_id, day),
    before AS (SELECT project_id, day, max(cal) OVER (PARTITION BY project_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM days),
    within AS (SELECT *, max(cal) OVER (PARTITION BY project_id, day ORDER BY at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS same_day FROM (SELECT project_id, day, cal.calibrated_utc AS at, false AS wanted, cal FROM cd UNION ALL SELECT project_id, day, start_time, true, NULL FROM asked) u),
    known AS (SELECT w.project_id, w.at AS start_time, coalesce(w.same_day, b.earlier) AS cal FROM within w JOIN before b ON b.project_id = w.project_id AND b.day = w.day WHERE w.wanted)"""

#: A frame's four numbers.
FRAME = "^ *-?[0-9.]+ *, *-?[0-9.]+ *, *-?[0-9.]+ *, *-?[0-9.]+ *$"
OUTPUTS = "SELECT batch_id, CAST(CASE WHEN frames > 0 THEN frames WHEN split_book_pages THEN 2 ELSE 1 END AS INT) AS outputs FROM q"

#: Extension of a path, cut off.
STEM = "regexp_replace(path, '[.][^./]+$', '')"

GATE = "g AS (SELECT batch_id, CAST(sum(CASE WHEN processing_status IN ('Pending', 'InProgress') THEN 1 ELSE 0 END) AS BIGINT) AS waiting FROM capture_job GROUP BY batch_id)"

#: Positions and files of the pages to export. The job's recorded files, or its original if none.
FILES_SPARK = "m AS (SELECT f.job_id, f.batch_id, f.page_number, f.capture_format, posexplode(split(coalesce(processed_path, original_path), ';')) AS (file_pos, path) FROM f)"
FILES_DUCKDB = """m0 AS (SELECT f.*, string_split(coalesce(processed_path, original_path), ';') AS fs FROM f),
     m AS (SELECT job_id, batch_id, page_number, capture_format, unnest(range(len(fs))) AS file_pos, unnest(fs) AS path FROM m0)"""
MANIFEST = """SELECT n.job_id, n.batch_id, n.page_number, CAST(n.file_pos AS INT) AS file_pos, n.path, n.idx,
       concat(b.batch_code, '_Page_', lpad(CAST(n.idx AS STRING), 6, '0'), CASE n.capture_format WHEN 'TIFF' THEN '.tif' WHEN 'JPG' THEN '.jpg' ELSE '.png' END) AS target
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY page_number, job_id, file_pos, path) AS INT) AS idx FROM m) n JOIN batch b ON n.batch_id = b.batch_id"""

#: What a template gives to other jobs, and the statuses that go back.
ADJUSTMENTS = ("rotation_degrees", "flip_horizontal", "flip_vertical", "brightness", "contrast", "saturation", "sharpness", "white_balance")
FOUR = ("processing", "qc", "ocr", "export")

PLANS = {
    "a01_enqueue": Plan(("capture_job", "batch"), "New captures with every status Pending, and the batch's resolution stamped on the row.",
        "SELECT concat(j.job_id, '-n') AS job_id, j.batch_id, j.page_number, j.ts, j.original_path, j.capture_format, b.dpi, 'Pending' AS processing_status, 'Pending' AS qc_status, 'Pending' AS ocr_status, 'Pending' AS export_status FROM capture_job j JOIN batch b ON j.batch_id = b.batch_id"),
    "a02_pending_queue": Plan(("capture_job", "batch", "calibration"), "Pending jobs, oldest first, with their batch and its rig's newest calibration; both may be missing.",
        """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY calibrated_utc DESC, calibration_id) AS rn FROM calibration) q WHERE rn = 1)
        SELECT j.job_id, j.batch_id, j.ts, b.batch_code, b.dpi, c.calibration_id, CAST(row_number() OVER (PARTITION BY j.batch_id ORDER BY j.ts, j.job_id) AS INT) AS place
        FROM capture_job j LEFT JOIN batch b ON j.batch_id = b.batch_id LEFT JOIN c ON b.project_id = c.project_id WHERE j.processing_status = 'Pending'"""),
    "a03_recover_interrupted": Plan(("capture_job",), "Jobs in progress go back to Pending; how many, by batch.",
        "SELECT batch_id, count(*) AS jobs, sum(CASE WHEN processing_status = 'InProgress' THEN 1 ELSE 0 END) AS recovered, sum(CASE WHEN processing_status IN ('InProgress', 'Pending') THEN 1 ELSE 0 END) AS pending FROM capture_job GROUP BY batch_id"),
    "a04_final_page_set": Plan(("capture_job",), "The newest completed attempt of each page that was not superseded.",
        f"WITH {FINAL} SELECT job_id, batch_id, page_number, ts, original_path, processed_path FROM f"),
    "a05_supersede_page": Plan(("capture_job",), "With a newer attempt, all earlier ones of a page are superseded in processing and export, unless they are already.",
        """SELECT job_id, batch_id, page_number, CASE WHEN late AND export_status <> 'Superseded' THEN 'Superseded' ELSE processing_status END AS processing_status,
        CASE WHEN late THEN 'Superseded' ELSE export_status END AS export_status FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, page_number ORDER BY ts DESC, job_id) > 1 AS late FROM capture_job) q"""),
    "a06_delete_capture": Plan(("capture_job", "listing"), "Soft deletion of the jobs whose original is gone: the marks of A05, the row stays.",
        """SELECT j.job_id, CASE WHEN l.path IS NULL THEN 'Superseded' ELSE processing_status END AS processing_status, CASE WHEN l.path IS NULL THEN 'Superseded' ELSE export_status END AS export_status
        FROM capture_job j LEFT JOIN listing l ON j.original_path = l.path"""),
    "a07_fold_status": Plan(("job_event",), "Current statuses from the event log: the last write of each field counts, none after a supersede; unknown fields are ignored.",
        f"""WITH {FOLD} SELECT a.job_id, CASE WHEN gone = 1 THEN 'Superseded' ELSE coalesce(processing, 'Pending') END AS processing_status, coalesce(qc, 'Pending') AS qc_status,
        coalesce(ocr, 'Pending') AS ocr_status, CASE WHEN gone = 1 THEN 'Superseded' ELSE coalesce(export, 'Pending') END AS export_status FROM a LEFT JOIN k ON a.job_id = k.job_id"""),
    "a08_set_outputs": Plan(("job_event", "output_event"), "Output paths from the log of their writes: the last one counts, none from the first supersede on; null if there is none.",
        """WITH k AS (SELECT job_id, min(CASE WHEN lower(status_type) = 'supersede' THEN ts END) AS cut FROM job_event GROUP BY job_id), j AS (SELECT job_id FROM job_event UNION SELECT job_id FROM output_event),
        w AS (SELECT o.job_id, o.paths, row_number() OVER (PARTITION BY o.job_id ORDER BY o.ts DESC, o.event_id DESC) AS rn FROM output_event o LEFT JOIN k ON k.job_id = o.job_id WHERE k.cut IS NULL OR o.ts < k.cut)
        SELECT j.job_id, w.paths AS processed_path, CASE WHEN w.paths IS NULL THEN 0 ELSE length(w.paths) - length(replace(w.paths, ';', '')) + 1 END AS n_outputs FROM j LEFT JOIN w ON w.job_id = j.job_id AND w.rn = 1"""),
    "a09_recent_batches": Plan(("batch", "project", "capture_job"), "Batches, newest first, with their project's name and the largest page number of any attempt.",
        """WITH p AS (SELECT batch_id, max(page_number) AS pages FROM capture_job GROUP BY batch_id)
        SELECT b.batch_id, b.batch_code, coalesce(r.name, '(unknown project)') AS project_name, coalesce(p.pages, 0) AS pages, concat(CAST(coalesce(p.pages, 0) AS STRING), ' page(s)') AS pages_text, b.start_time,
        CAST(row_number() OVER (PARTITION BY b.project_id ORDER BY b.start_time DESC, b.batch_id) AS INT) AS place
        FROM batch b LEFT JOIN project r ON b.project_id = r.project_id LEFT JOIN p ON b.batch_id = p.batch_id"""),
    "a10_latest_pages": Plan(("capture_job",), "At most 100 pages of a batch, highest first: the newest attempt of each that was not superseded, with a label.",
        """WITH n AS (SELECT *, row_number() OVER (PARTITION BY batch_id, page_number ORDER BY ts DESC, job_id) AS rn FROM capture_job WHERE processing_status <> 'Superseded' AND export_status <> 'Superseded'),
        t AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY page_number DESC) AS place FROM n WHERE rn = 1)
        SELECT batch_id, page_number, job_id, CAST(place AS INT) AS place, CASE processing_status WHEN 'Completed' THEN 'Processed' WHEN 'Failed' THEN 'Processing failed' ELSE 'Processing' END AS label FROM t WHERE place <= 100"""),
    "a11_bulk_adjust": Plan(("capture_job", "adjust_request"), "A template's eight adjustments go to the jobs asked for (those of an id, or a whole batch without one), not to the template itself; they are flagged and queued again, superseded ones too. Of two templates the smaller id counts; unknown templates change nothing.",
        f"""WITH x AS (SELECT job_id, min(template_id) AS template_id FROM (SELECT job_id, template_id FROM adjust_request WHERE job_id IS NOT NULL UNION ALL SELECT j.job_id, r.template_id FROM capture_job j JOIN adjust_request r ON r.batch_id = j.batch_id AND r.job_id IS NULL) a WHERE job_id <> template_id GROUP BY job_id),
        t AS (SELECT x.job_id AS to_id, j.* FROM x JOIN capture_job j ON j.job_id = x.template_id)
        SELECT j.job_id, j.batch_id, {", ".join(f"CASE WHEN t.to_id IS NULL THEN j.{c} ELSE t.{c} END AS {c}" for c in ADJUSTMENTS)}, t.to_id IS NOT NULL AS changed, {", ".join(f"CASE WHEN t.to_id IS NULL THEN j.{c}_status ELSE 'Pending' END AS {c}_status" for c in FOUR)}
        FROM capture_job j LEFT JOIN t ON t.to_id = j.job_id""",
        f"""WITH x AS (SELECT job_id, min(template_id) AS template_id FROM (SELECT j.job_id, r.template_id FROM capture_job j JOIN adjust_request r ON r.job_id = j.job_id UNION SELECT j.job_id, r.template_id FROM capture_job j JOIN adjust_request r ON r.batch_id = j.batch_id AND r.job_id IS NULL) a WHERE job_id <> template_id GROUP BY job_id),
        t AS (SELECT x.job_id AS to_id, j.* FROM x JOIN capture_job j ON j.job_id = x.template_id)
        SELECT j.job_id, j.batch_id, {", ".join(f"CASE WHEN t.to_id IS NULL THEN j.{c} ELSE t.{c} END AS {c}" for c in ADJUSTMENTS)}, t.to_id IS NOT NULL AS changed, {", ".join(f"CASE WHEN t.to_id IS NULL THEN j.{c}_status ELSE 'Pending' END AS {c}_status" for c in FOUR)}
        FROM capture_job j LEFT JOIN t ON t.to_id = j.job_id"""),
    "a12_next_page_number": Plan(("capture_job",), "Where numbering resumes: after the highest page still held. Deleting the last page frees its number, an inner one does not.",
        "SELECT batch_id, coalesce(max(CASE WHEN processing_status <> 'Superseded' AND export_status <> 'Superseded' THEN page_number END), 0) + 1 AS next_page, max(page_number) + 1 AS next_of_all FROM capture_job GROUP BY batch_id"),
    "a13_resume_or_create": Plan(("batch", "batch_request"), "Each request for a batch code of a project: the active batch of that code (the newest), or a new one with a snapshot of the asked settings; no splitting if it has frames.",
        """WITH a AS (SELECT project_id, batch_code, max(batch_id) AS batch_id FROM batch WHERE status = 'Active' GROUP BY project_id, batch_code)
        SELECT r.request_id, r.project_id, r.batch_code, a.batch_id, a.batch_id IS NULL AS created, coalesce(b.dpi, r.dpi) AS dpi, CASE WHEN a.batch_id IS NOT NULL THEN b.split_book_pages WHEN trim(coalesce(r.fixed_frames, '')) <> '' THEN false ELSE r.split_book_pages END AS split_book_pages
        FROM batch_request r LEFT JOIN a ON r.project_id = a.project_id AND r.batch_code = a.batch_code LEFT JOIN batch b ON b.batch_id = a.batch_id"""),
    "a14_calibration_at_start": Plan(("batch", "calibration"), "As-of join: the rig's calibration that was active when the batch started, if any.",
        f"""WITH {_as_of()}
        SELECT b.batch_id, b.project_id, k.cal.calibration_id AS calibration_id, k.cal.calibrated_utc AS calibrated_utc FROM batch b LEFT JOIN known k ON k.project_id = b.project_id AND k.start_time = b.start_time""",
        """WITH c AS (SELECT *, lead(calibrated_utc) OVER (PARTITION BY project_id ORDER BY calibrated_utc, calibration_id) AS until FROM calibration)
        SELECT b.batch_id, b.project_id, c.calibration_id, c.calibrated_utc FROM batch b LEFT JOIN c ON b.project_id = c.project_id AND c.calibrated_utc <= b.start_time AND (c.until IS NULL OR b.start_time < c.until)"""),
    "a15_ocr_worklist": Plan(("capture_job",), "Final pages whose text is not read yet.", f"WITH {FINAL} SELECT job_id, batch_id, page_number, ocr_status FROM f WHERE ocr_status <> 'Completed'"),
    "a16_ocr_summary": Plan(("capture_job", "ocr_site"), "Counts of text reading by batch; all are skipped where the engine is missing. Batches of unknown sites have one.",
        f"""WITH {FINAL}, c AS (SELECT f.batch_id, max(CASE WHEN s.engine THEN 0 WHEN s.engine IS NULL THEN 0 ELSE 1 END) = 1 AS missing, sum(CASE WHEN ocr_status = 'Completed' THEN 1 ELSE 0 END) AS done, sum(CASE WHEN ocr_status = 'Failed' THEN 1 ELSE 0 END) AS failed, count(*) AS n FROM f LEFT JOIN ocr_site s ON s.batch_id = f.batch_id GROUP BY f.batch_id)
        SELECT batch_id, missing, CASE WHEN missing THEN 0 ELSE done END AS completed, CASE WHEN missing THEN 0 ELSE failed END AS failed, CASE WHEN missing THEN n ELSE n - done - failed END AS skipped,
        CASE WHEN missing THEN 'engine missing' WHEN failed > 0 THEN 'some pages failed' WHEN done = n THEN 'all pages read' ELSE 'some pages skipped' END AS message FROM c"""),
    "a17_export_plan": Plan(("capture_job", "batch", "export_request"), "Whether a batch can be exported and its pages in order: none without captures, none while a job waits. A list of ids wins over the final pages: its order holds, whatever the jobs' status, and unknown ids and those of other batches drop out.",
        f"""WITH {FINAL}, {GATE}, x AS (SELECT r.batch_id, j.job_id, j.page_number, min(r.position) AS place FROM export_request r JOIN capture_job j ON j.job_id = r.job_id AND j.batch_id = r.batch_id GROUP BY r.batch_id, j.job_id, j.page_number), listed AS (SELECT DISTINCT batch_id FROM export_request),
        pages AS (SELECT batch_id, job_id, page_number, place FROM x UNION ALL SELECT f.batch_id, f.job_id, f.page_number, f.page_number FROM f WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.batch_id = f.batch_id))
        SELECT b.batch_id, CASE WHEN g.batch_id IS NULL THEN 'no captures' WHEN g.waiting > 0 THEN 'blocked' ELSE 'ready' END AS state, p.job_id, p.page_number, CAST(row_number() OVER (PARTITION BY b.batch_id ORDER BY p.place, p.page_number, p.job_id) AS INT) AS position
        FROM batch b LEFT JOIN g ON b.batch_id = g.batch_id LEFT JOIN pages p ON b.batch_id = p.batch_id AND g.waiting = 0"""),
    "a18_export_manifest": Plan(("capture_job", "batch"), "Files to write: final pages' outputs, one running number for each batch, and the target's name.", f"WITH {FINAL}, {FILES_SPARK} {MANIFEST}", f"WITH {FINAL}, {FILES_DUCKDB} {MANIFEST}"),
    "a19_mark_exported": Plan(("capture_job", "batch"), "After export the final pages are Completed, and the batch Exported once none waits.",
        f"""WITH {FINAL}, {GATE} SELECT j.job_id, CASE WHEN f.job_id IS NOT NULL THEN 'Completed' ELSE j.export_status END AS export_status, CASE WHEN g.waiting = 0 THEN 'Exported' ELSE b.status END AS batch_status
        FROM capture_job j JOIN batch b ON j.batch_id = b.batch_id JOIN g ON j.batch_id = g.batch_id LEFT JOIN f ON j.job_id = f.job_id"""),
    "a20_cleanup_list": Plan(("capture_job",), "Files that may go after export: originals of final pages, and text files beside each output. A list; nothing is deleted.",
        f"""WITH {FINAL}, {FILES_SPARK}, t AS (SELECT batch_id, {STEM} AS stem FROM m)
        SELECT batch_id, original_path AS path, 'original' AS kind FROM f UNION ALL SELECT batch_id, concat(stem, '.txt'), 'text' FROM t UNION ALL SELECT batch_id, concat(stem, '.tsv'), 'words' FROM t""",
        f"""WITH {FINAL}, {FILES_DUCKDB}, t AS (SELECT batch_id, {STEM} AS stem FROM m)
        SELECT batch_id, original_path AS path, 'original' AS kind FROM f UNION ALL SELECT batch_id, concat(stem, '.txt'), 'text' FROM t UNION ALL SELECT batch_id, concat(stem, '.tsv'), 'words' FROM t"""),
    "a21_frame_edit_gate": Plan(("capture_job",), "Frames of a batch are locked while jobs wait, with their count.", f"WITH {GATE} SELECT batch_id, waiting > 0 AS locked, waiting FROM g"),
    "a22_last_format": Plan(("capture_job",), "Capture format of a batch's newest job.",
        "SELECT batch_id, capture_format FROM (SELECT batch_id, capture_format, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, job_id DESC) AS rn FROM capture_job) q WHERE rn = 1"),
    "a23_crop_requeue": Plan(("capture_job", "crop_edit"), "Edited crops of jobs: the manual flag is kept, or set where the geometry changed; all four statuses go to Pending. Edits of unknown jobs do nothing.",
        f"""SELECT j.job_id, e.left_crop_box, coalesce(j.manual_crop, false) OR (e.left_crop_box IS DISTINCT FROM j.left_crop_box) AS manual_crop, {", ".join(f"'Pending' AS {c}_status" for c in FOUR)} FROM capture_job j JOIN crop_edit e ON e.job_id = j.job_id"""),
    "a24_page_status": Plan(("capture_job",), "One label for a page; the first that fits.",
        "SELECT job_id, CASE WHEN processing_status = 'Failed' THEN 'Processing failed' WHEN ocr_status = 'Failed' THEN 'OCR failed' WHEN qc_status = 'FAIL' THEN 'QC fail' WHEN qc_status = 'WARNING' THEN 'Needs review' WHEN processing_status = 'Completed' THEN 'Processed' ELSE 'Processing' END AS label FROM capture_job"),
    "a25_severity": Plan(("capture_job",), "Severity of a status text or page label; the first rule that fits.",
        """WITH u AS (SELECT processing_status AS status FROM capture_job UNION ALL SELECT qc_status FROM capture_job UNION ALL SELECT ocr_status FROM capture_job UNION ALL SELECT export_status FROM capture_job
        UNION ALL SELECT CASE WHEN processing_status = 'Failed' THEN 'Processing failed' WHEN ocr_status = 'Failed' THEN 'OCR failed' WHEN qc_status = 'FAIL' THEN 'QC fail' WHEN qc_status = 'WARNING' THEN 'Needs review' WHEN processing_status = 'Completed' THEN 'Processed' ELSE 'Processing' END FROM capture_job)
        SELECT status, count(*) AS n, CASE WHEN coalesce(status, '') = '' THEN 'Neutral' WHEN lower(status) LIKE '%qc fail%' OR status = 'Processing failed' THEN 'Fail'
        WHEN status IN ('NOT READY', 'SET PROJECT & BATCH') OR lower(status) LIKE '%ocr failed%' OR lower(status) LIKE '%needs review%' OR lower(status) LIKE '%lower confidence%' OR lower(status) LIKE '%no boundary detected%' THEN 'Warning'
        WHEN status LIKE '✓%' OR status IN ('Processed', 'READY TO CAPTURE', 'AUTO CAPTURE ACTIVE') THEN 'Success' WHEN status = 'Recapturing' OR lower(status) LIKE '%processing%' THEN 'InProgress' ELSE 'Neutral' END AS severity
        FROM u GROUP BY status"""),
    "a26_worker_route": Plan(("capture_job", "batch", "calibration"), "How a job is processed: by fixed frames or normally, whether the resolution is measured (all four sizes of the calibration at the batch's start) or the fallback, and the resulting status; a job with frames keeps its check pending.",
        f"""WITH {_as_of('target_w_in', 'target_h_in', 'pixel_w', 'pixel_h')}
        SELECT j.job_id, CASE WHEN trim(coalesce(b.fixed_frames, '')) <> '' THEN 'frames' ELSE 'normal' END AS route, CASE WHEN k.cal.target_w_in > 0 AND k.cal.target_h_in > 0 AND k.cal.pixel_w IS NOT NULL AND k.cal.pixel_h IS NOT NULL THEN 'calibration' ELSE 'fallback' END AS dpi_source,
        CASE WHEN j.processing_status = 'Completed' AND j.processed_path IS NOT NULL THEN 'Completed' ELSE 'Failed' END AS output_status, CASE WHEN trim(coalesce(b.fixed_frames, '')) <> '' THEN 'Pending' ELSE j.qc_status END AS qc_status
        FROM capture_job j LEFT JOIN batch b ON j.batch_id = b.batch_id LEFT JOIN known k ON k.project_id = b.project_id AND k.start_time = b.start_time""",
        """WITH c AS (SELECT *, lead(calibrated_utc) OVER (PARTITION BY project_id ORDER BY calibrated_utc, calibration_id) AS until FROM calibration)
        SELECT j.job_id, CASE WHEN trim(coalesce(b.fixed_frames, '')) <> '' THEN 'frames' ELSE 'normal' END AS route, CASE WHEN c.target_w_in > 0 AND c.target_h_in > 0 AND c.pixel_w IS NOT NULL AND c.pixel_h IS NOT NULL THEN 'calibration' ELSE 'fallback' END AS dpi_source,
        CASE WHEN j.processing_status = 'Completed' AND j.processed_path IS NOT NULL THEN 'Completed' ELSE 'Failed' END AS output_status, CASE WHEN trim(coalesce(b.fixed_frames, '')) <> '' THEN 'Pending' ELSE j.qc_status END AS qc_status
        FROM capture_job j LEFT JOIN batch b ON j.batch_id = b.batch_id LEFT JOIN c ON b.project_id = c.project_id AND c.calibrated_utc <= b.start_time AND (c.until IS NULL OR b.start_time < c.until)"""),
    "a27_expected_outputs": Plan(("batch",), "Files expected of each page: one for each well-formed frame, else two when pages are split, else one.",
        f"WITH q AS (SELECT batch_id, split_book_pages, size(filter(split(fixed_frames, ';'), t -> t RLIKE '{FRAME}')) AS frames FROM batch) {OUTPUTS}",
        f"WITH q AS (SELECT batch_id, split_book_pages, len(list_filter(string_split(fixed_frames, ';'), lambda t: regexp_matches(t, '{FRAME}'))) AS frames FROM batch) {OUTPUTS}"),
    "a28_qc_rollup": Plan(("capture_job",), "Verdicts of a batch: counts, the worst, and the mean sharpness setting.",
        """SELECT batch_id, sum(CASE WHEN qc_status = 'PASS' THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN qc_status = 'WARNING' THEN 1 ELSE 0 END) AS warned, sum(CASE WHEN qc_status = 'FAIL' THEN 1 ELSE 0 END) AS failed,
        CASE max(CASE qc_status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 WHEN 'PASS' THEN 0 ELSE -1 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' WHEN 0 THEN 'PASS' ELSE 'Pending' END AS worst, round(avg(sharpness), 6) AS mean_sharpness FROM capture_job GROUP BY batch_id"""),
    "a29_validation_report": Plan(("validation",), "Overall verdict of each checked page by run, flagged if any part is, what changed between the runs, and the share of pages that pass in each run.",
        """WITH v AS (SELECT image, page, run, max(CASE WHEN 'FLAG' IN (top_status, bottom_status, left_status, right_status, gutter_status) THEN 1 ELSE 0 END) AS flag FROM validation GROUP BY image, page, run),
        r AS (SELECT round(avg(CASE WHEN run = 'previous' THEN 1e0 - flag END), 9) AS previous_rate, round(avg(CASE WHEN run = 'current' THEN 1e0 - flag END), 9) AS current_rate FROM v),
        p AS (SELECT image, page, flag FROM v WHERE run = 'previous'), c AS (SELECT image, page, flag FROM v WHERE run = 'current')
        SELECT coalesce(p.image, c.image) AS image, coalesce(p.page, c.page) AS page, CASE p.flag WHEN 1 THEN 'FLAG' WHEN 0 THEN 'PASS' END AS previous, r.previous_rate, r.current_rate, CASE c.flag WHEN 1 THEN 'FLAG' WHEN 0 THEN 'PASS' END AS current_run,
        CASE WHEN p.flag IS NULL THEN 'new' WHEN c.flag IS NULL THEN 'gone' WHEN p.flag = c.flag THEN 'same' WHEN c.flag = 1 THEN 'worse' ELSE 'better' END AS change FROM p FULL OUTER JOIN c ON p.image = c.image AND p.page = c.page CROSS JOIN r""",
        """WITH v AS (SELECT image, page, run, max(CASE WHEN 'FLAG' IN (top_status, bottom_status, left_status, right_status, gutter_status) THEN 1 ELSE 0 END) AS flag FROM validation GROUP BY image, page, run),
        p AS (SELECT image, page, flag FROM v WHERE run = 'previous'), c AS (SELECT image, page, flag FROM v WHERE run = 'current')
        SELECT coalesce(p.image, c.image) AS image, coalesce(p.page, c.page) AS page, CASE p.flag WHEN 1 THEN 'FLAG' WHEN 0 THEN 'PASS' END AS previous, round(avg(1e0 - p.flag) OVER (), 9) AS previous_rate, round(avg(1e0 - c.flag) OVER (), 9) AS current_rate, CASE c.flag WHEN 1 THEN 'FLAG' WHEN 0 THEN 'PASS' END AS current_run,
        CASE WHEN p.flag IS NULL THEN 'new' WHEN c.flag IS NULL THEN 'gone' WHEN p.flag = c.flag THEN 'same' WHEN c.flag = 1 THEN 'worse' ELSE 'better' END AS change FROM p FULL OUTER JOIN c ON p.image = c.image AND p.page = c.page"""),
}
