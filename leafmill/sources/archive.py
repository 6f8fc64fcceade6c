"""Reading and writing an archive: ledger tables, text sidecars, listings, images, exports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.plan import Plan

LEDGER = {
    "project": "project_id int, name string, output_directory string",
    "batch": "batch_id long, project_id int, batch_code string, status string, start_time timestamp, split_book_pages boolean, dewarp_enabled boolean, binarize_enabled boolean, fixed_frames string, frame_ref_w int, frame_ref_h int, dpi int",
    "capture_job": "job_id string, batch_id long, page_number int, ts timestamp, processing_status string, qc_status string, ocr_status string, export_status string, original_path string, processed_path string, capture_format string, rotation_degrees int, brightness double, contrast double, saturation double, sharpness double, white_balance double, flip_horizontal boolean, flip_vertical boolean, manual_crop boolean, left_crop_box string",
    "calibration": "calibration_id long, project_id int, calibrated_utc timestamp, target_w_in double, target_h_in double, pixel_w double, pixel_h double, reprojection_error_px double",
}
#: Values of columns that older ledgers lack; others are null.
DEFAULTS = {"batch": {"status": "Active", "split_book_pages": False, "dewarp_enabled": False, "binarize_enabled": False, "frame_ref_w": 0, "frame_ref_h": 0, "dpi": 300}, "capture_job": {"processing_status": "Pending", "qc_status": "Pending", "ocr_status": "Pending", "export_status": "Pending", "capture_format": "TIFF", "rotation_degrees": 0, "brightness": 0.0, "contrast": 0.0, "saturation": 0.0, "sharpness": 0.0, "white_balance": 0.0, "flip_horizontal": False, "flip_vertical": False, "manual_crop": False}}


def read_ledger(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a ledger, with their schema given."""
    return {t: spark.read.schema(s).parquet(f"{path}/{t}") for t, s in LEDGER.items()}


def align_schema(df: DataFrame, table: str) -> DataFrame:
    """`df` with each column of the table that it lacks (names in any case) at its default; columns it has stay as they are."""
    have = {c.lower() for c in df.columns}
    fields = T._parse_datatype_string(LEDGER[table]).fields
    return df.withColumns({f.name: F.lit(DEFAULTS.get(table, {}).get(f.name)).cast(f.dataType) for f in fields if f.name.lower() not in have})


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Word boxes of text-recognition tables: rows of at least 12 fields, level 5, text that is not blank and four whole numbers; others are skipped."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), fields.alias("f")).where((F.size("f") >= 12) & (F.col("f")[0] == "5") & (F.trim(F.col("f")[11]) != ""))
    names = {2: "block_num", 3: "par_num", 4: "line_num", 5: "word_num", 6: "left_px", 7: "top_px", 8: "width", 9: "height"}
    boxes = rows.select("path", *[F.col("f")[i].try_cast("int").alias(n) for i, n in names.items()], F.col("f")[11].alias("text"))
    return boxes.dropna(subset=["left_px", "top_px", "width", "height"])


def read_ocr_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain-text sidecars: path, i (from 0), line."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split(F.replace(F.col("value"), F.lit("\r"), F.lit("")), "\n").alias("lines"))
    return text.select("path", F.posexplode("lines").alias("i", "line"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of files, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def verify_export(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of a manifest whose target is missing or empty."""
    there = listing.where(F.col("length") > 0).select(F.col("path").alias("target"))
    return manifest.join(there, "target", "left_anti")


SCANLINES = "path string, width int, height int, y int, r array<int>, g array<int>, b array<int>, gray array<int>"


def read_scanlines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of image files in colour and grey: path, width, height, y, r, g, b, gray. A file that can't be decoded is one row of width and height 0 without y and samples, so it fails its page, not the run.

    Grey images have three equal planes; an alpha plane is left out. A row of a batch is one scanline, so a page of any height is passed on in pieces of 256 rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SCANLINES.split(", ")]
        kinds = [pa.string(), *[pa.int32()] * 3, *[pa.list_(pa.int32())] * 4]
        table = lambda values: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)
        for batch in batches:
            for i in range(batch.num_rows):
                image = batch.column(0)[i].as_py()
                h, w, c = image["height"], image["width"], image["nChannels"]
                if h <= 0 or w <= 0:
                    yield table([[image["origin"]], [0], [0], *[[None]] * 5])
                    continue
                samples = np.frombuffer(image["data"], np.uint8).reshape(h, w, c)
                for y in range(0, h, 256):
                    v = samples[y : y + 256].astype(np.int32)
                    b, g, r = (v[..., k if c >= 3 else 0] for k in range(3))  # blue comes first
                    grey = np.rint(0.299 * r + 0.587 * g + 0.114 * b).astype(np.int32)
                    n = len(v)
                    yield table([[image["origin"]] * n, [w] * n, [h] * n, list(range(y, y + n)), *[list(p) for p in (r, g, b, grey)]])

    images = spark.read.format("image").option("dropInvalid", "false").load(path).select("image")
    return images.mapInArrow(rows, SCANLINES)


PLANS = {
    "s01_read_ledger": Plan(("batch", "project", "calibration"), "The ledger's tables joined by their keys.",
        """WITH c AS (SELECT project_id, count(calibration_id) AS n FROM calibration GROUP BY project_id), p AS (SELECT project_id, name, count(*) AS n FROM project GROUP BY project_id, name)
        SELECT b.batch_id, b.batch_code, p.name, sum(coalesce(c.n, 0) * coalesce(p.n, 1)) AS calibrations FROM batch b LEFT JOIN p ON b.project_id = p.project_id LEFT JOIN c ON c.project_id = b.project_id GROUP BY b.batch_id, b.batch_code, p.name""",
        "SELECT b.batch_id, b.batch_code, p.name, count(c.calibration_id) AS calibrations FROM batch b LEFT JOIN project p ON b.project_id = p.project_id LEFT JOIN calibration c ON c.project_id = b.project_id GROUP BY b.batch_id, b.batch_code, p.name"),
    "s07_verify_export": Plan(("capture_job", "listing"), "Recorded outputs that are missing or empty.",
        "SELECT DISTINCT p.job_id, p.path FROM (SELECT job_id, explode(split(processed_path, ';')) AS path FROM capture_job) p LEFT JOIN listing l ON l.path = p.path AND l.length > 0 WHERE l.path IS NULL",
        "SELECT DISTINCT p.job_id, p.path FROM (SELECT job_id, unnest(string_split(processed_path, ';')) AS path FROM capture_job) p LEFT JOIN listing l ON l.path = p.path AND l.length > 0 WHERE l.path IS NULL"),
}
