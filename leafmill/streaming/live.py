"""Watching live frames: when is a new page steady and worth capturing. The same fold serves batches and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from ..operators import strips
from ..plans.plan import Plan, view

INTERVAL_MS, SHARP, NEEDED, DIFFERS, WEIGHT, NEAR, COVERED = 500, 40.0, 3, 18.0, 0.35, 0.03, 0.2
#: Size of the live picture.
IMAGE_W, IMAGE_H = 640, 480
FRAMES = "frame_id long, stream_id long, ts timestamp, detected boolean, x double, y double, w double, h double, sharpness double, signature array<int>"
CHECKS = "frame_id long, stream_id long, ts timestamp, stable boolean, smooth_x double, smooth_y double, smooth_w double, smooth_h double, stable_count int, settled boolean, triggered boolean"
STATE = "last_ms long, x double, y double, w double, h double, count int, captured array<int>, previous array<int>"


@dataclass
class Watch:
    """What is remembered of a stream: the last accepted time, the smoothed box, the count of steady checks, and two signatures."""

    last_ms: int | None = None
    box: tuple[float, float, float, float] | None = None
    count: int = 0
    captured: list[int] | None = None
    previous: list[int] | None = field(default=None)

    def check(self, ms: int, f: dict) -> dict | None:
        """One frame, at `ms`; None if it comes too soon after the last accepted one."""
        if self.last_ms is not None and ms - self.last_ms < INTERVAL_MS:
            return None
        self.last_ms = ms
        signature = [int(v) for v in f["signature"]] if f["signature"] is not None else None
        settled = difference(signature, self.previous) < DIFFERS
        self.previous = signature
        stable = triggered = False
        new = (f["x"], f["y"], f["w"], f["h"])
        if not f["detected"] or f["w"] * f["h"] < COVERED * IMAGE_W * IMAGE_H:
            self.box, self.count = None, 0
        elif f["sharpness"] < SHARP:
            self.box, self.count = new, 0
        else:
            if self.box is not None:
                stable = all(abs(a - b) <= NEAR * size for a, b, size in zip(new, self.box, (IMAGE_W, IMAGE_H) * 2, strict=True))
            self.count = min(self.count + 1, NEEDED) if stable else 1
            self.box = tuple(WEIGHT * a + (1 - WEIGHT) * b for a, b in zip(new, self.box, strict=True)) if self.box is not None else new
            if self.count == NEEDED and difference(signature, self.captured) >= DIFFERS:
                triggered, self.captured, self.count = True, signature, 0
        x, y, w, h = self.box or (None,) * 4
        return {"frame_id": f["frame_id"], "stream_id": f["stream_id"], "ts": f["ts"], "stable": stable, "smooth_x": x, "smooth_y": y, "smooth_w": w, "smooth_h": h, "stable_count": self.count, "settled": settled, "triggered": triggered}

    @classmethod
    def of(cls, state: tuple) -> Watch:
        last, x, y, w, h, count, captured, previous = state
        return cls(last, (x, y, w, h) if x is not None else None, count, captured, previous)

    def state(self) -> tuple:
        return (self.last_ms, *(self.box or (None,) * 4), self.count, self.captured, self.previous)


#: A region's measures, and what frame mode needs to know of a frame's stream.
REGIONS = "array<struct<sharpness: double, signature: array<int>>>"
MODE_FRAMES = f"frame_id long, stream_id long, ts timestamp, editing boolean, automatic boolean, regions {REGIONS}"
MODE_CHECKS = "frame_id long, stream_id long, ts timestamp, lowest_sharpness double, settled boolean, stable_count int, status string, triggered boolean"
MODE_STATE = "last_ms long, count int, captured array<int>, previous array<int>"


@dataclass
class FrameWatch:
    """Frame mode: regions are pinned by the operator, so a page is steady when their contents rest, and the least sharp region decides. Remembers the signatures of all regions, one after the other."""

    cells: int = 24
    last_ms: int | None = None
    count: int = 0
    captured: list[int] | None = None
    previous: list[int] | None = None

    def check(self, ms: int, f: dict) -> dict | None:
        if self.last_ms is not None and ms - self.last_ms < INTERVAL_MS:
            return None
        self.last_ms = ms
        status, settled, triggered = self._status(f)
        lowest = min((r["sharpness"] for r in f["regions"]), default=None) if f["regions"] is not None else None
        return {"frame_id": f["frame_id"], "stream_id": f["stream_id"], "ts": f["ts"], "lowest_sharpness": lowest, "settled": settled, "stable_count": self.count, "status": status, "triggered": triggered}

    def _status(self, f: dict) -> tuple[str, bool, bool]:
        if f["regions"] is None or not len(f["regions"]):
            self.count = 0
            return "WAITING FOR LIVE VIEW", False, False
        signature, size = [], self.cells * self.cells
        for r in f["regions"]:  # a region without a signature is a block of zeros, so the others keep their places
            own = [int(v) for v in r["signature"][:size]] if r["signature"] is not None else []
            signature += own + [0] * (size - len(own))
        before, self.previous = self.previous, signature
        settled = difference(signature, before) < DIFFERS
        if f["editing"] or not f["automatic"] or min(r["sharpness"] for r in f["regions"]) < SHARP:
            self.count = 0
            return "EDITING FRAMES" if f["editing"] else "FOCUSING" if f["automatic"] else "PRESS CAPTURE", settled, False
        self.count = min(self.count + 1, NEEDED) if settled else 1
        if self.count < NEEDED:
            return "HOLD STILL", settled, False
        if difference(signature, self.captured) < DIFFERS:
            return "SWAP PAGE", settled, False
        self.captured, self.count = signature, 0
        return "CAPTURING", settled, True

    @classmethod
    def of(cls, state: tuple, cells: int) -> FrameWatch:
        return cls(cells, *state)

    def state(self) -> tuple:
        return (self.last_ms, self.count, self.captured, self.previous)


def difference(a: list[int] | None, b: list[int] | None) -> float:
    """Mean absolute difference of two signatures; infinite if one is missing, empty or of another length."""
    if not a or not b or len(a) != len(b):
        return float("inf")
    return sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a)


def fold_batch(frames: DataFrame, start: Callable[[], Watch | FrameWatch], out: str) -> DataFrame:
    """Folds each stream's frames in the order of time. They come sorted, and a task holds what is remembered of one stream, not its frames."""
    schema = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = watch = None
        for batch in batches:
            found = []
            for us, f in zip(batch.column("ts").cast(pa.int64()).to_pylist(), batch.to_pylist(), strict=True):
                if watch is None or f["stream_id"] != stream:
                    stream, watch = f["stream_id"], start()
                if (r := watch.check(us // 1000, f)) is not None:
                    found.append(r)
            yield from pa.Table.from_pylist(found, schema).to_batches()

    return frames.repartition("stream_id").sortWithinPartitions("stream_id", "ts", "frame_id").mapInArrow(run, out)


def fold_stream(frames: DataFrame, start: Callable[[], Watch | FrameWatch], again: Callable[[tuple], Watch | FrameWatch], out: str, kept: str) -> DataFrame:
    """The same over a stream. Frames of one micro-batch are put in the order of time; a frame that comes in a later one is checked then."""
    names = [c.split()[0] for c in out.split(", ")]

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watch = again(tuple(state.get)) if state.exists else start()
        rows = pd.concat(list(chunks)).sort_values(["ts", "frame_id"]).to_dict("records")
        found = [r for f in rows if (r := watch.check(int(f["ts"].value // 1_000_000), f)) is not None]
        state.update(watch.state())
        yield pd.DataFrame(found, columns=names)

    return frames.groupBy("stream_id").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def watch_batch(frames: DataFrame) -> DataFrame:
    """Checks of all accepted frames of each stream, in the order of time."""
    return fold_batch(frames, Watch, CHECKS)


def watch_stream(frames: DataFrame) -> DataFrame:
    """The same over a stream."""
    return fold_stream(frames, Watch, Watch.of, CHECKS, STATE)


def frame_mode_batch(frames: DataFrame, cells: int = 24) -> DataFrame:
    """Frame mode over MODE_FRAMES: lowest sharpness, whether all regions rest, steady checks so far, what the operator is told, and whether a capture starts. Signatures have `cells` * `cells` values."""
    return fold_batch(frames, lambda: FrameWatch(cells), MODE_CHECKS)


def frame_mode_stream(frames: DataFrame, cells: int = 24) -> DataFrame:
    """The same over a stream."""
    return fold_stream(frames, lambda: FrameWatch(cells), lambda state: FrameWatch.of(state, cells), MODE_CHECKS, MODE_STATE)


@lru_cache(maxsize=4096)
def _overlaps(size: int, cells: int) -> np.ndarray:
    """Part of each sample of a side that lies in each cell, (cells, samples), over the samples of a cell."""
    edges, at = np.arange(cells + 1)[:, None] * size / cells, np.arange(size)
    return np.clip(np.minimum(edges[1:], at + 1) - np.maximum(edges[:-1], at), 0, None) * cells / size


@lru_cache(maxsize=4096)
def _mirrored(size: int) -> np.ndarray:
    """Places of a side with one more at each end, mirrored without the border sample."""
    return np.concatenate([[1], np.arange(size), [size - 2]])


def measured_regions(picture: np.ndarray, frames: list[dict], cells: int) -> list[dict]:
    """Sharpness and signature of each fractional frame of a picture: as strips.region_measure() gives them for stored images."""
    height, width = picture.shape
    out = []
    for f in frames:
        x, y = max(0, min(round(f["x"] * width), width - 1)), max(0, min(round(f["y"] * height), height - 1))
        w, h = max(1, min(round(f["w"] * width), width - x)), max(1, min(round(f["h"] * height), height - y))
        if w < 2 or h < 2:
            out.append({"sharpness": 0.0, "signature": None})
            continue
        part = picture[y : y + h, x : x + w]
        signature = None
        if w >= cells and h >= cells:
            signature = np.rint(np.round(_overlaps(h, cells) @ part @ _overlaps(w, cells).T, 6)).astype(int).ravel().tolist()
        out.append({"sharpness": float(strips.laplacian(part[_mirrored(h)[:, None], _mirrored(w)]).var()), "signature": signature})
    return out


def _pictures(column: pa.Array) -> Iterator[np.ndarray | None]:
    for rows in column:
        samples = np.asarray(rows.values.flatten()) if rows.is_valid else ()
        yield samples.reshape(len(rows.values), -1) if len(samples) else None


def check_regions(pictures: DataFrame, batches: DataFrame, cells: int = 24) -> DataFrame:
    """MODE_FRAMES of live pictures (frame_id, stream_id, ts, picture: array of grey rows, may be a stream) by the frames that their batch holds (stream_id, frames: array of x, y, w, h as fractions, editing, automatic).

    Pictures of streams whose batch has no frames are left out: they are not in frame mode. A picture that is null or empty has no regions.
    """
    joined = pictures.join(batches.where("size(frames) > 0"), "stream_id")
    names = [c.split(" ")[0] for c in MODE_FRAMES.split(", ")[:5]] + ["regions"]
    schema = to_arrow_schema(_parse_datatype_string(MODE_FRAMES))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            regions = [measured_regions(p, f, cells) if p is not None else None for p, f in zip(_pictures(batch.column("picture")), batch.column("frames").to_pylist(), strict=True)]
            yield from pa.table([*[batch.column(c) for c in names[:-1]], pa.array(regions, schema.field("regions").type)], names=names).cast(schema).to_batches()

    return joined.select(*names[:-1], "picture", "frames").mapInArrow(run, MODE_FRAMES)


def frame_mode_batches(batch: DataFrame) -> DataFrame:
    """Frames of each batch as fractions of the picture that they were drawn on, for check_regions(); a stream is at the batch of its number. Malformed frames are left out, and without a reference size there are none."""
    numbers = F.transform(F.split("fixed_frames", ";"), lambda t: F.transform(F.split(t, ","), lambda v: v.try_cast("double")))
    fine = F.filter(numbers, lambda a: (F.size(a) == 4) & F.forall(a, lambda v: v.isNotNull()))
    part = lambda a, i, side: F.get(a, i) / F.col(side)
    frames = F.transform(fine, lambda a: F.struct(part(a, 0, "frame_ref_w").alias("x"), part(a, 1, "frame_ref_h").alias("y"), part(a, 2, "frame_ref_w").alias("w"), part(a, 3, "frame_ref_h").alias("h")))
    drawn = F.when((F.col("frame_ref_w") > 0) & (F.col("frame_ref_h") > 0), frames)
    return batch.select(F.col("batch_id").alias("stream_id"), drawn.alias("frames"), (F.col("status") == "Completed").alias("editing"), (F.col("status") == "Active").alias("automatic"))


def signed_frames(live_frame: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Frames with the grey signature of their picture."""
    cells = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.5) * 255))).cast("int"))
    return live_frame.join(embeddings.select("vec_id", cells.alias("signature")), "vec_id", "left").drop("vec_id")


def live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed_frames(view(spark, sf_dir, "live_frame"), view(spark, sf_dir, "embeddings"))


def live_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small pictures (12 rows of 32) of the frames, from the cells of their signature."""
    cell = lambda y: lambda x: F.get("signature", ((x * 2 + y * 7) % 64).cast("int"))
    picture = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(31)), cell(y)))
    return live_frames(spark, sf_dir).select("frame_id", "stream_id", "ts", F.when(F.col("signature").isNotNull(), picture).alias("picture"))


def f07_frame_mode_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = check_regions(live_pictures(spark, sf_dir), frame_mode_batches(view(spark, sf_dir, "batch")), cells=4)
    return frame_mode_batch(frames, cells=4).select("frame_id", "stream_id", F.round("lowest_sharpness", 6).alias("lowest_sharpness"), "settled", "stable_count", "status", "triggered")


QUERIES = {"f07_frame_mode_trigger": f07_frame_mode_trigger}

#: The fold in SQL: every stream's frames one after the other.
_FOLD = f"""WITH RECURSIVE fr AS (SELECT l.frame_id, l.stream_id, l.ts, epoch_ms(l.ts) AS ms, l.detected AND l.w * l.h >= {COVERED} * {IMAGE_W} * {IMAGE_H} AS found, l.x, l.y, l.w, l.h, l.sharpness, list_transform(e.embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT)) AS sig,
        row_number() OVER (PARTITION BY l.stream_id ORDER BY l.ts, l.frame_id) AS n FROM live_frame l LEFT JOIN embeddings e ON e.vec_id = l.vec_id),
    st AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last_ms, CAST(NULL AS DOUBLE) AS bx, CAST(NULL AS DOUBLE) AS bx_y, CAST(NULL AS DOUBLE) AS bw, CAST(NULL AS DOUBLE) AS bh, 0 AS count, CAST(NULL AS INT[]) AS captured, false AS seen, false AS stable, false AS triggered, CAST(NULL AS BIGINT) AS frame_id, CAST(NULL AS TIMESTAMP) AS ts FROM fr
        UNION ALL SELECT stream_id, n, last_ms, CASE WHEN seen THEN CASE WHEN NOT found THEN NULL WHEN NOT sharp OR bx IS NULL THEN x ELSE {WEIGHT} * x + (1 - {WEIGHT}) * bx END ELSE bx END, CASE WHEN seen THEN CASE WHEN NOT found THEN NULL WHEN NOT sharp OR bx IS NULL THEN y ELSE {WEIGHT} * y + (1 - {WEIGHT}) * bx_y END ELSE bx_y END,
            CASE WHEN seen THEN CASE WHEN NOT found THEN NULL WHEN NOT sharp OR bx IS NULL THEN w ELSE {WEIGHT} * w + (1 - {WEIGHT}) * bw END ELSE bw END, CASE WHEN seen THEN CASE WHEN NOT found THEN NULL WHEN NOT sharp OR bx IS NULL THEN h ELSE {WEIGHT} * h + (1 - {WEIGHT}) * bh END ELSE bh END,
            CASE WHEN fires THEN 0 ELSE now END, CASE WHEN fires THEN sig ELSE captured END, seen, steady, fires, frame_id, ts
        FROM (SELECT *, seen AND found AND sharp AND now = {NEEDED} AND (captured IS NULL OR sig IS NULL OR list_sum(list_transform(list_zip(sig, captured), lambda p: abs(p[1] - p[2]))) / CAST(len(sig) AS DOUBLE) >= {DIFFERS}) AS fires
            FROM (SELECT *, CASE WHEN NOT seen THEN count WHEN NOT found OR NOT sharp THEN 0 WHEN steady THEN least(count + 1, {NEEDED}) ELSE 1 END AS now
                FROM (SELECT *, seen AND found AND sharp AND bx IS NOT NULL AND abs(x - bx) <= {NEAR} * {IMAGE_W} AND abs(y - bx_y) <= {NEAR} * {IMAGE_H} AND abs(w - bw) <= {NEAR} * {IMAGE_W} AND abs(h - bh) <= {NEAR} * {IMAGE_H} AS steady
                    FROM (SELECT t.stream_id, f.n, CASE WHEN t.last_ms IS NULL OR f.ms - t.last_ms >= {INTERVAL_MS} THEN f.ms ELSE t.last_ms END AS last_ms, t.last_ms IS NULL OR f.ms - t.last_ms >= {INTERVAL_MS} AS seen, t.bx, t.bx_y, t.bw, t.bh, t.count, t.captured, f.frame_id, f.ts, f.found, f.sharpness >= {SHARP} AS sharp, f.x, f.y, f.w, f.h, f.sig
                        FROM st t JOIN fr f ON f.stream_id = t.stream_id AND f.n = t.n + 1) a) b) c) d)
    SELECT frame_id, stream_id, {{columns}} FROM st WHERE seen AND {{where}}"""


def _checked(doc: str, columns: str, where: str = "true") -> Plan:
    """A query over the checks of all accepted frames; `columns` in SQL that both dialects take."""
    sql = _FOLD.format(columns=columns, where=where)
    for name, own in (("smooth_x", "bx"), ("smooth_y", "bx_y"), ("smooth_w", "bw"), ("smooth_h", "bh"), ("stable_count", "count")):
        sql = sql.replace(f"round({name}, 9)", f"round({own}, 9)").replace(f"{name} AS {name}", f"{own} AS {name}")
    return Plan(("live_frame", "embeddings"), doc, run=lambda live_frame, embeddings: watch_batch(signed_frames(live_frame, embeddings)).where(where).selectExpr("frame_id", "stream_id", *columns.split(" ; ")), duckdb=sql.replace(" ; ", ", "))


PLANS = {
    "f01_throttle": _checked("Frames that are checked: each at least half a second after the last one.", "ts AS ts"),
    "f03_box_stable": _checked("Whether a frame's box is where the smoothed one was, within 3 % of the picture.", "stable AS stable"),
    "f04_smooth_box": _checked("The smoothed box after each check.", "round(smooth_x, 9) AS smooth_x ; round(smooth_y, 9) AS smooth_y ; round(smooth_w, 9) AS smooth_w ; round(smooth_h, 9) AS smooth_h"),
    "f05_stable_count": _checked("Steady checks so far.", "stable_count AS stable_count"),
    "f06_capture_trigger": _checked("Checks that start a capture.", "ts AS ts", "triggered"),
    "f02_detected_gate": Plan(("live_frame",), "Frames whose outline covers a fifth of the picture.", "SELECT frame_id, stream_id, detected AND w * h / (640 * 480) >= 0.2 AS passes FROM live_frame"),
    # A frame without a measurement means no camera, a stream is at the batch of its number, an active batch captures by itself, and frames of a batch that was not exported are being edited.
    "f08_readiness": Plan(("live_frame", "batch"), "What the operator is told; the first that fits.",
        """WITH s AS (SELECT l.frame_id, l.sharpness IS NOT NULL AS connected, b.project_id, b.batch_code, b.fixed_frames IS NOT NULL AND b.status = 'Completed' AS editing, b.status = 'Active' AS automatic, l.detected AND l.w * l.h / (640 * 480) >= 0.2 AS found FROM live_frame l LEFT JOIN batch b ON l.stream_id = b.batch_id)
        SELECT frame_id, CASE WHEN NOT connected THEN 'NOT READY' WHEN project_id IS NULL OR trim(coalesce(batch_code, '')) = '' THEN 'SET PROJECT & BATCH' WHEN editing THEN 'EDITING FRAMES' WHEN NOT found THEN 'WAITING FOR DOCUMENT' WHEN automatic THEN 'AUTO CAPTURE ACTIVE' ELSE 'READY TO CAPTURE' END AS readiness FROM s"""),
}
