"""Walking along the edges of a page: each step depends on the one before, so an image is one group (a row for each scanline)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Plan
from ..plans.views import SOBEL_PASSES
from .points import fitted_line
from .strips import gradients, matrix

REACH = 6
#: Where a trace starts: between these shares of the width, and so many rows before and behind the place where the page begins.
SEED_FROM, SEED_TO, SEED_BEYOND, SEED_BEFORE = 0.35, 0.95, 150, 100
TRACE = "side string, pos int, row_val int, strength long"
SIDES = "side string, y int, x int, bridged boolean, margin int, jitter double, strength double, gutter_distance double, reliable boolean"


def walk(strength: np.ndarray, seed: int, start: int, guide: tuple[float, float] | None = None, near: float = 15.0, low: int = 0, high: int | None = None) -> np.ndarray:
    """The row of largest strength in each column, within REACH of the row before, out from `start` in column `seed` to both sides; the first on a tie. Rows stay in [low, high).

    With a guide (slope, intercept of the row over the column), a search that has come farther than `near` from it is drawn back to that distance.
    """
    h, w = strength.shape
    high = h if high is None else high
    rows = np.zeros(w, np.int64)
    rows[seed] = start
    for step, stop in ((1, w), (-1, -1)):
        at = start
        for x in range(seed + step, stop, step):
            centre = float(at)
            if guide is not None and abs(off := centre - (guide[0] * x + guide[1])) > near:
                centre += np.clip(off, -near, near) - off
            centre = round(centre)
            first, last = max(low, centre - REACH), min(high, centre + REACH + 1)
            at = first + int(strength[first:last, x].argmax()) if first < last else centre
            rows[x] = at
    return rows


def transition(values: np.ndarray, first: bool, window: int = 80, share: float = 0.6) -> int:
    """Where the page begins in a line of samples (or ends): the first (or last) place whose mean over `window` is above the darker end by `share` of the way to the middle's median; else the line's end."""
    n = len(values)
    middle, tail = values[int(n * 0.2) : int(n * 0.8)], min(20, n)
    page = np.median(middle) if len(middle) else values[0]
    dark = min(values[:tail].min(), values[n - tail :].min())
    sums = np.append(0, np.cumsum(values))
    at = np.arange(n)
    low, high = np.maximum(0, at - window // 2), np.minimum(n, at - window // 2 + window)
    above = np.flatnonzero((sums[high] - sums[low]) / (high - low) > dark + (page - dark) * share)
    return int(above[0] if first else above[-1]) if len(above) else (0 if first else n - 1)


def outline(image: np.ndarray, top: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the page's top (or bottom) edge in each column and their strength: a walk along the largest vertical gradient, from a column right of the middle where the page begins (or ends)."""
    h, w = image.shape
    strength = np.abs(gradients(np.pad(image, 1, "reflect"))[1])
    seed = (int(w * SEED_FROM) + int(w * SEED_TO)) // 2
    begins = transition(image[:, seed].astype(np.float64), top)
    low, high = (begins - SEED_BEFORE, begins + SEED_BEYOND) if top else (begins - SEED_BEYOND, begins + SEED_BEFORE)
    low, high = max(0, low), min(h, high)
    rows = walk(strength, seed, low + int(strength[low:high, seed].argmax()))
    return rows, strength[rows, np.arange(w)]


def bridged(places: np.ndarray, strength: np.ndarray, share: float = 0.4, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places with each run of weak ones (strength at most `share` of the median) put on the line between its neighbours, rounded if `whole`; and which were weak.

    At an end a run copies its one neighbour. If all are weak, the line runs from the last place to the first.
    """
    weak = strength <= share * np.median(strength)
    out = places.copy()
    n = len(places)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], weak, [False]]).astype(int)))
    for a, b in edges.reshape(-1, 2):
        low = places[a - 1] if a else places[min(b, n - 1)]
        high = places[b] if b < n else places[max(a - 1, 0)]
        line = low + (np.arange(b - a) + 1) / (b - a + 1) * (high - low)
        out[a:b] = np.rint(line) if whole else line
    return out, weak


@dataclass
class Side:
    """A traced side: column of each row from `top` on, which were bridged, and how it is judged."""

    top: int
    x: np.ndarray
    weak: np.ndarray
    margin: int
    jitter: float
    strength: float
    distance: float
    whole: bool = False


def side_walk(across: np.ndarray, top: int, bottom: int, book: int, margin: int, gutter: float, whole: bool = False) -> Side:
    """One side between rows `top` and `bottom`, sought within `margin` of column `book`: a robust line through the strongest columns of every third row (without the outer 15 %) guides the walk from the middle row."""
    w = across.shape[1]
    low, high = max(0, book - margin), min(w, book + margin)
    first, last = top + int((bottom - top) * 0.15), top + int((bottom - top) * 0.85)
    y = np.arange(first, last, 3)
    found = fitted_line(y.astype(float), (low + across[first:last:3, low:high].argmax(1)).astype(float), 1000, 2.0) if high > low and len(y) > 1 else None
    seed = min(max(round(found[1] * ((top + bottom) // 2) + found[2]), book - margin), book + margin - 1) if found else book
    seed = min(max(seed, low), high - 1)
    part = across[top:bottom].T  # a walk down the rows
    guide = (found[1], found[1] * top + found[2]) if found else None
    raw = walk(part, (bottom - top) // 2, seed, guide, low=low, high=high)
    x, weak = bridged(raw, part[raw, np.arange(len(raw))])
    rows = np.arange(top, bottom, dtype=np.float64)
    spread = ((rows - rows.mean()) ** 2).sum()
    slope = ((rows - rows.mean()) * (x - x.mean())).sum() / spread if spread > 1e-12 else 0.0
    jitter = float(np.sqrt(np.mean((x - x.mean() - slope * (rows - rows.mean())) ** 2))) if spread > 1e-12 else float(np.sqrt(np.mean((x - x[0]) ** 2)))
    return Side(top, x, weak, margin, jitter, float(np.median(part[np.clip(x, 0, w - 1), np.arange(len(x))])), float(np.median(np.abs(x - gutter))), whole)


def judged_sides(image: np.ndarray, rows: tuple[int, int, int, int], book: tuple[int, int], gutter: float, jitter: float = 3.0, share: float = 0.5, symmetry: float = 1.3, growth: float = 2.0, margin: int | None = None) -> tuple[Side, Side, bool, bool]:
    """Left and right side of a page and whether each can be relied on.

    `rows`: top and bottom of the left side, then of the right; `book`: first and last column of the page; `gutter`: the column that sides should be equally far from. A side is good if it strays at most `jitter` from its own line
    and is at least `share` as strong as the stronger. Sides whose distances differ by more than `symmetry` are suspect: the nearer one is tried again. A side to be tried again is walked anew within a margin `growth` times as
    wide, until both are good and symmetric, or the margins reach the image's border.
    """
    across, w = np.abs(gradients(np.pad(image, 1, "reflect"))[0]), image.shape[1]
    start = max(20, int(w * 0.04)) if margin is None else margin
    sides = [side_walk(across, rows[2 * k], rows[2 * k + 1], book[k], start, gutter) for k in (0, 1)]
    good = lambda s: s.jitter <= jitter and s.strength >= share * max(x.strength for x in sides)
    while True:
        near, far = sorted(s.distance for s in sides)
        lopsided = far / max(near, 1e-6) > symmetry
        nearer = 0 if sides[0].distance <= sides[1].distance else 1
        again = [k for k in (0, 1) if (not good(sides[k]) or lopsided and k == nearer) and not sides[k].whole]
        if not again:
            return sides[0], sides[1], good(sides[0]), good(sides[1])
        for k in again:
            limit = book[0] if k == 0 else w - book[1]
            wider = min(limit, sides[k].margin * growth)
            sides[k] = side_walk(across, rows[2 * k], rows[2 * k + 1], book[k], max(1, int(wider)), gutter, wider >= limit)


def bridge_edges(edge: DataFrame, share: float = 0.4) -> DataFrame:
    """image_id, pos, row_val and val: rows of each edge (image_id, pos, row_val, strength) with weak samples bridged. See bridged()."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        rows = t.column("row_val").to_numpy().astype(np.float64)
        return t.drop(["strength"]).append_column("val", pa.array(bridged(rows, t.column("strength").to_numpy().astype(np.float64), share, False)[0]))

    kinds = ", ".join(f"{c} {edge.schema[c].dataType.simpleString()}" for c in ("image_id", "pos", "row_val"))
    return edge.select("image_id", "pos", "row_val", "strength").groupBy("image_id").applyInArrow(run, f"{kinds}, val double")


def trace_edge(scanlines: DataFrame) -> DataFrame:
    """Top and bottom edge of each image (image_id, y, gray): image_id, side, pos, row_val, strength. Images of under 3 rows or columns give no rows. See outline()."""

    def run(t: pa.Table) -> pa.Table:
        image = matrix(t.sort_by("y").column("gray")).astype(np.int64)
        found = [(side, *outline(image, side == "top")) for side in ("top", "bottom")] if min(image.shape) >= 3 else []
        n = image.shape[1] if found else 0
        column = lambda k, kind: pa.array(np.concatenate([f[k] for f in found]) if found else [], kind)
        return pa.table({"image_id": pa.array([t.column("image_id")[0].as_py()] * (n * len(found)), t.column("image_id").type), "side": pa.array([f[0] for f in found for _ in range(n)], pa.string()), "pos": pa.array(list(range(n)) * len(found), pa.int32()), "row_val": column(1, pa.int32()), "strength": column(2, pa.int64())})

    return scanlines.select("image_id", "y", "gray").groupBy("image_id").applyInArrow(run, f"image_id {scanlines.schema['image_id'].dataType.simpleString()}, {TRACE}")


def side_edges(scanlines: DataFrame, spans: DataFrame) -> DataFrame:
    """Left and right edge of each image by judged, guided walks: image_id and SIDES, a row for each row of a side.

    `spans`: image_id, top_left, bottom_left, top_right, bottom_right, book_low, book_high, gutter (see judged_sides()). Images without a span, and spans without rows or columns, give no rows.
    """
    names = ["top_left", "bottom_left", "top_right", "bottom_right", "book_low", "book_high", "gutter"]

    def run(held: pa.Table, span: pa.Table) -> pa.Table:
        kinds = {"image_id": held.schema.field("image_id").type, "side": pa.string(), "y": pa.int32(), "x": pa.int32(), "bridged": pa.bool_(), "margin": pa.int32(), "jitter": pa.float64(), "strength": pa.float64(), "gutter_distance": pa.float64(), "reliable": pa.bool_()}
        parts = []
        if held.num_rows and span.num_rows:
            image = matrix(held.sort_by("y").column("gray")).astype(np.int64)
            h, w = image.shape
            tl, bl, tr, br, low, high, gutter = (span.column(c)[0].as_py() for c in names)
            rows = tuple(min(max(v, 0), h) for v in (tl, bl, tr, br))
            if min(image.shape) >= 3 and rows[0] < rows[1] and rows[2] < rows[3] and 0 <= low < high <= w:
                left, right, *reliable = judged_sides(image, rows, (low, high), gutter)
                for name, s, fine in (("left", left, reliable[0]), ("right", right, reliable[1])):
                    n = len(s.x)
                    values = [[held.column("image_id")[0].as_py()] * n, [name] * n, np.arange(s.top, s.top + n), s.x, s.weak, [s.margin] * n, [s.jitter] * n, [s.strength] * n, [s.distance] * n, [fine] * n]
                    parts.append(pa.table({c: pa.array(v, k) for (c, k), v in zip(kinds.items(), values, strict=True)}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], k) for c, k in kinds.items()})

    own = spans.select("image_id", *names)
    return scanlines.select("image_id", "y", "gray").groupBy("image_id").cogroup(own.groupBy("image_id")).applyInArrow(run, f"image_id {scanlines.schema['image_id'].dataType.simpleString()}, {SIDES}")


def edge_quality(scanlines: DataFrame, spans: DataFrame) -> DataFrame:
    """How each side was judged: image_id, side, jitter, strength, gutter_distance, margin, bridged (rows), reliable."""
    firsts = [F.first(c).alias(c) for c in ("jitter", "strength", "gutter_distance", "margin", "reliable")]
    return side_edges(scanlines, spans).groupBy("image_id", "side").agg(*firsts, F.count_if("bridged").alias("bridged"))


#: The walk in SQL: seeds by the brightness of one column, then column by column to both sides.
_WALK = f"""WITH RECURSIVE {SOBEL_PASSES}, size AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixel GROUP BY image_id), sd AS (SELECT *, CAST((floor(w * {SEED_FROM}) + floor(w * {SEED_TO})) // 2 AS INT) AS seed FROM size WHERE w >= 3 AND h >= 3),
    c AS (SELECT p.image_id, p.y, p.v, sd.h, sd.seed, avg(p.v) OVER (PARTITION BY p.image_id ORDER BY p.y ROWS BETWEEN 40 PRECEDING AND 39 FOLLOWING) AS mean FROM pixel p JOIN sd ON sd.image_id = p.image_id AND p.x = sd.seed),
    lv AS (SELECT image_id, quantile_cont(CASE WHEN y >= floor(0.2 * h) AND y < floor(0.8 * h) THEN v END, 0.5) AS page, least(min(CASE WHEN y < 20 THEN v END), min(CASE WHEN y >= h - 20 THEN v END)) AS dark FROM c GROUP BY image_id),
    tr AS (SELECT c.image_id, max(c.h) AS h, max(c.seed) AS seed, coalesce(min(CASE WHEN mean > dark + (page - dark) * 0.6 THEN y END), 0) AS first, coalesce(max(CASE WHEN mean > dark + (page - dark) * 0.6 THEN y END), max(c.h) - 1) AS last FROM c JOIN lv ON lv.image_id = c.image_id GROUP BY c.image_id),
    zone AS (SELECT image_id, seed, 'top' AS side, first - {SEED_BEFORE} AS low, first + {SEED_BEYOND} AS high FROM tr UNION ALL SELECT image_id, seed, 'bottom', last - {SEED_BEYOND}, last + {SEED_BEFORE} FROM tr),
    m AS MATERIALIZED (SELECT image_id, x, y, abs(gy) AS s FROM g),
    start AS (SELECT z.image_id, z.side, z.seed, arg_min(m.y, (-m.s, m.y)) AS y FROM zone z JOIN m ON m.image_id = z.image_id AND m.x = z.seed AND m.y >= z.low AND m.y < z.high GROUP BY z.image_id, z.side, z.seed),
    steps AS (SELECT image_id, side, d, seed AS x, y FROM start, (VALUES (1), (-1)) AS v(d)
        UNION ALL SELECT * FROM (SELECT t.image_id, t.side, t.d, t.x + t.d AS x, arg_min(m.y, (-m.s, m.y)) AS y FROM steps t JOIN m ON m.image_id = t.image_id AND m.x = t.x + t.d AND m.y BETWEEN t.y - {REACH} AND t.y + {REACH} GROUP BY t.image_id, t.side, t.d, t.x) r)
    SELECT DISTINCT t.image_id, t.side, CAST(t.x AS INT) AS pos, CAST(t.y AS INT) AS row_val, CAST(m.s AS BIGINT) AS strength FROM steps t JOIN m ON m.image_id = t.image_id AND m.x = t.x AND m.y = t.y"""

PLANS = {"e12_trace_edge": Plan(("scanline",), "Top and bottom edge of each image: a walk along the largest vertical gradient from where the page begins.", run=lambda scanline: trace_edge(scanline), duckdb=_WALK, oracle_inputs=("pixel",))}
