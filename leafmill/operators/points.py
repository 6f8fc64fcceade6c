"""Points of an image as arrays: robust lines, nearest neighbours, and the mesh that text lines allow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.plan import Plan, run_together


def trial_pairs(n: int, trials: int) -> np.ndarray:
    """Two different places of `n` for each trial, (trials, 2), by a fixed sequence of whole numbers."""
    k = np.arange(trials, dtype=np.int64)
    a = (k * 1103515245 + 12345) % 2**31
    b = (a * 1103515245 + 12345) % 2**31
    i, j = (a >> 8) % n, (b >> 8) % n
    return np.stack([i, np.where(i == j, (j + 1) % n, j)], axis=1)


def fitted_line(x: np.ndarray, y: np.ndarray, trials: int = 300, tolerance: float = 4.0) -> tuple[int, float, float] | None:
    """(points within `tolerance`, slope, intercept) of y over x: the trial line that most points lie within `tolerance` of (the first on a tie), fitted again to these; None if fewer than two, or if they stand at one x."""
    if len(x) < 2:
        return None
    pairs = trial_pairs(len(x), trials)
    pairs = pairs[x[pairs[:, 0]] != x[pairs[:, 1]]]
    best, inside = -1, None
    step = max(1, 4_000_000 // len(x))  # trials whose distances are held at once
    for at in range(0, len(pairs), step):
        i, j = pairs[at : at + step].T
        s = (y[j] - y[i]) / (x[j] - x[i])
        near = np.abs(y - s[:, None] * x - (y[i] - s * x[i])[:, None]) < tolerance
        counts = near.sum(1)
        if len(counts) and counts.max() > best:
            best, inside = int(counts.max()), near[int(np.argmax(counts))]
    if inside is None or best < 2:
        return None
    u, v = x[inside], y[inside]
    spread = best * (u * u).sum() - u.sum() ** 2
    if abs(spread) < 1e-12:
        return None
    slope = (best * (u * v).sum() - u.sum() * v.sum()) / spread
    return best, float(slope), float((v.sum() - slope * u.sum()) / best)


def robust_lines(points: DataFrame, trials: int = 300, tolerance: float = 4.0) -> DataFrame:
    """image_id, inliers, slope and intercept of y over x of each image's `points` (image_id, x, y), of any number; null without a line. See fitted_line(). Points are one group an image, trials are counted in blocks."""

    def run(t: pa.Table) -> pa.Table:
        x, y = (np.asarray(t.column(c), np.float64) for c in ("x", "y"))
        order = np.lexsort((y, x))
        found = fitted_line(x[order], y[order], trials, tolerance) or (None, None, None)
        return pa.table({"image_id": t.column("image_id")[:1], "inliers": pa.array([found[0]], pa.int64()), "slope": pa.array([found[1]], pa.float64()), "intercept": pa.array([found[2]], pa.float64())})

    return points.select("image_id", "x", "y").groupBy("image_id").applyInArrow(run, f"image_id {points.schema['image_id'].dataType.simpleString()}, inliers long, slope double, intercept double")


def nearest_distances(x: np.ndarray, y: np.ndarray, image: np.ndarray | None = None) -> np.ndarray:
    """Distance of each point to the nearest of its image (one image, if none are given) that stands elsewhere; infinite if all stand at one place.

    Points lie in the cells of their image's grid, about one in each. A point looks at the cells around it, ring by ring (the reach doubles), until its nearest is no farther than the rings it has seen. All images are
    searched at once.
    """
    image = np.zeros(len(x)) if image is None else image
    order = np.lexsort((y, x, image))
    rows = np.stack([image[order].astype(np.float64), x[order], y[order]], axis=1)
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    place = np.cumsum(new) - 1
    rows = rows[new]
    n, out = len(rows), np.full(int(new.sum()), np.inf)
    if n > 1:
        first = np.append(True, rows[1:, 0] != rows[:-1, 0])
        start, group = np.flatnonzero(first), np.cumsum(first) - 1
        many = np.diff(np.append(start, n))
        low = np.minimum.reduceat(rows[:, 1:], start)
        size = np.maximum.reduceat(rows[:, 1:], start) - low
        cell = np.maximum(np.sqrt(size[:, 0] * size[:, 1] / many), size.max(1) / many)
        cell = np.where(cell > 0, cell, 1.0)[group]
        at = np.floor((rows[:, 1:] - low[group]) / cell[:, None]).astype(np.int64)
        side = int(at.max()) + 2
        by_key = np.argsort((group * side + at[:, 0]) * side + at[:, 1], kind="stable")
        key = ((group * side + at[:, 0]) * side + at[:, 1])[by_key]
        left, reach = np.flatnonzero(many[group] > 1), 1
        while len(left):
            for off in range(-reach, reach + 1):
                column = at[left, 0] + off
                inside = (column >= 0) & (column < side)
                base = (group[left] * side + column) * side
                begin = np.searchsorted(key, base + np.maximum(at[left, 1] - reach, 0), side="left")
                end = np.searchsorted(key, base + np.minimum(at[left, 1] + reach, side - 1), side="right")
                held = np.where(inside, np.maximum(end - begin, 0), 0)
                row = np.repeat(np.arange(len(left)), held)
                other = by_key[np.repeat(begin, held) + np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)]
                d = np.hypot(rows[left[row], 1] - rows[other, 1], rows[left[row], 2] - rows[other, 2])
                d[left[row] == other] = np.inf
                np.minimum.at(out, left[row], d)
            left = left[out[left] > reach * cell[left]]
            reach *= 2
    answer = np.empty(len(x))
    answer[order] = out[place]
    return answer


def marker_spacing(points: DataFrame, together: int = 200_000) -> DataFrame:
    """image_id and spacing: the upper-middle one of the distances of `points` (image_id, x, y) to their nearest at another place; 0 if there are none. Images are searched in groups of about `together` points."""
    groups = max(1, -(-points.count() // together))
    kind = points.schema["image_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("image_id").combine_chunks().dictionary_encode()
        image = np.asarray(ids.indices)
        d = nearest_distances(*(np.asarray(t.column(c), np.float64) for c in ("x", "y")), image)
        order = np.lexsort((d, image))
        found = np.isfinite(d)[order]
        n = np.bincount(image[order], found, len(ids.dictionary)).astype(np.int64)
        start = np.searchsorted(image[order], np.arange(len(n)))
        middle = np.where(n > 0, d[order][np.minimum(start + n // 2, len(d) - 1)], 0.0)
        return pa.table({"image_id": ids.dictionary, "spacing": pa.array(middle)})

    dealt = points.where("image_id IS NOT NULL").select("image_id", "x", "y", F.pmod(F.xxhash64("image_id"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInArrow(run, f"image_id {kind}, spacing double")


def calibration_audit(least_images: int = 3, least_markers: int = 6, most_error: float = 1.0) -> Plan:
    """What a set of calibration photos allows: set_id, n_images, n_decoded, reference_id, usable, grade.

    calibration_image: set_id, image_id, width and height (null if it can't be decoded), error_px of the set; marker: image_id, marker_id. The reference is the decoded image with most markers (ties: the smallest id). An image is usable
    if it has the reference's size and `least_markers` different markers that the reference shows too. Graded by the error if `least_images` are. The grid of the board isn't inferred: every marker of the reference counts as placed.
    """
    return Plan(
        ("calibration_image", "marker"),
        "Whether a set of calibration photos can be trusted: three photos, a reference with six markers, three photos of its size that share six of them, and an error of 1 pixel at most.",
        f"""WITH m AS (SELECT image_id, count(DISTINCT marker_id) AS n FROM marker GROUP BY image_id),
        i AS (SELECT c.set_id, c.image_id, c.width, c.height, coalesce(m.n, 0) AS n, row_number() OVER (PARTITION BY c.set_id ORDER BY CASE WHEN c.width IS NULL THEN 1 ELSE 0 END, coalesce(m.n, 0) DESC, c.image_id) AS place FROM calibration_image c LEFT JOIN m ON m.image_id = c.image_id),
        r AS (SELECT set_id, image_id, width, height, n FROM i WHERE place = 1 AND width IS NOT NULL),
        k AS (SELECT r.set_id, i.image_id, count(DISTINCT a.marker_id) AS matched FROM r JOIN i ON i.set_id = r.set_id AND i.width = r.width AND i.height = r.height JOIN marker a ON a.image_id = i.image_id JOIN marker b ON b.image_id = r.image_id AND b.marker_id = a.marker_id GROUP BY r.set_id, i.image_id),
        u AS (SELECT set_id, count(*) AS usable FROM k WHERE matched >= {least_markers} GROUP BY set_id),
        s AS (SELECT set_id, count(*) AS n_images, sum(CASE WHEN width IS NULL THEN 0 ELSE 1 END) AS n_decoded, max(error_px) AS error_px FROM calibration_image GROUP BY set_id)
        SELECT s.set_id, s.n_images, CAST(s.n_decoded AS BIGINT) AS n_decoded, r.image_id AS reference_id, coalesce(u.usable, 0) AS usable,
        CASE WHEN s.n_images < {least_images} THEN 'too few images' WHEN s.n_decoded = 0 THEN 'none decoded' WHEN r.n < {least_markers} THEN 'no reference' WHEN coalesce(u.usable, 0) < {least_images} THEN 'too few usable' WHEN s.error_px <= {most_error:g} THEN 'good' ELSE 'poor' END AS grade
        FROM s LEFT JOIN r ON r.set_id = s.set_id LEFT JOIN u ON u.set_id = s.set_id""",
    )


def _solved(n: int, leave_out: bool = True) -> tuple[str, list[str]]:
    """Steps that solve n normal equations m0.. and u0.. in columns (nothing, or nulls unless `leave_out`, where a pivot is below 1e-9), and the names of the solution."""
    size = n + 1
    cells = [[f"m{i + j}" for j in range(n)] + [f"u{i}"] for i in range(n)]
    steps, last = [], "sums"
    for k in range(n):
        pivot = cells[k][k] if leave_out else f"CASE WHEN abs({cells[k][k]}) >= 1e-9 THEN {cells[k][k]} END"
        make = [f"({cells[i][j]} - {cells[k][j]} * {cells[i][k]} / {pivot}) AS s{k}_{i}_{j}" for i in range(n) if i != k for j in range(size)]
        steps.append(f"e{k} AS (SELECT *, {', '.join(make)} FROM {last}" + (f" WHERE abs({cells[k][k]}) >= 1e-9)" if leave_out else ")"))
        cells = [[cells[i][j] if i == k else f"s{k}_{i}_{j}" for j in range(size)] for i in range(n)]
        last = f"e{k}"
    return ", ".join(steps), [f"{cells[i][n]} / {cells[i][i]}" if leave_out else f"{cells[i][n]} / nullif({cells[i][i]}, 0e0)" for i in range(n)]


def mesh_gate(least_lines: int = 6, least_samples: int = 8, reach: int = 20, share: float = 0.06) -> Plan:
    """Whether a page's lines allow a mesh: doc_id, n (usable lines), most (the largest offset of the common bend, in pixels) and mesh.

    line_sample: doc_id, line_num, x, y. Samples of one column count as their mean; each is smoothed with those of its line within `reach` columns (gaps stay gaps), and lines of `least_samples` columns give theirs, less the line's
    upper-middle one, to a cubic fit over all lines. `most` is the largest value of this cubic over all columns up to the page's last; a mesh needs `least_lines` usable lines and `most` within `share` of the height from the first
    to the last line. Sums of powers are all that moves; x counts in hundreds of pixels from its mean, so they stay small.
    """
    steps, solution = _solved(4)
    powers = ", ".join([f"sum(power(t, {k})) AS m{k}" for k in range(7)] + [f"sum(power(t, {k}) * d) AS u{k}" for k in range(4)])
    # The largest value on whole columns lies at an end or beside a place where the cubic turns.
    value = lambda x: f"abs(c0 + (({x}) - ax) / 1e2 * (c1 + (({x}) - ax) / 1e2 * (c2 + (({x}) - ax) / 1e2 * c3)))"
    places = ["0e0", "last_x", *[f"greatest(0e0, least(last_x, {side}(ax + 1e2 * {t})))" for t in ("t1", "t2") for side in ("floor", "ceil")]]
    body = f"""WITH c AS (SELECT doc_id, line_num, floor(x) AS x, avg(y) AS y, sum(y) AS sy, count(*) AS cy FROM line_sample GROUP BY doc_id, line_num, floor(x)),
        w AS (SELECT doc_id, line_num, x, avg(y) OVER (PARTITION BY doc_id, line_num ORDER BY x RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS y, count(*) OVER (PARTITION BY doc_id, line_num) AS n FROM c),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_num ORDER BY y, x) - 1 AS k FROM w WHERE n >= {least_samples}), h AS (SELECT *, max(CASE WHEN k = floor(n / 2e0) THEN y END) OVER (PARTITION BY doc_id, line_num) AS mid FROM o),
        a AS (SELECT doc_id, avg(x) AS ax, count(DISTINCT line_num) AS lines FROM o GROUP BY doc_id), p AS (SELECT h.doc_id, (h.x - a.ax) / 1e2 AS t, h.y - h.mid AS d FROM h JOIN a ON a.doc_id = h.doc_id),
        sums AS (SELECT doc_id, {powers} FROM p GROUP BY doc_id), {steps}, coef AS (SELECT doc_id, {", ".join(f"{v} AS c{i}" for i, v in enumerate(solution))} FROM e3),
        page AS (SELECT doc_id, max(last_x) AS last_x, max(ly) - min(ly) AS height FROM (SELECT doc_id, line_num, max(x) AS last_x, sum(sy) / sum(cy) AS ly FROM c GROUP BY doc_id, line_num) l GROUP BY doc_id),
        turn AS (SELECT page.doc_id, CAST(page.last_x AS DOUBLE) AS last_x, page.height, coalesce(a.lines, 0) AS n, a.ax, c0, c1, c2, c3, CASE WHEN c2 * c2 - 3 * c1 * c3 >= 0 THEN -(c2 + CASE WHEN c2 < 0 THEN -1 ELSE 1 END * sqrt(c2 * c2 - 3 * c1 * c3)) END AS q FROM page LEFT JOIN a ON a.doc_id = page.doc_id LEFT JOIN coef ON coef.doc_id = page.doc_id),
        at_ AS (SELECT *, CASE WHEN c3 <> 0 THEN q / (3 * c3) END AS t1, CASE WHEN q <> 0 THEN c1 / q END AS t2 FROM turn), g AS (SELECT doc_id, n, height, CASE WHEN c0 IS NOT NULL THEN greatest({", ".join(map(value, places))}) END AS most FROM at_)
        SELECT doc_id, n, CASE WHEN n >= {least_lines} THEN round(most, 4) END AS most, coalesce(n >= {least_lines} AND most <= {share} * height, false) AS mesh FROM g"""
    # In Spark a page moves once and its sums are taken in one pass: lines that don't count are left out of sums, and pivots that are too small give nulls, where the SQL above leaves out rows and joins.
    guarded, solution = _solved(4, leave_out=False)
    counts = f"doc_id IS NOT NULL AND n >= {least_samples}"
    once = f"""WITH c AS (SELECT doc_id, line_num, floor(x) AS x, avg(y) AS y, sum(y) AS sy, count(*) AS cy FROM line_sample GROUP BY doc_id, line_num, floor(x)),
        w AS (SELECT doc_id, line_num, x, avg(y) OVER (PARTITION BY doc_id, line_num ORDER BY x RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS y, count(*) OVER (PARTITION BY doc_id, line_num) AS n, sum(sy) OVER (PARTITION BY doc_id, line_num) / sum(cy) OVER (PARTITION BY doc_id, line_num) AS ly FROM c),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_num ORDER BY y, x) - 1 AS k FROM w), h AS (SELECT *, max(CASE WHEN k = floor(n / 2e0) THEN y END) OVER (PARTITION BY doc_id, line_num) AS mid, avg(CASE WHEN {counts} THEN x END) OVER (PARTITION BY doc_id) AS ax FROM o),
        p AS (SELECT doc_id, x, ly, ax, CASE WHEN {counts} AND k = 0 AND line_num IS NOT NULL THEN 1 ELSE 0 END AS line, CASE WHEN {counts} THEN (x - ax) / 1e2 END AS t, CASE WHEN {counts} THEN y - mid END AS d FROM h),
        sums AS (SELECT doc_id, max(ax) AS ax, sum(line) AS n, CAST(max(x) AS DOUBLE) AS last_x, max(ly) - min(ly) AS height, {powers} FROM p GROUP BY doc_id), {guarded}, coef AS (SELECT doc_id, ax, n, last_x, height, {", ".join(f"{v} AS c{i}" for i, v in enumerate(solution))} FROM e3),
        turn AS (SELECT *, CASE WHEN c2 * c2 - 3 * c1 * c3 >= 0 THEN -(c2 + CASE WHEN c2 < 0 THEN -1 ELSE 1 END * sqrt(c2 * c2 - 3 * c1 * c3)) END AS q FROM coef),
        at_ AS{body.split("at_ AS")[1]}"""
    return Plan(("line_sample",), "Whether a page's lines allow a mesh: six lines of eight samples at least, and a common cubic bend within 6 % of the page's height.", run=lambda line_sample: run_together(once, "doc_id", line_sample=line_sample), duckdb=body)


def _edge_points(edge: DataFrame) -> DataFrame:
    return edge.selectExpr("image_id", "CAST(pos AS DOUBLE) AS x", "row_val AS y")


_TRIALS = """pt AS (SELECT image_id, CAST(pos AS DOUBLE) AS x, row_val AS y, row_number() OVER (PARTITION BY image_id ORDER BY pos, row_val) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM edge),
    ab AS (SELECT k, a, (a * 1103515245 + 12345) % 2147483648 AS b FROM (SELECT k, (k * 1103515245 + 12345) % 2147483648 AS a FROM (SELECT unnest(range(300)) AS k) r) q),
    ij AS (SELECT DISTINCT ab.k, pt.image_id, pt.n, (a // 256) % n AS i, (b // 256) % n AS j FROM ab, pt), t AS (SELECT k, image_id, i, CASE WHEN i = j THEN (j + 1) % n ELSE j END AS j FROM ij)"""

PLANS = {
    "e14_robust_line": Plan(("edge",), "The line through two points, of 300 trial pairs, that most points lie within 4 of; then a fit to these.",
        run=lambda edge: robust_lines(_edge_points(edge)).where("inliers IS NOT NULL").selectExpr("image_id", "inliers", "round(slope, 6) AS slope"),
        duckdb=f"""WITH {_TRIALS}, l AS (SELECT t.image_id, t.k, (q.y - p.y) / (q.x - p.x) AS s, p.y - (q.y - p.y) / (q.x - p.x) * p.x AS c FROM t JOIN pt p ON p.image_id = t.image_id AND p.i = t.i JOIN pt q ON q.image_id = t.image_id AND q.i = t.j WHERE p.x <> q.x),
        q AS (SELECT l.image_id, l.k, l.s, l.c, count(*) AS inliers FROM l JOIN pt e ON e.image_id = l.image_id AND abs(e.y - l.s * e.x - l.c) < 4 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY inliers DESC, k) AS rn FROM q)
        SELECT w.image_id, max(w.inliers) AS inliers, round(regr_slope(e.y, e.x), 6) AS slope FROM w JOIN pt e ON e.image_id = w.image_id AND abs(e.y - w.s * e.x - w.c) < 4 WHERE w.rn = 1 AND w.inliers >= 2 GROUP BY w.image_id"""),
    "e26_marker_spacing": Plan(("contour",), "Middle distance of outlines' centres to the nearest at another place, by image.",
        run=lambda contour: marker_spacing(contour.selectExpr("image_id", "x + w / 2e0 AS x", "y + h / 2e0 AS y")).selectExpr("image_id", "round(spacing, 6) AS spacing"),
        duckdb="""WITH p AS (SELECT image_id, contour_id, x + w / 2e0 AS cx, y + h / 2e0 AS cy FROM contour), d AS (SELECT a.image_id, a.contour_id, min(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS d FROM p a JOIN p b ON a.image_id = b.image_id AND (a.cx <> b.cx OR a.cy <> b.cy) GROUP BY a.image_id, a.contour_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, contour_id) - 1 AS k, count(*) OVER (PARTITION BY image_id) AS n FROM d), f AS (SELECT image_id, d FROM r WHERE k = floor(n / 2e0)) SELECT i.image_id, coalesce(round(f.d, 6), 0e0) AS spacing FROM (SELECT DISTINCT image_id FROM contour) i LEFT JOIN f ON f.image_id = i.image_id"""),
    "e27_mesh_gate": mesh_gate(),
    "e34_calibration_audit": calibration_audit(),
}
