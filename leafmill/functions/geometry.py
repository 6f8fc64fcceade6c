"""Geometry of stored crops and frames, as columns."""

from __future__ import annotations

from ..plans.plan import Plan
from .settings import CROP_DUCKDB, CROP_SPARK, FRAMES_DUCKDB, FRAMES_SPARK


def duck(sql: str) -> str:
    """Half-even rounding to whole numbers, which .NET and the archive's tools use, in DuckDB's words."""
    out, i = "", 0
    while (j := sql.find("bround(", i)) >= 0:
        k, depth = j + 7, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out += sql[i:j] + "round_even(" + duck(sql[j + 7 : k - 1]) + ", 0)"
        i = k
    return out + sql[i:]


def _after(tables: str, more: tuple[str, ...], body: str) -> str:
    return f"WITH {', '.join((tables, *more))} {body}"


def on_crops(name_doc: str, body: str, *more: str) -> Plan:
    """A query of stored crops; `more` are further named tables."""
    return Plan(("capture_job",), name_doc, _after(CROP_SPARK, more, body), duck(_after(CROP_DUCKDB, more, body)))


def on_frames(name_doc: str, body: str, *more: str) -> Plan:
    return Plan(("batch",), name_doc, _after(FRAMES_SPARK, more, body), duck(_after(FRAMES_DUCKDB, more, body)))


def both(inputs: tuple[str, ...], name_doc: str, body: str) -> Plan:
    return Plan(inputs, name_doc, body, duck(body))


def _ends(sign: str, first: int) -> str:
    """The corners as an array that sorts by x and y added or subtracted, then by place."""
    return "array(" + ", ".join(f"struct(x{i} {sign} y{i} AS at, {i * first} AS i, x{i} AS x, y{i} AS y)" for i in (1, 2, 3, 4)) + ")"


def _cross(a: int, b: int, c: int) -> str:
    return f"((x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b}))"


TURNS = [_cross(1, 2, 3), _cross(2, 3, 4), _cross(3, 4, 1), _cross(4, 1, 2)]
SIDE = lambda a, b: f"sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b}))"


def _dot(a: int, b: int, c: int) -> str:
    return f"(x{a} - x{b}) * (x{c} - x{b}) + (y{a} - y{b}) * (y{c} - y{b})"


#: Of each corner: the product of its two sides' lengths, and their dot product.
CORNERS = f"""sides AS (SELECT job_id, {SIDE(1, 2)} AS a, {SIDE(2, 3)} AS b, {SIDE(3, 4)} AS c, {SIDE(4, 1)} AS d, {_dot(4, 1, 2)} AS d1, {_dot(1, 2, 3)} AS d2, {_dot(2, 3, 4)} AS d3, {_dot(3, 4, 1)} AS d4 FROM crop),
        corners AS (SELECT job_id, d * a AS l1, a * b AS l2, b * c AS l3, c * d AS l4, d1, d2, d3, d4 FROM sides)"""


def _angle(i: int) -> str:
    """Deviation from a right angle at a corner, in degrees; 0 where a side has no length."""
    return f"CASE WHEN l{i} < 0.000001 THEN 0 ELSE abs(degrees(acos(greatest(-1.0, least(1.0, d{i} / l{i})))) - 90) END"


PLANS = {
    "c01_is_convex": on_crops("Whether a quad turns one way at all corners; turns near 0 are ignored.", f"SELECT job_id, NOT (least({', '.join(TURNS)}) < -0.000001 AND greatest({', '.join(TURNS)}) > 0.000001) AS convex FROM crop"),
    "c02_order_corners": Plan(("capture_job",), "Corners by extreme sums and differences of x and y; the first on a tie.",
        _after(CROP_SPARK, (f"k AS (SELECT job_id, array_min({_ends('+', 1)}) AS tl, array_max({_ends('-', -1)}) AS tr, array_max({_ends('+', -1)}) AS br, array_min({_ends('-', 1)}) AS bl FROM crop)", "o AS (SELECT job_id, min(tl) AS tl, max(tr) AS tr, max(br) AS br, min(bl) AS bl FROM k GROUP BY job_id)"),
            f"SELECT job_id, {', '.join(f'{c}.{v} AS {c}_{v}' for c in ('tl', 'tr', 'br', 'bl') for v in 'xy')} FROM o"),
        on_crops("Corners by extreme sums and differences of x and y; the first on a tie.",
        """SELECT job_id, max(CASE WHEN tl = 1 THEN x END) AS tl_x, max(CASE WHEN tl = 1 THEN y END) AS tl_y, max(CASE WHEN tr = 1 THEN x END) AS tr_x, max(CASE WHEN tr = 1 THEN y END) AS tr_y, max(CASE WHEN br = 1 THEN x END) AS br_x, max(CASE WHEN br = 1 THEN y END) AS br_y, max(CASE WHEN bl = 1 THEN x END) AS bl_x, max(CASE WHEN bl = 1 THEN y END) AS bl_y FROM k GROUP BY job_id""",
        """pt AS (SELECT job_id, 1 AS i, x1 AS x, y1 AS y FROM crop UNION ALL SELECT job_id, 2, x2, y2 FROM crop UNION ALL SELECT job_id, 3, x3, y3 FROM crop UNION ALL SELECT job_id, 4, x4, y4 FROM crop),
        k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY x + y, i) AS tl, row_number() OVER (PARTITION BY job_id ORDER BY x - y DESC, i) AS tr, row_number() OVER (PARTITION BY job_id ORDER BY x + y DESC, i) AS br, row_number() OVER (PARTITION BY job_id ORDER BY x - y, i) AS bl FROM pt)""").duckdb),
    "c03_is_axis_rect": on_crops("Whether a quad is an upright rectangle within 0.01, and its rounded rectangle.",
        "SELECT job_id, abs(x1 - x4) <= 0.01 AND abs(x2 - x3) <= 0.01 AND abs(y1 - y2) <= 0.01 AND abs(y3 - y4) <= 0.01 AS axis_rect, CAST(bround(x1) AS INT) AS x, CAST(bround(y1) AS INT) AS y, CAST(greatest(1, bround(x3 - x1)) AS INT) AS w, CAST(greatest(1, bround(y3 - y1)) AS INT) AS h FROM crop"),
    "c04_pad_rect": on_frames("Frames grown by 5 %, then kept inside 960 x 640.",
        "SELECT batch_id, n, greatest(0.0, x - w * 0.05) AS x0, greatest(0.0, y - h * 0.05) AS y0, least(960.0, x + w * 1.05) AS x1, least(640.0, y + h * 1.05) AS y1 FROM ok"),
    "c05_bounding_rect": on_crops("Whole-number rectangle around a quad, inside 1000 x 800, at least 1 x 1.",
        "SELECT job_id, x, y, greatest(1, least(1000, r) - x) AS w, greatest(1, least(800, d) - y) AS h FROM b", "b AS (SELECT job_id, greatest(0, least(999, CAST(floor(least(x1, x2, x3, x4)) AS INT))) AS x, greatest(0, least(799, CAST(floor(least(y1, y2, y3, y4)) AS INT))) AS y, CAST(ceil(greatest(x1, x2, x3, x4)) AS INT) AS r, CAST(ceil(greatest(y1, y2, y3, y4)) AS INT) AS d FROM crop)"),
    "c06_warp_size": on_crops("Size of a straightened quad: the longer of opposite sides, rounded.", f"SELECT job_id, CAST(bround(greatest({SIDE(1, 2)}, {SIDE(4, 3)})) AS INT) AS w, CAST(bround(greatest({SIDE(1, 4)}, {SIDE(2, 3)})) AS INT) AS h FROM crop"),
    "c07_corner_angle_score": on_crops("1 less the mean deviation from right angles over 45 degrees, between 0 and 1.", f"SELECT job_id, round(greatest(0.0, least(1.0, 1 - ({_angle(1)} + {_angle(2)} + {_angle(3)} + {_angle(4)}) / 4 / 45)), 9) AS score FROM corners", CORNERS),
    "c08_scale_frames": on_frames("Frames scaled from the size they were drawn at to 4000 x 3000 (factor 1 if unknown), rounded and kept inside; also as fractions.",
        "SELECT batch_id, n, sx, sy, greatest(1, least(sw, 4000 - sx)) AS sw, greatest(1, least(sh, 3000 - sy)) AS sh, round(sx / CAST(4000 AS DOUBLE), 9) AS fraction_x, round(sy / CAST(3000 AS DOUBLE), 9) AS fraction_y FROM sd", """sc AS (SELECT *, CASE WHEN frame_ref_w = 0 THEN 1.0 ELSE 4000.0 / frame_ref_w END AS fx, CASE WHEN frame_ref_h = 0 THEN 1.0 ELSE 3000.0 / frame_ref_h END AS fy FROM ok),
        sd AS (SELECT batch_id, n, least(3999, greatest(0, CAST(bround(CAST(x * fx AS DOUBLE)) AS INT))) AS sx, least(2999, greatest(0, CAST(bround(CAST(y * fy AS DOUBLE)) AS INT))) AS sy, CAST(bround(CAST(w * fx AS DOUBLE)) AS INT) AS sw, CAST(bround(CAST(h * fy AS DOUBLE)) AS INT) AS sh FROM sc)"""),
    "c09_aspect_mismatch": both(("batch",), "Whether a batch's frames were drawn at another aspect ratio than 3 : 2, by over 0.02.", "SELECT batch_id, frame_ref_h > 0 AND abs(frame_ref_w / CAST(frame_ref_h AS DOUBLE) - 1.5 - (batch_id % 3) * 0.015) > 0.02 AS mismatch FROM batch WHERE frame_ref_h > 0"),
    "c10_frame_audit": on_frames("Frames both of whose edges are at least 2 % of the drawing's shorter side.", "SELECT batch_id, n, w >= greatest(1.0, 0.02 * least(frame_ref_w, frame_ref_h)) AND h >= greatest(1.0, 0.02 * least(frame_ref_w, frame_ref_h)) AS valid FROM ok"),
    "c11_normalize_adjustments": both(("capture_job",), "Rotation to a quarter turn, tone to -1..1, sharpness to 0..1, and whether any is not the default.",
        """WITH n AS (SELECT job_id, CAST(((bround(rotation_degrees / CAST(90 AS DOUBLE)) % 4) + 4) % 4 * 90 AS INT) AS rotation, greatest(-1.0, least(1.0, brightness)) AS brightness, greatest(-1.0, least(1.0, contrast)) AS contrast, greatest(-1.0, least(1.0, saturation)) AS saturation, greatest(0.0, least(1.0, sharpness)) AS sharpness, greatest(-1.0, least(1.0, white_balance)) AS white_balance FROM capture_job)
        SELECT *, rotation <> 0 OR abs(brightness) > 0.000001 OR abs(contrast) > 0.000001 OR abs(saturation) > 0.000001 OR abs(sharpness) > 0.000001 OR abs(white_balance) > 0.000001 AS adjusted FROM n"""),
    "c12_dpi_columns": both(("calibration",), "Measured pixels per inch if plausible (20 to 4800), else 285; and the scale to 300, between 1/8 and 8.",
        """WITH p AS (SELECT calibration_id, (pixel_w / target_w_in + pixel_h / target_h_in) / 2 AS ppi FROM calibration), q AS (SELECT calibration_id, CASE WHEN ppi BETWEEN 20 AND 4800 THEN ppi ELSE CAST(285 AS DOUBLE) END AS dpi FROM p)
        SELECT calibration_id, round(dpi, 6) AS dpi, round(greatest(0.125, least(8.0, 300 / dpi)), 9) AS scale, CAST(greatest(1, bround(2480 * greatest(0.125, least(8.0, 300 / dpi)))) AS INT) AS out_w FROM q"""),
}
