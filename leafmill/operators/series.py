"""Series along page edges and text lines: rolling means, runs, fits, decisions about outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import both
from ..plans.plan import Plan
from . import slopes, trace
from .raster import OTSU

ROLLED = "rolled AS (SELECT image_id, pos, val, avg(val) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS r, max(pos) OVER (PARTITION BY image_id) + 1 AS n FROM profile)"
LEVELS = "levels AS (SELECT image_id, median(CASE WHEN pos >= 0.2 * n AND pos < 0.8 * n THEN val END) AS page, min(CASE WHEN pos < 20 THEN val END) AS near_min, min(CASE WHEN pos >= n - 20 THEN val END) AS far_min, max(n) AS n FROM rolled GROUP BY image_id)"

#: For DuckDB, weak samples of an edge replaced by straight lines between the strong ones beside them.
BRIDGED = """lim AS (SELECT image_id, 0.4 * median(strength) AS weak FROM edge GROUP BY image_id), st AS (SELECT e.image_id, e.pos, e.row_val, e.strength, e.strength > l.weak AS good FROM edge e JOIN lim l ON e.image_id = l.image_id),
    nb AS (SELECT *, max(CASE WHEN good THEN pos END) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0, min(CASE WHEN good THEN pos END) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1 FROM st),
    bridged AS (SELECT n.image_id, n.pos, n.row_val, n.strength, CASE WHEN n.good THEN n.row_val WHEN a.pos IS NULL THEN coalesce(b.row_val, n.row_val) WHEN b.pos IS NULL THEN a.row_val ELSE a.row_val + (b.row_val - a.row_val) * (n.pos - a.pos) / CAST(b.pos - a.pos AS DOUBLE) END AS val
    FROM nb n LEFT JOIN st a ON a.image_id = n.image_id AND a.pos = n.p0 LEFT JOIN st b ON b.image_id = n.image_id AND b.pos = n.p1)"""

#: Profile split in two by Otsu's threshold of its values on 256 levels.
SPLIT = "rng AS (SELECT image_id, min(val) AS lo, max(val) AS hi, count(*) AS cnt FROM profile GROUP BY image_id), hist AS (SELECT p.image_id, CAST(floor((p.val - r.lo) / (r.hi - r.lo) * 255) AS INT) AS v, count(*) AS n FROM profile p JOIN rng r ON p.image_id = r.image_id WHERE r.hi > r.lo AND r.cnt >= 20 GROUP BY p.image_id, CAST(floor((p.val - r.lo) / (r.hi - r.lo) * 255) AS INT)), " + OTSU + ", cut AS (SELECT o.image_id, r.lo + o.threshold / 255e0 * (r.hi - r.lo) AS at_val FROM otsu o JOIN rng r ON o.image_id = r.image_id)"
MASK = SPLIT + """, raw AS (SELECT p.image_id, p.pos, CASE WHEN p.val > c.at_val THEN 1 ELSE 0 END AS m FROM profile p JOIN cut c ON p.image_id = c.image_id),
    ends AS (SELECT image_id, max(CASE WHEN pos = 0 THEN m END) AS first_m, max(CASE WHEN pos = 63 THEN m END) AS last_m FROM raw GROUP BY image_id),
    sums AS (SELECT image_id, pos, m, sum(m) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM raw),
    mask AS (SELECT s.image_id, s.pos, CASE WHEN s.s + greatest(0, 2 - s.pos) * e.first_m + greatest(0, s.pos - 61) * e.last_m >= 3 THEN 1 ELSE 0 END AS m FROM sums s JOIN ends e ON s.image_id = e.image_id)"""
#: Runs of a mask of at least 20 places and 5 % of its width, merged over gaps of 10 places or 3 % of it; the widest of them, the first on a tie.
RUNS = """wide AS (SELECT image_id, count(*) AS n FROM mask GROUP BY image_id), isl AS (SELECT image_id, pos, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS g FROM mask WHERE m = 1),
    run0 AS (SELECT i.image_id, n, min(pos) AS a, max(pos) AS b FROM isl i JOIN wide ON i.image_id = wide.image_id GROUP BY i.image_id, n, g HAVING max(pos) - min(pos) + 1 >= greatest(20, floor(0.05 * n))),
    run1 AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY image_id ORDER BY a) - 1 <= greatest(10, floor(0.03 * n)) THEN 0 ELSE 1 END AS fresh FROM run0), run2 AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id ORDER BY a) AS k FROM run1),
    runs AS (SELECT image_id, n, min(a) AS a, max(b) AS b FROM run2 GROUP BY image_id, n, k), widest AS (SELECT image_id, n, a, b FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY b - a DESC, a) AS rn FROM runs) q WHERE rn = 1)"""


def book_span(gutter: int | None = None) -> str:
    """SQL for the span of a book over `mask`: the widest run, or with a gutter's place, from the last run that starts at or before it to the first that ends at or after it.

    Without a run on both sides of the gutter it is the widest one; images without runs have no row.
    """
    if gutter is None:
        return f"{RUNS}, span AS (SELECT image_id, a, b FROM widest)"
    at = f"greatest(0, least({gutter}, n - 1))"
    return f"""{RUNS}, beside AS (SELECT image_id, max(CASE WHEN a <= {at} THEN a END) AS l, min(CASE WHEN b >= {at} THEN b END) AS r FROM runs GROUP BY image_id),
    span AS (SELECT w.image_id, CASE WHEN l IS NULL OR r IS NULL THEN a ELSE l END AS a, CASE WHEN l IS NULL OR r IS NULL THEN b ELSE r END AS b FROM widest w JOIN beside ON w.image_id = beside.image_id)"""


#: Power sums of a quadratic fit around a centre, and its three coefficients, from m0..m4 and u0..u2.
DET = "(m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m2 * m3) + m2 * (m1 * m3 - m2 * m2))"
C0 = f"(u0 * (m2 * m4 - m3 * m3) - m1 * (u1 * m4 - u2 * m3) + m2 * (u1 * m3 - u2 * m2)) / {DET}"
C1 = f"(m0 * (u1 * m4 - u2 * m3) - u0 * (m1 * m4 - m2 * m3) + m2 * (m1 * u2 - m2 * u1)) / {DET}"
C2 = f"(m0 * (m2 * u2 - m3 * u1) - m1 * (m1 * u2 - m2 * u1) + u0 * (m1 * m3 - m2 * m2)) / {DET}"

LINES = "ln AS (SELECT doc_id, line_num, min(x) AS lx, avg(y) AS ly, count(*) AS cnt, regr_slope(y, x) AS slope FROM line_sample GROUP BY doc_id, line_num)"
#: For DuckDB, slope v over y of the lines of a page: upper-middle slope of all pairs at least 2 % of the height apart, upper-middle intercept, share of lines within `near` of it.
_THEIL_DUCKDB = """{n}_l AS (SELECT doc_id, line_num, ly, {v} AS v FROM ln WHERE {lines}), {n}_h AS (SELECT doc_id, min(ly) AS first_y, max(ly) AS last_y FROM {n}_l GROUP BY doc_id HAVING count(*) >= 8),
        {n}_p AS (SELECT a.doc_id, (b.v - a.v) / (b.ly - a.ly) AS s FROM {n}_l a JOIN {n}_l b ON a.doc_id = b.doc_id AND b.ly > a.ly JOIN {n}_h h ON h.doc_id = a.doc_id WHERE b.ly - a.ly >= 0.02 * (h.last_y - h.first_y)),
        {n}_m AS (SELECT doc_id, list_sort(list(s))[count(*) // 2 + 1] AS s FROM {n}_p GROUP BY doc_id), {n}_c AS (SELECT l.doc_id, m.s, l.v - m.s * l.ly AS c, l.ly FROM {n}_l l JOIN {n}_m m ON l.doc_id = m.doc_id),
        {n}_k AS (SELECT doc_id, list_sort(list(c))[count(*) // 2 + 1] AS mid FROM {n}_c GROUP BY doc_id),
        {n} AS (SELECT c.doc_id, max(c.s) AS s, max(k.mid) AS c, max(h.first_y) AS first_y, max(h.last_y) AS last_y, avg(CASE WHEN abs(c.c - k.mid) <= {near} THEN 1e0 ELSE 0e0 END) AS share, min_by(c.ly, (round(abs(c.c - k.mid), 9), c.ly)) AS pivot_y FROM {n}_c c JOIN {n}_k k ON c.doc_id = k.doc_id JOIN {n}_h h ON h.doc_id = c.doc_id GROUP BY c.doc_id)"""
_SHEAR = "shear AS (SELECT doc_id, round(degrees(atan(s)), 6) AS angle, round(share, 6) AS inliers, round(pivot_y, 6) AS pivot_y, share >= 0.6 AND abs(degrees(atan(s))) BETWEEN 0.3 AND 10 AS applies FROM margin)"
_FIELD = "span AS (SELECT *, abs(degrees(atan(c + s * last_y)) - degrees(atan(c + s * first_y))) AS span FROM turn), field AS (SELECT doc_id, round(s, 9) + 0e0 AS trend, round(c, 9) + 0e0 AS slope, round(span, 6) AS span, round(share, 6) AS share, share >= 0.5 AND span BETWEEN 0.5 AND 10 AS applies FROM span)"
_MARGIN, _TURN = {"n": "margin", "v": "lx", "lines": "cnt >= 1", "near": "15"}, {"n": "turn", "v": "slope", "lines": "cnt >= 8", "near": "0.03e0"}
SHEAR_DUCKDB, FIELD_DUCKDB = f"{_THEIL_DUCKDB.format(**_MARGIN)}, {_SHEAR}", f"{_THEIL_DUCKDB.format(**_TURN)}, {_FIELD}"
DECISION = """a AS (SELECT doc_id, line_num, degrees(atan(slope)) AS deg FROM ln WHERE cnt >= 8), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY deg, line_num) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM a),
        q AS (SELECT doc_id, max(n) AS n, max(CASE WHEN k = floor(n / 2e0) THEN deg END) AS mid, max(CASE WHEN k = floor(n * 3 / 4e0) THEN deg END) - max(CASE WHEN k = floor(n / 4e0) THEN deg END) AS iqr FROM r GROUP BY doc_id)
        SELECT q.doc_id, q.n, round(mid, 6) AS angle, round(iqr, 6) AS iqr, CASE WHEN n < 3 THEN 'none' WHEN iqr <= 3 AND abs(mid) >= 0.1 THEN CASE WHEN abs(mid) <= 15 THEN 'lines' ELSE 'none' END WHEN field.applies THEN 'rotation' WHEN shear.applies THEN 'shear' ELSE 'none' END AS decision
        FROM q LEFT JOIN field ON q.doc_id = field.doc_id LEFT JOIN shear ON q.doc_id = shear.doc_id"""
SCORED = """sc AS (SELECT *, area / 800000 AS share, CASE WHEN area / 800000 < 0.1 THEN NULL ELSE 0.5e0 * area / 800000 + 0.3e0 * area / rect_area + 0.2e0 END AS conf FROM contour),
    big AS (SELECT *, row_number() OVER (PARTITION BY image_id, pass ORDER BY area DESC, contour_id) AS rn FROM sc),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(conf, 9) DESC, pass) AS pick FROM big WHERE rn = 1 AND conf IS NOT NULL) q WHERE pick = 1)"""

PLANS = {
    "e01_rolling_mean": both(("profile",), "Mean of nine samples around each, cut at the ends.", f"WITH {ROLLED} SELECT image_id, pos, round(r, 9) AS mean FROM rolled"),
    "e02_sustained_transition": both(("profile",), "First and last place where the rolling mean passes 60 % of the way from background to page.",
        f"WITH {ROLLED}, {LEVELS}, t AS (SELECT *, least(near_min, far_min) + 0.6e0 * (page - least(near_min, far_min)) AS cut FROM levels) SELECT t.image_id, coalesce(min(CASE WHEN r > cut THEN pos END), 0) AS first_pos, coalesce(max(CASE WHEN r > cut THEN pos END), max(t.n) - 1) AS last_pos, round(max(t.cut), 6) AS cut FROM t JOIN rolled q ON q.image_id = t.image_id GROUP BY t.image_id"),
    "e03_row_transition": both(("profile",), "As e02, with the near end alone as background.",
        f"WITH {ROLLED}, {LEVELS}, t AS (SELECT *, near_min + 0.6e0 * (page - near_min) AS cut FROM levels) SELECT t.image_id, coalesce(min(CASE WHEN r > cut THEN pos END), 0) AS first_pos, round(max(t.cut), 6) AS cut FROM t JOIN rolled q ON q.image_id = t.image_id GROUP BY t.image_id"),
    "e04_bridge_low_confidence": Plan(("edge",), "An edge whose weak samples are bridged.", run=lambda edge: trace.bridge_edges(edge).selectExpr("image_id", "pos", "round(val, 9) AS val"), duckdb=f"WITH {BRIDGED} SELECT image_id, pos, round(val, 9) AS val FROM bridged"),
    "e05_count_bridged": Plan(("edge",), "Samples that bridging moved by over 0.01.", run=lambda edge: trace.bridge_edges(edge).groupBy("image_id").agg(F.count_if(F.abs(F.col("val") - F.col("row_val")) > 0.01).alias("moved")),
        duckdb=f"WITH {BRIDGED} SELECT image_id, sum(CASE WHEN abs(val - row_val) > 0.01 THEN 1 ELSE 0 END) AS moved FROM bridged GROUP BY image_id"),
    "e06_savgol": both(("edge",), "Local quadratic fit over 151 samples, fewer at the ends; places count from the middle of each edge.",
        f"""WITH d AS (SELECT image_id, pos, (pos - (min(pos) OVER (PARTITION BY image_id) + max(pos) OVER (PARTITION BY image_id)) / 2e0) / 64 AS i, row_val AS v FROM edge), s AS (SELECT image_id, pos, i, v, count(*) OVER w AS s0, sum(i) OVER w AS s1, sum(i * i) OVER w AS s2, sum(i * i * i) OVER w AS s3, sum(i * i * i * i) OVER w AS s4, sum(v) OVER w AS t0, sum(i * v) OVER w AS t1, sum(i * i * v) OVER w AS t2 FROM d WINDOW w AS (PARTITION BY image_id ORDER BY i ROWS BETWEEN 75 PRECEDING AND 75 FOLLOWING)),
        c AS (SELECT image_id, pos, v, CAST(s0 AS DOUBLE) AS m0, s1 - i * s0 AS m1, s2 - 2 * i * s1 + i * i * s0 AS m2, s3 - 3 * i * s2 + 3 * i * i * s1 - i * i * i * s0 AS m3, s4 - 4 * i * s3 + 6 * i * i * s2 - 4 * i * i * i * s1 + i * i * i * i * s0 AS m4, t0 AS u0, t1 - i * t0 AS u1, t2 - 2 * i * t1 + i * i * t0 AS u2 FROM s)
        SELECT image_id, pos, round(CASE WHEN m0 >= 3 THEN {C0} ELSE v END, 6) AS val FROM c"""),
    "e07_gutter_notch": both(("edge",), "Near the middle, the lowest and the highest place of an edge (the first of each), and the length of the line between.",
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_val DESC, pos) AS hi, row_number() OVER (PARTITION BY image_id ORDER BY row_val, pos) AS lo FROM edge WHERE pos BETWEEN 12 AND 52), k AS (SELECT image_id, max(CASE WHEN hi = 1 THEN pos END) AS top_pos, max(CASE WHEN hi = 1 THEN row_val END) AS top_val, max(CASE WHEN lo = 1 THEN pos END) AS bottom_pos, max(CASE WHEN lo = 1 THEN row_val END) AS bottom_val FROM r GROUP BY image_id) SELECT *, CAST(bround(sqrt(CAST((top_pos - bottom_pos) * (top_pos - bottom_pos) AS DOUBLE) + (top_val - bottom_val) * (top_val - bottom_val))) AS INT) AS length FROM k"),
    "e08_otsu_split": both(("profile",), "Value that splits a profile in two classes; none with under 20 values or no range.", f"WITH {SPLIT} SELECT image_id, round(at_val, 6) AS cut FROM cut"),
    "e09_clean_mask": both(("profile",), "Majority of five around each sample of the split profile; ends are replicated.", f"WITH {MASK} SELECT image_id, pos, m FROM mask"),
    "e10_book_span": both(("profile",), "The widest run of the cleaned mask; runs of under 20 places or 5 % don't count, gaps of 10 or 3 % are bridged. `book_span` takes a gutter's place.", f"WITH {MASK}, {book_span()} SELECT image_id, a, b FROM span"),
    "e11_detect_span": both(("profile",), "The span of e10, or nothing where there is none.", f"WITH {MASK}, {book_span()} SELECT wide.image_id, a, b FROM wide LEFT JOIN span ON wide.image_id = span.image_id"),
    "e13_line_fit": both(("edge",), "Least squares of an edge's rows on its columns.", "SELECT image_id, round(regr_slope(row_val, pos), 9) AS slope, round(regr_intercept(row_val, pos), 6) AS intercept FROM edge GROUP BY image_id"),
    "e15_edge_quality": both(("edge",), "Spread of each half of an edge around its line and its median strength; good if steady and at least half as strong as the stronger half of its image, else it needs a second try. Reduced: halves stand for sides; no distance to the gutter.",
        """WITH h AS (SELECT e.*, CASE WHEN 2 * pos < max(pos) OVER (PARTITION BY image_id) + 1 THEN 'left' ELSE 'right' END AS side FROM edge e), f AS (SELECT image_id, side, regr_slope(row_val, pos) AS s, regr_intercept(row_val, pos) AS c, median(strength) AS strength FROM h GROUP BY image_id, side),
        j AS (SELECT f.image_id, f.side, max(f.strength) AS strength, sqrt(avg(power(h.row_val - f.s * h.pos - f.c, 2))) AS jitter FROM f JOIN h ON h.image_id = f.image_id AND h.side = f.side GROUP BY f.image_id, f.side), g AS (SELECT *, jitter <= 3 AND strength >= 0.5 * max(strength) OVER (PARTITION BY image_id) AS good FROM j)
        SELECT image_id, side, round(jitter, 6) AS jitter, strength, good, NOT good AS needs_retry FROM g"""),
    "e16_interp": both(("profile",), "A profile at places between its samples, by straight lines; ends are held.",
        "WITH s AS (SELECT image_id, pos, val, lead(pos) OVER w AS p1, lead(val) OVER w AS v1 FROM profile WINDOW w AS (PARTITION BY image_id ORDER BY pos)) SELECT image_id, pos + 0.25e0 AS x, round(CASE WHEN p1 IS NULL THEN val ELSE val + (v1 - val) * 0.25e0 / (p1 - pos) END, 9) AS val FROM s"),
    "e17_arc_length": both(("edge",), "Length along an edge up to each sample.", "WITH d AS (SELECT image_id, pos, sqrt(1 + power(row_val - lag(row_val) OVER (PARTITION BY image_id ORDER BY pos), 2)) AS step FROM edge) SELECT image_id, pos, round(sum(coalesce(step, 0)) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS length FROM d"),
    "e18_margin_shear": Plan(("line_sample",), "Slope of the left margin: the upper-middle slope of all pairs of lines far enough apart; 8 lines and 60 % of them within 15 pixels are needed, and 0.3 to 10 degrees. Turned around the line that fits best.",
        run=slopes.margin_shear, duckdb=f"WITH {LINES}, {SHEAR_DUCKDB} SELECT * FROM shear"),
    "e19_rotation_field": Plan(("line_sample",), "How the lines' own slopes change down the page: as e18, with 8 lines of 8 samples, half of them within 0.03, and a span of 0.5 to 10 degrees from the first to the last line.",
        run=slopes.rotation_field, duckdb=f"WITH {LINES}, {FIELD_DUCKDB} SELECT * FROM field"),
    "e20_deskew_decision": Plan(("line_sample",), "How to set a page straight. By its lines' middle angle, if three lines have 8 samples, quartiles are within 3 degrees and it is 0.1 at least (none beyond 15); else by e19; else by e18; else none.",
        run=slopes.deskew_decision, duckdb=f"WITH {LINES}, {FIELD_DUCKDB}, {SHEAR_DUCKDB}, {DECISION}"),
    "e21_poly_fit": both(("edge",), "Quadratic through an edge, weighted by strength, around its mean column; nothing if singular.",
        f"""WITH c AS (SELECT image_id, avg(CAST(pos AS DOUBLE)) AS mid FROM edge GROUP BY image_id), d AS (SELECT e.image_id, e.pos - c.mid AS t, e.row_val AS v, e.strength + 1 AS w FROM edge e JOIN c ON e.image_id = c.image_id),
        s AS (SELECT image_id, sum(w) AS m0, sum(w * t) AS m1, sum(w * t * t) AS m2, sum(w * t * t * t) AS m3, sum(w * t * t * t * t) AS m4, sum(w * v) AS u0, sum(w * t * v) AS u1, sum(w * t * t * v) AS u2 FROM d GROUP BY image_id) SELECT image_id, round({C0}, 5) AS c0, round({C1}, 6) AS c1, round({C2}, 7) AS c2 FROM s WHERE abs({DET}) > 0.000000001"""),
    "e28_detection_score": both(("contour",), "The best outline of each image over the passes; a later pass must be strictly better. Padded by 10 but where it touches the border.",
        f"WITH {SCORED} SELECT image_id, contour_id, pass, round(conf, 12) AS conf, CASE WHEN x <= 0 THEN x ELSE greatest(0, x - 10) END AS px, CASE WHEN y <= 0 THEN y ELSE greatest(0, y - 10) END AS py FROM best"),
    "e29_two_page_pair": both(("contour",), "The two largest outlines of 15 to 60 % of the image, left to right, if they overlap by a quarter of the narrower at most.",
        "WITH r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, contour_id) AS rn FROM contour WHERE area / 800000 BETWEEN 0.15 AND 0.6) SELECT a.image_id, CASE WHEN a.x + a.w / 2e0 <= b.x + b.w / 2e0 THEN a.contour_id ELSE b.contour_id END AS left_id, CASE WHEN a.x + a.w / 2e0 <= b.x + b.w / 2e0 THEN b.contour_id ELSE a.contour_id END AS right_id, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) AS overlap FROM r a JOIN r b ON a.image_id = b.image_id AND a.rn = 1 AND b.rn = 2 WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) <= 0.25 * least(a.w, b.w)"),
    "e30_crop_decision": both(("contour",), "Keep the whole page below a confidence of 0.3, crop with a warning below 0.5, else crop.",
        f"WITH {SCORED}, i AS (SELECT DISTINCT image_id FROM contour) SELECT i.image_id, CASE WHEN conf IS NULL OR conf < 0.3 THEN 'whole' ELSE 'crop' END AS action, CASE WHEN conf IS NULL OR conf < 0.5 THEN 'WARNING' ELSE 'PASS' END AS verdict FROM i LEFT JOIN best b ON i.image_id = b.image_id"),
    "e31_quad_from_traces": both(("edge",), "Side of each half of an edge: its mean row, and the edge's row there.", "SELECT image_id, round(avg(CASE WHEN pos < 32 THEN row_val END), 6) AS left_mean, round(avg(CASE WHEN pos >= 32 THEN row_val END), 6) AS right_mean, max(CASE WHEN pos = 0 THEN row_val END) AS left_row, max(CASE WHEN pos = 63 THEN row_val END) AS right_row FROM edge GROUP BY image_id"),
    "e32_output_size": both(("edge",), "Size of a flattened page: the edge's length, at least a quarter of its width, and the range of its rows.", "WITH d AS (SELECT image_id, pos, row_val, sqrt(1 + power(row_val - lag(row_val) OVER (PARTITION BY image_id ORDER BY pos), 2)) AS step FROM edge) SELECT image_id, CAST(greatest(bround(sum(coalesce(step, 0))), bround(count(*) / 4e0)) AS INT) AS w, CAST(greatest(1, max(row_val) - min(row_val)) AS INT) AS h FROM d GROUP BY image_id"),
    "e33_spline": both(("profile",), "Catmull-Rom spline through a profile, half way between its samples; ends are held.",
        "WITH p AS (SELECT image_id, pos, val AS p1, coalesce(lag(val) OVER w, val) AS p0, lead(val) OVER w AS p2, lead(val, 2) OVER w AS q3 FROM profile WINDOW w AS (PARTITION BY image_id ORDER BY pos)) SELECT image_id, pos + 0.5e0 AS x, round(0.5e0 * (2 * p1 + (p2 - p0) * 0.5e0 + (2 * p0 - 5 * p1 + 4 * p2 - coalesce(q3, p2)) * 0.25e0 + (3 * p1 - p0 - 3 * p2 + coalesce(q3, p2)) * 0.125e0), 6) AS val FROM p WHERE p2 IS NOT NULL"),
    "e35_nearest_edge_point": Plan(("contour", "edge"), "The edge sample nearest to a corner, within 15 pixels, else the corner; candidates come from the corner's cell and its neighbours.",
        """WITH k AS (SELECT contour_id, image_id % 10 AS img, CAST(x % 64 AS DOUBLE) AS cx, CAST(y % 40 AS DOUBLE) AS cy FROM contour),
        near AS (SELECT image_id, cell, collect_list(struct(pos, row_val)) AS points FROM (SELECT image_id, pos, row_val, explode(transform(array(-1, 0, 1), d -> CAST(floor(pos / 16e0) AS INT) + d)) AS cell FROM edge WHERE abs(image_id) < 10) e GROUP BY image_id, cell),
        d AS (SELECT DISTINCT img, cx, cy FROM k),
        b AS (SELECT /*+ BROADCAST(near) */ img, cx AS dx, cy AS dy, array_min(filter(transform(points, p -> struct((p.pos - cx) * (p.pos - cx) + (p.row_val - cy) * (p.row_val - cy) AS d2, p.pos AS pos, p.row_val AS row_val)), s -> s.d2 <= 225)) AS best FROM d JOIN near ON near.image_id = d.img AND near.cell = CAST(floor(cx / 16) AS INT)),
        c AS (SELECT /*+ BROADCAST(b) */ contour_id, cx, cy, best FROM k LEFT JOIN b ON b.img = k.img AND b.dx = k.cx AND b.dy = k.cy)
        SELECT contour_id, coalesce(CAST(best.pos AS DOUBLE), cx) AS x, coalesce(best.row_val, cy) AS y FROM (SELECT contour_id, min(cx) AS cx, min(cy) AS cy, min(best) AS best FROM c GROUP BY contour_id) f""",
        "WITH k AS (SELECT contour_id, image_id % 10 AS img, CAST(x % 64 AS DOUBLE) AS cx, CAST(y % 40 AS DOUBLE) AS cy FROM contour), n AS (SELECT k.*, CAST(floor(cx / 16) AS INT) + d AS cell FROM k CROSS JOIN (VALUES (-1), (0), (1)) AS t(d)), e AS (SELECT image_id, pos, row_val, CAST(floor(pos / 16e0) AS INT) AS cell FROM edge), m AS (SELECT n.contour_id, e.pos, e.row_val, (e.pos - n.cx) * (e.pos - n.cx) + (e.row_val - n.cy) * (e.row_val - n.cy) AS d2 FROM n JOIN e ON e.image_id = n.img AND e.cell = n.cell), r AS (SELECT *, row_number() OVER (PARTITION BY contour_id ORDER BY d2, pos) AS rn FROM m WHERE d2 <= 225), u AS (SELECT contour_id, min(cx) AS cx, min(cy) AS cy FROM k GROUP BY contour_id), f AS (SELECT contour_id, min(pos) AS pos, min(row_val) AS row_val FROM r WHERE rn = 1 GROUP BY contour_id) SELECT u.contour_id, coalesce(CAST(f.pos AS DOUBLE), u.cx) AS x, coalesce(f.row_val, u.cy) AS y FROM u LEFT JOIN f ON u.contour_id = f.contour_id"),
}
