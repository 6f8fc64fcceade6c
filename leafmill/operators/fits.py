"""Fits to page edges and text lines: lines and curves near a segment, corners, the width of a bent page, the bend of its lines.

Each function gives the operator for its arguments; PLANS are those of the queries.
"""

from __future__ import annotations

from ..functions.geometry import both, duck
from ..plans.plan import Plan, run_together
from .series import C2, DET

#: Points within `band` of a segment, by their place t along it and distance d from it.
_NEAR = """q AS (SELECT image_id, side, ax, ay, (ex - ax) / len AS ux, (ey - ay) / len AS uy, len FROM (SELECT *, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS len FROM segment) z WHERE len >= 1),
    td AS (SELECT q.image_id, q.side, q.ux, q.uy, q.len, e.x - 0e0 AS x, e.y - 0e0 AS y, (e.x - q.ax) * q.ux + (e.y - q.ay) * q.uy AS t, (e.y - q.ay) * q.ux - (e.x - q.ax) * q.uy AS d FROM edge_point e JOIN q ON e.image_id = q.image_id),
    near AS (SELECT * FROM td WHERE abs(d) <= {band} AND t >= -greatest({band}, 0.03e0 * len) AND t <= len + greatest({band}, 0.03e0 * len)),
    mid AS (SELECT image_id, side, avg(x) AS x0, avg(y) AS y0, avg(t) AS t0 FROM near GROUP BY image_id, side HAVING count(*) >= {least}),
    s AS (SELECT n.image_id, n.side, m.x0, m.y0, n.ux, n.uy, n.len, count(*) AS n, min(n.t) AS first_t, max(n.t) AS last_t,
          sum((n.x - m.x0) * (n.x - m.x0)) AS sxx, sum((n.x - m.x0) * (n.y - m.y0)) AS sxy, sum((n.y - m.y0) * (n.y - m.y0)) AS syy,
          CAST(count(*) AS DOUBLE) AS m0, sum((n.t - m.t0) / n.len) AS m1, sum(power((n.t - m.t0) / n.len, 2)) AS m2, sum(power((n.t - m.t0) / n.len, 3)) AS m3, sum(power((n.t - m.t0) / n.len, 4)) AS m4,
          sum(n.d) AS u0, sum(n.d * (n.t - m.t0) / n.len) AS u1, sum(n.d * power((n.t - m.t0) / n.len, 2)) AS u2
          FROM near n JOIN mid m ON n.image_id = m.image_id AND n.side = m.side GROUP BY n.image_id, n.side, m.x0, m.y0, n.ux, n.uy, n.len),
    a AS (SELECT *, 0.5e0 * atan2(2 * sxy, sxx - syy) AS angle FROM s),
    fit AS (SELECT *, CASE WHEN cos(angle) * ux + sin(angle) * uy < 0 THEN -1e0 ELSE 1e0 END AS turn FROM a)"""


def band_fit(band: float = 4.0, least: int = 12) -> Plan:
    """For each segment, the line of least squared distance through the `least` or more edge points near it; and how far a quadratic through them, pinned to the
    segment's ends, leaves it (null unless they cover 15 to 85 % of the length).

    Segments shorter than 1 or with fewer points give no row. Once pinned, the curve is c * t * (t - length), so its largest offset is in the middle.
    """
    return both(("edge_point", "segment"), "Line and pinned quadratic through the edge points near each side of a page.",
        f"""WITH {_NEAR.format(band=repr(band), least=least)}
        SELECT image_id, side, n, round(turn * cos(angle), 6) AS vx, round(turn * sin(angle), 6) AS vy, round(x0, 6) AS x0, round(y0, 6) AS y0,
        CASE WHEN first_t <= 0.15e0 * len AND last_t >= 0.85e0 * len AND abs({DET}) > 0.000000001 THEN round(abs({C2}) / 4, 6) END AS max_offset FROM fit""")  # fmt: skip


def refine_quad(band: float = 4.0, least: int = 12) -> Plan:
    """Corners as crossings of the lines fitted to the two sides that meet there; a corner without both lines, or with parallel ones, stays.

    Sides are 0 to 3 and start at the corner of their number. All corners stay if the area would leave 0.5 to 1.5 of the original, or that is 0.
    """
    area = lambda x, y: "abs(" + " + ".join(f"({x}{i} * {y}{(i + 1) % 4} - {x}{(i + 1) % 4} * {y}{i})" for i in range(4)) + ") / 2"
    wide = ", ".join(f"max(CASE WHEN side = {i} THEN {v} END) AS {n}{i}" for i in range(4) for v, n in (("ax", "x"), ("ay", "y"), ("rx", "r"), ("ry", "s")))
    return both(("edge_point", "segment"), "Corners of a page moved to where the lines fitted to its sides cross, unless the area changes too much.",
        f"""WITH {_NEAR.format(band=repr(band), least=least)}, ln AS (SELECT image_id, side, cos(angle) AS vx, sin(angle) AS vy, x0, y0 FROM fit),
        c AS (SELECT g.image_id, g.side, g.ax, g.ay, i.vx AS ivx, i.vy AS ivy, i.x0 AS ix, i.y0 AS iy, i.vx * o.vy - i.vy * o.vx AS den, (o.x0 - i.x0) * o.vy - (o.y0 - i.y0) * o.vx AS num
              FROM segment g LEFT JOIN ln i ON i.image_id = g.image_id AND i.side = (g.side + 3) % 4 LEFT JOIN ln o ON o.image_id = g.image_id AND o.side = g.side),
        r AS (SELECT image_id, side, ax, ay, CASE WHEN abs(den) >= 0.000001 THEN ix + num / den * ivx ELSE ax END AS rx, CASE WHEN abs(den) >= 0.000001 THEN iy + num / den * ivy ELSE ay END AS ry FROM c),
        w AS (SELECT image_id, {wide} FROM r GROUP BY image_id), k AS (SELECT image_id, {area("x", "y")} AS was, {area("r", "s")} AS now FROM w)
        SELECT r.image_id, r.side AS corner, round(CASE WHEN was > 0 AND now BETWEEN 0.5 * was AND 1.5 * was THEN rx ELSE ax END, 5) AS x, round(CASE WHEN was > 0 AND now BETWEEN 0.5 * was AND 1.5 * was THEN ry ELSE ay END, 5) AS y,
        was > 0 AND now BETWEEN 0.5 * was AND 1.5 * was AS kept FROM r JOIN k ON r.image_id = k.image_id""")  # fmt: skip


def fit_width_curve(gain: float = 1.0) -> Plan:
    """Physical place of each column of a bent page, from the bow that fits its height.

    The bow is alpha * t * (1 - t) with alpha in -3 to 3. It is compared with the height after both are scaled to 0 to 1, so that only alpha's sign
    matters: the search ends at 3 if the upright bow is no worse than the other, else at 0, where the sign turns.
    """
    return both(("edge_pair",), "Physical place of each column: length along the bow that fits the page's height.",
        f"""WITH h AS (SELECT image_id, pos, bottom - top AS h, row_number() OVER (PARTITION BY image_id ORDER BY pos) - 1e0 AS i, count(*) OVER (PARTITION BY image_id) AS n, min(bottom - top) OVER (PARTITION BY image_id) AS lo, max(bottom - top) OVER (PARTITION BY image_id) AS hi FROM edge_pair),
        b AS (SELECT *, CASE WHEN n > 1 THEN i / (n - 1) * (1 - i / (n - 1)) ELSE 0e0 END AS bow, CASE WHEN hi > lo THEN (h - lo) / (hi - lo) ELSE 0e0 END AS part FROM h),
        k AS (SELECT image_id, max(bow) AS top_bow FROM b GROUP BY image_id), e AS (SELECT b.*, CASE WHEN top_bow > 0 THEN bow / top_bow ELSE 0e0 END AS up, CASE WHEN top_bow > 0 THEN 1 - bow / top_bow ELSE 0e0 END AS down FROM b JOIN k ON b.image_id = k.image_id),
        f AS (SELECT image_id, CASE WHEN round(sum((up - part) * (up - part)), 9) <= round(sum((down - part) * (down - part)), 9) THEN 3e0 ELSE 0e0 END AS alpha FROM e GROUP BY image_id),
        d AS (SELECT e.image_id, pos, alpha, alpha * (bow - lag(bow) OVER (PARTITION BY e.image_id ORDER BY pos)) * CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END AS dy FROM e JOIN f ON e.image_id = f.image_id)
        SELECT image_id, pos, alpha, round(sum(CASE WHEN dy IS NULL THEN 0e0 ELSE sqrt(1 + dy * dy) * {gain!r} END) OVER (PARTITION BY image_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS phys_x FROM d""")  # fmt: skip


def page_curve(width: float = 800.0, spine: float | None = 0.0) -> Plan:
    """Five points of a page's upper and lower curve: a cubic through all lines' samples, each less its line's middle y, through the first or last line's middle.

    Lines need 8 samples; three lines, and one of at least 35 % of `width`, are needed, else the page gives no row; nor does a page whose samples don't
    determine a cubic. With a `spine`, the mean of the 20 samples nearest to the edge away from it is one more sample there, weighing 8 times as much as they.
    """
    far = None if spine is None else (width if spine < width / 2 else 0.0)
    anchor = "" if far is None else f""" UNION ALL SELECT doc_id, {far!r} AS x, avg(v) AS v, 8e0 * count(*) AS w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(x - {far!r}), line_num, x, v) AS k FROM pool) z WHERE k <= 20 GROUP BY doc_id"""
    # Places are centred and in half widths, which keeps the sums of powers well scaled.
    half = width / 2
    powers = ", ".join(f"sum(w * power(t, {k})) AS m{k}" for k in range(1, 7))
    mixed = ", ".join(f"sum(w * power(t, {k}) * v) AS u{k}" for k in range(1, 4))
    at = lambda x: f"(k0 + k1 * (({x} - mid) / {half!r}) + k2 * power(({x} - mid) / {half!r}, 2) + k3 * power(({x} - mid) / {half!r}, 3))"
    sql = f"""WITH r AS (SELECT doc_id, line_num, x, y, row_number() OVER (PARTITION BY doc_id, line_num ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY doc_id, line_num) AS n FROM line_sample),
        l AS (SELECT doc_id, line_num, avg(x) AS mx, max(CASE WHEN k = floor(n / 2e0) THEN y END) AS my, max(x) - min(x) AS span FROM r WHERE n >= 8 GROUP BY doc_id, line_num),
        ok AS (SELECT doc_id FROM l GROUP BY doc_id HAVING count(*) >= 3 AND max(span) >= 0.35 * {width!r}),
        pool AS (SELECT r.doc_id, r.line_num, r.x, r.y - l.my AS v FROM r JOIN l ON r.doc_id = l.doc_id AND r.line_num = l.line_num JOIN ok ON ok.doc_id = r.doc_id),
        p AS (SELECT doc_id, x, v, 1e0 AS w FROM pool{anchor}), c AS (SELECT doc_id, avg(x) AS mid FROM p GROUP BY doc_id), t AS (SELECT p.doc_id, c.mid, (p.x - c.mid) / {half!r} AS t, p.v, p.w FROM p JOIN c ON p.doc_id = c.doc_id),
        g0 AS (SELECT doc_id, mid, sum(w) AS m0, {powers}, sum(w * v) AS u0, {mixed} FROM t GROUP BY doc_id, mid),
        g1 AS (SELECT *, m2 - m1 * m1 / m0 AS b11, m3 - m1 * m2 / m0 AS b12, m4 - m1 * m3 / m0 AS b13, m4 - m2 * m2 / m0 AS b22, m5 - m2 * m3 / m0 AS b23, m6 - m3 * m3 / m0 AS b33, u1 - m1 * u0 / m0 AS v1, u2 - m2 * u0 / m0 AS v2, u3 - m3 * u0 / m0 AS v3 FROM g0),
        g2 AS (SELECT *, b22 - b12 * b12 / b11 AS c22, b23 - b12 * b13 / b11 AS c23, b33 - b13 * b13 / b11 AS c33, v2 - b12 * v1 / b11 AS w2, v3 - b13 * v1 / b11 AS w3 FROM g1 WHERE b11 > 0.000000001),
        g3 AS (SELECT *, (w3 - c23 * w2 / c22) / (c33 - c23 * c23 / c22) AS k3 FROM g2 WHERE c22 > 0.000000001 AND c33 - c23 * c23 / c22 > 0.000000001),
        g4 AS (SELECT *, (w2 - c23 * k3) / c22 AS k2 FROM g3), g5 AS (SELECT *, (v1 - b12 * k2 - b13 * k3) / b11 AS k1 FROM g4), g6 AS (SELECT doc_id, mid, (u0 - m1 * k1 - m2 * k2 - m3 * k3) / m0 AS k0, k1, k2, k3 FROM g5),
        e AS (SELECT doc_id, mx, my, row_number() OVER (PARTITION BY doc_id ORDER BY line_num) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY line_num DESC) AS down FROM l),
        a AS (SELECT g6.*, 'top' AS edge, mx, my FROM g6 JOIN e ON g6.doc_id = e.doc_id WHERE up = 1 UNION ALL SELECT g6.*, 'bottom', mx, my FROM g6 JOIN e ON g6.doc_id = e.doc_id WHERE down = 1),
        five AS (SELECT a.*, i, i / 4e0 * ({width!r} - 1) AS x FROM a, (VALUES (0), (1), (2), (3), (4)) pts(i))
        SELECT doc_id, edge, i AS point, x, round(my + {at("x")} - {at("mx")}, 5) AS y FROM five"""
    # In Spark a page moves once and its sums are taken in one pass: what lines and pages have in common comes from windows, and the sample at the far edge is added to the sums.
    near, far_t = ("0", "0e0") if far is None else (f"row_number() OVER (PARTITION BY doc_id ORDER BY abs(x - {far!r}), line_num, x, v)", f"({far!r} - mid) / {half!r}")
    plus = lambda k: "" if far is None else f" + 8e0 * near_n * power({far_t}, {k})"
    plus_v = lambda k: "" if far is None else f" + coalesce(8e0 * near_n * power({far_t}, {k}) * near_v, 0e0)"
    sums = ", ".join([f"p{k}{plus(k)} AS m{k}" for k in range(7)] + [f"q{k}{plus_v(k)} AS u{k}" for k in range(4)])
    mid = "sum(x) OVER p / count(x) OVER p" if far is None else f"(sum(x) OVER p + {far!r}) / (count(x) OVER p + 1)"
    once = f"""WITH r AS (SELECT doc_id, line_num, x, y, row_number() OVER (PARTITION BY doc_id, line_num ORDER BY y, x) - 1 AS k, count(*) OVER (PARTITION BY doc_id, line_num) AS n FROM line_sample),
        l AS (SELECT *, avg(x) OVER g AS mx, max(CASE WHEN k = floor(n / 2e0) THEN y END) OVER g AS my, max(x) OVER g - min(x) OVER g AS span FROM r WHERE n >= 8 WINDOW g AS (PARTITION BY doc_id, line_num)),
        b AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER p AS lines, max(span) OVER p AS widest, min(line_num) OVER p AS first_line, max(line_num) OVER p AS last_line FROM l WINDOW p AS (PARTITION BY doc_id)),
        pool AS (SELECT doc_id, line_num, x, y - my AS v, mx, my, first_line, last_line FROM b WHERE lines >= 3 AND widest >= 0.35 * {width!r} AND doc_id IS NOT NULL AND line_num IS NOT NULL),
        t AS (SELECT *, {mid} AS mid, {near} AS near FROM pool WINDOW p AS (PARTITION BY doc_id)), z AS (SELECT *, (x - mid) / {half!r} AS t FROM t),
        g AS (SELECT doc_id, max(mid) AS mid, CAST(count(*) AS DOUBLE) AS p0, {", ".join(f"sum(power(t, {k})) AS p{k}" for k in range(1, 7))}, sum(v) AS q0, {", ".join(f"sum(power(t, {k}) * v) AS q{k}" for k in range(1, 4))}, CAST(sum(CASE WHEN near <= 20 THEN 1 ELSE 0 END) AS DOUBLE) AS near_n, avg(CASE WHEN near <= 20 THEN v END) AS near_v,
             max(CASE WHEN line_num = first_line THEN mx END) AS first_x, max(CASE WHEN line_num = first_line THEN my END) AS first_y, max(CASE WHEN line_num = last_line THEN mx END) AS last_x, max(CASE WHEN line_num = last_line THEN my END) AS last_y FROM z GROUP BY doc_id),
        g0 AS (SELECT doc_id, mid, first_x, first_y, last_x, last_y, {sums} FROM g),
        g1 AS{sql.split("g1 AS")[1].split("g6 AS")[0]}g6 AS (SELECT *, (u0 - m1 * k1 - m2 * k2 - m3 * k3) / m0 AS k0 FROM g5),
        a AS (SELECT *, CASE WHEN edge = 'top' THEN first_x ELSE last_x END AS mx, CASE WHEN edge = 'top' THEN first_y ELSE last_y END AS my FROM g6, (VALUES ('top'), ('bottom')) edges(edge)),
        five AS{sql.split("five AS")[1]}"""
    return Plan(("line_sample",), "Five points of a page's upper and lower curve, from the shape that its text lines share.", run=lambda line_sample: run_together(once, "doc_id", line_sample=line_sample), duckdb=duck(sql))


PLANS = {"e22_band_fit": band_fit(), "e23_fit_width_curve": fit_width_curve(), "e24_refine_quad": refine_quad(), "e25_page_curve": page_curve()}
