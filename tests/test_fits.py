"""Fits against numpy on small tables."""

import numpy as np
import pytest

from leafmill.operators import fits


@pytest.fixture(scope="module")
def page(spark):
    """A page outline whose sides bow inwards, and its straight guess, in image 1; too few points in image 2."""
    corners = np.array([[10.0, 12.0], [210.0, 8.0], [214.0, 158.0], [6.0, 152.0]])
    guess = corners + [[1, -1], [-1, 1], [1, 1], [-1, 1]]
    points = []
    for i in range(4):
        a, b = corners[i], corners[(i + 1) % 4]
        u = (b - a) / np.linalg.norm(b - a)
        for t in np.linspace(0.02, 0.98, 80):
            points.append(a + t * (b - a) + np.array([-u[1], u[0]]) * 2 * t * (1 - t))
    p = [(1, float(x), float(y)) for x, y in points] + [(2, 1.0, 1.0)]
    sides = [(image, i, *map(float, guess[i]), *map(float, guess[(i + 1) % 4])) for image in (1, 2) for i in range(4)] + [(3, 0, 5.0, 5.0, 5.0, 5.0)]
    return {"edge_point": spark.createDataFrame(p, "image_id long, x double, y double"), "segment": spark.createDataFrame(sides, "image_id long, side int, ax double, ay double, ex double, ey double")}, np.array(points), guess


def near(points, a, b, band=4.0):
    length = np.linalg.norm(b - a)
    u = (b - a) / length
    t = (points - a) @ u
    d = (points - a) @ np.array([-u[1], u[0]])
    keep = (np.abs(d) <= band) & (t >= -max(band, 0.03 * length)) & (t <= length + max(band, 0.03 * length))
    return points[keep], t[keep], d[keep], u, length


def test_band_fit(page):
    tables, points, guess = page
    rows = {(r["image_id"], r["side"]): r for r in fits.band_fit().apply(**tables).collect()}
    assert set(rows) == {(1, i) for i in range(4)}
    for i in range(4):
        own, t, d, u, length = near(points, guess[i], guess[(i + 1) % 4])
        _, _, v = np.linalg.svd(own - own.mean(0))
        v = v[0] * np.sign(v[0] @ u)
        c = np.polyfit(t, d, 2)
        s = np.linspace(0, length, 51)
        offset = np.abs(c[0] * s * s - c[0] * length * s).max()
        r = rows[1, i]
        assert (r["n"], r["vx"], r["vy"], r["max_offset"]) == (len(own), pytest.approx(v[0], abs=2e-6), pytest.approx(v[1], abs=2e-6), pytest.approx(offset, abs=2e-6))


def test_refine_quad(page):
    tables, points, guess = page
    rows = {(r["image_id"], r["corner"]): r for r in fits.refine_quad().apply(**tables).collect()}
    lines = []
    for i in range(4):
        own = near(points, guess[i], guess[(i + 1) % 4])[0]
        lines.append((own.mean(0), np.linalg.svd(own - own.mean(0))[2][0]))
    for i in range(4):
        (p, v), (q, w) = lines[i - 1], lines[i]
        corner = p + np.linalg.solve(np.array([v, -w]).T, q - p)[0] * v
        assert rows[1, i]["kept"] and [rows[1, i]["x"], rows[1, i]["y"]] == pytest.approx(corner.tolist(), abs=2e-5)
        assert [rows[2, i]["x"], rows[2, i]["y"]] == guess[i].tolist()  # no lines: corners stay
    assert not rows[3, 0]["kept"]


def test_fit_width_curve(spark):
    t = np.arange(21) / 20
    rows = [(1, i, 10.0, 40 + 30 * float(x * (1 - x))) for i, x in enumerate(t)] + [(2, i, 10.0, 40 - 30 * float(x * (1 - x))) for i, x in enumerate(t)] + [(3, 0, 1.0, 5.0)]
    out = {(r["image_id"], r["pos"]): r for r in fits.fit_width_curve().apply(edge_pair=spark.createDataFrame(rows, "image_id long, pos int, top double, bottom double")).collect()}
    dy = np.diff(3 * t * (1 - t)) * 7.5
    assert out[1, 0]["phys_x"] == 0 and out[1, 20]["phys_x"] == pytest.approx(np.sqrt(1 + dy * dy).sum(), abs=1e-5)
    assert out[2, 20]["alpha"] == 0 and out[2, 20]["phys_x"] == 20 and out[3, 0]["phys_x"] == 0


@pytest.mark.parametrize("spine", [None, 0.0, 700.0])
def test_page_curve(spark, spine):
    rng = np.random.default_rng(3)
    rows = [(1, k, float(x), float(100 * k + 20 * (x / 800) ** 3 - 10 * x / 800 + rng.normal())) for k in range(6) for x in np.linspace(20 + k, 700 - 9 * k, 30)]
    rows += [(2, 0, float(x), 5.0) for x in range(20)] + [(3, k, 5.0, float(i)) for k in range(3) for i in range(9)]
    got = {(r["doc_id"], r["edge"], r["point"]): r["y"] for r in fits.page_curve(800.0, spine).apply(line_sample=spark.createDataFrame(rows, "doc_id long, line_num int, x double, y double")).collect()}
    own = np.array([r[1:] for r in rows if r[0] == 1])
    mids = {k: (own[own[:, 0] == k, 1].mean(), np.sort(own[own[:, 0] == k, 2])[15]) for k in range(6)}
    x, v, w = own[:, 1], own[:, 2] - np.array([mids[int(k)][1] for k in own[:, 0]]), np.ones(len(own))
    if spine is not None:
        far = 800.0 if spine < 400 else 0.0
        near20 = np.argsort(np.abs(x - far), kind="stable")[:20]
        x, v, w = np.append(x, far), np.append(v, v[near20].mean()), np.append(w, 160.0)
    p = np.poly1d(np.polyfit(x, v, 3, w=np.sqrt(w)))
    for edge, k in (("top", 0), ("bottom", 5)):
        for i in range(5):
            assert got[1, edge, i] == pytest.approx(mids[k][1] + p(i / 4 * 799) - p(mids[k][0]), abs=1e-3)
    assert len(got) == 10  # one line, or lines of no width, give nothing


def test_empty_tables(spark):
    empty = {"edge_point": "image_id long, x double, y double", "segment": "image_id long, side int, ax double, ay double, ex double, ey double", "edge_pair": "image_id long, pos int, top double, bottom double", "line_sample": "doc_id long, line_num int, x double, y double"}
    for plan in fits.PLANS.values():
        assert plan.apply(**{t: spark.createDataFrame([], empty[t]) for t in plan.inputs}).count() == 0
