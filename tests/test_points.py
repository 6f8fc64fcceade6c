"""Robust lines, nearest neighbours, meshes and calibration sets against plain computations and literal cases."""

import numpy as np
import pytest

from leafmill.operators import points
from leafmill.operators.points import PLANS


@pytest.mark.parametrize("seed", range(25))
def test_nearest_distances(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 120))
    x, y = (rng.integers(0, 12, n).astype(float), rng.normal(0, 50, n)) if seed % 2 else (rng.normal(0, 1e3, n), rng.normal(0, 1, n) * (seed % 5))
    if seed % 4 == 3:
        x[: n // 2], y[: n // 2] = x[0], y[0]  # many at one place
    d = np.hypot(x[:, None] - x, y[:, None] - y)
    d[d == 0] = np.inf
    assert np.allclose(points.nearest_distances(x, y), d.min(1), rtol=1e-12)
    image = rng.integers(0, 9, n)
    d[image[:, None] != image] = np.inf
    assert np.allclose(points.nearest_distances(x, y, image), d.min(1), rtol=1e-12)


def test_many_markers_in_linear_time():
    rng = np.random.default_rng(1)
    d = points.nearest_distances(*rng.uniform(0, 1e4, (2, 300_000)))
    assert 0 < np.median(d) < 20


def test_spacing_of_a_board(spark):
    rows = [(1, 40.0 * i, 40.0 * j) for i in range(6) for j in range(5)] + [(1, 0.0, 0.0), (2, 3.0, 3.0), (2, 3.0, 3.0)]
    got = {r["image_id"]: r["spacing"] for r in points.marker_spacing(spark.createDataFrame(rows, "image_id int, x double, y double")).collect()}
    assert got == {1: 40.0, 2: 0.0}


def test_planted_lines_are_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for image in range(4):
        x = rng.uniform(0, 1000, 400)
        y = np.where(rng.random(400) < 0.6, 20 + 0.1 * image * x + rng.uniform(-1, 1, 400), rng.uniform(0, 900, 400))
        rows += [(image, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    rows += [(7, 1.0, 1.0), (8, 2.0, 0.0), (8, 2.0, 9.0), (9, 0.0, 1.0), (9, 10.0, 2.0)]
    got = {r["image_id"]: r for r in points.robust_lines(spark.createDataFrame(rows, "image_id int, x double, y double"), trials=1000, tolerance=3).collect()}
    for image in range(4):
        assert got[image]["slope"] == pytest.approx(0.1 * image, abs=0.01) and got[image]["intercept"] == pytest.approx(20, abs=3) and got[image]["inliers"] >= 220
    assert got[7]["slope"] is None and got[8]["slope"] is None and got[9]["slope"] == pytest.approx(0.1)


def test_trials_draw_two_places():
    for n in (2, 3, 64, 5000):
        pairs = points.trial_pairs(n, 1000)
        assert (pairs[:, 0] != pairs[:, 1]).all() and pairs.min() >= 0 and pairs.max() < n and len(np.unique(pairs)) >= min(n, 500)


def mesh_by_numpy(samples, reach=20):
    """(usable lines, largest value of the cubic) of one page: {line: [(x, y)]}."""
    pooled, n = [], 0
    for line in samples.values():
        column = {}
        for x, y in line:
            column.setdefault(int(np.floor(x)), []).append(y)
        x = np.array(sorted(column), float)
        y = np.array([np.mean(column[int(v)]) for v in x])
        y = np.array([y[np.abs(x - v) <= reach].mean() for v in x])
        if len(x) >= 8:
            n += 1
            pooled += list(zip(x, y - np.sort(y)[len(y) // 2], strict=True))
    if not pooled:
        return n, None
    px, py = np.array(pooled).T
    fit = np.polynomial.Polynomial.fit(px, py, 3)
    return n, float(np.abs(fit(np.arange(max(x for line in samples.values() for x, _ in line) // 1 + 1))).max())


def test_mesh_gate(spark):
    rng = np.random.default_rng(3)
    pages = {}
    for page, (lines, bend) in enumerate([(8, 0.0), (8, 20.0), (8, 90.0), (5, 1.0), (7, -30.0)]):
        pages[page] = {k: [(float(x) + 0.25, 24.0 * k + bend * np.sin(x / 250) + rng.normal(0, 0.5)) for x in range(0, 800, 11) if rng.random() > 0.2] for k in range(lines)}
    pages[5] = {0: [(1.0, 1.0)], 1: [(5.0, 9.0)]}
    rows = [(p, k, x, float(y)) for p, lines in pages.items() for k, line in lines.items() for x, y in line]
    got = {r["doc_id"]: r for r in PLANS["e27_mesh_gate"].apply(line_sample=spark.createDataFrame(rows, "doc_id int, line_num int, x double, y double")).collect()}
    for p, lines in pages.items():
        n, most = mesh_by_numpy(lines)
        assert got[p]["n"] == n
        assert got[p]["most"] == (pytest.approx(most, abs=2e-4) if n >= 6 else None)
        height = np.ptp([np.mean([y for _, y in line]) for line in lines.values()])
        assert got[p]["mesh"] == (n >= 6 and most <= 0.06 * height)
    assert [got[p]["mesh"] for p in range(6)] == [True, False, False, False, False, False]


def test_calibration_sets(spark):
    images, markers = [], []

    def photo(set_id, image_id, ids, size=(4000, 3000), error=0.5):
        images.append((set_id, image_id, *size, error))
        markers.extend((image_id, m) for m in ids)

    for k in range(3):
        photo(1, k, range(8), error=0.9)
        photo(2, 10 + k, range(8), error=1.2)
        photo(3, 20 + k, range(5))
        photo(4, 30 + k, range(8) if k else range(100, 107))
        photo(5, 40 + k, range(8), size=(4000, 3000) if k else (3000, 3000))
        photo(7, 60 + k, [], size=(None, None))
    photo(4, 33, range(9))
    photo(4, 34, range(6), size=(None, None))
    photo(6, 50, range(9))
    photo(6, 51, range(9))
    tables = {"calibration_image": spark.createDataFrame(images, "set_id int, image_id int, width int, height int, error_px double"), "marker": spark.createDataFrame([*markers, markers[0]], "image_id int, marker_id int")}
    got = {r["set_id"]: (r["grade"], r["reference_id"], r["usable"]) for r in PLANS["e34_calibration_audit"].apply(**tables).collect()}
    assert got == {1: ("good", 0, 3), 2: ("poor", 10, 3), 3: ("no reference", 20, 0), 4: ("good", 33, 3), 5: ("too few usable", 40, 1), 6: ("too few images", 50, 2), 7: ("none decoded", None, 0)}
