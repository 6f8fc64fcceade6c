"""The gutter against a blurred image."""

import numpy as np
import pytest

from leafmill.plans import catalog


def test_gutter(spark):
    rng = np.random.default_rng(4)
    images = {k: rng.integers(120, 250, (30 + 5 * k, 60 + 7 * k)).astype(float) for k in range(4)}
    images[1][:, 30:34] -= 90
    images[2][:, :23] -= 100  # a slope at the band's start is no gutter
    rows = [(k, y, x, float(v)) for k, im in images.items() for (y, x), v in np.ndenumerate(im)]
    got = {r["image_id"]: r for r in catalog.plans()["d09_gutter"].apply(pixel=spark.createDataFrame(rows, "image_id long, y int, x int, v double")).collect()}
    bell = np.exp(-np.arange(-4, 5) ** 2 / (2 * 1.7**2))
    bell /= bell.sum()
    for k, im in images.items():
        wide = np.pad(im, 4, mode="reflect")
        blurred = np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, wide, bell, "valid"), bell, "valid")
        m, w = blurred.mean(0), im.shape[1]
        lo, hi = int(w * 0.3), int(w * 0.7)
        at = lo + int(m[lo:hi].argmin())
        mean, margin = m[lo:hi].mean(), int(w * 0.05)
        sure = (mean - m[at]) / mean if at - lo >= margin and hi - at >= margin else 0
        assert (got[k]["gutter"], got[k]["confidence"], got[k]["fall"]) == (at, pytest.approx(sure, abs=1e-6), pytest.approx(mean - m[at], abs=1e-6))
    assert got[1]["confidence"] > 0.08 and got[2]["confidence"] == 0
