"""Middle slopes against all pairs, and large pages."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import slopes


def plain(t, v, gap):
    s = sorted((v[j] - v[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[j] - t[i] >= gap and t[j] > t[i])
    return s[len(s) // 2] if s else None


@pytest.fixture
def never_direct(monkeypatch):
    monkeypatch.setattr(slopes, "DIRECT", 0)


@pytest.mark.parametrize("seed", range(30))
def test_middle_slope_of_small_pages(seed, never_direct):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    t = rng.integers(0, 30, n).astype(float) if seed % 2 else rng.normal(0, 100, n)
    v = rng.integers(0, 4, n).astype(float) if seed % 3 else 0.1 * t + rng.normal(0, 1, n)
    gap = float(rng.choice([0.0, 1.0, 5.5, 1000.0]))
    got, want = slopes.middle_slope(t, v, gap), plain(t, v, gap)
    assert got == want or got == pytest.approx(want, rel=1e-12)


def test_selection_equals_all_pairs(never_direct):
    rng = np.random.default_rng(1)
    for k in range(6):
        t = np.sort(rng.uniform(0, 5000, 900))
        v = 30 + 0.03 * t + (rng.normal(0, 8, 900) if k % 2 else np.round(rng.normal(0, 2, 900)))
        p = slopes.earlier(t, 100.0)
        j, i = np.repeat(np.arange(900), p), np.concatenate([np.arange(x) for x in p])
        want = np.sort((v[j] - v[i]) / (t[j] - t[i]))[len(j) // 2]
        got = slopes.middle_slope(t, v, 100.0)
        assert got == want if k % 2 else got == pytest.approx(want, rel=1e-12)  # rounded values: many pairs of nearly one slope


def test_counts_from():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 65):
        z, p = rng.integers(0, 9, n).astype(float), rng.integers(0, n + 1, n)
        assert slopes.counts_from(z, p).tolist() == [int((z[: p[j]] >= z[j]).sum()) for j in range(n)]


def test_lines_of_one_slope(never_direct):
    t = np.arange(1000.0)
    assert slopes.middle_slope(t, 7 - 0.25 * t) == pytest.approx(-0.25, rel=1e-12)
    assert slopes.middle_slope(t, np.zeros(1000)) == 0


def test_a_page_of_a_hundred_thousand_lines(spark):
    lines = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_num"), (F.col("id") * 24.0).alias("y"), (50 + F.col("id") * 0.9 + F.when(F.col("id") % 5 == 0, 40.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0)).alias("x"))
    began = time.time()
    r = slopes.margin_shear(lines).first()
    assert r["angle"] == pytest.approx(np.degrees(np.arctan(0.9 / 24)), abs=0.01) and r["applies"] and r["inliers"] == pytest.approx(0.8, abs=0.01)
    assert time.time() - began < 120


def test_pages_without_enough_lines(spark):
    rows = [(1, k, float(x), 24.0 * k) for k in range(7) for x in range(9)] + [(2, k, 5.0, 10.0) for k in range(9)] + [(3, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id int, line_num int, x double, y double")
    assert slopes.margin_shear(df).count() == 0 and slopes.rotation_field(df).count() == 0
    assert {r["doc_id"]: r["decision"] for r in slopes.deskew_decision(df).collect()} == {1: "none"}
    assert slopes.deskew_decision(df.limit(0)).count() == 0
