"""Neighbourhoods, colour and regions on arrays: strips don't show in results, and small cases by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import colour, strips


def lines_of(spark, images):
    rows = [(i, y, row.tolist()) for i, image in images.items() for y, row in enumerate(image)]
    return spark.createDataFrame(rows, "image_id int, y int, gray array<int>")


def colour_of(spark, images):
    rows = [(i, y, *[image[y, :, k].tolist() for k in range(3)]) for i, image in images.items() for y in range(len(image))]
    return spark.createDataFrame(rows, "image_id int, y int, r array<int>, g array<int>, b array<int>")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(4)
    return {0: rng.integers(0, 256, (37, 23)), 1: rng.integers(0, 256, (1, 5)), 2: rng.integers(100, 120, (12, 1)), 3: np.full((9, 9), 77)}


def collected(df):
    return sorted(map(str, df.collect()))


def planes(df, *names):
    out = {}
    for r in df.collect():
        out.setdefault(r["image_id"], {})[r["y"]] = [r[n] for n in names]
    return {i: [np.array([rows[y][k] for y in sorted(rows)]) for k in range(len(names))] for i, rows in out.items()}


@pytest.mark.parametrize("name,options", [("blur_scores", {}), ("sobel", {}), ("edge_thresholds", {}), ("unsharp", {"sigma": 1.5}), ("suppress_showthrough", {"least_sigma": 2.0}), ("local_stats", {"radius": 3}), ("median3", {}), ("sauvola", {"radius": 2}), ("ink_coverage", {"radius": 2})])
def test_strips_do_not_show(spark, images, name, options):
    lines = lines_of(spark, images)
    whole = collected(getattr(strips, name)(lines, **options))
    assert whole and collected(getattr(strips, name)(lines, height=1, **options)) == whole
    assert collected(getattr(strips, name)(lines.repartition(5).withColumn("halo", F.lit("x")), height=7, **options)) == whole
    assert getattr(strips, name)(lines.limit(0), **options).count() == 0


def test_against_plain_loops(spark, images):
    lines = lines_of(spark, images)
    back = lambda i, n: 0 if n == 1 else (n - 1) - abs((n - 1) - abs(i) % (2 * (n - 1)))
    score = {r["image_id"]: r["score"] for r in strips.blur_scores(lines).collect()}
    sharp = planes(strips.unsharp(lines, amount=0.7, sigma=1.2), "v")
    stats = planes(strips.local_stats(lines, radius=2), "mean", "sd")
    w = strips.bell(1.2)
    for i, v in images.items():
        h, n = v.shape
        at = lambda y, x: int(v[back(y, h), back(x, n)])
        z = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(n)]
        assert score[i] == pytest.approx(np.var(z), abs=1e-6)
        blurred = np.array([[round(sum(w[abs(a)] * w[abs(b)] * at(y + a, x + b) for a in range(1 - len(w), len(w)) for b in range(1 - len(w), len(w))), 9) for x in range(n)] for y in range(h)])
        want = np.clip(np.rint(np.round(v * 1.7 - 0.7 * np.rint(blurred), 6)), 0, 255)
        assert (sharp[i][0] == want).all()
        for y in range(h):
            for x in range(n):
                box = v[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3]
                assert stats[i][0][y, x] == pytest.approx(box.mean()) and stats[i][1][y, x] == pytest.approx(box.std(), abs=1e-6)


def test_a_large_page_is_many_tasks_of_rows(spark):
    lines = spark.range(4000).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("y"), F.transform(F.sequence(F.lit(1), F.lit(300)), lambda x: ((x * F.col("id")) % 251).cast("int")).alias("gray"))
    seen = strips.by_strips(lines, 7, lambda s: {"strip": [s.top], "rows": [len(s.planes[0])]}, "strip int, rows int").collect()
    assert sorted(r["strip"] for r in seen) == list(range(0, 4000, 512)) and sum(r["rows"] for r in seen) <= 4000 + 8 * 14


def test_showthrough_fades_and_ink_stays(spark):
    page = np.full((80, 80), 250)
    page[20:23, 10:70] = 240  # seen through the paper
    page[50:53, 10:70] = 5
    out = planes(strips.suppress_showthrough(lines_of(spark, {1: page})), "v")[1][0]
    assert out[21, 40] > 240 and out[51, 40] < 10 and out[5, 5] == 250


def test_regions_measure_their_own_samples(spark):
    rng = np.random.default_rng(1)
    page = np.full((100, 200), 128)
    page[:, :100] = rng.integers(0, 256, (100, 100))  # sharp left half
    frames = [(1, 0, 0.0, 0.0, 0.5, 1.0), (1, 1, 0.5, 0.0, 0.5, 1.0), (1, 2, 0.25, 0.25, 0.5, 0.5), (1, 3, 0.999, 0.0, 1.0, 1.0), (1, 4, -0.2, 0.4, 0.3, 0.1), (9, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(frames, "image_id int, frame_no int, x double, y double, w double, h double")
    got = {(r["image_id"], r["frame_no"]): r for r in strips.region_measure(lines_of(spark, {1: page}), df, height=16).collect()}
    assert len(got) == 6
    assert got[1, 0]["sharpness"] > 1000 and got[1, 1]["sharpness"] == 0 and got[1, 1]["signature"] == [128] * 576
    assert got[1, 3]["sharpness"] == 0 and got[1, 3]["signature"] is None and got[9, 0]["sharpness"] == 0
    assert got[1, 4]["signature"] is None  # ten samples high
    cells = np.array(got[1, 2]["signature"]).reshape(24, 24)
    part = page[25:75, 50:150]
    y, x = np.arange(50), np.arange(100)
    for cy, cx in ((0, 0), (3, 5), (23, 11)):
        oy = np.clip(np.minimum(y + 1, (cy + 1) * 50 / 24) - np.maximum(y, cy * 50 / 24), 0, None)
        ox = np.clip(np.minimum(x + 1, (cx + 1) * 100 / 24) - np.maximum(x, cx * 100 / 24), 0, None)
        assert cells[cy, cx] == round(oy @ part @ ox / (oy.sum() * ox.sum()))
    # Altering one region changes its signature only.
    other = page.copy()
    other[:, 100:] = 30
    new = {(r["image_id"], r["frame_no"]): r for r in strips.region_measure(lines_of(spark, {1: other}), df).collect()}
    assert new[1, 0]["signature"] == got[1, 0]["signature"] and new[1, 1]["signature"] != got[1, 1]["signature"]


def test_grey_and_hue_round_trip():
    rng = np.random.default_rng(2)
    r, g, b = rng.integers(0, 256, (3, 50, 50))
    back = colour.from_hsv(*colour.to_hsv(r, g, b))
    assert all(np.abs(x - y).max() <= 6 for x, y in zip(back, (r, g, b), strict=True))  # hues are two degrees wide
    assert [int(x[0, 0]) for x in colour.to_hsv(*(np.array([[v]]) for v in (0, 0, 255)))] == [120, 255, 255]
    assert [int(x[0, 0]) for x in colour.to_hsv(*(np.array([[v]]) for v in (90, 90, 90)))] == [0, 0, 90]


def test_tone_settings_move_one_way(spark):
    rng = np.random.default_rng(3)
    page = rng.integers(20, 230, (6, 8, 3))
    lines = colour_of(spark, {i: page for i in range(6)})
    settings = [(0, 0.0, 0.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0, 0.0), (2, 0.0, 0.5, 0.0, 0.0), (3, 0.0, 0.0, -1.0, None), (4, 0.0, 0.0, 0.0, -1.0)]
    out = planes(colour.tone_adjust(lines, spark.createDataFrame(settings, "image_id int, white_balance double, brightness double, contrast double, saturation double")), "r", "g", "b")
    own = [page[..., k] for k in range(3)]
    assert all((out[i][k] == own[k]).all() for i in (0, 5) for k in range(3))  # defaults, and no settings, change nothing
    assert (out[1][0] >= own[0]).all() and (out[1][2] <= own[2]).all() and (out[1][1] == own[1]).all()
    assert all((out[2][k] == np.clip(own[k] + 40, 0, 255)).all() for k in range(3))
    assert all((out[3][k] == 128).all() for k in range(3))
    assert (out[4][0] == out[4][1]).all() and (out[4][1] == out[4][2]).all()


def test_skin_at_the_border_and_inside(spark):
    plain = np.full((60, 60, 3), 240)
    skin = (200, 140, 120)
    edge, inside = plain.copy(), plain.copy()
    edge[10:15, :12] = skin
    inside[20:25, 20:32] = skin
    got = {r["image_id"]: r for r in colour.skin_coverage(colour_of(spark, {0: plain, 1: edge, 2: inside})).collect()}
    assert got[0]["coverage"] == 0 and not got[0]["plausible"]
    assert got[1]["coverage"] == pytest.approx(60 / 3600) and got[1]["plausible"] and got[1]["edge_coverage"] > 0
    assert got[2]["coverage"] == pytest.approx(60 / 3600) and not got[2]["plausible"]


def test_colour_finds_an_edge_unless_it_is_washed_out(spark):
    page = np.zeros((3, 60, 3), int)
    page[...] = (120, 80, 60)
    page[:2, 30:] = (60, 80, 140)  # bluer from column 30 on
    page[1, 20:40] = 250  # glare
    lines = colour_of(spark, {1: page})
    guesses = spark.createDataFrame([(1, y, 27.0) for y in range(3)] + [(1, 7, 3.0)], "image_id int, y int, guess double")
    got = {r["y"]: r for r in colour.glare_rows(lines, guesses).collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0]["glare"], got[0]["x"]) == (False, 30.0) and (got[1]["glare"], got[1]["x"]) == (True, 27.0)
    assert got[2]["x"] == 9.0  # nothing stands out: the first of the window
    right = {r["y"]: r for r in colour.glare_rows(lines, guesses, from_left=False).collect()}
    assert right[0]["x"] == 9.0  # against the blue side, the first column that differs
