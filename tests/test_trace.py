"""Walks along edges: plain rules, guides, and sides that are judged and tried again."""

import numpy as np
import pytest

from leafmill.operators import trace


def lines_of(spark, images):
    return spark.createDataFrame([(i, y, row.tolist()) for i, image in images.items() for y, row in enumerate(image)], "image_id int, y int, gray array<int>")


def plain_walk(strength, seed, start):
    rows = {seed: start}
    for step in (1, -1):
        at, x = start, seed + step
        while 0 <= x < strength.shape[1]:
            near = [y for y in range(strength.shape[0]) if abs(y - at) <= trace.REACH]
            at = rows[x] = min(near, key=lambda y, x=x: (-strength[y, x], y))
            x += step
    return [rows[x] for x in range(strength.shape[1])]


@pytest.mark.parametrize("seed", range(10))
def test_walk_takes_the_strongest_near_row(seed):
    rng = np.random.default_rng(seed)
    strength = rng.integers(0, 6, (30, 25))
    start = int(rng.integers(0, 30))
    assert trace.walk(strength, 11, start).tolist() == plain_walk(strength, 11, start)


def test_a_guide_draws_the_walk_back():
    strength = np.zeros((100, 60), int)
    strength[50 + np.arange(60) // 3, np.arange(60)] = 5  # the edge
    strength[50 - np.arange(60) // 2, np.arange(60)] = 9  # a stronger line that leaves it
    assert trace.walk(strength, 0, 50)[-1] == 50 - 59 // 2
    guided = trace.walk(strength, 0, 50, guide=(1 / 3, 50.0), near=4)
    assert abs(guided[-1] - (50 + 59 / 3)) <= 4 + trace.REACH


def page(h=240, w=320, left=40, right=280, top=30, bottom=210):
    image = np.full((h, w), 30)
    image[top:bottom, left:right] = 220
    return image


def test_top_and_bottom_of_a_page(spark):
    image = page()
    image[120:126, 60:260] = 110  # a line of text
    got = {}
    for r in trace.trace_edge(lines_of(spark, {1: image, 2: np.zeros((2, 9), int)})).collect():
        assert r["image_id"] == 1
        got.setdefault(r["side"], {})[r["pos"]] = r["row_val"]
    assert all(abs(got["top"][x] - 30) <= 1 and abs(got["bottom"][x] - 210) <= 1 for x in range(45, 275))


def test_transition_needs_a_sustained_rise():
    values = np.concatenate([np.full(100, 20.0), np.full(300, 200.0), np.full(80, 20.0)])
    values[10:13] = 255
    assert abs(trace.transition(values, True) - 100) <= 20 and abs(trace.transition(values, False) - 399) <= 20
    assert trace.transition(np.full(50, 7.0), True) == 0 and trace.transition(np.full(50, 7.0), False) == 49


def test_bridges():
    x, strength = np.array([5, 5, 90, 91, 8, 8, 70]), np.array([9, 9, 1, 1, 9, 9, 1])
    out, weak = trace.bridged(x, strength)
    assert trace.bridged(x.astype(float), strength, whole=False)[0].tolist() == [5, 5, 6, 7, 8, 8, 8]
    assert trace.bridged(np.array([1.0, 5.0, 7.0]), np.zeros(3), whole=False)[0].tolist() == [5.5, 4.0, 2.5]  # all weak: from the last to the first
    assert out.tolist() == [5, 5, 6, 7, 8, 8, 8] and weak.tolist() == [False, False, True, True, False, False, True]


def test_sides_are_found_judged_and_tried_again(spark):
    images = {1: page(), 2: page(), 3: page(left=90)}
    images[2][80:110, 30:60] = 220  # a finger over the left edge
    rng = np.random.default_rng(1)
    images[4] = rng.integers(0, 255, (240, 320))
    span = lambda i, low=42, high=278: (i, 35, 205, 35, 205, low, high, 160.0)
    spans = spark.createDataFrame([span(1), span(2), span(3), span(4), (5, 0, 9, 0, 9, 1, 5, 3.0)], "image_id int, top_left int, bottom_left int, top_right int, bottom_right int, book_low int, book_high int, gutter double")
    rows = trace.side_edges(lines_of(spark, images), spans).collect()
    at = lambda i, side: [r for r in rows if r["image_id"] == i and r["side"] == side]
    assert {r["image_id"] for r in rows} == {1, 2, 3, 4}
    for side, x in (("left", 40), ("right", 280)):
        assert all(abs(r["x"] - x) <= 1 for r in at(1, side)) and at(1, side)[0]["reliable"] and len(at(1, side)) == 170
    assert at(1, "left")[0]["margin"] == 20  # good at once
    # The finger's rows have no edge at the page's side; they are bridged.
    assert all(abs(r["x"] - 40) <= 12 for r in at(2, "left")) and any(r["bridged"] for r in at(2, "left"))
    # The left side lies beyond the first margin and is much weaker there: a wider one finds it.
    assert at(3, "left")[0]["margin"] > 20
    quality = {(r["image_id"], r["side"]): r for r in trace.edge_quality(lines_of(spark, images), spans).collect()}
    assert quality[1, "left"]["gutter_distance"] == pytest.approx(120, abs=1) and quality[1, "left"]["jitter"] < 1
    assert not quality[4, "left"]["reliable"] and quality[4, "left"]["margin"] >= 40
