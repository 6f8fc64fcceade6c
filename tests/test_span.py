"""Spans of a mask against a plain walk over it."""

import random

import pytest

from leafmill.functions.geometry import both
from leafmill.operators.series import book_span


def plain(mask, gutter):
    n, runs, start = len(mask), [], None
    for i, m in enumerate([*mask, 0]):
        if m and start is None:
            start = i
        if not m and start is not None:
            if i - start >= max(20, int(0.05 * n)):
                runs.append([start, i - 1])
            start = None
    merged = []
    for a, b in runs:
        if merged and a - merged[-1][1] - 1 <= max(10, int(0.03 * n)):
            merged[-1][1] = b
        else:
            merged.append([a, b])
    if not merged:
        return None
    left, right = ([r for r in merged if r[0] <= gutter], [r for r in merged if r[1] >= gutter]) if gutter is not None else ([], [])
    return (left[-1][0], right[0][1]) if left and right else tuple(max(merged, key=lambda r: r[1] - r[0]))


@pytest.mark.parametrize("gutter", [None, 0, 300])
def test_book_span(spark, gutter):
    rng = random.Random(2)
    masks = {}
    for image in range(12):
        masks[image] = []
        while len(masks[image]) < 60 + 80 * image:
            masks[image] += [len(masks[image]) // 7 % 2 if image == 3 else rng.randint(0, 1)] * rng.randint(1, 70)
    rows = [(k, i, m) for k, v in masks.items() for i, m in enumerate(v)]
    plan = both(("mask",), "", f"WITH {book_span(gutter)} SELECT image_id, a, b FROM span")
    got = {r["image_id"]: (r["a"], r["b"]) for r in plan.apply(mask=spark.createDataFrame(rows, "image_id long, pos int, m int")).collect()}
    want = {k: plain(v, None if gutter is None else min(gutter, len(v) - 1)) for k, v in masks.items()}
    assert got == {k: v for k, v in want.items() if v}
