"""Colour measurements on scanlines of three planes: image_id, y and r, g, b (array<int>, 0..255). Rows are worked on where they are; only sums of rows move."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .strips import lists

PLANES = ("r", "g", "b")


def by_rows(lines: DataFrame, kernel: Callable[[list[np.ndarray], dict[str, np.ndarray]], dict[str, pa.Array | np.ndarray]], out: str, values: Sequence[str] = (), keys: Sequence[str] = ("image_id", "y")) -> DataFrame:
    """Runs `kernel` on groups of rows of one width (planes as matrices, `values` as columns): its columns (`out`) beside the rows' `keys`. Rows without samples give none."""
    names = [*keys, *[c.strip().split(" ")[0] for c in out.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            widths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(t.column("r")), 0))
            for width in np.unique(widths[widths > 0]):
                part = t.filter(pa.array(widths == width))
                planes = [np.asarray(part.column(p).combine_chunks().flatten()).reshape(-1, width).astype(np.int64) for p in PLANES]
                found = kernel(planes, {v: part.column(v).to_numpy() for v in values})
                yield from pa.table([*[part.column(k) for k in keys], *found.values()], names=names).to_batches()

    kinds = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys)
    return lines.select(*keys, *values, *PLANES).mapInArrow(run, f"{kinds}, {out}")


def grey_of(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.rint(np.round(0.299 * r + 0.587 * g + 0.114 * b, 9)).astype(np.int64)


def _byte(v: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.round(v, 9)), 0, 255).astype(np.int64)


def to_gray(lines: DataFrame) -> DataFrame:
    """image_id, y, gray (array<int>): 0.299 red + 0.587 green + 0.114 blue, rounded."""
    return by_rows(lines, lambda p, _: {"gray": lists(grey_of(*p), pa.int32())}, "gray array<int>")


def chroma(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue difference from the grey, in bytes around 128."""
    y = grey_of(r, g, b)
    return _byte((r - y) * 0.713 + 128), _byte((b - y) * 0.564 + 128)


def skin_coverage(lines: DataFrame, cr: tuple[int, int] = (135, 180), cb: tuple[int, int] = (85, 135), margin: int = 4, least: float = 0.0015, most: float = 0.05) -> DataFrame:
    """image_id, coverage (share of samples of skin colour), edge_coverage (that share within `margin` of the border) and plausible: whether the share may be a finger's, `least` to `most`, and some of it is at the border."""

    def kernel(p: list[np.ndarray], _: dict) -> dict[str, np.ndarray]:
        red, blue = chroma(*p)
        skin = (red >= cr[0]) & (red <= cr[1]) & (blue >= cb[0]) & (blue <= cb[1])
        side = np.zeros(skin.shape[1], bool)
        side[:margin] = side[max(0, len(side) - margin) :] = True
        n = np.full(len(skin), skin.shape[1], np.int64)
        return {"n": n, "skin": skin.sum(1), "side_n": np.full(len(skin), side.sum(), np.int64), "side_skin": skin[:, side].sum(1)}

    rows = by_rows(lines, kernel, "n long, skin long, side_n long, side_skin long")
    near = (F.col("y") < margin) | (F.col("y") >= F.max("y").over(Window.partitionBy("image_id")) + 1 - margin)
    rows = rows.withColumn("near", near)
    at = lambda whole, side: F.sum(F.when(F.col("near"), F.col(whole)).otherwise(F.col(side)))
    out = rows.groupBy("image_id").agg((F.sum("skin") / F.sum("n")).alias("coverage"), (at("skin", "side_skin") / at("n", "side_n")).alias("edge_coverage"))
    return out.withColumn("plausible", F.col("coverage").between(least, most) & (F.col("edge_coverage") > 0))


def to_hsv(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue (0..179, two degrees each), saturation and value (0..255)."""
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = v - low
    some = np.maximum(d, 1)
    h = np.where(v == r, (g - b) / some, np.where(v == g, 2 + (b - r) / some, 4 + (r - g) / some)) * 30
    h = np.rint(np.round(np.where(d == 0, 0, np.where(h < 0, h + 180, h)), 9)).astype(np.int64) % 180
    return h, _byte(d * 255 / np.maximum(v, 1)), v


def from_hsv(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sector, part, s = h // 30, h % 30 / 30, s / 255
    low, fall, rise = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    pick = lambda *of: _byte(np.choose(sector, of))
    return pick(v, fall, low, low, rise, v), pick(rise, v, v, fall, low, low), pick(low, low, rise, v, v, fall)


def toned(planes: Sequence[np.ndarray], balance: np.ndarray, brightness: np.ndarray, contrast: np.ndarray, saturation: np.ndarray) -> list[np.ndarray]:
    """White balance, then contrast around 128 with brightness, then saturation, each by its row's setting (a column, -1..1), in bytes after each step; a setting of 0 leaves the samples as they are."""
    r, g, b = planes
    r, b = _byte(r * (1 + 0.3 * balance)), _byte(b * (1 - 0.3 * balance))
    r, g, b = (_byte(p * (1 + contrast) - 128 * contrast + 80 * brightness) for p in (r, g, b))
    h, s, v = to_hsv(r, g, b)
    changed = from_hsv(h, _byte(s * (1 + saturation)), v)
    return [np.where(saturation != 0, x, p) for x, p in zip(changed, (r, g, b), strict=True)]


SETTINGS = ("white_balance", "brightness", "contrast", "saturation")


def tone_adjust(lines: DataFrame, settings: DataFrame) -> DataFrame:
    """image_id, y, r, g, b after each image's tone settings (image_id and SETTINGS, held to -1..1; null counts as 0). Images without settings stay as they are; an image has one row of them."""
    own = settings.select(F.col("image_id").alias("s_id"), *SETTINGS)
    joined = lines.join(own, F.col("image_id") == F.col("s_id"), "left")
    joined = joined.withColumns({c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0)))) for c in SETTINGS})

    def kernel(p: list[np.ndarray], v: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        out = toned(p, *(v[c].astype(float)[:, None] for c in SETTINGS))
        return {c: lists(x, pa.int32()) for c, x in zip(PLANES, out, strict=True)}

    return by_rows(joined, kernel, "r array<int>, g array<int>, b array<int>", values=SETTINGS)


def glare_rows(lines: DataFrame, guesses: DataFrame, step: int = 6, from_left: bool = True, washed_out: int = 25) -> DataFrame:
    """Where an edge can be recovered by colour in rows whose brightness doesn't show it: image_id, y, saturation (at the guess), glare, x.

    `guesses`: image_id, y, guess (the column on a straight bridge). A row whose saturation there is `washed_out` or less is glare: x stays at the guess. Else x is the column within 3 * `step` of the guess whose blue
    difference lies furthest from the median of the columns outside (left of the window for an edge found from the left, right of it otherwise); the first on a tie. Without columns outside, x stays.
    """
    asked = guesses.select(F.col("image_id").alias("g_id"), F.col("y").alias("g_y"), F.col("guess").cast("double"))
    rows = lines.join(asked, (F.col("image_id") == F.col("g_id")) & (F.col("y") == F.col("g_y")))

    def kernel(p: list[np.ndarray], v: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        width, guess = p[0].shape[1], np.rint(v["guess"]).astype(np.int64)
        _, s, _ = to_hsv(*p)
        _, cb = chroma(*p)
        at = np.clip(guess, 0, width - 1)
        saturation = s[np.arange(len(s)), at]
        x = v["guess"].copy()
        for i in np.flatnonzero(saturation > washed_out):
            low, high = max(0, guess[i] - 3 * step), min(width, guess[i] + 3 * step + 1)
            outside = cb[i, :low] if from_left else cb[i, high:]
            if len(outside) and high > low:
                x[i] = low + np.argmax(np.abs(cb[i, low:high] - np.median(outside)))
        return {"saturation": saturation, "glare": saturation <= washed_out, "x": x}

    return by_rows(rows, kernel, "saturation long, glare boolean, x double", values=("guess",))
