"""Neighbourhoods in images of any size: rows go once to strips of an image, with the rows around them, and arrays do the rest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


@dataclass
class Strip:
    """Neighbouring rows of one image: `core` of them from row `top` on, with up to `halo` rows above and below, fewer only at the image's border."""

    planes: list[np.ndarray]
    first: int
    top: int
    core: int
    halo: int
    values: dict[str, Any]

    def padded(self, plane: np.ndarray, halo: int, mode: str) -> np.ndarray:
        """The core rows of `plane` with `halo` (at most the strip's) rows and columns on every side; beyond the image's border they are mirrored without the border sample ("reflect") or repeat it ("edge")."""
        low, high = self.top - halo - self.first, self.top + self.core + halo - self.first
        inside = plane[max(0, low) : high]
        return np.pad(inside, ((max(0, -low), max(0, high - len(plane))), (halo, halo)), mode)

    def of_core(self, plane: np.ndarray) -> np.ndarray:
        at = self.top - self.first
        return plane[at : at + self.core]


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length."""
    rows = column.combine_chunks()
    return np.asarray(rows.flatten()).reshape(len(rows), -1)


def by_strips(lines: DataFrame, halo: int | Column, kernel: Callable[[Strip], dict[str, Any] | None], out: str, planes: Sequence[str] = ("gray",), keys: Sequence[str] = ("image_id",), values: Sequence[str] = (), height: int = 512) -> DataFrame:
    """Runs `kernel` on every strip of every image: its columns (`out`), with the image's `keys`.

    `lines`: keys, y (from 0, gapless), `planes` (array<int>, of one length in an image) and `values` (the same in all rows of an image; the kernel gets them by name). A strip has `height` rows, or four
    times the halo if that is more, so few rows go to two strips. What moves is rows of images, once; an image of any height is as many tasks as strips.
    """
    strip = F.greatest(F.lit(height), F.lit(4) * halo)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - halo) / F.col("_height"))), F.floor((F.col("y") + halo) / F.col("_height")))
    dealt = lines.select(*keys, *values, "y", *planes, F.lit(halo).alias("_halo") if isinstance(halo, int) else halo.alias("_halo"), strip.alias("_height")).withColumn("_strip", F.explode(near))
    names = [c.strip().split(" ")[0] for c in out.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("y")
        y, h, s, halo_ = np.asarray(t.column("y")), t.column("_height")[0].as_py(), t.column("_strip")[0].as_py(), t.column("_halo")[0].as_py()
        core = int(((y >= s * h) & (y < (s + 1) * h)).sum())
        found = kernel(Strip([matrix(t.column(p)) for p in planes], int(y[0]), s * h, core, halo_, {v: t.column(v)[0].as_py() for v in values})) if core else None
        if found is None:
            found = {n: [] for n in names}
        n = len(next(iter(found.values())))
        columns = {k: pa.array([t.column(k)[0].as_py()] * n, t.column(k).type) for k in keys} | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in found.items()}
        return pa.table(columns).cast(schema)

    by = ", ".join(f"{k} {lines.schema[k].dataType.simpleString()}" for k in keys)
    schema = to_arrow_schema(_parse_datatype_string(f"{by}, {out}"))
    return dealt.groupBy(*keys, "_strip").applyInArrow(run, f"{by}, {out}")


def image_sizes(lines: DataFrame, plane: str = "gray", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """keys, width and height of each image."""
    return lines.groupBy(*keys).agg(F.max(F.size(plane)).alias("width"), (F.max("y") + 1).alias("height"))


def pixels(rows: DataFrame, *planes: str, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """A row for each sample: keys, y, x and the planes' values."""
    zipped = F.arrays_zip(*planes)
    return rows.select(*keys, "y", F.posexplode(zipped).alias("x", "p")).select(*keys, "y", "x", *[F.col("p")[c].alias(c) for c in planes])


def bell(sigma: float) -> np.ndarray:
    """Weights of a Gaussian from its middle outwards, over round(6 sigma + 1) samples, made odd."""
    reach = (int(np.rint(6 * sigma + 1)) | 1) // 2
    w = np.exp(-np.arange(reach + 1) ** 2 / (2 * sigma * sigma))
    return w / (w[0] + 2 * w[1:].sum())


def reach_of(sigma: Column | float) -> Column:
    """Rows that a Gaussian needs on each side."""
    n = F.bround(F.lit(6.0) * sigma + 1).cast("int")
    return F.floor((n + (1 - n % 2)) / 2).cast("int")


def gaussian(strip: Strip, plane: np.ndarray, sigma: float) -> np.ndarray:
    """The core rows smoothed by a Gaussian, first across and then down, to whole numbers; the border is mirrored."""
    w = bell(sigma)
    r = len(w) - 1
    v = strip.padded(plane, r, "reflect").astype(np.float64)
    width = plane.shape[1]
    across = w[0] * v[:, r : r + width]
    for k in range(1, r + 1):
        across += w[k] * (v[:, r - k : r - k + width] + v[:, r + k : r + k + width])
    down = w[0] * across[r : r + strip.core]
    for k in range(1, r + 1):
        down += w[k] * (across[r - k : r - k + strip.core] + across[r + k : r + k + strip.core])
    return np.rint(np.round(down, 9))


def _rows(strip: Strip) -> pa.Array:
    return pa.array(np.arange(strip.top, strip.top + strip.core), pa.int32())


def laplacian(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return v[:-2, 1:-1] + v[2:, 1:-1] + v[1:-1, :-2] + v[1:-1, 2:] - 4 * v[1:-1, 1:-1]


def blur_scores(lines: DataFrame, keys: Sequence[str] = ("image_id",), height: int = 512) -> DataFrame:
    """keys and score: the variance of the Laplacian of four neighbours, the border mirrored; from whole sums of strips, so it doesn't depend on them."""

    def kernel(s: Strip) -> dict[str, Any]:
        z = laplacian(s.padded(s.planes[0], 1, "reflect"))
        return {"n": [z.size], "s1": [int(z.sum())], "s2": [int((z * z).sum())]}

    sums = by_strips(lines, 1, kernel, "n long, s1 long, s2 long", keys=keys, height=height).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    return sums.select(*keys, (F.col("s2").cast("double") / F.col("n") - F.pow(F.col("s1").cast("double") / F.col("n"), 2)).alias("score"))


def gradients(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3 x 3 gradients, across and down, of a plane with one sample more on each side."""
    v = v.astype(np.int64)
    across, down = v[:, 2:] - v[:, :-2], v[2:] - v[:-2]
    return across[:-2] + 2 * across[1:-1] + across[2:], down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]


def sobel(lines: DataFrame, height: int = 512) -> DataFrame:
    """image_id, y, gx, gy (array<int>): 3 x 3 gradients, the border mirrored."""

    def kernel(s: Strip) -> dict[str, Any]:
        gx, gy = gradients(s.padded(s.planes[0], 1, "reflect"))
        return {"y": _rows(s), "gx": lists(gx, pa.int32()), "gy": lists(gy, pa.int32())}

    return by_strips(lines, 1, kernel, "y int, gx array<int>, gy array<int>", height=height)


def edge_thresholds(lines: DataFrame, share: float = 0.995, least: float = 30, most: float = 220, height: int = 512) -> DataFrame:
    """image_id, high and low: high is half the gradient at place floor(share * n) of all gradients of an image, between `least` and `most`; low is 0.4 of high, at least half of `least`.

    The place is found in a histogram of squared gradients, which are whole numbers; no pixels are sorted.
    """

    def kernel(s: Strip) -> dict[str, Any]:
        gx, gy = gradients(s.padded(s.planes[0], 1, "reflect"))
        square, n = np.unique(gx * gx + gy * gy, return_counts=True)
        return {"square": square, "n": n}

    squares = by_strips(lines, 1, kernel, "square long, n long", height=height).groupBy("image_id", "square").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("image_id").orderBy("square").rowsBetween(Window.unboundedPreceding, 0))
    counted = squares.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy("image_id")))
    found = counted.where(F.col("upto") > F.floor(F.col("total") * share)).groupBy("image_id").agg(F.min("square").alias("square"))
    high = F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.sqrt("square") / 2))
    return found.select("image_id", high.alias("high")).withColumn("low", F.greatest(F.lit(least / 2), F.least(F.col("high"), 0.4 * F.col("high"))))


def unsharp(lines: DataFrame, amount: float = 0.6, sigma: float = 2.0, height: int = 512) -> DataFrame:
    """image_id, y, v (array<int>): v * (1 + amount) - amount * its Gaussian, rounded, kept to 0..255."""

    def kernel(s: Strip) -> dict[str, Any]:
        own = s.of_core(s.planes[0]).astype(np.float64)
        return {"y": _rows(s), "v": lists(np.clip(np.rint(np.round(own * (1 + amount) - amount * gaussian(s, s.planes[0], sigma), 6)), 0, 255), pa.int32())}

    return by_strips(lines, len(bell(sigma)) - 1, kernel, "y int, v array<int>", height=height)


def suppress_showthrough(lines: DataFrame, sigma_share: float = 0.03, least_sigma: float = 25.0, low: float = 15.0, high: float = 45.0, height: int = 512) -> DataFrame:
    """image_id, y, v (array<int>): what is less than `low` darker than the background fades into it, what is `high` darker or more stays, between them a ramp; brighter samples stay.

    The background is a Gaussian of sigma `sigma_share` of the image's shorter side, at least `least_sigma`. Results are cut to whole numbers.
    """
    sized = lines.join(image_sizes(lines).withColumn("sigma", F.greatest(F.lit(float(least_sigma)), F.least("width", "height") * F.lit(float(sigma_share)))).select("image_id", "sigma"), "image_id")

    def kernel(s: Strip) -> dict[str, Any]:
        own, ground = s.of_core(s.planes[0]).astype(np.float64), gaussian(s, s.planes[0], s.values["sigma"])
        depth = ground - own
        ramp = np.clip((depth - low) / (high - low), 0, 1) if high > low else (depth >= high).astype(float)
        faded = np.floor(np.clip(np.round(ground - depth * ramp, 9), 0, 255))
        return {"y": _rows(s), "v": lists(np.where(depth <= 0, own, faded), pa.int32())}

    return by_strips(sized, reach_of(F.col("sigma")), kernel, "y int, v array<int>", values=("sigma",), height=height)


def box_stats(strip: Strip, plane: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of a window around each core sample, cut at the image's border, from a summed-area table."""
    v = plane.astype(np.int64)
    tables = [np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (v, v * v)]
    y = np.arange(strip.core) + strip.top - strip.first
    x = np.arange(v.shape[1])
    y0, y1, x0, x1 = np.maximum(0, y - radius), np.minimum(len(v), y + radius + 1), np.maximum(0, x - radius), np.minimum(v.shape[1], x + radius + 1)
    area = np.outer(y1 - y0, x1 - x0).astype(np.float64)
    s, q = (t[np.ix_(y1, x1)] - t[np.ix_(y0, x1)] - t[np.ix_(y1, x0)] + t[np.ix_(y0, x0)] for t in tables)
    mean = s / area
    return mean, np.sqrt(np.maximum(0, q / area - mean * mean))


def radius_of(width: Column, height: Column) -> Column:
    """Radius of the local window: a 160th of the longer side, 7 to 35."""
    return F.greatest(F.lit(7), F.least(F.lit(35), F.floor(F.greatest(width, height) / 160))).cast("int")


def _with_radius(lines: DataFrame, radius: int | None) -> DataFrame:
    if radius is not None:
        return lines.withColumn("radius", F.lit(radius))
    return lines.join(image_sizes(lines).select("image_id", radius_of(F.col("width"), F.col("height")).alias("radius")), "image_id")


def local_stats(lines: DataFrame, radius: int | None = None, height: int = 512) -> DataFrame:
    """image_id, y, mean, sd (array<double>) of a window around each sample, cut at the border; the radius follows from the image's size if not given."""

    def kernel(s: Strip) -> dict[str, Any]:
        mean, sd = box_stats(s, s.planes[0], s.values["radius"])
        return {"y": _rows(s), "mean": lists(mean, pa.float64()), "sd": lists(sd, pa.float64())}

    return by_strips(_with_radius(lines, radius), F.col("radius"), kernel, "y int, mean array<double>, sd array<double>", values=("radius",), height=height)


def medians(v: np.ndarray) -> np.ndarray:
    """Median of 3 x 3 neighbours of a plane with one sample more on each side."""
    near = np.stack([v[i : v.shape[0] - 2 + i, j : v.shape[1] - 2 + j] for i in range(3) for j in range(3)])
    return np.partition(near, 4, axis=0)[4]


def median3(lines: DataFrame, height: int = 512) -> DataFrame:
    """image_id, y, v (array<int>): 3 x 3 median, the border repeated."""
    return by_strips(lines, 1, lambda s: {"y": _rows(s), "v": lists(medians(s.padded(s.planes[0], 1, "edge")), pa.int32())}, "y int, v array<int>", height=height)


def otsu_thresholds(histograms: DataFrame) -> DataFrame:
    """image_id and threshold of the largest variance between two classes (the first on a tie), from image_id, v (0..255) and n."""
    counts = histograms.groupBy("image_id").agg(F.collect_list(F.struct("v", "n")).alias("h"))  # 256 at most

    def threshold(t: pa.Table) -> pa.Table:
        out = []
        for h in t.column("h").to_pylist():
            n = np.zeros(256, np.int64)
            for x in h:
                n[x["v"]] += x["n"]
            n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
            n1, s1 = n0[-1] - n0, s0[-1] - s0
            fine = (n0 > 0) & (n1 > 0)
            between = np.zeros(256)
            between[fine] = n0[fine].astype(float) * n1[fine] * (s0[fine] / n0[fine] - s1[fine] / n1[fine]) ** 2 / n0[-1] / n0[-1]
            between[n == 0] = -1  # thresholds are values that occur
            out.append(int(np.argmax(np.round(between, 6))))
        return pa.table({"image_id": t.column("image_id"), "threshold": pa.array(out, pa.int32())})

    kind = histograms.schema["image_id"].dataType.simpleString()
    return counts.mapInArrow(lambda batches: (b for x in batches for b in threshold(pa.Table.from_batches([x])).to_batches()), f"image_id {kind}, threshold int")


def sauvola(lines: DataFrame, k: float = 0.34, span: float = 128.0, flat: float = 3.0, radius: int | None = None, height: int = 512) -> DataFrame:
    """image_id, y, v (array<int>): 0 for ink and 255 for paper, after a 3 x 3 median, by the local threshold mean * (1 + k * (sd / span - 1)), or the image's own (Otsu's) where sd is below `flat`.

    Two passes over the rows: one for the histogram of medians, one for the result.
    """

    def histogram(s: Strip) -> dict[str, Any]:
        v, n = np.unique(medians(s.padded(s.planes[0], 1, "edge")), return_counts=True)
        return {"v": v, "n": n}

    counts = by_strips(lines, 1, histogram, "v int, n long", height=height).groupBy("image_id", "v").agg(F.sum("n").alias("n"))
    known = _with_radius(lines, radius).join(otsu_thresholds(counts), "image_id")

    def kernel(s: Strip) -> dict[str, Any]:
        med = medians(np.pad(s.planes[0], 1, "edge"))  # wrong in the outermost row at a cut, which no window reaches: the halo is one more than the radius
        mean, sd = box_stats(s, med, s.values["radius"])
        limit = np.where(sd < flat, s.values["threshold"], mean * (1 + k * (sd / span - 1)))
        return {"y": _rows(s), "v": lists(np.where(s.of_core(med) <= limit, 0, 255), pa.int32())}

    return by_strips(known, F.col("radius") + 1, kernel, "y int, v array<int>", values=("radius", "threshold"), height=height)


def ink_coverage(lines: DataFrame, **options: Any) -> DataFrame:
    """image_id and ink: the share of ink of sauvola()."""
    rows = sauvola(lines, **options).select("image_id", F.size(F.filter("v", lambda x: x == 0)).alias("ink"), F.size("v").alias("n"))
    return rows.groupBy("image_id").agg((F.sum("ink") / F.sum("n")).alias("ink"))


def signature_parts(plane: np.ndarray, y: np.ndarray, width: int, height: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of samples by cells of a `cells` x `cells` grid, weighted by overlap: (rows of the grid, sums of its columns), of some rows y of an image."""
    edges = np.arange(cells + 1)[:, None] * width / cells
    across = np.clip(np.minimum(edges[1:], np.arange(1, width + 1)) - np.maximum(edges[:-1], np.arange(width)), 0, None)  # cells x width
    sums = plane.astype(np.float64) @ across.T
    first, last = np.floor(y * cells / height).astype(int), np.minimum(cells - 1, np.ceil((y + 1) * cells / height).astype(int) - 1)
    out = np.zeros((cells, cells))
    for place in range(int(first.min()), int(last.max()) + 1):
        part = np.clip(np.minimum(y + 1, (place + 1) * height / cells) - np.maximum(y, place * height / cells), 0, None)
        out[place] = part @ sums
    used = np.unique(np.concatenate([first, last]))
    return used, out[used]


def region_rows(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """The rows inside each frame: image_id, frame_no, y (from 0), gray (cut), width and height of the frame; only frames of 2 x 2 samples or more.

    `frames`: image_id, frame_no and x, y, w, h as fractions of the image; they are rounded (half to even) and held inside it, and may overlap. An image's rows meet its own frames only, and each sends the part inside.
    """
    sizes = image_sizes(lines)
    whole = lambda c, side: F.bround(F.col(c) * F.col(side)).cast("int")
    held = lambda v, low, high: F.greatest(F.lit(low), F.least(v, high))
    rects = frames.join(sizes, "image_id").withColumn("x0", held(whole("x", "width"), 0, F.col("width") - 1)).withColumn("y0", held(whole("y", "height"), 0, F.col("height") - 1))
    rects = rects.select("image_id", "frame_no", "x0", "y0", held(whole("w", "width"), 1, F.col("width") - F.col("x0")).alias("f_width"), held(whole("h", "height"), 1, F.col("height") - F.col("y0")).alias("f_height"))
    rects = rects.where("f_width >= 2 AND f_height >= 2")
    inside = (F.col("line_y") >= F.col("y0")) & (F.col("line_y") < F.col("y0") + F.col("f_height"))
    return lines.select("image_id", F.col("y").alias("line_y"), "gray").join(rects, "image_id").where(inside).select("image_id", "frame_no", (F.col("line_y") - F.col("y0")).alias("y"), F.slice("gray", F.col("x0") + 1, F.col("f_width")).alias("gray"), F.col("f_width").alias("width"), F.col("f_height").alias("height"))


def region_measure(lines: DataFrame, frames: DataFrame, cells: int = 24, height: int = 512) -> DataFrame:
    """Sharpness and content of each frame by itself: image_id, frame_no, sharpness, signature (array<int> of cells * cells area means, row by row).

    Sharpness is the variance of the Laplacian inside the frame, its border mirrored. Frames under 2 samples, of images without rows, or outside count 0 and have no signature; frames with a side under `cells` have no signature.
    See region_rows() for `frames`.
    """

    def kernel(s: Strip) -> dict[str, Any]:
        z = laplacian(s.padded(s.planes[0], 1, "reflect"))
        w, h = s.values["width"], s.values["height"]
        cell, total = np.array([-1, -2, -3]), np.array([z.size, z.sum(), (z * z).sum()], np.float64)  # whole numbers, exact below 2 ** 53
        if w >= cells and h >= cells:
            used, sums = signature_parts(s.of_core(s.planes[0]), np.arange(s.top, s.top + s.core), w, h, cells)
            cell, total = np.concatenate([cell, (used[:, None] * cells + np.arange(cells)).ravel()]), np.concatenate([total, sums.ravel()])
        return {"cell": cell, "total": total}

    keys, size = ["image_id", "frame_no"], F.col("width") * F.col("height") / F.lit(float(cells * cells))
    rows = region_rows(lines, frames)
    sums = by_strips(rows, 1, kernel, "cell int, total double", keys=keys, values=("width", "height"), height=height).groupBy(*keys, "cell").agg(F.sum("total").alias("total"))
    of = lambda c: F.max(F.when(F.col("cell") == c, F.col("total")))
    sizes = rows.groupBy(*keys).agg(F.first("width").alias("width"), F.first("height").alias("height"))
    grid = F.sort_array(F.collect_list(F.when(F.col("cell") >= 0, F.struct("cell", "total"))))  # cells * cells at most
    found = sums.groupBy(*keys).agg((of(-3) / of(-1) - F.pow(of(-2) / of(-1), 2)).alias("sharpness"), grid.alias("grid")).join(sizes, keys)
    signature = F.when(F.size("grid") > 0, F.transform("grid", lambda c: F.bround(F.round(c["total"] / size, 6)).cast("int")))
    found = found.select(*keys, "sharpness", signature.alias("signature"))
    return frames.select(*keys).join(found, keys, "left").select(*keys, F.coalesce("sharpness", F.lit(0.0)).alias("sharpness"), "signature")
