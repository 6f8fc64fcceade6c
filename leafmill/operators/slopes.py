"""Trends of a page's text lines by the middle slope of all pairs (Theil and Sen), without listing the pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many pairs are looked at directly.
DIRECT = 200_000


def earlier(t: np.ndarray, gap: float) -> np.ndarray:
    """For each of sorted `t`, how many are below it by `gap` at least (and by more than nothing)."""
    p = np.minimum(np.searchsorted(t, t - gap, side="right"), np.searchsorted(t, t, side="left"))
    apart = lambda i: t - t[np.clip(i, 0, len(t) - 1)]
    while (more := (p < len(t)) & (apart(p) >= gap) & (apart(p) > 0)).any():  # t - gap was rounded
        p = p + more
    while (less := (p > 0) & ((apart(p - 1) < gap) | (apart(p - 1) <= 0))).any():
        p = p - less
    return p


def counts_from(z: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each j, how many of z[:upto[j]] are at least z[j].

    A prefix is made of blocks whose lengths are the powers of two in its length. Level by level, blocks are sorted (a merge sort), and all prefixes that hold a block of that level search it at once.
    """
    _, rank = np.unique(z, return_inverse=True)
    n, out = len(z), np.zeros(len(z), np.int64)
    base = n + 1
    block = rank.astype(np.int64)
    for level in range(int(upto.max(initial=0)).bit_length()):
        size = 1 << level
        block = np.sort(np.pad(block, (0, -len(block) % size), constant_values=n).reshape(-1, size), axis=1).ravel()
        asked = np.flatnonzero(upto >> level & 1)
        at = (upto[asked] >> (level + 1)) * 2
        keys = block + np.repeat(np.arange(len(block) // size), size) * base
        out[asked] += size - (np.searchsorted(keys, at * base + rank[asked]) - at * size)
    return out


def middle_slope(t: np.ndarray, v: np.ndarray, gap: float = 0.0, seed: int = 18) -> float | None:
    """The upper-middle one of the slopes of all pairs that are `gap` apart in t, or None without such pairs: in O(n log n) time for each halving and O(n) memory.

    How many slopes are at most m is the number of pairs in falling order of v - m t. Slopes of a random sample of pairs bracket the middle, halvings narrow the bracket until it holds a few hundred pairs, and the middle is
    picked from their slopes. Where more pairs than that have one slope, it is that slope.
    """
    order = np.argsort(t, kind="stable")
    t, v = t[order].astype(np.float64), v[order].astype(np.float64)
    p = earlier(t, gap)
    total = int(p.sum())
    if not total:
        return None
    k = total // 2
    of = lambda j, i: (v[j] - v[i]) / (t[j] - t[i])
    if total <= DIRECT:
        j = np.repeat(np.arange(len(t)), p)
        i = np.arange(total) - np.repeat(np.cumsum(p) - p, p)
        return float(np.partition(of(j, i), k)[k])
    upto = lambda m: counts_from(v - m * t, p)
    rng = np.random.default_rng(seed)
    ends = np.cumsum(p)
    drawn = rng.integers(0, total, 4096)
    j = np.searchsorted(ends, drawn, side="right")
    some = np.sort(of(j, drawn - (ends[j] - p[j])))
    reach = 1 / 32
    while True:
        low, high = (some[int(np.clip(0.5 + d, 0, 1) * (len(some) - 1))] for d in (-reach, reach))
        width = max(abs(low), abs(high), 1e-300) * 1e-9 + (some[-1] - some[0]) * (1e-9 if reach < 0.5 else reach)
        low, high = low - width, high + width
        below, above = upto(low), upto(high)
        if below.sum() <= k < above.sum():
            break
        reach *= 2
    while above.sum() - below.sum() > 256 and high - low > 1e-13 * max(abs(low), abs(high), 1e-300):
        mid = low + (high - low) / 2
        if not low < mid < high:
            break
        counts = upto(mid)
        if counts.sum() <= k:
            low, below = mid, counts
        else:
            high, above = mid, counts
    found, rank = [], k - int(below.sum())
    for j in np.flatnonzero(above > below):
        z_low, z_high = v - low * t, v - high * t
        i = np.flatnonzero((z_high[: p[j]] >= z_high[j]) & (z_low[: p[j]] < z_low[j]))
        found.append(of(j, i))
        if len(found) > 256:
            break  # more pairs than numbers between the two bounds: they have one slope
    slopes = np.concatenate(found)
    return float(np.partition(slopes, min(rank, len(slopes) - 1))[min(rank, len(slopes) - 1)])


def trend(y: np.ndarray, v: np.ndarray, near: float, least: int = 8, gap_share: float = 0.02) -> dict | None:
    """How v changes with y: s (middle slope of pairs at least `gap_share` of the height apart), c (middle intercept), share (of lines within `near` of it), first and last y, and pivot (the y of the line nearest to it)."""
    if len(y) < least:
        return None
    s = middle_slope(y, v, gap_share * (y.max() - y.min()))
    if s is None:
        return None
    rest = v - s * y
    c = np.sort(rest)[len(rest) // 2]
    off = np.abs(rest - c)
    pivot = y[np.lexsort((y, np.round(off, 9)))[0]]
    return {"s": s, "c": float(c), "first": float(y.min()), "last": float(y.max()), "share": float(np.mean(off <= near)), "pivot": float(pivot)}


OUT = "n int, angle double, iqr double, shear double, shear_share double, shear_pivot double, turn double, turn_at_0 double, turn_first double, turn_last double, turn_share double"


def page_trends(line_sample: DataFrame, near_px: float = 15.0, near_slope: float = 0.03, least_lines: int = 8, least_samples: int = 8, margins: bool = True, turns: bool = True) -> DataFrame:
    """For each page (doc_id) of `line_sample` (doc_id, line_num, x, y): what deskewing needs to know.

    n, angle, iqr: lines with `least_samples` or more, the upper-middle of their angles (degrees) and the distance of the quartiles. shear, shear_share, shear_pivot: the trend of the left margin down
    the page. turn, turn_at_0, turn_share, turn_first, turn_last: the trend of the lines' own slopes. Trends need `least_lines` lines and are null otherwise, or unless `margins` or `turns` (also n, angle, iqr) are asked for. Pages pass through a task in order, many to a batch, and one page's
    lines are held at a time: a row for each line, not for each pair.
    """
    slope = F.regr_slope("y", "x") if turns else F.first(F.lit(None).cast("double"))
    lines = line_sample.groupBy("doc_id", "line_num").agg(F.min("x").alias("lx"), F.avg("y").alias("ly"), F.count(F.lit(1)).alias("cnt"), slope.alias("slope"))
    names, kinds = [c.split(" ")[0] for c in OUT.split(", ")], [pa.int32(), *[pa.float64()] * 10]

    def of_page(lx: np.ndarray, ly: np.ndarray, cnt: np.ndarray, slope: np.ndarray, number: np.ndarray) -> list:
        long = (cnt >= least_samples) & ~np.isnan(slope)
        angle = np.degrees(np.arctan(slope[long]))
        angle = angle[np.lexsort((number[long], angle))]
        n = len(angle)
        margin = trend(ly, lx, near_px, least_lines) if margins else None
        turn = trend(ly[long], slope[long], near_slope, least_lines) if turns else None
        row = [n, angle[n // 2] if n else None, angle[3 * n // 4] - angle[n // 4] if n else None]
        row += [margin[c] for c in ("s", "share", "pivot")] if margin else [None] * 3
        return row + ([turn[c] for c in ("s", "c", "first", "last", "share")] if turn else [None] * 5)

    def pages(t: pa.Table, ids: list, cuts: list[int]) -> pa.RecordBatch:
        columns = [t.column(c).to_numpy() for c in ("lx", "ly", "cnt", "slope", "line_num")]
        rows = [of_page(*(c[i:j] for c in columns)) for i, j in zip(cuts, [*cuts[1:], t.num_rows], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in cuts], t.schema.field("doc_id").type), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([*held, b])
                ids = t.column("doc_id").to_pylist()
                cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]]
                held = t.slice(cuts[-1]).to_batches()
                if len(cuts) > 1:
                    yield pages(t.slice(0, cuts[-1]), ids, cuts[:-1])
        if held:
            t = pa.Table.from_batches(held)
            yield pages(t, t.column("doc_id").to_pylist()[:1], [0])

    parts = int(line_sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, f"doc_id {line_sample.schema['doc_id'].dataType.simpleString()}, {OUT}")


_DEGREES = 180 / math.pi


def margin_shear(line_sample: DataFrame, share: float = 0.6, least: float = 0.3, most: float = 10.0) -> DataFrame:
    """doc_id, angle of the left margin, inliers, pivot_y (the y of the line that a correction leaves in place) and whether to correct it."""
    t = page_trends(line_sample, turns=False).where("shear IS NOT NULL").withColumn("deg", F.atan("shear") * _DEGREES)
    applies = (F.col("shear_share") >= share) & F.abs("deg").between(least, most)
    return t.select("doc_id", F.round("deg", 6).alias("angle"), F.round("shear_share", 6).alias("inliers"), F.round("shear_pivot", 6).alias("pivot_y"), applies.alias("applies"))


def _span() -> Column:
    at = lambda y: F.atan(F.col("turn_at_0") + F.col("turn") * F.col(y)) * _DEGREES
    return F.abs(at("turn_last") - at("turn_first"))


def rotation_field(line_sample: DataFrame, share: float = 0.5, least: float = 0.5, most: float = 10.0) -> DataFrame:
    """doc_id, trend of the lines' slopes, slope at y = 0, span (degrees from the first to the last line), share of lines that follow and whether to correct it."""
    t = page_trends(line_sample, margins=False).where("turn IS NOT NULL").withColumn("deg", _span())
    applies = (F.col("turn_share") >= share) & F.col("deg").between(least, most)
    return t.select("doc_id", (F.round("turn", 9) + 0.0).alias("trend"), (F.round("turn_at_0", 9) + 0.0).alias("slope"), F.round("deg", 6).alias("span"), F.round("turn_share", 6).alias("share"), applies.alias("applies"))


def deskew_decision(line_sample: DataFrame) -> DataFrame:
    """doc_id, n, angle, iqr and how to set a page straight, from one look at its lines: by its middle angle, else by the turn of its lines, else by the shear of its margin, else not."""
    t = page_trends(line_sample).where("n > 0").withColumn("deg", F.atan("shear") * _DEGREES).withColumn("span", _span())
    turn = (F.col("turn_share") >= 0.5) & F.col("span").between(0.5, 10)
    shear = (F.col("shear_share") >= 0.6) & F.abs("deg").between(0.3, 10)
    plain = (F.col("iqr") <= 3) & (F.abs("angle") >= 0.1)
    decision = F.when(F.col("n") < 3, "none").when(plain & (F.abs("angle") <= 15), "lines").when(plain, "none").when(turn, "rotation").when(shear, "shear").otherwise("none")
    return t.select("doc_id", F.col("n").cast("long").alias("n"), F.round("angle", 6).alias("angle"), F.round("iqr", 6).alias("iqr"), decision.alias("decision"))
