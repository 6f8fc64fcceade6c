"""Hard negatives by a vertical scan: columns of blocks read in each anchor's order of magnitude, candidates pruned by what the unread columns can still add."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, packed, parts_for, unpacked

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(vectors: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """vec_id, label and vector (floor(scale * x) of each component) of the rows of `vectors` (vec_id, embedding, label) that can take part.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. `label` may replace the label of rows.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select("vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


class Block:
    """Rows stored by dimension: `columns` (dimensions, rows), their least and largest values; rows stand by label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray):
        self.ids, self.labels, self.columns = ids, labels, columns
        self.lows, self.highs = columns.min(axis=1), columns.max(axis=1)

    def scan(self, vector: np.ndarray, rows: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of `rows` that stay wanted, and their whole inner products with `vector`.

        Dimensions are read `step` at a time, those of largest magnitude in the vector first. Then each row's product lies between what it has plus the least and the largest that the unread
        dimensions can add, by their least and largest values in the block; rows whose bounds (low, high) are not `wanted` leave.
        """
        order = np.argsort(-np.abs(vector), kind="stable")
        ends = np.stack([vector * self.lows, vector * self.highs])
        least, most = (np.append(np.cumsum(x[order][::-1])[::-1], 0) for x in (ends.min(axis=0), ends.max(axis=0)))
        score = np.zeros(len(rows), self.columns.dtype)
        for at in range(0, len(order), step):
            dims = order[at : at + step]
            part = self.columns[dims] if len(rows) == self.columns.shape[1] else self.columns[dims[:, None], rows]
            score = score + vector[dims] @ part
            upto = min(at + step, len(order))
            keep = wanted(score + least[upto], score + most[upto])
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score


class Best:
    """The first `k` (score, id), by larger score and then smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]

    def bar(self, scores: np.ndarray) -> float:
        """A score that at least k rows reach: those held, and others with at least these `scores`. What stays below it can't be among the first."""
        both = np.concatenate([self.scores, scores])
        return np.partition(both, len(both) - self.k)[len(both) - self.k] if len(both) >= self.k else -np.inf


def nearest_of_label(block: Block, vector: np.ndarray, label: int, own: int, best: Best, step: int) -> None:
    """Adds the block's rows of the anchor's label to its `best`; rows of its own id are no candidates."""
    low, high = np.searchsorted(block.labels, [label, label + 1])
    rows = np.arange(low, high)
    rows = rows[block.ids[rows] != own]
    rows, score = block.scan(vector, rows, lambda least, most: most >= best.bar(least), step)
    best.add(score, block.ids[rows])


def negatives_in(block: Block, vector: np.ndarray, label: int, own: int, windows: list[tuple[int, int]], best: list[Best], step: int) -> None:
    """Adds the block's rows of other labels to `best` of each window (least and largest score) that holds their score."""
    low, high = np.searchsorted(block.labels, [label, label + 1])
    rows = np.concatenate([np.arange(low), np.arange(high, len(block.labels))])
    rows = rows[block.ids[rows] != own]

    def wanted(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), bool)
        for (lowest, highest), held in zip(windows, best, strict=True):
            could = (least <= highest) & (most >= lowest)
            surely = (least >= lowest) & (most <= highest)
            keep |= could & (most >= held.bar(least[surely]))
        return keep

    rows, score = block.scan(vector, rows, wanted, step)
    for (lowest, highest), held in zip(windows, best, strict=True):
        inside = (score >= lowest) & (score <= highest)
        held.add(score[inside], block.ids[rows[inside]])


def mine_hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block_rows: int = 4096, band_blocks: int = 16, least_bands: int = 64, group_anchors: int = 4096, step: int = 16) -> DataFrame:
    """For each anchor and each of its positives, its hard negatives: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    `rows` and `anchors`: vec_id, label, vector (whole numbers, see whole_vectors()). A row's score is its inner product with the anchor. Positives are the first `positives` rows of the anchor's label
    (all, if fewer), by larger score, ties by smaller id. Negatives of a positive are the first `negatives` rows of other labels whose score is between `low` and `high` percent of the positive's.

    Rows equal in all columns count once; of rows that share only their id each counts, and rows of an anchor's own id are not its candidates. Vectors of another length than the most common (ties: the
    longer) take no part. Without rows or anchors there are no rows. Scores are exact; they must fit in 63 bits, else an error says so.

    Rows are dealt by hash into blocks of about `block_rows`, each stored once as its columns. Every group of about `group_anchors` anchors meets every band of blocks (blocks are bands of their own up to `least_bands`; later a
    band has up to `band_blocks`): first for positives, then for negatives. Each meeting gives its own first rows for each anchor and window, and these are ranked. A task holds the blocks of one band.
    """
    spark = rows.sparkSession
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    width = common["width"]
    keyed = lambda df: df.where(F.size("vector") == width).select("vec_id", "label", "vector", F.xxhash64("label", "vector").alias("h")).dropDuplicates(["vec_id", "h"])
    asked = materialize(keyed(anchors), "anchors")
    n_rows, n_anchors = common["count"], asked.count()
    blocks, groups = parts_for(n_rows, block_rows), parts_for(n_anchors, group_anchors)
    bands = min(blocks, max(least_bands, parts_for(blocks, band_blocks)))
    dealt = keyed(rows).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id", "h"), F.lit(blocks)).cast("int"))

    def stored(key: tuple, t: pa.Table) -> pa.Table:
        vectors = np.asarray(t.column("vector").combine_chunks().flatten(), np.int64).reshape(-1, width)
        ids, labels = np.asarray(t.column("vec_id"), np.int64), np.asarray(t.column("label"), np.int64)
        order = np.lexsort((ids, labels))
        top = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        columns = [packed(vectors[order, d].astype(np.int32 if top < 2**31 else np.int64)) for d in range(width)]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "top": [top], "wide": [top >= 2**31], "ids": [packed(ids[order])], "labels": [packed(labels[order])], "columns": pa.array([columns], pa.list_(pa.binary()))})

    store = materialize(dealt.groupBy("block").applyInArrow(stored, "block int, top long, wide boolean, ids binary, labels binary, columns array<binary>"), "blocks")
    top = max(store.agg(F.max("top")).first()[0] or 0, asked.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0)
    if top * top * max(1, width) >= 2**62:
        raise ValueError("scores of these vectors may not fit in 63 bits")
    kind = np.float64 if top * top * max(1, width) < 2**52 else np.int64  # both exact

    def loaded(t: pa.Table) -> list[Block]:
        out = []
        for r in t.to_pylist():
            number = np.int64 if r["wide"] else np.int32
            columns = np.stack([unpacked(c, number).astype(kind) for c in r["columns"]]) if width else np.zeros((0, len(unpacked(r["ids"], np.int64))), kind)
            out.append(Block(unpacked(r["ids"], np.int64), unpacked(r["labels"], np.int64), columns))
        return out

    def meeting(sought: DataFrame):
        """Bands and groups of anchors, side by side."""
        left = store.withColumn("band", F.col("block") % bands).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        group = F.pmod(F.xxhash64(F.lit("group"), "vec_id", "h"), F.lit(groups)).cast("int")
        right = sought.withColumn("group", group).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
        return left.groupBy("group", "band").cogroup(right.groupBy("group", "band"))

    def each(t: pa.Table):
        vectors = np.asarray(t.column("vector").combine_chunks().flatten(), np.int64).reshape(-1, width).astype(kind)
        return zip(t.column("vec_id").to_pylist(), t.column("h").to_pylist(), t.column("label").to_pylist(), vectors, strict=True)

    def first_positives(held: pa.Table, sought: pa.Table) -> pa.Table:
        out = []
        found = loaded(held) if sought.num_rows else []
        for vec_id, h, label, vector in each(sought):
            best = Best(positives)
            for b in found:
                nearest_of_label(b, vector, label, vec_id, best, step)
            out += [(vec_id, h, int(i), int(s)) for s, i in zip(best.scores, best.ids, strict=True)]
        give_back()
        return _table(out, ("vec_id", "h", "positive_id", "positive_score"))

    def first(k: int, score: str, found: str, *by: str) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), found)) <= k

    near = meeting(asked).applyInArrow(first_positives, "vec_id long, h long, positive_id long, positive_score long")
    near = near.withColumn("keep", first(positives, "positive_score", "positive_id", "vec_id", "h")).where("keep")
    near = near.groupBy(F.col("vec_id").alias("p_id"), F.col("h").alias("p_h")).agg(F.sort_array(F.collect_list(F.struct("positive_score", "positive_id")), asc=False).alias("near"))  # `positives` at most
    both = asked.join(near, (F.col("vec_id") == F.col("p_id")) & (F.col("h") == F.col("p_h"))).select("vec_id", "h", "label", "vector", F.col("near.positive_score").alias("scores"), F.col("near.positive_id").alias("ids"))
    both = materialize(both, "positives")

    def first_negatives(held: pa.Table, sought: pa.Table) -> pa.Table:
        out = []
        found = loaded(held) if sought.num_rows else []
        for (vec_id, h, label, vector), scores, ids in zip(each(sought), sought.column("scores").to_pylist(), sought.column("ids").to_pylist(), strict=True):
            windows = [(-(-low * s // 100), high * s // 100) for s in scores]
            best = [Best(negatives) for _ in windows]
            for b in found:
                negatives_in(b, vector, label, vec_id, windows, best, step)
            for place, (score, positive, x) in enumerate(zip(scores, ids, best, strict=True)):
                out += [(vec_id, h, place, positive, score, int(i), int(s)) for s, i in zip(x.scores, x.ids, strict=True)]
        give_back()
        return _table(out, ("vec_id", "h", "place", "positive_id", "positive_score", "negative_id", "negative_score"))

    hard = meeting(both).applyInArrow(first_negatives, "vec_id long, h long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("vec_id", "h", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})
