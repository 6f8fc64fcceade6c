"""Approximate nearest neighbours: a forest of random-projection trees searched through one priority queue, then exact scores."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parts_for

#: More than a product of unit vectors can differ from their cosine in double precision.
ROUNDING = 1e-12


class Forest:
    """Trees whose inner nodes cut at the median of a sample's projections on the difference of two of its vectors.

    Nodes are numbered as in a heap: node n has the children 2n and 2n + 1; leaves are 0 to 2 ** depth - 1.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        self.trees, self.depth = trees, depth
        rng = np.random.default_rng(seed)
        self.planes = np.zeros((trees, 2**depth, sample.shape[1]))
        self.offsets = np.zeros((trees, 2**depth))
        for t in range(trees):
            self._split(t, 1, sample, 0, rng)
        self.sizes = np.zeros((trees, 2**depth), np.int64)

    def _split(self, t: int, node: int, rows: np.ndarray, level: int, rng: np.random.Generator) -> None:
        if level == self.depth:
            return
        plane = np.zeros(rows.shape[1])
        if len(rows) > 1:
            a, b = rows[rng.choice(len(rows), 2, replace=False)]
            plane = a - b
        if not plane.any():
            plane = rng.normal(size=rows.shape[1])
        plane /= np.linalg.norm(plane)
        at = rows @ plane
        cut = np.median(at) if len(rows) else 0.0
        self.planes[t, node], self.offsets[t, node] = plane, cut
        self._split(t, 2 * node, rows[at <= cut], level + 1, rng)
        self._split(t, 2 * node + 1, rows[at > cut], level + 1, rng)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, (vectors, trees)."""
        out = np.empty((len(unit), self.trees), np.int64)
        for t in range(self.trees):
            node = np.ones(len(unit), np.int64)
            for _ in range(self.depth):
                node = 2 * node + ((unit * self.planes[t, node]).sum(-1) > self.offsets[t, node])
            out[:, t] = node - 2**self.depth
        return out

    def ranks(self, unit: np.ndarray) -> np.ndarray:
        """The place (from 1) of each leaf in the order in which an endless search visits them, (trees, leaves); empty leaves count no place.

        A leaf's turn is set by the largest margin on its way, so the queue's order is that of these.
        """
        gap = self.planes @ unit - self.offsets
        worst = np.full((self.trees, 1), -np.inf)
        for level in range(self.depth):
            own = gap[:, 2**level : 2 ** (level + 1)]
            worst = np.stack([np.maximum(worst, own), np.maximum(worst, -own)], axis=2).reshape(self.trees, -1)
        order = np.argsort(worst, axis=None, kind="stable")
        out = np.empty(worst.size, np.int64)
        out[order] = np.cumsum(self.sizes.ravel()[order] > 0)
        return out.reshape(worst.shape)

    def search(self, unit: np.ndarray, visits: int, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of a queue that all trees share: the branch with the largest smallest margin first.

        Ends after `visits` leaves, once leaves of one tree hold `least` vectors.
        """
        gap = self.planes @ unit - self.offsets
        queue = [(-np.inf, t, 1) for t in range(self.trees)]
        out: list[tuple[int, int]] = []
        held = np.zeros(self.trees, np.int64)
        while queue and (len(out) < visits or held.max() < least):
            worst, t, node = heapq.heappop(queue)
            if node >= 2**self.depth:
                leaf = node - 2**self.depth
                if self.sizes[t, leaf]:
                    out.append((t, leaf))
                    held[t] += self.sizes[t, leaf]
            else:
                heapq.heappush(queue, (max(worst, gap[t, node]), t, 2 * node))
                heapq.heappush(queue, (max(worst, -gap[t, node]), t, 2 * node + 1))
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def usable(vector) -> F.Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def measured_visits(forest: Forest, vectors: DataFrame, queries: list, width: int, k: int, recall: float) -> int:
    """Leaves to visit so that the share `recall` of the true `k` nearest of `queries` (rows of h1, h2, vector) is found; 1 without queries."""
    if not queries:
        return 1
    w = np.array([r["vector"] for r in queries], np.float64)
    w /= np.sqrt((w * w).sum(-1, keepdims=True))
    own = {(r["h1"], r["h2"]): i for i, r in enumerate(queries)}

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("vector"), width)
            v = v / np.sqrt((v * v).sum(-1, keepdims=True))
            near = w @ v.T
            for j, key in enumerate(zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), strict=True)):
                if key in own:
                    near[own[key], j] = -np.inf
            most = min(k, len(v))
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            leaf = forest.leaves(v[top.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(w)), most)), pa.array(np.take_along_axis(near, top, 1).ravel()), pa.array(leaf.tolist(), pa.list_(pa.int64()))], names=["query", "score", "leaf"])

    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    true = vectors.mapInArrow(closest, "query long, score double, leaf array<long>").where(F.col("score") > float("-inf")).withColumn("place", best).where(F.col("place") <= k)
    places = {i: forest.ranks(unit) for i, unit in enumerate(w)}
    need = sorted(min(int(places[r["query"]][t, x]) for t, x in enumerate(r["leaf"])) for r in true.select("query", "leaf").collect())  # k rows a query
    return max(1, need[int(np.ceil(recall * len(need))) - 1]) if need else 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 8, depth: int = 6, leaf_rows: int = 64, recall: float = 0.95, calibration_queries: int = 128, block_rows: int = 20_000, seed: int = 8) -> DataFrame:
    """The `k` rows of `vectors` nearest to each row of `queries` by cosine: query_id, rank (from 1), vec_id, score.

    Both have vec_id and embedding. A query's own id is no candidate; nearest first, ties to the smaller vec_id. Rows whose id is
    null, or whose vector is null, empty, zero or holds null or non-finite numbers, take no part, nor do vectors of another
    length than the most common (ties: the longer). Rows equal in both columns count once. Without vectors there are no rows.

    Trees are as deep as leaves of `leaf_rows` vectors or more allow, but at most `depth`, so that the planes that tasks get are bounded and a
    query's candidates grow with its visits only; beyond 64 times `leaf_rows` vectors, leaves grow unless `depth` is raised. Their cuts are fitted on about eight vectors for each leaf, 20,000 at least (those of smallest hash); every vector is then put
    into one leaf of each tree. How many leaves a query visits, over all trees, is measured: the true neighbours of `calibration_queries` query
    vectors (those of smallest hash) are found among all vectors in one pass, and visits are as many as find the share `recall` of them. A search goes on
    while its leaves could hold fewer than k + 1 vectors. Scores are exact (double precision) for all vectors of visited leaves. Equal vectors are
    searched once, with the k + 1 smallest ids, as no result can hold more of them. A leaf of over `block_rows` vectors is cut into blocks.
    """
    keyed = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows, asked = keyed(vectors), keyed(queries)
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    spark = vectors.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = common["width"]
    hashed = lambda df: df.where(F.size("vector") == width).select("*", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(seed), "vector").alias("h2"))
    few = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    distinct = materialize(hashed(rows).withColumn("few", few).where(F.col("few") <= k + 1).groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("vec_id")).alias("ids")), "vectors")
    n = distinct.count()
    depth = max(0, min(depth, (n // leaf_rows).bit_length() - 1))
    share = min(1.0, max(20_000, 8 * 2**depth) / n)
    sample = distinct.where(F.pmod(F.col("h2"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vector").toArrow().column(0).combine_chunks()
    sample = matrix(sample, width) if len(sample) else np.zeros((0, width))
    sample = sample / np.maximum(np.sqrt((sample * sample).sum(-1, keepdims=True)), 1e-300)
    forest = Forest(sample, trees, depth, seed)
    blocks = parts_for(n / 2**depth, block_rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("vector"), width)
            leaf = forest.leaves(v / np.sqrt((v * v).sum(-1, keepdims=True)))
            block = np.asarray(b.column("h1")) % blocks
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(leaf[:, t].astype(np.int32)), pa.array(block.astype(np.int32)), *[b.column(c) for c in ("h1", "h2", "ids", "vector")]], names=["tree", "leaf", "block", "h1", "h2", "ids", "vector"])

    cells = distinct.mapInArrow(index, "tree int, leaf int, block int, h1 long, h2 long, ids array<long>, vector array<double>")
    for r in cells.groupBy("tree", "leaf").count().collect():  # trees * 2 ** depth rows
        forest.sizes[r["tree"], r["leaf"]] = r["count"]

    asked = hashed(asked).select("vec_id", "vector", "h1", "h2")
    sought = asked.groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    visits = measured_visits(forest, distinct, sought.orderBy("h1", "h2").limit(calibration_queries).collect(), width, k, recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("vector"), width)
            unit = v / np.sqrt((v * v).sum(-1, keepdims=True))
            found = [(i, t, leaf, x) for i in range(len(v)) for t, leaf in forest.search(unit[i], visits, k + 1) for x in range(blocks)]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[pa.array([x[j] for x in found], pa.int32()) for j in (1, 2, 3)], *[b.column(c).take(at) for c in ("h1", "h2", "vector")]], names=["tree", "leaf", "block", "h1", "h2", "vector"])

    visited = sought.mapInArrow(visit, "tree int, leaf int, block int, h1 long, h2 long, vector array<double>")

    def score(held: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table({"q1": pa.array([], pa.int64()), "q2": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not held.num_rows or not q.num_rows:
            return empty
        held, q = held.combine_chunks(), q.combine_chunks()
        v, w = matrix(held.column("vector").combine_chunks(), width), matrix(q.column("vector").combine_chunks(), width)
        v_norm, w_norm = np.sqrt((v * v).sum(-1)), np.sqrt((w * w).sum(-1))
        most = min(len(v), k + 1)
        smallest = np.asarray(pc.list_element(held.column("ids"), 0))
        v_unit = (v / v_norm[:, None]).T
        out_q, out_v, out_s = [], [], []
        for i in range(0, len(w), 512):
            near = (w[i : i + 512] / w_norm[i : i + 512, None]) @ v_unit
            least = np.partition(near, len(v) - most, axis=1)[:, len(v) - most]
            for j, row in enumerate(near, i):
                # All that rounding in the product could have put below the last; then the measure itself, ties to the smaller id.
                top = np.flatnonzero(row >= least[j - i] - ROUNDING)
                exact = (v[top] * w[j]).sum(-1) / (v_norm[top] * w_norm[j])
                best = np.lexsort((smallest[top], -exact))[:most]
                out_q.append(np.full(len(best), j))
                out_v.append(top[best])
                out_s.append(exact[best])
        a, b = pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v))
        return pa.table({"q1": q.column("h1").take(a), "q2": q.column("h2").take(a), "h1": held.column("h1").take(b), "h2": held.column("h2").take(b), "ids": held.column("ids").take(b), "score": pa.array(np.concatenate(out_s))})

    by = ["tree", "leaf", "block"]
    scored = cells.groupBy(*by).cogroup(visited.groupBy(*by)).applyInArrow(score, "q1 long, q2 long, h1 long, h2 long, ids array<long>, score double")
    # The best of each query vector over all leaves; a vector may come from several trees.
    pairs = scored.groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    # The first k + 1 ids of a query are those of its first k + 1 vectors, by score and then smallest id.
    first = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.element_at("ids", 1)))
    found = pairs.withColumn("place", first).where(F.col("place") <= k + 1).withColumn("id", F.explode("ids"))
    named = asked.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2")).distinct()
    ranked = named.join(found, ["q1", "q2"]).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
