"""Exact Jaccard join of documents' shingle sets by partitioning the universe of shingles.

Two sets of sizes x and y with Jaccard similarity t or more differ in H(x, y) elements at most. If the universe is dealt into
segments by a hash, two linked sets differ in at most H segments, so they agree on one that is not empty whenever one of
them has more than H segments with elements (or on an empty one, if neither has). Sets are compared only with those of their size
band, so H is fixed where the keys are made.

How a set's H + 1 is allocated to its segments is a matter of cost. By default each segment counts for one: the set is found through the
segments that agree. A set may instead skip the segments that very many sets share (they count for nothing) and let every other
count for two: agreeing, or differing in one element, which the segment's one-deletion neighbourhood finds. See Band.quota for how many may be skipped.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, give_back, materialize, mixed, packed, parts_for, shingle_hashes, small, unpacked, word_hashes
from .components import connected_components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def most_apart(x: int, y: int, percent: int) -> int:
    """The largest symmetric difference of sets of sizes x and y that link: 100 * intersection >= percent * union."""
    least_common = -(-percent * (x + y) // (100 + percent))
    return x + y - 2 * least_common


def largest_partner(x: int, percent: int) -> int:
    return 100 * x // percent


class Band:
    """Sizes low to high of the smaller set of a pair, and how the universe is dealt for such pairs."""

    def __init__(self, number: int, low: int, high: int, percent: int):
        self.number, self.low, self.high = number, low, high
        self.apart = max(most_apart(x, y, percent) for x in {low, high} for y in {x, largest_partner(x, percent)})
        self.apart = max(self.apart, *(most_apart(high, y, percent) for y in range(max(high, largest_partner(high, percent) - 8), largest_partner(high, percent) + 1)))
        need = self.apart + 1
        # As many segments as leave the smallest set with enough that are not empty.
        m = need
        while m < 8 * low + 8 and m * (1 - math.exp(-low / m)) < 1.08 * need + 1:
            m += max(1, m // 16)
        self.segments = m

    def dealt(self, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segment of each element of a set, and where the segments' elements begin."""
        segment = ((sorted_set >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        return segment, np.flatnonzero(np.diff(segment, prepend=np.uint64(2**63)))

    def _base(self, segment: np.ndarray) -> np.ndarray:
        return mixed(segment + (np.uint64(self.number) << np.uint64(40)))

    def keys(self, sorted_set: np.ndarray, element: np.ndarray) -> np.ndarray:
        """Keys of a set (sorted hashes, and numbers for its elements to add up), of its segments in order first: linked sets of this band share one."""
        segment, starts = self.dealt(sorted_set)
        own = mixed(self._base(segment[starts]) + np.add.reduceat(element, starts))
        if len(starts) > self.apart:
            return own
        # Empty segments are keys only if too few others stand.
        empty = np.setdiff1d(np.arange(self.segments, dtype=np.uint64), segment[starts])
        return np.concatenate([own, mixed(mixed(empty + (np.uint64(self.number) << np.uint64(40))))])

    def neighbourhood(self, sorted_set: np.ndarray, element: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the segments that are not among the `skipped` keys, and those of the same segments less one element (of segments of several)."""
        segment, starts = self.dealt(sorted_set)
        sums, base = np.add.reduceat(element, starts), self._base(segment[starts])
        own = mixed(base + sums)
        keep = ~np.isin(own, skipped)
        lengths = np.diff(np.append(starts, len(segment)))
        at = np.repeat(np.arange(len(starts)), lengths)
        one_less = (keep & (lengths > 1))[at]
        return own[keep], mixed(base[at] + sums[at] - element)[one_less]

    def quota(self, standing: int) -> int:
        """How many segments a set may skip that has elements in `standing` ones, if all others count for two.

        Let two linked sets have elements in s and t segments, and let both skip no more than that: d in all, with 2d < s + t - H. If they
        differed by two or more in each segment that both have and neither skips, and by one or more in each that one has, then 2(s - d) - e + f <= H
        and 2(t - d) + e - f <= H, where e and f segments are of one only. Their sum says s + t - 2d <= H: a contradiction.
        """
        return max(0, (2 * standing - self.apart - 1) // 4)


class Bands:
    """The size bands up to a largest size, found by size; made as needed."""

    def __init__(self, percent: int, ratio: float):
        self.percent, self.ratio = percent, ratio
        self.all: list[Band] = []

    def of(self, size: int) -> list[Band]:
        """Bands in which a set of this size may be the smaller or the larger of a linked pair."""
        while not self.all or self.all[-1].high < size:
            low = self.all[-1].high + 1 if self.all else 1
            self.all.append(Band(len(self.all), low, max(low, int(low * self.ratio)), self.percent))
        least = -(-self.percent * size // 100)
        out = []
        for b in reversed(self.all[: bisect.bisect_left(self.all, size, key=lambda b: b.high) + 1]):
            if b.high < least:
                break
            out.append(b)
        return out


def text_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return distinct(shingle_hashes(word_hashes(text), width))


def elements(s: np.ndarray) -> np.ndarray:
    """Numbers for the elements of a set to add up in keys."""
    return mixed(s ^ GOLDEN)


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, independent of order."""
    if not len(s):
        return 0, 0
    m = mixed(s)
    n = np.uint64(len(s))
    return tuple(mixed(np.array([m.sum() + n, np.bitwise_xor.reduce(m * GOLDEN) ^ n])).view(np.int64).tolist())


def sketch_of(s: np.ndarray) -> bytes:
    """How many elements fall in each of 128 bins, 255 at most: the sum of two sketches' differences is at most the sets' symmetric difference."""
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) & 127, minlength=128), 255).astype(np.uint8).tobytes()


def fine_sketch(s: np.ndarray) -> bytes | None:
    """The same with about a bin for each one or two elements, of sets of over 256: 128 bins tell such sets apart no more."""
    if len(s) <= 256:
        return None
    bits = len(s).bit_length() - 1
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) & ((1 << bits) - 1), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def bins_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint8).reshape(-1, 128)


def folded(sketch: bytes, bins: int) -> np.ndarray:
    """A finer sketch with fewer bins."""
    return np.frombuffer(sketch, np.uint8).reshape(-1, bins).sum(axis=0, dtype=np.uint16)


def sketches_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)


def with_sets(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """doc_id, n, s1, s2 (hashes of the set), bands and quotas (how many segments may be skipped in each), sketch and fine of every row of `docs` (doc_id, text as bytes)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                s = text_set(x.as_py(), width)
                own = bands.of(len(s)) if len(s) else []
                rows.append((len(s), *set_hashes(s), [band.number for band in own], [band.quota(len(band.dealt(s)[1])) for band in own], sketch_of(s), fine_sketch(s)))
            kinds = [*[pa.int64()] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]], names=["doc_id", "n", "s1", "s2", "bands", "quotas", "sketch", "fine"])
        give_back()

    return docs.mapInArrow(sets, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, s1 long, s2 long, bands array<int>, quotas array<int>, sketch binary, fine binary")


class Packer:
    """Gathers keys and yields them packed by bucket: the sets (s1) that have keys there, tags (band, whether an element is left out, whether the next set begins), how many keys each tag has, and the keys' low 32 bits."""

    SCHEMA = "bucket int, nodes binary, tags binary, counts binary, keys binary"

    def __init__(self, buckets: int):
        self.buckets, self.owners, self.keys, self.size = buckets, [], [], 0

    def add(self, node: int, band: Band, less: bool, keys: np.ndarray) -> None:
        self.owners.append((node, 2 * band.number + less))
        self.keys.append(keys)
        self.size += len(keys)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size > least:
            yield self._batch()
            self.owners, self.keys, self.size = [], [], 0

    def _batch(self) -> pa.RecordBatch:
        key = np.concatenate(self.keys)
        owner = np.repeat(np.arange(len(self.owners), dtype=np.uint32), [len(k) for k in self.keys])
        node, tag = np.array([o[0] for o in self.owners], np.int64), np.array([o[1] for o in self.owners], np.uint16)
        bucket = bucket_of(key, self.buckets).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        low = key.astype(np.uint32)
        out = []
        for i in range(self.buckets):
            rows = order[ends[i] : ends[i + 1]]
            if len(rows):
                own, counts = np.unique(owner[rows], return_counts=True)
                fresh = np.ones(len(own), bool)
                fresh[1:] = node[own[1:]] != node[own[:-1]]
                out.append((i, node[own[fresh]].tobytes(), packed(2 * tag[own] + fresh.astype(np.uint16)), packed(counts.astype(np.uint32)), low[rows].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[j] for r in out], pa.binary()) for j in range(1, 5)]], names=["bucket", "nodes", "tags", "counts", "keys"])


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def packed_keys(docs: DataFrame, width: int, bands: Bands, buckets: int) -> DataFrame:
    """Keys of all sets, packed. A set that a batch holds several times is sent once. Two keys that share a band, a bucket and 32 bits by chance cost a comparison only."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            packer = Packer(buckets)
            for x in b.column(0):
                s = text_set(x.as_py(), width)
                if len(s) and (node := set_hashes(s)[0]) not in seen:
                    seen.add(node)
                    for band in bands.of(len(s)):
                        packer.add(node, band, False, band.keys(s, elements(s)))
                yield from packer.flush(1_000_000)
            yield from packer.flush(0)
        give_back()

    return docs.select("text").mapInArrow(pack, Packer.SCHEMA)


def bucket_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: node, whether an element is left out, and band and low key as one number, ordered by the last and the node, without repeats."""
    nodes, key = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)]) for c, kind in (("nodes", np.int64), ("keys", np.uint32)))
    tags, counts = (np.concatenate([unpacked(x.as_py(), kind) for x in table.column(c)]) for c, kind in (("tags", np.uint16), ("counts", np.uint32)))
    nodes = nodes[np.cumsum(tags & 1) - 1]
    tag = np.repeat(tags >> 1, counts)
    key = key.astype(np.uint64) | (tag >> 1).astype(np.uint64) << np.uint64(32)
    # Keys of one set go before the others are put in order.
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    keep = np.zeros(len(key), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    node, key, less = np.repeat(nodes, counts)[order], key[order], (tag & 1)[order]
    order = np.lexsort((node, less, key))
    node, key, less = node[order], key[order], less[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (less[1:] != less[:-1])
    return node[fresh], less[fresh], key[fresh]


def run_hashes(node: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    u = node.view(np.uint64)
    return [np.add.reduceat(mixed(u ^ np.uint64(k)), starts).view(np.int64) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def lists_of(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def live_runs(packed: DataFrame, most: int) -> DataFrame:
    """Sets that share a key: band, h1, h2 (hashes of all sets of the key), part, keys (those that these sets share so), nodes (sorted; of a later part, the key's first set before them).

    Each distinct run of a band stands once. Runs of over `most` sets are cut into parts, of which the first has the keys.
    """

    def runs(table: pa.Table) -> pa.Table:
        bucket = np.int64(table.column("bucket")[0].as_py())
        node, _, key = bucket_rows(table)
        starts = np.flatnonzero(np.diff(key, prepend=np.uint64(2**63))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(key))
        held = ends - starts > 1
        out: list[tuple] = []
        if held.any():
            h1, h2 = (h[held] for h in run_hashes(node, starts))
            starts, ends = starts[held], ends[held]
            band, name = (key[starts] >> np.uint64(32)).astype(np.int64), (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64) | bucket << 32
            order = np.lexsort((h1, band))
            cuts = np.flatnonzero((np.diff(h1[order]) != 0) | (np.diff(band[order]) != 0)) + 1
            for same in np.split(order, cuts):
                i = same[0]
                s, e = starts[i], ends[i]
                out.append((band[i], h1[i], h2[i], 0, name[same], node[s : min(e, s + most)]))
                for part, at in enumerate(range(s + most, e, most), 1):
                    out.append((band[i], h1[i], h2[i], part, name[:0], np.append(node[s], node[at : min(e, at + most)])))
        give_back()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([*[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], lists_of([r[4] for r in out]), lists_of([r[5] for r in out])], names=["band", "h1", "h2", "part", "keys", "nodes"])

    found = packed.groupBy("bucket").applyInArrow(runs, "band int, h1 long, h2 long, part int, keys array<long>, nodes array<long>")
    return found.groupBy("band", "h1", "h2", "part").agg(F.flatten(F.collect_list("keys")).alias("keys"), F.first("nodes").alias("nodes"))


def deletion_runs(packed: DataFrame, most: int) -> DataFrame:
    """Sets that have a key (`left`) and sets that have it once an element is left out (`right`), in blocks of at most `most`."""

    def runs(table: pa.Table) -> pa.Table:
        node, less, key = bucket_rows(table)
        starts = np.flatnonzero(np.diff(key, prepend=np.uint64(2**63))) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(key))
        cut = starts + (np.add.reduceat(less == 0, starts) if len(starts) else 0)
        out = {}
        for i in np.flatnonzero((cut > starts) & (cut < ends)):
            for a in range(starts[i], cut[i], most):
                for b in range(cut[i], ends[i], most):
                    left, right = node[a : min(a + most, cut[i])], node[b : min(b + most, ends[i])]
                    out.setdefault((left.tobytes(), right.tobytes()), (left, right))
        give_back()
        return pa.table([lists_of([r[0] for r in out.values()]), lists_of([r[1] for r in out.values()])], names=["left", "right"])

    return packed.groupBy("bucket").applyInArrow(runs, "left array<long>, right array<long>")


def candidate_links(runs: DataFrame) -> DataFrame:
    """Pairs (a, b) to compare next: in each run, the heaviest set of each component with the heaviest one of the run's most common component.

    `runs` has nodes, labels and weights. A task sends at most three pairs of each set: which are compared first matters for speed only.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for nodes, label, weight in zip(*b.columns, strict=True):
                nodes, label, weight = (np.asarray(x.values) for x in (nodes, label, weight))
                order = np.lexsort((nodes, -weight))
                _, first, counts = np.unique(label[order], return_index=True, return_counts=True)
                heads = nodes[order][first]
                hub = heads[counts.argmax()] if counts.max() > 1 else nodes[order[0]]
                heads = heads[heads != hub]
                left.append(heads)
                right.append(np.full(len(heads), hub))
            if left:
                a, c = np.concatenate(left), np.concatenate(right)
                order = np.lexsort((c, a))
                a, c = a[order], c[order]
                keep = np.ones(len(a), bool)
                keep[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                a, c = a[keep], c[keep]
                starts = np.flatnonzero(np.diff(a, prepend=a[0] - 1) != 0) if len(a) else np.zeros(0, np.int64)
                keep = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))) < 3
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(c[keep])], names=["a", "b"])
        give_back()

    return runs.select("nodes", "labels", "weights").mapInArrow(pairs, "a long, b long").distinct().withColumn("grp", F.col("b"))


class Join:
    """The steps of one join over `docs` (doc_id, text as bytes)."""

    def __init__(self, docs: DataFrame, percent: int = 75, width: int = 5, ratio: float = 1.4, bucket_keys: int = 2_000_000, most: int = 4096):
        self.docs, self.percent, self.width, self.bucket_keys, self.most = docs, percent, width, bucket_keys, most
        self.bands = Bands(percent, ratio)
        self.sets = materialize(with_sets(docs, width, self.bands), "sets")
        classes = self.sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first_doc"), *[F.first(c).alias(c) for c in ("bands", "quotas", "sketch", "fine")])
        self.classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        total = self.sets.agg(F.sum("n")).first()[0] or 0
        self.runs = materialize(live_runs(packed_keys(docs, width, self.bands, parts_for(total, bucket_keys)), most), "runs")
        # A set that shares many keys with many others is near the middle of its group.
        keys = F.greatest(F.size("keys"), F.lit(1))
        self.weights = materialize(self.runs.select(F.explode("nodes").alias("w_node"), (keys * (F.size("nodes") - 1)).cast("double").alias("w")).groupBy("w_node").agg(F.sum("w").alias("weight")), "weights")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs of classes with the nodes of `pairs` (a, b, grp) that sizes and sketches do not rule out, and how far apart their sketches are."""
        side = lambda p: self.classes.select(F.col("s1").alias(f"{p}_s1"), F.col("s2").alias(f"{p}_s2"), F.col("cid").alias(f"{p}_cid"), F.col("n").alias(f"{p}_n"), F.col("first_doc").alias(f"{p}_doc"), F.col("sketch").alias(f"{p}_sketch"))
        met = pairs.join(side("a"), F.col("a") == F.col("a_s1")).join(side("b"), F.col("b") == F.col("b_s1")).where("a_cid <> b_cid").drop("a", "b")
        percent = self.percent

        def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    apart = sketches_apart(bins_of(b.column("a_sketch")), bins_of(b.column("b_sketch")))
                    total = np.asarray(b.column("a_n")) + np.asarray(b.column("b_n"))
                    keep = pa.array(apart <= total - 2 * -(-percent * total // (100 + percent)))
                    yield b.drop_columns(["a_sketch", "b_sketch"]).append_column("apart", pa.array(apart)).filter(keep)
            give_back()

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        columns = [f"{p}_{c} {kind if c == 'doc' else 'long'}" for p in "ab" for c in ("s1", "s2", "cid", "n", "doc")]
        return met.mapInArrow(rule_out, "grp long, " + ", ".join(columns) + ", apart long")

    def verified(self, pairs: DataFrame, each: int = 1_500_000, most: int = 200_000) -> DataFrame:
        """Links (a, b: cid) among pairs of classes from near(), by their sets.

        Each text is sent once to each group of pairs that has it. Groups whose sets have over `each` elements, or of over `most` pairs, are dealt into blocks of pairs.
        """
        pairs = materialize(pairs, "pairs")
        side = lambda p: pairs.select("grp", F.col(f"{p}_cid").alias("cid"), F.col(f"{p}_n").alias("n"))
        elements_of = side("a").unionByName(side("b")).distinct().groupBy("grp").agg(F.sum("n").alias("n"))
        large = elements_of.join(pairs.groupBy("grp").agg(F.count(F.lit(1)).alias("pairs")), "grp").where((F.col("n") > each) | (F.col("pairs") > most))
        large = materialize(large.select(F.col("grp").alias("l_grp"), F.greatest(F.ceil(F.col("n") / each), F.ceil(F.sqrt(2 * F.col("pairs") / most))).alias("blocks")), "large")
        block = lambda p: F.pmod(F.xxhash64(f"{p}_cid"), "blocks").cast("int")
        split = pairs.join(small(large, large.count()), F.col("grp") == F.col("l_grp"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        split = split.withColumn("x", F.least(block("a"), block("b"))).withColumn("y", F.greatest(block("a"), block("b")))
        key = ["grp", "x", "y"]
        named = lambda p: split.select(*key, *[F.col(f"{p}_{c}").alias(d) for c, d in (("doc", "want_id"), ("cid", "cid"), ("s1", "s1"), ("s2", "s2"))])
        wanted = materialize(named("a").unionByName(named("b")).distinct(), "wanted")
        texts = self.docs.join(small(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("want_id"))).select(*key, "cid", "s1", "s2", "text")
        rows = texts.select(*key, F.lit(0).alias("kind"), "cid", "s1", "s2", "text").unionByName(split.select(*key, F.lit(1).alias("kind"), F.col("a_cid").alias("cid"), F.col("b_cid").alias("s1"), F.lit(None).cast("long").alias("s2"), F.lit(None).cast("binary").alias("text")))
        width, percent = self.width, self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, {}
            for b in batches:
                a, c = [], []
                for grp, x, y, kind, cid, s1, s2, text in zip(*(b.column(j).to_pylist() for j in range(7)), b.column(7), strict=True):
                    if at != (grp, x, y):
                        at, held = (grp, x, y), {}
                    if kind == 0:
                        if cid not in held and set_hashes(s := text_set(text.as_py(), width)) == (s1, s2):  # rows may repeat, or other texts have this id
                            held[cid] = s
                        continue
                    s, o = held[cid], held[s1]
                    if len(s) > len(o):
                        s, o = o, s
                    common = int(np.count_nonzero(o[np.minimum(np.searchsorted(o, s), len(o) - 1)] == s))
                    if 100 * common >= percent * (len(s) + len(o) - common):
                        a.append(cid)
                        c.append(s1)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
            give_back()

        return rows.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(compare, "a long, b long").distinct()

    def labels(self, components: DataFrame) -> DataFrame:
        """Components by node, for sets in components of several; a node that two sets share by chance has none, so that its pairs are all compared."""
        classes = self.classes.select(F.col("cid").alias("vertex"), F.col("s1").alias("l_node"))
        held = classes.join(components, "vertex", "left").groupBy("l_node").agg(F.count(F.lit(1)).alias("sets"), F.min("component").alias("label"))
        return held.where("sets = 1 AND label IS NOT NULL").select("l_node", "label")

    def open_runs(self, runs: DataFrame, labels: DataFrame | None) -> DataFrame:
        """All parts of runs whose sets are not all in one component, with lists beside the nodes: labels (the component's, or for a set by itself its node) and weights."""
        facts = self.weights
        if labels is not None:
            # A component goes by its hash, so that it and a set by itself, which goes by its node, can be told apart.
            facts = facts.join(labels.select("l_node", F.xxhash64(F.lit("component"), "label").alias("label")), F.col("w_node") == F.col("l_node"), "left").drop("l_node")
        else:
            facts = facts.withColumn("label", F.lit(None).cast("long"))
        run = ["band", "h1", "h2"]
        rows = runs.select(*run, "part", F.explode("nodes").alias("node")).join(facts, F.col("node") == F.col("w_node")).withColumn("label", F.coalesce("label", "node"))
        sets = rows.groupBy(*run, "part").agg(F.collect_list(F.struct("node", "label", "weight")).alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
        is_open = F.col("low") != F.col("high")
        long = runs.where("part > 0").select(*run).distinct()
        n = long.count()
        if n:
            # A part in one component stays if another part of its run is in a second one.
            whole = rows.join(small(long, n), run, "left_semi").groupBy(*run).agg(F.min("label").alias("least"), F.max("label").alias("greatest"))
            sets = sets.join(small(whole.where("least <> greatest").select(*run, F.lit(True).alias("divided")), n), run, "left")
            is_open = is_open | F.col("divided").isNotNull()
        kept = sets.where(is_open).select(*run, "part", F.col("sets.node").alias("nodes"), F.col("sets.label").alias("labels"), F.col("sets.weight").alias("weights"))
        return kept.join(runs.select(*run, "part", "keys"), [*run, "part"])

    def skippers(self, runs: DataFrame, hot: int, key_cost: float) -> DataFrame:
        """Sets that find their links through one-deletion neighbourhoods in a band: node, band, skipped (keys).

        A key is hot if sets of more than `hot` components share it. A set may skip its hot keys if they are within its quota, and does so if
        that spares it more comparisons (its hot keys are mostly of the same sets) than `key_cost` for each element, whose neighbour is to be sent.
        """
        components = F.size(F.array_distinct("labels"))
        shared = runs.groupBy("band", "h1", "h2").agg(F.sum(components).alias("components"), F.max(F.when(F.col("part") == 0, F.col("keys"))).alias("keys")).where(F.col("components") > hot)
        members = runs.select("band", "h1", "h2", F.explode("nodes").alias("node")).distinct().join(shared, ["band", "h1", "h2"])
        by_set = members.groupBy("node", "band").agg(F.flatten(F.collect_list("keys")).alias("skipped"), F.max("components").alias("spared"))
        only = self.classes.groupBy("s1").agg(F.count(F.lit(1)).alias("sets"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("quotas").alias("quotas")).where("sets = 1")
        quota = F.element_at("quotas", F.array_position("bands", F.col("band")).cast("int"))
        return by_set.join(only, F.col("node") == F.col("s1")).where((F.size("skipped") <= quota) & (F.col("spared") > key_cost * F.col("n"))).select("node", "band", "skipped")

    def neighbour_runs(self, skippers: DataFrame, rows: int) -> DataFrame:
        """Blocks (left, right) of skippers that agree, less one element of the right, in a segment that neither skips."""
        asks = skippers.groupBy("node").agg(F.collect_list(F.struct("band", "skipped")).alias("asks"))
        one = self.classes.select(F.col("s1").alias("c_node"), F.col("s2").alias("c_s2"), F.col("first_doc").alias("want_id"), "n")
        asks = materialize(asks.join(one, F.col("node") == F.col("c_node")), "asks")
        total = asks.agg(F.sum(F.col("n") * F.size("asks"))).first()[0] or 0
        buckets, width, bands = parts_for(2 * total, self.bucket_keys), self.width, self.bands
        found = self.docs.join(small(asks, rows, 100_000), F.col("doc_id").eqNullSafe(F.col("want_id"))).select("node", "c_s2", "asks", "text")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                packer = Packer(buckets)
                for node, s2, own, text in zip(*(b.column(j).to_pylist() for j in range(3)), b.column(3), strict=True):
                    s = text_set(text.as_py(), width)
                    if set_hashes(s) != (node, s2):
                        continue  # another text of this id
                    element = elements(s)
                    by_number = {band.number: band for band in bands.of(len(s))}
                    for ask in own:
                        band, skipped = by_number[ask["band"]], np.array(ask["skipped"], np.int64)
                        every = band.keys(s, element)
                        named = (every & np.uint64(0xFFFFFFFF)).astype(np.int64) | bucket_of(every, base).astype(np.int64) << 32
                        whole, less = band.neighbourhood(s, element, every[np.isin(named, skipped)])
                        packer.add(node, band, False, whole)
                        packer.add(node, band, True, less)
                    yield from packer.flush(1_000_000)
                yield from packer.flush(0)
            give_back()

        base = parts_for(self.sets.agg(F.sum("n")).first()[0] or 0, self.bucket_keys)
        return deletion_runs(found.mapInArrow(pack, Packer.SCHEMA), self.most)


def blocks_of(join: Join, runs: DataFrame, hot: int, key_cost: float) -> DataFrame:
    """Blocks (anchor, left, right) such that each pair of open runs to compare is one of a left and a right set in one block; without right, of two left ones.

    Runs of one anchor, their heaviest set, have most of their sets in common. In a run of a hot key, sets that skip it meet the others only;
    they meet each other in their neighbourhoods.
    """
    run = ["band", "h1", "h2"]
    heaviest = F.array_max(F.arrays_zip(F.col("weights").alias("w"), F.col("nodes").alias("n")))["n"]
    parts = runs.select(*run, "part", "nodes", heaviest.alias("anchor"))
    skippers = materialize(join.skippers(runs, hot, key_cost), "skippers")
    n = skippers.count()
    if n:
        keys = skippers.select("node", "band", F.lit(True).alias("skips"))
        hot_runs = runs.groupBy(*run).agg(F.sum(F.size(F.array_distinct("labels"))).alias("components")).where(F.col("components") > hot).select(*run)
        members = runs.join(hot_runs, run, "left_semi").select(*run, "part", F.explode("nodes").alias("node")).join(small(keys, n), ["node", "band"], "left")
        keepers = members.groupBy(*run, "part").agg(F.collect_list(F.when(F.col("skips").isNull(), F.col("node"))).alias("keepers"))
        parts = parts.join(keepers, [*run, "part"], "left")
    else:
        parts = parts.withColumn("keepers", F.lit(None).cast("array<long>"))
    parts = parts.select(*run, "part", "anchor", "nodes", F.coalesce("keepers", "nodes").alias("left"), F.when(F.size("keepers") < F.size("nodes"), F.col("nodes")).alias("right"))
    out = parts.where(F.size("left") > 0).select("anchor", "left", "right")
    if runs.where("part > 0").limit(1).count():
        met = parts.alias("x").join(parts.alias("y"), run).where("x.part <> y.part AND size(x.left) > 0 AND (x.part < y.part OR x.right IS NOT NULL OR y.right IS NOT NULL)")
        out = out.unionByName(met.select(F.col("x.anchor").alias("anchor"), F.col("x.left").alias("left"), F.col("y.nodes").alias("right")))
    if n:
        out = out.unionByName(join.neighbour_runs(skippers, n).select(F.element_at("left", 1).alias("anchor"), "left", "right"))
    return out


class Meeting:
    """Members (node, n, label, sketch, fine) of some groups of blocks, ordered by group and node, and the filter of their pairs."""

    def __init__(self, members: pa.Table, groups: np.ndarray, percent: int):
        self.codes, place = np.unique(np.asarray(members.column("node")), return_inverse=True)
        at = groups.astype(np.int64) << 32 | place
        order = np.argsort(at)
        self.at, self.percent = at[order], percent
        members = members.take(pa.array(order))
        self.node, self.label = np.asarray(members.column("node")), np.asarray(members.column("label"))
        sketch = members.column("sketch").combine_chunks()
        self.unsure = np.asarray(sketch.is_null())  # two sets of one hash
        self.n = np.asarray(members.column("n"))
        self.bins = bins_of(sketch.fill_null(b"\0" * 128)) if len(self.node) else np.zeros((0, 128), np.uint8)
        self.fine = members.column("fine").combine_chunks()
        #: Bins of the fine sketches as powers of two; 0 without one.
        self.bits = np.where(np.asarray(self.fine.is_valid()), np.log2(np.maximum(np.asarray(pc.fill_null(pc.binary_length(self.fine), 1)), 1)).astype(np.int64), 0)
        coarse = self.bins.reshape(-1, 32, 4).sum(axis=2, dtype=np.int32)
        self.coarse = coarse.astype(np.uint8) if coarse.size and coarse.max() < 256 else coarse

    def find(self, groups: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, groups.astype(np.int64) << 32 | np.searchsorted(self.codes, nodes))

    def nodes(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.node[i], self.node[j]
        return np.minimum(a, b), np.maximum(a, b)

    def kept(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of members (i, j) that are in different components and may link, and which they are."""
        n, unsure = self.n, self.unsure
        total = n[i] + n[j]
        bound = total - 2 * -(-self.percent * total // (100 + self.percent))
        free = unsure[i] | unsure[j]
        keep = (self.label[i] != self.label[j]) & (free | (np.abs(n[i] - n[j]) <= bound))
        at = np.flatnonzero(keep)
        i, j, bound, free = i[keep], j[keep], bound[keep], free[keep]
        for fine in (self.coarse, self.bins):  # the coarse ones rule most pairs out at a quarter of the cost
            keep = free.copy()
            for a in range(0, len(i), 50_000):
                part = slice(a, a + 50_000)
                keep[part] |= sketches_apart(fine[i[part]], fine[j[part]]) <= bound[part]
            i, j, bound, free, at = i[keep], j[keep], bound[keep], free[keep], at[keep]
        keep = np.ones(len(i), bool)
        bits = np.minimum(self.bits[i], self.bits[j])
        for level in np.unique(bits[(bits > 0) & ~free]):
            todo = np.flatnonzero((bits == level) & ~free)
            for a in range(0, len(todo), max(1, 8_000_000 >> level)):
                part = todo[a : a + max(1, 8_000_000 >> level)]
                own, place = np.unique(np.concatenate([i[part], j[part]]), return_inverse=True)
                sketch = np.stack([folded(x.as_py(), 1 << level) for x in self.fine.take(pa.array(own))])
                for b in range(0, len(part), max(1, 2_000_000 >> level)):
                    c = slice(b, b + max(1, 2_000_000 >> level))
                    keep[part[c]] = sketches_apart(sketch[place[: len(part)][c]], sketch[place[len(part) :][c]]) <= bound[part[c]]
        return i[keep], j[keep], at[keep]

    def by_list(self, blocks: list[tuple[np.ndarray, np.ndarray | None, np.int64]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some small blocks (members' places, and the group's name): the pairs and the group of each."""
        pairs, names = [], []
        for left, right, name in blocks:
            if right is None:
                i, j = np.triu_indices(len(left), 1)
                pairs.append(left[i] << 32 | left[j])
            else:
                pairs.append((np.minimum(left[:, None], right) << 32 | np.maximum(left[:, None], right)).ravel())
            names.append(np.full(len(pairs[-1]), name))
        pairs, first = np.unique(np.concatenate(pairs), return_index=True)
        i, j, name = pairs >> 32, pairs & 0xFFFFFFFF, np.concatenate(names)[first]
        apart = i != j
        i, j, kept = self.kept(i[apart], j[apart])
        return *self.nodes(i, j), name[apart][kept]

    def by_matrix(self, blocks: list[tuple[np.ndarray, np.ndarray | None]], rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of blocks that have most members in common: each pair once."""
        own = np.unique(np.concatenate([x for b in blocks for x in b if x is not None]))
        met = np.zeros((len(own), len(own)), bool)
        for left, right in blocks:
            a = np.searchsorted(own, left)
            b = a if right is None else np.searchsorted(own, right)
            met[np.ix_(a, b)] = True
            if right is not None:
                met[np.ix_(b, a)] = True
        for at in range(0, len(own), rows):
            i, j = np.nonzero(met[at : at + rows])
            i += at
            i, j, _ = self.kept(own[i[i < j]], own[j[i < j]])
            yield self.nodes(i, j)


def close_pairs(join: Join, blocks: DataFrame, labels: DataFrame, group_sets: int = 100_000, few: int = 1_000_000) -> DataFrame:
    """All pairs of nodes (a, b; grp: a group of blocks that has both) that a block puts together, are in different components and may link by their sizes and sketches.

    Each set goes once to each group of blocks: those of one anchor, or some of them, if they hold over `group_sets` sets. Within a group a pair is looked at
    once, however many blocks have it; only pairs that may link leave the task.
    """
    percent = join.percent
    blocks = materialize(blocks.withColumn("id", F.monotonically_increasing_id()).withColumn("sets", F.size("left") + F.coalesce(F.size("right"), F.lit(0))), "blocks")
    large = materialize(blocks.groupBy("anchor").agg(F.sum("sets").alias("sets")).where(F.col("sets") > group_sets).select(F.col("anchor").alias("l_anchor"), F.ceil(F.col("sets") / group_sets).alias("groups")), "large")
    dealt = blocks.join(small(large, large.count()), F.col("anchor") == F.col("l_anchor"), "left").withColumn("salt", F.pmod("id", F.coalesce("groups", F.lit(1))).cast("int"))
    facts = join.classes.groupBy("s1").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("fine").alias("fine"), F.count(F.lit(1)).alias("same"))
    # Sets whose hashes are equal by chance are told apart only when they are compared.
    facts = facts.select(F.col("s1").alias("s_node"), "n", *[F.when(F.col("same") == 1, F.col(c)).alias(c) for c in ("sketch", "fine")]).join(labels, F.col("s_node") == F.col("l_node"), "left")
    facts = facts.select("s_node", "n", F.when(F.col("label").isNotNull(), F.xxhash64(F.lit("component"), "label")).otherwise(F.col("s_node")).alias("label"), "sketch", "fine")
    group = ["anchor", "salt"]
    members = dealt.select(*group, F.explode(F.array_union("left", F.coalesce("right", F.array().cast("array<long>")))).alias("node")).distinct().join(facts, F.col("node") == F.col("s_node"))
    none = F.lit(None).cast("array<long>")
    rows = members.select(*group, F.lit(0).alias("kind"), "node", "n", "label", "sketch", "fine", none.alias("left"), none.alias("right"))
    zero = F.lit(None).cast("long")
    rows = rows.unionByName(dealt.select(*group, F.lit(1).alias("kind"), zero.alias("node"), zero.alias("n"), zero.alias("label"), F.lit(None).cast("binary").alias("sketch"), F.lit(None).cast("binary").alias("fine"), "left", "right"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.int64)])
            if carry and (key[0] != last).any():
                yield from compare(pa.Table.from_batches(carry))
                carry = []
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from compare(pa.Table.from_batches([*carry, b.slice(0, cut)]))
                carry = []
            carry.append(b.slice(cut))
            last = key[-1]
        if carry:
            yield from compare(pa.Table.from_batches(carry))
        give_back()

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, salt = np.asarray(table.column("anchor")), np.asarray(table.column("salt"))
        groups = np.cumsum(np.append(0, (np.diff(anchor) != 0) | (np.diff(salt) != 0)))
        is_set = np.asarray(table.column("kind")) == 0
        meeting = Meeting(table.filter(pa.array(is_set)), groups[is_set], percent)
        found = table.select(["left", "right"]).filter(pa.array(~is_set))
        places = []
        for column in ("left", "right"):
            c = found.column(column).combine_chunks()
            lengths = np.asarray(c.value_lengths().fill_null(0))
            values = meeting.find(np.repeat(groups[~is_set], lengths), np.asarray(c.flatten()))
            places.append(np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else [])
        alone = np.asarray(found.column("right").combine_chunks().is_null()) if found.num_rows else []
        blocks = list(zip(places[0], [None if x else p for x, p in zip(alone, places[1], strict=True)], strict=True))
        name = mixed(anchor[~is_set].view(np.uint64) + salt[~is_set].astype(np.uint64)).view(np.int64)
        costs = np.array([len(a) * (len(a) if b is None else len(b)) for a, b in blocks], np.int64)
        starts = np.flatnonzero(np.diff(groups[~is_set], prepend=-1))
        held: list = []
        size = 0
        for start, end in zip(starts, np.append(starts[1:], len(blocks)), strict=True):
            cost = costs[start:end].sum()
            if cost > few:
                for own in bounded(blocks[start:end]):
                    for pairs in meeting.by_matrix(own):
                        yield batch(*pairs, np.full(len(pairs[0]), name[start]))
                continue
            held += [(*x, name[start]) for x in blocks[start:end]]
            size += cost
            if size > few:
                yield batch(*meeting.by_list(held))
                held, size = [], 0
        if held:
            yield batch(*meeting.by_list(held))

    def bounded(blocks: list, most: int = 6_000) -> Iterator[list]:
        """Blocks with at most `most` members together, or one block."""
        out: list = []
        own = np.zeros(0, np.int64)
        for block in sorted(blocks, key=lambda b: -len(b[0])):
            more = np.union1d(own, np.concatenate([x for x in block if x is not None]))
            if out and len(more) > most:
                yield out
                out, more = [], np.unique(np.concatenate([x for x in block if x is not None]))
            out.append(block)
            own = more
        if out:
            yield out

    def batch(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "grp"])

    return rows.repartition(*group).sortWithinPartitions(*group, "kind").mapInArrow(meet, "a long, b long, grp long").groupBy("a", "b").agg(F.min("grp").alias("grp"))


def link_documents(docs: DataFrame, percent: int = 75, width: int = 5, rounds: int = 2, ratio: float = 1.4, hot: int = 256, key_cost: float = 4.0, bucket_keys: int = 2_000_000, most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that links connect: id, n_shingles, component_id.

    Two rows link if 100 * intersection >= percent * union of their sets of `width`-word shingles. component_id is the smallest id
    of a row reachable by links, the row's own included. Every row counts by itself: rows may repeat or share ids; a null id is never the
    smallest, and the component is null if no row of it has an id. Null texts and texts without words have no shingles, link with
    nothing and keep their own id. Other columns of `docs`, whatever their names, play no part; an empty table gives an empty one. Every link counts: the result is exact.

    Rows with equal sets are one class. Keys of all sets are exchanged in packed form; sets that share a key are a run. For `rounds` rounds, each
    run compares one set of each component with the heaviest of its most common component, and links are merged into components; groups of
    copies, however large, are settled by about as many comparisons as they have members. Of what runs are still divided, keys that more than `hot`
    components share are skipped by the sets for which their one-deletion neighbourhoods cost less (`key_cost` comparisons for each element). What is left is looked
    at pair by pair in blocks, behind a bound from sketches, and compared. Runs of over `most` sets are held in parts.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    join = Join(docs, percent, width, ratio, bucket_keys, most)
    links, labels = None, None
    runs = materialize(join.open_runs(join.runs, None), "open")
    for _ in range(rounds):
        # Of the pairs that sketches leave, the nearest of each set is compared.
        near = join.near(candidate_links(runs))
        best = near.groupBy("a_cid").agg(F.min_by(F.struct(*near.columns), F.struct("apart", "b_cid")).alias("p")).select("p.*")
        found = join.verified(best)
        links = materialize(links.unionByName(found) if links is not None else found, "links")
        labels = materialize(join.labels(connected_components(links)), "labels")
        runs = materialize(join.open_runs(join.runs, labels), "open")
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "l_node long, label long")
    last = join.verified(join.near(close_pairs(join, blocks_of(join, runs, hot, key_cost), labels)))
    components = connected_components(links.unionByName(last) if links is not None else last)
    grouped = join.classes.join(components.withColumnRenamed("vertex", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_class = grouped.join(smallest, "component").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "component_id")
    sets = join.sets.select("doc_id", "n", "s1", "s2")
    known = sets.where("n > 0").join(by_class, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))).select("doc_id", "n", "component_id")
    out = known.union(sets.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with one document of each group that link_documents() finds: that of the smallest id.

    Of rows with this id and one text, one stays. Rows whose group has no id all stay, as no id tells which to keep.
    """
    groups = materialize(link_documents(docs, **options), "groups")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    n, ids = kept.where("doc_id is not null").agg(F.count(F.lit(1)), F.countDistinct("doc_id")).first()
    out = docs.join(small(kept.select(F.col("doc_id").alias("kept_id")).distinct(), ids), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    if n == ids:
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id is null"))
