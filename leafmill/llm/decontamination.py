"""Benchmark decontamination: a BM25 index of test items, queried with every passage by block-max WAND, then overlap checks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import give_back, materialize, pieces

WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"[.?!\n]+\s*")
#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Cells of the table of block bounds at most; blocks get larger beyond.
CELLS = 20_000_000


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words before and after its last question mark that has words on both sides, or else before and in its last sentence; the answer is empty if there is one sentence."""
    cuts = [m.end() for m in re.finditer(r"\?", text)] or [m.end() for m in SENTENCE_END.finditer(text)]
    for cut in reversed(cuts):
        question, answer = words(text[:cut]), words(text[cut:])
        if question and answer:
            return question, answer
    return words(text), []


def overlap(part: list[str], passage: list[str], width: int = 3) -> float:
    """Share of the part's distinct runs of `width` words (of all its words, if fewer) that the passage has; 1 for an empty part."""
    if not part:
        return 1.0
    width = min(width, len(part))
    runs = lambda w: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    wanted = runs(part)
    return len(wanted & runs(passage)) / len(wanted)


class Index:
    """Postings of test items by term, with weights that sum to 1 for each item: BM25 over the item's score against itself.

    `known` has the number of all items, their mean length and the number of items by term, if `items` are some of them.
    """

    def __init__(self, items: list[tuple[object, str]], block: int = 4, known: tuple[int, float, dict[str, int]] | None = None):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        texts = [q + a for q, a in self.parts]
        self.longest = max(map(len, texts), default=0)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        counts = [defaultdict(int) for _ in texts]
        for c, t in zip(counts, texts, strict=True):
            for w in t:
                c[w] += 1
        held = defaultdict(int)
        for c in counts:
            for w in c:
                held[w] += 1
        every, mean = len(texts), sum(map(len, texts)) / max(1, len(texts))
        if known:
            every, mean, held = known
        for i, c in enumerate(counts):
            own = {w: np.log1p((every - held[w] + 0.5) / (held[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(texts[i]) / mean)) for w, n in c.items()}
            total = sum(own.values())
            for w, x in own.items():
                postings[w].append((i, x / total))
        self.terms = {w: k for k, w in enumerate(postings)}
        while len(self.terms) * -(-len(items) // block) > CELLS:
            block *= 2
        self.block = block
        self.items = [[i for i, _ in p] for p in postings.values()]
        self.weights = [[x for _, x in p] for p in postings.values()]
        self.most = [max(w) for w in self.weights]
        #: The largest weight of each term in each block of items: bounds of the block-max step, also summed at once for many passages.
        self.bounds = np.zeros((len(self.terms), -(-len(items) // block)), np.float32)
        for t, p in enumerate(postings.values()):
            for i, x in p:
                self.bounds[t, i // block] = max(self.bounds[t, i // block], x)

    def block_max_wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items whose score with the query terms reaches the threshold.

        Lists stand at their next item. The pivot is the first list at which the terms' largest weights reach the threshold: no item before it
        can. If the blocks' largest weights can't reach it either, all lists skip to the end of that block of items.
        """
        at = {t: 0 for t in terms}
        out = []
        low = threshold - 1e-6
        while True:
            open_lists = sorted((self.items[t][p], t) for t, p in at.items() if p < len(self.items[t]))
            bound, pivot = 0.0, None
            for item, t in open_lists:
                bound += self.most[t]
                if bound >= low:
                    pivot = item
                    break
            if pivot is None:
                return out
            block = pivot // self.block
            here = [t for item, t in open_lists if item < (block + 1) * self.block]
            if sum(float(self.bounds[t, block]) for t in here) < low:
                to = (block + 1) * self.block
            else:
                score = 0.0
                for item, t in open_lists:
                    if item > pivot:
                        break
                    self._skip(at, t, pivot)
                    if at[t] < len(self.items[t]) and self.items[t][at[t]] == pivot:
                        score += self.weights[t][at[t]]
                if score >= low:
                    out.append((pivot, score))
                to = pivot + 1
            for item, t in open_lists:
                if item >= to:
                    break
                self._skip(at, t, to)

    def _skip(self, at: dict[int, int], t: int, item: int) -> None:
        held, p = self.items[t], at[t]
        while p < len(held) and held[p] < item:
            p += 1
        at[t] = p

    def search(self, texts: list[list[str]], threshold: float, least_overlap: float) -> list[dict[int, tuple[float, float, float, int]]]:
        """For each text: by item, (score, question overlap, answer overlap, first word of the passage) of its best verified passage."""
        out: list[dict[int, tuple[float, float, float, int]]] = [{} for _ in texts]
        stride = max(64, self.longest)
        lengths = np.array([len(t) for t in texts], np.int64)
        known = np.fromiter((k for t in texts for k in map(self.terms.get, t, repeat(-1))), np.int64, int(lengths.sum()))
        doc = np.repeat(np.arange(len(texts)), lengths)
        place = np.arange(len(known)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = known >= 0
        if not keep.any():
            return out
        # Passages of two strides, a stride apart: any span of an item's length lies in one whole. Passage j has the strides j and j + 1.
        per_doc = lengths // stride + 2
        first = np.cumsum(per_doc) - per_doc
        passage = (first[doc] + place // stride)[keep]
        pairs = np.unique(np.concatenate([passage * len(self.terms) + known[keep], (passage + 1) * len(self.terms) + known[keep]]))
        where, term = pairs // len(self.terms), pairs % len(self.terms)
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        bounds = np.add.reduceat(self.bounds[term], starts, axis=0).max(axis=1)
        ends = np.append(starts[1:], len(pairs))
        for k in np.flatnonzero(bounds >= threshold - 1e-4):
            found = self.block_max_wand(term[starts[k] : ends[k]].tolist(), threshold)
            if found:
                d = int(np.searchsorted(first, where[starts[k]], side="right") - 1)
                begin = max(0, int(where[starts[k]] - first[d] - 1) * stride)
                own = texts[d][begin : begin + 2 * stride]
                for item, score in found:
                    q, a = (overlap(p, own) for p in self.parts[item])
                    if min(q, a) >= least_overlap and (item not in out[d] or out[d][item][0] < score):
                        out[d][item] = (score, q, a, begin)
        return out


def indexes(items: DataFrame, block_items: int = 20_000, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of all items in blocks of about `block_items`, so that what a task gets is bounded; items without words are left out.

    Scores don't depend on the blocks: numbers of items by term, and of all items, are counted over all of them.
    """
    items = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike(r"\w"))
    n = items.count()
    blocks = max(1, -(-n // block_items))
    of_block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int")
    if blocks == 1:
        if n:
            yield Index([(r["i"], r["t"]) for r in items.orderBy("i", "t").collect()])
        return

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            texts = [words(t) for t in b.column(1).to_pylist()]
            found = [(block, w, len(t)) for block, t in zip(b.column(0).to_pylist(), texts, strict=True) for w in dict.fromkeys(t)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())], names=["block", "term"])
            yield pa.RecordBatch.from_arrays([pa.array([len(t) for t in texts], pa.int32()), pa.nulls(len(texts), pa.string())], names=["block", "term"])

    counted = materialize(items.select(of_block.alias("block"), "t").mapInArrow(terms, "block int, term string").groupBy("block", "term").count(), "terms")
    lengths = counted.where("term is null").agg(F.sum(F.col("block") * F.col("count"))).first()[0]
    counted = counted.where("term is not null")
    held = counted.join(counted.groupBy("term").agg(F.sum("count").alias("items")), "term")
    for k in range(blocks):
        own = items.where(of_block == k).orderBy("i", "t").collect()
        if own:
            yield Index([(r["i"], r["t"]) for r in own], known=(n, lengths / n, {r["term"]: r["items"] for r in held.where(F.col("block") == k).select("term", "items").collect()}))


def grouped(batch: pa.RecordBatch, column: int, most: int = 400_000) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Rows of a batch and their words, in groups of at most `most` characters or one row."""
    rows: list[int] = []
    texts: list[list[str]] = []
    size = 0
    for i, x in enumerate(batch.column(column)):
        t = x.as_py() or ""
        if rows and size + len(t) > most:
            yield rows, texts
            rows, texts, size = [], [], 0
        rows.append(i)
        texts.append(words(t))
        size += len(t)
    if rows:
        yield rows, texts


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least_overlap: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Benchmark items that documents hold: id, item_id, score, question_overlap, answer_overlap, start_word.

    Every whole text is cut into overlapping passages, and each passage queries the index of all items. A hit scores at least `threshold` of the
    item's own BM25 score, and has at least `least_overlap` of the word trigrams of its question and of its answer. One row for each
    document and item, with its best passage. Null and empty texts, and items without words, hit nothing; ids may be
    null or repeated, and each row of `docs` is searched by itself. No shuffle; an index block and a few texts are in memory.
    """
    id_type = docs.schema[id_col].dataType
    item_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("item_id", item_type), *[T.StructField(n, T.DoubleType()) for n in ("score", "question_overlap", "answer_overlap")], T.StructField("start_word", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1):
                hits = [(rows[k], item, *x) for rows, texts in grouped(b, 1) for k, found in enumerate(index.search(texts, threshold, least_overlap)) for item, x in found.items()]
                ids = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                item_ids = pa.array([index.ids[h[1]] for h in hits], to_arrow_type(item_type))
                yield pa.RecordBatch.from_arrays([ids, item_ids, *[pa.array([h[j] for h in hits], pa.float64()) for j in (2, 3, 4)], pa.array([h[5] for h in hits], pa.int64())], names=[id_col, "item_id", "score", "question_overlap", "answer_overlap", "start_word"])
            give_back()

        out = out.unionByName(docs.select(id_col, text_col).mapInArrow(search, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least_overlap: float = 0.6, text_col: str = "text") -> DataFrame:
    """`docs` without the rows in which find_leaks() would find an item; all columns stay."""
    for index in indexes(items):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, text_col):
                column = b.schema.get_field_index(text_col)
                keep = [not found for rows, texts in grouped(b, column) for found in index.search(texts, threshold, least_overlap)]
                yield b.filter(pa.array(keep, pa.bool_()))
            give_back()

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
