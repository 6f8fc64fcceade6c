"""Aligning two tokenizers over the same bytes by merge-path partitioning, and counting which of their tokens meet over the whole corpus."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, packed, pieces, unpacked
from .token_counts import TOKENIZERS, default_pattern

#: Beyond these code points, versions of Unicode may class characters differently.
_OTHER = re.compile("[^\x00-\u024f]")


class Vocabulary:
    """Bytes of ids."""

    def __init__(self, table: list[bytes]):
        self.bytes = table
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def give(self, ids: list[np.ndarray], data: list[bytes]) -> np.ndarray:
        """Which of `data` the ids stand for, byte for byte."""
        fine = np.array([self.lengths[x].sum() == len(d) for x, d in zip(ids, data, strict=True)], bool)
        for i in np.flatnonzero(fine):
            size = self.lengths[ids[i]]
            at = np.repeat(self.starts[ids[i]] - (np.cumsum(size) - size), size) + np.arange(len(data[i]))
            fine[i] = np.array_equal(self.flat[at], np.frombuffer(data[i], np.uint8))
        return fine


class BytePieces(Vocabulary):
    """A byte-level BPE tokenizer file. With the same vocabulary as ranks, texts of Latin letters are encoded through those, which is faster and gives the same ids."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True  # their strings in a text are ordinary text
        self.quick = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=table, special_tokens={})
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves; the others follow from U+0100
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            table[i] = bytes(letters[c] for c in piece)
        super().__init__(table)

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None and not _OTHER.search(text):
            return self.quick.encode_to_numpy(" " + text, disallowed_special=())
        return np.array(self.slow.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.uint32)


class SentencePieces(Vocabulary):
    """A sentencepiece model with byte fallback; it puts the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__([self._bytes(i) for i in range(self.model.get_piece_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


def diagonal_splits(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of sorted `a` are among the first d of the merge of sorted `a` and `b` (equal ones: a's first), for each d of `diagonals`, by binary search along each diagonal."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at, other = np.where(open_, mid, 0), np.where(open_, diagonals - 1 - mid, 0)
        first = a[at] <= b[other]
        low = np.where(open_ & first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return low


def merge_pieces(a: np.ndarray, b: np.ndarray, work: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Merges two strictly increasing arrays by merge path: (counts of a, counts of b) up to and with each value that both hold.

    Diagonals `work` apart cut the merge into pieces of equal work, each found by binary search and independent of the others. The pieces are merged in lockstep, one
    lane for each. A piece emits its common values (a's comes just before b's); one whose two halves fall on both sides of a cut is stitched afterwards.
    """
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(0, total, work)
    i = diagonal_splits(a, b, starts)
    j = starts - i
    far = max(int(a[-1]), int(b[-1])) + 1
    a, b = np.append(a, far), np.append(b, far)
    from_a = np.zeros((work, len(starts)), bool)
    common = np.zeros((work, len(starts)), bool)
    last = np.full(len(starts), -1, np.int64)
    first_taken = np.minimum(a[i], b[j])
    for step in range(work):
        x, y = a[i], b[j]
        left = x <= y
        taken = np.where(left, x, y)
        from_a[step] = left
        common[step] = taken == last
        last = taken
        i += left
        j += ~left
        np.minimum(i, len(a) - 1, out=i)  # only the last piece runs beyond the ends, on values that are cut off below
        np.minimum(j, len(b) - 1, out=j)
    common[0, 1:] |= first_taken[1:] == last[:-1]  # stitches
    ends = np.flatnonzero(common.T.ravel()[:total])
    upto_a = np.cumsum(from_a.T.ravel()[:total])[ends]
    return upto_a, ends + 1 - upto_a


class Aligned:
    """Texts of one chunk under both tokenizers. Tokens of texts whose bytes both give back stand one text after the other; `a_cuts`, `b_cuts` count them up to the end of each group."""

    def __init__(self, texts: list[str | None], a: BytePieces, b: SentencePieces, work: int):
        empty = np.zeros(0, np.uint32)
        sides = [[v.encode(t) if t else empty for t in texts] for v in (a, b)]
        data = [b" " + t.encode() if t else b"" for t in texts]
        fine = a.give(sides[0], data) & b.give(sides[1], data)
        sides = [[x if ok else empty for x, ok in zip(s, fine, strict=True)] for s in sides]
        self.n_a, self.n_b = (np.array([len(x) for x in s], np.int64) for s in sides)
        self.a_ids, self.b_ids = (np.concatenate([empty, *s]).astype(np.int64) for s in sides)
        self.a_cuts, self.b_cuts = merge_pieces(np.cumsum(a.lengths[self.a_ids]), np.cumsum(b.lengths[self.b_ids]), work)
        # Every text ends at a common end, so no group crosses texts.
        self.a_upto, self.b_upto = np.cumsum(self.n_a), np.cumsum(self.n_b)
        self.g_upto = np.searchsorted(self.a_cuts, self.a_upto, side="right")
        self.g_from = np.append(0, self.g_upto[:-1])


def _starts(cuts: np.ndarray) -> np.ndarray:
    return np.append(0, cuts[:-1]) if len(cuts) else cuts


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, repeated `counts` times: the row, and 0, 1, ... within it."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def linked_ids(c: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, id of A, id of B, links) whose links add up to all pairs of occurrences in one group.

    Where a group has one token of a side, its pairs are as many as its tokens. In other groups equal ids are counted first, so repeats of a few tokens make a few rows.
    """
    a_size, b_size = np.diff(c.a_cuts, prepend=0), np.diff(c.b_cuts, prepend=0)
    a_group, b_group = np.repeat(np.arange(len(a_size)), a_size), np.repeat(np.arange(len(b_size)), b_size)
    one_a = np.flatnonzero(a_size[b_group] == 1)
    one_b = np.flatnonzero((b_size[a_group] == 1) & (a_size[a_group] > 1))
    a_start, b_start = _starts(c.a_cuts), _starts(c.b_cuts)
    groups = [b_group[one_a], a_group[one_b]]
    left = [c.a_ids[a_start[b_group[one_a]]], c.a_ids[one_b]]
    right = [c.b_ids[one_a], c.b_ids[b_start[a_group[one_b]]]]
    times = [np.ones(len(one_a) + len(one_b), np.int64)]
    many = (a_size > 1) & (b_size > 1)
    x, nx = np.unique(a_group[many[a_group]] << 32 | c.a_ids[many[a_group]], return_counts=True)
    y, ny = np.unique(b_group[many[b_group]] << 32 | c.b_ids[many[b_group]], return_counts=True)
    y_start = np.searchsorted(y, x >> 32 << 32)
    row, k = _spread(np.searchsorted(y, ((x >> 32) + 1) << 32) - y_start)
    other = y_start[row] + k
    mask = (1 << 32) - 1
    return np.concatenate([*groups, x[row] >> 32]), np.concatenate([*left, x[row] & mask]), np.concatenate([*right, y[other] & mask]), np.concatenate([*times, nx[row] * ny[other]])


class Digester:
    """Fingerprints of groups, `a1,a2|b1;a3|b2,b3`, through the texts of ids with the sign that follows them."""

    def __init__(self, n_a: int, n_b: int):
        self.signs = [f"{i}{s}".encode() for i in range(n_a) for s in ",|"] + [f"{i}{s}".encode() for i in range(n_b) for s in ",;"]
        self.shift = 2 * n_a

    def of(self, c: Aligned) -> list[str]:
        a_start, b_start = _starts(c.a_cuts), _starts(c.b_cuts)
        a_last, b_last = np.zeros(len(c.a_ids), np.int64), np.zeros(len(c.b_ids), np.int64)
        a_last[c.a_cuts - 1] = 1
        b_last[c.b_cuts - 1] = 1
        order = np.empty(len(c.a_ids) + len(c.b_ids), np.int64)
        order[np.arange(len(c.a_ids)) + np.repeat(b_start, c.a_cuts - a_start)] = 2 * c.a_ids + a_last
        order[np.arange(len(c.b_ids)) + np.repeat(c.a_cuts, c.b_cuts - b_start)] = self.shift + 2 * c.b_ids + b_last
        out, at = [], 0
        for end in (c.a_upto + c.b_upto).tolist():
            out.append(hashlib.sha256(b"".join(map(self.signs.__getitem__, order[at:end].tolist()))[:-1]).hexdigest() if end > at else "")
            at = end
        return out


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    return pieces(batches, "text", rows=4096, size=size)


def align_documents(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model", a_ranks: str | None = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", work: int = 256, chunk_bytes: int = 4_000_000) -> DataFrame:
    """Token ids of each text of `docs` (doc_id, text) under both tokenizers, and where both end together: doc_id, a_ids, b_ids, a_cuts, b_cuts.

    Group g holds A's tokens a_cuts[g-1] to a_cuts[g] - 1 (from 0 for the first) and B's likewise; all of them are linked with each other. Both see the text after one space. Whole texts are encoded.
    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: empty arrays. Rows are independent: repeated ids and rows stay, an empty table gives an
    empty one, other columns are left out. Tasks work on chunks of about `chunk_bytes` of text, or one text. `a_file`, `b_file` and `a_ranks` (optional: A's vocabulary as ranks) are on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = BytePieces(a_file, a_ranks), SentencePieces(b_file)
        for batch in _texts(batches, chunk_bytes):
            c = Aligned(batch.column("text").to_pylist(), a, b, work)
            lists = [_lists(ids, ends) for ids, ends in ((c.a_ids, c.a_upto), (c.b_ids, c.b_upto))]
            for cuts, upto in ((c.a_cuts, c.a_upto), (c.b_cuts, c.b_upto)):
                lists.append(_lists(cuts - np.repeat(_starts(upto), c.g_upto - c.g_from), c.g_upto))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def _lists(values: np.ndarray, upto: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), pa.array(values, pa.int32()))


def alignment_digests(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model", a_ranks: str | None = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", work: int = 256, chunk_bytes: int = 4_000_000) -> DataFrame:
    """For each row of `docs` (doc_id, text): n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, as align_documents() aligns it.

    Links are all pairs of an A and a B token in one group. An id pair's count is the number of rows that hold it linked. n_best: links whose count is the highest of their A id (ties
    included); count_sum: the counts of all links. groups_sha256: of the groups' ids, '' without tokens. Rows without tokens hold zeros.

    Each text is encoded once. A chunk of texts (about `chunk_bytes`, or one text) keeps its distinct id pairs once and its texts as places in that list. Pairs go to counters as one row for each chunk
    that holds them, however often it does, and their counts come back to the chunk. So a pair that every text holds is one row of each chunk, and no task gathers the texts of a pair.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = BytePieces(a_file, a_ranks), SentencePieces(b_file)
        digester = Digester(len(a.bytes), len(b.bytes))
        part = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(_texts(batches, chunk_bytes)):
            c = Aligned(batch.column("text").to_pylist(), a, b, work)
            group, left, right, times = linked_ids(c)
            doc = np.searchsorted(c.g_upto, group, side="right")
            pair = left * len(b.bytes) + right
            order = np.lexsort((pair, doc))
            doc, pair, times = doc[order], pair[order], times[order]
            new = np.flatnonzero(np.diff(doc, prepend=-1).astype(bool) | np.diff(pair, prepend=-1).astype(bool))
            doc, pair, times = doc[new], pair[new], np.add.reduceat(times, new) if len(new) else times
            keys, place = np.unique(pair, return_inverse=True)
            n_links = np.bincount(doc, times, len(batch)).astype(np.int64) if len(doc) else np.zeros(len(batch), np.int64)
            per_doc = [c.n_a, c.n_b, c.g_upto - c.g_from, n_links, np.bincount(doc, minlength=len(batch))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part | k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("doc_id")), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in per_doc],
                    pa.array([digester.of(c)], pa.list_(pa.string())), *[pa.array([packed(x)], pa.binary()) for x in (place.astype(np.int32), times, keys, np.bincount(place, minlength=len(keys)))],
                ],
                names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "sha", "places", "times", "keys", "docs"],
            )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs"))
    chunks = docs.select("doc_id", "text").mapInArrow(encode, f"chunk long, doc_id array<{kind}>, {counts}, sha array<string>, places binary, times binary, keys binary, docs binary")
    chunks = materialize(chunks, "aligned")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, keys, n in zip(*[batch.column(c).to_pylist() for c in ("chunk", "keys", "docs")], strict=True):
                keys = unpacked(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(keys), pa.array(unpacked(n, np.int64))], names=["chunk", "place", "pair", "docs"])

    size_b = _size(b_file)
    held = chunks.select("chunk", "keys", "docs").mapInArrow(listed, "chunk long, place int, pair long, docs long")
    counted = held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pair div {size_b}"))
    most = counted.groupBy("a").agg(F.max("count").alias("most"))
    counted = counted.join(most, "a").select(F.col("pair").alias("c_pair"), "count", (F.col("count") == F.col("most")).alias("best"))
    back = held.join(counted, F.col("pair") == F.col("c_pair")).select("chunk", "place", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"
    return chunks.drop("keys", "docs").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(partial(_finished, names), schema)


def _size(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()


def _finished(names: list[str], chunk: pa.Table, back: pa.Table) -> pa.Table:
    """Rows of the documents of a chunk from its places and the counts that came back for its list of pairs."""
    row = {c: chunk.column(c).combine_chunks() for c in chunk.column_names}
    place = np.asarray(back.column("place"))
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = np.asarray(back.column("count")), np.asarray(back.column("best"))
    places, times = unpacked(row["places"][0].as_py(), np.int32), unpacked(row["times"][0].as_py(), np.int64)
    n = {c: np.asarray(row[c].flatten()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
    ends = np.cumsum(n["n_pairs"])
    sums = [np.append(0, np.cumsum(x[places] * times)) for x in (best, count)]
    n_best, count_sum = (s[ends] - s[ends - n["n_pairs"]] for s in sums)
    return pa.table([row["doc_id"].flatten(), *[pa.array(n[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(n_best), pa.array(count_sum), row["sha"].flatten()], names=names)
