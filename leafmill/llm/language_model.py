"""Scoring of texts by a trigram model with deleted interpolation.

Maximum-likelihood estimates of order 3, 2, 1 and 0 are mixed, each order with the next lower one, by a weight for the bucket of its context's
frequency. The weights are learned by expectation-maximisation on the n-grams of documents that the estimates then leave out.

Documents are packed into chunks. Each chunk asks for the counts of its own distinct n-grams; counters, each of a range of hashed n-grams, add up
all chunks' training counts and answer. So no table of counts is gathered anywhere, and a chunk sees what its texts need. Beyond `fan` counters,
chunks ask through nodes that merge the requests of some chunks for a range, so that rows grow with the input and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, give_back, materialize, mixed, packed, parts_for, unpacked, words_of

#: Chunks of training documents, of others, and of the training documents on which weights are learned.
TRAIN, OTHER, HELD = 0, 1, 2
#: Buckets of context frequency: 0, then powers of two.
BUCKETS = 40
PAIR, TRIPLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of an n-gram's key; the lowest is 1 for single words.
KEY_BITS = 56
REQUEST = "node long, part long, keys binary, counts binary, held binary"
ANSWER = "node long, part long, counts binary, held binary, types long"


def end_and_start() -> tuple[np.uint64, np.uint64]:
    """Hashes of the end of a text and of what comes before it; no word has white space."""
    h = WordHashes()
    return np.uint64(h[b" "]), np.uint64(h[b"\t"])


def key_of(hashes: np.ndarray, word: int) -> np.ndarray:
    return mixed(hashes) >> np.uint64(64 - KEY_BITS) & ~np.uint64(1) | np.uint64(word)


class Chunk:
    """Some documents: distinct words, their first the end, and tokens as codes of them; distinct n-grams, and where each token's are among them."""

    def __init__(self, row: dict):
        words, self.lengths = unpacked(row["words"], np.uint64), unpacked(row["lengths"], np.uint32).astype(np.int64)
        ends = np.cumsum(self.lengths + 1) - 1
        self.starts = ends - self.lengths
        tokens = np.zeros(len(ends) + int(self.lengths.sum()), np.int64)  # code 0 is the end
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = unpacked(row["codes"], np.uint32)
        token = words[tokens]
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.starts] = end_and_start()[1]
        pairs = mixed(before * PAIR + token)
        later = np.flatnonzero(np.isin(np.arange(len(tokens)), self.starts, invert=True))
        triples = mixed(pairs[later - 1] * TRIPLE + token[later])
        #: Sorted distinct keys of all orders.
        self.keys, place = np.unique(np.concatenate([key_of(words, 1), key_of(pairs, 0), key_of(triples, 0)]), return_inverse=True)
        place = place.astype(np.int32)
        w, t = len(words), len(tokens)
        self.end = int(place[0])
        #: Places of each token's n-grams; the first token of a text has no longer one than its pair.
        self.first, self.second = place[:w][tokens], place[w : w + t]
        self.third = self.second.copy()
        self.third[later] = place[w + t :]
        n = len(self.keys)
        self.counts = np.bincount(self.first, minlength=n) + np.bincount(self.second, minlength=n) + np.bincount(place[w + t :], minlength=n)

    def estimates(self, counts: np.ndarray, tokens: int) -> tuple[np.ndarray, ...]:
        """For each token the buckets of its contexts' counts (two words, one) and the maximum-likelihood estimates of order 3, 2 and 1."""
        # What precedes a text is as frequent as the end. A pair that ends no text is followed by one token, so its count is that of a context.
        one, two = np.empty((2, len(self.first)), np.int64)
        one[1:], two[1:] = counts[self.first[:-1]], counts[self.second[:-1]]
        one[self.starts] = two[self.starts] = counts[self.end]
        share = lambda n, of: np.where(of > 0, n / np.maximum(of, 1), 0.0)
        return bucket(two), bucket(one), share(counts[self.third], two), share(counts[self.second], one), counts[self.first] / max(tokens, 1)


def bucket(contexts: np.ndarray) -> np.ndarray:
    return np.where(contexts > 0, np.minimum(np.log2(np.maximum(contexts, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def pack_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, first: int, n: int, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts from `first` on, `n` of `parts` equal ranges, that hold some of the sorted keys."""
    at = np.searchsorted(keys, np.array([(i << KEY_BITS) // parts for i in range(first, first + n + 1)], np.uint64))
    for i in range(n):
        if at[i] < at[i + 1]:
            yield first + i, slice(at[i], at[i + 1])


def request_rows(node: int, keys: np.ndarray, counts: np.ndarray | None, held: np.ndarray | None, first: int, n: int, parts: int) -> pa.RecordBatch:
    part = lambda values, s: b"" if values is None else packed(values[s].astype(np.uint64))
    rows = [(node, i, pack_sorted(keys[s]), part(counts, s), part(held, s)) for i, s in slices(keys, first, n, parts)]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["node", "part", "keys", "counts", "held"])


def chunks(docs: DataFrame, chunk_words: int) -> DataFrame:
    """Packs `docs` (doc_id, text as bytes, kind): chunk, kind, ids, tokens, lengths (in words), words, codes. Codes of frequent words are small."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        end = end_and_start()[0]
        ids: dict[int, list] = {k: [] for k in (TRAIN, OTHER, HELD)}
        texts: dict[int, list[np.ndarray]] = {k: [] for k in ids}
        size = dict.fromkeys(ids, 0)

        def flush(kind: int) -> pa.RecordBatch:
            parts = texts[kind]
            words, place, counts = np.unique(np.concatenate([*parts, np.array([end])]), return_inverse=True, return_counts=True)
            counts[place[-1]] = len(place) + 1  # the end is the first
            order = np.argsort(-counts, kind="stable")
            code = np.empty(len(words), np.uint32)
            code[order] = np.arange(len(words), dtype=np.uint32)
            row = [[kind], [ids[kind]], [size[kind]], [packed(np.array([len(p) for p in parts], np.uint32))], [packed(words[order])], [packed(code[place[:-1]])]]
            ids[kind], texts[kind], size[kind] = [], [], 0
            kinds = [pa.int32(), pa.list_(id_type), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["kind", "ids", "tokens", "lengths", "words", "codes"])

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for i, text, kind in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = hashes.of(words_of(text.as_py()))
                ids[kind].append(i)
                texts[kind].append(words)
                size[kind] += len(words) + 1
                if size[kind] >= chunk_words:
                    yield flush(kind)
        for kind in ids:
            if ids[kind]:
                yield flush(kind)
        hashes.clear()
        give_back()

    out = docs.mapInArrow(pack, f"kind int, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, tokens long, lengths binary, words binary, codes binary")
    return out.withColumn("chunk", F.monotonically_increasing_id())


def requests(chunk_rows: DataFrame, parts: int) -> DataFrame:
    """For each chunk and part, the distinct n-grams there, and their counts if they are for training."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                chunk = Chunk(row)
                counts = None if row["kind"] == OTHER else chunk.counts
                yield request_rows(row["chunk"], chunk.keys, counts, counts if row["kind"] == HELD else None, 0, parts, parts)
        give_back()

    return chunk_rows.select("chunk", "kind", "lengths", "words", "codes").mapInArrow(ask, REQUEST)


class Merged:
    """The distinct keys of some requests, with the sums of their counts, and where each request's keys are."""

    def __init__(self, rows: list[dict]):
        keys = [unpack_sorted(r["keys"]) for r in rows]
        self.keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
        self.counts, self.held = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        for r, own in zip(rows, self.places, strict=True):
            for name, sums in (("counts", self.counts), ("held", self.held)):
                if r[name]:
                    sums[own] += unpacked(r[name], np.uint64).astype(np.int64)  # keys are distinct within a request

    def answer(self, rows: list[dict], counts: np.ndarray, held: np.ndarray, types: int | None = None) -> pa.Table:
        """Counts for each request in the order of its keys; held-out ones where it has such. `types`: one more row, without a node."""
        out = [(r["node"], r["part"], packed(counts[own].astype(np.uint64)), packed(held[own].astype(np.uint64)) if r["held"] else b"", None) for r, own in zip(rows, self.places, strict=True)]
        if types is not None:
            out.append((None, None, None, None, types))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        give_back()
        return pa.table([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=["node", "part", "counts", "held", "types"])


def placed(rows: list[dict], name: str) -> np.ndarray:
    """The answers' counts, in the order of the keys of the node that asked: parts are ranges of keys."""
    return np.concatenate([unpacked(r[name], np.uint64) for r in sorted(rows, key=lambda r: r["part"])]).astype(np.int64)


def counted(asked: DataFrame) -> DataFrame:
    """Each part's counter adds up its requests and answers them. A row without a node has the distinct training words there."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        m = Merged(rows)
        return m.answer(rows, m.counts, m.held, int(((m.keys & np.uint64(1)) * (m.counts > 0)).sum()))

    return asked.groupBy("part").applyInArrow(add, ANSWER)


def answers(chunk_rows: DataFrame, keys: int, counter_keys: int, fan: int) -> DataFrame:
    """Total counts for each chunk's n-grams, at most `keys` in all, by ranges. A row without a node has a counter's distinct training words.

    Up to `fan` counters answer chunks themselves. Beyond, a chunk asks `fan` ranges; a node for each range and some chunks, of about
    `counter_keys` keys, asks the counters of its range and passes their answers down.
    """
    counters = parts_for(keys, counter_keys)
    if counters <= fan:
        return materialize(counted(requests(chunk_rows, counters)), "answers")
    each, groups = parts_for(counters, fan), parts_for(keys / fan, counter_keys)
    asked = requests(chunk_rows, fan)
    asked = materialize(asked.withColumn("above", F.col("part") * groups + F.pmod(F.xxhash64("node"), F.lit(groups))), "requests")

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        m = Merged(rows)
        held = m.held if any(r["held"] for r in rows) else None
        return pa.Table.from_batches([request_rows(rows[0]["above"], m.keys, m.counts, held, rows[0]["part"] * each, each, fan * each)])

    def pass_down(below: pa.Table, got: pa.Table) -> pa.Table:
        rows, found = below.to_pylist(), got.to_pylist()
        return Merged(rows).answer(rows, placed(found, "counts"), placed(found, "held") if found[0]["held"] else np.zeros(0, np.int64))

    found = materialize(counted(asked.groupBy("above").applyInArrow(merge, REQUEST)), "counted")
    down = asked.groupBy("above").cogroup(found.where("node is not null").withColumnRenamed("node", "above").groupBy("above")).applyInArrow(pass_down, ANSWER)
    return materialize(down.unionByName(found.where("node is null")), "answers")


class Weights:
    """Of order 3 and 2, by bucket of the context's count, and of order 1; what an order leaves goes to the next lower one."""

    def __init__(self, floor: float, tokens: int):
        self.floor = floor
        self.orders = np.full((2, BUCKETS), 0.5)
        self.orders[:, 0] = 0  # a context that was never seen says nothing
        self.words = 0.5 if tokens else 0.0

    def shares(self, two: np.ndarray, one: np.ndarray, third: np.ndarray, second: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What each order adds to the probability of each token: (4, tokens), from order 3 to 0."""
        a, b = self.orders[0, two], self.orders[1, one]
        rest = (1 - a) * (1 - b)
        return np.stack([a * third, (1 - a) * b * second, rest * self.words * first, rest * (1 - self.words) * self.floor])

    def learn(self, held: DataFrame, rounds: int = 30, gain: float = 1e-3) -> Weights:
        """Expectation-maximisation on held-out n-grams (n, two, one, third, second, first as packed arrays), until a round gains less than `gain` nats a token.

        A bucket without held-out tokens takes the next lower one's weight in the end. Each round reads `held` once and returns a row for each bucket.
        """
        used = np.zeros((2, BUCKETS), bool)
        before = -np.inf
        for _ in range(rounds):

            def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                # The last row: the log probability of all tokens, and their number.
                won, out_of = np.zeros((4, BUCKETS)), np.zeros((4, BUCKETS))
                for b in batches:
                    for i in range(b.num_rows):
                        row = b.slice(i, 1).to_pylist()[0]
                        n = unpacked(row["n"], np.uint32).astype(float)
                        two, one = unpacked(row["two"], np.uint8), unpacked(row["one"], np.uint8)
                        part = self.shares(two, one, *(unpacked(row[c], np.float32).astype(float) for c in ("third", "second", "first")))
                        p = part.sum(axis=0)
                        won[3, 0] += n @ np.log(p)
                        out_of[3, 0] += n.sum()
                        part *= n / p
                        below = part[::-1].cumsum(axis=0)[::-1]
                        for j, at in enumerate((two, one, np.zeros_like(one))):
                            won[j] += np.bincount(at, part[j], BUCKETS)
                            out_of[j] += np.bincount(at, below[j], BUCKETS)
                j, at = np.nonzero(out_of)
                yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(at), pa.array(won[j, at]), pa.array(out_of[j, at])], names=["place", "bucket", "won", "out_of"])

            sums = held.mapInArrow(expect, "place long, bucket long, won double, out_of double").groupBy("place", "bucket").agg(F.sum("won").alias("won"), F.sum("out_of").alias("out_of")).collect()
            now = -np.inf
            for r in sums:
                new = r["won"] / r["out_of"]
                if r["place"] == 3:
                    now = new
                elif r["place"] == 2:
                    self.words = min(new, 1 - 1e-9)  # no token ever has probability 0
                else:
                    used[r["place"], r["bucket"]] = True
                    self.orders[r["place"], r["bucket"]] = min(new, 1 - 1e-9)
            if now - before < gain:
                break
            before = now
        for j in range(2):
            for b in range(2, BUCKETS):
                if not used[j, b]:
                    self.orders[j, b] = self.orders[j, b - 1]
        return self


def score_texts(docs: DataFrame, training: Column, held: Column, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = 800_000, counter_keys: int = 2_000_000, fan: int = 4096) -> DataFrame:
    """Scores every whole text: id, n_tokens, n_known (tokens seen in training), train_tokens, base_score, score.

    Tokens are the words with A-Z in lower case, then one end. Counts come from the rows where `training` holds; the
    mixture weights are learned on those of them where `held` holds too, against the counts of the rest. score is the log10 probability of the text under the
    mixture; base_score that of words alone, log10((c + 0.5) / (N + 0.5 * (V + 1))). A null text is an empty one and has one token, the end.
    Nulls of the two conditions count as false. Ids may be null or repeated: each row is scored, and repeated rows count as often. Other columns of `docs`,
    whatever their names, are not read. Without rows there are none; without training rows, counts are 0 and the score is uniform.
    """
    kind = F.when(~F.coalesce(training, F.lit(False)), OTHER).when(F.coalesce(held, F.lit(False)), HELD).otherwise(TRAIN)
    rows = materialize(chunks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), kind.alias("kind")), chunk_words), "chunks")
    size = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.sum("tokens").alias("n")).collect()}
    held_tokens = size.get(HELD, 0)
    tokens = size.get(TRAIN, 0) + held_tokens
    found = answers(rows, 2 * sum(size.values()), counter_keys, fan)
    types = found.where("node is null").agg(F.sum("types")).first()[0] or 0
    found = found.where("node is not null").select("node", "part", "counts", "held")
    weights = Weights(1 / (types + 1), tokens)

    def held_out(mine: pa.Table, got: pa.Table) -> pa.Table:
        chunk, answer = Chunk(mine.to_pylist()[0]), got.to_pylist()
        values = chunk.estimates(placed(answer, "counts") - placed(answer, "held"), tokens - held_tokens)
        # Tokens with the same estimates count together.
        kinds = (np.uint8, np.uint8, np.float32, np.float32, np.float32)
        two, one, third, second, first = values = [v.astype(k) for v, k in zip(values, kinds, strict=True)]
        wide = lambda v: v.view(np.uint32).astype(np.uint64)
        same = mixed(mixed(wide(third) << np.uint64(32) | wide(second)) + (wide(first) << np.uint64(16) | two.astype(np.uint64) << np.uint64(8) | one))
        _, at, n = np.unique(same, return_index=True, return_counts=True)
        row = [packed(n.astype(np.uint32)), *(packed(v[at]) for v in values)]
        give_back()
        return pa.table([pa.array([x], pa.binary()) for x in row], names=["n", "two", "one", "third", "second", "first"])

    if held_tokens:
        schema = "n binary, two binary, one binary, third binary, second binary, first binary"
        at_held = rows.where(F.col("kind") == HELD).select("chunk", "lengths", "words", "codes").groupBy("chunk").cogroup(found.where(F.octet_length("held") > 0).groupBy("node")).applyInArrow(held_out, schema)
        weights.learn(materialize(at_held, "held"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(mine: pa.Table, got: pa.Table) -> pa.Table:
        ids = mine.column("ids").combine_chunks().flatten()
        chunk = Chunk(mine.select(["lengths", "words", "codes"]).to_pylist()[0])
        counts = placed(got.to_pylist(), "counts")
        p = np.log10(weights.shares(*chunk.estimates(counts, tokens)).sum(axis=0))
        c = counts[chunk.first]
        base = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))
        add = lambda v: np.add.reduceat(v, chunk.starts)
        out = pa.table({"doc_id": ids, "n_tokens": chunk.lengths + 1, "n_known": add((c > 0).astype(np.int64)), "train_tokens": np.full(len(ids), tokens), "base_score": add(base), "score": add(p)})
        give_back()
        return out

    out = rows.select("chunk", "ids", "lengths", "words", "codes").groupBy("chunk").cogroup(found.groupBy("node")).applyInArrow(score, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)
