"""Language identification by interpolated Kneser-Ney character models, kept in sorted hash arrays."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed

BASE = np.uint64(0x100000001B3)


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normal_codes(text: str) -> np.ndarray:
    """Code points in lower case, with a single space for each run of other characters than letters and at both ends; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return codes[:0]
    codes = np.concatenate(([32], np.where(is_letter, codes, 32), [32])).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 to `order`, hashes of the k-grams by their last place (place k - 1 on)."""
    raw = codes.astype(np.uint64) + np.uint64(1)
    out, h = [], raw
    for k in range(1, order + 1):
        if k > 1:
            h = h[:-1] * BASE + raw[k - 1 :]
        out.append(mixed(h + (np.uint64(k) << np.uint64(56))))
    return out


def hash_of(gram: str) -> int:
    return int(gram_hashes(np.array([ord(c) for c in gram], np.uint32), len(gram))[-1][0])


class Table:
    """Numbers for each language by n-gram: a sorted array of hashes, and rows in the same order."""

    def __init__(self, rows: dict[str, list[float]], languages: int):
        grams = list(rows)
        hashes = np.array([hash_of(g) for g in grams], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = np.array([rows[g] for g in grams], np.float32).reshape(len(grams), languages)[order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is there, and its row."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at


class KneserNey:
    """Interpolated Kneser-Ney models of all languages over the same n-grams: log probabilities of n-grams that any language has, and log weights of the lower order after contexts."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int):
        self.languages, self.order = sorted(counts), order
        n = len(self.languages)
        probability: list[dict[str, list[float]]] = [defaultdict(lambda: [0.0] * n) for _ in range(order + 1)]
        weight: list[dict[str, list[float]]] = [defaultdict(lambda: [1.0] * n) for _ in range(order + 1)]
        by_order: list[list[dict[str, int]]] = [[] for _ in range(order + 1)]
        for lang in self.languages:
            level = counts[lang]
            for k in range(order, 0, -1):  # below the top, a gram counts the kinds of characters before it
                by_order[k].append(level)
                level = Counter(g[1:] for g in level)
        characters = len({g for level in by_order[1] for g in level}) + 1
        self.floor = -math.log(characters)
        for k in range(1, order + 1):
            union = {g for level in by_order[k] for g in level}
            for j, level in enumerate(by_order[k]):
                kinds = Counter(level.values())
                discount = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] and kinds[2] else 0.5
                total, types = Counter(), Counter()
                for g, c in level.items():
                    total[g[:-1]] += c
                    types[g[:-1]] += 1
                for context, c in total.items():
                    weight[k][context][j] = discount * types[context] / c
                for g in union:
                    lower = probability[k - 1].get(g[1:], None)
                    below = (lower[j] if lower else self._below(probability, weight, g[1:], j, characters)) if k > 1 else 1 / characters
                    c = total.get(g[:-1], 0)
                    probability[k][g][j] = (max(level.get(g, 0) - discount, 0) / c if c else 0.0) + (weight[k][g[:-1]][j] if c else 1.0) * below
        self.tables = [None, *(Table({g: [math.log(p) for p in ps] for g, ps in probability[k].items()}, n) for k in range(1, order + 1))]
        self.weights = [None, *(Table({g: [math.log(w) for w in ws] for g, ws in weight[k].items() if g}, n) for k in range(1, order + 1))]
        self.unseen = np.array([math.log(w) for w in weight[1][""]], np.float32) + self.floor

    @staticmethod
    def _below(probability, weight, gram: str, j: int, characters: int) -> float:
        """The probability of a gram that no language has, by backing off."""
        out = 1.0
        while gram:
            k = len(gram)
            if gram in probability[k]:
                return out * probability[k][gram][j]
            out *= weight[k][gram[:-1]][j] if gram[:-1] in weight[k] else 1.0
            gram = gram[1:]
        return out / characters

    def entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Cross-entropy a character (nats) under each language, and the characters scored; nan and 0 without letters."""
        codes = normal_codes(text)
        if len(codes) < 2:
            return np.full(len(self.languages), np.nan), 0
        hashes = gram_hashes(codes, min(self.order, len(codes)))
        total = np.zeros(len(self.languages))
        top = len(hashes)
        missed = np.arange(top - 1, len(codes))  # places whose n-gram of the order in hand is looked up
        for k in range(top, 0, -1):
            places = missed
            found, at = self.tables[k].find(hashes[k - 1][places - (k - 1)])
            total += self.tables[k].values[at[found]].sum(axis=0, dtype=np.float64)
            missed = places[~found]
            if k > 1:  # back off: weights of the contexts, which end a place earlier; then the first places, which have no longer context
                known, at = self.weights[k].find(hashes[k - 2][missed - (k - 1)])
                total += self.weights[k].values[at[known]].sum(axis=0, dtype=np.float64)
                missed = np.append(missed, k - 2) if k > 2 else missed
        total += len(missed) * self.unseen
        return -total / (len(codes) - 1), len(codes) - 1


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text (null: empty) mod `folds`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def spread(n: float) -> float:
    """How much further a text of n characters may lie from its language's mean than a very long one."""
    return 1 + 10 / math.sqrt(max(n, 1))


class LanguageModel:
    """The character models with each language's mean cross-entropy and largest accepted deviation."""

    def __init__(self, models: KneserNey, mean: list[float], limit: list[float]):
        self.models, self.mean, self.limit = models, mean, limit

    def predict(self, text: str | None) -> tuple[str, float, bool, float | None]:
        """(language, score, accepted, cross-entropy). und, 0, False and None for a null text, one without letters, or no models."""
        if not text or not self.models.languages:
            return "und", 0.0, False, None
        h, n = self.models.entropies(text)
        if not n:
            return "und", 0.0, False, None
        best = int(h.argmin())
        score = 1 / float(np.exp(-(h - h[best]) * min(n, 60)).sum())
        return self.models.languages[best], score, float(h[best]) - self.mean[best] <= self.limit[best] * spread(n), float(h[best])


def train(docs: DataFrame, order: int = 4, sample_docs: int = 1500, slack: float = 2.5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Fits a model of each language on about `sample_docs` documents of it at most, chosen by a hash of their ids.

    Whole texts are used. Rows with a null text or language are left out. Nine in ten of the sample make the counts; on the
    rest, rejection is calibrated: of the texts that the models take for the language of their label, the 0.99 quantile of what their cross-entropy exceeds
    that language's mean by, times `slack` (0.8 nats at least), is what any text may exceed it by, short ones more. So wrong labels do not widen it. The driver holds the sample's n-grams only.
    """
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit("language"), id_col), F.lit(1_000_000)).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.col("draw") < math.ceil(min(1.0, sample_docs / n) * 1_000_000)))
    sample = usable.where(chosen)
    held = F.col("draw") % 10 == 0

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = "".join(map(chr, normal_codes(text).tolist()))
                s = " " * (order - 2) + s if s else s
                totals[lang].update(s[i : i + order] for i in range(len(s) - order + 1))
        for lang, c in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    counts: dict[str, dict[str, int]] = {}
    counted = sample.where(~held).select("lang", "text").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in counted.toArrow().to_pylist():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    models = KneserNey(counts, order)

    def deviations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, h, n = [], [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # Texts that the models take for another language may bear a wrong label.
                if (e := models.entropies(text))[1] and models.languages[int(e[0].argmin())] == lang:
                    langs.append(lang), h.append(float(e[0].min())), n.append(e[1])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(h, pa.float64()), pa.array(n, pa.int64())], names=["lang", "h", "n"])

    rows = sample.where(held).select("lang", "text").mapInArrow(deviations, "lang string, h double, n long").toArrow().to_pylist()
    mean, limit = [], []
    for lang in models.languages:
        own = [(r["h"], r["n"]) for r in rows if r["lang"] == lang]
        mean.append(sum(h * n for h, n in own) / sum(n for _, n in own) if own else 2.0)
        limit.append(max(0.8, slack * float(np.quantile([(h - mean[-1]) / spread(n) for h, n in own], 0.99))) if own else 1.0)
    return LanguageModel(models, mean, limit)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), accepted and cross_entropy (nats a character); columns of these names are replaced.

    The language is the one of lowest cross-entropy a character, over the whole text; the first by name on a tie. No shuffle.
    """
    docs = docs.drop("lang_pred", "score", "accepted", "cross_entropy")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(x.as_py()) for x in b.column(b.schema.get_field_index(text_col))]
            lang, score, accepted, h = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_()), pa.array(h, pa.float64())], names=[*b.schema.names, "lang_pred", "score", "accepted", "cross_entropy"])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("accepted", "boolean"), ("cross_entropy", "double")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(predict, schema)
