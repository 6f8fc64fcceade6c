"""Exact token-length histograms, and the answers that suffix sums of them give for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

TOKENIZERS = "/opt/tokenizers"


class Encoder:
    """Token lengths under a byte-pair vocabulary in the rank format (a line for each token: base 64, rank)."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def length(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Documents by encoded length: length, n_docs. Every whole text is encoded; a null or empty text has length 0.

    Each task sends its own counts of lengths only, so the shuffle is small however large the texts are. No documents give no rows.
    `vocabulary` is a file on every worker, `pattern` the pre-tokeniser (the public vocabularies' own if not given).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern or default_pattern())
        totals: dict[int, int] = {}
        for b in batches:
            for x in b.column(0):
                n = encoder.length(x.as_py() or "")
                totals[n] = totals.get(n, 0) + 1
        keys = np.array(sorted(totals), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([totals[k] for k in keys.tolist()], pa.int64())], names=["length", "n_docs"])

    return docs.select(text_col).mapInArrow(count, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length L that occurs, as a context limit: docs_over (longer than L), tokens_upto and tokens_over (all tokens of
    documents of at most L and of more), truncated_total (tokens left if texts are cut to L), share_upto (share of documents of at most L).

    Sums run within blocks of lengths on top of the sums of later blocks, so no task holds all lengths.
    """
    h = materialize(histogram, "lengths").withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("blk", F.expr(f"length div {block}"))
    blocks = h.groupBy("blk").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("blk").alias("b"), *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"], F.sum("d").over(Window.partitionBy()).alias("d_all"), F.sum("t").over(Window.partitionBy()).alias("t_all"))
    within = Window.partitionBy("blk").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, at: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(at)
    return (
        h.join(blocks, F.col("blk") == F.col("b"))
        .withColumn("docs_over", over("n_docs", "d_after"))
        .withColumn("tokens_over", over("tokens", "t_after"))
        .select("length", "n_docs", "docs_over", (F.col("t_all") - F.col("tokens_over")).alias("tokens_upto"), "tokens_over",
                (F.col("t_all") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_total"), ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("share_upto"))
    )


def totals_at(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Exact truncated totals for any limits (a column `context`), from suffix_sums(): the last length that occurs at or below a limit answers for it.

    A limit below every length truncates all documents; without documents there are no rows.
    """
    ends = sums.agg(F.max("length").alias("longest"), F.sum("n_docs").alias("all_docs"))
    marks = sums.select("length", "docs_over", "tokens_upto", F.lit(None).cast("long").alias("context")).unionByName(limits.select(F.lit(None).cast("long").alias("docs_over"), F.lit(None).cast("long").alias("tokens_upto"), F.col("context").cast("long").alias("length"), F.col("context").cast("long").alias("context")))
    upto = Window.orderBy("length", F.col("context").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    found = marks.select("context", last("docs_over").alias("o"), last("tokens_upto").alias("t")).where("context is not null")
    return found.crossJoin(F.broadcast(ends)).where("longest is not null").select("context", F.coalesce("o", "all_docs").alias("docs_over"), (F.coalesce("t", F.lit(0)) + F.col("context") * F.coalesce("o", "all_docs")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length at or below which at least each share of the documents lies: share, length."""
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return sums.select("length", "share_upto", wanted).where(F.col("share_upto") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
