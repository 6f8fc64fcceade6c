"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, parts_for, small


def hypergeometric(good: int, bad: int, n: int, u: float) -> int:
    """How many of `n` seats drawn from `good` and `bad` ones are good: the quantile `u`. For totals of any size.

    Probabilities come from the ratios of neighbours around the mode, 12 standard deviations each way, beyond which less than 1e-30 lies.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 30 + int(12 * (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (float(bad - n) + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.exp(logs - logs.max()).cumsum()
    return low + int(np.searchsorted(chance, u * chance[-1], side="right").clip(0, high - low))


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each part sends to each shard: drawn exactly, as if all rows were permuted and cut into shards of sizes at most one apart.

    Each part draws a multivariate hypergeometric sample from the seats that the parts before it left, shard by shard.
    """
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    draws = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts):
        rest = total
        for s, u in enumerate(draws.random(shards).tolist()):
            rest -= left[s]
            taken = hypergeometric(left[s], rest, n, u)
            out[i, s] = taken
            left[s] -= taken
            total -= taken
            n -= taken
    return out


def shard_rows(rows: DataFrame, shards: int = 8, seed: int = 20, part_rows: int = 65_536, most_parts: int = 100_000) -> DataFrame:
    """Deals `rows` into `shards` shards, uniformly at random, with sizes at most one apart; adds shard and slot (from 0, gapless in each shard).

    Rows are dealt by two hashes of all their columns, so the result depends on the rows and the seed alone, not on files, splits or lost
    executors. Parts are made by a hash. Each part's rows are permuted, cut as its line of the communication matrix says, exchanged
    to blocks of a shard, and permuted again; a block starts at the number of rows in the blocks before it. Equal rows are
    counted before they move and numbered after, so repeats of one row spread over all parts. The plan moves hashes only; the rows
    themselves move once, to their places. Columns of map type are not supported. Nulls are values like others; an empty
    table gives an empty one. Input columns named shard or slot are replaced. Parts have about `part_rows` rows, or more if there would be over `most_parts` parts:
    the driver holds a count for each part and shard.
    """
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    nulls = [F.col(c).isNull() for c in cols]  # a hash passes over nulls
    keyed = rows.select(F.xxhash64(*nulls, *cols).alias("_k1"), F.xxhash64(F.lit(seed), F.lit("row"), *nulls, *cols).alias("_k2"), F.struct(*cols).alias("_row"))
    keys = materialize(keyed.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n")), "rows")
    n = keys.agg(F.sum("_n")).first()[0] or 0
    copies = numbered(keys, "_n", "_copy").select("_k1", "_k2", F.col("_copy").cast("int"))
    parts = min(parts_for(n, part_rows), most_parts)
    draw = lambda what: F.xxhash64(F.lit(seed), F.lit(what), "_k1", "_k2", "_copy")
    dealt = copies.withColumn("_part", F.pmod(draw("part"), F.lit(parts)).cast("int"))
    counts = [0] * parts
    for r in dealt.groupBy("_part").count().collect():
        counts[r["_part"]] = r["count"]
    matrix = communication_matrix(counts, shards, seed)
    ends = rows.sparkSession.createDataFrame([(i, [int(x) for x in line]) for i, line in enumerate(matrix.cumsum(axis=1))], "_m_part int, _ends array<long>")
    first = Window.partitionBy("_part").orderBy(draw("first"), "_k1", "_k2", "_copy")
    # Blocks of a shard by the top bits of the second draw: as many as keep a block near part_rows.
    blocks = parts_for(n / shards, part_rows)
    sent = (
        dealt.withColumn("_place", F.row_number().over(first) - 1)
        .join(small(ends, parts, 10_000), F.col("_part") == F.col("_m_part"))
        .select("_k1", "_k2", "_copy", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))).cast("int").alias("shard"), draw("second").alias("_second"))
        .withColumn("_block", F.floor(F.shiftrightunsigned("_second", 33) * blocks / F.lit(2**31)).cast("int"))
    )
    sent = materialize(sent, "sent")
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_block").count().select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    second = Window.partitionBy("shard", "_block").orderBy("_second", "_k1", "_k2", "_copy")
    plan = sent.join(small(starts, blocks * shards, 10_000), ["shard", "_block"]).select("_k1", "_k2", "shard", (F.col("_start") + F.row_number().over(second) - 1).cast("long").alias("slot"))
    # Equal rows travel as one and are repeated where they arrive.
    return keyed.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row")).join(plan, ["_k1", "_k2"]).select("_row.*", "shard", "slot")
