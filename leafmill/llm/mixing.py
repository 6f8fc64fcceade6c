"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, parts_for, small


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source.

    `sizes`: a row for each source with `source` and `source_size`. Sources in code-point order, null last, weigh `weights`,
    repeating; together they get `share` of all words. No target is above `most` times its source's size: such a source is
    full, and the others share what is left by weight. Sources without words get 0. An empty table gives an empty table.
    Adds sid (place from 0), weight and target.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    # Sources in the order in which a rising level (words for each unit of weight) fills them: all before the first that
    # the level of the remaining budget does not fill are full.
    filled = Window.orderBy("fills_at", "sid")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "sid", "level"))).over(whole)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return levels.select("source", "source_size", "sid", "weight", target.alias("target"))


def mix_plan(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", block: int = 8192) -> DataFrame:
    """How many words the mix takes of each row.

    `rows`: doc_id, source, size (words) and print (a fingerprint of the text). Returns them with copy (from 1, among rows
    that are equal in these columns), source_size, target and taken.

    Each source's rows stand in an order shuffled by md5 and are served up to `most` times. A row's virtual finish time is its
    source's words up to and with it, divided by the source's target. All rows of all sources are served by finish time (ties:
    source, round, then shuffled order) until the budget, the sum of the targets rounded down, is spent; the last row may be
    taken in part. Rows without words take 0. Null ids and sources are values like others. Equal inputs give equal results.

    Equal rows are counted first and numbered after, so that a group of repeats is never gathered in one task. Running sums are made
    within blocks of about `block` rows, on top of the sums of the blocks before.
    """
    key = ["doc_id", "source", "size", "print"]
    rows = materialize(rows.select(*key), "mix-rows")
    counted = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    copies = numbered(counted, "n", "copy").select(*key, "copy")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    known = sources.agg(F.count(F.lit(1)), F.sum("source_rows"), F.sum("source_size")).first()
    n_sources, n_rows, words = known[0], known[1] or 0, known[2] or 0
    budget = int(share * words)
    targets = source_targets(sources.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "t_source")
    sources = sources.select(F.col("source").alias("s_source"), "source_rows").join(targets, F.col("s_source").eqNullSafe(F.col("t_source"))).drop("s_source")
    shuffled = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "print", F.col("copy").cast("string")))
    place = F.conv(F.substring("dealt", 1, 7), 16, 10).cast("long") * F.ceil(F.col("source_rows") / block) / F.lit(float(16**7))
    dealt = (
        copies.join(small(sources, n_sources, 10_000), F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
        .withColumn("dealt", shuffled)
        .withColumn("blk", F.floor(place))
    )
    sums = dealt.groupBy("sid", "blk").agg(F.sum("size").alias("blk_size"))
    before = Window.partitionBy("sid").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("sid").alias("b_sid"), F.col("blk").alias("b_blk"), F.coalesce(F.sum("blk_size").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("sid", "blk").orderBy("dealt", "doc_id", "print", "copy").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        dealt.join(sums, (F.col("sid") == F.col("b_sid")) & (F.col("blk") == F.col("b_blk")))
        .drop("b_sid", "b_blk")
        .withColumn("upto", F.col("start") + F.sum("size").over(upto))
    )
    finish = lambda served: (F.col("upto") + F.col("source_size") * served) / F.col("target")
    width = parts_for(n_rows, block)
    bin_of = lambda v: F.floor(F.least(v, F.lit(16.0)) * width).cast("long")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    turns = queued.where((F.col("size") > 0) & (F.col("target") > 0)).select("sid", "dealt", "copy", "doc_id", "print", "size", "upto", "source_size", "target", rounds.alias("served")).withColumn("finish", finish(F.col("served"))).withColumn("bin", bin_of(F.col("finish")))
    bins = turns.groupBy("bin").agg(F.sum("size").alias("bin_size"))
    total = F.sum("bin_size").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    edge = bins.withColumn("total", total).where(F.col("total") >= budget).orderBy("bin").limit(1).first() if budget else None
    cut = edge["bin"] if edge else (2**62 if budget else -1)  # all turns of earlier bins are taken, none of later ones
    spent = edge["total"] - edge["bin_size"] if edge else 0
    order = Window.orderBy("finish", "sid", "served", "dealt", "doc_id", "print", "copy").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        turns.where(F.col("bin") == cut)
        .withColumn("total", spent + F.sum("size").over(order))
        .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("total") + F.col("size"))))
        .groupBy(F.col("dealt").alias("l_dealt"), F.col("sid").alias("l_sid"))
        .agg(F.sum("part").alias("part"))
    )
    whole = sum((F.when(bin_of(finish(F.lit(k))) < cut, F.col("size")).otherwise(F.lit(0)) for k in range(most)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), whole + F.coalesce("part", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return queued.join(last, (F.col("sid") == F.col("l_sid")) & (F.col("dealt") == F.col("l_dealt")), "left").select(*key, "copy", "source_size", "target", taken.alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The narrow rows that mix_plan() needs; a null text has no words and the fingerprint of an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(text).alias("print"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of `docs` (doc_id, text, source and any others, of any names): a document that is taken twice
    stands twice, one that is not taken goes. The one document at the end of the budget, taken in part, stands once whole.
    Rows with equal doc_id, source and text are numbered in the order of their other columns, if there are any such rows."""
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = mix_plan(mix_rows(docs), **options).select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("print").alias("p_print"), F.col("copy").alias("p_copy"), times.alias("p_times"))
    plan = materialize(plan.where("p_times > 0"), "mix-plan")
    n, copies = plan.agg(F.count(F.lit(1)), F.max("p_copy")).first()
    # Columns of `docs` stand in a struct, so their names meet no others.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d_row"), F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("d_print"))
    same = F.col("d_id").eqNullSafe(F.col("p_id")) & F.col("d_source").eqNullSafe(F.col("p_source")) & (F.col("d_print") == F.col("p_print"))
    if (copies or 1) > 1:
        own = [F.col("d_row").getField(c) for c in docs.columns if c not in ("doc_id", "source", "text")]
        rows = rows.withColumn("d_copy", F.row_number().over(Window.partitionBy("d_id", "d_source", "d_print").orderBy(*(own or ["d_id"]))))
        same = same & (F.col("d_copy") == F.col("p_copy"))
    return rows.join(small(plan, n), same).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("p_times")))).select("d_row.*")
