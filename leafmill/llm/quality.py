"""Quality rules: a decision list of threshold conjunctions, learned from labelled text statistics, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

#: What stands between words.
SPACES = r"[\x20\x09-\x0D]+"
#: Counts that text_statistics() adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_distinct")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_places(keys: Column) -> Column:
    """Places from 0, ascending, of the elements of an array of longs that occur twice or more.

    Low bits of a key and its place make one number, and equal keys stand together when these are sorted. If dropped bits make different keys equal, pairs of whole keys and places are sorted instead.
    """

    def by(pairs: Column, key: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
        def twice(s: Column) -> Column:
            same = lambda x, at: F.coalesce(key(F.get(s, at)) == key(x), F.lit(False))
            return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), place)

        return F.array_sort(_let(pairs, twice))

    def found(k: Column) -> Column:
        bits = F.ceil(F.log2(F.size(k) + F.lit(1.0))).cast("int")

        def quick(n: Column) -> Column:
            short = F.transform(k, lambda x: F.call_function("shiftleft", x, n))
            sorted_ = F.sort_array(F.transform(k, lambda x, i: F.call_function("shiftleft", x, n).bitwiseOR(i.cast("long"))))
            whole = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.cast("long").alias("i"))))
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
            places = by(sorted_, lambda x: F.call_function("shiftright", x, n), lambda x: x.bitwiseAND(mask))
            return F.when(F.size(F.array_distinct(short)) == F.size(F.array_distinct(k)), places).otherwise(by(whole, lambda x: x["k"], lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.array().cast("array<long>")).otherwise(_let(bits, quick))

    return _let(keys, found)


def repeat_words(words: Column) -> Column:
    """How many of `words` (an array) are in a run of three words that is found twice or more. Runs are compared by 64-bit hashes."""
    three = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    covered = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long"))))
    total = lambda p: F.aggregate(_let(p, covered), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(words) > 3, total(_repeated_places(_let(words, three)))).otherwise(F.lit(0).cast("long"))


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the counts COUNTS of each whole text in place of the text; a null text counts as empty. Columns of these names are replaced.

    n_words: runs of other characters than ASCII white space; word_chars: their code points; n_symbols: characters of #*$%&|<>; n_lines: \\n-split lines with a word; n_dup_lines: those equal to an
    earlier one; n_repeat_words: words in runs of three that are found twice or more; n_upper: upper-case letters; n_digits: digits; n_stops: characters of .,;:!?; n_distinct: different words.
    Rows stay apart, so repeated rows and null ids stay, and an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    parts = F.struct(F.array_remove(F.split(text, SPACES, -1), "").alias("w"), lines.alias("l"), *[count(p).alias(n) for n, p in (("s", "[#*$%&|<>]"), ("u", r"\p{Lu}"), ("d", r"\p{Nd}"), ("p", "[.,;:!?]"))])
    counts = lambda t: F.struct(
        F.size(t["w"]).alias("n_words"), F.char_length(F.array_join(t["w"], "")).alias("word_chars"), t["s"].alias("n_symbols"), (F.size(t["l"]) - F.size(F.array_distinct(t["l"]))).alias("n_dup_lines"),
        repeat_words(t["w"]).alias("n_repeat_words"), F.size(t["l"]).alias("n_lines"), t["u"].alias("n_upper"), t["d"].alias("n_digits"), t["p"].alias("n_stops"), F.size(F.array_distinct(t["w"])).alias("n_distinct"),
    )
    kept = [F.col(c) for c in docs.columns if c != text_col and c not in COUNTS]
    own = [c for c in docs.columns if c != text_col and c not in COUNTS]
    named = docs.select(F.struct(*kept).alias("own") if kept else F.lit(None).alias("own"), _let(parts, counts).alias("t"))
    return named.select(*[F.col("own")[c].alias(c) for c in own], *[F.col("t")[c].cast("long").alias(c) for c in COUNTS])


def features() -> dict[str, Column]:
    """Measures of a text from its counts, by name; 0 where there is nothing to divide by."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"), "symbols_a_word": share("n_symbols", "n_words"), "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"), "upper_case": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"), "stops_a_word": share("n_stops", "n_words"),
        "different_words": share("n_distinct", "n_words"), "words_a_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: (measure, whether above, threshold). `found` and `wrong`: rows of the looked-for and the other class that it covered when it was pruned."""

    conditions: tuple[tuple[str, bool, float], ...]
    found: int = 0
    wrong: int = 0

    def column(self, measures: dict[str, Column]) -> Column:
        return reduce(Column.__and__, [measures[m] > t if above else measures[m] <= t for m, above, t in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{m} {'>' if above else '<='} {t:g}" for m, above, t in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """The decision list over the counts of text_statistics(): the number of the first rule (from 1) that fits, else 0."""
    measures = features()
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(measures), F.lit(i)).otherwise(out)
    return out


def learn_rules(stats: DataFrame, labels: DataFrame, fit_rows: int = 200_000, cuts: int = 48, precision: float = 0.9, support: int = 5, most_rules: int = 12, most_conditions: int = 4, seed: int = 12) -> list[Rule]:
    """Rules for texts of quality 0, by sequential covering: `stats` (doc_id and COUNTS) with `labels` (doc_id, quality).

    A rule grows on two thirds of the labelled rows that no earlier rule covers: the condition of largest information gain (as in FOIL) is added until no other row is covered, nothing is gained, or
    there are `most_conditions`. Then the last conditions go again if the remaining ones do better, (found - wrong) / (found + wrong), on the other third. It is kept if there at least the share
    `precision` of the covered rows and at least `support` are of quality 0; the first rule that is not kept ends the list. Thresholds are exact quantiles of each class, `cuts` for each measure.

    Learned from at most about `fit_rows` labelled rows, those of smallest hash of their id: this bounds the passes over them, one for each condition. Documents whose labels differ, and null ids and qualities, teach
    nothing. Repeated rows count as often as they stand. Without rows of both classes there are no rules. The driver gets counts by measure and cut only.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    measures = features()
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    rows = stats.join(known.where("low = high"), F.col("doc_id") == F.col("l_id")).select((F.col("low") == 0).alias("bad"), hashed.alias("h"), F.array(*measures.values()).alias("x"))
    rows = materialize(rows, "labelled")
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    shares = [i / cuts for i in range(1, cuts)]
    quantiles = rows.groupBy("bad").agg(*[F.percentile(F.get("x", i), shares).alias(m) for i, m in enumerate(measures)]).collect()
    if len(quantiles) < 2:
        return []
    names = list(measures)
    at = {m: sorted({t for q in quantiles for t in q[m]}) for m in names}
    # A row's bins: how many thresholds of a measure are below its value.
    below = lambda m, value: F.size(F.filter(F.array(*[F.lit(t) for t in at[m]]), lambda t: t < value))
    bins = F.array(*[below(m, F.get("x", i)) for i, m in enumerate(names)])
    rows = materialize(rows.select("bad", (F.pmod(F.floor(F.col("h") / 1_000_000), F.lit(3)) == 0).alias("prune"), bins.alias("bins")), "bins")

    def fits(conditions) -> Column:
        own = [F.get("bins", names.index(m)) > k if above else F.get("bins", names.index(m)) <= k for m, above, k in conditions]
        return reduce(Column.__and__, own, F.lit(True))

    def grown(left: DataFrame) -> list[tuple[str, bool, int]]:
        conditions: list[tuple[str, bool, int]] = []
        while len(conditions) < most_conditions:
            covered = left.where(~F.col("prune") & fits(conditions)).select("bad", F.posexplode("bins").alias("measure", "bin"))
            counts = covered.groupBy("measure", "bin").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).collect()
            best = best_condition([(r["measure"], r["bin"], r["p"], r["n"] - r["p"]) for r in counts], [len(at[m]) for m in names])
            if best is None:
                break
            conditions.append((names[best[0]], best[1], best[2]))
            if best[3]:
                break
        return conditions

    rules: list[Rule] = []
    left = rows
    while len(rules) < most_rules:
        conditions = grown(left)
        if not conditions:
            break
        held = left.where("prune").agg(*[F.struct(F.coalesce(F.sum(F.when(fits(conditions[:k]), F.col("bad").cast("long"))), F.lit(0)).alias("p"), F.count_if(fits(conditions[:k])).alias("n")).alias(f"c{k}") for k in range(1, len(conditions) + 1)]).first()
        worth = [(2 * c["p"] - c["n"]) / c["n"] if c["n"] else -1.0 for c in held]
        k = worth.index(max(worth)) + 1
        p, covered = held[k - 1]["p"], held[k - 1]["n"]
        if p < support or p < precision * covered:
            break
        rules.append(Rule(tuple((m, above, at[m][c]) for m, above, c in conditions[:k]), p, covered - p))
        left = left.where(~fits(conditions[:k]))
    return rules


def best_condition(counts: list[tuple[int, int, int, int]], thresholds: list[int]) -> tuple[int, bool, int, bool] | None:
    """(measure, whether above, cut, whether it leaves no other row) of largest gain p * (log2(p / (p + n)) - log2(P / (P + N))); ties: the first. None if nothing is gained.

    `counts`: measure, bin, rows of the class, other rows; `thresholds`: how many cuts each measure has.
    """
    best, gain = None, 1e-9
    for m, cuts in enumerate(thresholds):
        held = [[0, 0] for _ in range(cuts + 1)]
        for measure, k, p, n in counts:
            if measure == m:
                held[k] = [p, n]
        all_p, all_n = (sum(x[i] for x in held) for i in (0, 1))
        if not all_p or not all_n:
            return None
        before = math.log2(all_p / (all_p + all_n))
        p = n = 0
        for k in range(cuts):
            p, n = p + held[k][0], n + held[k][1]
            for above, x, y in ((False, p, n), (True, all_p - p, all_n - n)):
                if x and (got := x * (math.log2(x / (x + y)) - before)) > gain:
                    best, gain = (m, above, k, not y), got
    return best


def judged(docs: DataFrame, labels: DataFrame, least_words: int = 50, most_repeats: int = 50, **options) -> tuple[DataFrame, list[Rule]]:
    """doc_id, COUNTS, base_failed, rule (that of the decision list which fits first, 0 for none) and kept of each row of `docs` (doc_id, text), and the rules.

    base_failed: fewer than `least_words` words, or over `most_repeats` % of them in repeated runs of three. kept: neither failed nor covered by a rule. Rules learn from labelled rows that have not failed. Every row is judged, labelled or not, by its whole text.
    """
    stats = materialize(text_statistics(docs.select("doc_id", "text")), "text-stats")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    rules = learn_rules(stats.where(~failed), labels, **options)
    out = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
