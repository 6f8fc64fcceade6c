"""Quality rules against plain Python: counts, the choice of conditions, and rules learned from planted texts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, own struct<a: int>, rule long"


def counts(text):
    t = text or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(lines), len(set(w)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [None, "", "  \n\t", "a", "a b c", "a b c a b c", "a a a a", "a\nb\na\n\na ", "日本 🙂 é", " x\x0by\x0cz\r\n", "1 2", "x " * 30_000, "a b c d " * 2 + "c d a b c", "#|$ <b> #|$ <b> #|$"]
    for _ in range(60):
        words = ["w" + str(rng.randrange(rng.choice([3, 12, 400]))) for _ in range(rng.randrange(300))]
        out.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t"]) for w in words))
    return out


def test_statistics(spark, rows):
    df = spark.createDataFrame([(i if i % 7 else None, t, "clash", (1,), 5) for i, t in enumerate(rows)] + [(3, rows[3], "clash", (1,), 5)], SCHEMA)
    got = quality.text_statistics(df)
    assert got.columns == ["doc_id", "own", "rule", *quality.COUNTS]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
    want = Counter((i if i % 7 else None, *counts(t)) for i, t in [*enumerate(rows), (3, rows[3])])
    assert Counter(tuple(r) for r in got.select("doc_id", *names).collect()) == want
    assert quality.text_statistics(df.limit(0)).count() == 0


def test_keys_whose_low_bits_agree(spark):
    rng = random.Random(6)
    arrays = [[rng.randrange(4) << rng.choice([0, 40, 62]) for _ in range(rng.randrange(40))] for _ in range(200)] + [[1 << 61, 1 << 60, 0, 5, 5], [-1, 1, -1]]
    df = spark.createDataFrame([(i, [x - (1 << 64) if x >= 1 << 63 else x for x in a]) for i, a in enumerate(arrays)], "i int, k array<long>")
    got = {r["i"]: r["p"] for r in df.select("i", quality._repeated_places(F.col("k")).alias("p")).collect()}
    assert got == {i: [j for j, x in enumerate(a) if a.count(x) > 1] for i, a in enumerate(arrays)}


def test_best_condition():
    rng = random.Random(8)
    for _ in range(200):
        cuts = [rng.randrange(0, 5) for _ in range(3)]
        counts = [(m, k, rng.randrange(6), rng.randrange(6)) for m in range(3) for k in range(cuts[m] + 1)]
        p_all, n_all = (sum(c[i] for c in counts if c[0] == 0) for i in (2, 3))
        counts = [c for c in counts if c[0] == 0]  # totals are those of every measure
        best, gain = None, 1e-9
        for k in range(cuts[0]):
            for above in (False, True):
                p, n = (sum(c[i] for c in counts if (c[1] > k) == above) for i in (2, 3))
                if p and p_all and n_all and (g := p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all)))) > gain:
                    best, gain = (0, above, k, not n), g
        assert quality.best_condition(counts, cuts[:1]) == best


def planted(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))]
        bad = i % 5 == 0
        if bad and i % 2:
            words = [w + "***" for w in words]
        elif bad:
            words = [w.upper() for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_rules_of_planted_texts(spark):
    docs, labels = planted(random.Random(9), 600)
    docs += [(None, docs[5][1]), (5, docs[5][1]), (700, None), (701, "few words"), (702, "a b c " * 40)]
    labels = [*labels[:400], (3, None), (None, 0), (1, 0), (1, 0), (5, 0)]  # id 1 has two labels
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("clash"))
    out, rules = quality.judged(df, known, support=3)
    assert 1 <= len(rules) <= 4 and all(r.wrong == 0 for r in rules) and all(str(r) for r in rules)
    got = out.collect()
    assert len(got) == len(docs)
    text = dict(docs[:600])
    for r in got:
        d = r["doc_id"]
        failed = d in (700, 701, 702)
        assert r["base_failed"] == failed
        bad = d is None or not failed and (text[d].isupper() or "***" in text[d])
        assert r["kept"] == (not failed and not bad)
    # The list's first fitting rule, by a plain reading of its conditions.
    stats = quality.text_statistics(df).select("doc_id", *[c.alias(n) for n, c in quality.features().items()]).collect()
    fits = lambda r, rule: all((r[m] > t) == above for m, above, t in rule.conditions)
    want = Counter((r["doc_id"], next((i for i, rule in enumerate(rules, 1) if fits(r, rule)), 0)) for r in stats)
    assert Counter((r["doc_id"], r["rule"]) for r in got) == want


def test_nothing_to_learn_keeps_what_the_base_keeps(spark):
    df = spark.createDataFrame([(i, "a b c d e f g " + " ".join(f"w{i}{j}" for j in range(60))) for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        out, rules = quality.judged(df, known)
        assert rules == [] and out.where("kept").count() == 9
    out, rules = quality.judged(df.limit(0), labels)
    assert rules == [] and out.count() == 0


def test_fit_is_bounded_and_steady(spark):
    docs, labels = planted(random.Random(10), 400)
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    stats = quality.text_statistics(df)
    some = quality.learn_rules(stats, known, fit_rows=200, support=2)
    assert some and some == quality.learn_rules(stats.repartition(7), known.repartition(3), fit_rows=200, support=2)
