"""Hard negatives against brute force: ties, repeated rows, hot labels, unusable vectors, and the bounds of the vertical scan."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, positive_id long"


@pytest.fixture(scope="module")
def table():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        v = [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) if i % 3 else rng.gauss(0.3, 0.5) for _ in range(6)]
        rows.append((i, v, 1 if i % 3 == 0 else rng.randrange(4)))  # a third of all rows in one label, many ties
    rows += [(5, rows[5][1], rows[5][2]), (10, rows[20][1], 2), (None, rows[1][1], 1), (400, None, 1), (410, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (420, [math.nan] + [0.1] * 5, 1), (430, [math.inf] + [0.1] * 5, 0), (440, rows[4][1], None)]
    rows += [(450, [], 1), (460, [1.0, 2.0], 1), (470, [0.0] * 6, 1), (480, [9.0] * 6, 7), (490, [-9.0] * 6, 8)]
    return rows


def brute(rows, every, positives, negatives, low, high):
    fine = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    fine = [r for r in fine if len(r[2]) == 6]
    out = Counter()
    for a, label, v in fine:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, y) for i, y, w in fine if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -low * ps <= -100 * s[0] <= -high * ps][:negatives]
            for rank, (ns, n, _) in enumerate(inside, 1):
                out[a, p, rank, n, -ps, -ns] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 20, "band_blocks": 3, "least_bands": 2, "group_anchors": 7, "step": 1}, {"block_rows": 50, "step": 4, "positives": 2, "negatives": 3, "low": 10, "high": 100}])
def test_against_brute_force(spark, table, options):
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in table], SCHEMA)
    rows = hard_negatives.whole_vectors(df)
    got = hard_negatives.mine_hard_negatives(rows, rows.where(F.col("vec_id") % 10 == 0), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == brute(table, 10, *(options.get(k, d) for k, d in (("positives", 5), ("negatives", 10), ("low", 30), ("high", 90))))


def test_empty_tables_and_large_numbers(spark, table):
    rows = hard_negatives.whole_vectors(spark.createDataFrame([(*r, "s", 1, 2) for r in table], SCHEMA))
    for a, b in ((rows.limit(0), rows), (rows, rows.limit(0)), (rows.where("label = 7"), rows.where("label = 7"))):
        assert hard_negatives.mine_hard_negatives(a, b).count() == 0
    wide = spark.createDataFrame([(i, i % 2, [(1 << 28) + i, i]) for i in range(40)], "vec_id long, label long, vector array<long>")  # beyond what doubles hold exactly
    got = hard_negatives.mine_hard_negatives(wide, wide.where("vec_id % 20 = 0"), low=0, high=100).collect()
    for r in got:
        dot = lambda x, y: ((1 << 28) + x) * ((1 << 28) + y) + x * y
        assert r["negative_score"] == dot(r["anchor_id"], r["negative_id"]) and r["positive_score"] == dot(r["anchor_id"], r["positive_id"])
    assert len(got) == 2 * 5 * 10
    with pytest.raises(ValueError):
        huge = wide.withColumn("vector", F.transform("vector", lambda x: x * (1 << 30)))
        hard_negatives.mine_hard_negatives(huge, huge)


def test_the_scan_prunes_before_all_columns_are_read():
    rng = np.random.default_rng(5)
    columns = rng.normal(0, 1, (64, 2000)) * np.geomspace(100, 1, 64)[:, None]
    block = hard_negatives.Block(np.arange(2000), np.zeros(2000, np.int64), np.floor(columns))
    vector, seen = np.floor(columns[:, 7]), []
    best = hard_negatives.Best(5)

    def wanted(least, most):
        seen.append(len(least))
        return most >= best.bar(least)

    rows, score = block.scan(vector, np.arange(2000), wanted, 8)
    exact = vector @ block.columns
    assert set(np.argsort(-exact)[:5]) <= set(rows) and (score == exact[rows]).all()
    assert seen[0] == 2000 and seen[-1] < 100  # bounds shrink the candidates while columns are still unread
