"""What the forest finds of the true neighbours, by its own depth and visits."""

import numpy as np

from leafmill.llm import neighbours


def test_recall_of_a_searched_forest(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict[int, set[int]] = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(80), np.arange(0, 4000, 50)] = -2
    true = np.argsort(-near, axis=1)[:, :5]
    found = sum(len(got[50 * i] & set(t.tolist())) for i, t in enumerate(true))
    assert found >= 0.9 * 400
    assert (4000 // 64).bit_length() - 1 > 0  # the trees have inner nodes
