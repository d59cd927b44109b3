import numpy as np
from pyspark.sql import functions as F

from graphloom.llm.hard_negatives import best, bit_planes, hard_negatives, scores, subset_sums


def test_scores_against_products():
    rng = np.random.default_rng(1)
    for width in (0, 1, 7, 8, 9, 64, 100):
        for size in (1, 3, 300, 2**20):
            x, y = (rng.integers(-size, size, (n, width)) for n in (13, 6))
            assert (scores(bit_planes(x), subset_sums(y)) == x @ y.T).all()
    y[:] = 2**40
    assert (scores(bit_planes(x[:, :9] % 5), subset_sums(y[:, :9])) == (x[:, :9] % 5) @ y[:, :9].T).all()


def test_best_keeps_order_of_ties():
    assert best(np.array([3, 5, 5, 1, 5]), 2).tolist() == [1, 2]
    assert best(np.array([3, 5]), 4).tolist() == [1, 0]
    assert best(np.zeros(0, int), 4).tolist() == []


def by_force(data, every, k):
    """``data``: id -> (label, vector)."""
    out = set()
    for a, (label, v) in data.items():
        if a % every:
            continue
        ranked = sorted((-sum(int(p) * int(q) for p, q in zip(v, w)), i, lab) for i, (lab, w) in data.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:k]:
            negatives = [(i, -t) for t, i, lab in ranked if lab != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(a, p, n, i, -s, t) for n, (i, t) in enumerate(negatives, 1)}
    return out


def test_negatives_of_a_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0.2, 0.3, 11)], int(rng.integers(0, 3)), "x") for i in range(300)]
    same = rows[3][1]
    rows += [(300 + i, same, i % 4, "x") for i in range(60)]
    rows += [(400, None, 1, "x"), (405, [1.0, None], 1, "x"), (410, [float("nan")], 1, "x"), (415, [float("-inf")], 1, "x"), (None, [1.0], 1, "x"), (420, [1.0], None, "x")]
    plain = [(500, [], 1, "x"), (505, [1.0, -2.0], 2, "x"), (507, [-1.0] * 3, 9, "x")]
    rows += plain + rows[:3] + [(505, [9.0], 3, "x")]
    data = {i: (lab, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, lab, _ in rows[:360] + plain}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell string")
    for how in ({}, {"slice_rows": 40, "anchor_rows": 13}):
        got = [tuple(r) for r in hard_negatives(df, F.col("label"), every=5, k=4, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
        assert len(got) == len(set(got)) and set(got) == by_force(data, 5, 4)
    assert hard_negatives(df.limit(0), F.col("label")).collect() == []
    assert hard_negatives(df.where("vec_id % 100 <> 0"), F.col("label")).collect() == []
