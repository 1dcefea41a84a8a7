"""Hard negatives by vertical scan, against all inner products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataprof.llm.bond import Columns, best, hard_negatives, windows

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """rows: distinct (id, label, vector)."""
    out = []
    for i, (a, label, q) in enumerate(rows):
        if a % 50:
            continue
        score = {j: int(np.dot(q, v)) for j, (_, _, v) in enumerate(rows) if len(v) == len(q)}
        ranked = sorted((j for j in score), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in ranked if rows[j][1] == label and rows[j][0] != a][:positives]:
            fit = [j for j in ranked if rows[j][1] != label and low * score[p] <= 100 * score[j] <= high * score[p]][:negatives]
            out += [(a, rows[p][0], r, rows[j][0], score[p], score[j]) for r, j in enumerate(fit, 1)]
    return sorted(out)


def result(df, **options):
    got = hard_negatives(df, F.col("vec_id") % 50 == 0, **options).toPandas()
    return sorted(map(tuple, got[["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]].to_numpy().tolist()))


@pytest.mark.parametrize("blocks", [{}, {"anchor_block": 3, "row_block": 40}])
def test_equals_all_pairs(spark, blocks):
    """A label with half of the rows, ties through few values, negative scores, copies of one vector."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        v = rng.integers(-3, 4, 12) + (4 if i % 3 else 0)
        if i % 5 == 0:
            v = np.array([2, 1, 0, 3] * 3)
        rows.append((i, 0 if i < 300 else int(i % 4), v.astype(float).tolist()))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df, **blocks) == brute(rows)
    assert len(brute(rows)) > 60


def test_bitmap_keeps_what_bounds_cannot_rule_out():
    rng = np.random.default_rng(9)
    for trial in range(40):
        n, d = int(rng.integers(1, 200)), int(rng.integers(1, 40))
        v, q = rng.integers(-6, 7, (n, d)), rng.integers(-6, 7, d)
        score = v @ q
        block, k = Columns(list(v)), int(rng.integers(1, 6))
        at, got = block.scan(q.astype(float), np.arange(n), best(k))
        assert (got == score[at]).all() and sorted(got)[::-1][:k] == sorted(score)[::-1][:k]
        lows = np.sort(rng.integers(-50, 50, 3)).astype(float)
        highs = lows + rng.integers(0, 40, 3)
        at, got = block.scan(q.astype(float), np.arange(n), windows(lows, highs, k))
        assert (got == score[at]).all()
        for a, b in zip(lows, highs):
            assert sorted(got[(got >= a) & (got <= b)])[::-1][:k] == sorted(score[(score >= a) & (score <= b)])[::-1][:k]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(0, 1, [2.0, 1.0]), (1, 1, [4.0, 2.0]), (1, 1, [3.0, 2.0]), (2, 2, [2.0, 1.0]), (3, 2, [4.0, 1.0]), (50, 2, [1.0, 1.0]), (100, 7, [1.0, 1.0]), (150, 1, [5.0])]
    odd = [(4, None, [9.0, 9.0]), (None, 1, [9.0, 9.0]), (5, 1, None), (6, 1, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 1, [None, 1.0]), (9, 2, []), (0, 1, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in sound + odd], f"{SCHEMA}, x string, score string, h string")
    assert result(df) == brute(sound)
    assert result(df.where("false")) == []
    assert result(df.where("vec_id = 100")) == []
    huge = spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30]), (2, 2, [6e29])], SCHEMA)
    assert result(huge) == []  # both scores end at the limit of a long
