"""Shards of exact sizes: draws against exact probabilities, sums of the matrix, uniformity, odd inputs."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from strataprof.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards, uniform


def exact(total, good, draws):
    ks = np.arange(max(0, draws + good - total), min(good, draws) + 1)
    return ks, np.array([math.comb(good, int(k)) * math.comb(total - good, draws - int(k)) / math.comb(total, draws) for k in ks])


def test_draws_follow_the_exact_probabilities(spark):
    n = 20_000
    for total, good, draws in ((50, 20, 30), (1000, 3, 500), (400, 390, 200), (7, 7, 3), (10, 4, 0)):
        ks, p = exact(total, good, draws)
        lit = lambda x: F.lit(x).cast("long")
        got = spark.range(n).select(hypergeometric(lit(total), lit(good), lit(draws), uniform(5, F.col("id"), F.lit(total))).alias("k")).groupBy("k").count().toPandas()
        seen = dict(zip(got["k"], got["count"]))
        assert set(seen) <= set(ks.tolist())
        big = p * n >= 5
        chi = sum((seen.get(int(k), 0) - n * q) ** 2 / (n * q) for k, q in zip(ks[big], p[big]))
        assert chi < big.sum() + 5 * math.sqrt(2 * big.sum()) + 5, (total, good, draws, chi)


def test_inversion_of_known_points(spark):
    """A uniform number just under and over a step of the distribution function falls on the two sides of it."""
    total, good, draws = 30, 12, 10
    ks, p = exact(total, good, draws)
    steps = np.cumsum(p)[:-1]
    rows = [(float(s + d), int(k + (d > 0))) for k, s in zip(ks, steps) for d in (-1e-9, 1e-9)]
    got = spark.createDataFrame(rows, "u double, k long").select(
        "k", hypergeometric(F.lit(total).cast("long"), F.lit(good).cast("long"), F.lit(draws).cast("long"), F.col("u")).alias("x")
    ).collect()
    assert all(r.k == r.x for r in got)


def test_matrix_has_the_sums_of_both_sides(spark):
    """Over several levels of the tree, with missing and uneven parts, and for several groups."""
    rng = np.random.default_rng(1)
    counts, caps = [], []
    for group in (0, 1):
        parts = rng.choice(9000, 150, replace=False)
        n = rng.integers(1, 40, 150)
        n[0] = 3000
        counts += [(group, int(p), int(x)) for p, x in zip(parts, n)]
        total = int(n.sum())
        caps.append((group, [total - 5, 0, 3, 2]))
    got = communication_matrix(spark.createDataFrame(counts, "group long, part long, n long"), spark.createDataFrame(caps, "group long, caps array<bigint>"), 9000, 3).collect()
    assert len(got) == len(counts)
    of = {(r.group, r.part): r.row for r in got}
    assert all(sum(of[g, p]) == n and min(of[g, p]) >= 0 for g, p, n in counts)
    for g, c in caps:
        assert [sum(of[k][j] for k in of if k[0] == g) for j in range(4)] == c


def test_shards_are_exact_gapless_and_uniform(spark):
    n = 8003
    docs = spark.range(0, n, 1, 7).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("é "), F.col("id").cast("string"))).alias("text"))
    got = shuffle_into_shards(docs, shards=16, bin_rows=200).toPandas()
    assert sorted(got["doc_id"]) == list(range(n))
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    text = {i: "the same text" if i % 3 == 0 else f"é {i}" for i in range(n)}
    assert all(r.size_ == len(text[r.doc_id].encode()) + 1 and r.crc == zlib.crc32(text[r.doc_id].encode()) for r in got.rename(columns={"size": "size_", "text_crc32": "crc"}).itertuples())
    # shard and half of the shard do not depend on where a row stood
    got["origin"], got["half"] = got["doc_id"] * 7 // n, got["slot"] * 2 // sizes.loc[got["shard"]].to_numpy()
    table = got.groupby(["origin", "shard", "half"]).size().to_numpy()
    assert len(table) == 7 * 32
    expected = n / (7 * 32)
    chi = ((table - expected) ** 2 / expected).sum()
    df = 6 * 31
    assert df - 5 * math.sqrt(2 * df) < chi < df + 5 * math.sqrt(2 * df)
    order = got.sort_values(["shard", "slot"])["doc_id"].to_numpy()
    assert abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.05 and abs(np.corrcoef(order, np.arange(n))[0, 1]) < 0.05
    again = shuffle_into_shards(docs, shards=16, bin_rows=200).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()


def test_copies_of_one_row_spread_over_shards(spark):
    got = shuffle_into_shards(spark.createDataFrame([(1, "a")] * 320 + [(None, None)] * 160, "doc_id long, text string"), bin_rows=10).toPandas()
    each = got[got["doc_id"] == 1].groupby("shard").size()
    assert len(got) == 480 and len(each) == 16 and each.max() < 30
    assert set(got[got["doc_id"].isna()]["size"]) == {1} and set(got[got["doc_id"].isna()]["text_crc32"]) == {0}


def test_odd_inputs(spark):
    schema = "doc_id long, text string, shard string, slot string, part string, place string, n string"
    assert shuffle_into_shards(spark.createDataFrame([], schema)).collect() == []
    got = shuffle_into_shards(spark.createDataFrame([(1, "", "x", "x", "x", "x", "x"), (None, "b" * 300_000, "x", "x", "x", "x", "x")], schema)).toPandas()
    assert sorted(got["size"]) == [1, 300_001] and sorted(got["shard"]) == [0, 1] and set(got["slot"]) == {0}
