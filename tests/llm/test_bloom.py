import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataprof.llm import bloom_lm

learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def corpus():
    rng = random.Random(6)
    vocab = ["w%d" % i for i in range(60)]
    texts = [" ".join(rng.choice(vocab[: 1 + int(60 * rng.random() ** 3)]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "Unseen é Words", "w1 " * 3000]
    return list(enumerate(texts)) + [(5, texts[5]), (None, "w1 W2 w3"), (90, texts[7])]


def brute(rows, prior):
    """Per row: tokens, known ones, tokens in training, base score and model score by exact counts."""
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for _, t in rows]
    train = [ws for (i, _), ws in zip(rows, toks) if learns(i)]
    one = Counter(w for ws in train for w in ws)
    two = Counter(p for ws in train for p in zip([None, *ws], ws))
    n, v = sum(one.values()), len(one)
    about = lambda c: float(bloom_lm.expected_count(bloom_lm.levels(np.array([c])))[0]) if c else 0.0
    out = []
    for (i, _), ws in zip(rows, toks):
        score = 0.0
        for a, b in zip([None, *ws], ws):
            past, own = about(one[a]), about(one[b])
            score += math.log10((min(about(two[a, b]), past, own) + prior * (own + 1) / (n + v + 1)) / (past + prior))
        out.append((i, len(ws), sum(one[w] > 0 for w in ws), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws), score))
    return out


@pytest.mark.parametrize("most_broadcast", [1 << 27, 0])
@pytest.mark.parametrize("slice_chars,segment_tokens", [(1 << 23, 1 << 20), (500, 40), (1, 1)])
def test_scores_against_exact_counts(spark, slice_chars, segment_tokens, most_broadcast):
    """Any cut into slices and segments, broadcast or not, gives the scores of exact counts: nothing is left out."""
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, words string").repartition(3)
    got = bloom_lm.score(df, ~bloom_lm.held_out("doc_id", 7, 2) & F.col("doc_id").isNotNull(), prior=20.0, slice_chars=slice_chars, segment_tokens=segment_tokens, bits_per_item=64, most_broadcast=most_broadcast)
    got, want = (sorted(map(tuple, x), key=lambda r: (r[0] is None, r)) for x in (got.collect(), brute(rows, 20.0)))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)


def test_nothing_to_learn_and_nothing_to_score(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in bloom_lm.score(df, F.lit(None)).orderBy("doc_id").collect()] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert bloom_lm.score(df.limit(0), F.lit(True)).count() == 0


def test_filter_never_underestimates():
    keys = np.arange(1, 2001, dtype=np.uint64) * np.uint64(7919)
    counts = 1 + (np.arange(2000) ** 2) % 500
    bits = bloom_lm.segment_bits(keys, counts)
    made = bloom_lm.Filter.of(3, [(2, bits)], len(bits))
    at = np.full(2000, 2)
    got, want = made.level(keys, at), bloom_lm.levels(counts)
    assert (got >= want).all() and (got == want).mean() > 0.97
    assert (made.level(keys + np.uint64(1), at) > 0).mean() < 0.03
    assert not made.level(keys, at - 1).any()


def test_both_ways_probe_the_same_filter(spark):
    """With a filter so tight that it errs, broadcast and segments err alike."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    ways = [
        sorted(map(tuple, bloom_lm.score(df, F.col("doc_id") % 2 == 0, slice_chars=900, segment_tokens=100, bits_per_item=3, most_broadcast=b).collect()), key=str)
        for b in (1 << 27, 0)
    ]
    assert ways[0] == ways[1]


def test_never_more_rows_than_ngrams(spark):
    """Segments in plenty: a row for each n-gram of a slice at most, and twice the texts are twice the rows."""
    text = " ".join("w%d" % (i * i % 97) for i in range(400))
    ws = text.split() + [None]
    most = len(set(ws)) + len(set(zip([None, *ws], ws)))
    rows = []
    for copies in (4, 8, 16):
        df = spark.createDataFrame([(i, text) for i in range(copies)], "doc_id long, text string").coalesce(1)
        slices = bloom_lm._slices(df, "doc_id", "text", F.lit(True), slice_chars=1)
        rows.append(bloom_lm._sent(slices, 1 << 20, True).count())
        assert rows[-1] <= copies * most
    assert rows[1] == 2 * rows[0] and rows[2] == 4 * rows[0]
