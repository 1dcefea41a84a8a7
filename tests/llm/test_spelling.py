"""Spelling variants by k-d trees, against all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np

from strataprof.llm import spelling
from strataprof.llm.spelling import build, inserted, letter_counts, near_rows, replaced, spread, variants, vocabulary


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    """{word: n} -> {word: (form, root, n, n_near, form_n)}"""
    form = {}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    for w, xs in near.items():
        top = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def result(df, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants(df, **options).collect()}


def texts_of(words):
    return " ".join(w for w, n in words.items() for _ in range(n))


def some_words(n, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéßiou") for _ in range(rng.randint(6, 9))) for _ in range(n)]
    out = {}
    for w in base:
        out[w] = rng.choice([5, 25, 30, 125, 700])
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            out[rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxÿ") + w[i:], w[:i] + rng.choice("abxÿ") + w[i + 1 :]])] = rng.choice([5, 6, 25, 26])
        out["".join(rng.sample(w, len(w)))] = 7  # an anagram
    return {w: n for w, n in out.items() if len(w) >= 6}


def test_equals_all_pairs(spark, monkeypatch):
    """With cells of few words, cells dealt in blocks, and trees from a part of the words."""
    words = some_words(120, 2)
    want = brute(words)
    df = spark.createDataFrame([(1, texts_of(words)), (2, None)], "doc_id long, text string")
    assert sum(x[3] > 0 for x in want.values()) > 150
    assert result(df, noise=0) == want
    monkeypatch.setattr(spelling, "CELL", 8)
    assert result(df, noise=0) == want
    few = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda w: few(w, most_sample=60))
    assert result(df, noise=0) == want


def test_chains_of_forms_end_at_their_root(spark):
    words = {"abcdefgh": 5, "abcdefgx": 25, "abcdefyx": 125, "abcdezyx": 625, "abcdezy": 3125, "aaaaaa": 9}
    got = result(spark.createDataFrame([(1, texts_of(words))], "doc_id long, text string"), noise=0)
    assert got == brute(words)
    assert {w: x[1] for w, x in got.items()} == {w: "abcdezy" if w != "aaaaaa" else w for w in words}


def test_trees_prune_nothing_that_is_near():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcde") for _ in range(7)) for _ in range(900)})
    longer = sorted({"".join(rng.choice("abcde") for _ in range(8)) for _ in range(900)})
    for there in (words, longer):
        letters = spread(there)
        tree, members = build(letter_counts(letters), 5)
        assert sorted(np.concatenate(members).tolist()) == list(range(len(there))) and len(members) > 50
        a, b = near_rows(spread(words), letters, tree, members)
        got = sorted(zip(a.tolist(), b.tolist()))
        assert got == sorted((i, j) for i, x in enumerate(words) for j, y in enumerate(there) if one_edit(x, y))
        # and they prune: far fewer pairs are verified than there are
        seen = sum(len(at) * len(members[leaf]) for leaf, at in tree.visit(letter_counts(spread(words)), 1, int(there is words)))
        assert seen < 0.4 * len(words) * len(there)


def test_letters_are_verified_in_order():
    pair = lambda a, b: (spread([a]), spread([b]))
    assert replaced(*pair("abcdef", "abcxef")) and not replaced(*pair("abcdef", "abcdef")) and not replaced(*pair("abcdef", "bacdef"))
    assert inserted(*pair("abcdef", "abccdef")) and inserted(*pair("abcdef", "xabcdef")) and inserted(*pair("abcdef", "abcdefx"))
    assert not inserted(*pair("abcdef", "bacdefx"))


def test_words_and_planted_misspellings(spark):
    rng = random.Random(3)
    pool = ["Straße", "naïveté", "ÉTUDES", "wording", "another×", "short", "divide÷d", "Misspelling"]
    docs = [(i, " ".join(rng.choice(pool) + rng.choice([" ", "-", "1", "_", "Ā"]) for _ in range(300))) for i in range(40)] + [(None, "wording " * 9), (7, None), (8, ""), (9, "z" * 200_000 + " ")] + [(41, "z" * 200_000)] * 5
    want = Counter()
    import re

    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 13 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, word string, n int").repartition(3)
    assert {r.word: r.n for r in vocabulary(df, noise=13).collect()} == want
    assert result(df, noise=13) == brute(want)


def test_empty(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == {}
    assert result(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")) == {}
