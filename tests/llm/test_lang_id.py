import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from strataprof.llm import lang_id

WORDS = {"aa": "the of and that with this from have for was ing tion".split(), "bb": "der die und nicht ist ein mit sich auf für ung keit".split()}


def sample(n=300, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang) for i in range(n) for lang in [rng.choice("ab") * 2]]


def test_languages_held_out(spark):
    rows = sample() + [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (1003, "the of and", None), (1004, "the " * 100_000, "aa"), (None, "und die der", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lang_id.classify(df, lang_id.learn(df)).collect()}
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0 and got[1000]["rejected"]
    test = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["lang_pred"] == lang for i, lang in test) >= 0.98 * len(test)
    assert got[1003]["lang_pred"] == "aa" and got[1004]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lang_id.classify(df, lang_id.learn(df)).first()["lang_pred"] == "und"


def test_language_model_is_a_distribution(spark):
    df = spark.createDataFrame(sample(), "doc_id long, text string, lang string")
    m = lang_id.fit(df, order=3)
    alphabet = sorted({int(c) for _, t, _ in sample() for c in lang_id.letters_of(t)})
    ctx = lang_id.letters_of("the of")[:4]
    total = np.zeros(len(m.langs))
    for c in alphabet:
        cps = np.append(ctx, np.uint32(c)).astype(np.uint32)
        total += np.exp(m._below(cps, np.array([len(cps) - 1]), 3))
    assert np.all(total > 0.75) and np.all(total <= 1.0001)  # the rest is kept for letters never seen


def brute_kneser_ney(texts, order, d):
    """Plain interpolated Kneser-Ney over strings of one language: the probability of a character after a history."""
    grams = Counter(t[i : i + n] for t in texts for n in range(1, order + 1) for i in range(len(t) - n + 1))
    cont = defaultdict(set)
    for g in grams:
        if len(g) > 1:
            cont[g[1:]].add(g[0])
    count = lambda g: grams[g] if len(g) == order else len(cont.get(g, ()))
    of_hist = defaultdict(list)
    for g in grams:
        of_hist[g[:-1], len(g)].append(count(g))
    kinds, total = sum(c > 0 for c in of_hist["", 1]), sum(of_hist["", 1])

    def p(g):
        if len(g) == 1:
            return max(count(g) - d, 0) / total + d * kinds / total / (kinds + 1000)
        seen = of_hist.get((g[:-1], len(g)), [])
        below = p(g[1:])
        return max(count(g) - d, 0) / sum(seen) + d * sum(c > 0 for c in seen) / sum(seen) * below if sum(seen) else below

    return p


def test_entropies_against_plain_kneser_ney(spark):
    rows = sample(60)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.build(lang_id._gathered(lang_id.count_grams(df, "lang", "text", 4)), 4, 0.75)
    as_text = lambda t: "".join(map(chr, lang_id.letters_of(t)))
    plain = [brute_kneser_ney([as_text(t) for _, t, g in rows if g == lang], 4, 0.75) for lang in model.langs]
    for text in [rows[0][1], rows[1][1], "und nicht the of", "zzz qqq", "ñ the", "a"]:
        t = as_text(text)
        got, n = model.entropies(text)
        assert n == len(t) - 1
        for h, p in zip(got, plain):
            assert math.isclose(h, -sum(math.log(p(t[max(0, i - 3) : i + 1])) for i in range(1, len(t))) / n, rel_tol=1e-9)


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS["aa"]) for _ in range(20)), "aa") for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(WORDS["bb"]) for _ in range(2000)), "bb") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(df)
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in lang_id.classify(df, model, keep=["lang"]).collect())
    odd = spark.createDataFrame([(1, "xqzj kvwx jjqz vvkx wqxz " * 20), (2, "Жили были дед да баба и ели кашу с молоком " * 5)], "doc_id long, text string")
    assert all(r["rejected"] for r in lang_id.classify(odd, model).collect())


def test_scores_are_calibrated(spark):
    """Texts that mix two languages: of those scored near s, about the share s goes to the language of most words."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS[lang] if rng.random() < 0.75 else WORDS["ab".replace(lang[0], "") * 2]) for _ in range(rng.randint(1, 12))), lang) for i in range(900) for lang in [rng.choice("ab") * 2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.classify(df, lang_id.learn(df), keep=["doc_id", "lang"]).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == r["lang"] for r in held) / len(held)
    assert abs(np.mean([r["score"] for r in held]) - right) < 0.08


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "the of and", "aa", 5.0)] * 3 + [(2, "the of and", "bb", 6.0)] * 3, "doc_id long, text string, lang string, score double")
    model = lang_id.fit(df)
    got = lang_id.classify(df, model, keep=["doc_id", "score", "lang"])
    assert got.columns == ["doc_id", "lang", "lang_pred", "score", "entropy", "rejected"]
    assert {r["lang_pred"] for r in got.collect()} == {"aa"} and got.count() == 6  # a tie: the first by name
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in got.collect())
    assert lang_id.classify(df.limit(0), model).count() == 0
    none = lang_id.fit(df.limit(0))
    assert {r["lang_pred"] for r in lang_id.classify(df, none).collect()} == {"und"}
