"""Features, lexicon and calibration of toxicity against plain counting."""

import math
import random

from strataprof.llm import toxicity


def plain_features(text, lexicon, stems):
    words, word = [], ""
    for ch in text + " ":
        if ch.isalpha():
            word += ch
        elif word:
            words.append(word)
            word = ""
    out = dict.fromkeys(toxicity.FEATURES, 0.0)
    if not words:
        return out
    n = len(words)
    spots, best = [], []
    for i, w in enumerate(w.lower() for w in words):
        found = [d[w] for d in (lexicon,) if w in d] + [stems[w[:k]] for k in (4, 5) if w[:k] in stems]
        out["hits"] += w in lexicon
        out["stem_hits"] += any(w[:k] in stems for k in (4, 5))
        out["you_density"] += (w in toxicity.SECOND_PERSON) / n
        if found:
            spots.append(i)
            best.append(max(found))
    out["near_you"] = sum(any(abs(i - j) <= 5 and words[j].lower() in toxicity.SECOND_PERSON for j in range(n)) for i in spots)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    out |= {
        "log_words": math.log(1 + n), "hit_density": out["hits"] / n, "stem_density": out["stem_hits"] / n, "best": max(best, default=0.0),
        "weight": sum(best), "capitals": upper / max(1, upper + lower), "all_caps": sum(w == w.upper() and w != w.lower() for w in words) / n,
        "punctuation": sum(33 <= ord(c) <= 126 and not c.isalnum() for c in text) / max(1, len(text.encode())), "exclaims": text.count("!") / n,
    }
    return out


def test_features_against_plain_counting():
    rng = random.Random(4)
    pool = "you YOU du fool foolish idiotic Idiot calm été Straße ok I a, b. !!! ?? <p> x-y 12 ; (so)".split()
    lexicon, stems = {"fool": 2.5, "idiot": 3.0}, {"fool": 2.0, "idiot": 1.5}
    exact = [f for f in toxicity.FEATURES if f not in ("odd_rate", "odd_hits", "repeats")]
    for _ in range(300):
        text = rng.choice((" ", "\n", "  ")).join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        got, want = dict(zip(toxicity.FEATURES, toxicity.features(text, lexicon, stems))), plain_features(text, lexicon, stems)
        assert all(math.isclose(got[f], want[f], abs_tol=1e-12) for f in exact), text
    got = dict(zip(toxicity.FEATURES, toxicity.features("f00l f0ol id1ot sooo niiice ok", lexicon, stems)))
    assert got["odd_hits"] == 3 and math.isclose(got["repeats"], 2 / 9)  # nine runs of letters: f l f ol id ot sooo niiice ok


def test_lexicon_against_counting(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"word{chr(97 + rng.randrange(26))}" for _ in range(8)] + (["Vile", "vilest"] if toxic and rng.random() < 0.6 else [])
        rows.append((int(toxic), " ".join(words + (["rude"] if rng.random() < (0.5 if toxic else 0.02) else []))))
    words, stems = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    bad, n = sum(t for t, _ in rows), len(rows)

    def odds(pick, least):
        out = {}
        for w in {x for _, s in rows for x in pick(s)}:
            t, c = (sum(w in pick(s) for x, s in rows if x == k) for k in (1, 0))
            score = math.log((t + 0.5) / (bad + 1)) - math.log((c + 0.5) / (n - bad + 1))
            if t >= least and score >= math.log(6):
                out[w] = score
        return out

    for got, want in ((words, odds(lambda s: set(s.lower().split()), 4)), (stems, odds(lambda s: {w[:k] for w in s.lower().split() if len(w) > 4 for k in (4, 5)}, 8))):
        assert got.keys() == want.keys() and all(math.isclose(got[w], want[w]) for w in got)
    assert {"vile", "vilest", "rude"} <= words.keys() and "viles" in stems


def pooled(points):
    """Isotonic regression by pooling adjacent violators; points of one p are averaged first."""
    by_p = {}
    for p, y in points:
        by_p.setdefault(p, []).append(y)
    blocks = []
    for p in sorted(by_p):
        blocks.append([sum(by_p[p]), len(by_p[p]), [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, k, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + k, blocks[-1][2] + ps]
    return {p: s / k for s, k, ps in blocks for p in ps}


def test_calibration_against_pooling(spark):
    rng = random.Random(8)
    texts = [(i, f"{rng.choice(('you', 'they'))} {rng.choice(('vile', 'fine', 'rude', 'calm'))} {rng.choice(('dog', 'cat', 'sun'))}") for i in range(1500)]
    labels = [(i, int(rng.random() < (0.8 if "vile" in t else 0.6 if "rude" in t else 0.05))) for i, t in texts]
    docs, lab = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab, trees=4)
    from pyspark.sql import functions as F
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(6))
    rows = toxicity._probability(model.trees, toxicity._assembled(model.with_features(docs.where(part == 5), "text", ["doc_id"]))).select("doc_id", "p").collect()
    known = dict(labels)
    want = pooled([(r["p"], known[r["doc_id"]]) for r in rows])
    got = {r["doc_id"]: r["score"] for r in model.transform(docs.where(part == 5)).collect()}
    assert rows and all(math.isclose(got[r["doc_id"]], want[r["p"]], abs_tol=1e-9) for r in rows)
