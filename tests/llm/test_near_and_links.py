import math
import random

from strataprof.llm import itq, minhash
from strataprof.llm.common import shingle_set


def closure(ids, links):
    up = {i: i for i in ids}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_near(rows, words):
    sets = {i: set(shingle_set(t or "", words).tolist()) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = closure(ids, links)
    return sorted((i, len(sets[i]), comp[i], comp[i] == i) for i in ids)


def corpus(seed=2, copies=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    texts = [" ".join(word() for _ in range(rng.randint(1, 150))) for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(0, 90))]) for _ in range(80)]
    for _ in range(copies):  # near copies, some of them only through others
        t = list(base)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    return texts + [texts[0], texts[0].upper(), "one two", "ONE\ttwo", "one", "", "  ", None]


def test_near_duplicates_against_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item string")
    for words in (4, 5):
        got = sorted(map(tuple, minhash.near_duplicates(df, words=words).collect()))
        assert got == brute_near(rows, words)


def test_collisions_against_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minhash.signatures(df, "doc_id", "text", 4).where("n > 0")
    signature_of = {r["id"]: r["items"] for r in sets.collect()}
    pairs = [(a, b) for a in signature_of for b in signature_of if a < b]
    got = minhash.collisions(spark.createDataFrame(pairs, "a long, b long"), sets)
    assert {(r["a"], r["b"]): r["matches"] for r in got.collect()} == {
        (a, b): sum(x == y for x, y in zip(signature_of[a], signature_of[b])) for a, b in pairs
    }


def test_near_duplicates_with_shuffled_prefixes_and_many_blocks(spark, monkeypatch):
    """The ways for tables too large to broadcast, and for postings of several blocks, give the same rows."""
    rows = list(enumerate(corpus(copies=80))) + [(1000, "long " + "lorem ipsum dolor sit amet " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "MOST_BROADCAST", 0)
    monkeypatch.setattr(minhash, "SHORT", 8)
    monkeypatch.setattr(minhash._cross_pairs, "__defaults__", (16,))
    assert sorted(map(tuple, minhash.near_duplicates(df, words=4).collect())) == brute_near(rows, 4)


def test_near_duplicates_of_odd_rows(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "x y z x y"), (2, "x y z x y"), (3, None)], schema)
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, words=4).collect()}
    assert got[(None, 3)] == (None, False) and got[(1, 3)] == (1, True) and got[(2, 2)] == (1, False) and got[(3, 0)] == (3, True)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def brute_vectors(rows):
    ok = {}
    for i, v, g in rows:
        if v and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (v, g)
    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and cos(ok[a][0], ok[b][0]) >= 0.98]
    comp = closure([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], comp[i], comp[i] == i) for i in n)


def test_vectors_against_brute_force(spark):
    rng = random.Random(4)
    gauss = lambda: [round(rng.gauss(0, 1), 3) for _ in range(16)]
    rows = [(i, gauss(), i % 3) for i in range(150)]
    centre = gauss()
    rows += [(200 + i, [x + rng.gauss(0, 0.06) for x in centre], 1) for i in range(60)] + [(300 + i, list(centre), 1) for i in range(8)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + centre[1:], 1), (403, list(centre), None), (404, [None] + centre[1:], 1), (405, centre[:8], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, itq.link_vectors(df).collect())) == brute_vectors(rows)
    assert itq.link_vectors(df.limit(0)).count() == 0
    assert itq.link_vectors(df.where("embedding is null")).first()["component_id"] == 400


def test_vectors_in_a_narrow_cone(spark):
    """Links about one direction, where codes about the origin or the mean say little, are found all the same."""
    rng = random.Random(14)
    rows = []
    for label, spread in ((1, 0.035), (2, 0.02), (3, 0.05)):
        centre = [rng.gauss(0, 1) for _ in range(32)]
        norm = math.sqrt(sum(x * x for x in centre))
        rows += [(label * 1000 + i, [x / norm + rng.gauss(0, spread) for x in centre], label) for i in range(220)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = sorted(map(tuple, itq.link_vectors(df, block=64).collect())), brute_vectors(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in want) > 0
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(want)


def test_vectors_of_odd_rows(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1e-200, 1.0]
    rows = [(1, a, 1), (1, b, 1), (2, b, 1), (2, b, 1), (3, a, 1), (None, a, 1), (4, c, 1), (5, c + [0.0], 1), (6, [1e300 * x for x in a], 1), (7, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, m string")
    got = sorted(map(tuple, itq.link_vectors(df).collect()), key=str)
    assert len(got) == len(rows)
    assert {r[:3] for r in got} == {(1, 2, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1), (6, 2, 1), (None, 0, None), (4, 0, 4), (5, 0, 5), (7, 0, 7)}
