import math
import random
import re
import time
import zlib

import numpy as np

from strataprof.llm import decontaminate, pii, toxicity


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(q) > 255 for q in m[0].split(".")) or k == "card" and not (16 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pattern_spans(spark):
    texts = [
        "a@b@c.d e._%+@x.y.z@q.w 1.2.3.4.5.6.7.8.9 1.2.3 999.1.1.1 +1 (456) 555-2186 4041894974608795 4041 8949 7460 8795x 4041-8949-7460-8795-11 +12",
        "4041  8949 7460 8795 10.0.0.1 0.0.0.0255 0.00.0.256 1.1.1.300", "é🙂a@b.c🙂1.1.1.1 +123456789)) 4041894974608795", "9" * 3000 + " " + "1 " * 4000 + "a." * 3000 + "@x" + ".y" * 3000, "", None,
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "b@c.d", "y")], "doc_id long, text string, kind string")
    got = {r["_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_spans(df).collect()}
    for i, t in enumerate(texts):
        assert got.get(i, []) == brute_spans(t or "")
    assert got[None] == [("email", 0, 5)]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_revealing_terms_and_sanitising(spark):
    ends = [("red", "sun"), ("blue", "moon"), ("green", "mars"), ("odd", "fun")]
    texts = [f"Zorbo wrote from zq@x.org about {a} things and {b}" for a, b in ends] + [f"the cat number {i} wrote here about things and from" for i in range(60)]
    texts += ["a copy holds one@y.org beside Quimby"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(df).collect()}
    assert out[0] == "[...] wrote from [EMAIL] about red things and sun"
    assert out[10] == texts[10]
    assert out[64] == "a copy holds [EMAIL] beside Quimby"  # twenty copies are one observation


def test_disclosure_against_counting_all_pairs(spark):
    import duckdb
    import pandas as pd
    rng = random.Random(12)
    people = [f"user{i}@mail{i % 7}.org" for i in range(12)] + ["4111 1111 1111 1111", "4111-1111-1111-1111", "+44 20 7946 0000"]
    own = [[f"Own{chr(97 + i)}{k}" for k in "xyz"] for i in range(len(people))]
    texts = []
    for n in range(400):
        words = [f"w{chr(97 + rng.randrange(20))}{chr(97 + rng.randrange(20))}" for _ in range(rng.randint(0, 30))]
        for i in rng.sample(range(len(people)), rng.choice((0, 0, 1, 1, 2, 9))):
            at = rng.randint(0, len(words))
            words[at:at] = [*rng.sample(own[i], rng.randint(0, 3)), f"k{n}", people[i], f"z{n}"]
        texts.append(" ".join(words))
    texts += texts[:5] + ["", None, " ".join(f"d{i} {p} {' '.join(o)}" for i, (p, o) in enumerate(zip(people, own)))]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.from_df(docs).query("documents", pii.ORACLE).df().set_index("doc_id")["spans"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) for r in pii.find_spans(df).collect()}
    assert {i: s for i, s in want.items() if s} == got
    assert sum(s.count("term") for s in got.values()) > 200


def test_a_directory_is_not_multiplied_out(spark):
    import time
    n, m = 4000, 20_000
    big = " ".join(f"t{i} u{i}@x.org" if i < n else f"t{i}" for i in range(m))
    texts = [big] + [f"p{k} {i} u{i}@x.org q{k} {i} secret{i}" for i in range(n) for k in range(3)] + [f"t{i} t{i + 1} t{i + 2}" for i in range(0, m, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    start = time.time()
    found = {r["_id"]: r["spans"] for r in pii.find_spans(df).collect()}
    assert time.time() - start < 90
    assert sum(s["kind"] == "email" for s in found[0]) == n and not any(s["kind"] == "term" for s in found[0])
    assert all(any(s["kind"] == "term" for s in found[i]) for i in range(1, 3 * n + 1))


def test_alignment_against_plain_dp():
    import numpy as np
    rng = random.Random(8)
    for _ in range(200):
        a, b = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 12))]) for _ in range(2)]
        h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
        assert math.isclose(decontaminate.align(a, b)[0], max(map(max, h)) / len(a), abs_tol=1e-9)


def test_leaks(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(15, 50))) for _ in range(30)]
    def edited(t):
        return " ".join(word() if rng.random() < 0.15 else w for w in t.split())
    clean = [" ".join(word() for _ in range(200)) for _ in range(60)]
    docs = clean + [f"{clean[i][:300]} {edited(t)} {clean[i][300:]}" for i, t in enumerate(items)] + [None, "", items[0].upper() + "."]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(docs)], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, "two words"), (None, "x")], "item_id long, text string")
    for chars in (4_000_000, 1500):  # in one block, in several
        got = decontaminate.contaminated(df, bench, most_chars=chars).collect()
        assert {(60 + i, i) for i in range(30)} | {(92, 0)} == {(r["doc_id"], r["item_id"]) for r in got}
    assert decontaminate.clean(df, bench).count() == len(docs) - 31
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_hits_against_aligning_every_pair(spark):
    """All pairs of document and item by plain alignment of whole texts give the same hits and scores."""
    import numpy as np

    rng = random.Random(21)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 25))) for _ in range(12)]
    docs = []
    for i in range(60):
        body = [rng.choice(words + ["x", "y", "z"]) for _ in range(rng.randint(0, 60))]
        copy = [w if rng.random() > 0.2 else rng.choice(["x", *words]) for w in items[i % 12].split() if rng.random() > 0.1]
        at = rng.randint(0, len(body))
        docs.append(" ".join(body[:at] + (copy if i % 3 else []) + body[at:]))
    rows = list(enumerate(docs)) + [(7, docs[7]), (None, items[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)) + [(100, items[3])], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in decontaminate.contaminated(df.drop("item_id"), bench).collect()), key=str)
    number = {w: i for i, w in enumerate([*words, "x", "y", "z"])}
    code = lambda t: np.array([number[w] for w in t.split()], dtype=np.int64)
    want = []
    for i, t in rows:
        for k, item in [*enumerate(items), (100, items[3])]:
            score = decontaminate.align(code(item), code(t))[0] if t else 0.0
            if score >= 0.4:
                want.append((i, k, round(score, 9)))
    assert got == sorted(want, key=str)


def test_a_long_document_with_many_copies(spark):
    item = " ".join(f"q{i}" for i in range(30))
    df = spark.createDataFrame([(1, "filler text " * 40_000 + (item + " and ") * 50 + "tail " * 1000)], "doc_id long, text string")
    r = decontaminate.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(r) == 1 and r[0]["score"] == 1.0 and r[0]["first_word"] == 80_000  # of equal scores the first stretch


def test_edited_copies_beside_whole_ones(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (15, 25, 40)]
    def edited(t, every):
        return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(t.split()))
    docs = [t for t in items for _ in range(3)] + [f"before it {edited(t, every)} after it" for every in (6, 5, 4, 3) for t in items]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(i, i // 3) for i in range(9)} | {(9 + i, i % 3) for i in range(12)}
    assert all(got[i, i // 3] == 1 for i in range(9)) and 0.7 < got[9, 0] < 0.85


def test_no_stretch_over_the_threshold_is_left_unaligned():
    import numpy as np
    rng = random.Random(13)
    for _ in range(300):
        m = rng.randint(6, 20)
        words = [str(rng.randrange(12)) for _ in range(m)]
        doc = [str(rng.randrange(14)) for _ in range(rng.randint(0, 40))]
        copy = [rng.choice([w, w, w, str(rng.randrange(14))]) for w in words if rng.random() > 0.1]
        at = rng.randint(0, len(doc))
        doc[at:at] = copy
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        item = np.array([number[w] for w in words])
        ids = np.array([number.get(w, -1) for w in doc])
        found = decontaminate.Block(["x"], [item], number, *decontaminate.seeds_of([item])).find(" ".join(doc), 0.4)
        want = decontaminate.align(item, ids)[0]
        assert [h[1] for h in found] == ([want] if want >= 0.4 else [])


def test_toxic_held_out(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        ws = [word() for _ in range(rng.randint(5, 60))]
        for _ in range(2 * toxic):
            ws.insert(rng.randrange(len(ws)), rng.choice(["zzidiot", "zzscum", "zzmoron"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "x")]
    labels += [(5000, None), (None, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, features int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    test = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    got = {r["doc_id"]: r for r in toxicity.fit(docs, lab.where(~toxicity.held_out("doc_id", 5, 0)), trees=8).transform(docs).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["predicted"], i % 5 == 0) for i in range(900) if test(i)]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert toxicity.fit(docs, lab.limit(0)).transform(docs).where("score <> 0").count() == 0


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(i, f"you are lovely {i}" if i % 2 else f"you are zzidiot {i}", 1) for i in range(200)] + [(900, "you are zzidiot " * 50_000, 1)], "doc_id long, text string, score int")
    lab = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] * 2, "doc_id long, toxic int")  # each label twice
    model = toxicity.fit(docs, lab, trees=3)
    got = {r["doc_id"]: r["predicted"] for r in model.transform(docs.unionByName(docs.limit(5))).collect()}
    assert got[900] == 1 and sum(got[i] == 1 - i % 2 for i in range(200)) >= 190
    assert model.transform(docs.limit(0)).count() == 0
    assert toxicity.fit(docs.limit(0), lab).transform(docs).where("score <> 0").count() == 0


def test_common_pairs_of_long_documents_and_many_items_are_not_multiplied():
    """Items that all repeat a common pair, and a long document that repeats it too: time goes with the length."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(20_000)]
    vocabulary, items = {}, []
    for _ in range(5000):
        words = [rng.choice(pool) for _ in range(14)]
        for at in (12, 7, 2):
            words[at:at] = ["of", "the"]
        items.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]))
    block = decontaminate.Block(list(range(5000)), items, vocabulary, *decontaminate.seeds_of(items))
    took = {}
    for n in (800, 12_800):
        text = " ".join("of the" if i % 20 == 0 else rng.choice(pool) for i in range(n))
        began = time.process_time()
        assert block.find(text, 0.4) == []
        took[n] = time.process_time() - began
    assert took[12_800] < 3 and took[12_800] < 60 * took[800]
    names = {i: w for w, i in vocabulary.items()}
    leak = [names[x] for x in items[77]]
    leak[5] = "other"
    text = " ".join(rng.choice(pool) for _ in range(3000)) + " " + " ".join(leak) + " " + " ".join(rng.choice(pool) for _ in range(3000))
    assert [(k, x) for k, _, _, x, _ in block.find(text, 0.4)] == [(77, 3000)]


def test_entities_of_documents_without_ids_have_terms(spark):
    said = [f"{w} zebrafish a@b.cd {w} more {w}" for w in ("one", "two", "three", "four")]
    rest = [f"plain words {i}" for i in range(200)]

    def terms(ids):
        df = spark.createDataFrame(list(zip(ids, said + rest)), "doc_id long, text string")
        return sum(x["kind"] == "term" for r in pii.find_spans(df).collect() for x in r["spans"])

    named = terms(range(204))
    assert named >= 4 and terms([None] * 4 + list(range(200))) == named


def test_terms_in_capitals_that_change_when_lowered(spark):
    """Counted and placed alike: a dotted capital I, and a sigma whose small letter depends on what follows."""
    import duckdb
    import pandas as pd

    texts = [f"k{n} {word} k{n} {who} z{n} {n}" for who, word in (("a@b.cd", "İstanbul"), ("b@b.cd", "ΛΟΓΟΣ"), ("c@b.cd", "ΟΔΟΣ.α"), ("d@b.cd", "ÉCOLE")) for n in range(4)]
    texts += ["λογοσ b@b.cd n1", "οδος c@b.cd n2", "istanbul a@b.cd n3", *(f"plain words {i}" for i in range(300))]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.from_df(docs).query("documents", pii.ORACLE).df().set_index("doc_id")["spans"]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"]) for r in found}
    assert {i: s for i, s in want.items() if s} == got
    assert all("term:" in got[4 * k + n] for k in range(4) for n in range(4))
