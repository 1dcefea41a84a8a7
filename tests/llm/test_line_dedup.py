import random
import time

from strataprof.llm import line_dedup


def brute_lines(rows):
    def key(x):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        if i is not None and t is not None:
            for x in t.split("\n"):
                held.setdefault(key(x), set()).add(i)
    hot = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in rows:
        xs = (t or "").split("\n")
        keep = [x for x in xs if i is None or hot.get(key(x), i) == i]
        out.append((i, len(xs), len(xs) - len(keep), "\n".join(keep)))
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["A line that is long enough é", "a line that is LONG enough é ", "short", "", "another repeated line of text", "\x0b tab line that repeats here\t"]
    rows = [(i, "\n".join(rng.choice(pool + [f"unique line number {i} {rng.random()}"]) for _ in range(rng.randint(1, 8)))) for i in range(40)]
    rows += [(50, None), (51, ""), (None, pool[0]), (3, rows[3][1]), (60, "\n".join(pool * 500))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_lines string")
    got = sorted((tuple(r) for r in line_dedup.drop_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)
    assert got == sorted(brute_lines(rows), key=str)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_long_documents_cost_by_their_length(spark):
    """A dropped line among very many: the text is split once, not once for each line."""
    took, last = {}, "a line that three documents hold"
    for extra in ("", last + "\n"):
        text = extra + "\n".join(f"line {i}" for i in range(100_000))
        df = spark.createDataFrame([(1, text), (2, last), (3, last), (4, last)], "doc_id long, text string")
        began = time.time()
        got = line_dedup.drop_repeated_lines(df).where("doc_id = 1").first()
        took[extra] = time.time() - began
        assert (got["n_lines"], got["n_dropped"], got["kept_text"]) == (100_000 + bool(extra), int(bool(extra)), text[len(extra) :])
    assert took[last + "\n"] < 3 * took[""] + 5
