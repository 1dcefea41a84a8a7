import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strataprof.functions import stats, text
from strataprof.operators import lexical
from strataprof.plans import catalog


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_styles(spark):
    words = ["MAX_RATE", "GPU_Load", "Q_Z", "  fooBar  ", "Ledger", "net_price", "two-part", "a few words", "ÉTÉ", None, " "]
    got = column(spark, words, text.case_style)
    assert got == ["UPPER_CASE", "mixed", "UPPER_CASE", "camelCase", "PascalCase", "snake_case", "kebab-case", "lowercase", "UPPERCASE", "empty", "empty"]


def test_tokens(spark):
    tokens = text.tokenizer(text.TokenizerConfig(lowercase=True))
    want = {
        "fooBar": ["foo", "bar"], "PDFFileReader": ["pdf", "file", "reader"], "anURLList": ["an", "url", "list"], "payBill3": ["pay", "bill", "3"], "step9Close": ["step", "9", "close"],
        "r7TCPLink": ["r", "7", "tcp", "link"], "...": [], None: [], "Été ﬂot": ["été", "flot"],
    }
    assert column(spark, list(want), tokens) == list(want.values())
    bare = text.tokenizer(text.TokenizerConfig(lowercase=True, keep_numbers=False))
    assert column(spark, ["payBill3", "9 to 5"], bare) == [["pay", "bill"], ["to"]]


def test_single_and_multi_words(spark):
    labels = spark.createDataFrame([("one", i, "node", "T", t) for i, t in (("1", "ledger"), ("2", "net price"), ("3", "!!"), ("4", "invoice"))], "model_id string, label_id string, kind string, type string, label string")
    models = spark.createDataFrame([("one",), ("none",)], "model_id string")
    got = {r["model_id"]: r for r in lexical.words_per_model(lexical.tokenised(labels), models).collect()}
    assert (got["one"]["single"], got["one"]["multi"], got["one"]["single_share"]) == (2, 1, 0.5)
    assert got["none"]["single_share"] == 0


def histogram(spark, values, **options):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return [(r["bin_idx"], r["count"]) for r in stats.histogram(df, "v", **options).orderBy("bin_idx").collect()]


def test_histograms(spark):
    assert histogram(spark, [2.0, 2.1, 2.4, 3.0]) == [(0, 3), (1, 1)]
    assert histogram(spark, [1.0, 1.0, 7.0, 13.0], bins=4) == [(0, 2), (1, 0), (2, 1), (3, 1)]
    assert len(histogram(spark, [i / 7 for i in range(700)])) == 20
    assert histogram(spark, [None, float("nan"), float("-inf")]) == []
    assert histogram(spark, [5e-4, 5e-4, 5e-4]) == [(0, 3)]


def test_percentile_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    r = df.agg(*stats.summary("v", "x")).first()
    assert (r["x_p25"], r["x_median"], r["x_p75"]) == (1.75, 2.5, 4.75)
    assert df.limit(1).agg(*stats.summary("v", "x")).first()["x_std"] == 0.0


def test_language_usage_against_brute_force(spark, tmp_path):
    """Every labelled text teaches: here no id of language ``xx`` is divisible by 5."""
    words = {"en": "the cat sat on that mat", "de": "der Hund lief über die Straße", "xx": "qoqo zuzu qyqy zaza"}
    docs = [(i, f"{t} {'abc'[i % 3]}", lang, f"s{i % 2}", 1) for i in range(60) for lang, t in [("xx", words["xx"]) if i % 5 in (1, 2) else (("en", words["en"]) if i % 2 else ("de", words["de"]))]]
    docs += [(60, "the cat", None, "s0", 1), (61, "", "en", "s1", 1), (62, None, "de", "s3", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))

    def grams(t):
        t = " " + re.sub(r"[^a-zäöüß]+", " ", t.lower()) + " "
        return [t[i : i + 3] for i in range(len(t) - 2)]

    c, per = defaultdict(Counter), defaultdict(Counter)
    for i, t, lang, source, _ in docs:
        if lang:
            c[lang].update(grams(t or "") if t is not None else [])
        per[f"{source}/{i % 50}"].update(grams(t) if t is not None else [])
    known = set().union(*c.values())
    def logp(lang, g):
        return math.log((c[lang][g] + 0.5) / (sum(c[lang].values()) + 0.5 * len(known)))
    want = Counter()
    for seen in per.values():
        hit = {g: n for g, n in seen.items() if g in known}
        want[max(c, key=lambda lang: (sum(n * logp(lang, g) for g, n in hit.items()), lang)) if hit else "unknown"] += 1
    got = {r["language"]: r["n_models"] for r in catalog.QUERIES["lexical_language_usage"](spark, str(tmp_path)).collect()}
    assert got == dict(want) and got["xx"] > 0 and got["unknown"] == 1


def test_ngrams_are_of_code_points_and_texts_are_read_once(spark, tmp_path):
    """A letter outside the basic plane is one; no n-gram crosses two texts; and a profile keeps its counts as a table."""
    from strataprof.operators import lexical

    docs = spark.createDataFrame([("a", "x\U0001F600ab \U00010400c\n"), ("a", "AB"), ("b", ""), ("b", None), (None, "ab")], "lang string, text string")

    def want(n):
        out = Counter()
        for lang, t in [("a", " x ab \U00010428c  "), ("a", " ab "), ("b", "  "), (None, " ab ")]:
            out.update((lang, t[i : i + n]) for i in range(len(t) - n + 1))
        return dict(out)

    for n in (2, 3, 5):
        assert {(r["lang"], r["gram"]): r["c"] for r in lexical.gram_counts(docs, ["lang"], "text", n).collect()} == want(n)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lexical.language_profile(docs.mapInArrow(count, docs.schema)).collect()
    assert seen.value == 5
