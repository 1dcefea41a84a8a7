"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from a bounded sample of labelled texts: words, and word beginnings for inflected forms, whose
odds of standing in toxic texts are high.  Features of a text are the densities of lexicon hits, how close second-person
words stand to them, shares of capitals and punctuation, and rates of obfuscated spellings.  Boosted trees are fitted
on another part of the sample and an isotonic regression on a third maps their probability to a calibrated score.

Null and empty texts have zero features and get a score like others.  Rows with a null label or id teach nothing;
repeated labels count as often as they occur.  Without two classes in the sample the score is the share of toxic rows
(0 if none).  Whole texts are read once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import bounded_fraction, cut, hash_fraction, held_out, per_text, table

#: Words that address the reader (fixed values; English, German, French, Spanish).
SECOND_PERSON = frozenset(
    "you your yours yourself u ya thou thee du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tuyo usted ustedes vosotros os su".split()
)
#: Characters that stand for letters in obfuscated words (fixed values).
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "-": None, ".": None, "_": None})
WORD = re.compile(r"[^\W\d_]+")
ODD = re.compile(r"[^\W\d_]+(?:[@$!*0-9._-]+[^\W\d_]+)+")
REPEAT = re.compile(r"([^\W\d_])\1{2,}")
FEATURES = (
    "log_words", "hits", "hit_density", "stem_hits", "stem_density", "best", "weight", "near_you", "you_density", "capitals",
    "all_caps", "punctuation", "exclaims", "odd_rate", "odd_hits", "repeats",
)
STEMS = (4, 5)


def features(text: str, lexicon: dict[str, float], stems: dict[str, float]) -> list[float]:
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    low = [w.lower() for w in words]
    hits = [i for i, w in enumerate(low) if w in lexicon]
    stem_hits = [i for i, w in enumerate(low) if w[:5] in stems or w[:4] in stems]
    places = sorted({*hits, *stem_hits})
    weights = [max(lexicon.get(low[i], 0.0), stems.get(low[i][:5], 0.0), stems.get(low[i][:4], 0.0)) for i in places]
    near = sum(1 for i in places if not SECOND_PERSON.isdisjoint(low[max(0, i - 5) : i + 6]))
    you = sum(map(SECOND_PERSON.__contains__, low))
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    size = np.bincount(data, minlength=256)
    upper, lower = int(size[65:91].sum()), int(size[97:123].sum())
    marks = int(size[33:48].sum() + size[58:65].sum() + size[91:97].sum() + size[123:127].sum())
    odd = ODD.findall(text)
    odd_hits = 0
    for w in odd:
        plain = w.lower().translate(LOOKALIKE)
        odd_hits += plain in lexicon or plain[:5] in stems
    return [
        math.log1p(n), float(len(hits)), len(hits) / n, float(len(stem_hits)), len(stem_hits) / n, max(weights, default=0.0), sum(weights),
        float(near), you / n, upper / max(1, upper + lower), sum(map(str.isupper, words)) / n, marks / max(1, len(data)),
        float(size[33]) / n, len(odd) / n, float(odd_hits), len(REPEAT.findall(text)) / n,
    ]


def learn_lexicon(sample: DataFrame, least: int = 4, odds: float = 6.0, most: int = 4000) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds of standing in a toxic text of the sample; at most ``most`` of each."""
    totals = sample.agg(F.sum("toxic"), F.count("*")).first()
    bad, n = float(totals[0] or 0), float(totals[1])
    if not bad or bad == n:
        return {}, {}
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    stems = sample.select(
        "toxic",
        F.explode(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0)), lambda w: F.array(*[F.substring(w, F.lit(1), F.lit(k)) for k in STEMS]))))).alias("w"),
    )

    def top(df: DataFrame, least: int) -> dict[str, float]:
        t = F.sum("toxic").alias("t")
        ratio = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (n - bad + 1))
        found = (
            df.groupBy("w").agg(t, F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") >= least)
            .withColumn("s", ratio).where(F.col("s") >= math.log(odds)).orderBy(F.desc("s"), "w").limit(most)
        )
        return {r["w"]: r["s"] for r in found.select("w", "s").collect()}

    return top(words, least), top(stems, 2 * least)


class Scorer:
    """A fitted lexicon, trees and calibration."""

    def __init__(self, lexicon, stems, trees, calibration, prior: float):
        self.lexicon, self.stems, self.trees, self.calibration, self.prior = lexicon, stems, trees, calibration, prior

    def with_features(self, df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.lexicon, self.stems))

        def fn(texts, rows):
            got = [features(t, *shared.value) for t in texts]
            return {name: [g[i] for g in got] for i, name in enumerate(FEATURES)}

        return per_text(df, text_col, fn, ", ".join(f"{f} double" for f in FEATURES), keep)

    def transform(self, df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
        """``id_col, score, predicted``."""
        src = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        if self.trees is None:
            scored = src.select("_id", F.lit(self.prior).alias("score"))
        else:
            raw = _assembled(self.with_features(src, "_text", ["_id"]))
            p = _probability(self.trees, raw)
            scored = self.calibration.transform(p).select("_id", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))
        return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def _probability(trees, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("p", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 16000, trees: int = 20, depth: int = 4, seed: int = 7) -> Scorer:
    """Learns from at most about ``most_rows`` labelled rows, chosen by a hash: half for the lexicon, a third for the
    trees, the rest for calibration.  The chosen labels are broadcast, so that no other text moves."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    chosen = known.where(hash_fraction("id", fraction=bounded_fraction(known.count(), most_rows)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sample = cut(texts.join(F.broadcast(chosen), "id"), "toxic-sample")
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(6))
    lexicon, stems = learn_lexicon(sample.where(part < 3))
    blank = Scorer(lexicon, stems, None, None, 0.0)
    made = cut(blank.with_features(sample.where(part >= 3).withColumn("label", F.col("toxic").cast("double")), "text", ["id", "label"]), "toxic-features")
    seen = {r[0]: r[1] for r in made.where(part < 5).groupBy("label").count().collect()}
    if len(seen) < 2:
        blank.prior = float(max(seen, default=0.0))
        return blank
    data = _assembled(made).coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=5).fit(data.where(part < 5))
    check = _probability(model, data.where(part == 5) if data.where(part == 5).limit(1).count() else data).select("p", "label")
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(check)
    return Scorer(lexicon, stems, model, calibration, 0.0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out("doc_id", 5, 0))
    return fit(docs, labels).transform(docs).withColumn("held_out", held_out("doc_id", 5, 0))
