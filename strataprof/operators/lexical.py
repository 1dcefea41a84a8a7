"""Lexical measures over ``labels(model_id, label_id, kind, type, label)`` and ``models(model_id)``.

``tokenised`` computes tokens, style and lengths once; the measures share it.  Models without labels come in from
``models`` where a measure counts them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strataprof.functions import stats, text
from strataprof.operators.graph import cut
from strataprof.operators.labels import eligible


def tokenised(labels: DataFrame, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Labels that are there, with ``tokens``, ``chars`` and ``n_tokens``."""
    tokens = tokens or text.tokenizer()
    return (
        labels.where(text.present(F.col("label")))
        .withColumn("tokens", tokens(F.col("label")))
        .withColumn("chars", F.length("label"))
        .withColumn("n_tokens", F.size("tokens"))
    )


def _presence(labels: DataFrame) -> DataFrame:
    return labels.where(eligible(F.col("type"))).withColumn("present", text.present(F.col("label")))


def presence_per_model(labels: DataFrame, models: DataFrame) -> DataFrame:
    got = _presence(labels).groupBy("model_id").agg(F.count("*").alias("eligible"), F.count_if("present").alias("present"))
    share = F.when(F.col("eligible") > 0, F.col("present") / F.col("eligible")).otherwise(0.0)
    return models.select("model_id").join(got, "model_id", "left").fillna(0).select("model_id", "eligible", "present", share.alias("present_share"), (1 - share).alias("missing_share"))


def missing_by_type(labels: DataFrame, per_model: bool = False) -> DataFrame:
    keys = ["model_id", "type"] if per_model else ["type"]
    return _presence(labels).where(~F.col("present")).groupBy(*keys).agg(F.count("*").alias("missing"))


def presence(labels: DataFrame, models: DataFrame) -> DataFrame:
    p = presence_per_model(labels, models)
    share = F.coalesce(F.sum("present") / F.sum("eligible"), F.lit(0.0))
    return p.agg(
        F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"), F.coalesce(F.sum("present"), F.lit(0)).alias("present"), share.alias("present_share"),
        (1 - share).alias("missing_share"), *stats.summary("present_share", "model_share"), stats.score(share).alias("score"),
    )


def length_per_model(tokens: DataFrame, models: DataFrame) -> DataFrame:
    def three(c: str) -> list[Column]:
        q = F.percentile(c, F.array(F.lit(0.5), F.lit(0.95)))
        return [F.avg(c).alias(f"{c}_mean"), q[0].alias(f"{c}_median"), q[1].alias(f"{c}_p95")]

    n = F.count("*")
    got = tokens.groupBy("model_id").agg(
        n.alias("label_count"), *three("chars"), *three("n_tokens"),
        (F.count_if(text.is_short(F.col("label"), F.col("n_tokens"))) / n).alias("short_share"),
        (F.count_if(text.is_long(F.col("label"), F.col("n_tokens"))) / n).alias("long_share"),
    )
    return models.select("model_id").join(got, "model_id", "left").fillna(0)


def length(tokens: DataFrame, models: DataFrame) -> DataFrame:
    """Spread over the models that have labels."""
    p = length_per_model(tokens, models).where("label_count > 0")
    return p.agg(*stats.summary("chars_median", "chars"), *stats.summary("n_tokens_median", "tokens"), *stats.summary("short_share", "short"), *stats.summary("long_share", "long"))


def _styles(tokens: DataFrame, keys: list[str]) -> DataFrame:
    n = tokens.groupBy(*keys, text.case_style(F.col("label")).alias("style")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def styles_per_model(tokens: DataFrame) -> DataFrame:
    return _styles(tokens, ["model_id"])


def styles(tokens: DataFrame) -> DataFrame:
    return _styles(tokens, [])


def style_entropy_per_model(tokens: DataFrame, models: DataFrame) -> DataFrame:
    got = styles_per_model(tokens).groupBy("model_id").agg(stats.entropy(F.col("share")).alias("style_entropy"))
    return models.select("model_id").join(got, "model_id", "left").fillna(0.0)


def style_entropy(tokens: DataFrame, models: DataFrame) -> DataFrame:
    return style_entropy_per_model(tokens, models).agg(*stats.summary("style_entropy", "entropy"))


def words_per_model(tokens: DataFrame, models: DataFrame) -> DataFrame:
    """Labels of one word and of more; labels without a token are in neither."""
    got = tokens.groupBy("model_id").agg(F.count("*").alias("labels"), F.count_if(F.col("n_tokens") == 1).alias("single"), F.count_if(F.col("n_tokens") > 1).alias("multi"))
    return models.select("model_id").join(got, "model_id", "left").fillna(0).withColumn("single_share", stats.ratio(F.col("single"), F.col("labels")))


def words(tokens: DataFrame, models: DataFrame) -> DataFrame:
    p = words_per_model(tokens, models)
    return p.agg(
        F.sum("single").alias("single"), F.sum("multi").alias("multi"), stats.ratio(F.sum("single"), F.sum("labels")).alias("single_share"),
        *stats.summary(F.when(F.col("labels") > 0, F.col("single_share")), "model_share"),
    )


def diversity_per_model(tokens: DataFrame, models: DataFrame) -> DataFrame:
    got = tokens.select("model_id", F.explode("tokens").alias("token")).groupBy("model_id").agg(F.count("*").alias("tokens"), F.count_distinct("token").alias("vocabulary"))
    return models.select("model_id").join(got, "model_id", "left").fillna(0).withColumn("type_token_ratio", stats.ratio(F.col("vocabulary"), F.col("tokens")))


def diversity(tokens: DataFrame) -> DataFrame:
    by = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("vocabulary"), F.coalesce(F.count("*") / F.sum("n"), F.lit(0.0)).alias("type_token_ratio"))


def top_labels(tokens: DataFrame, k: int = 50) -> DataFrame:
    return stats.top(tokens.groupBy(text.strip(F.col("label")).alias("label")).agg(F.count("*").alias("n")), "n", "label", k)


def top_tokens(tokens: DataFrame, k: int = 50) -> DataFrame:
    return stats.top(tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "n", "token", k)


def profile_per_model(labels: DataFrame, models: DataFrame, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """All per-model figures in one row: the labels are tokenised and grouped by model once; styles and tokens, which
    are counted first, take a group each."""
    there = text.present(F.col("label"))
    made = (tokens or text.tokenizer())(F.col("label"))
    rows = labels.select("model_id", "label", there.alias("ok"), eligible(F.col("type")).alias("counts"), F.when(there, made).alias("tokens"), F.when(there, F.length("label")).alias("chars"))
    rows = rows.withColumn("n_tokens", F.when(F.col("ok"), F.size("tokens")))
    n, size, label = F.count_if("ok"), F.col("n_tokens"), F.col("label")

    def three(c: str) -> list[Column]:
        q = F.percentile(c, F.array(F.lit(0.5), F.lit(0.95)))
        return [F.avg(c).alias(f"{c}_mean"), q[0].alias(f"{c}_median"), q[1].alias(f"{c}_p95")]

    by_label = rows.groupBy("model_id").agg(
        F.count_if("counts").alias("eligible"), F.count_if(F.col("counts") & F.col("ok")).alias("present"), n.alias("label_count"), *three("chars"), *three("n_tokens"),
        (F.count_if(F.col("ok") & text.is_short(label, size)) / n).alias("short_share"), (F.count_if(F.col("ok") & text.is_long(label, size)) / n).alias("long_share"),
        F.count_if(size == 1).alias("single"), F.count_if(size > 1).alias("multi"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"),
    )
    styled = rows.where("ok").groupBy("model_id", text.case_style(label).alias("style")).agg(F.count("*").alias("n"))
    styled = styled.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("model_id"))).groupBy("model_id").agg(stats.entropy(F.col("share")).alias("style_entropy"))
    words = rows.select("model_id", F.explode("tokens").alias("token")).distinct().groupBy("model_id").agg(F.count("*").alias("vocabulary"))
    out = models.select("model_id").join(by_label, "model_id", "left").join(styled, "model_id", "left").join(words, "model_id", "left").fillna(0)
    share = F.when(F.col("eligible") > 0, F.col("present") / F.col("eligible")).otherwise(0.0)
    return out.withColumn("present_share", share).withColumn("single_share", stats.ratio(F.col("single"), F.col("label_count"))).withColumn(
        "type_token_ratio", stats.ratio(F.col("vocabulary"), F.col("tokens"))
    )


# language of a model by a naive Bayes over character trigrams of its labels


def language_profile(texts: DataFrame, lang: str = "lang", body: str = "text", n: int = 3, smoothing: float = 0.5) -> DataFrame:
    """``gram, lang, logp``: trained by counting.  Its size is the languages times the n-grams of the alphabet."""
    c = cut(gram_counts(texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(body).alias("_body")), ["lang"], "_body", n))  # read four times
    total = c.groupBy("lang").agg(F.sum("c").alias("t"))
    kinds = c.select("gram").distinct()
    v = kinds.agg(F.count("*").alias("v"))
    grid = kinds.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(v)).join(c, ["lang", "gram"], "left")  # languages: a handful
    return grid.select("gram", "lang", F.log((F.coalesce("c", F.lit(0)) + smoothing) / (F.col("t") + smoothing * F.col("v"))).alias("logp"))


def gram_counts(texts: DataFrame, keys: list[str], body: str, n: int = 3) -> DataFrame:
    """``keys, gram, c``: how often each n-gram of code points stands in the letters of the texts of a key; runs of anything
    else are one blank.  Texts are counted batch by batch where they are, so rows grow with the kinds of n-grams that a
    batch holds, not with its characters."""
    letters = F.concat(F.lit(" "), F.regexp_replace(F.lower(body), r"[^\p{L}]+", " "), F.lit(" "))
    src = texts.where(F.col(body).isNotNull()).select(*keys, letters.alias("_t"))
    sent = StructType([*src.schema.fields[:-1], StructField("gram", StringType()), StructField("c", LongType())])
    arrow = to_arrow_schema(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple, list[str]] = {}
            for *key, t in zip(*(col.to_pylist() for col in b.columns)):
                groups.setdefault(tuple(key), []).append(t)
            for key, group in groups.items():
                grams, counts = _counted(group, n)
                cols = [pa.array([k] * len(grams), type=f.type) for k, f in zip(key, arrow)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(grams, type=arrow[-2].type), pa.array(counts, type=pa.int64())], schema=arrow)

    return src.mapInArrow(run, sent).groupBy(*keys, "gram").agg(F.sum("c").alias("c"))


def _counted(texts: list[str], n: int) -> tuple[list[str], list[int]]:
    """N-grams of texts without line ends and their counts; up to three code points fit one number."""
    if n > 3:
        found = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        return list(found), list(found.values())
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    size = max(0, len(points) - n + 1)
    code, inside = np.zeros(size, np.int64), np.ones(size, bool)
    for i in range(n):
        at = points[i : i + size]
        code, inside = code << 21 | at, inside & (at != 10)
    codes, counts = np.unique(code[inside], return_counts=True)
    each = [(codes >> 21 * i & 0x1FFFFF).tolist() for i in reversed(range(n))]
    return ["".join(map(chr, x)) for x in zip(*each)], counts.tolist()


def detect_language(texts: DataFrame, profile: DataFrame, key: str = "model_id", body: str = "text", n: int = 3) -> DataFrame:
    """``key, language``: the profile with the largest summed log probability; ``unknown`` where no n-gram is known."""
    c = gram_counts(texts, [key], body, n)
    s = c.join(profile, "gram").groupBy(key, "lang").agg(F.sum(F.col("c") * F.col("logp")).alias("s"))
    best = s.groupBy(key).agg(F.max_by("lang", F.struct("s", "lang")).alias("language"))
    return texts.select(key).distinct().join(best, key, "left").fillna("unknown", ["language"])


def language_usage(per_model: DataFrame) -> DataFrame:
    return per_model.groupBy("language").agg(F.count("*").alias("n_models"))


def measures(
    labels: DataFrame, models: DataFrame, enabled: set[str] | None = None, tokens: Callable[[Column], Column] | None = None, profile: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Corpus measures by name; a measure that is off has no plan.  ``language`` needs a language profile."""
    toks = tokenised(labels, tokens)
    plans = {
        "presence": lambda: presence(labels, models), "length": lambda: length(toks, models), "naming": lambda: styles(toks),
        "words": lambda: words(toks, models), "diversity": lambda: diversity(toks),
    }
    if profile is not None:
        said = models.select("model_id").join(toks.select("model_id", "label"), "model_id", "left")
        plans["language"] = lambda: language_usage(detect_language(said, profile, "model_id", "label"))
    return {k: f() for k, f in plans.items() if enabled is None or k in enabled}
