"""Language identification by interpolated Kneser-Ney character language models, one per language.

Counts of character n-grams are gathered in Spark from a bounded sample of labelled texts, read whole.  For each
language the models give interpolated Kneser-Ney probabilities; they are stored as sorted arrays of n-gram hashes with a
column per language, looked up by binary search.  The language with the lowest length-normalised cross-entropy wins.  A
fifth of the sample is kept out of the counts: on it the score is calibrated (how fast odds grow with the gap between
cross-entropies and with length) and the limit beyond which a text is rejected, from the spread of cross-entropies of
texts in their own language.  A language with few such texts has the spread of all languages; with no such text at all
nothing but letterless text is rejected.

Texts are lower-cased; every run of characters that are no letters is one blank.  A null text, an empty one or one
without a letter is ``und`` with score 0 and rejected.  Very long texts are scored in windows that overlap by the order,
so memory is bounded.  Ties go to the language that comes first by name.  Rows with a null language or text teach
nothing; repeated rows count as often as they occur; an empty table, or one without labels, gives ``und`` for all.
Other columns are ignored; of columns to keep, those named as a result are left out.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import bounded_fraction, held_out, mix, per_text, table

UND = "und"
RESULT = ("lang_pred", "score", "entropy", "rejected")
_MUL = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters and marks, 0x20 for all others."""
    out = np.full(0x110000, 0x20, dtype=np.uint32)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] in "LM":
            out[i] = i
    return out


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters with single blanks between words and one at each end; empty if there is no letter."""
    cps = _letters()[np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)]
    if not any(map(str.isalpha, text if len(text) < 64 else text[:64])) and not any(map(str.isalpha, text)):
        return cps[:0]
    blank = cps == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    cps = cps[keep]
    if len(cps) and cps[0] != 0x20:
        cps = np.concatenate([[np.uint32(0x20)], cps])
    if len(cps) and cps[-1] != 0x20:
        cps = np.concatenate([cps, [np.uint32(0x20)]])
    return cps if len(cps) > 1 else cps[:0]


def hashes(cps: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position from ``order - 1`` on."""
    m = len(cps) - order + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(m, order, dtype=np.uint64)
    for k in range(order):
        h = (h ^ cps[k : k + m]) * _MUL
        h ^= h >> np.uint64(29)
    return mix(h)


def hashes_at(cps: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """As ``hashes``, only for the n-grams that end at ``ends``."""
    if len(ends) and len(ends) == ends[-1] - ends[0] + 1:
        return hashes(cps[ends[0] - order + 1 : ends[-1] + 1], order)
    h = np.full(len(ends), order, dtype=np.uint64)
    for k in range(order - 1, -1, -1):
        h = (h ^ cps[ends - k]) * _MUL
        h ^= h >> np.uint64(29)
    return mix(h)


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted hash array, and whether the code is there."""
    if not len(keys):
        return np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
    i = np.searchsorted(keys, codes)
    i[i == len(keys)] = 0
    return i, keys[i] == codes


@dataclass
class Model:
    """``grams[n]``: sorted hashes; ``logp[n]``: a row of log probabilities for each, a column per language;
    ``ctx[n]`` and ``back[n]``: the same for contexts and their back-off weights."""

    langs: list[str]
    order: int
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    ctx: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    limit: np.ndarray
    temper: float = 1.0
    power: float = 1.0

    def positions(self, cps: np.ndarray, first: int = 1) -> np.ndarray:
        """Sum over positions (from ``first`` on) of log probability, per language."""
        total = np.zeros(len(self.langs))
        n = len(cps)
        for at in range(first, min(self.order - 1, n)):  # the first positions have shorter contexts
            total += self._below(cps, np.array([at]), at + 1)
        return total + self._below(cps, np.arange(max(first, self.order - 1), n), self.order)

    def _below(self, cps: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """The n-grams of length ``k`` that end at ``ends``; those not seen are weighed and looked up one shorter."""
        weight = np.zeros(len(self.langs))
        while len(ends):
            i, hit = _find(self.grams[k], hashes_at(cps, ends, k))
            weight += np.take(self.logp[k], i[hit], axis=0).sum(axis=0)
            ends = ends[~hit]
            if k == 1:
                return weight + len(ends) * self.floor
            if len(ends):
                i, hit = _find(self.ctx[k], hashes_at(cps, ends - 1, k - 1))
                weight += np.take(self.back[k], i[hit], axis=0).sum(axis=0)
            k -= 1
        return weight

    def entropies(self, text: str) -> tuple[np.ndarray | None, int]:
        """Cross-entropy per character and language, and the number of characters predicted."""
        cps = letters_of(text)
        n = len(cps) - 1
        if n < 1 or not self.langs:
            return None, 0
        if len(cps) <= WINDOW:
            return -self.positions(cps) / n, n
        total = self.positions(cps[:WINDOW])
        for at in range(WINDOW, len(cps), WINDOW):
            lead = min(at, self.order - 1)
            total += self.positions(cps[at - lead : at + WINDOW], lead)
        return -total / n, n

    def classify(self, text: str) -> tuple[str, float, float | None, bool]:
        """Language, score in 0..1, cross-entropy, whether rejected."""
        h, n = self.entropies(text)
        if h is None:
            return UND, 0.0, None, True
        best = int(np.argmin(h))
        score = float(1.0 / np.exp(-(h - h[best]) * self.temper * n**self.power).sum())
        limit = self.limit[best] * (1.0 + 1.0 / np.sqrt(n))  # short texts scatter more
        return self.langs[best], score, float(h[best]), bool(h[best] > limit)

    def calibrate(self, seen: list[tuple[str, int, list[float]]], least: int = 5, slack: float = 0.75) -> None:
        """Set ``temper``, ``power`` and ``limit`` from (language, length, cross-entropies) of texts kept out."""
        seen = [x for x in seen if x[0] in self.langs]
        if not seen:
            return
        own = np.array([self.langs.index(x[0]) for x in seen])
        n = np.array([x[1] for x in seen], dtype=np.float64)
        h = np.array([x[2] for x in seen])
        # likelihood of the true languages, with one error in all texts allowed for; of equal ones the mildest
        best, doubt = -np.inf, 1.0 / (len(seen) + 1)
        for power in (0.0, 0.5, 1.0):
            for temper in 2.0 ** np.arange(-8, 9):
                z = -h * temper * (n**power)[:, None]
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z[np.arange(len(seen)), own]) / np.exp(z).sum(axis=1)
                fit = float(np.log((1 - doubt) * p + doubt / len(self.langs)).mean())
                if fit > best + 1e-4:
                    best, self.temper, self.power = fit, float(temper), power
        long = n >= 50
        e = h[np.arange(len(seen)), own]
        groups = [e[long & (own == k)] for k in range(len(self.langs))]
        known = [g for g in groups if len(g) >= least]
        if not known:
            known = [e[long]] if long.any() else []
        if not known:
            return
        reach = lambda g: max(8 * g.std(), g.max() - g.mean() + 4 * g.std()) + slack
        mean, spread = max(g.mean() for g in known), max(map(reach, known))
        for k, g in enumerate(groups):
            self.limit[k] = g.mean() + reach(g) if len(g) >= least else mean + spread


def count_grams(docs: DataFrame, lang_col: str, text_col: str, order: int, most: int = 1 << 18) -> DataFrame:
    """``lang, n, h, hist, c``: how often each n-gram of each order occurs in each language, its hash and the hash of
    its history, and ``suffix``, the hash without its first character.  Counted in each task, about ``most``
    characters at a time, then summed."""

    def counted(lang: str, arrays: list[np.ndarray]) -> pd.DataFrame:
        frames = []
        for n in range(1, order + 1):
            rows = []
            for cps in arrays:
                if len(cps) < n:
                    continue
                h = hashes(cps, n)
                hist = hashes(cps, n - 1)[: len(h)] if n > 1 else np.zeros(len(h), dtype=np.uint64)
                suffix = hashes(cps, n - 1)[1:] if n > 1 else np.zeros(len(h), dtype=np.uint64)
                rows.append(np.stack([h, hist, suffix]))
            if rows:
                x = np.concatenate(rows, axis=1)
                _, first, c = np.unique(x[0], return_index=True, return_counts=True)
                frames.append(pd.DataFrame({"lang": lang, "n": n, "h": x[0][first].view(np.int64), "hist": x[1][first].view(np.int64), "suffix": x[2][first].view(np.int64), "c": c}))
        return pd.concat(frames)

    def run(batches):
        for b in batches:
            for lang, part in b.groupby("lang"):
                arrays, size = [], 0
                for t in part["text"]:
                    if len(x := letters_of(t)):
                        arrays.append(x)
                        size += len(x)
                    if size >= most:
                        yield counted(lang, arrays)
                        arrays, size = [], 0
                if arrays:
                    yield counted(lang, arrays)

    return (
        docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .mapInPandas(run, "lang string, n int, h bigint, hist bigint, suffix bigint, c bigint")
        .groupBy("lang", "n", "h", "hist", "suffix")
        .agg(F.sum("c").alias("c"))
    )


def _gathered(counts: DataFrame) -> pd.DataFrame:
    """The counts on the driver, packed in the tasks: n-grams of a bounded sample."""
    columns = ["h", "hist", "suffix", "c"]

    def pack(batches):
        for b in batches:
            yield pd.DataFrame(
                [{"lang": lang, "n": n, **{k: g[k].to_numpy(np.int64).tobytes() for k in columns}} for (lang, n), g in b.groupby(["lang", "n"])],
                columns=["lang", "n", *columns],
            )

    frames = [
        pd.DataFrame({"lang": r[0], "n": r[1], **{k: np.frombuffer(r[2 + i], dtype=np.int64) for i, k in enumerate(columns)}})
        for r in counts.mapInPandas(pack, "lang string, n int, h binary, hist binary, suffix binary, c binary").collect()
    ]
    return pd.concat(frames) if frames else pd.DataFrame({k: [] for k in ["lang", "n", *columns]})


def fit(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", order: int = 4,
    most_texts: int = 1000, discount: float = 0.75,
) -> Model:
    """Learn from at most about ``most_texts`` texts per language, whole whatever their length, a fifth of them for
    calibration; the model's size is bounded by the n-grams of that sample."""
    known = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = [(r[0], r[1]) for r in known.groupBy("lang").count().collect()]
    fraction, aside = F.lit(1.0), F.lit(0.0)
    for lang, n in sizes:
        fraction = F.when(F.col("lang") == lang, bounded_fraction(n, most_texts)).otherwise(fraction)
        aside = F.when(F.col("lang") == lang, 0.2 if n >= 10 else 0.0).otherwise(aside)  # of fewer all are counted
    at = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    sample = known.where(at < fraction * (1 << 30))
    kept_out = F.pmod(F.xxhash64("id", "text", F.lit("calibrate")), F.lit(1 << 30)) < aside * (1 << 30)
    model = build(_gathered(count_grams(sample.where(~kept_out), "lang", "text", order)), order, discount)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def fn(texts, rows):
        got = [shared.value.entropies(t) for t in texts]
        return {"n": [g[1] for g in got], "h": [None if g[0] is None else g[0].tolist() for g in got]}

    seen = per_text(sample.where(kept_out), "text", fn, "n bigint, h array<double>", ["lang"]).where("h is not null").collect()
    model.calibrate([(r["lang"], r["n"], r["h"]) for r in sorted(seen)])
    return model


def build(counts: pd.DataFrame, order: int, discount: float) -> Model:
    langs = sorted(counts["lang"].unique())
    nl = len(langs)
    column = {g: i for i, g in enumerate(langs)}
    empty = np.zeros(0, dtype=np.uint64)
    grams, logp, ctx, back = [empty], [np.zeros((0, nl))], [empty, empty], [np.zeros((0, nl)), np.zeros((0, nl))]
    if not nl:
        return Model([], order, grams, logp, ctx, back, np.zeros(0), np.zeros(0))
    lower: np.ndarray | None = None
    floor = np.zeros(nl)
    for n in range(1, order + 1):
        x = counts[counts["n"] == n]
        h = x["h"].to_numpy().view(np.uint64)
        keys, first, row = np.unique(h, return_index=True, return_inverse=True)
        cols = x["lang"].map(column).to_numpy()
        c = np.zeros((len(keys), nl))
        np.add.at(c, (row, cols), x["c"].to_numpy())
        if n < order:  # continuation counts: how many characters come before
            up = counts[counts["n"] == n + 1]
            c = np.zeros((len(keys), nl))
            at = np.searchsorted(keys, up["suffix"].to_numpy().view(np.uint64))
            np.add.at(c, (np.minimum(at, len(keys) - 1), up["lang"].map(column).to_numpy()), 1.0)
        if n == 1:
            total = c.sum(axis=0)
            kinds = (c > 0).sum(axis=0)
            floor = np.maximum(discount * kinds / np.maximum(total, 1), 1e-9) / (kinds + 1000.0)
            p = np.maximum(c - discount, 0) / np.maximum(total, 1) + floor
            grams.append(keys), logp.append(np.log(p))
            lower = p
            continue
        hist = x["hist"].to_numpy().view(np.uint64)[first]
        hk, hrow = np.unique(hist, return_inverse=True)
        total, kinds = np.zeros((len(hk), nl)), np.zeros((len(hk), nl))
        np.add.at(total, hrow, c)
        np.add.at(kinds, hrow, c > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        suffix = x["suffix"].to_numpy().view(np.uint64)[first]
        j = np.searchsorted(grams[n - 1], suffix)
        below = lower[np.minimum(j, len(lower) - 1)]
        p = np.where(total[hrow] > 0, np.maximum(c - discount, 0) / np.maximum(total[hrow], 1), 0) + weight[hrow] * below
        grams.append(keys), logp.append(np.log(p))
        ctx.append(hk), back.append(np.log(weight))
        lower = p
    return Model(langs, order, grams, logp, ctx, back, np.log(floor), np.full(nl, np.inf))


def classify(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns in ``keep`` and ``lang_pred, score, entropy, rejected``.  The model is bounded by its sample."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def fn(texts, rows):
        got = [shared.value.classify(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "entropy": [g[2] for g in got], "rejected": [g[3] for g in got]}

    kept = [c for c in (["doc_id"] if keep is None else keep) if c not in RESULT]
    return per_text(df, text_col, fn, "lang_pred string, score double, entropy double, rejected boolean", kept)


def learn(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out("doc_id", 3, 1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs)).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
