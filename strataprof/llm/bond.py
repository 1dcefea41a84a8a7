"""Hard negatives by a vertical scan with branch and bound (BOND).

A block of vectors is a column for each dimension.  An anchor reads the columns in the order of its own components, the
largest magnitude first, and adds up partial inner products of the candidates that are left.  The smallest and largest
value of each column bound what the unread ones can still add; with these bounds the bitmap of candidates shrinks:

* positives: candidates go whose upper bound is below the k-th best lower bound;
* negatives: each positive of the anchor has a window of scores; candidates go that no window can hold any more, or that
  in each are beaten for certain by as many as are asked for.

What is left when all columns are read has exact scores.  Anchors are a stated query set against all rows, in blocks:
anchors and rows are dealt to a grid of bounded blocks, for positives within a label, and each cell of the grid gives back
at most ``positives`` or ``positives * negatives`` rows an anchor.  Nothing is broadcast or collected; a label with many
rows is many blocks.

Rows with a null id, a null label, a null vector, or a null or non-finite component take no part.  Rows that are equal in
id, label and vector count once; other rows that share an id are rows of their own, but none is a positive of an anchor
with its id.  Vectors meet vectors of their own length only; an empty vector scores 0.  Ties go to the smaller id.  Scores
are exact below 2**53; beyond the limits of a long they end there.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataprof.llm.common import cut, table

STEP = 8  # columns between two looks at the bitmap


class Columns:
    """A block of vectors by dimension, with the range of each."""

    def __init__(self, vectors: list[np.ndarray]):
        self.rows = len(vectors)
        self.of = np.ascontiguousarray(np.stack(vectors).astype(np.float64).T)
        self.low, self.high = (self.of.min(axis=1), self.of.max(axis=1)) if self.rows else (None, None)

    def scan(self, anchor: np.ndarray, at: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``at`` that ``keep(lower, upper)`` never threw out, and their scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor[order] * self.low[order], anchor[order] * self.high[order]
        rest_low = np.append(np.cumsum(np.minimum(*ends)[::-1])[::-1], 0.0)
        rest_high = np.append(np.cumsum(np.maximum(*ends)[::-1])[::-1], 0.0)
        score = np.zeros(len(at))
        for first in range(0, len(order), STEP):
            for d in order[first : first + STEP]:
                score += anchor[d] * self.of[d, at]
            end = min(first + STEP, len(order))
            stay = keep(score + rest_low[end], score + rest_high[end])
            if not stay.all():
                at, score = at[stay], score[stay]
            if not len(at):
                break
        return at, score


def best(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps what can still be among the ``k`` best."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), dtype=bool)
        return upper >= np.partition(lower, -k)[-k]

    return keep


def windows(low: np.ndarray, high: np.ndarray, k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Keeps what can still be among the ``k`` best of a window ``low <= score <= high``."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lower), dtype=bool)
        for a, b in zip(low, high):
            inside = lower[(lower >= a) & (upper <= b)]
            least = np.partition(inside, -k)[-k] if len(inside) >= k else a
            stay |= (upper >= max(a, least)) & (lower <= b)
        return stay

    return keep


def _long(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _split(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return pdf[pdf["anchor"]].reset_index(drop=True), pdf[~pdf["anchor"]].sort_values("id", kind="stable").reset_index(drop=True)


def _vectors(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float64) for v in pdf["v"]]


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", positives: int = 5,
    negatives: int = 3, low: int = 50, high: int = 95, anchor_block: int = 4096, row_block: int = 8192,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row where ``anchor`` is true
    and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score is
    from ``low`` to ``high`` percent of the positive's.  Vectors are arrays of whole numbers."""
    id_type, label_type = df.schema[id_col].dataType.simpleString(), df.schema[group_col].dataType.simpleString()
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cut(
        df.where(F.col(id_col).isNotNull() & F.col(group_col).isNotNull() & F.col(vector_col).isNotNull()).where(sound)
        .select(F.col(id_col).alias("id"), F.col(group_col).alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
        .distinct().select("*", F.size("v").alias("dim"), F.xxhash64("id", "label", "v").alias("h")),
        "bond-rows",
    )

    def grid(asking: DataFrame, groups: list[str], answering: Column) -> DataFrame:
        """Anchors and rows of each group in cells (x, y) of bounded numbers of both."""
        sizes = (
            rows.groupBy(*groups).agg(F.count_if("asks").alias("asked"), F.count("*").alias("n")).where("asked > 0")
            .select(*groups, F.ceil(F.col("asked") / anchor_block).cast("int").alias("across"), F.ceil(F.col("n") / row_block).cast("int").alias("down"))
        )
        extra = [c for c in asking.columns if c not in rows.columns]
        mine = lambda n: F.pmod(F.xxhash64(F.lit(17), "h"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        names = [*dict.fromkeys([*groups, "dim", "label"]), "id", "h", "v", *extra]
        a = asking.join(sizes, groups).select(*names, F.lit(True).alias("anchor"), mine("across").alias("x"), every("down").alias("y"))
        d = rows.where(answering).join(sizes, groups).withColumns({c: F.lit(None).cast(asking.schema[c].dataType) for c in extra})
        return a.unionByName(d.select(*names, F.lit(False).alias("anchor"), every("across").alias("x"), mine("down").alias("y")))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, there = _split(pdf)
        out = []
        if len(there):
            block, ids, h = Columns(_vectors(there)), there["id"].to_numpy(), there["h"].to_numpy()
            for a, ah, v in zip(asked["id"], asked["h"], _vectors(asked)):
                at, score = block.scan(v, np.flatnonzero(ids != a), best(positives))
                first = np.lexsort((h[at], ids[at], -score))[:positives]
                out.append(pd.DataFrame({"ah": ah, "pid": ids[at[first]], "ph": h[at[first]], "score": _long(score[first])}))
        return pd.concat(out) if out else pd.DataFrame({"ah": [], "pid": [], "ph": [], "score": []})

    found = grid(rows.where("asks"), ["dim", "label"], F.lit(True)).groupBy("dim", "label", "x", "y").applyInPandas(
        nearest, f"ah bigint, pid {id_type}, ph bigint, score bigint"
    )
    place = F.row_number().over(Window.partitionBy("ah").orderBy(F.desc("score"), "pid", "ph"))
    of_anchor = cut(
        found.withColumn("k", place).where(F.col("k") <= positives)
        .groupBy(F.col("ah").alias("h")).agg(F.sort_array(F.collect_list(F.struct("k", "score", "pid"))).alias("positives")),
        "bond-positives",
    )
    spread = of_anchor.select("h", F.col("positives.k").alias("ks"), F.col("positives.score").alias("scores"))

    def in_windows(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, there = _split(pdf)
        out = []
        if len(there):
            block, ids, h, label = Columns(_vectors(there)), there["id"].to_numpy(), there["h"].to_numpy(), there["label"].to_numpy()
            for ah, group, v, ks, scores in zip(asked["h"], asked["label"], _vectors(asked), asked["ks"], asked["scores"]):
                ks, scores = np.asarray(ks), np.asarray(scores, dtype=np.float64)
                lows, highs = np.ceil(low * scores / 100), np.floor(high * scores / 100)
                at, score = block.scan(v, np.flatnonzero(label != group), windows(lows, highs, negatives))
                order = np.lexsort((h[at], ids[at], -score))
                at, score = at[order], score[order]
                for k, a, b in zip(ks, lows, highs):
                    fit = np.flatnonzero((score >= a) & (score <= b))[:negatives]
                    if len(fit):
                        out.append(pd.DataFrame({"ah": ah, "k": k, "nid": ids[at[fit]], "nh": h[at[fit]], "negative": _long(score[fit])}))
        return pd.concat(out) if out else pd.DataFrame({"ah": [], "k": [], "nid": [], "nh": [], "negative": []})

    asking = rows.where("asks").join(spread, "h")
    hits = grid(asking, ["dim"], F.lit(True)).groupBy("dim", "x", "y").applyInPandas(
        in_windows, f"ah bigint, k int, nid {id_type}, nh bigint, negative bigint"
    )
    rank = F.row_number().over(Window.partitionBy("ah", "k").orderBy(F.desc("negative"), "nid", "nh"))
    ranked = hits.withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = rows.where("asks").select(F.col("h").alias("ah"), F.col("id").alias("anchor_id"))
    pairs = of_anchor.select(F.col("h").alias("ah"), F.explode("positives").alias("p")).select("ah", "p.k", F.col("p.pid").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return ranked.join(pairs, ["ah", "k"]).join(names, "ah").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("nid").alias("negative_id"), "positive_score", F.col("negative").alias("negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = src.select(
        "vec_id", turned.alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.floor(x * 256).cast("double"))).alias("embedding")
    )
    return hard_negatives(whole, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x : floor(256 * x)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x : x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE a.id % 50 = 0),
positive AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negative AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
  FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negative WHERE rank <= 3
"""
