"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking with original vectors.

On a bounded sample, principal directions and a learned rotation give binary codes; further rotations, from other
starts, give more bits.  Codes are cut into substrings, one hash table each; vectors of a label that share a substring
meet and are compared by cosine in double precision.  Length and number of substrings come from recall measured on the
sample: of its own pairs over the threshold, label by label, and of pairs made to lie right at the threshold.  Among the
plans that reach the recall asked for, with codes about the origin or about the mean, the one expected to compare least
is taken; where none does (a label that is one narrow cone), all vectors of a label meet.  Buckets that are large are
dealt out in pairs of blocks.  A pair that meets in several tables counts in the first of them.  Blocks give back counts
and one edge for each vector that has links, not the links.

Equal vectors of a label are one class with a multiplicity, and count in full as links.  Vectors that are null, zero
or hold null or non-finite components, and rows with a null label, link with nothing.  Vectors of different length are
not compared; those of another length than most of the sample meet all of their label and length.  Rows that repeat a
vec_id with different vectors are one vertex: they share a component, and each counts the links of its own vector.  A
null vec_id links with nothing and is its own (null) component.  Ties do not arise.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import bounded_fraction, components, cut, hash_fraction, table

BITS = 64
MOST_TABLES = 40
LONGEST = 30


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Codes:
    """``mean``, and for each rotation a matrix from unit vectors to at most 64 signed values."""

    mean: np.ndarray
    maps: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        out = np.zeros((len(x), len(self.maps)), dtype=np.uint64)
        for k, m in enumerate(self.maps):
            on = x @ m > 0
            for j in range(on.shape[1]):
                out[:, k] |= on[:, j].astype(np.uint64) << np.uint64(j)
        return out

    @property
    def bits(self) -> int:
        return self.maps[0].shape[1]


@dataclass
class Plan:
    """``tables`` substrings of ``length`` bits, as many from each rotation as fit; length 0: all vectors meet."""

    codes: Codes
    length: int
    tables: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Substrings of unit vectors, a column for each table."""
        if not self.length:
            return np.zeros((len(x), 1), dtype=np.int32)
        return substrings(self.codes(x), self.codes.bits, self.length)[:, : self.tables]


def substrings(codes: np.ndarray, bits: int, length: int) -> np.ndarray:
    per, mask = bits // length, np.uint64((1 << length) - 1)
    cut_out = [(codes[:, k] >> np.uint64(i * length)) & mask for k in range(codes.shape[1]) for i in range(per)]
    return np.stack(cut_out, axis=1).astype(np.int32)


def learn(x: np.ndarray, rotations: int, centred: bool, rounds: int = 12, seed: int = 11) -> Codes:
    """Iterative quantisation (Gong and Lazebnik): alternate codes sign(V R) and the best rotation for them."""
    mean = x.mean(axis=0) if centred else np.zeros(x.shape[1])
    y = x - mean
    _, _, vt = np.linalg.svd(y, full_matrices=False)
    w = vt[:BITS].T
    v = y @ w
    rng = np.random.default_rng(seed)
    maps = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(rounds):
            u, _, s = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ s).T
        maps.append(w @ r)
    return Codes(mean, maps)


def _sample_pairs(x: np.ndarray, label: np.ndarray, threshold: float, most: int = 1500) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of pairs over the threshold, for each label with enough of them to measure."""
    out = []
    for g in np.unique(label):
        at = np.flatnonzero(label == g)[:most]
        a, b = np.nonzero(np.triu(x[at] @ x[at].T >= threshold, 1))
        if len(a) >= 50:
            take = np.random.default_rng(5).permutation(len(a))[:4000]
            out.append((x[at[a[take]]], x[at[b[take]]]))
    return out


def _pairs_at(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    x = x[rng.permutation(len(x))[:2000]]
    w = rng.standard_normal(x.shape)
    w -= (w * x).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(w, axis=1, keepdims=True)
    w = np.divide(w, norm, out=np.zeros_like(w), where=norm > 1e-9)
    return x, threshold * x + (1 - threshold**2) ** 0.5 * w


def plan(x: np.ndarray, label: np.ndarray, n: int, threshold: float, recall: float) -> Plan:
    """The cheapest plan for ``n`` vectors of a label that reaches the recall on unit vectors ``x`` of the sample."""
    pairs = [*_sample_pairs(x, label, threshold), _pairs_at(x, threshold)]
    few = x[np.random.default_rng(3).permutation(len(x))[:2500]]
    chosen, least = None, 300.0 + n  # what a vector costs if all of its label meet
    for centred in (False, True):
        codes = learn(few, 8, centred)
        coded = [(codes(a), codes(b)) for a, b in pairs]
        own = codes(x)
        for length in range(1, min(LONGEST, codes.bits) + 1):
            tables = 0
            for a, b in coded:
                same = substrings(a, codes.bits, length) == substrings(b, codes.bits, length)
                reached = np.flatnonzero(np.maximum.accumulate(same, axis=1).mean(axis=0) >= recall)
                tables = max(tables, int(reached[0]) + 1 if len(reached) else MOST_TABLES + 1)
            if tables > MOST_TABLES:
                break  # longer substrings find fewer
            met = substrings(own, codes.bits, length)[:, 0].astype(np.int64)
            share = 0.0
            for g in np.unique(label):
                c = np.unique(met[label == g], return_counts=True)[1]
                share = max(share, float((c / c.sum() * np.maximum(c - 1, 0) / max(1, c.sum() - 1)).sum()))
            # posting a vector and opening a bucket cost as much as so many comparisons
            cost = tables * (300 + 130_000 * min(1.0, 2.0**length / n) + n * share)
            if cost < least:
                least = cost
                chosen = Plan(Codes(codes.mean, codes.maps[: -(-tables // (codes.bits // length))]), length, tables)
    return chosen or Plan(Codes(np.zeros(x.shape[1]), []), 0, 1)


def link_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", threshold: float = 0.98,
    recall: float = 0.998, block: int = 1024, most_sample: int = 20_000,
) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per input row.  The index is fitted on at most about
    ``most_sample`` vectors; every vector is indexed."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("label"), F.col(vector_col).alias("v"))
    sound = (
        F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = src.withColumn("ok", sound).select("id", "label", "ok", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2"))
    classes = cut(
        rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count_distinct("id").alias("m"), F.first("v").alias("v")),
        "vector-classes",
    )
    sizes = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not sizes[0]:
        return df.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.col(id_col).isNotNull().alias("kept"))
    fraction = bounded_fraction(sizes[1], most_sample)
    found = classes.where(hash_fraction("h1", "id", fraction=fraction)).select("label", "v").toPandas()
    if not len(found):  # a few vectors and none of them in the sample
        found = classes.select("label", "v").limit(1000).toPandas()
    dim = int(found["v"].map(len).mode()[0])
    found = found[found["v"].map(len) == dim]
    x = _unit(np.stack(found["v"].to_numpy()).astype(np.float64))
    shared = spark.sparkContext.broadcast(plan(x, pd.factorize(found["label"])[0], sizes[0], threshold, recall))

    def coded(batches):
        for b in batches:
            keys: list = [[0]] * len(b)
            at = np.flatnonzero(b["v"].map(len) == dim)
            if len(at):
                for i, k in zip(at, shared.value.keys(_unit(np.stack(b["v"].iloc[at].to_numpy()).astype(np.float64)))):
                    keys[i] = k
            yield b.assign(keys=keys)

    label_type, id_type, v_type = (df.schema[c].dataType.simpleString() for c in (group_col, id_col, vector_col))
    posted = (
        classes.select("label", "id", "h1", "m", "v")
        .mapInPandas(coded, f"label {label_type}, id {id_type}, h1 bigint, m bigint, v {v_type}, keys array<int>")
        .select("label", F.size("v").alias("dim"), "id", "h1", "m", "v", "keys", F.posexplode("keys").alias("t", "key"))
    )
    bucket_of = ["label", "dim", "t", "key"]
    large = posted.groupBy(*bucket_of).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*bucket_of, F.ceil(F.col("n") / block).cast("int").alias("nb"))
    dealt = (
        posted.join(large, bucket_of, "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    )

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "h1"])
        m = _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
        ids, mine, t, times = pdf["id"].to_numpy(), pdf["mine"].to_numpy(), int(pdf["t"].iloc[0]), pdf["m"].to_numpy()
        hit = m @ m.T >= threshold
        if pdf["x"].iloc[0] != pdf["y"].iloc[0]:
            hit &= mine[:, None] != mine[None, :]
        if t and hit.any():  # met in an earlier table already
            keys = np.stack(pdf["keys"].to_numpy())
            for k in range(t):
                hit &= keys[:, None, k] != keys[None, :, k]
        np.fill_diagonal(hit, False)
        others = hit @ times.astype(np.float64)
        root = np.arange(len(ids))
        a, b = np.nonzero(hit)
        while len(a):
            low = root.copy()
            np.minimum.at(low, a, root[b])
            low = low[low]
            if (low == root).all():
                break
            root = low
        on = others > 0
        return pd.DataFrame({"id": ids[on], "h1": pdf["h1"].to_numpy()[on], "root": ids[root[on]], "others": others[on].astype(np.int64)})

    links = cut(
        dealt.select(*bucket_of, "x", "y", "mine", "id", "h1", "m", "v", "keys").groupBy(*bucket_of, "x", "y").applyInPandas(rerank, f"id {id_type}, h1 bigint, root {id_type}, others bigint"),
        "vector-links",
    )
    degree = links.groupBy("id", "h1").agg(F.sum("others").alias("others"))
    edges = links.select(F.col("id").alias("a"), F.col("root").alias("b"))
    # a vec_id that stands in several classes joins them
    several = cut(rows.where("ok").select("id", "label", "h1", "h2").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("a")), "repeated-vectors")
    if several.limit(1).count():
        of_row = rows.where("ok").join(several, rows.id == several.a).select("label", "h1", "h2", "a").distinct()
        edges = edges.unionByName(of_row.join(classes.select("label", "h1", "h2", F.col("id").alias("b")), ["label", "h1", "h2"]).select("a", "b"))
    vertices = classes.select("id").unionByName(several.select(F.col("a").alias("id")))
    of_class = (
        classes.select("label", "h1", "h2", "id", "m").join(components(vertices, edges), "id").join(degree, ["id", "h1"], "left")
        .select("label", "h1", "h2", F.col("component_id").alias("c"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    )
    joined = rows.select("id", "label", "ok", "h1", "h2").join(of_class.withColumn("ok", F.lit(True)), ["label", "h1", "h2", "ok"], "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
sound AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x : x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON e.vec_id = c.id LEFT JOIN degree d ON d.a = e.vec_id
"""
