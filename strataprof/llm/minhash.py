"""Near-duplicate documents by a signature-coordinate inverted join.

Each distinct shingle set gets a MinHash signature.  Sets are posted under their (coordinate, value) pairs.  Two
signatures of K coordinates with at least T matches share one of any K - T + 1 coordinates of either, in one global
order; so each set is posted only under the K - T + 1 rarest of its pairs (prefix merging) and common pairs, which a
passage in many documents makes, are skipped.  Pairs that meet in a posting and cannot reach T, by two bits of each
coordinate (a bound from above), are skipped as well; of the others the collisions are counted over all coordinates.
Pairs with T collisions or more are confirmed on full shingle sets.

Postings that stay long, those of large groups of near copies, are linked through their smallest member first.  After
those links are confirmed and components known, only members of different components are compared, in blocks; so the
work follows what is left to decide, and no link between components is lost.

Null and empty texts and texts without words have empty sets and link with nothing.  Rows that repeat an id are one
document with several texts.  A null id links with nothing: its component is null, it is not kept.  An empty table gives
an empty result; other columns are ignored.  Very long texts cost arrays proportional to their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import components, cut, per_text, shingle_set, table

K = 64
MOST_BROADCAST = 2_000_000  # rows of one or two longs
SHORT = 32  # postings up to this size are compared pair by pair
_RNG = np.random.Generator(np.random.PCG64(0xC0FFEE))
_XOR = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
SKETCH = 1024
_SKETCH_XOR = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_SKETCH_ODD = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """K minima (32 bits each) of a non-empty array of hashes."""
    low = np.full(K, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        h = (shingles[at : at + 2048, None] ^ _XOR) * _ODD
        h ^= h >> np.uint64(31)
        low = np.minimum(low, ((h * _ODD) >> np.uint64(32)).min(axis=0))
    return low


def signatures(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, n, k1, k2, items, b1, b2``: set size, two hashes of the set, coordinate-value pairs, two bits of each."""
    bits = np.uint64(1) << np.arange(K, dtype=np.uint64)
    coordinate = np.arange(K, dtype=np.uint64) << np.uint64(32)

    def fn(texts, rows):
        out = {c: [] for c in ("n", "k1", "k2", "items", "b1", "b2")}
        for text in texts:
            s = shingle_set(text, words)
            out["n"].append(len(s))
            if not len(s):
                for c in ("k1", "k2", "items", "b1", "b2"):
                    out[c].append(None)
                continue
            sig = signature(s)
            keys = np.array([s.sum(), (s * (s >> np.uint64(7) | np.uint64(1))).sum()], dtype=np.uint64).view(np.int64)
            two = np.array([bits[sig & np.uint64(1) > 0].sum(), bits[sig & np.uint64(2) > 0].sum()], dtype=np.uint64).view(np.int64)
            out["k1"].append(int(keys[0])), out["k2"].append(int(keys[1]))
            out["items"].append((coordinate | sig).view(np.int64))
            out["b1"].append(int(two[0])), out["b2"].append(int(two[1]))
        return out

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return per_text(src, "text", fn, "n bigint, k1 bigint, k2 bigint, items array<bigint>, b1 bigint, b2 bigint", ["id"])


def _alike(a1: Column, a2: Column, b1: Column, b2: Column, least: int) -> Column:
    differ = a1.bitwiseXOR(b1).bitwiseOR(a2.bitwiseXOR(b2))
    return K - F.bit_count(differ) >= least


def _prefixes(classes: DataFrame, size: int) -> tuple[DataFrame, bool]:
    """``id, b1, b2, item, df`` for the ``size`` rarest items of each; ``df`` is 0 for items of short postings.  And
    whether the long postings are few enough for a row of each to be broadcast."""
    hot = cut(
        classes.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df")).where(F.col("df") > SHORT),
        "hot-items",
    )
    n_hot = hot.count()
    if n_hot <= MOST_BROADCAST:
        known = hot.orderBy("item").toPandas()
        shared = classes.sparkSession.sparkContext.broadcast((known["item"].to_numpy(np.int64), known["df"].to_numpy(np.int64)))

        def run(batches):
            keys, dfs = shared.value
            for b in batches:
                if not len(b):
                    continue
                items = np.stack(b["items"].to_numpy())
                df = np.zeros(items.shape, dtype=np.int64)
                if len(keys):
                    at = np.searchsorted(keys, items)
                    at[at == len(keys)] = 0
                    df = np.where(keys[at] == items, dfs[at], 0)
                first = np.lexsort((items, df), axis=1)[:, :size]
                yield b.drop(columns="items").assign(
                    items=list(np.take_along_axis(items, first, 1)), dfs=list(np.take_along_axis(df, first, 1))
                )

        chosen = classes.select("id", "b1", "b2", "items").mapInPandas(run, "id bigint, b1 bigint, b2 bigint, items array<bigint>, dfs array<bigint>")
        return chosen.select("id", "b1", "b2", F.explode(F.arrays_zip("items", "dfs")).alias("x")).select("id", "b1", "b2", F.col("x.items").alias("item"), F.col("x.dfs").alias("df")), True
    ranked = (
        classes.select("id", "b1", "b2", F.explode("items").alias("item"))
        .join(hot, "item", "left")
        .groupBy("id", "b1", "b2")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "item"))), 1, size).alias("x"))
    )
    return ranked.select("id", "b1", "b2", F.explode("x").alias("x")).select("id", "b1", "b2", "x.item", "x.df"), False


def _short_pairs(posted: DataFrame, least: int) -> DataFrame:
    met = (
        posted.where("df = 0").groupBy("item").agg(F.collect_list(F.struct("id", "b1", "b2")).alias("m"))
        .where(F.size("m") > 1)
        .select(F.array_sort("m").alias("m"))
    )
    later = F.transform("m", lambda x, i: F.transform(F.filter(F.slice(F.col("m"), i + 2, SHORT), lambda y: (x.id != y.id) & _alike(x.b1, x.b2, y.b1, y.b2, least)), lambda y: F.struct(x.id.alias("a"), y.id.alias("b"))))
    return met.select(F.explode(F.flatten(later)).alias("p")).select("p.a", "p.b").distinct()


def _star_pairs(long: DataFrame, least: int, few: bool) -> DataFrame:
    """Each long posting's smallest member with the others.  A row per posting is broadcast where that is allowed, so
    that a posting of very many members is not gathered in one task."""
    side = F.broadcast if few else (lambda df: df)
    centre = long.groupBy("item").agg(F.min("id").alias("a"))
    met = long.join(side(centre), "item")
    heads = met.where("id = a").select("a", F.col("b1").alias("a1"), F.col("b2").alias("a2")).distinct()
    return (
        met.where("id <> a").groupBy("a", "id").agg(F.first("b1").alias("b1"), F.first("b2").alias("b2"))
        .join(side(heads), "a").where(_alike(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"), least))
        .select("a", F.col("id").alias("b"))
    )


def collisions(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b, matches``: in how many coordinates the signatures of a pair have the same value.  The two bits of a
    posting only bound it."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("items").alias(f"items_{c}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")
    return met.select("a", "b", F.size(F.array_intersect("items_a", "items_b")).alias("matches"))


def sketch(shingles: np.ndarray) -> bytes:
    """The low byte of SKETCH minima, a finer estimate for pairs that the signature leaves open."""
    low = np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        h = (shingles[at : at + 512, None] ^ _SKETCH_XOR) * _SKETCH_ODD
        h ^= h >> np.uint64(31)
        low = np.minimum(low, ((h * _SKETCH_ODD) >> np.uint64(32)).min(axis=0))
    return (low & np.uint64(0xFF)).astype(np.uint8).tobytes()


def _cross_pairs(long: DataFrame, comp: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int, percent: int, few: bool, block: int = 1024) -> DataFrame:
    """Members of a long posting that belong to different components.

    Those outside the posting's largest component meet all its members, dealt out in blocks; within the largest
    component nothing is left to find.  They are compared by sketches: a pair at the threshold falls short of the
    matches asked for with a probability below 1e-6."""
    rows = long.join(comp, "id").select("item", "id", F.col("component_id").alias("c"))
    shape = (
        rows.groupBy("item", "c").agg(F.count("*").alias("n"))
        .groupBy("item").agg(F.sum("n").alias("s"), F.count("*").alias("kinds"), F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"))
        .where("kinds > 1")
        .select("item", "main", F.ceil(F.col("s") / block).cast("int").alias("nb"), F.ceil((F.col("s") - F.col("most")) / block).cast("int").alias("na"))
    )
    placed = cut(rows.join(F.broadcast(shape) if few else shape, "item"), "open-postings")

    def fn(texts, batch):
        return {"sketch": [sketch(shingle_set(t, words)) for t in texts]}

    made = cut(per_text(_texts_of(placed.select("id"), df, id_col, text_col), "text", fn, "sketch binary", ["id"]).dropDuplicates(["id", "sketch"]), "sketches")
    lists = placed.groupBy("id").agg(F.collect_list("item").alias("items"))  # at most as many as a prefix has
    placed = placed.join(made.join(lists, "id"), "id")
    a = placed.where("c <> main").select(
        "item", F.pmod(F.xxhash64("id"), "na").cast("int").alias("xa"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("xb"), "id", "c", "sketch", "items"
    )
    b = placed.select(
        F.col("item").alias("item_b"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ya"), F.pmod(F.xxhash64("id"), "nb").cast("int").alias("yb"),
        F.col("id").alias("id_b"), F.col("c").alias("c_b"), F.col("sketch").alias("sketch_b"), F.col("items").alias("items_b"), (F.col("c") != F.col("main")).alias("minor_b"),
    )
    j = percent / 100
    least = int(SKETCH * j - 5 * (SKETCH * j * (1 - j)) ** 0.5)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        if len(left) and len(right):
            other = np.frombuffer(b"".join(right["sketch_b"]), dtype=np.uint8).reshape(-1, SKETCH)
            ids, c, minor = right["id_b"].to_numpy(), right["c_b"].to_numpy(), right["minor_b"].to_numpy()
            width = right["items_b"].map(len).max()
            held = np.stack([np.pad(x, (0, width - len(x)), constant_values=-1) for x in right["items_b"]])
            item, last = left["item"].iloc[0], np.iinfo(np.int64).max
            for i, ci, s, items in zip(left["id"], left["c"], left["sketch"], left["items"]):
                hit = np.flatnonzero(((other == np.frombuffer(s, dtype=np.uint8)).sum(axis=1) >= least) & (c != ci) & (~minor | (ids > i)))
                # a pair that meets in several postings counts in the first of them
                first = np.where(np.isin(held[hit], items), held[hit], last).min(axis=1, initial=last)
                hit = ids[hit[first == item]]
                out_a.append(np.minimum(hit, i)), out_b.append(np.maximum(hit, i))
        none = [np.zeros(0, dtype=np.int64)]
        return pd.DataFrame({"a": np.concatenate(out_a or none), "b": np.concatenate(out_b or none)})

    return a.groupBy("item", "xa", "xb").cogroup(b.groupBy("item_b", "ya", "yb")).applyInPandas(meet, "a bigint, b bigint").distinct()


def _texts_of(ids: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` of the documents named: the ids select them by a broadcast up to a checked number, else by a
    shuffled join."""
    needed = cut(ids.distinct(), "near-ids")
    if needed.count() <= MOST_BROADCAST:
        needed = F.broadcast(needed)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(needed, "id", "left_semi")


def confirm(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of which full shingle sets have ``100 * intersection >= percent * union``."""
    src = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), df, id_col, text_col)

    def fn(texts, rows):
        return {"s": [shingle_set(t, words).view(np.int64) for t in texts]}

    sets = per_text(src, "text", fn, "s array<bigint>", ["id"])
    met = (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .withColumn("i", F.size(F.array_intersect("sa", "sb")))
    )
    return met.where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, matches: int = 35,
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``, one row per input row.

    ``matches``: of 64 coordinates; at a similarity of 0.8 fewer than 35 match with a probability of 1e-7.
    """
    rows = cut(signatures(df, id_col, text_col, words), "signatures")
    classes = cut(
        rows.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "items", "b1", "b2")).alias("x"))
        .select("k1", "k2", "x.id", "x.items", "x.b1", "x.b2"),
        "classes",
    )
    prefixes, few = _prefixes(classes, K - matches + 1)
    posted = cut(prefixes, "postings")
    long = posted.where("df > 0")
    met = cut(_short_pairs(posted, matches).unionByName(_star_pairs(long, matches, few)).distinct(), "met")
    pairs = cut(collisions(met, classes).where(F.col("matches") >= matches).select("a", "b"), "pairs")
    links = cut(confirm(pairs, df, id_col, text_col, words, percent), "links")
    ids = classes.select("id")
    twice = rows.where("n > 0").groupBy("id").agg(F.count_distinct("k1", "k2").alias("texts")).where("texts > 1").select(F.col("id").alias("b"))
    twice = cut(twice, "repeated-ids")
    if twice.limit(1).count():
        bridges = rows.join(twice, rows.id == twice.b).select("k1", "k2", "b").join(classes.select("k1", "k2", F.col("id").alias("a")), ["k1", "k2"]).where("a <> b").select("a", "b")
        links = cut(links.unionByName(bridges), "links")
        ids = ids.unionByName(bridges.select(F.col("b").alias("id")))
    found = cut(components(ids, links), "components")
    rest = cut(_cross_pairs(long, found, df, id_col, text_col, words, percent, few), "pairs")
    if rest.limit(1).count():
        more = cut(confirm(rest, df, id_col, text_col, words, percent), "links")
        found = cut(components(ids, links.unionByName(more)), "components")
    of_class = classes.select("k1", "k2", "id").join(found, "id").select("k1", "k2", "component_id")
    return (
        rows.select("id", "n", "k1", "k2").join(of_class, ["k1", "k2"], "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
         lambda i : array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)),
reach(id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN comp c ON s.doc_id = c.id
"""
