"""Benchmark decontamination: word pairs as seeds, then Smith-Waterman alignment.

Every pair of neighbouring words of an item is a seed, common or rare, so that an edited copy is found whatever else is
in the corpus: no seed is given up for another.  A pass over the documents finds seeds, lines up the places that agree
on an item and scores the stretch by local alignment of words, so that edited copies count by what still aligns.
Stretches that cannot reach the threshold are not aligned: a score is at most the words in common, and as each run of
matches but the last costs an edit, at most half of the words and pairs in common and a half.  By the same count a copy
over the default threshold of 0.4 and of more than five words has an intact pair if words were only replaced or left
out; without one, words must have been put in after nearly every word.

The benchmark goes to the tasks in blocks of bounded size, one pass over the documents for each.  Null or empty texts and
items of fewer than three words match nothing; null ids are carried; repeated documents and items each give rows; of equal scores
the first stretch stands; an empty table gives an empty result; other columns are ignored.  Very long texts cost arrays
proportional to their length, and time in proportion to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import per_text, table, without

WORD = re.compile(r"[^\W_]+")
N = 2
LEAST_WORDS = 3
GAP = 0.5
BITS = np.int64(31)  # of a word's number within a block
PIECE = 256  # words of a text that are looked at together, at least


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def codes_of(ids: np.ndarray) -> np.ndarray:
    """One number for each run of N words, -1 where a word is unknown."""
    m = len(ids) - N + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    out, known = np.zeros(m, dtype=np.int64), np.ones(m, dtype=bool)
    for k in range(N):
        part = ids[k : k + m]
        out = (out << BITS) | np.maximum(part, 0)
        known &= part >= 0
    out[~known] = -1
    return out


def seeds_of(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the items, sorted, with their item."""
    none = [np.zeros(0, dtype=np.int64)]
    grams = [codes_of(x) if len(x) >= LEAST_WORDS else none[0] for x in items]
    code = np.concatenate(grams or none)
    item = np.repeat(np.arange(len(grams)), list(map(len, grams)))
    order = np.argsort(code, kind="stable")
    return code[order], item[order]


@dataclass
class Block:
    """Items of one block: their word numbers, the vocabulary, and seeds as sorted codes with their item."""

    names: list
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    seed_item: np.ndarray

    def __post_init__(self) -> None:
        self.lengths = np.fromiter(map(len, self.items), dtype=np.int64, count=len(self.items))
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([*self.items, np.zeros(0, dtype=np.int64)])
        # items of up to 64 words, 512 and so on apart, as pieces of texts go by the longest; seeds of each by distinct code
        size = np.ceil(np.log2(np.maximum(self.lengths, 64) / 64) / 3).astype(np.int64)[self.seed_item]
        self.codes = np.append(np.unique(self.seeds), np.iinfo(np.int64).max)
        self.classes = []
        for c in np.unique(size):
            item, seeds = self.seed_item[size == c], self.seeds[size == c]
            first = np.searchsorted(seeds, self.codes)
            self.classes.append((int(self.lengths[item].max()), item, first, np.searchsorted(seeds, self.codes, "right") - first))

    def numbers(self, text: str) -> np.ndarray:
        return np.array(list(map(self.vocabulary.get, words_of(text), repeat(-1))), dtype=np.int64)

    def find(self, text: str, threshold: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, seeds, first word, end word) of each item that aligns at or over the threshold.

        The text is taken in pieces that overlap by the longest alignment.  In each, work grows with its distinct seeds and
        what holds them, then with the piece for each item that may still reach the threshold: a pair that item and text
        both repeat is not multiplied out, and time is in proportion to the length of the text."""
        ids = self.numbers(text)
        codes = codes_of(ids)
        here = np.zeros(len(self.vocabulary) + 1, dtype=bool)  # the last is for unknown words
        best: dict[int, tuple[float, int, int]] = {}
        code = np.searchsorted(self.codes, codes)
        held = np.flatnonzero(self.codes[code] == codes)
        code = code[held]
        for longest, seed_item, first_of, n_of in self.classes if len(held) else ():
            overlap = reach(longest, threshold)
            size = max(PIECE, 4 * overlap)
            for start in range(0, max(1, len(ids) - overlap), size - overlap):
                x, y = held.searchsorted((start, start + size - 1))
                if x == y:
                    continue
                at = _distinct(code[x:y])
                n = n_of[at]
                which, pairs = _counted(seed_item[_runs(first_of[at], n)])
                piece = ids[start : start + size]
                here[piece] = True
                here[-1] = False
                m = self.lengths[which]
                if not len(which):
                    here[piece] = False
                    continue
                common = np.add.reduceat(here[self.flat[_runs(self.offsets[which], m)]], m.cumsum() - m, dtype=np.int64)
                here[piece] = False
                for k in which[np.minimum(common, (common + pairs + 1) / 2) >= threshold * m].tolist():
                    item = self.items[k]
                    here[item] = True
                    on = here[piece]
                    here[item] = False
                    for a, b in stretches(on, len(item), threshold):
                        here[piece[a:b]] = True
                        here[-1] = False
                        shared = np.count_nonzero(here[item])
                        here[piece[a:b]] = False
                        if shared < threshold * len(item):
                            continue
                        if (shared + np.isin(codes_of(item), codes[start + a : start + b - 1]).sum() + 1) / 2 < threshold * len(item):
                            continue
                        score, c, d = align(item, piece[a:b])
                        if score >= threshold and (k not in best or score > best[k][0]):
                            best[k] = (score, start + a + c, start + a + d)
        known = np.unique(codes) if best else codes
        return [(k, best[k][0], int(np.isin(codes_of(self.items[k]), known).sum()), *best[k][1:]) for k in sorted(best)]


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...``: n[0] numbers, then n[1] from ``first[1]`` on."""
    ends = n.cumsum()
    return (first - ends + n).repeat(n) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    fresh = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    return x[fresh]


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each is there."""
    x = np.sort(x)
    fresh = np.ones(len(x) + 1, dtype=bool)
    np.not_equal(x[1:], x[:-1], out=fresh[1:-1])
    at = np.flatnonzero(fresh)
    return x[at[:-1]], at[1:] - at[:-1]


def reach(m: int, threshold: float) -> int:
    """Words of a text that an alignment over the threshold with ``m`` words may span: the words, and as many put in as the
    score can spare."""
    return m + int(np.ceil(m * max(0.0, 1 - threshold) / GAP))


def stretches(on: np.ndarray, m: int, threshold: float) -> list[tuple[int, int]]:
    """Stretches of a text that may hold an alignment at or over the threshold with an item of ``m`` words; ``on`` tells
    words of the item.

    An alignment has at least threshold * m words of the item within its reach.  Windows that have as many are joined where
    they overlap."""
    span = reach(m, threshold)
    total = np.append(0, np.cumsum(on))
    starts = np.arange(max(1, len(on) - span + 1))
    ends = np.minimum(starts + span, len(on))
    full = np.flatnonzero(total[ends] - total[starts] >= threshold * m)
    if not len(full):
        return []
    cuts = np.flatnonzero(starts[full][1:] > ends[full][:-1])
    return list(zip(starts[full[np.append(0, cuts + 1)]].tolist(), ends[full[np.append(cuts, len(full) - 1)]].tolist()))


def align(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with match 1, mismatch and gap -GAP: best score as a share of the item's length, and the stretch
    of ``doc`` aligned.  A row at a time: gaps along a row are a running maximum."""
    m, n = len(item), len(doc)
    slope = GAP * np.arange(n + 1)
    h = np.zeros(n + 1)
    origin = np.arange(n + 1)
    best, where = 0.0, (0, 0)
    for i in range(m):
        diagonal = np.zeros(n + 1)
        diagonal[1:] = h[:-1] + np.where(doc == item[i], 1.0, -GAP)
        up = h - GAP
        from_diagonal = diagonal >= up
        t = np.where(from_diagonal, diagonal, up)
        o = np.where(from_diagonal, np.append(0, origin[:-1]), origin)
        fresh = t <= 0
        t[fresh] = 0.0
        o[fresh] = np.arange(n + 1)[fresh]
        lifted = t + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(n + 1), 0))
        h = top - slope
        origin = o[source]
        j = int(np.argmax(h))
        if h[j] > best:
            best, where = float(h[j]), (int(origin[j]), j)
    return best / max(1, m), *where


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, most_chars: int) -> list[Block]:
    """Read the benchmark in blocks of about ``most_chars`` characters; each is built when it is needed."""
    src = benchmark.select(F.col(item_col).alias("name"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    total = src.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // most_chars)
    for k in range(n):
        part = src.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toPandas()
        vocabulary: dict[str, int] = {}
        items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], dtype=np.int64) for t in part["text"]]
        yield Block([None if pd.isna(x) else x for x in part["name"]], items, vocabulary, *seeds_of(items))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = 0.4, most_chars: int = 4_000_000,
) -> DataFrame:
    """``id_col, item_col, score, n_seeds, first_word, end_word`` for each document and item that align.

    ``score``: aligned words less penalties, as a share of the item's words; 1 for a whole copy.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    found = None
    for block in blocks_of(benchmark, item_col, item_text_col, most_chars):
        shared = spark.sparkContext.broadcast(block)

        def fn(texts, rows, shared=shared):
            b = shared.value
            got = [b.find(t, threshold) for t in texts]
            return {"hits": [[(b.names[k], s, n, x, y) for k, s, n, x, y in g] for g in got]}

        src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        hits = per_text(src, "_text", fn, f"hits array<struct<item:{item_type},score:double,n_seeds:bigint,first_word:bigint,end_word:bigint>>", ["_id"])
        part = hits.select("_id", F.explode("hits").alias("h")).select(
            F.col("_id").alias(id_col), F.col("h.item").alias(item_col), "h.score", "h.n_seeds", "h.first_word", "h.end_word"
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{id_col} {id_type}, {item_col} {item_type}, score double, n_seeds bigint, first_word bigint, end_word bigint")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that hold a benchmark item, all columns kept; rows with a null id stay."""
    return without(docs, id_col, contaminated(docs, benchmark, id_col, **options).select(id_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
