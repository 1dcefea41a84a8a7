"""Language-model scoring with a log-frequency Bloom filter.

Words and word pairs (bigrams) of the training texts are counted in Spark.  A count c becomes the level 1 + floor(log_b
c); the filter holds (n-gram, 1) .. (n-gram, level), so that a count comes back, a little overestimated at times and
never under, by probing rising levels until one is missing.  Every n-gram is in the filter, so the filter grows with the
corpus.  It is built in segments by hash, each in one task, from a bounded number of n-grams.

Texts are cut into slices.  A slice sends each segment its distinct words, and the distinct pairs of its training texts,
with their counts, packed; a frequent n-gram is sent once a slice, so no segment is hot, and there are never more rows than
n-grams.  The segment adds the counts up, builds its part of the filter and answers exact counts of words, by their whole
64-bit hashes, for the base score.  Up to a checked size the filter is then broadcast and probed where the texts are.  Beyond it
the n-grams of the texts go to the segment that holds them.  Both ways probe the same bits, so results are the same.

Probabilities are smoothed: p(word) by add-one over estimated counts; p(word | word before) has a Dirichlet prior that
backs off to p(word).

Null texts count as empty: one end token.  Rows that repeat an id and text each come back; a null id is carried; a null
in ``learns`` is false; no training text at all gives every token probability 1 in the base and the model.  Very long
texts cost arrays proportional to their length; other columns are ignored; ties do not arise; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import cut, held_out, mix, small_batches, table, word_hashes

END = np.uint64(0x0E4DE4DE4DE4DE4D)
LOG_BASE = 1.6
PROBES = 6
BITS_PER_ITEM = 10
SLICE_CHARS = 1 << 23
SEGMENT_TOKENS = 1 << 21
KEY_BITS = np.uint64(40)  # of a hash: the lower bits are the key in the filter, the upper ones name the segment
MOST_SEGMENTS = 1 << 24
MOST_BROADCAST = 1 << 27  # bytes of a filter that every worker holds
PAIR_SALT = np.uint64(1 << 63)


def tokens(text: str) -> np.ndarray:
    return np.append(word_hashes(text)[0], END)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LOG_BASE) + 1e-9).astype(np.int64)


def expected_count(level: np.ndarray) -> np.ndarray:
    """The middle of a level's range; 0 at level 0."""
    j = level.astype(np.float64)
    return np.where(level > 0, (LOG_BASE ** (j - 1) + np.maximum(LOG_BASE**j - 1, LOG_BASE ** (j - 1))) / 2, 0.0)


def _probe(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    item = mix(keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return item, mix(item + np.uint64(1)) | np.uint64(1)


def _place(item: np.ndarray, step: np.ndarray, i: int, size: np.ndarray | np.uint64) -> np.ndarray:
    return ((item + np.uint64(i) * step) >> np.uint64(8)) % size


def segment_bits(keys: np.ndarray, counts: np.ndarray, bits_per_item: int = BITS_PER_ITEM) -> bytes:
    """The bits of one segment, for distinct n-grams with their counts."""
    n = levels(counts)
    flags = np.zeros(-(-max(64, int(n.sum()) * bits_per_item) // 8) * 8, dtype=bool)
    j = 1
    while len(keys):
        item, step = _probe(keys, j)
        for i in range(PROBES):
            flags[_place(item, step, i, np.uint64(len(flags)))] = True
        more = n > j
        keys, n, j = keys[more], n[more], j + 1
    return np.packbits(flags, bitorder="little").tobytes()


@dataclass
class Filter:
    """Segments one after another in ``bits``; those without n-grams are eight zeros at the end."""

    bits: np.ndarray
    starts: np.ndarray  # of each segment, in bits
    sizes: np.ndarray

    @classmethod
    def of(cls, segments: int, held: Iterable[tuple[int, bytes]], size: int) -> Filter:
        """From segments with ``size`` bytes in all, taken one at a time."""
        made = cls(np.zeros(size + 1, dtype=np.uint8), np.full(segments, size * 8, dtype=np.int64), np.full(segments, 8, dtype=np.uint64))
        at = 0
        for k, x in held:
            made.bits[at : at + len(x)] = np.frombuffer(x, dtype=np.uint8)
            made.starts[k], made.sizes[k] = at * 8, len(x) * 8
            at += len(x)
        return made

    def level(self, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Probe level 1, then 2 for those found, and so on."""
        out = np.zeros(len(keys), dtype=np.int64)
        left, j = np.arange(len(keys)), 1
        while len(left):
            item, step = _probe(keys[left], j)
            start, size = self.starts[segment[left]], self.sizes[segment[left]]
            for i in range(PROBES):
                # only what is left is probed again
                at = start + _place(item, step, i, size).astype(np.int64)
                alive = (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                left, item, step, start, size = (x[alive] for x in (left, item, step, start, size))
            out[left] = j
            j += 1
        return out


# ---------------------------------------------------------------------------------------------------------------
# slices of texts


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, lowest first, as many bytes as the largest needs."""
    x = x.astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _slices(df: DataFrame, id_col: str, text_col: str, learns: Column, slice_chars: int) -> DataFrame:
    """Texts as numbers: ``slice, n, ids, sizes, learn, words, tokens``.  ``words``: hashes of the distinct tokens of a
    slice, frequent ones first; ``tokens``: their places in it, in text order."""
    small_batches(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.coalesce(learns.cast("boolean"), F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    id_type = src.schema["id"].dataType

    def flush(number: int, ids: list, learn: list, texts: list[str]) -> dict:
        parts = [tokens(t) for t in texts]
        flat = np.concatenate(parts)
        at, words = pd.factorize(flat)
        order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        return {
            "slice": (TaskContext.get().partitionId() << 32) + number, "n": len(flat), "ids": ids, "sizes": list(map(len, parts)), "learn": learn,
            "words": words[order].tobytes(), "tokens": zlib.compress(_planes(rank[at]), 1),
        }

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"slice bigint, n bigint, ids array<{id_type.simpleString()}>, sizes array<int>, learn array<boolean>, words binary, tokens binary"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        ids, learn, texts, chars, number = [], [], [], 0, 0
        for b in batches:
            for i, on, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                ids.append(i), learn.append(on), texts.append(t or "")
                chars += len(texts[-1])
                if chars >= slice_chars:
                    yield pa.RecordBatch.from_pylist([flush(number, ids, learn, texts)], schema=arrow)
                    ids, learn, texts, chars, number = [], [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pylist([flush(number, ids, learn, texts)], schema=arrow)

    return cut(src.mapInArrow(run, schema), "lm-slices")


@dataclass
class Slice:
    """The distinct words of a slice and where each token's word stands among them."""

    words: np.ndarray  # hashes
    token: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: bytes, packed: bytes, n: int, sizes: np.ndarray) -> Slice:
        return cls(np.frombuffer(words, dtype=np.uint64), _from_planes(zlib.decompress(packed), n).astype(np.int64), np.cumsum(sizes) - sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each token's pair stands among the distinct ones; the words of each, first and second."""
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.starts] = np.flatnonzero(self.words == END)[0]
        pair_of, code = pd.factorize(before * len(self.words) + self.token)
        return pair_of, code // len(self.words), code % len(self.words)

    def hashes(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words and pairs."""
        return mix(self.words), mix(self.words[before] * np.uint64(0xD6E8FEB86659FD93) + self.words[after] + np.uint64(0x51))


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> KEY_BITS) % np.uint64(segments)).astype(np.int64)


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << int(KEY_BITS)) - 1)


def _pair_keys(hashes: np.ndarray) -> np.ndarray:
    return _word_keys(hashes) | PAIR_SALT


def _by_segment(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by segment, and the segments in it."""
    segment = _segment(hashes, segments)
    order = np.argsort(segment, kind="stable")
    return order, segment[order]


SENT = "segment bigint, slice bigint, n_word int, words binary, word_counts binary, n_pair int, pairs binary, pair_counts binary"


def _sent(slices: DataFrame, segments: int, counting: bool) -> DataFrame:
    """``SENT``: distinct n-grams of each slice for each segment.  ``counting``: with how often training texts of the slice
    hold them, and only pairs that they hold."""

    def run(batches):
        for b in batches:
            for row in b.itertuples():
                sizes = np.asarray(row.sizes)
                s = Slice.of(row.words, row.tokens, row.n, sizes)
                pair_of, before, after = s.pairs()
                on = np.repeat(np.asarray(row.learn, dtype=np.float64), sizes)
                found: dict[int, dict] = {}
                for kind, hashes, at in zip(("word", "pair"), s.hashes(before, after), (s.token, pair_of)):
                    counts = np.bincount(at, weights=on, minlength=len(hashes)).astype(np.int64)
                    if counting and kind == "pair":
                        hashes, counts = hashes[counts > 0], counts[counts > 0]
                    order, segment = _by_segment(hashes, segments)
                    keys, counts = hashes[order], counts[order]
                    if kind == "pair":
                        keys = _word_keys(keys)
                    ids, first = np.unique(segment, return_index=True)
                    for k, x, y in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(segment)]):
                        packed = _planes(counts[x:y]) if counting else b""
                        found.setdefault(k, {}).update({f"n_{kind}": y - x, f"{kind}s": _planes(keys[x:y]), f"{kind}_counts": packed})
                none = {"n_word": 0, "words": b"", "word_counts": b"", "n_pair": 0, "pairs": b"", "pair_counts": b""}
                yield pd.DataFrame([{"segment": k, "slice": row.slice} | none | x for k, x in found.items()])

    return slices.select("slice", "n", "sizes", "learn", "words", "tokens").mapInPandas(run, SENT)


def _unpacked(pdf: pd.DataFrame, col: str, sizes: str) -> np.ndarray:
    return np.concatenate([_from_planes(x, k) for x, k in zip(pdf[col], pdf[sizes])])


def _parts(x: np.ndarray, sizes: pd.Series) -> list[np.ndarray]:
    return np.split(x, np.cumsum(sizes.to_numpy())[:-1])


def _counted(sent: DataFrame, bits_per_item: int) -> DataFrame:
    """``segment, slice, n_word, word_counts, bits, n, v``: exact counts of the words that each slice sent; the first row of a
    segment has its bits of the filter, and tokens and distinct tokens in training."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [], []
        for kind, as_keys in (("word", _word_keys), ("pair", _pair_keys)):
            at, hashes = pd.factorize(_unpacked(pdf, f"{kind}s", f"n_{kind}"))
            weights = _unpacked(pdf, f"{kind}_counts", f"n_{kind}").astype(np.float64)
            seen = np.bincount(at, weights=weights, minlength=len(hashes)).astype(np.int64)
            if kind == "word":
                answers, n, v = _parts(seen[at], pdf["n_word"]), int(seen.sum()), int((seen > 0).sum())
            keys.append(as_keys(hashes[seen > 0])), counts.append(seen[seen > 0])
        out = pdf[["segment", "slice", "n_word"]].copy()
        out["word_counts"] = [_planes(x) for x in answers]
        out["bits"] = [segment_bits(np.concatenate(keys), np.concatenate(counts), bits_per_item), *[None] * (len(pdf) - 1)]
        out["n"], out["v"] = [n, *[0] * (len(pdf) - 1)], [v, *[0] * (len(pdf) - 1)]
        return out

    return sent.groupBy("segment").applyInPandas(run, "segment bigint, slice bigint, n_word int, word_counts binary, bits binary, n bigint, v bigint")


def _probed(sent: DataFrame, bits: DataFrame) -> DataFrame:
    """``slice, segment, word_levels, pair_levels``: what each segment's bits say of the n-grams sent to it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = Filter.of(1, [(0, x) for x in right["bits"]], int(right["bits"].str.len().sum()))
        out = left[["slice", "segment"]].copy()
        for kind, as_keys in (("word", _word_keys), ("pair", _pair_keys)):
            keys = as_keys(_unpacked(left, f"{kind}s", f"n_{kind}"))
            level = made.level(keys, np.zeros(len(keys), dtype=np.int64)).astype(np.uint8)
            out[f"{kind}_levels"] = [x.tobytes() for x in _parts(level, left[f"n_{kind}"])]
        return out

    return sent.groupBy("segment").cogroup(bits.groupBy("segment")).applyInPandas(run, "slice bigint, segment bigint, word_levels binary, pair_levels binary")


def _back(x: np.ndarray, hashes: np.ndarray, segments: int) -> np.ndarray:
    """From the order by segment to that of ``hashes``."""
    out = np.empty_like(x)
    out[_by_segment(hashes, segments)[0]] = x
    return out


def score(
    df: DataFrame, learns: Column, text_col: str = "text", id_col: str = "doc_id", prior: float = 300.0, slice_chars: int = SLICE_CHARS,
    segment_tokens: int = SEGMENT_TOKENS, bits_per_item: int = BITS_PER_ITEM, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` of every row; the rows where ``learns`` is true
    are the training texts.  ``slice_chars`` and ``segment_tokens`` bound the memory of a task; results do not depend on
    them but for false positives of the filter, about 1 % of the n-grams not seen at ten bits an item.  A filter of up to
    ``most_broadcast`` bytes is broadcast, a larger one is probed where its segments are, with the same results."""
    spark = df.sparkSession
    slices = _slices(df, id_col, text_col, learns, slice_chars)
    total = slices.agg(F.sum("n")).first()[0] or 0
    segments = min(MOST_SEGMENTS, max(1, -(-total // segment_tokens)))
    counted = cut(_counted(_sent(slices, segments, counting=True), bits_per_item), "lm-counts")
    n, v, size = (int(x or 0) for x in counted.agg(F.sum("n"), F.sum("v"), F.sum(F.length("bits"))).first())
    bits = counted.where("bits is not null").select("segment", "bits")

    answers = counted.select("slice", "segment", "n_word", "word_counts")
    shared = None
    if size + 16 * segments <= most_broadcast:
        shared = spark.sparkContext.broadcast(Filter.of(segments, bits.toLocalIterator(), size))
    else:
        answers = answers.join(_probed(_sent(slices, segments, counting=False), bits), ["slice", "segment"], "full")

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        sizes = np.asarray(row.sizes)
        s = Slice.of(row.words, row.tokens, row.n, sizes)
        pair_of, before, after = s.pairs()
        words, pairs = s.hashes(before, after)
        right = right.sort_values("segment")
        counts = right[right["word_counts"].notna()]
        count = _back(_unpacked(counts.astype({"n_word": np.int64}), "word_counts", "n_word").astype(np.int64), words, segments)
        if shared is None:
            told = lambda col: np.frombuffer(b"".join(right[col]), dtype=np.uint8).astype(np.int64)
            word_level, pair_level = _back(told("word_levels"), words, segments), _back(told("pair_levels"), pairs, segments)
        else:
            word_level = shared.value.level(_word_keys(words), _segment(words, segments))
            pair_level = shared.value.level(_pair_keys(pairs), _segment(pairs, segments))
        about = expected_count(word_level)
        alone = (about + 1) / (n + v + 1)
        past = about[before]
        both = np.minimum(expected_count(pair_level), np.minimum(past, about[after]))
        p = np.log10((both + prior * alone[after]) / (past + prior)) if n else np.zeros(len(past))
        base = np.log10((count + 1) / (n + v + 1))
        add = lambda x: np.add.reduceat(x, s.starts)
        return pd.DataFrame(
            {
                "id": list(row.ids), "n_tokens": sizes, "n_known": add((count > 0).astype(np.int64)[s.token]), "train_tokens": n,
                "base_score": add(base[s.token]), "score": add(p[pair_of]),
            }
        )

    id_type = df.schema[id_col].dataType.simpleString()
    scored = (
        slices.groupBy("slice").cogroup(answers.groupBy("slice"))
        .applyInPandas(finish, f"id {id_type}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    )
    return scored.select(F.col("id").alias(id_col), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), ~held_out("doc_id", 7, 2))
    return found.withColumn("held_out", held_out("doc_id", 7, 2))
