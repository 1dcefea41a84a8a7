"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts become arrays of codepoint classes.  Each class symbol is a transition function over a handful of automaton
states; composing functions is associative, so the states at all positions come from a scan over blocks, with no
regular expression.  The boundaries cut the text into byte slices that feed a cached pair merger; the byte offset of each
slice is retained and gives the offset of each token.  Decoding puts the bytes of each token where its offset says, all
texts of a slice of rows at once, and can decode a stretch of a text alone.

Null texts count as empty (no tokens); very long texts cost arrays proportional to their length; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import per_text, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: White space of the splitting pattern (fixed values).
SPACES = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# symbols
LETTER, NUMBER, OTHER, APOS1, APOS2, LAST_BLANK, BLANK, LAST_SPACE, SPACE, RESET = range(10)
# states: after a whole piece; inside letters, numbers, others; a blank that joins what follows; inside white space;
# one or two letters of a contraction to come
DONE, IN_L, IN_N, IN_O, JOIN, IN_W, TAKE1, TAKE2 = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    nxt, start = np.zeros((10, 8), dtype=np.uint8), np.ones((10, 8), dtype=bool)
    goes_on = {
        LETTER: (IN_L, (IN_L, JOIN)), NUMBER: (IN_N, (IN_N, JOIN)), OTHER: (IN_O, (IN_O, JOIN)),
        BLANK: (IN_W, (IN_W,)), SPACE: (IN_W, (IN_W,)), LAST_BLANK: (JOIN, ()), LAST_SPACE: (DONE, ()), RESET: (DONE, ()),
    }
    for sym, (state, inside) in goes_on.items():
        nxt[sym] = state
        start[sym, list(inside)] = False
    for sym, state in ((APOS1, TAKE1), (APOS2, TAKE2)):
        nxt[sym] = state
        nxt[sym, [IN_O, JOIN]] = IN_O
        start[sym, [IN_O, JOIN]] = False
    nxt[LETTER, TAKE1], nxt[LETTER, TAKE2] = DONE, TAKE1
    start[LETTER, [TAKE1, TAKE2]] = False
    return nxt, start


NEXT, START = _tables()
_NEXT, _START = NEXT.ravel(), START.ravel()


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
    out[SPACES] = SPACE
    return out


def boundaries(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in ``cps``, texts joined with one separator at each position in ``ends``."""
    n = len(cps)
    if not n:
        return np.zeros(0, dtype=bool)
    sym = codepoint_classes()[cps]
    space = sym == SPACE
    more = np.zeros(n, dtype=bool)  # a character that is no white space follows in the same text
    more[:-1] = ~space[1:]
    more[ends[ends > 0] - 1] = False
    blank = cps == 0x20
    sym[blank] = BLANK
    sym[space & more] = LAST_SPACE
    sym[blank & more] = LAST_BLANK
    apos = np.flatnonzero(cps == 0x27)
    if len(apos):
        pad = np.append(cps, [0, 0])
        a, b = pad[apos + 1], pad[apos + 2]
        sym[apos[np.isin(a, [ord(c) for c in "stmd"])]] = APOS1
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        sym[apos[two]] = APOS2
    sym[ends] = RESET
    steps = 64
    rows = -(-n // steps)
    grid = np.full(rows * steps, RESET, dtype=np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, steps).T).astype(np.intp) * 8
    # each block's function from state to state
    fun = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for t in range(steps):
        fun = _NEXT[grid[t][:, None] + fun]
    # the functions of all blocks up to each: a scan by doubling
    jump = 1
    while jump < rows:
        fun[jump:] = np.take_along_axis(fun[jump:], fun[:-jump].astype(np.intp), axis=1)
        jump *= 2
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = fun[:-1, DONE]
    begins = np.empty((steps, rows), dtype=bool)
    for t in range(steps):
        at = grid[t] + state
        begins[t] = _START[at]
        state = _NEXT[at]
    return np.ascontiguousarray(begins.T).ravel()[:n]


class Codec:
    """Cached pair merging for one rank table.  ``most`` bounds the cache: it is emptied when full."""

    def __init__(self, ranks: dict[bytes, int], most: int = 1 << 18):
        self.ranks, self.most = ranks, most
        self.text_of = {i: str(i) for i in ranks.values()}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        n = by_id[-1][1] + 1 if by_id else 0
        self.sizes, self.first = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        ids = [i for _, i in by_id]
        self.sizes[ids] = [len(t) for t, _ in by_id]
        self.first[ids] = np.cumsum(self.sizes[ids]) - self.sizes[ids]
        self.blob = np.frombuffer(b"".join(t for t, _ in by_id), dtype=np.uint8)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # the part from i to end[i]
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] - i != size:
                continue
            j = end[i]
            alive[j], end[i] = False, end[j]
            if end[i] < n:
                before[end[i]] = i
                k = end[end[i]]
                if (r := self.ranks.get(piece[i:k])) is not None:
                    heapq.heappush(heap, (r, i, k - i))
            h = before[i]
            if h >= 0 and (r := self.ranks.get(piece[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, end[i] - h))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        found = list(map(self.cache.get, pieces))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    piece = pieces[k]
                    x = self.cache.get(piece)
                    if x is None:
                        x = self.merge(piece)
                        if len(piece) <= 64:
                            if len(self.cache) >= self.most:
                                self.cache.clear()
                            self.cache[piece] = x
                    found[k] = x
        return found

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, how many each text has, and the byte offset of each token in its
        text."""
        joined = "\n".join(texts) + "\n"
        cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        data = joined.encode("utf-8")
        begins = np.flatnonzero(boundaries(cps, ends))
        if len(data) == len(cps):
            at = begins
        else:
            width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            at = (np.cumsum(width) - width)[begins]
        closes = np.searchsorted(begins, ends)  # the separator's own piece
        where = [*at.tolist(), len(data)]
        found = self([data[a:b] for a, b in zip(where, where[1:])])
        for k in closes.tolist():
            found[k] = ()
        n_of = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(n_of.sum()))
        text_of = np.searchsorted(closes, np.arange(len(found)))  # of each piece
        starts = np.concatenate([[0], at[closes[:-1]] + 1])  # of each text, in bytes
        done = np.cumsum(n_of)
        size = self.sizes[ids]
        before = np.cumsum(size) - size
        lead = np.zeros(len(found), dtype=np.int64)
        some = n_of > 0
        lead[some] = before[(done - n_of)[some]]
        offsets = np.repeat(at - starts[text_of] - lead, n_of) + before
        counts = np.diff(done[closes], prepend=0)
        return ids, counts, offsets

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """For each text its token ids and the byte offset of each token."""
        if not texts:
            return []
        ids, counts, offsets = self.encode_all(texts)
        cuts = np.cumsum(counts)[:-1]
        return [(a.tolist(), b.tolist()) for a, b in zip(np.split(ids, cuts), np.split(offsets, cuts))]

    def decode_all(self, ids: np.ndarray, counts: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts one after another, and where each text ends: every token is put at its offset."""
        size = self.sizes[ids]
        last = np.cumsum(counts) - 1
        lengths = np.where(counts > 0, offsets[last] + size[last], 0) if len(ids) else np.zeros(len(counts), dtype=np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(ends - lengths, counts) + offsets
        out = np.zeros(total, dtype=np.uint8)
        ramp = np.arange(int(size.sum()))
        ramp -= np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(place, size) + ramp] = self.blob[np.repeat(self.first[ids], size) + ramp]
        return out.tobytes(), ends

    def decode(self, ids: list[int], offsets: list[int] | None = None, start: int = 0, end: int | None = None) -> bytes:
        """The bytes from ``start`` to ``end`` of one text; with offsets, only the tokens that reach into them are
        decoded."""
        ids = np.asarray(ids, dtype=np.int64)
        at = np.cumsum(self.sizes[ids]) - self.sizes[ids] if offsets is None else np.asarray(offsets, dtype=np.int64)
        if not len(ids) or end is not None and end <= start:
            return b""
        x = max(0, int(np.searchsorted(at, start, "right")) - 1)
        y = len(ids) if end is None else int(np.searchsorted(at, end, "left"))
        found, _ = self.decode_all(ids[x:y], np.array([y - x]), at[x:y] - at[x])
        return found[start - int(at[x]) : None if end is None else end - int(at[x])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_codecs: dict[str, Codec] = {}


def _shared(spark: SparkSession, path: str):
    """The rank table's bytes, read once on the driver and broadcast: its size is the vocabulary's (under 1 MB)."""
    with open(path, "rb") as f:
        raw = f.read()
    return spark.sparkContext.broadcast((hashlib.md5(raw).hexdigest(), raw))


def _codec(shared) -> Codec:
    key, raw = shared.value
    if key not in _codecs:
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})
    return _codecs[key]


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids array<int>`` and ``offsets array<int>`` (first byte of each token) to the columns in ``keep``."""
    shared = _shared(df.sparkSession, ranks_path)

    def fn(texts, rows):
        got = _codec(shared).encode(texts)
        return {"ids": [x[0] for x in got], "offsets": [x[1] for x in got]}

    return per_text(df, text_col, fn, "ids array<int>, offsets array<int>", keep or ["doc_id"])


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", offsets_col: str = "offsets") -> DataFrame:
    """Add ``decoded binary`` to a frame with token ids and their offsets; null where either is null."""
    shared = _shared(df.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def back(ids, offsets):
        codec = _codec(shared)
        return pd.Series([None if x is None or o is None else codec.decode(x, o) for x, o in zip(ids, offsets)], dtype=object)

    return df.withColumn("decoded", back(F.col(ids_col), F.col(offsets_col)))


def round_trip(df: DataFrame, ranks_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode, decode and digest in one pass, so that token lists need not leave the task."""
    shared = _shared(df.sparkSession, ranks_path)

    def fn(texts, rows):
        codec = _codec(shared)
        ids, counts, offsets = codec.encode_all(texts)
        data, ends = codec.decode_all(ids, counts, offsets)
        said = list(map(codec.text_of.__getitem__, ids.tolist()))
        at, lo, ids_sha, text_sha = 0, 0, [], []
        for n, hi in zip(counts.tolist(), ends.tolist()):
            ids_sha.append(hashlib.sha256(",".join(said[at : at + n]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(data[lo:hi]).hexdigest())
            at, lo = at + n, hi
        return {"n_tokens": counts.tolist(), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return per_text(df, text_col, fn, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", [id_col])


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_ranks())
