"""Spelling variants: k-d trees over letter counts, searched per pair of lengths.

One edit changes the letter counts of a word by little: a replaced letter takes one from a letter and gives one to another
(L1 distance 2, lengths equal), an inserted one adds one (L1 distance 1, lengths one apart).  So the words of each length
stand in a k-d tree over their counts, and a word searches the tree of its own length and that of the next: a branch whose
box asks for more letters than one edit can bring, or leaves more than it can take away, is pruned.  What is reached is
verified letter by letter.

The top of each tree comes from a bounded sample of the vocabulary and cuts it into cells of about ``CELL`` words; every
word is posted to its cell and, as a query, to each cell that its search reaches.  A cell is searched by a tree of its own
in one task.  Cells that the sample underrates, or whose words no count tells apart (anagrams), are dealt out in blocks.

Words are maximal runs of the letters a-z, A-Z and U+00C0 to U+00FF, A-Z lower-cased; they are counted per slice of texts
before they are shuffled.  Null texts have none; a null id is written as nothing where ids are part of a hash; rows that
repeat an id or a text count as often as they stand there.  Of near words with equal counts the smallest in code-point order
is the form.  Texts and words of any length are taken whole.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import bounded_fraction, chunks, cut, hash_fraction, py_lower_ascii, small_batches, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS = 26 + 64
CELL = 2048
LEAF = 12
MOST_COUNT = 100  # counts are cut off here: that only brings boxes closer
FAR = 1 << 14
PAIR_BYTES = 1 << 24
VISITORS = 50_000

_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[97:123] = np.arange(26)
_LETTER[0xC0:] = np.arange(26, LETTERS)


def spread(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points, all of which are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    out = np.zeros((len(letters), LETTERS), dtype=np.int32)
    rows = np.arange(len(letters))
    for i in range(letters.shape[1]):
        out[rows, _LETTER[letters[:, i]]] += 1
    return np.minimum(out, MOST_COUNT).astype(np.int16)


@dataclass
class Tree:
    """Inner nodes ``(dimension, cut, left, right)``: counts up to ``cut`` are left.  Children below zero are leaves, -1 the first."""

    nodes: list[tuple[int, int, int, int]]
    root: int
    leaves: int

    def visit(self, points: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and the points that may reach them by at most ``more`` letters added and ``fewer`` taken away."""
        zero = np.zeros(len(points), dtype=np.int16)
        stack = [(self.root, np.arange(len(points)), zero, zero, {}, {})]
        while stack:
            node, at, up, down, low, high = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at
                continue
            d, t, left, right = self.nodes[node]
            v = points[at, d]
            shrunk = down - np.maximum(v - high.get(d, FAR), 0) + np.maximum(v - t, 0)
            on = shrunk <= fewer
            stack.append((left, at[on], up[on], shrunk[on], low, high | {d: t}))
            grown = up - np.maximum(low.get(d, 0) - v, 0) + np.maximum(t + 1 - v, 0)
            on = grown <= more
            stack.append((right, at[on], grown[on], down[on], low | {d: t + 1}, high))


def build(points: np.ndarray, most: int) -> tuple[Tree, list[np.ndarray]]:
    """Split at the count that halves a node best, until at most ``most`` points are left or all are equal."""
    nodes: list[tuple[int, int, int, int]] = []
    members: list[np.ndarray] = []

    def halves(at: np.ndarray) -> tuple[int, int] | None:
        if len(at) <= most:
            return None
        here, n = points[at], len(at)
        top, best, found = int(here.max()), 0, None
        for t in range(top):
            under = np.count_nonzero(here <= t, axis=0)
            even = np.minimum(under, n - under)
            d = int(even.argmax())
            if even[d] > best:
                best, found = int(even[d]), (d, t)
            if 2 * best >= n - 1:
                break
        return found

    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]
    root = -1
    while todo:
        at, parent, side = todo.pop()
        split = halves(at)
        if split is None:
            members.append(at)
            me = -len(members)
        else:
            me = len(nodes)
            nodes.append((*split, 0, 0))
            below = points[at, split[0]] <= split[1]
            todo += [(at[below], me, 2), (at[~below], me, 3)]
        if parent < 0:
            root = me
        else:
            whole = list(nodes[parent])
            whole[side] = me
            nodes[parent] = tuple(whole)
    return Tree(nodes, root, len(members)), members


ONE_LEAF = Tree([], -1, 1)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``a`` and ``b``, of one length, differ in one letter."""
    return np.count_nonzero(a != b, axis=-1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b`` are rows of ``a`` with one letter put in."""
    front = np.logical_and.accumulate(a == b[..., :-1], axis=-1).sum(axis=-1)
    back = np.logical_and.accumulate((a == b[..., 1:])[..., ::-1], axis=-1).sum(axis=-1)
    return front + back >= a.shape[-1]


def near_rows(asked: np.ndarray, there: np.ndarray, tree: Tree, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``asked`` and of ``there`` that are one edit apart; ``there`` is as long or longer by one letter."""
    same = asked.shape[1] == there.shape[1]
    tell = replaced if same else inserted
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for leaf, at in tree.visit(letter_counts(asked), 1, int(same)):
        inside = members[leaf]
        for some in range(0, len(inside), 256):
            part = inside[some : some + 256]
            step = max(1, PAIR_BYTES // (len(part) * max(1, asked.shape[1])))
            for first in range(0, len(at), step):
                x = at[first : first + step]
                i, j = np.nonzero(tell(asked[x][:, None, :], there[part][None, :, :]))
                a.append(x[i])
                b.append(part[j])
    return np.concatenate(a), np.concatenate(b)


# ---------------------------------------------------------------------------------------------------------------


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least: int = 5, noise: int = 199) -> DataFrame:
    """``word, n``.  ``noise`` makes misspellings: where it divides the crc32 of ``<id>:<word>``, the word loses the letter
    that the crc32 points at; 0 makes none."""
    src = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    small_batches(df.sparkSession)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  chunks uses it

        counts: Counter = Counter()
        for batch in batches:
            ids = batch.column(0)
            for start, _, texts in chunks(batch, "text", 1 << 20):
                for k, text in enumerate(texts):
                    seed = crc32(f"{ids[start + k].as_py()}:".encode())
                    for w, c in Counter(RUN.findall(text)).items():
                        if len(w) < least_chars:
                            continue
                        w = py_lower_ascii(w)
                        if noise and not (h := crc32(w.encode(), seed)) % noise:
                            k2 = h % len(w)
                            w = w[:k2] + w[k2 + 1 :]
                            if len(w) < least_chars:
                                continue
                        counts[w] += c
                if len(counts) > 200_000:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame, most_sample: int = 100_000) -> DataFrame:
    """``words(word, n)``, a table -> ``word, n_near, best struct<negative n, word>`` of those that have near words."""
    spark = words.sparkSession
    total = words.count()
    fraction = bounded_fraction(total, most_sample)
    sample = words.where(hash_fraction("word", fraction=fraction)).select("word").toPandas()["word"]
    by_length = {int(n): part.tolist() for n, part in sample.groupby(sample.str.len())} if len(sample) else {}
    trees = spark.sparkContext.broadcast({n: build(letter_counts(spread(part)), max(1, int(CELL * fraction)))[0] for n, part in by_length.items()})

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A visit of a tree costs by its nodes: many words go at once."""
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= VISITORS:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in together(batches):
            for n, part in b.groupby(b["word"].str.len()):
                n = int(n)
                points = letter_counts(spread(part["word"].tolist()))
                for length, role in ((n, 1), (n + 1, 2)):
                    tree = trees.value.get(length, ONE_LEAF)
                    home = np.full(len(part), -1)
                    if role == 1:
                        for leaf, at in tree.visit(points, 0, 0):
                            home[at] = leaf
                    for leaf, at in tree.visit(points, 1, 2 - role):
                        yield part.iloc[at].assign(length=length, cell=leaf, role=np.where(home[at] == leaf, 0, role))[["length", "cell", "role", "word", "n"]]

    posted = words.select("word", "n").mapInPandas(post, "length int, cell int, role int, word string, n bigint")
    posted = cut(posted, "spelling-cells")
    # role 0: a word of the cell, which also asks; 1: one of its length that asks; 2: a shorter one that asks
    cells = posted.groupBy("length", "cell").agg(F.count_if(F.col("role") == 0).alias("n_words")).where("n_words > 0").select(
        "length", "cell", F.ceil(F.col("n_words") / (4 * CELL)).cast("int").alias("blocks")
    )
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    dealt = (
        posted.join(cells, ["length", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("role", F.when((F.col("role") == 0) & (F.col("block") != mine), 1).otherwise(F.col("role")))
        .select("length", "cell", "block", "role", "word", "n")
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        word, n, role = (pdf[c].to_numpy() for c in ("word", "n", "role"))
        home = np.flatnonzero(role == 0)
        letters = spread(word[home].tolist())
        tree, members = build(letter_counts(letters), LEAF)
        pairs = []
        for asking, longer in ((np.flatnonzero(role < 2), False), (np.flatnonzero(role == 2), True)):
            if len(asking):
                a, b = near_rows(spread(word[asking].tolist()), letters, tree, members)
                a, b = asking[a], home[b]
                pairs.append((a, b))
                if longer:
                    pairs.append((b, a))
        a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
        found = pd.DataFrame({"word": word[a], "other": word[b], "minus": -n[b]}).sort_values(["word", "minus", "other"])
        groups = found.groupby("word", sort=False)
        first = groups.head(1)
        return pd.DataFrame({"word": first["word"], "n_near": groups.size().to_numpy(), "minus": first["minus"], "other": first["other"]})

    hits = dealt.groupBy("length", "cell", "block").applyInPandas(search, "word string, n_near bigint, minus bigint, other string")
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "other")).alias("best"))


def roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``word, form`` -> ``word, root``: forms of forms, twice as far each round.  Counts grow along forms, so they end."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(most_rounds):
        far = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = cut(at.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = nxt.select("word", "root")
        if not nxt.where("moved").limit(1).count():
            return at
    raise RuntimeError("forms did not settle")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 5, **options) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of the vocabulary."""
    words = cut(vocabulary(df, id_col, text_col, **options), "spelling-words")
    near = near_words(words)
    n_form = -F.col("best.minus")
    is_form = F.coalesce(n_form >= ratio * F.col("n"), F.lit(False))
    found = cut(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, n_form).alias("form_n")
        ),
        "spelling-forms",
    )
    return found.join(roots(found.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


#: Bytes of a word: code points U+00C0 to U+00FF are 195 and the code point less 64.  Near words share a word with one
#: letter left out: at one place both, or at any place the longer one.
ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i : list_reduce(list_concat([i], range(8)),
           lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM runs GROUP BY ALL HAVING length(any_value(run)) >= 6),
hashed AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
           lambda x : CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
         lambda h, b : xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(c) >= 5),
without AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN without b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN without b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(o := other, n := n), struct_pack(m := -n, o := other)) AS b FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.b.n >= 5 * w.n THEN b.b.o END AS form, CASE WHEN b.b.n >= 5 * w.n THEN b.b.n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""
