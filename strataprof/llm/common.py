"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows with whole texts are long: send Python workers fewer at a time than the default, unless it was changed."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session on one machine (a local master) gets a temporary folder; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strataprof-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` wrote in this process.  To be called once the results that read them are written
    or collected; how many there were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: later steps neither recompute it nor depend
    on an executor's disk, and Spark knows its real size when it picks a join."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/strataprof/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false where the id is null."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_fraction(n: int, bound: int) -> float:
    return 1.0 if n <= bound else bound / n


def hash_fraction(*cols: str | Column, fraction: float) -> Column:
    """A repeatable sample: rows whose hash falls in the first ``fraction`` of the range."""
    if fraction >= 1.0:
        return F.lit(True)
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < F.lit(int(fraction * (1 << 30)))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is the fast way for texts that are ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


_ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def py_lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def chunks(batch: pa.RecordBatch, column: str, most_chars: int) -> Iterator[tuple[int, int, list[str]]]:
    """Slices (first row, end row, texts) of a batch with about ``most_chars`` characters; null texts come as ''."""
    col = batch.column(batch.schema.get_field_index(column))
    start, n = 0, batch.num_rows
    sizes = np.zeros(n, dtype=np.int64)
    if n:
        lengths = pa.compute.binary_length(col)
        sizes = np.nan_to_num(lengths.to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    while start < n:
        end, size = start + 1, int(sizes[start])
        while end < n and size + sizes[end] <= most_chars:
            size += int(sizes[end])
            end += 1
        yield start, end, [t or "" for t in col.slice(start, end - start).to_pylist()]
        start = end


def per_text(
    df: DataFrame, text_col: str, fn: Callable[[list[str], pa.RecordBatch], dict[str, list]], schema: str,
    keep: list[str], most_chars: int = 1 << 20,
) -> DataFrame:
    """Apply ``fn(texts, rows) -> new columns`` to slices of Arrow batches, beside the columns in ``keep``.

    Narrow: no shuffle, each task holds one batch and the arrays of one slice.
    """
    small_batches(df.sparkSession)
    src = df.select(*dict.fromkeys([*keep, text_col]))
    kept = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in keep)
    full = f"{kept}, {schema}" if kept else schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for start, end, texts in chunks(batch, text_col, most_chars):
                rows = batch.slice(start, end - start)
                new = fn(texts, rows)
                arrays = []
                for f in out_schema:
                    if f.name in new:
                        arrays.append(pa.array(new[f.name], type=f.type))
                    else:
                        arrays.append(rows.column(rows.schema.get_field_index(f.name)).cast(f.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    return src.mapInArrow(run, full)


# ---------------------------------------------------------------------------------------------------------------
# words and shingles as 64-bit hashes, whole texts at a time


def _byte_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(0x5EED)).integers(1, 1 << 63, 256, dtype=np.uint64)


_BYTES = _byte_table()
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(name: str, step: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 17), step, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text with A-Z lower-cased, and their byte starts and ends.

    A polynomial over random byte values, by a running sum and a division by powers (odd numbers have inverses mod
    2**64), so that no loop runs over words.
    """
    data = _FOLD[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _power("step", _STEP, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power("back", _BACK, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` words, by position."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(words) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix(h + np.uint64(n))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle; no words, none."""
    words, _, _ = word_hashes(text)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(n, len(words))))


# ---------------------------------------------------------------------------------------------------------------


def components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex of each: ``vertices(id)``, ``edges(a, b)`` -> ``(id, component_id)``.

    Alternating large-star and small-star steps on tables in the shared folder; only a count of changed rows reaches
    the driver.  Each step groups the neighbours of a vertex by a minimum, never by a list, so a hot vertex is
    pre-aggregated on the map side.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        e = cut(small, "edges")
        # done when the edges are stars: no vertex is a leaf of two centres, or a leaf and a centre
        ends = e.select("u", F.lit(1).alias("leaf")).unionByName(e.select(F.col("v").alias("u"), F.lit(0).alias("leaf")))
        if not ends.groupBy("u").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("c")).where("n > 1 or (n = 1 and c = 0)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return vertices.select("id").distinct().join(e.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select(
        "id", F.coalesce("c", "id").alias("component_id")
    )


def without(df: DataFrame, id_col: str, bad: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose id is not in the one column of ``bad``; null ids stay.  The ids are broadcast up to a
    checked number, beyond it the join is shuffled."""
    name = bad.columns[0]
    ids = cut(bad.select(F.col(name).alias("_bad")).where("_bad is not null").distinct(), "bad-ids")
    if ids.count() <= most_broadcast:
        ids = F.broadcast(ids)
    return df.join(ids, df[id_col] == F.col("_bad"), "left_anti")
