"""Repeated-line removal with DataFrame functions only.

Lines are exploded, normalised and hashed (two 64-bit hashes) once, into a table of hashes and positions; distinct
documents are counted per hash; the lines over the threshold are joined back by hash and dropped by position, except in
the largest document that holds them.  That join is salted by document, so that a line which very many documents hold
is spread over tasks.

Null and empty texts are one empty line and are never dropped.  A null id belongs to no document: such rows are
returned whole and count for nothing.  Rows that repeat an id count as one document; each row comes back.  Ties cannot
arise: the largest id is one value.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.llm.common import cut, lower_ascii, table

BLANKS = " \t\n\x0b\x0c\r"
SALTS = 16


def drop_repeated_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``id_col``, those in ``keep``, ``kept_text``, ``n_lines`` and ``n_dropped``, one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = cut(
        df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.posexplode(F.split(text_col, "\n")).alias("_pos", "_line"))
        .where(F.length("_line") >= min_chars)
        .withColumn("_key", lower_ascii(F.btrim("_line", F.lit(BLANKS))))
        .where(F.length("_key") >= min_chars)
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), "_key").alias("_h2")),
        "lines",
    )
    repeated = (
        lines.groupBy("_h1", "_h2")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_last"))
        .where(F.col("_n") >= min_docs)
        .select("_h1", "_h2", "_last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    dropped = (
        lines.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
        .join(repeated, ["_h1", "_h2", "_salt"])
        .where("_id <> _last")
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    src = df.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text_col).alias("_row"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep or [])],
    )
    # lines and the places that stay are bound once: inside the inner lambda each text would be split again for every line
    bound = F.transform(F.array(F.split("_text", "\n")), lambda parts: F.struct(parts.alias("parts"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone")).alias("rest")))
    rest = F.transform(bound, lambda b: F.array_join(F.transform(b["rest"], lambda i: F.get(b["parts"], i)), "\n"))
    return (
        src.join(dropped, ["_id", "_row"], "left")
        .select(
            F.col("_id").alias(id_col),
            *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep or [])],
            F.when(F.col("_gone").isNull(), F.col("_text"))
            .otherwise(F.get(rest, F.lit(0)))
            .alias("kept_text"),
            (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
            F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (h.key IS NOT NULL AND k.doc_id <> h.last) AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
