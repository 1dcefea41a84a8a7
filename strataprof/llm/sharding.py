"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

Each partition of the input is permuted where it is.  A communication matrix says how many of its rows go to each shard:
rows sum to the sizes of the partitions, columns to the sizes of the shards, and its entries are drawn as a uniform
permutation of all rows would have them, by hypergeometric variates without return.  The first rows of a permuted
partition go to the first shard and so on; each shard is permuted again after the exchange.  So that no task holds a
whole shard, shards are cut into bins of at most ``bin_rows`` rows by a second matrix of the same kind, and a bin is what
one task permutes: the slot of a row is the start of its bin and its place there.

The matrix is drawn down a tree of partitions, 64 to a node: a node deals its totals out to its children, all nodes of a
level side by side.  Permuted partitions are a table before the matrix is drawn, with the place of each row in it, so
that a task that runs again cannot change what was counted.  Nothing is grouped by a key of the data: equal ids or texts
are as many rows as they are, wherever they stand, and a group of copies cannot make a task large.

Null texts have no bytes: size 1 and checksum 0.  Null ids are carried; rows that repeat an id or are equal in full are
rows of their own.  Ties of the random order are broken by partition and place.  Fewer rows than shards leave the last
shards empty.  An empty table gives an empty result; other columns are ignored.  With the same seed, the same input in
the same partitions and order gives the same shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataprof.llm.common import cut, table

FAN_OUT = 64
PLACE_BITS = 33  # of monotonically_increasing_id, below the partition


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows, taken without return from ``total`` of which ``good`` are of a kind, are of that kind.

    By inversion: weights follow from their neighbours by a ratio, so they need no factorials; beyond nine standard
    deviations and twenty they are below what a double can tell.  ``u`` is uniform in [0, 1).
    """
    share = good / F.greatest(total, F.lit(1))
    mean = draws * share
    deviation = F.sqrt(F.greatest(mean * (1 - share) * (total - draws) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    reach = F.ceil(deviation * 9) + 20
    centre = F.floor(mean)
    first = F.greatest(F.lit(0).cast("long"), draws + good - total, centre - reach)
    last = F.least(draws, good, centre + reach)

    def ratio(k: Column) -> Column:
        return (good - k).cast("double") * (draws - k) / ((k + 1).cast("double") * (total - good - draws + k + 1))

    def inverted(bounds: Column) -> Column:
        steps = F.sequence(bounds["first"], bounds["last"])
        weight = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s")),
            lambda z, k: F.struct((z["p"] * ratio(k)).alias("p"), (z["s"] + z["p"]).alias("s")), lambda z: z["s"],
        )
        return _let(
            weight * u,
            lambda goal: F.least(bounds["last"], F.aggregate(
                steps, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"), bounds["first"].alias("x")),
                lambda z, k: F.struct(
                    (z["p"] * ratio(k)).alias("p"), (z["s"] + z["p"]).alias("s"), F.when(z["s"] + z["p"] <= goal, k + 1).otherwise(z["x"]).alias("x")
                ),
                lambda z: z["x"],
            )),
        )

    return _let(F.struct(first.alias("first"), last.alias("last")), inverted)


def deal(caps: Column, counts: Column, seed: int, *keys: Column) -> Column:
    """For each of ``counts`` (array<bigint>) how many of its rows go to each of ``caps`` (array<bigint>, equal in sum)."""

    def to_columns(left: Column, n: Column, i: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(left) - 1),
            F.struct(n.alias("n"), F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array().cast("array<bigint>").alias("out")),
            lambda z, j: _let(
                hypergeometric(z["total"], F.get(left, j), z["n"], uniform(seed, *keys, i, j)),
                lambda x: F.struct((z["n"] - x).alias("n"), (z["total"] - F.get(left, j)).alias("total"), F.array_append(z["out"], x).alias("out")),
            ),
            lambda z: z["out"],
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.size(counts) - 1),
        F.struct(caps.alias("left"), F.array().cast("array<array<bigint>>").alias("rows")),
        lambda z, i: _let(
            to_columns(z["left"], F.get(counts, i), i),
            lambda row: F.struct(F.zip_with(z["left"], row, lambda c, x: c - x).alias("left"), F.array_append(z["rows"], row).alias("rows")),
        ),
        lambda z: z["rows"],
    )


def communication_matrix(counts: DataFrame, caps: DataFrame, most_part: int, seed: int) -> DataFrame:
    """``counts(group, part, n)`` and ``caps(group, caps array)`` of the same sums -> ``(group, part, row array)``.

    ``most_part``: the largest part.  Groups are independent of each other.
    """
    levels = 1
    while FAN_OUT**levels <= most_part:
        levels += 1
    out = caps.select("group", F.lit(0).cast("long").alias("node"), F.col("caps").alias("row"))
    for level in reversed(range(levels)):
        of_child = F.floor(F.col("part") / FAN_OUT**level)
        children = (
            counts.groupBy("group", of_child.alias("child")).agg(F.sum("n").alias("n"))
            .groupBy("group", F.floor(F.col("child") / FAN_OUT).alias("node"))
            .agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children"))
        )
        dealt = deal(F.col("row"), F.col("children.n"), seed, F.lit(level), F.col("group"), F.col("node"))
        out = out.join(children, ["group", "node"]).select(
            "group", F.explode(F.arrays_zip(F.col("children.child").alias("child"), dealt.alias("row"))).alias("x")
        ).select("group", F.col("x.child").alias("node"), F.col("x.row").alias("row"))
    return out.select("group", F.col("node").alias("part"), "row")


def _even(total: Column, parts: Column) -> Column:
    """Sizes of ``parts`` parts of ``total`` rows, at most one apart."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.floor(total / parts).cast("long") + (i < total % parts).cast("long"))


def _ends(row: Column) -> Column:
    return F.aggregate(
        row, F.array().cast("array<bigint>"), lambda out, x: F.array_append(out, x + F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0).cast("long")))
    )


def _cell(ends: Column, place: Column) -> Column:
    return F.size(F.filter(ends, lambda e: e <= place))


def shuffle_into_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 20, bin_rows: int = 1_000_000
) -> DataFrame:
    """``id_col, size, text_crc32, shard, slot`` for each row, in a uniformly random order: ``slot`` counts from 0 in each
    shard, whose numbers of rows are at most one apart."""
    text = F.col(text_col)
    permuted = cut(
        df.select(
            F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("crc"), F.rand(seed).alias("random"),
        ).sortWithinPartitions("random").select("id", "size", "crc", F.monotonically_increasing_id().alias("at")),
        "permuted-rows",
    ).select("id", "size", "crc", F.shiftright("at", PLACE_BITS).alias("part"), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).alias("place"))
    counts = cut(permuted.groupBy("part").agg(F.count("*").alias("n")), "partition-sizes")
    n, most_part = counts.agg(F.sum("n"), F.max("part")).first()
    n = n or 0
    bins = max(1, -(-n // (shards * bin_rows)))  # of each shard
    spark = df.sparkSession
    sizes = spark.range(1).select(_even(F.lit(n), F.lit(shards)).alias("caps"))
    to_shards = cut(
        communication_matrix(counts.select(F.lit(0).cast("long").alias("group"), "part", "n"), sizes.select(F.lit(0).cast("long").alias("group"), "caps"), most_part or 0, seed),
        "partitions-to-shards",
    )
    in_shards = to_shards.select("part", F.posexplode("row").alias("group", "n")).where("n > 0").withColumn("group", F.col("group").cast("long"))
    of_bins = sizes.select(F.posexplode("caps").alias("group", "size")).select(F.col("group").cast("long").alias("group"), _even(F.col("size"), F.lit(bins)).alias("caps"))
    to_bins = cut(communication_matrix(in_shards, of_bins, most_part or 0, seed + 1), "partitions-to-bins")

    before = F.when(F.col("shard") > 0, F.get("ends", F.col("shard") - 1)).otherwise(F.lit(0).cast("long"))
    placed = (
        permuted.join(to_shards.select("part", _ends(F.col("row")).alias("ends")), "part")
        .withColumn("shard", _cell(F.col("ends"), F.col("place")))
        .select("id", "size", "crc", "part", "shard", "place", (F.col("place") - before).alias("offset"))
        .join(to_bins.select("part", F.col("group").cast("int").alias("shard"), _ends(F.col("row")).alias("ends")), ["part", "shard"])
        .select("id", "size", "crc", "part", "place", "shard", _cell(F.col("ends"), F.col("offset")).alias("bin"))
    )
    of_shard = F.lit(n // shards).cast("long") + (F.col("shard") < n % shards).cast("long")
    start = F.col("bin") * F.floor(of_shard / bins) + F.least(F.col("bin").cast("long"), of_shard % bins)
    again = Window.partitionBy("shard", "bin").orderBy(F.xxhash64(F.lit(seed + 2), "part", "place"), "part", "place")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"),
        (start + F.row_number().over(again) - 1).cast("long").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shuffle_into_shards(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
