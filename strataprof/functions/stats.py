"""Summaries, entropies and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def summary(col: Column | str, prefix: str) -> list[Column]:
    """n, min, p25, median, mean, p75, max and sample deviation as aggregate columns; zeros where nothing is there.

    ``percentile`` interpolates linearly; it keeps a count per distinct value, so feed it per-model figures."""
    c = F.col(col) if isinstance(col, str) else col
    v = c.cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    zero = F.lit(0.0)
    return [
        F.count(v).alias(f"{prefix}_n"),
        F.coalesce(F.min(v), zero).alias(f"{prefix}_min"),
        F.coalesce(q[0], zero).alias(f"{prefix}_p25"),
        F.coalesce(q[1], zero).alias(f"{prefix}_median"),
        F.coalesce(F.avg(v), zero).alias(f"{prefix}_mean"),
        F.coalesce(q[2], zero).alias(f"{prefix}_p75"),
        F.coalesce(F.max(v), zero).alias(f"{prefix}_max"),
        F.coalesce(F.stddev_samp(v), zero).alias(f"{prefix}_std"),
    ]


def exact_percentiles(df: DataFrame, columns: list[str], percentages: list[float], most_values: int = 100_000, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of columns of any length, those of ``percentile``, without a count per value.

    Each wanted rank is held between two bounds.  A round takes two narrow passes over the data for all columns and ranks
    together: an approximate sketch of what is between the bounds gives two values close to the rank, and counts of what
    is below, at, between and above them give the next bounds, whatever the sketch got wrong.  So a round leaves about
    2 / ``accuracy`` of the values, values tied with a bound are counted and not kept, and once at most ``most_values``
    distinct ones are left they are counted one by one.  Nulls are left out, NaN is the largest value."""
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    total = src.agg(*[F.count(c).alias(c) for c in src.columns]).first()
    open_: dict[tuple[int, int], tuple] = {}  # (column, rank): low, high, values up to low, values between
    for i, n in enumerate(total):
        for p in percentages if n else []:
            lo = int(p * (n - 1))
            for rank in {lo, min(lo + 1, n - 1)}:
                open_[i, rank] = (None, None, 0, n)
    found: dict[tuple[int, int], float] = {}

    def between(i: int, low: float | None, high: float | None) -> Column:
        v = F.col(f"v{i}")
        inside = v.isNotNull() if low is None else v > F.lit(low)
        return inside if high is None else inside & (v < F.lit(high))

    while open_:
        few = sorted({(k[0], *x) for k, x in open_.items() if x[3] <= most_values}, key=str)
        if few:
            each = F.array(*[F.when(between(i, low, high), F.struct(F.lit(j).alias("j"), F.col(f"v{i}").alias("v"))) for j, (i, low, high, _, _) in enumerate(few)])
            counts = src.select(F.explode(each).alias("x")).where("x is not null").groupBy("x.j", "x.v").agg(F.count("*").alias("n")).orderBy("j", "v").collect()
            for key in [k for k, x in open_.items() if (k[0], *x) in few]:
                j, seen = few.index((key[0], *open_[key])), open_[key][2]
                for row in counts:
                    if row["j"] == j:
                        seen += row["n"]
                        if key[1] < seen:
                            found[key] = row["v"]
                            break
                del open_[key]
        keys = sorted(open_)
        if not keys:
            break
        near = []
        for i, rank in keys:
            low, high, before, n = open_[i, rank]
            at = (rank - before + 0.5) / n
            q = [max(0.0, at - 1 / accuracy), min(1.0, at + 1 / accuracy)]
            near.append(F.percentile_approx(F.when(between(i, low, high), F.col(f"v{i}")), q, accuracy))
        bounds = list(src.agg(*[c.alias(f"b{k}") for k, c in enumerate(near)]).first())
        counted = []
        for (i, rank), (a, b) in zip(keys, bounds):
            inside, v = between(i, *open_[i, rank][:2]), F.col(f"v{i}")
            counted += [F.count_if(inside & (v < F.lit(a))), F.count_if(inside & (v == F.lit(a))), F.count_if(inside & (v > F.lit(a)) & (v < F.lit(b))), F.count_if(inside & (v == F.lit(b)) & (v > F.lit(a)))]
        sums = list(src.agg(*[c.alias(f"c{k}") for k, c in enumerate(counted)]).first())
        for k, (key, (a, b)) in enumerate(zip(keys, bounds)):
            low, high, before, n = open_.pop(key)
            under, at_a, mid, at_b = sums[4 * k : 4 * k + 4]
            rank = key[1] - before
            if rank < under:
                open_[key] = (low, a, before, under)
            elif rank < under + at_a:
                found[key] = a
            elif rank < under + at_a + mid:
                open_[key] = (a, b, before + under + at_a, mid)
            elif rank < under + at_a + mid + at_b:
                found[key] = b
            else:
                passed = under + at_a + mid + at_b
                open_[key] = (b, high, before + passed, n - passed)
    out: dict[str, list[float | None]] = {}
    for i, (c, n) in enumerate(zip(columns, total)):
        out[c] = []
        for p in percentages:
            if not n:
                out[c].append(None)
                continue
            at = p * (n - 1)
            lo = int(at)
            x, y = found[i, lo], found[i, min(lo + 1, n - 1)]
            out[c].append(x if x == y or at == lo else (lo + 1 - at) * x + (at - lo) * y)
    return out


def large_summary(df: DataFrame, columns: dict[str, str], **options) -> DataFrame:
    """The columns of ``summary`` for each ``{column: prefix}``, in one row, for tables of any length."""
    q = exact_percentiles(df, list(columns), [0.25, 0.5, 0.75], **options)
    parts = []
    for c, prefix in columns.items():
        v = F.col(f"`{c}`").cast("double")
        known = [F.lit(x if x is not None else 0.0).alias(f"{prefix}_{name}") for name, x in zip(("p25", "median", "p75"), q[c])]
        zero = F.lit(0.0)
        parts += [
            F.count(v).alias(f"{prefix}_n"), F.coalesce(F.min(v), zero).alias(f"{prefix}_min"), known[0], known[1], F.coalesce(F.avg(v), zero).alias(f"{prefix}_mean"),
            known[2], F.coalesce(F.max(v), zero).alias(f"{prefix}_max"), F.coalesce(F.stddev_samp(v), zero).alias(f"{prefix}_std"),
        ]
    return df.agg(*parts)


def score(col: Column) -> Column:
    """Clamped to 0..1, times 100."""
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0)) * 100.0


def ratio(a: Column, b: Column) -> Column:
    """``a / max(1, b)``."""
    return a / F.greatest(b, F.lit(1))


def skip_ratio(loaded: Column, skipped: Column) -> Column:
    return ratio(skipped, loaded + skipped)


def warnings_per_element(warnings: Column, loaded: Column) -> Column:
    return ratio(warnings, loaded)


def entropy(share: Column) -> Column:
    """Shannon entropy in bits, an aggregate over the shares of a group."""
    return F.abs(F.coalesce(F.sum(F.when(share > 0, -share * F.log2(share))), F.lit(0.0)))


def utilisation_entropy(share: Column) -> Column:
    """Entropy over its largest value, ln k for k shares above 0; 0 for fewer than two."""
    k = F.count(F.when(share > 0, 1))
    return F.when(k <= 1, 0.0).otherwise(F.abs(F.sum(F.when(share > 0, -share * F.log(share)))) / F.log(k))


def histogram(df: DataFrame, col: str, by: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """``by..., bin_idx, lo, hi, count`` over finite values; empty bins are kept, the last one is closed.

    Bounds come from one aggregate that is joined back; without ``bins`` there are min(20, ceil(sqrt(n))).
    """
    by = by or []
    v = F.col(col).cast("double")
    src = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    n = F.count("*")
    wanted = F.lit(bins) if bins and bins > 0 else F.least(F.lit(20), F.ceil(F.sqrt(n)).cast("int"))
    bounds = src.groupBy(*by).agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), wanted.alias("_b"), n.alias("_n")).where("_n > 0")
    bounds = bounds.withColumn("_b", F.when(F.col("_mn") == F.col("_mx"), 1).otherwise(F.col("_b"))).withColumn("_w", (F.col("_mx") - F.col("_mn")) / F.col("_b"))
    placed = (src.join(bounds, by) if by else src.crossJoin(F.broadcast(bounds))).withColumn(
        "bin_idx", F.when(F.col("_w") <= 0, 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_mn")) / F.col("_w")).cast("int"), F.col("_b") - 1))
    )
    counted = placed.groupBy(*by, "bin_idx").agg(F.count("*").alias("count"))
    grid = bounds.select(*by, "_mn", "_mx", "_w", "_b", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("bin_idx"))
    return grid.join(counted, [*by, "bin_idx"], "left").select(
        *by, "bin_idx", (F.col("_mn") + F.col("bin_idx") * F.col("_w")).alias("lo"),
        F.when(F.col("bin_idx") == F.col("_b") - 1, F.col("_mx")).otherwise(F.col("_mn") + (F.col("bin_idx") + 1) * F.col("_w")).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def bin_labels(bins: DataFrame, by: list[str] | None = None, percent: bool = False) -> DataFrame:
    """Bins of ``histogram`` with ``bin``, their text: ``lo-hi`` with one decimal more than the order of magnitude of the
    width, the value alone where all values are one; ``%`` for shares."""
    lo, hi = F.col("lo"), F.col("hi")
    width = F.max(hi - lo).over(W.partitionBy(*(by or [F.lit(1)])))
    places = F.greatest(F.lit(0), 1 - F.floor(F.log10(width))).cast("int")
    ends = [F.format_string("%s", F.expr(f"format_number({c}, concat(if(_places = 0, '0', concat('0.', repeat('0', _places)))))")) for c in ("lo", "hi")]
    one = F.when(lo == F.floor(lo), lo.cast("decimal(38,0)").cast("string")).otherwise(lo.cast("string"))
    text = F.when(lo == hi, one).otherwise(F.concat_ws("-", *ends))
    return bins.withColumn("_places", F.when(width > 0, places).otherwise(0)).withColumn("bin", F.concat(text, F.lit("%")) if percent else text).drop("_places")


def share_histogram(df: DataFrame, col: str, by: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """The same over shares clamped to 0..1, in percent."""
    return histogram(df.withColumn(col, F.least(F.greatest(F.col(col).cast("double"), F.lit(0.0)), F.lit(1.0)) * 100.0), col, by, bins)


def top(df: DataFrame, by: str | Column, key: str, k: int, ascending: bool = False) -> DataFrame:
    """The first ``k`` rows by a figure, ties by ``key``."""
    c = F.col(by) if isinstance(by, str) else by
    return df.orderBy(c.asc() if ascending else c.desc(), F.col(key)).limit(k)


def top_per(df: DataFrame, group: list[str], by: str, key: str, k: int) -> DataFrame:
    w = W.partitionBy(*group).orderBy(F.col(by).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pareto(df: DataFrame, by: str, key: str) -> DataFrame:
    """``rank, share, cumulative_share``: rows by falling count.  For small tables, such as a construct catalog: the
    running sum needs one ordering of all rows."""
    w = W.orderBy(F.col(by).desc(), F.col(key))
    total = F.sum(by).over(W.partitionBy())
    share = F.when(total > 0, F.col(by) / total).otherwise(0.0)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("share", share)
    return out.withColumn("cumulative_share", F.sum("share").over(w.rowsBetween(W.unboundedPreceding, 0)))


def top_and_other(df: DataFrame, key: str, by: str, k: int, other: str = "other") -> DataFrame:
    """The first ``k`` keys by a figure, and the sum of all others: the k keys are found first and broadcast."""
    few = top(df.groupBy(key).agg(F.sum(by).alias("_by")), "_by", key, k).select(F.col(key).alias("_key"))
    named = df.join(F.broadcast(few), F.col(key) == F.col("_key"), "left")
    return named.select(F.coalesce("_key", F.lit(other)).alias(key), F.col(by)).groupBy(key).agg(F.sum(by).alias(by))
