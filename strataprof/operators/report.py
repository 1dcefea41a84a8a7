"""Report tables over per-model measure tables (``model_id`` and figures) and ``paths(model_id, relpath)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataprof.functions import stats
from strataprof.operators.graph import cut


def with_path(df: DataFrame, paths: DataFrame) -> DataFrame:
    """Add ``relpath``; a model without one keeps its id."""
    return df.join(paths.select("model_id", "relpath"), "model_id", "left").withColumn("relpath", F.coalesce("relpath", "model_id"))


def top_models(df: DataFrame, by: str, paths: DataFrame | None = None, k: int = 10, ascending: bool = False, positive: bool = False) -> DataFrame:
    """``model_id, relpath, value``: first by a figure, ties by id."""
    src = df.where(F.col(by) > 0) if positive else df
    few = stats.top(src.select("model_id", F.col(by).alias("value")), "value", "model_id", k, ascending)
    return with_path(few, paths) if paths is not None else few


def size_time_scatter(per_model: DataFrame) -> DataFrame:
    return per_model.where("file_size_bytes_source > 0 and parse_time_ms > 0").select("model_id", F.col("file_size_bytes_source").alias("x"), F.col("parse_time_ms").alias("y"))


def time_with_size(times: DataFrame, sizes: DataFrame) -> DataFrame:
    """``model_id, x, y``: size and parse time of the models that are in both tables, both above 0."""
    return size_time_scatter(times.select("model_id", "parse_time_ms").join(sizes.select("model_id", "file_size_bytes_source"), "model_id"))


def mean_score(*scores: DataFrame) -> DataFrame:
    """Mean of one-row ``score`` frames; null unless all are there."""
    out = scores[0].select(F.col("score").alias("s0"))
    for i, s in enumerate(scores[1:], 1):
        out = out.crossJoin(F.broadcast(s.select(F.col("score").alias(f"s{i}"))))  # one row each
    return out.select((sum((F.col(f"s{i}") for i in range(1, len(scores))), F.col("s0")) / len(scores)).alias("dimension_score"))


def frequency_pareto(frequency: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Constructs by falling count with cumulative share, over those of some kinds."""
    src = frequency.where(F.col("kind").isin(kinds)) if kinds else frequency
    return stats.pareto(src.select("construct", "kind", "n"), "n", "construct")


def frequency_by_group(frequency: DataFrame) -> DataFrame:
    g = frequency.groupBy(F.coalesce("group", F.lit("—")).alias("group")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(stats.W.partitionBy())
    return g.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def model_matrix(grid: DataFrame) -> DataFrame:
    """``model_id, construct, n, share`` of the cells above 0, in long form."""
    return grid.where("n > 0").select("model_id", "construct", "n", "share")


def wide_matrix(grid: DataFrame, constructs: list[str], value: str = "n") -> DataFrame:
    """One column per construct of the list."""
    return grid.groupBy("model_id").pivot("construct", constructs).agg(F.first(value)).fillna(0)


def heatmap_page(grid: DataFrame, paths: DataFrame, offset: int, limit: int, top_constructs: int = 60) -> DataFrame:
    """Cells of a page of models (by path) and the constructs with most instances, with the largest cell."""
    totals = stats.top(grid.groupBy("construct").agg(F.sum("n").alias("total")), "total", "construct", top_constructs)
    page = with_path(grid.select("model_id").distinct(), paths).orderBy("relpath", "model_id").offset(offset).limit(limit)
    cells = grid.join(F.broadcast(page), "model_id").join(F.broadcast(totals), "construct")
    return cells.select("model_id", "relpath", "construct", "n", "share", F.max("n").over(stats.W.partitionBy()).alias("largest"))


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows in which the words of some columns, joined by blanks, hold ``text``, without regard to case."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def frequency_kpis(frequency: DataFrame) -> DataFrame:
    return frequency.agg(F.count_if(F.col("n") > 0).alias("active"), F.max("share").alias("top_share"))


def language_kpis(usage: DataFrame) -> DataFrame:
    known = F.col("language") != "unknown"
    return usage.agg(
        F.sum("n_models").alias("total"), F.count_if(known).alias("languages"), F.max_by("language", F.struct("n_models", "language")).alias("top"),
        F.coalesce(F.sum(F.when(~known, F.col("n_models"))), F.lit(0)).alias("unknown"),
    )


def long_histograms(df: DataFrame, columns: list[str], bins: int | None = None) -> DataFrame:
    """Histograms of several figures in one pass: ``measure, bin_idx, lo, hi, count``."""
    pairs: list[Column] = []
    for c in columns:
        pairs += [F.lit(c), F.col(c).cast("double")]
    long = df.select(F.explode(F.create_map(*pairs)).alias("measure", "v"))
    return stats.histogram(long, "v", ["measure"], bins)


def browse_catalog(known: DataFrame, text: str) -> DataFrame:
    """Constructs that hold a text, by group, kind and id."""
    found = known.select("group", "kind", F.col("id").alias("construct"), "description")
    return search(found, text, "group", "kind", "construct", "description").orderBy("group", "kind", "construct")


def as_long(family: str, measure: str, row: DataFrame) -> DataFrame:
    """A one-row frame of figures as ``family, measure, figure, value``."""
    cols = [f.name for f in row.schema.fields if f.dataType.typeName() not in ("string", "map", "array", "struct")]
    long = row.unpivot([], [F.col(f"`{c}`").cast("double").alias(c) for c in cols], "figure", "value")
    return long.select(F.lit(family).alias("family"), F.lit(measure).alias("measure"), "figure", "value")


def roll_up(models: DataFrame, families: dict[str, dict[str, DataFrame] | None]) -> DataFrame:
    """The number of models and the corpus measures of all families, in long form; a family that is switched off has
    one row with a null figure and value.

    Each measure is written, a few figures, before the next is worked out: so the disk holds the shuffles of one, not of all."""
    out = cut(as_long("corpus", "models", models.agg(F.count_distinct("model_id").alias("n_models"))))
    for family, measures in families.items():
        if measures is None:
            nothing = models.sparkSession.range(1).select(F.lit(family).alias("family"), *[F.lit(None).cast(t).alias(c) for c, t in (("measure", "string"), ("figure", "string"), ("value", "double"))])
            out = out.unionByName(nothing)
            continue
        for name, row in measures.items():
            out = out.unionByName(cut(as_long(family, name, row)))
    return out


def assemble(tables: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Report tables of all families as ``family, table, row``: each row of each table as JSON."""
    out = None
    for family, named in tables.items():
        for name, df in named.items():
            part = df.select(F.lit(family).alias("family"), F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
            out = part if out is None else out.unionByName(part)
    return out


def cuts(df: DataFrame, by: str, key: str, sizes: dict[str, int]) -> DataFrame:
    """``cut, key, by``: the first rows by a figure, as many as each view shows.  The largest cut is taken once."""
    most = stats.top(df.select(key, by), by, key, max(sizes.values()))
    ranked = most.withColumn("_rank", F.row_number().over(stats.W.orderBy(F.col(by).desc(), F.col(key))))  # a few dozen rows
    views = F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), F.lit(n).alias("n")) for k, n in sizes.items()])).alias("x")
    return ranked.select(key, by, "_rank", views).where("_rank <= x.n").select("x.cut", key, by)
