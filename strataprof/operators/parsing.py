"""Parse-quality measures over ``diagnostics``: one row per model with ``parse_status, elements_loaded, elements_skipped,
parse_time_ms, file_size_bytes_source, file_size_bytes_ir, warning_count, warnings_by_type map<string,bigint>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataprof.functions import stats


def parsed(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where("parse_status <> 'failure'")


def parse_status(diagnostics: DataFrame) -> DataFrame:
    n = F.count("*")
    ok, part, bad = (F.count_if(F.col("parse_status") == s) for s in ("success", "warning", "failure"))
    index = F.coalesce((ok + 0.5 * part) / n, F.lit(0.0))
    return diagnostics.agg(
        n.alias("n_models"), ok.alias("n_success"), part.alias("n_partial"), bad.alias("n_failed"),
        *[F.coalesce(x / n, F.lit(0.0)).alias(f"share_{s}") for x, s in ((ok, "success"), (part, "partial"), (bad, "failed"))],
        index.alias("robustness_index"), stats.score(index).alias("score"),
    )


def element_loading(diagnostics: DataFrame) -> DataFrame:
    """Corpus ratio over all elements, and the spread of the models' ratios."""
    d = parsed(diagnostics).withColumn("r", stats.skip_ratio(F.col("elements_loaded"), F.col("elements_skipped")))
    loaded, skipped = F.coalesce(F.sum("elements_loaded"), F.lit(0)), F.coalesce(F.sum("elements_skipped"), F.lit(0))
    corpus = stats.skip_ratio(loaded, skipped)
    with_skips = F.count_if(F.col("elements_skipped") > 0)
    return d.agg(
        loaded.alias("total_loaded"), skipped.alias("total_skipped"), corpus.alias("skip_ratio"), *stats.summary("r", "ratio"),
        with_skips.alias("models_with_skips"), stats.ratio(with_skips, F.count("*")).alias("share_with_skips"), stats.score(1 - corpus).alias("score"),
    )


def parse_time(diagnostics: DataFrame) -> DataFrame:
    return parsed(diagnostics).agg(*stats.summary("parse_time_ms", "ms"), F.coalesce(F.sum("parse_time_ms"), F.lit(0)).alias("total_ms"))


def file_size(diagnostics: DataFrame) -> DataFrame:
    return parsed(diagnostics).agg(*stats.summary("file_size_bytes_source", "source"), *stats.summary("file_size_bytes_ir", "ir"))


def warnings(diagnostics: DataFrame) -> DataFrame:
    d = parsed(diagnostics).withColumn("density", stats.warnings_per_element(F.col("warning_count"), F.col("elements_loaded")))
    warned = F.count_if(F.col("warning_count") > 0)
    share = stats.ratio(warned, F.count("*"))
    return d.agg(
        warned.alias("models_with_warnings"), share.alias("share_with_warnings"), *stats.summary("warning_count", "count"),
        *stats.summary("density", "density"), F.when(F.count("*") > 0, stats.score(1 - share)).otherwise(0.0).alias("score"),
    )


def warnings_by_type(diagnostics: DataFrame) -> DataFrame:
    d = parsed(diagnostics)
    n = d.agg(F.count("*").alias("_n"))
    by = d.select(F.explode("warnings_by_type").alias("warning_type", "c")).groupBy("warning_type").agg(F.sum("c").alias("total"), F.count_if(F.col("c") > 0).alias("n_models"))
    return by.crossJoin(F.broadcast(n)).select("warning_type", "total", "n_models", (F.col("n_models") / F.col("_n")).alias("share_models"))


def per_model(diagnostics: DataFrame) -> DataFrame:
    return parsed(diagnostics).select(
        "model_id", "parse_status", "elements_loaded", "elements_skipped", stats.skip_ratio(F.col("elements_loaded"), F.col("elements_skipped")).alias("skip_ratio"),
        "parse_time_ms", "file_size_bytes_source", "file_size_bytes_ir", "warning_count", "warnings_by_type",
        stats.warnings_per_element(F.col("warning_count"), F.col("elements_loaded")).alias("warnings_per_element"),
    )


def all_measures(diagnostics: DataFrame) -> dict[str, DataFrame]:
    """The five corpus measures; ``diagnostics`` should be persisted by the caller if it is dear."""
    return {
        "parse_status": parse_status(diagnostics), "element_loading": element_loading(diagnostics), "parse_time": parse_time(diagnostics),
        "file_size": file_size(diagnostics), "warnings": warnings(diagnostics), "warnings_by_type": warnings_by_type(diagnostics),
    }


def assemble(models: DataFrame, elements: DataFrame, warnings: DataFrame) -> DataFrame:
    """Diagnostics from counts: ``elements(model_id, loaded)`` and ``warnings(model_id, warning_type, is_skip)``.

    Every skip is a warning.  No warning: success, even if empty; else warning if anything was loaded, else failure."""
    by_type = warnings.groupBy("model_id", "warning_type").agg(F.count("*").alias("c"), F.count_if("is_skip").alias("s"))
    found = by_type.groupBy("model_id").agg(
        F.sum("c").alias("warning_count"), F.sum("s").alias("elements_skipped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("warning_type", "c")))).alias("warnings_by_type"),
    )
    out = models.join(elements, "model_id", "left").join(found, "model_id", "left").fillna(0, ["loaded", "warning_count", "elements_skipped"])
    status = F.when(F.col("warning_count") == 0, "success").when(F.col("loaded") > 0, "warning").otherwise("failure")
    return out.select(
        "model_id", status.alias("parse_status"), F.when(status == "failure", "No elements loaded").alias("parse_error_msg"),
        F.col("loaded").alias("elements_loaded"), "elements_skipped", "warning_count",
        F.coalesce("warnings_by_type", F.create_map().cast("map<string,bigint>")).alias("warnings_by_type"),
    )


def parse_totals(candidates: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``candidates_in, success, warning, failure`` in one row.  A candidate without diagnostics (it was listed, but no
    longer there) is a failure."""
    found = candidates.select("model_id").join(diagnostics.select("model_id", "parse_status"), "model_id", "left")
    status = F.coalesce("parse_status", F.lit("failure"))
    return found.agg(F.count("*").alias("candidates_in"), *[F.count_if(status == s).alias(s) for s in ("success", "warning", "failure")])
