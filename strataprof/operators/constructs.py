"""Construct coverage: elements of models against a catalog of constructs.

``elements(model_id, element_id, side, type, data map<string,string>)`` with side node or edge;
``catalog(id, kind, match_type, description, match_data_equals map<string,string>, meta map<string,string>)``.  The
catalog is a dimension of at most some hundred rows a language and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataprof.functions import stats

EDGE_KINDS = ("edge_type", "edge_data")


def known(catalog: DataFrame) -> DataFrame:
    """The catalog without its rows for unknown constructs, with the side that each matches and its group."""
    group = F.coalesce(*[F.when(F.col("meta")[k] != "", F.col("meta")[k]) for k in ("layer", "group", "category", "kind")], F.lit("—"))
    side = F.when(F.col("kind").startswith("edge"), "edge").otherwise("node")
    return catalog.where(~F.col("id").startswith("UNKNOWN")).withColumn("side", side).withColumn("group", group)


def projection(catalog: DataFrame) -> DataFrame:
    """``id, description, kind, match_type, group, meta`` of the constructs; without ``meta`` it is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return known(catalog).select("id", "description", "kind", "match_type", "group", F.coalesce("meta", empty).alias("meta"))


def _fits(c: DataFrame) -> Column:
    return F.coalesce(F.forall(F.map_entries(c["match_data_equals"]), lambda e: F.element_at(F.col("data"), e.key).eqNullSafe(e.value)), F.lit(True))


def match(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    """``model_id, element_id, side, type, construct``: an element may match several constructs."""
    c = F.broadcast(known(catalog).select("id", F.col("side").alias("_side"), "match_type", "match_data_equals"))
    on = (elements["type"] == c["match_type"]) & (elements["side"] == c["_side"]) & _fits(c)
    return elements.join(c, on).select("model_id", "element_id", "side", "type", F.col("id").alias("construct"))


def unmatched(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    c = F.broadcast(known(catalog).select(F.col("side").alias("_side"), "match_type", "match_data_equals"))
    return elements.join(c, (elements["type"] == c["match_type"]) & (elements["side"] == c["_side"]) & _fits(c), "left_anti")


def counts(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    return match(elements, catalog).groupBy("model_id", "construct").agg(F.count("*").alias("n"))


def grid(elements: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    """``model_id, construct, n, share``: every model with every construct, zero filled.

    The pairing is with a broadcast catalog: its rows, and no others, multiply those of the models."""
    cells = models.select("model_id").crossJoin(F.broadcast(known(catalog).select(F.col("id").alias("construct"))))
    filled = cells.join(counts(elements, catalog), ["model_id", "construct"], "left").fillna(0, ["n"])
    return filled.withColumn("share", stats.ratio(F.col("n"), F.sum("n").over(W.partitionBy("model_id"))))


def unknown_types(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    """``model_id, side, type, n``."""
    return unmatched(elements, catalog).groupBy("model_id", "side", "type").agg(F.count("*").alias("n"))


def _merged(unknown: DataFrame, keys: list[str]) -> DataFrame:
    """A name that is unknown on both sides counts by its edges in each model."""
    pick = F.coalesce(F.max(F.when(F.col("side") == "edge", F.col("n"))), F.max("n")).alias("n")
    per = unknown.groupBy("model_id", "type").agg(pick)
    return per if "model_id" in keys else per.groupBy("type").agg(F.sum("n").alias("n"))


def top_unknown_per_model(unknown: DataFrame, k: int = 10) -> DataFrame:
    return stats.top_per(_merged(unknown, ["model_id", "type"]), ["model_id"], "n", "type", k)


def top_unknown(unknown: DataFrame, k: int = 25) -> DataFrame:
    return stats.top(_merged(unknown, ["type"]), "n", "type", k)


def presence_per_model(elements: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    seen = counts(elements, catalog).groupBy("model_id").agg(F.count("*").alias("observed"))
    unknown = unmatched(elements, catalog).groupBy("model_id").agg(F.count_if(F.col("side") == "node").alias("unknown_nodes"), F.count_if(F.col("side") == "edge").alias("unknown_edges"))
    size = elements.groupBy("model_id").agg(F.count("*").alias("elements"))
    available = known(catalog).agg(F.count("*").alias("available"))
    out = models.select("model_id").join(size, "model_id", "left").join(seen, "model_id", "left").join(unknown, "model_id", "left").fillna(0).crossJoin(F.broadcast(available))
    return out.select(
        "model_id", "available", "observed", stats.ratio(F.col("observed"), F.col("available")).alias("coverage"), "unknown_nodes", "unknown_edges",
        "elements", stats.ratio(F.col("unknown_nodes") + F.col("unknown_edges"), F.col("elements")).alias("unknown_share"),
    )


def measures(elements: DataFrame, models: DataFrame, catalog: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Corpus measures and per-model figures.  With an empty catalog the measures are zero and there are no per-model
    rows."""
    per_model = presence_per_model(elements, models, catalog).join(frequency_per_model(elements, models, catalog), "model_id", "left")
    corpus = {"presence": presence(elements, models, catalog), "frequency": frequency(elements, catalog)}
    if known(catalog).isEmpty():
        return {k: v.select(*[F.lit(0).cast(f.dataType).alias(f.name) for f in v.schema.fields]).limit(1) for k, v in corpus.items()}, per_model.limit(0)
    return corpus, per_model


def presence(elements: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    p = presence_per_model(elements, models, catalog)
    corpus = p.agg(
        F.sum("unknown_nodes").alias("unknown_nodes"), F.sum("unknown_edges").alias("unknown_edges"), F.sum("elements").alias("_e"),
        *stats.summary("coverage", "coverage"),
    )
    observed = corpus_frequency(elements, catalog).agg(F.count("*").alias("available"), F.count_if(F.col("n") > 0).alias("observed"))
    cover = stats.ratio(F.col("observed"), F.col("available"))
    unknown = stats.ratio(F.col("unknown_nodes") + F.col("unknown_edges"), F.col("_e"))
    return observed.crossJoin(F.broadcast(corpus)).select(
        "available", "observed", cover.alias("coverage"), unknown.alias("unknown_share"), stats.score(cover * (1 - unknown)).alias("score"),
        *[c for c in corpus.columns if c != "_e"],
    )


def corpus_frequency(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    """``construct, group, kind, description, n, share`` for the whole catalog."""
    c = known(catalog).select(F.col("id").alias("construct"), "group", "kind", "description")
    n = match(elements, catalog).groupBy("construct").agg(F.count("*").alias("n"))
    out = c.join(n, "construct", "left").fillna(0, ["n"])
    total = F.sum("n").over(W.partitionBy())  # one row per construct of the catalog
    return out.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def missing(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    return corpus_frequency(elements, catalog).where("n = 0").select("group", "construct", "description", "kind").orderBy("group", "construct")


def coverage_by(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    """Coverage by group and by kind in one pass: ``dimension, value, available, observed, missing, coverage``."""
    f = corpus_frequency(elements, catalog)
    both = f.groupingSets([["group"], ["kind"]], "group", "kind").agg(F.grouping("group").alias("_g"), F.count("*").alias("available"), F.count_if(F.col("n") > 0).alias("observed"))
    return both.select(
        F.when(F.col("_g") == 0, "group").otherwise("kind").alias("dimension"), F.when(F.col("_g") == 0, F.col("group")).otherwise(F.col("kind")).alias("value"),
        "available", "observed", (F.col("available") - F.col("observed")).alias("missing"), stats.ratio(F.col("observed"), F.col("available")).alias("coverage"),
    )


def frequency_per_model(elements: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    g = grid(elements, models, catalog)
    return g.groupBy("model_id").agg(F.sum("n").alias("instances"), stats.utilisation_entropy(F.col("share")).alias("utilisation_entropy"))


def frequency(elements: DataFrame, catalog: DataFrame) -> DataFrame:
    h = stats.utilisation_entropy(F.col("share"))
    return corpus_frequency(elements, catalog).agg(F.sum("n").alias("instances"), h.alias("utilisation_entropy"), stats.score(h).alias("score"))


def dimension_score(elements: DataFrame, models: DataFrame, catalog: DataFrame) -> DataFrame:
    a = presence(elements, models, catalog).select(F.col("score").alias("presence_score"))
    b = frequency(elements, catalog).select(F.col("score").alias("frequency_score"))
    s = (F.col("presence_score") + F.col("frequency_score")) / 2
    return a.crossJoin(F.broadcast(b)).withColumn("score", F.least(F.greatest(s, F.lit(0.0)), F.lit(100.0)))
