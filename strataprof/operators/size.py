"""Size and complexity measures over ``models(model_id, language)``, ``nodes`` and ``edges``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataprof.functions import stats
from strataprof.operators import graph


def size_per_model(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("model_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("model_id").agg(F.count("*").alias("edges"))
    out = models.select("model_id").join(n, "model_id", "left").join(e, "model_id", "left").fillna(0)
    return out.withColumn("elements", F.col("nodes") + F.col("edges")).withColumn("edges_per_node", stats.ratio(F.col("edges"), F.col("nodes")))


def size(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = size_per_model(models, nodes, edges)
    cols = ("nodes", "edges", "elements", "edges_per_node")
    return p.agg(*[F.sum(c).alias(f"total_{c}") for c in cols[:3]], *[x for c in cols for x in stats.summary(c, c)])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``model_id, node_id, in_degree, out_degree, degree``; a dangling edge counts at the end that exists."""
    out_end = edges.select("model_id", F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    in_end = edges.select("model_id", F.col("target_id").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = out_end.unionByName(in_end).groupBy("model_id", "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    got = nodes.select("model_id", "node_id").distinct().join(ends, ["model_id", "node_id"], "left").fillna(0)
    return got.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_per_model(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = degrees(nodes, edges).groupBy("model_id").agg(
        F.avg("degree").alias("degree_mean"), F.avg("in_degree").alias("in_mean"), F.avg("out_degree").alias("out_mean"), F.median("degree").alias("degree_median"), F.max("degree").alias("degree_max"),
    )
    return models.select("model_id").join(p, "model_id", "left").fillna(0)


def degree(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degree_per_model(models, nodes, edges).agg(*[x for c in ("degree_mean", "in_mean", "out_mean", "degree_median") for x in stats.summary(c, c)])


def connectivity_per_model(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components; isolated nodes are those without any valid edge, a loop counts as one."""
    joined = graph.cut(graph.pairs(nodes, edges))  # read twice
    comp = graph.components(nodes, edges, joined=joined).groupBy("model_id", "component").agg(F.count("*").alias("size"))
    loops = joined.where("u = v").select("model_id", F.col("u").alias("component"), F.lit(True).alias("loop"))
    comp = comp.join(loops, ["model_id", "component"], "left")  # a component of one node is that node
    shape = comp.groupBy("model_id").agg(
        F.count("*").alias("components"), F.max("size").alias("largest"), F.avg("size").alias("size_mean"), F.sum("size").alias("n"), F.count_if((F.col("size") == 1) & F.col("loop").isNull()).alias("isolated"),
    )
    out = models.select("model_id").join(shape, "model_id", "left").fillna(0)
    return out.withColumn("isolated_share", stats.ratio(F.col("isolated"), F.col("n"))).drop("n")


def connectivity(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = connectivity_per_model(models, nodes, edges)
    return p.agg(F.sum("isolated").alias("isolated_total"), *[x for c in ("components", "largest", "isolated_share") for x in stats.summary(c, c)])


def containment_per_model(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = graph.containment_depth(nodes, edges, models)
    p = d.groupBy("model_id").agg(
        F.max("depth").alias("max_depth"), F.avg("depth").alias("mean_depth"), F.median("depth").alias("median_depth"), F.count_if("is_root").alias("roots"),
        F.count_if(F.col("depth") > 0).alias("contained"), F.count("*").alias("n"),
    )
    out = models.select("model_id").join(p, "model_id", "left").fillna(0)
    return out.withColumn("contained_share", stats.ratio(F.col("contained"), F.col("n"))).drop("n")


def containment(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    p = containment_per_model(models, nodes, edges)
    return p.agg(F.sum("roots").alias("roots_total"), F.sum("contained").alias("contained_total"), *[x for c in ("max_depth", "mean_depth", "contained_share") for x in stats.summary(c, c)])


def _read_once(nodes: DataFrame, edges: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns that the measures read, as tables: what nodes and edges come from is worked out once, not by each."""
    kept = ["model_id", "source_id", "target_id", *(["type", "data"] if "containment" in names else [])]
    return graph.cut(nodes.select("model_id", "node_id")), graph.cut(edges.select(kept))


def all_measures(models: DataFrame, nodes: DataFrame, edges: DataFrame, enabled: set[str] | None = None) -> dict[str, DataFrame]:
    """The four corpus measures, one row each; one that is off has no plan and no work, as components and depths are
    worked out when they are asked for."""
    plans = {f.__name__: f for f in (size, degree, connectivity, containment) if enabled is None or f.__name__ in enabled}
    nodes, edges = _read_once(nodes, edges, list(plans))
    return {name: f(models, nodes, edges) for name, f in plans.items()}


def all_per_model(models: DataFrame, nodes: DataFrame, edges: DataFrame, enabled: set[str] | None = None) -> DataFrame:
    """Per-model figures side by side, of all four measures or of those that are on."""
    plans = {"size": size_per_model, "degree": degree_per_model, "connectivity": connectivity_per_model, "containment": containment_per_model}
    plans = {name: f for name, f in plans.items() if enabled is None or name in enabled}
    nodes, edges = _read_once(nodes, edges, list(plans))
    out = models.select("model_id")
    for f in plans.values():
        out = out.join(f(models, nodes, edges), "model_id", "left")
    return out
