"""Components and containment depth over all models at once.  Vertices are ``(model_id, node_id)``.

Neither crosses a model.  So models up to a stated size are dealt out whole, many to a task, and solved there; only
larger ones go through rounds over tables, in which the work of one model is spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprof.sources.files import shared_folder

MOST_EDGES = 200_000  # of a model that one task solves
TASK_EDGES = 100_000
MOST_BROADCAST = 100_000  # rows of a table that a join may send to all tasks


def cut(df: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Written to the folder that all executors share and read again, so that each round starts from a table and a lost
    executor costs one round.

    Files are many times smaller than the rows in them, so Spark takes large tables for small ones and would broadcast
    them through the driver.  A table of more rows than ``most_broadcast`` is joined by shuffles instead."""
    return _counted(df, most_broadcast)[0]


def _counted(df: DataFrame, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, int]:
    """The table of ``cut``, and its number of rows."""
    spark = df.sparkSession
    path = shared_folder(spark, "graph")
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    rows = table.count()
    return (table.hint("merge") if rows > most_broadcast else table), rows


@contextmanager
def _shuffles_dropped(spark: SparkSession, key: str = "spark.sql.classic.shuffleDependency.fileCleanup.enabled") -> Iterator[None]:
    """What is written here leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _dealt(edges: DataFrame, most_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of small models with a ``task`` number, and those of large models (None if there are none)."""
    per = cut(edges.groupBy("model_id").agg(F.count("*").alias("n")))
    total, most = per.agg(F.sum("n"), F.max("n")).first()
    tasks = max(1, -(-(total or 0) // TASK_EDGES))
    task = F.pmod(F.xxhash64("model_id"), F.lit(tasks)).alias("task")
    if (most or 0) <= most_edges:
        return edges.select("*", task), None
    large = per.where(F.col("n") > most_edges).select("model_id")
    return edges.join(large, "model_id", "left_anti").select("*", task), edges.join(large, "model_id", "left_semi")


def _numbered(models: pd.Series, *columns: pd.Series) -> tuple[list[np.ndarray], pd.DataFrame]:
    """Vertices of several columns as numbers in order of model and id, and their names."""
    keys = pd.concat([pd.DataFrame({"m": models, "v": c}) for c in columns], ignore_index=True)
    names = keys.drop_duplicates().sort_values(["m", "v"], ignore_index=True)
    names["at"] = np.arange(len(names))
    at = keys.merge(names, on=["m", "v"], how="left")["at"].to_numpy()
    n = len(models)
    return [at[i * n : (i + 1) * n] for i in range(len(columns))], names


def _least(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """The smallest vertex that each is joined with."""
    low = np.arange(size)
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = np.minimum(new, new[new])
        # hook the roots as well, so that rounds go with the logarithm of a path
        np.minimum.at(new, low[u], new[v])
        np.minimum.at(new, low[v], new[u])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest vertex of each component of whole models."""
    (u, v), names = _numbered(pdf["model_id"], pdf["u"], pdf["v"])
    low = _least(u, v, len(names))
    return pd.DataFrame({"model_id": names["m"], "node_id": names["v"], "c": names["v"].to_numpy()[low]})


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes of their model."""
    return _between(nodes.select("model_id", "node_id").distinct(), edges)


def _between(ids: DataFrame, edges: DataFrame) -> DataFrame:
    s, t = ids.withColumnRenamed("node_id", "source_id"), ids.withColumnRenamed("node_id", "target_id")
    return edges.join(s, ["model_id", "source_id"], "left_semi").join(t, ["model_id", "target_id"], "left_semi")


def pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``model_id, u, v``: what valid edges join, once each, without direction; loops are there too."""
    return valid_edges(nodes, edges).select("model_id", F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60, most_edges: int = MOST_EDGES, joined: DataFrame | None = None) -> DataFrame:
    """``model_id, node_id, component``: the smallest node id of each undirected component.  ``joined``: a table of the
    ``pairs`` if there is one."""
    e = (cut(pairs(nodes, edges)) if joined is None else joined).where("u <> v")
    small, large = _dealt(e, most_edges)
    found = small.groupBy("task").applyInPandas(_joined, "model_id string, node_id string, c string")
    if large is not None:
        found = found.unionByName(_stars(large, most_rounds))
    return nodes.select("model_id", "node_id").distinct().join(found, ["model_id", "node_id"], "left").select("model_id", "node_id", F.coalesce("c", "node_id").alias("component"))


def _stars(edges: DataFrame, most_rounds: int) -> DataFrame:
    """Large-star and small-star rounds, which end after a number that grows with the logarithm of the longest path."""
    e = cut(edges.select("model_id", "u", "v"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select("model_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("model_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, ["model_id", "u"]).where("v > u").select("model_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("model_id", "u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        e = cut(large.join(low, ["model_id", "u"]).select("model_id", F.explode(pairs).alias("x")).select("model_id", "x.u", "x.v").where("u <> v").distinct())
        # done when the edges are stars: no vertex is a leaf of two centres, or a leaf and a centre
        ends = e.select("model_id", "u", F.lit(1).alias("leaf")).unionByName(e.select("model_id", F.col("v").alias("u"), F.lit(0).alias("leaf")))
        if not ends.groupBy("model_id", "u").agg(F.sum("leaf").alias("n"), F.min("leaf").alias("c")).where("n > 1 or (n = 1 and c = 0)").limit(1).count():
            return e.select("model_id", F.col("u").alias("node_id"), F.col("v").alias("c"))
    raise RuntimeError("components did not settle")


def is_containment(language: Column, edge_type: Column, data: Column) -> Column:
    lang, kind = F.lower(F.trim(language)), F.lower(F.trim(edge_type))
    flag = F.coalesce(data["containment"] == "true", F.lit(False))
    return F.coalesce(
        F.when(F.contains(lang, F.lit("archimate")), kind.isin("composition", "aggregation"))
        .when(F.contains(lang, F.lit("ecore")), kind.isin("contains", "containment") | flag)
        .otherwise(kind.isin("contains", "containment", "composition", "aggregation") | flag),
        F.lit(False),
    )


def _onward(first: np.ndarray, child: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Children of ``front``, with repeats: those of node i stand in ``child`` from ``first[i]`` on."""
    times = first[front + 1] - first[front]
    return child[np.repeat(first[front] - (np.cumsum(times) - times), times) + np.arange(times.sum())]


def _last_visits(first: np.ndarray, child: np.ndarray, enters: dict[int, np.ndarray], most: int, depth: np.ndarray) -> None:
    """Sets ``depth`` to the last step, ``most`` at the latest, in which a walk is at a node; walks enter at given steps.

    The nodes of a step follow from those of the step before.  So once all have entered and a step has the nodes of an
    earlier one, steps repeat for ever: one more period is walked and carried on to ``most``."""
    times = sorted(enters)
    k, front, seen = times[0], np.zeros(0, dtype=np.int64), {}
    while k <= most:
        if k in enters:
            front = np.union1d(front, enters[k])
        depth[front] = k
        if k >= times[-1]:
            if not len(front):
                return
            key = blake2b(front.tobytes(), digest_size=16).digest()
            if key in seen:
                break
            seen[key] = k
        front, k = np.unique(_onward(first, child, front)), k + 1
    else:
        return
    period = k - seen[key]
    for t in range(k, min(k + period, most + 1)):
        depth[front] = np.maximum(depth[front], t + (most - t) // period * period)
        front = np.unique(_onward(first, child, front))


def _walked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depths of whole models: ``n`` is the number of nodes of the model, ``rooted`` tells whether it has a node that
    nothing contains; one that has none starts from every node.

    Nodes that no cycle leads to are peeled level by level, which is one longest-path pass.  On cycles and behind them
    walks of every length count: those run apart for each connected part of what is left."""
    (a, b), names = _numbered(pdf["model_id"], pdf["node_id"], pdf["child"])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    size = len(names)
    first = np.searchsorted(a, np.arange(size + 1))
    most = names["m"].map(dict(zip(pdf["model_id"], pdf["n"]))).to_numpy(np.int64)
    rooted = names["m"].map(dict(zip(pdf["model_id"], pdf["rooted"]))).to_numpy(bool)
    depth = np.zeros(size, dtype=np.int64)
    waiting = np.bincount(b, minlength=size)
    front, k, left = np.flatnonzero(waiting == 0), 0, np.ones(size, dtype=bool)
    while len(front):
        depth[front] = k
        left[front] = False
        to = _onward(first, b, front)
        np.subtract.at(waiting, to, 1)
        front, k = np.unique(to[waiting[to] == 0]), k + 1
    if left.any():
        enters: dict[int, dict[int, np.ndarray]] = {}
        inside = left[a] & left[b]
        part = _least(a[inside], b[inside], size)
        every = np.flatnonzero(left & ~rooted)
        if len(every):
            for p, at in _groups(part[every], every):
                enters.setdefault(p, {})[0] = at
        # walks of every length from the roots to the cycles, through nodes that lead to one
        leads, todo = left.copy(), np.flatnonzero(left)
        back = np.argsort(b, kind="stable")
        into = np.searchsorted(b[back], np.arange(size + 1))
        while len(todo):
            todo = np.unique(_onward(into, a[back], todo))
            todo = todo[~leads[todo]]
            leads[todo] = True
        front, k = np.flatnonzero(leads & ~left & (np.bincount(b, minlength=size) == 0)), 0
        while len(front):
            to, k = np.unique(_onward(first, b, front)), k + 1
            for p, at in _groups(part[to[left[to]]], to[left[to]]):
                enters.setdefault(p, {})[k] = at
            front = to[leads[to] & ~left[to]]
        for p, at in enters.items():
            _last_visits(first, b, at, int(most[p]), depth)
    return pd.DataFrame({"model_id": names["m"], "node_id": names["v"], "k": depth})


def _groups(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    found, at = np.unique(keys[order], return_index=True)
    return list(zip(found.tolist(), np.split(values[order], at[1:]))) if len(keys) else []


def containment_depth(nodes: DataFrame, edges: DataFrame, models: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """``model_id, node_id, depth, is_root``: longest walk from a root (a node that nothing contains; all nodes where
    there is none), at most as long as the model has nodes."""
    ids, languages = cut(nodes.select("model_id", "node_id").distinct()), cut(models.select("model_id", "language"))
    e = (
        _between(ids, edges).join(languages, "model_id")
        .where(is_containment(F.col("language"), F.col("type"), F.col("data")))
        .select("model_id", F.col("source_id").alias("node_id"), F.col("target_id").alias("child")).distinct()
    )
    e = cut(e)
    free = cut(ids.join(e.select("model_id", F.col("child").alias("node_id")).distinct(), ["model_id", "node_id"], "left_anti"))
    rooted = cut(free.select("model_id").distinct())
    roots = free.unionByName(ids.join(rooted, "model_id", "left_anti"))
    size = ids.groupBy("model_id").agg(F.count("*").alias("n"))
    small, large = _dealt(e, most_edges)
    small = small.join(size, "model_id").join(rooted.withColumn("rooted", F.lit(True)), "model_id", "left").fillna(False, ["rooted"])
    reached = small.groupBy("task").applyInPandas(_walked, "model_id string, node_id string, k long")
    if large is not None:
        reached = reached.unionByName(_rounds(large, roots.join(large.select("model_id").distinct(), "model_id", "left_semi"), size))
    is_root = roots.withColumn("is_root", F.lit(True))
    out = ids.join(is_root, ["model_id", "node_id"], "left").join(reached, ["model_id", "node_id"], "left")
    return out.select("model_id", "node_id", F.coalesce("k", F.lit(0)).cast("int").alias("depth"), F.coalesce("is_root", F.lit(False)).alias("is_root"))


def _rounds(e: DataFrame, roots: DataFrame, size: DataFrame) -> DataFrame:
    """Each round keeps the distinct nodes that a walk of k edges reaches.  A model ends when no walk goes on, or when the
    nodes of a round are those of an earlier one: from there on rounds repeat, so that one more period, carried on to
    the number of nodes of the model, tells the rest.

    A round is compared with one earlier round, the last whose number is a power of two, by a count and two sums of hashes
    for each model.  These are tables too: the driver keeps two numbers, however many models there are."""
    none = F.lit(None).cast("long")
    start = roots.join(size, "model_id").select("model_id", "node_id", "n", none.alias("last"), none.alias("period"))
    (e, edges), (frontier, rows) = _counted(e.select("model_id", "node_id", "child")), _counted(start)
    reached, saved, at, k = [], None, 0, 0  # saved: what the nodes of each model were in round ``at``
    while rows:
        h = F.xxhash64("node_id")
        told = frontier.where("last is null").groupBy("model_id").agg(F.count("*").alias("c"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 24)).alias("s"))
        if saved is not None:
            again, models = _counted(told.join(saved, ["model_id", "c", "x", "s"], "left_semi").select("model_id", F.lit(True).alias("again")))
            if models:  # one more period begins with this round
                marked = frontier.join(again, "model_id", "left")
                frontier = cut(marked.select(
                    "model_id", "node_id", "n", F.when(F.col("again"), k + (k - at) - 1).otherwise(F.col("last")).cast("long").alias("last"), F.when(F.col("again"), k - at).otherwise(F.col("period")).cast("long").alias("period")
                ))
        step = F.when(F.col("last").isNull(), k).otherwise(F.lit(k) + F.floor((F.col("n") - k) / F.col("period")) * F.col("period"))  # in the extra period, the last repeat
        reached.append(frontier.select("model_id", "node_id", step.cast("long").alias("k")))
        if len(reached) >= 16:  # fold the levels so far into one table
            reached = [cut(_deepest(reached))]
        onward = frontier.where(F.coalesce(F.col("last") > k, F.lit(True)) & (F.col("n") > k))
        if k & (k - 1) == 0:
            saved, at = cut(told), k
            if k and rows * 4 < edges:  # edges of models that have ended are left behind
                e, edges = _counted(e.join(onward.select("model_id").distinct(), "model_id", "left_semi"))
        k += 1
        frontier, rows = _counted(onward.join(e, ["model_id", "node_id"]).select("model_id", F.col("child").alias("node_id"), "n", "last", "period").distinct())
    return _deepest(reached)


def _deepest(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.groupBy("model_id", "node_id").agg(F.max("k").alias("k"))
