from strataprof.operators import graph, size

NONE = "map<string,string>"


def frames(spark, nodes, edges, language="UML"):
    m = spark.createDataFrame([(x, language) for x in sorted({n[0] for n in nodes})], "model_id string, language string")
    n = spark.createDataFrame(nodes, "model_id string, node_id string")
    e = spark.createDataFrame([(a, f"e{i}", s, t, k, {}) for i, (a, s, t, k) in enumerate(edges)], f"model_id string, edge_id string, source_id string, target_id string, type string, data {NONE}")
    return m, n, e


def test_components_loops_and_dangling_edges(spark):
    m, n, e = frames(spark, [("m", x) for x in "abcdef"], [("m", "a", "b", "x"), ("m", "b", "c", "x"), ("m", "d", "d", "x"), ("m", "e", "zz", "x")])
    got = {r["node_id"]: r["component"] for r in graph.components(n, e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    r = size.connectivity_per_model(m, n, e).first()
    assert (r["components"], r["largest"], r["isolated"]) == (4, 3, 2)


def test_long_path_is_one_component(spark):
    nodes = [("m", f"n{i:03d}") for i in range(60)]
    m, n, e = frames(spark, nodes, [("m", nodes[i][1], nodes[i + 1][1], "x") for i in range(59)])
    assert graph.components(n, e).select("component").distinct().count() == 1


def test_containment_depth(spark):
    edges = [("d", "a", "b", "contains"), ("d", "a", "c", "contains"), ("d", "b", "c", "contains"), ("d", "a", "e", "other"), ("y", "p", "q", "contains"), ("y", "q", "p", "contains")]
    m, n, e = frames(spark, [("d", x) for x in "abce"] + [("y", "p"), ("y", "q")], edges)
    got = {(r["model_id"], r["node_id"]): r["depth"] for r in graph.containment_depth(n, e, m).collect()}
    assert got == {("d", "a"): 0, ("d", "b"): 1, ("d", "c"): 2, ("d", "e"): 0, ("y", "p"): 2, ("y", "q"): 2}


def test_small_and_large_models_alike(spark):
    """Models solved whole in a task and models solved by rounds over tables give the same as plain loops."""
    import random

    rng = random.Random(11)
    nodes, edges = [], []
    for m in range(12):
        n = rng.randint(1, 25)
        ids = [f"n{i}" for i in range(n)]
        nodes += [(f"m{m}", i) for i in ids]
        edges += [(f"m{m}", rng.choice(ids), rng.choice([*ids, "gone"]), rng.choice(["contains", "other"])) for _ in range(rng.randint(0, 30))]
    m, n, e = frames(spark, nodes, edges)
    comp, depth = {}, {}
    for model in {x for x, _ in nodes}:
        mine = sorted(v for x, v in nodes if x == model)
        ok = [(a, b, k) for x, a, b, k in edges if x == model and b in mine]
        low = {v: v for v in mine}
        for _ in mine:
            for a, b, _ in ok:
                low[a] = low[b] = min(low[a], low[b])
        comp |= {(model, v): low[v] for v in mine}
        inside = {(a, b) for a, b, k in ok if k == "contains"}
        front = {v for v in mine if v not in {b for _, b in inside}} or set(mine)
        depth |= {(model, v): 0 for v in mine}
        for k in range(1, len(mine) + 1):
            front = {b for a, b in inside if a in front}
            depth |= {(model, v): k for v in front}
    for most in (graph.MOST_EDGES, 10, 0):
        assert {(r["model_id"], r["node_id"]): r["component"] for r in graph.components(n, e, most_edges=most).collect()} == comp
        assert {(r["model_id"], r["node_id"]): r["depth"] for r in graph.containment_depth(n, e, m, most_edges=most).collect()} == depth


def test_no_edges_and_no_nodes(spark):
    m, n, e = frames(spark, [("m", "a")], [("m", "a", "zz", "contains")])
    assert graph.components(n, e).first()["component"] == "a" and graph.containment_depth(n, e, m).first()["depth"] == 0
    assert graph.components(n.limit(0), e.limit(0)).count() == 0


def test_measures_that_are_off_cost_nothing(spark, monkeypatch):
    """Only what is asked for is worked out, with the figures that it has beside the others."""
    m, n, e = frames(spark, [("m", x) for x in "abcd"] + [("k", "a")], [("m", "a", "b", "contains"), ("m", "c", "zz", "x")])
    whole = {k: v.first() for k, v in size.all_measures(m, n, e).items()}
    per = {r["model_id"]: r for r in size.all_per_model(m, n, e).collect()}
    monkeypatch.setattr(graph, "components", None)
    assert size.all_measures(m, n, e, {"containment"})["containment"].first() == whole["containment"]
    monkeypatch.undo()
    monkeypatch.setattr(graph, "containment_depth", None)
    on = {"size", "degree", "connectivity"}
    assert {k: v.first() for k, v in size.all_measures(m, n, e, on).items()} == {k: whole[k] for k in on}
    got = size.all_per_model(m, n, e, on)
    assert "max_depth" not in got.columns and all(per[r["model_id"]][c] == r[c] for r in got.collect() for c in got.columns)


def test_rounds_keep_nothing_of_each_model_on_the_driver(spark, monkeypatch):
    """Rings of 1 to 8 nodes behind tails of 0 to 4, and a node that leaves the ring: as in whole models, with few rows collected."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    rows = []
    for m in range(40):
        ring, tail = m % 8 + 1, m // 8
        way = [f"t{i}" for i in range(tail)] + [f"r{i}" for i in range(ring)] + ["r0"]
        rows += [(f"m{m}", a, b) for a, b in zip(way, way[1:])] + [(f"m{m}", f"r{ring - 1}", "out")]
    edges = spark.createDataFrame([(m, a, b, "contains", {}) for m, a, b in rows], "model_id string, source_id string, target_id string, type string, data map<string,string>")
    nodes = spark.createDataFrame(sorted({(m, x) for m, a, b in rows for x in (a, b)}), "model_id string, node_id string")
    models = spark.createDataFrame([(f"m{m}", "UML") for m in range(40)], "model_id string, language string")
    want = sorted(graph.containment_depth(nodes, edges, models).collect())
    collect, most = Classic.collect, []

    def counted(self):
        found = collect(self)
        most.append(len(found))
        return found

    with monkeypatch.context() as patched:
        patched.setattr(Classic, "collect", counted)
        by_tables = graph.containment_depth(nodes, edges, models, most_edges=0)
    assert max(most) == 1
    assert sorted(by_tables.collect()) == want


def test_a_roll_up_holds_figures_only(spark):
    """Each measure is written before the next is worked out, and leaves no shuffles: what is returned only reads figures."""
    from strataprof.operators import report

    m, n, e = frames(spark, [("m", x) for x in "abcdefg"], [("m", "a", "b", "x"), ("m", "b", "c", "x"), ("m", "d", "d", "x"), ("m", "e", "zz", "x"), ("m", "b", "b", "x")])
    measures = size.all_measures(m, n, e, {"size", "connectivity"})
    out = report.roll_up(m, {"size": measures, "lexical": None})
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["measure"], r["figure"]): r["value"] for r in out.collect()}
    assert got["size", "total_edges"] == 5 and got["connectivity", "isolated_total"] == 3 and got["connectivity", "components_max"] == 5
