"""Cyclic containment, pull parsing, nested and repeated elements, exact percentiles, field samples and whole runs."""

import json
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataprof.functions import stats
from strataprof.operators import extract, graph, labels, views
from strataprof.sources import files

XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def longest_walks(n, edges):
    """Last step up to n in which a walk from a root (all nodes, if none) is at each node."""
    front = {v for v in range(n) if v not in {b for _, b in edges}}
    rooted, depth = bool(front), dict.fromkeys(range(n), 0)
    front = front or set(range(n))
    for k in range(1, n + 1):
        front = {b for a, b in edges if a in front}
        depth |= dict.fromkeys(front, k)
    return depth, rooted


def some_graphs(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(1, 12)
        yield n, sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 2 * n))})


def test_walks_on_random_graphs():
    """Cycles of several lengths, entered from several places, behind each other and beside acyclic parts."""
    for n, edges in some_graphs(300, 5):
        depth, rooted = longest_walks(n, edges)
        rows = [("m", f"{a:02d}", f"{b:02d}", n, rooted) for a, b in edges]
        if rows:
            got = graph._walked(pd.DataFrame(rows, columns=["model_id", "node_id", "child", "n", "rooted"]))
            assert {int(r.node_id): r.k for r in got.itertuples()} == {v: depth[v] for e in edges for v in e}, edges


def test_walks_in_tasks_and_over_tables(spark):
    nodes, edges, want = [], [], {}
    for m, (n, pairs) in enumerate(some_graphs(12, 8)):
        nodes += [(f"m{m}", f"n{v}") for v in range(n)]
        edges += [(f"m{m}", f"n{a}", f"n{b}") for a, b in pairs]
        want |= {(f"m{m}", f"n{v}"): k for v, k in longest_walks(n, pairs)[0].items()}
    ms = spark.createDataFrame(sorted({(m,) for m, _ in nodes}), "model_id string").withColumn("language", F.lit("UML"))
    e = spark.createDataFrame(edges, "model_id string, source_id string, target_id string").select("*", F.lit("contains").alias("type"), F.create_map().cast("map<string,string>").alias("data"))
    n = spark.createDataFrame(nodes, "model_id string, node_id string")
    for most in (graph.MOST_EDGES, 0):
        assert {(r.model_id, r.node_id): r.depth for r in graph.containment_depth(n, e, ms, most_edges=most).collect()} == want


def test_a_ring_of_many_edges_takes_seconds(spark):
    n = 200_000
    ids = F.format_string("n%d", "id")
    nodes = spark.range(n).select(F.lit("m").alias("model_id"), ids.alias("node_id"))
    edges = spark.range(n).select(F.lit("m").alias("model_id"), ids.alias("source_id"), F.format_string("n%d", (F.col("id") + 1) % n).alias("target_id"), F.lit("contains").alias("type"), F.create_map().cast("map<string,string>").alias("data"))
    ms = spark.createDataFrame([("m", "UML")], "model_id string, language string")
    for most in (graph.MOST_EDGES, 0):
        began = time.time()
        assert tuple(graph.containment_depth(nodes, edges, ms, most_edges=most).agg(F.min("depth"), F.max("depth"), F.count_if("is_root")).first()) == (n, n, n)
        assert time.time() - began < 90


def shredded(spark, text, language="xml"):
    return extract.shred(spark.createDataFrame([("m", text)], "model_id string, text string"), language)


def test_long_and_deep_files_in_bounded_batches(spark):
    long = "<r>" + "<e id='1'>x</e>" * 100_000 + "</r>"
    deep = "<e>" * 50_000 + "</e>" * 50_000
    out = extract.shred(spark.createDataFrame([("long", long), ("deep", deep), ("broken", long[:-1]), ("none", "")], "model_id string, text string").coalesce(1), "xml-flat")
    got = {r.model_id: (r.n, r.d, r.e) for r in out.groupBy("model_id").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.count("error").alias("e")).collect()}
    assert got == {"long": (100_001, 1, 0), "deep": (50_000, 49_999, 0), "broken": (1, 0, 1), "none": (1, 0, 1)}
    assert out.where("model_id = 'deep' and seq > 0 and parent_seq <> seq - 1").count() == 0
    # rows leave while the file is read: of the first batch there are no more than asked for
    rows, source = 0, extract.xml_rows("m", long)
    while rows < 30_000:
        next(source)
        rows += 1
    source.close()


def test_rows_of_a_file_do_not_depend_on_batches(spark):
    text = "<a i='0'><b type='t'>x<c/><c>y</c></b><d xmlns='u'>z</d></a>"
    df = spark.createDataFrame([("m", text)], "model_id string, text string")
    few = extract.shred(df, "xml", most_rows=1).orderBy("seq").collect()
    assert few == extract.shred(df, "xml").orderBy("seq").collect()
    assert [(r.tag, r.parent_seq, r.anc_tags, r.anc_types, r.text, r.ns) for r in few] == [
        ("a", None, [], [], None, ""), ("b", 0, ["a"], [""], "x", ""), ("c", 1, ["a", "b"], ["", "t"], None, ""), ("c", 1, ["a", "b"], ["", "t"], "y", ""), ("d", 0, ["a"], [""], "z", "u"),
    ]


def test_shapes_by_levels_equal_the_walk(spark):
    """Nested, repeated and id-less shapes; repeats that stand in what goes hide nothing."""
    rng = random.Random(3)

    def shape(depth):
        x = {}
        if rng.random() < 0.9:
            x["resourceId"] = f"s{rng.randrange(14)}"
        if rng.random() < 0.93:
            x["stencil"] = {"id": rng.choice(["Task", "SequenceFlow"])}
        if rng.random() < 0.3:
            x["properties"] = {"name": "n"}
        if rng.random() < 0.3:
            x["outgoing"] = [{"resourceId": "s1"}, {}, {"resourceId": ""}, "odd"]
        if rng.random() < 0.3:
            x["target"] = rng.choice([{"resourceId": "s2"}, "s3"])
        if rng.random() < 0.2:
            x["source"] = {"resourceId": "s4"}
        if depth < 5:
            x["childShapes"] = [rng.choice([shape(depth + 1), shape(depth + 1), "odd"]) for _ in range(rng.randint(0, 3))]
        return x

    texts = [(f"m{i}", json.dumps({"resourceId": "root", "stencil": {"id": "D"}, "childShapes": [shape(1) for _ in range(4)]})) for i in range(40)]
    texts += [("broken", "{"), ("list", "[1]"), ("empty", ""), ("bare", "{}")]
    df = spark.createDataFrame(texts, "model_id string, text string")
    columns = ["model_id", "seq", "parent_id", "shape_id", "stencil", "name", "outgoing", "target", "source"]
    is_bad = F.when(F.col("error").contains("Error"), "no JSON object").otherwise(F.col("error")).alias("error")

    def rows(d):
        return sorted(map(str, d.select(*[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c == "outgoing" else c for c in columns], is_bad).collect()))

    walk, levels = rows(extract.shred(df, "bpmn-json")), rows(extract.bpmn_shapes(df))
    assert len(walk) > 200 and "DUPLICATE_ID" in str(walk) and "MISSING_ATTRIBUTE" in str(walk)
    assert levels == walk


def test_extractor_as_a_table_function(spark):
    extract.register_extractor("pairs", lambda m, t: ((m, *p.split("=", 1)) for p in t.split(";") if "=" in p), "model_id string, key string, value string")
    name = extract.register_udtf(spark, "pairs")
    spark.createDataFrame([("a", "x=1;y=2"), ("b", ""), ("c", None)], "model_id string, text string").createOrReplaceTempView("texts")
    got = spark.sql(f"SELECT t.* FROM texts f, LATERAL {name}(f.model_id, f.text) t").collect()
    assert sorted(map(tuple, got)) == [("a", "x", "1"), ("a", "y", "2")]
    extract.register_udtf(spark, "xml", "to_elements")
    assert spark.sql("SELECT count(*) AS n, max(depth) AS d FROM to_elements('m', '<a><b><c/></b></a>')").first() == (3, 2)


ECORE = f"""<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore" {XSI}>
<ecore:EAnnotation source="top"><details key="a" value="1"/><eAnnotations source="top"><details key="a" value="2"/></eAnnotations></ecore:EAnnotation>
<ecore:EPackage name="p"><eAnnotations source="s"><details key="k" value="first"/><details key="k" value="second"/></eAnnotations><eAnnotations source="s"><details key="k" value="third"/></eAnnotations><eAnnotations/>
<eClassifiers xsi:type="ecore:EClass" name="A" eSuperTypes="#//B #/1/C  q.ecore#//D"/><eClassifiers xsi:type="ecore:EClass" name="B" eSuperTypes="#//A"/>
<eClassifiers xsi:type="ecore:EClass" name="E" eSuperTypes="ecore:EClass http://x#//Far #//B ecore:EClass y.ecore#//Z"/><eSubpackages name="in"><eClassifiers xsi:type="ecore:EDataType" name="T"/></eSubpackages></ecore:EPackage>
<ecore:EPackage name="r"><eClassifiers xsi:type="ecore:EClass" name="C"/></ecore:EPackage><ecore:EDataType name="Lone"/></xmi:XMI>"""


def test_supertypes_roots_and_origin(spark):
    e = shredded(spark, ECORE)
    nodes, edges, _ = extract.ecore(e)
    got = {(r.source_id, r.target_id) for r in edges.where("type = 'Generalization'").collect()}
    assert got == {("p/A", "p/B"), ("p/A", "r/C"), ("p/A", "q.ecore#//D"), ("p/B", "p/A"), ("p/E", "http://x#//Far"), ("p/E", "p/B"), ("p/E", "y.ecore#//Z")}
    assert {(r.node_id, r.ns_uri) for r in nodes.where("external").collect()} == {("q.ecore#//D", "q.ecore"), ("http://x#//Far", "http://x"), ("y.ecore#//Z", "y.ecore"), ("Lone", extract.ECORE_NS)}
    assert {(r.external, r.package_name) for r in extract.data_type_origin(e).collect()} == {(False, None), (True, "ecore")}


def test_nested_annotations(spark):
    e = shredded(spark, ECORE)
    names = {r.seq: r.attrs.get("name") for r in e.collect()}
    got = {(names.get(r.owner_seq), r.source): r.data for r in extract.annotations(e).collect()}
    assert got == {(None, "top"): {"a": "2"}, ("p", "s"): {"k": "second"}, ("p", ""): {}}


def test_upsert_and_conflicts(spark):
    """Against a loop that keeps nodes as they come."""
    rng = random.Random(6)
    rows = [(rng.choice("mn"), rng.choice("abc"), i, rng.choice(["X", "X", "Y"]), rng.choice([None, "", "u", "v"]), {rng.choice("pq"): str(i)}) for i in range(60)]
    kept, conflicts = {}, []
    for m, k, _, kind, name, data in rows:
        old = kept.get((m, k))
        if old is None:
            kept[m, k] = [kind, name or None, dict(data)]
            continue
        if old[0] != kind or (name and old[1] and old[1] != name):
            conflicts.append((m, k))
        old[1] = old[1] or name or None
        old[2] = data | old[2]
    df = spark.createDataFrame(rows, "model_id string, node_id string, pos int, type string, name string, data map<string,string>").repartition(3)
    assert {(r.model_id, r.node_id): [r.type, r.name, r.data] for r in extract.upsert(df).collect()} == kept
    assert sorted((r.model_id, r.msg) for r in extract.upsert_conflicts(df).collect()) == sorted(conflicts) and len(conflicts) > 5


@pytest.mark.parametrize("most", [5, 100_000])
def test_exact_percentiles(spark, most):
    rng = np.random.default_rng(2)
    n = 3001
    columns = {
        "even": rng.normal(size=n), "ties": rng.choice([1.0, 5.0, 5.0, 5.0, 9.0], n), "wide": 10.0 ** rng.integers(-300, 300, n), "one": np.full(n, 7.0),
        "some": np.where(rng.random(n) < 0.7, None, rng.integers(0, 50, n).astype(float)), "none": np.full(n, None),
    }
    df = spark.createDataFrame(pd.DataFrame({k: pd.Series(v, dtype="float64") for k, v in columns.items()})).repartition(4)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    p = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = stats.exact_percentiles(df, list(columns), p, most_values=most, accuracy=50)
    for c in columns:
        want = df.agg(F.percentile(c, F.array(*map(F.lit, p))).alias("x")).first()["x"]
        assert got[c] == ([None] * len(p) if want is None else pytest.approx(want, rel=1e-12)), c
    a = stats.large_summary(df, {"even": "e", "none": "n"}, most_values=most).first()
    b = df.agg(*stats.summary("even", "e"), *stats.summary("none", "n")).first()
    assert a.asDict() == pytest.approx(b.asDict(), rel=1e-12)


def test_bin_labels(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 10)], "v double")
    assert [r.bin for r in stats.bin_labels(stats.histogram(df, "v", bins=4)).orderBy("bin_idx").collect()] == ["0.0-2.5", "2.5-5.0", "5.0-7.5", "7.5-10.0"]
    one = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [r.bin for r in stats.bin_labels(stats.histogram(one, "v")).collect()] == ["3"]
    share = spark.createDataFrame([(0.0,), (1.0,)], "v double")
    assert [r.bin for r in stats.bin_labels(stats.share_histogram(share, "v", bins=2), percent=True).orderBy("bin_idx").collect()] == ["0-50%", "50-100%"]


def test_field_catalog(spark):
    df = spark.createDataFrame([(1, "b", {"x": 1, "y": 2}, True, None), (2, "a", {"y": 2, "x": 1}, None, None), (2, None, None, True, None)], "n int, s string, m map<string,int>, f boolean, z string")
    got = {r.field: tuple(r)[1:] for r in views.field_catalog(df).collect()}
    assert got == {
        "n": ("number", "1", 3, 3, 2, False), "s": ("string", "a", 3, 2, 2, True), "m": ("map_number", '{"x":1,"y":2}', 3, 2, 1, False), "f": ("boolean", "true", 3, 2, 1, False), "z": ("string", None, 3, 0, 0, False),
    }
    assert {tuple(r)[2:] for r in views.field_catalog(df.limit(0)).collect()} == {(None, 0, 0, 0, False)}


def test_readers_see_whole_runs_only(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert files.runs(spark, path) == []
    with pytest.raises(FileNotFoundError):
        files.read_run(spark, path, "a")
    first = files.write_run(spark, path, {"a": spark.range(3), "b": spark.range(2)}, source="here")
    broken = spark.range(4).select((F.lit(1) / F.when(F.col("id") < 3, 1).otherwise(0)).alias("id"))
    with pytest.raises(Exception):
        files.write_run(spark, path, {"a": spark.range(9), "b": broken})
    assert files.runs(spark, path) == [first] and files.read_run(spark, path, "a").count() == 3
    assert [p.name for p in (tmp_path / "runs").iterdir()] == [first]
    (tmp_path / "runs" / "run-99999999-half" / "a").mkdir(parents=True)  # a folder that never got a manifest
    second = files.write_run(spark, path, {"a": spark.range(5)}, fmt="json")
    assert files.runs(spark, path) == [first, second] and files.read_run(spark, path, "a").count() == 5
    assert files.read_run(spark, path, "b", first).count() == 2
    with pytest.raises(KeyError):
        files.read_run(spark, path, "b")
    m = files.manifest(spark, path, first).orderBy("name").collect()
    assert [(r.name, r.rows, r.source, r.bytes > 0, r.files > 0) for r in m] == [("a", 3, "here", True, True), ("b", 2, "here", True, True)]


def test_labels_of_any_type_end_at_what_is_no_string(spark):
    cases = [
        ('{"name":"a"}', "{}", "a"), ('{"name":1,"label":"b"}', '{"name":"d"}', None), ('{"name":null,"label":"b"}', "{}", "b"), ('{"label":"b"}', '{"name":"d"}', "d"),
        ("{}", '{"name":3,"title":"t"}', "t"), ('{"name":""}', '{"name":"d"}', ""), ("{}", "{}", None), (None, None, None), ('{"title":[1]}', '{"title":"t"}', None),
    ]
    df = spark.createDataFrame([(i, f, d, w) for i, (f, d, w) in enumerate(cases)], "i int, f string, d string, want string")
    got = df.select("want", labels.resolve_variant(F.parse_json("f"), F.parse_json("d")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_specs_of_concepts(spark):
    text = (
        '<m xmlns:xmi="http://schema.omg.org/spec/XMI/2.1"><p xmi:type="uml:RedefinableTemplateSignature" xmi:id="s" parameter=" a  b " other="1"><q/><details/><r xmi:type="uml:Done"/></p>'
        '<p xmi:type="uml:Nobody" xmi:id="n" other="2"><q/></p></m>'
    )
    rows = extract.shred(spark.createDataFrame([("m", text), ("bad", "<no"), ("none", None)], "model_id string, text string"), "xml")
    spec = spark.createDataFrame([*extract.UML_LISTS, extract.UML_LISTS[-1]], extract.SPEC)
    assert [(r["concept"], r["data"]) for r in extract.concept_payload(rows, spec).collect()] == [("RedefinableTemplateSignature", {"parameterRefs": ["a", "b"]})]
    assert [r["msg"] for r in extract.unhandled_by_concept(rows, spec).collect()] == ["RedefinableTemplateSignature(s)@other=1"]
    allowed = spark.createDataFrame([("RedefinableTemplateSignature", "z")], "concept string, child string")
    assert [r["msg"] for r in extract.unhandled_children_by_concept(rows, allowed, ["Done"]).collect()] == ["RedefinableTemplateSignature/q"]
    assert extract.concept_payload(rows.limit(0), spec).count() == 0


def test_large_tables_between_rounds_are_not_broadcast(spark):
    """Rows alike are small as a file and large in memory."""
    rows = graph.cut(spark.range(graph.MOST_BROADCAST + 1).selectExpr("'m' as model_id", "id % 10 as seq", "repeat('x', 50) as text"))
    few = graph.cut(spark.range(10).selectExpr("'m' as model_id", "id as seq"))
    assert "BroadcastHashJoin" not in rows.join(rows.groupBy("model_id", "seq").count(), ["model_id", "seq"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in few.join(few.groupBy("model_id", "seq").count(), ["model_id", "seq"])._jdf.queryExecution().executedPlan().toString()


def test_a_name_with_many_candidates_is_resolved_once(spark):
    n = 40_000  # references and candidates of one name: pairs would be 1.6 billion
    refs = spark.range(n).selectExpr("'m' as model_id", "cast(id as string) as ref_id", "'a' as name", "if(id % 3 = 0, 'h', null) as hint", "if(id % 3 = 1, 'k', 'none') as package")
    refs = refs.unionByName(spark.createDataFrame([("m", "0", "b", None, None), ("m", "1", "lost", "h", "k")], "model_id string, ref_id string, name string, hint string, package string"))
    cands = spark.range(n).selectExpr("'m' as model_id", "id as node_id", "'a' as name", "case when id = 7 then 'h' when id > 10 and id % 2 = 0 then 'k' else 'z' end as package")
    cands = cands.unionByName(spark.createDataFrame([("m", 5, "b", "z")], "model_id string, node_id long, name string, package string"))
    began = time.time()
    found = {r["ref_id"]: r["node_id"] for r in extract.resolve_by_name(refs, cands).collect()}
    assert len(found) == n and all(found[str(i)] == (7, 12, 0)[i % 3] for i in range(n))
    assert time.time() - began < 20


def test_files_of_a_model_that_hold_one_node_do_not_multiply(spark):
    n = 40_000  # pairs of the node and what it holds would be 1.6 billion
    nodes = spark.range(n).selectExpr("'m' as model_id", "explode(array('canvas', concat('c', id))) as node_id").selectExpr("*", "if(node_id = 'canvas', null, 'canvas') as parent_id")
    began = time.time()
    found = extract.containment(nodes)
    assert found.count() == n and found.where("edge_id = 'contains:canvas->c7' and source_id = 'canvas' and target_id = 'c7'").count() == 1
    assert time.time() - began < 20


def test_shreds_hand_over_only_what_is_read(spark):
    df = spark.createDataFrame([("m", '<model id="1"><documentation>d</documentation><folder type="business"><element id="2"/></folder></model>'), ("bad", "<no")], "model_id string, text string")
    whole = extract.shred(df, "archimate")
    few = extract.shred(df, "archimate", columns=extract.HEADER_COLUMNS, most_depth=1)
    assert few.columns == extract.HEADER_COLUMNS and sorted(few.collect(), key=str) == sorted(whole.where("depth < 2").select(few.columns).collect(), key=str)
    assert extract.header(few).collect() == extract.header(whole).collect()
    lean = extract.shred(df, "archimate", columns=extract.ARCHIMATE_COLUMNS)
    for a, b in zip(extract.archimate(lean), extract.archimate(whole)):
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_pairs_of_references_are_numbered_without_moving_them(spark):
    df = spark.createDataFrame([("m", "d", " a  b ", "x y"), ("m", "e", "a", "z"), ("m", "e", "b", "z"), ("m", "f", "", "z"), ("m", "g", None, "z")], "model_id string, id string, s string, t string")
    out = extract.directed_edges(df, "s", "t")
    assert sorted(map(tuple, out.collect())) == [
        ("m", "d", "a", "x"), ("m", "d__1", "a", "y"), ("m", "d__2", "b", "x"), ("m", "d__3", "b", "y"), ("m", "e", "a", "z"), ("m", "e__1", "b", "z"),
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")  # pairs are made of numbered rows: the plan is printed from the top


def test_small_models_are_dealt_out_to_tasks_of_bounded_edges(spark):
    edges = spark.range(300_000).selectExpr("concat('m', id % 3000) as model_id", "concat('a', id) as u", "concat('b', id) as v")
    small, large = graph._dealt(edges, graph.MOST_EDGES)
    assert large is None and max(r["count"] for r in small.groupBy("task").count().collect()) < 150_000


def some_archimate(rng, depth):
    tag = rng.choice(["folder", "folder", "element", "element", "documentation", "a:element"])
    said = [("type", ["business", "connectors", "relations"]), ("xsi:type", ["archimate:X", "connectors"]), ("id", ["a", "b", ""]), ("a:type", ["connectors"]), ("name", ["n &amp; m"]), ("source", ["s"]), ("target", ["t"])]
    attrs = "".join(f' {k}="{rng.choice(v)}"' for k, v in said if rng.random() < 0.8)
    text = lambda: rng.choice(["", " ", "x", " y <!-- c --> z ", "<![CDATA[<]]>"])
    inner = "".join(text() + (some_archimate(rng, depth - 1) if depth and rng.random() < 0.7 else "") for _ in range(rng.randrange(5))) + text()
    return f"<{tag}{attrs}>{inner}</{tag}>"


def test_nodes_and_relations_of_archimate_come_without_other_elements_or_joins(spark):
    rng = random.Random(4)
    top = f'<m xmlns:a="urn:a" {XSI}>'
    held = lambda: f'<folder type="{rng.choice(["business", "connectors", "relations"])}">{some_archimate(rng, 3)}{some_archimate(rng, 0)}</folder>'
    texts = [top + "".join(rng.choice([some_archimate(rng, 4), held(), held()]) for _ in range(rng.randrange(6))) + "</m>" for _ in range(600)]
    texts += [t[:-2] for t in texts[:20]] + ["", None, top + '<folder type="other">' + '<element id="e" xsi:type="t"/>' * 30_000 + "</folder></m>", top + '<folder type="other">' + "<element/>" * 30_000]
    df = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(texts)], "model_id string, text string")
    nodes, edges, warnings = extract.archimate(graph.cut(extract.shred(df, "archimate")))
    rows = [extract.shred(df, f"archimate-{kind}") for kind in ("nodes", "relations")]
    for found, want in ((extract.archimate_nodes(rows[0]), nodes), (extract.archimate_edges(rows[1], {"X": "Y"}), edges.withColumn("type", F.replace("type", F.lit("X"), F.lit("Y"))))):
        got = sorted(map(str, found.collect()))
        assert got == sorted(map(str, want.collect())) and len(got) > 10
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows[0].where("error is not null").count() == warnings.where("warning_type = 'PARSE_ERROR'").count() == 23
    part = '<folder name="f"><element xsi:type="t" id="p%d"><documentation> d </documentation></element></folder>'
    few = spark.createDataFrame([("m", top + '<folder type="business">' + "".join(part % i for i in range(50)) + '</folder><folder type="relations"><element id="r"/></folder></m>')], "model_id string, text string")
    lean = extract.shred(few, "archimate-nodes", columns=extract.NODE_COLUMNS)
    assert lean.count() == 50 and extract.shred(few, "archimate").count() == 154  # what is handed over
    assert {r["documentation"] for r in extract.archimate_nodes(lean).collect()} == {"d"}


def test_ecore_nodes_do_not_rank_edges_and_do_not_broadcast_a_row_for_each_model(spark):
    ecore = '<ecore:EPackage xmlns:ecore="http://www.eclipse.org/emf/2002/Ecore" %s name="p%d"><eClassifiers xsi:type="ecore:EClass" name="A" eSuperTypes="o.ecore#//B #//A"><eStructuralFeatures xsi:type="ecore:EReference" name="r" eType="o.ecore#//C"/><eStructuralFeatures xsi:type="ecore:EReference" name="s" eType="o.ecore#//C"/><eStructuralFeatures xsi:type="ecore:EAttribute" name="t" eType="o.ecore#//D"/></eClassifiers></ecore:EPackage>'
    df = spark.createDataFrame([(f"m{i}", ecore % (XSI, i)) for i in range(40)], "model_id string, text string")
    nodes, edges, warnings = extract.ecore(extract.shred(df, "xml", columns=extract.ECORE_COLUMNS))
    outside = nodes.where("external").select("node_id", "type", "name", "ns_uri")
    assert sorted(map(tuple, outside.distinct().collect())) == [("o.ecore#//B", "EClass", "B", "o.ecore"), ("o.ecore#//C", "EClass", "C", "o.ecore"), ("o.ecore#//D", "EDataType", "D", "o.ecore")]
    assert outside.count() == 120 and nodes.count() == 120 + 40 * 3 and edges.count() == 40 * 6 and [r["warning_type"] for r in warnings.collect()] == ["DUPLICATE_ID"] * 40
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(model_id" in plan and "edge_id" not in plan and "strategy=merge" in plan
