"""Queries of cyclic containment, nested and repeated elements, table functions, exact percentiles, field samples and whole
runs; registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataprof.functions import stats
from strataprof.operators import constructs, extract, graph, labels, report, scan, size, views
from strataprof.plans import bindings as b
from strataprof.plans.catalog import big, query, r, summed
from strataprof.plans.more import _XSI
from strataprof.sources import files as sources

# --- cyclic containment: a customer's orders hold each other in a ring; of odd customers the first stands before it ---

_RING = """ring AS (SELECT 'c' || o_custkey AS model_id, o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
  rd AS (SELECT model_id, 'o' || k AS node_id, CASE WHEN c % 2 = 0 THEN m WHEN j = 1 THEN 0 WHEN j = 2 THEN m ELSE j - 1 END AS depth, c % 2 = 0 OR j = 1 AS is_root FROM ring)"""


def _ring(spark, sf):
    o = b.read(spark, sf, "orders")
    per = W.partitionBy("o_custkey")
    at = o.select("o_custkey", "o_orderkey", F.row_number().over(per.orderBy("o_orderkey")).alias("j"), F.count("*").over(per).alias("m"), F.lead("o_orderkey").over(per.orderBy("o_orderkey")).alias("next"))
    start = F.when(F.col("o_custkey") % 2 == 0, 1).otherwise(2)
    at = at.withColumn("entry", F.max(F.when(F.col("j") == start, F.col("o_orderkey"))).over(per))
    model, ident = F.concat(F.lit("c"), "o_custkey").alias("model_id"), lambda c: F.concat(F.lit("o"), c)
    nodes = at.select(model, ident("o_orderkey").alias("node_id"), F.lit("Order").alias("type"))
    edges = at.select(
        model, ident("o_orderkey").alias("edge_id"), ident("o_orderkey").alias("source_id"), ident(F.coalesce("next", "entry")).alias("target_id"), F.lit("contains").alias("type"), F.create_map().cast("map<string,string>").alias("data")
    ).where("target_id is not null")
    return at.select(model, F.lit("UML").alias("language")).distinct(), nodes, edges


@query("containment_cycles", "SELECT model_id, node_id, depth, is_root FROM rd", _RING)
def _(spark, sf):
    m, n, e = _ring(spark, sf)
    return graph.containment_depth(n, e, m)


@query("containment_cycles_tables", "SELECT model_id, node_id, depth, is_root FROM rd", _RING)
def _(spark, sf):
    """The same by rounds over tables, the way of models that no task should hold."""
    m, n, e = _ring(spark, sf)
    return graph.containment_depth(n, e, m, most_edges=0)


@query("containment_cycles_per_model", f"SELECT model_id, {big('max(depth)', 'max_depth')}, {r('avg(depth)', 'mean_depth')}, {r('median(depth)', 'median_depth')}, {big('count(*) FILTER (is_root)', 'roots')}, count(*) FILTER (depth > 0) AS contained FROM rd GROUP BY model_id", _RING)
def _(spark, sf):
    return size.containment_per_model(*_ring(spark, sf)).select("model_id", "max_depth", "mean_depth", "median_depth", "roots", "contained")


# --- Ecore: where data types come from, supertypes of all kinds, nested annotations ----------------------------------

_ECORE = "http://www.eclipse.org/emf/2002/Ecore"


def _xmi_ecore_files(spark, sf):
    """Fifty parts are a file with a package, a data type beside it, and one that a note holds in a package of its own."""
    p = b.read(spark, sf, "part").dropDuplicates(["p_partkey"])
    k = F.col("p_partkey")
    types = F.when(k % 4 == 0, F.format_string('<eClassifiers xsi:type="ecore:EDataType" name="T%d"/>', k)).when(
        k % 4 == 1, F.format_string('<eSubpackages name="s%d"><eClassifiers xsi:type="ecore:EEnum" name="T%d"/></eSubpackages>', k, k)
    ).when(k % 4 == 2, F.format_string('<eAnnotations source="held"><contents xsi:type="ecore:EPackage" name="far" nsURI="http://far"><eClassifiers xsi:type="ecore:EDataType" name="T%d"/></contents></eAnnotations>', k)).otherwise("")
    supers = F.when(k % 4 == 0, "#//Base").when(k % 4 == 1, "#//Base #/0/Other").when(k % 4 == 2, "#//Base  #//Other #/1/Third").otherwise("ecore:EClass http://x#//Far #//Base ecore:EClass y.ecore#//Z")
    note = F.format_string(
        '<eAnnotations source="doc"><details key="brand" value="%s"/><details key="kept" value="outer"/><eAnnotations source="doc"><details key="kept" value="inner"/></eAnnotations><eAnnotations><details key="size" value="%d"/></eAnnotations></eAnnotations><eAnnotations source="bare"/>',
        F.col("p_brand"), F.col("p_size"),
    )
    body = F.concat(F.format_string('<eClassifiers xsi:type="ecore:EClass" name="P%d" eSuperTypes="', k), supers, F.lit('">'), note, F.lit("</eClassifiers>"), types)
    beside = F.when(k % 4 == 3, F.format_string('<ecore:EDataType name="T%d"/>', k)).otherwise("")
    per = p.groupBy(F.concat(F.lit("x"), F.floor(k / 50)).alias("model_id")).agg(
        F.array_join(F.sort_array(F.collect_list(body)), "").alias("body"), F.array_join(F.sort_array(F.collect_list(beside)), "").alias("beside")
    )
    head = f'<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:ecore="{_ECORE}" {_XSI}><ecore:EAnnotation source="file"><details key="by" value="hand"/></ecore:EAnnotation><ecore:EPackage name="pk"><eClassifiers xsi:type="ecore:EClass" name="Base"/><eClassifiers xsi:type="ecore:EClass" name="Other"/>'
    second = '</ecore:EPackage><ecore:EPackage name="two"><eClassifiers xsi:type="ecore:EClass" name="Third"/></ecore:EPackage>'
    return per.select("model_id", F.concat(F.lit(head), "body", F.lit(second), "beside", F.lit("</xmi:XMI>")).alias("text"))


def _xmi_ecore(spark, sf):
    return graph.cut(extract.shred(_xmi_ecore_files(spark, sf), "xml", columns=extract.ECORE_COLUMNS))


_XP = "xp AS (SELECT DISTINCT 'x' || CAST(floor(p_partkey / 50) AS BIGINT) AS model_id, p_partkey AS k, p_size, p_brand FROM part)"


@query("extract_data_type_origin", f"""SELECT model_id, 'T' || k AS name, k % 4 > 1 AS external, CASE k % 4 WHEN 2 THEN 'http://far' WHEN 3 THEN '{_ECORE}' END AS ns_uri, CASE k % 4 WHEN 2 THEN 'far' WHEN 3 THEN 'ecore' END AS package_name FROM xp""", _XP)
def _(spark, sf):
    e = _xmi_ecore(spark, sf)
    return extract.data_type_origin(e).join(e.select("model_id", "seq", F.col("attrs")["name"].alias("name")), ["model_id", "seq"]).select("model_id", "name", "external", "ns_uri", "package_name")


@query("extract_ecore_supertypes", """SELECT model_id, 'pk/P' || k AS source_id, unnest(CASE k % 4 WHEN 0 THEN ['pk/Base'] WHEN 1 THEN ['pk/Base', 'pk/Other'] WHEN 2 THEN ['pk/Base', 'pk/Other', 'two/Third'] ELSE ['http://x#//Far', 'pk/Base', 'y.ecore#//Z'] END) AS target_id FROM xp""", _XP)
def _(spark, sf):
    return extract.ecore(_xmi_ecore(spark, sf))[1].where("type = 'Generalization'").select("model_id", "source_id", "target_id")


@query("extract_ecore_externals", f"""SELECT DISTINCT model_id, unnest(['http://x#//Far', 'y.ecore#//Z']) AS node_id, 'EClass' AS type, true AS external, unnest(['http://x', 'y.ecore']) AS ns_uri FROM xp WHERE k % 4 = 3
  UNION ALL SELECT model_id, CASE k % 4 WHEN 2 THEN 'pk/far/T' WHEN 3 THEN 'T' END || k, 'EDataType', true, CASE k % 4 WHEN 2 THEN 'http://far' WHEN 3 THEN '{_ECORE}' END FROM xp WHERE k % 4 > 1""", _XP)
def _(spark, sf):
    return extract.ecore(_xmi_ecore(spark, sf))[0].where("external").select("model_id", "node_id", "type", "external", "ns_uri")


@query("extract_annotations_nested", """SELECT model_id, 'P' || k AS owner, s AS source, CASE s WHEN 'doc' THEN p_brand END AS brand, CASE s WHEN 'doc' THEN 'inner' END AS kept, CASE s WHEN '' THEN CAST(p_size AS VARCHAR) END AS size, NULL::VARCHAR AS by, CASE s WHEN 'doc' THEN 2 WHEN '' THEN 1 ELSE 0 END AS n
  FROM xp, unnest(['doc', '', 'bare']) AS t(s) UNION ALL SELECT DISTINCT model_id, NULL, 'file', NULL, NULL, NULL, 'hand', 1 FROM xp
  UNION ALL SELECT DISTINCT model_id, 'pk', 'held', NULL, NULL, NULL, NULL, 0 FROM xp WHERE k % 4 = 2""", _XP)
def _(spark, sf):
    e = _xmi_ecore(spark, sf)
    names = e.select("model_id", F.col("seq").alias("owner_seq"), F.col("attrs")["name"].alias("owner"))
    d = F.col("data")
    return extract.annotations(e).join(names, ["model_id", "owner_seq"], "left").select("model_id", "owner", "source", *[d[c].alias(c) for c in ("brand", "kept", "size", "by")], F.size("data").alias("n"))


# --- XMI with repeated ids: the first type and name stand, data is filled, conflicts are told of ----------------------


def _repeats(spark, sf):
    o = b.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    first = F.format_string('<packagedElement xsi:type="uml:Class" xmi:id="o%d" isLeaf="a"', k)
    first = F.concat(first, F.when(k % 2 == 0, F.format_string(' name="%s"', F.col("o_orderpriority"))).otherwise(""), F.lit("/>"))
    again = F.concat(F.lit("<packagedElement xsi:type=\"uml:"), F.when(k % 3 == 0, "Interface").otherwise("Class"), F.format_string('" xmi:id="o%d" name="later" isLeaf="b" isAbstract="c"/>', k))
    last = F.when(k % 5 == 0, F.format_string('<packagedElement xsi:type="uml:Class" xmi:id="o%d" name="later"/>', k)).otherwise("")
    per = o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(first, again, last))), "").alias("body"))
    head = '<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:uml="u" ' + _XSI + '><uml:Model xmi:id="m">'
    return graph.cut(extract.shred(per.select(F.concat(F.lit("c"), "o_custkey").alias("model_id"), F.concat(F.lit(head), "body", F.lit("</uml:Model></xmi:XMI>")).alias("text")), "xml"))


_RO = "ro AS (SELECT 'c' || o_custkey AS model_id, o_orderkey AS k, o_orderpriority AS pr FROM orders)"


@query("extract_uml_repeats", "SELECT model_id, 'o' || k AS node_id, 'Class' AS type, CASE WHEN k % 2 = 0 THEN pr ELSE 'later' END AS name, 'a' AS leaf, 'c' AS abstract FROM ro", _RO)
def _(spark, sf):
    d = F.col("data")
    return extract.uml(_repeats(spark, sf))[0].select("model_id", "node_id", "type", "name", d["isLeaf"].alias("leaf"), d["isAbstract"].alias("abstract"))


@query("extract_uml_repeat_warnings", """SELECT model_id, 'DUPLICATE_ID' AS warning_type, 'o' || k AS msg, true AS is_skip FROM ro WHERE k % 3 = 0 OR k % 2 = 0
  UNION ALL SELECT model_id, 'DUPLICATE_ID', 'o' || k, true FROM ro WHERE k % 5 = 0 AND k % 2 = 0""", _RO)
def _(spark, sf):
    return extract.uml(_repeats(spark, sf))[2].select("model_id", "warning_type", "msg", "is_skip")


# --- BPMN by levels: each order holds a task that all orders of the customer name alike, and a shape without an id -----


def _nested_shapes(spark, sf):
    def obj(kind: str, ident, *more):
        return F.struct(ident.alias("resourceId"), F.struct(F.lit(kind).alias("id")).alias("stencil"), *more)

    o = b.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    leaf = obj("Task", F.concat(F.lit("leaf"), k))
    shared = obj("Task", F.concat(F.lit("same"), "o_custkey"), F.array(leaf).alias("childShapes"))
    lost = F.struct(F.lit(None).cast("string").alias("resourceId"), F.struct(F.lit("Task").alias("id")).alias("stencil"), F.array(obj("Task", F.concat(F.lit("in"), k))).alias("childShapes"))
    task = obj("Pool", F.concat(F.lit("o"), k), F.struct(F.col("o_orderstatus").alias("name")).alias("properties"), F.array(F.to_json(shared), F.to_json(lost)).alias("held"))
    text = F.concat(F.format_string('{"resourceId":"o%d","stencil":{"id":"Pool"},"properties":{"name":"%s"},"childShapes":[', k, F.col("o_orderstatus")), F.array_join(task["held"], ","), F.lit("]}"))
    per = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", text.alias("t")))).alias("x"))
    return per.select(F.concat(F.lit("c"), "o_custkey").alias("model_id"), F.concat(F.lit('{"resourceId":"canvas","stencil":{"id":"BPMNDiagram"},"childShapes":['), F.array_join(F.col("x.t"), ","), F.lit("]}")).alias("text"))


_SHAPES = """WITH s AS (SELECT 'c' || o_custkey AS model_id, o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j FROM orders),
  t AS (SELECT DISTINCT model_id, 'canvas' AS shape_id, NULL AS parent_id, NULL AS name, NULL AS error, 0 AS seq FROM s
    UNION ALL SELECT model_id, 'o' || k, 'canvas', st, NULL, CASE WHEN j = 1 THEN 1 ELSE 5 + 3 * (j - 2) END FROM s
    UNION ALL SELECT model_id, 'same' || c, 'o' || k, NULL, CASE WHEN j > 1 THEN 'DUPLICATE_ID' END, CASE WHEN j = 1 THEN 2 ELSE 6 + 3 * (j - 2) END FROM s
    UNION ALL SELECT model_id, 'leaf' || k, 'same' || c, NULL, NULL, 3 FROM s WHERE j = 1
    UNION ALL SELECT model_id, NULL, 'o' || k, NULL, 'MISSING_ATTRIBUTE', CASE WHEN j = 1 THEN 4 ELSE 7 + 3 * (j - 2) END FROM s)
SELECT * FROM t"""


@query("extract_bpmn_by_levels", _SHAPES)
def _(spark, sf):
    return extract.bpmn_shapes(_nested_shapes(spark, sf)).select("model_id", "shape_id", "parent_id", "name", "error", "seq")


@query("extract_bpmn_by_walk", _SHAPES)
def _(spark, sf):
    return extract.shred(_nested_shapes(spark, sf), "bpmn-json").select("model_id", "shape_id", "parent_id", "name", "error", "seq")


# --- an extractor of one's own, as a table function ----------------------------------------------------------------


def _words(model_id: str, text: str):
    """Words of a text with their places, as an extractor that a user might register."""
    for i, word in enumerate(text.split(" ")):
        yield model_id, i, word


@query("extract_table_function", "SELECT 'p' || p_partkey AS model_id, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part")
def _(spark, sf):
    extract.register_extractor("words", _words, "model_id string, place int, word string")
    name = extract.register_udtf(spark, "words")
    files = b.read(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("model_id"), F.col("p_name").alias("text"))
    return spark.sql(f"SELECT t.model_id, t.word, t.place FROM {{files}} f, LATERAL {name}(f.model_id, f.text) t", files=files)


@query("extract_table_function_xml", "SELECT DISTINCT model_id, 'EClass' AS kind, 'P' || k AS name FROM xp UNION ALL SELECT DISTINCT model_id, 'EClass', unnest(['Base', 'Other', 'Third']) FROM xp", _XP)
def _(spark, sf):
    name = extract.register_udtf(spark, "xml-flat")
    found = spark.sql(f"SELECT t.model_id, t.attrs FROM {{files}} f, LATERAL {name}(f.model_id, f.text) t", files=_xmi_ecore_files(spark, sf))
    return found.where("attrs['xsi:type'] = 'ecore:EClass'").select("model_id", F.lit("EClass").alias("kind"), F.col("attrs")["name"].alias("name"))


# --- percentiles of columns of any length ---------------------------------------------------------------------------


@query("stats_large_summary", "SELECT " + ", ".join(summed(c, p) for c, p in (("l_extendedprice", "price"), ("l_quantity", "quantity"), ("l_discount", "discount"))) + " FROM lineitem")
def _(spark, sf):
    """Bounds are narrowed until a thousand values are left, as at a size where no task could count all."""
    return stats.large_summary(b.read(spark, sf, "lineitem"), {"l_extendedprice": "price", "l_quantity": "quantity", "l_discount": "discount"}, most_values=1000, accuracy=200)


# --- labels of bins -------------------------------------------------------------------------------------------------

_WIDTHS = """w AS (SELECT min(CAST(o_totalprice AS DOUBLE)) AS mn, max(CAST(o_totalprice AS DOUBLE)) AS mx FROM orders), d AS (SELECT mn, mx, (mx - mn) / 12 AS wd, greatest(0, 1 - floor(log10((mx - mn) / 12))) AS places FROM w),
  c AS (SELECT least(CAST(floor((CAST(o_totalprice AS DOUBLE) - mn) / wd) AS INTEGER), 11) AS i, count(*) AS n FROM orders, d GROUP BY 1)"""


@query("report_bin_labels", """SELECT g.i AS bin_idx, CAST(round_even(mn + g.i * wd, 0) AS BIGINT) || '-' || CAST(round_even(CASE WHEN g.i = 11 THEN mx ELSE mn + (g.i + 1) * wd END, 0) AS BIGINT) AS bin, coalesce(n, 0) AS count
  FROM d, (SELECT unnest(range(12)) AS i) AS g LEFT JOIN c ON c.i = g.i""", _WIDTHS)
def _(spark, sf):
    bins = stats.histogram(b.read(spark, sf, "orders"), "o_totalprice", bins=12)
    return stats.bin_labels(bins).select("bin_idx", "bin", "count")


# --- fields of a wide table with a sample of each -------------------------------------------------------------------

_PART = [("p_partkey", "number"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "number")]


@query("view_field_samples", " UNION ALL ".join(
    f"SELECT '{c}' AS field, '{k}' AS type, min(CAST({c} AS VARCHAR)) AS sample, count(*) AS n, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = count({c}) AS is_unique FROM part" for c, k in _PART
) + " UNION ALL SELECT 'odd', 'number', min(CAST(p_size AS VARCHAR)) FILTER (p_size % 2 = 1), count(*), count(*) FILTER (p_size % 2 = 1), count(DISTINCT p_size) FILTER (p_size % 2 = 1), count(DISTINCT p_size) FILTER (p_size % 2 = 1) = count(*) FILTER (p_size % 2 = 1) FROM part")
def _(spark, sf):
    odd = F.when(F.col("p_size") % 2 == 1, F.col("p_size")).alias("odd")
    return views.field_catalog(b.read(spark, sf, "part").select(*[c for c, _ in _PART], odd))


# --- whole runs -----------------------------------------------------------------------------------------------------


def _scan_run(spark, sf):
    path = sources.shared_folder(spark, "scan")
    found = scan.scan(b.files(spark, sf), include=b.INCLUDE, exclude=["src1/de/**"], limit_mb=0.005).select("relpath", "length", "status")
    sources.write_run(spark, path, {"scan_files": found, "scan_totals": scan.totals(found)}, source="documents")
    return path


@query("sink_scan_record", "SELECT relpath, length, status FROM scanned", b.FILES)
def _(spark, sf):
    return sources.read_run(spark, _scan_run(spark, sf), "scan_files")


@query("sink_manifest", "SELECT 'scan_files' AS name, 'documents' AS source, 'parquet' AS format, count(*) AS rows, true AS has_bytes FROM scanned UNION ALL SELECT 'scan_totals', 'documents', 'parquet', 1, true", b.FILES)
def _(spark, sf):
    return sources.manifest(spark, _scan_run(spark, sf)).select("name", "source", "format", "rows", (F.col("bytes") > 0).alias("has_bytes"))


@query("sink_graph_origin", "SELECT model_id, 'corpus/' || model_id || '.xmi' AS source_path, model_id || '.xmi' AS source_relpath, CAST(10 * length(model_id) AS VARCHAR) AS filesize FROM gm", b.GRAPH)
def _(spark, sf):
    """Each graph keeps the path and the size of the file that it is from."""
    m, n, e = b.graph(spark, sf)
    path = sources.shared_folder(spark, "graphs")
    rel = F.concat("model_id", F.lit(".xmi"))
    origin = m.select("model_id", F.concat(F.lit("corpus/"), rel).alias("source_path"), rel.alias("source_relpath"), (F.length("model_id") * 10).alias("filesize"))
    sources.write_graphs(m, n.withColumn("name", F.lit("")), e, path, origin)
    d = F.col("data")
    return sources.read_graphs(spark, path, lines=True)[0].select("model_id", *[d[c].alias(c) for c in ("source_path", "source_relpath", "filesize")])


@query("sink_graph_sizes", "SELECT count(*) AS models, count(*) FILTER (n > 0) AS sized FROM (SELECT gm.model_id, 1 AS n FROM gm) AS q", b.GRAPH)
def _(spark, sf):
    m, n, e = b.graph(spark, sf)
    graphs, run = sources.shared_folder(spark, "graphs"), sources.shared_folder(spark, "sizes")
    sizes = sources.write_graphs(m, n.withColumn("name", F.lit("")), e, graphs)
    sources.write_run(spark, run, {"graph_sizes": sizes}, source=graphs, fmt="json")
    back = sources.read_run(spark, run, "graph_sizes")
    return back.join(m.select("model_id"), "model_id").agg(F.count("*").alias("models"), F.count_if(F.col("file_size_bytes_ir") > 0).alias("sized"))


@query("sink_report_tables", """SELECT 'status' AS report, parse_status AS key, count(*) AS n FROM diag GROUP BY ALL
  UNION ALL SELECT 'skipped', CASE WHEN elements_skipped > 0 THEN 'some' ELSE 'none' END, count(*) FROM ok GROUP BY ALL""", b.DIAGNOSTICS)
def _(spark, sf):
    """Tables of a report, written as one run and read back; the run before it is not what a reader gets."""
    d = b.diagnostics(spark, sf)
    path = sources.shared_folder(spark, "report")
    ok = d.where("parse_status <> 'failure'")
    tables = {
        "status": d.groupBy(F.col("parse_status").alias("key")).agg(F.count("*").alias("n")),
        "skipped": ok.groupBy(F.when(F.col("elements_skipped") > 0, "some").otherwise("none").alias("key")).agg(F.count("*").alias("n")),
    }
    sources.write_run(spark, path, {k: v.limit(0) for k, v in tables.items()}, fmt="json")
    sources.write_run(spark, path, tables, fmt="json")
    both = [sources.read_run(spark, path, k).select(F.lit(k).alias("report"), "key", "n") for k in tables]
    return both[0].unionByName(both[1])


# --- labels of any type, projections of catalogs, times with sizes, concepts by their specs ---------------------------


@query("labels_of_any_type", """SELECT 'p' || p_partkey AS node_id, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_name WHEN p_size % 3 = 0 THEN NULL
  WHEN p_size % 4 = 2 AND p_partkey % 2 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS label FROM part""")
def _(spark, sf):
    """Names that are numbers end the search; null names, and numbers in the data, are passed over."""
    k = F.col("p_size")
    name = F.when(k % 4 == 0, F.concat(F.lit('"name":'), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit('"name":"'), "p_name", F.lit('"'))).otherwise('"name":null')
    label = F.when(k % 3 == 0, ',"label":{"no":"text"}').otherwise("")
    inner = F.when((k % 4 == 2) & (F.col("p_partkey") % 2 == 0), F.concat(F.lit('"label":"'), "p_brand", F.lit('"'))).otherwise('"label":17')
    title = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',"title":"'), "p_type", F.lit('"')))
    of = lambda *c: F.parse_json(F.concat(F.lit("{"), *c, F.lit("}")))
    rows = b.read(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), of(name, label).alias("fields"), of(inner, title).alias("data"))
    return rows.select("node_id", labels.resolve_variant(F.col("fields"), F.col("data")).alias("label"))


@query("constructs_projection", """SELECT p_type || p_size AS id, any_value('a ' || p_type) AS description, CASE WHEN p_size % 2 = 0 THEN 'node_type' ELSE 'edge_type' END AS kind, lower(p_type) AS match_type,
  CASE WHEN p_size % 3 = 0 THEN '—' ELSE 'g' || p_size END AS "group", CASE WHEN p_size % 3 = 0 THEN '' ELSE 'category=g' || p_size END AS meta FROM part GROUP BY p_type, p_size""")
def _(spark, sf):
    k = F.col("p_size")
    meta = F.when(k % 3 != 0, F.create_map(F.lit("category"), F.concat(F.lit("g"), k)))
    rows = b.read(spark, sf, "part").select("p_type", "p_size").distinct().select(
        F.concat("p_type", "p_size").alias("id"), F.when(k % 2 == 0, "node_type").otherwise("edge_type").alias("kind"), F.lower("p_type").alias("match_type"), F.concat(F.lit("a "), "p_type").alias("description"), meta.alias("meta")
    )
    unknown = rows.limit(1).withColumn("id", F.lit("UNKNOWN_NODE"))
    text = F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return constructs.projection(rows.unionByName(unknown)).withColumn("meta", text)


@query("report_time_with_size", """SELECT l.model_id, s.size AS x, l.ms AS y FROM (SELECT 'o' || l_orderkey AS model_id, CAST(sum(l_quantity) AS BIGINT) AS ms FROM lineitem GROUP BY ALL) AS l
  JOIN (SELECT 'o' || o_orderkey AS model_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS size FROM orders WHERE o_orderstatus <> 'F') AS s ON s.model_id = l.model_id WHERE s.size > 0 AND l.ms > 0""")
def _(spark, sf):
    """Times come with lines, sizes with orders that are not closed; of every third order the size is not known."""
    li, o = b.read(spark, sf, "lineitem"), b.read(spark, sf, "orders")
    times = li.groupBy(F.concat(F.lit("o"), "l_orderkey").alias("model_id")).agg(F.sum("l_quantity").cast("long").alias("parse_time_ms"))
    size_of = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.floor("o_totalprice"))
    sizes = o.where("o_orderstatus <> 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("model_id"), size_of.alias("file_size_bytes_source"))
    return report.time_with_size(times, sizes)


_SPEC = extract.UML_LISTS + [("Class", "name", False, None), ("Class", "isAbstract", False, "abstract")]


def _concept_files(spark, sf):
    """A customer is a file: a class, and for each order a template parameter with classifiers in a list."""
    o = b.read(spark, sf, "orders")
    order = F.concat(F.lit('<p xmi:type="uml:ClassifierTemplateParameter" xmi:id="o'), "o_orderkey", F.lit('" signature="s" constrainingClassifier="'), "o_orderstatus", F.lit("  c"), F.col("o_orderkey") % 7, F.lit('" note="'), F.col("o_orderkey") % 5, F.lit('"/>'))
    head = F.concat(F.lit('<m xmlns:xmi="http://schema.omg.org/spec/XMI/2.1"><p xmi:type="uml:Class" xmi:id="k" name="K" isAbstract="true"><odd/><Extension/>'))
    return o.groupBy("o_custkey").agg(F.concat(head, F.array_join(F.sort_array(F.collect_list(order)), ""), F.lit("</p></m>")).alias("text")).select(F.concat(F.lit("c"), "o_custkey").alias("model_id"), "text")


@query("extract_concept_payload", """SELECT 'c' || o_custkey AS model_id, 'ClassifierTemplateParameter' AS concept, 'constrainingClassifierRefs=' || o_orderstatus || '+c' || (o_orderkey % 7) || ',signature=s' AS data, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT DISTINCT 'c' || o_custkey, 'Class', 'abstract=true,name=K', 1 FROM orders""")
def _(spark, sf):
    found = extract.concept_payload(extract.shred(_concept_files(spark, sf), "xml"), spark.createDataFrame(_SPEC, extract.SPEC))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("data"), lambda e: F.concat_ws("=", e.key, F.array_join(e.value, "+")))), ",")
    return found.groupBy("model_id", "concept", text.alias("data")).agg(F.count("*").alias("n"))


@query("extract_concept_unhandled", """SELECT 'c' || o_custkey AS model_id, 'UNHANDLED_ATTRIBUTE' AS warning_type, 'ClassifierTemplateParameter(o' || o_orderkey || ')@note=' || (o_orderkey % 5) AS msg FROM orders
  UNION ALL SELECT DISTINCT 'c' || o_custkey, 'UNHANDLED_CHILD', 'Class/odd' FROM orders""")
def _(spark, sf):
    rows = graph.cut(extract.shred(_concept_files(spark, sf), "xml"))
    odd = extract.unhandled_by_concept(rows, spark.createDataFrame(_SPEC, extract.SPEC))
    children = extract.unhandled_children_by_concept(rows, spark.createDataFrame([("Class", "ownedAttribute")], "concept string, child string"), ["ClassifierTemplateParameter"])
    return odd.unionByName(children).select("model_id", "warning_type", "msg")
