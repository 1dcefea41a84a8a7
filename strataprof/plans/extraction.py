"""Queries of extraction from XMI, Ecore and ArchiMate texts made of the given tables, and of sources and sinks; registered
beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataprof.operators import extract, graph, parsing, size
from strataprof.plans import bindings as b
from strataprof.plans.catalog import _SIZE, big, query, r
from strataprof.plans.more import _XSI, _archimate_files
from strataprof.sources import files as sources

# --- XMI: a customer is a model; an order is a class, a state, a transition, and by its number more ---------------


def _xmi_files(spark, sf):
    o = b.read(spark, sf, "orders")
    k = F.col("o_orderkey")

    def when(test, text: str, *args):
        return F.when(test, F.format_string(text, *(args or [k] * text.count("%d")))).otherwise("")

    parts = [
        F.format_string('<packagedElement xsi:type="uml:Class" xmi:id="o%d" name="%s" isAbstract="false"><ownedAttribute xmi:id="a%d" name="total" type="b" visibility="public"/>', k, F.col("o_orderpriority"), k),
        when(k % 2 == 0, '<ownedOperation xmi:id="m%d" name="pay"/>'),
        when(k % 3 == 0, '<generalization xmi:id="g%d" general="b"/>'), when(k % 3 == 1, '<generalization general="x%d"/>'), F.lit("</packagedElement>"),
        F.format_string('<subvertex xsi:type="uml:%s" xmi:id="s%d" name="s"/>', F.when(F.col("o_orderstatus") == "P", "Strange").otherwise("State"), k),
        F.format_string('<transition xmi:id="t%d" %starget="o%d b"/>', k, F.when(k % 7 == 0, "").otherwise(F.format_string('source="s%d" ', k)), k),
        when(k % 5 == 0, '<packagedElement xsi:type="uml:Association" xmi:id="as%d" memberEnd="e%d f%d"><ownedEnd xmi:id="e%d" type="o%d"/><ownedEnd xmi:id="f%d" type="b" aggregation="composite"/></packagedElement>'),
        when(k % 5 == 1, '<packagedElement xsi:type="uml:Association" xmi:id="as%d" memberEnd="e%d z%d"><ownedEnd xmi:id="e%d" type="o%d"/></packagedElement>'),
        when(k % 11 == 0, '<packagedElement xsi:type="uml:UseCase" xmi:id="u%d" name="u"><extensionPoint xmi:id="p%d" name="late"/></packagedElement><packagedElement xsi:type="uml:UseCase" xmi:id="v%d"><extend xmi:id="w%d" extension="v%d" extendedCase="u%d" '),
        F.when(k % 11 == 0, F.format_string('extensionLocation="%s%d"/></packagedElement>', F.when(k % 2 == 0, "p").otherwise("lost"), k)).otherwise(""),
    ]
    per = o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(*parts))), "").alias("body"))
    head = (
        '<xmi:XMI xmlns:xmi="http://schema.omg.org/spec/XMI/2.1" xmlns:uml="http://www.eclipse.org/uml2/5.0.0/UML" ' + _XSI + '><uml:Model xmi:id="m" name="n">'
        '<packagedElement xsi:type="uml:Package" xmi:id="pk" name="all"><packagedElement xsi:type="uml:Class" xmi:id="b" name="base"/>'
    )
    return per.select(F.concat(F.lit("c"), "o_custkey").alias("model_id"), F.concat(F.lit(head), "body", F.lit("</packagedElement></uml:Model></xmi:XMI>")).alias("text"))


def _xmi(spark, sf):
    return graph.cut(extract.shred(_xmi_files(spark, sf), "xml", columns=extract.UML_COLUMNS))  # read by several branches


_O = "uo AS (SELECT 'c' || o_custkey AS model_id, o_orderkey AS k, o_orderpriority AS pr, o_orderstatus AS st FROM orders), um AS (SELECT DISTINCT model_id FROM uo)"
_UN = _O + """, un AS (SELECT model_id, 'pk' AS node_id, 'Package' AS type, 'all' AS name FROM um UNION ALL SELECT model_id, 'b', 'Class', 'base' FROM um
  UNION ALL SELECT model_id, 'o' || k, 'Class', pr FROM uo UNION ALL SELECT model_id, 's' || k, 'State', 's' FROM uo WHERE st <> 'P'
  UNION ALL SELECT model_id, 'u' || k, 'UseCase', 'u' FROM uo WHERE k % 11 = 0 UNION ALL SELECT model_id, 'v' || k, 'UseCase', NULL FROM uo WHERE k % 11 = 0)"""


@query("extract_uml_nodes", """SELECT model_id, node_id, type, name, CASE WHEN node_id[1] = 'o' THEN 'total' ELSE '' END AS attributes,
  CASE WHEN node_id[1] = 'o' AND CAST(substr(node_id, 2) AS BIGINT) % 2 = 0 THEN 'pay' ELSE '' END AS operations, CASE WHEN node_id[1] = 'u' THEN 'late' ELSE '' END AS extension_points,
  CASE WHEN node_id[1] = 'o' THEN 'false' END AS abstract FROM un""", _UN)
def _(spark, sf):
    n = extract.uml(_xmi(spark, sf))[0]
    said = [F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("attributes", "operations", "extension_points")]
    return n.select("model_id", "node_id", "type", "name", *said, F.col("data")["isAbstract"].alias("abstract"))


@query("extract_uml_edges", """SELECT model_id, 'g' || k AS edge_id, 'o' || k AS source_id, 'b' AS target_id, 'Generalization' AS type FROM uo WHERE k % 3 = 0
  UNION ALL SELECT model_id, 'o' || k || '__generalization__x' || k, 'o' || k, 'x' || k, 'Generalization' FROM uo WHERE k % 3 = 1
  UNION ALL SELECT model_id, 't' || k, 's' || k, 'o' || k, 'Transition' FROM uo WHERE k % 7 <> 0 UNION ALL SELECT model_id, 't' || k || '__1', 's' || k, 'b', 'Transition' FROM uo WHERE k % 7 <> 0
  UNION ALL SELECT model_id, 'as' || k, 'b', 'o' || k, 'Composition' FROM uo WHERE k % 5 = 0 UNION ALL SELECT model_id, 'w' || k, 'v' || k, 'u' || k, 'extends' FROM uo WHERE k % 11 = 0
  UNION ALL SELECT model_id, 'pk__contains__' || id, 'pk', id, 'contains' FROM (SELECT model_id, node_id AS id FROM un WHERE node_id <> 'pk' UNION ALL SELECT model_id, 't' || k FROM uo
    UNION ALL SELECT model_id, 's' || k FROM uo WHERE st = 'P' UNION ALL SELECT model_id, 'as' || k FROM uo WHERE k % 5 < 2) AS x""", _UN)
def _(spark, sf):
    return extract.uml(_xmi(spark, sf))[1].select("model_id", "edge_id", "source_id", "target_id", "type")


@query("extract_uml_warnings", """SELECT model_id, 'UNKNOWN_NODE_TYPE' AS warning_type, 'Strange' AS msg, true AS is_skip FROM uo WHERE st = 'P'
  UNION ALL SELECT model_id, 'MISSING_EDGE_ENDPOINT', 't' || k, true FROM uo WHERE k % 7 = 0 UNION ALL SELECT model_id, 'MISSING_EDGE_ENDPOINT', 'as' || k, true FROM uo WHERE k % 5 = 1
  UNION ALL SELECT model_id, 'DEFERRED_REF_UNRESOLVED', 'z' || k, false FROM uo WHERE k % 5 = 1 UNION ALL SELECT model_id, 'DEFERRED_REF_UNRESOLVED', 'lost' || k, false FROM uo WHERE k % 22 = 11
  UNION ALL SELECT model_id, 'UNRESOLVED_REFERENCE', 'x' || k, false FROM uo WHERE k % 3 = 1
  UNION ALL SELECT model_id, 'UNRESOLVED_REFERENCE', 's' || k, false FROM uo, (VALUES (1), (2)) AS t(i) WHERE st = 'P' AND k % 7 <> 0""", _UN)
def _(spark, sf):
    return extract.uml_warnings(extract.shred(_xmi_files(spark, sf), "xmi")).select("model_id", "warning_type", "msg", "is_skip")


@query("extract_uml_members", """SELECT model_id, 'o' || k AS owner_id, 'attributes' AS kind, 'a' || k AS member_id, 'total' AS name, 'b' AS type, 'public' AS visibility FROM uo
  UNION ALL SELECT model_id, 'o' || k, 'operations', 'm' || k, 'pay', NULL, NULL FROM uo WHERE k % 2 = 0 UNION ALL SELECT model_id, 'u' || k, 'extension_points', 'p' || k, 'late', NULL, NULL FROM uo WHERE k % 11 = 0""", _UN)
def _(spark, sf):
    return extract.uml_members(_xmi(spark, sf)).drop("pos")


@query("extract_uml_extension_points", "SELECT model_id, 'w' || k AS edge_id, 'p' || k AS location, 'late' AS point FROM uo WHERE k % 22 = 0", _UN)
def _(spark, sf):
    return extract.extension_points(_xmi(spark, sf))[0]


# --- Ecore: fifty parts are a model ---------------------------------------------------------------------------------

_NS = "http://www.eclipse.org/emf/2002/Ecore"


def _ecore_files(spark, sf):
    p = b.read(spark, sf, "part").dropDuplicates(["p_partkey"])
    k = F.col("p_partkey")

    def when(test, text: str):
        return F.when(test, text).otherwise("")

    up = '<eStructuralFeatures xsi:type="ecore:EReference" name="%s" eType="#//Base" containment="true"/>'
    parts = [
        F.format_string('<eClassifiers xsi:type="ecore:EClass" name="P%d"', k), when(k % 2 == 0, ' eSuperTypes="#//Base"'), when(k % 2 == 1, ' eSuperTypes="other.ecore#//Far"'), F.lit(">"),
        F.format_string('<eAnnotations source="doc"><details key="size" value="%d"/><details key="brand" value="%s"/></eAnnotations>', F.col("p_size"), F.col("p_brand")),
        F.lit(f'<eStructuralFeatures xsi:type="ecore:EAttribute" name="size" eType="ecore:EDataType {_NS}#//EInt"/>'),
        when(k % 3 == 0, up % "up"), when(k % 15 == 0, up % "again"), when(k % 4 == 0, '<eOperations name="run" eType="#//Kind"><eParameters name="on" eType="#//Base"/></eOperations>'), F.lit("</eClassifiers>"),
    ]
    per = p.groupBy(F.concat(F.lit("e"), F.floor(k / 50)).alias("model_id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(*parts))), "").alias("body"))
    head = f'<ecore:EPackage xmlns:ecore="{_NS}" {_XSI} name="pk"><eClassifiers xsi:type="ecore:EClass" name="Base"/><eClassifiers xsi:type="ecore:EEnum" name="Kind"><eLiterals name="one"/></eClassifiers>'
    return per.select("model_id", F.concat(F.lit(head), "body", F.lit("</ecore:EPackage>")).alias("text"))


def _ecore(spark, sf):
    return graph.cut(extract.shred(_ecore_files(spark, sf), "xml", columns=extract.ECORE_COLUMNS))


_EP = f"""ep AS (SELECT DISTINCT 'e' || CAST(floor(p_partkey / 50) AS BIGINT) AS model_id, p_partkey AS k, p_size, p_brand FROM part), em AS (SELECT DISTINCT model_id FROM ep),
  base AS (SELECT model_id, unnest(['pk', 'pk/Base', 'pk/Kind', 'pk/Kind/one']) AS node_id, unnest(['EPackage', 'EClass', 'EEnum', 'EEnumLiteral']) AS type FROM em),
  en AS (SELECT model_id, node_id, type, false AS external FROM base UNION ALL SELECT model_id, 'pk/P' || k, 'EClass', false FROM ep UNION ALL SELECT model_id, 'pk/P' || k || '/size', 'EAttribute', false FROM ep
    UNION ALL SELECT model_id, 'pk/P' || k || '/run', 'EOperation', false FROM ep WHERE k % 4 = 0 UNION ALL SELECT model_id, 'pk/P' || k || '/run/on', 'EParameter', false FROM ep WHERE k % 4 = 0
    UNION ALL SELECT model_id, '{_NS}#//EInt', 'EDataType', true FROM em UNION ALL SELECT DISTINCT model_id, 'other.ecore#//Far', 'EClass', true FROM ep WHERE k % 2 = 1)"""


@query("extract_ecore_nodes", "SELECT model_id, node_id, type, external FROM en", _EP)
def _(spark, sf):
    return extract.ecore(_ecore(spark, sf))[0].select("model_id", "node_id", "type", "external")


@query("extract_ecore_edges", f"""SELECT model_id, 'Contains' AS type, regexp_replace(node_id, '/[^/]+$', '') AS source_id, node_id AS target_id FROM en WHERE NOT external AND contains(node_id, '/')
  UNION ALL SELECT model_id, 'Generalization', 'pk/P' || k, CASE WHEN k % 2 = 0 THEN 'pk/Base' ELSE 'other.ecore#//Far' END FROM ep UNION ALL SELECT model_id, 'AttributeType', 'pk/P' || k || '/size', '{_NS}#//EInt' FROM ep
  UNION ALL SELECT model_id, 'Containment', 'pk/P' || k, 'pk/Base' FROM ep WHERE k % 3 = 0 UNION ALL SELECT model_id, 'Type', 'pk/P' || k || '/run', 'pk/Kind' FROM ep WHERE k % 4 = 0
  UNION ALL SELECT model_id, 'Type', 'pk/P' || k || '/run/on', 'pk/Base' FROM ep WHERE k % 4 = 0""", _EP)
def _(spark, sf):
    return extract.ecore(_ecore(spark, sf))[1].select("model_id", "type", "source_id", "target_id")


@query("extract_ecore_warnings", "SELECT model_id, 'DUPLICATE_ID' AS warning_type, 'Containment|pk/P' || k || '|pk/Base' AS msg FROM ep WHERE k % 15 = 0", _EP)
def _(spark, sf):
    return extract.ecore(_ecore(spark, sf))[2].select("model_id", "warning_type", "msg")


@query("extract_annotations", "SELECT model_id, 'doc' AS source, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, count(*) AS n FROM ep GROUP BY ALL", _EP)
def _(spark, sf):
    a = extract.annotations(_ecore(spark, sf))
    return a.groupBy("model_id", "source", F.col("data")["brand"].alias("brand"), F.col("data")["size"].alias("size")).agg(F.count("*").alias("n"))


# --- any XML: header, gate, what is not handled ---------------------------------------------------------------------


@query("extract_header", "SELECT model_id, model_id AS id, 'n' AS name, '1' AS version FROM gm", b.GRAPH)
def _(spark, sf):
    return extract.header(extract.shred(_archimate_files(spark, sf), "archimate", columns=extract.HEADER_COLUMNS, most_depth=1)).select("model_id", "id", "name", "version")


@query("extract_gate", """SELECT model_id, CASE WHEN CAST(substr(model_id, 2) AS BIGINT) % 13 = 0 THEN 0 ELSE 1 END AS passed, CASE CAST(substr(model_id, 2) AS BIGINT) % 13 WHEN 0 THEN 'CannotParse: root {http://www.archimatetool.com/archimate}sheet' END AS said FROM gm""", b.GRAPH)
def _(spark, sf):
    f = _archimate_files(spark, sf)
    odd = F.substring("model_id", 2, 20).cast("long") % 13 == 0
    f = f.withColumn("text", F.when(odd, F.replace("text", F.lit("archimate:model"), F.lit("archimate:sheet"))).otherwise(F.col("text")))
    ok, bad = extract.gate(graph.cut(extract.shred(f, "archimate")), ["model"], ["http://www.archimatetool.com/", "http://www.bolton.ac.uk/"])
    roots = ok.where("depth = 0").select("model_id", F.lit(1).alias("passed"), F.lit(None).cast("string").alias("said"))
    return roots.unionByName(bad.select("model_id", F.lit(0).alias("passed"), F.col("msg").alias("said")))


_KNOWN = [("model", "id"), ("model", "name"), ("model", "version"), ("folder", "type"), ("folder", "name"), ("element", "xsi:type"), ("element", "id"), ("element", "name"), ("element", "source")]


@query("extract_unhandled_attributes", "SELECT model_id, 'element@target' AS msg, count(*) AS n FROM gj GROUP BY model_id", b.GRAPH)
def _(spark, sf):
    rows = extract.shred(_archimate_files(spark, sf), "archimate", columns=extract.ATTRIBUTE_COLUMNS)
    return extract.unhandled(rows, spark.createDataFrame(_KNOWN, "tag string, name string")).groupBy("model_id", "msg").agg(F.count("*").alias("n"))


@query("extract_unhandled_children", "SELECT model_id, 'element/documentation' AS msg, count(*) AS n FROM gj WHERE l_linenumber <> 7 GROUP BY model_id", b.GRAPH)
def _(spark, sf):
    rows = graph.cut(extract.shred(_archimate_files(spark, sf), "archimate", columns=extract.CHILD_COLUMNS))
    known = spark.createDataFrame([("model", "folder"), ("folder", "folder"), ("folder", "element")], "tag string, child string")
    return extract.unhandled_children(rows, known).groupBy("model_id", "msg").agg(F.count("*").alias("n"))


@query("extract_archimate_documentation", "SELECT DISTINCT model_id, 'p' || l_partkey AS node_id, 'P' || l_partkey AS name, 'd' AS documentation FROM gj WHERE l_linenumber <> 7", b.GRAPH)
def _(spark, sf):
    n = extract.archimate_nodes(extract.shred(_archimate_files(spark, sf), "archimate-nodes", columns=extract.NODE_COLUMNS))
    return n.where("documentation is not null").select("model_id", "node_id", "name", "documentation")


# --- graphs: every column of an upsert, every error, every edge -----------------------------------------------------


@query("graph_upsert_all", """SELECT 'p' || l_partkey AS node_id, arg_min(l_returnflag, pos) AS type, arg_min(l_linestatus, pos) FILTER (l_linenumber % 2 = 0) AS name,
  arg_min(l_suppkey, pos) FILTER (l_linenumber % 2 = 1) AS odd, arg_min(l_suppkey, pos) FILTER (l_linenumber % 2 = 0) AS even
  FROM (SELECT *, (l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity) AS pos FROM lineitem) AS x GROUP BY 1""")
def _(spark, sf):
    li = b.read(spark, sf, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    rows = li.select(
        F.lit("m").alias("model_id"), F.concat(F.lit("p"), "l_partkey").alias("node_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity").alias("pos"),
        F.col("l_returnflag").alias("type"), F.when(even, F.col("l_linestatus")).otherwise("").alias("name"), F.create_map(F.when(even, "even").otherwise("odd"), F.col("l_suppkey").cast("string")).alias("data"),
    )
    d = F.col("data")
    return extract.upsert(rows).select("node_id", "type", "name", d["odd"].cast("long").alias("odd"), d["even"].cast("long").alias("even"))


@query("graph_validation_all", """, bad AS (SELECT model_id, CAST(substr(s, 2) AS BIGINT) AS k, t FROM ge)
SELECT model_id, 'dangling endpoint' AS error, count(*) AS n FROM bad WHERE k % 10 <> 3 AND t[1] = 'x' GROUP BY model_id
UNION ALL SELECT model_id, 'missing endpoint', count(*) FROM bad WHERE k % 10 = 3 GROUP BY model_id
UNION ALL SELECT model_id, 'missing language', 1 FROM gm WHERE CAST(substr(model_id, 2) AS BIGINT) % 9 = 0
UNION ALL SELECT model_id, 'duplicate node id', count(*) FROM gn WHERE node_id[1] = 'p' AND CAST(substr(node_id, 2) AS BIGINT) % 8 = 0 GROUP BY model_id
UNION ALL SELECT model_id, 'missing node id', count(*) FROM gn WHERE node_id[1] = 'p' AND CAST(substr(node_id, 2) AS BIGINT) % 8 = 1 GROUP BY model_id""", b.GRAPH.rstrip())
def _(spark, sf):
    m, n, e = b.graph(spark, sf)
    number = lambda c: F.substring(c, 2, 20).cast("long")
    part = F.col("node_id").startswith("p")
    m = m.withColumn("language", F.when(number("model_id") % 9 != 0, F.col("language")))
    again = n.where(part & (number("node_id") % 8 == 0))
    blank = n.where(part & (number("node_id") % 8 == 1)).withColumn("node_id", F.lit(None).cast("string"))
    e = e.withColumn("source_id", F.when(number("source_id") % 10 != 3, F.col("source_id")))
    return extract.validate(m, n.unionByName(again), e).where("error <> 'missing node id'").unionByName(extract.validate(m.limit(0), n.unionByName(blank), e.limit(0)).where("error = 'missing node id'"))


@query("extract_directed_edges_all", """SELECT model_id, CASE k WHEN 0 THEN 'd' ELSE 'd__' || k END AS edge_id, s AS source_id, t AS target_id FROM (
  SELECT 'o' || a.l_orderkey AS model_id, a.x AS s, b.x AS t, row_number() OVER (PARTITION BY a.l_orderkey ORDER BY a.i, b.i) - 1 AS k FROM
  (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS i FROM lineitem) AS a JOIN
  (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS i FROM lineitem) AS b USING (l_orderkey)) AS q""")
def _(spark, sf):
    at = F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber")))
    lists = b.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(at.alias("x"))
    said = [F.array_join(F.col(f"x.{c}").cast("array<string>"), " ").alias(n) for c, n in (("l_partkey", "s"), ("l_suppkey", "t"))]
    return extract.directed_edges(lists.select(F.concat(F.lit("o"), "l_orderkey").alias("model_id"), F.lit("d").alias("id"), *said), "s", "t")


@query("extract_compacted_payload", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name END AS a, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'x' END AS b FROM part""")
def _(spark, sf):
    p = b.read(spark, sf, "part")
    data = F.create_map(F.lit("a"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_name")), F.lit("b"), F.when(F.col("p_size") % 3 == 0, "[]").when(F.col("p_size") % 3 == 1, "{}").otherwise("x"))
    d = extract.compact(data)
    return p.select("p_partkey", d["a"].alias("a"), d["b"].alias("b"))


# --- sources and sinks: written to the shared folder and read back --------------------------------------------------


@query("source_graphs_round_trip", "SELECT model_id, node_id, CASE WHEN node_id[1] = 'o' THEN 'Order' ELSE 'Part' END AS type FROM gn", b.GRAPH)
def _(spark, sf):
    m, n, e = b.graph(spark, sf)
    path = sources.shared_folder(spark, "graphs")
    sources.write_graphs(m, n.withColumn("name", F.lit("")), e, path)
    return sources.read_graphs(spark, path, lines=True)[1].select("model_id", "node_id", "type")


@query("source_graph_edges_round_trip", "SELECT model_id, s AS source_id, t AS target_id, type, count(*) AS n FROM ge GROUP BY ALL", b.GRAPH)
def _(spark, sf):
    m, n, e = b.graph(spark, sf)
    path = sources.shared_folder(spark, "graphs")
    sources.write_graphs(m, n.withColumn("name", F.lit("")), e, path)
    back = sources.read_graphs(spark, path, lines=True)[2]
    return back.groupBy("model_id", "source_id", "target_id", "type").agg(F.count("*").alias("n"))


@query("source_diagnostics_round_trip", f"SELECT model_id, relpath, parse_status, {big('elements_loaded', 'elements_loaded')}, {big('elements_skipped', 'elements_skipped')}, parse_time_ms, {big('warning_count', 'warning_count')} FROM diag", b.DIAGNOSTICS)
def _(spark, sf):
    path = sources.shared_folder(spark, "run")
    sources.write_diagnostics(b.diagnostics(spark, sf), path)
    return sources.read_diagnostics(spark, f"{path}/ir").select("model_id", "relpath", "parse_status", "elements_loaded", "elements_skipped", "parse_time_ms", "warning_count")


@query("source_files", """SELECT source, lang, sum(octet_length(encode(text)) + 1) AS bytes, sum(octet_length(encode(text)) + 1) AS content_bytes FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """Documents as text files, a folder for each source and language."""
    path = sources.shared_folder(spark, "files")
    b.read(spark, sf, "documents").where("text is not null and source is not null and lang is not null").select("source", "lang", "text").write.partitionBy("source", "lang").text(path)
    f = sources.corpus_files(spark, path).where("name like 'part-%'")
    part = lambda k: F.regexp_extract("relpath", f"{k}=([^/]+)/", 1).alias(k)
    return f.groupBy(part("source"), part("lang")).agg(F.sum("length").alias("bytes"), F.sum(F.octet_length("content")).alias("content_bytes"))


@query("source_catalog_round_trip", "SELECT DISTINCT p_type AS id, 'node_type' AS kind, lower(p_type) AS match_type, 'b' || length(p_type) AS layer FROM part")
def _(spark, sf):
    """A catalog of part types, written as JSON under its language; another language has none."""
    path = sources.shared_folder(spark, "catalog")
    p = b.read(spark, sf, "part").select("p_type").distinct()
    row = F.struct(F.col("p_type").alias("id"), F.lit("node_type").alias("kind"), F.lower("p_type").alias("match_type"), F.create_map(F.lit("layer"), F.concat(F.lit("b"), F.length("p_type"))).alias("meta"))
    p.agg(F.collect_list(row).alias("constructs")).select(F.lit("parts").alias("language"), "constructs").write.json(path)
    none = sources.read_catalog(spark, path, "other")
    return sources.read_catalog(spark, path, "parts").unionByName(none).select("id", "kind", "match_type", F.col("meta")["layer"].alias("layer"))


@query("sink_measures_round_trip", "SELECT model_id, 'size' AS dimension, 'elements' AS measure, CAST(elements AS DOUBLE) AS value FROM sz", b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    path = sources.shared_folder(spark, "measures")
    sources.write_measures(sources.melt(size.size_per_model(*b.graph(spark, sf)), "size"), path)
    return sources.read_measures(spark, path, "size", "elements").select("model_id", "dimension", "measure", "value")


@query("sink_index", "SELECT model_id FROM gm", b.GRAPH)
def _(spark, sf):
    path = sources.shared_folder(spark, "measures")
    sources.write_measures(sources.melt(size.size_per_model(*b.graph(spark, sf)), "size"), path)
    return sources.model_index(sources.read_measures(spark, path))


@query("sink_tables_round_trip", f"SELECT model_id, {big('elements_loaded', 'elements_loaded')}, {r('r', 'skip_ratio')} FROM ok", b.DIAGNOSTICS)
def _(spark, sf):
    path = sources.shared_folder(spark, "tables")
    table = parsing.per_model(b.diagnostics(spark, sf)).select("model_id", "elements_loaded", "skip_ratio")
    sources.write_tables({"per_model": table}, path, "json")
    return spark.read.schema(table.schema).json(f"{path}/per_model")


@query("parsing_totals", """SELECT count(*) AS candidates_in, count(*) FILTER (k % 10 <> 0 AND parse_status = 'success') AS success, count(*) FILTER (k % 10 <> 0 AND parse_status = 'warning') AS warning,
  count(*) FILTER (k % 10 = 0 OR parse_status = 'failure') AS failure FROM (SELECT *, CAST(substr(model_id, 2) AS BIGINT) AS k FROM diag) AS x""", b.DIAGNOSTICS)
def _(spark, sf):
    """Every tenth order is listed but left no diagnostics."""
    d = b.diagnostics(spark, sf)
    return parsing.parse_totals(d, d.where(F.substring("model_id", 2, 20).cast("long") % 10 != 0))

