"""Queries of reports, views and extraction; registered beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataprof.functions import stats
from strataprof.operators import constructs, extract, graph, lexical, parsing, report, size, views
from strataprof.plans import bindings as b
from strataprof.plans.catalog import _SIZE, _TOK, ORACLE_SQL, _c, _tokens, big, query, r
from strataprof.sources import files as sources

# --- report ----------------------------------------------------------------------------------------------------


def hist(src: str, col: str, bins: str = "least(20, ceil(sqrt(n)))") -> str:
    """Histogram of one column of a relation, in SQL."""
    return f"""hb AS (SELECT min(v) AS mn, max(v) AS mx, CASE WHEN min(v) = max(v) THEN 1 ELSE {bins.replace('n)', 'count(*))')} END AS nb FROM (SELECT CAST({col} AS DOUBLE) AS v FROM {src}) AS x WHERE v IS NOT NULL),
  hc AS (SELECT CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / ((mx - mn) / nb)), nb - 1) END AS bin_idx, count(*) AS n FROM (SELECT CAST({col} AS DOUBLE) AS v FROM {src}) AS x, hb WHERE v IS NOT NULL GROUP BY 1),
  hg AS (SELECT mn, mx, nb, (mx - mn) / nb AS w, unnest(range(CAST(nb AS BIGINT))) AS i FROM hb)
SELECT CAST(i AS BIGINT) AS bin_idx, {r('mn + i * w', 'lo')}, {r('CASE WHEN i = nb - 1 THEN mx ELSE mn + (i + 1) * w END', 'hi')}, CAST(coalesce(n, 0) AS BIGINT) AS count FROM hg LEFT JOIN hc ON bin_idx = i"""


def _diag(spark, sf):
    return parsing.per_model(b.diagnostics(spark, sf))


def _paths(spark, sf):
    return b.diagnostics(spark, sf).select("model_id", "relpath")


_H1, _S1 = hist("ok", "parse_time_ms").split("\nSELECT", 1)


@query("report_time_histogram", "SELECT" + _S1, b.DIAGNOSTICS, _H1)
def _(spark, sf):
    return stats.histogram(_diag(spark, sf), "parse_time_ms")


_H2, _S2 = hist("(SELECT 100 * least(greatest(density, 0), 1) AS d FROM ok)", "d", "8").split("\nSELECT", 1)


@query("report_density_share_histogram", "SELECT" + _S2, b.DIAGNOSTICS, _H2)
def _(spark, sf):
    return stats.share_histogram(_diag(spark, sf), "warnings_per_element", bins=8)


@query("report_size_histograms", " UNION ALL ".join(f"SELECT '{c}' AS measure, * FROM ({hist('sz', c).replace('hb AS', 'WITH hb AS', 1)}) AS z_{c}" for c in ("nodes", "edges", "elements")), b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return report.long_histograms(size.size_per_model(*b.graph(spark, sf)), ["nodes", "edges", "elements"])


for _name, _col, _asc, _pos in (
    ("skip_ratio", "r", False, False), ("largest", "file_size_bytes_source", False, False), ("smallest", "file_size_bytes_source", True, False), ("warned", "warning_count", False, True),
):
    _field = {"r": "skip_ratio"}.get(_col, _col)

    @query(f"report_top_{_name}", f"SELECT model_id, relpath, {r(_col, 'value') if _col == 'r' else big(_col, 'value')} FROM ok {'WHERE ' + _col + ' > 0' if _pos else ''} ORDER BY {_col} {'ASC' if _asc else 'DESC'}, model_id LIMIT 10", b.DIAGNOSTICS)
    def _(spark, sf, field=_field, asc=_asc, pos=_pos):
        return report.top_models(_diag(spark, sf), field, _paths(spark, sf), ascending=asc, positive=pos)


@query("report_size_time_scatter", "SELECT model_id, file_size_bytes_source AS x, parse_time_ms AS y FROM ok WHERE file_size_bytes_source > 0 AND parse_time_ms > 0", b.DIAGNOSTICS)
def _(spark, sf):
    return report.size_time_scatter(_diag(spark, sf))


@query("report_parsing_score", f"""SELECT {r('(a + s + w) / 3', 'dimension_score')} FROM (SELECT 100.0 * (count(*) FILTER (parse_status = 'success') + 0.5 * count(*) FILTER (parse_status = 'warning')) / count(*) AS a FROM diag) AS x,
  (SELECT 100 * (1 - sum(elements_skipped) / greatest(1, sum(elements_loaded) + sum(elements_skipped))) AS s, 100 * (1 - count(*) FILTER (warning_count > 0) / count(*)) AS w FROM ok) AS y""", b.DIAGNOSTICS)
def _(spark, sf):
    d = b.diagnostics(spark, sf)
    return report.mean_score(parsing.parse_status(d), parsing.element_loading(d), parsing.warnings(d))


@query("report_pareto", f"""SELECT construct, kind, n, rank, {r('share', 'share')}, {r('sum(share) OVER (ORDER BY rank)', 'cumulative_share')} FROM (
  SELECT construct, kind, n, row_number() OVER (ORDER BY n DESC, construct) AS rank, n / sum(n) OVER () AS share FROM freq) AS q""", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return report.frequency_pareto(constructs.corpus_frequency(e, c))


@query("report_pareto_edges", f"""SELECT construct, kind, n, rank, {r('share', 'share')}, {r('sum(share) OVER (ORDER BY rank)', 'cumulative_share')} FROM (
  SELECT construct, kind, n, row_number() OVER (ORDER BY n DESC, construct) AS rank, n / sum(n) OVER () AS share FROM freq WHERE kind = 'edge_type') AS q""", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return report.frequency_pareto(constructs.corpus_frequency(e, c), ["edge_type"])


@query("report_frequency_by_group", f"""SELECT "group", {big('sum(n)', 'n')}, {r('sum(n) / sum(sum(n)) OVER ()', 'share')} FROM freq GROUP BY "group" """, b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return report.frequency_by_group(constructs.corpus_frequency(e, c))


@query("report_matrix", f"SELECT model_id, construct, n, {r('share', 'share')} FROM grid WHERE n > 0", b.CONSTRUCTS)
def _(spark, sf):
    return report.model_matrix(constructs.grid(*_c(spark, sf)))


_IDS = [x[0] for x in b.CATALOG_ROWS[:6]]


@query("report_wide_matrix", "SELECT model_id, " + ", ".join(f"""CAST(sum(n) FILTER (construct = '{i}') AS BIGINT) AS "{i}" """ for i in _IDS) + " FROM grid GROUP BY model_id", b.CONSTRUCTS)
def _(spark, sf):
    return report.wide_matrix(constructs.grid(*_c(spark, sf)), _IDS)


@query("report_heatmap_page", f"""SELECT model_id, relpath, construct, n, {r('share', 'share')}, max(n) OVER () AS largest FROM (
  SELECT *, 'user/' || substr(model_id, 2) AS relpath FROM grid) AS g WHERE model_id IN (SELECT model_id FROM ms ORDER BY 'user/' || substr(model_id, 2), model_id LIMIT 10 OFFSET 5)
  AND construct IN (SELECT construct FROM freq ORDER BY n DESC, construct LIMIT 4)""", b.CONSTRUCTS)
def _(spark, sf):
    e, m, c = _c(spark, sf)
    paths = m.select("model_id", F.concat(F.lit("user/"), F.substring("model_id", 2, 20)).alias("relpath"))
    return report.heatmap_page(constructs.grid(e, m, c), paths, 5, 10, top_constructs=4)


@query("report_top_and_other", "SELECT CASE WHEN rn <= 8 THEN token ELSE 'other' END AS token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) AS rn FROM tk GROUP BY token) AS q GROUP BY 1", b.LABELS.rstrip() + _TOK)
def _(spark, sf):
    by = _tokens(spark, sf).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return stats.top_and_other(by, "token", "n", 8)


@query("report_frequency_kpis", f"SELECT count(*) FILTER (n > 0) AS active, {r('max(share)', 'top_share')} FROM freq", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return report.frequency_kpis(constructs.corpus_frequency(e, c))


@query("report_missing_search", "SELECT construct FROM freq WHERE n = 0 AND contains(lower(concat_ws(' ', \"group\", kind, construct, description)), 'refund')", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return report.search(constructs.missing(e, c), "REFUND", "group", "kind", "construct", "description").select("construct")


@query("report_language_kpis", """SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (lang <> 'unknown') AS languages, max_by(lang, (n, lang)) AS top, CAST(coalesce(sum(n) FILTER (lang = 'unknown'), 0) AS BIGINT) AS unknown
  FROM (SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1) AS q""")
def _(spark, sf):
    d = b.read(spark, sf, "documents").select(F.coalesce("lang", F.lit("unknown")).alias("language"))
    return report.language_kpis(lexical.language_usage(d))


# --- views -----------------------------------------------------------------------------------------------------


def _wide(spark, sf):
    return views.wide({"parsing": parsing.per_model(b.diagnostics(spark, sf))}, _paths(spark, sf))


_V = views.ViewSpec
_F = views.Filter


@query("view_kpi", f"SELECT {r('avg(parse_time_ms)', 'value')}, {r('min(parse_time_ms)', 'min')}, {r('max(parse_time_ms)', 'max')}, count(parse_time_ms) AS n FROM ok WHERE warning_count > 2 AND contains(lower(relpath), 'high')", b.DIAGNOSTICS)
def _(spark, sf):
    return views.run(_wide(spark, sf), _V("k", "kpi", "parsing.parse_time_ms", filters=(_F("parsing.warning_count", "gt", 2), _F("relpath", "contains", "HIGH"))))


@query("view_bar_map", f"SELECT kind AS key, {r('sum(c)', 'value')} FROM lines JOIN ok ON model_id = 'o' || l_orderkey WHERE kind <> 'AO' AND parse_status <> 'warning' GROUP BY kind", b.DIAGNOSTICS)
def _(spark, sf):
    return views.run(_wide(spark, sf), _V("b", "bar", "parsing.warnings_by_type", filters=(_F("parsing.parse_status", "ne", "warning"),)))


@query("view_bar", f"SELECT model_id AS key, {r('parse_time_ms', 'value')} FROM ok WHERE elements_skipped IN (3, 4)", b.DIAGNOSTICS)
def _(spark, sf):
    return views.run(_wide(spark, sf), _V("b", "bar", "model_id", y="parsing.parse_time_ms", filters=(_F("parsing.elements_skipped", "in", [3, 4]),)))


@query("view_pie", f"SELECT parse_status AS key, {r('count(*)', 'value')} FROM ok WHERE elements_loaded NOT IN (1, 2) GROUP BY 1", b.DIAGNOSTICS)
def _(spark, sf):
    return views.run(_wide(spark, sf), _V("p", "pie", "parsing.parse_status", filters=(_F("parsing.elements_loaded", "not_in", [1, 2]),)))


_H3, _S3 = hist("ok", "skip_ratio", "7").replace("skip_ratio", "r").split("\nSELECT", 1)


@query("view_histogram", "SELECT" + _S3, b.DIAGNOSTICS, _H3)
def _(spark, sf):
    return views.run(_wide(spark, sf), _V("h", "histogram", "parsing.skip_ratio", bins=7))


@query("view_scatter", f"SELECT model_id, {r('file_size_bytes_source', 'x')}, {r('parse_time_ms', 'y')}, parse_status AS color FROM ok WHERE warning_count IS NOT NULL AND parse_time_ms <= 100", b.DIAGNOSTICS)
def _(spark, sf):
    spec = _V("s", "scatter", "parsing.file_size_bytes_source", y="parsing.parse_time_ms", color="parsing.parse_status", filters=(_F("parsing.warning_count", "is_not_null"), _F("parsing.parse_time_ms", "lte", 100)))
    return views.run(_wide(spark, sf), spec)


_FIELDS = [("parsing.parse_status", "string", "parse_status"), ("parsing.parse_time_ms", "number", "parse_time_ms"), ("relpath", "string", "relpath"), ("model_id", "string", "model_id")]


@query("view_fields", " UNION ALL ".join(f"SELECT '{f}' AS field, '{t}' AS type, count(*) AS n, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = count(*) AS is_unique FROM ok" for f, t, c in _FIELDS), b.DIAGNOSTICS)
def _(spark, sf):
    w = _wide(spark, sf)
    return views.field_catalog(w.select(*[F.col(f"`{f}`") for f, _, _ in _FIELDS])).drop("sample")


# --- extraction ------------------------------------------------------------------------------------------------

_XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'


def _archimate_files(spark, sf):
    """A customer's orders and parts as an ArchiMate file: parts repeat, a seventh line points nowhere, every 97th order
    lacks its id."""
    o, li = b.read(spark, sf, "orders"), b.read(spark, sf, "lineitem")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    model = F.concat(F.lit("c"), "o_custkey").alias("model_id")
    ident = F.when(F.col("o_orderkey") % 97 == 0, "").otherwise(F.format_string('id="o%d" ', "o_orderkey"))
    orders = o.groupBy(model).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<element xsi:type="archimate:BusinessObject" '), ident, F.format_string('name="%s"/>', "o_orderpriority")))), "").alias("a"))
    part = F.format_string('<folder name="f"><element xsi:type="archimate:ApplicationComponent" id="p%d" name="P%d"><documentation> d </documentation></element></folder>', "l_partkey", "l_partkey")
    kind = F.when(F.col("l_returnflag") == "A", "Composition").otherwise("association")
    rel = F.concat(
        F.lit('<element xsi:type="archimate:'), kind, F.lit('Relationship" '), F.format_string('id="r%d-%d-%d-%d" source="o%d" ', "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderkey"),
        F.lit('target="'), F.when(F.col("l_linenumber") == 7, "x").otherwise("p"), F.col("l_partkey").cast("string"), F.lit('"/>'),
    )
    lines = j.groupBy(model).agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("l_linenumber") != 7, part))), "").alias("b"), F.array_join(F.sort_array(F.collect_list(rel)), "").alias("r"))
    text = F.concat(
        F.format_string('<archimate:model xmlns:archimate="http://www.archimatetool.com/archimate" ' + _XSI + ' id="%s" name="n" version="1">', "model_id"),
        F.lit('<folder type="business">'), "a", F.lit('</folder><folder type="application">'), F.coalesce("b", F.lit("")), F.lit('</folder><folder type="relations">'), F.coalesce("r", F.lit("")), F.lit("</folder></archimate:model>"),
    )
    return orders.join(lines, "model_id", "left").select("model_id", text.alias("text"))


@query("extract_archimate_nodes", """SELECT model_id, node_id, CASE WHEN node_id[1] = 'o' THEN 'BusinessObject' ELSE 'ApplicationComponent' END AS type, CASE WHEN node_id[1] = 'o' THEN 'business' ELSE 'application' END AS layer
  FROM gn WHERE node_id[1] = 'p' OR CAST(substr(node_id, 2) AS BIGINT) % 97 <> 0""", b.GRAPH)
def _(spark, sf):
    rows = extract.shred(_archimate_files(spark, sf), "archimate-nodes", columns=extract.NODE_COLUMNS)
    return extract.archimate_nodes(rows).select("model_id", "node_id", "type", "layer")


_LINE = "'r' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


@query("extract_archimate_edges", f"""SELECT DISTINCT model_id, {_LINE} AS edge_id, 'o' || o_orderkey AS source_id, CASE WHEN l_linenumber = 7 THEN 'x' ELSE 'p' END || l_partkey AS target_id,
  min(CASE WHEN l_returnflag = 'A' THEN 'Composition' ELSE 'Association' END) OVER (PARTITION BY model_id, {_LINE}) AS type FROM gj""", b.GRAPH)
def _(spark, sf):
    rows = extract.shred(_archimate_files(spark, sf), "archimate-relations", columns=extract.RELATION_COLUMNS)
    return extract.archimate_edges(rows).select("model_id", "edge_id", "source_id", "target_id", F.when(F.lower("type") == "association", "Association").otherwise(F.col("type")).alias("type"))


@query("extract_archimate_warnings", f""", u AS (SELECT DISTINCT model_id, {_LINE} AS id, o_orderkey, l_linenumber FROM gj), ws AS (
  SELECT 'c' || o_custkey AS model_id, 'MISSING_ATTRIBUTE' AS warning_type, count(*) AS n FROM orders WHERE o_orderkey % 97 = 0 GROUP BY 1
  UNION ALL SELECT model_id, 'DUPLICATE_ID', count(*) - count(DISTINCT l_partkey) FROM gj WHERE l_linenumber <> 7 GROUP BY 1
  UNION ALL SELECT model_id, 'DUPLICATE_ID', count(*) - count(DISTINCT {_LINE}) FROM gj GROUP BY 1
  UNION ALL SELECT model_id, 'UNRESOLVED_REFERENCE', count(*) FILTER (o_orderkey % 97 = 0) + count(*) FILTER (l_linenumber = 7) FROM u GROUP BY 1)
SELECT model_id, warning_type, CAST(sum(n) AS BIGINT) AS n FROM ws GROUP BY ALL HAVING sum(n) > 0""", b.GRAPH)
def _(spark, sf):
    rows = extract.shred(_archimate_files(spark, sf), "archimate-checks")
    return extract.archimate_warnings(rows).groupBy("model_id", "warning_type").agg(F.sum("n").alias("n"))


ORACLE_SQL["extract_archimate_warnings"] = ORACLE_SQL["extract_archimate_warnings"].replace("\n, u AS", ", u AS")


def _bpmn_files(spark, sf):
    """A nation is a model of many files, one for each customer: a pool that holds tasks (orders); flows run from each
    order to the customer."""
    n, c, o = b.read(spark, sf, "nation"), b.read(spark, sf, "customer"), b.read(spark, sf, "orders")
    def obj(kind: str, ident, *more):
        return F.struct(ident.alias("resourceId"), F.struct(F.lit(kind).alias("id")).alias("stencil"), *more)

    flow = F.concat(F.lit("f"), "o_orderkey")
    task = obj("Task", F.concat(F.lit("o"), "o_orderkey"), F.array(F.struct(flow.alias("resourceId"))).alias("outgoing"))
    target = F.when(F.col("o_orderkey") % 10 != 0, F.struct(F.concat(F.lit("c"), "o_custkey").alias("resourceId")))
    flows = obj("SequenceFlow", flow, target.alias("target"))
    per = o.groupBy("o_custkey").agg(F.concat(F.array_join(F.collect_list(F.to_json(task)), ","), F.lit(","), F.array_join(F.collect_list(F.to_json(flows)), ",")).alias("inner"))
    text = F.concat(
        F.format_string('{"resourceId":"canvas","stencil":{"id":"BPMNDiagram"},"childShapes":[{"resourceId":"c%d","stencil":{"id":"Pool"},"childShapes":[', "c_custkey"),
        F.coalesce("inner", F.lit("")), F.lit("]}]}"),
    )
    pools = c.join(n, c.c_nationkey == n.n_nationkey).join(per.hint("merge"), c.c_custkey == per.o_custkey, "left")  # texts are far larger than the keys they are made of
    return pools.select(F.col("n_name").alias("model_id"), text.alias("text"))


@query("extract_bpmn_edges", """SELECT n_name AS model_id, 'f' || o_orderkey AS edge_id, 'o' || o_orderkey AS source_id, 'c' || o_custkey AS target_id, 'SequenceFlow' AS type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 10 <> 0
UNION ALL SELECT n_name, 'contains:c' || c_custkey || '->o' || o_orderkey, 'c' || c_custkey, 'o' || o_orderkey, 'contains' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_name, 'contains:canvas->c' || c_custkey, 'canvas', 'c' || c_custkey, 'contains' FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    return extract.bpmn(graph.cut(extract.shred(_bpmn_files(spark, sf), "bpmn-json")))[1].select("model_id", "edge_id", "source_id", "target_id", "type")


@query("extract_bpmn_warnings", """SELECT n_name AS model_id, 'MISSING_EDGE_ENDPOINT' AS warning_type, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey % 10 = 0 GROUP BY 1""")
def _(spark, sf):
    return extract.bpmn(graph.cut(extract.shred(_bpmn_files(spark, sf), "bpmn-json")))[2].groupBy("model_id", "warning_type").agg(F.count("*").alias("n"))


@query("extract_directed_edges", """SELECT 'o' || a.l_orderkey AS model_id, count(*) AS n FROM (SELECT l_orderkey, l_partkey FROM lineitem) AS a JOIN (SELECT l_orderkey, l_suppkey FROM lineitem) AS b ON a.l_orderkey = b.l_orderkey GROUP BY 1""")
def _(spark, sf):
    lists = b.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list("l_partkey"), " ").alias("s"), F.array_join(F.collect_list("l_suppkey"), " ").alias("t"))
    rows = lists.select(F.concat(F.lit("o"), "l_orderkey").alias("model_id"), F.lit("d").alias("id"), "s", "t")
    return extract.directed_edges(rows, "s", "t").groupBy("model_id").agg(F.count_distinct("edge_id").alias("n"))


@query("graph_validation", """SELECT model_id, 'dangling endpoint' AS error, count(*) AS n FROM ge WHERE t[1] = 'x' GROUP BY model_id""", b.GRAPH)
def _(spark, sf):
    return extract.validate(*b.graph(spark, sf))


@query("graph_upsert", """SELECT 'p' || l_partkey AS node_id, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity)) AS type FROM lineitem GROUP BY 1""")
def _(spark, sf):
    li = b.read(spark, sf, "lineitem")
    rows = li.select(F.lit("m").alias("model_id"), F.concat(F.lit("p"), "l_partkey").alias("node_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity").alias("pos"), F.col("l_returnflag").alias("type"), F.lit("").alias("name"), F.create_map(F.col("l_linestatus"), F.lit("1")).alias("data"))
    return extract.upsert(rows).select("node_id", "type")


@query("sink_graph_json", "SELECT gm.model_id, CAST((SELECT count(*) FROM gn WHERE gn.model_id = gm.model_id) AS BIGINT) AS n_ids FROM gm", b.GRAPH)
def _(spark, sf):
    ms, n, e = b.graph(spark, sf)
    text = sources.graphs_as_json(ms, n.withColumn("name", F.lit("")), e)
    return text.select("model_id", F.size(F.from_json("json", "struct<nodes:array<struct<id:string>>>")["nodes"]).alias("n_ids"))


@query("measures_long", "SELECT model_id, 'size' AS dimension, measure, value FROM (SELECT model_id, CAST(nodes AS DOUBLE) AS nodes, CAST(edges AS DOUBLE) AS edges, CAST(elements AS DOUBLE) AS elements FROM sz) UNPIVOT (value FOR measure IN (nodes, edges, elements))", b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return sources.melt(size.size_per_model(*b.graph(spark, sf)).drop("edges_per_node"), "size")

