"""Further report tables and reference resolution; registered beside the other queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataprof.functions import stats, text
from strataprof.operators import constructs, extract, lexical, report, scan, size
from strataprof.plans import bindings as b
from strataprof.plans.catalog import _CONN, _LEN, _PRES, _SIZE, _TOK, _c, _labels, _scanned, _tokens, query, r
from strataprof.plans.more import hist


def _paths(spark, sf):
    return b.models(spark, sf).select("model_id", F.concat(F.lit("brands/"), "model_id").alias("relpath"))


def _top_sql(src: str, col: str, asc: bool = False, where: str = "") -> str:
    return f"SELECT model_id, {r(col, 'value')} FROM {src} {where} ORDER BY {col} {'ASC' if asc else 'DESC'}, model_id LIMIT 10"


def _value(df):
    return df.withColumn("value", F.col("value").cast("double"))


for _name, _col in (("elements", "elements"), ("edges_per_node", "edges_per_node")):

    @query(f"report_top_{_name}", _top_sql("sz", _col), b.GRAPH.rstrip() + _SIZE)
    def _(spark, sf, col=_col):
        return _value(report.top_models(size.size_per_model(*b.graph(spark, sf)), col))


@query("report_top_degree", _top_sql("dg", "degree_mean"), b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return _value(report.top_models(size.degree_per_model(*b.graph(spark, sf)), "degree_mean"))


@query("report_top_isolated", _top_sql("cn", "isolated_share"), b.GRAPH.rstrip() + _CONN)
def _(spark, sf):
    return _value(report.top_models(size.connectivity_per_model(*b.graph(spark, sf)), "isolated_share"))


@query("report_top_depth", _top_sql("(SELECT model_id, max(depth) AS d FROM td GROUP BY model_id) AS q", "d"), b.TREE)
def _(spark, sf):
    return _value(report.top_models(size.containment_per_model(*b.tree(spark, sf)), "max_depth"))


@query("report_top_missing_labels", f"SELECT model_id, 'brands/' || model_id AS relpath, {r('1 - present_share', 'value')} FROM pres WHERE eligible > present ORDER BY 1 - present_share DESC, model_id LIMIT 10", b.LABELS.rstrip() + _PRES)
def _(spark, sf):
    p = lexical.presence_per_model(_labels(spark, sf), b.models(spark, sf)).where("eligible > present")
    return report.top_models(p, "missing_share", _paths(spark, sf))


@query("report_top_label_length", _top_sql("len", "coalesce(cmed, 0)"), b.LABELS.rstrip() + _LEN)
def _(spark, sf):
    return report.top_models(lexical.length_per_model(_tokens(spark, sf), b.models(spark, sf)), "chars_median")


@query("report_top_diversity", _top_sql("dm", "type_token_ratio"), b.LABELS.rstrip() + _TOK)
def _(spark, sf):
    return report.top_models(lexical.diversity_per_model(_tokens(spark, sf), b.models(spark, sf)), "type_token_ratio")


_H, _S = hist("len", "coalesce(cmed, 0)").split("\nSELECT", 1)


@query("report_label_length_histogram", "SELECT" + _S, b.LABELS.rstrip() + _LEN, _H)
def _(spark, sf):
    return stats.histogram(lexical.length_per_model(_tokens(spark, sf), b.models(spark, sf)), "chars_median")


for _name, _asc in (("lowest", True), ("highest", False)):

    @query(f"report_coverage_{_name}", _top_sql("(SELECT model_id, observed / 6 AS c FROM pm) AS q", "c", _asc), b.CONSTRUCTS)
    def _(spark, sf, asc=_asc):
        return report.top_models(constructs.presence_per_model(*_c(spark, sf)), "coverage", ascending=asc)


@query("report_top_instances", _top_sql("(SELECT model_id, sum(n) AS n FROM grid GROUP BY model_id) AS q", "n"), b.CONSTRUCTS)
def _(spark, sf):
    return _value(report.top_models(constructs.frequency_per_model(*_c(spark, sf)), "instances"))


@query("report_coverage_page", """SELECT model_id, construct, n > 0 AS present FROM grid WHERE model_id IN (SELECT model_id FROM ms ORDER BY model_id LIMIT 7 OFFSET 4)""", b.CONSTRUCTS)
def _(spark, sf):
    e, m, c = _c(spark, sf)
    page = m.orderBy("model_id").offset(4).limit(7)
    return constructs.grid(e, m.join(F.broadcast(page), "model_id", "left_semi"), c).select("model_id", "construct", (F.col("n") > 0).alias("present"))


@query("report_catalog_browser", "SELECT \"group\", kind, construct, description, n FROM freq WHERE contains(lower(concat_ws(' ', \"group\", kind, construct, description)), 'view')", b.CONSTRUCTS)
def _(spark, sf):
    """Constructs that hold a text, with how often the events match them."""
    e, _, c = _c(spark, sf)
    found = report.search(constructs.corpus_frequency(e, c), "view", "group", "kind", "construct", "description")
    return found.select("group", "kind", "construct", "description", "n").orderBy("group", "kind", "construct")


@query("report_missing_from_models", "SELECT construct FROM cat WHERE construct NOT IN (SELECT construct FROM cnt)", b.CONSTRUCTS)
def _(spark, sf):
    """Missing constructs rebuilt from per-model counts alone."""
    e, _, c = _c(spark, sf)
    return constructs.known(c).select(F.col("id").alias("construct")).join(constructs.counts(e, c), "construct", "left_anti")


@query("report_top_labels_page", "SELECT label, n FROM (SELECT t AS label, count(*) AS n FROM toks GROUP BY t ORDER BY n DESC, label LIMIT 50) AS q ORDER BY n DESC, label LIMIT 10 OFFSET 20", b.LABELS)
def _(spark, sf):
    return lexical.top_labels(_tokens(spark, sf)).orderBy(F.desc("n"), "label").offset(20).limit(10)


@query("scan_browse_duplicates", "SELECT sha256, count(*) AS n_files FROM scanned WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1 AND bool_or(contains(lower(relpath), 'src2')) ORDER BY sha256 LIMIT 10", b.FILES)
def _(spark, sf):
    return scan.browse_duplicates(scan.duplicate_groups(_scanned(spark, sf)), "SRC2", limit=10).select("sha256", "n_files")


@query("text_short_construct", "SELECT event_id, CASE WHEN length(t) > 6 THEN substr(t, 1, 5) || '…' ELSE t END AS label FROM (SELECT event_id, event_type AS t FROM events) AS q")
def _(spark, sf):
    e = b.read(spark, sf, "events")
    return e.select("event_id", text.short_construct(F.concat(F.lit("ev:"), "event_type"), 6).alias("label"))


@query("extract_external_names", "SELECT p_partkey, 'lib' || p_size || '::' || p_name AS name FROM part")
def _(spark, sf):
    p = b.read(spark, sf, "part")
    return p.select("p_partkey", extract.external_name(F.concat(F.lit("http://x/lib"), "p_size", F.lit(".library.uml#"), "p_name")).alias("name"))


@query("extract_resolve_by_name", """SELECT ref_id, min(part) AS part FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS ref_id, q.p_brand,
  arg_min(p.p_partkey, (CASE WHEN p.p_type = 'SMALL' THEN 0 WHEN p.p_type = q.p_type THEN 1 ELSE 2 END, p.p_partkey)) AS part
  FROM lineitem JOIN part q ON q.p_partkey = l_partkey JOIN part p ON p.p_name = q.p_name AND p.p_brand = q.p_brand GROUP BY 1, 2) AS x GROUP BY ref_id""")
def _(spark, sf):
    """References of all lines."""
    return _resolved(b.read(spark, sf, "part"), b.read(spark, sf, "lineitem"))


@query("extract_resolve_all_by_name", """SELECT ref_id, min(part) AS part FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS ref_id, q.p_brand,
  arg_min(p.p_partkey, (CASE WHEN p.p_type = 'SMALL' THEN 0 WHEN p.p_type = q.p_type THEN 1 ELSE 2 END, p.p_partkey)) AS part
  FROM lineitem JOIN part q ON q.p_partkey = l_partkey JOIN part p ON p.p_name = q.p_name AND p.p_brand = q.p_brand GROUP BY 1, 2) AS x GROUP BY ref_id""")
def _(spark, sf):
    """The same, under the name that it had while the other took third lines only."""
    return _resolved(b.read(spark, sf, "part"), b.read(spark, sf, "lineitem"))


def _resolved(p, li):
    refs = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("model_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("ref_id"), F.col("p_name").alias("name"), F.lit("SMALL").alias("hint"), F.col("p_type").alias("package"))
    cands = p.select(F.col("p_brand").alias("model_id"), F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("package"))
    return extract.resolve_by_name(refs, cands).groupBy("ref_id").agg(F.min("node_id").alias("part"))


@query("extract_resolve_files", """SELECT relpath, arg_min(t, (n, t)) AS target FROM (SELECT f.relpath, g.relpath AS t, CASE WHEN f.lang = g.lang THEN 1 ELSE 2 END AS n
  FROM (SELECT source || '/' || lang || '/' || doc_id AS relpath, source, lang, doc_id % 7 AS k FROM documents) AS f
  JOIN (SELECT DISTINCT source || '/' || lang || '/t' || doc_id % 7 AS relpath, source, lang, doc_id % 7 AS k FROM documents) AS g ON f.source = g.source AND f.k = g.k) AS q GROUP BY relpath""")
def _(spark, sf):
    d = b.read(spark, sf, "documents")
    base = F.concat(F.lit("t"), F.col("doc_id") % 7)
    refs = d.select(F.concat_ws("/", "source", "lang", "doc_id").alias("relpath"), F.concat(F.lit("../x/"), base, F.lit("#//A")).alias("ref"))
    files = d.select(F.concat_ws("/", "source", "lang", base).alias("relpath")).distinct()
    return extract.resolve_files(refs, files).select("relpath", "target")


