"""Queries of whole reports: corpus roll-up, all histograms of a family, cuts, and rules for odd catalogs; registered beside
the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataprof.operators import constructs, graph, labels, lexical, parsing, report, size, views
from strataprof.plans import bindings as b
from strataprof.plans.catalog import _CONN, _LEN, _LEN_COLS, _PRES, _SIZE, _STY, _TOK, _WORDS, ORACLE_SQL, _c, _labels, _tokens, query, r
from strataprof.plans.more import _wide, hist


def long_sql(families: dict[str, dict[str, str]]) -> str:
    """The SQL of registered one-row queries in long form."""
    return " UNION ALL ".join(
        f"SELECT '{family}' AS family, '{measure}' AS measure, name AS figure, round(value, 6) + 0.0 AS value FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM ({ORACLE_SQL[q]}) AS q) ON COLUMNS(*) INTO NAME name VALUE value) AS u"
        for family, named in families.items() for measure, q in named.items()
    )


_PARSING = {"parse_status": "parsing_status", "element_loading": "parsing_elements", "parse_time": "parsing_time", "file_size": "parsing_file_size", "warnings": "parsing_warnings"}
_SIZES = {"size": "size", "degree": "degree", "connectivity": "connectivity"}


def _graph_measures(spark, sf):
    return size.all_measures(*b.graph(spark, sf), enabled=set(_SIZES))


@query("corpus_measures", f"""SELECT 'corpus' AS family, 'models' AS measure, 'n_models' AS figure, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS value FROM orders
  UNION ALL SELECT 'lexical', NULL, NULL, NULL UNION ALL {long_sql({"parsing": _PARSING, "size": _SIZES, "constructs": {"presence": "constructs_presence", "frequency": "constructs_utilisation"}})}""")
def _(spark, sf):
    """The roll-up of a corpus with its lexical family switched off."""
    models = graph.cut(b.diagnostics(spark, sf).drop("relpath", "warnings_by_type"))  # read by five measures
    parsed = {name: getattr(parsing, name)(models) for name in _PARSING}
    e, m, c = _c(spark, sf)
    families = {"parsing": parsed, "lexical": None, "size": _graph_measures(spark, sf), "constructs": constructs.measures(e, m, c)[0]}
    return report.roll_up(b.graph(spark, sf)[0], families)


@query("parsing_all", long_sql({"parsing": _PARSING}))
def _(spark, sf):
    found = parsing.all_measures(b.diagnostics(spark, sf))
    out = None
    for name in _PARSING:
        part = report.as_long("parsing", name, found[name])
        out = part if out is None else out.unionByName(part)
    return out


@query("size_all_tree", long_sql({"size": {"containment": "containment"}}))
def _(spark, sf):
    return report.as_long("size", "containment", size.all_measures(*b.tree(spark, sf), enabled={"containment"})["containment"])


@query("size_all_per_model", f"""SELECT sz.model_id, nodes, edges, elements, {r('edges_per_node', 'edges_per_node')}, {r('degree_mean', 'degree_mean')}, {r('in_mean', 'in_mean')}, {r('out_mean', 'out_mean')},
  {r('degree_median', 'degree_median')}, degree_max, components, largest, {r('size_mean', 'size_mean')}, isolated, {r('isolated_share', 'isolated_share')} FROM sz JOIN dg USING (model_id) JOIN cn USING (model_id)""", b.GRAPH.rstrip() + _SIZE + _CONN)
def _(spark, sf):
    wanted = "model_id nodes edges elements edges_per_node degree_mean in_mean out_mean degree_median degree_max components largest size_mean isolated isolated_share".split()
    return size.all_per_model(*b.graph(spark, sf), enabled=set(_SIZES)).select(wanted)


def histograms_sql(sources: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS measure, * FROM ({hist(src, col).replace('hb AS', 'WITH hb AS', 1)}) AS z_{name}" for name, (src, col) in sources.items())


_RD4 = {
    **{c: ("sz", c) for c in ("nodes", "edges", "elements", "edges_per_node")}, **{c: ("dg", c) for c in ("degree_mean", "in_mean", "out_mean", "degree_median", "degree_max")},
    **{c: ("cn", c) for c in ("components", "largest", "size_mean", "isolated", "isolated_share")},
}


@query("report_graph_histograms", histograms_sql(_RD4), b.GRAPH.rstrip() + _SIZE + _CONN)
def _(spark, sf):
    return report.long_histograms(size.all_per_model(*b.graph(spark, sf), enabled=set(_SIZES)), list(_RD4))


_DEPTHS = """, dp AS (SELECT model_id, max(depth) AS max_depth, avg(depth) AS mean_depth, count(*) FILTER (depth > 0) / count(*) AS contained_share FROM td GROUP BY model_id)"""


@query("report_depth_histograms", histograms_sql({c: ("dp", c) for c in ("max_depth", "mean_depth", "contained_share")}), b.TREE.rstrip() + _DEPTHS)
def _(spark, sf):
    return report.long_histograms(size.containment_per_model(*b.tree(spark, sf)), ["max_depth", "mean_depth", "contained_share"])


@query("report_size_scatter", "SELECT model_id, nodes AS x, edges AS y FROM sz", b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return size.size_per_model(*b.graph(spark, sf)).select("model_id", F.col("nodes").alias("x"), F.col("edges").alias("y"))


_RD1 = {"parse_time_ms": ("ok", "parse_time_ms"), "file_size_bytes_source": ("ok", "file_size_bytes_source"), "file_size_bytes_ir": ("ok", "file_size_bytes_ir"), "skip_ratio": ("ok", "r"), "warnings_per_element": ("ok", "density")}


@query("report_parsing_histograms", histograms_sql(_RD1), b.DIAGNOSTICS)
def _(spark, sf):
    return report.long_histograms(parsing.per_model(b.diagnostics(spark, sf)), list(_RD1))


@query("report_status_chart", f"SELECT status, n, {r('n / sum(n) OVER ()', 'share')} FROM (SELECT parse_status AS status, count(*) AS n FROM diag GROUP BY 1) AS q", b.DIAGNOSTICS)
def _(spark, sf):
    d = parsing.parse_status(b.diagnostics(spark, sf))
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(f"n_{c}").alias("n"), F.col(f"share_{c}").alias("share")) for s, c in (("success", "success"), ("warning", "partial"), ("failure", "failed"))])
    return d.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")


@query("report_skip_kpis", f"SELECT {r('sum(elements_skipped) / greatest(1, sum(elements_loaded) + sum(elements_skipped))', 'skip_ratio')}, count(*) FILTER (elements_skipped > 0) AS models_with_skips, {r('count(*) FILTER (elements_skipped > 0) / count(*)', 'share_with_skips')} FROM ok", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.element_loading(b.diagnostics(spark, sf)).select("skip_ratio", "models_with_skips", "share_with_skips")


_RD2 = {"present_share": ("pres", "present_share"), **{n: ("len", f"coalesce({a}, 0)") for a, n in _LEN_COLS}, "style_entropy": ("ent", "style_entropy"), "single_share": ("wm", "single_share"), "type_token_ratio": ("dm", "type_token_ratio")}


@query("report_lexical_histograms", histograms_sql(_RD2), b.LABELS.rstrip() + _PRES + _LEN + _STY + _WORDS + _TOK)
def _(spark, sf):
    toks, ms, ls = _tokens(spark, sf), b.models(spark, sf), _labels(spark, sf)
    p = lexical.presence_per_model(ls, ms)
    for t in (lexical.length_per_model(toks, ms), lexical.style_entropy_per_model(toks, ms), lexical.words_per_model(toks, ms).drop("labels"), lexical.diversity_per_model(toks, ms)):
        p = p.join(t, "model_id")
    return report.long_histograms(p, list(_RD2))


@query("report_presence_chart", "SELECT kind, CASE WHEN present THEN 'present' ELSE 'missing' END AS status, count(*) AS n FROM elig GROUP BY ALL", b.LABELS)
def _(spark, sf):
    return lexical._presence(_labels(spark, sf)).groupBy("kind", F.when(F.col("present"), "present").otherwise("missing").alias("status")).agg(F.count("*").alias("n"))


_UTIL = """, ut AS (SELECT model_id, sum(n) AS instances, CASE WHEN count(*) FILTER (share > 0) <= 1 THEN 0 ELSE abs(sum(CASE WHEN share > 0 THEN -share * ln(share) END)) / ln(count(*) FILTER (share > 0)) END AS utilisation_entropy FROM grid GROUP BY model_id),
  pc AS (SELECT *, observed / available AS coverage, (unknown_nodes + unknown_edges) / greatest(1, elements) AS unknown_share FROM pm)"""
_RD3 = {"coverage": ("pc", "coverage"), "unknown_share": ("pc", "unknown_share"), "instances": ("ut", "instances"), "utilisation_entropy": ("ut", "utilisation_entropy")}


@query("report_construct_histograms", histograms_sql(_RD3), b.CONSTRUCTS.rstrip() + _UTIL)
def _(spark, sf):
    return report.long_histograms(constructs.measures(*_c(spark, sf))[1], list(_RD3))


@query("report_unknown_from_models", "SELECT type, count(*) AS n FROM unk GROUP BY type ORDER BY n DESC, type LIMIT 25", b.CONSTRUCTS)
def _(spark, sf):
    """Unknown types rebuilt from per-model lists alone."""
    e, _, c = _c(spark, sf)
    per = constructs.unknown_types(e, c).groupBy("model_id", "type").agg(F.sum("n").alias("n"))
    return per.groupBy("type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "type").limit(25)


@query("report_assembly", """SELECT 'parsing' AS family, 'status' AS "table", parse_status AS key, count(*) AS n FROM diag GROUP BY 3 UNION ALL SELECT 'constructs', 'frequency', construct, n FROM freq
  UNION ALL SELECT 'lexical', 'missing', type, count(*) FROM elig WHERE NOT present GROUP BY 3 UNION ALL SELECT 'size', 'models', model_id, elements FROM sz""", b.DIAGNOSTICS, b.CONSTRUCTS, b.LABELS, b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    """Tables of all families in one; here read back from their JSON."""
    e, _, c = _c(spark, sf)
    tables = {
        "parsing": {"status": b.diagnostics(spark, sf).groupBy(F.col("parse_status").alias("key")).agg(F.count("*").alias("n"))},
        "constructs": {"frequency": constructs.corpus_frequency(e, c).select(F.col("construct").alias("key"), "n")},
        "lexical": {"missing": lexical.missing_by_type(_labels(spark, sf)).select(F.col("type").alias("key"), F.col("missing").alias("n"))},
        "size": {"models": size.size_per_model(*b.graph(spark, sf)).select(F.col("model_id").alias("key"), F.col("elements").alias("n"))},
    }
    row = F.from_json("row", "key string, n long")
    return report.assemble(tables).select("family", "table", row["key"].alias("key"), row["n"].alias("n"))


_CUTS = {"treemap": 80, "bar": 20, "languages": 15, "heatmap": 60}


@query("report_cuts", " UNION ALL ".join(f"SELECT '{k}' AS cut, * FROM (SELECT token, count(*) AS n FROM tk GROUP BY token ORDER BY n DESC, token LIMIT {n}) AS c_{k}" for k, n in _CUTS.items()), b.LABELS.rstrip() + _TOK)
def _(spark, sf):
    by = _tokens(spark, sf).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return report.cuts(by, "n", "token", _CUTS)


@query("report_catalog_of_parts", """SELECT "group", kind, construct, description FROM (SELECT DISTINCT p_brand AS "group", CASE WHEN p_size % 2 = 0 THEN 'node_type' ELSE 'edge_type' END AS kind, p_type || p_size AS construct, p_name AS description FROM part) AS q
  WHERE contains(lower(concat_ws(' ', "group", kind, construct, description)), 'node')""")
def _(spark, sf):
    """A catalog made of parts: searched, sorted by group, kind and id."""
    p = b.read(spark, sf, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "node_type").otherwise("edge_type")
    none = F.lit(None).cast("map<string,string>")
    rows = p.select(F.concat("p_type", "p_size").alias("id"), kind.alias("kind"), F.lower("p_type").alias("match_type"), F.col("p_name").alias("description"), none.alias("match_data_equals"), F.create_map(F.lit("layer"), "p_brand").alias("meta"), "p_brand")
    return report.browse_catalog(constructs.known(rows), "NODE").distinct()


@query("constructs_empty_catalog", "SELECT 0 AS available, 0 AS observed, 0 AS instances, 0 AS per_model_rows, count(*) AS elements FROM events")
def _(spark, sf):
    e, m, c = _c(spark, sf)
    corpus, per_model = constructs.measures(e, m, c.limit(0))
    out = corpus["presence"].select("available", "observed").crossJoin(corpus["frequency"].select("instances")).crossJoin(per_model.agg(F.count("*").alias("per_model_rows")))  # one row each
    return out.crossJoin(e.agg(F.count("*").alias("elements")))


@query("view_corpus_kpi", f"SELECT {r('x.robustness_index', 'value')}, 1 AS n FROM ({ORACLE_SQL['parsing_status']}) AS x")
def _(spark, sf):
    return views.corpus_kpi(parsing.parse_status(b.diagnostics(spark, sf)), "robustness_index")


@query("view_of_two_tables", f"""SELECT coalesce(ok.model_id, diag.model_id) AS model_id, diag.relpath AS path, {r('r', 'skip_ratio')}, parse_status IS NULL AS no_status FROM (SELECT model_id, r FROM ok WHERE warning_count > 1) AS ok
  FULL JOIN (SELECT model_id, relpath, parse_status FROM diag WHERE parse_time_ms < 100) AS diag USING (model_id)""", b.DIAGNOSTICS)
def _(spark, sf):
    """Two tables of which neither has all models."""
    d = b.diagnostics(spark, sf)
    tables = {"a": parsing.per_model(d).where("warning_count > 1").select("model_id", "skip_ratio"), "b": d.where("parse_time_ms < 100").select("model_id", "relpath", "parse_status")}
    w = views.wide(tables)
    return w.select("model_id", F.col("`b.relpath`").alias("path"), F.col("`a.skip_ratio`").alias("skip_ratio"), F.col("`b.parse_status`").isNull().alias("no_status"))


_W = views.Filter


@query("view_filters", f"""SELECT model_id AS key, {r('parse_time_ms', 'value')} FROM ok WHERE parse_status = 'success' AND elements_loaded >= 3 AND parse_time_ms < 120""", b.DIAGNOSTICS)
def _(spark, sf):
    f = (_W("parsing.parse_status", "eq", "success"), _W("parsing.elements_loaded", "gte", 3), _W("parsing.parse_time_ms", "lt", 120))
    return views.run(_wide(spark, sf), views.ViewSpec("b", "bar", "model_id", y="parsing.parse_time_ms", filters=f))


@query("view_all_fields", " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) AS n, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct FROM ok" for f, c in (
        ("parsing.parse_status", "parse_status"), ("parsing.elements_loaded", "elements_loaded"), ("parsing.elements_skipped", "elements_skipped"), ("parsing.skip_ratio", "r"), ("parsing.parse_time_ms", "parse_time_ms"),
        ("parsing.file_size_bytes_source", "file_size_bytes_source"), ("parsing.file_size_bytes_ir", "file_size_bytes_ir"), ("parsing.warning_count", "warning_count"), ("parsing.warnings_per_element", "density"), ("relpath", "relpath"), ("model_id", "model_id"))), b.DIAGNOSTICS)
def _(spark, sf):
    w = _wide(spark, sf)
    return views.field_catalog(w.drop("parsing.warnings_by_type")).select("field", "n", "non_null", "n_distinct")


@query("lexical_model_language", r"""WITH d AS (SELECT concat_ws('/', source, CAST(doc_id % 50 AS VARCHAR)) AS model_id, lang, ' ' || regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') || ' ' AS t FROM documents WHERE text IS NOT NULL),
  g AS (SELECT model_id, lang, substr(t, i, 3) AS gram FROM (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM d) AS x),
  c AS (SELECT lang, gram, count(*) AS c FROM g WHERE lang IS NOT NULL GROUP BY ALL), k AS (SELECT DISTINCT gram FROM c), tot AS (SELECT lang, sum(c) AS t FROM c GROUP BY lang),
  p AS (SELECT k.gram, tot.lang, ln((coalesce(c.c, 0) + 0.5) / (tot.t + 0.5 * (SELECT count(*) FROM k))) AS lp FROM k CROSS JOIN tot LEFT JOIN c ON c.gram = k.gram AND c.lang = tot.lang),
  m AS (SELECT model_id, gram, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT model_id, lang, sum(n * lp) AS s FROM m JOIN p USING (gram) GROUP BY ALL)
SELECT a.model_id, coalesce(b.language, 'unknown') AS language FROM (SELECT DISTINCT concat_ws('/', source, CAST(doc_id % 50 AS VARCHAR)) AS model_id FROM documents) AS a LEFT JOIN (SELECT model_id, arg_max(lang, (s, lang)) AS language FROM s GROUP BY 1) AS b USING (model_id)""")
def _(spark, sf):
    """The language of each model, by a profile of all labelled texts."""
    d = b.read(spark, sf, "documents")
    by = d.select(F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("model_id"), "lang", "text")
    return lexical.detect_language(by, lexical.language_profile(d))


@query("report_detected_language_kpis", "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (language <> 'unknown') AS languages, max_by(language, (n, language)) AS top, CAST(coalesce(sum(n) FILTER (language = 'unknown'), 0) AS BIGINT) AS unknown FROM (SELECT language, count(*) AS n FROM (" + ORACLE_SQL["lexical_model_language"] + ") AS l GROUP BY 1) AS q")
def _(spark, sf):
    d = b.read(spark, sf, "documents")
    by = d.select(F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("model_id"), "lang", "text")
    return report.language_kpis(lexical.language_usage(lexical.detect_language(by, lexical.language_profile(d))))


# --- labels of all kinds, unknown types of both sides, measures switched on and off ---------------------------------

_KINDS = """, ent2 AS (SELECT p_brand AS model_id, 'p' || p_partkey AS id, p_type AS type, p_size, p_name FROM part),
  all_labels AS (SELECT model_id, id AS label_id, 'node' AS kind, type, CASE WHEN p_size % 3 = 0 THEN 'shown ' || p_size ELSE p_name END AS label FROM ent2
    UNION ALL SELECT model_id, id || '::operation::0', 'operation', type || '.operation', p_name FROM ent2 WHERE p_size % 2 = 0 UNION ALL SELECT model_id, id || '::operation::1', 'operation', type || '.operation', NULL FROM ent2 WHERE p_size % 2 = 0
    UNION ALL SELECT model_id, id || '::literal::0', 'literal', type || '.literal', 'L' || p_size FROM ent2 WHERE p_size % 5 = 0
    UNION ALL SELECT model_id, 'to' || id, 'edge', 'Flow', CASE WHEN p_size % 4 = 0 THEN 'flow ' || p_size END FROM ent2)"""


@query("labels_all_kinds", "SELECT model_id, label_id, kind, type, label FROM all_labels", b.LABELS.rstrip() + _KINDS)
def _(spark, sf):
    """Nodes named by another attribute, operations, literals and edges."""
    p = b.read(spark, sf, "part")
    none, size_ = F.lit(None).cast("string"), F.col("p_size")

    def entry(**said):
        return F.struct(*[said.get(k, none).alias(k) for k in ("name", "label", "displayName", "title")])

    def some(test, *entries):
        return F.when(test, F.array(*entries)).otherwise(F.array()).cast(f"array<{b.ENTRY}>")

    nodes = p.select(
        F.col("p_brand").alias("model_id"), F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_type").alias("type"), F.when(size_ % 3 != 0, F.col("p_name")).alias("name"),
        F.create_map(F.lit("displayName"), F.concat(F.lit("shown "), size_)).alias("data"),
        some(size_ % 2 == 0, entry(title=F.col("p_name")), entry()).alias("operations"), some(size_ % 5 == 0, entry(name=F.concat(F.lit("L"), size_))).alias("literals"),
    )
    edges = p.select(F.col("p_brand").alias("model_id"), F.concat(F.lit("top"), "p_partkey").alias("edge_id"), F.lit("Flow").alias("type"), F.create_map(F.lit("label"), F.when(size_ % 4 == 0, F.concat(F.lit("flow "), size_))).alias("data"))
    return labels.iter_labels(nodes, edges)


_BOTH = """, two AS (SELECT 'u' || user_id AS model_id, event_type AS type, CASE WHEN event_id % 3 = 0 THEN 'edge' ELSE 'node' END AS side, regexp_extract(props, '([0-9]+)', 1) AS k FROM events),
  unk2 AS (SELECT * FROM two WHERE NOT EXISTS (SELECT 1 FROM cat WHERE cat.match_type = two.type AND cat.side = two.side AND (cat.k IS NULL OR cat.k = two.k))),
  per2 AS (SELECT model_id, type, CASE WHEN count(*) FILTER (side = 'edge') > 0 THEN count(*) FILTER (side = 'edge') ELSE count(*) END AS n FROM unk2 GROUP BY ALL)"""


def _two_sided(spark, sf):
    e = b.elements(spark, sf)
    return e.withColumn("side", F.when(F.col("element_id").cast("long") % 3 == 0, "edge").otherwise("node"))


@query("constructs_unknown_both_sides", "SELECT model_id, type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY n DESC, type) AS rank FROM per2) AS q WHERE rank <= 2", b.CONSTRUCTS.rstrip() + _BOTH)
def _(spark, sf):
    """Types that are unknown as nodes and as edges count by their edges; two of each model."""
    unknown = constructs.unknown_types(_two_sided(spark, sf), b.catalog(spark))
    return constructs.top_unknown_per_model(unknown, 2)


@query("constructs_unknown_both_sides_total", "SELECT type, CAST(sum(n) AS BIGINT) AS n FROM per2 GROUP BY type ORDER BY n DESC, type LIMIT 25", b.CONSTRUCTS.rstrip() + _BOTH)
def _(spark, sf):
    return constructs.top_unknown(constructs.unknown_types(_two_sided(spark, sf), b.catalog(spark)))


@query("lexical_switches", long_sql({"lexical": {"length": "lexical_length", "words": "lexical_words"}}))
def _(spark, sf):
    """Only the measures that are switched on have rows."""
    found = lexical.measures(_labels(spark, sf), b.models(spark, sf), enabled={"length", "words"})
    return report.as_long("lexical", "length", found["length"]).unionByName(report.as_long("lexical", "words", found["words"]))
