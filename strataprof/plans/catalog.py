"""All queries of the profiling operators and the SQL that they are held against.

Doubles are rounded to six digits on both sides, since sums run in no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataprof.functions import stats, text
from strataprof.operators import constructs, graph, labels, lexical, parsing, report, scan, size, views
from strataprof.plans import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, integers to bigint; no negative zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(out)


def query(name: str, sql: str | None = None, *parts: str):
    """Register a query; ``parts`` are common table expressions that come before ``sql``."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = (f"WITH RECURSIVE {','.join(p.strip() for p in parts)}\n{sql}" if parts else sql)
        return fn

    return wrap


def r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def summed(col: str, prefix: str) -> str:
    c = f"CAST({col} AS DOUBLE)"
    parts = [("n", None), ("min", f"min({c})"), ("p25", f"quantile_cont({c}, 0.25)"), ("median", f"quantile_cont({c}, 0.5)"), ("mean", f"avg({c})"),
             ("p75", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})"), ("std", f"stddev_samp({c})")]
    return ", ".join(big(f"count({c})", f"{prefix}_n") if e is None else r(f"coalesce({e}, 0)", f"{prefix}_{n}") for n, e in parts)


# --- scan ------------------------------------------------------------------------------------------------------


def _scanned(spark, sf):
    return scan.scan(b.files(spark, sf), include=b.INCLUDE, exclude=["src1/de/**"], limit_mb=0.005)


@query("scan_status", "SELECT relpath, name, ext, length, sha256, status FROM scanned", b.FILES)
def _(spark, sf):
    return _scanned(spark, sf).select("relpath", "name", "ext", "length", "sha256", "status")


@query("scan_totals", "SELECT count(*) AS total_seen, " + ", ".join(f"count(*) FILTER (status = '{k}') AS n_{k}" for k in ("candidate", "unreadable", "too_large", "filtered", "duplicate")) + " FROM scanned", b.FILES)
def _(spark, sf):
    return scan.totals(_scanned(spark, sf))


@query("scan_extensions", "SELECT ext, count(*) AS n_files FROM scanned WHERE status <> 'filtered' GROUP BY ext", b.FILES)
def _(spark, sf):
    return scan.extension_histogram(_scanned(spark, sf))


@query("scan_duplicates", "SELECT sha256, count(*) AS n_files, string_agg(relpath, ';' ORDER BY relpath) AS members FROM scanned WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1", b.FILES)
def _(spark, sf):
    return scan.duplicate_groups(_scanned(spark, sf)).withColumn("members", F.array_join("members", ";"))


@query("scan_browse", """SELECT relpath, length, status, (SELECT count(*) FROM scanned WHERE status = 'candidate' AND contains(lower(relpath), 'src3/')) AS total
FROM scanned WHERE status = 'candidate' AND contains(lower(relpath), 'src3/') ORDER BY relpath LIMIT 20 OFFSET 3""", b.FILES)
def _(spark, sf):
    return scan.browse(_scanned(spark, sf), "candidate", "SRC3/", offset=3, limit=20)


@query("scan_model_ids", "SELECT relpath, substr(coalesce(sha256, sha256(relpath)), 1, 16) AS model_id FROM scanned", b.FILES)
def _(spark, sf):
    return _scanned(spark, sf).select("relpath", scan.model_id(F.col("sha256"), F.col("relpath")).alias("model_id"))


# --- labels and text -------------------------------------------------------------------------------------------


def _labels(spark, sf):
    return labels.iter_labels(b.labelled_nodes(spark, sf))


def _tokens(spark, sf):
    return lexical.tokenised(_labels(spark, sf))


@query("labels", "SELECT model_id, label_id, kind, type, label FROM labels", b.LABELS)
def _(spark, sf):
    return _labels(spark, sf)


@query("text_tokens", "SELECT label_id, array_to_string(tokens, '|') AS tokens, chars, n_tokens, chars < 5 OR n_tokens < 2 AS short, chars > 30 OR n_tokens > 8 AS long FROM toks", b.LABELS)
def _(spark, sf):
    n = F.col("n_tokens")
    return _tokens(spark, sf).select("label_id", F.array_join("tokens", "|").alias("tokens"), "chars", "n_tokens", text.is_short(F.col("label"), n).alias("short"), text.is_long(F.col("label"), n).alias("long"))


@query("text_styles", "SELECT label_id, style FROM styled", b.LABELS)
def _(spark, sf):
    return _tokens(spark, sf).select("label_id", text.case_style(F.col("label")).alias("style"))


_CAMEL = "[^\\p{L}\\p{N}]+"


@query("text_document_tokens", f"""SELECT lang, count(*) AS tokens, count(DISTINCT token) AS vocabulary FROM (
  SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '{_CAMEL}'), lambda x : x <> '')) AS token FROM documents) AS t GROUP BY lang""")
def _(spark, sf):
    tokens = text.tokenizer(text.TokenizerConfig(lowercase=True, split_camel_case=False, unicode_nfkc=False))
    rows = b.read(spark, sf, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("token"))
    by = rows.groupBy("lang", "token").agg(F.count("*").alias("n"))  # two levels: no set of tokens per language in one row
    return by.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count("*").alias("vocabulary"))


@query("text_nfkc")
def _(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id", text.nfkc(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"))


@query("text_human_bytes", """SELECT doc_id, CASE WHEN n >= 1048576 THEN CASE WHEN n / 1048576 >= 100 THEN printf('%.0f', round(n / 1048576, 0)) WHEN n / 1048576 >= 10 THEN printf('%.1f', round(n / 1048576, 1)) ELSE printf('%.2f', round(n / 1048576, 2)) END || ' MB'
  WHEN n >= 1024 THEN CASE WHEN n / 1024 >= 100 THEN printf('%.0f', round(n / 1024, 0)) WHEN n / 1024 >= 10 THEN printf('%.1f', round(n / 1024, 1)) ELSE printf('%.2f', round(n / 1024, 2)) END || ' KB'
  ELSE printf('%.0f', n) || ' B' END AS size FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * 64 AS n FROM documents) AS d""")
def _(spark, sf):
    return b.read(spark, sf, "documents").select("doc_id", text.human_bytes(F.col("n_chars") * 64.0).alias("size"))


# --- lexical measures ------------------------------------------------------------------------------------------

_PRES = """, pres AS (SELECT m.model_id, coalesce(e, 0) AS eligible, coalesce(p, 0) AS present, coalesce(p / e, 0) AS present_share FROM models m
  LEFT JOIN (SELECT model_id, count(*) AS e, count(*) FILTER (present) AS p FROM elig GROUP BY model_id) AS x ON x.model_id = m.model_id)"""


@query("lexical_presence_per_model", f"SELECT model_id, eligible, present, {r('present_share', 'present_share')}, {r('1 - present_share', 'missing_share')} FROM pres", b.LABELS.rstrip() + _PRES)
def _(spark, sf):
    return lexical.presence_per_model(_labels(spark, sf), b.models(spark, sf))


@query("lexical_presence", f"SELECT {big('sum(eligible)', 'eligible')}, {big('sum(present)', 'present')}, {r('sum(present) / sum(eligible)', 'present_share')}, {r('1 - sum(present) / sum(eligible)', 'missing_share')}, {summed('present_share', 'model_share')}, {r('100 * sum(present) / sum(eligible)', 'score')} FROM pres", b.LABELS.rstrip() + _PRES)
def _(spark, sf):
    return lexical.presence(_labels(spark, sf), b.models(spark, sf))


@query("lexical_missing_by_type", "SELECT type, count(*) AS missing FROM elig WHERE NOT present GROUP BY type", b.LABELS)
def _(spark, sf):
    return lexical.missing_by_type(_labels(spark, sf))


@query("lexical_missing_by_model_and_type", "SELECT model_id, type, count(*) AS missing FROM elig WHERE NOT present GROUP BY model_id, type", b.LABELS)
def _(spark, sf):
    return lexical.missing_by_type(_labels(spark, sf), per_model=True)


_LEN = """, len AS (SELECT m.model_id, coalesce(n, 0) AS label_count, cm, cmed, cp, tm, tmed, tp, s, l FROM models m LEFT JOIN (
  SELECT model_id, count(*) AS n, avg(chars) AS cm, quantile_cont(chars, 0.5) AS cmed, quantile_cont(chars, 0.95) AS cp, avg(n_tokens) AS tm,
    quantile_cont(n_tokens, 0.5) AS tmed, quantile_cont(n_tokens, 0.95) AS tp, count(*) FILTER (chars < 5 OR n_tokens < 2) / count(*) AS s,
    count(*) FILTER (chars > 30 OR n_tokens > 8) / count(*) AS l FROM toks GROUP BY model_id) AS x ON x.model_id = m.model_id)"""
_LEN_COLS = [("cm", "chars_mean"), ("cmed", "chars_median"), ("cp", "chars_p95"), ("tm", "n_tokens_mean"), ("tmed", "n_tokens_median"), ("tp", "n_tokens_p95"), ("s", "short_share"), ("l", "long_share")]


@query("lexical_length_per_model", f"SELECT model_id, label_count, {', '.join(r(f'coalesce({a}, 0)', n) for a, n in _LEN_COLS)} FROM len", b.LABELS.rstrip() + _LEN)
def _(spark, sf):
    return lexical.length_per_model(_tokens(spark, sf), b.models(spark, sf))


@query("lexical_length", f"SELECT {summed('cmed', 'chars')}, {summed('tmed', 'tokens')}, {summed('s', 'short')}, {summed('l', 'long')} FROM len WHERE label_count > 0", b.LABELS.rstrip() + _LEN)
def _(spark, sf):
    return lexical.length(_tokens(spark, sf), b.models(spark, sf))


_STY = """, sm AS (SELECT model_id, style, n, n / sum(n) OVER (PARTITION BY model_id) AS share FROM (SELECT model_id, style, count(*) AS n FROM styled GROUP BY ALL) AS q),
  ent AS (SELECT m.model_id, coalesce(h, 0) AS style_entropy FROM models m LEFT JOIN (SELECT model_id, abs(sum(-share * log2(share))) AS h FROM sm GROUP BY model_id) AS q ON q.model_id = m.model_id)"""


@query("lexical_styles_per_model", f"SELECT model_id, style, n, {r('share', 'share')} FROM sm", b.LABELS.rstrip() + _STY)
def _(spark, sf):
    return lexical.styles_per_model(_tokens(spark, sf))


@query("lexical_styles", f"SELECT style, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM styled GROUP BY style", b.LABELS)
def _(spark, sf):
    return lexical.styles(_tokens(spark, sf))


@query("lexical_style_entropy", f"SELECT {summed('style_entropy', 'entropy')} FROM ent", b.LABELS.rstrip() + _STY)
def _(spark, sf):
    return lexical.style_entropy(_tokens(spark, sf), b.models(spark, sf))


_WORDS = """, wm AS (SELECT m.model_id, coalesce(n, 0) AS labels, coalesce(s, 0) AS single, coalesce(u, 0) AS multi, coalesce(s / n, 0) AS single_share FROM models m LEFT JOIN (
  SELECT model_id, count(*) AS n, count(*) FILTER (n_tokens = 1) AS s, count(*) FILTER (n_tokens > 1) AS u FROM toks GROUP BY model_id) AS q ON q.model_id = m.model_id)"""


@query("lexical_words_per_model", f"SELECT model_id, labels, single, multi, {r('single_share', 'single_share')} FROM wm", b.LABELS.rstrip() + _WORDS)
def _(spark, sf):
    return lexical.words_per_model(_tokens(spark, sf), b.models(spark, sf))


@query("lexical_words", f"SELECT {big('sum(single)', 'single')}, {big('sum(multi)', 'multi')}, {r('sum(single) / sum(labels)', 'single_share')}, {summed('CASE WHEN labels > 0 THEN single_share END', 'model_share')} FROM wm", b.LABELS.rstrip() + _WORDS)
def _(spark, sf):
    return lexical.words(_tokens(spark, sf), b.models(spark, sf))


_TOK = """, tk AS (SELECT model_id, unnest(tokens) AS token FROM toks),
  dm AS (SELECT m.model_id, coalesce(n, 0) AS tokens, coalesce(v, 0) AS vocabulary, coalesce(v / n, 0) AS type_token_ratio FROM models m LEFT JOIN (
  SELECT model_id, count(*) AS n, count(DISTINCT token) AS v FROM tk GROUP BY model_id) AS q ON q.model_id = m.model_id)"""


@query("lexical_diversity_per_model", f"SELECT model_id, tokens, vocabulary, {r('type_token_ratio', 'type_token_ratio')} FROM dm", b.LABELS.rstrip() + _TOK)
def _(spark, sf):
    return lexical.diversity_per_model(_tokens(spark, sf), b.models(spark, sf))


@query("lexical_diversity", f"SELECT count(*) AS tokens, count(DISTINCT token) AS vocabulary, {r('count(DISTINCT token) / count(*)', 'type_token_ratio')} FROM tk", b.LABELS.rstrip() + _TOK)
def _(spark, sf):
    return lexical.diversity(_tokens(spark, sf))


@query("lexical_top_labels", "SELECT t AS label, count(*) AS n FROM toks GROUP BY t ORDER BY n DESC, label LIMIT 50", b.LABELS)
def _(spark, sf):
    return lexical.top_labels(_tokens(spark, sf))


@query("lexical_top_tokens", "SELECT token, count(*) AS n FROM tk GROUP BY token ORDER BY n DESC, token LIMIT 50", b.LABELS.rstrip() + _TOK)
def _(spark, sf):
    return lexical.top_tokens(_tokens(spark, sf))


def _profiled(spark, sf):
    return lexical.profile_per_model(_labels(spark, sf), b.models(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical profile of each model: presence, length, naming, words and diversity in one row."""
    return rounded(_profiled(spark, sf_dir))


@query(
    "lexical_profile",
    f"""SELECT pres.model_id, eligible, present, {r('present_share', 'present_share')}, label_count, {', '.join(r(f'coalesce({a}, 0)', n) for a, n in _LEN_COLS)},
  {r('style_entropy', 'style_entropy')}, single, multi, {r('single_share', 'single_share')}, tokens, vocabulary, {r('type_token_ratio', 'type_token_ratio')}
  FROM pres JOIN len USING (model_id) JOIN ent USING (model_id) JOIN wm USING (model_id) JOIN dm USING (model_id)""",
    b.LABELS.rstrip() + _PRES + _LEN + _STY + _WORDS + _TOK,
)
def _(spark, sf):
    return _profiled(spark, sf)


@query("lexical_language_usage")
def _(spark, sf):
    d = b.read(spark, sf, "documents")
    by = d.select(F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("model_id"), "lang", "text")
    profile = lexical.language_profile(d)
    return lexical.language_usage(lexical.detect_language(by, profile))


# --- parsing measures ------------------------------------------------------------------------------------------


@query("parsing_status", f"""SELECT count(*) AS n_models, count(*) FILTER (parse_status = 'success') AS n_success, count(*) FILTER (parse_status = 'warning') AS n_partial,
  count(*) FILTER (parse_status = 'failure') AS n_failed, {r("count(*) FILTER (parse_status = 'success') / count(*)", 'share_success')}, {r("count(*) FILTER (parse_status = 'warning') / count(*)", 'share_partial')},
  {r("count(*) FILTER (parse_status = 'failure') / count(*)", 'share_failed')}, {r("(count(*) FILTER (parse_status = 'success') + 0.5 * count(*) FILTER (parse_status = 'warning')) / count(*)", 'robustness_index')},
  {r("100 * (count(*) FILTER (parse_status = 'success') + 0.5 * count(*) FILTER (parse_status = 'warning')) / count(*)", 'score')} FROM diag""", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.parse_status(b.diagnostics(spark, sf))


_RATIO = "sum(elements_skipped) / greatest(1, sum(elements_loaded) + sum(elements_skipped))"


@query("parsing_elements", f"""SELECT {big('sum(elements_loaded)', 'total_loaded')}, {big('sum(elements_skipped)', 'total_skipped')}, {r(_RATIO, 'skip_ratio')}, {summed('r', 'ratio')},
  count(*) FILTER (elements_skipped > 0) AS models_with_skips, {r('count(*) FILTER (elements_skipped > 0) / count(*)', 'share_with_skips')}, {r(f'100 * (1 - {_RATIO})', 'score')} FROM ok""", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.element_loading(b.diagnostics(spark, sf))


@query("parsing_time", f"SELECT {summed('parse_time_ms', 'ms')}, {big('sum(parse_time_ms)', 'total_ms')} FROM ok", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.parse_time(b.diagnostics(spark, sf))


@query("parsing_file_size", f"SELECT {summed('file_size_bytes_source', 'source')}, {summed('file_size_bytes_ir', 'ir')} FROM ok", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.file_size(b.diagnostics(spark, sf))


@query("parsing_warnings", f"""SELECT count(*) FILTER (warning_count > 0) AS models_with_warnings, {r('count(*) FILTER (warning_count > 0) / count(*)', 'share_with_warnings')}, {summed('warning_count', 'count')},
  {summed('density', 'density')}, {r('100 * (1 - count(*) FILTER (warning_count > 0) / count(*))', 'score')} FROM ok""", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.warnings(b.diagnostics(spark, sf))


@query("parsing_warnings_by_type", f"""SELECT kind AS warning_type, {big('sum(c)', 'total')}, count(*) AS n_models, {r('count(*) / (SELECT count(*) FROM ok)', 'share_models')}
  FROM lines JOIN ok ON ok.model_id = 'o' || l_orderkey WHERE kind <> 'AO' GROUP BY kind""", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.warnings_by_type(b.diagnostics(spark, sf))


@query("parsing_per_model", f"""SELECT model_id, parse_status, {big('elements_loaded', 'elements_loaded')}, {big('elements_skipped', 'elements_skipped')}, {r('r', 'skip_ratio')}, parse_time_ms,
  file_size_bytes_source, file_size_bytes_ir, {big('warning_count', 'warning_count')}, {r('density', 'warnings_per_element')} FROM ok""", b.DIAGNOSTICS)
def _(spark, sf):
    return parsing.per_model(b.diagnostics(spark, sf)).drop("warnings_by_type")


@query("parsing_diagnostics", """, w AS (SELECT 'o' || l_orderkey AS model_id, sum(c) AS wc, sum(r) AS sk FROM lines WHERE kind <> 'AO' GROUP BY 1),
  e AS (SELECT 'o' || l_orderkey AS model_id, sum(c) FILTER (kind[1] = 'N') AS n FROM lines GROUP BY 1)
SELECT m.model_id, CASE WHEN coalesce(wc, 0) = 0 THEN 'success' WHEN coalesce(n, 0) > 0 THEN 'warning' ELSE 'failure' END AS parse_status,
  CASE WHEN coalesce(wc, 0) > 0 AND coalesce(n, 0) = 0 THEN 'No elements loaded' END AS parse_error_msg, CAST(coalesce(n, 0) AS BIGINT) AS elements_loaded,
  CAST(coalesce(sk, 0) AS BIGINT) AS elements_skipped, CAST(coalesce(wc, 0) AS BIGINT) AS warning_count
FROM (SELECT 'o' || o_orderkey AS model_id FROM orders) m LEFT JOIN w USING (model_id) LEFT JOIN e USING (model_id)""".lstrip(", "))
def _(spark, sf):
    o, li = b.read(spark, sf, "orders"), b.read(spark, sf, "lineitem").withColumn("model_id", F.concat(F.lit("o"), "l_orderkey"))
    loaded = li.where("l_returnflag = 'N'").groupBy("model_id").agg(F.count("*").alias("loaded"))
    warned = li.where("l_returnflag <> 'A' or l_linestatus <> 'O'").select("model_id", F.concat("l_returnflag", "l_linestatus").alias("warning_type"), (F.col("l_returnflag") == "R").alias("is_skip"))
    return parsing.assemble(o.select(F.concat(F.lit("o"), "o_orderkey").alias("model_id")), loaded, warned).drop("warnings_by_type")


ORACLE_SQL["parsing_diagnostics"] = "WITH " + b.DIAGNOSTICS.strip() + ", " + ORACLE_SQL["parsing_diagnostics"]

# --- constructs ------------------------------------------------------------------------------------------------


def _c(spark, sf):
    return b.elements(spark, sf), b.element_models(spark, sf), b.catalog(spark)


@query("constructs_matches", "SELECT model_id, CAST(event_id AS VARCHAR) AS element_id, side, type, construct FROM hit", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.match(e, c)


@query("constructs_unknown_types", "SELECT model_id, side, type, count(*) AS n FROM unk GROUP BY ALL", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.unknown_types(e, c)


@query("constructs_top_unknown", "SELECT type, count(*) AS n FROM unk GROUP BY type ORDER BY n DESC, type LIMIT 25", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.top_unknown(constructs.unknown_types(e, c))


@query("constructs_top_unknown_per_model", "SELECT model_id, type, count(*) AS n, 1 AS rank FROM unk GROUP BY ALL", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.top_unknown_per_model(constructs.unknown_types(e, c))


@query("constructs_presence_per_model", f"""SELECT model_id, {big('available', 'available')}, observed, {r('observed / available', 'coverage')}, unknown_nodes, unknown_edges, elements,
  {r('(unknown_nodes + unknown_edges) / greatest(1, elements)', 'unknown_share')} FROM pm""", b.CONSTRUCTS)
def _(spark, sf):
    return constructs.presence_per_model(*_c(spark, sf))


_COV = "(SELECT count(*) FROM freq WHERE n > 0) / 6"
_UNK = "(sum(unknown_nodes) + sum(unknown_edges)) / sum(elements)"


@query("constructs_presence", f"""SELECT {big('6', 'available')}, {big('(SELECT count(*) FROM freq WHERE n > 0)', 'observed')}, {r(_COV, 'coverage')}, {r(_UNK, 'unknown_share')},
  {r(f'100 * {_COV} * (1 - {_UNK})', 'score')}, {big('sum(unknown_nodes)', 'unknown_nodes')}, {big('sum(unknown_edges)', 'unknown_edges')}, {summed('observed / available', 'coverage')} FROM pm""", b.CONSTRUCTS)
def _(spark, sf):
    return constructs.presence(*_c(spark, sf))


@query("constructs_frequency", f'SELECT construct, "group", kind, description, n, {r("share", "share")} FROM freq', b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.corpus_frequency(e, c)


@query("constructs_missing", 'SELECT "group", construct, description, kind FROM freq WHERE n = 0', b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.missing(e, c)


@query("constructs_coverage", " UNION ALL ".join(f"""SELECT '{d}' AS dimension, "{d}" AS value, count(*) AS available, count(*) FILTER (n > 0) AS observed, count(*) FILTER (n = 0) AS missing,
  {r('count(*) FILTER (n > 0) / count(*)', 'coverage')} FROM freq GROUP BY "{d}" """ for d in ("group", "kind")), b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.coverage_by(e, c)


_H = "CASE WHEN count(*) FILTER (share > 0) <= 1 THEN 0 ELSE abs(sum(CASE WHEN share > 0 THEN -share * ln(share) END)) / ln(count(*) FILTER (share > 0)) END"


@query("constructs_frequency_per_model", f"SELECT model_id, {big('sum(n)', 'instances')}, {r(_H, 'utilisation_entropy')} FROM grid GROUP BY model_id", b.CONSTRUCTS)
def _(spark, sf):
    return constructs.frequency_per_model(*_c(spark, sf))


@query("constructs_utilisation", f"SELECT {big('sum(n)', 'instances')}, {r(_H, 'utilisation_entropy')}, {r(f'100 * ({_H})', 'score')} FROM freq", b.CONSTRUCTS)
def _(spark, sf):
    e, _, c = _c(spark, sf)
    return constructs.frequency(e, c)


@query("constructs_score", f"""SELECT {r('p', 'presence_score')}, {r('f', 'frequency_score')}, {r('(p + f) / 2', 'score')} FROM (SELECT 100 * {_COV} * (1 - {_UNK}) AS p FROM pm) AS a, (SELECT 100 * ({_H}) AS f FROM freq) AS q""", b.CONSTRUCTS)
def _(spark, sf):
    return constructs.dimension_score(*_c(spark, sf))


# --- size ------------------------------------------------------------------------------------------------------

_SIZE = """, sz AS (SELECT *, nodes + edges AS elements, edges / greatest(1, nodes) AS edges_per_node FROM (SELECT model_id,
  (SELECT count(*) FROM gn WHERE gn.model_id = gm.model_id) AS nodes, (SELECT count(*) FROM ge WHERE ge.model_id = gm.model_id) AS edges FROM gm) AS q),
  dg AS (SELECT model_id, avg(in_degree + out_degree) AS degree_mean, avg(in_degree) AS in_mean, avg(out_degree) AS out_mean, median(in_degree + out_degree) AS degree_median, max(in_degree + out_degree) AS degree_max FROM deg GROUP BY model_id)"""


@query("size_per_model", f"SELECT model_id, nodes, edges, elements, {r('edges_per_node', 'edges_per_node')} FROM sz", b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return size.size_per_model(*b.graph(spark, sf))


@query("size", "SELECT " + ", ".join(big(f"sum({c})", f"total_{c}") for c in ("nodes", "edges", "elements")) + ", " + ", ".join(summed(c, c) for c in ("nodes", "edges", "elements", "edges_per_node")) + " FROM sz", b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return size.size(*b.graph(spark, sf))


@query("degree_per_model", f"SELECT model_id, {r('degree_mean', 'degree_mean')}, {r('in_mean', 'in_mean')}, {r('out_mean', 'out_mean')}, {r('degree_median', 'degree_median')}, {big('degree_max', 'degree_max')} FROM dg", b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return size.degree_per_model(*b.graph(spark, sf))


@query("degree", "SELECT " + ", ".join(summed(c, c) for c in ("degree_mean", "in_mean", "out_mean", "degree_median")) + " FROM dg", b.GRAPH.rstrip() + _SIZE)
def _(spark, sf):
    return size.degree(*b.graph(spark, sf))


_CONN = """, both_ways AS (SELECT DISTINCT model_id, s AS a, t AS b FROM ve UNION SELECT model_id, t, s FROM ve),
  reach(model_id, a, b) AS (SELECT model_id, node_id, node_id FROM gn UNION SELECT reach.model_id, reach.a, w.b FROM reach JOIN both_ways w ON w.model_id = reach.model_id AND w.a = reach.b),
  comp AS (SELECT model_id, a, min(b) AS c FROM reach GROUP BY model_id, a),
  cs AS (SELECT model_id, c, count(*) AS size FROM comp GROUP BY model_id, c),
  cn AS (SELECT x.model_id, components, largest, size_mean, coalesce(isolated, 0) AS isolated, coalesce(isolated, 0) / n AS isolated_share FROM (
    SELECT model_id, count(*) AS components, max(size) AS largest, avg(size) AS size_mean, sum(size) AS n FROM cs GROUP BY model_id) AS x
    LEFT JOIN (SELECT model_id, count(*) AS isolated FROM gn WHERE (model_id, node_id) NOT IN (SELECT (model_id, s) FROM ve UNION ALL SELECT (model_id, t) FROM ve) GROUP BY model_id) AS y USING (model_id))"""


@query("connectivity_per_model", f"SELECT model_id, components, largest, {r('size_mean', 'size_mean')}, isolated, {r('isolated_share', 'isolated_share')} FROM cn", b.GRAPH.rstrip() + _CONN)
def _(spark, sf):
    return size.connectivity_per_model(*b.graph(spark, sf))


@query("connectivity", f"SELECT {big('sum(isolated)', 'isolated_total')}, " + ", ".join(summed(c, c) for c in ("components", "largest", "isolated_share")) + " FROM cn", b.GRAPH.rstrip() + _CONN)
def _(spark, sf):
    return size.connectivity(*b.graph(spark, sf))


@query("containment_per_model", f"""SELECT model_id, {big('max(depth)', 'max_depth')}, {r('avg(depth)', 'mean_depth')}, {r('median(depth)', 'median_depth')}, {big('count(*) FILTER (depth = 0)', 'roots')},
  count(*) FILTER (depth > 0) AS contained, {r('count(*) FILTER (depth > 0) / count(*)', 'contained_share')} FROM td GROUP BY model_id""", b.TREE)
def _(spark, sf):
    return size.containment_per_model(*b.tree(spark, sf))


@query("containment", f"SELECT {big('sum(roots)', 'roots_total')}, {big('sum(contained)', 'contained_total')}, " + ", ".join(summed(c, c) for c in ("max_depth", "mean_depth", "contained_share")) + """ FROM (
  SELECT max(depth) AS max_depth, avg(depth) AS mean_depth, count(*) FILTER (depth = 0) AS roots, count(*) FILTER (depth > 0) AS contained, count(*) FILTER (depth > 0) / count(*) AS contained_share FROM td GROUP BY model_id) AS q""", b.TREE)
def _(spark, sf):
    return size.containment(*b.tree(spark, sf))


@query("graph_model", "SELECT node_id, CASE WHEN node_id[1] = 'o' THEN 'Order' ELSE 'Part' END AS type FROM gn WHERE model_id = 'c7'", b.GRAPH)
def _(spark, sf):
    return b.graph(spark, sf)[1].where("model_id = 'c7'").select("node_id", "type")


@query("graph_dangling", "SELECT model_id, s AS source_id, t AS target_id FROM ge EXCEPT ALL SELECT model_id, s, t FROM ve", b.GRAPH)
def _(spark, sf):
    _, nodes, edges = b.graph(spark, sf)
    cols = ("model_id", "source_id", "target_id")
    return edges.select(*cols).exceptAll(graph.valid_edges(nodes, edges).select(*cols))
