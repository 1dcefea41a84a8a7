"""The given tables in the roles of files, models, nodes, edges, diagnostics, elements and catalogs.

Each role has a DataFrame and, for the checks, the same in SQL as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<name:string,label:string,displayName:string,title:string>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a file; every third ending in capitals, every eleventh without one."""
    d = read(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 11 == 0, F.col("doc_id").cast("string")).otherwise(
        F.concat_ws(".", "doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")))
    )
    return d.select(F.concat_ws("/", "source", "lang", name).alias("relpath"), name.alias("name"), F.col("n_chars").alias("length"), F.col("text").alias("content"))


FILES = """
files AS (SELECT concat_ws('/', source, lang, name) AS relpath, name, n_chars AS length, text AS content FROM (
  SELECT *, CASE WHEN doc_id % 11 = 0 THEN CAST(doc_id AS VARCHAR)
    ELSE doc_id || '.' || CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END END AS name FROM documents) AS d),
staged AS (SELECT *, CASE WHEN NOT (regexp_matches(lower(name), '^.*\\.(en|de|fr)$') OR regexp_matches(lower(name), '^[0-9]*$'))
    OR starts_with(lower(relpath), 'src1/de') OR regexp_matches(lower(relpath), '^src1/de/.*$') THEN 'filtered'
    WHEN content IS NULL THEN 'unreadable' WHEN length > 5242 THEN 'too_large' END AS s FROM files),
hashed AS (SELECT *, CASE WHEN s IS NULL THEN sha256(content) END AS sha256 FROM staged),
scanned AS (SELECT relpath, name, length, sha256,
    CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^.+(\\.[^.]+)$', 1) ELSE '.noext' END AS ext,
    coalesce(s, CASE WHEN relpath = min(relpath) OVER (PARTITION BY sha256) THEN 'candidate' ELSE 'duplicate' END) AS status FROM hashed)
"""

INCLUDE = ["*.en", "*.de", "*.fr", "[0-9]", "[0-9][0-9]*[0-9]"]


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a model; two nations are models without any label."""
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("model_id")).distinct()
    empty = read(spark, sf_dir, "nation").where("n_nationkey < 2").select(F.col("n_name").alias("model_id"))
    return brands.unionByName(empty).withColumn("language", F.lit("UML"))


def labelled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a node; names in several styles, some missing or blank; every second has two attributes."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 6
    name = (
        F.when(F.col("p_size") % 7 == 0, F.lit(None)).when(F.col("p_size") % 11 == 0, "  ")
        .when(k == 0, F.regexp_replace("p_name", " ", "_")).when(k == 1, F.upper("p_name")).when(k == 2, F.regexp_replace("p_name", " ", "-"))
        .when(k == 3, F.col("p_brand")).when(k == 4, F.concat(F.upper(F.substring("p_name", 1, 1)), F.regexp_replace(F.substring("p_name", 2, 99), " ", "X")))
        .otherwise(F.concat_ws(" ", "p_name", "p_partkey"))
    )
    none = F.lit(None).cast("string")
    entries = F.array(F.struct(F.col("p_type").alias("name"), none.alias("label"), none.alias("displayName"), none.alias("title")),
                      F.struct(none.alias("name"), F.col("p_name").alias("label"), none.alias("displayName"), none.alias("title")))
    return p.select(
        F.col("p_brand").alias("model_id"), F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_partkey").alias("pos"),
        F.when(F.col("p_size") % 5 == 0, "uml:LiteralString").otherwise(F.col("p_type")).alias("type"), name.alias("name"),
        F.create_map().cast("map<string,string>").alias("data"),
        F.when(F.col("p_size") % 2 == 0, entries).otherwise(F.array()).cast(f"array<{ENTRY}>").alias("attributes"),
    )


LABELS = """
models AS (SELECT DISTINCT p_brand AS model_id FROM part UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 2),
lnodes AS (SELECT p_brand AS model_id, 'p' || p_partkey AS node_id, p_size, p_type, p_name,
  CASE WHEN p_size % 5 = 0 THEN 'uml:LiteralString' ELSE p_type END AS type,
  CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '  ' WHEN p_partkey % 6 = 0 THEN replace(p_name, ' ', '_')
    WHEN p_partkey % 6 = 1 THEN upper(p_name) WHEN p_partkey % 6 = 2 THEN replace(p_name, ' ', '-') WHEN p_partkey % 6 = 3 THEN p_brand
    WHEN p_partkey % 6 = 4 THEN upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', 'X') ELSE p_name || ' ' || p_partkey END AS name FROM part),
labels AS (SELECT model_id, node_id AS label_id, 'node' AS kind, type, name AS label FROM lnodes
  UNION ALL SELECT model_id, node_id || '::attribute::' || i, 'attribute', type || '.attribute', CASE i WHEN 0 THEN p_type ELSE p_name END
  FROM lnodes, (VALUES (0), (1)) AS t(i) WHERE p_size % 2 = 0),
elig AS (SELECT *, coalesce(trim(label), '') <> '' AS present FROM labels
  WHERE NOT list_contains(['LiteralString'], list_last(string_split(type, ':')))),
toks AS (SELECT *, length(label) AS chars, len(tokens) AS n_tokens FROM (
  SELECT *, trim(label) AS t, list_filter(regexp_split_to_array(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(label), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'),
      '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'),
    '[^\\p{L}\\p{N}]+'), lambda x : x <> '') AS tokens FROM labels WHERE coalesce(trim(label), '') <> '') AS z),
styled AS (SELECT *, CASE WHEN regexp_matches(t, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches(t, '[A-Z]') THEN 'camelCase'
  WHEN regexp_matches(t, '^[A-Z][a-zA-Z0-9]*$') AND regexp_matches(t, '[a-z]') THEN 'PascalCase'
  WHEN regexp_matches(t, '^[A-Z0-9]+(_[A-Z0-9]+)+$') THEN 'UPPER_CASE' WHEN regexp_matches(t, '^[a-z0-9]+(_[a-z0-9]+)+$') THEN 'snake_case'
  WHEN regexp_matches(t, '^[a-z0-9]+(-[a-z0-9]+)+$') THEN 'kebab-case' WHEN lower(t) = t AND upper(t) <> t THEN 'lowercase'
  WHEN upper(t) = t AND lower(t) <> t AND regexp_matches(t, '^\\p{L}+$') THEN 'UPPERCASE' ELSE 'mixed' END AS style FROM toks)
"""


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a parsed model: lines sent back are skipped, lines by flag and status are warnings."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    kind = F.concat("l_returnflag", "l_linestatus")
    by = li.groupBy("l_orderkey", kind.alias("kind")).agg(
        F.count("*").alias("c"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.count_if(F.col("l_returnflag") == "R").alias("r")
    )
    per = by.groupBy("l_orderkey").agg(
        F.sum("c").alias("n"), F.sum("r").alias("r"), F.sum("q").alias("q"), F.sum("p").alias("p"),
        F.map_from_entries(F.collect_list(F.when(F.col("kind") != "AO", F.struct("kind", "c")))).alias("w"),
        F.coalesce(F.sum(F.when(F.col("kind") != "AO", F.col("c"))), F.lit(0)).alias("wc"),
    )
    status = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "P", "warning").otherwise("failure")
    return o.join(per, o.o_orderkey == per.l_orderkey).select(
        F.concat(F.lit("o"), "o_orderkey").alias("model_id"), F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("relpath"), status.alias("parse_status"),
        (F.col("n") - F.col("r")).alias("elements_loaded"), F.col("r").alias("elements_skipped"), F.col("q").cast("long").alias("parse_time_ms"),
        F.floor("o_totalprice").alias("file_size_bytes_source"), F.floor(F.round(F.col("p"), 2) / 10).alias("file_size_bytes_ir"),
        F.col("wc").alias("warning_count"), F.col("w").alias("warnings_by_type"),
    )


DIAGNOSTICS = """
lines AS (SELECT l_orderkey, l_returnflag || l_linestatus AS kind, count(*) AS c, sum(l_quantity) AS q, sum(l_extendedprice) AS p,
  count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY ALL),
diag AS (SELECT 'o' || o_orderkey AS model_id, o_orderpriority || '/' || o_orderkey AS relpath,
  CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'P' THEN 'warning' ELSE 'failure' END AS parse_status,
  sum(c) - sum(r) AS elements_loaded, sum(r) AS elements_skipped, CAST(sum(q) AS BIGINT) AS parse_time_ms,
  CAST(floor(o_totalprice) AS BIGINT) AS file_size_bytes_source, CAST(floor(round(sum(p), 2) / 10) AS BIGINT) AS file_size_bytes_ir,
  coalesce(sum(c) FILTER (kind <> 'AO'), 0) AS warning_count
  FROM orders JOIN lines ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority, o_totalprice),
ok AS (SELECT *, elements_skipped / greatest(1, elements_loaded + elements_skipped) AS r, warning_count / greatest(1, elements_loaded) AS density
  FROM diag WHERE parse_status <> 'failure')
"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("model_id"), F.col("event_id").cast("string").alias("element_id"),
        F.when(F.col("event_type").isin("click", "view", "error"), "node").otherwise("edge").alias("side"), F.col("event_type").alias("type"),
        F.create_map(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1)).alias("data"),
    )


#: A catalog for the event types; one construct asks for data, one never occurs, one row stands for unknown types.
CATALOG_ROWS = [
    ("ev:Click", "node_type", "click", "a click", None, {"layer": "input"}),
    ("ev:View", "node_type", "view", "a view", None, {"layer": "input"}),
    ("ev:View7", "node_data", "view", "a view of seven", {"k": "7"}, {"group": "special"}),
    ("ev:Error", "node_type", "error", "an error", None, {"category": "fault"}),
    ("ev:Purchase", "edge_type", "purchase", "a purchase", None, {"layer": "commerce"}),
    ("ev:Refund", "edge_type", "refund", "a refund", None, {}),
    ("UNKNOWN_EDGE", "edge_type", "signup", "anything else", None, {}),
]


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG_ROWS, "id string, kind string, match_type string, description string, match_data_equals map<string,string>, meta map<string,string>")


def element_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).select("model_id").distinct()


CONSTRUCTS = """
cat(construct, kind, side, match_type, description, k, "group") AS (VALUES
  ('ev:Click', 'node_type', 'node', 'click', 'a click', NULL, 'input'), ('ev:View', 'node_type', 'node', 'view', 'a view', NULL, 'input'),
  ('ev:View7', 'node_data', 'node', 'view', 'a view of seven', '7', 'special'), ('ev:Error', 'node_type', 'node', 'error', 'an error', NULL, 'fault'),
  ('ev:Purchase', 'edge_type', 'edge', 'purchase', 'a purchase', NULL, 'commerce'), ('ev:Refund', 'edge_type', 'edge', 'refund', 'a refund', NULL, '—')),
el AS (SELECT 'u' || user_id AS model_id, event_id, event_type AS type, regexp_extract(props, '([0-9]+)', 1) AS k,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN 'node' ELSE 'edge' END AS side FROM events),
hit AS (SELECT el.model_id, el.event_id, el.side, el.type, cat.construct FROM el JOIN cat
  ON el.type = cat.match_type AND el.side = cat.side AND (cat.k IS NULL OR cat.k = el.k)),
unk AS (SELECT * FROM el WHERE event_id NOT IN (SELECT event_id FROM hit)),
ms AS (SELECT DISTINCT model_id FROM el),
cnt AS (SELECT model_id, construct, count(*) AS n FROM hit GROUP BY ALL),
grid AS (SELECT model_id, construct, n, n / greatest(1, sum(n) OVER (PARTITION BY model_id)) AS share FROM (
  SELECT ms.model_id, cat.construct, coalesce(cnt.n, 0) AS n FROM ms CROSS JOIN cat LEFT JOIN cnt ON cnt.model_id = ms.model_id AND cnt.construct = cat.construct) AS g),
freq AS (SELECT construct, "group", kind, description, n, n / sum(n) OVER () AS share FROM (
  SELECT cat.*, (SELECT count(*) FROM hit WHERE hit.construct = cat.construct) AS n FROM cat) AS f),
pm AS (SELECT ms.model_id, 6 AS available, (SELECT count(*) FROM cnt WHERE cnt.model_id = ms.model_id) AS observed,
  (SELECT count(*) FROM unk WHERE unk.model_id = ms.model_id AND side = 'node') AS unknown_nodes,
  (SELECT count(*) FROM unk WHERE unk.model_id = ms.model_id AND side = 'edge') AS unknown_edges,
  (SELECT count(*) FROM el WHERE el.model_id = ms.model_id) AS elements FROM ms)
"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer is a model; orders and parts are nodes, lines edges; a seventh line points nowhere."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    j = o.join(li, o.o_orderkey == li.l_orderkey)
    model = F.concat(F.lit("c"), "o_custkey").alias("model_id")
    none = F.create_map().cast("map<string,string>").alias("data")
    ms = o.select(model, F.lit("UML").alias("language")).distinct()
    order_nodes = o.select(model, F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.lit("Order").alias("type"))
    part_nodes = j.where("l_linenumber <> 7").select(model, F.concat(F.lit("p"), "l_partkey").alias("node_id"), F.lit("Part").alias("type")).distinct()
    target = F.concat(F.when(F.col("l_linenumber") == 7, "x").otherwise("p"), "l_partkey")
    edges = j.select(
        model, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"), F.concat(F.lit("o"), "o_orderkey").alias("source_id"),
        target.alias("target_id"), F.when(F.col("l_returnflag") == "A", "contains").otherwise("association").alias("type"), none,
    )
    return ms, order_nodes.unionByName(part_nodes), edges


GRAPH = """
gm AS (SELECT DISTINCT 'c' || o_custkey AS model_id FROM orders),
gj AS (SELECT 'c' || o_custkey AS model_id, * FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
gn AS (SELECT 'c' || o_custkey AS model_id, 'o' || o_orderkey AS node_id FROM orders
  UNION ALL SELECT DISTINCT model_id, 'p' || l_partkey FROM gj WHERE l_linenumber <> 7),
ge AS (SELECT model_id, 'o' || o_orderkey AS s, CASE WHEN l_linenumber = 7 THEN 'x' ELSE 'p' END || l_partkey AS t,
  CASE WHEN l_returnflag = 'A' THEN 'contains' ELSE 'association' END AS type FROM gj),
ve AS (SELECT * FROM ge WHERE (model_id, s) IN (SELECT (model_id, node_id) FROM gn) AND (model_id, t) IN (SELECT (model_id, node_id) FROM gn)),
deg AS (SELECT gn.model_id, gn.node_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM gn
  LEFT JOIN (SELECT model_id, t, count(*) AS n FROM ge GROUP BY ALL) AS i ON i.model_id = gn.model_id AND i.t = gn.node_id
  LEFT JOIN (SELECT model_id, s, count(*) AS n FROM ge GROUP BY ALL) AS o ON o.model_id = gn.model_id AND o.s = gn.node_id)
"""


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A region is a model that holds nations, customers and orders; languages differ by region."""
    r, n, c, o = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    lang = F.when(F.col("r_regionkey") % 2 == 0, "ArchiMate-Archi").otherwise("UML")
    ms = r.select(F.col("r_name").alias("model_id"), lang.alias("language"))
    rn = r.join(n, r.r_regionkey == n.n_regionkey)
    rc = rn.join(c, rn.n_nationkey == c.c_nationkey)
    ro = rc.join(o, rc.c_custkey == o.o_custkey)

    def ident(letter: str, col: str):
        return F.concat(F.lit(letter), col)

    nodes = [(r, "r", "r_regionkey"), (rn, "n", "n_nationkey"), (rc, "c", "c_custkey"), (ro, "o", "o_orderkey")]
    edges = [(rn, "r", "r_regionkey", "n", "n_nationkey"), (rc, "n", "n_nationkey", "c", "c_custkey"), (ro, "c", "c_custkey", "o", "o_orderkey")]
    all_nodes = all_edges = None
    for d, letter, col in nodes:
        x = d.select(F.col("r_name").alias("model_id"), ident(letter, col).alias("node_id"), F.lit(letter).alias("type"))
        all_nodes = x if all_nodes is None else all_nodes.unionByName(x)
    for d, a, ac, b, bc in edges:
        # from customers on the odd regions' edges say so by data, not by type
        kind = F.when(F.col("r_regionkey") % 2 == 0, "Composition").otherwise("holds" if a == "c" else "contains")
        flag = F.create_map(F.lit("containment"), F.lit("true"))
        x = d.select(F.col("r_name").alias("model_id"), F.concat(F.lit(f"{a}{b}"), bc).alias("edge_id"), ident(a, ac).alias("source_id"), ident(b, bc).alias("target_id"), kind.alias("type"), flag.alias("data"))
        all_edges = x if all_edges is None else all_edges.unionByName(x)
    return ms, all_nodes, all_edges


TREE = """
td AS (SELECT r_name AS model_id, 0 AS depth FROM region
  UNION ALL SELECT r_name, 1 FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT r_name, 3 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)
"""
