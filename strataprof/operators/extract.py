"""Extraction as Spark jobs: files are shredded to element rows in parallel, references resolved by joins."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Collection, Iterable, Iterator
from functools import lru_cache
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from strataprof.operators.graph import cut

ELEMENTS = (
    "model_id string, seq bigint, parent_seq bigint, depth int, tag string, ns string, attrs map<string,string>, text string, "
    "anc_seqs array<bigint>, anc_tags array<string>, anc_types array<string>, error string"
)
ARCHIMATE_ITEMS = (
    "model_id string, seq bigint, ftype string, id string, xtype string, name string, source string, target string, attrs map<string,string>, "
    "documentation string, error string"
)
#: Kinds of rows that ``archimate_check_rows`` gives.
FILE, NODE, RELATION = 0, 1, 2
ARCHIMATE_CHECKS = "model_id string, seq bigint, kind int, id string, xtype string, source string, target string, error string"
SHAPES = "model_id string, seq bigint, parent_id string, shape_id string, stencil string, name string, outgoing array<string>, target string, error string, source string"
#: Stencils of connecting shapes (fixed values).
EDGE_STENCILS = ["SequenceFlow", "MessageFlow", "Association_Undirected", "Association_Unidirectional", "Association_Bidirectional", "DataAssociation"]
#: Folders of an ArchiMate file that hold elements (fixed values).
LAYERS = ["strategy", "business", "application", "technology", "motivation", "implementation_migration", "other"]


@lru_cache(1 << 12)
def _local(name: str) -> tuple[str, str]:
    return tuple(name[1:].split("}", 1)) if name.startswith("{") else ("", name)


@lru_cache(1 << 12)
def _attribute(name: str) -> str:
    ns, local = _local(name)
    return {"http://www.w3.org/2001/XMLSchema-instance": "xsi:"}.get(ns, "xmi:" if "XMI" in ns else "") + local


CHECKED_ROWS = 20_000


def xml_rows(model_id: str, text: str, ancestors: int | None = None) -> Iterator[tuple]:
    """Elements with their ancestors from the root on, the first ``ancestors`` of them; a file that is no XML gives one row
    with an error.

    The text is fed to a pull parser piece by piece and an element leaves when it ends, parents after what they hold;
    only open elements are kept.  ``seq`` tells document order.  Whether a file is XML shows at its end: a long one is read
    to there once more, keeping nothing, before its first row leaves."""
    yield from _whole(_xml_rows(model_id, text, ancestors), text, lambda said: (model_id, 0, None, 0, None, None, {}, None, [], [], [], said))


def _whole(rows: Iterator[tuple], text: str, broken: Callable[[str], tuple]) -> Iterator[tuple]:
    """The rows of a file that is XML to its end, else the one row of an error."""
    held = []
    try:
        for row in rows:
            held.append(row)
            if len(held) > CHECKED_ROWS:
                for _ in _events(text, ()):
                    pass
                break
    except ET.ParseError as e:
        yield broken(f"{type(e).__name__}: {e}")
        return
    yield from held
    yield from rows


def _xml_rows(model_id: str, text: str, ancestors: int | None) -> Iterator[tuple]:
    n, above = 0, []  # open elements: seq and what their children see as ancestors
    for event, el in _events(text, ("start", "end")):
        if event == "start":
            seqs, tags, types = above[-1][1] if above else ((), (), ())
            if above and (ancestors is None or len(above) <= ancestors):
                parent = above[-1]
                seqs, tags, types = (*seqs, parent[0]), (*tags, parent[2]), (*types, parent[3])
            attrs = el.attrib
            above.append((n, (seqs, tags, types), _local(el.tag)[1], _kind(attrs)))
            n += 1
        else:
            seq, (seqs, tags, types), tag, _ = above.pop()
            attrs = {_attribute(k): v for k, v in el.attrib.items()}
            yield (model_id, seq, above[-1][0] if above else None, len(above), tag, _local(el.tag)[0], attrs, (el.text or "").strip() or None, seqs, tags, types, None)
            el.clear()


def _kind(attrib: dict[str, str]) -> str:
    return attrib.get("type") or attrib.get("{http://www.w3.org/2001/XMLSchema-instance}type") or ""


def _events(text: str, events: tuple[str, ...], piece: int = 1 << 16) -> Iterator[tuple]:
    """Events of a pull parser; what has ended is taken from the tree that the parser builds."""
    parser = ET.XMLPullParser(("start", "end"))
    path = []

    def ready() -> Iterator[tuple]:
        for event, el in parser.read_events():
            if event == "start":
                path.append(el)
                if event in events:
                    yield event, el
            else:
                if event in events:
                    yield event, el
                path.pop()
                if path:
                    path[-1].remove(el)

    for at in range(0, len(text), piece):
        parser.feed(text[at : at + piece])
        yield from ready()
    parser.close()
    yield from ready()


def archimate_item_rows(model_id: str, text: str, anywhere: Collection[str], first: Collection[str] = ()) -> Iterator[tuple]:
    """The elements of an ArchiMate file in folders of the types ``anywhere``, at any depth, or right in the first folder of
    each of the types ``first``; each with the text of its documentation.  A file that is no XML gives one row with an error.

    Nothing else of the file becomes a row, and nothing is left to be joined to these.  No tree is built: only open
    elements are kept, and rows leave after each piece of the text."""
    yield from _whole(_archimate_item_rows(model_id, text, anywhere, first), text, lambda said: (model_id, 0, *[None] * 6, {}, None, said))


def _archimate_item_rows(model_id: str, text: str, anywhere: Collection[str], first: Collection[str], piece: int = 1 << 16) -> Iterator[tuple]:
    n, path, rows, seen = 0, [], [], set()  # path: of each open element, the row that it becomes, a text to read, or nothing
    ftype, holds, direct = None, False, False  # of the element below the root: its type, if it holds items, if they stand right in it

    def start(tag: str, attrib: dict[str, str]) -> None:
        nonlocal n, ftype, holds, direct
        depth, found = len(path), None
        if depth > 1 and holds or depth == 1:
            tag = _local(tag)[1]
            if depth == 1:
                ftype = _kind(attrib)
                holds, direct = ftype in anywhere, False
                if tag == "folder":
                    said = {_attribute(k): v for k, v in attrib.items()}.get("type")
                    if said in first and said not in seen:
                        seen.add(said)
                        if said == ftype:
                            holds = direct = True
            elif tag == "element" and (depth == 2 or not direct):
                found = [n, ftype, {_attribute(k): v for k, v in attrib.items()}, None]
            elif tag == "documentation" and type(path[-1]) is list and path[-1][3] is None:
                found = _Text()
            if type(path[-1]) is _Text:
                path[-1].over = True  # the text of an element is what comes before the first that it holds
        path.append(found)
        n += 1

    def data(piece: str) -> None:
        if type(path[-1]) is _Text and not path[-1].over:
            path[-1].said.append(piece)

    def end(_: str) -> None:
        found = path.pop()
        if found is None:
            return
        if type(found) is _Text:
            path[-1][3] = "".join(found.said).strip() or None
        else:
            seq, kind, attrs, documentation = found
            rows.append((model_id, seq, kind, *map(attrs.get, ("id", "xsi:type", "name", "source", "target")), attrs, documentation, None))

    parser = ET.XMLParser(target=SimpleNamespace(start=start, data=data, end=end))
    for at in range(0, len(text), piece):
        parser.feed(text[at : at + piece])
        yield from rows
        rows.clear()
    parser.close()
    yield from rows


def archimate_check_rows(model_id: str, text: str) -> Iterator[tuple]:
    """What ``archimate_warnings`` reads of a file: its nodes and relations without names, data and documentation, and a row
    for the file, of which ``id`` is set if it has a folder of relations.  A file that is no XML gives one row with an error."""
    yield from _whole(_archimate_check_rows(model_id, text), text, lambda said: (model_id, 0, FILE, *[None] * 4, said))


def _archimate_check_rows(model_id: str, text: str, piece: int = 1 << 16) -> Iterator[tuple]:
    n = depth = deepest = 0  # elements in a folder that holds items count down to the depth ``deepest``
    rows, seen, kind = [], set(), NODE
    names: dict[str, str] = {}

    def start(tag: str, attrib: dict[str, str]) -> None:
        nonlocal n, depth, deepest, kind
        if 1 < depth <= deepest:
            if tag == "element" or _local(tag)[1] == "element":
                found = {}
                for k, v in attrib.items():
                    try:
                        found[names[k]] = v
                    except KeyError:
                        names[k] = _attribute(k)
                        found[names[k]] = v
                get = found.get
                rows.append((model_id, n, kind, get("id"), get("xsi:type"), get("source"), get("target"), None))
        elif depth == 1:
            ftype = _kind(attrib)
            kind, deepest = NODE, 1 << 60 if ftype in LAYERS else 0
            if _local(tag)[1] == "folder":
                said = {_attribute(k): v for k, v in attrib.items()}.get("type")
                if said in ("relations", "connectors") and said not in seen:
                    seen.add(said)
                    if said == ftype:  # items stand right in it
                        kind, deepest = (RELATION if said == "relations" else NODE), 2
        depth += 1
        n += 1

    def end(_: str) -> None:
        nonlocal depth
        depth -= 1

    parser = ET.XMLParser(target=SimpleNamespace(start=start, end=end))
    for at in range(0, len(text), piece):
        parser.feed(text[at : at + piece])
        yield from rows
        rows.clear()
    parser.close()
    yield from rows
    yield (model_id, 0, FILE, "relations" if "relations" in seen else None, None, None, None, None)


class _Text:
    """What an open element says so far, and if an element in it has begun."""

    def __init__(self) -> None:
        self.said: list[str] = []
        self.over = False


def json_rows(model_id: str, text: str) -> list[tuple]:
    """Shapes, parents first; a shape without an id or a stencil, or with an id seen before, goes with what it holds."""

    def row(n: int, parent, ident=None, stencil=None, name=None, outgoing=(), target=None, error=None, source=None) -> tuple:
        return (model_id, n, parent, ident, stencil, name, list(outgoing), target, error, source)

    def ref(x):
        return x.get("resourceId") if isinstance(x, dict) else x

    try:
        root = json.loads(text)
        if not isinstance(root, dict):
            raise ValueError("no object")
    except ValueError as e:
        return [row(0, None, error=f"{type(e).__name__}: {e}")]
    rows, seen, todo = [], set(), [(root, None)]
    while todo:
        shape, parent = todo.pop()
        ident, stencil = shape.get("resourceId"), (shape.get("stencil") or {}).get("id")
        lacks = "MISSING_ATTRIBUTE" if not ident or not stencil else "DUPLICATE_ID" if ident in seen else None
        if lacks:
            rows.append(row(len(rows), parent, ident, stencil, error=lacks))
            continue
        seen.add(ident)
        outgoing = [o["resourceId"] for o in shape.get("outgoing") or [] if isinstance(o, dict) and o.get("resourceId")]
        rows.append(row(len(rows), parent, ident, stencil, (shape.get("properties") or {}).get("name"), outgoing, ref(shape.get("target")), source=ref(shape.get("source"))))
        todo.extend((c, ident) for c in reversed(shape.get("childShapes") or []) if isinstance(c, dict))
    return rows


EXTRACTORS: dict[str, tuple[Callable[[str, str], Iterable[tuple]], str]] = {
    "xml": (xml_rows, ELEMENTS), "archimate": (lambda m, t: xml_rows(m, t, 2), ELEMENTS), "xml-flat": (lambda m, t: xml_rows(m, t, 0), ELEMENTS),
    "archimate-nodes": (lambda m, t: archimate_item_rows(m, t, LAYERS, ["connectors"]), ARCHIMATE_ITEMS),
    "archimate-relations": (lambda m, t: archimate_item_rows(m, t, [], ["relations"]), ARCHIMATE_ITEMS), "archimate-checks": (archimate_check_rows, ARCHIMATE_CHECKS), "bpmn-json": (json_rows, SHAPES),
}


def register_extractor(language: str, fn: Callable[[str, str], Iterable[tuple]], schema: str) -> None:
    """``fn(model_id, text)`` gives the rows of one file, at once or one after the other."""
    EXTRACTORS[language] = (fn, schema)


#: What ``archimate``, ``archimate_nodes``, ``archimate_edges``, ``uml``, ``header``, ``unhandled``, ``unhandled_children`` and ``ecore`` read of the elements (fixed values).
ARCHIMATE_COLUMNS = "model_id seq parent_seq depth tag attrs text anc_types error".split()
NODE_COLUMNS = "model_id seq ftype id xtype name documentation error".split()
RELATION_COLUMNS = "model_id seq id xtype name source target error".split()
UML_COLUMNS = "model_id seq parent_seq tag attrs anc_seqs anc_tags error".split()
HEADER_COLUMNS = "model_id seq depth tag attrs text error".split()
ATTRIBUTE_COLUMNS = "model_id tag attrs error".split()
CHILD_COLUMNS = "model_id seq parent_seq tag error".split()
ECORE_COLUMNS = "model_id seq parent_seq depth tag attrs anc_seqs anc_tags error".split()


def shred(files: DataFrame, language: str, most_rows: int = 20_000, most_ancestors: int = 1_000_000, columns: list[str] | None = None, most_depth: int | None = None) -> DataFrame:
    """Rows of every file of ``files(model_id, text)``, in Arrow batches of many files or of parts of one.  Narrow: besides
    the text, a task holds the rows of one batch, which ends at ``most_rows`` rows or ``most_ancestors`` list entries.
    ``xml-flat`` names no ancestors but the parent: for files nested so deep that lists of them would outgrow the file.

    Python hands over whole rows: name the ``columns`` that are read, and the ``most_depth`` of elements, where the rest is not."""
    fn, schema = EXTRACTORS[language]
    whole = _parse_datatype_string(schema)
    kept = [whole.names.index(c) for c in columns or whole.names]
    depth = whole.names.index("depth") if most_depth is not None else None
    sent = StructType([whole[i] for i in kept])
    arrow = to_arrow_schema(sent)
    lists = [i for i, f in zip(kept, arrow) if pa.types.is_list(f.type)]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        every = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array([list(x.items()) if isinstance(x, dict) else x for x in every[i]] if pa.types.is_map(f.type) else every[i], type=f.type) for i, f in zip(kept, arrow)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        entries = 0
        for b in batches:
            for model_id, text in zip(b.column(0), b.column(1)):
                for row in fn(model_id.as_py(), text.as_py() or ""):
                    if depth is not None and row[depth] > most_depth:
                        continue
                    rows.append(row)
                    for i in lists:
                        entries += len(row[i] or ())
                    if len(rows) >= most_rows or entries >= most_ancestors:
                        yield packed(rows)
                        rows, entries = [], 0
        if rows:
            yield packed(rows)

    return files.select("model_id", "text").mapInArrow(run, sent)


def register_udtf(spark: SparkSession, language: str, name: str | None = None) -> str:
    """An extractor as a table function of SQL: ``SELECT t.* FROM files f, LATERAL shred_xml(f.model_id, f.text) t``.  Returns
    its name.  A lateral join is narrow: files stay in the partitions they are in."""
    fn, schema = EXTRACTORS[language]

    class Shred:
        def eval(self, model_id: str, text: str) -> Iterator[tuple]:
            yield from fn(model_id, text or "")

    name = name or "shred_" + re.sub(r"\W", "_", language)
    spark.udtf.register(name, udtf(Shred, returnType=schema))
    return name


def first_of_id(rows: DataFrame, key: str, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The first row of each id in a model, and warnings for the others."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("model_id", key).orderBy(order)))
    return ranked.where("_n = 1").drop("_n"), _warn(ranked.where("_n > 1"), "DUPLICATE_ID", True, F.col(key))


def _warn(rows: DataFrame, kind: str, skip: bool, msg: Column) -> DataFrame:
    return rows.select("model_id", F.lit(kind).alias("warning_type"), F.lit(skip).alias("is_skip"), msg.alias("msg"))


def require(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows in which all columns are set, and warnings that name what the others lack."""
    lacks = F.filter(F.array(*[F.when(F.coalesce(F.col(c) == "", F.lit(True)), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    marked = rows.withColumn("_lacks", lacks)
    return marked.where(F.size("_lacks") == 0).drop("_lacks"), _warn(marked.where(F.size("_lacks") > 0), "MISSING_ATTRIBUTE", True, F.array_join("_lacks", ","))


def unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Warnings for ends that are no node of the model; the edges stay."""
    ids = nodes.select("model_id", F.col("node_id").alias("end")).distinct()
    ends = edges.select("model_id", F.explode(F.array("source_id", "target_id")).alias("end"))  # edges are worked out once for both
    return _warn(ends.join(ids, ["model_id", "end"], "left_anti"), "UNRESOLVED_REFERENCE", False, F.col("end"))


def relation_type(t: Column, renamed: dict[str, str] | None = None) -> Column:
    """``archimate:CompositionRelationship`` -> ``Composition``; ``renamed``: deprecated types and their successors."""
    t = F.regexp_replace(F.regexp_replace(t, "^archimate:", ""), "Relationship$", "")
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))
    for old, new in (renamed or {}).items():
        t = F.when(t == old, new).otherwise(t)
    return t


def gate(elements: DataFrame, tags: list[str], namespaces: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Elements of files whose root has one of the tags and a namespace that starts with one of those given; and a
    PARSE_ERROR for each other file, which is left out whole.  Files that are no XML are left to their own error."""
    roots = elements.where("depth = 0 and error is null")
    fits = F.col("tag").isin(tags)
    if namespaces:
        fits = fits & F.array_contains(F.transform(F.array(*map(F.lit, namespaces)), lambda n: F.startswith(F.col("ns"), n)), True)
    bad = roots.where(~F.coalesce(fits, F.lit(False)))
    said = F.concat(F.lit("CannotParse: root {"), F.coalesce("ns", F.lit("")), F.lit("}"), "tag")
    return elements.join(bad.select("model_id"), "model_id", "left_anti"), _warn(bad, "PARSE_ERROR", True, said)


def payload(attrs: Column, *without: str) -> Column:
    """Attributes beside some names and those that end in ``type``."""
    return F.map_filter(attrs, lambda k, v: ~k.isin(*without) & ~F.lower(k).endswith("type"))


def compact(data: Column) -> Column:
    """Without empty texts, nulls, empty lists and empty records (values are JSON texts)."""
    return F.map_filter(data, lambda k, v: v.isNotNull() & ~v.isin("", "null", "[]", "{}", '""'))


def documentation(elements: DataFrame) -> DataFrame:
    """``model_id, seq, documentation``: the text of that child."""
    d = elements.where("tag = 'documentation' and text is not null")
    return d.groupBy("model_id", F.col("parent_seq").alias("seq")).agg(F.min_by("text", d["seq"]).alias("documentation"))


def archimate(elements: DataFrame, renamed: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes, edges, warnings`` of shredded ArchiMate files.

    Elements stand in typed folders at any depth, the top one names the layer; relations are direct children of the
    first folder of relations, connectors of the first of connectors.  A file without a folder of relations is warned
    of."""
    e = elements.where("error is null")
    folders = e.where("tag = 'folder' and depth = 1").groupBy("model_id", F.col("attrs")["type"].alias("ftype")).agg(F.min("seq").alias("fseq"))
    item = e.where("tag = 'element'").select(
        "model_id", "seq", "parent_seq", F.get("anc_types", F.lit(1)).alias("ftype"), F.col("attrs")["id"].alias("id"), F.col("attrs")["xsi:type"].alias("xtype"),
        F.col("attrs")["name"].alias("name"), F.col("attrs")["source"].alias("source"), F.col("attrs")["target"].alias("target"), payload(F.col("attrs"), "id", "name", "source", "target").alias("data"),
    )
    direct = item.join(folders, ["model_id", "ftype"]).where("parent_seq = fseq").drop("fseq")
    node_rows = item.where(F.col("ftype").isin(LAYERS)).unionByName(direct.where("ftype = 'connectors'"))
    node_rows, w1 = require(node_rows, "id", "xtype")
    node_rows, w2 = first_of_id(node_rows, "id")
    doc = documentation(e)
    nodes = node_rows.join(doc, ["model_id", "seq"], "left").select(
        "model_id", F.col("id").alias("node_id"), F.col("seq").alias("pos"), F.regexp_replace("xtype", "^archimate:", "").alias("type"), "name", F.col("ftype").alias("layer"), "data", "documentation"
    )
    edge_rows, w3 = require(direct.where("ftype = 'relations'"), "id", "xtype", "source", "target")
    edge_rows, w4 = first_of_id(edge_rows, "id")
    edges = _relations(edge_rows, renamed)
    warnings = w1.unionByName(w2).unionByName(w3).unionByName(w4).unionByName(unresolved(edges, nodes)).unionByName(
        _warn(elements.where("error is not null"), "PARSE_ERROR", True, F.col("error"))
    )
    lacking = e.where("depth = 0").select("model_id").join(folders.where("ftype = 'relations'"), "model_id", "left_anti")
    return nodes, edges, warnings.unionByName(_warn(lacking, "OTHER", False, F.lit("no folder of relations")))


def _relations(rows: DataFrame, renamed: dict[str, str] | None) -> DataFrame:
    return rows.select("model_id", F.col("id").alias("edge_id"), F.col("seq").alias("pos"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), relation_type(F.col("xtype"), renamed).alias("type"), "name")


def archimate_edges(rows: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """The edges that ``archimate`` gives, from rows of ``shred(files, "archimate-relations")``."""
    whole, _ = require(rows.where("error is null"), "id", "xtype", "source", "target")
    return _relations(first_of_id(whole, "id")[0], renamed)


def archimate_nodes(rows: DataFrame) -> DataFrame:
    """The nodes that ``archimate`` gives, from rows of ``shred(files, "archimate-nodes")``; ``data`` if attributes are there."""
    whole, _ = require(rows.where("error is null"), "id", "xtype")
    first, _ = first_of_id(whole, "id")
    data = [payload(F.col("attrs"), "id", "name", "source", "target").alias("data")] if "attrs" in rows.columns else []
    return first.select(
        "model_id", F.col("id").alias("node_id"), F.col("seq").alias("pos"), F.regexp_replace("xtype", "^archimate:", "").alias("type"), "name", F.col("ftype").alias("layer"), *data, "documentation"
    )


def archimate_warnings(rows: DataFrame) -> DataFrame:
    """The warnings that ``archimate`` gives, from rows of ``shred(files, "archimate-checks")``: those alike are one row
    with their number ``n``.

    Relations meet by id once, then their ends and the nodes by id once; nothing is ranked, and no row is joined."""
    rows = cut(rows)  # read by several branches
    ok = rows.where("error is null")
    nodes, lacking = require(ok.where(F.col("kind") == NODE), "id", "xtype")
    relations, lacking_relations = require(ok.where(F.col("kind") == RELATION), "id", "xtype", "source", "target")
    # of relations alike by id the first is the edge
    edges = relations.groupBy("model_id", "id").agg(F.count("*").alias("rows"), F.min(F.struct("seq", "source", "target")).alias("x"))
    edges = edges.select("model_id", F.posexplode(F.array("id", "x.source", "x.target")).alias("i", "msg"), (F.col("rows") - 1).alias("repeats"))
    by_id = nodes.select("model_id", F.col("id").alias("msg"), F.lit(1).alias("node"), F.lit(0).alias("ends"), F.lit(0).cast("long").alias("repeats")).unionByName(
        edges.select("model_id", "msg", F.lit(0).alias("node"), F.when(F.col("i") > 0, 1).otherwise(0).alias("ends"), F.when(F.col("i") == 0, F.col("repeats")).otherwise(0).alias("repeats"))
    )
    told = by_id.groupBy("model_id", "msg").agg(F.sum("node").alias("nodes"), F.sum("ends").alias("ends"), F.sum("repeats").alias("repeats"))
    kinds = F.array(
        F.struct(F.lit("DUPLICATE_ID").alias("warning_type"), F.lit(True).alias("is_skip"), (F.greatest(F.col("nodes") - 1, F.lit(0)) + F.col("repeats")).alias("n")),
        F.struct(F.lit("UNRESOLVED_REFERENCE").alias("warning_type"), F.lit(False).alias("is_skip"), F.when(F.col("nodes") == 0, F.col("ends")).otherwise(0).alias("n")),
    )
    found = told.select("model_id", "msg", F.explode(kinds).alias("x")).where("x.n > 0").select("model_id", "x.warning_type", "x.is_skip", "msg", "x.n")
    # a model of several files has one folder of relations if any of them has
    files = ok.where(F.col("kind") == FILE).groupBy("model_id").agg(F.count("*").alias("n"), F.count("id").alias("folders"))
    alone = lacking.unionByName(lacking_relations).unionByName(_warn(rows.where("error is not null"), "PARSE_ERROR", True, F.col("error"))).withColumn("n", F.lit(1).cast("long"))
    return found.unionByName(alone).unionByName(files.where("folders = 0").select("model_id", F.lit("OTHER").alias("warning_type"), F.lit(False).alias("is_skip"), F.lit("no folder of relations").alias("msg"), "n"))


def bpmn_shapes(files: DataFrame, most_levels: int = 1000) -> DataFrame:
    """The rows of ``shred(files, "bpmn-json")`` by DataFrame functions: JSON texts as VARIANT, one level of child shapes
    after the other.  A shape without an id or a stencil goes with what it holds before the next level; a repeated id too,
    once all levels are there: which of two is the first is known only when neither stands in what goes.

    ``seq`` is the place in document order; each level is a table, so a lost executor costs one level."""
    at = lambda path, kind: F.expr(f"try_variant_get(v, '{path}', '{kind}')")
    parsed = files.select("model_id", F.try_parse_json("text").alias("v"))
    is_shape = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))

    def shapes(df: DataFrame, *keep: str) -> DataFrame:
        ident, stencil = at("$.resourceId", "string"), at("$.stencil.id", "string")
        outgoing = F.filter(F.transform(at("$.outgoing", "array<variant>"), lambda o: F.try_variant_get(o, "$.resourceId", "string")), lambda o: F.coalesce(o != "", F.lit(False)))
        ref = lambda name: F.coalesce(at(f"$.{name}.resourceId", "string"), F.when(~F.coalesce(F.schema_of_variant(at(f"$.{name}", "variant")).startswith("OBJECT"), F.lit(False)), at(f"$.{name}", "string")))
        return df.select(
            "model_id", "path", "parent_id", ident.alias("shape_id"), stencil.alias("stencil"), at("$.properties.name", "string").alias("name"), F.coalesce(outgoing, F.array().cast("array<string>")).alias("outgoing"),
            ref("target").alias("target"), F.when(F.coalesce(ident, F.lit("")).eqNullSafe("") | F.coalesce(stencil, F.lit("")).eqNullSafe(""), "MISSING_ATTRIBUTE").alias("error"), ref("source").alias("source"),
            at("$.childShapes", "array<variant>").alias("below"), *keep,
        )

    tops = cut(shapes(parsed.select("model_id", "v", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("parent_id"), (~is_shape).alias("broken")), "broken"))
    broken, level = tops.where("broken"), tops.where("not broken").drop("broken")
    found = level.drop("below")
    for _ in range(most_levels):
        children = level.where("error is null and size(below) > 0").select("model_id", "path", F.col("shape_id").alias("parent_id"), F.posexplode("below").alias("i", "v"))
        children = children.withColumn("path", F.array_append("path", F.col("i"))).where(F.schema_of_variant("v").startswith("OBJECT"))
        level = cut(shapes(children))
        if not level.limit(1).count():
            break
        found = found.unionByName(level.drop("below"))
    else:
        raise RuntimeError(f"shapes nested deeper than {most_levels} levels")
    kept = _first_shapes(cut(found))
    kept = kept.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("name", "target", "source")} | {"outgoing": F.when(F.col("error").isNull(), F.col("outgoing")).otherwise(F.array().cast("array<string>"))})
    order = F.row_number().over(W.partitionBy("model_id").orderBy("path")) - 1
    lost = broken.select("model_id", F.lit(0).cast("bigint").alias("seq"), F.lit("ValueError: no object").alias("error"))
    return kept.withColumn("seq", order.cast("bigint")).select("model_id", "seq", "parent_id", "shape_id", "stencil", "name", "outgoing", "target", "error", "source").unionByName(lost, allowMissingColumns=True)


def _first_shapes(found: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Marks shapes whose id an earlier one has, and drops what they hold.

    A shape stays for certain if it is the first of its id, as are all that hold it; others of that id then go.  What they
    held goes too, and may have hidden the first of another id: so rounds follow until none goes.  All of it is windows
    over the shapes of a model in document order, for which rows are dealt by model once a round."""
    of_id = W.partitionBy("model_id", "shape_id")
    state = found.where("error is null").select("model_id", "path", "shape_id", F.lit(False).alias("gone"))
    rounds = 0
    while True:
        alive = state.repartition("model_id").withColumn("alive", ~_inside("gone"))
        # shapes that are gone or held by one get a place of their own, so that they are no first
        placed = alive.withColumn("n", F.row_number().over(W.partitionBy("model_id", "shape_id", "alive").orderBy("path")))
        ranked = placed.withColumn("bad", F.col("alive") & (F.col("n") > 1)).withColumn("sure", F.col("alive") & (F.col("n") == 1) & ~_inside("bad"))
        state = cut(ranked.where("alive or gone").select("model_id", "path", "shape_id", (F.col("gone") | F.col("bad") & F.max("sure").over(of_id)).alias("gone"), "bad"))
        if not state.where("bad").limit(1).count():
            break
        state, rounds = state.drop("bad"), rounds + 1
        if rounds == most_rounds:
            raise RuntimeError("repeated shapes did not settle")
    if not rounds:
        return found
    gone = state.where("gone").select("model_id", "path", "gone")
    marked = found.join(gone, ["model_id", "path"], "left").withColumn("gone", F.coalesce("gone", F.lit(False))).repartition("model_id")
    left = marked.withColumn("held", _inside("gone", strictly=True)).where("not held")
    return left.withColumn("error", F.when(F.col("gone"), "DUPLICATE_ID").otherwise(F.col("error"))).drop("gone", "held")


def _inside(top: str, strictly: bool = False) -> Column:
    """Whether a row's path is one of the tops or goes through one; ``strictly``: it goes through one.

    In the order of paths what a top holds follows it without a gap, up to the path of which the last step is one more.
    The largest such end of the tops so far is that of the outermost top that may hold a row."""
    end = F.when(F.size("path") > 0, F.concat(F.slice("path", 1, F.size("path") - 1), F.array(F.try_element_at("path", F.lit(-1)) + 1))).otherwise(F.array(F.lit(2**31 - 1)))
    so_far = W.partitionBy("model_id").orderBy("path").rowsBetween(W.unboundedPreceding, -1 if strictly else 0)
    return F.coalesce(F.col("path") < F.max(F.when(F.col(top), end)).over(so_far), F.lit(False))


def bpmn(shapes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes, edges, warnings`` of shredded BPMN files.

    A shape is an edge by its stencil or because it has a target.  Its source is the first node that names it as
    outgoing, else the one it states itself; its target its own, else the first outgoing reference that is another node.  Nodes inside nodes give
    ``contains`` edges."""
    ok = shapes.where("error is null")
    is_edge = F.col("stencil").isin(EDGE_STENCILS) | F.col("target").isNotNull()
    nodes = ok.where(~is_edge).select("model_id", F.col("shape_id").alias("node_id"), F.col("seq").alias("pos"), F.col("stencil").alias("type"), "name", "parent_id", "outgoing")
    flows = ok.where(is_edge).select("model_id", F.col("shape_id").alias("edge_id"), F.col("stencil").alias("type"), "outgoing", "target", F.col("source").alias("stated"))
    named = nodes.select("model_id", "node_id", "pos", F.explode("outgoing").alias("edge_id"))
    source = named.groupBy("model_id", "edge_id").agg(F.min_by("node_id", "pos").alias("source_id"), F.count("*").alias("n"))
    ids = nodes.select("model_id", F.col("node_id").alias("ref")).distinct()
    onward = flows.where("target is null").select("model_id", "edge_id", F.posexplode("outgoing").alias("i", "ref")).join(ids, ["model_id", "ref"]).where("ref <> edge_id")
    onward = onward.groupBy("model_id", "edge_id").agg(F.min_by("ref", "i").alias("onward"))
    joined = flows.join(source, ["model_id", "edge_id"], "left").join(onward, ["model_id", "edge_id"], "left").withColumn("target_id", F.coalesce("target", "onward")).withColumn("source_id", F.coalesce("source_id", "stated"))
    whole = joined.where("source_id is not null and target_id is not null")
    edges = whole.select("model_id", "edge_id", "source_id", "target_id", "type")
    warnings = (
        _warn(joined.where("source_id is null or target_id is null"), "MISSING_EDGE_ENDPOINT", True, F.col("edge_id"))
        .unionByName(_warn(joined.where("n > 1"), "OTHER", False, F.col("edge_id")))
        .unionByName(unresolved(edges, nodes))
        .unionByName(_warn(shapes.where("error is not null"), "SHAPE", True, F.col("error")))
    )
    return nodes.drop("outgoing", "parent_id"), edges.unionByName(containment(nodes)), warnings


def containment(nodes: DataFrame) -> DataFrame:
    """``contains:parent->child`` for nodes whose parent is a node."""
    parents = nodes.select("model_id", F.col("node_id").alias("parent_id")).distinct()  # many files of a model may hold one node
    return nodes.join(parents, ["model_id", "parent_id"]).select(
        "model_id", F.concat(F.lit("contains:"), "parent_id", F.lit("->"), "node_id").alias("edge_id"), F.col("parent_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("contains").alias("type")
    ).dropDuplicates(["model_id", "edge_id"])


def directed_edges(rows: DataFrame, source: str, target: str, *keep: str) -> DataFrame:
    """``model_id, edge_id, source_id, target_id`` and the columns to keep, from rows with ``id`` and lists of references
    separated by blanks: each source with each target; from the second on, ids get ``__k``."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    lists = rows.select("model_id", "id", *keep, words(F.col(source)).alias("_s"), words(F.col(target)).alias("_t")).withColumn("_n", F.size("_s").cast("long") * F.size("_t"))
    # rows that share an id are numbered one after the other; only rows move for it, not pairs
    before = W.partitionBy("model_id", "id").orderBy("_s", "_t", *([F.to_json(F.struct(*keep))] if keep else [])).rowsBetween(W.unboundedPreceding, -1)
    lists = lists.where("size(_s) > 0 and size(_t) > 0").withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    pairs = lists.select("model_id", "id", *keep, "_before", "_t", F.posexplode("_s").alias("_i", "source_id")).select(
        "model_id", "id", *keep, "_before", F.size("_t").alias("_w"), "_i", "source_id", F.posexplode("_t").alias("_j", "target_id")
    )
    k = F.col("_before") + F.col("_i").cast("long") * F.col("_w") + F.col("_j")
    return pairs.withColumn("_k", k).select("model_id", F.when(F.col("_k") == 0, F.col("id")).otherwise(F.concat_ws("__", "id", "_k")).alias("edge_id"), "source_id", "target_id", *keep)


#: Concepts that become a node as they are (fixed values).
UML_SIMPLE = (
    "ClassifierTemplateParameter RedefinableTemplateSignature Port Activity StateMachine Interaction InstanceSpecification Device Node "
    "Artifact ExecutionEnvironment OpaqueAction CallBehaviorAction SendSignalAction ActivityParameterNode CentralBufferNode DataStoreNode "
    "InitialNode ActivityFinalNode FlowFinalNode DecisionNode MergeNode JoinNode ForkNode ActivityPartition MessageOccurrenceSpecification "
    "ExecutionOccurrenceSpecification BehaviorExecutionSpecification Collaboration State FinalState Pseudostate Region Lifeline "
    "CombinedFragment InteractionOperand InstanceValue Expression LiteralBoolean LiteralInteger LiteralReal LiteralString "
    "LiteralUnlimitedNatural PrimitiveType EnumerationLiteral"
).split()
#: Concepts that become a node with members, extension points or ends (fixed values).
UML_CLASSIFIERS = "Package Class Interface Enumeration DataType Component UseCase Actor AssociationClass".split()
#: Relations: concept, edge type, attributes of the source and of the target, word in an id made up (none: an id is needed) (fixed values).
UML_RELATIONS = [
    ("ControlFlow", "ControlFlow", ["source"], ["target"], None), ("ObjectFlow", "ObjectFlow", ["source"], ["target"], None),
    ("Transition", "Transition", ["source"], ["target"], None), ("Message", "Message", ["sendEvent"], ["receiveEvent"], None),
    ("InformationFlow", "InformationFlow", ["informationSource"], ["informationTarget"], None), ("Dependency", "Dependency", ["client"], ["supplier"], None),
    ("Usage", "Usage", ["client"], ["supplier"], None), ("Generalization", "Generalization", ["specific"], ["general"], "generalization"),
    ("InterfaceRealization", "InterfaceRealization", ["implementingClassifier", "client"], ["contract", "supplier"], "realizes"),
    ("Include", "includes", ["includingCase"], ["addition"], "includes"), ("Extend", "extends", ["extension"], ["extendedCase"], "extends"),
]
#: Attributes that relations, associations and warnings read (fixed values).
UML_ATTRIBUTES = sorted({"xsi:type", "xmi:type", "xmi:id", "name", "xmi:idref", "href", "memberEnd", "type", "aggregation", "extensionLocation", *(n for r in UML_RELATIONS for side in r[2:4] for n in side)})
XMI_ROWS = "model_id string, seq bigint, parent_seq bigint, tag string, " + ", ".join(f"`{a}` string" for a in UML_ATTRIBUTES) + ", error string"


def xmi_rows(model_id: str, text: str) -> Iterator[tuple]:
    """What ``uml_warnings`` reads of a file: elements, but for extensions and what stands in them, with the attributes
    ``UML_ATTRIBUTES``.  A file that is no XML gives one row with an error."""
    yield from _whole(_xmi_rows(model_id, text), text, lambda said: (model_id, 0, None, None, *[None] * len(UML_ATTRIBUTES), said))


def _xmi_rows(model_id: str, text: str, piece: int = 1 << 16) -> Iterator[tuple]:
    n = inside = 0  # inside: open elements from an extension on
    rows, path = [], [None]
    names: dict[str, str] = {}

    def start(tag: str, attrib: dict[str, str]) -> None:
        nonlocal n, inside
        tag = _local(tag)[1]
        if inside or tag == "Extension":
            inside += 1
        else:
            found = {}
            for k, v in attrib.items():
                if k not in names:
                    names[k] = _attribute(k)
                found[names[k]] = v
            rows.append((model_id, n, path[-1], tag, *map(found.get, UML_ATTRIBUTES), None))
            path.append(n)
        n += 1

    def end(_: str) -> None:
        nonlocal inside
        if inside:
            inside -= 1
        else:
            path.pop()

    parser = ET.XMLParser(target=SimpleNamespace(start=start, end=end))
    for at in range(0, len(text), piece):
        parser.feed(text[at : at + piece])
        yield from rows
        rows.clear()
    parser.close()
    yield from rows


register_extractor("xmi", xmi_rows, XMI_ROWS)
#: Namespace of Ecore (fixed value).
ECORE_NS = "http://www.eclipse.org/emf/2002/Ecore"
UML_ASSOCIATIONS = ["Association", "CommunicationPath"]
#: Concepts of elements that have no xsi:type, by tag (fixed values).
UML_TAGS = {
    "Model": "Model", "generalization": "Generalization", "interfaceRealization": "InterfaceRealization", "include": "Include", "extend": "Extend",
    "ownedUseCase": "UseCase", "ownedBehavior": "Activity", "doActivity": "StateMachine", "nestedNode": "ExecutionEnvironment", "region": "Region",
    "transition": "Transition", "message": "Message", "lifeline": "Lifeline", "operand": "InteractionOperand",
}
#: Tags of elements that a package contains (fixed values).
UML_CONTAINED = (
    "packagedElement ownedUseCase ownedBehavior doActivity nestedNode nestedClassifier ownedNode ownedGroup edge subvertex region "
    "transition fragment lifeline message operand"
).split()
UML_MEMBERS = {"ownedAttribute": "attributes", "ownedOperation": "operations", "ownedLiteral": "literals", "extensionPoint": "extension_points"}


def uml_elements(elements: DataFrame) -> DataFrame:
    """Elements with ``concept, id, name``; what tools have put into extensions is left out."""
    a = F.col("attrs")
    e = elements.where("error is null and tag <> 'Extension'" + (" and not exists(anc_tags, t -> t = 'Extension')" if "anc_tags" in elements.columns else ""))
    by_tag = F.create_map(*[F.lit(x) for kv in UML_TAGS.items() for x in kv])
    concept = F.coalesce(F.regexp_replace(F.coalesce(a["xsi:type"], a["xmi:type"]), "^uml:", ""), by_tag[F.col("tag")])
    return e.select("*", concept.alias("concept"), a["xmi:id"].alias("id"), a["name"].alias("name"))


def uml_members(elements: DataFrame) -> DataFrame:
    """``model_id, owner_id, kind, pos, member_id, name, type, visibility``: attributes, operations, literals and
    extension points of classifiers.  Ends of associations are no attributes."""
    e = uml_elements(elements)
    kind = F.create_map(*[F.lit(x) for kv in UML_MEMBERS.items() for x in kv])[F.col("tag")]
    own = e.where(F.col("tag").isin(list(UML_MEMBERS)) & ((F.col("tag") != "ownedAttribute") | F.col("attrs")["association"].isNull()))
    owners = e.where(F.col("concept").isin(UML_CLASSIFIERS) & F.col("id").isNotNull()).select("model_id", F.col("seq").alias("parent_seq"), F.col("id").alias("owner_id"))
    a = F.col("attrs")
    return own.join(owners, ["model_id", "parent_seq"]).select(
        "model_id", "owner_id", kind.alias("kind"), F.col("seq").alias("pos"), F.col("id").alias("member_id"), "name", a["type"].alias("type"), a["visibility"].alias("visibility")
    )


def _uml_relations(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges, warnings`` of directed relations: lists of references cross, an end is an attribute or a child that
    refers; a generalization starts at its parent unless it says otherwise."""
    a = F.col("attrs")
    ends = sorted({n for r in UML_RELATIONS for side in (r[2], r[3]) for n in side})
    rel = e.where(F.col("concept").isin([r[0] for r in UML_RELATIONS]))
    said = e.where(F.col("tag").isin(ends)).select("model_id", F.col("parent_seq").alias("seq"), "tag", F.coalesce(a["xmi:idref"], a["href"]).alias("ref"), F.col("seq").alias("at")).where("ref is not null")
    child = said.groupBy("model_id", "seq", "tag").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]), " ").alias("ref"))
    child = child.groupBy("model_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("tag", "ref"))).alias("refs"))
    owner = e.where("id is not null").select("model_id", F.col("seq").alias("parent_seq"), F.col("id").alias("owner"))
    rel = rel.join(child, ["model_id", "seq"], "left").join(owner, ["model_id", "parent_seq"], "left")

    def end(side: int) -> Column:
        found = F.lit(None).cast("string")
        for r in UML_RELATIONS:
            here = F.coalesce(*[x for n in r[side] for x in (a[n], F.col("refs")[n])], *([F.col("owner")] if r[0] == "Generalization" and side == 2 else []))
            found = F.when(F.col("concept") == r[0], F.nullif(F.trim(here), F.lit(""))).otherwise(found)
        return found

    kind, word = (F.create_map(*[F.lit(x) for r in UML_RELATIONS for x in (r[0], r[i])])[F.col("concept")] for i in (1, 4))
    rel = rel.select("model_id", "concept", "id", kind.alias("type"), word.alias("word"), end(2).alias("s"), end(3).alias("t"))
    lost = (F.col("id").isNull() & F.col("word").isNull()).alias("lost")
    rel = rel.select("*", lost)
    warnings = _warn(rel.where("lost"), "MISSING_ATTRIBUTE", True, F.col("concept")).unionByName(
        _warn(rel.where("not lost and (s is null or t is null)"), "MISSING_EDGE_ENDPOINT", True, F.coalesce("id", "concept"))
    )
    whole = rel.where("not lost and s is not null and t is not null").withColumn("id", F.coalesce("id", F.concat("s", F.lit("__"), "word", F.lit("__"), "t")))
    return directed_edges(whole, "s", "t", "type"), warnings


def _uml_associations(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges, warnings``: the first two ends that resolve; a composite end makes a composition from whole to part."""
    a = F.col("attrs")
    assoc = e.where(F.col("concept").isin(UML_ASSOCIATIONS)).select("model_id", "seq", "id", "concept", F.nullif(F.trim(a["memberEnd"]), F.lit("")).alias("ends"))
    ok, no_id = assoc.where("id is not null"), _warn(assoc.where("id is null"), "MISSING_ATTRIBUTE", True, F.col("concept"))
    end = e.where("id is not null").select("model_id", F.col("id").alias("end"), "parent_seq", "tag", F.col("seq").alias("at"), a["type"].alias("of"), F.coalesce(a["aggregation"] == "composite", F.lit(False)).alias("composite"))
    listed = ok.select("model_id", "id", F.posexplode(F.split("ends", r"\s+")).alias("i", "end")).where("end is not null")
    # the first element of each id that is listed; other ids are dropped before they are ranked
    meant = end.select("model_id", "end", "at", "of", "composite").join(listed.select("model_id", "end").distinct(), ["model_id", "end"], "left_semi")
    first = meant.groupBy("model_id", "end").agg(F.min(F.struct("at", "of", "composite")).alias("x"))
    named = listed.join(first, ["model_id", "end"], "left").select("model_id", "id", "i", "end", "x.*")
    unknown = named.where("at is null")
    owned = ok.where("ends is null").join(end.where("tag = 'ownedEnd'").select("model_id", F.col("parent_seq").alias("seq"), "at", "of", "composite"), ["model_id", "seq"]).select("model_id", "id", F.col("at").alias("i"), "of", "composite")
    both = named.select("model_id", "id", F.col("i").cast("bigint").alias("i"), "of", "composite").unionByName(owned).where("of is not null")
    found = both.groupBy("model_id", "id").agg(F.slice(F.sort_array(F.collect_list(F.struct("i", "of", "composite"))), 1, 2).alias("x"))
    joined = ok.join(found, ["model_id", "id"], "left")
    x = F.col("x")
    second = ~x[0]["composite"] & x[1]["composite"]
    edges = joined.where("size(x) = 2").select(
        "model_id", F.col("id").alias("edge_id"), F.when(second, x[1]["of"]).otherwise(x[0]["of"]).alias("source_id"), F.when(second, x[0]["of"]).otherwise(x[1]["of"]).alias("target_id"),
        F.when(F.exists("x", lambda v: v["composite"]), "Composition").otherwise(F.col("concept")).alias("type"),
    )
    few = _warn(joined.where("coalesce(size(x), 0) < 2"), "MISSING_EDGE_ENDPOINT", True, F.col("id"))
    return edges, no_id.unionByName(few).unionByName(_warn(unknown, "DEFERRED_REF_UNRESOLVED", False, F.col("end")))


def extension_points(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``model_id, edge_id, location, point``: the named extension point of each extend relation; and warnings for those
    that name no element."""
    return _extension_points(uml_elements(elements))


def _extension_points(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = e.where("concept = 'Extend'").select("model_id", "id", F.col("attrs")["extensionLocation"].alias("location")).where("location is not null")
    known = e.where("id is not null").select("model_id", F.col("id").alias("location"), F.col("name").alias("point"))
    return at.join(known, ["model_id", "location"]).select("model_id", F.col("id").alias("edge_id"), "location", "point"), _warn(
        at.join(known, ["model_id", "location"], "left_anti"), "DEFERRED_REF_UNRESOLVED", False, F.col("location")
    )


def _uml_nodes(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes, an id may have several, and warnings for those without one."""
    node_rows = e.where(F.col("concept").isin(UML_SIMPLE + UML_CLASSIFIERS) & (F.col("tag") != "ownedLiteral") & ~((F.col("concept") == "PrimitiveType") & F.col("id").isNull() & F.col("attrs")["href"].isNotNull()))
    return require(node_rows, "id")


def uml(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes, edges, warnings`` of shredded XMI files: nodes with data and the names of their members, directed
    relations, associations, and what each package contains.  The model itself is no node."""
    e = uml_elements(elements)
    node_rows, _ = _uml_nodes(e)
    every = node_rows.select("model_id", F.col("id").alias("node_id"), F.col("seq").alias("pos"), F.col("concept").alias("type"), "name", payload(F.col("attrs"), "xmi:id", "name").alias("data"))
    names = uml_members(elements).groupBy("model_id", F.col("owner_id").alias("node_id")).agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "name")))), lambda m: m["name"]).alias(k) for k in UML_MEMBERS.values()
    ])
    place = every.groupBy("model_id", "node_id").agg(F.min("pos").alias("pos"))
    nodes = upsert(every).join(place, ["model_id", "node_id"]).join(names, ["model_id", "node_id"], "left").select(
        "model_id", "node_id", "pos", "type", "name", F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"), *UML_MEMBERS.values()
    )
    packages = e.where("concept = 'Package' and id is not null").select("model_id", F.col("seq").alias("_p"), F.col("id").alias("package_id"))
    inner = e.where(F.col("tag").isin(UML_CONTAINED) & F.col("id").isNotNull() & F.col("concept").isNotNull()).select("model_id", "id", F.explode("anc_seqs").alias("_p")).join(packages, ["model_id", "_p"])
    inner = inner.groupBy("model_id", "id").agg(F.max_by("package_id", "_p").alias("package_id"))
    contains = inner.select("model_id", F.concat("package_id", F.lit("__contains__"), "id").alias("edge_id"), F.col("package_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("type"))
    edges = _uml_relations(e)[0].unionByName(_uml_associations(e)[0]).unionByName(contains)
    return nodes, edges, _uml_warnings(e)


def uml_warnings(rows: DataFrame) -> DataFrame:
    """The warnings of ``uml``, from rows of ``shred(files, "xmi")``: one table of columns, of which each branch reads those
    that it needs."""
    attrs = F.struct(*[F.col(f"`{a}`") for a in UML_ATTRIBUTES]).alias("attrs")
    return _uml_warnings(cut(uml_elements(rows.select("model_id", "seq", "parent_seq", "tag", attrs, "error")).drop("error")))


def _uml_warnings(e: DataFrame) -> DataFrame:
    """Of nodes only ids, types and names are worked out, and of containment nothing."""
    node_rows, w1 = _uml_nodes(e)
    every = node_rows.select("model_id", F.col("id").alias("node_id"), F.col("seq").alias("pos"), F.col("concept").alias("type"), "name")
    w2 = upsert_conflicts(every)
    relations, w3 = _uml_relations(e)
    associations, w4 = _uml_associations(e)
    known = [*UML_SIMPLE, *UML_CLASSIFIERS, *UML_ASSOCIATIONS, *[r[0] for r in UML_RELATIONS], "Model", "Property", "Operation", "ExtensionPoint"]
    odd = e.where("tag = 'packagedElement' or attrs['xsi:type'] is not null or attrs['xmi:type'] is not null").where(F.col("concept").isNotNull() & ~F.col("concept").isin(known))
    warnings = w1.unionByName(w2).unionByName(w3).unionByName(w4).unionByName(_warn(odd, "UNKNOWN_NODE_TYPE", True, F.col("concept")))
    return warnings.unionByName(_extension_points(e)[1]).unionByName(unresolved(relations.unionByName(associations), every))


def external_name(href: Column) -> Column:
    """``lib/Types.xmi#String`` -> ``Types::String``."""
    lib, part = F.regexp_extract(href, r"([^/#]+?)(?:\.[^./#]*)*#", 1), F.regexp_extract(href, r"#(?://)?(.*)$", 1)
    return F.when(href.contains("#"), F.concat_ws("::", lib, part)).otherwise(href)


def _tops(e: DataFrame) -> DataFrame:
    """``model_id, seq`` of packages that no other holds: a file's root, or what its XMI root holds."""
    return e.where("(depth = 0 and tag = 'EPackage') or (depth = 1 and tag = 'EPackage' and anc_tags[0] = 'XMI')").select("model_id", "seq")


def data_type_origin(elements: DataFrame) -> DataFrame:
    """``model_id, seq, external, ns_uri, package_name`` of data types and enumerations: one is internal if its package, or
    one that this stands in, is a root package of the file.  What is external has the namespace and name of the package
    it stands in, else those of Ecore itself."""
    e = elements.where("error is null")
    own = F.regexp_replace(F.col("attrs")["xsi:type"], "^ecore:", "")
    kinds = e.where(own.isin("EDataType", "EEnum") | F.col("tag").isin("EDataType", "EEnum")).select("model_id", "seq", "parent_seq", "anc_seqs", "anc_tags")
    package = (F.col("tag").isin("EPackage", "eSubpackages")) | F.coalesce(own == "EPackage", F.lit(False))
    packages = e.where(package).select("model_id", F.col("seq").alias("a"), F.col("attrs")["nsURI"].alias("uri"), F.col("attrs")["name"].alias("name"))
    # from the type upwards: a chain of packages without a gap up to a root
    above = kinds.select("model_id", "seq", "parent_seq", F.size("anc_seqs").alias("n"), F.coalesce((F.get("anc_tags", F.lit(0)) == "XMI").cast("int"), F.lit(0)).alias("skip"), F.posexplode_outer("anc_seqs").alias("i", "a"))
    chain = above.join(packages, ["model_id", "a"], "left").groupBy("model_id", "seq").agg(
        F.first("n").alias("n"), F.first("skip").alias("skip"), F.count_if(F.col("name").isNotNull() | F.col("uri").isNotNull()).alias("packages"),
        F.max_by("uri", "i").alias("uri"), F.max_by("name", "i").alias("name"),
    )
    external = ~((F.col("packages") > 0) & (F.col("packages") == F.col("n") - F.col("skip")))
    return chain.select(
        "model_id", "seq", external.alias("external"), F.when(external, F.coalesce("uri", F.lit(ECORE_NS))).alias("ns_uri"), F.when(external, F.coalesce("name", F.lit("ecore"))).alias("package_name")
    )


def ecore(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes, edges, warnings`` of shredded Ecore files.

    Packages, classes, enumerations, data types, attributes, operations, parameters and literals are nodes under their
    path, references are edges; types and supertypes resolve by path to nodes of the file, which are internal.  What does
    not resolve becomes an external class or data type, as its use says.  Of edges alike the first stands."""
    e = elements.where("error is null")
    kinds = {"EPackage": "EPackage", "eSubpackages": "EPackage", "eLiterals": "EEnumLiteral", "eOperations": "EOperation", "eParameters": "EParameter"}
    kinds |= {k: k for k in ("EClass", "EDataType", "EEnum")}
    mapping = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    kind = F.coalesce(F.regexp_replace(F.col("attrs")["xsi:type"], "^ecore:", ""), mapping[F.col("tag")])
    item = e.select("model_id", "seq", "parent_seq", "anc_seqs", kind.alias("type"), F.col("attrs")["name"].alias("name"), "attrs", "tag").where("type is not null and name is not null")
    chain = item.select("model_id", "seq", F.posexplode(F.concat("anc_seqs", F.array("seq"))).alias("i", "a"))
    names = item.select("model_id", F.col("seq").alias("a"), "name")
    path = chain.join(names, ["model_id", "a"]).groupBy("model_id", "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), "/").alias("node_id"))
    item = cut(item.join(path, ["model_id", "seq"]).drop("anc_seqs"))  # read by several branches
    item, w1 = first_of_id(item, "node_id")
    origin = data_type_origin(elements)
    nodes = item.where("type <> 'EReference'").join(origin, ["model_id", "seq"], "left").select(
        "model_id", "node_id", F.col("seq").alias("pos"), "type", "name", F.coalesce("external", F.lit(False)).alias("external"), "ns_uri", "package_name"
    )
    parent = item.select("model_id", F.col("seq").alias("parent_seq"), F.col("node_id").alias("p"), F.col("type").alias("ptype"))
    owned = item.join(parent, ["model_id", "parent_seq"])
    contains = owned.where("type <> 'EReference'").select("model_id", F.col("p").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("Contains").alias("type"), "seq")
    # a file has one root, or several in an XMI element: "#//A" is in the first, "#/1/A" in the second
    tops = item.join(_tops(e), ["model_id", "seq"], "left_semi").groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("seq", "node_id"))).alias("tops"))
    root = tops.select("model_id", F.transform("tops", lambda x: x["node_id"]).alias("roots")).hint("merge")  # a row for each model: not broadcast

    def target(ref: Column) -> Column:
        bare = F.regexp_replace(ref, r"^ecore:\w+\s+", "")
        number = F.coalesce(F.expr(r"try_cast(regexp_extract(%s, '^#/([0-9]*)/', 1) AS INT)" % "_ref"), F.lit(0))
        inner = F.regexp_extract(bare, r"^#/[0-9]*/(.+)$", 1)
        return F.when((inner != "") & (number < F.size("roots")), F.concat_ws("/", F.get("roots", number), inner)).otherwise(bare)

    # references are separated by blanks, as is a reference from the type that may come before it
    every = F.regexp_extract_all(F.col("attrs")["eSuperTypes"], F.lit(r"(?:ecore:\w+\s+)?\S+"), F.lit(0))
    supers = owned.where("attrs['eSuperTypes'] is not null").join(root, "model_id").select("model_id", "seq", F.col("node_id").alias("source_id"), F.explode(every).alias("_ref"), "roots")
    supers = supers.select("model_id", "source_id", target(F.col("_ref")).alias("target_id"), F.lit("Generalization").alias("type"), "seq")
    typed = owned.where("attrs['eType'] is not null").join(root, "model_id").withColumn("_ref", F.col("attrs")["eType"])
    how = F.when(F.col("type") == "EAttribute", "AttributeType").when(F.col("type") != "EReference", "Type").when(F.col("attrs")["containment"] == "true", "Containment").otherwise("Reference")
    source = F.when(F.col("type") == "EReference", F.col("p")).otherwise(F.col("node_id"))
    types = typed.select("model_id", source.alias("source_id"), target(F.col("_ref")).alias("target_id"), how.alias("type"), "seq")
    references = supers.unionByName(types)
    edges = contains.unionByName(references).withColumn("edge_id", F.concat_ws("|", "type", "source_id", "target_id"))
    edges, w2 = first_of_id(edges, "edge_id")
    # what is contained is a node, and edges alike have one target and type: neither is looked at for what does not resolve
    is_class = F.max(F.col("type").isin("Generalization", "Reference", "Containment"))
    used = references.groupBy("model_id", F.col("target_id").alias("node_id")).agg(F.when(is_class, "EClass").otherwise("EDataType").alias("type"))
    lost = used.join(nodes.select("model_id", "node_id").hint("merge"), ["model_id", "node_id"], "left_anti")  # all nodes: not broadcast
    stubs = lost.select("model_id", "node_id", F.lit(None).cast("bigint").alias("pos"), "type", F.regexp_extract("node_id", r"([^/#]+)$", 1).alias("name"), F.lit(True).alias("external"),
        F.nullif(F.regexp_extract("node_id", r"^([^#]*)#", 1), F.lit("")).alias("ns_uri"), F.lit(None).cast("string").alias("package_name"))
    return nodes.unionByName(stubs), edges.drop("seq"), w1.unionByName(w2)


def resolve_by_name(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``refs(model_id, ref_id, name, hint, package)`` to one of ``candidates(model_id, node_id, name, package)``: one in
    the package of the hint, else in the same package, else the first by id.

    The first of each name, and of each name in a package, are found once, so that many candidates of one name don't
    multiply the references to it; references alike are resolved once."""
    c = candidates.select("model_id", "node_id", "name", F.col("package").alias("_p"))
    every = c.groupBy("model_id", "name").agg(F.min("node_id").alias("_any"))
    within = c.groupBy("model_id", "name", "_p").agg(F.min("node_id").alias("_first"))
    keys = refs.select("model_id", "name", "hint", "package").distinct()
    for at in ("hint", "package"):
        keys = keys.join(within.withColumnsRenamed({"_p": at, "_first": f"_{at}"}), ["model_id", "name", at], "left")
    said = F.when(F.col("_hint").isNotNull(), F.struct(F.lit(0).alias("s"), F.col("_hint").alias("n"))).when(F.col("_package").isNotNull(), F.struct(F.lit(1).alias("s"), F.col("_package").alias("n")))
    found = keys.join(every, ["model_id", "name"]).select("model_id", "name", F.col("hint").alias("_h"), F.col("package").alias("_k"), F.coalesce(said, F.struct(F.lit(2).alias("s"), F.col("_any").alias("n"))).alias("_x"))
    alike = F.col("hint").eqNullSafe(F.col("_h")) & F.col("package").eqNullSafe(F.col("_k"))
    r, f = refs.alias("r"), found.alias("f")
    same = (F.col("r.model_id") == F.col("f.model_id")) & (F.col("r.name") == F.col("f.name")) & alike
    return r.join(f, same).groupBy("r.model_id", "ref_id").agg(F.min("_x")["n"].alias("node_id"))


def resolve_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """``refs(relpath, ref)`` to a file of that basename in the same top folder: fewest steps up, then fewest segments,
    then by path."""
    base, top = (lambda c: F.element_at(F.split(c, "/"), -1)), (lambda c: F.element_at(F.split(c, "/"), 1))
    want = F.regexp_replace("ref", "#.*$", "")
    r = refs.select("relpath", "ref", base(want).alias("_b"), top(F.col("relpath")).alias("_t"))
    f = files.select(F.col("relpath").alias("target"), base(F.col("relpath")).alias("_b"), top(F.col("relpath")).alias("_t"))
    here, there = F.split("relpath", "/"), F.split("target", "/")
    shared = F.size(F.filter(F.transform(here, lambda x, i: F.coalesce(F.slice(here, 1, i + 1) == F.slice(there, 1, i + 1), F.lit(False))), lambda x: x))
    return r.join(f, ["_b", "_t"]).groupBy("relpath", "ref").agg(F.min_by("target", F.struct(F.size(here) - shared, F.size(there), "target")).alias("target"))


def annotations(elements: DataFrame) -> DataFrame:
    """``model_id, owner_seq, source, data map``: details of all annotations of an element by source, those inside other
    annotations with them; the owner is null for annotations that stand beside the packages of a file.  A source without
    details has an empty map, a missing one is the empty text.

    Of details with one key those of the annotation that is further in stand, else those of the earlier one; in one
    annotation, the later detail."""
    e = elements.where("error is null")
    note = F.col("tag").isin("eAnnotations", "EAnnotation")
    # from the owner down: the last ancestor that is no annotation, and the annotations below it
    depth = F.aggregate(F.sequence(F.lit(0), F.size("anc_tags") - 1), F.lit(-1), lambda last, i: F.when(F.get("anc_tags", i).isin("eAnnotations", "EAnnotation"), last).otherwise(i))
    depth = F.when(F.size("anc_tags") == 0, -1).otherwise(depth)
    top = F.coalesce(F.get("anc_tags", F.col("at")) == "XMI", F.lit(False)) & (F.col("at") == 0)
    notes = e.where(note).withColumn("at", depth).select(
        "model_id", F.col("seq").alias("n"), F.when(~top, F.get("anc_seqs", F.col("at"))).alias("owner_seq"), F.coalesce(F.col("attrs")["source"], F.lit("")).alias("source"),
        F.transform(F.concat(F.slice("anc_seqs", F.col("at") + 2, F.size("anc_seqs")), F.array("seq")), lambda x: -x).alias("way"),
    )
    details = e.where("tag = 'details'").select("model_id", F.col("parent_seq").alias("n"), F.col("seq").alias("place"), F.col("attrs")["key"].alias("k"), F.coalesce(F.col("attrs")["value"], F.lit("")).alias("v")).where("k is not null")
    said = notes.join(details, ["model_id", "n"], "left").groupBy("model_id", "owner_seq", "source", "k").agg(F.max_by("v", F.struct("way", "place")).alias("v"))
    pairs = F.filter(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["k"].isNotNull())
    return said.groupBy("model_id", "owner_seq", "source").agg(F.map_from_entries(pairs).alias("data"))


def unhandled(elements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Warnings for attributes that ``allowed(tag, name)`` doesn't list for their element."""
    pairs = elements.where("error is null").select("model_id", "tag", F.explode(F.map_keys("attrs")).alias("name"))
    return _warn(pairs.join(F.broadcast(allowed), ["tag", "name"], "left_anti"), "UNHANDLED_ATTRIBUTE", False, F.concat_ws("@", "tag", "name"))


def unhandled_children(elements: DataFrame, allowed: DataFrame) -> DataFrame:
    """Warnings for elements that ``allowed(tag, child)`` doesn't list under their parent."""
    e = elements.where("error is null")
    parent = e.select("model_id", F.col("seq").alias("parent_seq"), F.col("tag").alias("_tag"))
    pairs = e.select("model_id", "parent_seq", F.col("tag").alias("child")).join(parent, ["model_id", "parent_seq"]).select("model_id", F.col("_tag").alias("tag"), "child")
    return _warn(pairs.join(F.broadcast(allowed), ["tag", "child"], "left_anti"), "UNHANDLED_CHILD", False, F.concat_ws("/", "tag", "child"))


SPEC = "concept string, attribute string, is_list boolean, as_name string"
#: Concepts whose references come as lists under another name (fixed values).
UML_LISTS = [
    ("ClassifierTemplateParameter", "parameteredElement", False, None), ("ClassifierTemplateParameter", "signature", False, None),
    ("ClassifierTemplateParameter", "constrainingClassifier", True, "constrainingClassifierRefs"),
    ("RedefinableTemplateSignature", "parameter", True, "parameterRefs"),
]
#: Attributes that need no handler, and children that are never reported (fixed values).
ALWAYS_HANDLED = ["id", "type"]
NEVER_REPORTED = ["Extension", "eAnnotations", "details", "name"]


def _concept() -> Column:
    a = F.col("attrs")
    return F.coalesce(F.regexp_replace(F.coalesce(a["xsi:type"], a["xmi:type"]), "^uml:", ""), "tag")


def _with_spec(elements: DataFrame, spec: DataFrame) -> DataFrame:
    """Elements with ``concept`` and ``_spec``, a map from attribute to how it is taken; null where the concept has none.
    A spec has some hundred concepts, whatever the models."""
    how = F.map_from_entries(F.collect_list(F.struct("attribute", F.struct(F.coalesce("is_list", F.lit(False)).alias("is_list"), F.coalesce("as_name", "attribute").alias("as_name")))))
    by = spec.dropDuplicates(["concept", "attribute"]).groupBy("concept").agg(how.alias("_spec"))
    return elements.where("error is null").withColumn("concept", _concept()).join(F.broadcast(by), "concept", "left")


def concept_payload(elements: DataFrame, spec: DataFrame) -> DataFrame:
    """``model_id, seq, concept, data map<string, array<string>>``: of each element whose concept has rows in ``spec``, the
    attributes named there, under the names given there; those marked as lists are split at blanks, others are lists of one."""
    e = _with_spec(elements, spec).where("_spec is not null")
    taken = F.filter(F.map_entries("attrs"), lambda x: F.map_contains_key("_spec", x.key))
    words = lambda x: F.filter(F.split(x.value, r"\s+"), lambda w: w != "")
    as_named = F.transform(taken, lambda x: F.struct(F.col("_spec")[x.key]["as_name"], F.when(F.col("_spec")[x.key]["is_list"], words(x)).otherwise(F.array(x.value))))
    return e.select("model_id", "seq", "concept", F.map_from_entries(as_named).alias("data"))


def unhandled_by_concept(elements: DataFrame, spec: DataFrame) -> DataFrame:
    """Warnings for attributes that ``spec`` doesn't name for their concept, with the element's id and the value.
    Attributes with a prefix are never reported, nor is an element whose concept has no spec."""
    e = _with_spec(elements, spec).where("_spec is not null")
    odd = F.filter(F.map_entries("attrs"), lambda x: ~F.contains(x.key, F.lit(":")) & ~x.key.isin(ALWAYS_HANDLED) & ~F.map_contains_key("_spec", x.key))
    ident = F.coalesce(F.col("attrs")["xmi:id"], F.col("attrs")["id"], F.lit("None"))
    rows = e.select("model_id", "concept", ident.alias("id"), F.explode(odd).alias("x"))
    return _warn(rows, "UNHANDLED_ATTRIBUTE", False, F.concat("concept", F.lit("("), "id", F.lit(")@"), "x.key", F.lit("="), "x.value"))


def unhandled_children_by_concept(elements: DataFrame, allowed: DataFrame, handled: list[str]) -> DataFrame:
    """Warnings for children whose tag ``allowed(concept, child)`` doesn't list for the concept of their parent, unless the
    child's own concept is one of ``handled``.  Parents whose concept has no row are not looked at."""
    e = elements.where("error is null").withColumn("concept", _concept())
    lists = F.broadcast(allowed.groupBy("concept").agg(F.collect_set("child").alias("_allowed")))
    parents = e.join(lists, "concept").select("model_id", F.col("seq").alias("parent_seq"), F.col("concept").alias("of"), "_allowed")
    child = e.where(~F.col("tag").isin(NEVER_REPORTED) & ~F.col("concept").isin(handled)).select("model_id", "parent_seq", F.col("tag").alias("child"))
    odd = child.join(parents, ["model_id", "parent_seq"]).where(~F.array_contains("_allowed", F.col("child")))
    return _warn(odd, "UNHANDLED_CHILD", False, F.concat_ws("/", "of", "child"))


def upsert(rows: DataFrame) -> DataFrame:
    """``model_id, node_id, type, name, data`` from rows with ``pos``: the first type and the first name that is not
    empty stand; data keys missing so far come from later rows."""
    by = rows.groupBy("model_id", "node_id")
    flat = rows.select("model_id", "node_id", "pos", F.explode("data").alias("k", "v")).groupBy("model_id", "node_id", "k").agg(F.min_by("v", "pos").alias("v"))
    data = flat.groupBy("model_id", "node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("data"))
    head = by.agg(F.min_by("type", "pos").alias("type"), F.min_by("name", F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("pos"))).alias("name"))
    return head.join(data, ["model_id", "node_id"], "left")


def upsert_conflicts(rows: DataFrame) -> DataFrame:
    """Warnings for rows of ``upsert`` that come after the first of their id and tell another type, or another name than
    the one that stands by then."""
    before = W.partitionBy("model_id", "node_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    said = F.nullif(F.col("name"), F.lit(""))
    marked = rows.select("model_id", "node_id", "type", said.alias("name"), F.count("*").over(before).alias("_n"), F.first("type").over(before).alias("_type"), F.first(said, ignorenulls=True).over(before).alias("_name"))
    odd = ~F.col("type").eqNullSafe(F.col("_type")) | F.coalesce(F.col("name") != F.col("_name"), F.lit(False))
    return _warn(marked.where((F.col("_n") > 0) & odd), "DUPLICATE_ID", True, F.col("node_id"))


def validate(models: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``model_id, error, n``: missing ids, languages and ends, repeated node ids, ends that are no node."""
    repeated = nodes.groupBy("model_id", "node_id").count().where("count > 1").groupBy("model_id").agg(F.count("*").alias("n"))
    parts = [
        (models.where("language is null or language = ''"), "missing language"), (nodes.where("node_id is null or node_id = ''"), "missing node id"),
        (edges.where("source_id is null or target_id is null"), "missing endpoint"),
        (unresolved(edges.where("source_id is not null and target_id is not null"), nodes.where("node_id is not null")), "dangling endpoint"),
    ]
    out = repeated.select("model_id", F.lit("duplicate node id").alias("error"), "n")
    for df, error in parts:
        out = out.unionByName(df.groupBy("model_id").agg(F.count("*").alias("n")).select("model_id", F.lit(error).alias("error"), "n"))
    return out


def header(elements: DataFrame) -> DataFrame:
    """``model_id, id, name, version, documentation`` of each file's root; its text is that of a child ``documentation`` or
    ``purpose``."""
    a = F.col("attrs")
    root = elements.where("depth = 0 and error is null").select("model_id", "seq", F.coalesce(a["id"], a["xmi:id"]).alias("id"), a["name"].alias("name"), F.coalesce(a["version"], a["xmi:version"]).alias("version"))
    said = elements.where("depth = 1 and tag in ('documentation', 'purpose') and text is not null").groupBy("model_id").agg(F.min_by("text", "seq").alias("documentation"))
    return root.join(said, "model_id", "left").select("model_id", "id", "name", "version", "documentation")
