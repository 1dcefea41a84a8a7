"""Reading and writing corpora: files, model graphs, diagnostics, catalogs and measures."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "struct<name:string,label:string,displayName:string,title:string>"
NODE = f"struct<id:string,type:string,name:string,data:map<string,string>,attributes:array<{ENTRY}>,operations:array<{ENTRY}>,literals:array<{ENTRY}>>"
EDGE = "struct<id:string,sourceId:string,targetId:string,type:string,data:map<string,string>>"
GRAPH = f"id string, language string, data map<string,string>, nodes array<{NODE}>, edges array<{EDGE}>"
CATALOG = "language string, constructs array<struct<id:string,kind:string,match_type:string,description:string,match_data_equals:map<string,string>,meta:map<string,string>>>"


def corpus_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Every file under ``root``: ``relpath, name, length`` and, if asked, ``content``.

    Without content only the listing is read.  With it, a file that cannot be read comes with null content
    (``unreadable``): the files that can be are found by reading them, and only their paths move."""
    def load(corrupt: bool) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", str(corrupt).lower()).load(root)

    df = load(content)
    rel = F.regexp_replace("path", r"^.*?\Q" + root.split("://")[-1].rstrip("/") + r"\E/+", "")
    cols = [rel.alias("relpath"), F.element_at(F.split("path", "/"), -1).alias("name"), "length"]
    if not content:
        return df.select(*cols)
    read = df.where("content is not null").select("path")
    lost = load(False).select("path", "length").join(read, "path", "left_anti")
    return df.where("content is not null").select(*cols, "content").unionByName(lost.select(*cols, F.lit(None).cast("binary").alias("content")))


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.  Where that is unset, a session on
    one machine gets a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strataprof-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{scratch(spark)}/strataprof/{name}-{uuid.uuid4().hex}"


def read_graphs(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``models, nodes, edges`` from JSON files of one graph each, or of one graph a line; broken ones are skipped."""
    g = spark.read.schema(GRAPH).option("multiLine", not lines).option("mode", "DROPMALFORMED").json(path).where("id is not null")
    nodes = g.select(F.col("id").alias("model_id"), F.posexplode("nodes").alias("pos", "n")).select(
        "model_id", F.col("n.id").alias("node_id"), "pos", "n.type", "n.name", "n.data", "n.attributes", "n.operations", "n.literals"
    )
    edges = g.select(F.col("id").alias("model_id"), F.posexplode("edges").alias("pos", "e")).select(
        "model_id", F.col("e.id").alias("edge_id"), "pos", F.col("e.sourceId").alias("source_id"), F.col("e.targetId").alias("target_id"), "e.type", "e.data"
    )
    return g.select(F.col("id").alias("model_id"), "language", "data"), nodes, edges


def graphs_as_json(models: DataFrame, nodes: DataFrame, edges: DataFrame, origin: DataFrame | None = None) -> DataFrame:
    """``model_id, json, json_bytes``: each graph as one JSON text, as large as its model.  ``origin(model_id, source_path,
    source_relpath, filesize)``: the file that a model is from, kept in its data."""
    n = nodes.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node_id").alias("id"), "type", "name"))).alias("nodes"))
    e = edges.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct(F.col("edge_id").alias("id"), F.col("source_id").alias("sourceId"), F.col("target_id").alias("targetId"), "type"))).alias("edges"))
    joined = models.join(n, "model_id", "left").join(e, "model_id", "left")
    said = []
    if origin is not None:
        joined = joined.join(origin.select("model_id", "source_path", "source_relpath", F.col("filesize").cast("string").alias("filesize")), "model_id", "left")
        said = [F.struct("source_path", "source_relpath", "filesize").alias("data")]
    text = F.to_json(F.struct(F.col("model_id").alias("id"), "language", *said, "nodes", "edges"))
    return joined.select("model_id", text.alias("json")).withColumn("json_bytes", F.octet_length("json"))


def write_graphs(models: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, origin: DataFrame | None = None) -> DataFrame:
    """One graph a line, in a folder made anew; ``model_id, file_size_bytes_ir`` of each, read from what was written."""
    graphs_as_json(models, nodes, edges, origin).select("json").write.mode("overwrite").text(path)
    back = models.sparkSession.read.text(path)
    return back.select(F.get_json_object("value", "$.id").alias("model_id"), F.octet_length("value").alias("file_size_bytes_ir"))


# --- runs: all tables of a run or none of them -----------------------------------------------------------------------

MANIFEST = "run string, written_at timestamp, source string, name string, format string, schema string, rows long, files long, bytes long"


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_run(spark: SparkSession, path: str, tables: dict[str, DataFrame], source: str | None = None, fmt: str = "parquet") -> str:
    """Writes the tables of a run, and the name of the run.

    They go to a folder beside those of other runs whose name readers pass over; a manifest tells what each holds and what
    the run was made from; last, the folder gets its name.  A run that fails leaves nothing that is read."""
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    run = f"run-{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    fs, staging = _at(spark, f"{path.rstrip('/')}/_writing-{run}")
    try:
        rows = []
        for name, df in tables.items():
            where = f"{staging}/{name}"
            df.write.format(fmt).save(where)
            held = fs.getContentSummary(_at(spark, where)[1])
            files = sum(1 for s in fs.listStatus(_at(spark, where)[1]) if s.getPath().getName().startswith("part-"))
            n = spark.read.schema(df.schema).format(fmt).load(where).count()
            rows.append((run, now, source, name, fmt, df.schema.json(), n, files, held.getLength()))
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{staging}/manifest")
        if not fs.rename(staging, _at(spark, f"{path.rstrip('/')}/{run}")[1]):
            raise OSError(f"could not rename {staging}")
    except BaseException:
        fs.delete(staging, True)
        raise
    return run


def runs(spark: SparkSession, path: str) -> list[str]:
    """Whole runs, the latest last."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [x for x in names if x.startswith("run-") and fs.exists(_at(spark, f"{path.rstrip('/')}/{x}/manifest/_SUCCESS")[1])]


def manifest(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    run = run or (runs(spark, path) or [None])[-1]
    if not run:
        raise FileNotFoundError(f"no run in {path}")
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/{run}/manifest")


def read_run(spark: SparkSession, path: str, name: str, run: str | None = None) -> DataFrame:
    """A table of a run, the latest if none is named, with the schema that it was written with."""
    found = manifest(spark, path, run).where(F.col("name") == name).first()
    if found is None:
        raise KeyError(name)
    schema = T.StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).format(found["format"]).load(f"{path.rstrip('/')}/{found['run']}/{name}")


DIAGNOSTICS = (
    "model_id string, relpath string, parse_status string, parse_error_msg string, elements_loaded long, elements_skipped long, parse_time_ms long, "
    "file_size_bytes_source long, file_size_bytes_ir long, warning_count long, warnings_by_type map<string,long>"
)


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """The parse diagnostics of a run, JSON lines in the folder ``ir_info`` in ``path`` or beside it; an error if neither
    is there."""
    for at in (f"{path.rstrip('/')}/ir_info", f"{path.rstrip('/').rsplit('/', 1)[0]}/ir_info"):
        where = spark._jvm.org.apache.hadoop.fs.Path(at)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return spark.read.schema(DIAGNOSTICS).json(at)
    raise FileNotFoundError(f"no ir_info in {path} or beside it")


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    diagnostics.write.mode("overwrite").json(f"{path.rstrip('/')}/ir_info")


def read_catalog(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Construct rows of a language; none if it is not known."""
    c = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    return c.where(F.col("language") == language).select(F.explode("constructs").alias("c")).select("c.*")


def write_measures(df: DataFrame, path: str) -> None:
    """Per-model figures ``model_id, dimension, measure, value``: one folder a measure, so that reading one prunes the
    others."""
    df.write.mode("overwrite").partitionBy("dimension", "measure").parquet(path)


def read_measures(spark: SparkSession, path: str, dimension: str | None = None, measure: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if dimension:
        df = df.where(F.col("dimension") == dimension)
    return df.where(F.col("measure") == measure) if measure else df


def model_index(measures: DataFrame) -> DataFrame:
    return measures.select("model_id").distinct().orderBy("model_id")


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder a table, in Parquet or JSON."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def melt(df: DataFrame, dimension: str) -> DataFrame:
    """A wide per-model table as ``model_id, dimension, measure, value``."""
    cols = [c for c in df.columns if c != "model_id"]
    return df.unpivot("model_id", [F.col(c).cast("double").alias(c) for c in cols], "measure", "value").withColumn("dimension", F.lit(dimension))
