"""Ad-hoc views: a ``ViewSpec`` compiled to DataFrame operations over a wide per-model table."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataprof.functions import stats

ORDERING = ("gt", "gte", "lt", "lte")
OPS = ("eq", "ne", *ORDERING, "contains", "in", "not_in", "is_null", "is_not_null")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class ViewSpec:
    """chart: kpi, bar, pie, histogram or scatter; ``x``, ``y``, ``color``, ``bins`` as the chart needs."""

    name: str
    chart: str
    x: str
    y: str | None = None
    color: str | None = None
    bins: int | None = None
    filters: tuple[Filter, ...] = field(default_factory=tuple)


def flatten(df: DataFrame) -> DataFrame:
    """Structs become columns with dotted names; maps and arrays are leaves."""
    out: list[Column] = []

    def walk(schema: T.StructType, path: tuple[str, ...]) -> None:
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))

    walk(df.schema, ())
    return df.select(out)


def wide(tables: dict[str, DataFrame], paths: DataFrame | None = None) -> DataFrame:
    """One row per model of any table: full outer joins on ``model_id``, columns named ``table.column``."""
    out = None
    for name, t in tables.items():
        part = flatten(t)
        part = part.select("model_id", *[F.col(f"`{c}`").alias(f"{name}.{c}") for c in part.columns if c != "model_id"])
        out = part if out is None else out.join(part, "model_id", "full")
    if paths is not None:
        out = out.join(paths.select("model_id", "relpath"), "model_id", "left").withColumn("relpath", F.coalesce("relpath", "model_id"))
    return out


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.MapType):
        return f"map_{_kind(t.valueType)}"
    return "string" if isinstance(t, T.StringType) else "mixed"


def field_catalog(df: DataFrame) -> DataFrame:
    """``field, type, sample, n, non_null, n_distinct, is_unique``.  Values of all columns become (field, text) pairs, which
    are counted by pair and then by field; the sample is the smallest text.  Unique: no value twice, nulls aside."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, T.MapType):
            return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_q(c)))))
        return F.to_json(_q(c)) if isinstance(kind, (T.StructType, T.ArrayType)) else _q(c).cast("string")

    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in df.columns])).alias("x")).select("x.*")
    counted = pairs.groupBy("field", "value").agg(F.count("*").alias("n")).groupBy("field").agg(
        F.min("value").alias("sample"), F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("n_distinct")
    )
    fields = df.sparkSession.createDataFrame([(c, _kind(df.schema[c].dataType)) for c in df.columns], "field string, type string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = fields.join(counted, "field", "left").select("field", "type", "sample", zero("n"), zero("non_null"), zero("n_distinct"))
    return rows.withColumn("is_unique", (F.col("n_distinct") == F.col("non_null")) & (F.col("non_null") > 0))


def predicate(df: DataFrame, f: Filter) -> Column:
    """A filter as a condition.  A null differs from every value and is in no list; it is never in order with one."""
    v = _q(f.field)
    match f.op:
        case "eq":
            return v.eqNullSafe(F.lit(f.value))
        case "ne":
            return ~v.eqNullSafe(F.lit(f.value))
        case "in":
            return F.coalesce(v.isin(list(f.value)), F.lit(False))
        case "not_in":
            return F.coalesce(~v.isin(list(f.value)), F.lit(True))
        case "contains":
            return F.coalesce(F.contains(F.lower(v), F.lit(str(f.value).lower())), F.lit(False))
        case "is_null":
            return v.isNull()
        case "is_not_null":
            return v.isNotNull()
    d = v.cast("double")
    sound = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    test = {"gt": d > f.value, "gte": d >= f.value, "lt": d < f.value, "lte": d <= f.value}[f.op]
    return F.coalesce(sound & test, F.lit(False))


def check(df: DataFrame, spec: ViewSpec) -> None:
    """Errors that the schema shows, before anything is planned."""
    for name in filter(None, (spec.x, spec.y, spec.color)):
        if name not in df.columns:
            raise ValueError(f"unknown field {name}")
    for f in spec.filters:
        if f.op not in OPS:
            raise ValueError(f"unknown operator {f.op}")
        if f.field not in df.columns:
            raise ValueError(f"unknown field {f.field}")
        kind = _kind(df.schema[f.field].dataType)
        number = isinstance(f.value, (int, float)) and not isinstance(f.value, bool)
        if f.op in ORDERING and (kind != "number" or not number):
            raise ValueError(f"{f.op} needs a numeric field and value")
        if f.op == "contains" and (kind != "string" or not isinstance(f.value, str)):
            raise ValueError("contains needs a text field and value")
        if f.op in ("in", "not_in") and not isinstance(f.value, (list, tuple)):
            raise ValueError(f"{f.op} needs a list")
    kinds = {c: _kind(df.schema[c].dataType) for c in df.columns}
    if spec.chart in ("kpi", "histogram") and kinds[spec.x] != "number":
        raise ValueError(f"{spec.chart} needs a numeric field")
    if spec.chart == "bar" and not kinds[spec.x].startswith("map") and (spec.y is None or spec.x == spec.y or kinds[spec.y] != "number"):
        raise ValueError("bar needs a map, or a key and a numeric field")
    if spec.chart == "scatter" and (spec.y is None or kinds[spec.x] != "number" or kinds[spec.y] != "number"):
        raise ValueError("scatter needs two numeric fields")
    if spec.chart not in ("kpi", "bar", "pie", "histogram", "scatter"):
        raise ValueError(f"unknown chart {spec.chart}")


def filtered(df: DataFrame, filters: tuple[Filter, ...]) -> DataFrame:
    for f in filters:
        df = df.where(predicate(df, f))
    return df


def _finite(v: Column) -> Column:
    d = v.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _entries(df: DataFrame, name: str) -> DataFrame:
    """Sums of map entries by key; true counts as 1."""
    v = F.col("v").cast("double") if not isinstance(df.schema[name].dataType.valueType, T.BooleanType) else F.col("v").cast("int").cast("double")
    return df.select(F.explode(_q(name)).alias("key", "v")).select("key", v.alias("value")).where("value is not null").groupBy("key").agg(F.sum("value").alias("value"))


def corpus_kpi(measures: DataFrame, value: str) -> DataFrame:
    """``value, n`` of one corpus measure, from its one-row frame; maps and mixed values are refused."""
    if value not in measures.columns:
        raise ValueError(f"unknown field {value}")
    if _kind(measures.schema[value].dataType) not in ("number", "boolean", "string"):
        raise ValueError(f"{value} is no scalar")
    return measures.agg(F.first(_q(value)).alias("value"), F.count("*").alias("n"))


def run(df: DataFrame, spec: ViewSpec, name_col: str = "model_id") -> DataFrame:
    """The chart's data.  Counts that decide whether a chart makes sense are taken first; they are single aggregates."""
    check(df, spec)
    rows = filtered(df, spec.filters)
    is_map = isinstance(df.schema[spec.x].dataType, T.MapType)
    if spec.chart == "kpi":
        v = _finite(_q(spec.x))
        return rows.agg(F.avg(v).alias("value"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    if spec.chart == "histogram":
        bins = min(100, max(2, spec.bins or 20))
        src = rows.select(_finite(_q(spec.x)).alias("v")).where("v is not null")
        if src.limit(2).count() < 2:
            raise ValueError("a histogram needs two values")
        return stats.histogram(src, "v", bins=bins)
    if spec.chart == "bar":
        if is_map:
            return _entries(rows, spec.x).orderBy(F.desc("value"), "key")
        if rows.groupBy(_q(spec.x)).count().where("count > 1").limit(1).count():
            raise ValueError(f"{spec.x} is not unique")
        return rows.select(_q(spec.x).cast("string").alias("key"), _finite(_q(spec.y)).alias("value")).where("value is not null").orderBy("key")
    if spec.chart == "pie":
        if is_map:
            out = _entries(rows, spec.x)
            if out.limit(2).count() < 2:
                raise ValueError("a pie needs two entries")
            return out.orderBy(F.desc("value"), "key")
        out = rows.where(_q(spec.x).isNotNull()).groupBy(_q(spec.x).cast("string").alias("key")).agg(F.count("*").cast("double").alias("value"))
        kinds, most = out.agg(F.count("*"), F.max("value")).first()
        if not 2 <= kinds <= 12 or most == 1:
            raise ValueError("a pie needs 2 to 12 categories that repeat")
        return out.orderBy(F.desc("value"), "key")
    points = rows.select(F.col(name_col), _finite(_q(spec.x)).alias("x"), _finite(_q(spec.y)).alias("y"), *([_color(_q(spec.color)).alias("color")] if spec.color else []))
    points = points.where("x is not null and y is not null")
    if points.limit(2).count() < 2:
        raise ValueError("a scatter needs two points")
    if spec.color and points.select("color").distinct().limit(9).count() > 8:
        raise ValueError("too many colours")
    return points


def _color(v: Column) -> Column:
    t = v.cast("string")
    return F.when(v.isNull() | t.isin("", "false"), "(empty)").otherwise(t)


STORE = "name string, spec string, created_at timestamp, updated_at timestamp, version string"


class ViewStore:
    """Saved views as a log of small JSON rows: a change adds a row and takes none away, so writers do not undo each other.
    Of a name the latest row stands; one without a spec says that the view is deleted.  Stored rows that are no view any more
    are dropped on reading.  ``compact`` leaves the standing rows only, for a store that nobody writes to meanwhile."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(STORE).json(self.path)
        except Exception as e:  # no store yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _rows(self) -> dict[str, dict]:
        log = self._log()
        if log is None:
            return {}
        latest = F.max_by(F.struct(*log.columns), F.struct("updated_at", F.coalesce("version", F.lit("")))).alias("r")
        rows = log.where("name is not null").groupBy("name").agg(latest).select("r.*").where("spec is not null").collect()
        return {r["name"]: r.asDict() for r in rows if self._spec(r["spec"])}

    @staticmethod
    def _spec(text: str | None) -> ViewSpec | None:
        try:
            d = json.loads(text or "")
            return ViewSpec(**d | {"filters": tuple(Filter(**f) for f in d.get("filters", ()))})
        except (ValueError, TypeError):
            return None

    def _add(self, *changes: tuple[str, str | None, datetime | None]) -> None:
        """Rows of name, spec and when it was made (now, if null), in one write."""
        now = datetime.now(timezone.utc)
        data = [(name, spec, made or now, now, uuid.uuid4().hex) for name, spec, made in changes]
        self.spark.createDataFrame(data, STORE).coalesce(1).write.mode("append").json(self.path)

    def list(self) -> list[ViewSpec]:
        return [self._spec(r["spec"]) for _, r in sorted(self._rows().items())]

    def save(self, spec: ViewSpec) -> None:
        self._add((spec.name, json.dumps(asdict(spec)), self._rows().get(spec.name, {}).get("created_at")))

    def rename(self, name: str, new: str) -> None:
        old = self._rows()[name]
        spec = json.dumps(asdict(replace(self._spec(old["spec"]), name=new)))
        self._add(*([(name, None, None)] if name != new else []), (new, spec, old["created_at"]))

    def delete(self, name: str) -> None:
        self._add((name, None, None))

    def compact(self) -> None:
        rows = [tuple(r[c] for c in ("name", "spec", "created_at", "updated_at", "version")) for r in self._rows().values()]
        self.spark.createDataFrame(rows, STORE).coalesce(1).write.mode("overwrite").json(self.path)

    def run(self, name: str, df: DataFrame) -> DataFrame:
        return run(df, self._spec(self._rows()[name]["spec"]))
