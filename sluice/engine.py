"""The engine: pipelines, lookup sources and user functions bound to a SparkSession."""

from __future__ import annotations

import asyncio
import contextlib
import json
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import __version__
from .functions.registry import FUNCTIONS
from .operators.stages import ROW, Flow, OrderNeeded, apply, err_name, needs_errors, needs_rows
from .plans import syntax as S
from .plans import types as L
from .plans.syntax import PipelineError, parse, show_pipeline
from .plans.types import Ex, ident
from .sources.config import load_sources, masked
from .sources.fetch import FetchSource, function_source
from .sources.tables import TableSource

HEALTH = parse("health(n as long) | project out = n + 42;")[0]
BINDING = threading.RLock()


@contextlib.contextmanager
def exact_names(spark: SparkSession) -> Iterator[None]:
    """Names tell upper from lower case while a plan is bound; the session's own setting comes back after it."""
    with BINDING:
        before = spark.conf.get("spark.sql.caseSensitive")
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            yield
        finally:
            spark.conf.set("spark.sql.caseSensitive", before)


class Engine:
    """Runs pipelines on DataFrames (run) or on JSON rows (process).

    definitions: text of pipelines. sources: name to source, or the JSON text of a configuration. udfs: name to
    (function, DDL result type). A source may also be a DataFrame's (df, key) pair or a plain lookup function with types.

    An engine pickles as its definitions, sources and functions, which have to pickle themselves (a configuration's text
    does, DataFrames don't), and wakes up in the active session.
    """

    def __init__(self, spark: SparkSession, definitions: str = "", sources: Mapping | str | None = None, udfs: Mapping | None = None, clients: dict | None = None, token: Callable | None = None):
        self.spark = spark
        self._made_of = (sources, clients, token)
        self._functions: list[tuple] = []
        self._pipelines = {p.name: p for p in parse(definitions)}
        given = load_sources(spark, sources, clients, token) if isinstance(sources, str) else dict(sources or {})
        self._sources = {n: s if isinstance(s, (TableSource, FetchSource)) else TableSource(*s) if isinstance(s[0], DataFrame) else function_source(*s) for n, s in given.items()}
        self._udfs: dict[str, Callable] = {}
        for name, (function, kind) in (udfs or {}).items():
            self.register(name, function, kind)

    # ---- definitions ----

    def define(self, text: str) -> None:
        self._pipelines |= {p.name: p for p in parse(text)}

    def new_function(self, name: str, how: str, *what) -> None:
        if name in FUNCTIONS or name in self._udfs:
            raise PipelineError(f"the function {name} exists")
        self._functions.append((how, name, *what))

    def register(self, name: str, function: Callable, kind: str = "string") -> None:
        """A Python function on rows; an exception is an error cell. Runs in Arrow batches."""
        self.new_function(name, "register", function, kind)
        t = L.NAMED.get(kind) or T.DataType.fromDDL(kind)

        def guarded(*args):
            try:
                return (function(*args), None)
            except Exception as e:
                return (None, f"{type(e).__name__}: {e}"[:500])

        hidden = f"__udf_{name}"
        self.spark.udf.register(hidden, F.udf(guarded, T.StructType([T.StructField("value", t), T.StructField("error", T.StringType())]), useArrow=True))

        self._udfs[name] = guarded_call(hidden, t)

    def register_vectorised(self, name: str, function: Callable, kind: str = "string") -> None:
        """A Python function of pyarrow arrays that gives an array; an exception is an error in each cell of its batch."""
        self.new_function(name, "register_vectorised", function, kind)
        t = L.NAMED.get(kind) or T.DataType.fromDDL(kind)

        def guarded(*args: pa.Array) -> pa.Array:
            n = len(args[0])
            try:
                values, error = function(*args), pa.nulls(n, pa.string())
                return pa.StructArray.from_arrays([values, error], ["value", "error"])
            except Exception as e:
                return pa.StructArray.from_arrays([pa.nulls(n, to_arrow(t)), pa.array([f"{type(e).__name__}: {e}"[:500]] * n)], ["value", "error"])

        hidden = f"__udf_{name}"
        self.spark.udf.register(hidden, F.arrow_udf(guarded, T.StructType([T.StructField("value", t), T.StructField("error", T.StringType())])))
        self._udfs[name] = guarded_call(hidden, t)

    def register_java(self, name: str, java_class: str, kind: str = "string") -> None:
        """A Java class on the session's class path that implements one of Spark's UDF interfaces; its exceptions fail the job."""
        self.new_function(name, "register_java", java_class, kind)
        t = L.NAMED.get(kind) or T.DataType.fromDDL(kind)
        hidden = f"__udf_{name}"
        self.spark.udf.registerJavaFunction(hidden, java_class, t)
        self._udfs[name] = plain_call(lambda sqls: f"{hidden}({', '.join(sqls)})", t)

    def register_expression(self, name: str, template: str, kind: str = "string") -> None:
        """A native function: a Spark SQL expression of {0}, {1}, ..., which stays inside Catalyst; null is a regular result."""
        self.new_function(name, "register_expression", template, kind)
        t = L.NAMED.get(kind) or T.DataType.fromDDL(kind)
        self._udfs[name] = plain_call(lambda sqls: f"cast({template.format(*sqls)} as {t.simpleString()})", t)

    def add_source(self, name: str, source: TableSource | FetchSource) -> None:
        self._sources[name] = source

    def pipeline(self, name: str) -> S.Pipeline:
        if name not in self._pipelines:
            raise PipelineError(f"unknown pipeline {name}")
        return self._pipelines[name]

    # ---- runs ----

    def input(self, p: S.Pipeline, df: DataFrame, validation: str) -> tuple[DataFrame, dict, dict[str, Ex]]:
        """The declared columns by name (missing ones null, others dropped), cast to their declared types."""
        cast = {"strict": L.strict, "lenient": L.lenient}[validation]
        columns, types, errors = [], {}, {}
        for name, declared in p.columns:
            there = name in df.columns
            src = df.schema[name].dataType if there else L.NULL
            want = L.NAMED.get(declared) if declared else None
            raw = ident(name) if there else "null"
            if want is None or want == src:
                if declared == "array" and not (L.is_array(src) or L.is_null(src)) or declared == "object" and not (L.is_object(src) or L.is_null(src)):
                    errors[name] = Ex("null", L.NULL, f"if({raw} is null, null, 'no {declared}')")
                    raw, src = "null", L.NULL
                columns.append(f"{raw} as {ident(name)}" if not L.is_null(src) else f"null as {ident(name)}")
                types[name] = src
                continue
            sql = cast(raw, src, want)
            bad = f"if({raw} is not null and {f'({sql}) is null' if sql else 'true'}, 'no {declared}: ' || coalesce(cast({raw} as string), ''), null)" if there and not L.is_null(src) else None
            if bad and (L.is_array(src) or L.is_object(src)):
                bad = bad.replace(f"cast({raw} as string)", f"to_json({raw})")
            sql = sql or f"cast(null as {want.simpleString()})"
            columns.append(f"{sql} as {ident(name)}")
            types[name] = want
            if bad:
                errors[name] = Ex(sql, want, bad)
        return df, {"columns": columns, "types": types}, errors

    def flow(self, p: S.Pipeline, df: DataFrame, validation: str = "lenient", track: bool = False, order_by: str | None = None) -> Flow:
        rows = needs_rows(p.stages) or order_by is not None
        with exact_names(df.sparkSession):
            try:
                return self.bound(p, df, validation, track, order_by, rows)
            except OrderNeeded:
                return self.bound(p, df, validation, track, order_by, True)

    def bound(self, p: S.Pipeline, df: DataFrame, validation: str, track: bool, order_by: str | None, rows: bool) -> Flow:
        track = track or needs_errors(p.stages)
        df, bound, errors = self.input(p, df, validation)
        extra = [f"coalesce(cast({ident(order_by)} as bigint), {-(1 << 63) + 1}L) as {ident(ROW)}" if order_by else f"monotonically_increasing_id() as {ident(ROW)}"] if rows else []
        errs = [f"{e.err} as {ident(err_name(n))}" for n, e in errors.items()] if track else []
        start = df.selectExpr(*bound["columns"], *extra, *errs)
        return apply(Flow(start, bound["types"], frozenset(errors) if track else frozenset(), track, rows, sources=self._sources, udfs=self._udfs), p.stages)

    def run(self, name: str, df: DataFrame, validation: str = "lenient", order_by: str | None = None) -> DataFrame:
        """The pipeline over a DataFrame. order_by: a whole-number column that gives the order of rows, if it matters."""
        out = self.flow(self.pipeline(name), df, validation, order_by=order_by)
        with exact_names(df.sparkSession):
            return out.df.selectExpr(*(ident(n) for n in out.types)) if out.types else out.df.select()

    def run_with_errors(self, name: str, df: DataFrame, validation: str = "lenient", order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, errors): errors holds (row, column, message) of each error cell, row as the row id of the result."""
        out = self.flow(self.pipeline(name), df, validation, track=True, order_by=order_by)
        with exact_names(df.sparkSession):
            return self.split_errors(out)

    def split_errors(self, out: Flow) -> tuple[DataFrame, DataFrame]:
        ids = out.df.withColumn("row", F.monotonically_increasing_id())
        cells = F.array(*(F.struct(F.lit(n).alias("column"), F.col(ident(err_name(n))).alias("message")) for n in sorted(out.tracked))) if out.tracked else F.array().cast("array<struct<column:string,message:string>>")
        errors = ids.select("row", F.explode(cells).alias("c")).select("row", "c.column", "c.message").where("message is not null")
        return ids.selectExpr("row", *(ident(n) for n in out.types)), errors

    # ---- JSON rows ----

    def frame(self, rows: list[dict], columns: list[str]) -> DataFrame:
        """Rows of JSON values; whole numbers are longs, mixed columns become text."""
        return self.spark.createDataFrame([tuple(plain(r.get(c), kinds[c]) for c in columns) for r in rows], T.StructType([T.StructField(c, kinds[c]) for c in columns])) if (kinds := {c: json_type([r.get(c) for r in rows]) for c in columns}) else self.spark.createDataFrame([], T.StructType([]))

    def process_one(self, request: dict, pipeline: S.Pipeline | None = None) -> dict:
        """One request; pipeline stands in for the one that the request names."""
        began = time.perf_counter()
        name = request.get("pipeline", "")
        out = {"pipeline": name, "status": "OK", "time": 0.0, "count": 0, "data": [], "errors": []}
        try:
            p = pipeline or self.pipeline(name)
            data = request.get("data", [])
            df = self.frame(data if isinstance(data, list) else [data], [c for c, _ in p.columns])
            got = self.flow(p, df.coalesce(1), "strict" if request.get("validate") else "lenient", track=True)
            columns = [*map(ident, got.types), *(ident(err_name(n)) for n in got.types if n in got.tracked)]
            with exact_names(self.spark):
                shown = got.df.selectExpr(*columns)
            for i, r in enumerate(shown.toLocalIterator()):
                out["data"].append({n: to_json(r[n]) for n in got.types})
                for n in got.types:
                    if n in got.tracked and (m := r[err_name(n)]) is not None:
                        out["errors"].append({"row": i, "column": n, "message": m})
            out["count"] = len(out["data"])
            if request.get("errors") is False:
                out.pop("errors")
        except Exception as e:
            out["status"] = f"ERROR: {e}"
        out["time"] = (time.perf_counter() - began) * 1000
        return out

    def process(self, request: dict) -> dict:
        """{"requests": [{pipeline, data, validate?, errors?}]} to {"results": [...]}."""
        return {"results": [self.process_one(r) for r in request.get("requests", [])]}

    def lookup(self, source: str, keys: list, fields: list[str]) -> list[dict]:
        """One object for each key, nulls where there is none."""
        if source not in self._sources:
            raise PipelineError(f"unknown lookup source {source}")
        p = parse(f"lookup__(place as long, key) | lookup {', '.join(f'f{i}__ = {f}' for i, f in enumerate(fields))} from {source} on key;")[0]
        by_kind: dict[type, list[int]] = {}  # a column has one type, so keys of each type are asked apart
        for place, key in enumerate(keys):
            by_kind.setdefault(type(key), []).append(place)
        out: list[dict] = [dict.fromkeys(fields) for _ in keys]
        for kind, places in by_kind.items():
            if kind is type(None):
                continue
            got = self.process_one({"data": [{"place": i, "key": keys[i]} for i in places]}, p)
            if got["status"] != "OK":
                raise PipelineError(got["status"])
            for r in got["data"]:
                out[r["place"]] = {f: r[f"f{i}__"] for i, f in enumerate(fields)}
        return out

    async def process_async(self, request: dict) -> dict:
        return await asyncio.to_thread(self.process, request)

    async def lookup_async(self, source: str, keys: list, fields: list[str]) -> list[dict]:
        return await asyncio.to_thread(self.lookup, source, keys, fields)

    def pipelines(self) -> dict:
        out = {}
        for n, p in self._pipelines.items():
            entry = {"definition": show_pipeline(p), "input": {c: t or "dynamic" for c, t in p.columns}}
            try:
                empty = self.spark.createDataFrame([], T.StructType([T.StructField(c, L.NAMED.get(t or "", T.NullType())) for c, t in p.columns]))
                entry["output"] = {c: L.kind(t) if not L.is_null(t) else "dynamic" for c, t in self.flow(p, empty).types.items()}
            except Exception:  # a dynamic column has no type before a DataFrame is bound
                entry["output"] = None
            out[n] = entry
        return out

    def lookup_sources(self) -> dict:
        return {n: masked(s.info) | {"class": s.info.get("class", type(s).__name__)} for n, s in self._sources.items()}

    def health_check(self) -> bool:
        got = self.process_one({"data": {"n": 57}}, HEALTH)
        return got["status"] == "OK" and got["data"] == [{"n": 57, "out": 99}]

    def version(self) -> str:
        return __version__

    def __reduce__(self):
        return woken, (" ".join(show_pipeline(p) for p in self._pipelines.values()), *self._made_of, self._functions)


def woken(definitions: str, sources, clients, token, functions: list[tuple]) -> Engine:
    """An engine of the active session."""
    engine = Engine(SparkSession.active(), definitions, sources, clients=clients, token=token)
    for how, name, *what in functions:
        getattr(engine, how)(name, *what)
    return engine


def to_arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def guarded_call(hidden: str, t: T.DataType) -> Callable:
    """A call of a function that gives (value, error); it is made once for both."""

    def bind(args: list[Ex], binder) -> Ex:
        got = binder.hold(Ex(f"{hidden}({', '.join(a.sql for a in args)})", T.StructType(), level=max([0, *(a.level for a in args)])))
        errs = [a.err for a in args if a.err] + [f"{got.sql}.error"]
        return Ex(f"{got.sql}.value", t, f"coalesce({', '.join(errs)})" if len(errs) > 1 else errs[0], level=got.level)

    return bind


def plain_call(build: Callable[[list[str]], str], t: T.DataType) -> Callable:
    def bind(args: list[Ex], binder) -> Ex:
        errs = [a.err for a in args if a.err]
        return Ex(build([a.sql for a in args]), t, None if not errs else f"coalesce({', '.join(errs)})" if len(errs) > 1 else errs[0])

    return bind


def json_type(values: list) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if not kinds:
        return T.NullType()
    if kinds == {bool}:
        return T.BooleanType()
    if kinds == {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    if kinds == {list}:
        return T.ArrayType(json_type([x for v in values if v for x in v]))
    if kinds == {dict}:
        return T.MapType(T.StringType(), json_type([x for v in values if v for x in v.values()]))
    return T.TimestampType() if kinds == {datetime} else T.StringType()


def plain(v, t):
    if v is None:
        return None
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else json.dumps(v)
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.ArrayType):
        return [plain(x, t.elementType) for x in v]
    return {k: plain(x, t.valueType) for k, x in v.items()} if isinstance(t, T.MapType) else v


def to_json(v):
    """A cell as a JSON value: datetimes as text, NaN and infinities as null."""
    if isinstance(v, float):
        return v if v == v and abs(v) != float("inf") else None
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, list):
        return [to_json(x) for x in v]
    if isinstance(v, dict):
        return {k: to_json(x) for k, x in v.items()}
    return to_json(v.asDict(True)) if hasattr(v, "asDict") else v
