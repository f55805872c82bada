"""Registered queries over sources, errors and the embedding API, with the DuckDB text of the same rows.

Files and databases of these queries hold small tables of the input (or the few rows named here) and lie in the folder of
spark.checkpoint.dir, which executors share.
"""

from __future__ import annotations

import json
import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from threading import Thread

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .queries import Query
from .sources.config import load_sources
from .sources.fetch import function_source, http_source, sqlite_source
from .sources.tables import TableSource, file_source


def folder(spark: SparkSession) -> str:
    """A new folder that executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sluice-")
    return f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}"


def nation_file(fmt: str, write: Callable[[DataFrame, str], None], suffix: str = "", **more) -> Callable:
    def source(spark: SparkSession, sf_dir: str) -> TableSource:
        path = folder(spark) + suffix
        write(spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1), path)
        return file_source(spark, {"path": path, "format": fmt, "keyColumn": "n_nationkey", "fields": ["n_name", "n_regionkey"]} | more)

    return source


def local(path: str) -> Path:
    place = Path(path.removeprefix("file://"))
    place.parent.mkdir(parents=True, exist_ok=True)
    return place


def write_json_array(df: DataFrame, path: str) -> None:
    """nation, a table of constant size, as one JSON array."""
    local(path).write_text(json.dumps([r.asDict() for r in df.collect()]))


def write_repeated(df: DataFrame, path: str) -> None:
    """Two rows for each key; the second one counts."""
    twice = df.selectExpr("n_nationkey", "'old' as n_name", "n_regionkey").unionAll(df)
    local(path).write_text("n_nationkey,n_name,n_regionkey\n" + "".join(f"{r[0]},{r[1]},{r[2]}\n" for r in twice.collect()))


def nation_sqlite(spark: SparkSession, sf_dir: str):
    path = local(folder(spark) + ".db")
    with sqlite3.connect(path) as db:
        db.execute("create table n(k integer, name text, region integer)")
        db.executemany("insert into n values (?, ?, ?)", [tuple(r) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()])
    return sqlite_source({"class": "SqliteSource", "dbPath": str(path), "sqlTemplate": "select name, region from n where region = :key order by k", "availableFields": ["name", "region"], "fieldTypes": {"region": "int"}})


def nation_http(spark: SparkSession, sf_dir: str):
    """A server on the driver's host that answers for one nation, and wants a header with its password."""
    names = {str(r[0]): {"id": r[0], "at": {"name": r[1], "regions": [r[2]]}} for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = names.get(self.path.split("?")[0].rpartition("/")[2])
            ok = found and self.headers["X-Key"] == "open"
            self.send_response(200 if ok else 404)
            self.end_headers()
            self.wfile.write(json.dumps(found if ok else {}).encode())

        def log_message(self, *args) -> None:
            pass

    host = spark.conf.get("spark.driver.host", "127.0.0.1")
    server = ThreadingHTTPServer((host, 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return http_source({"class": "HttpJsonApi", "urlBase": f"http://{host}:{server.server_address[1]}", "keyUrlTemplate": "/nation/$", "auth": {"type": "header", "key": "X-Key", "value": "open"}, "resultPath": {"name": "$.at.name", "region": "$.at.regions[0]"}, "fieldTypes": {"region": "int"}, "concurrency": 4})


def even_only(key, fields):
    if key % 2:
        raise ValueError("odd")
    return [[key * 10] for _ in fields]


def configured(spark: SparkSession, sf_dir: str):
    """A source by its JSON configuration, found by its suffix."""
    path = folder(spark) + "/n.parquet"
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(path)
    return load_sources(spark, json.dumps({"sources": [{"class": "Local", "name": "s", "path": path, "keyColumn": "n_nationkey"}]}))["s"]


@dataclass(frozen=True)
class ApiQuery:
    """Rows that calls of the embedding API give; its inputs are JSON rows, so no table is read."""

    calls: Callable[[SparkSession], list[tuple]]
    schema: str
    sql: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(self.calls(spark), self.schema)


PRICES = 't(x as long, s as string) | project half = 10 / x, n = int(s);'
REQUEST = {"pipeline": "t", "data": [{"x": 5, "s": "7"}, {"x": 0, "s": "a"}, {"x": None, "s": None}]}


def processed(spark: SparkSession) -> list[tuple]:
    got = Engine(spark, PRICES).process({"requests": [REQUEST, {"pipeline": "none", "data": []}]})["results"]
    bad = {(e["row"], e["column"]) for e in got[0]["errors"]}
    return [(i, r["x"], r["half"], r["n"], (i, "half") in bad, (i, "n") in bad, got[0]["status"], got[1]["status"][:5], got[0]["count"]) for i, r in enumerate(got[0]["data"])]


def looked_up(spark: SparkSession) -> list[tuple]:
    keys = [4, 7, "a", None, 4]
    rows = Engine(spark, "", {"s": function_source(lambda key, fields: [[str(key) + "!"]], {"v": "string"})}).lookup("s", keys, ["v"])
    return [(i, str(k) if k is not None else None, r["v"]) for i, (k, r) in enumerate(zip(keys, rows, strict=True))]


def described(spark: SparkSession) -> list[tuple]:
    e = Engine(spark, "t(x as int, s as string) | where (x > 1) | project y = x + 2;", {"f": function_source(even_only, {"v": "long"})})
    p = e.pipelines()["t"]
    return [("input", json.dumps(p["input"])), ("output", json.dumps(p["output"])), ("sources", ",".join(e.lookup_sources())), ("health", str(e.health_check())), ("version", str(bool(e.version())))]


def refused(spark: SparkSession) -> list[tuple]:
    """Definitions and bindings that are errors."""
    out = []
    for i, text in enumerate(["t(x as int) | project x = 1;", "t(x as int) | lookup x = v from f on x;", "t(x as int) | where y > 1;", "t(x as int) | project z = nope(x);", "t(x as int) | project z = x + 1;"]):
        status = Engine(spark, text, {"f": function_source(even_only, {"v": "long"})}).process({"requests": [{"pipeline": "t", "data": [{"x": 1}]}]})["results"][0]["status"]
        out.append((i, status[:5]))
    return out


N = "(c_custkey as long, c_nationkey as int) | lookup n_name, n_regionkey as long from s on c_nationkey;"
N_SQL = "SELECT c_custkey, c_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"
ODD = "(c_custkey as long, c_nationkey as int) | project k = {key} | lookup v from s on k | project bad = case when v is null then 1 else 0 end"

SOURCES: dict[str, Query | ApiQuery] = {
    "source_csv": Query("customer", N, N_SQL, {"s": nation_file("csv", lambda df, p: df.write.option("header", True).csv(p))}),
    "source_csv_gz": Query("customer", N, N_SQL, {"s": nation_file("csv", lambda df, p: df.write.option("header", True).option("compression", "gzip").csv(p))}),
    "source_parquet": Query("customer", N, N_SQL, {"s": nation_file("auto", lambda df, p: df.write.parquet(p), ".parquet")}),
    "source_json": Query("customer", N, N_SQL, {"s": nation_file("auto", write_json_array, ".json")}),
    "source_ndjson": Query("customer", N, N_SQL, {"s": nation_file("ndjson", lambda df, p: df.write.json(p))}),
    "source_last_row_wins": Query("customer", N, N_SQL, {"s": nation_file("auto", write_repeated, ".csv")}),
    "source_registry": Query("customer", N, N_SQL, {"s": configured}),
    "source_sqlite": Query("region", "(r_regionkey as int) | join kind=left-inner name, region from s on r_regionkey;", "SELECT r_regionkey, n_name AS name, n_regionkey AS region FROM region JOIN nation ON r_regionkey = n_regionkey", {"s": nation_sqlite}),
    "source_http": Query("customer", "(c_custkey as long, c_nationkey as int) | lookup name, region from s on c_nationkey;", "SELECT c_custkey, c_nationkey, n_name AS name, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", {"s": nation_http}),
    "lookup_source_failure": Query("customer", ODD.format(key="c_nationkey") + "| project-keep c_custkey, v;", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey * 10 AS BIGINT) END AS v FROM customer", {"s": lambda s, d: function_source(even_only, {"v": "long"})}),
    "lookup_failure_is_an_error": Query("customer", "(c_custkey as long, c_nationkey as int) | lookup v from s on c_nationkey | ignore-error;", "SELECT c_custkey, c_nationkey, CAST(c_nationkey * 10 AS BIGINT) AS v FROM customer WHERE c_nationkey % 2 = 0", {"s": lambda s, d: function_source(even_only, {"v": "long"})}),
    "lookup_null_key": Query("customer", "(c_custkey as long, c_nationkey as int) | project k = case when (c_nationkey > 9) then c_nationkey end | lookup n_name from s on k | project-remove c_nationkey | ignore-error;", "SELECT c_custkey, CASE WHEN c_nationkey > 9 THEN c_nationkey END AS k, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_nationkey > 9", {"s": ("nation", "n_nationkey")}),
    "lookup_error_key": Query("customer", "(c_custkey as long, c_nationkey as int) | lookup n_name from s on (c_nationkey div (c_nationkey % 2)) | ignore-error;", "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 2 <> 0", {"s": ("nation", "n_nationkey")}),
    "join_error_key": Query("customer", "(c_custkey as long, c_nationkey as int) | join kind=left-inner n_name from s on (c_nationkey div (c_nationkey % 2)) | project-keep c_custkey, n_name;", "SELECT c_custkey, CASE WHEN c_nationkey % 2 <> 0 THEN n_name END AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", {"s": ("nation", "n_nationkey")}),
    "api_process": ApiQuery(processed, "i int, x long, half long, n int, bad_half boolean, bad_n boolean, status string, other string, count long", "SELECT * FROM (VALUES (0, 5::BIGINT, 2::BIGINT, 7, false, false, 'OK', 'ERROR', 3::BIGINT), (1, 0, NULL, NULL, true, true, 'OK', 'ERROR', 3), (2, NULL, NULL, NULL, true, false, 'OK', 'ERROR', 3)) t(i, x, half, n, bad_half, bad_n, status, other, count)"),
    "api_lookup": ApiQuery(looked_up, "i int, k string, v string", "SELECT * FROM (VALUES (0, '4', '4!'), (1, '7', '7!'), (2, 'a', 'a!'), (3, NULL, NULL), (4, '4', '4!')) t(i, k, v)"),
    "api_descriptions": ApiQuery(described, "what string, shown string", """SELECT * FROM (VALUES ('input', '{"x": "int", "s": "string"}'), ('output', '{"x": "int", "s": "string", "y": "int"}'), ('sources', 'f'), ('health', 'True'), ('version', 'True')) t(what, shown)"""),
    "api_refusals": ApiQuery(refused, "i int, status string", "SELECT * FROM (VALUES (0, 'ERROR'), (1, 'ERROR'), (2, 'ERROR'), (3, 'ERROR'), (4, 'OK')) t(i, status)"),
}
