import asyncio
import json
import pickle
import sqlite3
from concurrent.futures import ThreadPoolExecutor
from urllib.request import Request, urlopen

import pyarrow.compute as pc
import pytest

from sluice import service as services
from sluice.engine import Engine
from sluice.plans.syntax import PipelineError
from sluice.service import Service
from sluice.sources.fetch import client_source, dbapi_client, document_client, function_source

DOUBLES = function_source(lambda key, fields: [[key * 2]], {"v": "string"})


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("numbers") / "t.parquet")
    spark.createDataFrame([(i, f"w{i % 7}", i / 10, None if i % 5 == 0 else i % 3 == 0) for i in range(200)], "a long, s string, d double, b boolean").write.parquet(path)
    return spark.read.parquet(path)


def test_conjunctions_and_disjunctions_reach_the_scan(spark, numbers):
    e = Engine(spark, 't(a as long, s as string, d as double, b as bool) | where (a > 20) and (s == "w3") and (d <= 9.5); o(a as long, d as double) | where (a > 190) or (d < 1.0); n(a as long, b as bool) | where b or (a > 100);')
    pushed = plan(e.run("t", numbers)).split("PushedFilters: [")[1].split("]")[0]
    for part in ("GreaterThan(a,20)", "EqualTo(s,w3)", "LessThanOrEqual(d,9.5)"):
        assert part in pushed
    assert "Or(" in plan(e.run("o", numbers)).split("PushedFilters: [")[1]
    assert [r.a for r in e.run("t", numbers).collect()] == [a for a in range(21, 96) if a % 7 == 3]
    # a null operand is an error, so the row goes even where the other side is true
    assert sorted(r.a for r in e.run("n", numbers).collect()) == [i for i in range(200) if i % 5 and (i % 3 == 0 or i > 100)]
    with pytest.raises(PipelineError):
        Engine(spark, "x(a as long) | where a and (a > 1);").run("x", numbers)


def test_nested_calls_grow_in_proportion(spark, numbers):
    def size(depth: int, stage: str) -> int:
        inner = "s"
        for _ in range(depth):
            inner = f"substring({inner}, 0, 5)"
        df = Engine(spark, f"t(s as string) | {stage.format(inner)};").run("t", numbers)
        assert df.count() == 200
        return len(df._jdf.queryExecution().toString())

    for stage in ("project z = {}", 'where ({} != "x")'):
        few, many = size(4, stage), size(8, stage)
        assert many < 3 * few


def test_a_random_argument_has_one_value(spark):
    e = Engine(spark, "t(a as long) | project k = bucket(rand(), 0.5, 0.75) | summarize n = count() by k;")
    got = {r.k: r.n for r in e.run("t", spark.range(20_000).withColumnRenamed("id", "a")).collect()}
    assert abs(got[0] - 10_000) < 500 and abs(got[1] - 5_000) < 400 and abs(got[2] - 5_000) < 400


def test_session_settings_stay(spark, numbers):
    before = spark.conf.get("spark.sql.caseSensitive")
    Engine(spark, "t(a as long) | project A = a + 1;").run("t", numbers).collect()
    assert spark.conf.get("spark.sql.caseSensitive") == before


def test_health_leaves_pipelines_alone(spark):
    e = Engine(spark, "health(x as long) | project y = x + 1;")
    assert e.health_check() and e.health_check()
    assert e.process({"requests": [{"pipeline": "health", "data": {"x": 1}}]})["results"][0]["data"] == [{"x": 1, "y": 2}]


def test_lookup_of_mixed_keys_and_of_many_threads(spark):
    e = Engine(spark, "", {"s": DOUBLES})
    assert [r["v"] for r in e.lookup("s", [4, "a", 2.5, None, 4], ["v"])] == ["8", "aa", "5.0", None, "8"]
    with ThreadPoolExecutor(6) as pool:
        assert [r[0]["v"] for r in pool.map(lambda i: e.lookup("s", [i], ["v"]), range(12))] == [str(2 * i) for i in range(12)]


def test_async_calls(spark):
    e = Engine(spark, "t(x) | project y = x + 1;", {"s": DOUBLES})

    async def both():
        return await asyncio.gather(e.process_async({"requests": [{"pipeline": "t", "data": {"x": 1}}]}), e.lookup_async("s", ["b"], ["v"]))

    done, found = asyncio.run(both())
    assert done["results"][0]["data"] == [{"x": 1, "y": 2}] and found == [{"v": "bb"}]


def twice(x):
    return x * 2


def test_pickled_engines_wake_up(spark):
    e = Engine(spark, "t(x as long) | project y = twice(x), z = neg(x);", udfs={"twice": (twice, "long")})
    e.register_expression("neg", "-({0})", "long")
    again = pickle.loads(pickle.dumps(e))
    assert again.process({"requests": [{"pipeline": "t", "data": {"x": 3}}]})["results"][0]["data"] == [{"x": 3, "y": 6, "z": -3}]


def test_functions_of_every_kind(spark):
    e = Engine(spark, "t(x as long) | project a = vec(x), b = native(x, 2), c = broken(x); j(s as string) | project n = java(s);")
    e.register_vectorised("vec", lambda a: pc.add(a, 10), "long")
    e.register_vectorised("broken", lambda a: a.no_such_method(), "long")
    e.register_expression("native", "{0} * {1}", "long")
    got = e.process({"requests": [{"pipeline": "t", "data": [{"x": 1}, {"x": 2}]}]})["results"][0]
    assert [(r["a"], r["b"], r["c"]) for r in got["data"]] == [(11, 2, None), (12, 4, None)]
    assert {(m["row"], m["column"]) for m in got["errors"]} == {(0, "c"), (1, "c")}
    with pytest.raises(PipelineError):
        e.register_expression("vec", "{0}")
    with pytest.raises(Exception, match="(?i)class"):
        e.register_java("java", "no.such.Class", "int")


def test_metrics_and_bad_bodies(spark):
    service = Service(Engine(spark, "t(x) | project y = x + 1;"), port=0)
    service.start()
    try:
        at = f"http://127.0.0.1:{service.port}"
        with urlopen(Request(at + "/process", data=json.dumps({"requests": [{"pipeline": "t", "data": {"x": 1}}]}).encode())) as r:
            assert json.loads(r.read())["results"][0]["data"] == [{"x": 1, "y": 2}]
        with pytest.raises(Exception, match="400"):
            urlopen(Request(at + "/process", data=b"{nope"))
        with urlopen(at + "/metrics") as r:
            text = r.read().decode()
        assert 'sluice_requests_total{path="/process",status="200"} 1' in text and 'status="400"} 1' in text
    finally:
        service.stop()


def test_definitions_and_tokens_over_http(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps({"access_token": f"T-{self.headers['Metadata']}"}) if self.path.startswith("/id") else f"who is {self.headers['Authorization']}"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_address[1]}"
        token = lambda resource: services.managed_identity(resource, at + "/id")
        assert token("x") == "T-true"
        assert services.load_text(at + "/p.blob.txt", token) == "who is Bearer T-true"
        assert services.load_text(at + "/p.txt", token) == "who is None"
    finally:
        server.shutdown()
        server.server_close()


def test_clients_of_drivers_and_document_stores(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t(k int, name text, age int)")
        db.executemany("insert into t values (?, ?, ?)", [(1, "Ann", 30), (1, "Bo", 31), (2, "Cy", 32)])
    sql = client_source({"class": "MsSqlSource", "path": path, "sqlTemplate": "select name, age from t where k = @P1 order by age", "availableFields": ["name", "age"], "fieldTypes": {"age": "long"}}, {"mssql": dbapi_client(lambda cfg: sqlite3.connect(cfg["path"], check_same_thread=False))}, "mssql")

    def pages(cfg, query, given):
        stored = [{"id": i, "at": {"city": f"c{i}"}} for i in range(3)]
        start = int(given["continuation"] or 0)
        return [d for d in stored[start : start + 1] if given["@key"] >= d["id"]], str(start + 1) if start < 2 else None

    documents = client_source({"class": "CosmosDb", "query": "select", "availableFields": ["at.city"]}, {"cosmosdb": document_client(pages)}, "cosmosdb")
    e = Engine(spark, "t(k as long) | join kind=left-inner name, age from people on k;", {"people": sql, "store": documents})
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert sorted(tuple(r) for r in e.run("t", df).collect()) == [(1, "Ann", 30), (1, "Bo", 31), (2, "Cy", 32)]
    ask = document_client(pages)({"query": "select"})
    assert ask(1, ["at.city", "id"]) == [["c0", 0], ["c1", 1]]
