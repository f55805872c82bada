import sqlite3
from datetime import datetime

import pytest

from sluice.engine import Engine
from sluice.plans.syntax import PipelineError
from sluice.sources.fetch import FetchSource, decode_feature, function_source, http_source, json_path, sqlite_source
from sluice.sources.tables import TableSource, file_format


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def ab(spark):
    data = [(7, [-5, 0]), (3, None), (3, []), (7, [11]), (5, [2, 2, 2, 8])]
    return spark.createDataFrame(data, "a int, b array<int>").coalesce(1)


@pytest.fixture(scope="module")
def xyz(spark):
    return spark.createDataFrame([(5, 9, 100), (-2, 4, 101), (8, 9, 102), (8, 4, 103), (70, 6, 104)], "x int, y int, z int").coalesce(1)


def test_explode(spark, ab):
    e = Engine(spark, "t(a as int, b as array) | explode b; u(a as int, b as array) | explode a;")
    assert sorted(rows(e.run("t", ab))) == [(5, 2), (5, 2), (5, 2), (5, 8), (7, -5), (7, 0), (7, 11)]
    assert rows(e.run("u", ab)) == []  # no array: the row goes


def test_distinct(spark, ab):
    e = Engine(spark, "t(a as int, b as array) | distinct by a; u(a as int, b as array) | distinct;")
    assert sorted(rows(e.run("t", ab))) == [(3,), (5,), (7,)]
    assert e.run("u", ab.unionAll(ab)).count() == 5


def test_summarize(spark, xyz):
    e = Engine(spark, """t(x as int, y as int, z as int) | summarize n = count(), sx = sum(x), sz = sum(z) by y;
        u(x as int, y as int, z as int) | where (x > 1000) | summarize n = count();
        v(x as int, y as int, z as int) | summarize f = first(x), l = last(x), a = array_agg(x), s = collect_set(y), lo = min_by(y, x), hi = max_by(y, x), m = avg(x), i = array_agg_if(x, y == 4);""")
    assert sorted(rows(e.run("t", xyz)), key=lambda r: r[3]) == [(2, 6, 204, 4), (1, 70, 104, 6), (2, 13, 202, 9)]
    assert e.run("t", xyz).columns == ["n", "sx", "sz", "y"]
    assert rows(e.run("u", xyz)) == []  # no row for no input
    assert rows(e.run("v", xyz)) == [(5, 70, [5, -2, 8, 8, 70], [9, 4, 6], -2, 8, 17, [-2, 8])]


def test_aggregates_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (1, 2, True), (2, None, None)], "k int, v int, b boolean").coalesce(1)
    e = Engine(spark, "t(k as int, v as int, b as bool) | summarize c = count(v), ci = count_if(b), dc = distinct_count(v), s = sum(v), a = avg(v), e1 = every(b), y = any(b), f = first(v), fi = first(v, true), l = array_agg(v) by k;")
    got = {r[-1]: r[:-1] for r in rows(e.run("t", df))}
    assert got[1] == (2, 1, 2, 2, None, False, True, None, 2, [None, 2])
    assert got[2] == (1, 0, 1, None, None, False, None, None, None, [None])


def test_top(spark):
    data = [("p", 30), ("q", None), ("r", -4), ("s", 12), ("t", 77), ("u", 0)]
    df = spark.createDataFrame(data, "a string, b int")
    e = Engine(spark, "t(a as string, b as int) | top 4 by b asc nulls first; u(a as string, b as int) | top 2 by b;")
    assert [r[0] for r in rows(e.run("t", df))] == ["q", "r", "u", "s"]
    assert [r[0] for r in rows(e.run("u", df))] == ["t", "p"]


def test_projections(spark, xyz):
    e = Engine(spark, "t(x as int, y as int, z as int) | project-rename w = x, q = nope | project-remove y, nope | project-keep z, w;")
    assert e.run("t", xyz).columns == ["w", "z"]
    for bad in ("project x = 1", "project a = 1, a = 2", "project-rename y = x", "project-keep nope", "project a = nope + 1", "project a = nope(1)", 'project a = x + "s"', "project a = x and y", "summarize n = count(), n = count()", "lookup f from nope on x"):
        with pytest.raises(PipelineError):
            Engine(spark, f"t(x as int, y as int, z as int) | {bad};").run("t", xyz)


def test_where_keeps_true_only(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 0)], "a int, b int")
    assert rows(Engine(spark, "t(a as int, b as int) | where (b > 1);").run("t", df)) == [(2, 5)]
    assert rows(Engine(spark, "t(a as int, b as int) | where (10 / b > 1);").run("t", df)) == [(2, 5)]


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as twice", "cast(id as string) as s").write.parquet(str(tmp_path / "p"))
    df = Engine(spark, "t(id as long, twice as long, s as string) | where (id > 50) | project-keep id;").run("t", spark.read.parquet(str(tmp_path / "p")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan and "ReadSchema: struct<id:bigint>" in plan


SOURCE = {100: [("oak", 8), ("elm", 3)], 300: [("fir", 1), ("yew", 90), ("ash", 5)], 500: [("box", 2)]}


def fetch(key, fields):
    return [[dict(zip(("name", "age"), r, strict=True))[f] for f in fields] for r in SOURCE.get(key, [])]


@pytest.mark.parametrize("source", ["table", "function"])
def test_lookup_kinds(spark, source):
    keys = spark.createDataFrame([(300,), (200,), (100,)], "key int")
    if source == "table":
        src = TableSource(spark.createDataFrame([(k, n, a) for k, r in SOURCE.items() for n, a in r], "key int, name string, age int").coalesce(1), "key")
    else:
        src = function_source(fetch, {"name": "string", "age": "int"}, 2)
    e = Engine(spark, """a(key as int) | lookup name, years = age as long from s on key;
        b(key as int) | join kind=left-inner name, age from s on key; c(key as int) | join kind=left-outer name, age from s on key;""", {"s": src})
    assert sorted(rows(e.run("a", keys))) == [(100, "oak", 8), (200, None, None), (300, "fir", 1)]
    assert len(rows(e.run("b", keys))) == 5 and len(rows(e.run("c", keys))) == 6
    assert e.lookup("s", [500, 9], ["age", "name"]) == [{"age": 2, "name": "box"}, {"age": None, "name": None}]


def test_lookup_failures_and_nulls(spark):
    def ask(key, fields):
        if key == 2:
            raise ValueError("boom")
        return [[key * 10]]

    df = spark.createDataFrame([(1,), (2,), (None,)], "k int").coalesce(1)
    e = Engine(spark, "t(k as int) | join kind=left-inner v from f on k;", {"f": FetchSource(lambda: ask, {"v": "int"}, null_key_row=True)})
    got, errors = e.run_with_errors("t", df)
    assert sorted(((r.k, r.v) for r in got.collect()), key=str) == [(1, 10), (2, None), (None, None)]
    assert [r.message for r in errors.collect()] and "boom" in "".join(r.message for r in errors.collect())


def test_text_and_numbers_are_different_keys(spark):
    src = TableSource(spark.createDataFrame([("1", "x")], "k string, v string"), "k")
    e = Engine(spark, "t(k as int) | lookup v from s on k;", {"s": src})
    assert rows(e.run("t", spark.createDataFrame([(1,)], "k int"))) == [(1, None)]


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("C1,C2,C3\n1,AaA,BbB\n2,CcC,DdD\n3,EeE,FfF\n3,last,wins\n")
    (tmp_path / "t.json").write_text('[{"C1":1,"C2":"AaA","C3":"BbB"},{"C1":3,"C2":"EeE","C3":"FfF"}]')
    (tmp_path / "t.ndjson").write_text('{"C1":1,"C2":"AaA","C3":"BbB"}\n{"C1":3,"C2":"EeE","C3":"FfF"}\n')
    spark.createDataFrame([(1, "AaA", "BbB"), (3, "EeE", "FfF")], "C1 int, C2 string, C3 string").write.parquet(str(tmp_path / "t.parquet"))
    for name, third in (("t.csv", ("last", "wins")), ("t.json", ("EeE", "FfF")), ("t.ndjson", ("EeE", "FfF")), ("t.parquet", ("EeE", "FfF"))):
        cfg = '{"sources": [{"class": "local", "name": "s", "path": "%s", "keyColumn": "C1"}]}' % (tmp_path / name)
        e = Engine(spark, "t(k as long) | lookup C2, C3 from s on k;", cfg)
        got = {r[0]: r[1:] for r in rows(e.run("t", spark.createDataFrame([(1,), (3,), (9,)], "k long")))}
        assert got == {1: ("AaA", "BbB"), 3: third, 9: (None, None)}, name
    assert file_format("a.csv.gz") == "csv" and file_format("x", "Parquet") == "parquet"
    with pytest.raises(PipelineError):
        file_format("a.xls")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    db = sqlite3.connect(path)
    db.execute("create table crew(ship int, name text, age int)")
    db.executemany("insert into crew values (?, ?, ?)", [(1, "Mara", 50), (1, "Nilo", 19), (2, "Odd", 77)])
    db.commit()
    src = sqlite_source({"dbPath": path, "sqlTemplate": "select name, age from crew where ship = :key", "availableFields": ["name", "age"], "fieldTypes": {"age": "int"}})
    e = Engine(spark, "t(id as int) | join kind=left-inner name, age from s on id | summarize avg_age = avg(double(age)), names = array_agg(name) by id;", {"s": src})
    assert sorted(rows(e.run("t", spark.createDataFrame([(1,), (2,), (3,)], "id int")))) == [(34.5, ["Mara", "Nilo"], 1), (77.0, ["Odd"], 2)]


def test_http(monkeypatch):
    import io

    monkeypatch.setenv("TOKEN_X", "secret")
    seen = []

    class Response(io.BytesIO):
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

    def opener(request):
        seen.append((request.full_url, dict(request.header_items()), request.data))
        return Response(b'{"items": [{"id": 1, "n": "a"}, {"id": 2, "n": "b"}]}')

    src = http_source({"urlBase": "http://x", "keyUrlTemplate": "/l/$", "keyQueryParam": "q", "keyHeader": "K", "method": "post", "requestTemplate": {"k": [None]}, "keyPath": "$.k[0]", "auth": {"type": "bearer", "token": "${TOKEN_X}"}, "resultPath": {"id": "$.items[*].id", "n": "$..n"}}, opener=opener)
    assert src.client()(7, ["id", "n"]) == [[1, "a"], [2, "b"]]
    url, headers, body = seen[0]
    assert url == "http://x/l/7?q=7" and headers["Authorization"] == "Bearer secret" and headers["K"] == "7" and body == b'{"k": [7]}'
    assert json_path({"a": [{"b": 1}, {"b": 2}]}, "$.a[1:].b") == [2] and json_path({"a": 1}, "$['a']") == [1]


def test_feature_values():
    assert decode_feature(b"\x28\x05") == 5 and decode_feature(b"\x12\x02hi") == "hi" and decode_feature(b"\x08\x01") is True
    assert decode_feature(b"\x30" + b"\xff" * 9 + b"\x01") == -1 and decode_feature(b"\x1d\x00\x00\x80\x3f") == 1.0
    assert decode_feature(b"\x5a\x06\x0a\x01a\x0a\x01b") == ["a", "b"] and decode_feature(b"\x72\x04\x0a\x02\x01\x02") == [1, 2]
    with pytest.raises(ValueError):
        decode_feature(b"\x82\x01\x00")


def test_validation_and_errors(spark):
    e = Engine(spark, "t(a as int, b as string, c as bool) | project d = 10 / a;")
    data = [{"a": 2, "b": "x", "c": True}, {"a": 0, "b": 5, "c": None}, {"a": "7", "b": "z"}]
    lenient = e.process({"requests": [{"pipeline": "t", "data": data}]})["results"][0]
    assert lenient["status"] == "OK" and [r["d"] for r in lenient["data"]] == [5, None, 1] and [(x["row"], x["column"]) for x in lenient["errors"]] == [(1, "d")]
    strict = e.process({"requests": [{"pipeline": "t", "data": data, "validate": True}]})["results"][0]
    assert {(x["row"], x["column"]) for x in strict["errors"]} >= {(0, "a"), (2, "a")}
    assert e.process({"requests": [{"pipeline": "no", "data": []}]})["results"][0]["status"].startswith("ERROR")


def test_ignore_error_and_is_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "a int")
    e = Engine(spark, "t(a as int) | project b = 10 / a | ignore-error; u(a as int) | project b = 10 / a | project c = b is null, d = a is null;")
    assert rows(e.run("t", df)) == [(1, 10)]
    assert sorted(rows(e.run("u", df)), key=str) == [(0, None, None, False), (1, 10, False, False), (None, None, None, True)]


def test_process_types(spark):
    e = Engine(spark, "t(a) | project b = a + 42, c = a - 42; u(s, l) | project n = size(l), t = timestamp(s);")
    assert [(r["b"], r["c"]) for r in e.process({"requests": [{"pipeline": "t", "data": [{"a": 1}, {"a": 2}, {"a": 3}]}]})["results"][0]["data"]] == [(43, -41), (44, -40), (45, -39)]
    got = e.process({"requests": [{"pipeline": "u", "data": {"s": "2020-01-02 03:04:05", "l": [1, 2], "extra": 1}}]})["results"][0]
    assert got["data"] == [{"s": "2020-01-02 03:04:05", "l": [1, 2], "n": 2, "t": "2020-01-02 03:04:05"}]


def test_udf_and_dumps(spark, monkeypatch):
    def inverse(x):
        return 1 / x

    e = Engine(spark, "t(x as int) | project y = inverse(x);", '{"sources": []}', {"inverse": (inverse, "double")})
    got = e.process({"requests": [{"pipeline": "t", "data": [{"x": 2}, {"x": 0}]}]})["results"][0]
    assert [r["y"] for r in got["data"]] == [0.5, None] and "ZeroDivision" in got["errors"][0]["message"]
    with pytest.raises(PipelineError):
        e.register("inverse", inverse)
    with pytest.raises(PipelineError):
        e.register("abs", inverse)
    assert e.pipelines()["t"]["output"] == {"x": "int", "y": "double"} and e.health_check() and e.version()
    e.add_source("s", sqlite_source({"class": "sqlite", "dbPath": "x", "sqlTemplate": "", "availableFields": [], "password": "p", "token": "${T}"}))
    dump = e.lookup_sources()["s"]
    assert dump["password"] == "***" and dump["token"] == "${T}"


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(30)], "a long, b long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    out = Engine(spark, "t(a as long, b as long) | where (b == 1) | project c = a * 2;").run("t", stream)
    q = out.writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("streamed").count() == 10


def test_datetimes(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 2, 3),)], "t timestamp")
    got = rows(Engine(spark, 'q(t) | project later = t > "2020-01-01", s = string(t);').run("q", df))
    assert got == [(datetime(2020, 1, 2, 3), True, "2020-01-02 03:00:00")]


def test_registered_queries_have_their_columns(spark):
    """Every registered query compiles; its DuckDB text names the same columns."""
    import duckdb

    import __spark_entry__

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    oracle = __spark_entry__.oracle_sql()
    from sluice.queries import QUERIES

    for name, q in QUERIES.items():
        got = q(spark, d)
        if name in oracle:
            assert sorted(got.columns) == sorted(c[0] for c in con.execute(oracle[name] + " LIMIT 0" if "LIMIT" not in oracle[name] else oracle[name]).description), name
