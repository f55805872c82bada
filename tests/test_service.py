import json
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from sluice.engine import Engine
from sluice.plans.syntax import PipelineError
from sluice.service import Service, load_text
from sluice.sources.fetch import function_source
from sluice.streaming.runner import is_stateless, run_stream


def call(port, path, body=None):
    with urlopen(Request(f"http://127.0.0.1:{port}{path}", data=None if body is None else json.dumps(body).encode())) as r:
        return json.loads(r.read())


def test_service(spark, tmp_path):
    (tmp_path / "p.txt").write_text("t(x) | project y = x + 42;")
    engine = Engine(spark, load_text(str(tmp_path / "p.txt")), {"s": function_source(lambda key, fields: [[key * 2]], {"v": "long"})})
    service = Service(engine, port=0)
    service.start()
    try:
        assert call(service.port, "/process", {"requests": [{"pipeline": "t", "data": {"x": 57}}]})["results"][0]["data"] == [{"x": 57, "y": 99}]
        assert call(service.port, "/lookup", {"source": "s", "keys": [4], "features": ["v"]}) == [{"v": 8}]
        assert call(service.port, "/healthz") == {"status": "OK"} and "t" in call(service.port, "/pipelines") and call(service.port, "/version")["version"]
        assert "s" in call(service.port, "/lookup-sources")
        with pytest.raises(HTTPError):
            call(service.port, "/nope")
        with pytest.raises(HTTPError):
            call(service.port, "/lookup", {"source": "none", "keys": [], "features": []})
    finally:
        service.stop()


def test_stateful_stream(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(30)], "a long, b long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long").parquet(str(tmp_path / "in"))
    e = Engine(spark, "t(a as long, b as long) | summarize n = count(), s = sum(a) by b; u(a as long, b as long) | top 3 by a; v(a as long, b as long) | where (a > 1);")
    with pytest.raises(PipelineError):
        run_stream(e, "u", stream)
    assert is_stateless(e.pipeline("v")) and not is_stateless(e.pipeline("t"))
    spark.sql("drop view if exists counted")
    q = run_stream(e, "t", stream).writeStream.format("memory").outputMode("complete").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("counted").collect()) == [(10, 135, 0), (10, 145, 1), (10, 155, 2)]
