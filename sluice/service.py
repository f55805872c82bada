"""A thin HTTP service over an Engine: POST /process and /lookup, GET /pipelines, /lookup-sources, /healthz, /version and
/metrics (Prometheus text).

`python -m sluice.service -p pipelines.txt -l lookups.json --address 127.0.0.1 --port 8000`; -p and -l are files or http(s)
addresses. --enable-managed-identity takes tokens of the machine's identity, for sources with that authentication and for
definitions in a blob store; -j logs each request as one JSON line.
"""

from __future__ import annotations

import argparse
import json
import sys
import threading
import time
from collections import Counter
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from .engine import Engine

TIMEOUT = 30.0
#: The public address and version of the identity service of cloud machines, and the header of blob stores.
IDENTITY = "http://169.254.169.254/metadata/identity/oauth2/token"
IDENTITY_VERSION, BLOB_VERSION = "2018-02-01", "2021-08-06"
BLOBS = "https://storage.azure.com/"


def managed_identity(resource: str, address: str = IDENTITY) -> str:
    """A token of the machine's identity for a resource."""
    request = Request(f"{address}?{urlencode({'api-version': IDENTITY_VERSION, 'resource': resource})}", headers={"Metadata": "true"})
    with urlopen(request, timeout=TIMEOUT) as r:
        return json.loads(r.read())["access_token"]


def load_text(place: str, token: Callable[[str], str] | None = None) -> str:
    """A definition from a local file or an http(s) address; blob stores are asked with a token, if there is one."""
    if place.startswith(("http://", "https://")):
        headers = {"Authorization": f"Bearer {token(BLOBS)}", "x-ms-version": BLOB_VERSION} if token and ".blob." in place else {}
        with urlopen(Request(place, headers=headers), timeout=TIMEOUT) as r:
            return r.read().decode()
    return Path(place).read_text()


class Metrics:
    """Counts and seconds of requests by path and status."""

    def __init__(self):
        self.lock, self.count, self.seconds = threading.Lock(), Counter(), Counter()

    def add(self, path: str, status: int, seconds: float) -> None:
        with self.lock:
            self.count[path, status] += 1
            self.seconds[path, status] += seconds

    def text(self) -> str:
        with self.lock:
            lines = ["# TYPE sluice_requests_total counter"] + [f'sluice_requests_total{{path="{p}",status="{s}"}} {n}' for (p, s), n in sorted(self.count.items())]
            return "\n".join(lines + ["# TYPE sluice_request_seconds_total counter"] + [f'sluice_request_seconds_total{{path="{p}",status="{s}"}} {n:.6f}' for (p, s), n in sorted(self.seconds.items())]) + "\n"


class Service:
    def __init__(self, engine: Engine, address: str = "127.0.0.1", port: int = 8000, json_log: bool = False):
        self.engine, self.metrics = engine, Metrics()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, status: int, body) -> None:
                seconds = time.perf_counter() - self.began
                outer.metrics.add(self.path if status != 404 else "other", status, seconds)
                if json_log:
                    print(json.dumps({"time": time.time(), "method": self.command, "path": self.path, "status": status, "ms": round(seconds * 1000, 3)}), file=sys.stderr, flush=True)
                data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "text/plain; version=0.0.4" if isinstance(body, str) else "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def answer(self, routes: dict) -> None:
                if self.path not in routes:
                    return self.reply(404, {"error": f"no {self.path}"})
                try:
                    self.reply(200, routes[self.path]())
                except Exception as e:
                    self.reply(400, {"error": str(e)})

            def do_GET(self) -> None:
                self.began = time.perf_counter()
                e = outer.engine
                self.answer({"/pipelines": e.pipelines, "/lookup-sources": e.lookup_sources, "/version": lambda: {"version": e.version()}, "/healthz": lambda: {"status": "OK" if e.health_check() else "ERROR"}, "/metrics": outer.metrics.text})

            def do_POST(self) -> None:
                self.began = time.perf_counter()
                try:
                    body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                except ValueError as e:
                    return self.reply(400, {"error": f"no JSON: {e}"})
                self.answer({"/process": lambda: outer.engine.process(body), "/lookup": lambda: outer.engine.lookup(body["source"], body["keys"], body["features"])})

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((address, port), Handler)
        self.port = self.server.server_address[1]

    def start(self) -> None:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def main() -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-p", "--pipeline", required=True)
    p.add_argument("-l", "--lookup")
    p.add_argument("--address", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--enable-managed-identity", action="store_true")
    p.add_argument("-j", "--json-log", action="store_true")
    a = p.parse_args()
    token = managed_identity if a.enable_managed_identity else None
    spark = SparkSession.builder.appName("sluice").getOrCreate()
    engine = Engine(spark, load_text(a.pipeline, token), load_text(a.lookup, token) if a.lookup else None, token=token)
    service = Service(engine, a.address, a.port, a.json_log)
    service.server.serve_forever()


if __name__ == "__main__":
    main()
