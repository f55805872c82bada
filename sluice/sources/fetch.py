"""Lookup sources that are asked key by key: distinct keys are fetched once in parallel on the executors and joined back.

A client is any picklable factory of a function (key, fields) -> rows, each row a list in the order of fields. One client
is made for each task, `concurrency` keys are asked at once, and a failed key is an error cell, not a failed job. Keys that
repeat cost one request; results equal those of asking row by row if the source is stable.
"""

from __future__ import annotations

import asyncio
import base64
import inspect
import json
import re
import sqlite3
import struct
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..plans.syntax import PipelineError
from ..plans.types import NAMED
from .config import secret


class FetchSource:
    def __init__(self, client: Callable[[], Callable], types: dict[str, str], concurrency: int = 1, null_key_row: bool = False, info: dict | None = None):
        self.client, self.types, self.concurrency, self.null_key_row, self.info = client, types, max(1, concurrency), null_key_row, info or {}

    def rows(self, keys: DataFrame, key_type, fields: list[str], first: bool) -> DataFrame:
        for f in fields:
            if f not in self.types:
                raise PipelineError(f"the source has no field {f}")
        fields = list(dict.fromkeys(fields))
        client, concurrency = self.client, self.concurrency
        kinds = [NAMED.get(self.types[f]) or T.DataType.fromDDL(self.types[f]) for f in fields]
        schema = T.StructType([T.StructField("__fk", key_type), *(T.StructField(f"__f_{f}", k) for f, k in zip(fields, kinds, strict=True)), T.StructField("__seq", T.LongType()), T.StructField("__hit", T.IntegerType()), T.StructField("__ferr", T.StringType())])
        names = [f.name for f in schema.fields]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask = client()

            def one(key):
                try:
                    got = ask(key.item() if hasattr(key, "item") else key, fields)
                    got = asyncio.run(got) if inspect.isawaitable(got) else got
                    return [[key, *(fit(v, k) for v, k in zip(r, kinds, strict=True)), i, 1, None] for i, r in enumerate(got[:1] if first else got)]
                except Exception as e:  # one key's failure is this key's error cell
                    return [[key, *[None] * len(fields), 0, None, f"lookup failed: {e}"[:500]]]

            with ThreadPoolExecutor(concurrency) as pool:
                for pdf in batches:
                    rows = [r for rs in pool.map(one, pdf["__k"].tolist()) for r in rs]
                    yield pd.DataFrame(rows, columns=names, dtype=object)

        return keys.distinct().mapInPandas(run, schema)


def fit(v, kind):
    """A fetched value in the declared type."""
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else json.dumps(v) if isinstance(v, (list, dict, bool)) else str(v)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return int(v)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(v)
    return v


def function_source(function: Callable, types: dict[str, str], concurrency: int = 1) -> FetchSource:
    """A user function (key, fields) -> rows, plain or async."""
    return FetchSource(lambda: function, types, concurrency)


def sqlite_source(cfg: dict) -> FetchSource:
    """sqlTemplate with :key; the columns of its result are availableFields in order."""
    path, sql, available = secret(cfg["dbPath"]), cfg["sqlTemplate"], cfg["availableFields"]

    def client():
        db = sqlite3.connect(path, check_same_thread=False)

        def ask(key, fields):
            out = []
            for row in db.execute(sql, {"key": key} if ":key" in sql else ()).fetchall():
                if any(isinstance(v, bytes) for v in row):
                    raise ValueError("blobs are not supported")
                out.append([row[available.index(f)] for f in fields])
            return out

        return ask

    types = cfg.get("fieldTypes") or dict.fromkeys(available, "string")
    return FetchSource(client, {f: types.get(f, "string") for f in available}, 1, null_key_row=True, info=cfg)


# ---- HTTP ----

STEP = re.compile(r"\.\.|\.?\*|\.?([A-Za-z_][\w-]*)|\[(?:'([^']*)'|\"([^\"]*)\"|(-?\d+)|(\*)|(-?\d*):(-?\d*))\]|\.")


def json_path(value, path: str) -> list:
    """All matches of a JSON path: children, indexes, slices, wildcards and recursive descent."""
    got, at, deep = [value], 1 if path.startswith("$") else 0, False
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path {path}")
        at, step = m.end(), m[0]
        if step == "..":
            deep = True
            continue
        if step == ".":
            continue
        if deep:
            got, deep = [d for v in got for d in descend(v)], False
        name = m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]
        if step in ("*", ".*") or m[5]:
            got = [c for v in got for c in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        elif name is not None:
            got = [v[name] for v in got if isinstance(v, dict) and name in v]
        elif m[4] is not None:
            got = [v[int(m[4])] for v in got if isinstance(v, list) and -len(v) <= int(m[4]) < len(v)]
        else:
            got = [c for v in got if isinstance(v, list) for c in v[int(m[6]) if m[6] else None : int(m[7]) if m[7] else None]]
    return got


def descend(v) -> Iterator:
    yield v
    for c in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        yield from descend(c)


def replaced(value, path: str, key):
    """A copy of a request body with the key at a plain path of names and indexes."""
    steps = [m[1] or m[2] or m[3] or int(m[4]) for m in STEP.finditer(path.removeprefix("$")) if m[0] != "."]
    out = json.loads(json.dumps(value))
    if not steps:
        return key
    at = out
    for s in steps[:-1]:
        at = at[s]
    at[steps[-1]] = key
    return out


def auth_headers(auth: dict | None, token: Callable[[str], str] | None) -> dict[str, str]:
    match (auth or {}).get("type", "none").lower():
        case "none":
            return {}
        case "basic":
            pair = f"{secret(auth['username'])}:{secret(auth.get('password') or '')}"
            return {"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()}
        case "header":
            return {secret(auth["key"]): secret(auth.get("value") or "")}
        case "bearer":
            return {"Authorization": f"Bearer {secret(auth['token'])}"}
        case "aad":
            if token is None:
                raise PipelineError("this authentication needs a token function")
            return {"Authorization": f"Bearer {token(secret(auth['resource']))}"}
        case other:
            raise PipelineError(f"unknown authentication {other}")


def http_source(cfg: dict, token: Callable[[str], str] | None = None, opener: Callable | None = None) -> FetchSource:
    """The key goes into the URL ($), a header, a query parameter or the body; fields come out by JSON path.

    A request that takes longer than cfg["timeout"] seconds (30) is an error cell.
    """
    paths = cfg["resultPath"]
    base = secret(cfg["urlBase"])
    fixed = {k: secret(v) for k, v in (cfg.get("additionalHeaders") or {}).items()} | auth_headers(cfg.get("auth"), token)
    query = {k: secret(v) for k, v in (cfg.get("additionalQueryParams") or {}).items()}
    timeout = float(cfg.get("timeout") or 30)

    def client():
        def ask(key, fields):
            text = str(key).lower() if isinstance(key, bool) else str(key)
            url = base + (cfg["keyUrlTemplate"].replace("$", text) if cfg.get("keyUrlTemplate") else "")
            params = ({cfg["keyQueryParam"]: text} if cfg.get("keyQueryParam") else {}) | query
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(params) if params else ""
            headers = fixed | ({cfg["keyHeader"]: text} if cfg.get("keyHeader") else {})
            body = None
            if cfg.get("requestTemplate") is not None:
                filled = replaced(cfg["requestTemplate"], cfg["keyPath"], key) if cfg.get("keyPath") else cfg["requestTemplate"]
                body, headers = json.dumps(filled).encode(), headers | {"Content-Type": "application/json"}
            request = urllib.request.Request(url, data=body, headers=headers, method=(cfg.get("method") or "GET").upper())
            with opener(request) if opener else urllib.request.urlopen(request, timeout=timeout) as response:
                got = json.loads(response.read())
            columns = [json_path(got, paths[f]) for f in fields]
            return [[c[i] if i < len(c) else None for c in columns] for i in range(len(columns[0]))]

        return ask

    types = cfg.get("fieldTypes") or {}
    return FetchSource(client, {f: types.get(f, "string") for f in paths}, int(cfg.get("concurrency") or 1), info=cfg)


# ---- clients that the user brings ----


def client_source(cfg: dict, clients: dict[str, Callable], kind: str) -> FetchSource:
    """SQL Server, document stores and Redis: the user gives a factory (config) -> (key, fields) -> rows for the class."""
    if kind not in clients:
        raise PipelineError(f"a source of class {cfg['class']} needs a client: pass clients={{{kind!r}: factory}}")
    factory, clean = clients[kind], {k: secret(v) if isinstance(v, str) else v for k, v in cfg.items()}
    types = dict.fromkeys(cfg.get("availableFields") or (), "string") | (cfg.get("fieldTypes") or {})
    return FetchSource(lambda: factory(clean), types, int(cfg.get("concurrency") or 1), null_key_row=kind == "mssql", info=cfg)


def dbapi_client(connect: Callable[[dict], object], marker: str = "?") -> Callable:
    """A client for client_source over a DB-API driver: connect(config) opens one connection for each task.

    sqlTemplate names the key as @P1, which becomes the driver's marker; availableFields are the result's columns in order.
    """

    def factory(cfg: dict) -> Callable:
        db, sql, available = connect(cfg), cfg["sqlTemplate"], list(cfg["availableFields"])
        keys = sql.count("@P1")
        sql = sql.replace("@P1", marker)

        def ask(key, fields):
            cursor = db.cursor()
            try:
                cursor.execute(sql, (key,) * keys)
                return [[row[available.index(f)] for f in fields] for row in cursor.fetchall()]
            finally:
                cursor.close()

        return ask

    return factory


def document_client(pages: Callable[[dict, str, dict], tuple[list[dict], str | None]]) -> Callable:
    """A client for client_source over a document store: pages(config, query, {"@key": key, "continuation": mark}) gives
    (documents, next mark or None) and is asked until there is no next mark; fields are paths like a.b within a document.
    """

    def factory(cfg: dict) -> Callable:
        def field(document, path: str):
            for name in path.split("."):
                document = document.get(name) if isinstance(document, dict) else None
            return document

        def ask(key, fields):
            out, mark = [], None
            while True:
                documents, mark = pages(cfg, cfg["query"], {"@key": key, "continuation": mark})
                out += [[field(d, f) for f in fields] for d in documents]
                if mark is None:
                    return out

        return ask

    return factory


def redis_features(hmget: Callable[[str, list[str]], list]) -> Callable:
    """(key, fields) -> rows over an HMGET function whose values are base64 of an encoded feature value."""
    return lambda key, fields: [[None if v is None else decode_feature(base64.b64decode(v)) for v in hmget(str(key), fields)]]


#: Fixed values of the wire format: field number to kind.
SCALARS = {1: "bool", 2: "string", 3: "float", 4: "double", 5: "int", 6: "long"}
ARRAYS = {10: "bool", 11: "string", 12: "float", 13: "double", 14: "int", 15: "long"}


def wire(data: bytes) -> Iterator[tuple[int, int, object]]:
    """(field, wire type, raw value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            at += n
            yield tag >> 3, kind, data[at - n : at]


def scalar(kind: str, wire_type: int, raw) -> list:
    """The values of one field; packed ones give several."""
    if kind == "string":
        return [raw.decode()]
    if kind in ("float", "double"):
        size = 4 if kind == "float" else 8
        return [v for (v,) in struct.iter_unpack("<f" if size == 4 else "<d", raw)]
    ints = [raw] if wire_type == 0 else packed(raw)
    return [bool(v) for v in ints] if kind == "bool" else [v - (1 << 64) if v >= 1 << 63 else v for v in ints]


def packed(raw: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in raw:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    return out


def decode_feature(data: bytes):
    """Scalars and dense arrays; other kinds are refused."""
    out = None
    for number, kind, raw in wire(data):
        if number in SCALARS:
            out = scalar(SCALARS[number], kind, raw)[-1]
        elif number in ARRAYS:
            out = [v for _, w, r in wire(raw) for v in scalar(ARRAYS[number], w, r)]
        else:
            raise ValueError(f"feature values of kind {number} are not supported")
    return out
