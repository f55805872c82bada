"""Source definitions in JSON: {"sources": [{"class": ..., "name": ..., ...}]}."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..plans.syntax import PipelineError

#: Keys whose values a dump masks unless they are references to the environment.
SECRET_KEYS = re.compile(r"(?i)password|token|secret|connectionstring|apikey|accountkey|value$")


def secret(value: str) -> str:
    """A value that is exactly ${NAME} is read from the environment, on the driver."""
    m = re.fullmatch(r"\$\{([^}]+)\}", value)
    if not m:
        return value
    if m[1] not in os.environ:
        raise PipelineError(f"the environment variable {m[1]} is not set")
    return os.environ[m[1]]


def masked(value, key: str = ""):
    if isinstance(value, dict):
        return {k: masked(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [masked(v, key) for v in value]
    literal = isinstance(value, str) and not re.fullmatch(r"\$\{[^}]+\}", value)
    return "***" if literal and SECRET_KEYS.search(key) else value


def source_kind(name: str) -> str:
    """The implementation behind a class name; spellings with the suffix Source or a vendor's prefix count too."""
    low = name.lower()
    for kind, pattern in (("local", r"local(store)?"), ("sqlite", r"sqlite(source)?"), ("mssql", r"mssql(source)?"), ("http", r"http(jsonapi(source)?)?"), ("redis", r".*redis(source)?"), ("cosmosdb", r"cosmos(db)?(source)?")):
        if re.fullmatch(pattern, low):
            return kind
    raise PipelineError(f"unknown source class {name}")


def load_sources(spark: SparkSession, text: str, clients: dict[str, Callable] | None = None, token: Callable[[str], str] | None = None) -> dict:
    """Name to source. clients: factories for the classes that need a driver of their own; see fetch.client_source."""
    from . import fetch, tables

    out = {}
    for cfg in json.loads(text).get("sources", []):
        kind = source_kind(cfg["class"])
        if kind == "local":
            out[cfg["name"]] = tables.file_source(spark, cfg)
        elif kind == "sqlite":
            out[cfg["name"]] = fetch.sqlite_source(cfg)
        elif kind == "http":
            out[cfg["name"]] = fetch.http_source(cfg, token)
        else:
            out[cfg["name"]] = fetch.client_source(cfg, clients or {}, kind)
    return out
