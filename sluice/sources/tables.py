"""Lookup sources that are tables: joined on their key, in any size; Catalyst picks the join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import types as L
from ..plans.syntax import PipelineError

SUFFIXES = {".csv": "csv", ".csv.gz": "csv", ".parquet": "parquet", ".json": "json", ".json.gz": "json", ".ndjson": "ndjson", ".ndjson.gz": "ndjson"}


class TableSource:
    """Rows of a DataFrame by a key column.

    last_wins: of rows with one key only the last counts (local files); else a lookup takes the first and a join all.
    null_key_row: a null key answers one row of nulls, which keeps the row in an inner join.
    """

    def __init__(self, df: DataFrame, key: str, last_wins: bool = False, null_key_row: bool = False, info: dict | None = None):
        if key not in df.columns:
            raise PipelineError(f"no key column {key}")
        self.df, self.key, self.last_wins, self.null_key_row, self.info = df, key, last_wins, null_key_row, info or {}

    def rows(self, keys: DataFrame, key_type, fields: list[str], first: bool) -> DataFrame | None:
        t = self.df.schema[self.key].dataType
        same = L.is_numeric(t) and L.is_numeric(key_type) or t == key_type or L.is_time(t) and L.is_time(key_type)
        if not same:
            return None  # text never equals a number
        for f in fields:
            if f not in self.df.columns:
                raise PipelineError(f"the source has no field {f}")
        values = [F.col(f"`{f}`").alias(f"__f_{f}") for f in dict.fromkeys(fields)]
        out = self.df.select(F.col(f"`{self.key}`").alias("__fk"), *values, F.monotonically_increasing_id().alias("__seq")).where("__fk is not null")
        if first or self.last_wins:
            pick = F.max_by if self.last_wins else F.min_by
            names = [f"__f_{f}" for f in dict.fromkeys(fields)]
            out = out.groupBy("__fk").agg(pick(F.struct(*names, "__seq"), "__seq").alias("r")).select("__fk", "r.*")
        return out.withColumns({"__hit": F.lit(1), "__ferr": F.lit(None).cast("string")})


def file_format(path: str, given: str = "auto") -> str:
    if given.lower() != "auto":
        return given.lower()
    for suffix, fmt in SUFFIXES.items():
        if path.lower().endswith(suffix):
            return fmt
    raise PipelineError(f"no known format of {path}")


def read_file(spark: SparkSession, path: str, fmt: str = "auto", options: dict | None = None) -> DataFrame:
    """CSV with a header, Parquet, a JSON array, or JSON lines; paths are whatever Spark reads, cloud stores too.

    Options go to the reader, which hands fs.* settings (keys of a cloud store) on to the file system's configuration.
    """
    reader = spark.read.options(**(options or {}))
    match file_format(path, fmt):
        case "csv":
            return reader.option("header", True).option("inferSchema", True).csv(path)
        case "parquet":
            return reader.parquet(path)
        case "json":
            return reader.option("multiLine", True).json(path)
        case "ndjson":
            return reader.json(path)
        case other:
            raise PipelineError(f"unknown format {other}")


def file_source(spark: SparkSession, cfg: dict) -> TableSource:
    df = read_file(spark, cfg["path"], cfg.get("format", "auto"), cfg.get("cloudConfig"))
    if cfg.get("fields"):
        df = df.select(cfg["keyColumn"], *(f for f in cfg["fields"] if f != cfg["keyColumn"]))
    return TableSource(df, cfg["keyColumn"], last_wins=True, info=cfg)
