"""Helpers shared by the training-data operators: scratch tables, word splitting and vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
U = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def no_gc() -> Iterator[None]:
    """Switches the cycle collector off, for loops that make many small objects and no cycles, and back as it was."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def paused(run):
    """The generator function with the cycle collector off while it runs."""

    def wrapped(batches):
        with no_gc():
            yield from run(batches)

    return wrapped


@functools.cache
def local_folder() -> str:
    """One folder of this machine, for sessions without a cluster."""
    return "file://" + tempfile.mkdtemp(prefix="sluice-")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the session's process ends.

    Only local masters may leave that setting unset (tests); they get a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = local_folder()
    folder = f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}"
    atexit.register(forget, folder)
    return folder


def forget(folder: str) -> None:
    """Deletes a scratch folder while there is a session to do it."""
    if SparkContext._active_spark_context is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            delete(SparkSession.active(), folder)


def delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and rereads it, which cuts the lineage.

    The shuffle files of the write go as soon as it is done; the table stands in for them.
    """
    spark, path = df.sparkSession, f"{folder}/{name}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables that materialise() wrote and that no later plan reads."""
    for name in names:
        delete(spark, f"{folder}/{name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from those taken, whatever their case."""
    prefix, low = "__", {t.lower() for t in taken}
    while any((prefix + n).lower() in low for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def doc_texts(documents: DataFrame) -> DataFrame:
    """doc_id and whole text; a null text counts as empty, other columns are dropped."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def split_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8. bytes.split() breaks at exactly those six bytes."""
    return text.encode("utf-8", "surrogatepass").split()


_xx = xxhash.xxh3_64_intdigest


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_xx, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply), vectorised."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(32))
        x = x * U(0xD6E8FEB86659FD93)
        x = x ^ (x >> U(32))
        x = x * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all n-grams of h (position i covers h[i:i+n]), by doubling: log2(n) passes."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        cur, size = mix(h + U((seed * 0x9E3779B97F4A7C15 + 1) & MASK64)), 1
        done = None  # the hash of the first `covered` words of each gram
        covered, left = 0, n
        total = len(h) - n + 1
        while left:
            if left & 1:
                part = cur[covered : covered + total]
                done = part if done is None else mix(done * U(0x9E3779B97F4A7C15) + part)
                covered += size
            left >>= 1
            if left:
                cur = mix(cur[:-size] * U(0xC2B2AE3D27D4EB4F) + cur[size:])
                size *= 2
    return done
