"""Exact top-k by integer inner product: tiled matrix products, a partial selection per tile, a tree merge per query.

The stated queries are packed in blocks of rows and meet shards of packed candidate rows on a grid (block, shard), so
only packed blocks travel, never pairs of rows. Every tile keeps k rows a query; these lists merge by groups of shards
and then by query. Products run in float64 where the magnitudes prove them exact (below 2**53), else in int64, else in
Python integers.

Defined cases: a null vector, or one with a null or non-finite component, takes no part; vectors of another length than
the query's are no candidates of it; an empty table gives an empty result; repeated vec_ids stay separate rows, and a
query leaves out all rows that carry its own vec_id; scores beyond a long raise an error instead of wrapping. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, rank int, vec_id long, score long"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and double vector of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def pack(rows: int):
    """Packs Arrow rows (vec_id, v) to blocks (dim, n, ids, data) of one vector length each, with floor(256 * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int, got: list) -> pa.RecordBatch:
            ids = np.concatenate([g[0] for g in got])
            data = np.concatenate([g[1] for g in got])
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

        for b in batches:
            ids, v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
            lens = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            flat = np.floor(flat * 256)
            starts = np.concatenate([[0], np.cumsum(lens)])
            for dim in np.unique(lens):
                at = np.flatnonzero(lens == dim)
                m = flat[(starts[at][:, None] + np.arange(dim)[None, :]).ravel()].reshape(len(at), int(dim))
                for i in range(0, len(at), rows):
                    got = waiting.setdefault(int(dim), [])
                    got.append((ids[at[i : i + rows]], m[i : i + rows]))
                    if sum(len(g[0]) for g in got) >= rows:
                        yield block(int(dim), waiting.pop(int(dim)))
        for dim, got in waiting.items():
            yield block(dim, got)

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one row: score descending, then id ascending."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows that hold whole numbers."""
    top = lambda m: float(np.abs(m).max(initial=0))
    bound = top(q) * top(c) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**63 and top(q) < 2**62 and top(c) < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    s = whole(q) @ whole(c).T
    if any(abs(x) >= 2**63 for row in s for x in row):
        raise OverflowError("an inner product exceeds a long")
    return s.astype(np.int64)


def tile_topk(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["q_dim"] != r["dim"]:
                    continue
                qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["q_data"], np.float64).reshape(len(qi), r["dim"])
                c = np.frombuffer(r["data"], np.float64).reshape(len(ci), r["dim"])
                out = ([], [], [], [])
                for at in range(0, len(qi), 256):
                    s = products(q[at : at + 256], c)
                    for i, row in enumerate(s):
                        own = int(qi[at + i])
                        keep = np.flatnonzero(ci != own)
                        top = keep[best(row[keep], ci[keep], k)]
                        for col, vals in zip(out, ([own] * len(top), [r["shard"]] * len(top), ci[top].tolist(), row[top].tolist()), strict=True):
                            col.extend(vals)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "shard", "vec_id", "score"])

    return run


def merge_topk(partial: DataFrame, k: int, fan_in: int = 64) -> DataFrame:
    """Tree merge of per-tile lists: groups of fan_in shards first, then whole queries."""
    order = [F.desc("score"), F.asc("vec_id")]
    first = Window.partitionBy("query_id", F.floor(F.col("shard") / fan_in)).orderBy(*order)
    last = Window.partitionBy("query_id").orderBy(*order)
    cut = partial.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return cut.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def exact_topk(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", query_rows: int = 1024, shard_rows: int = 8192, blocks: int = 16) -> DataFrame:
    """k highest integer products of each query row with all rows of df.

    query_rows, shard_rows: the size of a tile; blocks: query blocks of a cell.
    """
    packed = "dim int, n int, ids binary, data binary"
    q = valid_vectors(queries, id_col, vec_col).mapInArrow(pack(query_rows), packed)
    c = valid_vectors(df, id_col, vec_col).mapInArrow(pack(shard_rows), packed)
    # a grid of cells: about one shard and `blocks` query blocks meet in each, whatever the sizes of the tables
    lanes, groups = max(1, -(-df.count() // shard_rows)), max(1, -(-queries.count() // (query_rows * blocks)))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = c.select("dim", "ids", "data", F.monotonically_increasing_id().alias("shard"), dealt(lanes).alias("lane")).withColumn("group", every(groups))
    q = q.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), dealt(groups).alias("group")).withColumn("lane", every(lanes))
    tiles = q.join(c, ["lane", "group"]).select("q_dim", "q_ids", "q_data", "dim", "ids", "data", "shard")
    partial = tiles.mapInArrow(tile_topk(k), "query_id long, shard long, vec_id long, score long")
    return merge_topk(partial, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
