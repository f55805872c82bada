"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto disjoint groups of random orthogonal directions; each group, with its own shift, gives one
Hilbert ordering. Every curve is cut into ranges of equal share (splitters from a bounded sample), Spark partitions the
rows by (curve, range), and a query meets the rows of its own and the neighbouring ranges. Each meeting reranks by exact
cosine and keeps k rows; the lists of all curves merge to the final k.

Fit: means, deviations and splitters come from at most `sample_rows` rows chosen by a hash of vec_id; every row is
indexed. The window is `window` of all rows on each curve, which holds recall at every size, also on vectors without
any structure. Work is thus queries x rows x window x curves; a smaller window makes it cheaper where vectors cluster.

Repeated rows (equal vec_id and vector) count once, and of equal vectors the ids beyond the first k + 1 (by vec_id) can't
be among a query's k nearest, so they are left out before the index; this is exact and frees the ranges of hot vectors.
Of an id with several vectors the nearest counts; a range keeps k distinct ids.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; only vectors of
one length are compared; an empty table gives an empty result; a query leaves out rows with its own vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exact_topk import merge_topk, valid_vectors
from .hilbert import hilbert_keys

BITS, DIMS = 10, 3


def directions(dim: int, curves: int, seed: int) -> np.ndarray:
    """[dim, curves * 3] columns: orthogonal within each turn of `dim` of them."""
    rng = np.random.default_rng([seed, dim])
    need, cols = curves * DIMS, []
    while need > 0:
        q = np.linalg.qr(rng.normal(size=(dim, min(dim, need))))[0]
        cols.append(q[:, :need])
        need -= cols[-1].shape[1]
    return np.concatenate(cols, axis=1)


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def matrices(batch: pa.RecordBatch, col: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in a batch."""
    v = batch.column(col)
    lens = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    for dim in np.unique(lens):
        at = np.flatnonzero(lens == dim)
        yield at, flat[(starts[at][:, None] + np.arange(dim)[None, :]).ravel()].reshape(len(at), int(dim))


def project(curves: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, m in matrices(b, 1):
                p = unit(m) @ directions(m.shape[1], curves, seed)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([m.shape[1]] * len(at), pa.int32()), "p": pa.array(p.tolist(), pa.list_(pa.float64()))})

    return run


class Fit:
    """Mean, deviation and splitters by curve, for each vector length; a bounded size: lengths seen x curves x tiles."""

    def __init__(self, curves: int, seed: int, tiles: int):
        self.curves, self.seed, self.tiles = curves, seed, tiles
        self.by_dim: dict[int, tuple] = {}

    def learn(self, dim: int, p: np.ndarray) -> None:
        self.by_dim[dim] = (p.mean(axis=0), np.maximum(p.std(axis=0), 1e-12), None)
        keys = self.keys(dim, p)
        cuts = [np.quantile(np.sort(k).astype(np.float64), np.arange(1, self.tiles) / self.tiles) for k in keys]
        self.by_dim[dim] = (*self.by_dim[dim][:2], cuts)

    def keys(self, dim: int, p: np.ndarray) -> list[np.ndarray]:
        mean, std, _ = self.by_dim[dim]
        z = (p - mean) / std
        u = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))  # near the normal distribution function
        shift = np.random.default_rng(self.seed).random(p.shape[1]) * 0.2
        cells = np.clip(((u * 0.8 + shift) * 2**BITS).astype(np.int64), 0, 2**BITS - 1)
        return [hilbert_keys(cells[:, c * DIMS : (c + 1) * DIMS], BITS) for c in range(self.curves)]

    def ranges(self, m: np.ndarray) -> np.ndarray:
        """[curves, rows] range numbers; all 0 for a length that the sample doesn't hold."""
        dim = m.shape[1]
        if dim not in self.by_dim:
            return np.zeros((self.curves, len(m)), dtype=np.int64)
        keys = self.keys(dim, unit(m) @ directions(dim, self.curves, self.seed))
        return np.array([np.searchsorted(c, k.astype(np.float64), side="right") for k, c in zip(keys, self.by_dim[dim][2], strict=True)])


def assign(fit: Fit, reach: int, query: bool):
    """One row for each curve (and, for queries, each range within reach): dim, curve, tile, kind, vec_id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for at, m in matrices(b, 1):
                tiles = fit.ranges(m)
                known = m.shape[1] in fit.by_dim
                vecs = b.column(1).take(pa.array(at))
                own = ids.take(pa.array(at))
                for c in range(fit.curves if known else 1):
                    for step in range(-reach, reach + 1) if query and known else (0,):
                        t = tiles[c] + step
                        on = np.flatnonzero((t >= 0) & (t < max(1, fit.tiles)))
                        n = len(on)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m.shape[1], np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(t[on].astype(np.int32)), pa.array(np.full(n, int(query), np.int32)), own.take(pa.array(on)), vecs.take(pa.array(on))], ["dim", "curve", "tile", "kind", "vec_id", "v"])

    return run


def rerank(k: int):
    """The k nearest ids of each query in one range, by exact cosine."""

    def run(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()
        out: tuple[list, ...] = ([], [], [], [])
        if b:
            kind, ids, curve = b[0].column("kind").to_numpy(), b[0].column("vec_id").to_numpy(), b[0].column("curve")[0].as_py()
            m = unit(next(matrices(b[0], b[0].schema.get_field_index("v")))[1])
            qi, ci = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
            for at in range(0, len(qi), 256) if len(ci) else ():
                q = m[qi[at : at + 256]]
                s = q @ m[ci].T
                for i, row in enumerate(s):
                    me = ids[qi[at + i]]
                    row[ids[ci] == me] = -np.inf
                    take = min(len(row), k + 16)
                    while True:
                        near = np.argpartition(-row, take - 1)[:take]
                        near = np.flatnonzero(row >= row[near].min() - 1e-12) if take < len(row) else near
                        near = near[row[near] > -np.inf]
                        if take == len(row) or len(set(ids[ci[near]].tolist())) >= k:
                            break
                        take = min(len(row), 4 * take)  # some ids have several vectors here
                    exact = (m[ci[near]] * q[i]).sum(axis=1)  # one order of summation, so equal vectors tie exactly
                    near = near[np.lexsort((ids[ci[near]], -exact))]
                    top = near[np.sort(np.unique(ids[ci[near]], return_index=True)[1])[:k]]
                    exact = (m[ci[top]] * q[i]).sum(axis=1)
                    for col, x in zip(out, ([me] * len(top), [curve] * len(top), ids[ci[top]].tolist(), exact.tolist()), strict=True):
                        col.extend(x)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "shard": pa.array(out[1], pa.int64()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    return run


def curve_neighbours(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", curves: int = 14, window: float = 0.14, tile_rows: int = 4096, sample_rows: int = 20000, seed: int = 7) -> DataFrame:
    """k nearest rows of df found for each query row: query_id, rank, vec_id, score."""
    zero = lambda d: d.where(F.exists("v", lambda x: x != 0))
    rows, q = zero(valid_vectors(df, id_col, vec_col)), zero(valid_vectors(queries, id_col, vec_col))
    n = df.count()
    fit = Fit(curves, seed, max(50, -(-n // tile_rows)))
    share = max(1, -(-n // sample_rows))
    sample: dict[int, list] = {}
    for r in rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).limit(2 * sample_rows).mapInArrow(project(curves, seed), "dim int, p array<double>").toLocalIterator():
        sample.setdefault(r["dim"], []).append(r["p"])
    for dim, p in sample.items():
        fit.learn(dim, np.array(p))
    copies = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.select("vec_id", "v").distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    reach = max(1, round(window * fit.tiles / 2 - 0.5))
    schema = "dim int, curve int, tile int, kind int, vec_id long, v array<double>"
    met = distinct.mapInArrow(assign(fit, reach, False), schema).unionAll(q.mapInArrow(assign(fit, reach, True), schema))
    found = met.groupBy("dim", "curve", "tile").applyInArrow(rerank(k), "query_id long, shard long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("shard").alias("shard"))
    return merge_topk(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
