"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows with quality 1, the unlabelled set is every document. A linear model f is fitted to the
risk  pi * R_p^+ + max(0, R_u^- - pi * R_p^-)  with the squared loss (1 - y f)^2 / 4; where the second part falls below
zero, its gradient step is reversed. The class prior pi is estimated as the mean label of the labelled rows. Features of a
text: frequencies of adjacent byte-class pairs (letter case, digits, white space, kinds of marks) and shape ratios
(repeated lines and words, word and line length); every byte of every text counts. The score is 1 / (1 + exp(-4 f)).

With the squared loss every part of the risk is a quadratic in the weights, whose coefficients are sums over documents: the
number of rows, the sums of the features and of their products. One pass gathers them over all documents (R_u^-, means and
deviations of the features) and over the trusted positives; tasks emit one row each, which merge in a tree of `fan_in`. The
driver gets the two sums, four MB at any input size, and no feature row.

Bounded sample (parameter): at most about `max_labelled` labelled rows, drawn row by row with a fixed seed; their ids go to
all tasks as 8 bytes each. All else covers every row.

Defined cases: a null text is an empty text, which gets the score of its (all zero) features; rows without a label or a
doc_id teach nothing as positives; repeated doc_ids give one row each; with no positive label the score is the prior,
0.5 if no label is known at all; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte classes of the features: each string is a class of its own, after letters, digits, white space and the rest.
MARKS = [".", ",", "!", "?", "|", "*", "#", "$", "%", "&", "-_", "/\\", ":;", "'\"`", "()[]{}<>", "@=+~^"]
CLASSES = 6 + len(MARKS)


def byte_classes() -> bytes:
    t = bytearray(256)
    for b in range(256):
        c = chr(b)
        t[b] = 0 if b < 128 and c.islower() else 1 if b < 128 and c.isupper() else 2 if b < 128 and c.isdigit() else 3 if b == 32 else 4 if b < 32 else 5
    for i, m in enumerate(MARKS):
        for c in m:
            t[ord(c)] = 6 + i
    return bytes(t)


TABLE = byte_classes()
WIDTH = CLASSES * CLASSES + 8
SHARPNESS = 4.0


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH)
    if raw:
        c = np.frombuffer(raw.translate(TABLE), dtype=np.uint8).astype(np.int64)
        pairs = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(c) - 1))
        words, lines = raw.split(), raw.split(b"\n")
        n, kinds = len(words), len(set(words))
        out[CLASSES * CLASSES :] = [1, min(1, n / 20), kinds / max(1, n), 1 - len(set(lines)) / len(lines), min(1, len(raw) / max(1, n) / 12), min(1, n / len(lines) / 40), np.log1p(len(raw)) / 12, kinds / max(1, n) * np.log1p(n) / 8]
    return out


def feature_matrix(texts) -> np.ndarray:
    return np.array([features(t.as_py() or "") for t in texts]).reshape(len(texts), WIDTH)


class Moments:
    """Sums over rows: their number, the features, and the products of all pairs of features."""

    def __init__(self, n: float = 0.0, total: np.ndarray | None = None, product: np.ndarray | None = None):
        self.n, self.total, self.product = n, np.zeros(WIDTH) if total is None else total, np.zeros((WIDTH, WIDTH)) if product is None else product

    def add(self, x: np.ndarray) -> None:
        self.n += len(x)
        self.total += x.sum(axis=0)
        self.product += x.T @ x

    def pack(self) -> bytes:
        """The products are symmetric, so one triangle is enough."""
        return np.concatenate([[self.n], self.total, self.product[np.triu_indices(WIDTH)]]).tobytes()

    @staticmethod
    def unpack(data: bytes) -> Moments:
        flat = np.frombuffer(data)
        product = np.zeros((WIDTH, WIDTH))
        product[np.triu_indices(WIDTH)] = flat[1 + WIDTH :]
        return Moments(flat[0], flat[1 : 1 + WIDTH], product + np.triu(product, 1).T)


def task_moments(trusted: np.ndarray):
    """Rows (doc_id, text) to one row (part, unlabelled, positive) with the packed sums of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, positive = Moments(), Moments()
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                x = feature_matrix(b.column(1).slice(at, 2048))
                every.add(x)
                ids = b.column(0).slice(at, 2048)
                known = ids.is_valid().to_numpy(zero_copy_only=False) & np.isin(ids.fill_null(0).to_numpy(), trusted)
                positive.add(x[known])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([every.pack()], pa.binary()), pa.array([positive.pack()], pa.binary())], ["part", "unlabelled", "positive"])

    return run


def merged(t: pa.Table) -> pa.Table:
    sums = lambda name: sum(np.frombuffer(x.as_py()) for x in t.column(name)).tobytes()
    return pa.table([t.column("part").slice(0, 1), pa.array([sums("unlabelled")], pa.binary()), pa.array([sums("positive")], pa.binary())], ["part", "unlabelled", "positive"])


def gather(rows: DataFrame, trusted: np.ndarray, fan_in: int = 16) -> tuple[Moments, Moments]:
    """Moments of all rows(doc_id, text) and of the trusted ones."""
    schema = "part long, unlabelled binary, positive binary"
    parts, tree = rows.rdd.getNumPartitions(), rows.mapInArrow(task_moments(trusted), schema)
    while parts > 1:
        tree = tree.groupBy(F.floor(F.col("part") / fan_in)).applyInArrow(merged, schema).withColumn("part", F.floor(F.col("part") / fan_in))
        parts = -(-parts // fan_in)
    got = tree.select("unlabelled", "positive").collect()  # one row, or none of an empty table
    return (Moments.unpack(got[0][0]), Moments.unpack(got[0][1])) if got else (Moments(), Moments())


def inverse(a: np.ndarray) -> np.ndarray:
    """Of a positive definite matrix, by Gauss-Jordan steps (which need no pivots there)."""
    a = a.copy()
    for k in range(len(a)):
        col, row = a[:, k].copy(), a[k] / a[k, k]
        a -= np.multiply.outer(col, row)
        a[:, k] = -col / col[k]
        a[k] = row
        a[k, k] = 1 / col[k]
    return a


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, x)


def fit_nnpu(positive: Moments, unlabelled: Moments, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 0.1) -> np.ndarray:
    """Weights (last: bias) of the non-negative PU risk with the squared loss; steps are scaled by the risk's own curvature.

    It runs on the driver, where a threaded BLAS can wait for its own threads for good, so matrices are multiplied and
    inverted without one.
    """
    mean = unlabelled.total / unlabelled.n
    std = np.maximum(np.sqrt(np.maximum(np.diag(unlabelled.product) / unlabelled.n - mean**2, 0)), 1e-3)

    def standard(m: Moments) -> tuple[np.ndarray, np.ndarray]:
        """Mean and mean product of the standardised features and a constant 1."""
        centre = (m.total / m.n - mean) / std
        product = (m.product - np.outer(m.total, mean) - np.outer(mean, m.total) + m.n * np.outer(mean, mean)) / m.n / np.outer(std, std)
        first = np.append(centre, 1.0)
        return first, np.block([[product, centre[:, None]], [first[None, :]]])

    (mu, gu), (mp, gp) = standard(unlabelled), standard(positive)
    curve = inverse(gu / 2 + decay * np.eye(len(mu)))
    w = np.zeros(len(mu))
    for _ in range(steps):
        uw, pw = times(gu, w), times(gp, w)
        on_unlabelled, on_positive = (1 + 2 * mu @ w + w @ uw) / 4, (1 + 2 * mp @ w + w @ pw) / 4
        negative = (mu + uw) / 2 - prior * (mp + pw) / 2
        grad = prior * (pw - mp) / 2 + negative + decay * w if on_unlabelled >= prior * on_positive else -negative
        w = w - rate * times(curve, grad)
    scaled = w[:-1] / std
    return np.append(scaled, w[-1] - scaled @ mean)


def held_out_sql(modulo: int, remainder: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulo == remainder, F.lit(False))


def train_quality(documents: DataFrame, labels: DataFrame, max_labelled: int = 16_000) -> np.ndarray:
    """Weights of the model; rows held out (crc32 of doc_id mod 3 is 1) give no labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out_sql(3, 1))
    n = known.count()
    known = known.sample(min(1.0, max_labelled / max(1, n)), 7).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    got = known.collect()  # about max_labelled rows at most
    prior = min(0.98, float(np.mean([r["quality"] for r in got]))) if got else 0.5
    untaught = np.append(np.zeros(WIDTH), np.log(max(prior, 1e-6) / (1 - prior)) / SHARPNESS)
    trusted = np.sort(np.array([r["doc_id"] for r in got if r["quality"] == 1], dtype=np.int64))
    if not len(trusted):
        return untaught
    every, positive = gather(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trusted)
    return fit_nnpu(positive, every, prior) if positive.n else untaught


def scorer(weights: np.ndarray):
    w = weights.astype(np.float64)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(0.5 * (1 + np.tanh(SHARPNESS * (feature_matrix(texts) @ w[:-1] + w[-1]) / 2)))

    return F.arrow_udf(run, "double")


def score_quality(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """documents with `score` (0 to 1) of each whole text; a column of that name is replaced."""
    return documents.withColumn("score", scorer(weights)(F.col("text")))


def keep_quality(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows, with their own columns, whose score is at least 0.5."""
    return documents.where(scorer(weights)(F.col("text")) >= 0.5)


def quality_scores(documents: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_quality(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train_quality(documents, labels, **params))
    return scored.select("doc_id", held_out_sql(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_remainder(doc_id: int, modulo: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulo
