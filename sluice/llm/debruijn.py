"""Substring dedup by De Bruijn compaction over word windows.

Edges of the graph are the windows of `window` consecutive words of one document. Walking a document, the edges that share
one anchor (the smallest hash among the `anchor`-word grams inside the window, leftmost on ties) follow each other without
a branch that the anchor can't see; they compact to one block, the path from the first to the last of these windows. Equal
windows have equal anchors at equal places, so a repeat is found among the blocks of one anchor, and about one row per
fourteen words travels instead of one per word. Where a document repeats a few words over and over, equal blocks follow each
other without a gap; such a cycle is one row with the number of its rounds, however long it is.

Spark joins then tell the cases apart:
1. equal blocks are one class, their rounds summed before they travel; a class that occurs twice is a path that repeats as a
   whole;
2. an anchor with one class doesn't branch: nothing else repeats there;
3. at the other anchors (branches) one source coordinate for each class leads back to its text, where its single windows
   are hashed anew; a window that two classes share is a repeat.
Spans go back to their documents by source coordinates (document, first word, windows).

Two blocks or windows count as equal when the anchor's 64-bit hash and their own independent 64-bit hash agree; the words
themselves are never compared, and source coordinates lead back to a text only for the classes at branches.

A row is told by doc_id and a hash of its text. Defined cases: a null text has no words; a null doc_id is a document too;
texts shorter than a window keep all words; exact repeats of a row repeat each other's windows; overlapping repeats in one
document count; an empty table gives an empty result; extra columns are ignored by spans and kept by strip_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, discard, free_names, gram_hashes, materialise, mix, paused, scratch_dir, split_words, word_hashes

BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = -(1 << 63)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost minimum of every run of `width` values."""
    pos, size = np.arange(len(values)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while size * 2 <= width:
        pos = better(pos[:-size], pos[size:])
        size *= 2
    return better(pos[: len(pos) - (width - size)], pos[width - size :]) if width > size else pos


class Segments:
    """Hashes of any run of words, from prefix sums of a polynomial over mixed word hashes."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(h) + 1
            power = np.full(n, U(BASE))
            power[0] = 1
            inverse = np.full(n, U(pow(BASE, -1, 1 << 64)))
            inverse[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(inverse, out=inverse)
            self.inverse = inverse
            self.sums = np.concatenate([[U(0)], np.add.accumulate(mix(h ^ U(0x5851F42D4C957F2D)) * power[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def compact(window: int, anchor: int, block_words: int = 600_000):
    """Rows (rid, th, text) to blocks (rid, th, start, n, rounds, anchor, path); a block stands for `rounds` equal ones in a row."""

    def blocks(keys: list[tuple], hashes: list[np.ndarray]) -> pa.RecordBatch:
        lens = np.array([len(h) for h in hashes])
        h = np.concatenate(hashes)
        grams = gram_hashes(h, anchor, seed=1)
        at = smallest(grams, window - anchor + 1)
        ends = np.cumsum(lens)
        doc = np.repeat(np.arange(len(lens)), np.maximum(lens - window + 1, 0))
        first = ends - lens
        per = np.maximum(lens - window + 1, 0)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + first[doc]  # valid windows only
        a = at[start]
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(doc) != 0)])
        head = np.flatnonzero(new)
        n = np.diff(np.concatenate([head, [len(doc)]]))
        s, a, doc = start[head], a[head], doc[head]
        with np.errstate(over="ignore"):
            path = mix(Segments(h).of(s, s + n - 1 + window) + (a - s).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in (doc, n, grams[a], path)])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        rounds = np.diff(np.concatenate([head, [len(doc)]]))
        s, a, n, doc, path = (x[head] for x in (s, a, n, doc, path))
        rid, th = (np.array([k[i] for k in keys], dtype=np.int64)[doc] for i in (0, 1))
        small = [pa.array(x.astype(np.int32)) for x in (s - first[doc], n, rounds)]
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(th), *small, long(grams[a]), long(path)], ["rid", "th", "start", "n", "rounds", "anchor", "path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        hashes: list[np.ndarray] = []
        held = 0
        for b in batches:
            for rid, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = split_words(text.as_py() or "")
                if len(words) >= window:
                    keys.append((rid, th))
                    hashes.append(word_hashes(words))
                    held += len(words)
                if held >= block_words:
                    yield blocks(keys, hashes)
                    keys, hashes, held = [], [], 0
        if keys:
            yield blocks(keys, hashes)

    return paused(run)


def variant_windows(window: int):
    """Rows (rid, th, text, variants) to single windows (anchor, edge, rid, th, start, known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for rid, th, text, variants in zip(*(b.column(i) for i in range(4)), strict=True):
                h = word_hashes(split_words(text.as_py()))
                v = variants.as_py()
                n = np.array([x["n"] for x in v])
                start = np.repeat(np.array([x["start"] for x in v]), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cols[0].append(np.repeat(np.array([x["anchor"] for x in v], dtype=np.int64), n))
                cols[1].append(Segments(h).of(start, start + window).view(np.int64))
                cols[2].append(np.full(len(start), rid.as_py(), dtype=np.int64))
                cols[3].append(np.full(len(start), th.as_py(), dtype=np.int64))
                cols[4].append(start.astype(np.int32))
                cols[5].append(np.repeat(np.array([x["known"] for x in v], dtype=bool), n))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["anchor", "edge", "rid", "th", "start", "known"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, folder: str, window: int = 35, anchor: int = 8) -> DataFrame:
    """(rid, th, spans): for each text with repeats, the runs of repeated window starts as (start, n)."""
    spark = docs.sparkSession
    rows = keyed(docs)
    blocks = materialise(rows.mapInArrow(compact(window, anchor), "rid long, th long, start int, n int, rounds int, anchor long, path long"), folder, "blocks")
    # any member will do as the source of its class; the table is written, so that later reads agree on it
    at = [F.first(c).alias(c) for c in ("rid", "th", "start", "n")]
    classes = materialise(blocks.groupBy("anchor", "path").agg(F.sum("rounds").alias("c"), *at), folder, "classes")
    repeated = classes.where("c > 1").select("anchor", "path")
    whole = materialise(blocks.join(repeated, ["anchor", "path"], "left_semi").select("rid", "th", "start", (F.col("n") * F.col("rounds")).alias("n")), folder, "whole")
    discard(spark, folder, "blocks")
    forks = classes.groupBy("anchor").agg(F.count("*").alias("v")).where("v > 1").select("anchor")
    variants = materialise(classes.join(forks, "anchor", "left_semi"), folder, "variants")
    discard(spark, folder, "classes")
    sources = variants.groupBy("rid", "th").agg(F.collect_list(F.struct("start", "n", "anchor", (F.col("c") > 1).alias("known"))).alias("variants"))
    met = rows.join(sources, ["rid", "th"]).select("rid", "th", "text", "variants")
    edges = materialise(met.mapInArrow(variant_windows(window), "anchor long, edge long, rid long, th long, start int, known boolean"), folder, "edges")
    twice = edges.groupBy("anchor", "edge").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "edge")
    single = edges.where("not known").join(twice, ["anchor", "edge"], "left_semi").withColumn("n", F.lit(1))
    cols = ["rid", "th", "start", "n"]
    found = whole.unionAll(single.select(*cols))
    return found.groupBy("rid", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def cover(window: int, joined: pa.Schema):
    """Adds n_words, n_removed and kept (the words that no repeated window covers, joined by one space)."""
    text_at, spans_at = joined.get_field_index("text"), joined.get_field_index("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(b.column(text_at), b.column(spans_at), strict=True):
                words = split_words(text.as_py() or "")
                total.append(len(words))
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    flat = spans.values.flatten()
                    start, n = flat[0].to_numpy(), flat[1].to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n - 1 + window, -1)
                    free = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[i] for i in free.tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            keep = [i for i in range(b.num_columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*(b.schema.names[i] for i in keep), "n_words", "n_removed", "kept"])

    return paused(run)


def strip_repeats(docs: DataFrame, window: int = 35, anchor: int = 8) -> DataFrame:
    """docs with n_words, n_removed and kept; columns of docs with these names are replaced, all others stay."""
    spark = docs.sparkSession
    spans = repeated_spans(docs, scratch_dir(spark), window, anchor)
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept")]
    rid, th, at = free_names(docs.columns, "rid", "th", "spans")
    rows = docs.select(*(F.col(f"`{c}`") for c in own), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(rid), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias(th))
    met = rows.join(spans.withColumnsRenamed({"rid": rid, "th": th, "spans": at}), [rid, th], "left").select(*(F.col(f"`{c}`") for c in own), F.col(at))
    out = T.StructType([f for f in met.schema if f.name != at]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    shape = pa.schema([pa.field("spans" if f.name == at else f.name if f.name == "text" else "", pa.null()) for f in met.schema])
    return met.mapInArrow(cover(window, shape), out)


def repeat_digests(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    done = strip_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **params)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
