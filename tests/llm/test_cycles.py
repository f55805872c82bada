"""Substring dedup of texts that repeat a few words over and over."""

from collections import Counter
from hashlib import sha256

import brute
import pyarrow as pa

from sluice.llm import debruijn


def cycle(period, words, tag=""):
    return [f"c{period}{tag}_{i % period}" for i in range(words)]


def block_rows(text):
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], ["rid", "th", "text"])
    return [r for b in debruijn.compact(35, 8)(iter([batch])) for r in b.to_pylist()]


def test_a_cycle_is_one_row_however_long():
    for period in range(1, 28):
        few, many = (block_rows(" ".join(["x", "y", *cycle(period, n), "z"])) for n in (300, 6000))
        assert len(many) <= len(few) + 1 and len(many) <= 40  # the words around it and a last round cut short make some more
        for rows, n in ((few, 300), (many, 6000)):  # each window lies in one block
            assert sum(r["n"] * r["rounds"] for r in rows) == n + 3 - 34
            assert all(a["start"] + a["n"] * a["rounds"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_cycles_against_brute_force(spark):
    docs = []
    for p in (1, 2, 3, 7, 20, 27, 28, 29, 34, 35, 36, 50):
        alone = [f"only{p}_{i}" for i in range(50)]
        for words in (34, 35, 36, 35 + p, 36 + p, 5 * p + 90):
            docs.append([*alone[:9], *cycle(p, words, f"_{words}"), *alone[9:20]])  # repeats in one document, if at all
            docs.append(cycle(p, words, "both") + alone[20:30] + cycle(p, 40, "both"))  # shared by some documents
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = Counter((i, n, n - len(kept), sha256(b" ".join(kept)).hexdigest()) for (i, _), (n, kept) in zip(docs, brute.repeats(docs), strict=True))
    assert Counter(tuple(r)[:4] for r in debruijn.repeat_digests(df).collect()) == want
