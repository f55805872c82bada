"""The n-gram model of order 3 and more against a plain version."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import pytest

from sluice.llm import ngram_trie
from sluice.llm.queries import op3_ngram_trie


def plain(docs, order, discount=0.5):
    """(doc_id, score) in order of docs."""
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    streams = [[w.lower() for w in brute.words(t)] + [None] for _, t in docs]
    c, follow = Counter(), defaultdict(Counter)
    for (i, _), s in zip(docs, streams, strict=True):
        padded = [None] * (order - 1) + s
        for at, w in enumerate(s, order - 1):
            if train(i):
                c[w] += 1
                for n in range(1, order):
                    follow[tuple(padded[at - n : at])][w] += 1
    total, out = sum(c.values()), []
    for (i, _), s in zip(docs, streams, strict=True):
        padded, score = [None] * (order - 1) + s, 0.0
        for at, w in enumerate(s, order - 1):
            p = (c[w] + 1) / (total + len(c) + 1)
            for n in range(1, order):
                f = follow.get(tuple(padded[at - n : at]))
                if f:
                    p = (max(f[w] - discount, 0) + discount * len(f) * p) / sum(f.values())
            score += math.log10(p)
        out.append((i, score))
    return out


def same_scores(got, want):
    key = lambda r: (repr(r[0]), r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], rel=1e-6)


@pytest.mark.parametrize("order", [3, 4])
def test_scores_of_higher_orders(spark, order):
    docs = brute.odd_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ngram_trie.trie_scores(df, order=order, block_chars=2000, shard_chars=5000).select("doc_id", "score").collect()
    same_scores([tuple(r) for r in got], plain(docs, order))


def test_registered_query_is_of_order_3(spark, tmp_path):
    docs = brute.odd_documents()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same_scores([tuple(r) for r in op3_ngram_trie(spark, str(tmp_path)).select("doc_id", "score").collect()], plain(docs, 3))
