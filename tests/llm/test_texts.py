"""Operators on texts against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import debruijn, jaccard, licenses, ngram_trie, packing, pair_bpe, quality
from sluice.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs():
    return brute.odd_documents()


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).withColumns({"n_words": F.lit("clash"), "spans": F.lit(1), "score": F.lit(None).cast("int")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ---- BPE ----


def test_bpe_equals_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = [x or "" for _, x in docs] + ["".join(rng.choice("abcdeinthsorAÉİßẞﬁ中'!.0 \n\t<|>\x1c") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["aaaaaaaaaa aaa", "<|startoftext|>x<|endoftext|>", "ΣΑΣ Σ"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    encoded = pair_bpe.bpe_encode(df, path)
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert [ids[i] for i in range(len(texts))] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    back = {r.doc_id: r.text for r in pair_bpe.bpe_decode(encoded, path).collect()}
    assert all(back[i] == t.decode(ids[i], skip_special_tokens=False) for i in ids)
    for r in pair_bpe.bpe_digests(df, path).collect():
        assert r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids[r.doc_id])).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(back[r.doc_id].encode()).hexdigest()
    assert pair_bpe.bpe_digests(empty, path).count() == 0


# ---- packing ----


def check_packing(pieces, want, capacity=1024):
    """want: doc_id -> ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(want[d][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(want[d])
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return sum(len(x) for x in want.values()) / capacity / len(by_sequence)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = [x or "" for _, x in docs] + ["".join(rng.choice("abc deé'!0\n\t \x85中<|>") for _ in range(rng.randint(0, 9000))) for _ in range(60)] + ["a<|endoftext|>b", "x  y   z \n\n w"]
    want = {i: [*e.ids, 0] for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    assert check_packing(packing.pack_documents(df, path).collect(), want) > 0.97
    check_packing(packing.pack_documents(df.repartition(4), path).collect(), want)
    assert packing.pack_documents(empty, path).count() == 0


def test_differencing():
    rng = random.Random(1)
    for n, k in ((1, 1), (5, 3), (200, 16), (40, 40), (3, 7)):
        sizes = [rng.randint(1, 256) for _ in range(n)]
        window, load = packing.differencing(sizes, k)
        assert len(load) == k and sorted(load.tolist()) == sorted(sum(s for s, w in zip(sizes, window, strict=True) if w == x) for x in range(k))
    assert max(packing.differencing([rng.randint(1, 256) for _ in range(640)], 64)[1]) - min(packing.differencing([100] * 640, 64)[1]) < 1500
    window, count = packing.partition([600, 600, 600], 1024)
    assert count == 3 and sorted(window.tolist()) == [0, 1, 2]  # two windows would hold 1800 tokens, but not these pieces


# ---- repeats ----


def test_repeats_equal_brute_force(docs, frame, empty):
    for window, anchor in ((35, 8), (5, 3)):
        want = [(i, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for (i, _), (n, kept) in zip(docs, brute.repeats(docs, window), strict=True)]
        same([tuple(r) for r in debruijn.repeat_digests(frame, window=window, anchor=anchor).collect()], want)
    out = debruijn.strip_repeats(frame)
    assert out.columns == ["doc_id", "text", "spans", "score", "n_words", "n_removed", "kept"]
    assert debruijn.repeat_digests(empty).count() == 0


def test_repeats_of_random_texts(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for i in range(60)]
    want = [(i, n, n - len(kept)) for (i, _), (n, kept) in zip(docs, brute.repeats(docs, 9), strict=True)]
    got = debruijn.repeat_digests(spark.createDataFrame(docs, SCHEMA), window=9, anchor=4).select("doc_id", "n_words", "n_removed")
    same([tuple(r) for r in got.collect()], want)


def test_smallest():
    rng = np.random.default_rng(0)
    for n, w in ((30, 1), (30, 2), (40, 7), (64, 28), (28, 28)):
        v = rng.integers(0, 9, n)
        assert debruijn.smallest(v, w).tolist() == [int(i + v[i : i + w].argmin()) for i in range(n - w + 1)]


# ---- near copies ----


def expected_groups(docs):
    got = brute.groups(docs)
    out = []
    for (i, _), (n, g) in zip(docs, got, strict=True):
        ids = [j for (j, _), (_, h) in zip(docs, got, strict=True) if h == g and j is not None]
        out.append((i, n, min(ids) if ids and n else i))
    return out


def test_groups_equal_brute_force(docs, frame, empty):
    same([tuple(r) for r in jaccard.group_documents(frame).select("doc_id", "n_shingles", "component_id").collect()], expected_groups(docs))
    assert jaccard.group_documents(empty).count() == 0
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    blank = [(i, t) for i, t in docs if not brute.words(t)]
    groups = {g for _, (n, g) in zip(docs, brute.groups(docs), strict=True) if n}
    assert kept.count() == len(groups) + len(blank)


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_edited_copies(spark, seed):
    """Families of copies with many or few edits: links run between copies as well as to a hub."""
    rng = random.Random(seed)
    docs = []
    for f in range(6):
        base = [f"f{f}w{rng.randint(0, 500)}" for _ in range(rng.randint(8, 150))]
        for _ in range(25):
            w = [x if rng.random() > rng.choice([0.002, 0.01, 0.03, 0.06]) else f"e{rng.randint(0, 40)}" for x in base]
            a, b = rng.choice([(0, 0), (0, 0), (0, 12), (9, 0), (5, 5)])
            docs.append((len(docs), " ".join(w[a : len(w) - b])))
    same([tuple(r) for r in jaccard.group_documents(spark.createDataFrame(docs, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()], expected_groups(docs))


# ---- language model ----


def test_scores_equal_brute_force(docs, frame, empty):
    want = {repr(w[:5]): w for w in brute.language_model(docs)}
    got = ngram_trie.trie_scores(frame, block_chars=2000, shard_chars=5000).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[repr(tuple(r)[:5])]
        assert r.base_score == pytest.approx(w[5], rel=1e-12) and r.score == pytest.approx(w[6], rel=1e-6)
    assert ngram_trie.trie_scores(empty).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (1, 2**63), (500, 600), (3000, 2**40), (2000, 2**64 - 1)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        e = ngram_trie.EliasFano(ngram_trie.EliasFano.dump(v), 0)
        assert e.get(np.arange(n)).tolist() == v.tolist()
        u = np.unique(v)
        e = ngram_trie.EliasFano(ngram_trie.EliasFano.dump(u), 0)
        assert e.find(u).tolist() == list(range(len(u)))
        absent = np.setdiff1d(rng.integers(0, top, 50, dtype=np.uint64, endpoint=True), u)
        assert (e.find(absent) == -1).all()


def test_trie():
    rng = np.random.default_rng(4)
    pairs = Counter(zip(rng.integers(0, 60, 4000).tolist(), rng.integers(0, 200, 4000).tolist(), strict=True))
    keys = sorted(pairs)
    c, s = (np.array([k[i] for k in keys], dtype=np.uint64) for i in (0, 1))
    t = ngram_trie.Trie.mapped(ngram_trie.Trie.dump(c, s, np.array([pairs[k] for k in keys])))
    assert ngram_trie.LEVELS[t.lookup(c, s)].tolist() == [pairs[k] - 0.5 for k in keys]
    assert (t.lookup(c, s + np.uint64(500)) == 0).all() and (t.lookup(c + np.uint64(1000), s) == 0).all()
    assert t.fanout(np.arange(61, dtype=np.uint64)).tolist() == [len([k for k in keys if k[0] == i]) for i in range(61)]


# ---- licenses ----


def test_licenses(spark, empty):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "code"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "rest of it " * 20), (4, "a/b/c/z.py", "more"), (5, "d/e.py", "nothing"), (6, None, None),
             (7, "a/b/COPYING", "notes\nThis work is licensed under the GNU General Public License, version 3.\n" + "other words here " * 20), (8, "a2/x", "the the under"), (2, "a/x.py", "code")]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("dir", F.lit(1))
    got = sorted(((r.doc_id, r.declared, r.license, r.inherited_from, r.is_license_file) for r in licenses.scan_licenses(df).collect()), key=str)
    assert got == sorted([(1, "MIT", "MIT", None, True), (2, None, "MIT", "a", False), (2, None, "MIT", "a", False), (3, "Apache-2.0", "Apache-2.0", None, False), (4, None, "GPL-3.0", "a/b", False), (5, None, None, None, False), (6, None, None, None, False), (7, "GPL-3.0", "GPL-3.0", None, True), (8, None, None, None, False)], key=str)
    assert licenses.scan_licenses(empty.withColumn("path", F.lit("x"))).count() == 0


def test_key_terms_lose_no_match():
    m = licenses.Model({"the": 900, "license": 10, "under": 500, "licensed": 10}, 1000, 0.7)
    rng = random.Random(0)
    terms = sorted({t for x in licenses.TEMPLATES.values() for t in licenses.terms(x)}) + ["foo", "bar"]
    for _ in range(3000):
        line = " ".join(rng.choice(terms) for _ in range(rng.randint(1, 12)))
        assert m.match(line) is None or m.key.search(line)


# ---- quality ----


def test_quality(spark, empty):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["river", "stone", "the", "of", "walks", "and"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "NOW!!", "a|b"]) for _ in range(60))
    kinds = [int(rng.random() < 0.8) for _ in range(600)]
    docs = [(i, good() if k else bad()) for i, k in enumerate(kinds)] + [(None, None), (601, ""), (1, good())]
    labels = [(i, k) for i, k in enumerate(kinds) if i % 2] + [(None, 1), (3, None)]
    df, lab = spark.createDataFrame(docs, SCHEMA).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.quality_scores(df, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    known = [r for r in rows if r.doc_id is not None and 1 < r.doc_id < 600 and r.held_out]
    assert np.mean([r.predicted == kinds[r.doc_id] for r in known]) > 0.97
    assert {r.score for r in quality.quality_scores(df, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}
    assert quality.quality_scores(empty, lab).count() == 0
