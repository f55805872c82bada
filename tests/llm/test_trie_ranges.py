"""Successor search within the range that the pointers of a context give."""

import numpy as np

from sluice.llm import ngram_trie


def test_lookup_reads_only_the_context_range():
    rng = np.random.default_rng(8)
    pairs = np.unique(rng.integers(0, 400, (3000, 2)).astype(np.uint64), axis=0)
    c, s = pairs[:, 0], pairs[:, 1]
    t = ngram_trie.Trie.mapped(ngram_trie.Trie.dump(c, s, np.ones(len(c), dtype=np.int64)))
    whole = t.lookup(c, s)
    assert (whole > 0).all()

    class Shifted:  # pointers that say that every context is empty
        def get(self, i):
            return np.zeros(len(i), dtype=np.uint64)

    t.pointers = Shifted()
    assert (t.lookup(c, s) == 0).all()


def test_find_within():
    v = np.array([1, 4, 4, 9, 12], dtype=np.uint64)
    e = ngram_trie.EliasFano(ngram_trie.EliasFano.dump(v), 0)
    x, low, high = np.array([1, 9, 9, 5, 12], dtype=np.uint64), np.array([0, 0, 0, 0, 5]), np.array([5, 3, 5, 5, 5])
    assert e.find_within(x, low, high).tolist() == [0, -1, 3, -1, -1]
