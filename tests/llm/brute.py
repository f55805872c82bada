"""Plain versions of the training-data operators, and odd rows for them."""

import math
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").encode().split()


def odd_documents():
    """(doc_id, text): nulls, blanks, repeats, ties, copies, near copies and a very long text."""
    base = [f"w{i % 97}x{i * 7 % 13}" for i in range(300)]
    near = [w if i not in (50, 170) else "edited" for i, w in enumerate(base)]
    cut = base[:260]
    passage = [f"p{i}" for i in range(60)]
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, "  ".join(near)), (4, " ".join(cut)), (5, None), (6, ""), (7, " \t\n "), (8, "One two"), (9, "one TWO"), (10, "short"),
        (11, "a " * 400), (12, " ".join(["q"] * 100 + passage + ["r", "s"])), (13, " ".join(["z1", "z2"] + passage)), (14, " ".join(passage + passage)), (None, " ".join(base[10:250])), (None, None),
        (16, " ".join(base)), (16, " ".join(base)), (17, "Ünïcode \x1c ΑΣ's <|endoftext|> İ 12345 don't!!"), (18, " ".join(f"u{i}" for i in range(20000))), (19, " ".join(reversed(base))),
        *((100 + k, " ".join(w if (i + 3 * k) % 40 else f"n{k}_{i}" for i, w in enumerate(base))) for k in range(12)),
    ]


def repeats(docs, window=35):
    """List of (n_words, kept words) in order of docs."""
    count = Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for _, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def shingle_set(text):
    w = (text or "").translate(LOWER).encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(docs):
    """List of (set size, group number) in order of docs; blank texts are groups of their own."""
    sets = [shingle_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def language_model(docs, discount=0.5):
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    streams = [[w.lower() for w in words(t)] + [None] for _, t in docs]
    c, pairs = Counter(), Counter()
    for (i, _), s in zip(docs, streams, strict=True):
        if train(i):
            c.update(s)
            pairs.update(zip([None, *s[:-1]], s, strict=True))
    n, v, fan = sum(c.values()), len(c), Counter(a for a, _ in pairs)
    out = []
    for (i, _), s in zip(docs, streams, strict=True):
        base = [(c[w] + 1) / (n + v + 1) for w in s]
        p = [(max(pairs[a, w] - discount, 0) + discount * fan[a] * b) / c[a] if c[a] else b for a, w, b in zip([None, *s[:-1]], s, base, strict=True)]
        out.append((i, not train(i), len(s), sum(c[w] > 0 for w in s), n, sum(map(math.log10, base)), sum(map(math.log10, p))))
    return out
