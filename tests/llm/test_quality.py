"""The classifier against plain versions of its features, sums and risk."""

import random
import string

import numpy as np

from sluice.llm import quality

SCHEMA = "doc_id long, text string"


def plain_features(text: str) -> list[float]:
    """The features by their definition, byte by byte."""
    def kind(b: int) -> int:
        c = chr(b)
        for i, marks in enumerate(quality.MARKS):
            if c in marks:
                return 6 + i
        return 0 if c in string.ascii_lowercase else 1 if c in string.ascii_uppercase else 2 if c in string.digits else 3 if b == 32 else 4 if b < 32 else 5

    raw = text.encode()
    if not raw:
        return [0.0] * quality.WIDTH
    n = quality.CLASSES
    counts = [0] * (n * n)
    for x, y in zip(raw, raw[1:], strict=False):
        counts[kind(x) * n + kind(y)] += 1
    words, lines = raw.split(), raw.split(b"\n")
    w, u = len(words), len(set(words))
    shape = [1, min(1, w / 20), u / max(1, w), 1 - len(set(lines)) / len(lines), min(1, len(raw) / max(1, w) / 12), min(1, w / len(lines) / 40), np.log1p(len(raw)) / 12, u / max(1, w) * np.log1p(w) / 8]
    return [(c / max(1, len(raw) - 1)) ** 0.5 for c in counts] + shape


def some_texts(n: int) -> list[str | None]:
    r = random.Random(5)
    good = lambda: " ".join(r.choice(["the", "sea", "Was", "calm,", "and", "ship", "sailed."]) for _ in range(r.randrange(1, 60)))
    bad = lambda: "".join(r.choice("$$##!!|| \n9AZ") for _ in range(r.randrange(1, 200)))
    return [None, "", "a", " \n\t", "ü文🙂" * 40, "x" * 200_000] + [good() if r.random() < 0.7 else bad() for _ in range(n)]


def test_features_match_their_definition():
    for t in some_texts(60):
        assert np.allclose(quality.features(t or ""), plain_features(t or ""))


def test_sums_cover_every_row_once(spark):
    texts = some_texts(300)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "twice"), (7, "twice")]
    trusted = np.array([3, 7, 8, 200], dtype=np.int64)
    df = spark.createDataFrame(rows, SCHEMA).repartition(37)
    every, positive = quality.gather(df, trusted, fan_in=4)
    x = np.array([quality.features(t or "") for _, t in rows])
    p = np.array([quality.features(t or "") for i, t in rows if i in set(trusted.tolist())])
    for got, want in ((every, x), (positive, p)):
        assert got.n == len(want) and np.allclose(got.total, want.sum(axis=0)) and np.allclose(got.product, want.T @ want)
    none, _ = quality.gather(spark.createDataFrame([], SCHEMA), trusted)
    assert none.n == 0


def test_fit_lowers_the_risk_that_rows_give():
    """The risk of the fitted weights, taken row by row, against other weights; the clamped part does not fall far below zero."""
    r = np.random.default_rng(1)
    texts = some_texts(400)
    x = np.array([quality.features(t or "") for t in texts])
    is_good = np.array([bool(t) and t.startswith(("the", "sea", "Was", "calm", "and", "ship", "sailed")) for t in texts])
    p, prior = x[is_good][::2], float(is_good.mean())
    moments = []
    for rows in (p, x):
        m = quality.Moments()
        m.add(rows)
        moments.append(m)
    w = quality.fit_nnpu(*moments, prior)

    def risk(w):
        f_p, f_u = p @ w[:-1] + w[-1], x @ w[:-1] + w[-1]
        loss = lambda z: (1 - z) ** 2 / 4
        rest = loss(-f_u).mean() - prior * loss(-f_p).mean()
        return prior * loss(f_p).mean() + max(0.0, rest), rest

    best, rest = risk(w)
    assert rest > -0.01
    assert best < risk(np.zeros_like(w))[0]
    for _ in range(20):
        assert best < risk(w + np.append(np.zeros(quality.WIDTH), 1.0) * r.normal())[0] + 0.02
    assert ((x @ w[:-1] + w[-1] >= 0) == is_good).mean() > 0.97


def test_very_long_and_repeated_rows_get_their_score(spark):
    texts = some_texts(50)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[9])], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(0, len(texts), 3)] + [(1, 0), (None, 1), (4, None)], "doc_id long, quality int")
    weights = quality.train_quality(df, labels)
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        z = quality.features(texts[row.doc_id] or "") @ weights[:-1] + weights[-1]
        assert abs(row.score - 1 / (1 + np.exp(-quality.SHARPNESS * z))) < 1e-9
