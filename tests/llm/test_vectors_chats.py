"""Vector searches and chat formatting against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import chat, curve_ann, exact_topk
from sluice.llm.hilbert import hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, label int, score string"
ODD = [(100000, None), (100050, [None, 1.0]), (100100, [float("nan")] * 8), (100150, [float("inf")] * 8), (100200, [0.0] * 8), (100250, [1.0, 2.0]), (100300, []), (None, [1.0] * 8)]


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)] + [(5, rows[7][1])]  # a hot vector, and a repeated id
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors(900) + ODD], SCHEMA).repartition(5)


def valid(rows):
    return [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]


def brute(score, k=5):
    rows = valid(vectors(900) + ODD)
    out = {}
    for i, v in rows:
        if i % 50 == 0:
            got = sorted(((-score(v, w), j) for j, w in rows if j != i and len(v) == len(w)))[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in got])
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_exact_topk(frame, spark):
    want = brute(lambda a, b: sum(math.floor(256 * float(x)) * math.floor(256 * float(y)) for x, y in zip(a, b, strict=True)))
    got = result(exact_topk.exact_topk(frame, frame.where("vec_id % 50 = 0"), query_rows=7, shard_rows=50))
    assert set(got) == {q for q, w in want.items() if w[0]}
    for q, rows in got.items():
        assert [x[1:] for x in rows] == want[q][0] and [x[0] for x in rows] == list(range(1, len(rows) + 1))
    none = spark.createDataFrame([], SCHEMA)
    assert exact_topk.exact_topk(none, none).count() == 0


def test_exact_topk_of_large_numbers(spark):
    df = spark.createDataFrame([(0, [3e6, 1.0]), (1, [5e6, 2.0]), (2, [5e6, 3.0])], "vec_id long, embedding array<double>")
    got = result(exact_topk.exact_topk(df, df.where("vec_id = 0")))
    assert got[0] == [(1, 2, 768000000 * 1280000000 + 256 * 768), (2, 1, 768000000 * 1280000000 + 256 * 512)]


def test_curve_neighbours(frame, spark):
    def cosine(a, b):
        a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
        return float(a @ b / np.sqrt((a @ a) * (b @ b))) if a.any() and b.any() else -9.0

    want = {q: w for q, w in brute(cosine).items() if q not in (100200,)}
    got = result(curve_ann.curve_neighbours(frame, frame.where("vec_id % 50 = 0")))
    hits = total = 0
    for q, ws in want.items():
        w = [(j, s) for j, s in ws[0] if s > -2]
        rows = got.get(q, [])
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1))
        assert all(s == pytest.approx(cosine(dict(vectors(900))[q], dict(valid(vectors(900)))[j]), abs=1e-9) for _, j, s in rows if j != 5 and q < 900)
        hits += len({j for j, _ in w} & {x[1] for x in rows})
        total += len(w)
    assert hits / total >= 0.9
    assert [x[1] for x in got[0]] == [900 + i for i in (0, 1, 2, 3, 4)]  # equal vectors: smaller ids first
    none = spark.createDataFrame([], SCHEMA)
    assert curve_ann.curve_neighbours(none, none).count() == 0


def test_hilbert_keys_walk_the_grid():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * d), axis=-1).reshape(-1, d)
        keys = hilbert_keys(grid, bits)
        walk = grid[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (3, 0, None, "x"), (None, 0, "ann", "lost"), (4, None, "ann", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("perspective", F.lit(1))
    seg = chat.rotate_perspectives(df)
    by = {}
    for r in seg.orderBy("conv_id", "perspective", "turn").collect():
        by.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (3, "unknown"), (4, "ann")}
    assert [(r.role_out, r.is_target, r.n_target_chars) for r in by[1, "bob"]] == [("system", False, 0), ("user", False, 0), ("assistant", True, 10), ("user", False, 0), ("user", False, 0)]
    assert by[1, "bob"][1].segment == "<|im_start|>user name=ann\nhi<|im_end|>\n"
    whole = {(r.conv_id, r.perspective): r for r in chat.render_dialogues(seg).collect()}
    r = whole[1, "ann"]
    assert [r.text[m.start : m.end] for m in r["mask"]] == ["hi<|im_end|>", "bye<|im_end|>", "bye<|im_end|>"] and r.n_turns == 5
    assert chat.rotate_perspectives(df.limit(0)).count() == 0
