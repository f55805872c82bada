"""Columns of the caller that bear the names of results or helpers, grids of cells, and scratch folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import common, debruijn, exact_topk, jaccard

TEXTS = [" ".join(f"w{i}" for i in range(80)), " ".join(f"w{i}" for i in range(20, 100)), "short", None, ""]
SCHEMA = "doc_id long, text string, spans string, __rid int, __th int, kept string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i}", i, -i, f"k{i}", f"n{i}") for i, t in enumerate(TEXTS)], SCHEMA)


def test_strip_repeats_keeps_what_it_does_not_replace(docs):
    got = {r.doc_id: r for r in debruijn.strip_repeats(docs).collect()}
    assert all((r.spans, r["__rid"], r["__th"]) == (f"s{i}", i, -i) for i, r in got.items())
    assert got[0].n_removed == got[1].n_removed == 60 and got[2].kept == "short" and got[3].kept == ""


def test_pipeline_stages_keep_own_columns(spark, docs):
    rest = corpus_pipeline.drop_repeats(spark, docs, "")
    assert rest.columns == docs.columns
    rows = {r.doc_id: r for r in rest.collect()}
    assert rows[0].text == " ".join(f"w{i}" for i in range(20)) and all((r.kept, r.n_words, r.spans) == (f"k{i}", f"n{i}", f"s{i}") for i, r in rows.items())
    one = jaccard.one_of_each(docs.unionAll(docs).withColumn("__k_id", F.lit(1)))
    assert one.columns == [*docs.columns, "__k_id"] and sorted(r.doc_id for r in one.collect()) == [0, 1, 2, 3, 3, 4, 4]


def test_topk_over_many_cells(spark):
    r = np.random.default_rng(4)
    m = r.normal(size=(230, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(7)
    got = [tuple(x) for x in exact_topk.exact_topk(df, df.where("vec_id % 3 = 0"), query_rows=8, shard_rows=16, blocks=2).orderBy("query_id", "rank").collect()]
    whole = np.floor(256 * m.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 230, 3):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(230), -s)) if i != q][:5]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    assert got == want


def test_scratch_needs_a_shared_folder_on_clusters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.scratch_dir(Session())
    Context.master = "local-cluster[2,1,512]"
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.scratch_dir(Session())
