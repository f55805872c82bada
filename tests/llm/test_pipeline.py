"""Every stage of the corpus pipeline against brute force on its own input, on documents of their real columns."""

from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F
from test_texts import check_packing

import corpus_pipeline
from sluice.llm import quality
from sluice.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", None if i == 3 else "s", len(t or "")) for i, t in brute.odd_documents()] + [(500 + i, " ".join(f"BUY!! $$$ {i}" for _ in range(30)), "en", "s", 9) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i is not None and i < 500), 0) for i, *_ in docs if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]

    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    weights = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in docs.collect() if quality.features(r.text or "") @ weights[:-1] + weights[-1] >= 0]
    assert good.columns == columns and Counter(good.collect()) == Counter(want) and good.where("doc_id >= 500").count() == 0

    single = stages["n-gram Jaccard join"](spark, good, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    numbers = brute.groups(rows)
    keep = Counter(min((i is None, i) for (i, _), (_, h) in zip(rows, numbers, strict=True) if h == g) for n, g in {x for x in numbers if x[0]} for _ in [0] if (n, g) == next(x for x in numbers if x[1] == g))
    got = Counter((r.doc_id is None, r.doc_id) for r in single.collect() if brute.words(r.text))
    assert single.columns == columns and got == keep

    rest = stages["substring dedup"](spark, single, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = Counter((i, t if len(kept) == n else b" ".join(kept).decode()) for (i, t), (n, kept) in zip(rows, brute.repeats(rows), strict=True))
    assert rest.columns == columns and Counter((r.doc_id, r.text) for r in rest.collect()) == want
    assert all(r.n_chars == len(r.text) for r in rest.where("text is not null").join(single.select("doc_id", F.col("text").alias("t")), "doc_id").where("t <> text").collect())

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    known = [r for r in rest.collect() if r.doc_id is not None]
    pieces = stages["packing"](spark, rest.where("doc_id is not null"), sf_dir).collect()
    check_packing(pieces, {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in known})


def test_run(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "sequence_id" in out.columns
    d = str(tmp_path / "empty")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
