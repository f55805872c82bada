"""Registered queries that read every row of their table."""

from sluice.queries import QUERIES


def test_explode_reaches_every_vector(spark, tmp_path):
    rows = [(i, [float(i), 0.5]) for i in (0, 99, 100, 101, 5000)] + [(7, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.vec_id, r.x) for r in QUERIES["explode"](spark, str(tmp_path)).collect())
    assert got == sorted((i, x) for i, v in rows for x in v)


def test_top_puts_every_null_first_or_last(spark, tmp_path):
    spark.range(40).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["top_asc_nulls_first"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(20, 10, 19, 10)]
    assert [r.k for r in QUERIES["top_desc_nulls_last"](spark, str(tmp_path)).collect()] == list(range(39, 19, -1))
