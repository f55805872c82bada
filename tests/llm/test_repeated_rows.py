"""Vector search on tables with repeated rows and ids."""

import numpy as np

from sluice.llm import curve_ann


def test_repeated_rows_take_no_place_of_other_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100, 400)]
    v, near = [5.0] * 8, [[5.0] * 7 + [5.0 + e] for e in (np.arange(1, 41) / 100).tolist()]
    rows += [(5, v)] * 9 + [(6, v), (7, v)]  # repeated rows of one id before its copies
    rows += [(8, w) for w in near] + [(9, [5.0] * 7 + [6.0])]  # one id with many vectors
    df = spark.createDataFrame([(0, v), (0, v), *rows], "vec_id long, embedding array<double>").repartition(3)
    got = curve_ann.curve_neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got[:5]] == [5, 6, 7, 8, 9] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
