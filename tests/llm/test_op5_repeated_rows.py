import numpy as np
from pyspark.sql import functions as F

from vigil.llm import ann_srs


def test_repeated_rows_and_ids_take_one_place(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((40, 8))
    vectors[1:12] = vectors[0] + 0.01 * rng.standard_normal((11, 8))
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7])] * 6 + [(0, vectors[0])] * 9
    rows += [(30 + i, vectors[0]) for i in range(3)]  # copies of the query under larger ids
    rows += [(3, vectors[0] + 0.001 * rng.standard_normal(8)) for _ in range(8)]  # one id, many vectors
    expected = {}
    for i, v in rows:
        s = float(v @ vectors[0] / np.linalg.norm(v) / np.linalg.norm(vectors[0]))
        expected[i] = max(s, expected.get(i, -2))
    del expected[0]
    best = sorted(expected, key=lambda i: (-round(expected[i], 12), i))[:5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    for shard_rows in (8192, 12):
        out = ann_srs.nearest(df, F.col("vec_id") == 0, shard_rows=shard_rows).orderBy("rank").collect()
        assert [r.vec_id for r in out] == best
