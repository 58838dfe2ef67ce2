import math

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import ann_srs, queries

SF = "/root/testdata/sf0.01"


def brute(ids, vectors, query_ids, k=5):
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for q in query_ids:
        v = vectors[np.flatnonzero(ids == q)[0]]
        score = (vectors * v).sum(axis=1) / norms / math.sqrt((v * v).sum())
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, expected):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    return hits / sum(map(len, expected.values()))


def test_query_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding.to_list()).astype(float)
    got = by_query(queries.op5_nearest(spark, SF).collect())
    expected = brute(ids, vectors, ids[ids % 50 == 0])
    assert set(got) == set(expected) and all(len(v) == 5 for v in got.values())
    exact = {q: dict(brute(ids, vectors, [q], len(ids))[q]) for q in got}
    assert all(abs(s - exact[q][i]) < 1e-12 for q, v in got.items() for i, s in v)
    assert recall(got, expected) >= 0.9


def test_the_stop_saves_work_on_the_larger_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding.to_list()).astype(float)
    rows = queries.op5_nearest(spark, "/root/testdata/sf0.1").collect()
    got, expected = by_query(rows), brute(ids, vectors, ids[ids % 50 == 0])
    verified = {r.query_id: r.verified for r in rows}
    assert recall(got, expected) >= 0.9
    assert sum(verified.values()) < 0.5 * len(verified) * len(ids)


def test_shards_blocks_copies_and_a_stop_before_the_end(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 16))
    vectors = np.concatenate([centres[rng.integers(0, 40, 3000)] + 0.1 * rng.standard_normal((3000, 16)), np.tile(centres[0], (900, 1))])
    ids = rng.permutation(len(vectors))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    out = ann_srs.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=700, block_queries=64)
    got, expected = by_query(out.collect()), brute(ids, vectors, ids[ids % 20 == 0])
    assert set(got) == set(expected) and recall(got, expected) >= 0.95
    hot = [q for q in expected if abs(expected[q][0][1] - 1) < 1e-12]
    assert len(hot) > 20 and all(got[q] == expected[q] for q in hot)  # ties go to the smallest ids
    verified = {r.query_id: r.verified for r in out.collect()}
    assert sum(verified.values()) < 0.5 * len(verified) * 3001  # copies are one vector


def test_a_known_bound_is_shared(spark):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((4000, 32))
    search = lambda worst: ann_srs.search_shard([[i] for i in range(4000)], points, np.array([-1]), points[:1] + 0.01, np.array([worst]), k=5, m=16, seed=1, limit=ann_srs.chi_square_quantile(0.9, 16))
    (_, alone), (found, told) = search(-1.0), search(0.999)
    assert told[0] < alone[0] / 10 and [i for _, i, _ in found] == [0]


def test_tree_places_points():
    points = np.random.default_rng(1).standard_normal((5000, 4))
    points[:900] = points[0]
    tree = ann_srs.KdTree(points, leaf=50)
    leaf = tree.leaf_of(points)
    assert sorted(np.concatenate(tree.leaves).tolist()) == list(range(5000))
    assert all((leaf[own] == i).all() for i, own in enumerate(tree.leaves))
    assert (np.bincount(leaf) <= 50).sum() >= len(tree.leaves) - 1
    for p in (0.5, 0.9, 0.99):
        assert abs(ann_srs.chi_square_cdf(ann_srs.chi_square_quantile(p, 24), 24) - p) < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 1e-200]), (50, [0.0, 3.0]), (50, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    got = by_query(ann_srs.nearest(df, F.col("vec_id") % 50 == 0).collect())
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 50, 9], 50: [9, 0, 1]}
    assert ann_srs.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chi_square():
    draws = np.random.default_rng(0).standard_normal((200_000, 8))
    for x in (2.0, 7.3, 15.5):
        assert abs(((draws**2).sum(axis=1) <= x).mean() - ann_srs.chi_square_cdf(x, 8)) < 0.005
