from pyspark.sql import functions as F

from vigil.operators import text
from vigil.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def test_all_queries_and_blocks_give_one_result(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = {r.vec_id for r in e.where("vec_id % 20 = 0").collect()}
    assert len(asked) > 20
    assert {r.query_id for r in REGISTRY["r01_nearest_all"][0](spark, SF).collect()} == asked
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one, many = text.nearest_vectors(e, q), text.nearest_vectors(e, q, shard_rows=60, block_queries=4)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
