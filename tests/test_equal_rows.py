from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from vigil.functions import core
from vigil.operators import models

X = ["x1", "x2"]


def test_equal_rows_train_as_one(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("x1"), (F.col("id") % 5).cast("double").alias("x2"), (F.col("id") * F.col("id") % 11 > 6).cast("int").alias("y"))
    rows = models.equal_rows(df, X, "y")
    assert rows.count() == 70 and rows.agg(F.sum("n")).first()[0] == 3000
    trees = GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=3, maxDepth=3, stepSize=0.1, seed=42)
    single = Pipeline(stages=[VectorAssembler(inputCols=X, outputCol="x"), trees]).fit(models.weighted(df, "y"))
    found = models.train_trees(df, X, "y", rounds=3, depth=3)
    p = lambda m: {(r.x1, r.x2): round(r.p, 9) for r in models.scored(m, df, X).collect()}
    assert p(found) == p(single)
    nodes = lambda m: [t.numNodes for t in m.stages[-1].trees]
    assert nodes(found) == nodes(single)


def test_cvss_parts_are_read_once_a_row(spark):
    record = core.cvss_record(F.col("v"))
    plan = spark.createDataFrame([("CVSS:3.0/AV:L",)], "v string").select(record.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
