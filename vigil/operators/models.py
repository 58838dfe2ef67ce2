"""Model training and stacking on pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.metrics import meta_features, ranking_metrics


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing feature columns become 0.0 and nulls 0."""
    return df.withColumns({f: F.lit(0.0) for f in features if f not in df.columns}).na.fill(0.0, features)


def weighted(df: DataFrame, label: str) -> DataFrame:
    """A weight column: negatives over positives for the positive class, 1 for the other."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    return df.withColumn("weight", F.when(F.col(label) == 1, n.neg / max(n.pos, 1)).otherwise(1.0))


#: Training rows of one task; every level of every tree starts its tasks anew.
ROWS_A_TASK = 20_000


def equal_rows(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The features, the label and n: one row for all that agree in them, n how many they are."""
    return df.groupBy(*features, label).agg(F.count("*").alias("n"))


def train_trees(df: DataFrame, features: list[str], label: str, rounds: int = 200, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Boosted trees on all rows, balanced by class.

    Equal rows enter as one with their summed weight, which leaves every impurity and every
    split candidate as it is, so that a round's time follows the distinct rows.
    """
    rows = equal_rows(prepared(df, features), features, label).persist()
    count = lambda y: F.coalesce(F.sum(F.when(F.col(label) == y, F.col("n"))), F.lit(0))
    n = rows.agg(count(1).alias("pos"), count(0).alias("neg"), F.count("*").alias("rows")).first()
    balanced = rows.withColumn("weight", F.col("n") * F.when(F.col(label) == 1, n.neg / max(n.pos, 1)).otherwise(1.0)).coalesce(1 + n.rows // ROWS_A_TASK)
    trees = GBTClassifier(featuresCol="x", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), trees]).fit(balanced)
    rows.unpersist()
    return model


def scored(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(prepared(df, features))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: list[str], n: int = 15) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(((f, round(float(v), 4)) for f, v in zip(features, values, strict=True)), key=lambda x: (-x[1], x[0]))[:n]


class Logistic(LogisticRegression):
    """Logistic regression whose models keep no training summary.

    The summary holds the training rows and with them the session, which every task of the
    model would have to carry, and can't once the session has an Observation.
    """

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        model = super()._fit(dataset)
        model._java_obj.setSummary(dataset.sparkSession.sparkContext._jvm.scala.Option.empty())
        return model


class AveragePrecision(Evaluator):
    """Average precision (ties as one step) of the probability of class 1; 0 where it is undefined."""

    def __init__(self, label: str):
        super().__init__()
        self.label = label

    def _evaluate(self, dataset: DataFrame) -> float:
        rows = dataset.select(self.label, vector_to_array("probability")[1].alias("p"))
        return ranking_metrics(rows, [], self.label, "p").first().average_precision or 0.0

    def isLargerBetter(self) -> bool:
        return True


def cross_validated(df: DataFrame, streams: list[str], label: str = "y", key: str = "doc_id", folds: int = 5, parallel: int = 4) -> tuple[CrossValidatorModel, list[str]]:
    """Three logistic blends and a small boosted one under cross-validation, and the names of the stack's inputs.

    Folds are stratified: rows are dealt out within each class by a hash of the key, and
    are a column, so every candidate sees the same ones.  Vectors are assembled once;
    what is fitted (scaling too) sees the training folds only; fits run side by side.
    """
    meta = weighted(meta_features(df, streams), label)
    inputs = [c for c in meta.columns if c not in (*df.columns, "weight")] + sorted(streams)
    pos = meta.where(F.col(label) == 1).count()
    folds = min(folds, max(2, pos // 3))
    meta = meta.withColumn("fold", F.pmod(F.xxhash64(key, label), F.lit(folds)).cast("int"))
    meta = VectorAssembler(inputCols=inputs, outputCol="raw").transform(meta).select(key, label, "weight", "fold", "raw").persist()
    n = meta.count()
    scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True)
    blends = [Logistic(featuresCol="x", labelCol=label, weightCol="weight", regParam=1 / (c * n)) for c in (1.0, 10.0, 0.1)]
    blends.append(GBTClassifier(featuresCol="x", labelCol=label, weightCol="weight", maxIter=50, maxDepth=2, subsamplingRate=0.8, seed=42))
    whole = Pipeline(stages=[])
    grid = ParamGridBuilder().addGrid(whole.stages, [[scale, b] for b in blends]).build()
    model = CrossValidator(estimator=whole, estimatorParamMaps=grid, evaluator=AveragePrecision(label), numFolds=folds, foldCol="fold", parallelism=parallel).fit(meta)
    meta.unpersist()
    return model, inputs


def stack(df: DataFrame, streams: list[str], label: str = "y", key: str = "doc_id", folds: int = 5) -> tuple[PipelineModel, DataFrame]:
    """The best blend of ``cross_validated`` by mean held-out average precision, refitted; and the scored rows."""
    found, inputs = cross_validated(df, streams, label, key, folds)
    model = PipelineModel(stages=[VectorAssembler(inputCols=inputs, outputCol="raw"), *found.bestModel.stages])
    return model, stacked(model, df, streams).select(key, label, "p")


def stacked(model: PipelineModel, df: DataFrame, streams: list[str]) -> DataFrame:
    """df plus p, the score of a fitted stack over its streams."""
    out = model.transform(meta_features(df, streams))
    return out.select(*df.columns, vector_to_array("probability")[1].alias("p"))


def text_head(df: DataFrame, label: str, vector: str = "embedding") -> PipelineModel:
    """Balanced logistic regression on given text vectors."""
    rows = weighted(df.withColumn("x", array_to_vector(F.col(vector).cast("array<double>"))), label)
    return Pipeline(stages=[Logistic(featuresCol="x", labelCol=label, weightCol="weight")]).fit(rows)


def text_scores(df: DataFrame, head: PipelineModel | None, vector: str = "embedding") -> DataFrame:
    """df plus p by a text head; 0.5 throughout without one."""
    if head is None:
        return df.withColumn("p", F.lit(0.5))
    out = head.transform(df.withColumn("x", array_to_vector(F.col(vector).cast("array<double>"))))
    return out.select(*df.columns, vector_to_array("probability")[1].alias("p"))


def calibrated(df: DataFrame, label: str = "y", score: str = "p", method: str = "sigmoid") -> DataFrame:
    """df plus calibrated: a logistic or isotonic map of the score, the score itself if it can't be fitted."""
    if df.select(label).distinct().count() < 2:
        return df.withColumn("calibrated", F.col(score))
    if method == "isotonic":
        out = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(df).transform(df)
        return out
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = df.withColumn("__x", array_to_vector(F.array(F.log(p / (1 - p)))))
    out = Logistic(featuresCol="__x", labelCol=label, probabilityCol="__p").fit(rows).transform(rows)
    return out.withColumn("calibrated", vector_to_array("__p")[1]).drop("__x", "__p", "rawPrediction", "prediction")


def reduced_vectors(train: DataFrame, rows: DataFrame, vector: str = "embedding", k: int = 8) -> DataFrame:
    """rows plus emb_0..: standardised principal components, fitted on ``train`` only."""
    width, n = len(train.first()[vector]), train.count()
    k = min(k, width, n)
    stages = [StandardScaler(inputCol="__v", outputCol="__s", withMean=True), PCA(k=k, inputCol="__s", outputCol="__c")]
    as_vector = lambda df: df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    out = Pipeline(stages=stages).fit(as_vector(train)).transform(as_vector(rows))
    return out.select(*rows.columns, *[vector_to_array("__c")[i].alias(f"emb_{i}") for i in range(k)])


def text_encoder(train: DataFrame, text: str = "text", width: int = 1 << 18, least_docs: int = 2) -> PipelineModel:
    """TF-IDF of hashed words with unit norm, its document frequencies from ``train`` only.

    Words are runs of letters and digits in lower case; a word that fewer than
    ``least_docs`` training texts hold has no weight.  ``encoded`` applies it.
    """
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern="[^\\p{L}\\p{N}]+", toLowercase=True),
        HashingTF(inputCol="__words", outputCol="__tf", numFeatures=width),
        IDF(inputCol="__tf", outputCol="__idf", minDocFreq=least_docs),
        Normalizer(inputCol="__idf", outputCol="encoding", p=2.0),
    ]
    return Pipeline(stages=stages).fit(train.select(F.coalesce(F.col(text), F.lit("")).alias(text)))


def encoded(df: DataFrame, encoder: PipelineModel, text: str = "text") -> DataFrame:
    """df plus encoding: a sparse vector of norm 1, without entries for a text without known words (null and empty texts too)."""
    return encoder.transform(df.withColumn(text, F.coalesce(F.col(text), F.lit("")))).drop("__words", "__tf", "__idf")


def sparse_parts(df: DataFrame, vector: str) -> DataFrame:
    """df with a column of sparse vectors replaced by their indices and values."""
    rest = [c for c in df.columns if c != vector]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(rest))
            column = column.storage if isinstance(column, pa.ExtensionArray) else column
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], column.field("indices"), column.field("values")], [*rest, "indices", "values"])

    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
    return df.select(*rest, vector).mapInArrow(split, schema)


def vector_head(df: DataFrame, label: str, vector: str = "encoding") -> PipelineModel:
    """Balanced logistic regression on a column of vectors, dense or sparse."""
    head = Logistic(featuresCol=vector, labelCol=label, weightCol="weight", regParam=1e-3, maxIter=50)
    return Pipeline(stages=[head]).fit(weighted(df, label))


def vector_scores(df: DataFrame, head: PipelineModel | None) -> DataFrame:
    """df plus p by a head on vectors; 0.5 throughout without one."""
    if head is None:
        return df.withColumn("p", F.lit(0.5))
    return head.transform(df).select(*df.columns, vector_to_array("probability")[1].alias("p"))
