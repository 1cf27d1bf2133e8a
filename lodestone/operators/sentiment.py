"""Sentiment: logistic regression on hashed TF-IDF, in place of a neural encoder."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.storage import written

#: Probability over which a text is positive.
THRESHOLD = 0.9


def prepared(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t", tokens(F.col("text")))


def split(rows: DataFrame, share: float = 0.9, seed: int = 42) -> list[DataFrame]:
    return rows.randomSplit([share, 1 - share], seed)


def train(rows: DataFrame, features: int = 1 << 14) -> PipelineModel:
    """rows: (text, sentiment). Texts are read once: their hashed counts are written, and the passes of the fit read those."""
    counted = HashingTF(inputCol="t", outputCol="tf", numFeatures=features)
    held = written(counted.transform(prepared(rows)).select("tf", "sentiment"))
    fitted = Pipeline(stages=[IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="sentiment", maxIter=20, regParam=0.01)]).fit(held)
    return PipelineModel(stages=[counted, *fitted.stages])


def predict(model: PipelineModel, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scored = model.transform(prepared(rows)).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.drop("t", "tf", "x", "probability", "prediction").withColumn("label", (F.col("p") > threshold).cast("int"))


def evaluate(model: PipelineModel, rows: DataFrame) -> dict[str, float]:
    scored = model.transform(prepared(rows))
    return {"auc": BinaryClassificationEvaluator(labelCol="sentiment").evaluate(scored), "accuracy": scored.select(F.avg((F.col("prediction") == F.col("sentiment")).cast("double"))).first()[0]}
