"""Calibration of scores: logistic and isotonic fits, averaged."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.functions.decisions import clip


def fit_calibration(train: DataFrame, score: str = "score", label: str = "label"):
    """A function DataFrame -> DataFrame that adds ``calibrated``; both models are fitted by Spark over all rows."""
    assembled = VectorAssembler(inputCols=[score], outputCol="__x")
    rows = assembled.transform(train.withColumn(label, F.col(label).cast("double")))
    platt = LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__hard").fit(rows)
    isotonic = IsotonicRegression(featuresCol="__x", labelCol=label, predictionCol="__iso").fit(rows)

    def apply(df: DataFrame) -> DataFrame:
        out = isotonic.transform(platt.transform(assembled.transform(df)))
        mean = (vector_to_array("__p")[1] + F.col("__iso")) / 2
        return out.withColumn("calibrated", clip(mean)).drop("__x", "__p", "__raw", "__hard", "__iso")

    return apply


def fit_meta(train: DataFrame, scores: list[str], label: str = "label"):
    """A logistic combination of layer scores, fitted over all rows; adds ``meta``."""
    assembled = VectorAssembler(inputCols=scores, outputCol="__x", handleInvalid="keep")
    model = LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__hard").fit(assembled.transform(train.withColumn(label, F.col(label).cast("double"))))

    def apply(df: DataFrame) -> DataFrame:
        neutral = df.select("*", *[F.coalesce(c, F.lit(0.5)).alias(f"__{c}") for c in scores])
        named = neutral.withColumns({c: F.col(f"__{c}") for c in scores}).drop(*[f"__{c}" for c in scores])
        return model.transform(assembled.transform(named)).withColumn("meta", clip(vector_to_array("__p")[1])).drop("__x", "__p", "__raw", "__hard")

    return apply
