"""Distributed model jobs on MLlib: boosted ensembles, calibration, refits and importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.numbers import clip

# Three differently set members: (depth, step size, row share, seed).
MEMBERS = [(3, 0.10, 0.8, 11), (4, 0.07, 0.7, 22), (2, 0.15, 0.9, 33)]


def assemble(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep").transform(df)


def fit_boosted(train: DataFrame, label: str, rounds: int = 10, members: Sequence[tuple] = MEMBERS) -> list:
    """Differently set boosted tree models on the same assembled rows."""
    return [
        GBTClassifier(
            labelCol=label, featuresCol="features", maxDepth=d, stepSize=s, subsamplingRate=r, seed=seed, maxIter=rounds
        ).fit(train)
        for d, s, r, seed in members
    ]


def score_ensemble(models: Sequence, df: DataFrame, out: str = "p") -> DataFrame:
    """Mean positive-class probability of all members."""
    scored = df
    names = []
    for i, m in enumerate(models):
        m = m.copy()
        m.setProbabilityCol(f"__prob{i}").setRawPredictionCol(f"__raw{i}").setPredictionCol(f"__pred{i}")
        scored = m.transform(scored).withColumn(f"__p{i}", vector_to_array(f"__prob{i}")[1])
        scored = scored.drop(f"__prob{i}", f"__raw{i}", f"__pred{i}")
        names.append(f"__p{i}")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return scored.withColumn(out, total / F.lit(float(len(names)))).drop(*names)


def fit_isotonic(df: DataFrame, label: str, p: str):
    """Monotone calibration of a score; fit it on rows that are neither trained on nor reported."""
    return IsotonicRegression(labelCol=label, featuresCol=p, predictionCol="calibrated").fit(df)


def apply_isotonic(model, df: DataFrame, p: str, eps: float = 1e-6) -> DataFrame:
    return model.setFeaturesCol(p).transform(df).withColumn("calibrated", clip(F.col("calibrated"), eps, 1.0 - eps))


def refit_rounds(best: int, factor: float = 1.1) -> int:
    return max(1, int(best * factor))


def best_rounds(model, df: DataFrame, label: str) -> int:
    """Boosting length with the lowest validation loss."""
    losses = model.evaluateEachIteration(df)
    return losses.index(min(losses)) + 1


def mean_importance(models: Sequence, cols: Sequence[str], spark) -> DataFrame:
    """(feature, importance) averaged over the models; as long as the feature list."""
    rows = []
    for m in models:
        values = m.featureImportances.toArray()
        rows += [(c, float(v)) for c, v in zip(cols, values)]
    return spark.createDataFrame(rows, "feature string, importance double").groupBy("feature").agg(
        F.avg("importance").alias("importance")
    )


def fit_window_classifier(train: DataFrame, label: str, trees: int = 20, depth: int = 5, seed: int = 7):
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
