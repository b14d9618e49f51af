"""Model jobs on a separable toy set: sane scores on rows outside the fit."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as md


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        "id", ((F.col("id") * 37) % 100 / 100).alias("a"), ((F.col("id") * 53) % 100 / 100).alias("b"), (F.col("id") % 3 == 0).cast("int").alias("cal")
    )
    return md.assemble(df.withColumn("y", (F.col("a") > 0.6).cast("int")), ["a", "b"]).cache()


def test_ensemble_calibration_and_importance(spark, rows):
    train, rest = rows.where("cal = 0"), rows.where("cal = 1")
    models = md.fit_boosted(train, "y", rounds=3)
    scored = md.score_ensemble(models, rest)
    split = scored.groupBy("y").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("y").collect()
    assert 0 < split[0]["lo"] and split[0]["hi"] < split[1]["lo"] and split[1]["hi"] < 1
    cal = md.fit_isotonic(scored.select("y", "p"), "y", "p")
    out = md.apply_isotonic(cal, scored, "p").select("p", "calibrated").distinct().orderBy("p").collect()
    values = [r["calibrated"] for r in out]
    assert values == sorted(values) and all(0 < v < 1 for v in values)
    weights = {r["feature"]: r["importance"] for r in md.mean_importance(models, ["a", "b"], spark).collect()}
    assert weights["a"] > weights["b"] and sum(weights.values()) == pytest.approx(1.0)


def test_refit_rounds():
    assert md.refit_rounds(10) == 11 and md.refit_rounds(1) == 1


def test_window_classifier(rows):
    model = md.fit_window_classifier(rows.where("cal = 0"), "y", trees=5)
    hits = model.transform(rows.where("cal = 1")).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    assert hits > 0.95
