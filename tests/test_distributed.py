"""Ranks, quantiles and samples on skewed keys against plain pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distributed as ds
from tidemark.operators import features as ft
from tidemark.operators.aggregates import histogram, quantile_bins


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", np.array([f"k{i % 60}" for i in range(n)]))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "v": np.round(rng.normal(size=n), 1), "y": (rng.random(n) < 0.2).astype(int)})
    return spark.createDataFrame(pdf).repartition(5), pdf


def test_ordinal_equals_a_plain_row_number(skewed):
    df, pdf = skewed
    got = ds.ordinal(df, ["key"], [F.col("v"), F.col("id")], F.floor("v")).select("id", "rn").toPandas().set_index("id")["rn"]
    want = pdf.sort_values(["v", "id"]).groupby("key").cumcount() + 1
    assert (got.sort_index() == want.sort_index()).all()


def test_ordinal_upto_keeps_the_first_rows(skewed):
    df, pdf = skewed
    got = ds.ordinal(df, ["key"], [F.col("v"), F.col("id")], F.floor("v"), upto=F.lit(7)).select("id").toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("key").head(7)
    assert set(got["id"]) == set(want["id"])


def test_ordinal_by_position_splits_hot_keys(skewed):
    df, pdf = skewed
    cut = ds.range_buckets(df, ["key"], F.col("v"), hot_rows=100, grid=4, fine=4)
    parts = {r["key"]: r["n"] for r in cut.groupBy("key").agg(F.countDistinct("__bucket").alias("n")).collect()}
    assert parts["hot"] > 8 and {n for k, n in parts.items() if k != "hot"} == {1}
    got = ds.ordinal(df, ["key"], [F.col("v"), F.col("id")], position=F.col("v"), hot_rows=100).select("id", "rn").toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("key").cumcount() + 1
    assert (got.set_index("id")["rn"].sort_index() == want.sort_index()).all()
    whole = ds.ordinal(df, [], [F.col("v"), F.col("id")], position=F.col("v"), hot_rows=100).orderBy("rn").select("id").toPandas()
    assert list(whole["id"]) == list(pdf.sort_values(["v", "id"])["id"])


@pytest.mark.parametrize("probs", [[0.0, 0.5, 1.0], [0.1, 0.25, 0.333, 0.9]])
@pytest.mark.parametrize("hot_rows", [5, 1000])
def test_exact_quantiles(skewed, probs, hot_rows):
    df, pdf = skewed
    got = {r["key"]: r["q"] for r in ds.exact_quantiles(df, ["key"], "v", probs, hot_rows=hot_rows).collect()}
    want = pdf.groupby("key")["v"].quantile(probs).unstack()
    assert set(got) == set(want.index)
    for k, q in got.items():
        np.testing.assert_allclose(q, want.loc[k].to_numpy(), atol=1e-9)
    whole = ds.exact_quantiles(df, [], "v", probs, hot_rows=hot_rows).first()["q"]
    np.testing.assert_allclose(whole, np.quantile(pdf["v"], probs), atol=1e-9)


def test_quantile_bins_keep_ties_together(skewed):
    df, pdf = skewed
    got = quantile_bins(df, "v", 10).select("id", "decile").toPandas().set_index("id")["decile"].sort_index()
    want = pd.qcut(pdf["v"], 10, labels=False, duplicates="drop")
    assert (got.to_numpy() == want.to_numpy()).all()


def test_quantile_bins_merge_repeated_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 15 + [2, 3, 4, 5, 6]], "v double")
    got = sorted(r["decile"] for r in quantile_bins(df, "v", 10).collect())
    want = sorted(pd.qcut(pd.Series([1.0] * 15 + [2, 3, 4, 5, 6]), 10, labels=False, duplicates="drop"))
    assert got == want


def test_histogram_counts_every_row(skewed):
    df, pdf = skewed
    got = {r["bin"]: r["n"] for r in histogram(df, "v", 30).collect()}
    assert sum(got.values()) == len(pdf) and max(got) == 29


def test_balanced_undersample_is_exact(skewed):
    df, pdf = skewed
    out = ft.balanced_undersample(df, "y", "id", 1).toPandas()
    assert out["y"].value_counts().to_dict() == {0: pdf["y"].sum(), 1: pdf["y"].sum()}
    sized = ft.balanced_undersample(df, "y", "id", 1, {0: 100, 1: 40}).toPandas()
    assert sized["y"].value_counts().to_dict() == {0: 100, 1: 40}


def test_stratified_split_sizes(skewed):
    df, pdf = skewed
    out = ft.stratified_split(df, "key", "id", 0.85, 5).toPandas()
    share = out[out["split"] == "train"].groupby("key").size() - 0.85 * pdf.groupby("key").size()
    assert len(out) == len(pdf) and share.abs().max() <= 1


def test_materialize_reads_back_from_the_shared_folder(spark, skewed):
    df, pdf = skewed
    back = ds.materialize(df, "test")
    assert back.count() == len(pdf)
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") in back.inputFiles()[0]


def test_first_per_key(skewed):
    df, pdf = skewed
    got = {r["key"]: r["id"] for r in ds.first_per_key(df, ["key"], ["id"]).collect()}
    assert got == pdf.groupby("key")["id"].min().to_dict()


def test_dealt_tasks_hold_a_bounded_number_of_rows(spark):
    from tidemark.operators.distributed import dealt

    rows = dealt(spark.range(4000).coalesce(1), 100).rdd.glom().map(len).collect()
    assert sum(rows) == 4000 and max(rows) <= 200
