"""Model queries on MLlib. Tree fits are iterative and have no SQL counterpart; the isotonic fit of a fixed score has one, in its min-max form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import models as md, series as se
from tidemark.operators.distributed import materialize
from tidemark.operators.features import fold_of
from tidemark.plans.registry import Tables, query
from tidemark.plans.series import sensor_windows
from tidemark.plans.tabular import event_features

NOT_FEATURES = {"event_id", "label", "split"}


def matrices(t: Tables) -> tuple[DataFrame, DataFrame, list[str]]:
    """Feature rows before and after the cut, written once since every tree level reads them again."""
    train, other = event_features(t)
    cols = [c for c in train.columns if c not in NOT_FEATURES]
    both = materialize(md.assemble(train.unionByName(other), cols).select("event_id", "label", "split", "features"), "matrix")
    return both.where("split = 'train'"), both.where("split = 'validation'"), cols


def slices(later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Separate calibration and test rows among the later ones."""
    marked = later.withColumn("__f", fold_of(F.col("event_id"), 2))
    return marked.where("__f = 0").drop("__f"), marked.where("__f = 1").drop("__f")


@query("boosted_ensemble")
def boosted_ensemble(t: Tables) -> DataFrame:
    train, later, _ = matrices(t)
    models = md.fit_boosted(train, "label", rounds=5)
    return md.score_ensemble(models, later).select("event_id", "label", "p")


@query(
    "isotonic_calibration",
    """
    with o as (select (o_orderkey%89)/100.0::double as p, (o_custkey%100 < o_orderkey%89)::int as label from orders),
      g as materialized (select p, count(*) as n, sum(label) as s from o group by 1),
      c as materialized (select p, row_number() over (order by p) as k, n, sum(n) over (order by p) as cn, sum(s) over (order by p) as cs from g),
      m as materialized (select a.k as i, b.k as j, (b.cs-coalesce(z.cs,0))/(b.cn-coalesce(z.cn,0))::double as mean
        from c a join c b on a.k<=b.k left join c z on z.k=a.k-1),
      low as (select i, c.k, min(mean) as least from m join c on c.k between m.i and m.j group by 1,2),
      fit as (select k, max(least) as v from low group by 1)
    select p, n::bigint as n, round(least(greatest(v,1e-6),1-1e-6),6) as calibrated from c join fit using (k)""",
)
def isotonic_calibration(t: Tables) -> DataFrame:
    """Monotone calibration of a fixed score of the orders, and the calibrated value of every score that occurs."""
    score = (F.col("o_orderkey") % 89).cast("double") / 100.0
    rows = t.orders.select(score.alias("p"), (F.col("o_custkey") % 100 < F.col("o_orderkey") % 89).cast("int").alias("label"))
    fitted = md.fit_isotonic(rows, "label", "p")
    scores = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return md.apply_isotonic(fitted, scores, "p").select("p", "n", F.round("calibrated", 6).alias("calibrated"))


@query("isotonic_after_boosting")
def isotonic_after_boosting(t: Tables) -> DataFrame:
    """Calibration of a boosted model's score on rows that are neither trained on nor reported."""
    train, later, _ = matrices(t)
    calibration, test = slices(later)
    models = md.fit_boosted(train, "label", rounds=3, members=md.MEMBERS[:1])
    fitted = md.fit_isotonic(md.score_ensemble(models, calibration).select("label", "p"), "label", "p")
    out = md.apply_isotonic(fitted, md.score_ensemble(models, test), "p")
    return out.select("event_id", "label", "p", "calibrated")


@query("refit_full")
def refit_full(t: Tables) -> DataFrame:
    """Boosting length chosen on the calibration slice, refit on all rows outside the test slice."""
    train, later, _ = matrices(t)
    calibration, test = slices(later)
    first = md.fit_boosted(train, "label", rounds=6, members=md.MEMBERS[:1])[0]
    rounds = md.refit_rounds(md.best_rounds(first, calibration, "label"))
    final = md.fit_boosted(train.unionByName(calibration), "label", rounds=rounds, members=md.MEMBERS[:1])
    return md.score_ensemble(final, test).select("event_id", "label", "p", F.lit(rounds).alias("rounds"))


@query("mean_importance")
def mean_importance(t: Tables) -> DataFrame:
    train, _, cols = matrices(t)
    return md.mean_importance(md.fit_boosted(train, "label", rounds=3), cols, t.spark)


@query("window_classifier")
def window_classifier(t: Tables) -> DataFrame:
    """Window features to the window's label, scored on users that were not trained on."""
    wf = se.window_features(sensor_windows(t), "user_id", ["value", "k"], ["value"], "event_type")
    named = wf.withColumn("cls", F.when(F.col("label") == "click", 0).when(F.col("label") == "view", 1).otherwise(2))
    rows = md.assemble(named, ["value_std", "k_std", "value_mean"]).select("user_id", "window_id", "cls", "features")
    marked = materialize(rows.withColumn("fold", fold_of(F.col("user_id"), 5)), "windows")
    model = md.fit_window_classifier(marked.where("fold > 0"), "cls", trees=10)
    return model.transform(marked.where("fold = 0")).select("user_id", "window_id", "cls", F.col("prediction").cast("int").alias("pred"))
