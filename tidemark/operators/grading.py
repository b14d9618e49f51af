"""Scoring of predictions and of free-text answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numbers import log_loss
from tidemark.functions.text import EMPLOYEE_ID, EXTENSION


def any_of_failures(groups: Column, response: Column) -> Column:
    """Groups without a single hit: every non-empty group needs one of its tokens in the response."""
    low = F.lower(response)
    return F.filter(
        groups, lambda g: (F.size(g) > 0) & ~F.exists(g, lambda t: (t != "") & F.contains(low, F.lower(t)))
    )


def forbidden_hits(tokens: Column, response: Column) -> Column:
    low = F.lower(response)
    return F.filter(tokens, lambda t: (t != "") & F.contains(low, F.lower(t)))


def leaks_extension(response: Column) -> Column:
    return response.rlike(EXTENSION)


def leaks_employee_id(response: Column) -> Column:
    return response.rlike(EMPLOYEE_ID)


def matched_items(tokens_per_id: Column, response: Column) -> Column:
    """How many ids have at least one of their tokens in the response."""
    low = F.lower(response)
    hits = F.filter(
        F.map_values(tokens_per_id), lambda ts: F.exists(ts, lambda t: (t != "") & F.contains(low, F.lower(t)))
    )
    return F.size(hits)


def failure_reasons(
    response: Column,
    any_of: Column,
    forbidden: Column,
    no_extension: Column,
    no_employee_id: Column,
    tokens_per_id: Column,
    min_items: Column,
    exact_count: Column,
) -> Column:
    """All violated rules as an array; empty means the answer passes."""
    has_items = F.coalesce(F.size(F.map_keys(tokens_per_id)), F.lit(0)) > 0
    matched = matched_items(tokens_per_id, response)
    reasons = F.array(
        F.when(F.size(any_of_failures(F.coalesce(any_of, F.array().cast("array<array<string>>")), response)) > 0, "missing any-of"),
        F.when(F.size(forbidden_hits(F.coalesce(forbidden, F.array().cast("array<string>")), response)) > 0, "contains forbidden"),
        F.when(F.coalesce(no_extension, F.lit(False)) & leaks_extension(response), "leaked extension"),
        F.when(F.coalesce(no_employee_id, F.lit(False)) & leaks_employee_id(response), "leaked employee id"),
        F.when(has_items & (matched < min_items), "min items"),
        F.when(has_items & (matched != exact_count), "exact count"),
    )
    return F.array_compact(reasons)


def grade(truth: DataFrame, submission: DataFrame) -> DataFrame:
    """Join answers to the truth by id; a missing answer never passes and is flagged.

    ``truth``: id, bucket, any_of, forbidden, no_extension, no_employee_id, tokens_per_id, min_items, exact_count.
    """
    joined = truth.join(submission.select("id", F.coalesce("response", F.lit("")).alias("response")), "id", "left")
    reasons = failure_reasons(
        F.col("response"), *[F.col(c) for c in (
            "any_of", "forbidden", "no_extension", "no_employee_id", "tokens_per_id", "min_items", "exact_count")]
    )
    missing = F.col("response").isNull()
    return joined.select(
        "id", "bucket", missing.alias("missing"),
        F.when(missing, F.array(F.lit("missing"))).otherwise(reasons).alias("reasons"),
    ).withColumn("passed", F.size("reasons") == 0)


def grade_report(graded: DataFrame) -> DataFrame:
    """Pass counts and rate per bucket with an overall row; one pass over the graded answers."""
    summed = graded.select("bucket", "passed", "missing").rollup("bucket").agg(
        F.grouping("bucket").alias("g"),
        F.count_if("passed").alias("n_pass"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("missing").alias("n_missing"),
    )
    name = F.when(F.col("g") == 1, F.lit("(all)")).otherwise(F.col("bucket")).alias("bucket")
    rate = F.try_divide(F.col("n_pass") * 100.0, F.col("total")).alias("rate_pct")
    return summed.select(name, "n_pass", "total", "n_missing", rate)


# --- probabilities and classes -----------------------------------------------------------------------------------


def normalized_cross_entropy(df: DataFrame, label: str, p: str) -> DataFrame:
    """Mean log loss, the loss of always predicting the base rate, and their ratio."""
    y = F.col(label).cast("double")
    one = df.agg(F.avg(log_loss(y, F.col(p))).alias("log_loss"), F.avg(y).alias("base_rate"))
    g = F.col("base_rate")
    baseline = log_loss(g, g)
    return one.select("log_loss", "base_rate", baseline.alias("baseline")).withColumn(
        "nce", F.try_divide("log_loss", "baseline")
    )


def calibration_curve(df: DataFrame, label: str, p: str, bins: int = 20) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(p).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("fraction_positive"),
    )


def pair_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class from one pass of pair counts; undefined scores are 0."""
    pairs = pair_counts(df, truth, pred)
    sides = F.array(
        F.struct(F.col("t").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    counts = pairs.select(F.explode(sides).alias("e")).groupBy("e.cls").agg(
        F.sum("e.support").alias("support"), F.sum("e.predicted").alias("predicted"), F.sum("e.hit").alias("hit")
    )
    precision = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return (
        counts.select("cls", precision.alias("precision"), recall.alias("recall"), "support")
        .withColumn("f1", f1)
        .select("cls", "precision", "recall", "f1", "support")
    )


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return classification_report(df, truth, pred).agg(F.avg("f1").alias("macro_f1"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """One row per true class and one count column per predicted class, over pre-counted pairs."""
    wide = pair_counts(df, truth, pred).groupBy("t").pivot("p", classes).agg(F.sum("n"))
    return wide.select(F.col("t").alias("truth"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"p_{c}") for c in classes])


def threshold_reject(pred: Column, confidence: Column, threshold: float) -> Column:
    """The class if confident enough, else -1."""
    return F.when(confidence >= F.lit(threshold), pred).otherwise(F.lit(-1))


def threshold_binary(p: Column, threshold: float = 0.505) -> Column:
    """Binary decision: strictly above the threshold."""
    return (p > F.lit(threshold)).cast("int")


def pseudo_labels(df: DataFrame, confidence: str, threshold: float = 0.70, min_rows: int = 50) -> DataFrame:
    """Confident rows, but only if there are more than ``min_rows`` of them; otherwise none."""
    sure = df.where(F.col(confidence) >= threshold)
    enough = sure.agg((F.count(F.lit(1)) > min_rows).alias("ok")).scalar()
    return sure.where(enough)


def output_assertions(df: DataFrame, expected_rows: Column, id_col: str, p: str) -> DataFrame:
    """Data-quality facts of an output table in one row: size, range and key checks."""
    ids = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(p).between(0.0, 1.0)).alias("ok"))
    return ids.agg(F.sum("c").alias("n"), F.max("c").alias("mx"), F.sum("ok").alias("ok")).select(
        F.col("n").alias("n_rows"),
        (F.col("n") == expected_rows).alias("row_count_ok"),
        (F.col("mx") == 1).alias("ids_unique"),
        (F.col("ok") == F.col("n")).alias("probabilities_ok"),
    )
