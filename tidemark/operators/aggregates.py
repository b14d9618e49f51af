"""Group statistics, rates, pivots and distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numbers import bin_by_edges, equal_width_bin
from tidemark.operators.distributed import exact_quantiles


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), col)


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column in one row; the sketch form avoids shuffling the values."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(F.col(c)).alias(c) for c in cols])


def describe(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, std, min, quartiles and max per key; quartiles are exact and interpolated.

    Keys of more than ``HOT_ROWS`` distinct values are cut into ranges before they are sorted; the result is the same.
    """
    basic = df.groupBy(key).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = exact_quantiles(df, [key], value, [0.25, 0.5, 0.75])
    joined = basic.join(q, key, "left")
    return joined.select(
        key, "n", "mean", "std", "min", "max", *[F.col("q")[i].alias(n) for i, n in enumerate(["q25", "q50", "q75"])]
    )


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    totals = df.groupBy(key).agg(F.sum(value).alias("total"))
    grand = totals.agg(F.sum("total").alias("g")).scalar()
    return totals.withColumn("share_pct", F.try_divide(F.col("total") * 100.0, grand))


def yoy_growth(df: DataFrame, key: str, date: str, value: str, year: int) -> DataFrame:
    """Per-day average of two successive years and the growth in percent."""
    day = F.to_date(F.col(date))
    daily = df.groupBy(key, day.alias("__d")).agg(F.sum(value).alias("__v"))
    per_year = daily.groupBy(key).agg(
        *[
            F.try_divide(
                F.sum(F.when(F.year("__d") == y, F.col("__v"))), F.count_if(F.year("__d") == y)
            ).alias(n)
            for y, n in ((year, "avg_before"), (year + 1, "avg_after"))
        ]
    )
    growth = F.try_divide(F.col("avg_after") - F.col("avg_before"), F.col("avg_before")) * 100.0
    return per_year.withColumn("growth_pct", growth)


def volatility(df: DataFrame, key: str, value: str, high: float = 30.0, medium: float = 15.0) -> DataFrame:
    cv = F.try_divide(F.stddev_samp(value), F.avg(value)) * 100.0
    grade = F.when(F.col("cv") > high, "HIGH").when(F.col("cv") > medium, "MED").otherwise("STABLE")
    return df.groupBy(key).agg(cv.alias("cv")).withColumn("grade", grade)


def weekday_ratio(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    weekend = F.weekday(F.col(date)) >= 5
    out = df.groupBy(key).agg(
        F.avg(F.when(~weekend, F.col(value))).alias("weekday_mean"),
        F.avg(F.when(weekend, F.col(value))).alias("weekend_mean"),
    )
    return out.withColumn("ratio", F.try_divide("weekday_mean", "weekend_mean"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form of the symmetric matrix, one aggregate for all pairs of columns."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    one = df.agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs])

    def entry(i: int, j: int) -> Column:
        value = F.lit(1.0) if i == j else F.col(f"c{min(i, j)}_{max(i, j)}")
        return F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), value.alias("r"))

    entries = [entry(i, j) for i in range(len(cols)) for j in range(len(cols))]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the group's minimum and maximum; the last bin is closed."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull())
    span = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    if keys:
        spread = rows.join(span, keys)
    else:
        s = span.select(F.struct("__lo", "__hi").alias("s")).scalar()
        spread = rows.withColumns({"__lo": s["__lo"], "__hi": s["__hi"]})
    b = equal_width_bin(F.col("__v"), F.col("__lo"), F.col("__hi"), bins).alias("bin")
    return spread.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("n"))


def rate_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """Mean label per category next to the overall base rate, highest first."""
    groups = df.groupBy(key).agg(F.count(label).alias("n"), F.sum(label).alias("positives"))
    base = groups.agg(F.try_divide(F.sum("positives"), F.sum("n")).alias("b")).scalar()
    rated = groups.select(key, "n", F.try_divide("positives", "n").alias("rate"), base.alias("base_rate"))
    return rated.withColumn("lift", F.try_divide("rate", "base_rate")).orderBy(F.desc("rate"), key)


def entity_rate_spread(df: DataFrame, entity: str, label: str, min_rows: int = 1) -> DataFrame:
    """Spread of per-entity rates: two mergeable aggregates."""
    per = df.groupBy(entity).agg(F.count(label).alias("n"), F.avg(label).alias("rate")).where(F.col("n") >= min_rows)
    return per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.avg("rate").alias("mean_rate"),
        F.stddev_samp("rate").alias("std_rate"),
        F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
    )


def quantile_bins(df: DataFrame, value: str, bins: int, out: str = "decile") -> DataFrame:
    """Equal-frequency bins by value: right-closed, ties stay together, repeated edges merge.

    More than ``HOT_ROWS`` distinct values are cut into ranges before they are sorted; the edges are the same.
    """
    edges = exact_quantiles(df, [], value, [i / bins for i in range(bins)])
    inner = edges.select(
        F.filter(F.array_distinct(F.slice("q", 2, bins - 1)), lambda e: e > F.col("q")[0]).alias("e")
    ).scalar()
    return df.withColumn("__edges", inner).withColumn(out, bin_by_edges(F.col(value), F.col("__edges"))).drop("__edges")


def encoding_stability(df: DataFrame, key: str, ts: str, label: str) -> DataFrame:
    """Correlation of a category's rate between each week and the next; high means safe to encode."""
    week = F.date_trunc("week", F.col(ts))
    rates = df.groupBy(key, week.alias("w")).agg(F.avg(label).alias("rate"))
    following = rates.select(key, (F.col("w") - F.expr("interval 7 days")).alias("w"), F.col("rate").alias("next_rate"))
    joined = rates.join(following, [key, "w"])
    return joined.groupBy(F.col("w").cast("date").cast("string").alias("week")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.corr("rate", "next_rate").alias("stability")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weights proportional to 1/count that add up to the number of classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    norm = counts.agg((F.count(F.lit(1)) / F.sum(1.0 / F.col("n"))).alias("s")).scalar()
    return counts.withColumn("weight", norm / F.col("n"))


def frequent_shared(df: DataFrame, value: str, at_least: int = 2, top: int = 5) -> DataFrame:
    """The most frequent values held by several rows (a top-n report)."""
    counts = df.where(F.trim(value) != "").groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= at_least).orderBy(F.desc("n"), value).limit(top)


def mean_of(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / F.lit(float(len(cols)))


def best_tile(df: DataFrame, image: str, tile: str, classes: Sequence[str]) -> DataFrame:
    """Tile with the highest class probability per image, and that class."""
    scores = F.array(*[F.col(c) for c in classes])
    per_tile = df.select(
        image, tile, F.array_max(scores).alias("p"), (F.array_position(scores, F.array_max(scores)) - 1).alias("k")
    )
    best = F.max_by(F.struct(tile, "p", "k"), F.struct(F.col("p"), -F.col(tile), -F.col("k"))).alias("best")
    names = F.array(*[F.lit(c) for c in classes])
    return (
        per_tile.groupBy(image)
        .agg(best)
        .select(
            image,
            F.col(f"best.{tile}").alias(tile),
            F.get(names, F.col("best.k").cast("int")).alias("cls"),
            F.col("best.p").alias("confidence"),
        )
    )
