"""Daily series: pivots, centred rolling statistics, anomalies, fixed row windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.distributed import ordinal


def daily_totals(df: DataFrame, ts: str, value: str, series: str | None = None) -> DataFrame:
    keys = [F.to_date(F.col(ts)).alias("day")]
    if series:
        keys.append(F.col(series).alias("series"))
    return df.groupBy(*keys).agg(F.sum(value).alias("value"))


def daily_pivot(df: DataFrame, ts: str, series: str, value: str, order: Sequence[str]) -> DataFrame:
    """One column per series in a fixed order plus the row total; days without a series stay null."""
    day = F.to_date(F.col(ts)).alias("day")
    wide = df.groupBy(day).pivot(series, list(order)).agg(F.sum(value))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in order])
    return wide.withColumn("total", total)


def centred(order: str, size: int, keys: Sequence[str] = ()) -> Window:
    """Centred row frame; an even size leans one row back."""
    back = size // 2
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-back, size - 1 - back)


def rolling(
    df: DataFrame,
    order: str,
    value: str,
    size: int,
    min_periods: int,
    keys: Sequence[str],
    std: bool = False,
    position: Column | None = None,
    block: int = 100_000,
) -> DataFrame:
    """Centred rolling mean (and sample deviation) over rows.

    On day-level rows a key never exceeds the calendar and one window per key is enough. For longer series pass
    ``position``, a numeric form of ``order``: rows are then numbered in parallel, cut into blocks of ``block`` rows,
    and each block borrows the few rows its frames reach over from its neighbours.
    """
    keys = list(keys)

    def measured(rows: DataFrame, w: Window) -> DataFrame:
        enough = F.count(value).over(w) >= min_periods
        out = rows.withColumn("rolling_mean", F.when(enough, F.avg(value).over(w)))
        if std:
            out = out.withColumn("rolling_std", F.when(enough, F.stddev_samp(value).over(w)))
        return out

    if position is None:
        return measured(df, centred(order, size, keys))
    numbered = ordinal(df, keys, [F.col(order)], position=position, out="__rn")
    own = F.floor(F.col("__rn") / block)
    reached = F.array_distinct(F.array(F.floor((F.col("__rn") - size) / block), own, F.floor((F.col("__rn") + size) / block)))
    spread = numbered.withColumn("__own", own).withColumn("__block", F.explode(reached))
    out = measured(spread, centred("__rn", size, [*keys, "__block"]))
    return out.where("__block = __own").drop("__rn", "__own", "__block")


def zscores(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn("z", F.try_divide(F.col(value) - F.col("rolling_mean"), F.col("rolling_std")))


def anomaly_bands(df: DataFrame, value: str = "value", sigmas: float = 2.0) -> DataFrame:
    upper = F.col("rolling_mean") + sigmas * F.col("rolling_std")
    lower = F.col("rolling_mean") - sigmas * F.col("rolling_std")
    side = F.when(F.col(value) > upper, "high").when(F.col(value) < lower, "low").otherwise("normal")
    return df.withColumns({"upper": upper, "lower": lower, "side": side})


def top_and_bottom(df: DataFrame, by: str, order: str, largest: int, smallest: int) -> DataFrame:
    """The largest and smallest rows together, in date order (a fixed-length report)."""
    top = df.orderBy(F.desc(by), order).limit(largest)
    bottom = df.orderBy(F.asc(by), order).limit(smallest)
    return top.union(bottom).distinct().orderBy(order)


def mark_holidays(df: DataFrame, holidays: DataFrame, day: str = "day") -> DataFrame:
    """Left join a calendar of (day, holiday); one row per day even if the calendar repeats a date."""
    calendar = holidays.groupBy(day).agg(F.min("holiday").alias("holiday"))
    return df.join(calendar, day, "left").withColumn("is_holiday", F.col("holiday").isNotNull().cast("int"))


def fixed_row_windows(
    df: DataFrame,
    file: str,
    order: Sequence[str],
    size: int,
    position: Column,
    drop_last_full: bool = True,
) -> DataFrame:
    """Cut each file's ordered rows into windows of ``size`` rows; incomplete windows go.

    ``drop_last_full`` also drops each file's last full window. ``position`` is a numeric form of the first order
    column; row numbers come from the bucketed rank, so one very long file is spread over many tasks.
    """
    ranked = ordinal(df, [file], [F.col(c) for c in order], position=position, out="rn")
    windowed = ranked.withColumn("window_id", F.floor((F.col("rn") - 1) / size).cast("bigint"))
    totals = df.groupBy(file).agg(F.count(F.lit(1)).alias("__rows"))
    last = F.floor(F.col("__rows") / size) - (1 if drop_last_full else 0)
    return windowed.join(totals, file).where(F.col("window_id") < last).drop("__rows")


def window_features(df: DataFrame, file: str, std_of: Sequence[str], mean_of: Sequence[str], label: str) -> DataFrame:
    """Deviation and mean features per (file, window) and the window's first label."""
    return df.groupBy(file, "window_id").agg(
        *[F.stddev_samp(c).alias(f"{c}_std") for c in std_of],
        *[F.avg(c).alias(f"{c}_mean") for c in mean_of],
        F.min_by(label, "rn").alias("label"),
    )
