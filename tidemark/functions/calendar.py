"""Calendar expressions. Weeks are ISO weeks and Monday is day 0."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_dayfirst(text: Column, pattern: str = "d/M/yyyy") -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit(pattern)).cast("date")


def weekday(ts: Column) -> Column:
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def calendar_columns(ts: Column) -> list[Column]:
    return [
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.weekofyear(ts).alias("iso_week"),
        F.weekday(ts).alias("weekday"),
        is_weekend(ts).cast("int").alias("is_weekend"),
    ]


def week_label(ts: Column) -> Column:
    """Calendar year with ISO week, so 2025-12-29 is ``2025-W01``."""
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def week_period(ts: Column) -> Column:
    """``monday/sunday`` of the week a date lies in."""
    monday = F.date_trunc("week", ts).cast("date")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def second_number(ts: Column) -> Column:
    """Seconds since 1970 read off the clock fields, so that it rises with a zone-free timestamp in any time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
