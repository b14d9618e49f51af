"""CSV and JSON-lines sinks with checks in front."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_submission(df: DataFrame, path: str, columns: Sequence[str], expected_rows: int | None = None) -> None:
    """CSV with a fixed header. The row count is checked first, so a short result never replaces a good file."""
    out = df.select(*columns)
    if expected_rows is not None:
        n = out.count()
        if n != expected_rows:
            raise ValueError(f"expected {expected_rows} rows, got {n}")
    out.write.mode("overwrite").option("header", True).csv(path)


def append_run_log(df: DataFrame, path: str) -> None:
    """Append rows (nested lists allowed) as JSON lines."""
    df.write.mode("append").json(path)


def check_probabilities(df: DataFrame, column: str) -> None:
    """Raise if any probability is missing or outside 0..1; one aggregate, one row to the driver."""
    bad = df.agg(F.count_if(F.col(column).isNull() | ~F.col(column).between(0.0, 1.0)).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"{bad} probabilities out of range")
