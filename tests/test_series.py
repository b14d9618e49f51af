import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal, numbers as num
from tidemark.operators import aggregates as ag, series as se


def days(n):
    return [dt.date(2025, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def test_rolling_matches_centred_pandas(spark):
    values = [float((i * 7) % 11) for i in range(20)]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(days(20), values)], "series string, day date, value double")
    for size, least in ((7, 3), (14, 5)):
        out = se.rolling(df, "day", "value", size, least, ["series"], std=True).orderBy("day").toPandas()
        want = pd.Series(values).rolling(size, center=True, min_periods=least)
        np.testing.assert_allclose(out["rolling_mean"].to_numpy(float), want.mean().to_numpy(), atol=1e-9)
        np.testing.assert_allclose(out["rolling_std"].to_numpy(float), want.std().to_numpy(), atol=1e-9)


def test_rolling_needs_enough_rows_and_zscore_survives_zero_spread(spark):
    df = spark.createDataFrame([("a", d, 1.0) for d in days(2)] + [("b", d, 5.0) for d in days(6)], "series string, day date, value double")
    out = se.zscores(se.rolling(df, "day", "value", 7, 3, ["series"], std=True))
    assert out.where("series = 'a' and rolling_mean is not null").count() == 0
    assert out.where("series = 'b' and rolling_std = 0 and z is null").count() == 6


def test_fixed_windows_drop_the_last_full_one(spark):
    rows = [("f", i, float(i)) for i in range(3 * 480 + 10)]
    df = spark.createDataFrame(rows, "file string, pos int, v double")
    kept = se.fixed_row_windows(df, "file", ["pos"], 480, F.col("pos"))
    assert {r["window_id"]: r["count"] for r in kept.groupBy("window_id").count().collect()} == {0: 480, 1: 480}
    every = se.fixed_row_windows(df, "file", ["pos"], 480, F.col("pos"), drop_last_full=False)
    assert every.select("window_id").distinct().count() == 3
    feats = se.window_features(kept, "file", ["v"], ["v"], "pos").orderBy("window_id").collect()
    assert [r["label"] for r in feats] == [0, 480]


def test_week_label_keeps_calendar_year(spark):
    row = spark.createDataFrame([(dt.date(2025, 12, 29),)], "d date").select(cal.week_label(F.col("d")), cal.week_period(F.col("d"))).first()
    assert tuple(row) == ("2025-W01", "2025-12-29/2026-01-04")


def test_bad_dates_and_numbers_become_null(spark):
    df = spark.createDataFrame([("31/02/2025", "1,234"), ("zz", " 5 "), ("1/3/2025", "x"), (None, None)], "d string, n string")
    out = df.select(cal.parse_dayfirst(F.col("d")), num.parse_thousands(F.col("n"))).collect()
    assert [tuple(r) for r in out] == [(None, 1234.0), (None, 5.0), (dt.date(2025, 3, 1), None), (None, None)]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(i,) for i in (-1, 0, 5, 6, 11, 12, 23, 24)], "h int")
    got = [r[0] for r in df.select(num.cut(F.col("h"), [-1, 5, 11, 17, 23], ["night", "morning", "afternoon", "evening"])).collect()]
    assert got == [None, "night", "night", "morning", "morning", "afternoon", "evening", None]


def test_pivot_keeps_nulls_and_totals_zero_fill(spark):
    ts = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(ts, "a", 2.0), (ts, "a", 3.0)], "ts timestamp_ntz, s string, v double")
    row = se.daily_pivot(df, "ts", "s", "v", ["a", "b"]).first()
    assert (row["a"], row["b"], row["total"]) == (5.0, None, 5.0)


def test_volatility_grades(spark):
    rows = [("h", v) for v in (1.0, 9.0)] + [("m", v) for v in (8.0, 10.0)] + [("s", v) for v in (10.0, 10.1)]
    out = ag.volatility(spark.createDataFrame(rows, "k string, v double"), "k", "v")
    assert {r["k"]: r["grade"] for r in out.collect()} == {"h": "HIGH", "m": "MED", "s": "STABLE"}


def test_top_and_bottom_do_not_repeat_rows(spark):
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days(10))], "day date, z double")
    out = se.top_and_bottom(df, "z", "day", 8, 7).toPandas()
    assert len(out) == 10 and list(out["day"]) == sorted(out["day"])


def test_rolling_in_blocks_equals_one_window(spark):
    rows = [(k, i, float((i * 31) % 17)) for k, n in (("hot", 900), ("cold", 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    for size, least in ((7, 3), (14, 5)):
        plain = se.rolling(df, "i", "v", size, least, ["k"], std=True)
        cut = se.rolling(df, "i", "v", size, least, ["k"], std=True, position=F.col("i"), block=64)
        a, b = (x.orderBy("k", "i").toPandas() for x in (plain, cut.select(*plain.columns)))
        pd.testing.assert_frame_equal(a, b)
