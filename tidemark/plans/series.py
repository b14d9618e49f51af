"""Daily series, group statistics and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.calendar import second_number
from tidemark.operators import aggregates as ag, series as se
from tidemark.plans.registry import Tables, query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
DAY = "cast(o_orderdate::date as varchar)"


def order_days(t: Tables) -> DataFrame:
    """Daily order totals as the one series ``total``."""
    days = se.daily_totals(t.orders, "o_orderdate", "o_totalprice")
    return days.withColumn("series", F.lit("total"))


def click_events(t: Tables) -> DataFrame:
    return t.events.withColumn("label", (F.col("event_type") == "click").cast("int"))


@query(
    "daily_series_sum",
    """
    select cast(ts::date as varchar) as day, event_type as series, round(sum(value),4) as value from events group by 1,2""",
)
def daily_series_sum(t: Tables) -> DataFrame:
    out = se.daily_totals(t.events, "ts", "value", "event_type")
    return out.select(F.col("day").cast("string").alias("day"), "series", F.round("value", 4).alias("value"))


def _pivot_sql() -> str:
    cols = ", ".join(f"round(sum(case when event_type='{e}' then value end),4) as \"{e}\"" for e in EVENT_TYPES)
    tot = " + ".join(f"coalesce(sum(case when event_type='{e}' then value end),0)" for e in EVENT_TYPES)
    return f"select cast(ts::date as varchar) as day, {cols}, round({tot},4) as total from events group by 1"


@query("daily_pivot", _pivot_sql())
def daily_pivot(t: Tables) -> DataFrame:
    out = se.daily_pivot(t.events, "ts", "event_type", "value", EVENT_TYPES)
    return out.select(
        F.col("day").cast("string").alias("day"), *[F.round(c, 4).alias(c) for c in [*EVENT_TYPES, "total"]]
    )


def _pivot_mean_sql() -> str:
    cols = ", ".join(f"round(avg(case when isodow(o_orderdate)-1={d} then o_totalprice end),6) as d{d}" for d in range(7))
    return f"select year(o_orderdate)||'-W'||lpad(week(o_orderdate)::varchar,2,'0') as week, {cols} from orders group by 1"


@query("pivot_mean", _pivot_mean_sql())
def pivot_mean(t: Tables) -> DataFrame:
    from tidemark.functions.calendar import week_label

    base = t.orders.select(week_label(F.col("o_orderdate")).alias("week"), F.weekday("o_orderdate").alias("d"), "o_totalprice")
    wide = base.groupBy("week").pivot("d", list(range(7))).agg(F.avg("o_totalprice"))
    return wide.select("week", *[F.round(F.col(f"`{d}`"), 6).alias(f"d{d}") for d in range(7)])


@query("value_counts", "select event_type, count(*)::bigint as n from events group by 1")
def value_counts(t: Tables) -> DataFrame:
    return ag.value_counts(t.events, "event_type")


@query(
    "distinct_counts",
    """
    select count(distinct l_returnflag)::bigint as l_returnflag, count(distinct l_suppkey)::bigint as l_suppkey,
      count(distinct l_partkey)::bigint as l_partkey, count(distinct l_shipdate)::bigint as l_shipdate from lineitem""",
)
def distinct_counts(t: Tables) -> DataFrame:
    return ag.distinct_counts(t.lineitem, ["l_returnflag", "l_suppkey", "l_partkey", "l_shipdate"])


@query(
    "describe_series",
    """
    select event_type, count(value)::bigint as n, round(avg(value),6) as mean, round(stddev_samp(value),6) as std, min(value) as min,
      max(value) as max, round(quantile_cont(value,0.25),6) as q25, round(quantile_cont(value,0.5),6) as q50,
      round(quantile_cont(value,0.75),6) as q75 from events group by 1""",
)
def describe_series(t: Tables) -> DataFrame:
    out = ag.describe(t.events, "event_type", "value")
    return out.select("event_type", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query(
    "missing_days",
    """
    with days as (select distinct o_orderdate::date as d from orders), s as (select distinct o_orderpriority as series from orders),
      have as (select distinct o_orderdate::date as d, o_orderpriority as series from orders)
    select s.series, count_if(have.d is null)::bigint as missing, round(count_if(have.d is null)*100.0::double/count(*),6) as pct
    from days cross join s left join have on have.d=days.d and have.series=s.series group by 1""",
)
def missing_days(t: Tables) -> DataFrame:
    from tidemark.operators.cleaning import null_profile

    wide = se.daily_pivot(t.orders, "o_orderdate", "o_orderpriority", "o_totalprice", PRIORITIES)
    out = null_profile(wide, PRIORITIES)
    return out.select(F.col("column").alias("series"), "missing", F.round("pct", 6).alias("pct"))


@query(
    "share_of_total",
    """
    select event_type, round(sum(value),4) as total, round(sum(value)*100/sum(sum(value)) over (),6) as share_pct
    from events group by 1""",
)
def share_of_total(t: Tables) -> DataFrame:
    out = ag.share_of_total(t.events, "event_type", "value")
    return out.select("event_type", F.round("total", 4).alias("total"), F.round("share_pct", 6).alias("share_pct"))


@query(
    "yoy_growth",
    """
    with d as (select o_orderpriority, o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1,2),
      y as (select o_orderpriority, sum(v) filter (year(day)=1997)/count(*) filter (year(day)=1997) as a,
        sum(v) filter (year(day)=1998)/count(*) filter (year(day)=1998) as b from d group by 1)
    select o_orderpriority, round(a,4) as avg_before, round(b,4) as avg_after, round((b-a)/a*100,6) as growth_pct from y""",
)
def yoy_growth(t: Tables) -> DataFrame:
    out = ag.yoy_growth(t.orders, "o_orderpriority", "o_orderdate", "o_totalprice", 1997)
    return out.select(
        "o_orderpriority",
        F.round("avg_before", 4).alias("avg_before"),
        F.round("avg_after", 4).alias("avg_after"),
        F.round("growth_pct", 6).alias("growth_pct"),
    )


@query(
    "volatility_cv",
    """
    with d as (select o_orderpriority as series, o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1,2),
      c as (select series, stddev_samp(v)/avg(v)*100 as cv from d group by 1)
    select series, round(cv,6) as cv, case when cv>30 then 'HIGH' when cv>15 then 'MED' else 'STABLE' end as grade from c""",
)
def volatility_cv(t: Tables) -> DataFrame:
    daily = se.daily_totals(t.orders, "o_orderdate", "o_totalprice", "o_orderpriority")
    return ag.volatility(daily, "series", "value").withColumn("cv", F.round("cv", 6))


@query(
    "weekday_ratio",
    """
    with d as (select o_orderpriority as series, o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1,2),
      m as (select series, avg(v) filter (isodow(day)<6) as a, avg(v) filter (isodow(day)>=6) as b from d group by 1)
    select series, round(a,4) as weekday_mean, round(b,4) as weekend_mean, round(a/b,6) as ratio from m""",
)
def weekday_ratio(t: Tables) -> DataFrame:
    daily = se.daily_totals(t.orders, "o_orderdate", "o_totalprice", "o_orderpriority")
    out = ag.weekday_ratio(daily, "series", "day", "value")
    return out.select(
        "series",
        F.round("weekday_mean", 4).alias("weekday_mean"),
        F.round("weekend_mean", 4).alias("weekend_mean"),
        F.round("ratio", 6).alias("ratio"),
    )


def _corr_sql() -> str:
    cols = ", ".join(f"sum(case when event_type='{e}' then value end) as \"{e}\"" for e in EVENT_TYPES)
    parts = []
    for a in EVENT_TYPES:
        for b in EVENT_TYPES:
            r = "max(1.0::double)" if a == b else f'round(corr("{min(a, b)}","{max(a, b)}"),6)'
            parts.append(f"select '{a}' as a, '{b}' as b, {r} as r from w")
    return f"with w as (select ts::date as day, {cols} from events group by 1) " + " union all ".join(parts)


@query("correlation_matrix", _corr_sql())
def correlation_matrix(t: Tables) -> DataFrame:
    wide = se.daily_pivot(t.events, "ts", "event_type", "value", EVENT_TYPES)
    return ag.correlation_matrix(wide, EVENT_TYPES).withColumn("r", F.round("r", 6))


@query(
    "histogram",
    """
    with s as (select event_type, min(value) lo, max(value) hi from events group by 1)
    select event_type, least(floor((value-lo)/((hi-lo)/30.0)),29)::bigint as bin, count(*)::bigint as n
    from events join s using (event_type) group by 1,2""",
)
def histogram(t: Tables) -> DataFrame:
    out = ag.histogram(t.events, "value", 30, ["event_type"])
    return out.withColumn("bin", F.col("bin").cast("bigint"))


@query(
    "rate_by_dimension",
    """
    with j as (select source, quality from documents join labels using (doc_id))
    select source, count(*)::bigint as n, round(avg(quality),6) as rate, round((select avg(quality) from j),6) as base_rate,
      round(avg(quality)/(select avg(quality) from j),6) as lift from j group by 1""",
)
def rate_by_dimension(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id")
    out = ag.rate_by(joined, "source", "quality")
    return out.select("source", "n", *[F.round(c, 6).alias(c) for c in ("rate", "base_rate", "lift")])


@query(
    "rate_over_time",
    """
    with e as (select *, (event_type='click')::int as y from events)
    select 'day' as grain, cast(ts::date as varchar) as slot, round(avg(y),6) as rate, avg(y)>1.1*(select avg(y) from e) as high
    from e group by 2
    union all select 'hour', lpad(hour(ts)::varchar,2,'0'), round(avg(y),6), avg(y)>1.1*(select avg(y) from e) from e group by 2""",
)
def rate_over_time(t: Tables) -> DataFrame:
    slots = F.array(
        F.struct(F.lit("day").alias("grain"), F.to_date("ts").cast("string").alias("slot")),
        F.struct(F.lit("hour").alias("grain"), F.lpad(F.hour("ts").cast("string"), 2, "0").alias("slot")),
    )
    base = click_events(t).agg(F.avg("label").alias("b")).scalar()
    rates = click_events(t).select("label", F.explode(slots).alias("s")).groupBy("s.grain", "s.slot").agg(F.avg("label").alias("rate"))
    return rates.select("grain", "slot", F.round("rate", 6).alias("rate"), (F.col("rate") > 1.1 * base).alias("high"))


@query(
    "entity_rate_spread",
    """
    with p as (select user_id, avg((event_type='click')::int) as rate from events group by 1)
    select count(*)::bigint as entities, round(avg(rate),6) as mean_rate, round(stddev_samp(rate),6) as std_rate,
      round(min(rate),6) as min_rate, round(max(rate),6) as max_rate from p""",
)
def entity_rate_spread(t: Tables) -> DataFrame:
    out = ag.entity_rate_spread(click_events(t), "user_id", "label")
    return out.select("entities", *[F.round(c, 6).alias(c) for c in ("mean_rate", "std_rate", "min_rate", "max_rate")])


DECILES = """
    with q as (select quantile_cont(value,[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as e from events),
      d as (select event_id, event_type, len(list_filter(list_distinct(e[2:]), lambda x: x > e[1] and x < value))::bigint as decile
        from events, q)"""


@query("qcut_decile", DECILES + " select event_id, decile from d")
def qcut_decile(t: Tables) -> DataFrame:
    out = ag.quantile_bins(t.events.select("event_id", "value"), "value", 10)
    return out.select("event_id", F.col("decile").cast("bigint").alias("decile"))


@query(
    "rate_by_decile",
    DECILES + " select decile, count(*)::bigint as n, round(avg((event_type='click')::int),6) as rate from d group by 1",
)
def rate_by_decile(t: Tables) -> DataFrame:
    out = ag.quantile_bins(click_events(t).select("value", "label"), "value", 10)
    return out.groupBy(F.col("decile").cast("bigint").alias("decile")).agg(
        F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate")
    )


@query(
    "encoding_stability",
    """
    with r as (select user_id, date_trunc('week',ts)::date as w, avg((event_type='click')::int) as rate from events group by 1,2)
    select cast(a.w as varchar) as week, count(*)::bigint as n_keys, round(corr(a.rate,b.rate),6) as stability
    from r a join r b on a.user_id=b.user_id and b.w=a.w+7 group by 1""",
)
def encoding_stability(t: Tables) -> DataFrame:
    out = ag.encoding_stability(click_events(t), "user_id", "ts", "label")
    return out.withColumn("stability", F.round("stability", 6))


@query(
    "shared_values_top",
    """
    select p_name, count(*)::bigint as n from part where trim(p_name)<>'' group by 1 having count(*)>=2
    order by n desc, p_name limit 5""",
)
def shared_values_top(t: Tables) -> DataFrame:
    return ag.frequent_shared(t.part, "p_name")


@query(
    "date_span",
    """
    select cast(min(o_orderdate)::date as varchar) as first_day, cast(max(o_orderdate)::date as varchar) as last_day,
      count(distinct o_orderdate::date)::bigint as days, count(*)::bigint as n_rows from orders""",
)
def date_span(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.agg(
        F.min(day).cast("string").alias("first_day"),
        F.max(day).cast("string").alias("last_day"),
        F.countDistinct(day).alias("days"),
        F.count("*").alias("n_rows"),
    )


@query(
    "length_summary",
    """
    select lang, count(*)::bigint as n, round(avg(length(text)),4) as mean, round(stddev_samp(length(text)),4) as std,
      min(length(text))::bigint as min, max(length(text))::bigint as max, round(quantile_cont(length(text),0.5),4) as q50
    from documents group by 1""",
)
def length_summary(t: Tables) -> DataFrame:
    lengths = t.documents.select("lang", F.length("text").cast("bigint").alias("len"))
    out = ag.describe(lengths, "lang", "len")
    return out.select("lang", "n", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std", "q50")])


@query(
    "shortest_texts",
    "select doc_id, length(text)::bigint as n_chars, lang from documents order by length(text), doc_id limit 10",
)
def shortest_texts(t: Tables) -> DataFrame:
    lengths = t.documents.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "lang")
    return lengths.orderBy("n_chars", "doc_id").limit(10)


# --- windows -----------------------------------------------------------------------------------------------------


@query(
    "rolling_mean_7",
    """
    with d as (select event_type as series, ts::date as day, sum(value) as v from events group by 1,2)
    select cast(day as varchar) as day, series, case when count(v) over w >= 3 then round(avg(v) over w,4) end as rolling_mean
    from d window w as (partition by series order by day rows between 3 preceding and 3 following)""",
)
def rolling_mean_7(t: Tables) -> DataFrame:
    daily = se.daily_totals(t.events, "ts", "value", "event_type")
    out = se.rolling(daily, "day", "value", 7, 3, ["series"])
    return out.select(F.col("day").cast("string").alias("day"), "series", F.round("rolling_mean", 4).alias("rolling_mean"))


STATS14 = """
    with d as (select o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1),
      r as (select day, v, case when count(v) over w >= 5 then avg(v) over w end as m,
        case when count(v) over w >= 5 then stddev_samp(v) over w end as s
        from d window w as (order by day rows between 7 preceding and 6 following)),
      z as (select *, case when s=0 then null else (v-m)/s end as z from r)"""


def order_stats(t: Tables) -> DataFrame:
    return se.rolling(order_days(t), "day", "value", 14, 5, ["series"], std=True)


@query(
    "rolling_stats_14",
    STATS14 + " select cast(day as varchar) as day, round(m,3) as rolling_mean, round(s,3) as rolling_std from r",
)
def rolling_stats_14(t: Tables) -> DataFrame:
    return order_stats(t).select(
        F.col("day").cast("string").alias("day"),
        F.round("rolling_mean", 3).alias("rolling_mean"),
        F.round("rolling_std", 3).alias("rolling_std"),
    )


@query(
    "zscore_anomalies",
    STATS14 + " select cast(day as varchar) as day, round(v,2) as value, round(z,5) as z from z where abs(z)>2",
)
def zscore_anomalies(t: Tables) -> DataFrame:
    out = se.zscores(order_stats(t)).where(F.abs("z") > 2)
    return out.select(F.col("day").cast("string").alias("day"), F.round("value", 2).alias("value"), F.round("z", 5).alias("z"))


@query(
    "anomaly_band",
    STATS14
    + """ select cast(day as varchar) as day, round(m+2*s,3) as upper, round(m-2*s,3) as lower,
      case when v>m+2*s then 'high' when v<m-2*s then 'low' else 'normal' end as side from z""",
)
def anomaly_band(t: Tables) -> DataFrame:
    out = se.anomaly_bands(order_stats(t))
    return out.select(
        F.col("day").cast("string").alias("day"), F.round("upper", 3).alias("upper"), F.round("lower", 3).alias("lower"), "side"
    )


@query(
    "top_bottom_anomalies",
    STATS14
    + """ select cast(day as varchar) as day, round(z,5) as z from (
      (select day, z from z where abs(z)>2 order by z desc, day limit 8) union
      (select day, z from z where abs(z)>2 order by z, day limit 7))""",
)
def top_bottom_anomalies(t: Tables) -> DataFrame:
    found = se.zscores(order_stats(t)).where(F.abs("z") > 2).select("day", "z")
    out = se.top_and_bottom(found, "z", "day", 8, 7)
    return out.select(F.col("day").cast("string").alias("day"), F.round("z", 5).alias("z"))


@query(
    "holiday_join",
    """
    with d as (select o_orderdate::date as day, sum(o_totalprice) as v from orders group by 1),
      h as (select distinct o_orderdate::date as day, case when month(o_orderdate)=1 then 'New Year' else 'Labour Day' end as holiday
        from orders where (month(o_orderdate)=1 and day(o_orderdate)=1) or (month(o_orderdate)=5 and day(o_orderdate)=1))
    select cast(d.day as varchar) as day, round(v,2) as value, holiday, (holiday is not null)::int::bigint as is_holiday
    from d left join h using (day)""",
)
def holiday_join(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    calendar = t.orders.select(
        day.alias("day"),
        F.when(F.date_format(day, "MM-dd") == "01-01", "New Year").when(F.date_format(day, "MM-dd") == "05-01", "Labour Day").alias("holiday"),
    ).where("holiday is not null")
    out = se.mark_holidays(order_days(t), calendar)
    return out.select(
        F.col("day").cast("string").alias("day"), F.round("value", 2).alias("value"), "holiday",
        F.col("is_holiday").cast("bigint").alias("is_holiday"),
    )


def sensor_windows(t: Tables) -> DataFrame:
    """Events as recordings: one file per user, ordered by time, 20 rows per window."""
    rows = t.events.select(
        "user_id", "ts", "event_id", "value", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k")
    )
    return se.fixed_row_windows(rows, "user_id", ["ts", "event_id"], 20, second_number(F.col("ts")))


WINDOWS = """
    with r as (select *, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as c,
        regexp_extract(props,'([0-9]+)',1)::int as k from events),
      w as (select *, ((rn-1)//20)::bigint as window_id from r where (rn-1)//20 < c//20 - 1)"""


@query("fixed_row_windows", WINDOWS + " select event_id, user_id, rn::bigint as rn, window_id from w")
def fixed_row_windows(t: Tables) -> DataFrame:
    return sensor_windows(t).select("event_id", "user_id", F.col("rn").cast("bigint").alias("rn"), "window_id")


@query(
    "window_features",
    WINDOWS
    + """ select user_id, window_id, round(stddev_samp(value),5) as value_std, round(stddev_samp(k),5) as k_std,
      round(avg(value),5) as value_mean, arg_min(event_type, rn) as label from w group by 1,2""",
)
def window_features(t: Tables) -> DataFrame:
    out = se.window_features(sensor_windows(t), "user_id", ["value", "k"], ["value"], "event_type")
    return out.select(
        "user_id", "window_id", *[F.round(c, 5).alias(c) for c in ("value_std", "k_std", "value_mean")], "label"
    )
