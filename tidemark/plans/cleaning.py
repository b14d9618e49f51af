"""Cleaning, calendar and filter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import calendar as cal, numbers as num, text as tx
from tidemark.operators import cleaning as cl
from tidemark.plans.registry import Tables, query
from tidemark.sources import readers as rd


def long_(c):
    return c.cast("bigint")


def docs_with_labels(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


@query(
    "choices_to_map",
    "select p_partkey, '1. '||p_name||chr(10)||'2. '||p_brand||chr(10)||'3. '||p_type as choices, p_brand as second, "
    "3::bigint as n_choices from part",
)
def choices_to_map(t: Tables) -> DataFrame:
    from tidemark.operators.retrieval import choices_text

    df = rd.choices_to_map(t.part, ["p_name", "p_brand", "p_type"])
    return df.select(
        "p_partkey",
        choices_text(F.col("choices")).alias("choices"),
        F.col("choices")["2"].alias("second"),
        long_(F.size(F.map_keys("choices"))).alias("n_choices"),
    )


@query(
    "file_skip_nth",
    """
    with files as (select user_id, row_number() over (order by user_id) r from (select distinct user_id from events))
    select e.user_id, count(*)::bigint as n_rows from events e join files f using (user_id) where r <> 38
    group by e.user_id""",
)
def file_skip_nth(t: Tables) -> DataFrame:
    return rd.skip_nth_file(t.events, "user_id", 38).groupBy("user_id").agg(F.count("*").alias("n_rows"))


@query(
    "id_to_path_join",
    """
    select conv_id||'_'||turn as id, 'documents/'||conv_id||'.txt' as path, n_chars
    from conversations left join documents on doc_id = conv_id""",
)
def id_to_path_join(t: Tables) -> DataFrame:
    template = t.conversations.select(F.concat_ws("_", "conv_id", "turn").alias("id"))
    files = t.documents.select(F.concat(F.lit("documents/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "n_chars")
    return rd.join_by_path(template, "id", "documents/{0}.txt", files, "path").select("id", "path", "n_chars")


PREFIXES = [("red", "Red"), ("blue", "Blue"), ("green", "Green"), ("small", "Small"), ("large", "Large")]


@query(
    "label_from_prefix",
    """
    select coalesce(case when p_name like 'red%' then 'Red' when p_name like 'blue%' then 'Blue'
      when p_name like 'green%' then 'Green' when p_name like 'small%' then 'Small'
      when p_name like 'large%' then 'Large' end, '(unmatched)') as label, count(*)::bigint as n
    from part group by 1""",
)
def label_from_prefix(t: Tables) -> DataFrame:
    label = rd.label_from_prefix(F.col("p_name"), PREFIXES)
    return t.part.groupBy(F.coalesce(label, F.lit("(unmatched)")).alias("label")).agg(F.count("*").alias("n"))


@query(
    "label_from_keyword",
    """
    select page_id, case when contains(lower(url),'blog') then 'blog' when contains(lower(url),'/fr/') then 'french'
      when contains(lower(url),'/de/') then 'german' when contains(lower(url),'.html') then 'file' end as label
    from pages where not contains(lower(url),'#top') and not contains(lower(url),'ref=')""",
)
def label_from_keyword(t: Tables) -> DataFrame:
    kept = rd.drop_paths_with(t.pages.select("page_id", "url"), "url", ["#top", "ref="])
    words = [("blog", "blog"), ("/fr/", "french"), ("/de/", "german"), (".html", "file")]
    return kept.select("page_id", rd.label_from_keyword(F.col("url"), words).alias("label"))


@query(
    "parse_dayfirst",
    """
    select o_orderkey, cast(try_strptime(case when o_orderstatus='P' then '31/02/'||year(o_orderdate)
      else strftime(o_orderdate,'%-d/%-m/%Y') end, '%d/%m/%Y')::date as varchar) as day from orders""",
)
def parse_dayfirst(t: Tables) -> DataFrame:
    text = F.when(
        F.col("o_orderstatus") == "P", F.concat(F.lit("31/02/"), F.year("o_orderdate").cast("string"))
    ).otherwise(F.date_format("o_orderdate", "d/M/yyyy"))
    return t.orders.select("o_orderkey", cal.parse_dayfirst(text).cast("string").alias("day"))


@query(
    "parse_thousands",
    """
    select o_orderkey, case when o_orderstatus='P' then null else round(o_totalprice,2) end as volume from orders""",
)
def parse_thousands(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" "))
    )
    return t.orders.select("o_orderkey", F.round(num.parse_thousands(text), 2).alias("volume"))


@query(
    "null_profile",
    """
    with d as (select * from documents left join labels using (doc_id))
    select 'quality' as "column", count_if(quality is null)::bigint as missing,
      round(count_if(quality is null)*100.0::double/count(*),6) as pct from d
    union all select 'toxic', count_if(toxic is null)::bigint, round(count_if(toxic is null)*100.0::double/count(*),6) from d
    union all select 'lang', count_if(lang is null)::bigint, round(count_if(lang is null)*100.0::double/count(*),6) from d""",
)
def null_profile(t: Tables) -> DataFrame:
    out = cl.null_profile(docs_with_labels(t), ["quality", "toxic", "lang"])
    return out.withColumn("pct", F.round("pct", 6))


@query("drop_null_target", "select doc_id, quality, toxic from documents join labels using (doc_id) where quality is not null")
def drop_null_target(t: Tables) -> DataFrame:
    return docs_with_labels(t).dropna(subset=["quality"]).select("doc_id", "quality", "toxic")


@query("fill_default", "select doc_id, coalesce(quality,-1) as quality, coalesce(toxic,0) as toxic from documents left join labels using (doc_id)")
def fill_default(t: Tables) -> DataFrame:
    return docs_with_labels(t).na.fill({"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


@query(
    "blank_to_default",
    "select doc_id, case when lang in ('de','es') then 'unknown' else trim(source) end as source from documents",
)
def blank_to_default(t: Tables) -> DataFrame:
    raw = F.when(F.col("lang") == "de", F.lit("  ")).when(F.col("lang") == "es", F.lit(None)).otherwise(F.col("source"))
    return t.documents.select("doc_id", tx.blank_to_default(raw, "unknown").alias("source"))


@query(
    "integrity_report",
    """
    with o as (select o_totalprice - 2000 < 0 as a, year(o_orderdate) not between 1996 and 2000 as b,
      o_orderstatus='P' and o_orderpriority='5-LOW' as c from orders)
    select 'negative' as rule, count_if(a)::bigint as n_rows from o union all
    select 'year_out_of_range', count_if(b)::bigint from o union all
    select 'unit_mismatch', count_if(c)::bigint from o union all
    select 'kept', count_if(not (a or b or c))::bigint from o""",
)
def integrity_report(t: Tables) -> DataFrame:
    rules = {
        "negative": F.col("o_totalprice") - 2000 < 0,
        "year_out_of_range": ~F.year("o_orderdate").between(1996, 2000),
        "unit_mismatch": (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"),
    }
    return cl.integrity_report(t.orders, rules)


@query(
    "structural_null_check",
    """
    select 'quality' as rule, count_if((quality is null) <> (lang = 'en'))::bigint as violations
    from documents left join labels using (doc_id)
    union all select 'toxic', count_if((toxic is null) <> (quality is null))::bigint
    from documents left join labels using (doc_id)""",
)
def structural_null_check(t: Tables) -> DataFrame:
    rules = {"quality": ("quality", F.col("lang") == "en"), "toxic": ("toxic", F.col("quality").isNull())}
    return cl.structural_null_check(docs_with_labels(t), rules)


@query(
    "filter_isin",
    """
    select event_type, count(*)::bigint as kept, (select count(*) from events where event_type not in ('click','view'))::bigint
      as removed from events where event_type in ('click','view') group by 1""",
)
def filter_isin(t: Tables) -> DataFrame:
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("kept"))
    wanted = F.col("event_type").isin("click", "view")
    removed = counts.where(~wanted).agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("r")).scalar()
    return counts.where(wanted).withColumn("removed", removed)


@query(
    "recode_map",
    """
    select event_id, case event_type when 'click' then 'Interaction' when 'view' then 'Impression'
      when 'purchase' then 'Sale' end as series from events""",
)
def recode_map(t: Tables) -> DataFrame:
    mapping = {"click": "Interaction", "view": "Impression", "purchase": "Sale"}
    return t.events.select("event_id", cl.recode(F.col("event_type"), mapping).alias("series"))


@query(
    "calendar_features",
    """
    select o_orderkey, year(o_orderdate)::bigint as year, month(o_orderdate)::bigint as month,
      week(o_orderdate)::bigint as iso_week, (isodow(o_orderdate)-1)::bigint as weekday,
      (isodow(o_orderdate)>=6)::int::bigint as is_weekend from orders""",
)
def calendar_features(t: Tables) -> DataFrame:
    cols = cal.calendar_columns(F.col("o_orderdate"))
    names = ["year", "month", "iso_week", "weekday", "is_weekend"]
    return t.orders.select("o_orderkey", *cols).select("o_orderkey", *[long_(F.col(n)).alias(n) for n in names])


@query(
    "week_label",
    """
    select year(o_orderdate)||'-W'||lpad(week(o_orderdate)::varchar,2,'0') as week, count(*)::bigint as n,
      round(sum(o_totalprice),2) as total from orders group by 1""",
)
def week_label(t: Tables) -> DataFrame:
    return t.orders.groupBy(cal.week_label(F.col("o_orderdate")).alias("week")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "week_period",
    """
    select cast(date_trunc('week',o_orderdate)::date as varchar)||'/'||cast((date_trunc('week',o_orderdate)::date + 6) as varchar)
      as period, count(*)::bigint as n from orders group by 1""",
)
def week_period(t: Tables) -> DataFrame:
    return t.orders.groupBy(cal.week_period(F.col("o_orderdate")).alias("period")).agg(F.count("*").alias("n"))


@query(
    "coalesce_channel",
    """
    select doc_id, coalesce(quality::varchar, case when lang='en' then null else source end, 'unknown') as channel
    from documents left join labels using (doc_id)""",
)
def coalesce_channel(t: Tables) -> DataFrame:
    second = F.when(F.col("lang") != "en", F.col("source"))
    return docs_with_labels(t).select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), second, F.lit("unknown")).alias("channel")
    )


@query(
    "cut_time_of_day",
    """
    select case when hour(ts)<=5 then 'night' when hour(ts)<=11 then 'morning' when hour(ts)<=17 then 'afternoon'
      else 'evening' end as time_of_day, hour(ts)::bigint as hour, count(*)::bigint as n from events group by 1,2""",
)
def cut_time_of_day(t: Tables) -> DataFrame:
    from tidemark.operators.features import HOUR_EDGES, HOUR_NAMES

    hour = F.hour("ts")
    return t.events.groupBy(
        num.cut(hour, HOUR_EDGES, HOUR_NAMES).alias("time_of_day"), long_(hour).alias("hour")
    ).agg(F.count("*").alias("n"))


@query(
    "cyclic_hour",
    """
    select event_id, round(sin(2*pi()*hour(ts)/24),6) as hour_sin, round(cos(2*pi()*hour(ts)/24),6) as hour_cos from events""",
)
def cyclic_hour(t: Tables) -> DataFrame:
    s, c = cal.cyclic(F.hour("ts"), 24)
    return t.events.select("event_id", F.round(s, 6).alias("hour_sin"), F.round(c, 6).alias("hour_cos"))


@query(
    "hour_flags",
    """
    select (strftime(ts,'%a') in ('Sat','Sun'))::int::bigint as is_weekend, (hour(ts) between 18 and 21)::int::bigint as is_peak_hour,
      count(*)::bigint as n from events group by 1,2""",
)
def hour_flags(t: Tables) -> DataFrame:
    day = F.date_format("ts", "EEE")
    return t.events.groupBy(
        long_(day.isin("Sat", "Sun")).alias("is_weekend"), long_(F.hour("ts").between(18, 21)).alias("is_peak_hour")
    ).agg(F.count("*").alias("n"))


CROSSES = [
    ("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"),
    ("l_discount", "l_returnflag"), ("l_tax", "l_returnflag"), ("ship_year", "l_linestatus"), ("ship_year", "l_linenumber"),
]


def _cross_sql() -> str:
    parts = []
    for a, b in CROSSES:
        parts.append(f"select '{a}_x_{b}' as feature, {a}||'_'||{b} as value, count(*)::bigint as n from l group by 2")
    return (
        "with l as (select l_returnflag, l_linestatus, l_linenumber::varchar as l_linenumber, "
        "round(l_discount*100)::int::varchar as l_discount, round(l_tax*100)::int::varchar as l_tax, "
        "year(l_shipdate)::varchar as ship_year from lineitem) " + " union all ".join(parts)
    )


@query("feature_cross", _cross_sql())
def feature_cross(t: Tables) -> DataFrame:
    base = t.lineitem.select(
        "l_returnflag", "l_linestatus", "l_linenumber",
        F.round(F.col("l_discount") * 100).cast("int").alias("l_discount"),
        F.round(F.col("l_tax") * 100).cast("int").alias("l_tax"),
        F.year("l_shipdate").alias("ship_year"),
    )
    crossed = cl.feature_crosses(base, CROSSES)
    names = [f"{a}_x_{b}" for a, b in CROSSES]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    return crossed.select(F.explode(pairs).alias("e")).groupBy("e.feature", "e.value").agg(F.count("*").alias("n"))


@query(
    "binarize_flags",
    """
    select (case l_returnflag when 'R' then 1 when 'N' then 0 end)::bigint as flag, (l_quantity)::bigint as quantity,
      count(*)::bigint as n from lineitem group by 1,2""",
)
def binarize_flags(t: Tables) -> DataFrame:
    df = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))
    out = cl.binarize(df, ["flag", "quantity"], yes="R", no="N")
    return out.groupBy(long_(F.col("flag")).alias("flag"), long_(F.col("quantity")).alias("quantity")).agg(
        F.count("*").alias("n")
    )


@query(
    "threshold_ladder",
    """
    select c_custkey, case when c_acctbal<0 then 'Under' when c_acctbal<2500 then 'Normal' when c_acctbal<7500 then 'Over'
      else 'High' end as grade from customer""",
)
def threshold_ladder(t: Tables) -> DataFrame:
    steps = [(0, "Under"), (2500, "Normal"), (7500, "Over")]
    return t.customer.select("c_custkey", num.ladder(F.col("c_acctbal"), steps, "High").alias("grade"))


@query(
    "compound_flag",
    """
    select l_linenumber::bigint as l_linenumber, (l_quantity>=30 and l_returnflag='N')::int::bigint as risk, count(*)::bigint as n
    from lineitem group by 1,2""",
)
def compound_flag(t: Tables) -> DataFrame:
    risk = long_((F.col("l_quantity") >= 30) & (F.col("l_returnflag") == "N"))
    return t.lineitem.groupBy(long_(F.col("l_linenumber")).alias("l_linenumber"), risk.alias("risk")).agg(F.count("*").alias("n"))


@query(
    "align_columns",
    "select l_linestatus, 0::bigint as absent, l_returnflag, l_quantity, l_orderkey from lineitem",
)
def align_columns(t: Tables) -> DataFrame:
    wanted = ["l_linestatus", "absent", "l_returnflag", "l_quantity", "l_orderkey"]
    return cl.align_columns(t.lineitem, wanted).withColumn("absent", long_(F.col("absent")))


@query(
    "normalize_extension",
    "select s_suppkey, case when s_acctbal<1000 then 'n/a' else (70000+s_suppkey)::varchar end as ext from supplier",
)
def normalize_extension(t: Tables) -> DataFrame:
    raw = F.when(F.col("s_acctbal") < 1000, F.lit("n/a")).otherwise(
        F.concat((F.col("s_suppkey") + 70000).cast("string"), F.lit(".0"))
    )
    return t.supplier.select("s_suppkey", num.normalize_extension(raw).alias("ext"))


@query("digits_only", "select c_custkey, regexp_replace(c_name,'[^0-9]','','g') as digits from customer")
def digits_only(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.digits_only(F.col("c_name")).alias("digits"))


@query(
    "parse_bracket_label",
    """
    select event_id, try_cast(regexp_extract(props,'([0-9]+)',1) as bigint) as label from events""",
)
def parse_bracket_label(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1)
    raw = F.when(F.col("event_type") == "view", k).otherwise(F.concat(F.lit("["), k, F.lit("]")))
    return t.events.select("event_id", long_(num.parse_bracket_label(raw)).alias("label"))


@query(
    "split_id_parts",
    "select p_partkey, split_part(p_brand||'_'||p_size,'_',1) as subject, split_part(p_brand||'_'||p_size,'_',2) as part_no from part",
)
def split_id_parts(t: Tables) -> DataFrame:
    parts = F.split(F.concat_ws("_", "p_brand", "p_size"), "_")
    return t.part.select("p_partkey", parts[0].alias("subject"), parts[1].alias("part_no"))


@query(
    "text_after_marker",
    """
    select page_id, trim(string_split(url,'://')[-1]) as address,
      regexp_replace(regexp_extract(url,'([^/?#]*)(?:[?#].*)?$',1),'\\.[^.]*$','') as stem from pages""",
)
def text_after_marker(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", tx.text_after(F.col("url"), "://").alias("address"), tx.path_stem(F.col("url")).alias("stem")
    )


@query(
    "box_normalize",
    """
    select l_linenumber::bigint as l_linenumber, round(avg((l_quantity*2+l_discount*100)/2.0/200),6) as cx,
      round(avg((l_tax*100+20)/2.0/100),6) as cy, round(avg(l_discount*100/200),6) as bw, round(avg((20-l_tax*100)/100),6) as bh
    from lineitem group by 1""",
)
def box_normalize(t: Tables) -> DataFrame:
    x0, y0 = F.col("l_quantity"), F.col("l_tax") * 100
    x1, y1 = F.col("l_quantity") + F.col("l_discount") * 100, F.lit(20.0)
    boxes = t.lineitem.select(
        long_(F.col("l_linenumber")).alias("l_linenumber"), *num.box_to_center(x0, y0, x1, y1, F.lit(200.0), F.lit(100.0))
    )
    return boxes.groupBy("l_linenumber").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("cx", "cy", "bw", "bh")])


@query(
    "tile_grid",
    """
    with p as (select p_partkey, p_size*16 as iw, p_size*12 as ih from part)
    select p_partkey, 0::bigint as x, 0::bigint as y, iw::bigint as w, ih::bigint as h from p
    union all select p_partkey, xs.x::bigint, ys.y::bigint, 128::bigint, 128::bigint
    from p, unnest(range(0, iw-128+1, 64)) xs(x), unnest(range(0, ih-128+1, 64)) ys(y) where iw>=128 and ih>=128""",
)
def tile_grid(t: Tables) -> DataFrame:
    tiles = cl.tile_grid(t.part.select("p_partkey", "p_size"), F.col("p_size") * 16, F.col("p_size") * 12, 128, 64)
    return tiles.select("p_partkey", *[long_(F.col(c)).alias(c) for c in ("x", "y", "w", "h")])


@query("union_years", """
    select cast(o_orderdate::date as varchar) as day, o_orderpriority as series, round(sum(o_totalprice),2) as volume
    from orders where year(o_orderdate) in (1996,1997) group by 1,2""")
def union_years(t: Tables) -> DataFrame:
    one = t.orders.where(F.year("o_orderdate") == 1996)
    two = t.orders.where(F.year("o_orderdate") == 1997)
    both = one.unionByName(two)
    return both.groupBy(F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderpriority").alias("series")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("volume")
    )


@query(
    "duplicate_count",
    "select count(*)::bigint as n_rows, (count(*)-count(distinct md5(text)))::bigint as n_duplicates from documents",
)
def duplicate_count(t: Tables) -> DataFrame:
    return cl.duplicate_count(t.documents.select(F.md5("text").alias("h")), ["h"])


@query(
    "dedup_keep_first",
    """
    select doc_id, lang, source from (select *, row_number() over (partition by md5(text) order by doc_id) r from documents)
    where r=1""",
)
def dedup_keep_first(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", "lang", "source", F.md5("text").alias("h"))
    return cl.dedup_keep_first(df, ["h"], ["doc_id"]).drop("h")


@query(
    "grep_all_columns",
    """
    with h as (select * from part where contains(lower(concat_ws(chr(1),p_partkey,p_name,p_brand,p_type,p_size,p_retailprice)),'ring'))
    select p_partkey, p_name, (select count(*) from h)::bigint as total, (select count(*)>50 from h) as truncated
    from h order by p_partkey limit 50""",
)
def grep_all_columns(t: Tables) -> DataFrame:
    hits = cl.grep_columns(t.part, "RING")
    return cl.limited_with_total(hits.select("p_partkey", "p_name"), ["p_partkey"], 50)


@query(
    "limited_with_total",
    """
    select p_partkey, p_name, (select count(*) from part where p_size>25)::bigint as total,
      (select count(*)>20 from part where p_size>25) as truncated
    from part where p_size>25 order by p_name, p_partkey limit 20""",
)
def limited_with_total(t: Tables) -> DataFrame:
    return cl.limited_with_total(t.part.where("p_size > 25").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 20)


@query(
    "known_categories",
    """
    select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select p_partkey from part where p_size>25)""",
)
def known_categories(t: Tables) -> DataFrame:
    known = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return cl.known_only(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), known, "l_partkey")


@query(
    "template_fill",
    """
    select doc_id, coalesce(quality,-1)::bigint as label, (select count(*) from documents d anti join labels l using (doc_id))::bigint
      as n_missing from documents left join labels using (doc_id)""",
)
def template_fill(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    missing = joined.agg(F.count_if(F.col("quality").isNull()).alias("m")).scalar()
    return joined.select("doc_id", long_(F.coalesce("quality", F.lit(-1))).alias("label"), missing.alias("n_missing"))


@query(
    "coverage_pct",
    """
    select 'source' as "column", round(avg((case when lang='de' then '' else source end <> '')::int)*100,6) as pct from documents
    union all select 'lang', round(avg((lang<>'')::int)*100,6) from documents""",
)
def coverage_pct(t: Tables) -> DataFrame:
    df = t.documents.select("lang", F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias("source"))
    return cl.coverage(df, ["source", "lang"]).withColumn("pct", F.round("pct", 6))


@query(
    "strip_blocks",
    "select page_id, trim(regexp_replace(html,'<script>.*?</script>','','gs')) as html from pages",
)
def strip_blocks(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.strip_blocks(F.col("html"), "script").alias("html"))


@query(
    "category_from_path",
    """
    select page_id, case when contains(lower(url),'product') then 'Product' when contains(lower(url),'polic') then 'Policy'
      when contains(lower(url),'store') then 'Store Info' else 'General' end as category from
      (select page_id, case when contains(url,'/en/') then 'shop/products/'||url when contains(url,'/fr/') then 'policies/'||url
        when contains(url,'/de/') then 'Stores/'||url else url end as url from pages)""",
)
def category_from_path(t: Tables) -> DataFrame:
    url = F.col("url")
    path = (
        F.when(url.contains("/en/"), F.concat(F.lit("shop/products/"), url))
        .when(url.contains("/fr/"), F.concat(F.lit("policies/"), url))
        .when(url.contains("/de/"), F.concat(F.lit("Stores/"), url))
        .otherwise(url)
    )
    return t.pages.select("page_id", tx.category_from_path(path).alias("category"))
