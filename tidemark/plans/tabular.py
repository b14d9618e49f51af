"""Target encoding, label encoding, split and sampling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import features as ft
from tidemark.plans.registry import Tables, query
from tidemark.plans.series import click_events

CUT = "2024-01-21"


@query(
    "smoothed_target_encoding",
    """
    with b as (select *, (l_returnflag='R')::int as y from lineitem), g as (select avg(y) as g from b),
      s as (select l_suppkey, (sum(y)+15*max(g))/(count(*)+15) as te from b, g group by 1),
      n as (select l_linenumber, (sum(y)+5*max(g))/(count(*)+5) as te from b, g group by 1)
    select l_orderkey, l_partkey, l_quantity, round(s.te,6) as l_suppkey_te, round(n.te,6) as l_linenumber_te
    from b join s using (l_suppkey) join n using (l_linenumber)""",
)
def smoothed_target_encoding(t: Tables) -> DataFrame:
    df = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_quantity", "l_suppkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    enc = ft.SmoothedTargetEncoder(["l_suppkey", "l_linenumber"], {"l_linenumber": 5}).fit(df, "y")
    out = enc.transform(df)
    return out.select(
        "l_orderkey", "l_partkey", "l_quantity",
        F.round("l_suppkey_te", 6).alias("l_suppkey_te"), F.round("l_linenumber_te", 6).alias("l_linenumber_te"),
    )


@query(
    "te_train_apply",
    f"""
    with b as (select event_id, user_id, hour(ts) as hour, (event_type='click')::int as y, ts < timestamp '{CUT}' as train from events),
      g as (select avg(y) as g from b where train),
      u as (select user_id, (sum(y)+15*max(g))/(count(*)+15) as te from b, g where train group by 1),
      h as (select hour, (sum(y)+5*max(g))/(count(*)+5) as te from b, g where train group by 1)
    select event_id, round(coalesce(u.te,g),6) as user_id_te, round(coalesce(h.te,g),6) as hour_te
    from b cross join g left join u using (user_id) left join h using (hour) where not train""",
)
def te_train_apply(t: Tables) -> DataFrame:
    base = click_events(t).select("event_id", "user_id", F.hour("ts").alias("hour"), "label", "ts")
    split = ft.time_split(base, "ts", CUT)
    enc = ft.SmoothedTargetEncoder(["user_id", "hour"], {"hour": 5}).fit(split.where("split = 'train'"), "label")
    out = enc.transform(split.where("split = 'validation'"))
    return out.select("event_id", F.round("user_id_te", 6).alias("user_id_te"), F.round("hour_te", 6).alias("hour_te"))


@query(
    "label_encoding",
    """
    with c as (select o_orderpriority, row_number() over (order by o_orderpriority)-1 as code
      from (select distinct o_orderpriority from orders where o_orderpriority<>'5-LOW'))
    select o_orderkey, coalesce(code,0)::bigint as code from orders left join c using (o_orderpriority)""",
)
def label_encoding(t: Tables) -> DataFrame:
    codes = ft.label_codes(t.orders.where("o_orderpriority <> '5-LOW'"), "o_orderpriority")
    out = ft.label_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", codes, "code")
    return out.select("o_orderkey", F.col("code").cast("bigint").alias("code"))


TE_COLS = ["user_id", "hour", "time_of_day"]
CROSSES = [("hour", "day_of_week"), ("time_of_day", "is_weekend")]
ALPHAS = {"user_id": 40.0, "hour": 5.0, "time_of_day": 5.0}


def event_base(t: Tables) -> DataFrame:
    base = click_events(t).select(
        "event_id", "ts", "user_id", "value", "label",
        F.hour("ts").alias("hour"),
        F.date_format("ts", "EEE").alias("day_of_week"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    return ft.time_features(base, "hour", "day_of_week")


def event_features(t: Tables) -> tuple[DataFrame, DataFrame]:
    split = ft.time_split(event_base(t), "ts", CUT)
    train, other = (split.where(F.col("split") == s) for s in ("train", "validation"))
    return ft.make_features(train, other, "label", TE_COLS, CROSSES, ["day_of_week"], ["ts"], ALPHAS)


def _matrix_sql() -> str:
    keys = {
        "user_id": ("user_id", 40), "hour": ("hour", 5), "time_of_day": ("tod", 5),
        "hour_x_day_of_week": ("hour||'_'||dow", 15), "time_of_day_x_is_weekend": ("tod||'_'||we", 15),
    }
    ctes, joins, cols = [], [], []
    for i, (name, (expr, alpha)) in enumerate(keys.items()):
        ctes.append(
            f"e{i} as (select {expr} as key, (sum(label)+{alpha}*max(g))/(count(*)+{alpha}) as te from b, g where train group by 1)"
        )
        joins.append(f"left join e{i} on e{i}.key = {expr}")
        cols.append(f"round(coalesce(e{i}.te,g),6) as {name}_te")
    return f"""
    with b as (select event_id, user_id, value, (event_type='click')::int as label, hour(ts) as hour, strftime(ts,'%a') as dow,
        case when hour(ts)<=5 then 'night' when hour(ts)<=11 then 'morning' when hour(ts)<=17 then 'afternoon' else 'evening' end as tod,
        (strftime(ts,'%a') in ('Sat','Sun'))::int as we, (hour(ts) between 18 and 21)::int as peak,
        regexp_extract(props,'([0-9]+)',1)::int as k, ts < timestamp '{CUT}' as train from events),
      g as (select avg(label) as g from b where train), {", ".join(ctes)},
      c as (select dow as key, row_number() over (order by dow)-1 as code from (select distinct dow from b where train))
    select event_id, value, label::bigint as label, round(sin(2*pi()*b.hour/24),6) as hour_sin, round(cos(2*pi()*b.hour/24),6) as hour_cos,
      we::bigint as is_weekend, peak::bigint as is_peak_hour, k::bigint as k, coalesce(code,0)::bigint as day_of_week,
      case when train then 'train' else 'validation' end as split, {", ".join(cols)}
    from b cross join g {" ".join(joins)} left join c on c.key = dow"""


@query("feature_matrix", _matrix_sql())
def feature_matrix(t: Tables) -> DataFrame:
    train, other = event_features(t)
    both = train.unionByName(other)
    ints = ["label", "is_weekend", "is_peak_hour", "k", "day_of_week"]
    floats = ["hour_sin", "hour_cos", *[c for c in both.columns if c.endswith("_te")]]
    return both.select(
        "event_id", "value", "split", *[F.col(c).cast("bigint").alias(c) for c in ints], *[F.round(c, 6).alias(c) for c in floats]
    )


@query(
    "te_out_of_fold",
    """
    with b as (select l_orderkey, l_partkey, l_quantity, l_suppkey, (l_returnflag='R')::int as y,
        ('0x'||substr(md5(l_orderkey::varchar),1,8))::bigint % 5 as fold from lineitem),
      p as (select l_suppkey, fold, sum(y) as s, count(*) as n from b group by 1,2),
      w as (select l_suppkey, sum(s) as ts, sum(n) as tn from p group by 1),
      f as (select fold, sum(s) as fs, sum(n) as fn from p group by 1), g as (select sum(s) as s, sum(n) as n from p)
    select l_orderkey, l_partkey, l_quantity, fold, round((ts-p.s+15*((g.s-fs)/(g.n-fn)::double))/(tn-p.n+15),6) as te
    from b join p using (l_suppkey, fold) join w using (l_suppkey) join f using (fold) cross join g""",
)
def te_out_of_fold(t: Tables) -> DataFrame:
    df = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_quantity", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    out = ft.out_of_fold_encoding(df, "l_suppkey", "y", "l_orderkey")
    return out.select("l_orderkey", "l_partkey", "l_quantity", F.col("fold").cast("bigint").alias("fold"), F.round("te", 6).alias("te"))


@query(
    "balanced_undersample",
    """
    select doc_id, quality::bigint as quality from (select *, row_number() over (partition by quality order by md5(doc_id||'-7'), doc_id) as r
      from labels) where r <= (select min(n) from (select count(*) as n from labels group by quality))""",
)
def balanced_undersample(t: Tables) -> DataFrame:
    out = ft.balanced_undersample(t.labels, "quality", "doc_id", 7)
    return out.select("doc_id", F.col("quality").cast("bigint").alias("quality"))


@query(
    "stratified_split",
    """
    select vec_id, label::bigint as label, case when row_number() over (partition by label order by md5(vec_id||'-7'), vec_id)
      <= floor(count(*) over (partition by label)*0.85::double+0.5) then 'train' else 'test' end as split from embeddings""",
)
def stratified_split(t: Tables) -> DataFrame:
    out = ft.stratified_split(t.embeddings.select("vec_id", "label"), "label", "vec_id", 0.85, 7)
    return out.select("vec_id", F.col("label").cast("bigint").alias("label"), "split")


@query(
    "hash_split",
    """
    select doc_id, case when ('0x'||substr(md5(doc_id||'-7'),1,8))::bigint % 100 < 85 then 'train' else 'test' end as split
    from documents""",
)
def hash_split(t: Tables) -> DataFrame:
    return ft.hash_split(t.documents.select("doc_id"), "doc_id", 85, 7)


@query(
    "time_split",
    f"""
    with s as (select case when ts >= timestamp '{CUT}' then 'validation' else 'train' end as split, count(*)::bigint as n,
      avg((event_type='click')::int) as rate from events group by 1)
    select split, n, round(rate,6) as rate, round(n/(select sum(n) from s),6) as share from s""",
)
def time_split(t: Tables) -> DataFrame:
    out = ft.split_report(ft.time_split(click_events(t), "ts", CUT), "label")
    return out.select("split", "n", F.round("rate", 6).alias("rate"), F.round("share", 6).alias("share"))


@query(
    "negative_sample",
    """
    select doc_id, lang from documents anti join labels using (doc_id) order by md5(doc_id||'-42'), doc_id limit 300""",
)
def negative_sample(t: Tables) -> DataFrame:
    negatives = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left_anti")
    return ft.seeded_sample(negatives, "doc_id", 300, 42)


@query(
    "top_losses",
    """
    with s as (select doc_id, quality, least(greatest(n_chars/5000.0::double,1e-7),1-1e-7) as p from documents join labels using (doc_id))
    select doc_id, round(-(quality*ln(p)+(1-quality)*ln(1-p)),5) as loss from s
    order by round(-(quality*ln(p)+(1-quality)*ln(1-p)),5) desc, doc_id limit 20""",
)
def top_losses(t: Tables) -> DataFrame:
    from tidemark.plans.scoring import scored_docs

    from tidemark.functions.numbers import log_loss

    losses = scored_docs(t).select("doc_id", F.round(log_loss(F.col("quality"), F.col("p")), 5).alias("loss"))
    return losses.orderBy(F.desc("loss"), "doc_id").limit(20)
