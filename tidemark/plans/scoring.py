"""Scoring queries: probabilities, classes, and free-text answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import numbers as num
from tidemark.operators import aggregates as ag, grading as gr
from tidemark.operators.distributed import materialize
from tidemark.plans.registry import Tables, query
from tidemark.plans.search import class_centres


def scored_docs(t: Tables) -> DataFrame:
    """Labelled documents with a probability made from their length."""
    return t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id").withColumn(
        "p", F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0))
    )


P = "least(n_chars/5000.0::double,1.0)"


@query(
    "normalized_cross_entropy",
    f"""
    with s as (select quality as y, least(greatest({P},1e-7),1-1e-7) as p from documents join labels using (doc_id)),
      a as (select avg(-(y*ln(p)+(1-y)*ln(1-p))) as l, avg(y) as g from s)
    select round(l,6) as log_loss, round(g,6) as base_rate, round(-(g*ln(g)+(1-g)*ln(1-g)),6) as baseline,
      round(l/-(g*ln(g)+(1-g)*ln(1-g)),6) as nce from a""",
)
def normalized_cross_entropy(t: Tables) -> DataFrame:
    out = gr.normalized_cross_entropy(scored_docs(t), "quality", "p")
    return out.select(*[F.round(c, 6).alias(c) for c in ("log_loss", "base_rate", "baseline", "nce")])


@query(
    "calibration_curve",
    f"""
    with s as (select quality as y, {P} as p from documents join labels using (doc_id))
    select least(floor(p*20),19)::bigint as bin, count(*)::bigint as n, round(avg(p),6) as mean_predicted,
      round(avg(y),6) as fraction_positive from s group by 1""",
)
def calibration_curve(t: Tables) -> DataFrame:
    out = gr.calibration_curve(scored_docs(t), "quality", "p")
    return out.select(
        F.col("bin").cast("bigint").alias("bin"), "n",
        F.round("mean_predicted", 6).alias("mean_predicted"), F.round("fraction_positive", 6).alias("fraction_positive"),
    )


SHARPNESS = 5.0


def predicted(t: Tables) -> DataFrame:
    """Vectors scored against every class centre over all entries; the softmax of the scores gives pred and confidence."""
    centres = class_centres(t).agg(F.sort_array(F.collect_list(F.struct(F.col("label"), F.col("qv")))).alias("c")).scalar()
    unit = t.embeddings.select("vec_id", "label", num.l2_normalize(F.col("embedding")).alias("v"), centres.alias("c"))
    dot = lambda q: F.aggregate(F.zip_with(q, "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    probs = num.softmax(F.transform("c", lambda c: F.round(dot(c["qv"]) * SHARPNESS, 9)))
    scored = unit.select("vec_id", "label", "c", probs.alias("probs"))
    best = F.get(F.col("c"), num.argmax_index(F.col("probs")))["label"]
    named = scored.select("vec_id", "label", best.alias("pred"), F.array_max("probs").alias("confidence"))
    return materialize(named, "class-scores")  # read several times by reports; also keeps the scores from being inlined


PRED = """
    with u as (select vec_id, label, list_transform(embedding, lambda x: x::double/sqrt(list_inner_product(embedding::double[],embedding::double[]))) as v
        from embeddings),
      cp as (select label, i, avg(v[i]) as x from u, unnest(range(1,len(v)+1)) r(i) group by 1,2),
      cm as (select label, list(x order by i) as m from cp group by 1),
      cq as (select label, list_transform(m, lambda x: x/sqrt(list_inner_product(m,m))) as q from cm),
      cs as (select u.vec_id, u.label, cq.label as c, round(list_inner_product(q,v)*5,9) as s from u cross join cq),
      e as (select vec_id, label, list(s order by c) as v, list(c order by c) as cls from cs group by 1,2),
      x as (select vec_id, label, v, cls, list_transform(v, lambda s: exp(s-list_max(v))) as ex from e),
      p as (select vec_id, label, cls[list_position(v, list_max(v))]::bigint as pred, list_max(ex)/list_sum(ex) as confidence from x)"""


@query("argmax_class", PRED + " select vec_id, pred, round(confidence,6) as confidence from p")
def argmax_class(t: Tables) -> DataFrame:
    return predicted(t).select("vec_id", F.col("pred").cast("bigint").alias("pred"), F.round("confidence", 6).alias("confidence"))


@query(
    "classification_report",
    PRED
    + """, k as (select distinct label as cls from p union select pred from p),
      c as (select cls, (select count(*) from p where label=cls) as support, (select count(*) from p where pred=cls) as predicted,
        (select count(*) from p where pred=cls and label=cls) as hit from k)
    select cls::bigint as cls, support::bigint as support, round(case when predicted=0 then 0 else hit/predicted end,6) as precision,
      round(case when support=0 then 0 else hit/support end,6) as recall,
      round(case when hit=0 then 0 else 2.0::double*hit/(predicted+support) end,6) as f1 from c""",
)
def classification_report(t: Tables) -> DataFrame:
    out = gr.classification_report(predicted(t), "label", "pred")
    return out.select(
        F.col("cls").cast("bigint").alias("cls"), F.col("support").cast("bigint").alias("support"),
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
    )


@query(
    "macro_f1",
    PRED
    + """, k as (select distinct label as cls from p union select pred from p),
      c as (select cls, (select count(*) from p where label=cls) as support, (select count(*) from p where pred=cls) as predicted,
        (select count(*) from p where pred=cls and label=cls) as hit from k)
    select round(avg(case when hit=0 then 0 else 2.0::double*hit/(predicted+support) end),6) as macro_f1 from c""",
)
def macro_f1(t: Tables) -> DataFrame:
    return gr.macro_f1(predicted(t), "label", "pred").select(F.round("macro_f1", 6).alias("macro_f1"))


def _confusion_sql() -> str:
    cols = ", ".join(f"count_if(pred={i})::bigint as p_{i}" for i in range(10))
    return PRED + f" select label::bigint as truth, {cols} from p group by 1"


@query("confusion_matrix", _confusion_sql())
def confusion_matrix(t: Tables) -> DataFrame:
    out = gr.confusion_matrix(predicted(t), "label", "pred", list(range(10)))
    return out.withColumn("truth", F.col("truth").cast("bigint"))


@query(
    "threshold_reject",
    PRED
    + """ select (case when confidence>=0.12 then pred else -1 end)::bigint as pred, (confidence>0.505)::int::bigint as sure,
      count(*)::bigint as n, round(count(*)/(select count(*) from p),6) as share from p group by 1,2""",
)
def threshold_reject(t: Tables) -> DataFrame:
    df = predicted(t)
    counts = df.groupBy(
        gr.threshold_reject(F.col("pred"), F.col("confidence"), 0.12).cast("bigint").alias("pred"),
        gr.threshold_binary(F.col("confidence")).cast("bigint").alias("sure"),
    ).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


@query(
    "pseudo_labels",
    PRED
    + """ select vec_id, pred, round(confidence,6) as confidence from p
      where confidence>=0.13 and (select count(*)>50 from p where confidence>=0.13)""",
)
def pseudo_labels(t: Tables) -> DataFrame:
    out = gr.pseudo_labels(predicted(t), "confidence", 0.13)
    return out.select("vec_id", F.col("pred").cast("bigint").alias("pred"), F.round("confidence", 6).alias("confidence"))


@query(
    "class_weights",
    """
    with c as (select label, count(*) as n from embeddings group by 1)
    select label::bigint as label, n::bigint as n, round((1.0::double/n)*count(*) over ()/sum(1.0::double/n) over (),6) as weight from c""",
)
def class_weights(t: Tables) -> DataFrame:
    out = ag.class_weights(t.embeddings, "label")
    return out.select(F.col("label").cast("bigint").alias("label"), "n", F.round("weight", 6).alias("weight"))


@query(
    "ensemble_mean",
    """
    select l_returnflag, count(*)::bigint as n, round(avg((l_discount+l_tax+l_quantity/100)/3),6) as mean_p from lineitem group by 1""",
)
def ensemble_mean(t: Tables) -> DataFrame:
    members = t.lineitem.select(
        "l_returnflag", F.col("l_discount").alias("p1"), F.col("l_tax").alias("p2"), (F.col("l_quantity") / 100).alias("p3")
    )
    scored = members.withColumn("p", ag.mean_of(["p1", "p2", "p3"]))
    return scored.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


@query(
    "best_tile",
    """
    with s as (select l_orderkey, l_linenumber, [l_discount*10, l_tax*10, l_quantity/50] as v from lineitem),
      b as (select l_orderkey, l_linenumber, list_max(v) as p, list_position(v, list_max(v))-1 as k from s),
      r as (select *, row_number() over (partition by l_orderkey order by p desc, l_linenumber, k) as r from b)
    select l_orderkey, l_linenumber::bigint as l_linenumber, ['a','b','c'][k+1] as cls, round(p,6) as confidence from r where r=1""",
)
def best_tile(t: Tables) -> DataFrame:
    scores = t.lineitem.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_quantity") / 50).alias("c"),
    )
    out = ag.best_tile(scores, "l_orderkey", "l_linenumber", ["a", "b", "c"])
    return out.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "cls", F.round("confidence", 6).alias("confidence")
    )


@query(
    "output_assertions",
    """
    select count(*)::bigint as n_rows, count(*)=(select count(*) from orders) as row_count_ok, count(*)=count(distinct o_orderkey) as ids_unique,
      bool_and(o_totalprice/500000 between 0 and 1) as probabilities_ok from orders""",
)
def output_assertions(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", (F.col("o_totalprice") / 500000).alias("p"))
    expected = t.orders.agg(F.count("*").alias("n")).scalar()
    return gr.output_assertions(df, expected, "o_orderkey", "p")


# --- answers against rules ---------------------------------------------------------------------------------------


def truth_and_answers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Rules and answers made from document texts; an answer exists for the labelled documents only."""
    first = F.lower(F.element_at(F.split("text", " "), 1))
    d = t.documents.select("doc_id", "text", "source", "lang", "n_chars")
    strings = "array<string>"
    truth = d.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("bucket"),
        F.array(F.array(first, F.lit("zzzz")), F.array(F.lit("tion"), F.lit("ment")), F.array().cast(strings)).alias("any_of"),
        F.array(F.lit("qqqq"), F.concat(F.lit("@"), F.col("lang"))).alias("forbidden"),
        (F.col("lang") == "en").alias("no_extension"),
        (F.col("lang") != "fr").alias("no_employee_id"),
        F.create_map(
            F.lit("a"), F.array(F.lit("the "), F.lit("les ")), F.lit("b"), F.array(F.lit("der "), F.lit("and ")),
            F.lit("c"), F.array(F.lit("qqqq")),
        ).alias("tokens_per_id"),
        F.lit(1).alias("min_items"),
        F.when(F.col("lang") == "en", F.lit(2)).alias("exact_count"),
    )
    digits = F.col("doc_id").cast("string")
    response = F.concat_ws(
        " ",
        "text",
        F.when(F.col("n_chars") > 2000, F.concat(F.lit("ext"), F.lit(" "), (F.col("doc_id") + 10000).cast("string"))),
        F.when(F.col("n_chars") < 1000, F.concat(F.lit("id 0"), F.lpad(digits, 7, "0"))),
    )
    answered = d.join(t.labels, "doc_id", "left_semi").select(digits.alias("id"), response.alias("response"))
    return truth, answered


ANSWERS = """
    with r as (select doc_id::varchar as id, source as bucket, lang, lower(string_split(text,' ')[1]) as first,
        concat_ws(' ', text, case when n_chars>2000 then 'ext '||(doc_id+10000) end, case when n_chars<1000 then 'id 0'||lpad(doc_id::varchar,7,'0') end)
          as response, doc_id in (select doc_id from labels) as answered from documents),
      f as (select *, lower(response) as low from r),
      c as (select id, bucket, answered,
        ((contains(low,first) and first<>'') or contains(low,'zzzz')) as g1, (contains(low,'tion') or contains(low,'ment')) as g2,
        (contains(low,'qqqq') or contains(low,'@'||lang)) as bad,
        lang='en' and regexp_matches(response,'\\b\\d{5}\\b') as ext, lang<>'fr' and regexp_matches(response,'\\b0[08]\\d{6}\\b') as emp,
        (contains(low,'the ') or contains(low,'les '))::int + (contains(low,'der ') or contains(low,'and '))::int + contains(low,'qqqq')::int as items,
        lang from f),
      j as (select id, bucket, not answered as missing, case when not answered then 'missing' else concat_ws('|',
          case when not (g1 and g2) then 'missing any-of' end, case when bad then 'contains forbidden' end,
          case when ext then 'leaked extension' end, case when emp then 'leaked employee id' end,
          case when items<1 then 'min items' end, case when lang='en' and items<>2 then 'exact count' end) end as reasons, items, g1, g2, bad, ext, emp
        from c)"""


def graded(t: Tables) -> DataFrame:
    truth, answers = truth_and_answers(t)
    return gr.grade(truth, answers)


@query("grade_any_of", ANSWERS + " select id, (not g1)::int::bigint + (not g2)::int::bigint as n_failed from j where not missing")
def grade_any_of(t: Tables) -> DataFrame:
    truth, answers = truth_and_answers(t)
    joined = truth.join(answers, "id")
    return joined.select("id", F.size(gr.any_of_failures(F.col("any_of"), F.col("response"))).cast("bigint").alias("n_failed"))


@query("grade_forbidden", ANSWERS + " select id, bad from j where not missing")
def grade_forbidden(t: Tables) -> DataFrame:
    truth, answers = truth_and_answers(t)
    joined = truth.join(answers, "id")
    return joined.select("id", (F.size(gr.forbidden_hits(F.col("forbidden"), F.col("response"))) > 0).alias("bad"))


@query("grade_leaks", ANSWERS + " select id, ext as leaks_ext, emp as leaks_id from j where not missing")
def grade_leaks(t: Tables) -> DataFrame:
    truth, answers = truth_and_answers(t)
    joined = truth.join(answers, "id")
    return joined.select(
        "id",
        (F.col("no_extension") & gr.leaks_extension(F.col("response"))).alias("leaks_ext"),
        (F.col("no_employee_id") & gr.leaks_employee_id(F.col("response"))).alias("leaks_id"),
    )


@query("grade_item_count", ANSWERS + " select id, items::bigint as items from j where not missing")
def grade_item_count(t: Tables) -> DataFrame:
    truth, answers = truth_and_answers(t)
    joined = truth.join(answers, "id")
    return joined.select("id", gr.matched_items(F.col("tokens_per_id"), F.col("response")).cast("bigint").alias("items"))


@query("grade_reasons", ANSWERS + " select id, bucket, missing, reasons, reasons='' as passed from j")
def grade_reasons(t: Tables) -> DataFrame:
    return graded(t).withColumn("reasons", F.array_join("reasons", "|"))


@query(
    "grade_report",
    ANSWERS
    + """ select coalesce(bucket,'(all)') as bucket, count_if(reasons='')::bigint as n_pass, count(*)::bigint as total,
      count_if(missing)::bigint as n_missing, round(count_if(reasons='')*100.0::double/count(*),6) as rate_pct
    from j group by grouping sets ((bucket),())""",
)
def grade_report(t: Tables) -> DataFrame:
    return gr.grade_report(graded(t)).withColumn("rate_pct", F.round("rate_pct", 6))
