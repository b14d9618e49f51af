import pytest
from pyspark.sql import functions as F

from tidemark.operators import grading as gr

SCHEMA = (
    "id string, bucket string, any_of array<array<string>>, forbidden array<string>, no_extension boolean, "
    "no_employee_id boolean, tokens_per_id map<string,array<string>>, min_items int, exact_count int"
)
ITEMS = {"a": ["ann"], "b": ["bob", "rob"], "c": ["cat"]}
CASES = [
    ("1", [["Ann", "x"], []], None, None, None, None, None, None, "hello ANN", []),
    ("2", [["zed"]], None, None, None, None, None, None, "hello", ["missing any-of"]),
    ("3", None, ["secret"], None, None, None, None, None, "a Secret", ["contains forbidden"]),
    ("4", None, None, True, True, None, None, None, "call 73048", ["leaked extension"]),
    ("5", None, None, True, True, None, None, None, "id 00002699", ["leaked employee id"]),
    ("6", None, None, False, None, None, None, None, "73048 00002699", []),
    ("7", None, None, None, None, ITEMS, 2, None, "ann only", ["min items"]),
    ("8", None, None, None, None, ITEMS, 2, 2, "ann and rob and cat", ["exact count"]),
    ("9", None, None, None, None, ITEMS, 2, 2, "ann and rob", []),
]


@pytest.fixture(scope="module")
def graded(spark):
    truth = spark.createDataFrame([(c[0], "x" if int(c[0]) < 6 else "y", *c[1:8]) for c in CASES] + [("10", "y", *[None] * 7)], SCHEMA)
    answers = spark.createDataFrame([(c[0], c[8]) for c in CASES], "id string, response string")
    return gr.grade(truth, answers)


def test_reasons(graded):
    got = {r["id"]: r["reasons"] for r in graded.collect()}
    assert got == {**{c[0]: c[9] for c in CASES}, "10": ["missing"]}


def test_report(graded):
    got = {r["bucket"]: (r["n_pass"], r["total"], r["n_missing"]) for r in gr.grade_report(graded).collect()}
    assert got == {"x": (1, 5, 0), "y": (2, 5, 1), "(all)": (3, 10, 1)}


def test_report_by_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    got = {r["cls"]: (r["precision"], r["recall"], round(r["f1"], 6), r["support"]) for r in gr.classification_report(df, "t", "p").collect()}
    assert got == {0: (1.0, 0.5, 0.666667, 2), 1: (1 / 3, 1.0, 0.5, 1), 2: (0.0, 0.0, 0.0, 1)}
    assert gr.macro_f1(df, "t", "p").first()[0] == pytest.approx((2 / 3 + 0.5) / 3)


def test_nce_of_the_base_rate_is_one(spark):
    df = spark.createDataFrame([(1, 0.25), (0, 0.25), (0, 0.25), (0, 0.25)], "y int, p double")
    assert gr.normalized_cross_entropy(df, "y", "p").first()["nce"] == pytest.approx(1.0)
    sure = spark.createDataFrame([(1, 1.0), (0, 0.0)], "y int, p double")
    assert gr.normalized_cross_entropy(sure, "y", "p").first()["nce"] < 1e-5


def test_thresholds(spark):
    df = spark.createDataFrame([(3, 0.75), (3, 0.74)], "k int, p double")
    got = [tuple(r) for r in df.select(gr.threshold_reject(F.col("k"), F.col("p"), 0.75), gr.threshold_binary(F.col("p"), 0.74)).collect()]
    assert got == [(3, 1), (-1, 0)]


def test_pseudo_labels_need_enough_rows(spark):
    df = spark.range(60).select("id", F.lit(0.9).alias("c"))
    assert gr.pseudo_labels(df, "c").count() == 60
    assert gr.pseudo_labels(df.limit(50), "c").count() == 0
