"""Looking up all keys of a question at once, fragments of names, and the order of rules."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aliases, cascade as ca
from tidemark.operators.distributed import materialize


@pytest.fixture(scope="module")
def index(spark):
    people = [(f"{i:02}", f"name{i}", "red" if i % 3 else "blue", f"k{i}") for i in range(20)]
    rows = [("nick", nick, 0, name, emp, name) for emp, name, nick, _ in people]
    rows += [("code", code, 0, name, emp, name) for emp, name, _, code in people]
    rows += [("word", w, p, w, e, w) for w, p, e in [("abcd", 1, "01"), ("abcd", 0, "09"), ("xabc", 0, "05"), ("a", 0, "07"), ("", 0, "08"), (None, 0, "06")]]
    rows += [("scoped", k, 0, k, e, k) for k, e in [("A|bolt", "1"), ("A|rod", "2"), ("B|bolt", "3")]]
    entries = spark.createDataFrame(rows, "kind string, key string, preference int, line string, emp_id string, name string")
    return materialize(ca.directory_index(entries, ["emp_id", "name"], ["emp_id"], 4), "test-index", ["kind"])


def test_index_rows(index):
    got = {(r["kind"], r["key"]): r for r in index.collect()}
    assert got["nick", "red"]["n"] == 13 and [x["id"] for x in got["nick", "red"]["lines"]] == ["01", "02", "04", "05"]
    assert got["word", "abcd"]["person"]["emp_id"] == "09" and ("word", "") not in got


def test_all_keys_in_one_join(spark, index):
    q = spark.createDataFrame([(1, "red", ["k3", "zz", "k1"]), (2, None, None), (3, "nobody", []), (4, "blue", ["k1"])], "q int, nick string, codes array<string>")
    out = ca.look_up(q, "q", index, {"by_nick": ("nick", F.col("nick"))}, {"units": (["code"], F.col("codes"))})
    got = {r["q"]: (r["by_nick"] and r["by_nick"]["n"], [u["key"] for u in r["units"] or []]) for r in out.collect()}
    assert got == {1: (13, ["k3", "k1"]), 2: (None, []), 3: (None, []), 4: (7, ["k1"])}
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 2


def test_fragments(spark, index):
    terms = spark.createDataFrame([("abc",), ("bcd",), ("a",), ("zzz",), (None,), ("",)], "term string")
    got = {r["key"]: (r["n"], r["person"]["emp_id"], [x["id"] for x in r["lines"]]) for r in ca.fragment_index(terms, index, "word", False, 3).collect()}
    assert got == {"abc": (3, "09", ["01", "05", "09"]), "bcd": (2, "09", ["01", "09"]), "a": (4, "09", ["01", "05", "07"])}
    scoped = spark.createDataFrame([("A|ol",), ("C|ol",), ("A|",)], "term string")
    assert {r["key"]: r["n"] for r in ca.fragment_index(scoped, index, "scoped", True, 3).collect()} == {"A|ol": 1}


def test_first_rule_with_an_answer_wins(spark):
    q = spark.createDataFrame([(1, None, "b"), (2, "a", "b"), (3, None, None)], "q int, x string, y string")
    out = ca.first_answer(q, {5: F.col("x"), 2: F.col("y")}, F.lit("none")).select("q", "__b.rule", "__b.answer")
    assert sorted(map(tuple, out.collect())) == [(1, 2, "b"), (2, 5, "a"), (3, 99, "none")]


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_names_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(aliases, "CHUNK", 500)
    rng = random.Random(seed)
    letters = "abcกข é\n"
    names = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(40)} | {"", "𝒳y"}
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 90))) for _ in range(60)] + [None, "", "z𝒳yz", "a" * 3000]
    got = aliases.contained_names(
        spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3), "id", "t", spark.createDataFrame([(n,) for n in names], "alias string")
    ).collect()
    want = {(i, n) for i, t in enumerate(texts) for n in names if t is not None and n and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_names(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, t string")
    assert aliases.contained_names(texts, "id", "t", texts.select(F.lit("x").alias("alias")).limit(0)).count() == 0


def test_every_rule_is_hit(spark):
    from tests.conftest import SMALL
    from tidemark.plans.catalog import all_queries
    from tidemark.plans.registry import Tables

    rules = all_queries()["route_cascade"].build(Tables(spark, SMALL.replace("0.001", "0.01"))).groupBy("rule").count().collect()
    assert {r["rule"] for r in rules} == {*range(1, 33), 99}
