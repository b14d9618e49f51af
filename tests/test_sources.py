import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers as rd, sinks as sk


def test_csv_renames_by_position_and_ignores_the_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿วันที่,จำนวน\n1/2/2025,\"1,234\"\n,\n", encoding="utf-8")
    raw = rd.read_csv_renamed(spark, str(tmp_path / "a.csv"), ["date", "volume"]).collect()
    assert [tuple(r) for r in raw] == [("1/2/2025", "1,234"), (None, None)]
    assert [tuple(r) for r in rd.read_csv_text(spark, str(tmp_path / "a.csv"), ["date", "volume"]).collect()][1] == ("", "")
    (tmp_path / "b.csv").write_text("id,p\n1,0.5\n")
    assert tuple(rd.read_csv_typed(spark, str(tmp_path / "b.csv"), "id int, p double").first()) == (1, 0.5)


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "products" / "x y").mkdir(parents=True)
    (tmp_path / "products" / "x y" / "a.md").write_text("# A\n\nbody\n")
    (tmp_path / "b.md").write_text("b")
    (tmp_path / "c.txt").write_text("no")
    got = {r["path"]: r["text"] for r in rd.read_markdown(spark, str(tmp_path)).collect()}
    assert got == {"products/x y/a.md": "# A\n\nbody\n", "b.md": "b"}


def test_truth_file_feeds_the_grader(spark, tmp_path):
    from tidemark.operators.grading import grade

    items = [{"id": "q1", "bucket": "b", "language": "en", "expected_answer": {
        "must_contain_any_of": [["ann"]], "must_not_contain_phone_extension": True, "all_items_tokens_per_id": {"01": ["ann"]}, "min_items": 1}}]
    (tmp_path / "t.json").write_text(json.dumps({"items": items}, indent=1))
    truth = rd.read_truth(spark, str(tmp_path / "t.json"))
    answers = spark.createDataFrame([("q1", "Ann, 12345")], "id string, response string")
    assert grade(truth, answers).first()["reasons"] == ["leaked extension"]


def test_sensor_folder_skips_the_nth_file(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"s{i}.csv").write_text(f"v,label\n{i},[1]\n")
    df = rd.read_sensor_folder(spark, str(tmp_path), "v int, label string", skip=3)
    assert sorted(r["v"] for r in df.collect()) == [0, 1, 3]
    assert rd.read_sensor_folder(spark, str(tmp_path), "v int, label string", skip=9).count() == 4


def test_labels_from_paths(spark, tmp_path):
    (tmp_path / "egg_1.png").write_bytes(b"x")
    (tmp_path / "test").mkdir()
    (tmp_path / "test" / "worm_2.png").write_bytes(b"x")
    files = rd.list_files(spark, str(tmp_path), "*.png")
    name = F.regexp_extract("path", "[^/]*$", 0)
    got = {r[0]: r[1] for r in files.select(name, rd.label_from_prefix(name, [("egg", "Egg"), ("worm", "Worm")])).collect()}
    assert got == {"egg_1.png": "Egg", "worm_2.png": "Worm"}
    assert rd.drop_paths_with(files, "path", ["/test/"]).count() == 1
    assert [r[0] for r in files.select(rd.label_from_keyword(F.col("path"), [("worm", "W"), ("egg", "E")])).orderBy(F.desc("path")).collect()] == ["W", "E"]


def test_submission_checks_the_row_count_first(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, response string")
    out = str(tmp_path / "out")
    sk.write_submission(df, out, ["id", "response"], 2)
    with pytest.raises(ValueError):
        sk.write_submission(df.limit(1), out, ["id", "response"], 2)
    assert spark.read.option("header", True).csv(out).count() == 2


def test_run_log_appends_nested_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a.md", "b.md"])], "id int, sources array<string>")
    for _ in range(2):
        sk.append_run_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_probability_check(spark):
    good, bad = spark.createDataFrame([(0.1,)], "p double"), spark.createDataFrame([(1.1,), (None,)], "p double")
    sk.check_probabilities(good, "p")
    with pytest.raises(ValueError, match="2 probabilities"):
        sk.check_probabilities(bad, "p")


def test_row_wise_operators_run_on_a_stream(spark, tmp_path):
    """Parsing and masking keep no state, so a file stream takes them as they are."""
    from tidemark.functions import numbers as num, text as tx

    src = tmp_path / "in"
    spark.createDataFrame([("1,200", "id 00002699")], "v string, t string").write.parquet(str(src))
    stream = spark.readStream.schema("v string, t string").parquet(str(src))
    cleaned = stream.select(num.parse_thousands(F.col("v")).alias("v"), tx.mask_private(F.col("t"), F.lit(False)).alias("t"))
    q = cleaned.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("cleaned").collect()] == [(1200.0, "id XXXXXXXX")]
