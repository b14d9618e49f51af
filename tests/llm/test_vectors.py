"""Whitening and hard negatives against numpy and plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.conftest import odd_vectors
from tests.oracle import compare, duck
from tidemark.llm import hard_negatives as hn, whitening
from tidemark.llm.queries import QUERIES, SQL, table


def plain_fit(vectors: list[list[int]]):
    """n, sums and whitening of the distinct vectors, in exact fractions where it matters."""
    distinct = sorted(set(map(tuple, vectors)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    centred = np.array([[(n * v - s) / n for v, s in zip(x, sums, strict=True)] for x in distinct])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], axes[:, ::-1]


def check_whitening(rows, source, scale=64, shift=1_000_000, components=16):
    good = [(i, v) for i, v, *_ in source if v and all(c is not None and math.isfinite(c) and abs(c * scale) < 2**52 for c in v)]
    whole = [(i, [math.floor(c * scale) + shift for c in v]) for i, v in good]
    assert Counter(r["vec_id"] for r in rows) == Counter({i: sum(min(components, len(v)) for j, v in good if j == i) for i, _ in good})
    for length in {len(v) for _, v in good}:
        part = [(i, x) for i, x in whole if len(x) == length]
        n, sums, values, axes = plain_fit([x for _, x in part])
        wanted = {}
        for i, x in part:
            wanted.setdefault(i, []).append((sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), np.array([(n * v - s) / n for v, s in zip(x, sums, strict=True)]) @ axes))
        signs = {}
        for r in rows:
            mine = [w for w in wanted.get(r["vec_id"], []) if r["n"] == n and w[0] == r["deviation"]]
            if not mine:
                continue
            k = r["component"] - 1
            assert abs(r["explained"] - values[k] / values.sum()) <= 1e-4 * max(values[k] / values.sum(), 1e-12) and r["identity_error"] < 1e-9
            if values[k] < 1e-9 * values.sum():
                assert r["whitened"] is None
                continue
            want = mine[0][1][k] / math.sqrt(values[k])
            gaps = np.abs(np.diff(values))
            if min(gaps[max(0, k - 1) : k + 1], default=1) > 1e-3 * values[0]:
                assert abs(abs(r["whitened"]) - abs(want)) < 1e-6
                if abs(want) > 1e-6:
                    assert signs.setdefault(k, math.copysign(1, want * r["whitened"])) == math.copysign(1, want * r["whitened"])
        assert sum(r["n"] == n for r in rows) >= len(part)


def test_whitening_on_the_table(spark):
    rows = QUERIES["op11_whitening"](spark, SMALL).collect()
    check_whitening(rows, [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL, "embeddings").collect()])
    z = np.zeros((500, 16))
    for r in rows:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(z.T, bias=True) - np.eye(16)).max() < 1e-9


def test_whitening_on_odd_rows(spark, odd_folder):
    rows = QUERIES["op11_whitening"](spark, odd_folder).collect()
    check_whitening(rows, odd_vectors())
    assert sum(r["vec_id"] is None for r in rows) == 16 and not any(r["vec_id"] in (42, 43, 44, 45, 46, 47) for r in rows)


def test_whitening_of_one_vector_and_of_copies(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(one, "vec_id", "embedding").collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] is None and r["n"] == 1 and r["deviation"] == 0 for r in rows)
    hot = [(i, [1.0, 2.0]) for i in range(500)] + [(500 + i, [float(i % 7), float(i % 11)]) for i in range(77)]
    rows = whitening.whiten(spark.createDataFrame(hot, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    check_whitening(rows, hot)
    weighted = whitening.whiten(spark.createDataFrame(hot, "vec_id long, embedding array<double>"), "vec_id", "embedding", weights="count").collect()
    assert {r["n"] for r in weighted} == {577} and weighted[0]["identity_error"] < 1e-9


def test_deviation_stays_exact_or_null():
    model = whitening.Fit(2, 3, np.array([10**15, 0]), np.array([1, 2]), np.ones(2), np.eye(2), 2.0)
    x = np.array([[10**15 + 10**9, 1], [2 * 10**15, 0]])
    assert model.deviation(x) == [(3 * 10**9 - 1) ** 2 + 1, None]


def plain_negatives(source):
    rows = []
    for i, v, label in source:
        if label is None or not v or any(c is None or not math.isfinite(c) or abs(c * 256) >= 2**28 for c in v):
            continue
        rows.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(math.floor(c * 256) for c in v)))
    out = []
    order = lambda s: (-s[1], s[0] is None, s[0] or 0)
    for i, label, x in {r for r in rows if r[0] is not None and r[0] % 100 == 0}:
        scored = [(j, sum(a * b for a, b in zip(x, y, strict=True)), other) for j, other, y in rows if j != i and len(y) == len(x)]
        for p, ps, _ in sorted((s for s in scored if s[2] == label), key=order)[:5]:
            fits = sorted((s for s in scored if s[2] != label and 30 * ps <= 100 * s[1] <= 90 * ps), key=order)[:10]
            out += [(i, p, rank, j, ps, ns) for rank, (j, ns, _) in enumerate(fits, 1)]
    return Counter(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_on_odd_rows(spark, odd_folder):
    got = Counter(tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_hard_negatives"](spark, odd_folder).collect())
    want = plain_negatives(odd_vectors())
    assert got == want and len(want) > 100 and any(k[1] is None for k in want)


def test_negatives_as_sql(spark):
    folder = SMALL.replace("0.001", "0.1")
    assert compare(spark, duck(folder), lambda: QUERIES["op12_hard_negatives"](spark, folder), SQL["op12_hard_negatives"]) == ""


def test_negatives_over_many_cells(spark):
    vectors = table(spark, SMALL, "embeddings")
    mine = lambda **sizes: Counter(
        tuple(r[c] for c in COLUMNS)
        for r in hn.mine(vectors, "vec_id", "embedding", F.col("label"), lambda i: i % 20 == 0, **sizes).collect()
    )
    whole = mine()
    assert len(whole) > 500 and mine(row_block=70, anchor_block=9) == whole and mine(rotations=1) == whole


@pytest.mark.parametrize(("length", "rotations"), [(8, 1), (8, 4), (64, 4), (100, 2)])
def test_intervals_hold_every_score(length, rotations):
    import pandas as pd

    rng = np.random.default_rng(length)
    x = np.floor(rng.standard_normal((300, length)) * 90).astype("<i4")
    x[:5] = 0
    x[5:10] = x[10]
    coded = hn.encode(x.astype(float), rotations)
    rows = pd.DataFrame({
        "id": np.arange(300), "no_id": False, "label": rng.integers(0, 3, 300), "x": [r.tobytes() for r in x],
        "code": [r.tobytes() for r in coded["code"]], "width": coded["width"], "along": coded["along"], "off": coded["off"],
    })
    block = hn.Block(rows, length)
    for q in (*x[[0, 10, 20]].astype(float), 1000 * x[30].astype(float)):
        estimate, half = block.intervals(q, slice(0, 300), rotations)
        exact = block.scores(q, np.arange(300))
        assert (np.abs(exact - estimate) <= half).all()
        plain = block.x @ q
        assert (exact == plain.astype(np.int64)).all()
    if length == 64:
        assert (half < 0.5 * np.linalg.norm(q) * block.norm + 1).mean() > 0.95


def test_scores_beyond_exact_floats():
    import pandas as pd

    x = np.full((2, 64), 2**28 - 1, dtype="<i4")
    x[1, 0] -= 1
    coded = hn.encode(x.astype(float), 1)
    rows = pd.DataFrame({
        "id": [1, 2], "no_id": False, "label": 0, "x": [r.tobytes() for r in x], "code": [r.tobytes() for r in coded["code"]],
        "width": coded["width"], "along": coded["along"], "off": coded["off"],
    })
    top = 2**28 - 1
    assert hn.Block(rows, 64).scores(x[0].astype(float), np.arange(2)).tolist() == [64 * top * top, 64 * top * top - top]


def test_scores_of_many_rows_copy_no_rows():
    """Most rows survive the intervals of such vectors; gathering them for every anchor cost more than all else."""
    import tracemalloc

    import pandas as pd

    x = np.random.default_rng(0).integers(-300, 300, (4000, 64)).astype("<i4")
    found = hn.encode(x.astype(np.float64), 1)
    rows = pd.DataFrame({"id": range(4000), "no_id": False, "label": 0, "x": [r.tobytes() for r in x], "code": [r.tobytes() for r in found.pop("code")], **found})
    block, at = hn.Block(rows, 64), np.flatnonzero(np.arange(4000) % 10)
    tracemalloc.start()
    scores = block.scores(x[7].astype(np.float64), at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (scores == x[at].astype(np.int64) @ x[7].astype(np.int64)).all()
    assert peak < block.x.nbytes / 4
