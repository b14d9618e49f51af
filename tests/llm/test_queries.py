"""Every query of the subpackage on odd rows, on empty tables, and against SQL or a brute-force version."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import odd_texts
from tests.oracle import compare, duck
from tidemark.llm import bpe, fingerprints
from tidemark.llm.queries import QUERIES, SQL, table

ROWS, ITEM = odd_texts()
TEXTS = [r[1] for r in ROWS]


def counted(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, duck(SMALL), lambda: QUERIES[name](spark, SMALL), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


def test_quotes_on_odd_rows(spark, odd_folder):
    got = QUERIES["op1_quote_links"](spark, odd_folder).collect()
    assert len(got) == 9 + 0 * 2
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[(1, 4)]["parent_turn"] == 3 and by[(1, 2)]["parent_turn"] is None and by[(2, 5)]["depth"] == 0
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == [0, 1, 2, 3, 4]


def check_shards(rows, texts):
    sizes = {}
    for r, t in zip(rows, texts, strict=True):
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
        sizes.setdefault(r["shard"], []).append(r)
    for members in sizes.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    homes, first, load = {}, {}, Counter()
    for r, t in zip(rows, texts, strict=True):
        homes.setdefault(t or "", set()).add(r["shard"])
        if r["doc_id"] is not None:
            first[t or ""] = min(first.get(t or "", r["doc_id"]), r["doc_id"])
        load[t or ""] += r["size"]
    assert all(len(h) == 1 for h in homes.values())
    order = sorted(load, key=lambda t: first[t])
    assert max(sum(r["size"] for r in m) for m in sizes.values()) == brute.smallest_capacity([load[t] for t in order], 24)


def by_id(spark, folder):
    return {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("which", ["small", "odd"])
def test_shards(spark, odd_folder, which):
    folder = SMALL if which == "small" else odd_folder
    rows = QUERIES["op2_minimax_shards"](spark, folder).collect()
    docs = by_id(spark, folder)
    if which == "odd":
        null_rows = sorted((r for r in rows if r["doc_id"] is None), key=lambda r: r["size"])
        assert len(null_rows) == 2 and len(rows) == len(ROWS)
        texts = [docs[r["doc_id"]] if r["doc_id"] is not None else (None if r["size"] == 8 else ROWS[6][1]) for r in rows]
    else:
        texts = [docs[r["doc_id"]] for r in rows]
    check_shards(rows, texts)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_byte_bpe(spark, odd_folder, which):
    folder = SMALL if which == "small" else odd_folder
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in table(spark, folder, "documents").collect():
        ids = own.encode_ordinary(r["text"] or "")
        line = " ".join(map(str, ids)).encode()
        want.append((r["doc_id"], len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert counted(QUERIES["op3_byte_bpe"](spark, folder).collect()) == counted(want)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_suffix_dedup(spark, odd_folder, which):
    folder = SMALL if which == "small" else odd_folder
    docs = table(spark, folder, "documents").collect()
    cut = brute.repeats_removed([r["text"] for r in docs])
    want = [(r["doc_id"], n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(docs, cut, strict=True)]
    assert counted(QUERIES["op4_suffix_dedup"](spark, folder).collect()) == counted(want)


def test_language_held_out(spark):
    folder = SMALL.replace("0.001", "0.01")
    truth = {r["doc_id"]: r["lang"] for r in table(spark, folder, "documents").collect()}
    got = [r for r in QUERIES["op6_language_id"](spark, folder).collect() if r["held_out"]]
    assert len(got) > 200 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) > 0.93 * len(got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["rejected"] for r in got) < 0.03 * len(got)


def test_language_odd_rows(spark, odd_folder):
    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, odd_folder).collect()}
    assert {got[i]["lang_pred"] for i in (0, 1, 2, 5)} == {"und"} and got[16]["lang_pred"] == "de" and got[6]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"]


def test_quality_held_out(spark):
    folder = SMALL.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, folder, "labels").collect()}
    rows = [r for r in QUERIES["op7_quality"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) > 0.95 * len(rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_odd_rows(spark, odd_folder):
    rows = QUERIES["op7_quality"](spark, odd_folder).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_jaccard_components(spark, odd_folder, which):
    folder = SMALL if which == "small" else odd_folder
    docs = table(spark, folder, "documents").collect()
    group = brute.components([r["text"] for r in docs])
    ids = {}
    for r, g in zip(docs, group, strict=True):
        if g >= 0 and r["doc_id"] is not None:
            ids[g] = min(ids.get(g, r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], len(brute.shingles(r["text"])), ids.get(g) if g >= 0 else r["doc_id"]) for r, g in zip(docs, group, strict=True)]
    assert counted(QUERIES["op8_jaccard_join"](spark, folder).collect()) == counted(want)


@pytest.mark.parametrize("which", ["small", "odd"])
def test_jaccard_links(spark, odd_folder, which):
    folder = SMALL if which == "small" else odd_folder
    docs = table(spark, folder, "documents").collect()
    want = [(d["doc_id"], n) for d, n in zip(docs, brute.link_counts([d["text"] for d in docs]), strict=True)]
    assert counted((r["doc_id"], r["n_links"]) for r in QUERIES["op8_jaccard_links"](spark, folder).collect()) == counted(want)


def test_decontamination_on_odd_rows(spark, odd_folder):
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, odd_folder).collect()}
    assert got == {(14, 0), (14, 4), (15, 0), (15, 4), (4, 3)}


@pytest.mark.parametrize("which", ["small", "odd"])
def test_fingerprints(spark, odd_folder, which):
    folder = SMALL if which == "small" else odd_folder
    rows = QUERIES["op10_fingerprints"](spark, folder).collect()
    docs = table(spark, folder, "documents").collect()
    assert counted((r["doc_id"], r["n_chars"]) for r in rows) == counted((d["doc_id"], len(d["text"] or "")) for d in docs)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    if which == "odd":
        return
    texts = sorted((d["doc_id"], d["text"] or "") for d in docs)
    got = {r["doc_id"]: r for r in rows}
    for (i, a), (_, b) in zip(texts, texts[1:] + texts[:1], strict=True):
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        mark = fingerprints.digest(a.encode())
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["fingerprint"] == mark.hex()
        assert got[i]["near_next"] == fingerprints.likeness(mark, fingerprints.digest(b.encode()))


def test_fingerprint_ranges(spark):
    docs = table(spark, SMALL, "documents")
    one = counted(fingerprints.fingerprint_neighbours(docs).collect())
    assert counted(fingerprints.fingerprint_neighbours(docs, bytes_per_range=20_000).collect()) == one
    single = fingerprints.fingerprint_neighbours(docs.where("doc_id = 0")).first()
    assert single["near_next"] == 1.0


def test_pipeline_stages_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        if name != "byte_bpe":
            assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), after.schema)
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name == "jaccard_join":
            order = sorted(before)
            group = brute.components([before[i]["text"] for i in order])
            assert set(rows) == {i for k, i in enumerate(order) if group[k] in (-1, k)}
        elif name == "suffix_dedup":
            order = sorted(before)
            cut = brute.repeats_removed([before[i]["text"] for i in order])
            want = {i: k.decode("utf-8", "ignore") for i, (n, gone, _, k) in zip(order, cut, strict=True) if k or not gone}
            assert {i: r["text"] or "" for i, r in rows.items()} == want
        elif name == "decontaminate":
            items = [r["text"] for r in table(spark, SMALL, "benchmark").collect()]
            assert set(rows) == {i for i, r in before.items() if max(brute.contained(r["text"], x) for x in items) < 0.75}
        elif name == "byte_bpe":
            assert set(rows) == set(before) and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in rows.values())
        before = rows


def test_pipeline_on_odd_rows(spark, odd_folder):
    rows = corpus_pipeline.run(spark, odd_folder).collect()
    kept = {r["doc_id"] for r in rows}
    assert 6 in kept and not kept & {0, 1, 2, 5, 7, 8, 9, 14, 15} and all(r["round_trip"] for r in rows)
