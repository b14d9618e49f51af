"""The token store against the tokenizers library on whole texts, and its files."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.conftest import odd_texts
from tidemark.llm import token_store as ts
from tidemark.llm.queries import QUERIES, table

JSON = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(JSON)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def wanted(rows):
    """Expected rows; documents with equal ids may stand in any order among themselves, so their starts are left out."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    repeated = {i for i, n in Counter(i for i, _ in rows).items() if n > 1}
    out, start = [], 0
    for i, text in rows:
        ids = ids_of(text)
        out.append((i, None if i in repeated else start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return Counter(out), repeated


@pytest.mark.parametrize("which", ["small", "odd"])
def test_stored_tokens(spark, odd_folder, which):
    folder = SMALL if which == "small" else odd_folder
    want, repeated = wanted([(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()])
    got = QUERIES["op13_token_store"](spark, folder).collect()
    assert Counter((r["doc_id"], None if r["doc_id"] in repeated else r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_many_blocks_and_short_access(spark):
    docs = table(spark, SMALL, "documents")
    store = ts.write_store(docs, "doc_id", "text", JSON, 2, block_bytes=3_000, range_bytes=30_000)
    assert store.blocks.count() > 20 and store.blocks.select("range").distinct().count() > 2
    assert ts.read_back(store).select("doc_id").orderBy("start").collect() == docs.select("doc_id").orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    asked = spark.createDataFrame([(3,), (3,), (77,), (199,), (10**9,), (None,)], "doc_id long")
    got = {r["doc_id"]: r["token_ids"] for r in ts.read_documents(store, asked).collect()}
    assert got == {i: ids_of(texts[i]) for i in (3, 77, 199)}


def test_word_wise_ids_are_the_library_s():
    words = ts.WordIds(JSON, 2)
    odd = ["a\x1cb c'ſ ́x <|endoftext|>z  ΑΣ ΟΔΟΣ\n\r\n\tfoo bar　baz İI", "It's THE dog's 'lls we'VE 12a3 ?!a--b", "ŉ ß ÷ ×x Ǆ ĸ ª º µ", "x" * 5000, "é é ́"]
    texts = [t for _, t, *_ in odd_texts()[0]] + odd
    for _ in range(2):
        got = [np.frombuffer(raw, dtype="<u2").tolist() + [2] for raw in words.encode(texts)]
        assert got == [ids_of(t) for t in texts]
    assert "x" * 5000 not in words.memory and "dog" in words.memory


def test_memory_of_words_stays_bounded(monkeypatch):
    monkeypatch.setattr(ts, "MEMORY", 50)
    words = ts.WordIds(JSON, 4)
    for n in range(20):
        text = " ".join(f"word{n} again{i}" for i in range(20))
        assert np.frombuffer(words.encode([text])[0], dtype="<u4").tolist() == ids_of(text)[:-1]
        assert len(words.memory) <= 80 and len(words.older) <= 80


def test_another_dictionary_is_refused():
    block = ts.pack([5], [False], [ts.compressor(b"").compress(b"\1\0")], 2, ts.dictionary_hash(b""))
    assert ts.open_block(block, b"").wide(0, b"").tolist() == [1]
    with pytest.raises(ValueError, match="another dictionary"):
        ts.open_block(block, b"other dictionary")
    with pytest.raises(ValueError, match="not a block"):
        ts.open_block(b"x" + block[1:], b"")


def test_dictionary_is_trained_and_helps():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 49_000, 40).astype("<u2").tobytes() for _ in range(60)]
    samples = [b"".join(phrases[i] for i in rng.integers(0, 60, 8)) for _ in range(3000)]
    trained = ts.train(samples)
    assert 1000 < len(trained) <= ts.DICTIONARY_BYTES
    size = lambda d: sum(len(ts.compressor(d).compress(s)) for s in samples[:200])
    assert size(trained) < 0.6 * size(b"") and ts.decompressor(trained).decompress(ts.compressor(trained).compress(samples[0])) == samples[0]
    assert ts.train([]) == b"" and ts.train([b"abc"]) == b"abc"


def test_texts_are_read_four_times(spark):
    """To measure them, to choose those to train on, to find the ranges, and to encode them."""
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"text {i} of a few words") for i in range(300)], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    ts.write_store(docs, "doc_id", "text", JSON, 2, range_bytes=2000)
    assert rows.value == 4 * 300, rows.value
