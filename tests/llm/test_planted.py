"""Passages of over 50 words planted in several documents, spread over many partitions."""

import random

from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.conftest import prose
from tidemark.llm import suffix_dedup
from tidemark.llm.queries import table


def test_planted_passages_are_cut_and_the_rest_stays(spark):
    rng = random.Random(9)
    texts = [r["text"][:3000] for r in table(spark, SMALL, "documents").orderBy("doc_id").limit(120).collect()]
    passages = [prose(rng, rng.randrange(51, 120)) for _ in range(25)]
    holders = {}
    free = rng.sample(range(len(texts)), len(texts))  # no document takes two passages, so none is cut in two by another
    for n, passage in enumerate(passages):
        for doc in [free.pop() for _ in range(2 + n % 3)]:
            words = texts[doc].split(" ")
            at = rng.randrange(len(words) + 1)
            texts[doc] = " ".join([*words[:at], passage, *words[at:]])
            holders.setdefault(n, []).append(doc)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "starts", "kept").collect()}
    for doc, (n_bytes, removed, spans, kept) in enumerate(brute.repeats_removed(texts)):
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"], len(r["starts"]), bytes(r["kept"])) == (n_bytes, removed, spans, kept)
    long_ones = [n for n, p in enumerate(passages) if len(p.encode()) >= suffix_dedup.MIN_LENGTH]
    assert len(long_ones) > 8 and all(passages[n].encode() not in bytes(got[d]["kept"]) for n in long_ones for d in holders[n])
    clean = set(range(len(texts))) - {d for docs_ in holders.values() for d in docs_}
    assert sum(got[d]["n_removed"] == 0 for d in clean) > 0.5 * len(clean)
