import random

import pytest
from pyspark.sql import functions as F

CLASHES = ["key", "row", "text_key", "bucket", "hash", "range", "gram", "group", "size", "rank", "n", "component", "shard", "cut", "found"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, words: int, syllables: str = "th er on an re he in ed nd ha") -> str:
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def odd_texts() -> list[tuple]:
    """Nulls, empty, blank, one-word, very long, repeated, edited and overlapping texts, ties and repeated rows."""
    rng = random.Random(4)
    base, passage = prose(rng, 300), prose(rng, 120)
    edited = base.split()
    edited[7] = edited[150] = "changed"
    item = prose(rng, 30)
    german = "ung sch ein ich keit der die ver zu ge"
    texts = [
        None, "", "   \n\t", "word", "four words only here", "!!! ??? 123", base, base, " ".join(edited), base.upper(),
        prose(rng, 200) + " " + passage + " " + prose(rng, 50), passage + " " + prose(rng, 80), "é" * 1000, "ab" * 900,
        prose(rng, 40) + " " + item + " " + prose(rng, 20000), item.upper(), prose(rng, 90, german), prose(rng, 90, german),
        "Licensed under the\nMIT License. " + prose(rng, 20), "a b　c <|endoftext|> 日本語\r\n\r\n  x", "x" * 30000,
    ]
    rows = [(i, t, "de" if i in (16, 17) else None if i % 7 == 3 else "en", "s", None) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, "en", None, 1), rows[6], rows[12], (2**60 + 1, prose(rng, 60), "en", "s", 2)]
    return rows, item


def odd_vectors() -> list[tuple]:
    """Null, empty, broken, huge, flat, repeated and short vectors, null ids and labels; near groups so that negatives exist."""
    rng = random.Random(11)
    near = lambda base, w: [w * b + (1 - w) * rng.gauss(0, 0.2) for b in base]
    base = [rng.gauss(0, 0.3) for _ in range(8)]
    rows = [(i * 20, near(base, rng.choice([0.5, 0.8, 0.95])), i % 3) for i in range(60)]
    rows += [rows[5], rows[5], rows[10], (None, base, 0), (None, base, 1), (41, base, None), (42, None, 1), (43, [], 1)]
    rows += [(44, [float("nan")] * 8, 1), (45, [float("inf")] + base[1:], 1), (46, [None] + base[1:], 2), (47, [1e30] * 8, 0)]
    rows += [(100, base[:3], 0), (101, base[:3], 0), (102, [0.9 * b for b in base[:3]], 0), (103, [0.8 * b for b in base[:3]], 2), (2**50, [0.0] * 8, 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows, _ = odd_texts()
    docs = spark.createDataFrame(rows, DOCS)
    return docs.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def odd_folder(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    _, item = odd_texts()
    odd.write.parquet(f"{folder}/documents.parquet")
    bench = [(0, item), (1, None), (2, ""), (3, "four words only here"), (4, item), (None, item), (5, "never seen " * 9)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, i % 2, 0) for i in range(20)] + [(None, 1, None), (3, None, None), (99, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    turns = [(1, 0, "user", "Hello there"), (1, 1, "assistant", None), (1, 2, "user", "Hello there"), (1, 3, "user", "A\n\nB"), (1, 4, None, ""), (2, 5, "user", "x")]
    turns += [(None, 1, "user", "lost"), (3, None, "user", "lost"), (2, 5, "user", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    vectors = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<double>, label int")
    clashes = ["id", "x", "n", "weight", "length", "component", "anchor", "score", "code", "k1", "z"]
    vectors.withColumns({c: F.lit("clash") for c in clashes}).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_folder(spark, odd_folder, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_folder}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder
