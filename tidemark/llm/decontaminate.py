"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

MinHash compares sets of like size well and a short item with a long document badly. So the items are partitioned by size: class c
holds items of c to 2c - 1 shingles (c a power of two). For each class a document is read in overlapping windows of 4c
shingles that advance by 2c; a passage as long as the item lies whole in one of them, so the Jaccard similarity of the two is
never small and one common MinHash value among ``PERMUTATIONS`` finds it: an item whose shingles are all there is missed
with a probability under 1e-7, one with three quarters of them with one under 1e-5.

Tasks that read documents hold two bit tables of fixed size, made from the MinHash values and the shingles of all items; they only
drop values that no item has. What is left is joined to the items, and a pair that shares a MinHash value is verified: its
containment is the number of the item's distinct shingles found anywhere in the document, over the number the item has.

Defined results: null and empty texts and items have no shingles and match nothing; items without an id are left out; a text with fewer than five words is one shingle;
rows that repeat a document id or item id give one pair with the largest containment; columns other than the named ones are not
read. Ties do not arise: every pair at or above the threshold is returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.hashing import WORDS, lower_ascii, mix, shingle_hashes, word_hashes
from tidemark.llm.ordering import restored, with_id
from tidemark.operators.distributed import materialize

PERMUTATIONS = 64
TABLE_BITS = 24
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_SALTS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64))
_PIECE = 1 << 15


def _signature(minima: np.ndarray, size_class: int) -> np.ndarray:
    """64-bit names of MinHash values (permutations down, sets across) that hold the permutation and the class."""
    return mix(minima ^ (_SALTS[:, None] + np.uint64(size_class)))


def item_signature(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    size_class = 1 << (len(shingles).bit_length() - 1)
    permuted = shingles[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]
    return size_class, _signature(permuted.min(axis=1, keepdims=True), size_class)[:, 0]


def window_signatures(shingles: np.ndarray, classes: list[int]) -> Iterator[np.ndarray]:
    """Signatures of all windows of a document for every class, piece by piece in bounded memory."""
    widest = 2 * max(classes, default=1)
    stride = max(widest, _PIECE // widest * widest)
    for at in range(0, len(shingles), stride):
        piece = shingles[at : at + stride + widest]
        minima, step = piece[None, :] * _FACTORS[:, None] + _OFFSETS[:, None], 1
        for size_class in sorted(classes):
            minima = np.minimum.reduceat(minima, np.arange(0, minima.shape[1], 2 * size_class // step), axis=1)
            step = 2 * size_class
            windows = np.minimum(minima[:, :-1], minima[:, 1:]) if minima.shape[1] > 1 else minima
            yield _signature(windows, size_class).ravel()


def _shingles(text: str | None) -> np.ndarray:
    return shingle_hashes(word_hashes(lower_ascii(np.frombuffer((text or "").encode(), dtype=np.uint8))), WORDS)


def _item_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for item, text in zip(frame["item_id"], frame["text"], strict=True):
            found = np.unique(_shingles(text))
            if len(found):
                size_class, names = item_signature(found)
                out.append((item, len(found), size_class, found.view(np.int64), names.view(np.int64)))
        yield pd.DataFrame(out, columns=["item_id", "n_item", "size_class", "shingles", "names"])


def bit_table(values: DataFrame, column: str) -> np.ndarray:
    """Bits of all values in a table of ``2 ** TABLE_BITS`` bits; Spark gathers it, so its size is all that reaches the driver."""
    place = F.shiftrightunsigned(F.col(column), 64 - TABLE_BITS)
    words = values.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")
    )
    table = np.zeros(1 << (TABLE_BITS - 6), dtype=np.uint64)
    for r in words.toLocalIterator():
        table[r["word"]] = np.uint64(r["bits"] & 0xFFFFFFFFFFFFFFFF)
    return table


def _held(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = values >> np.uint64(64 - TABLE_BITS)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def find_contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Pairs (id, item) with ``n_shared``, ``n_item``, ``containment`` and ``text_key``, the md5 digest of the document's text."""
    known = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    known = known.where("item_id is not null").mapInPandas(_item_rows, "item_id long, n_item long, size_class long, shingles array<long>, names array<long>")
    known = materialize(known, "bench-items")
    item_names = known.select("item_id", F.explode("names").alias("value"))
    item_shingles = known.select("item_id", "n_item", F.explode("shingles").alias("value"))
    classes = sorted(r["size_class"] for r in known.select("size_class").distinct().collect())
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((bit_table(item_names, "value"), bit_table(item_shingles, "value")))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name_table, shingle_table = shared.value
        for frame in frames:
            out = []
            for doc, no_id, text in zip(frame["doc_id"], frame["no_id"], frame["text"], strict=True):
                found = _shingles(text)
                hits = [names[_held(names, name_table)] for names in window_signatures(found, classes)]
                names = np.unique(np.concatenate(hits)) if hits else found[:0]
                if len(names):
                    parts = np.unique(found[_held(found, shingle_table)])
                    out.append((doc, no_id, text, names.view(np.int64), parts.view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "no_id", "text", "names", "shingles"])

    rows = docs.select(*with_id(F.col(id_col)), F.col(text_col).cast("string").alias("text"))
    read_rows = rows.where("text is not null").mapInPandas(
        read, "doc_id long, no_id boolean, text string, names array<long>, shingles array<long>"
    )
    suspects = materialize(restored(read_rows).select("doc_id", F.md5("text").alias("text_key"), "names", "shingles"), "bench-suspects")
    named = suspects.select("text_key", F.explode("names").alias("value"))
    pairs = named.join(item_names, "value").select("text_key", "item_id").distinct()
    parts = suspects.select("text_key", F.explode("shingles").alias("value")).distinct()
    counted = parts.join(item_shingles.distinct(), "value").groupBy("text_key", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    enough = counted.where(F.col("n_shared") >= threshold * F.col("n_item")).join(pairs, ["text_key", "item_id"], "left_semi")
    out = suspects.select("doc_id", "text_key").distinct().join(enough, "text_key")
    best = out.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), "text_key", "item_id", "b.n_shared", "b.n_item", "b.containment")


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text holds no item."""
    held = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bad = find_contaminated(held, items, threshold).select("text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_key"))
    return rows.join(bad, "text_key", "left_anti").select("row.*")


SQL = r"""
    with words as (
        select 'd' as kind, doc_id as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
        union all
        select 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark),
    shingles as (
        select distinct kind, id, array_to_string(list_slice(w, i, i + 4), ' ') as s
        from words, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as u(i)),
    sizes as (select id as item_id, count(*) as n_item from shingles where kind = 'i' group by id)
    select d.id as doc_id, i.id as item_id, count(*) as n_shared, n_item, count(*) / n_item as containment
    from shingles d join shingles i on d.s = i.s and d.kind = 'd' and i.kind = 'i' join sizes on i.id = sizes.item_id
    group by d.id, i.id, n_item having count(*) >= 0.75 * n_item"""
