"""Byte-level BPE: ranked merges over the bytes of words, and decoding by concatenation of the pieces.

A text is cut into words by a pattern; every word starts as its single bytes, and the adjacent pair with the lowest
rank (the leftmost on ties) is merged until no pair has a rank. Ids are the ranks of the remaining pieces.

Two forms give the same ids:

* ``encode_words`` folds the merges with Spark's higher-order functions over a table of distinct words, with the rank table as a
  literal (an array of small maps, picked by a checksum, since a look-up walks through a literal map).
* ``encode`` and ``decode`` work on whole texts inside Arrow batches. Joining word occurrences to a table of encoded
  words would shuffle several times the corpus; here every text stays in its row, each task folds the merges of a distinct word
  once and keeps the result in a memory of bounded size.

Defined results: null and empty texts have no tokens; any text is encoded, whatever its length (a heap keeps the merges
of a very long word near-linear); special tokens do not exist, their strings are ordinary text. Decoding gives back exactly
the bytes that were encoded; a null list decodes to no bytes and an unknown id raises an error.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MEMORY = 600_000
LONG = 200
_NEVER = 1 << 40
_MAPS = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a public vocabulary file: one base64 piece and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word: the lowest-ranked pair of neighbours is merged, again and again."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    if len(word) > LONG:
        return _merge_long(word, ranks)
    get = ranks.get
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == _NEVER:
            break
        i = pairs.index(lowest)
        pieces[i] += pieces.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(pieces[i] + pieces[i + 1], _NEVER)
        if i:
            pairs[i - 1] = get(pieces[i - 1] + pieces[i], _NEVER)
    return tuple(ranks[p] for p in pieces)


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for a long word: pairs wait in a heap by (rank, place), links skip places that have been merged away."""
    n = len(word)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            waiting.append((rank, i, i + 1, i + 2))
    heapq.heapify(waiting)
    while waiting:
        _, i, middle, end = heapq.heappop(waiting)
        if ends[i] != middle or middle >= n or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, -1
        if end < n:
            before[end] = i
            rank = ranks.get(word[i : ends[end]])
            if rank is not None:
                heapq.heappush(waiting, (rank, i, end, ends[end]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(word[left:end])
            if rank is not None:
                heapq.heappush(waiting, (rank, left, i, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return tuple(out)


@lru_cache(maxsize=2)
def _worker_state(pattern: str, ranks_hash: int) -> tuple[Callable, dict]:
    """Of one Python worker: the word splitter, and the ids of words that it has met."""
    return regex.compile(pattern).findall, {}


def encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[str | None], list[int]]:
    """Function from a text to its ids; words seen before in this worker are looked up in a memory of bounded size."""
    words_of, memory = _worker_state(pattern, hash(frozenset(ranks.items())))

    def run(text: str | None) -> list[int]:
        ids: list[int] = []
        for word in words_of(text or ""):
            known = memory.get(word)
            if known is None:
                known = merge_word(word.encode(), ranks)
                if len(word) <= LONG:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[word] = known
            ids += known
        return ids

    return run


def decoder(ranks: dict[bytes, int]) -> Callable[[list[int] | None], bytes]:
    """Function from ids to bytes: the pieces, one after the other."""
    piece = {rank: piece for piece, rank in ranks.items()}.__getitem__
    return lambda ids: b"".join(map(piece, ids)) if ids is not None else b""


def encode(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Array of ids of a text column. The vocabulary travels once to each executor as a broadcast variable of fixed size."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids_of = encoder(shared.value, pattern)
        for batch in batches:
            yield pd.Series([ids_of(t) for t in batch], dtype=object)

    return run(text.cast("string"))


def decode(spark: SparkSession, ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of a column of ids."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = decoder(shared.value)
        for batch in batches:
            yield pd.Series([bytes_of(None if x is None else x.tolist()) for x in batch], dtype=object)

    return run(ids)


def round_trip(spark: SparkSession, text: Column, ranks: dict[bytes, int], pattern: str) -> Column:
    """Struct of the ids of a text and the bytes that they decode to, in one pass over the text."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("ids array<int>, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids_of, bytes_of = encoder(shared.value, pattern), decoder(shared.value)
        for batch in batches:
            ids = [ids_of(t) for t in batch]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(list(map(bytes_of, ids)), dtype=object)})

    return run(text.cast("string"))


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row with the rank table as an array of small maps, to be joined to distinct words or used as a scalar."""
    rows = spark.createDataFrame([(bytearray(p), r) for p, r in ranks.items()], "piece binary, rank int")
    slot = (F.crc32("piece") % _MAPS).cast("int").alias("slot")
    slots = rows.groupBy(slot).agg(F.collect_list(F.struct("piece", "rank")).alias("e"))
    all_slots = spark.range(_MAPS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    table = all_slots.agg(F.array_sort(F.collect_list(F.struct("slot", "e"))).alias("a"))
    nothing = F.array().cast("array<struct<piece:binary,rank:int>>")
    return table.select(F.transform("a", lambda s: F.map_from_entries(F.coalesce(s["e"], nothing))).alias("ranks"))


def encode_words(words: DataFrame, ranks: DataFrame, word_col: str = "word") -> DataFrame:
    """Distinct words with their ids, every merge a step of a fold over the array of pieces. Stays in the JVM."""
    table = ranks.scalar()

    def rank(piece: Column) -> Column:
        return F.element_at(F.get(F.col("__ranks"), (F.crc32(piece) % _MAPS).cast("int")), piece)

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.size(pieces) - 1),
            lambda j: F.struct(rank(F.concat(F.get(pieces, j - 1), F.get(pieces, j))).alias("r"), j.alias("j")),
        )
        best = F.array_min(F.filter(pairs, lambda p: p["r"].isNotNull()))
        merged = F.transform(
            F.array(best),
            lambda b: F.when(b.isNull(), pieces).otherwise(
                F.concat(
                    F.slice(pieces, 1, b["j"] - 1),
                    F.array(F.concat(F.get(pieces, b["j"] - 1), F.get(pieces, b["j"]))),
                    F.slice(pieces, b["j"] + 2, F.size(pieces)),
                )
            ),
        )
        return F.when(F.size(pieces) < 2, pieces).otherwise(F.get(merged, F.lit(0)))

    word = F.col(word_col).cast("binary")
    n = F.octet_length(F.col(word_col))
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("__bytes"), i, F.lit(1)))
    rows = words.where(F.col(word_col).isNotNull() & (n > 0)).select(word_col).distinct()
    rows = rows.withColumns({"__bytes": word, "__ranks": table})
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step)
    return rows.select(word_col, F.transform(folded, rank).alias("ids"))
