"""Which names of a table of any size stand anywhere inside a text.

Positions of a text are fingerprinted as they stream by: the code points of a window make one 64-bit number, and a bit table of
fixed size tells whether any name has that number. No piece of text is made before both tests are passed: that of the window as long as the
shortest name, which every position takes, and that of each length that occurs among the names, which only the positions left take. What passes is joined
to the names on equality, so a chance hit of the table costs a row and never a wrong answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 24
BUCKET = 32_768  # bits of one bitmap of Spark's bitmap functions
CHUNK = 1 << 20  # code points looked at together
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_END = np.uint32(0xFFFFFFFF)


def fingerprints(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bit number of the window of ``length`` code points at every start."""
    h = np.full(len(starts), length, dtype=np.uint64)
    for i in range(length):
        h = h * _BASE + codes[starts + i]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def name_bits(names: DataFrame, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Two bit tables of 2**BITS bits: of the first ``lengths[0]`` code points of every name, and of all whole names.

    Spark sets the bits; the driver gets at most 2**BITS / 32,768 bitmaps of four kilobytes for each.
    """
    shortest = lengths[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, whole = [], []
            for name in batch.column(0).to_pylist():
                codes, at = _code_points(name), np.zeros(1, dtype=np.int64)
                head.append(int(fingerprints(codes, at, shortest)[0]))
                whole.append(int(fingerprints(codes, at, len(codes))[0]))
            yield pa.RecordBatch.from_pydict({"head": pa.array(head, pa.int64()), "whole": pa.array(whole, pa.int64())})

    found = names.mapInArrow(run, "head long, whole long").select(F.posexplode(F.array("head", "whole")).alias("which", "bit"))
    maps = found.groupBy("which", F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(BUCKET))).alias("map"))
    tables = np.zeros((2, 1 << BITS >> 3), dtype=np.uint8)
    for r in maps.collect():
        at = r["bucket"] * (BUCKET >> 3)
        tables[r["which"], at : at + (BUCKET >> 3)] = np.frombuffer(r["map"], dtype=np.uint8)
    return tables[0], tables[1]


def _set(table: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def _pieces(texts: list[str], lengths: list[int], heads: np.ndarray, wholes: np.ndarray) -> Iterator[tuple[int, str]]:
    """(number of the text, piece) of all windows whose bits are set, each different pair once."""
    parts = [c for t in texts for c in (_code_points(t), np.array([_END]))]
    codes = np.concatenate([*parts, np.full(lengths[-1], _END)])
    ends = np.cumsum([len(c) for c in parts])[1::2]
    starts = np.arange(ends[-1])
    starts = starts[_set(heads, fingerprints(codes, starts, lengths[0]))]
    for length in lengths:
        hits = starts[_set(wholes, fingerprints(codes, starts, length))]
        owner = np.searchsorted(ends, hits, side="right")
        hits, owner = hits[hits + length < ends[owner]], owner[hits + length < ends[owner]]
        seen = {(o, codes[h : h + length].tobytes()) for h, o in zip(hits.tolist(), owner.tolist(), strict=True)}
        for o, raw in seen:
            yield o, raw.decode("utf-32-le", "surrogatepass")


def contained_names(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, alias), each once: the names (distinct, one column ``alias``) that a text holds; case counts. Empty names are in no text."""
    names = names.where(F.length("alias") > 0)
    lengths = sorted(r[0] for r in names.select(F.length("alias")).distinct().collect())  # the lengths that occur, not the names
    if not lengths:
        return texts.select(key, F.lit(None).cast("string").alias("alias")).limit(0)
    heads, wholes = name_bits(names, lengths)
    shared = texts.sparkSession.sparkContext.broadcast((lengths, heads, wholes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("text").to_pylist()
            at = 0
            while at < len(bodies):
                end, size = at, 0
                while end < len(bodies) and (size == 0 or size + len(bodies[end]) <= CHUNK):
                    size += len(bodies[end]) + 1
                    end += 1
                found = list(_pieces(bodies[at:end], *shared.value))
                if found:
                    rows, pieces = zip(*found, strict=True)
                    keys = batch.column("key").take(pa.array([at + r for r in rows], pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(pieces, pa.string())], ["key", "alias"])
                at = end

    kind = texts.schema[key].dataType.simpleString()
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    pieces = rows.mapInArrow(run, f"key {kind}, alias string")
    return pieces.join(names, "alias").select(F.col("key").alias(key), "alias")
