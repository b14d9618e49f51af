"""Document fingerprints: a quartile bucket digest of hashed byte triplets, and its bounded difference score.

Every byte triplet of the UTF-8 text is hashed into one of ``BUCKETS`` counters. A counter is written as the quartile
of the document's own counters that it falls into (two bits), so a digest depends on the shape of the text and not on its
length; the length is kept beside it as a logarithmic class. Two digests are compared bucket by bucket, like TLSH: a step of
one or two quartiles costs 1 or 2, opposite quartiles cost 6, and the length classes add a capped term. The sum has a
largest value, so the likeness ``1 - difference / largest`` is always between 0 and 1 and is 1 for equal texts.

Defined results: a null text counts as empty; a text under three bytes has no triplet (all buckets 0); rows are
never dropped, so repeated rows and repeated or null ids keep one output row each. Null ids sort before all others, ties of the id
are ordered by the text's hash. Other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.ordering import restored, with_id

BUCKETS = 1024
LENGTH_CAP = 32
_OPPOSITE = np.array([0, 1, 2, 6], dtype=np.int64)
_LARGEST = 6 * BUCKETS + LENGTH_CAP
_PIECE = 1 << 20


def triplet_counts(data: bytes) -> np.ndarray:
    """Occurrences of hashed byte triplets per bucket; long texts are counted piece by piece in fixed memory."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(0, len(raw) - 2), _PIECE):
        b = raw[at : at + _PIECE + 2].astype(np.uint32)
        mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(22), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> bytes:
    """Length class (one byte) followed by the quartile codes, four buckets to a byte."""
    counts = triplet_counts(data)
    marks = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > marks).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return bytes([min(255, int(np.log1p(len(data)) * 8))]) + packed.astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 minus the bounded difference of two digests."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    shifts = np.array([0, 2, 4, 6], dtype=np.uint8)
    left, right = (x[1:, None] >> shifts & 3).astype(np.int64), (y[1:, None] >> shifts & 3).astype(np.int64)
    score = int(_OPPOSITE[np.abs(left - right)].sum()) + min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))
    return 1.0 - score / _LARGEST


OUT_SCHEMA = (
    "doc_id long, no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def with_half_of(text: str, following: str) -> str:
    """The text whose last half (rounded down, in code points) gives way to as much of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in (bucket, id, hash) order; each is compared with the row after it, and an edge row ends its bucket."""
    held = None
    names = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    for frame in frames:
        out = []
        for bucket, doc, no_id, text, edge in zip(*(frame[c] for c in ("bucket", "doc_id", "no_id", "text", "edge")), strict=True):
            raw = text.encode()
            row = (bucket, (doc, no_id), text, digest(raw))
            if held is not None and held[0] == bucket:
                edited = with_half_of(held[2], text).encode()
                mark = digest(edited)
                sha = hashlib.sha256(edited).hexdigest()
                near = likeness(held[3], mark), likeness(held[3], row[3])
                out.append((*held[1], len(held[2]), sha, held[3].hex(), mark.hex(), *near))
            held = None if edge else row
        yield pd.DataFrame(out, columns=names)


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_range: int = 16 << 20) -> DataFrame:
    """Digest of every text, of its edited form, and the likeness to the edited form and to the next text by id.

    The ids are cut into ranges of about ``bytes_per_range`` of text. Texts move once, to their range; the first row of each
    range also travels to the range before it (the very first to the last), so that no task needs another's rows. Only the
    range limits, one id for each range, reach the driver.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // bytes_per_range))
    limits = []
    if parts > 1:
        points = [i / parts for i in range(1, parts)]
        found = rows.agg(F.percentile_approx("doc_id", F.lit(points), 100 * parts)).first()[0] or []
        limits = sorted(set(found))
    bucket = F.array_size(F.filter(F.array(*map(F.lit, limits)), lambda x: x <= F.col("doc_id"))) if limits else F.lit(0)
    keyed = rows.withColumn("bucket", F.coalesce(bucket, F.lit(0)).cast("int")).withColumn("hash", F.xxhash64("text"))
    firsts = keyed.groupBy("bucket").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    starts = {r["bucket"]: (r["first"]["doc_id"], r["first"]["hash"]) for r in firsts.collect()}
    if not starts:
        return restored(docs.sparkSession.createDataFrame([], OUT_SCHEMA))
    order = sorted(starts)
    edges = docs.sparkSession.createDataFrame(
        [(order[i - 1], *starts[b]) for i, b in enumerate(order)], "bucket int, e_id long, e_hash long"
    )
    same = keyed["doc_id"].eqNullSafe(edges["e_id"]) & (keyed["hash"] == edges["e_hash"])
    borrowed = keyed.drop("bucket").join(F.broadcast(edges), same).select("doc_id", "text", "bucket", "hash")
    borrowed = borrowed.dropDuplicates(["bucket"]).withColumn("edge", F.lit(True))
    placed = keyed.withColumn("edge", F.lit(False)).unionByName(borrowed)
    ordered = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "edge", "doc_id", "hash")
    return restored(ordered.select("bucket", *with_id(F.col("doc_id")), "text", "edge").mapInPandas(_compare, OUT_SCHEMA))
