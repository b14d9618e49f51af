"""Suffix-array dedup: removal of every byte inside a long string that occurs more than once in the corpus.

The suffix array is sparse: it holds the suffixes that start at anchors. An anchor is a place whose hash of ``GRAM`` bytes is the
smallest of a window; the window is so wide that every string of ``MIN_LENGTH`` bytes has an anchor that its own bytes
decide, so equal strings have equal anchors at the same offset. Around an anchor only ``MIN_LENGTH`` bytes to the right and a
window to the left matter (its context).

1. Anchors are read from every text. Contexts are hashed; a context that occurs twice is repeated as a whole, and a gram hash that
   occurs once repeats nothing. Only gram hashes with different contexts are left, one representative for each context, cut from one
   copy of its text.
2. For these, threshold-bounded interval expansion: the suffixes at the anchors of one gram are sorted, neighbours get the length
   of their common prefix, and the interval is extended backwards, breadth first, by the symbol before each suffix
   (the symbol of the Burrows-Wheeler transform). An interval splits into one for each symbol; intervals of one suffix end. Wherever the
   extension plus the common prefix reaches ``MIN_LENGTH`` the string is repeated.
3. The reaches go back to all occurrences, are merged per text, and cut out. A text that occurs twice is repeated as a whole.

Grams with more than ``LARGEST`` different contexts do not enter one task: hashes of their windows of ``MIN_LENGTH`` bytes are counted
instead, stretches of windows first, which gives the same bytes by plain aggregates.

Defined results: null and empty texts have no bytes and lose none; a text shorter than ``MIN_LENGTH`` loses none; rows that repeat a text
lose all of it when it is long enough, every copy alike; strings are judged on the input. Cuts may split a UTF-8 character, so the
operator returns bytes, and the spans. Contexts are told apart by 64-bit hashes within one gram hash, texts by md5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.hashing import mix
from tidemark.llm.workers import lean
from tidemark.operators.distributed import discard, materialize, release

MIN_LENGTH = 400
GRAM = 32
REACH = MIN_LENGTH - GRAM
LARGEST = 20_000
STRETCH = 20
_BATCH = 20_000
_SLICE = 4000
_TEXTS = 256
_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    global _UP, _DOWN
    while len(_UP) < n:
        size = len(_UP)
        up, down = np.uint64(pow(_BASE, size, 1 << 64)), np.uint64(pow(pow(_BASE, -1, 1 << 64), size, 1 << 64))
        _UP, _DOWN = np.concatenate([_UP, _UP * up]), np.concatenate([_DOWN, _DOWN * down])
    return _UP[:n], _DOWN[:n]


class Substrings:
    """Hashes of any substrings of one byte string, from running sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * up[:-1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every full window (running minima from both sides of blocks)."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, context hash and place of every anchor of a text; none in a text shorter than ``MIN_LENGTH``."""
    if len(raw) < MIN_LENGTH:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    width = REACH + 1
    of = Substrings(raw)
    starts = np.arange(len(raw) - GRAM + 1)
    grams = of.hashes(starts, starts + GRAM)
    lowest = _sliding_min(grams, width)
    edge = np.zeros(width - 1, dtype=np.uint64)
    highest = ~_sliding_min(~np.concatenate([edge, lowest, edge]), width)
    places = np.flatnonzero(grams == highest)
    contexts = of.hashes(np.maximum(places - REACH, 0), np.minimum(places + MIN_LENGTH, len(raw)))
    shape = (np.minimum(places, REACH) * (MIN_LENGTH + 1) + np.minimum(len(raw) - places, MIN_LENGTH)).astype(np.uint64)
    return grams[places], mix(contexts + shape), places


@lean
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(at, _TEXTS)
            out = []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    grams, contexts, places = anchors(np.frombuffer(text.encode(), dtype=np.uint8))
                    if len(places):
                        out.append((key, grams.view(np.int64), contexts.view(np.int64), places))
            kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "gram", "context", "place"])


@lean
def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["gram", "context", "before", "after"]
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(at, _TEXTS)
            out = []
            for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                raw = text.encode()
                for w in wanted:
                    place = w["place"]
                    out.append((w["gram"], w["context"], raw[max(0, place - REACH) : place], raw[place : place + MIN_LENGTH]))
                if len(out) >= _SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def _common_prefix(right: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the right contexts i and j."""
    out = np.zeros(len(i), dtype=np.int64)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        differs = np.concatenate([right[a] != right[b], np.ones((len(a), 1), dtype=bool)], axis=1)
        out[at : at + 4096] = np.minimum(differs.argmax(axis=1), np.minimum(length[a], length[b]))
    return out


def expand(gram: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes before and after its anchor that lie in a string repeated in another context (0, 0: none)."""
    n = len(gram)
    by_suffix = sorted(range(n), key=lambda x: (gram[x], after[x]))
    grams = gram[by_suffix]
    left_length = np.array([len(before[x]) for x in by_suffix], dtype=np.int64)
    right_length = np.array([len(after[x]) for x in by_suffix], dtype=np.int64)
    right = np.frombuffer(b"".join(after[x].ljust(MIN_LENGTH, b"\0") for x in by_suffix), dtype=np.uint8).reshape(n, MIN_LENGTH)
    left = np.frombuffer(b"".join(before[x].rjust(REACH, b"\0")[::-1] for x in by_suffix), dtype=np.uint8).reshape(n, REACH)
    reach_left, reach_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    members = np.arange(n)
    interval = np.cumsum(np.diff(grams, prepend=grams[:1]) != 0)
    common = np.zeros(n, dtype=np.int64)
    common[1:] = np.where(interval[1:] == interval[:-1], _common_prefix(right, right_length, members[:-1], members[1:]), -1)
    if n:
        common[0] = -1
    for depth in range(REACH + 1):
        found = np.flatnonzero((common >= 0) & (common + depth >= MIN_LENGTH))
        for side in (members[found], members[found - 1]):
            reach_left[side] = depth
            np.maximum.at(reach_right, side, common[found])
        if depth == REACH:
            break
        keep = left_length[members] > depth
        symbol = left[members, depth]
        steady = keep.all() and not np.any((interval[1:] == interval[:-1]) & (symbol[1:] != symbol[:-1]))
        if steady:
            continue
        place = np.flatnonzero(keep)
        place = place[np.lexsort((place, symbol[place], interval[place]))]
        same = np.zeros(len(place), dtype=bool)
        same[1:] = (interval[place][1:] == interval[place][:-1]) & (symbol[place][1:] == symbol[place][:-1])
        together = same.copy()
        together[:-1] |= same[1:]
        place, same = place[together], same[together]
        if not len(place):
            break
        adjacent = np.zeros(len(place), dtype=bool)
        adjacent[1:] = np.diff(place) == 1
        fresh = np.where(same & adjacent, common[place], -1)
        apart = np.flatnonzero(same & ~adjacent)
        moved = members[place]
        fresh[apart] = _common_prefix(right, right_length, moved[apart - 1], moved[apart])
        members, interval, common = moved, np.cumsum(~same), fresh
    out_left, out_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    out_left[by_suffix], out_right[by_suffix] = reach_left, reach_right
    return out_left, out_right


@lean
def _expand_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of one gram, gathered to batches. Rows come sorted by gram and context."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.drop_duplicates(["gram", "context"])
        left, right = expand(batch["gram"].to_numpy(), batch["before"].tolist(), batch["after"].tolist())
        hit = left + right >= MIN_LENGTH
        return pd.DataFrame({"gram": batch["gram"][hit], "context": batch["context"][hit], "to_left": left[hit], "to_right": right[hit]})

    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= _BATCH:
            rows = pd.concat(held, ignore_index=True)
            last = rows["gram"] == rows["gram"].iloc[-1]
            if not last.all():
                yield run(rows[~last])
                rows = rows[last]
            held = [rows]
    if held:
        yield run(pd.concat(held, ignore_index=True))


def _names(rows: list[tuple], what: list[str]) -> pd.DataFrame:
    """Columns of many small arrays put together, with the gram and the context repeated for each."""
    lengths = [len(r[2]) for r in rows]
    out = {c: np.repeat(np.array([r[i] for r in rows], dtype=np.int64), lengths) for i, c in enumerate(("gram", "context"))}
    return pd.DataFrame(out | {c: np.concatenate([r[i + 2] for r in rows]) if rows else [] for i, c in enumerate(what)})


@lean
def _stretch_names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For every stretch of depths of a context the hash of what all its windows have in common, and of all they cover.

    Windows start ``depth`` bytes before the anchor. The cover is left out (kind 0 only) where the context does not hold it whole.
    """
    for frame in frames:
        for at in range(0, len(frame), 500):
            rows = []
            for gram, context, before, after in zip(*(frame[c].iloc[at : at + 500] for c in ("gram", "context", "before", "after")), strict=True):
                of, anchor = Substrings(np.frombuffer(before + after, dtype=np.uint8)), len(before)
                size = anchor + len(after)
                first = np.arange(0, REACH + 1, STRETCH)
                last = first + STRETCH - 1
                core = (anchor - first >= 0) & (anchor + MIN_LENGTH - last <= size)
                cover = (anchor - last >= 0) & (anchor + MIN_LENGTH - first <= size) & (last <= REACH)
                names = [of.hashes(anchor - first[core], anchor + MIN_LENGTH - last[core]), of.hashes(anchor - last[cover], anchor + MIN_LENGTH - first[cover])]
                kinds = np.repeat(np.arange(2), [len(n) for n in names])
                rows.append((gram, context, np.concatenate([first[core], first[cover]]), kinds, np.concatenate(names).view(np.int64)))
            yield _names(rows, ["first", "kind", "name"])


@lean
def _window_names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of the windows of the wanted stretches of a context."""
    for frame in frames:
        for at in range(0, len(frame), 500):
            rows = []
            for gram, context, before, after, wanted in zip(*(frame[c].iloc[at : at + 500] for c in ("gram", "context", "before", "after", "wanted")), strict=True):
                of, anchor = Substrings(np.frombuffer(before + after, dtype=np.uint8)), len(before)
                depth = np.concatenate([np.arange(f, min(f + STRETCH, REACH + 1)) for f in wanted])
                depth = depth[(depth <= anchor) & (MIN_LENGTH - depth <= len(after))]
                rows.append((gram, context, depth, of.hashes(anchor - depth, anchor - depth + MIN_LENGTH).view(np.int64)))
            yield _names(rows, ["depth", "name"])


def _counted_reaches(contexts: DataFrame) -> DataFrame:
    """The same as ``expand`` for grams of any number of contexts, by counting hashes.

    Depths are taken in stretches. Where all that the windows of a stretch cover occurs twice, all of them do; where what they have in
    common occurs once, none does; only the windows of the other stretches are hashed one by one, and those of one context for each
    repeated cover, which they may meet.
    """
    stretches = materialize(contexts.mapInPandas(_stretch_names, "gram long, context long, first long, kind int, name long"), "suffix-stretches")
    again = stretches.groupBy("gram", "first", "kind", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    seen = materialize(stretches.join(again, ["gram", "first", "kind", "name"]), "suffix-seen")
    per = seen.groupBy("gram", "context", "first").agg(F.max("kind").alias("covered"))
    whole = per.where("covered = 1").groupBy("gram", "context").agg(
        F.max(F.col("first") + STRETCH - 1).alias("to_left"), F.max(F.lit(MIN_LENGTH) - F.col("first")).alias("to_right")
    )
    one_each = seen.where("kind = 1").groupBy("gram", "first", "name").agg(F.min("context").alias("context"))
    wanted = per.where("covered = 0").select("gram", "context", "first").unionByName(one_each.select("gram", "context", "first"))
    wanted = wanted.groupBy("gram", "context").agg(F.collect_set("first").alias("wanted"))
    open_windows = contexts.join(wanted, ["gram", "context"])
    names = materialize(open_windows.mapInPandas(_window_names, "gram long, context long, depth long, name long"), "suffix-windows")
    twice = names.groupBy("gram", "depth", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = names.join(twice, ["gram", "depth", "name"]).groupBy("gram", "context").agg(
        F.max("depth").alias("to_left"), F.max(F.lit(MIN_LENGTH) - F.col("depth")).alias("to_right")
    )
    return whole.unionByName(single).select("gram", "context", F.col("to_left").cast("long").alias("to_left"), F.col("to_right").cast("long").alias("to_right"))


def reaches(contexts: DataFrame, groups: DataFrame) -> DataFrame:
    """(gram, context, to_left, to_right) of contexts that share a string of ``MIN_LENGTH`` bytes with another of their gram."""
    dealt = contexts.join(groups.select("gram", (F.col("different") > LARGEST).alias("large")), "gram")
    small = dealt.where("not large").drop("large").repartition("gram").sortWithinPartitions("gram", "context")
    expanded = small.mapInPandas(_expand_groups, "gram long, context long, to_left long, to_right long")
    large = materialize(dealt.where("large").drop("large").dropDuplicates(["gram", "context"]), "suffix-large")
    return expanded.unionByName(_counted_reaches(large))


def repeated_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key`` (md5 of the text) and ``spans``, the reaches (start, end) that are repeated, for texts that have any."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= MIN_LENGTH)
    texts = texts.select(F.unhex(F.md5("text")).alias("key"), "text")
    read = materialize(texts.mapInArrow(_read, "key binary, gram array<long>, context array<long>, place array<long>"), "suffix-anchors")
    rows = read.select("key", F.explode(F.arrays_zip("gram", "context", "place")).alias("a")).select("key", "a.*")
    contexts = rows.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("one"))
    per_gram = contexts.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different")).where("total > 1")
    groups = materialize(per_gram, "suffix-grams")
    alive = materialize(contexts.join(groups, "gram"), "suffix-contexts")
    release(docs.sparkSession)
    wanted = alive.where("different > 1").groupBy(F.col("one.key").alias("key")).agg(
        F.collect_list(F.struct("gram", "context", F.col("one.place").alias("place"))).alias("wanted")
    )
    cut = texts.dropDuplicates(["key"]).join(wanted, "key").select("text", "wanted").mapInArrow(_cut_contexts, "gram long, context long, before binary, after binary")
    cut = materialize(cut, "suffix-cuts")
    release(docs.sparkSession)
    found = reaches(cut, groups.where("different > 1"))
    whole = alive.where("n > 1").select("gram", "context", F.lit(REACH).cast("long").alias("to_left"), F.lit(MIN_LENGTH).cast("long").alias("to_right"))
    reach = found.unionByName(whole).groupBy("gram", "context").agg(F.max("to_left").alias("to_left"), F.max("to_right").alias("to_right"))
    spans = rows.join(reach, ["gram", "context"]).select(
        "key", F.struct(F.greatest(F.col("place") - F.col("to_left"), F.lit(0)).alias("start"), (F.col("place") + F.col("to_right")).alias("end")).alias("s")
    )
    out = materialize(spans.groupBy("key").agg(F.collect_set("s").alias("spans")), "suffix-spans")
    discard(read, groups, alive, cut)
    return out


SPAN = "array<struct<start:bigint,end:bigint>>"


def merged(spans: Column, size: Column) -> Column:
    """Sorted spans without overlap, inside the text, each at least ``MIN_LENGTH`` long before merging."""
    inside = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], size).alias("end")))
    long_enough = F.sort_array(F.filter(inside, lambda s: s["end"] - s["start"] >= MIN_LENGTH))

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["start"] <= last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(long_enough, F.array().cast(SPAN), add)


def kept_bytes(raw: Column, starts: Column, ends: Column) -> Column:
    """The bytes outside the spans, put together."""
    from_, to = F.concat(F.array(F.lit(0).cast("long")), ends), F.concat(starts, F.array(F.octet_length(raw).cast("long")))
    pieces = F.zip_with(from_, to, lambda f, t: F.substring(raw, (f + 1).cast("int"), (t - f).cast("int")))
    return F.aggregate(pieces, F.lit(b"").cast("binary"), lambda done, piece: F.concat(done, piece))


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row as the struct ``row``, with ``n_bytes``, ``n_removed``, the removed spans and the ``kept`` bytes."""
    spans = repeated_spans(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    release(docs.sparkSession)
    copies = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "suffix-copies")
    known = spans.join(copies, "key", "full_outer").select("key", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")
    size = F.octet_length("text").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    none = F.array().cast(SPAN)
    cuts = F.when((F.coalesce("copies", F.lit(1)) > 1) & (size >= MIN_LENGTH), whole).otherwise(F.coalesce(merged(F.col("spans"), size), none))
    # exploded from an array of one, so that the fold over the spans is run once a row
    placed = rows.join(known, "key", "left").select("row", F.col("text").cast("binary").alias("raw"), F.explode(F.array(F.struct(size.alias("n_bytes"), cuts.alias("cuts")))).alias("c"))
    starts, ends = F.transform("c.cuts", lambda s: s["start"]), F.transform("c.cuts", lambda s: s["end"])
    removed = F.aggregate("c.cuts", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    kept = F.when(F.size("c.cuts") == 0, F.col("raw")).otherwise(kept_bytes(F.col("raw"), starts, ends))
    return placed.select("row", "c.n_bytes", removed.alias("n_removed"), starts.alias("starts"), ends.alias("ends"), kept.alias("kept"))


def _decoded(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))


def readable(kept: Column) -> Column:
    """Text of kept bytes; characters that a cut has split are left out."""
    return F.pandas_udf(_decoded, "string")(kept)
