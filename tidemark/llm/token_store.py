"""Token ids as binary blocks: every document compressed by itself with one shared zstandard dictionary.

1. The dictionary is trained on the serialised ids of a sample: about ``SAMPLE`` distinct texts of at most ``SAMPLE_BYTES`` bytes, chosen by text
   hash. Only this sample reaches the driver. Too few samples to train on become a raw-content dictionary.
2. Texts are put in ascending order of id by ranges (nulls first; ties by content). The task of a range encodes each text, appends the end id, writes the ids
   as little-endian integers, compresses them (one frame a document) and packs frame after frame into blocks of about ``BLOCK`` bytes, all as the texts
   stream by. The tokenizer splits at white space, so a task keeps the ids of the parts it has met in a memory of bounded size.
3. A block is written as one binary value, so Spark's writer commits it on any store and a lost executor leaves no half file.
4. Block: magic ``TMTK``, version, bytes per id, number of documents (4 bytes), first 8 bytes of the dictionary's sha256, then three columns of the offset
   index (ids as 8 bytes, null flags as 1 byte, ends of frames as 8 bytes), then the frames. All numbers are little-endian.
5. ``read_back`` decompresses all blocks; ``read_documents`` finds the blocks of some ids in the index and decompresses only their frames. Both refuse a
   block whose dictionary hash is another one.

Defined results: null and empty texts hold the end id only; repeated ids and rows are kept; an empty table gives a store without blocks. Strings of special
tokens in a text become their ids, as the tokenizers library does by default. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tidemark.operators.distributed import materialize

SAMPLE = 2_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 112_640
LEVEL = 3
MEMORY = 300_000
LONG_WORD = 100
SLICE = 512
BLOCK = 1 << 20
RANGE_BYTES = 32 << 20
MOST_RANGES = 4096
MAGIC = b"TMTK"
HEAD = struct.Struct("<4sBBI8s")


# --- ids of a text -------------------------------------------------------------------------------------------------


def id_width(tokenizer: str) -> int:
    """Bytes that hold any id of the tokenizer: 2 or 4."""
    return 2 if Tokenizer.from_str(tokenizer).get_vocab_size() <= 65_536 else 4


# Texts of common Latin letters, ASCII marks and blanks (without the dotted capital I, whose small form has two characters), and the
# parts into which the tokenizer's split pattern cuts such a text in lower case.
PLAIN_TEXT = re.compile("[ \n\t\r!-~À-įı-ž]*")
PARTS = re.compile("[a-zß-öø-ž]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ž0-9 \n\t\r]+")


class WordIds:
    """Serialised ids of words, asked of the tokenizers library and remembered in a memory of bounded size.

    A plain text is cut into the parts that the tokenizer's own pattern gives; parts not met before are encoded many at a time, and told apart again by
    the marks that the vocabulary sets on the last id of each. Any other text is cut at blanks, and its new words are encoded one by one. The
    memory has two halves: parts met lately, and those met before the last change of halves, which come back when they are met again.
    """

    def __init__(self, tokenizer: str, width: int):
        self.library, self.kind = Tokenizer.from_str(tokenizer), f"<u{width}"
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = json.loads(tokenizer)["model"].get("end_of_word_suffix") or ""
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[str]) -> dict[str, bytes]:
        """Of parts that the pattern does not cut again; nothing if the marks do not agree."""
        ids = self._encode([" ".join(parts)])[0]
        cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()]
        raw = ids.tobytes()
        if len(cuts) != len(parts) + 1 or cuts[-1] != len(raw):
            return {}
        return dict(zip(parts, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def learn(self, words: list[str], plain: bool) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        for at in range(0, len(words), 500):
            part = words[at : at + 500]
            known = self._together(part) if plain else {}
            found |= known or dict(zip(part, (ids.tobytes() for ids in self._encode(part)), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Serialised ids of texts.

        Blanks and line ends are no part of any token, and no normalisation reaches across them, so the ids of a text are those of
        its words one after the other. Words longer than ``LONG_WORD`` are not kept.
        """
        texts = [t or "" for t in texts]
        plain = ["<|" not in t and PLAIN_TEXT.fullmatch(t) is not None for t in texts]
        cut = [PARTS.findall(t.lower()) if p else t.replace("\n", " ").split(" ") for t, p in zip(texts, plain, strict=True)]
        if len(self.memory) > MEMORY:
            self.memory, self.older = {}, self.memory
        memory, older = self.memory, self.older
        long = []
        for kind in (True, False):
            missing = set().union(*(c for c, p in zip(cut, plain, strict=True) if p is kind)).difference(memory)
            memory.update((w, older[w]) for w in missing if w in older)
            fresh = self.learn([w for w in missing if w not in older], kind)
            memory.update(fresh)
            long += [w for w in fresh if len(w) > LONG_WORD]
        out = [b"".join(map(memory.__getitem__, words)) for words in cut]
        for w in long:
            memory.pop(w, None)
        return out


@lru_cache(maxsize=2)
def word_ids(tokenizer: str, width: int) -> WordIds:
    """One per Python worker."""
    return WordIds(tokenizer, width)


# --- dictionary ----------------------------------------------------------------------------------------------------


def train(samples: list[bytes]) -> bytes:
    """Dictionary bytes: trained, or the samples themselves where there are too few to train on."""
    samples = [s for s in samples if s]
    if sum(map(len, samples)) > 10 * DICTIONARY_BYTES and len(samples) >= 100:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:8]


def _zstandard_dictionary(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None


@lru_cache(maxsize=2)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    found = _zstandard_dictionary(dictionary)
    if found:
        found.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_dict_id=False)


@lru_cache(maxsize=2)
def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_zstandard_dictionary(dictionary))


def measured(docs: DataFrame, text: str) -> tuple[int, int]:
    """(bytes of all texts, estimate of the number of distinct texts short enough to train on), in one reading."""
    sized = docs.select(F.col(text).cast("string").alias("text"))
    short = F.when(F.octet_length("text").between(1, SAMPLE_BYTES), F.xxhash64("text"))
    total, distinct = sized.agg(F.sum(F.octet_length("text")), F.approx_count_distinct(short)).first()
    return total or 0, distinct


def learn_dictionary(docs: DataFrame, text: str, end_id: int, tokenizer: str, distinct: int) -> bytes:
    """Trained on about ``SAMPLE`` distinct texts: those whose hash is below a threshold that follows from an estimate of the number of texts."""
    short = docs.select(F.col(text).cast("string").alias("text")).where(F.octet_length("text").between(1, SAMPLE_BYTES)).withColumn("hash", F.xxhash64("text"))
    share = min(1.0, SAMPLE / max(1, distinct))
    chosen = short.where(F.shiftrightunsigned("hash", 1).cast("double") <= share * 2.0**63).dropDuplicates(["hash"])
    rows = sorted((r["hash"], r["text"]) for r in chosen.collect())  # at most some SAMPLE * SAMPLE_BYTES bytes
    width = id_width(tokenizer)
    end = end_id.to_bytes(width, "little")
    return train([ids + end for ids in word_ids(tokenizer, width).encode([t for _, t in rows])])


# --- blocks --------------------------------------------------------------------------------------------------------


def pack(ids: list[int], nulls: list[bool], frames: list[bytes], width: int, digest: bytes) -> bytes:
    ends = np.cumsum([len(f) for f in frames], dtype="<u8")
    head = HEAD.pack(MAGIC, 1, width, len(frames), digest)
    return b"".join([head, np.array(ids, dtype="<i8").tobytes(), np.array(nulls, dtype=np.uint8).tobytes(), ends.tobytes(), *frames])


@dataclass(frozen=True)
class Opened:
    """A block with its offset index; frames stay compressed until asked for."""

    width: int
    ids: np.ndarray
    nulls: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    frames: memoryview

    def raw(self, slot: int, dictionary: bytes) -> bytes:
        """Serialised ids of one document."""
        return decompressor(dictionary).decompress(self.frames[self.starts[slot] : self.ends[slot]])

    def wide(self, slot: int, dictionary: bytes) -> np.ndarray:
        return np.frombuffer(self.raw(slot, dictionary), dtype=f"<u{self.width}").astype("<u4")


def open_block(block: bytes, dictionary: bytes) -> Opened:
    magic, version, width, n, digest = HEAD.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a block of token ids")
    if digest != dictionary_hash(dictionary):
        raise ValueError("the block was written with another dictionary")
    at = HEAD.size
    ids = np.frombuffer(block, dtype="<i8", count=n, offset=at)
    nulls = np.frombuffer(block, dtype=np.uint8, count=n, offset=at + 8 * n).astype(bool)
    ends = np.frombuffer(block, dtype="<u8", count=n, offset=at + 9 * n).astype(np.int64)
    return Opened(width, ids, nulls, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, memoryview(block)[at + 17 * n :])


# --- store ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TokenStore:
    """``blocks``: (range, block, base, n_docs, n_tokens, bytes), base being the number of ids before the block; ``index``: (doc_id, no_id, range, block, slot)."""

    blocks: DataFrame
    index: DataFrame
    dictionary: bytes


BLOCKS = "range int, block int, first long, n_docs int, n_tokens long, bytes binary"


def blocks(rows: DataFrame, tokenizer: str, end_id: int, dictionary: bytes, block_bytes: int) -> DataFrame:
    """Blocks of the rows (id, no_id, text, range), which lie in order within their partition; ``first`` counts the ids before a block within its range.

    Texts are encoded, compressed and packed as they stream by: a task holds one slice of texts and the frames of one block.
    """
    width = id_width(tokenizer)
    shared = rows.sparkSession.sparkContext.broadcast((tokenizer, dictionary))
    end, digest = end_id.to_bytes(width, "little"), dictionary_hash(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = word_ids(shared.value[0], width).encode, compressor(shared.value[1]).compress
        held: list[tuple] = []
        size = first = block = 0

        def written() -> pa.RecordBatch:
            ids, nulls, counts, frames, ranges = zip(*held, strict=True)
            row = {"range": [ranges[0]], "block": [block], "first": [first], "n_docs": [len(held)], "n_tokens": [sum(counts)]}
            row["bytes"] = [pack(ids, nulls, frames, width, digest)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keys = (part.column(c).to_pylist() for c in ("id", "no_id", "range"))
                for doc, null, place, ids in zip(*keys, encode(part.column("text").to_pylist()), strict=True):
                    raw = ids + end
                    held.append((doc, null, len(raw) // width, squeeze(raw), place))
                    size += len(held[-1][3])
                    if size >= block_bytes:
                        yield written()
                        first, block, size, held = first + sum(h[2] for h in held), block + 1, 0, []
        if held:
            yield written()

    return rows.select("id", "no_id", "text", "range").mapInArrow(run, BLOCKS)


def write_store(
    docs: DataFrame, doc_id: str, text: str, tokenizer: str, end_id: int, block_bytes: int = BLOCK, range_bytes: int = RANGE_BYTES
) -> TokenStore:
    """Encode, compress and write all documents; ``tokenizer`` is the JSON of a tokenizers file."""
    total, distinct = measured(docs, text)
    dictionary = learn_dictionary(docs, text, end_id, tokenizer, distinct)
    key = F.col(doc_id).cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("no_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.desc("no_id"), F.asc("id"), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(max(1, min(MOST_RANGES, -(-total // range_bytes))), *order).sortWithinPartitions(*order, F.asc("text"))
    packed = materialize(blocks(ranged.withColumn("range", F.spark_partition_id()), tokenizer, end_id, dictionary, block_bytes), "token-blocks")
    totals = {r[0]: r[1] for r in packed.groupBy("range").agg(F.sum("n_tokens")).collect()}  # at most MOST_RANGES rows
    bases, before = {}, 0
    for r in sorted(totals):
        bases[r], before = before, before + totals[r]
    base = F.element_at(F.create_map(*[F.lit(v).cast(t) for r, b in bases.items() for v, t in ((r, "int"), (b, "long"))]), F.col("range")) if bases else F.lit(0)
    placed = packed.withColumn("base", (base + F.col("first")).cast("long")).drop("first")
    return TokenStore(placed, _index(placed, dictionary), dictionary)


def _index(stored: DataFrame, dictionary: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, b, block in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "bytes")), strict=True):
                found = open_block(block, dictionary)
                n = len(found.ids)
                columns = [pa.array(found.ids), pa.array(found.nulls), pa.array([r] * n, pa.int32()), pa.array([b] * n, pa.int32()), pa.array(range(n), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "no_id", "range", "block", "slot"])

    return stored.select("range", "block", "bytes").mapInArrow(run, "doc_id long, no_id boolean, range int, block int, slot int")


def read_back(store: TokenStore) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, from the blocks alone."""
    shared = store.blocks.sparkSession.sparkContext.broadcast(store.dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, block in zip(batch.column("base").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                found = open_block(block, shared.value)
                ids = [found.wide(slot, shared.value) for slot in range(len(found.ids))]
                counts = np.array([len(i) for i in ids], dtype=np.int64)
                sums = pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())
                starts = pa.array(base + np.cumsum(counts) - counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.ids, mask=found.nulls), starts, pa.array(counts), sums], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return store.blocks.select("base", "bytes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(store: TokenStore, wanted: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, token_ids) of the wanted documents: only their blocks are read and only their frames decompressed."""
    asked = wanted.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    slots = store.index.where(~F.col("no_id")).join(asked, "doc_id").groupBy("range", "block").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    needed = store.blocks.select("range", "block", "bytes").join(slots, ["range", "block"]).select("bytes", "slots")
    shared = store.blocks.sparkSession.sparkContext.broadcast(store.dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, chosen in zip(batch.column("bytes").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                found = open_block(block, shared.value)
                ids = pa.array([found.wide(s, shared.value).tolist() for s in chosen], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(found.ids[chosen]), ids], ["doc_id", "token_ids"])

    return needed.mapInArrow(run, "doc_id long, token_ids array<long>")
