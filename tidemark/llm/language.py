"""Language identification by compression: the language whose dictionary makes the text smallest.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is compressed
once with each dictionary; the smallest result names the language. Where the best two sizes lie too close together,
or the text has no letter, the decision is rejected.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected; equal sizes go to the
language first in name order and are rejected; with no labelled text at all everything is ``und``. Every row is kept,
so repeated rows repeat their result. Whole texts are compressed, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.workers import lean
from tidemark.operators.distributed import top_per_key

UNKNOWN = "und"
BLOCK = 2048
_NOT_LETTERS = regex.compile(r"\P{L}+")


def learn_dictionaries(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 256, dict_bytes: int = 1 << 18
) -> dict[str, bytes]:
    """A raw-content dictionary per language from at most ``sample_docs`` labelled texts, at most ``dict_bytes`` long.

    The sample is the texts with the smallest hashes, so it depends on nothing but the texts. At most ``sample_docs`` rows of a
    language leave any task; each offers at most an equal share of the dictionary, so that no long text fills it alone.
    """
    share = max(1, dict_bytes // sample_docs)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'").withColumn("hash", F.xxhash64("text"))
    start = F.pmod(F.col("hash"), F.greatest(F.lit(1), F.char_length("text") - share)).cast("int") + 1
    passage = F.substring("text", start, F.lit(share))
    offered = rows.select("lang", "hash", passage.alias("passage"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in top_per_key(offered, ["lang"], [F.col("hash"), F.col("passage")], sample_docs).collect():
        texts.setdefault(r["lang"], []).append((r["rank"], r["passage"]))
    return {
        lang: " ".join(letters_only(p) for _, p in sorted(texts[lang])).encode()[:dict_bytes] for lang in sorted(texts)
    }


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, raw in dictionaries:
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False))
    return out


def letters_only(text: str) -> str:
    """Lower-case letters with single blanks between words: symbols, digits and case tell nothing about a language."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], level: int, min_margin: float) -> tuple:
    """(language, score, margin, rejected) of one text; the margin is the second size over the best, less 1.

    The text is compressed in blocks, every block afresh with the dictionary, so that a long text is measured by the language
    all along and not by its own repetitions.
    """
    plain = "" if text is None else letters_only(text)
    if not dictionaries or not plain:
        return UNKNOWN, 0.0, 0.0, True
    raw = plain.encode()
    blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    sizes = [sum(len(c.compress(block)) for block in blocks) for c in _compressors(dictionaries, level)]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    if len(sizes) == 1:
        return dictionaries[0][0], 1.0, 1.0, False
    second = min(s for i, s in enumerate(sizes) if i != best)
    margin = second / sizes[best] - 1
    score = 1 / sum(math.exp(-20.0 * (s / sizes[best] - 1)) for s in sizes)
    return dictionaries[best][0], score, margin, margin <= min_margin


def identify(
    text: Column, dictionaries: dict[str, bytes], level: int = 3, min_margin: float = 0.005
) -> Column:
    """Struct (lang, score, margin, rejected) of a text column. The dictionaries are bounded by ``learn_dictionaries``."""
    frozen = tuple(sorted(dictionaries.items()))

    @F.pandas_udf("lang string, score double, margin double, rejected boolean")
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [classify(t, frozen, level, min_margin) for t in batch]
            yield pd.DataFrame(rows, columns=["lang", "score", "margin", "rejected"])

    return run(text.cast("string"))


def held_out(doc_id: Column) -> Column:
    """True for documents that are never learned from; rows without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))
