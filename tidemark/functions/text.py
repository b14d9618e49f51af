"""String, token and pattern expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# What a search token may not hold: anything but letters, digits, underscore, the Thai block and the dot.
TOKEN_JUNK = r"[^\p{L}\p{N}_\x{0E01}-\x{0E59}.\s]"
# Word edges over all letters and digits, so that a number glued to Thai text counts as part of a word.
_EDGE = r"[\p{L}\p{N}_]"
EMPLOYEE_ID = rf"(?<!{_EDGE})0[08]\d{{6}}(?!{_EDGE})"
EXTENSION = rf"(?<!{_EDGE})\d{{5}}(?!{_EDGE})"
MOBILE = rf"(?<!{_EDGE})0\d{{2}}-?\d{{3}}-?\d{{4}}(?!{_EDGE})"


def blank_to_default(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(default))


def non_blank(text: Column) -> Column:
    """Null for null or blank text, the text itself otherwise."""
    return F.when(F.trim(text) != "", text)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def icontains(text: Column, needle: str) -> Column:
    """Case-blind literal containment (never a pattern)."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


def path_stem(path: Column) -> Column:
    """File name without folders, query string and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[^.]*$", "")


def text_after(text: Column, marker: str) -> Column:
    """What follows the last marker; the whole text if there is none."""
    return F.trim(F.substring_index(text, marker, -1))


def words(text: Column) -> Column:
    """Whitespace tokens, empties removed."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def search_tokens(text: Column, stop_words: Sequence[str] = (), keep: Sequence[str] = ()) -> Column:
    """Lower-cased tokens without punctuation; stop words go unless they are on the keep list."""
    raw = F.split(F.regexp_replace(F.lower(text), TOKEN_JUNK, ""), r"\s+")
    dropped = sorted(set(stop_words) - set(keep))
    if dropped:
        return F.filter(raw, lambda w: (w != "") & ~w.isin(dropped))
    return F.filter(raw, lambda w: w != "")


def strip_blocks(text: Column, tag: str = "think") -> Column:
    return F.trim(F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", ""))


def parse_answer(text: Column, choices: int = 10, default: int = 1) -> Column:
    """Answer number of a reply: the ``"answer"`` field, else the last number in range, else the default."""
    field = F.nullif(F.regexp_extract(text, r'"answer":\s*"?(\d+)"?', 1), F.lit("")).try_cast("int")
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda n: n.try_cast("int"))
    in_range = F.filter(numbers, lambda n: n.between(1, choices))
    return F.coalesce(field, F.try_element_at(in_range, F.lit(-1)), F.lit(default))


def parse_answer_first(text: Column, choices: int = 10) -> Column:
    """Starter variant: reasoning blocks removed, ``ANSWER: n`` first, else the first 1-2 digit number in range."""
    clean = strip_blocks(text)
    field = F.nullif(F.regexp_extract(clean, r"ANSWER:\s*(\d+)", 1), F.lit("")).try_cast("int")
    numbers = F.transform(F.regexp_extract_all(clean, F.lit(r"\b(\d{1,2})\b"), 1), lambda n: n.try_cast("int"))
    return F.coalesce(field, F.try_element_at(F.filter(numbers, lambda n: n.between(1, choices)), F.lit(1)))


def category_from_path(path: Column) -> Column:
    """``polic`` rather than ``policy``, so that a ``policies/`` folder is recognised too."""
    p = F.lower(path)
    return (
        F.when(p.contains("product"), "Product")
        .when(p.contains("polic"), "Policy")
        .when(p.contains("store"), "Store Info")
        .otherwise("General")
    )


def mask_private(text: Column, is_refusal: Column) -> Column:
    """Employee ids are always masked, five-digit extensions only in refusals."""
    without_ext = F.when(is_refusal, F.regexp_replace(text, EXTENSION, "XXXXX")).otherwise(text)
    return F.trim(F.regexp_replace(without_ext, EMPLOYEE_ID, "XXXXXXXX"))


def strip_private_unless_asked(text: Column, asked_phone: Column) -> Column:
    """Ids always go; mobile and extension numbers go unless the question asked for one; spaces are squeezed."""
    no_id = F.regexp_replace(text, EMPLOYEE_ID, "")
    no_phone = F.regexp_replace(F.regexp_replace(no_id, MOBILE, ""), EXTENSION, "")
    kept = F.when(asked_phone, no_id).otherwise(no_phone)
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def lang_pick(lang: Column, thai: Column, english: Column) -> Column:
    """Thai or English text by language, falling back to the other when blank."""
    return F.when(lang == "th", F.coalesce(non_blank(thai), non_blank(english))).otherwise(
        F.coalesce(non_blank(english), non_blank(thai))
    )


def compact_json(cols: Sequence[str]) -> Column:
    """One-line JSON of the given text columns without the blank ones."""
    return F.to_json(F.struct(*[non_blank(F.col(c).cast("string")).alias(c) for c in cols]))
