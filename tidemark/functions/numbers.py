"""Numeric cleaning, binning and scoring expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def parse_thousands(text: Column) -> Column:
    """``' 1,234.5 '`` to 1234.5; anything unreadable becomes null."""
    return F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("double")


def parse_bracket_label(text: Column) -> Column:
    """Read an integer label written either ``1`` or ``'[1]'``."""
    return F.trim(F.regexp_replace(text, r"[\[\]]", "")).try_cast("int")


def normalize_extension(text: Column) -> Column:
    """``73048.0`` to ``73048``; values that are not numbers are kept as they are."""
    numeric = text.rlike(r"^[0-9]+\.?[0-9]*$")
    return F.when(numeric, text.try_cast("double").cast("bigint").cast("string")).otherwise(text)


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; values outside the edges become null."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one label per interval")
    out = F.when(value <= F.lit(edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(value <= F.lit(upper), F.lit(label))
    return out


def ladder(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """First step whose bound exceeds the value; ``last`` beyond them all; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when(value < F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(last))


def bin_by_edges(value: Column, inner_edges: Column) -> Column:
    """Right-closed bin index: how many inner edges lie strictly below the value."""
    index = F.size(F.filter(inner_edges, lambda e: e < value))
    return F.when(value.isNotNull(), index)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of an equal-width bin; the last bin also holds the maximum."""
    width = (high - low) / F.lit(float(bins))
    raw = F.coalesce(F.floor(F.try_divide(value - low, width)), F.lit(0))
    return F.when(value.isNotNull(), F.least(raw, F.lit(bins - 1)).cast("int"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def log_loss(label: Column, p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return -(label * F.ln(q) + (F.lit(1.0) - label) * F.ln(F.lit(1.0) - q))


def argmax_index(scores: Column) -> Column:
    """Zero-based index of the first largest entry of an array."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its maximum so that it cannot overflow."""
    exps = F.transform(scores, lambda x: F.exp(x.cast("double") - F.array_max(scores).cast("double")))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda e: e / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(v, lambda x: x.cast("double"))
    )


def box_to_center(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    """Corner box to normalised centre and size."""
    return [
        ((x0 + x1) / 2.0 / width).alias("cx"),
        ((y0 + y1) / 2.0 / height).alias("cy"),
        ((x1 - x0) / width).alias("bw"),
        ((y1 - y0) / height).alias("bh"),
    ]


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
