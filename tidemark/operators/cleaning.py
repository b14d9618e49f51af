"""Row cleaning, integrity rules, recoding and filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.numbers import all_of, any_of
from tidemark.functions.text import icontains
from tidemark.operators.distributed import first_per_key


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with its null count and percentage, from a single pass."""
    counted = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])
    flat = counted.select("__n", F.explode(entries).alias("e"))
    return flat.select(
        "e.column", "e.missing", F.try_divide(F.col("e.missing") * 100.0, F.col("__n")).alias("pct")
    )


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Percentage of non-blank values per column."""
    filled = [F.avg((F.coalesce(F.trim(F.col(c)), F.lit("")) != "").cast("int")).alias(c) for c in cols]
    entries = F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) * 100.0).alias("pct")) for c in cols])
    return df.agg(*filled).select(F.explode(entries).alias("e")).select("e.*")


def recode(column: Column, mapping: Mapping[str, str]) -> Column:
    """Recode by a fixed small mapping; values without an entry become null."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, column)


def integrity_flags(rules: Mapping[str, Column]) -> Column:
    """Array of the names of violated rules (unknown counts as not violated)."""
    hits = [F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    return F.array_compact(F.array(*hits))


def integrity_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows per violated rule plus the rows that pass all rules; one scan, one aggregate."""
    bad = {name: F.coalesce(cond, F.lit(False)) for name, cond in rules.items()}
    counted = df.agg(
        *[F.count_if(c).alias(n) for n, c in bad.items()], F.count_if(~any_of(list(bad.values()))).alias("kept")
    )
    names = [*bad, "kept"]
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in names])
    return counted.select(F.explode(entries).alias("e")).select("e.*")


def keep_valid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.where(F.size(integrity_flags(rules)) == 0)


def structural_null_check(df: DataFrame, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Count rows where a column is null although its flag says present, or the reverse."""
    counted = df.agg(*[F.count_if(F.col(c).isNull() != flag).alias(n) for n, (c, flag) in rules.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counted.select(F.explode(entries).alias("e")).select("e.*")


def binarize(df: DataFrame, cols: Sequence[str], yes: str = "Yes", no: str = "No") -> DataFrame:
    """Yes/No text to 1/0; numeric columns pass through unchanged."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    changed = {
        c: (F.col(c).cast("int") if c in numeric else F.when(F.col(c) == yes, 1).when(F.col(c) == no, 0)) for c in cols
    }
    return df.withColumns(changed)


def feature_crosses(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``a_x_b`` columns; a null side is spelled ``nan`` so that it forms its own category."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("nan"))

    return df.withColumns({f"{a}_x_{b}": F.concat_ws("_", text(a), text(b)) for a, b in pairs})


def align_columns(df: DataFrame, wanted: Sequence[str], fill: object = 0) -> DataFrame:
    """Exactly the wanted columns in that order; absent ones are filled."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in wanted])


def tile_grid(df: DataFrame, width: Column, height: Column, tile: int, stride: int) -> DataFrame:
    """All tile corners of each image plus one full-frame row; small images give the full frame only."""

    def starts(extent: Column) -> Column:
        return F.when(extent >= tile, F.sequence(F.lit(0), extent - tile, F.lit(stride))).otherwise(
            F.array().cast("array<int>")
        )

    sized = df.withColumns({"__w": width.cast("int"), "__h": height.cast("int")})
    full = F.array(
        F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("__w").alias("w"), F.col("__h").alias("h"))
    )
    tiles = F.flatten(
        F.transform(
            starts(F.col("__h")),
            lambda y: F.transform(
                starts(F.col("__w")),
                lambda x: F.struct(x.alias("x"), y.alias("y"), F.lit(tile).alias("w"), F.lit(tile).alias("h")),
            ),
        )
    )
    return sized.withColumn("__t", F.explode(F.concat(full, tiles))).select(*df.columns, "__t.*")


# --- lookups by text -------------------------------------------------------------------------------------------


def grep_columns(df: DataFrame, needle: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows holding the text in any column, case-blind and literal."""
    return df.where(any_of([icontains(F.col(c).cast("string"), needle) for c in (cols or df.columns)]))


def limited_with_total(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows, the total row count and whether the listing was cut."""
    total = df.agg(F.count(F.lit(1)).alias("t")).scalar()
    head = df.orderBy(*order).limit(n)
    return head.withColumn("total", total).withColumn("truncated", total > n)


def search_by_field(df: DataFrame, **filters: str | None) -> DataFrame:
    """Literal, case-blind substring filters; blank parameters are ignored."""
    used = [icontains(F.col(c), v.strip()) for c, v in filters.items() if v and v.strip()]
    return df.where(all_of(used))


def search_exact(df: DataFrame, contains: Mapping[str, str] | None = None, **filters: str | None) -> DataFrame:
    """Case-blind equality on each given column plus optional substring filters."""
    used = [F.lower(F.col(c)) == v.strip().lower() for c, v in filters.items() if v and v.strip()]
    used += [icontains(F.col(c), v) for c, v in (contains or {}).items() if v]
    return df.where(all_of(used))


def name_contains(df: DataFrame, cols: Sequence[str], part: str) -> DataFrame:
    return df.where(any_of([F.contains(F.upper(F.col(c)), F.lit(part.upper())) for c in cols]))


PREDICATE_TOKEN = re.compile(
    r"\s*(?:(?P<text>'[^'\\]*')|(?P<number>-?\d+(?:\.\d+)?)(?![\w.])|(?P<name>[A-Za-z_]\w*|`\w+`)|(?P<sign><=|>=|<>|!=|[=<>(),]))"
)
PREDICATE_WORDS = {"and", "or", "not", "in", "like", "between", "is", "null", "true", "false"}


def safe_predicate(predicate: str, kinds: Mapping[str, str]) -> str | None:
    """The predicate if it holds nothing but listed columns, literals, comparisons and logic; else null.

    Functions, arithmetic, casts and subqueries have no token, so nothing can be called and nothing can overflow. ``kinds`` gives
    ``text`` or ``number`` per column: a number compared with a text column becomes a text, so that no stored value has to
    be converted; a text that is no number, or a text column, compared with a number column is refused.
    """
    out, at, column, after_name = [], 0, None, False
    body = predicate.strip()
    while at < len(body):
        m = PREDICATE_TOKEN.match(body, at)
        if m is None:
            return None
        token, kind, at = m.group(m.lastgroup), m.lastgroup, m.end()
        if kind == "name":
            name = token.strip("`")
            word = token.lower() in PREDICATE_WORDS and name not in kinds
            if not word and name not in kinds:
                return None
            if not word:
                if column is not None and after_name == "sign" and kinds[column] != kinds[name]:
                    return None
                column = name
            elif token.lower() == "or":
                column = None
        elif kind in ("text", "number"):
            if column is None:
                return None
            if kind == "number" and kinds[column] == "text":
                token = f"'{token}'"
            if kind == "text" and kinds[column] == "number" and not re.fullmatch(r"'\s*-?\d+(\.\d+)?\s*'", token):
                return None
            if kind == "text" and kinds[column] == "number":
                token = token.strip("' ")
        elif token == "(" and after_name == "column":
            return None
        after_name = "sign" if kind == "sign" else "column" if kind == "name" and token.strip("`") in kinds else kind
        out.append(token)
    return " ".join(out)


def predicate_search(df: DataFrame, predicate: str, allowed: Sequence[str]) -> DataFrame:
    """Filter by a SQL predicate over an allow-list of text and number columns; anything else gives no rows, as does an error."""
    narrowed = df.select(*allowed).alias("rows")
    kinds = {}
    for field in narrowed.schema:
        if isinstance(field.dataType, (T.StringType, T.NumericType)):
            kinds[field.name] = "text" if isinstance(field.dataType, T.StringType) else "number"
    safe = safe_predicate(predicate, kinds)
    if not safe:
        return narrowed.limit(0)
    try:
        return narrowed.where(F.expr(safe))
    except PySparkException:
        return narrowed.limit(0)


# --- sets --------------------------------------------------------------------------------------------------------


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; grouped first so that hot keys collapse in the map stage."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return groups.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"),
    )


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, order)


def known_only(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return df.join(known.select(on).distinct(), on, "left_semi")


def unknown_only(df: DataFrame, known: DataFrame, on: str) -> DataFrame:
    return df.join(known.select(on).distinct(), on, "left_anti")
