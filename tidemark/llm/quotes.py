"""Quotation linking: nested quotes of messages are parsed, hashed, joined to the messages they come from and taken out.

A line that starts with n ``>`` marks (blanks between them allowed) is quoted at level n. Neighbouring lines of one level are one
passage. Passages are normalised (lower case, white space collapsed) and hashed as a whole and line by line; the same is done
to what each message says itself (its level 0 text, whole, by paragraph and by line). For a hash within a conversation
only the earliest message that says it counts as its origin, so a phrase that thousands repeat gives one row and no pairs. A passage
links to the earlier message that holds it whole, else to the one that holds most of its lines.

A message answers the latest message that its level 1 quotes link to; without a link it starts a thread. The conversation is
ordered by thread, then by distance from the thread's first message, then by turn: every answer stands after what it answers.

Defined results: a null text counts as empty; quotes of unknown, later or own text stay unlinked; passages without text are not
counted; a message repeated with the same conversation and turn is one node for linking and keeps all its rows; rows with a null
conversation or turn have no parent and stand first. Attribution lines (``On ... wrote:``) are taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.ordering import numbered
from tidemark.operators.distributed import materialize

MARKS = r"^[ \t]*>(?:[ \t]*>)*"
ATTRIBUTION = r"^On .{1,300} wrote:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parse(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Adds ``own`` (text without quotes) and ``passages``, an array of (level, lines)."""
    lines = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")
    level = lambda s: F.length(F.regexp_replace(F.regexp_extract(s, MARKS, 0), r"[^>]", ""))
    body = lambda s: F.trim(F.regexp_replace(s, MARKS, ""))
    parsed = F.transform(lines, lambda s: F.struct(level(s).alias("level"), F.when(level(s) > 0, body(s)).otherwise(s).alias("body")))
    rows = messages.withColumn("__lines", F.filter(parsed, lambda x: (x["level"] > 0) | ~x["body"].rlike(ATTRIBUTION)))
    size = F.size("__lines")
    at = lambda i: F.get(F.col("__lines"), i)
    begins = F.filter(
        F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (at(i)["level"] > 0) & ((i == 0) | (at(i)["level"] != F.coalesce(at(i - 1)["level"], F.lit(0)))),
    )
    rows = rows.withColumn("__begins", begins)
    level_change = lambda i: F.filter(F.sequence(i, size), lambda j: F.coalesce(at(j)["level"], F.lit(-1)) != at(i)["level"])
    passages = F.transform(
        F.col("__begins"),
        lambda b: F.struct(
            at(b)["level"].alias("level"),
            F.transform(F.slice("__lines", b + 1, F.get(level_change(b), F.lit(0)) - b), lambda x: x["body"]).alias("lines"),
        ),
    )
    own = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return rows.withColumns({"passages": passages, "own": F.regexp_replace(own, r"^\s+|\s+$", "")}).drop("__lines", "__begins")


def _pieces(whole: Column, parts: Column) -> Column:
    """Distinct (hash, whole) structs of a text and its parts, without empty ones."""
    full = F.struct(normalised(whole).alias("t"), F.lit(1).alias("whole"))
    each = F.transform(parts, lambda p: F.struct(normalised(p).alias("t"), F.lit(0).alias("whole")))
    kept = F.filter(F.concat(F.array(full), each), lambda p: p["t"] != "")
    return F.transform(F.array_distinct(kept), lambda p: F.struct(F.md5(p["t"]).alias("hash"), p["whole"].alias("whole")))


def link(parsed: DataFrame) -> DataFrame:
    """One row per non-empty quoted passage: conversation, turn, number, level and the turn of its origin (null: unknown)."""
    said = parsed.select("conv", "turn", F.explode(_pieces(F.col("own"), F.concat(F.split("own", r"\n\s*\n"), F.split("own", r"\n")))).alias("p"))
    origins = said.where("conv is not null and turn is not null").groupBy("conv", F.col("p.hash").alias("hash")).agg(F.min("turn").alias("origin"))
    quoted = parsed.select("conv", "turn", F.posexplode("passages").alias("number", "q"))
    quoted = quoted.where(normalised(F.array_join("q.lines", " ")) != "").select("conv", "turn", "number", "q.*").distinct()
    pieces = quoted.select("conv", "turn", "number", F.explode(_pieces(F.array_join("lines", " "), F.col("lines"))).alias("p"))
    met = pieces.select("conv", "turn", "number", "p.*").join(origins, ["conv", "hash"]).where("origin < turn")
    votes = met.groupBy("conv", "turn", "number", "origin").agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv", "turn", "number").agg(F.max(F.struct("whole", "n", (-F.col("origin")).alias("o"))).alias("b"))
    chosen = best.select("conv", "turn", "number", (-F.col("b.o")).alias("origin"))
    return quoted.select("conv", "turn", "number", "level").join(chosen, ["conv", "turn", "number"], "left")


def threads(nodes: DataFrame) -> DataFrame:
    """First message of the thread and distance to it, for (conv, turn, parent) rows, by pointer doubling."""
    state = materialize(
        nodes.select("conv", "turn", F.coalesce("parent", "turn").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("parent").isNull().alias("done")),
        "quote-threads",
    )
    while not state.where("not done").isEmpty():
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        moved = state.where("not done").join(above, ["conv", "up"]).select("conv", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        state = materialize(state.where("done").unionByName(moved), "quote-threads")
    return state.select("conv", "turn", F.col("up").alias("thread"), "depth")


def conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every message without its quotes, with its parent, thread, depth and place in the reply-ordered conversation."""
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    renamed = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text"), *kept)
    parsed = materialize(parse(renamed, "conv", "turn", "text").drop("text"), "quote-parsed")
    links = materialize(link(parsed), "quote-links")
    facts = links.groupBy("conv", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.max("level").cast("long").alias("max_level"),
        F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent"),
    )
    nodes = parsed.where("conv is not null and turn is not null").select("conv", "turn").distinct().join(facts, ["conv", "turn"], "left")
    placed = threads(nodes).join(facts, ["conv", "turn"], "left")
    rows = parsed.drop("passages").join(placed, ["conv", "turn"], "left").withColumn("known", F.col("conv").isNotNull())
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_quotes", "n_linked", "max_level", "depth")}
    rows = rows.withColumns(zero | {"__conv": F.coalesce(F.col("conv").cast("string"), F.lit("")), "digest": F.xxhash64("own")})
    total = parsed.count()
    out = numbered(rows, ["known", "__conv"], ["thread", "depth", "turn", "digest"], total, "quote-order", "position")
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("own").alias(text_col), F.col("parent").alias("parent_turn"), F.col("thread").alias("thread_turn"),
        "depth", "position", "n_quotes", "n_linked", "max_level",
    )
