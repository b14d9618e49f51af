"""Question cascade in one pass: one row per question from start to end.

A directory is exploded once to entries (kind, key, person, line) and reduced to one row per (kind, key): how many people, the first of them, and the first
lines of their list. A rule looks its key up in that index by a left join; a question without a key for the rule takes part with a key of its own, so
that questions without keys spread over all tasks. The answer is the first of the rules' answers, in their order, that is not null: no union of rule
outputs, no aggregate over them.

Fragments of a value (part of a surname, say) are found through an index of its grams of one to three characters: the fragment meets the values on equality of
its first gram, and only these are compared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.aliases import contained_names
from tidemark.operators.distributed import materialize, top_per_key

GRAM = 3


def directory_index(entries: DataFrame, person: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """(kind, key, n, person, lines) of entries (kind, key, preference, line, person columns).

    ``person`` is the first by preference and ``order``; ``lines`` are the first ``most`` by ``order``. A key with very many people sends one row, and
    ``most`` lines, from each task.
    """
    keyed = entries.where(F.col("key").isNotNull() & (F.col("key") != ""))
    facts = keyed.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("preference", *order, F.struct(*person).alias("p"))).alias("first")
    )
    head = top_per_key(keyed.select("kind", "key", *order, "line"), ["kind", "key"], [F.asc(c) for c in order], most, out="r")
    entry = F.struct("r", F.col(order[0]).alias("id"), "line")
    lines = head.groupBy("kind", "key").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["id"].alias("id"), x["line"].alias("line"))).alias("lines"))
    return facts.join(lines, ["kind", "key"]).select("kind", "key", "n", F.col("first.p").alias("person"), "lines")


def look_up(
    questions: DataFrame, qid: str, index: DataFrame, single: Mapping[str, tuple[str, Column]], several: Mapping[str, tuple[Sequence[str], Column]] | None = None
) -> DataFrame:
    """Looks all keys of a question up at once; adds a struct (kind, key, n, person, lines) for each name of ``single``, null where its key is null or unknown.

    ``several`` names arrays of keys that may be of any of some kinds; they give arrays of such structs, in the order of the keys. Only keys that are there
    travel: they meet the index in one join and come back as one row per question, no longer than its keys.
    """
    entry = lambda slot, kind, key, pos: F.struct(F.lit(slot).alias("slot"), pos.alias("pos"), F.lit(kind).alias("kind"), key.alias("key"))
    ones = F.array(*[entry(slot, kind, key, F.lit(0)) for slot, (kind, key) in single.items()])
    tried = lambda slot, kind, keys: F.transform(keys, lambda k, i: entry(slot, kind, k, i))
    lists = [tried(slot, kind, keys) for slot, (kinds, keys) in (several or {}).items() for kind in kinds]
    asked = F.filter(F.concat(ones, *[F.coalesce(x, F.array().cast("array<struct<slot:string,pos:int,kind:string,key:string>>")) for x in lists]), lambda e: e["key"] != "")
    hits = questions.select(qid, F.explode(asked).alias("e")).select(qid, "e.*").join(index, ["kind", "key"])
    fields = ["kind", "key", "n", "person", "lines"]
    found = hits.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("slot", "pos", *fields))).alias("__found"))
    group = lambda e: F.struct(*[e[f].alias(f) for f in fields])
    of = lambda slot: F.transform(F.filter("__found", lambda e: e["slot"] == slot), group)
    columns = [F.get(of(slot), F.lit(0)).alias(slot) for slot in single] + [of(slot).alias(slot) for slot in several or {}]
    return questions.join(found, qid, "left").select(*questions.columns, *columns)


def grams(value: Column) -> Column:
    """All different grams of one to ``GRAM`` characters of a value."""
    of = lambda n: F.when(
        F.length(value) >= n, F.transform(F.sequence(F.lit(1), F.length(value) - (n - 1)), lambda i: F.substring(value, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, GRAM + 1)])))


def fragment_index(terms: DataFrame, index: DataFrame, kind: str, scope: bool, most: int) -> DataFrame:
    """(kind, key, n, person, lines), the kind with ``~`` behind it: for every term the people of all values that contain it, their number, and their first lines.

    ``terms`` holds distinct terms in the column ``term``; with ``scope`` a term and a value are both ``scope|text`` and the scopes must be equal. Each value
    brings at most its first ``most`` lines, and so does each term, so nothing grows with the size of a group.
    """
    head = lambda c: F.concat(F.substring_index(c, "|", 1), F.lit("|")) if scope else F.lit("")
    body = lambda c: F.substring_index(c, "|", -1)
    values = index.where(F.col("kind") == kind).select("key", "n", "person", "lines")
    offered = values.select("key", F.explode(grams(body(F.col("key")))).alias("g")).select("key", F.concat(head(F.col("key")), "g").alias("gram"))
    wanted = terms.where(F.col("term").isNotNull() & (body(F.col("term")) != "")).distinct()
    wanted = wanted.withColumn("gram", F.concat(head(F.col("term")), F.substring(body(F.col("term")), 1, GRAM)))
    pairs = wanted.join(offered, "gram").where(F.contains(body(F.col("key")), body(F.col("term")))).select("term", "key").join(values, "key")
    facts = pairs.groupBy("term").agg(F.sum("n").alias("n"), F.min(F.struct(F.get("lines", F.lit(0))["id"].alias("id"), "person")).alias("first"))
    lines = top_per_key(pairs.select("term", F.explode("lines").alias("line")), ["term"], [F.asc("line.id")], most, out="r")
    listed = lines.groupBy("term").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return facts.join(listed, "term").select(F.lit(kind + "~").alias("kind"), F.col("term").alias("key"), "n", F.col("first.person").alias("person"), "lines")


def alias_targets(questions: DataFrame, qid: str, text: str, aliases: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Adds one column per kind of alias: the target of the longest alias of that kind in the text (ties alphabetical), or null.

    ``aliases``: (kind, alias, target). The texts are walked through once for all kinds.
    """
    names = aliases.select("kind", F.lower("alias").alias("alias"), "target")
    lowered = questions.select(qid, F.lower(F.col(text)).alias("__low"))
    hits = contained_names(lowered, qid, "__low", materialize(names.select("alias").distinct(), "aliases")).join(names, "alias")
    best = {k: F.min(F.when(F.col("kind") == k, F.struct((-F.length("alias")).alias("l"), "alias", "target"))) for k in kinds}
    return questions.join(hits.groupBy(qid).agg(*[b["target"].alias(k) for k, b in best.items()]), qid, "left")


def first_answer(questions: DataFrame, rules: Mapping[int, Column], fallback: Column, fallback_rule: int = 99) -> DataFrame:
    """``rule`` and ``answer``: the first rule, in the order given, whose answer is not null."""
    hits = [F.when(a.isNotNull(), F.struct(F.lit(n).alias("rule"), a.alias("answer"))) for n, a in rules.items()]
    best = F.coalesce(*hits, F.struct(F.lit(fallback_rule).alias("rule"), fallback.alias("answer")))
    return questions.withColumn("__b", best)


def listing(found: Column, limit: Column) -> Column:
    """Numbered lines of a looked-up group, and how many of how many when some are left out; null without a group."""
    shown = F.array_join(F.transform(F.slice(found["lines"], F.lit(1), limit), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    cut = F.concat(shown, F.lit("\n("), limit.cast("string"), F.lit(" of "), found["n"].cast("string"), F.lit(")"))
    return F.when(found.isNotNull(), F.when(limit < found["n"], cut).otherwise(shown))
