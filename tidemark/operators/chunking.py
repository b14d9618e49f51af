"""Splitting texts into chunks, paragraphs, dictionary words and tagged characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import category_from_path, has_digit, path_stem, words


def fixed_chunks(df: DataFrame, text: str, size: int = 512, overlap: int = 128) -> DataFrame:
    """Overlapping fixed-size windows; a text of at most ``size`` characters is one chunk.

    The text is cut once into strides and each window is put together from neighbouring strides, so a long text
    costs linear time (repeated ``substring`` from the start would be quadratic).
    """
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than size")
    span = -(-size // stride)
    strides = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(.{{1,{stride}}})"), 1)
    windows = F.transform(
        F.col("__s"), lambda _, i: F.substring(F.array_join(F.slice(F.col("__s"), i + 1, span), ""), 1, size)
    )
    pieces = F.when(F.length(text) <= size, F.array(F.col(text))).otherwise(windows)
    cut = df.withColumn("__s", strides)
    return cut.select(*[c for c in df.columns if c != text], F.posexplode(pieces).alias("chunk_no", "chunk"))


def paragraphs(text: Column, pattern: str = r"\n\n") -> Column:
    """Trimmed non-empty paragraphs, parted by blank lines; markdown headings stand alone."""
    spaced = F.regexp_replace(text, r"(?m)(^#+\s.*$)", "\n\n$1\n\n")
    bare = F.transform(F.split(spaced, pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(bare, lambda p: p != "")


def paragraph_split(df: DataFrame, text: str, pattern: str = r"\n\n") -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.posexplode(paragraphs(F.col(text), pattern)).alias("para_no", "paragraph"))


def packed_spans(sizes: Column, budget: Column) -> Column:
    """Runs of paragraphs (first, last, tokens) under a token budget, as a fold over their sizes; an oversized paragraph is a run with null tokens.

    A run that is closed by the next paragraph hands its last paragraph on, if both fit together.
    """
    run = lambda first, last, n: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), n.cast("int").alias("n"))
    state = lambda done, start, n: F.struct(done.alias("done"), start.cast("int").alias("start"), n.cast("int").alias("n"))
    none = F.array().cast("array<struct<first:int,last:int,n:int>>")
    closed = lambda s, i: F.when(s["start"] < i, F.concat(s["done"], F.array(run(s["start"], i - 1, s["n"])))).otherwise(s["done"])

    def step(s: Column, p: Column) -> Column:
        i, n, before = p["i"], p["n"], p["before"]
        alone = state(F.concat(closed(s, i), F.array(run(i, i, F.lit(None)))), i + 1, F.lit(0))
        handed_on = (s["start"] < i) & (before + n <= budget)
        fresh = state(closed(s, i), F.when(handed_on, i - 1).otherwise(i), F.when(handed_on, before + n).otherwise(n))
        return F.when(n > budget, alone).when(s["n"] + n > budget, fresh).otherwise(state(s["done"], s["start"], s["n"] + n))

    placed = F.transform(sizes, lambda n, i: F.struct(i.alias("i"), n.alias("n"), F.coalesce(F.get(sizes, i - 1), F.lit(0)).alias("before")))
    return F.aggregate(placed, state(none, F.lit(0), F.lit(0)), step, lambda s: closed(s, F.size(sizes)))


def pack_chunks(
    df: DataFrame, text: str, path: str, max_tokens: int = 400, overlap_tokens: int = 60, pattern: str = r"\n\n"
) -> DataFrame:
    """Pack paragraphs into chunks under a token budget, prefixed with category and title.

    The fold carries only sizes and places and runs inside the row; the text of a chunk is put together once, from the paragraphs of its run. Oversized
    paragraphs are cut by words, to their very end.
    """
    category = category_from_path(F.col(path))
    title = path_stem(F.col(path))
    prefix = F.concat(F.lit("Category: "), category, F.lit(" | Title: "), title, F.lit("\nContent: "))
    keep = [c for c in df.columns if c != text]
    counted = F.transform(paragraphs(F.col(text), pattern), lambda p: F.struct(p.alias("text"), F.size(words(p)).alias("n")))
    # each array of one keeps the optimiser from working out what is inside it once more for every use
    marked = df.select(*keep, category.alias("category"), title.alias("product"), prefix.alias("__prefix"), F.explode(F.array(counted)).alias("__paras"))
    marked = marked.withColumn("__budget", F.lit(max_tokens) - F.size(words(F.col("__prefix"))))
    spans = packed_spans(F.transform("__paras", lambda p: p["n"]), F.col("__budget"))
    placed = marked.withColumn("__spans", F.coalesce(spans, F.array().cast("array<struct<first:int,last:int,n:int>>")))
    step = F.greatest(F.lit(1), F.col("__budget") - overlap_tokens)

    def parts(place: Column) -> Column:
        para = F.get("__paras", place)
        windows = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((para["n"] - F.col("__budget")) / step).cast("int")))
        return F.transform(windows, lambda k: F.struct(
            F.array_join(F.slice(words(para["text"]), k * step + 1, F.col("__budget")), " ").alias("chunk"),
            F.least(F.col("__budget"), para["n"] - k * step).cast("int").alias("n_tokens"),
        ))

    def whole(s: Column) -> Column:
        body = F.array_join(F.transform(F.slice("__paras", s["first"] + 1, s["last"] - s["first"] + 1), lambda p: p["text"]), "\n\n")
        return F.array(F.struct(body.alias("chunk"), s["n"].alias("n_tokens")))

    chunks = F.flatten(F.transform("__spans", lambda s: F.when(s["n"].isNull(), parts(s["first"])).otherwise(whole(s))))
    exploded = placed.select("*", F.posexplode(chunks).alias("chunk_no", "__c"))
    return exploded.select(
        *keep,
        "chunk_no",
        F.concat("__prefix", "__c.chunk").alias("chunk"),
        F.col("__c.n_tokens").alias("n_tokens"),
        F.struct("product", "category").alias("metadata"),
    )


def oversize(df: DataFrame, text: str, limit: int) -> DataFrame:
    return df.where(F.size(words(F.col(text))) > limit)


def vocabulary(*sources: tuple[DataFrame, str], extra: DataFrame | None = None) -> DataFrame:
    """Distinct words of several text columns and an optional one-column table of extra words."""
    parts = [df.select(F.explode(words(F.col(c))).alias("word")) for df, c in sources]
    if extra is not None:
        parts.append(extra.toDF("word"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def space_positions(df: DataFrame, text: str) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    chars = df.select(*keep, F.posexplode(F.split(F.col(text), "")).alias("pos", "ch"))
    return chars.where(F.col("ch") == " ").drop("ch")


def segment_words(terms: DataFrame, vocab: DataFrame, max_len: int | None = None) -> DataFrame:
    """Longest-match segmentation of distinct words against a vocabulary table of any size.

    The vocabulary gives, for every first two letters, the lengths that occur; a place of a word tries only the lengths of its own two letters (and one
    letter). Those substrings are joined to the vocabulary on equality, the longest match per place is kept, and a fold walks the places from left to right;
    characters no entry covers become pieces of their own. Neither the vocabulary nor the words are broadcast by force or collected.
    """
    w = F.col("word")
    entries = vocab.select("word").where(F.length("word") > 0).distinct()
    if max_len is not None:
        entries = entries.where(F.length("word") <= max_len)
    heads = entries.where(F.length("word") > 1).groupBy(F.substring("word", 1, 2).alias("head")).agg(F.collect_set(F.length("word")).alias("lengths"))
    whole = terms.select("word").distinct().where(F.length("word") > 0)
    starts = whole.select("word", F.explode(F.sequence(F.lit(1), F.length(w))).alias("start"))
    placed = starts.withColumn("head", F.substring(w, F.col("start"), F.lit(2))).join(heads, "head", "left")
    tried = F.array_append(F.coalesce("lengths", F.array().cast("array<int>")), F.lit(1))
    cands = placed.select("word", "start", F.explode(tried).alias("len")).where(F.col("start") + F.col("len") - 1 <= F.length(w))
    pieces = cands.withColumn("piece", F.substring(w, F.col("start"), F.col("len")))
    known = pieces.join(entries.select(F.col("word").alias("piece"), F.lit(True).alias("known")), "piece", "left")
    best = known.groupBy("word", "start").agg(F.coalesce(F.max(F.when(F.col("known"), F.col("len"))), F.lit(1)).alias("len"))
    tables = best.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "len"))), lambda s: s["len"]).alias("steps"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.length(w)),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts")),
        lambda s, i: F.when(
            i == s["next"],
            F.struct((i + F.get("steps", i - 1)).alias("next"), F.array_append(s["starts"], i).alias("starts")),
        ).otherwise(s),
        lambda s: s["starts"],
    )
    walked = tables.select("word", "steps", F.explode(F.array(walk)).alias("starts"))
    cut = F.transform("starts", lambda i: F.substring(w, i, F.get("steps", i - 1)))
    return walked.select("word", has_digit(w).alias("has_digit"), cut.alias("pieces"))


def char_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """B/I/E tag of every non-space character with its true offset; a one-character word is B."""
    chars = F.filter(F.split(F.col(text), ""), lambda c: c != "")
    lined = df.select(key, chars.alias("__c"))
    space = lambda c: c.rlike(r"^\s$")

    def tag(c: Column, i: Column) -> Column:
        first = (i == 0) | space(F.get(F.col("__c"), i - 1))
        last = (i == F.size("__c") - 1) | space(F.get(F.col("__c"), i + 1))
        name = F.when(first, "B_WORD").when(last, "E_WORD").otherwise("I_WORD")
        return F.struct(i.alias("pos"), c.alias("ch"), name.alias("tag"))

    tagged = F.filter(F.transform(F.col("__c"), tag), lambda t: ~space(t["ch"]))
    return lined.select(key, F.explode(tagged).alias("t")).select(key, "t.pos", "t.ch", "t.tag")


def token_offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Start of each token counted in non-space characters of its own text."""
    tokens = df.select(key, F.posexplode(words(F.col(text))).alias("pos", "token"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("offset", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))
