"""N-gram Jaccard join with token-combination prefixes, and the components of its links.

Tokens are the distinct five-word shingles of a text. Two sets of similarity t share at least ceil(t * n) tokens of either,
so after putting all tokens into one global order they must meet in their prefixes. Rare tokens come first in the order and
are indexed one by one. Frequent tokens come last and fall into classes, of which pairs are indexed: when rare tokens do not fill
the prefix it is extended with frequent ones until the tokens it may lose cannot break every pair, that is until rare +
sum over classes of (members - 1) exceeds n - ceil(t * n). A bucket of a pair is smaller than that of a token. The number of classes
follows the size band of the set (powers of two), which keeps the pairs of a text in proportion to its length; a text also
makes the pairs of the next band when a text that links to it may lie there. Texts of fewer than ``SHORT`` shingles index single tokens
only; those just above do both, so that a short and a longer one meet.

Which tokens are frequent is found by counting runs of shingles over all documents. Any choice gives the same links, since the order
only has to be the same for all; the list is limited to the ``FREQUENT`` most counted ones, a fixed size to broadcast.

Buckets with the same members are one. They are never expanded into rows of pairs: each is first compared with its smallest member; linked texts
fall into components, and only buckets of three or more that still hold several components go on. Those are dealt in cells of bounded size, in which
parity sketches of the sets rule out most pairs of different components; where many are left, as among near copies, every member first offers
only its likeliest partners, and its bucket comes back once the components have grown, at last with all pairs. So no link
between two components is lost, whatever the bucket's size.

``join_links`` also counts the links of every row. All of them lie inside a component, so the different texts of each component are
compared with each other, every pair once, in blocks of bounded numbers and bytes of texts. Only counts leave a block, and copies are
weights: rows are never paired.

Rare tokens are counted alone first; only those that come again, by a bitmap of fixed size, move with their text's hash. Texts move only to be
verified: those wanted, by such a bitmap, once, and then once for each pair. Tables of finished steps are deleted.

Defined results: equal texts are one node and share their component; texts without words have no shingles and stand alone; ties
do not matter. The component is named by its smallest id; rows without an id count only for the others. Shingles and texts are
told apart by 64-bit hashes. Rows are never dropped and other columns not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.hashing import mix, shingle_set
from tidemark.llm.ordering import restored, with_id
from tidemark.llm.workers import lean
from tidemark.operators.distributed import discard, materialize, release

PERCENT = 75
BAND_SHARE = 8
SHORT = 16
FREQUENT = 1 << 18
RUN, RUN_COUNT = 1 << 22, 3
PER_TASK = 1000
BLOCK_TEXTS, BLOCK_BYTES = 1000, 1 << 24
SKETCH_BITS, SKETCH_MOST = 8, 15
CELL = 1024
BYTES_AT_ONCE = 1 << 25
OFFERS = (1, 8, None)
PER_MEMBER = 4
KEY_SLOTS, TOKEN_SLOTS = 24, 26
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lean
def _frequent_in_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens that several texts of one run share; a run is a fixed number of tokens."""
    held, size = [], 0

    def counted() -> pd.DataFrame:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= RUN_COUNT
        return pd.DataFrame({"token": tokens[often].view(np.int64), "n": counts[often]})

    for frame in frames:
        for text in frame["text"]:
            held.append(shingle_set(text))
            size += len(held[-1])
            if size >= RUN:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def frequent_tokens(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens in rising order, and the place of each in the order by rising count."""
    found = texts.mapInPandas(_frequent_in_runs, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens = top.column("token").to_numpy().view(np.uint64)
    place = np.arange(len(tokens), 0, -1)
    by_value = np.argsort(tokens)
    return tokens[by_value], place[by_value]


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one sorted token set: of rare tokens, and of frequent tokens and their pairs."""
    n = len(tokens)
    needed = n - -(-PERCENT * n // 100) + 1
    at = np.searchsorted(frequent, tokens)
    common = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == tokens) if len(frequent) else np.zeros(n, bool)
    rare = tokens[~common][:needed]
    missing = needed - len(rare)
    if missing <= 0:
        return rare, rare[:0]
    often = tokens[common][np.argsort(place[at[common]])]
    keys = []
    if n < SHORT * 100 // PERCENT + 1:
        keys.append(often[:missing])
    for band in {n.bit_length(), (100 * n // PERCENT).bit_length()} if n >= SHORT else ():
        group = (mix(often) % np.uint64((1 << band - 1) // BAND_SHARE)).astype(np.int64)
        repeats = np.ones(len(often), dtype=np.int64)
        repeats[np.unique(group, return_index=True)[1]] = 0
        length = int(np.searchsorted(np.cumsum(repeats), missing)) + 1
        by_class = np.argsort(group[:length], kind="stable")
        members, classes = often[:length][by_class], group[:length][by_class]
        for gap in range(1, length):
            same = classes[gap:] == classes[:-gap]
            if not same.any():
                break
            one, other = members[gap:][same], members[:-gap][same]
            keys.append(mix(np.minimum(one, other) * _STEP + np.maximum(one, other) + np.uint64(band)))
    return rare, np.concatenate(keys)


def _sketch(tokens: np.ndarray) -> bytes:
    """Parities of the numbers of tokens by their last bits, as many as follow the size of the set. Two sets differ in at least as many tokens as their sketches in bits."""
    bits = min(max(SKETCH_BITS, len(tokens).bit_length()), SKETCH_MOST)
    counts = np.bincount((tokens & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _words(sketches: Sequence[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1)


def _folded(sketches: list[bytes], lengths: np.ndarray, size: int) -> np.ndarray:
    """Sketches of at least ``size`` bytes as those of fewer last bits; zeros for the others."""
    out = np.zeros((len(sketches), size // 8), dtype=np.uint64)
    for length in np.unique(lengths[lengths >= size]):
        same = np.flatnonzero(lengths == length)
        out[same] = np.bitwise_xor.reduce(_words([sketches[x] for x in same]).reshape(len(same), -1, size // 8), axis=1)
    return out


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Different bits of sketches, row by row; wider ones are folded to the narrower."""
    width = min(one.shape[1], other.shape[1])
    one, other = (np.bitwise_xor.reduce(x.reshape(len(x), -1, width), axis=1) if x.shape[1] > width else x for x in (one, other))
    return np.bitwise_count(one ^ other).sum(axis=1, dtype=np.int64)


def _differ(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the sketches at the places i and j differ, by the shorter one of each pair."""
    lengths = np.fromiter(map(len, sketches), dtype=np.int64, count=len(sketches))
    shorter, out = np.minimum(lengths[i], lengths[j]), np.zeros(len(i), dtype=np.int64)
    for size in np.unique(shorter).tolist():
        words, pairs = _folded(sketches, lengths, size), np.flatnonzero(shorter == size)
        for at in range(0, len(pairs), BYTES_AT_ONCE // size):
            some = pairs[at : at + BYTES_AT_ONCE // size]
            out[some] = _apart(words[i[some]], words[j[some]])
    return out


@lean
def _may_link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that their sketches do not rule out: of sizes that add up to s, linked sets differ in at most s * (1 - t) / (1 + t) tokens."""
    for frame in frames:
        sizes = frame["n"].to_numpy(dtype=np.int64) + frame["n2"].to_numpy()
        places = np.arange(len(frame))
        apart = _differ([*frame["sketch"], *frame["sketch2"]], places, places + len(frame))
        yield frame.loc[(100 + PERCENT) * apart <= (100 - PERCENT) * sizes, ["a", "b"]]


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """An exact filter before any text is moved."""
    some = among(sketches, pairs.select(F.explode(F.array("a", "b")).alias("key")), "key", KEY_SLOTS)
    left = some.select(F.col("key").alias("a"), "n", "sketch")
    right = some.select(F.col("key").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(_may_link, "a long, b long")


@lean
def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one (left, part) follow each other: first the left text itself, then the texts to compare it with."""
    own = None
    for frame in frames:
        out = []
        for a, part, b, first, text in zip(*(frame[c] for c in ("a", "part", "b", "first", "text")), strict=True):
            if first:
                own = shingle_set(text)
                continue
            other = shingle_set(text)
            shared = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * shared >= PERCENT * (len(own) + len(other) - shared):
                out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def among(rows: DataFrame, wanted: DataFrame, column: str, slots: int, others: bool = False) -> DataFrame:
    """All rows whose hash ``column`` is wanted, and few others: by a bitmap of 2**slots bits, of which at most all words are broadcast. ``others``: the rest."""
    word = F.shiftrightunsigned(column, 70 - slots)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - slots}) & 63 as int))")
    words = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = rows.withColumn("word", word).join(F.broadcast(words), "word", "left" if others else "inner")
    hit = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    return met.where(~hit if others else hit).select(*rows.columns)


def different(texts: DataFrame) -> DataFrame:
    """``key`` and ``text``, once each. Only texts that may have copies move."""
    copied = materialize(texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "join-copied")
    return among(texts, copied, "key", KEY_SLOTS, others=True).unionByName(among(texts, copied, "key", KEY_SLOTS).dropDuplicates(["key"]))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts link. ``texts``: key, text, any number of times. A text with many partners is compared in parts of bounded size."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = dealt.select(F.col("b").alias("key"), "a", "part", F.lit(False).alias("first"))
    left = parts.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"))
    wanted = materialize(left.unionByName(right), "join-wanted")
    known = among(texts, wanted, "key", KEY_SLOTS).dropDuplicates(["key"])
    together = known.join(wanted, "key").select("a", "part", F.col("key").alias("b"), "first", "text")
    together = together.repartition("a", "part").sortWithinPartitions("a", "part", F.desc("first"))
    found = materialize(together.mapInPandas(_verify, "a long, b long"), "join-links")
    discard(wanted)
    return found


def _sizes_fit(x: str, y: str) -> F.Column:
    return 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)


def _near(sizes: np.ndarray, component: np.ndarray, chunk: np.ndarray, sketch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a cell, of different components, that neither sizes nor sketches rule out, and the share of tokens in which they differ at least."""
    left = np.flatnonzero(chunk == chunk.min())
    right = left if len(left) == len(chunk) else np.flatnonzero(chunk != chunk.min())
    fits = (component[left][:, None] != component[right]) & (100 * np.minimum(sizes[left][:, None], sizes[right]) >= PERCENT * np.maximum(sizes[left][:, None], sizes[right]))
    i, j = np.nonzero(np.triu(fits, 1) if right is left else fits)
    i, j = left[i], right[j]
    apart, both = _differ(sketch, i, j), sizes[i] + sizes[j]
    likely = (100 + PERCENT) * apart <= (100 - PERCENT) * both
    return i[likely], j[likely], apart[likely] / both[likely]


def _first_offers(i: np.ndarray, j: np.ndarray, differ: np.ndarray, offers: int) -> np.ndarray:
    """Places of the pairs that are among the first ``offers`` of one of their members."""
    member, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((np.tile(differ, 2), member))
    member, pair = member[order], pair[order]
    return np.unique(pair[np.arange(len(member)) - np.searchsorted(member, member) < offers])


def _compare_cells(offers: int | None):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one cell (bucket, low, high) follow each other. Gives pairs (a, b), and buckets that must come back."""

        def compared(cell: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
            key = cell["key"].to_numpy()
            i, j, differ = _near(cell["n"].to_numpy(dtype=np.int64), cell["component"].to_numpy(), cell["chunk"].to_numpy(), cell["sketch"].tolist())
            back = offers is not None and len(i) > PER_MEMBER * len(key)
            if back:
                some = _first_offers(i, j, differ, offers)
                i, j = i[some], j[some]
            return np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), back

        def results(rows: pd.DataFrame) -> pd.DataFrame:
            starts = _starts(rows)
            out = [(rows["bucket"].iat[s], *compared(rows.iloc[s:e])) for s, e in zip(starts, [*starts[1:], len(rows)], strict=True)]
            pairs = np.unique(np.stack([np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])], axis=1), axis=0)
            again = np.unique(np.array([o[0] for o in out if o[3]], dtype=np.int64))
            none = np.zeros((len(again), 2), dtype=np.int64)
            a, b = np.concatenate([pairs, none]).T
            return pd.DataFrame({"a": a, "b": b, "bucket": np.concatenate([np.zeros(len(pairs), dtype=np.int64), again]), "back": np.arange(len(a)) >= len(pairs)})

        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = _starts(rows)[-1] if len(rows) else 0
            if last:
                yield results(rows.iloc[:last])
            held = rows.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield results(held)

    return run


def _starts(rows: pd.DataFrame) -> np.ndarray:
    """Places where a new cell begins."""
    cell = rows[["bucket", "low", "high"]].to_numpy()
    return np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(axis=1)]))


def near_in_buckets(open_rows: DataFrame, sketches: DataFrame, offers: int | None) -> DataFrame:
    """(a, b, bucket, back): pairs of different components that may link, and the buckets of which not all such pairs are among them.

    ``open_rows``: bucket, key, n, component, members. Buckets of more than ``CELL`` members are dealt to cells of two chunks each, so that
    a task holds few members at a time. ``offers`` is the number of pairs for a member where there are many; None gives all pairs.
    """
    rows = open_rows.withColumn("chunks", F.ceil(F.col("members") / CELL).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    rows = rows.join(sketches.select("key", "sketch"), "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = rows.select("bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "key", "n", "component", "chunk", "sketch")
    dealt = cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return materialize(dealt.mapInPandas(_compare_cells(offers), "a long, b long, bucket long, back boolean"), "join-near")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``, and the hashes ``text_key`` and ``component`` for every row."""
    rows = docs.select(*with_id(F.col(id_col)), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    texts, spark = rows.select("key", "text"), docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_tokens(texts.select("text")))

    @lean
    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens_of = frequent.value
        for frame in frames:
            out = []
            for key, text in zip(frame["key"], frame["text"], strict=True):
                tokens = shingle_set(text)
                rare, often = prefix_keys(tokens, *tokens_of) if len(tokens) else (tokens, tokens)
                out.append((key, len(tokens), rare.view(np.int64), often.view(np.int64), _sketch(tokens)))
            yield pd.DataFrame(out, columns=["key", "n", "rare", "often", "sketch"])

    indexed = materialize(different(texts).mapInPandas(index, "key long, n int, rare array<long>, often array<long>, sketch binary"), "join-index")
    members = F.xxhash64("key")
    facts = {
        "first": F.min(F.struct("key", "n")), "last": F.max("key"), "high": F.sum(F.shiftright(members, 32)),
        "low": F.sum(members.bitwiseAND(F.lit(0xFFFFFFFF))), "count": F.count(F.lit(1)),
    }
    # dealt first: most rare tokens occur once, so counting them before would only fill the memory of the reading tasks
    counts = indexed.select(F.explode("rare").alias("token")).repartition("token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    again = materialize(counts.where("n > 1").select("token"), "join-tokens")
    release(spark)
    rare = among(indexed.select(F.explode("rare").alias("token"), "key", "n"), again, "token", TOKEN_SLOTS)
    rare = rare.withColumns({c: f.over(Window.partitionBy("token")) for c, f in facts.items()}).where("first.key <> last")
    often = indexed.select(F.explode("often").alias("token"), "key", "n")
    shared = often.groupBy("token").agg(*[f.alias(c) for c, f in facts.items()]).where("first.key <> last")
    met = rare.unionByName(often.join(shared, "token"))
    bucket = F.xxhash64("high", "low", "count").alias("bucket")
    live = met.select(bucket, "key", "n", "count", F.col("first.key").alias("first_key"), F.col("first.n").alias("first_n"))
    met = materialize(live.dropDuplicates(["bucket", "key"]), "join-live")
    release(spark)
    sketches = materialize(indexed.select("key", "n", "sketch"), "join-sketches")
    discard(indexed, again)
    pairs = met.where((F.col("key") != F.col("first_key")) & _sizes_fit("n", "first_n"))
    pairs = materialize(pairs.select(F.col("first_key").alias("a"), F.col("key").alias("b")).distinct(), "join-pairs")
    links = verified(materialize(possible(pairs, sketches), "join-possible"), texts)
    release(spark)
    tried, component = pairs, connected_components(links, "join-components")
    live = met.where("count > 2").select("bucket", "key", "n")
    for offers in OFFERS:
        placed = live.join(component.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        facts = [F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")]
        mixed = placed.groupBy("bucket").agg(*facts).where("low <> high").select("bucket", "members")
        open_rows = materialize(placed.join(mixed, "bucket"), "join-open")
        near = near_in_buckets(open_rows, sketches, offers)
        release(spark)
        new = materialize(near.where("not back").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "join-pairs")
        back = materialize(near.where("back").select("bucket").distinct(), "join-back")
        if not new.isEmpty():
            found = verified(new, texts)
            release(spark)
            tried = tried.unionByName(new)
            if not found.isEmpty():
                links = links.unionByName(found)
                component = connected_components(links, "join-components")
        if back.isEmpty():
            break
        live = open_rows.join(back, "bucket", "left_semi").select("bucket", "key", "n")
    discard(met, pairs)
    named = restored(rows.select("doc_id", "no_id", "key")).join(sketches.select("key", "n"), "key").join(component.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "key")))
    least = named.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "component", "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), own, F.col("key").alias("text_key"), "component")


def _shared(own: np.ndarray, flat: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Numbers of tokens that one set shares with each of several sets, laid end to end."""
    mark[own] = True
    out = np.add.reduceat(mark[flat], starts, dtype=np.int64)
    mark[own] = False
    return out


def _count_block(keys: list[int], copies: list[int], chunks: list[int], tokens: list[np.ndarray]) -> pd.DataFrame:
    """For every text of a block the rows whose texts link to it. In a block of two chunks only texts of different chunks are compared."""
    sizes, weights, chunk = np.array([len(t) for t in tokens]), np.array(copies, dtype=np.int64), np.array(chunks)
    names, flat = np.unique(np.concatenate(tokens), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark, out = np.zeros(len(names), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    one = chunk == chunk.min()
    two = one if one.all() else ~one
    right = np.flatnonzero(two)
    right_flat = flat[np.repeat(two, sizes)]
    right_starts = np.cumsum(sizes[right]) - sizes[right]
    for i in np.flatnonzero(one):
        shared = _shared(flat[starts[i] : starts[i] + sizes[i]], right_flat, right_starts, mark)
        linked = (100 * shared >= PERCENT * (sizes[i] + sizes[right] - shared)) & (right != i)
        out[i] += weights[right[linked]].sum()
        if not one.all():
            out[right[linked]] += weights[i]
    return pd.DataFrame({"key": np.array(keys, dtype=np.int64), "linked": out})


@lean
def _count_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one block (component, low, high) follow each other."""
    block, held = None, ([], [], [], [])
    for frame in frames:
        done = []
        for component, low, high, key, copies, chunk, text in zip(*(frame[c] for c in ("component", "low", "high", "key", "copies", "chunk", "text")), strict=True):
            if (component, low, high) != block:
                if held[0]:
                    done.append(_count_block(*held))
                block, held = (component, low, high), ([], [], [], [])
            for column, value in zip(held, (key, copies, chunk, shingle_set(text)), strict=True):
                column.append(value)
        if done:
            yield pd.concat(done)
    if held[0]:
        yield _count_block(*held)


def join_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``join_components`` and ``n_links``: the number of other rows whose texts link to the row's, copies among them."""
    found = materialize(join_components(docs, id_col, text_col), "join-found")
    copies = materialize(found.where("n_shingles > 0").groupBy(F.col("text_key").alias("key"), "component").agg(F.count(F.lit(1)).alias("copies")), "join-copies")
    several = copies.groupBy("component").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("component")
    members = copies.join(several, "component")
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("key"), "text")
    known = texts.join(members.select("key"), "key", "left_semi").dropDuplicates(["key"])
    known = materialize(known.join(members, "key"), "join-members")
    release(docs.sparkSession)
    needed = F.greatest(F.count(F.lit(1)) / BLOCK_TEXTS, F.sum(F.octet_length("text")) / BLOCK_BYTES)
    chunks = known.groupBy("component").agg(F.ceil(needed).cast("int").alias("chunks"))
    dealt = known.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("component", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "key", "copies", "chunk", "text")
    blocks = dealt.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")
    linked = blocks.mapInPandas(_count_links, "key long, linked long").groupBy("key").agg(F.sum("linked").alias("linked"))
    per_text = copies.join(linked, "key", "left").select(F.col("key").alias("text_key"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return found.join(materialize(per_text, "join-counts"), "text_key", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with one of each component: the one with its smallest id. Texts without words all stay."""
    found = join_components(docs, id_col, text_col).where("n_shingles > 0")
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_key").alias("key"))
    best = materialize(found.groupBy("component").agg(F.min(order).alias("b")).select("b.key", "b.id"), "join-kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct("*").alias("row"), worded.alias("worded"), F.xxhash64(text).alias("key"))
    chosen = rows.where("worded").join(best, "key").where(F.col(f"row.{id_col}").cast("long").eqNullSafe(F.col("id")))
    kept = chosen.dropDuplicates(["key"]).select("row.*")
    return kept.unionByName(rows.where("not worded").select("row.*"))
