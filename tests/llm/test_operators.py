"""Parts of the operators that the queries' small tables do not reach."""

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import prose
from tidemark.llm import bpe, components, decontaminate, jaccard_join, language, quality, quotes, sharding, suffix_dedup
from tidemark.llm.hashing import shingle_set
from tidemark.llm.ordering import numbered
from tidemark.session import ensure_checkpoint_dir

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("seed", range(4))
def test_encoder_equals_the_library_on_random_text(seed):
    rng = random.Random(seed)
    alphabet = [" ", "\n", "\t", " ", "　", "'s", "a", "b", "Z", "9", "é", "日", "😀", "​", "!", "\x85"]
    encode = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    decode = bpe.decoder(RANKS)
    for _ in range(200):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        assert encode(text) == OWN.encode_ordinary(text) and decode(encode(text)) == text.encode()
    for text in ("ab" * 3000, "=" * 5000, " " * 9000, "x" * 700):
        assert encode(text) == OWN.encode_ordinary(text)


def test_folded_merges_equal_the_library(spark):
    words = ["thing", " the", "naïve", "日本語", "x", "aaaaaaaa", "unbelievable", "ß", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["word"]: r["ids"] for r in bpe.encode_words(df, bpe.rank_literal(spark, RANKS)).collect()}
    assert got == {w: list(bpe.merge_word(w.encode(), RANKS)) for w in words if w}


def test_encode_and_decode_columns(spark, odd):
    ids = odd.select("text", bpe.encode(spark, F.col("text"), RANKS, public_tokenizers.PATTERN).alias("ids"))
    for r in ids.select("text", "ids", bpe.decode(spark, F.col("ids"), RANKS).alias("b")).collect():
        assert bytes(r["b"]) == (r["text"] or "").encode() and list(r["ids"]) == OWN.encode_ordinary(r["text"] or "")


def test_large_groups_count_windows(spark, odd, monkeypatch):
    want = sorted(brute.repeats_removed([r["text"] for r in odd.select("text").collect()]))
    for limit in (0, 20_000):
        monkeypatch.setattr(suffix_dedup, "LARGEST", limit)
        rows = suffix_dedup.remove_repeats(odd).collect()
        assert sorted((r["n_bytes"], r["n_removed"], len(r["starts"]), bytes(r["kept"])) for r in rows) == want


@pytest.mark.parametrize("seed", range(2))
def test_edited_copies_by_both_ways(spark, monkeypatch, seed):
    rng = random.Random(seed)
    core = prose(rng, 700)
    texts = []
    for _ in range(40):
        a, b = sorted(rng.sample(range(len(core)), 2))
        piece = list(core[a : b + 500])
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = "#"
        texts.append(prose(rng, rng.randrange(30)) + "".join(piece) + prose(rng, rng.randrange(30)))
    texts += [texts[0][:-3] + "!", texts[0][:-7] + "?", texts[1] + "."]
    want = sorted(brute.repeats_removed(texts))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for limit in (0, 20_000):
        monkeypatch.setattr(suffix_dedup, "LARGEST", limit)
        rows = suffix_dedup.remove_repeats(df).collect()
        assert sorted((r["n_bytes"], r["n_removed"], len(r["starts"]), bytes(r["kept"])) for r in rows) == want


def test_copies_of_a_text_cut_each_context_once(spark, monkeypatch):
    rng = random.Random(6)
    core = prose(rng, 400)
    texts = [core] * 60 + [core[:-9] + f"end {i}" for i in range(5)]
    seen, reaches = [], suffix_dedup.reaches

    def watched(contexts, groups):
        seen.extend((r["gram"], r["context"]) for r in contexts.select("gram", "context").collect())
        return reaches(contexts, groups)

    monkeypatch.setattr(suffix_dedup, "reaches", watched)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r["n_bytes"], r["n_removed"], len(r["starts"]), bytes(r["kept"])) for r in rows) == sorted(brute.repeats_removed(texts))
    assert seen and len(seen) == len(set(seen))


@pytest.mark.parametrize("seed", range(5))
def test_interval_expansion(seed):
    rng = random.Random(seed)
    core = "".join(rng.choice("abcd") for _ in range(1200)).encode()
    before, after = [], []
    for _ in range(25):
        i, cut_left, cut_right = rng.randrange(400, 410), rng.randrange(368), rng.randrange(32, 400)
        before.append((b"%d" % rng.randrange(10**6) + core[i - cut_left : i])[-suffix_dedup.REACH :])
        after.append((core[i : i + cut_right] + b"%d" % rng.randrange(10**9))[: suffix_dedup.MIN_LENGTH])
    gram = np.array([hash(a[:32]) for a in after])
    left, right = suffix_dedup.expand(gram, before, after)
    for x in range(25):
        best_left = best_right = 0
        for y in range(25):
            if x != y and gram[x] == gram[y]:
                a = next((k for k, (p, q) in enumerate(zip(before[x][::-1], before[y][::-1])) if p != q), min(len(before[x]), len(before[y])))
                b = next((k for k, (p, q) in enumerate(zip(after[x], after[y])) if p != q), min(len(after[x]), len(after[y])))
                if a + b >= suffix_dedup.MIN_LENGTH:
                    best_left, best_right = max(best_left, a), max(best_right, b)
        assert (left[x], right[x]) == (best_left, best_right)


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(2)
    universe = [shingle_set(f"w{i}")[0] for i in range(400)]
    frequent = np.sort(np.array(universe[:300], dtype=np.uint64))
    place = np.random.default_rng(1).permutation(len(frequent))
    for _ in range(300):
        a = set(rng.sample(universe, rng.randrange(1, 60)))
        b = set(a)
        for x in rng.sample(sorted(a), rng.randrange(0, 1 + len(a) // 6)):
            b.discard(x)
        b |= set(rng.sample(universe, rng.randrange(0, 1 + len(a) // 12)))
        keys = [jaccard_join.prefix_keys(np.sort(np.array(sorted(s), dtype=np.uint64)), frequent, place) for s in (a, b)]
        if 100 * len(a & b) >= 75 * len(a | b):
            assert set(keys[0][0]) & set(keys[1][0]) or set(keys[0][1]) & set(keys[1][1])


def test_join_with_every_shared_shingle_frequent(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 120).split()
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words[: rng.randrange(90, 121)]))
    texts += [" ".join(base[:n]) for n in range(4, 30)]
    monkeypatch.setattr(jaccard_join, "RUN_COUNT", 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(docs).collect()}
    assert got == dict(enumerate(brute.components(texts)))


def near_copies(n: int) -> list[str]:
    """Copies of one text with so many changes that many of them link with few others or none."""
    rng = random.Random(21)
    base = prose(rng, 140).split()
    texts = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(1, 6)):
            words[at] = f"x{i}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("cell", "per_member"), [(1024, 4), (7, 0), (50, 1)])
def test_near_copies_in_cells_of_any_size(spark, monkeypatch, cell, per_member):
    texts = near_copies(90)
    for name, value in {"RUN_COUNT": 2, "CELL": cell, "PER_MEMBER": per_member}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(docs).collect()}
    want = brute.components(texts)
    assert got == dict(enumerate(want)) and len(set(want)) > 5


def test_rows_of_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    texts, rows = near_copies(300), []
    possible = jaccard_join.possible
    monkeypatch.setattr(jaccard_join, "RUN_COUNT", 2)
    monkeypatch.setattr(jaccard_join, "possible", lambda pairs, sketches: rows.append(pairs.count()) or possible(pairs, sketches))
    jaccard_join.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(rows) < 20 * len(texts)


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(5)
    universe = jaccard_join.mix(np.arange(4000, dtype=np.uint64))
    ruled_out = 0
    for _ in range(400):
        a = np.sort(rng.choice(universe, rng.integers(1, 900), replace=False))
        b = np.sort(np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.4], rng.choice(universe, rng.integers(0, 1 + len(a) // 3), replace=False)])))
        sketches = [jaccard_join._words([jaccard_join._sketch(x)]) for x in (a, b)]
        shared = len(np.intersect1d(a, b))
        likely = 175 * jaccard_join._apart(*sketches)[0] <= 25 * (len(a) + len(b))
        ruled_out += not likely
        assert likely or 100 * shared < 75 * (len(a) + len(b) - shared)
    assert ruled_out > 100


def test_sketches_of_long_sets_of_any_sizes_rule_out_strangers_and_no_link():
    rng = np.random.default_rng(6)
    universe = jaccard_join.mix(np.arange(40000, dtype=np.uint64))
    sets = [np.sort(rng.choice(universe, n, replace=False)) for n in (150, 250, 260, 4000, 4090, 4100, 5000, 9000)]
    sets += [np.sort(s[rng.random(len(s)) > 0.12]) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    differ = jaccard_join._differ([jaccard_join._sketch(s) for s in sets], i, j)
    for a, b, least in zip(i, j, differ, strict=True):
        shared = len(np.intersect1d(sets[a], sets[b]))
        assert least <= len(sets[a]) + len(sets[b]) - 2 * shared
        likely = 175 * least <= 25 * (len(sets[a]) + len(sets[b]))
        assert likely == (b - a == 8) or 3 * len(sets[b]) < 2 * len(sets[a]) or 3 * len(sets[a]) < 2 * len(sets[b])


@pytest.mark.parametrize("slots", [7, 24])
def test_a_bitmap_loses_no_wanted_row(spark, slots):
    rows = spark.range(2000).selectExpr("xxhash64(id) as key", "id")
    wanted = rows.where("id % 40 = 0")
    met, rest = (jaccard_join.among(rows, wanted.select("key"), "key", slots, others=o) for o in (False, True))
    met, rest = {r["id"] for r in met.collect()}, {r["id"] for r in rest.collect()}
    assert {r["id"] for r in wanted.collect()} <= met and met | rest == set(range(2000)) and not met & rest
    assert slots == 7 or len(met) < 60


@pytest.mark.parametrize("run", [lambda docs: jaccard_join.one_per_component(docs), lambda docs: suffix_dedup.remove_repeats(docs)])
def test_tables_of_finished_steps_are_deleted(spark, run):
    rng = random.Random(8)
    texts = [prose(rng, 120) for _ in range(12)]
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    run(spark.createDataFrame(list(enumerate([*texts, *texts[:3]])), "doc_id long, text string")).collect()
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left and not left & {f"tidemark-{x}" for x in ("join-index", "join-live", "join-tokens", "suffix-anchors", "suffix-contexts", "suffix-cuts")}


@pytest.mark.parametrize("block", [7, 1000])
def test_links_inside_a_component_are_counted(spark, monkeypatch, block):
    rng = random.Random(3)
    base = prose(rng, 150).split()
    texts = [None, "", "alone here"]
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts += [" ".join(words[: rng.randrange(110, 151)])] * (1 + i % 3)
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", block)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = jaccard_join.join_links(docs).collect()
    want = brute.link_counts(texts)
    assert {r["doc_id"]: r["n_links"] for r in rows} == dict(enumerate(want)) and len(set(want)) > 10


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


@pytest.mark.parametrize("seed", range(3))
def test_line_search_over_marks(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([8, 20, 500, 3000, 90000]) for _ in range(700)]
    ends = np.cumsum(sizes).tolist()
    total = ends[-1]
    df = spark.createDataFrame([(e, (e - 1) * 16 // total) for e in ends], "end long, block long")
    capacity, cuts = sharding.find_cuts(df, 24, total, max(sizes))
    edges = [0, *cuts, total]
    assert capacity == brute.smallest_capacity(sizes, 24) == max(b - a for a, b in zip(edges, edges[1:]))
    assert set(cuts) <= {0, *ends}


def test_numbers_of_a_hot_key_are_gapless(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), "id")
    got = numbered(df, ["k"], ["id"], 3_000_000, "test", "at").toPandas()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("k")["at"])


def test_nested_quotes(spark):
    mail = [
        (0, "first thing\n\nsecond thing"),
        (1, "On Monday X wrote:\n> first thing\n>\n> second thing\nfine"),
        (2, "> > second   THING\n> fine\nthanks\n> unknown words"),
        (3, ">> fine\n> thanks\n"),
        (4, "alone"),
    ]
    df = spark.createDataFrame([("c", i, t, 1) for i, t in mail], "conv_id string, turn long, text string, key int")
    got = {r["turn"]: r for r in quotes.conversations(df, keep=("key",)).collect()}
    assert [got[i]["parent_turn"] for i in range(5)] == [None, 0, 1, 2, None]
    assert [got[i]["depth"] for i in range(5)] == [0, 1, 2, 3, 0] and [got[i]["position"] for i in range(5)] == [0, 1, 2, 3, 4]
    assert got[2]["text"] == "thanks" and (got[2]["n_quotes"], got[2]["n_linked"], got[2]["max_level"]) == (3, 2, 2)


def test_items_of_all_sizes_are_found(spark):
    rng = random.Random(8)
    items = [prose(rng, n) for n in (3, 5, 6, 9, 17, 33, 64, 120, 300)]
    docs = [prose(rng, 40) + " " + t + " " + prose(rng, 3000) for t in items] + items
    partly = items[5].split()
    partly[0] = partly[1] = "else"
    docs.append(prose(rng, 500) + " " + " ".join(partly))
    found = decontaminate.find_contaminated(
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    )
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if brute.contained(t, x) >= 0.75}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and len(want) > 15


def test_classifier_without_both_labels(spark, odd):
    assert quality.fit(odd, odd.select("doc_id", F.lit(1).alias("quality"))) is None
    assert odd.select(quality.score(F.col("text"), None).alias("s")).distinct().collect()[0]["s"] == 0.5


def test_one_language_and_none(spark, odd):
    one = language.learn_dictionaries(odd.where("lang = 'en'"))
    rows = odd.select(language.identify(F.col("text"), one).alias("r")).select("r.*").collect()
    assert {r["lang"] for r in rows} == {"en", "und"}
    assert {r["lang"] for r in odd.select(language.identify(F.col("text"), {}).alias("r")).select("r.*").collect()} == {"und"}
