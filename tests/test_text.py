import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking as ch


def chunk_brute(text, size, overlap):
    if len(text) <= size:
        return [text]
    return [text[i : i + size] for i in range(0, len(text), size - overlap)]


@pytest.mark.parametrize("size,overlap", [(8, 2), (8, 5), (10, 9), (5, 0)])
def test_fixed_chunks_equal_slices_and_cover_everything(spark, size, overlap):
    texts = ["", "a", "abcdefgh", "abcdefghi", "ab\ncd ef😀gh" * 5, "ก่อนหน้า" * 9, "x" * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in ch.fixed_chunks(df, "text", size, overlap).orderBy("chunk_no").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {i: chunk_brute(t, size, overlap) for i, t in enumerate(texts)}


def test_chunk_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        ch.fixed_chunks(spark.createDataFrame([("x",)], "t string"), "t", 4, 4)


def test_pack_keeps_every_word_under_the_budget(spark):
    paras = [" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate([5, 3, 9, 40, 2, 2, 6])]
    df = spark.createDataFrame([("store/a.md", "\n".join(paras))], "path string, text string")
    out = ch.pack_chunks(df, "text", "path", max_tokens=20, overlap_tokens=3, pattern=r"\n").collect()
    assert all(r["n_tokens"] <= 20 and len(r["chunk"].split()) <= 20 for r in out)
    words = {w for p in paras for w in p.split()}
    assert words <= {w for r in out for w in r["chunk"].split()}
    assert out[0]["metadata"]["category"] == "Store Info" and out[0]["metadata"]["product"] == "a"


def test_paragraphs_split_headings(spark):
    df = spark.createDataFrame([("# Title\nbody one\n\n## Next\nbody two",)], "text string")
    got = [r["paragraph"] for r in ch.paragraph_split(df, "text", r"\n").collect()]
    assert got == ["# Title", "body one", "## Next", "body two"]
    blank = [r["paragraph"] for r in ch.paragraph_split(df, "text").collect()]
    assert blank == ["# Title", "body one", "## Next", "body two"]


def segment_brute(word, vocab):
    out, i = [], 0
    while i < len(word):
        n = max([k for k in range(1, len(word) - i + 1) if word[i : i + k] in vocab], default=1)
        out.append(word[i : i + n])
        i += n
    return out


def test_segment_words_takes_the_longest(spark):
    vocab = {"กิน", "ข้าว", "กินข้าว", "แล้ว", "ab", "abc", "cd", "e"}
    words = ["กินข้าวแล้ว", "abcd", "abcde9", "zz", "a"]
    out = ch.segment_words(
        spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(v,) for v in vocab], "word string")
    )
    got = {r["word"]: (r["pieces"], r["has_digit"]) for r in out.collect()}
    assert got == {w: (segment_brute(w, vocab), any(c.isdigit() for c in w)) for w in words}


def test_char_tags(spark):
    df = spark.createDataFrame([(1, "ab c def")], "id int, text string")
    got = [(r["pos"], r["ch"], r["tag"][0]) for r in ch.char_tags(df, "id", "text").orderBy("pos").collect()]
    assert got == [(0, "a", "B"), (1, "b", "E"), (3, "c", "B"), (5, "d", "B"), (6, "e", "I"), (7, "f", "E")]


def test_search_tokens_keep_list_and_thai(spark):
    df = spark.createDataFrame([("The ATM, ราคา 3.5 (ok)!",)], "t string")
    got = df.select(tx.search_tokens(F.col("t"), ["the", "atm"], ["atm"])).first()[0]
    assert got == ["atm", "ราคา", "3.5", "ok"]


@pytest.mark.parametrize(
    "reply,last,first",
    [
        ('{"answer": "7"} 3', 7, 7),
        ("maybe 3 or 12, then 5.", 5, 3),
        ("<think>4</think> ANSWER: 9", 9, 9),
        ("none", 1, None),
        (None, 1, None),
        ("99 only", 1, None),
    ],
)
def test_parse_answer(spark, reply, last, first):
    df = spark.createDataFrame([(reply,)], "t string")
    assert tuple(df.select(tx.parse_answer(F.col("t")), tx.parse_answer_first(F.col("t"))).first()) == (last, first)


def test_small_text_helpers(spark):
    df = spark.createDataFrame([("  ", "a/b/c.tar.md?x=1", "73048.0", "x1y2")], "a string, p string, e string, d string")
    from tidemark.functions.numbers import normalize_extension

    row = df.select(
        tx.blank_to_default(F.col("a"), "-"), tx.path_stem(F.col("p")), normalize_extension(F.col("e")), tx.digits_only(F.col("d")),
        tx.text_after(F.lit("say: this: that"), ":"), tx.strip_blocks(F.lit("a<think>x\ny</think>b")),
    ).first()
    assert tuple(row) == ("-", "c.tar", "73048", "12", "that", "ab")


def test_space_positions_and_vocabulary(spark):
    df = spark.createDataFrame([(1, "a b  c")], "id int, t string")
    assert sorted(r["pos"] for r in ch.space_positions(df, "t").collect()) == [1, 3, 4]
    extra = spark.createDataFrame([("z",), ("a",)], "w string")
    assert sorted(r["word"] for r in ch.vocabulary((df, "t"), extra=extra).collect()) == ["a", "b", "c", "z"]


def pack_brute(sizes, budget):
    """Runs of paragraphs, built one after the other; None marks an oversized one."""
    runs, held = [], []
    for i, n in enumerate(sizes):
        if n > budget:
            runs += [held, [i, None]] if held else [[i, None]]
            held = []
        elif sum(sizes[j] for j in held) + n > budget:
            runs.append(held)
            held = [held[-1], i] if sizes[held[-1]] + n <= budget else [i]
        else:
            held = [*held, i]
    return [r for r in [*runs, held] if r]


def test_packed_spans_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.choice([1, 2, 5, 9, 10, 11, 30]) for _ in range(rng.randrange(0, 40))]) for i in range(200)] + [(200, [])]
    out = spark.createDataFrame(rows, "id int, sizes array<int>").select("id", "sizes", ch.packed_spans(F.col("sizes"), F.lit(10)).alias("s"))
    for r in out.collect():
        want = [(x[0], x[0], None) if x[-1] is None else (x[0], x[-1], sum(r["sizes"][j] for j in x)) for x in pack_brute(r["sizes"], 10)]
        assert [tuple(s) for s in r["s"]] == want


def test_segmentation_of_a_very_long_word(spark):
    import random

    rng = random.Random(6)
    vocab = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(60)}
    word = "".join(rng.choice("abcd") for _ in range(20_000))
    out = ch.segment_words(spark.createDataFrame([(word,)], "word string"), spark.createDataFrame([(v,) for v in vocab], "word string")).first()
    want, i = [], 0
    while i < len(word):
        n = max([k for k in range(1, 8) if word[i : i + k] in vocab], default=1)
        want.append(word[i : i + n])
        i += n
    assert out["pieces"] == want
