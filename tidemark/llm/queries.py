"""The registered ``opN_<name>`` queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import (
    bpe,
    decontaminate,
    fingerprints,
    hard_negatives,
    jaccard_join,
    language,
    licenses,
    quality,
    quotes,
    sharding,
    suffix_dedup,
    token_store,
    whitening,
)

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql.strip()
        return build

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


QUOTE_SQL = """
    with recursive m as (
        select conv_id, turn, role, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as own,
            trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) as norm
        from conversations),
    first_said as (select conv_id, norm, min(turn) as origin from m where norm <> '' group by all),
    q as (
        select m.*, one.norm as norm1, two.norm as norm2, o1.origin as origin1, o2.origin as origin2
        from m
        left join m one on one.conv_id = m.conv_id and one.turn = m.turn - 1 and one.norm <> ''
        left join m two on two.conv_id = m.conv_id and two.turn = m.turn - 2 and two.norm <> '' and one.turn is not null
        left join first_said o1 on o1.conv_id = one.conv_id and o1.norm = one.norm
        left join first_said o2 on o2.conv_id = two.conv_id and o2.norm = two.norm),
    tree(conv_id, turn, thread_turn, depth) as (
        select conv_id, turn, turn, 0 from q where origin1 is null
        union all
        select q.conv_id, q.turn, tree.thread_turn, tree.depth + 1
        from q join tree on q.conv_id = tree.conv_id and q.origin1 = tree.turn)
    select q.conv_id, q.turn, q.role, sha256(q.own) as text_sha256, q.origin1 as parent_turn, tree.thread_turn,
        cast(tree.depth as bigint) as depth,
        row_number() over (partition by q.conv_id order by tree.thread_turn, tree.depth, q.turn) - 1 as position,
        (q.norm1 is not null)::bigint + (q.norm2 is not null)::bigint as n_quotes,
        (q.origin1 is not null)::bigint + (q.origin2 is not null)::bigint as n_linked,
        case when q.norm2 is not null then 2 when q.norm1 is not null then 1 else 0 end::bigint as max_level
    from q join tree using (conv_id, turn)"""


def as_mail(turns: DataFrame) -> DataFrame:
    """The chat turns as a mail thread: each quotes the turn before it, and that turn's own quote one level deeper."""
    text = F.coalesce("text", F.lit(""))
    said = turns.select("conv_id", "turn", "role", text.alias("text"))
    before = lambda n, c: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(c))
    both = said.join(before(1, "one"), ["conv_id", "turn"], "left").join(before(2, "two"), ["conv_id", "turn"], "left")
    marked = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark), F.lit("\n"))
    deeper = F.when(F.col("one").isNotNull(), F.coalesce(marked("two", "> > "), F.lit("")))
    quoted = F.coalesce(F.concat(deeper, marked("one", "> ")), F.lit(""))
    return both.select("conv_id", "turn", "role", F.concat(quoted, "text").alias("text"))


@register("op1_quote_links", QUOTE_SQL)
def quote_links(spark: SparkSession, folder: str) -> DataFrame:
    """Quotation linking over all conversations, written as mail threads with quotes two levels deep."""
    found = quotes.conversations(as_mail(table(spark, folder, "conversations")), keep=("role",))
    return found.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@register("op2_minimax_shards")
def minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts stay together."""
    text = F.coalesce("text", F.lit(""))
    group, size = F.unhex(F.sha2(text, 256)), F.octet_length(text) + 8
    rows = sharding.minimax_shards(
        table(spark, folder, "documents"), group, size, "doc_id", 24, {"text_crc32": F.crc32(text.cast("binary"))}
    )
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@register("op5_license_scan", licenses.oracle_sql())
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@register("op3_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, their digest, and the digest of the bytes they decode to."""
    docs = table(spark, folder, "documents")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pattern, shared = public_tokenizers.PATTERN, spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ids_of, bytes_of = bpe.encoder(shared.value, pattern), bpe.decoder(shared.value)
        decimal = {rank: str(rank) for rank in shared.value.values()}.__getitem__
        for batch in batches:
            out = []
            for text in batch:
                ids = ids_of(text)
                line = " ".join(map(decimal, ids)).encode()
                out.append((len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(bytes_of(ids)).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("r")).select("doc_id", "r.*")


@register("op4_suffix_dedup")
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every text once all bytes in repeated 400-byte strings are gone."""
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    n_spans, digest = F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    return cut.select("row.doc_id", "n_bytes", "n_removed", n_spans, digest)


def language_model(docs: DataFrame) -> dict[str, bytes]:
    return language.learn_dictionaries(docs.where(~language.held_out(F.col("doc_id"))))


@register("op6_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(F.col("text"), language_model(docs)).alias("r")
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), found)
    return rows.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.margin", "r.rejected")


@register("op7_quality")
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    model = quality.fit(docs.where(~language.held_out(F.col("doc_id"))), labels)
    score = quality.score(F.col("text"), model).alias("score")
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), score)
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@register("op8_jaccard_join")
def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, folder, "documents")).drop("text_key", "component")


@register("op8_jaccard_links")
def jaccard_links(spark: SparkSession, folder: str) -> DataFrame:
    """Component and number of links of every document."""
    return jaccard_join.join_links(table(spark, folder, "documents")).drop("text_key", "component")


@register("op9_decontaminate", decontaminate.SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a document and a benchmark item of which it holds three quarters of the shingles or more."""
    items = table(spark, folder, "benchmark")
    return decontaminate.find_contaminated(table(spark, folder, "documents"), items).drop("text_key")


@register("op10_fingerprints")
def document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, folder, "documents"))


@register("op11_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen whitened components of every embedding; the fit takes each distinct integer vector once."""
    return whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding")


@register("op12_hard_negatives", hard_negatives.SQL)
def mined_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth embedding; every seventh label is moved by one."""
    vectors = table(spark, folder, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(vectors, "vec_id", "embedding", moved, lambda vec_id: vec_id % 100 == 0)


@register("op13_token_store")
def stored_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Place, number and checksum of the ids of every document, read back from the blocks that hold them."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    store = token_store.write_store(table(spark, folder, "documents"), "doc_id", "text", tokenizer, end_id=2)
    return token_store.read_back(store)


@register("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
