"""Chunking, token and segmentation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text as tx
from tidemark.operators import chunking as ch
from tidemark.plans.registry import Tables, query

STOP = ["the", "of", "and", "le", "la", "de", "der", "die", "und", "el", "en"]
KEEP = ["el", "en"]


def sql_tokens(col: str) -> str:
    """The search tokens of a text column as a DuckDB list."""
    dropped = ", ".join(f"'{w}'" for w in STOP if w not in KEEP)
    clean = rf"regexp_replace(lower({col}), '[^\p{{L}}\p{{N}}_\x{{0E01}}-\x{{0E59}}.\s]', '', 'g')"
    return rf"list_filter(regexp_split_to_array({clean}, '\s+'), lambda w: w <> '' and w not in ({dropped}))"


def tokens(col: str = "text"):
    return tx.search_tokens(F.col(col), STOP, KEEP)


@query(
    "vocabulary_build",
    r"""
    with w as (select unnest(regexp_split_to_array(text,'\s+')) as word from documents union
      select unnest(regexp_split_to_array(text,'\s+')) from benchmark union
      select unnest(regexp_split_to_array(text,'\s+')) from conversations union select p_type from part)
    select word from w where word<>''""",
)
def vocabulary_build(t: Tables) -> DataFrame:
    return ch.vocabulary(
        (t.documents.select("doc_id", "text"), "text"), (t.benchmark, "text"), (t.conversations, "text"), extra=t.part.select("p_type")
    )


@query(
    "space_positions",
    """
    select item_id, (i-1)::bigint as pos from benchmark, unnest(range(1,length(text)+1)) r(i) where substr(text,i,1)=' '""",
)
def space_positions(t: Tables) -> DataFrame:
    return ch.space_positions(t.benchmark, "text").select("item_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    "chunk_fixed",
    """
    with s as (select doc_id, text, length(text) as n from documents)
    select doc_id, 0::bigint as chunk_no, md5(text) as chunk, n::bigint as n_chars from s where n<=512
    union all select doc_id, (i//384)::bigint, md5(substr(text,i+1,512)), length(substr(text,i+1,512))::bigint
    from s, unnest(range(0,n,384)) r(i) where n>512""",
)
def chunk_fixed(t: Tables) -> DataFrame:
    out = ch.fixed_chunks(t.documents.select("doc_id", "text"), "text")
    return out.select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk"),
        F.length("chunk").cast("bigint").alias("n_chars"),
    )


@query(
    "paragraph_split",
    r"""
    with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text,'(?m)(^#+\s.*$)',chr(10)||'\1'||chr(10),'g'),chr(10)),
        lambda x: trim(x)), lambda x: x<>'') as ps from documents)
    select doc_id, (i-1)::bigint as para_no, ps[i] as paragraph from p, unnest(range(1,len(ps)+1)) r(i)""",
)
def paragraph_split(t: Tables) -> DataFrame:
    out = ch.paragraph_split(t.documents.select("doc_id", "text"), "text", r"\n")
    return out.withColumn("para_no", F.col("para_no").cast("bigint"))


@query(
    "paragraph_blank_lines",
    r"""
    with p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text,'. ','.'||chr(10)||chr(10)),'(?m)(^#+\s.*$)',
        chr(10)||chr(10)||'\1'||chr(10)||chr(10),'g'),chr(10)||chr(10)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'') as ps from documents)
    select doc_id, (i-1)::bigint as para_no, md5(ps[i]) as paragraph from p, unnest(range(1,len(ps)+1)) r(i)""",
)
def paragraph_blank_lines(t: Tables) -> DataFrame:
    """Paragraphs parted by blank lines; the documents get one after every sentence."""
    spaced = t.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return ch.paragraph_split(spaced, "text").select("doc_id", F.col("para_no").cast("bigint").alias("para_no"), F.md5("paragraph").alias("paragraph"))


# Budget 400 less the 7 tokens of the prefix; parts of oversized paragraphs step on by 393 - 60.
PACK = r"""
    with recursive ps as (select doc_id, list_filter(list_transform(string_split(
          regexp_replace(text,'(?m)(^#+\s.*$)',chr(10)||'\1'||chr(10),'g'),chr(10)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')), lambda x: x<>'') as ps
        from documents),
      pn as materialized (select doc_id, i, list_filter(regexp_split_to_array(ps[i],'\s+'), lambda w: w<>'') as ws, length(ps[i]) as c,
          len(list_filter(regexp_split_to_array(ps[i],'\s+'), lambda w: w<>'')) as n from ps, unnest(range(1,len(ps)+1)) r(i)),
      cnt as (select doc_id, max(i) as m from pn group by 1),
      walk as (select doc_id, 1::bigint as i, 1::bigint as s, 0::bigint as total, null::bigint as es, null::bigint as ee, null::bigint as et from cnt
        union all
        select w.doc_id, w.i+1,
          case when p.n>393 then w.i+1 when w.total+p.n>393 then case when w.s<w.i and q.n+p.n<=393 then w.i-1 else w.i end else w.s end,
          case when p.n>393 then 0 when w.total+p.n>393 then case when w.s<w.i and q.n+p.n<=393 then q.n+p.n else p.n end else w.total+p.n end,
          case when (p.n>393 or w.total+p.n>393) and w.s<w.i then w.s end, case when (p.n>393 or w.total+p.n>393) and w.s<w.i then w.i-1 end,
          case when (p.n>393 or w.total+p.n>393) and w.s<w.i then w.total end
        from walk w join pn p on p.doc_id=w.doc_id and p.i=w.i left join pn q on q.doc_id=w.doc_id and q.i=w.i-1),
      spans as (select doc_id, i-1 as para, es, ee, et from walk where es is not null
        union all select doc_id, i, s, m, total from walk join cnt using (doc_id) where i=m+1 and s<=m),
      packed as (select sp.doc_id, para, 0 as kind, 0 as k, any_value(et) as n_tokens, sum(c)+2*(any_value(ee)-any_value(es)) as body
          from spans sp join pn on pn.doc_id=sp.doc_id and pn.i between es and ee group by 1,2
        union all select doc_id, i, 1, k, least(393, n-k*333), length(array_to_string(ws[k*333+1:k*333+393],' '))
          from pn, unnest(range(0, 1+ceil((n-393)/333.0)::bigint)) r(k) where n>393)
    select doc_id, (row_number() over (partition by doc_id order by para, kind, k)-1)::bigint as chunk_no, n_tokens::bigint as n_tokens,
      (body+length('Category: Store Info | Title: '||doc_id||chr(10)||'Content: '))::bigint as n_chars, doc_id::varchar as product, 'Store Info' as category
    from packed"""


@query("chunk_pack", PACK)
def chunk_pack(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "source").select(
        "doc_id", "text", F.concat(F.col("source"), F.lit("/store/"), F.col("doc_id"), F.lit(".md")).alias("path")
    )
    out = ch.pack_chunks(docs, "text", "path", pattern=r"\n")
    ints = {"chunk_no": F.col("chunk_no"), "n_tokens": F.col("n_tokens"), "n_chars": F.length("chunk")}
    return out.select("doc_id", *[c.cast("bigint").alias(n) for n, c in ints.items()], "metadata.product", "metadata.category")


@query(
    "oversize_chunks",
    r"""
    select doc_id, len(list_filter(regexp_split_to_array(text,'\s+'), lambda w: w<>''))::bigint as n_words from documents
    where len(list_filter(regexp_split_to_array(text,'\s+'), lambda w: w<>'')) > 400""",
)
def oversize_chunks(t: Tables) -> DataFrame:
    big = ch.oversize(t.documents.select("doc_id", "text"), "text", 400)
    return big.select("doc_id", F.size(tx.words(F.col("text"))).cast("bigint").alias("n_words"))


@query("normalized_tokens", f"select doc_id, array_to_string({sql_tokens('text')},' ') as tokens from documents")
def normalized_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text").select("doc_id", F.array_join(tokens(), " ").alias("tokens"))


@query(
    "oov_words",
    r"""
    with d as (select distinct unnest(regexp_split_to_array(lower(text),'\s+')) as word from documents),
      b as (select unnest(regexp_split_to_array(lower(text),'\s+')) as word from benchmark)
    select word, count(*)::bigint as n from b where word<>'' and word not in (select word from d) group by 1""",
)
def oov_words(t: Tables) -> DataFrame:
    from tidemark.operators.cleaning import unknown_only

    words = t.benchmark.select(F.explode(tx.words(F.lower("text"))).alias("word"))
    known = t.documents.select("doc_id", "text").select(F.explode(tx.words(F.lower("text"))).alias("word"))
    return unknown_only(words.groupBy("word").agg(F.count("*").alias("n")), known, "word")


@query(
    "dict_segment",
    r"""
    with recursive v as materialized (select distinct unnest(regexp_split_to_array(text,'\s+')) as w from conversations),
      b as materialized (select distinct unnest(regexp_split_to_array(text,'\s+')) as word from benchmark),
      t as materialized (select word from b where word<>'' and word not in (select w from v)),
      c as (select word, i as start, j as len, substr(word,i,j) as piece
        from t, unnest(range(1,length(word)+1)) a(i), unnest(range(1,length(word)-i+2)) e(j)),
      best as materialized (select word, start, max(len) as len from c where piece in (select w from v) group by 1,2),
      walk as (select word, 1::bigint as pos, ''::varchar as pieces from t
        union all
        select walk.word, walk.pos + coalesce(best.len,1),
          walk.pieces || case when walk.pos=1 then '' else '|' end || substr(walk.word, walk.pos::bigint, coalesce(best.len,1))
        from walk left join best on best.word=walk.word and best.start=walk.pos where walk.pos <= length(walk.word))
    select word, regexp_matches(word,'[0-9]') as has_digit, pieces from walk where pos > length(word)""",
)
def dict_segment(t: Tables) -> DataFrame:
    from tidemark.operators.cleaning import unknown_only

    vocab = ch.vocabulary((t.conversations, "text"))
    words = t.benchmark.select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    out = ch.segment_words(unknown_only(words, vocab, "word"), vocab)
    return out.withColumn("pieces", F.array_join("pieces", "|"))


@query(
    "char_tags",
    r"""
    with c as (select item_id, i-1 as pos, substr(text,i,1) as ch, substr(text,i-1,1) as pv, substr(text,i+1,1) as nx, length(text) as n
      from benchmark, unnest(range(1,length(text)+1)) r(i))
    select item_id, pos::bigint as pos, ch, case when pos=0 or regexp_matches(pv,'^\s$') then 'B_WORD'
      when pos=n-1 or regexp_matches(nx,'^\s$') then 'E_WORD' else 'I_WORD' end as tag from c where not regexp_matches(ch,'^\s$')""",
)
def char_tags(t: Tables) -> DataFrame:
    return ch.char_tags(t.benchmark, "item_id", "text").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "token_offsets",
    r"""
    with w as (select item_id, list_filter(regexp_split_to_array(text,'\s+'), lambda x: x<>'') as ws from benchmark)
    select item_id, (i-1)::bigint as pos, ws[i] as token, length(array_to_string(ws[1:i-1],''))::bigint as "offset"
    from w, unnest(range(1,len(ws)+1)) r(i)""",
)
def token_offsets(t: Tables) -> DataFrame:
    out = ch.token_offsets(t.benchmark, "item_id", "text")
    return out.select("item_id", F.col("pos").cast("bigint").alias("pos"), "token", F.col("offset").cast("bigint").alias("offset"))
