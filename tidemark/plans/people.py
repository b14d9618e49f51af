"""Directory queries over the ``people`` and ``asks`` views."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text as tx
from tidemark.operators import cleaning as cl, directory as di
from tidemark.operators.distributed import first_per_key
from tidemark.plans.registry import Tables, query
from tidemark.plans.views import VIEWS, asks, people

COMPANY = "company"


def sql_any(col: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def sql_keyword(col: str, words: list[str]) -> str:
    """Keyword test in SQL: Thai and long words as substrings, short Latin words between non-word characters."""
    thai = [w for w in words if any("฀" <= c <= "๿" for c in w)]
    latin = [w for w in words if w not in thai]
    parts = [sql_any(col, [*thai, *[w for w in latin if len(w) > 4]])]
    for w in latin:
        if len(w) <= 4:
            parts.append(rf"regexp_matches({col}, '(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])')")
    return "(" + " or ".join(parts) + ")"


def sql_policy(col: str) -> str:
    whens = " ".join(f"when {sql_keyword(col, ws)} then '{name}'" for name, ws in di.POLICY_KEYWORDS.items())
    return f"case {whens} end"


def sql_phrase(cls: str) -> str:
    whens = []
    for name, p in di.PHRASES.items():
        th, en = (p[k].replace("{company}", COMPANY) for k in ("th", "en"))
        whens.append(f"when {cls}='{name}' then case when lang='th' then '{th}' else '{en}' end")
    return f"case {' '.join(whens)} end"


def sql_unwrap(col: str = "text") -> str:
    inner = rf"trim(regexp_split_to_array({col}, '(?i)====new user====|\]\s*')[-1])"
    return (
        f"case when {sql_any(f'lower({col})', di.INJECTION_MARKERS)} then coalesce("
        rf"nullif(trim(regexp_extract({col},'[—–-]\s*(.{{5,}})$',1)),''), "
        f"case when length({inner})>4 and {inner}<>trim({col}) then {inner} end, {col}) else {col} end"
    )


# --- searches ----------------------------------------------------------------------------------------------------


@query("search_by_field", VIEWS + " select emp_id, first_name from people where contains(lower(dept),'build') and contains(lower(branch),'nation_1')")
def search_by_field(t: Tables) -> DataFrame:
    return cl.search_by_field(people(t), dept="Build", branch="nation_1", level="  ").select("emp_id", "first_name")


@query("search_exact", VIEWS + " select emp_id, first_name from people where lower(dept)='building' and lower(level)='lead' and contains(lower(first_name),'r')")
def search_exact(t: Tables) -> DataFrame:
    out = cl.search_exact(people(t), {"first_name": "R"}, dept="Building", level="LEAD", branch=None)
    return out.select("emp_id", "first_name")


@query(
    "name_contains",
    VIEWS + " select emp_id from people where contains(upper(first_name),'BO') or contains(upper(last_name),'BO') or contains(upper(nickname),'BO')",
)
def name_contains(t: Tables) -> DataFrame:
    return cl.name_contains(people(t), ["first_name", "last_name", "nickname"], "bo").select("emp_id")


@query("predicate_string", "select c_custkey, c_acctbal from customer where c_acctbal > 5000 and c_mktsegment like 'B%'")
def predicate_string(t: Tables) -> DataFrame:
    out = cl.predicate_search(t.customer, "c_acctbal > 5000 AND c_mktsegment LIKE 'B%'", ["c_custkey", "c_acctbal", "c_mktsegment"])
    return out.select("c_custkey", "c_acctbal")


@query(
    "rows_to_context",
    VIEWS
    + """ select emp_id, '{"first_name":"'||first_name||'","dept":"'||dept||'"'||case when nickname<>'' then ',"nickname":"'||nickname||'"' else '' end
      ||case when ext<>'' then ',"ext":"'||ext||'"' else '' end||'}' as context from people""",
)
def rows_to_context(t: Tables) -> DataFrame:
    return people(t).select("emp_id", tx.compact_json(["first_name", "dept", "nickname", "ext"]).alias("context"))


@query(
    "lang_coalesce",
    VIEWS + """ select emp_id, case when lang='th' then coalesce(nullif(nickname,''), first_name) else coalesce(first_name, nickname) end as shown
      from people join asks on qid=emp_id""",
)
def lang_coalesce(t: Tables) -> DataFrame:
    both = people(t).join(asks(t).select(F.col("qid").alias("emp_id"), "lang"), "emp_id")
    return both.select("emp_id", tx.lang_pick(F.col("lang"), F.col("nickname"), F.col("first_name")).alias("shown"))


# --- lookups -----------------------------------------------------------------------------------------------------


@query(
    "code_lookup",
    VIEWS
    + r""", heads as (select dept, min(emp_id) as head from people where level='VP' group by 1),
      w as (select distinct qid, unnest(regexp_extract_all(upper(text),'\b([A-Z0-9][A-Z0-9\-]{2,15})\b',1)) as code from asks)
    select qid, code, head from w join heads on dept=code""",
)
def code_lookup(t: Tables) -> DataFrame:
    heads = people(t).where("level = 'VP'").groupBy(F.col("dept").alias("code")).agg(F.min("emp_id").alias("head"))
    codes = asks(t).select("qid", F.explode(F.array_distinct(di.code_tokens(F.col("text")))).alias("code"))
    return codes.join(heads, "code").select("qid", "code", "head")


@query(
    "longest_alias",
    r"""
    with a as (select distinct w as alias from (select unnest(regexp_split_to_array(lower(text),'[^\p{L}]+')) as w from benchmark) where length(w)>=6),
      h as (select doc_id, alias, row_number() over (partition by doc_id order by length(alias) desc, alias) as r
        from documents join a on contains(lower(text), alias))
    select doc_id, alias from h where r=1""",
)
def longest_alias(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("alias"))
    return di.longest_alias(t.documents.select("doc_id", "text"), "doc_id", "text", words, min_len=6)


@query(
    "reverse_lookup",
    VIEWS
    + r""", k as (select qid, regexp_extract(text,'\b(\d{5})\b',1) as ext, lower(regexp_extract(text,'[\w.+-]+@[\w-]+\.[\w.]+')) as email from asks),
      e as (select ext, min(emp_id) as emp_id from people where ext<>'' group by 1), m as (select email, min(emp_id) as emp_id from people group by 1)
    select qid, 'ext' as how, e.emp_id from k join e using (ext) union all select qid, 'email', m.emp_id from k join m using (email)""",
)
def reverse_lookup(t: Tables) -> DataFrame:
    p = people(t).select("emp_id", "ext", "email")
    keys = asks(t).select(
        "qid",
        F.explode(
            F.array(
                F.struct(F.lit("ext").alias("how"), F.regexp_extract("text", r"\b(\d{5})\b", 1).alias("key")),
                F.struct(F.lit("email").alias("how"), F.lower(F.regexp_extract("text", r"[\w.+-]+@[\w-]+\.[\w.]+", 0)).alias("key")),
            )
        ).alias("k"),
    ).select("qid", "k.how", "k.key").where("key <> ''")
    index = p.select(
        "emp_id",
        F.explode(
            F.array(F.struct(F.lit("ext").alias("how"), F.col("ext").alias("key")), F.struct(F.lit("email").alias("how"), F.lower("email").alias("key")))
        ).alias("k"),
    ).select("emp_id", "k.how", "k.key").where("key <> ''")
    return keys.join(first_per_key(index, ["how", "key"], ["emp_id"]), ["how", "key"]).select("qid", "how", "emp_id")


@query(
    "same_team",
    VIEWS
    + """, q as (select p.dept, count(*) as askers from asks join people p on p.emp_id=qid group by 1)
    select p.dept, p.emp_id as mate, p.first_name, askers::bigint as askers from people p join q using (dept) where level='VP'""",
)
def same_team(t: Tables) -> DataFrame:
    """Team rosters with the number of people they answer for: linear in the people, not in their pairs."""
    p = people(t)
    askers = asks(t).join(p.select(F.col("emp_id").alias("qid"), "dept"), "qid").groupBy("dept").agg(F.count("*").alias("askers"))
    return p.where("level = 'VP'").join(askers, "dept").select("dept", F.col("emp_id").alias("mate"), "first_name", "askers")


@query(
    "subordinates",
    VIEWS
    + """, c as (select dept, emp_id, row_number() over (partition by dept order by emp_id) as r from people where level in ('VP','Director'))
    select p.emp_id, p.dept, coalesce((select string_agg(x.emp_id, ',' order by x.emp_id) from
      (select c.emp_id, row_number() over (order by c.emp_id) as n from c where c.dept=p.dept and c.r<=11 and c.emp_id<>p.emp_id) x where n<=10),'') as reports
    from people p""",
)
def subordinates(t: Tables) -> DataFrame:
    out = di.subordinates(people(t), "dept", "level", ["VP", "Director"], "emp_id", 10)
    return out.withColumn("reports", F.array_join("reports", ","))


NICK_DEPT_SQL = r"""
      nk as (select qid, upper(regexp_extract(text, '(?i)\b([a-z\-]{3,12})\s+(?:from|in|at|with|on the|working in|based in|working at)\s+([a-z]{2,12})\b', 1)) as name_key,
        upper(regexp_extract(text, '(?i)\b([a-z\-]{3,12})\s+(?:from|in|at|with|on the|working in|based in|working at)\s+([a-z]{2,12})\b', 2)) as dept_key from UTEXT),
      ni as (select upper(dept) as dept_key, name_key, emp_id, first_name, last_name, nickname, ext, email, level, dept,
          row_number() over (partition by upper(dept), name_key order by case when ext<>'' and not code like '%-SEC' then 0 when ext<>'' then 1 else 2 end, emp_id) as r
        from (select *, unnest(list_distinct([upper(nickname), upper(first_name)])) as name_key from people) where name_key<>'')"""


@query(
    "nick_dept_lookup",
    VIEWS
    + ", "
    + NICK_DEPT_SQL.strip().replace("UTEXT", "asks")
    + """ select qid, name_key, dept_key, emp_id from nk left join ni using (name_key, dept_key)
      where name_key<>'' and name_key not in ('WHO','MANY','HOW','THE','AND','FOR','ALL') and coalesce(r,1)=1""",
)
def nick_dept_lookup(t: Tables) -> DataFrame:
    name, dept = di.nick_dept_keys(F.col("text"))
    keys = asks(t).select("qid", name.alias("name_key"), dept.alias("dept_key")).where("name_key is not null")
    known = people(t).select("emp_id", "nickname", "first_name", "dept", "ext", "code")
    index = di.nickname_index(known, ["nickname", "first_name"], "dept", "ext", F.col("code"), "emp_id")
    return keys.join(index.select("name_key", "dept_key", "emp_id"), ["name_key", "dept_key"], "left").select(
        "qid", "name_key", "dept_key", "emp_id"
    )


@query(
    "two_token_lookup",
    VIEWS
    + """, i as (select upper(nickname) as nick_key, upper(first_name) as name_key, min(emp_id) as emp_id from people where nickname<>'' group by 1,2),
      q as (select p_partkey, upper(split_part(p_name,' ',1)) as a, upper(split_part(p_name,' ',2)) as b from part)
    select p_partkey, coalesce(x.emp_id, y.emp_id) as emp_id from q left join i x on x.nick_key=b and x.name_key=a
      left join i y on y.nick_key=a and y.name_key=b where coalesce(x.emp_id, y.emp_id) is not null""",
)
def two_token_lookup(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    pairs = t.part.select("p_partkey", words[1].alias("a"), words[0].alias("b"))
    index = people(t).where("nickname <> ''").groupBy(F.upper("nickname").alias("nick_key"), F.upper("first_name").alias("name_key")).agg(
        F.min("emp_id").alias("emp_id")
    )
    return di.either_order_lookup(pairs, "p_partkey", "a", "b", index, ["emp_id"])


BIGRAM_SQL = r"""
      un as (select upper(first_name) as f, upper(last_name) as l, min(emp_id) as emp_id, min(first_name) as first_name, min(last_name) as last_name,
        min(nickname) as nickname, min(ext) as ext, min(email) as email, min(level) as level, min(dept) as dept
        from people group by 1,2 having count(*)=1),
      ws as (select qid, regexp_split_to_array(upper(regexp_replace(trim(text),'[^\p{L}\p{N}\p{M} ]',' ','g')),'\s+') as w from UTEXT),
      bg as (select qid, i as pos, w[i] as f, w[i+1] as l from ws, unnest(range(1,len(w))) r(i)),
      bh as (select qid, pos, un.*, row_number() over (partition by qid order by pos) as r from bg join un using (f,l))"""


@query("unique_bigram_name", VIEWS + ", " + BIGRAM_SQL.strip().replace("UTEXT", "asks") + " select qid, emp_id from bh where r=1")
def unique_bigram_name(t: Tables) -> DataFrame:
    unique = di.unique_names(people(t), "first_name", "last_name", ["emp_id"])
    return di.unique_name_lookup(asks(t), "qid", "text", unique, ["emp_id"])


@query("nickname_union", VIEWS + " select emp_id, nickname, first_name from people where upper(nickname)='RED' or upper(first_name)='RED'")
def nickname_union(t: Tables) -> DataFrame:
    return di.nickname_members(people(t), ["nickname", "first_name"], " red ", "emp_id").select("emp_id", "nickname", "first_name")


@query(
    "filtered_count",
    VIEWS
    + """ select qid, dept, (select count(*) from people p where p.dept=x.dept)::bigint as n,
      (select count(*) from people p where p.dept=x.dept and p.level='Lead' and contains(lower(p.first_name),'bolt'))::bigint as n_named_leads
    from (select qid, replace(text,'how many people in ','') as dept from asks where text like 'how many people in %') x""",
)
def filtered_count(t: Tables) -> DataFrame:
    counts = people(t).groupBy("dept").agg(
        F.count("*").alias("n"),
        F.count_if((F.col("level") == "Lead") & tx.icontains(F.col("first_name"), "bolt")).alias("n_named_leads"),
    )
    keys = asks(t).where(F.startswith("text", F.lit("how many people in "))).select(
        "qid", F.replace("text", F.lit("how many people in "), F.lit("")).alias("dept")
    )
    return keys.join(counts, "dept").select("qid", "dept", "n", "n_named_leads")


@query(
    "section_not_unit",
    VIEWS + " select distinct n_name as branch from nation except select distinct branch from people where level='VP' and dept='BUILDING'",
)
def section_not_unit(t: Tables) -> DataFrame:
    units = people(t).where("level = 'VP' and dept = 'BUILDING'").select("branch")
    return t.nation.select(F.col("n_name").alias("branch")).distinct().join(units, "branch", "left_anti")


# --- question analysis -------------------------------------------------------------------------------------------


def _flags_sql() -> str:
    cols = ", ".join(f"{sql_keyword('lower(text)', ws)} as {name}" for name, ws in di.POLICY_KEYWORDS.items())
    return VIEWS + f" select qid, {cols} from asks"


@query("keyword_match", _flags_sql())
def keyword_match(t: Tables) -> DataFrame:
    flags = [di.has_keyword(F.col("text"), ws).alias(name) for name, ws in di.POLICY_KEYWORDS.items()]
    return asks(t).select("qid", *flags)


@query(
    "policy_router",
    VIEWS + f", c as (select qid, lang, {sql_policy('lower(text)')} as cls from asks) select qid, cls, {sql_phrase('cls')} as phrase from c where cls is not null",
)
def policy_router(t: Tables) -> DataFrame:
    cls = asks(t).select("qid", "lang", di.policy_class(F.col("text")).alias("cls")).where("cls is not null")
    return cls.select("qid", "cls", di.phrase(F.col("cls"), F.col("lang"), COMPANY).alias("phrase"))


@query("unwrap_question", VIEWS + f" select qid, {sql_unwrap()} as question from asks")
def unwrap_question(t: Tables) -> DataFrame:
    return asks(t).select("qid", di.unwrap_question(F.col("text")).alias("question"))


def sql_asked(col: str) -> str:
    whens = " ".join(f"when {sql_any(col, ws)} then '{name}'" for name, ws in di.ASKED_WORDS.items())
    return f"case {whens} else 'identity' end"


@query("asked_type", VIEWS + f" select qid, {sql_asked('lower(text)')} as asked from asks")
def asked_type(t: Tables) -> DataFrame:
    return asks(t).select("qid", di.asked_type(F.col("text")).alias("asked"))


SQL_IS_LIST = sql_any("lower(text)", di.LIST_WORDS)
SQL_IS_COUNT = r"(regexp_matches(lower(text),'กี่|จำนวน') or regexp_matches(lower(text),'\b(how many|size of|count)\b'))"


@query(
    "intent_flags",
    VIEWS
    + rf""" select qid, {SQL_IS_LIST} as is_list, {SQL_IS_COUNT} as is_count, {sql_any('lower(text)', di.NEED_EXT_WORDS)} as need_ext,
      case when {SQL_IS_LIST} then try_cast(nullif(regexp_extract(text,'\b([1-9][0-9]?)\b',1),'') as bigint) end as list_limit
    from (select qid, text||case when lang='th' then ' first 7' else '' end as text from asks)""",
)
def intent_flags(t: Tables) -> DataFrame:
    text = F.concat("text", F.when(F.col("lang") == "th", " first 7").otherwise(""))
    out = asks(t).select("qid", text.alias("text")).select("qid", *di.intent_flags(F.col("text")))
    return out.withColumn("list_limit", F.col("list_limit").cast("bigint"))


SUFFIXES = {"VP": "VP", "DIR": "Director", "MGR": "Manager", "LEAD": "Lead"}


@query(
    "decode_code",
    VIEWS
    + """ select emp_id, case when code like '%LEAD' then left(code,-4) when code like '%DIR' then left(code,-3) when code like '%MGR' then left(code,-3)
      when code like '%VP' then left(code,-2) end as dept_code, case when code like '%LEAD' then 'Lead' when code like '%DIR' then 'Director'
      when code like '%MGR' then 'Manager' when code like '%VP' then 'VP' end as decoded from people""",
)
def decode_code(t: Tables) -> DataFrame:
    dept, level = di.decode_code(F.col("code"), SUFFIXES)
    return people(t).select("emp_id", dept.alias("dept_code"), level.alias("decoded"))


CODES_SQL = """
      codes as (select distinct dept as code, 'department' as kind from people union select distinct code, 'section' from people
        union select distinct upper(first_name), 'section' from people where level='VP')"""


@query(
    "extract_codes",
    VIEWS
    + ", "
    + CODES_SQL.strip()
    + r""", w as (select qid, regexp_extract_all(upper(text),'\b([A-Z0-9][A-Z0-9\-]{2,15})\b',1) as ws from asks),
      h as (select qid, code, kind, row_number() over (partition by qid order by
          case when kind='section' and contains(code,'-') then 1 when kind='section' then 2 when kind='department' then 3 else 4 end, i) as r
        from w, unnest(range(1,len(ws)+1)) x(i) join codes on code=ws[i])
    select qid, code, kind from h where r=1""",
)
def extract_codes(t: Tables) -> DataFrame:
    p = people(t)
    codes = (
        p.select(F.col("dept").alias("code"), F.lit("department").alias("kind"))
        .union(p.select("code", F.lit("section")))
        .union(p.where("level = 'VP'").select(F.upper("first_name"), F.lit("section")))
        .distinct()
    )
    return di.extract_codes(asks(t), "qid", "text", codes)


@query(
    "geo_answer",
    VIEWS
    + """, h as (select qid, n_name, r_name, row_number() over (partition by qid order by length(n_name) desc, n_name) as r
        from asks join (nation join region on r_regionkey=n_regionkey) on contains(lower(text), lower(n_name)))
    select qid, n_name||' is a branch in '||r_name as answer from h where r=1""",
)
def geo_answer(t: Tables) -> DataFrame:
    branches = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    aliases = branches.select(
        F.col("n_name").alias("alias"), F.concat("n_name", F.lit(" is a branch in "), "r_name").alias("target")
    )
    return di.resolve_alias(asks(t), "qid", "text", aliases).select("qid", F.col("target").alias("answer"))


@query(
    "region_answer",
    """
    select r_name, r_name||' branches: '||string_agg(n_name, ', ' order by n_name) as answer
    from nation join region on r_regionkey=n_regionkey group by 1""",
)
def region_answer(t: Tables) -> DataFrame:
    branches = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return di.group_listing(branches, "r_name", "n_name", F.concat("r_name", F.lit(" branches: ")))


@query(
    "role_alias",
    VIEWS
    + """, al as (select distinct lower(code) as alias, code as target from people),
      h as (select qid, target, row_number() over (partition by qid order by length(alias) desc, alias) as r
        from (select qid, 'who leads '||code||' as '||level as text from asks join people on emp_id=qid) join al on contains(lower(text), alias)
        where contains(lower(text),'vp') and not contains(lower(text),'list'))
    select qid, target from h where r=1""",
)
def role_alias(t: Tables) -> DataFrame:
    p = people(t)
    texts = p.select(F.col("emp_id").alias("qid"), F.concat(F.lit("who leads "), "code", F.lit(" as "), "level").alias("text"))
    aliases = p.select(F.col("code").alias("alias"), F.col("code").alias("target")).distinct()
    return di.resolve_alias(texts, "qid", "text", aliases, gate=["vp"], block=["list"]).select("qid", "target")


@query("category_set_members", VIEWS + " select emp_id, nickname from people where upper(nickname) in ('RED','GREEN','BLUE','YELLOW','BLACK','WHITE','PINK','PURPLE','ORANGE','GRAY','BROWN','GOLD')")
def category_set_members(t: Tables) -> DataFrame:
    return di.category_members(people(t), "nickname", di.NICKNAME_SETS["colour"]).select("emp_id", "nickname")


@query(
    "exact_then_contains",
    VIEWS
    + """, terms as (select distinct upper(last_name) as term from people where level='VP' union select distinct upper(p_type) from part
        union select distinct upper(p_brand) from part),
      e as (select term, count(*) as n from terms join people on upper(last_name)=term group by 1)
    select term, 'exact' as how, n::bigint as n from e union all
    select term, 'contains', count(*)::bigint from terms join people on contains(upper(last_name), term) where term not in (select term from e) group by 1""",
)
def exact_then_contains(t: Tables) -> DataFrame:
    terms = (
        people(t).where("level = 'VP'").select(F.upper("last_name").alias("term"))
        .union(t.part.select(F.upper("p_type")))
        .union(t.part.select(F.upper("p_brand")))
    )
    return di.exact_then_contains(terms, people(t), "last_name")


# --- answers -----------------------------------------------------------------------------------------------------

NAME = "first_name||' '||last_name"
IDENTITY = f"""{NAME}||case when nickname<>'' then case when lang='th' then ' ชื่อเล่น '||nickname else ' (nickname: '||nickname||')' end else '' end
  ||' | '||level||' '||dept"""
CONTACT = f"{NAME}||case when ext<>'' then ' | '||case when lang='th' then 'ต่อ ' else 'ext ' end||ext else '' end||' | '||email"


def identity_column():
    return di.identity_text(di.full_name("first_name", "last_name"), F.col("nickname"), F.concat_ws(" ", "level", "dept"), F.col("lang"))


def contact_column():
    return di.contact_text(di.full_name("first_name", "last_name"), F.col("ext"), F.col("email"), F.col("lang"))


@query(
    "format_answer",
    VIEWS
    + f""", l as (select emp_id, {IDENTITY} as identity, {CONTACT} as contact from people join asks on qid=emp_id) select * from l""",
)
def format_answer(t: Tables) -> DataFrame:
    both = people(t).join(asks(t).select(F.col("qid").alias("emp_id"), "lang"), "emp_id")
    return both.select("emp_id", identity_column().alias("identity"), contact_column().alias("contact"))


LISTING = f"""
      li as (select dept, string_agg(r||'. '||{NAME}, chr(10) order by r) as listing from
        (select *, row_number() over (partition by dept order by emp_id) as r from people) where r<=30 group by 1)"""


@query("format_list", VIEWS + ", " + LISTING.strip() + " select dept, listing from li")
def format_list(t: Tables) -> DataFrame:
    p = people(t).select("dept", "emp_id", di.full_name("first_name", "last_name").alias("line"))
    return di.numbered_list(p, ["dept"], "line", "emp_id", 30)


ANSWER_SQL = """
      an as (select emp_id, lang, level='IC' as is_refusal, case when nickname='' then 'this person has no nickname' else
        first_name||' ext '||ext||' id '||emp_id end as answer from people join asks on qid=emp_id)"""


def answers(t: Tables) -> DataFrame:
    both = people(t).join(asks(t).select(F.col("qid").alias("emp_id"), "lang", "text"), "emp_id")
    answer = F.when(F.col("nickname") == "", "this person has no nickname").otherwise(
        F.concat_ws(" ", "first_name", F.lit("ext"), "ext", F.lit("id"), "emp_id")
    )
    return both.select("emp_id", "lang", "text", (F.col("level") == "IC").alias("is_refusal"), answer.alias("answer"))


@query(
    "compliance_mask",
    VIEWS
    + ", "
    + ANSWER_SQL.strip()
    + r""" select emp_id, case when lang='en' and contains(answer,'no nickname') then 'nickname not listed' else trim(regexp_replace(
        case when is_refusal then regexp_replace(answer,'\b\d{5}\b','XXXXX','g') else answer end, '\b0[08]\d{6}\b','XXXXXXXX','g')) end as answer from an""",
)
def compliance_mask(t: Tables) -> DataFrame:
    return answers(t).select("emp_id", di.compliance(F.col("answer"), F.col("lang"), F.col("is_refusal")).alias("answer"))


@query(
    "strip_unless_asked",
    VIEWS
    + ", "
    + ANSWER_SQL.strip()
    + rf""", x as (select an.emp_id, regexp_replace(answer||' mob 081-234-5678','\b0[08]\d{{6}}\b','','g') as a, {sql_any('lower(text)', di.NEED_EXT_WORDS)} as asked
        from an join asks on qid=emp_id)
    select emp_id, trim(regexp_replace(case when asked then a else regexp_replace(regexp_replace(a,'\b0\d{{2}}-?\d{{3}}-?\d{{4}}\b','','g'),'\b\d{{5}}\b','','g') end,
      '\s+',' ','g')) as answer from x""",
)
def strip_unless_asked(t: Tables) -> DataFrame:
    full = F.concat("answer", F.lit(" mob 081-234-5678"))
    asked = di.contains_any(F.col("text"), di.NEED_EXT_WORDS)
    return answers(t).select("emp_id", tx.strip_private_unless_asked(full, asked).alias("answer"))


HINT_RULES = {
    "phone": (["phone", "ext", "เบอร์"], "Hint: read the extension column."),
    "family": (["surname", "family", "นามสกุล", "ญาติ"], "Hint: surnames may be shared."),
    "count": (["how many", "กี่คน"], "Hint: count the rows of the department."),
    "reporting": (["report", "chain", "หัวหน้า", "members"], "Hint: the chain runs from staff to lead, manager, director and vice president."),
}


@query(
    "build_hints",
    VIEWS
    + " select qid, concat_ws(chr(10), "
    + ", ".join(f"case when {sql_any('lower(text)', ws)} then '{h}' end" for ws, h in HINT_RULES.values())
    + ") as hint from asks",
)
def build_hints(t: Tables) -> DataFrame:
    return di.hints(asks(t), "qid", "text", HINT_RULES)
