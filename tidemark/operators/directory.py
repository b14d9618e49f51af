"""Set-based question answering against a directory: one output row per question, never a loop over questions.

Hot keys (a department or nickname shared by a third of all people) never meet a question row by row: each lookup
first reduces the directory to one row per key, and only that row joins the questions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import mask_private
from tidemark.operators.aliases import contained_names
from tidemark.operators.distributed import dealt, first_per_key, materialize, spread_scan, top_per_key

# Canonical phrases by class and language. ``{company}`` is filled in by the caller.
PHRASES = {
    "prompt_injection": {"th": "ขอปฏิเสธคำขอ", "en": "request declined"},
    "external_company": {"th": "ไม่ใช่ข้อมูลของ{company}", "en": "not a {company} record"},
    "opinion": {"th": "ไม่สามารถให้ความเห็นได้", "en": "cannot offer an opinion"},
    "field_not_in_directory": {"th": "ไม่สามารถให้ข้อมูลนี้ได้", "en": "cannot provide this information"},
    "nickname_blank": {"th": "ไม่มีชื่อเล่นในระบบ", "en": "nickname not listed"},
    "person_not_found": {"th": "ไม่พบข้อมูล", "en": "no record found"},
}

# Keywords of each policy class, in the order in which the classes are tested.
POLICY_KEYWORDS = {
    "prompt_injection": [
        "ignore previous instructions", "ignore above instructions", "disregard all", "forget all instructions",
        "jailbreak", "roleplay as", "pretend you are", "ละเว้นคำสั่งทั้งหมด", "ลืมคำสั่งทั้งหมด",
    ],
    "external_company": [
        "samsung", "apple", "lg", "sony", "microsoft", "google", "amazon", "alibaba", "huawei", "xiaomi", "dell", "hp",
        "lenovo", "asus", "acer", "panasonic", "sharp", "toshiba", "hitachi", "true", "ais", "dtac", "scb", "kbank",
        "bbl", "ktb", "bay", "ptt", "cpf", "cp group", "central", "robinson", "tesla", "meta", "netflix", "uber",
        "grab",
    ],
    "opinion": [
        "เก่งที่สุด", "ดีที่สุด", "แย่ที่สุด", "ฉลาดที่สุด", "น่าจะ", "ควรจะ", "ควร", "คิดว่า", "เหมาะสม", "เหมาะที่สุด",
        "โปรโมท", "แนะนำ", "ประเมิน", "คาดการณ์", "เก่งกว่า", "ดีกว่า", "เหนือกว่า", "สมควร", "น่าจะเป็น", "น่าจะได้",
        "ใครทำงานดี", "คนไหนเก่ง", "ใครเหมาะ",
        "best", "worst", "should", "think", "opinion", "recommend", "predict", "estimate", "likely", "probably",
        "suitable", "lead the next", "who would", "better than", "worse than", "most qualified", "most talented",
        "deserves", "smartest", "most intelligent", "rate", "rank", "evaluate", "assess",
    ],
    "field_not_in_directory": [
        "เงินเดือน", "ค่าจ้าง", "รายได้", "โบนัส", "ค่าตอบแทน", "สวัสดิการ", "อายุ", "วันเกิด", "เกิดปี", "อายุงาน",
        "วุฒิการศึกษา", "การศึกษา", "ปริญญา", "ประวัติการศึกษา", "จบจาก", "มหาวิทยาลัย", "ศาสนา", "ความเชื่อ", "นับถือ",
        "สถานภาพ", "สมรส", "โสด", "แต่งงาน", "ภูมิลำเนา", "บ้านเกิด", "ทะเบียนบ้าน", "ที่พักอาศัย", "รูปภาพ", "รูปร่าง",
        "หน้าตา", "น้ำหนัก", "ส่วนสูง", "หมู่เลือด", "กรุ๊ปเลือด", "สุขภาพ", "รหัสบัตรประชาชน", "บัตรประชาชน",
        "หนังสือเดินทาง", "พาสปอร์ต", "เลขประจำตัวประชาชน", "ผลการปฏิบัติงาน", "ประวัติการทำงาน",
        "salary", "wage", "income", "bonus", "pay", "compensation", "benefits", "remuneration", "how old", "age",
        "birth", "birthday", "born", "date of birth", "dob", "education", "degree", "qualification", "university",
        "school", "graduated", "alma mater", "studied at", "religion", "faith", "belief", "religious", "marital",
        "married", "single", "spouse", "divorced", "address", "hometown", "home address", "residence", "domicile",
        "photo", "picture", "appearance", "weight", "height", "blood type", "blood group", "health", "passport",
        "passport number", "national id", "id number", "citizen id", "identification number", "performance review",
        "performance rating", "demoted", "demotion", "promotion history", "recently promoted", "recently demoted",
    ],
}

# Marks of a wrapped question.
INJECTION_MARKERS = [
    "admin mode", "====end user====", "[คำสั่งพิเศษ]", "คำสั่งพิเศษ", "ignore previous", "ignore above",
    "new instruction", "forget instructions",
]

# Nickname categories.
NICKNAME_SETS = {
    "fruit": [
        "มะม่วง", "กล้วย", "ส้ม", "มะละกอ", "แตง", "ลิ้นจี่", "ทับทิม", "มังคุด", "แอปเปิ้ล", "เบอร์รี่", "มะพร้าว", "ชมพู่",
        "กีวี่", "เชอร์รี่", "มะขาม", "ฝรั่ง", "พลัม", "มะนาว", "ลูกพีช", "องุ่น",
        "MANGO", "BANANA", "ORANGE", "PAPAYA", "MELON", "LYCHEE", "POMEGRANATE", "MANGOSTEEN", "APPLE", "BERRY",
        "COCONUT", "GUAVA", "KIWI", "CHERRY", "TAMARIND", "PLUM", "PEACH", "GRAPE", "LEMON", "LIME", "PEAR",
    ],
    "colour": [
        "แดง", "เขียว", "น้ำเงิน", "เหลือง", "ดำ", "ขาว", "ชมพู", "ม่วง", "ส้ม", "ฟ้า", "เทา", "น้ำตาล",
        "RED", "GREEN", "BLUE", "YELLOW", "BLACK", "WHITE", "PINK", "PURPLE", "ORANGE", "GRAY", "BROWN", "GOLD",
    ],
}

# Wordings that mean a blank nickname.
BLANK_NICKNAME_WORDINGS = {
    "th": ["ไม่มีชื่อเล่น", "ไม่ปรากฏชื่อเล่น", "ไม่มีข้อมูลชื่อเล่น"],
    "en": ["does not have a nickname", "no nickname", "nickname is not available", "nickname is not listed",
           "has no nickname"],
}

# Words that reveal what a question asks for, tested in this order.
ASKED_WORDS = {
    "contact": ["ติดต่อ", "contact info", "contact details"],
    "phone": ["เบอร์", "ต่อ", "โทร", "ext", "extension", "phone", "number", "mobile"],
    "email": ["อีเมล", "email", "e-mail"],
    "team": ["ทีมไหน", "แผนกไหน", "อยู่ที่ไหน", "สังกัด", "which team", "which dept", "which department"],
}
# Words of listing questions and of questions for a number.
LIST_WORDS = ["มีใครบ้าง", "รายชื่อ", "ใครอยู่", "who's in", "who is in", "list", "members", "สมาชิก", "ใครบ้าง"]
NEED_EXT_WORDS = ["ext", "extension", "เบอร์", "ต่อ", "phone", "โทร"]


# --- question analysis -------------------------------------------------------------------------------------------


def _word_class(kw: str) -> str:
    if re.search(r"[\u0E00-\u0E7F]", kw):
        return "substring"
    return "word" if len(kw) <= 4 else "substring"


def word_pattern(words: Sequence[str]) -> str:
    """Any of the words standing alone. The edge is spelled out over all letters and digits, so that a Latin word
    glued to Thai text does not match."""
    edge = r"[\p{L}\p{N}_]"
    quoted = "|".join(re.sub(r"([.\\+*?\[\]^$(){}|])", r"\\\1", w) for w in words)
    return f"(?<!{edge})(?:{quoted})(?!{edge})"


def has_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """Short Latin words must stand alone; Thai and longer words count anywhere."""
    low = [k.lower() for k in dict.fromkeys(keywords)]
    alone = [k for k in low if _word_class(k) == "word"]
    anywhere = [k for k in low if _word_class(k) != "word"]
    # a keyword that contains another adds nothing
    anywhere = [k for k in anywhere if not any(o != k and o in k for o in anywhere)]
    out = contains_any(text, anywhere) if anywhere else F.lit(False)
    return out | F.lower(text).rlike(word_pattern(alone)) if alone else out


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    """Plain substring test for each of a short fixed list, as one compiled pattern."""
    either = "|".join(re.escape(k) for k in keywords)
    return F.coalesce(F.lower(text).rlike(either), F.lit(False)) if keywords else F.lit(False)


def policy_class(text: Column, keywords: Mapping[str, Sequence[str]] = POLICY_KEYWORDS) -> Column:
    """First policy class that applies, or null."""
    out = None
    for name, words in keywords.items():
        hit = has_keyword(text, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def phrase(cls: Column, lang: Column, company: str = "company", phrases: Mapping = PHRASES) -> Column:
    """Canonical phrase of a class in the question's language."""
    out = F.lit(None).cast("string")
    for name, texts in phrases.items():
        th, en = (texts[k].replace("{company}", company) for k in ("th", "en"))
        out = F.when(cls == name, F.when(lang == "th", F.lit(th)).otherwise(F.lit(en))).otherwise(out)
    return out


# What a tampered question stands behind (everything after the dash, however long; the last marker).
AFTER_DASH = r"(?s)[—–-]\s*(.{5,})$"
AFTER_MARKER = r"(?i)====new user====|\]\s*"


def unwrap_question(text: Column) -> Column:
    """The real question inside tampered text: all that follows a dash, else the part after the last marker."""
    marked = contains_any(text, INJECTION_MARKERS)
    tail = F.nullif(F.trim(F.regexp_extract(text, AFTER_DASH, 1)), F.lit(""))
    last = F.trim(F.element_at(F.split(text, AFTER_MARKER), -1))
    inner = F.when((F.length(last) > 4) & (last != F.trim(text)), last)
    return F.when(marked, F.coalesce(tail, inner, text)).otherwise(text)


def asked_type(text: Column) -> Column:
    out = None
    for name, words in ASKED_WORDS.items():
        hit = contains_any(text, words)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise("identity")


def intent_flags(text: Column) -> list[Column]:
    low = F.lower(text)
    is_list = contains_any(text, LIST_WORDS)
    is_count = low.rlike(r"กี่|จำนวน") | low.rlike(r"\b(how many|size of|count)\b")
    limit = F.nullif(F.regexp_extract(text, r"\b([1-9][0-9]?)\b", 1), F.lit("")).try_cast("int")
    return [
        is_list.alias("is_list"),
        is_count.alias("is_count"),
        contains_any(text, NEED_EXT_WORDS).alias("need_ext"),
        F.when(is_list, limit).alias("list_limit"),
    ]


def decode_code(code: Column, suffixes: Mapping[str, str]) -> tuple[Column, Column]:
    """(department, level) of a position code by its longest known suffix."""
    dept = F.lit(None).cast("string")
    level = F.lit(None).cast("string")
    for suffix, name in sorted(suffixes.items(), key=lambda kv: len(kv[0])):
        hit = F.endswith(code, F.lit(suffix)) & (F.length(code) > len(suffix))
        dept = F.when(hit, F.substring(code, F.lit(1), F.length(code) - len(suffix))).otherwise(dept)
        level = F.when(hit, F.lit(name)).otherwise(level)
    return dept, level


def code_tokens(text: Column, longest: int = 15) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(rf"\b([A-Z0-9][A-Z0-9\-]{{2,{longest}}})\b"), 1)


def extract_codes(questions: DataFrame, qid: str, text: str, codes: DataFrame) -> DataFrame:
    """Best code named in each question. ``codes``: (code, kind); dashed sections, then sections, then departments."""
    tokens = questions.select(qid, F.posexplode(code_tokens(F.col(text))).alias("pos", "code"))
    found = tokens.join(codes.select("code", "kind").distinct(), "code")
    rank = (
        F.when((F.col("kind") == "section") & F.contains("code", F.lit("-")), 1)
        .when(F.col("kind") == "section", 2)
        .when(F.col("kind") == "department", 3)
        .otherwise(4)
    )
    best = F.min_by(F.struct("code", "kind"), F.struct(rank.alias("r"), F.col("pos"))).alias("b")
    return found.groupBy(qid).agg(best).select(qid, "b.code", "b.kind")


def longest_alias(texts: DataFrame, key: str, text: str, aliases: DataFrame, min_len: int = 1) -> DataFrame:
    """Longest alias contained anywhere in each text, ties alphabetical; texts without one are left out."""
    names = aliases.select(F.lower(F.col(aliases.columns[0])).alias("alias")).where(F.length("alias") >= min_len).distinct()
    lowered = spread_scan(texts.select(key, F.lower(F.col(text)).alias("__low")))
    hits = contained_names(lowered, key, "__low", materialize(names, "aliases"))
    best = F.min(F.struct((-F.length("alias")).alias("l"), F.col("alias"))).alias("b")
    return hits.groupBy(key).agg(best).select(key, F.col("b.alias").alias("alias"))


def resolve_alias(
    texts: DataFrame,
    key: str,
    text: str,
    aliases: DataFrame,
    gate: Sequence[str] = (),
    block: Sequence[str] = (),
) -> DataFrame:
    """Target of the longest alias in each text. ``aliases``: (alias, target).

    With ``gate`` only texts holding one of these words are looked at (secretary or manager questions, say); texts
    holding a ``block`` word (listings) are passed over.
    """
    asked = texts
    if gate:
        asked = asked.where(contains_any(F.col(text), gate))
    if block:
        asked = asked.where(~contains_any(F.col(text), block))
    found = longest_alias(asked, key, text, aliases.select("alias"))
    targets = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.min("target").alias("target"))
    return found.join(targets, "alias").select(key, "alias", "target")


# Question patterns whose two groups are names (Thai and Latin letters).
NAME_PATTERNS = {
    "nickname_first": r"(?i)^\s*([ก-๙a-z\-]{1,10})\s+([ก-๙a-z\-]{1,10})\s*(?:เบอร์|โทร|phone|number|ต่อ|ext)",
    "nickname_real_name": r"([ก-๙a-zA-Z\-]{1,10})\s+(?:ชื่อจริง|real name)\s+([ก-๙a-zA-Z]{2,15})",
    "nickname_branch": r"(?i)([ก-๙a-z\-]{1,10})\s+(?:สาขา|branch)\s*([ก-๙a-z ]*)",
    "surname": r"(?i)(นามสกุล|surname)\s+([ก-๙a-z]+)",
    "bare_nickname": r"(?i)(ใครคือ\s*|who(?:'s| is)\s+)([ก-๙a-z\-]{2,12})\s*$",
}


def pattern_keys(text: Column, pattern: str) -> tuple[Column, Column]:
    """Both upper-cased groups of a named pattern; null where it does not occur."""
    groups = [F.upper(F.trim(F.regexp_extract(text, NAME_PATTERNS[pattern], g))) for g in (1, 2)]
    return F.nullif(groups[0], F.lit("")), F.nullif(groups[1], F.lit(""))


def group_listing(df: DataFrame, key: str, member: str, prefix: Column) -> DataFrame:
    """One line per group naming its members in order, for small reference tables such as branches by region."""
    names = F.array_join(F.array_sort(F.collect_set(member)), ", ")
    return df.groupBy(key).agg(F.concat(F.first(prefix), names).alias("answer"))


# --- lookups: one row per key first ------------------------------------------------------------------------------


def key_index(people: DataFrame, key: Column, order: Sequence[str], also: Sequence[Column] = ()) -> DataFrame:
    """First person per non-blank key (and optional further key columns)."""
    keyed = people.withColumn("__key", key).where(F.trim("__key") != "")
    names = []
    for i, c in enumerate(also):
        keyed = keyed.withColumn(f"__also{i}", c)
        names.append(f"__also{i}")
    return first_per_key(keyed, ["__key", *names], order)


def preference(ext: Column, code: Column) -> Column:
    """Order of equally named people: with an extension and no secretary, with an extension, the rest."""
    has_ext = F.coalesce(F.trim(ext), F.lit("")) != ""
    secretary = F.endswith(code, F.lit("-SEC")) | F.endswith(code, F.lit("-EA"))
    return F.when(has_ext & ~secretary, 0).when(has_ext, 1).otherwise(2)


INDEX_ROWS = 50_000  # people whose names a task sorts at one time


def nickname_index(people: DataFrame, names: Sequence[str], dept: str, ext: str, code: Column, order: str) -> DataFrame:
    """Preferred person per (name or nickname, department), with all columns of ``people``, which should be few.

    People are written and dealt by ``order``, a nearly unique column, so that a task sorts about ``INDEX_ROWS`` of them before names combine.
    """
    spread = dealt(materialize(people, "people"), INDEX_ROWS, order)
    candidates = spread.withColumn("__p", preference(F.col(ext), code)).withColumn(
        "name_key", F.explode(F.array_distinct(F.array(*[F.upper(F.trim(F.col(n))) for n in names])))
    ).where(F.col("name_key") != "")
    return first_per_key(candidates.withColumn("dept_key", F.upper(dept)), ["name_key", "dept_key"], ["__p", order]).drop("__p")


# Fixed values: "name connector department" patterns, words that are no names, and Thai titles.
NICK_DEPT = (
    r"(?i)\b([a-z\-]{3,12})\s+(?:from|in|at|with|on the|working in|based in|working at)\s+([a-z]{2,12})\b"
)
NICK_DEPT_TH = (
    r"(?i)([ก-๙a-z\-]{2,12})\s+(?:ที่อยู่|ที่|อยู่|จาก|ทีม|สาย|ประจำ|สังกัด|แผนก|ฝ่าย|ใน)\s+([a-z]{2,12})\b"
)
NOT_NAMES = ["WHO", "MANY", "HOW", "THE", "AND", "FOR", "ALL"]
THAI_TITLES = ["คุณ", "พี่", "น้อง", "หัวหน้า", "ผู้จัดการ", "ดร.", "นาย", "นาง", "นางสาว"]


def nick_dept_keys(text: Column) -> tuple[Column, Column]:
    """(NAME, DEPARTMENT) of "name from department" questions, Thai connectors first; null where absent."""
    bare = text
    for title in THAI_TITLES:
        bare = F.replace(bare, F.lit(title), F.lit(" "))
    th = [F.nullif(F.upper(F.trim(F.regexp_extract(bare, NICK_DEPT_TH, g))), F.lit("")) for g in (1, 2)]
    en = [F.nullif(F.upper(F.trim(F.regexp_extract(bare, NICK_DEPT, g))), F.lit("")) for g in (1, 2)]
    ok = ~en[0].isin(NOT_NAMES)
    return F.coalesce(th[0], F.when(ok, en[0])), F.coalesce(th[1], F.when(ok, en[1]))


def unique_names(people: DataFrame, first: str, last: str, keep: Sequence[str]) -> DataFrame:
    """People whose full name occurs once."""
    rest = F.struct(*keep)
    grouped = people.groupBy(F.upper(first).alias("first_key"), F.upper(last).alias("last_key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(rest).alias("row")
    )
    return grouped.where(F.col("n") == 1).select("first_key", "last_key", "row.*")


def name_bigrams_of(text: Column) -> Column:
    """Adjacent word pairs of a text, as structs of two upper-case keys, in order; null for a text of one word."""
    tokens = F.split(F.upper(F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}\p{M} ]", " ")), r"\s+")
    pairs = F.transform(
        F.array(tokens),
        lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.struct(a.alias("first_key"), b.alias("last_key"))),
    )
    return F.when(F.size(tokens) > 1, F.get(pairs, F.lit(0)))


def name_bigrams(questions: DataFrame, qid: str, text: str) -> DataFrame:
    """Adjacent word pairs of each question with their position."""
    return questions.select(qid, F.posexplode(name_bigrams_of(F.col(text))).alias("pos", "p")).select(qid, "pos", "p.first_key", "p.last_key")


def unique_name_lookup(questions: DataFrame, qid: str, text: str, unique: DataFrame, keep: Sequence[str]) -> DataFrame:
    """First adjacent word pair of a question that is the full name of exactly one person."""
    hits = name_bigrams(questions, qid, text).join(unique, ["first_key", "last_key"])
    best = F.min_by(F.struct(*keep), "pos").alias("b")
    return hits.groupBy(qid).agg(best).select(qid, "b.*")


def either_order_lookup(pairs: DataFrame, qid: str, a: str, b: str, index: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Two tokens as (nickname, first name) or the reverse. ``index``: nick_key, name_key, kept columns."""
    orders = F.array(
        F.struct(F.lit(0).alias("o"), F.upper(a).alias("nick_key"), F.upper(b).alias("name_key")),
        F.struct(F.lit(1).alias("o"), F.upper(b).alias("nick_key"), F.upper(a).alias("name_key")),
    )
    tried = pairs.select(qid, F.explode(orders).alias("t")).select(qid, "t.*")
    hits = tried.join(index, ["nick_key", "name_key"])
    return hits.groupBy(qid).agg(F.min_by(F.struct(*keep), "o").alias("b")).select(qid, "b.*")


def nickname_members(people: DataFrame, nick_columns: Sequence[str], nickname: str, row_id: str) -> DataFrame:
    """People with a nickname in any of the columns, each once."""
    hit = F.lit(False)
    for c in nick_columns:
        hit = hit | (F.upper(F.trim(F.col(c))) == nickname.strip().upper())
    return people.where(hit).dropDuplicates([row_id])


def category_members(people: DataFrame, nick: str, members: Sequence[str]) -> DataFrame:
    return people.where(F.upper(nick).isin([m.upper() for m in members]))


def exact_then_contains(terms: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Per search term: people with exactly that value, else with a value that contains the term.

    ``terms`` has one column ``term``. Values are counted first; only the distinct values are cut into substrings,
    and only lengths that occur among the unmatched terms are produced.
    """
    counts = values.where(F.trim(value) != "").groupBy(F.upper(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    wanted = terms.select(F.upper("term").alias("term")).distinct()
    exact = wanted.join(counts, wanted["term"] == counts["v"]).select("term", F.lit("exact").alias("how"), "n")
    rest = wanted.join(exact.select("term"), "term", "left_anti")
    lengths = rest.agg(F.array_sort(F.collect_set(F.length("term"))).alias("ls")).scalar()
    starts = counts.select("v", "n", F.explode(F.coalesce(lengths, F.array().cast("array<int>"))).alias("len")).where(
        F.length("v") >= F.col("len")
    )
    pieces = starts.select(
        "v", "n",
        F.explode(
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(1), F.length("v") - F.col("len") + 1),
                    lambda i: F.substring(F.col("v"), i, F.col("len")),
                )
            )
        ).alias("term"),
    )
    contained = pieces.join(rest, "term").groupBy("term").agg(F.sum("n").alias("n"))
    return exact.unionByName(contained.select("term", F.lit("contains").alias("how"), "n"))


def subordinates(people: DataFrame, dept: str, level: str, levels: Sequence[str], row_id: str, n: int = 10) -> DataFrame:
    """For every person the first n others of the same department on the given levels.

    Each department keeps its first n + 1 candidates once; a person only filters themself out of that short list.
    """
    pool = people.where(F.col(level).isin(list(levels))).select(F.col(dept).alias("__d"), F.col(row_id).alias("__i"))
    short = top_per_key(pool, ["__d"], [F.asc("__i")], n + 1, out="__r")
    lists = short.groupBy("__d").agg(F.sort_array(F.collect_list("__i")).alias("__list"))
    joined = people.join(lists, people[dept] == lists["__d"], "left")
    others = F.slice(F.filter(F.coalesce("__list", F.array().cast("array<string>")), lambda x: x != F.col(row_id)), 1, n)
    return joined.select(row_id, dept, others.alias("reports"))


# --- answers -----------------------------------------------------------------------------------------------------


def full_name(first: str, last: str) -> Column:
    return F.trim(F.concat_ws(" ", F.trim(F.col(first)), F.trim(F.col(last))))


def identity_text(name: Column, nickname: Column, position: Column, lang: Column) -> Column:
    nick = F.nullif(F.trim(nickname), F.lit(""))
    tag = F.when(lang == "th", F.concat(F.lit(" ชื่อเล่น "), nick)).otherwise(
        F.concat(F.lit(" (nickname: "), nick, F.lit(")"))
    )
    return F.concat_ws(" | ", F.concat(name, F.coalesce(tag, F.lit(""))), F.nullif(F.trim(position), F.lit("")))


def contact_text(name: Column, ext: Column, email: Column, lang: Column) -> Column:
    number = F.nullif(F.trim(ext), F.lit(""))
    label = F.when(lang == "th", F.lit("ต่อ ")).otherwise(F.lit("ext "))
    return F.concat_ws(" | ", name, F.concat(label, number), F.nullif(F.trim(email), F.lit("")))


# Rows of a listing without a number in the question, and the largest number a question can name.
DEFAULT_LISTING = 30
LARGEST_LISTING = 99


def numbered_list(df: DataFrame, keys: Sequence[str], line: str, order: str, limit: int, out: str = "listing") -> DataFrame:
    """``1. ...`` lines of the first ``limit`` rows per key."""
    return numbered_lines(df, keys, line, order, limit).select(*keys, F.array_join("lines", "\n").alias(out))


def numbered_lines(df: DataFrame, keys: Sequence[str], line: str, order: str, limit: int) -> DataFrame:
    """``lines``, the first ``limit`` numbered rows of each key as an array, so that every question can take as many as it asks for."""
    head = top_per_key(df, keys, [F.asc(order)], limit, out="__r")
    rows = F.sort_array(F.collect_list(F.struct("__r", F.col(line).alias("t"))))
    lines = F.transform(rows, lambda r: F.concat(r["__r"].cast("string"), F.lit(". "), r["t"]))
    return head.groupBy(*keys).agg(lines.alias("lines"))


def limited_listing(lines: Column, limit: Column, total: Column) -> Column:
    """The lines asked for (30 when no number is named), and how many of how many when some are left out."""
    wanted = F.coalesce(limit, F.lit(DEFAULT_LISTING))
    shown = F.array_join(F.slice(lines, F.lit(1), wanted), "\n")
    return F.when(wanted < total, F.concat(shown, F.lit("\n("), wanted.cast("string"), F.lit(" of "), total.cast("string"), F.lit(")"))).otherwise(shown)


def canonical_nickname(answer: Column, lang: Column) -> Column:
    """Short paraphrases of a blank nickname become the canonical phrase."""
    out = answer
    for code, wordings in BLANK_NICKNAME_WORDINGS.items():
        hit = (lang == code) & (F.length(answer) < 60) & contains_any(answer, wordings)
        out = F.when(hit, F.lit(PHRASES["nickname_blank"][code])).otherwise(out)
    return out


def compliance(answer: Column, lang: Column, is_refusal: Column) -> Column:
    return canonical_nickname(mask_private(answer, is_refusal), lang)


def cascade(questions: DataFrame, qid: str, rules: Sequence[DataFrame], fallback: Column) -> DataFrame:
    """Lowest priority number wins. Each rule is (qid, priority, answer); questions without one take the fallback."""
    union = None
    for r in rules:
        part = r.select(qid, F.col("priority").cast("int"), "answer")
        union = part if union is None else union.unionByName(part)
    best = union.groupBy(qid).agg(
        F.min("priority").alias("rule"), F.min_by("answer", F.struct("priority", "answer")).alias("answer")
    )
    joined = questions.join(best, qid, "left")
    return joined.withColumn("answer", F.coalesce("answer", fallback)).withColumn("rule", F.coalesce("rule", F.lit(99)))


def hints(questions: DataFrame, qid: str, text: str, rules: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Hint lines of a question: every rule whose trigger words occur adds its text, in rule order."""
    parts = [F.when(contains_any(F.col(text), words), F.lit(hint)) for words, hint in rules.values()]
    return questions.select(qid, F.concat_ws("\n", *parts).alias("hint"))
