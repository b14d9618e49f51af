"""The question cascade over a directory: 31 rules in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import cascade as ca, directory as di
from tidemark.operators.distributed import dealt, materialize
from tidemark.plans.people import COMPANY, SQL_IS_COUNT, SQL_IS_LIST, sql_any, sql_asked, sql_phrase, sql_policy, sql_unwrap
from tidemark.plans.registry import Tables, query
from tidemark.plans.views import PEOPLE_SQL, people

MOST = 99  # the largest number that a question can name
PEOPLE_AT_ONCE = 25_000  # people whose entries one task makes and sorts

# Patterns of the rules. Names are Thai or Latin letters.
EXT = r"\b(\d{5})\b"
MOBILE = r"0\d{2}[- ]?\d{3}[- ]?\d{4}"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
ROLE_NICKNAME = r"(?i)(?:ชื่อเล่น|nickname)\s+([a-z]{2,6})\b"
TWO_NAMES = r"(?i)^([ก-๙a-z\-]+)\s+([ก-๙a-z\-]+)\s*(?:เบอร์|โทร|phone|number|ต่อ|ext)"
REAL_NAME = r"(?i)([ก-๙a-z\-]+)\s+(?:ชื่อจริง|real name)\s+([ก-๙a-z]{2,})"
NAME_BRANCH = r"(?i)([ก-๙a-z\-]+)\s+(?:สาขา|branch)"
WHO_IS = r"(?i)(?:ใครคือ\s*|who(?:'s| is)\s+)([ก-๙a-z\-]{2,})\s*$"
IS_WHO = r"(?i)^([ก-๙a-z\-]{2,})\s*คือใคร$"
NAME_AT = r"(?i)([ก-๙a-z\-]+)\s+(?:ที่อยู่|อยู่ใน|อยู่|จาก|from|in)\s+([a-z]{2,})\s*(?:คือใคร|คือ|ใคร|who)?"
GRID = r"(?i)^([ก-๙a-z\-]+)\s*(?:คือใคร|มีใครบ้าง|มีใคร|มีกี่คน|ใครบ้าง|who(?:\s+is)?)"
GRID_AFTER = r"(?i)(?:ชื่อเล่น|nickname)[^ก-๙a-z]*([ก-๙a-z\-]+)"
SURNAME = r"(?i)(?:นามสกุล|surname)\s+([ก-๙a-z]+)"
COUNT_NAMED = r"(?i)(?:นับคนชื่อ|กี่คนชื่อ|count(?: employees)? named|how many(?: employees)? (?:named|called))\s*([ก-๙a-z\-]{2,})"
NAMED = r"(?i)(?:ใครชื่อ|คนชื่อ|รายชื่อคนชื่อ|who(?:'s| is) named|employees? named?)\s*([ก-๙a-z]{2,})"
CODE = r"\b([A-Z0-9][A-Z0-9\-]{2,15})\b"
LIMIT = r"\b([1-9][0-9]?)\b"

# Words of the rules.
SAME_TEAM = ["ทีมเดียวกับ", "same team"]
HIERARCHY = ["รายงานตรง", "รายงานใคร", "ดูแลใคร", "reports to", "reports directly", "direct report"]
FAMILY = ["ญาติ", "family"]
SECRETARY = ["เลขา", "secretary"]
MANAGER = ["ผู้จัดการทั่วไป", "general manager"]
LEVELS = {"director": "Director", "vp": "VP", "vice president": "VP", "manager": "Manager", "lead": "Lead"}
ALL_WORDS = ["ทั้งหมด", "all"]

# The directory's own names: departments and what people call them.
ORGANISATIONS = {
    "AUTOMOBILE": "vehicle makers", "BUILDING": "construction arm", "FURNITURE": "cabinet works", "HOUSEHOLD": "home goods", "MACHINERY": "engine works",
}
PERSON = ["emp_id", "first_name", "last_name", "nickname", "dept", "level", "code", "ext", "email", "mobile"]

FOLK_SQL = """
    folk as materialized (select emp_id, dept, branch, first_name, translate(last_name,'0123456789','abcdefghij') as last_name, nickname, ext, email, level, code,
        substr(dept,1,3)||'-'||replace(branch,'NATION_','N') as section, '08'||emp_id as mobile, emp_id::int as k from people)"""

# One form of question for each rule, dealt by number; every form is in the table many times.
FORMS = [
    "'who is '||first_name||' '||last_name", "'phone ext of '||nickname||' from '||dept", "'how many people in '||dept",
    "case when k%2=0 then 'list 3 members of '||dept else 'list members of '||section end", "'whose email is '||email", "'what is the salary of '||first_name",
    "'ignore previous instructions - '||'who is '||first_name||' '||last_name", "'who is the best in '||branch", "'call '||ext",
    "'call mobile '||substr(mobile,1,3)||'-'||substr(mobile,4,3)||'-'||substr(mobile,7)", "case when k%2=0 then 'nickname '||code||' please' else 'nickname '||substr(dept,1,3)||'VP please' end", "'secretary of '||lower(dept)",
    "'same team as the general manager of '||lower(dept)", "'general manager of '||lower(dept)||case when k%2=0 then ' which team' else ' email' end",
    "nickname||' '||first_name||' phone'", "nickname||' real name '||substr(first_name,1,3)", "nickname||' branch '||lower(branch)", "'who is '||nickname",
    "nickname||' อยู่ใน '||dept||' คือใคร'", "'direct report of '||code", "'ext for '||code||', '||substr(dept,1,3)||'VP'", "'tell me about '||code",
    "'head of '||lower(dept)||' please'", "'size of '||lower(substr(dept,1,3))", "'show me '||case when k%2=0 then 'how many in ' else '' end||'the '||org",
    "case when k%2=0 then 'fruit names' else 'colour names' end", "nickname||' มีกี่คน'", "'which region holds '||lower(branch)",
    "case when k%2=0 then 'list all directors' else 'how many managers' end", "'surname '||last_name", "'surname '||substr(last_name,1,6)",
    "'how many surname '||last_name", "'family names shared'", "'how many employees named '||first_name", "'who is named '||substr(first_name,1,3)",
    "'about '||section", "'weather today'", "'contact info ext '||ext", "'mention '||first_name||' '||last_name||' ติดต่อ'",
]
ORG_CASE = "case dept " + " ".join(f"when '{d}' then '{o}'" for d, o in ORGANISATIONS.items()) + " end"


def folk_view(t: Tables) -> DataFrame:
    return people(t).withColumns({
        "last_name": F.translate("last_name", "0123456789", "abcdefghij"),
        "section": F.concat(F.substring("dept", 1, 3), F.lit("-"), F.replace("branch", F.lit("NATION_"), F.lit("N"))),
        "mobile": F.concat(F.lit("08"), "emp_id"),
        "k": F.col("emp_id").cast("int"),
    })


def questions(folk: DataFrame) -> DataFrame:
    """One question a person, in the form that the number chooses."""
    org = F.create_map(*[F.lit(x) for pair in ORGANISATIONS.items() for x in pair])
    rows = folk.withColumn("org", org[F.col("dept")])
    n = len(FORMS)
    text = F.lit(None).cast("string")
    for i, form in enumerate(FORMS):
        text = F.when(F.col("k") % n == i, F.expr(form)).otherwise(text)
    return rows.select(F.col("emp_id").alias("qid"), F.when(F.col("k") % 5 == 0, "th").otherwise("en").alias("lang"), text.alias("text"))


def entries(folk: DataFrame) -> DataFrame:
    """(kind, key, preference, line, person columns): every key under which a person can be found."""
    up = lambda c: F.upper(F.trim(F.col(c)))
    names = F.filter(F.array_distinct(F.array(up("nickname"), up("first_name"))), lambda x: x != "")
    preference = di.preference(F.col("ext"), F.col("code"))
    key = lambda kind, k, p=None: F.struct(F.lit(kind).alias("kind"), k.alias("key"), (F.lit(0) if p is None else p).alias("preference"))
    bar = F.lit("|")
    top = F.col("level").isin("VP", "Director")
    colours = [w.upper() for w in di.NICKNAME_SETS["colour"]]
    fruits = [w.upper() for w in di.NICKNAME_SETS["fruit"]]
    single = F.array(
        key("ext", F.col("ext")), key("mobile", F.col("mobile")), key("email", F.lower("email")), key("unit", F.col("code")), key("dept", F.col("dept")),
        key("section", F.col("section")), key("full", F.concat_ws(" ", up("first_name"), up("last_name"))), key("first", up("first_name")),
        key("surname", up("last_name")), key("level", F.col("level")), key("nick", up("nickname")),
        key("nick_first", F.when(up("nickname") != "", F.concat(up("nickname"), bar, up("first_name")))),
        key("team", F.when(F.col("level") == "VP", F.col("dept"))),
        key("reports", F.when(top, F.concat("dept", bar))),
        key("reports", F.when(top, F.concat(F.col("dept"), bar, F.when(F.col("level") == "VP", "Director").otherwise("VP")))),
        key("set", F.when(up("nickname").isin(colours), F.lit("colour"))), key("set", F.when(up("nickname").isin(fruits), F.lit("fruit"))),
    )
    several = F.flatten(F.transform(names, lambda x: F.array(
        key("nick_dept", F.concat(x, bar, F.col("dept")), preference), key("nick_branch", F.concat(x, bar, F.lower("branch"))), key("name", x),
    )))
    line = di.full_name("first_name", "last_name").alias("line")
    return folk.select(F.explode(F.concat(single, several)).alias("e"), line, *PERSON).select("e.*", "line", *PERSON)


def aliases(t: Tables, folk: DataFrame) -> DataFrame:
    depts = folk.select("dept").distinct()
    low, short = F.lower("dept"), F.substring("dept", 1, 3)
    org = F.create_map(*[F.lit(x) for pair in ORGANISATIONS.items() for x in pair])
    row = lambda kind, alias, target: F.struct(F.lit(kind).alias("kind"), alias.alias("alias"), target.alias("target"))
    each = F.array(
        row("secretary_unit", F.concat(F.lit("secretary of "), low), F.concat(short, F.lit("-SEC"))),
        row("manager_unit", F.concat(F.lit("general manager of "), low), F.concat(short, F.lit("MGR"))),
        row("described_unit", F.concat(F.lit("head of "), low), F.concat(short, F.lit("VP"))),
        row("org_dept", F.coalesce(org[F.col("dept")], F.lit("")), F.col("dept")),
    )
    named = depts.select(F.explode(each).alias("a")).select("a.*")
    branches = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    geo = branches.select(F.lit("geo").alias("kind"), F.lower("n_name").alias("alias"), F.concat("n_name", F.lit(" is a branch in "), "r_name").alias("target"))
    branch = branches.select(F.lit("branch"), F.lower("n_name"), F.lower("n_name"))
    return named.unionByName(geo).union(branch)


def group(text: Column, pattern: str, g: int = 1) -> Column:
    return F.nullif(F.upper(F.trim(F.regexp_extract(text, pattern, g))), F.lit(""))


def analysed(q: DataFrame) -> DataFrame:
    """Every key and flag of a question, worked out once."""
    text, low = F.col("text"), F.lower("text")
    name_key, dept_key = di.nick_dept_keys(text)
    level = F.lit(None).cast("string")
    for word, name in reversed(LEVELS.items()):
        level = F.when(low.contains(word), name).otherwise(level)
    short = F.upper(F.regexp_extract(low, r"\b(" + "|".join(d[:3].lower() for d in ORGANISATIONS) + r")\b", 1))
    return q.select(
        "qid", "lang", "text", di.policy_class(text).alias("cls"), di.asked_type(text).alias("asked"), *di.intent_flags(text),
        F.nullif(F.regexp_extract(text, EXT, 1), F.lit("")).alias("ext_key"),
        F.nullif(F.regexp_replace(F.regexp_extract(text, MOBILE, 0), "[^0-9]", ""), F.lit("")).alias("mobile_key"),
        F.nullif(F.lower(F.regexp_extract(text, EMAIL, 0)), F.lit("")).alias("email_key"),
        F.concat_ws("|", name_key, dept_key).alias("nick_dept_key"), name_key.isNotNull().alias("asks_nick_dept"),
        group(text, ROLE_NICKNAME).alias("role_key"),
        F.concat(group(text, TWO_NAMES, 1), F.lit("|"), group(text, TWO_NAMES, 2)).alias("two_a"),
        F.concat(group(text, TWO_NAMES, 2), F.lit("|"), group(text, TWO_NAMES, 1)).alias("two_b"),
        F.concat(group(text, REAL_NAME, 1), F.lit("|"), group(text, REAL_NAME, 2)).alias("real_key"),
        group(text, NAME_BRANCH).alias("at_branch"),
        F.coalesce(group(text, WHO_IS), group(text, IS_WHO)).alias("who_key"),
        F.concat(group(text, NAME_AT, 1), F.lit("|"), group(text, NAME_AT, 2)).alias("at_key"),
        F.coalesce(group(text, GRID), group(text, GRID_AFTER)).alias("grid_key"),
        group(text, SURNAME).alias("surname_key"), group(text, COUNT_NAMED).alias("counted_key"), group(text, NAMED).alias("named_key"),
        di.contains_any(text, SAME_TEAM).alias("same_team"), di.contains_any(text, HIERARCHY).alias("hierarchy"), di.contains_any(text, FAMILY).alias("family"),
        di.contains_any(text, SECRETARY).alias("secretary"), di.contains_any(text, MANAGER).alias("manager"),
        F.when(low.contains("fruit") | low.contains("ผลไม้"), "fruit").when(low.contains("colour") | low.contains("color") | low.contains("ชื่อสี"), "colour").alias("set_key"),
        F.when(F.col("is_list") | F.col("is_count") | di.contains_any(text, ALL_WORDS), level).alias("level_key"),
        short.alias("short_dept"),
        F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(CODE), 1)).alias("codes"),
        F.array_distinct(F.transform(di.name_bigrams_of(text), lambda b: F.concat_ws(" ", b["first_key"], b["last_key"]))).alias("bigrams"),
    )


def person_name(p: Column) -> Column:
    return F.concat_ws(" ", p["first_name"], p["last_name"])


def labelled(value: Column, lang: Column, th: str, en: str) -> Column:
    return F.concat(F.when(lang == "th", F.lit(th)).otherwise(F.lit(en)), F.nullif(value, F.lit("")))


def contact(p: Column, lang: Column) -> Column:
    parts = [labelled(p["ext"], lang, "ต่อ ", "ext "), labelled(p["mobile"], lang, "มือถือ ", "mobile "), F.nullif(p["email"], F.lit(""))]
    return F.when(p.isNotNull(), F.concat_ws(" | ", person_name(p), *parts))


def identity(p: Column, lang: Column) -> Column:
    return F.when(p.isNotNull(), di.identity_text(person_name(p), p["nickname"], F.concat_ws(" ", p["level"], p["dept"]), lang))


def smart(p: Column, lang: Column, asked: Column) -> Column:
    """What is told of a person, by what was asked: numbers, mail address, team, or who it is."""
    mail = F.concat_ws(" | ", person_name(p), F.nullif(p["email"], F.lit("")))
    team = F.concat_ws(" | ", person_name(p), F.concat_ws(" ", p["level"], p["dept"]))
    told = F.when(asked.isin("contact", "phone"), contact(p, lang)).when(asked == "email", mail).when(asked == "team", team).otherwise(identity(p, lang))
    return F.when(p.isNotNull(), told)


def how_many(found: Column, name: Column, lang: Column) -> Column:
    th = F.concat(F.lit("แผนก "), name, F.lit(" มี "), found["n"].cast("string"), F.lit(" คน"))
    return F.when(found.isNotNull(), F.when(lang == "th", th).otherwise(F.concat(name, F.lit(" has "), found["n"].cast("string"), F.lit(" employees"))))


def keyed(q: DataFrame, index: DataFrame) -> DataFrame:
    """The questions with the groups of all keys that they hold themselves."""
    c = F.col
    short = F.create_map(*[F.lit(x) for d in ORGANISATIONS for x in (d[:3], d)])
    single = {
        "role": ("unit", c("role_key")), "by_secretary": ("unit", F.when(c("secretary"), c("secretary_unit"))), "by_manager": ("unit", F.when(c("manager"), c("manager_unit"))),
        "described": ("unit", c("described_unit")), "by_ext": ("ext", c("ext_key")), "by_mobile": ("mobile", c("mobile_key")), "by_email": ("email", c("email_key")),
        "by_nick_dept": ("nick_dept", F.when(c("asks_nick_dept"), c("nick_dept_key"))), "by_two_a": ("nick_first", c("two_a")), "by_two_b": ("nick_first", c("two_b")),
        "by_branch": ("nick_branch", F.concat(c("at_branch"), F.lit("|"), c("branch"))), "by_who": ("nick", c("who_key")), "by_at": ("nick_dept", c("at_key")),
        "org": ("dept", c("org_dept")), "set": ("set", c("set_key")), "grid": ("nick", c("grid_key")), "by_level": ("level", c("level_key")),
        "by_surname": ("surname", c("surname_key")), "counted": ("name", c("counted_key")), "short": ("dept", F.try_element_at(short, c("short_dept"))),
    }
    several = {"named_codes": (["unit", "dept", "section"], c("codes")), "full_names": (["full"], c("bigrams"))}
    q = ca.look_up(q, "qid", index, single, several)
    units = F.filter("named_codes", lambda x: x["kind"] == "unit")
    rank = lambda x: F.when(x["kind"] == "section", F.when(x["key"].contains("-"), 1).otherwise(2)).otherwise(3)
    places = F.transform(F.filter("named_codes", lambda x: x["kind"] != "unit"), lambda x, i: F.struct(rank(x).alias("rank"), i.alias("i"), x.alias("x")))
    only = F.get(F.filter("full_names", lambda x: x["n"] == 1), F.lit(0))
    return q.withColumns({"units": units, "unit": F.get(units, F.lit(0)), "place": F.array_min(places)["x"], "full": only}).drop("named_codes", "full_names")


def followed(q: DataFrame, index: DataFrame) -> DataFrame:
    """The same with the groups that follow from groups: the team or reports of a person found, and people by fragments of their names.

    Surnames are looked for inside values only where no surname is equal, and never for counts.
    """
    c = F.col
    target = F.coalesce(c("unit.person"), c("described.person"))
    shown = F.when(target["level"].isin("VP", "Director"), target["level"]).otherwise("")
    part = F.when(c("by_surname").isNull() & ~c("is_count"), c("surname_key"))
    single = {
        "team": ("team", F.when(c("same_team"), c("by_manager.person.dept"))),
        "reports": ("reports", F.when(c("hierarchy"), F.concat(target["dept"], F.lit("|"), shown))),
        "real": ("nick_first~", c("real_key")), "surname_part": ("surname~", part), "named": ("first~", c("named_key")),
    }
    fragments = [ca.fragment_index(q.select(single[out][1].alias("term")), index, kind, scope, MOST)
                 for out, kind, scope in (("real", "nick_first", True), ("surname_part", "surname", False), ("named", "first", False))]
    wider = index.where(F.col("kind").isin("team", "reports"))
    for f in fragments:
        wider = wider.unionByName(f)
    return ca.look_up(q, "qid", wider, single)


def rules(common: Column) -> dict[int, Column]:
    """The answers of the rules, in order, over the looked-up groups."""
    c, lang, asked = F.col, F.col("lang"), F.col("asked")
    limit = lambda default: F.coalesce(c("list_limit"), F.lit(default))
    group_or_person = lambda f: F.when(f["n"] == 1, identity(f["person"], lang)).when(f.isNotNull(), ca.listing(f, limit(30)))
    blank = lambda p: F.trim(p["nickname"]) == ""
    refused = lambda cls: di.phrase(cls, lang, COMPANY)
    missing = refused(F.lit("person_not_found"))
    unit_lines = F.transform("units", lambda u: F.concat(
        u["key"], F.lit(" — "), person_name(u["person"]), F.lit(": "), F.when(lang == "th", "ต่อ ").otherwise("ext "), u["person"]["ext"],
        F.when(lang == "th", " / มือถือ ").otherwise(" / mobile "), u["person"]["mobile"]))
    nickname_of = F.when(lang == "th", F.concat(F.lit("ชื่อเล่นของ "), person_name(c("role.person")), F.lit(" คือ "), c("role.person.nickname"))).otherwise(
        F.concat(F.lit("The nickname of "), person_name(c("role.person")), F.lit(" is "), c("role.person.nickname")))
    number = lambda f: F.coalesce(f["n"], F.lit(0)).cast("string")
    said = lambda th1, th2, en1, en2, f: F.when(lang == "th", F.concat(F.lit(th1), number(f), F.lit(th2))).otherwise(F.concat(F.lit(en1), number(f), F.lit(en2)))
    surname = F.when(c("is_count"), said("มีพนักงานนามสกุลนี้ ", " คน", "There are ", " employees with that surname", c("by_surname"))).otherwise(
        F.coalesce(ca.listing(c("by_surname"), limit(30)), ca.listing(c("surname_part"), limit(30))))
    place_listing = c("is_list") | c("is_count")
    counted_or_listed = F.when(c("is_count"), how_many(c("place"), c("place.key"), lang)).otherwise(ca.listing(c("place"), limit(30)))
    return {
        1: refused(c("cls")),
        2: F.when(c("role").isNotNull() & blank(c("role.person")), refused(F.lit("nickname_blank"))),
        3: F.when(c("same_team"), ca.listing(c("team"), limit(30))),
        4: smart(c("by_secretary.person"), lang, asked),
        5: smart(c("by_manager.person"), lang, asked),
        6: contact(c("by_ext.person"), lang),
        7: contact(c("by_mobile.person"), lang),
        8: contact(c("by_email.person"), lang),
        9: F.when(place_listing & c("place").isNotNull(), counted_or_listed),
        10: F.when(c("asks_nick_dept"), F.coalesce(smart(c("by_nick_dept.person"), lang, asked), missing)),
        11: smart(c("full.person"), lang, asked),
        12: F.when(c("role").isNotNull(), nickname_of),
        13: smart(F.coalesce(c("by_two_a.person"), c("by_two_b.person")), lang, asked),
        14: smart(c("real.person"), lang, asked),
        15: smart(c("by_branch.person"), lang, asked),
        16: F.when(~c("need_ext"), F.when(c("by_who.n") == 1, identity(c("by_who.person"), lang)).otherwise(ca.listing(c("by_who"), limit(10)))),
        17: F.when(~c("need_ext"), identity(c("by_at.person"), lang)),
        18: F.when(c("hierarchy"), ca.listing(c("reports"), F.lit(10))),
        19: F.when((F.size("units") >= 2) & c("need_ext"), F.array_join(unit_lines, "\n")),
        20: F.when(~c("is_count"), group_or_person(c("unit"))),
        21: group_or_person(c("described")),
        22: F.when(c("is_count"), how_many(c("short"), c("short.person.dept"), lang)),
        23: F.when(c("is_count"), how_many(c("org"), c("org_dept"), lang)).otherwise(ca.listing(c("org"), limit(15))),
        24: ca.listing(c("set"), F.lit(25)),
        25: F.when(c("grid_key").isNotNull(), F.when(c("is_count"), said("มีชื่อเล่นนี้ทั้งหมด ", " คน", "There are ", " employees with that nickname", c("grid"))).otherwise(
            F.coalesce(ca.listing(c("grid"), limit(30)), missing))),
        26: c("geo"),
        27: F.when(c("by_level").isNotNull(), F.when(c("is_count"), said("มีทั้งหมด ", " คน", "There are ", " of that level", c("by_level"))).otherwise(
            ca.listing(c("by_level"), F.lit(40)))),
        28: F.when(c("surname_key").isNotNull(), surname),
        29: F.when(c("family"), F.concat(F.when(lang == "th", "ตัวอย่างนามสกุลที่พบหลายคน: ").otherwise("Surnames that several people share: "), common)),
        30: F.when(c("counted_key").isNotNull(), said("มีทั้งหมด ", " คน", "There are ", " employees", c("counted"))),
        31: ca.listing(c("named"), limit(20)),
        32: ca.listing(c("place"), limit(20)),
    }


def shared_surnames(index: DataFrame, n: int = 5) -> Column:
    """The n surnames of most people (at least two), the smaller name first on ties."""
    most = index.where("kind = 'surname' and n >= 2").orderBy(F.desc("n"), "key").limit(n)
    return most.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))), lambda x: x["key"]), ", ")).scalar()


def sql_person(p: str) -> dict[str, str]:
    """How a person (alias ``p``) is told of, in SQL."""
    name = f"{p}.first_name||' '||{p}.last_name"
    number = lambda c, th, en: f"case when {p}.{c}<>'' then ' | '||case when lang='th' then '{th} ' else '{en} ' end||{p}.{c} else '' end"
    nick = f"case when {p}.nickname<>'' then case when lang='th' then ' ชื่อเล่น '||{p}.nickname else ' (nickname: '||{p}.nickname||')' end else '' end"
    told = {
        "name": name,
        "contact": f"({name}||{number('ext', 'ต่อ', 'ext')}||{number('mobile', 'มือถือ', 'mobile')}||' | '||{p}.email)",
        "identity": f"({name}||{nick}||' | '||{p}.level||' '||{p}.dept)",
    }
    told["smart"] = (
        f"case when asked in ('contact','phone') then {told['contact']} when asked='email' then {name}||' | '||{p}.email "
        f"when asked='team' then {name}||' | '||{p}.level||' '||{p}.dept else {told['identity']} end"
    )
    return told


def sql_listing(a: str, limit: str) -> str:
    rows = f"array_to_string(list_transform(range(1, least({limit}, len({a}.lines))+1), lambda i: i||'. '||{a}.lines[i]), chr(10))"
    return f"case when {a}.n is not null then {rows}||case when {limit}<{a}.n then chr(10)||'('||{limit}||' of '||{a}.n||')' else '' end end"


def route_sql() -> str:
    n = len(FORMS)
    form = "case k%" + str(n) + " " + " ".join(f"when {i} then {f}" for i, f in enumerate(FORMS)) + " end"
    ex = lambda pattern, g=1: f"nullif(upper(trim(regexp_extract(text, '{pattern.replace(chr(39), chr(39) * 2)}', {g}))), '')"
    colours, fruits = (", ".join(f"'{w.upper()}'" for w in di.NICKNAME_SETS[k]) for k in ("colour", "fruit"))
    level = "case " + " ".join(f"when contains(low,'{w}') then '{name}'" for w, name in LEVELS.items()) + " end"
    shorts = "|".join(d[:3].lower() for d in ORGANISATIONS)
    short_case = "case upper(regexp_extract(low, '\\b(" + shorts + ")\\b', 1)) " + " ".join(f"when '{d[:3]}' then '{d}'" for d in ORGANISATIONS) + " end"
    entry = lambda kind, key, where="true", pref="0": f"select '{kind}' as kind, {key} as key, {pref} as pref, * from folk where {where}"
    names = "(select *, unnest(list_distinct([upper(nickname), upper(first_name)])) as nm from folk)"
    several = lambda kind, key, pref="0": f"select '{kind}', {key}, {pref}, * exclude (nm) from {names} where nm<>''"
    prefer = "case when ext<>'' and not code like '%-SEC' then 0 when ext<>'' then 1 else 2 end"
    union = " union all ".join([
        entry("ext", "ext"), entry("mobile", "mobile"), entry("email", "lower(email)"), entry("unit", "code"), entry("dept", "dept"), entry("section", "section"),
        entry("full", "upper(first_name)||' '||upper(last_name)"), entry("first", "upper(first_name)"), entry("surname", "upper(last_name)"), entry("level", "level"),
        entry("nick", "upper(nickname)"), entry("nick_first", "upper(nickname)||'|'||upper(first_name)", "nickname<>''"), entry("team", "dept", "level='VP'"),
        entry("reports", "dept||'|'", "level in ('VP','Director')"),
        entry("reports", "dept||'|'||case level when 'VP' then 'Director' else 'VP' end", "level in ('VP','Director')"),
        entry("set", "'colour'", f"upper(nickname) in ({colours})"), entry("set", "'fruit'", f"upper(nickname) in ({fruits})"),
        several("nick_dept", "nm||'|'||dept", prefer), several("nick_branch", "nm||'|'||lower(branch)"), several("name", "nm"),
    ])
    orgs = ", ".join(f"('{d}', '{o}')" for d, o in ORGANISATIONS.items())
    alias = f"""
        select 'secretary_unit' as kind, 'secretary of '||lower(dept) as alias, substr(dept,1,3)||'-SEC' as target from ds
        union all select 'manager_unit', 'general manager of '||lower(dept), substr(dept,1,3)||'MGR' from ds
        union all select 'described_unit', 'head of '||lower(dept), substr(dept,1,3)||'VP' from ds
        union all select 'org_dept', o, d from (values {orgs}) as v(d, o) where d in (select dept from ds)
        union all select 'geo', lower(n_name), n_name||' is a branch in '||r_name from nation join region on r_regionkey=n_regionkey
        union all select 'branch', lower(n_name), lower(n_name) from nation join region on r_regionkey=n_regionkey"""
    kinds = ["secretary_unit", "manager_unit", "described_unit", "org_dept", "geo", "branch"]
    best = ", ".join(f"max(target) filter (where kind='{k}' and r=1) as {k}" for k in kinds)
    looked = {
        "role": ("unit", "role_key"), "by_secretary": ("unit", "case when secretary then secretary_unit end"), "by_manager": ("unit", "case when manager then manager_unit end"),
        "described": ("unit", "described_unit"), "by_ext": ("ext", "ext_key"), "by_mobile": ("mobile", "mobile_key"), "by_email": ("email", "email_key"),
        "by_nick_dept": ("nick_dept", "name_key||'|'||dept_key"), "by_two_a": ("nick_first", "two_1||'|'||two_2"), "by_two_b": ("nick_first", "two_2||'|'||two_1"),
        "by_branch": ("nick_branch", "at_branch||'|'||branch_key"), "by_who": ("nick", "who_key"), "by_at": ("nick_dept", "at_1||'|'||at_2"), "org": ("dept", "org_dept"),
        "sets": ("set", "set_key"), "grid": ("nick", "grid_key"), "by_level": ("level", "level_key"), "by_surname": ("surname", "surname_key"), "counted": ("name", "counted_key"),
        "unit": ("unit", "unit_key"), "place": ("", ""), "short": ("dept", "short_dept"), "fullname": ("full", "full_key"),
    }
    joins = ""
    for a, (kind, key) in looked.items():
        test = "place.kind=place_kind and place.key=place_key" if a == "place" else f"{a}.kind='{kind}' and {a}.key={key}"
        joins += f" left join ix {a} on {test} left join folk p_{a} on p_{a}.emp_id={a}.fid"
    told = {a: sql_person(f"p_{a}") for a in looked}
    listed = lambda a, limit: sql_listing(a, f"coalesce(list_limit, {limit})")
    fixed = lambda a, limit: sql_listing(a, str(limit))
    smart = lambda a: f"case when {a}.n is not null then {told[a]['smart']} end"
    contact = lambda a: f"case when {a}.n is not null then {told[a]['contact']} end"
    group_or_person = lambda a: f"case when {a}.n=1 then {told[a]['identity']} else {listed(a, 30)} end"
    number = lambda a, th1, th2, en1, en2: f"case when lang='th' then '{th1}'||coalesce({a}.n,0)||'{th2}' else '{en1}'||coalesce({a}.n,0)||'{en2}' end"
    many = lambda a, name: f"case when {a}.n is not null then case when lang='th' then 'แผนก '||{name}||' มี '||{a}.n||' คน' else {name}||' has '||{a}.n||' employees' end end"
    missing = sql_phrase("'person_not_found'")
    fragment = lambda kind, key, scope="": f"""
        (select q.qid, count(*) as n, list(e.line order by e.emp_id)[1:{MOST}] as lines, min(e.emp_id) as fid
          from keyed q join en e on e.kind='{kind}' and contains(split_part(e.key,'|',{2 if scope else 1}), {key}) {scope} group by 1)"""  # noqa: E731
    answers = {
        1: sql_phrase("cls"), 2: f"case when role.n is not null and p_role.nickname='' then {sql_phrase(chr(39) + 'nickname_blank' + chr(39))} end",
        3: f"case when same_team then {listed('team', 30)} end", 4: smart("by_secretary"), 5: smart("by_manager"), 6: contact("by_ext"), 7: contact("by_mobile"),
        8: contact("by_email"), 9: f"case when (is_list or is_count) and place.n is not null then case when is_count then {many('place', 'place.key')} else {listed('place', 30)} end end",
        10: f"case when name_key is not null then coalesce({smart('by_nick_dept')}, {missing}) end", 11: smart("fullname"),
        12: "case when role.n is not null then case when lang='th' then 'ชื่อเล่นของ '||{0}||' คือ '||p_role.nickname else 'The nickname of '||{0}||' is '||p_role.nickname end end".format(
            told["role"]["name"]),
        13: f"coalesce({smart('by_two_a')}, {smart('by_two_b')})", 14: f"case when real.n is not null then {sql_person('p_real')['smart']} end", 15: smart("by_branch"),
        16: f"case when not need_ext then case when by_who.n=1 then {told['by_who']['identity']} else {listed('by_who', 10)} end end",
        17: f"case when not need_ext and by_at.n is not null then {told['by_at']['identity']} end", 18: f"case when hierarchy then {fixed('reports', 10)} end",
        19: "case when n_units>=2 and need_ext then unit_lines end", 20: f"case when not is_count then {group_or_person('unit')} end", 21: group_or_person("described"),
        22: f"case when is_count then {many('short', 'short_dept')} end", 23: f"case when is_count then {many('org', 'org_dept')} else {listed('org', 15)} end",
        24: fixed("sets", 25),
        25: f"case when grid_key is not null then case when is_count then {number('grid', 'มีชื่อเล่นนี้ทั้งหมด ', ' คน', 'There are ', ' employees with that nickname')} "
            f"else coalesce({listed('grid', 30)}, {missing}) end end",
        26: "geo",
        27: f"case when by_level.n is not null then case when is_count then {number('by_level', 'มีทั้งหมด ', ' คน', 'There are ', ' of that level')} else {fixed('by_level', 40)} end end",
        28: f"case when surname_key is not null then case when is_count then {number('by_surname', 'มีพนักงานนามสกุลนี้ ', ' คน', 'There are ', ' employees with that surname')} "
            f"else coalesce({listed('by_surname', 30)}, {listed('part', 30)}) end end",
        29: "case when family then case when lang='th' then 'ตัวอย่างนามสกุลที่พบหลายคน: ' else 'Surnames that several people share: ' end||(select common from shared) end",
        30: f"case when counted_key is not null then {number('counted', 'มีทั้งหมด ', ' คน', 'There are ', ' employees')} end", 31: listed("named", 20), 32: listed("place", 20),
    }
    up_unit = "case when lang='th' then 'ต่อ ' else 'ext ' end||p.ext||case when lang='th' then ' / มือถือ ' else ' / mobile ' end||p.mobile"
    return rf"""
    with {PEOPLE_SQL.strip()}, {FOLK_SQL.strip()},
      asks0 as (select emp_id as qid, case when k%5=0 then 'th' else 'en' end as lang, {form} as text from (select *, {ORG_CASE} as org from folk)),
      asks as materialized (select qid, lang, {sql_unwrap()} as text from asks0),
      en as materialized (select *, first_name||' '||last_name as line from ({union}) where key<>''),
      ix as materialized (select kind, key, count(*) as n, arg_min(emp_id, (pref, emp_id)) as fid, list(line order by emp_id)[1:{MOST}] as lines from en group by 1,2),
      ds as (select distinct dept from folk), al as materialized ({alias}),
      ah as (select qid, kind, target, row_number() over (partition by qid, kind order by length(alias) desc, alias, target) as r from asks join al on contains(lower(text), alias)),
      ap as (select qid, {best} from ah group by 1),
      cw as (select qid, lang, regexp_extract_all(upper(text), '{CODE}', 1) as ws from asks),
      ch as materialized (select qid, lang, i as pos, x.kind, x.key, fid from cw, unnest(range(1,len(ws)+1)) r(i) join ix x on x.key=ws[i] and x.kind in ('unit','dept','section')
        where list_position(ws, ws[i])=i),
      un as (select qid, count(*) as n_units, arg_min(ch.key, pos) as unit_key, string_agg(ch.key||' — '||p.first_name||' '||p.last_name||': '||{up_unit}, chr(10) order by pos) as unit_lines
        from ch join folk p on p.emp_id=ch.fid where kind='unit' group by 1),
      pl as (select qid, arg_min(kind, o) as place_kind, arg_min(key, o) as place_key from (select *,
          (case when kind='section' and contains(key,'-') then 1 when kind='section' then 2 else 3 end, pos) as o from ch where kind<>'unit') group by 1),
      bw as (select qid, regexp_split_to_array(upper(regexp_replace(trim(text),'[^\p{{L}}\p{{N}}\p{{M}} ]',' ','g')),'\s+') as w from asks),
      fn as (select qid, arg_min(w[i]||' '||w[i+1], i) as full_key from bw, unnest(range(1,len(w))) r(i)
        where w[i]||' '||w[i+1] in (select key from ix where kind='full' and n=1) group by 1),
      base as (select *, lower(text) as low from asks),
      keyed as materialized (select qid, lang, text, low, {sql_policy('low')} as cls, {sql_asked('low')} as asked, {SQL_IS_LIST.replace('lower(text)', 'low')} as is_list,
        {SQL_IS_COUNT.replace('lower(text)', 'low')} as is_count, {sql_any('low', di.NEED_EXT_WORDS)} as need_ext,
        case when {SQL_IS_LIST.replace('lower(text)', 'low')} then try_cast(nullif(regexp_extract(text,'{LIMIT}',1),'') as bigint) end as list_limit,
        nullif(regexp_extract(text,'{EXT}',1),'') as ext_key, nullif(regexp_replace(regexp_extract(text,'{MOBILE}'),'[^0-9]','','g'),'') as mobile_key,
        nullif(lower(regexp_extract(text,'{EMAIL}')),'') as email_key,
        case when coalesce({ex(di.NICK_DEPT_TH)}, {ex(di.NICK_DEPT)}) not in ('WHO','MANY','HOW','THE','AND','FOR','ALL') or {ex(di.NICK_DEPT_TH)} is not null
          then coalesce({ex(di.NICK_DEPT_TH)}, {ex(di.NICK_DEPT)}) end as name_key, coalesce({ex(di.NICK_DEPT_TH, 2)}, {ex(di.NICK_DEPT, 2)}) as dept_key,
        {ex(ROLE_NICKNAME)} as role_key, {ex(TWO_NAMES)} as two_1, {ex(TWO_NAMES, 2)} as two_2, {ex(REAL_NAME)} as real_1, {ex(REAL_NAME, 2)} as real_2,
        {ex(NAME_BRANCH)} as at_branch, coalesce({ex(WHO_IS)}, {ex(IS_WHO)}) as who_key, {ex(NAME_AT)} as at_1, {ex(NAME_AT, 2)} as at_2,
        coalesce({ex(GRID)}, {ex(GRID_AFTER)}) as grid_key, {ex(SURNAME)} as surname_key, {ex(COUNT_NAMED)} as counted_key, {ex(NAMED)} as named_key,
        {sql_any('low', SAME_TEAM)} as same_team, {sql_any('low', HIERARCHY)} as hierarchy, {sql_any('low', FAMILY)} as family, {sql_any('low', SECRETARY)} as secretary,
        {sql_any('low', MANAGER)} as manager, {short_case} as short_dept,
        case when {sql_any('low', ['fruit', 'ผลไม้'])} then 'fruit' when {sql_any('low', ['colour', 'color', 'ชื่อสี'])} then 'colour' end as set_key,
        case when is_list or is_count or {sql_any('low', ALL_WORDS)} then {level} end as level_key,
        secretary_unit, manager_unit, described_unit, org_dept, geo, branch as branch_key, n_units, unit_key, unit_lines, place_kind, place_key, full_key
        from base left join ap using (qid) left join un using (qid) left join pl using (qid) left join fn using (qid)),
      shared as (select string_agg(key, ', ' order by n desc, key) as common from (select key, n from ix where kind='surname' and n>=2 order by n desc, key limit 5)),
      real as {fragment('nick_first', 'q.real_2', "and split_part(e.key,'|',1)=q.real_1")}, part as {fragment('surname', 'q.surname_key')}, named as {fragment('first', 'q.named_key')},
      ru as (select keyed.qid, lang, {", ".join(f"{a} as r{i}" for i, a in answers.items())}
        from keyed {joins}
        left join ix team on team.kind='team' and same_team and team.key=p_by_manager.dept
        left join ix reports on reports.kind='reports' and hierarchy and reports.key=coalesce(p_unit.dept, p_described.dept)||'|'||
          case when coalesce(p_unit.level, p_described.level) in ('VP','Director') then coalesce(p_unit.level, p_described.level) else '' end
        left join real on real.qid=keyed.qid left join folk p_real on p_real.emp_id=real.fid
        left join part on part.qid=keyed.qid and by_surname.n is null left join named on named.qid=keyed.qid)
    select qid, (case {" ".join(f"when r{i} is not null then {i}" for i in answers)} else 99 end)::bigint as rule,
      regexp_replace(coalesce({", ".join(f"r{i}" for i in answers)}, {missing}), '\b0[08]\d{{6}}\b', 'XXXXXXXX', 'g') as answer from ru"""


@query("route_cascade", route_sql())
def route_cascade(t: Tables) -> DataFrame:
    """Every question of every person through the cascade; the answers pass the compliance guard."""
    folk = materialize(folk_view(t), "folk")
    index = materialize(ca.directory_index(entries(dealt(folk, PEOPLE_AT_ONCE)), PERSON, ["emp_id"], MOST), "directory-index", ["kind"])
    q = materialize(analysed(questions(folk).withColumn("text", di.unwrap_question(F.col("text")))), "questions")
    q = ca.alias_targets(q, "qid", "text", aliases(t, folk), ["secretary_unit", "manager_unit", "described_unit", "org_dept", "geo", "branch"])
    q = followed(materialize(keyed(q, index), "keyed-questions"), index)
    out = ca.first_answer(q, rules(shared_surnames(index)), di.phrase(F.lit("person_not_found"), F.col("lang"), COMPANY))
    answer = di.compliance(F.col("__b.answer"), F.col("lang"), F.col("__b.rule") == 1)
    return out.select("qid", F.col("__b.rule").cast("bigint").alias("rule"), answer.alias("answer"))
