"""The registered queries over the derived sources and the given tables, and their SQL.

Each entry of QUERIES takes (spark, sf_dir) and reads whole tables. ORACLE_SQL says the
same in DuckDB. What rests on the greedy third tier has none (tier3_links, match_reviews,
merge_summary and every NAME_all_tiers) and is held against a sequential model in the
tests; neither have spectral flatness and quality_grade_measured.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import audio, fields, fixed, fuzzy
from weftline.operators import build, enrich, ingest, profile, resolve, serve, survive
from weftline.plans import oracle as o
from weftline.plans import derived
from weftline.plans.derived import BASE, WIDTH
from weftline.runtime import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Shared intermediate tables of this session: what several queries start from is
#: written once. forget() makes the next query start from the inputs again.
_made: dict[tuple, DataFrame] = {}


#: Whether person(), members(), links() and issues() rest on all three tiers.
_every: ContextVar[bool] = ContextVar("every", default=False)


def forget() -> None:
    _made.clear()


def _once(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = materialize(make())
    return _made[key]


def raw(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """A derived source, written once: it stands for an extract that is a file."""
    return _once(source, spark, sf_dir, lambda: derived.raw(spark, sf_dir, source))


def raw_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {s: raw(spark, sf_dir, s) for s in WIDTH}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def all_tiers(*names: str) -> None:
    """NAME_all_tiers for each: what the query NAME asks, of the persons, issues and
    reviews that all three tiers give. The greedy third tier is not for SQL to express,
    so NAME itself stays with what its SQL says."""

    def add(name: str) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            was = _every.set(True)
            try:
                return QUERIES[name](spark, sf_dir)
            finally:
                _every.reset(was)

        query(f"{name}_all_tiers")(run)

    for name in names:
        add(name)


def cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


# scalars


def _scalar(name: str, source: str, i: int, make: Callable[[Column], Column], value_sql: str, code: Callable[[Column], Column] | None = None, code_sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = [code(cell(i)).alias("codes")] if code else []
        return raw(spark, sf_dir, source).select("row_no", make(cell(i)).alias("value"), *more)

    query(name, o.scalar(source, value_sql, code_sql))(run)


def _field(name: str, source: str, i: int, make, sql: tuple, show: Callable[[Column], Column] = lambda v: v) -> None:
    _scalar(name, source, i, lambda c: show(make(c).value), sql[0], lambda c: make(c).codes(), sql[-1])


_scalar("clean_text", "source1", 0, fields.clean, o.clean("c0"))
_field("norm_phone", "source1", 2, fields.phone, o.phone("c2"))
_field("norm_phone_contacts", "source3", 1, fields.phone, o.phone("c1"))
_field("norm_email", "source1", 1, fields.email, o.email("c1"))
_scalar("phone_key", "source3", 1, fields.phone_key, o.phone_key("c1"))
_scalar("email_key", "source2", 0, fields.email_key, "nullif(lower(trim(c0)), '')")
_field("norm_name", "source1", 0, fields.name, o.name("c0"))
_scalar("name_key", "source3", 0, fields.name_key, o.name_key("c0"))
_scalar("name_parts", "source2", 1, lambda c: F.concat_ws("|", fields.first_name(c), fields.surname(c)), f"coalesce({o.name_tokens('c1')}[1], '') || '|' || coalesce({o.name_tokens('c1')}[-1], '')")
_field("norm_city", "source1", 3, fields.city, o.city("c3"))
_field("norm_date", "source1", 6, fields.date, (f"strftime({o.date('c6')[0]}, '%Y-%m-%d')", o.date("c6")[1]), lambda v: F.date_format(v, "yyyy-MM-dd"))
_field("norm_ctc", "source1", 5, fields.ctc, (f"concat_ws(' ', cast({o.ctc('c5')[0]} as varchar), {o.ctc('c5')[1]})", o.ctc("c5")[2]), lambda v: F.concat_ws(" ", v["annual"].cast("string"), v["unit"]))
_field("norm_rate", "source2", 2, fields.rate, (f"concat_ws(' ', cast({o.rate('c2')[1]} as varchar), {o.rate('c2')[2]})", o.rate("c2")[3]), lambda v: F.concat_ws(" ", v["monthly"].cast("string"), v["unit"]))
_scalar("norm_rate_hourly", "source2", 2, lambda c: fields.rate(c).value["hourly"], o.rate("c2")[0])
_field("norm_status", "source2", 4, fields.status, o.status("c4"))
_field("norm_bool", "source3", 3, fields.flag, o.flag("c3"), lambda v: v.cast("int"))
_field("norm_int", "source3", 4, fields.whole, o.whole("c4"))
_field("norm_float", "source1", 4, fields.experience, o.real("c4"))
_field("norm_skills", "source1", 7, fields.skills, o.skills("c7"), lambda v: F.array_join(v, "|"))
_scalar("category_enum", "source2", 4, fields.category, f"case when lower(trim(c4)) in ({o._list(fixed.CATEGORIES)}) then lower(trim(c4)) end")


@query("row_sha1", f"with {BASE} select row_no, sha1(" + " || chr(31) || ".join(f"c{i}" for i in range(5)) + ") as value from raw3")
def row_sha1(spark, sf_dir):
    return raw(spark, sf_dir, "source3").select("row_no", fields.row_digest(F.col("cells")).alias("value"))


@query("sha256", "select doc_id, sha256(text) as digest from documents")
def sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# structure and findings


def parsed(spark, sf_dir) -> DataFrame:
    return _once("parsed", spark, sf_dir, lambda: ingest.parse_all(raw_all(spark, sf_dir)))


_ROWS = "select '{s}' as source, row_no, {what} from parsed{t} where {when}"


def _structural(name: str, what: dict[str, str], when_sql: str, code: str, cols: Callable[[], list[Column]] = lambda: []) -> None:
    sql = o.over(o.PARSED) + " union all ".join("select 'source{t}' as source, row_no{more} from parsed{t} where {when}".format(t=t, more="".join(f", {v} as {k}" for k, v in what.items()), when=when_sql.format(width=o.WIDTH[f"source{t}"])) for t in "123")

    def run(spark, sf_dir):
        return parsed(spark, sf_dir).where(F.exists("issues", lambda x: x["code"] == code)).select("source", "row_no", *cols())

    query(name, sql)(run)


_structural("blank_rows", {}, "kind = 'blank'", "BLANK_ROW")
_structural("repeated_header", {"shown": "array_to_string(cells_raw, ',')"}, "kind = 'header'", "REPEATED_HEADER", lambda: [F.array_join("cells_raw", ",").alias("shown")])
_structural("width_mismatch", {"cells": "width"}, "kind = 'row' and width <> {width}", "COLUMN_COUNT_MISMATCH", lambda: [F.size("cells_raw").alias("cells")])
_structural("column_rotation", {"email_cell": "c0"}, "shift > 0", "COLUMN_SHIFT", lambda: [F.get("cells", F.lit(0)).alias("email_cell")])
_structural("exact_duplicates", {"note": "'identical to row ' || cast(first_row as varchar)"}, "status = 'duplicate_row'", "EXACT_DUPLICATE_ROW", lambda: ["note"])


@query("row_status", o.over(o.PARSED) + " union all ".join(f"select 'source{t}' as source, status, count(*) as n from parsed{t} group by status" for t in "123"))
def row_status(spark, sf_dir):
    return parsed(spark, sf_dir).groupBy("source", "status").agg(F.count("*").alias("n"))


def issues(spark, sf_dir) -> DataFrame:
    """Findings about rows; over all tiers also those of merges and open identities."""
    if not _every.get():
        return survive.issue_log(parsed(spark, sf_dir))
    merged = survive.merge_findings(members(spark, sf_dir), person(spark, sf_dir))
    return _once("issues, all tiers", spark, sf_dir, lambda: survive.issue_log(parsed(spark, sf_dir), merged, _resolution(spark, sf_dir)["reviews"]))


@query("issue_log", o.over(o.PARSED, o.issue_rows()) + f"select source, row_no, code as issue_code, {o.SEVERITY_SQL} as severity from found")
def issue_log(spark, sf_dir):
    return issues(spark, sf_dir).select("source", "row_no", "issue_code", "severity")


@query("issues_by_code", o.over(o.PARSED, o.issue_rows()) + f"select code as issue_code, {o.SEVERITY_SQL} as severity, count(*) as n, string_agg(distinct source, ',' order by source) as sources from found group by 1, 2")
def issues_by_code(spark, sf_dir):
    return serve.first_examples(issues(spark, sf_dir)).select("issue_code", "severity", "n", "sources")


@query("issues_by_severity", o.over(o.PARSED, o.issue_rows()) + f"select {o.SEVERITY_SQL} as severity, count(*) as n from found group by 1")
def issues_by_severity(spark, sf_dir):
    return serve.by_severity(issues(spark, sf_dir))


@query("issue_example_per_code", o.over(o.PARSED, o.issue_rows()) + "select issue_code, example_source, example_row from (select code as issue_code, source as example_source, row_no as example_row, row_number() over (partition by code order by source, row_no) as r from found) where r = 1")
def issue_example_per_code(spark, sf_dir):
    return serve.first_examples(issues(spark, sf_dir)).select("issue_code", "example_source", "example_row")


@query("top_issue_codes", o.over(o.PARSED, o.issue_rows()) + "select code as issue_code, count(*) as n from found group by 1 order by n desc, code limit 15")
def top_issue_codes(spark, sf_dir):
    return issues(spark, sf_dir).groupBy("issue_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue_code").limit(15)


# similarity


_PAIRS = "select row_no, {key} as a, lag({key}) over (partition by row_no % 16 order by row_no) as b from raw3"


def _name_pairs(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rows = raw(spark, sf_dir, "source3").select("row_no", cell(0).alias("raw_a"))
    return rows.withColumn("raw_b", F.lag("raw_a").over(Window.partitionBy(F.col("row_no") % 16).orderBy("row_no"))).where("raw_b is not null")


def _pairs_sql(value: str) -> str:
    return f"with {BASE}, pairs as (select row_no, {o.name_key('c0')} as a, lag({o.name_key('c0')}) over (partition by row_no % 16 order by row_no) as b from raw3) select row_no, {value} as value from pairs where b is not null"


_KEY_A, _KEY_B = o.sort_tokens("a"), o.sort_tokens("b")


@query("indel_ratio", _pairs_sql(f"round({o.indel('a', 'b')}, 6)"))
def indel_ratio(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("row_no", F.round(fuzzy.indel_ratio(fields.name_key(F.col("raw_a")), fields.name_key(F.col("raw_b"))), 6).alias("value"))


@query("token_sort_ratio", f"with p as ({_pairs_sql('[a, b]')}), q as (select row_no, {o.sort_tokens('value[1]')} as a, {o.sort_tokens('value[2]')} as b from p) select row_no, round({o.indel('a', 'b')}, 6) as value from q")
def token_sort_ratio(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("row_no", F.round(fuzzy.token_sort_ratio(fields.name_key(F.col("raw_a")), fields.name_key(F.col("raw_b"))), 6).alias("value"))


def _compatible(a: str, b: str) -> str:
    """Of two name keys (tokens joined by one space)."""
    first, last = (lambda k: f"split_part({k}, ' ', 1)"), (lambda k: f"split_part({k}, ' ', -1)")
    initial = f"{last(a)} = {last(b)} and {first(a)}[1:1] = {first(b)}[1:1] and (length({first(a)}) = 1 or length({first(b)}) = 1)"
    return f"case when {a} = '' or {b} = '' then false when {a} = {b} then true when {initial} then true else {o.indel(o.sort_tokens(a), o.sort_tokens(b))} >= {fixed.NAME_SIMILARITY} end"


@query("names_compatible", f"with p as ({_pairs_sql('[a, b]')}), q as (select row_no, array_to_string({o.name_tokens('value[1]')}, ' ') as a, array_to_string({o.name_tokens('value[2]')}, ' ') as b, {o.sort_tokens('value[1]')} as sa, {o.sort_tokens('value[2]')} as sb from p) select row_no, cast(({_compatible('a', 'b').replace(o.indel(_KEY_A, _KEY_B), o.indel('sa', 'sb'))}) as integer) as value from q")
def names_compatible(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("row_no", fuzzy.names_compatible(F.col("raw_a"), F.col("raw_b")).cast("int").alias("value"))


# graph


def records(spark, sf_dir) -> DataFrame:
    return _once("records", spark, sf_dir, lambda: ingest.records(parsed(spark, sf_dir)))


def strong_links(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir)
    return _once("strong", spark, sf_dir, lambda: resolve.key_links(r, "ekey", "email").unionByName(resolve.key_links(r, "pkey", "phone")))


def members(spark, sf_dir) -> DataFrame:
    """Records in the clusters of the first two tiers, or of all."""
    if _every.get():
        return _once("members, all tiers", spark, sf_dir, lambda: records(spark, sf_dir).join(_resolution(spark, sf_dir)["clusters"], "ord"))
    return _once("members", spark, sf_dir, lambda: resolve.with_components(records(spark, sf_dir), strong_links(spark, sf_dir)))


def links(spark, sf_dir) -> DataFrame:
    return _resolution(spark, sf_dir)["links"] if _every.get() else strong_links(spark, sf_dir)


_RECORDS, _STRONG, _GOLDEN = (o.PARSED, o.RECORDS), (o.PARSED, o.RECORDS, o.STRONG), (o.PARSED, o.RECORDS, o.STRONG, o.GOLDEN)


@query("record_keys", o.over(*_RECORDS) + "select ord, source, name, email, phone, city, ekey, pkey, nkey, surname from keyed")
def record_keys(spark, sf_dir):
    return records(spark, sf_dir).select("ord", "source", "name", "email", "phone", "city", "ekey", "pkey", "nkey", "surname")


@query("email_links", o.over(*_STRONG) + "select a, b, 1.0::double as confidence from email_edges")
def email_links(spark, sf_dir):
    return resolve.key_links(records(spark, sf_dir), "ekey", "email").select("a", "b", "confidence")


@query("phone_links", o.over(*_STRONG) + "select a, b, 0.99::double as confidence from phone_edges")
def phone_links(spark, sf_dir):
    return resolve.key_links(records(spark, sf_dir), "pkey", "phone").select("a", "b", "confidence")


@query("components_strong", o.over(*_STRONG) + "select ord, component from placed")
def components_strong(spark, sf_dir):
    return members(spark, sf_dir).select("ord", "component")


_BLOCKS = f"""blocked as materialized (select distinct surname, city, name, nkey, {o.sort_tokens('nkey')} as sorted from placed where surname <> '' and city is not null)
, alike as materialized (select x.surname, x.city, x.name as name_a, y.name as name_b from blocked x join blocked y on x.surname = y.surname and x.city = y.city
  where x.name = y.name or {_compatible('x.nkey', 'y.nkey').replace(o.indel(o.sort_tokens('x.nkey'), o.sort_tokens('y.nkey')), o.indel('x.sorted', 'y.sorted'))})"""


@query("block_candidates", o.over(*_STRONG, _BLOCKS) + "select a.ord as a, b.ord as b from placed a join alike on a.surname = alike.surname and a.city = alike.city and a.name = name_a join placed b on b.surname = alike.surname and b.city = alike.city and b.name = name_b where a.ord < b.ord and a.source <> b.source and a.component <> b.component")
def block_candidates(spark, sf_dir):
    return resolve.block_candidates(members(spark, sf_dir)).select("a", "b")


@query("veto_reasons", o.over(*_STRONG, _BLOCKS) + ", per as (select k.surname, k.city, k.name_a as name, p.source, count(*) as n from alike k join placed p on p.surname = k.surname and p.city = k.city and p.name = k.name_b group by all) select surname, city, name, string_agg(cast(n as varchar) || 'x in ' || source, ', ' order by source) as appears from per group by all having max(n) > 1")
def veto_reasons(spark, sf_dir):
    return resolve.ambiguous_names(members(spark, sf_dir))


def _resolution(spark, sf_dir) -> dict[str, DataFrame]:
    def make():
        found = resolve.resolve(records(spark, sf_dir))
        for name, df in (("links", found.links), ("clusters", found.clusters), ("reviews", found.reviews)):
            _once(f"resolved {name}", spark, sf_dir, lambda df=df: df)

    key = (spark.sparkContext.applicationId, sf_dir, "resolved links")
    if key not in _made:
        make()
    return {n: _made[(*key[:2], f"resolved {n}")] for n in ("links", "clusters", "reviews")}


@query("tier3_links")
def tier3_links(spark, sf_dir):
    return _resolution(spark, sf_dir)["links"].where("method = 'name_city'")


@query("match_reviews")
def match_reviews(spark, sf_dir):
    return _resolution(spark, sf_dir)["reviews"]


@query("merge_summary")
def merge_summary(spark, sf_dir):
    return build.summary(build.build(raw_all(spark, sf_dir)).tables)


# golden records over the first two tiers; all_tiers() registers them over all three


def person(spark, sf_dir) -> DataFrame:
    return _once("person, all tiers" if _every.get() else "person", spark, sf_dir, lambda: survive.golden(members(spark, sf_dir), links(spark, sf_dir)))


@query("pick_name", o.over(*_GOLDEN) + "select component, full_name from names")
def pick_name(spark, sf_dir):
    return survive.pick_names(members(spark, sf_dir))


@query("pick_email", o.over(*_GOLDEN) + "select component, primary_email from best_mail")
def pick_email(spark, sf_dir):
    m = members(spark, sf_dir)
    return survive.pick_emails(m, survive.pick_names(m))


@query("pick_city", o.over(*_GOLDEN) + "select component, city from best_city")
def pick_city(spark, sf_dir):
    return survive.pick_cities(members(spark, sf_dir))


@query("pick_phone", o.over(*_GOLDEN) + "select component, primary_phone from best_phone")
def pick_phone(spark, sf_dir):
    return survive.pick_phones(members(spark, sf_dir))


_PERSON = ["person_id", "full_name", "primary_email", "primary_phone", "city", "source_count", "in_source1", "in_source2", "in_source3", "current_ctc_inr", "applied_date", "gig_rate_inr_month", "gig_status", "contact_verified", "projects_completed"]


@query("golden_person", o.over(*_GOLDEN) + f"select {', '.join(_PERSON)} from person")
def golden_person(spark, sf_dir):
    p = person(spark, sf_dir)
    return p.withColumns({"applied_date": F.date_format("applied_date", "yyyy-MM-dd"), "contact_verified": F.col("contact_verified").cast("int")}).select(*_PERSON)


@query("match_methods", o.over(*_STRONG) + ", made as (select component, 'email' as method, 1.0::double as c from email_edges join placed on a = ord union select component, 'phone', 0.99 from phone_edges join placed on a = ord) select component, string_agg(distinct method, ',' order by method) as match_methods, min(c) as match_confidence from made group by component")
def match_methods(spark, sf_dir):
    return survive.methods(links(spark, sf_dir), members(spark, sf_dir).select("ord", "component"))


_SOURCE_COUNTS = "select match_methods, count(*) as n from (select p.component, coalesce(string_agg(distinct method, ',' order by method), 'single_source') as match_methods from person p left join (select component, 'email' as method from email_edges join placed on a = ord union all select component, 'phone' from phone_edges join placed on a = ord) m on m.component = p.component group by p.component) group by match_methods"


@query("people_by_method", o.over(*_GOLDEN) + _SOURCE_COUNTS)
def people_by_method(spark, sf_dir):
    return person(spark, sf_dir).groupBy("match_methods").agg(F.count("*").alias("n"))


@query("source_coverage", o.over(*_GOLDEN) + "select in_source1 + in_source2 + in_source3 as sources, count(*) as n from person group by 1")
def source_coverage(spark, sf_dir):
    return person(spark, sf_dir).groupBy((F.col("in_source1") + F.col("in_source2") + F.col("in_source3")).alias("sources")).agg(F.count("*").alias("n"))


_CHILD = "select person_id, {v} as {out}, arg_min(source, ord) as source{more} from placed m join person p on p.component = m.component where {v} is not null group by person_id, {v}{by}"


@query("person_email", o.over(*_GOLDEN) + _CHILD.format(v="email", out="email", more=", cast(email = primary_email as integer) as is_primary", by=", primary_email"))
def person_email(spark, sf_dir):
    return survive.person_email(members(spark, sf_dir), person(spark, sf_dir))


@query("person_phone", o.over(*_GOLDEN) + _CHILD.format(v="phone", out="phone", more=", cast(phone = primary_phone as integer) as is_primary", by=", primary_phone"))
def person_phone(spark, sf_dir):
    return survive.person_phone(members(spark, sf_dir), person(spark, sf_dir))


@query("person_alias", o.over(*_GOLDEN) + _CHILD.format(v="raw_name", out="name", more="", by=""))
def person_alias(spark, sf_dir):
    return survive.person_alias(members(spark, sf_dir), person(spark, sf_dir))


_SKILLS = "skill_rows as (select component, source, ord, generate_subscripts(skills, 1) as spot, unnest(skills) as skill from placed), skill as (select row_number() over (order by first) as skill_id, name from (select skill as name, min([component, ord, spot]) as first from skill_rows group by skill))"


@query("skill_dim", o.over(*_GOLDEN, _SKILLS) + "select skill_id, name from skill")
def skill_dim(spark, sf_dir):
    return survive.skills(members(spark, sf_dir))


@query("person_skill", o.over(*_GOLDEN, _SKILLS) + "select distinct person_id, skill_id, source from skill_rows r join person p on p.component = r.component join skill s on s.name = r.skill")
def person_skill(spark, sf_dir):
    m = members(spark, sf_dir)
    return survive.person_skill(m, person(spark, sf_dir), survive.skills(m))


def full(spark, sf_dir) -> DataFrame:
    m, p = members(spark, sf_dir), person(spark, sf_dir)
    known = survive.skills(m)
    return _once("full, all tiers" if _every.get() else "full", spark, sf_dir, lambda: survive.person_full(p, survive.person_skill(m, p, known), known))


_FULL = "full_view as (select p.*, listed.skills from person p left join (select component, string_agg(distinct skill, ', ' order by skill) as skills from skill_rows group by component) listed on listed.component = p.component)"


@query("person_full_view", o.over(*_GOLDEN, _SKILLS, _FULL) + "select person_id, full_name, city, skills from full_view")
def person_full_view(spark, sf_dir):
    return full(spark, sf_dir).select("person_id", "full_name", "city", "skills")


_FOUND = """emails_of as (select component, list(email order by o) as emails from (select component, email, min(ord) as o from placed where email is not null group by all) group by component)
, names_of as (select component, list(name order by o) as said from (select component, name, min(ord) as o from placed where name <> '' group by all) group by component)
, cities_of as (select component, string_agg(source || '=' || city, ' | ' order by ord) as said, count(distinct city) as n from placed where city is not null group by component)
, two as (select component, count(*) as n, list_sort(arg_min(skills, ord)) as x, list_sort(arg_max(skills, ord)) as y from placed where source in ('source1', 'source2') and len(skills) > 0 group by component)
, merged as (
  select component, 'NAME_VARIANTS_MERGED' as issue_code, array_to_string(said, ' | ') as raw_value from names_of where len(said) > 1
  union all select component, 'CROSS_SOURCE_CITY_CONFLICT', said from cities_of where n > 1
  union all select component, 'MULTIPLE_EMAILS_ONE_PERSON', array_to_string(emails, ' | ') from emails_of where len(emails) > 1
  union all select e.component, 'ALTERNATE_EMAIL', array_to_string(list_concat([primary_email], list_filter(emails, lambda z: z <> primary_email)), ' | ') from emails_of e join person p on p.component = e.component where len(emails) > 1
  union all select component, 'SKILL_SET_DIVERGENCE', 'source1=[' || array_to_string(x, ', ') || '] source2=[' || array_to_string(y, ', ') || ']' from two where n = 2 and x <> y
)"""


@query("merge_findings", o.over(*_GOLDEN, _FOUND) + "select p.source, p.row_no, issue_code, raw_value from merged m join placed p on p.ord = m.component")
def merge_findings(spark, sf_dir):
    return survive.merge_findings(members(spark, sf_dir), person(spark, sf_dir)).select("source", "row_no", "issue_code", "raw_value")


@query("source_record", o.over(*_GOLDEN) + " union all ".join(f"select 'source{t}' as source, f.row_no, status, person_id, sha1(case when kind = 'row' then {' || chr(31) || '.join(o._CELLS[f'source{t}'])} else array_to_string(cells_raw, chr(31)) end) as row_hash from parsed{t} f left join placed m on m.source = 'source{t}' and m.row_no = f.row_no left join person p on p.component = m.component" for t in "123").replace(" f.row_no, status", " f.row_no as row_no, status") .replace("then 'ingested'", "then 'ingested'"))
def source_record(spark, sf_dir):
    rows = survive.source_records(parsed(spark, sf_dir), members(spark, sf_dir), person(spark, sf_dir))
    return rows.select("source", "row_no", "status", "person_id", "row_hash")


for _name, _sql, _of in (
    ("invariant_email_owner", "select email, count(distinct component) as owners from placed where email is not null group by email having count(distinct component) > 1", "email"),
    ("invariant_phone_owner", "select phone, count(distinct component) as owners from placed where phone is not null group by phone having count(distinct component) > 1", "phone"),
):
    query(_name, o.over(*_STRONG) + _sql)(lambda spark, sf_dir, c=_of: members(spark, sf_dir).where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("component").alias("owners")).where("owners > 1"))


# serving

_SUBMISSIONS = """submissions as (select cast(event_id as bigint) as submission_id, '0' || cast(9000000000 + user_id as varchar(20)) as submitted_phone, 'h' || cast(event_id % 997 as varchar(20)) as sha256,
  cast(1 + event_id % 90 as double) as duration_sec, case when event_id % 4 = 0 then 'poor' when event_id % 4 = 1 then 'fair' else 'good' end as quality_label from events)"""


def submissions(spark, sf_dir) -> DataFrame:
    return spark.sql("with " + _SUBMISSIONS.replace("from events", "from {events}") + " select * from submissions", events=table(spark, sf_dir, "events"))


_OWNER = "owners as (select right(regexp_replace(phone, '\\D', '', 'g'), 10) as pkey, min(person_id) as person_id from placed m join person p on p.component = m.component where phone is not null group by 1)"


@query("resolve_submission_person", o.over(*_GOLDEN, _SUBMISSIONS, _OWNER) + "select submission_id, w.person_id, case when w.person_id is null then 'new_person' else 'phone' end as matched_by from submissions s left join owners w on w.pkey = right(regexp_replace(submitted_phone, '\\D', '', 'g'), 10)")
def resolve_submission_person(spark, sf_dir):
    phones = survive.person_phone(members(spark, sf_dir), person(spark, sf_dir))
    return serve.resolve_submitters(submissions(spark, sf_dir), phones).select("submission_id", "person_id", "matched_by")


@query("submission_list", o.over(*_GOLDEN, _SUBMISSIONS, _OWNER) + "select submission_id, w.person_id, full_name from submissions s left join owners w on w.pkey = right(regexp_replace(submitted_phone, '\\D', '', 'g'), 10) left join person p on p.person_id = w.person_id order by submission_id desc limit 100")
def submission_list(spark, sf_dir):
    p = person(spark, sf_dir)
    found = serve.resolve_submitters(submissions(spark, sf_dir), survive.person_phone(members(spark, sf_dir), p))
    return serve.list_submissions(found, p).select("submission_id", "person_id", "full_name")


@query("submission_stats", f"with {_SUBMISSIONS} select count(*) as n, round(sum(duration_sec) / 60, 1) as minutes, count(*) filter (where quality_label = 'good') as good, count(*) filter (where quality_label = 'poor') as poor from submissions")
def submission_stats(spark, sf_dir):
    return serve.submission_stats(submissions(spark, sf_dir))


@query("duplicate_uploads", f"with {_SUBMISSIONS} select submission_id, duplicate_of from (select submission_id, min(submission_id) over (partition by sha256) as duplicate_of from submissions) where submission_id <> duplicate_of")
def duplicate_uploads(spark, sf_dir):
    return serve.duplicate_uploads(submissions(spark, sf_dir))


_PROBES = """probes as (select k as probe_id, case when k % 3 = 0 then upper(full_name) else 'Nobody ' || last_name end as name, case when k % 2 = 0 then upper(mail) else null end as email, case when k % 5 < 3 then tel else null end as phone from base)"""


@query("match_check", o.over(*_GOLDEN, _PROBES) + f""", hits as (
  select probe_id, p.person_id, 1 as tier, 'email' as matched_on, 1.0::double as confidence from probes join placed m on m.email = lower(trim(probes.email)) join person p on p.component = m.component
  union select probe_id, p.person_id, 2, 'phone', 0.99 from probes join placed m on right(regexp_replace(m.phone, '\\D', '', 'g'), 10) = {o.phone_key('probes.phone')} join person p on p.component = m.component
  union select probe_id, p.person_id, 3, 'name', 0.5 from probes join person p on lower(p.full_name) = lower(trim(probes.name))
) select probe_id, person_id, matched_on, confidence from hits h where tier = (select min(tier) from hits g where g.probe_id = h.probe_id)""")
def match_check(spark, sf_dir):
    m, p = members(spark, sf_dir), person(spark, sf_dir)
    probes = spark.sql(f"with {BASE}, {_PROBES} select * from probes".replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))
    return serve.match_check(probes, p, survive.person_email(m, p), survive.person_phone(m, p))


_UPDATES = """updates as (select k % 700 + 1 as person_id, case when k % 6 = 0 then ' Data ' when k % 6 = 1 then 'web-dev' when k % 6 = 2 then 'bogus' when k % 6 = 3 then 'Automation-Heavy' else 'generalist' end as skill_category,
  cast(k % 10 as double) / 10 as confidence, 'hand' as tagged_by, k as told_at from base)"""


def updates(spark, sf_dir) -> DataFrame:
    return spark.sql(f"with {BASE}, {_UPDATES} select * from updates".replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))


_GOOD = f"good as (select u.*, lower(trim(skill_category)) as category from updates u join person p on p.person_id = u.person_id where lower(trim(skill_category)) in ({o._list(fixed.CATEGORIES)}))"


@query("latest_enrichment", o.over(*_GOLDEN, _UPDATES, _GOOD) + "select person_id, arg_max(category, told_at) as skill_category, arg_max(confidence, told_at) as skill_category_conf from good group by person_id")
def latest_enrichment(spark, sf_dir):
    return serve.latest_category(updates(spark, sf_dir), person(spark, sf_dir)).where("skill_category is not null").select("person_id", "skill_category", "skill_category_conf")


@query("update_status", o.over(*_GOLDEN, _UPDATES) + f"select told_at, case when lower(trim(skill_category)) not in ({o._list(fixed.CATEGORIES)}) then 422 when p.person_id is null then 404 else 200 end as status from updates u left join person p on p.person_id = u.person_id")
def update_status(spark, sf_dir):
    return serve.accepted_categories(updates(spark, sf_dir), person(spark, sf_dir)).select("told_at", "status")


@query("list_people_untagged", o.over(*_GOLDEN, _SKILLS, _FULL, _UPDATES, _GOOD) + "select person_id, full_name, skills from full_view where skills is not null and person_id not in (select person_id from good) order by person_id limit 200")
def list_people_untagged(spark, sf_dir):
    tagged = serve.latest_category(updates(spark, sf_dir), full(spark, sf_dir))
    return serve.list_people(tagged, untagged=True).select("person_id", "full_name", "skills")


@query("dashboard_stats", o.over(o.PARSED, o.RECORDS, o.STRONG, o.GOLDEN, _SUBMISSIONS, _UPDATES, _GOOD, o.issue_rows()) + "select (select count(*) from person) as people, (select count(*) from person where source_count > 1) as merged, (select count(distinct person_id) from good) as tagged, (select count(*) from found) as issues, 0::bigint as open_reviews, (select count(*) from submissions) as submissions")
def dashboard_stats(spark, sf_dir):
    tagged = serve.latest_category(updates(spark, sf_dir), person(spark, sf_dir))
    # The first two tiers leave nothing to review.
    open_ = _resolution(spark, sf_dir)["reviews"] if _every.get() else spark.range(0)
    return serve.dashboard(tagged, issues(spark, sf_dir), open_.select(F.lit(0).alias("resolved")), submissions(spark, sf_dir))


all_tiers("dashboard_stats", "issue_log", "issues_by_code", "issues_by_severity", "issue_example_per_code", "top_issue_codes")


all_tiers("pick_name", "pick_email", "pick_city", "pick_phone", "golden_person", "match_methods", "people_by_method", "source_coverage")
all_tiers("person_email", "person_phone", "person_alias", "skill_dim", "person_skill", "person_full_view", "merge_findings", "source_record")
all_tiers("resolve_submission_person", "submission_list", "match_check", "latest_enrichment", "update_status", "list_people_untagged")


# enrichment

_HITS = {c: "len(list_filter(tokens, lambda t: t in (" + o._list(w) + ")))" for c, w in fixed.CATEGORY_WORDS.items()}
_CLASSIFIED = f"""tokened as (select person_id, list_distinct(list_transform(string_split(lower(skills), ','), lambda t: trim(t))) as tokens from full_view where skills is not null)
, counted as (select person_id, {', '.join(f"{h} as h{i}" for i, h in enumerate(_HITS.values()))} from tokened)
, answered as (select person_id, case when h0 + h1 + h2 = 0 or greatest(h0, h1, h2) / (h0 + h1 + h2) < {fixed.SHARE_FLOOR} then 'generalist' when h0 >= h1 and h0 >= h2 then 'automation-heavy' when h1 >= h2 then 'web-dev' else 'data' end as category,
  case when h0 + h1 + h2 = 0 then 0.0 else round(greatest(h0, h1, h2)::double / (h0 + h1 + h2), 2) end as confidence from counted)"""


@query("classify_rule", o.over(*_GOLDEN, _SKILLS, _FULL, _CLASSIFIED) + "select person_id, category, confidence from answered")
def classify_rule(spark, sf_dir):
    return enrich.answers(full(spark, sf_dir)).select("person_id", "category", "confidence")


@query("category_counts", o.over(*_GOLDEN, _SKILLS, _FULL, _CLASSIFIED) + "select category, count(*) as n from answered group by 1")
def category_counts(spark, sf_dir):
    return enrich.answers(full(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


@query("validate_output", f"with {BASE}, {_UPDATES} select told_at as person_id, case when lower(trim(skill_category)) in ({o._list(fixed.CATEGORIES)}) then lower(trim(skill_category)) else 'generalist' end as category, cast(lower(trim(skill_category)) in ({o._list(fixed.CATEGORIES)}) and confidence >= {fixed.FLOW_CONFIDENCE} as integer) as accepted from updates")
def validate_output(spark, sf_dir):
    found = updates(spark, sf_dir).select(F.col("told_at").alias("person_id"), F.col("skill_category").alias("category"), "confidence")
    return enrich.validate(found).select("person_id", "category", F.col("accepted").cast("int").alias("accepted"))


@query("confidence_split", o.over(*_GOLDEN, _SKILLS, _FULL, _CLASSIFIED) + f"select case when confidence >= {fixed.FLOW_CONFIDENCE} then 'write' else 'review' end as branch, count(*) as n from answered group by 1")
def confidence_split(spark, sf_dir):
    good, rest = enrich.split(enrich.validate(enrich.answers(full(spark, sf_dir))))
    return good.withColumn("branch", F.lit("write")).unionByName(rest.withColumn("branch", F.lit("review"))).groupBy("branch").agg(F.count("*").alias("n"))


all_tiers("classify_rule", "category_counts", "confidence_split")


# profile

_ALL_CELLS = {t: [f"coalesce({c}, '')" for c in o._CELLS[f"source{t}"]] for t in "123"}


@query("profile_widths", f"with {BASE} " + " union all ".join(f"select 'source{t}' as source, width, count(*) as n from raw{t} group by width" for t in "123"))
def profile_widths(spark, sf_dir):
    rows = raw_all(spark, sf_dir)
    return profile.widths(rows["source1"].unionByName(rows["source2"]).unionByName(rows["source3"]))


def _hist_sql(t: str, what: str, value: str) -> str:
    return f"select 'source{t}' as source, '{what}' as what, {value} as value, count(*) as n from raw{t} group by all"


def _prefix(c: str) -> str:
    return f"left({o.digits(c)}, 2) || '/' || cast(length({o.digits(c)}) as varchar)"


def _shape_sql(c: str) -> str:
    s = o.clean(c)
    shapes = ((r"\d{4}-\d{2}-\d{2}", "YYYY-MM-DD"), (r"\d{1,2}-\d{1,2}-\d{4}", "D-M-Y"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/D/Y"), (r"\d{1,2} [A-Za-z]+ \d{4}", "D Month Y"))
    return f"case when {s} = '' then 'empty' " + " ".join(f"when regexp_full_match({s}, '{p}') then '{n}'" for p, n in shapes) + " else 'other' end"


_UNIT = f"case when regexp_matches(lower({o.clean('c2')}), '/ *(hr|hour)$') then 'hour' when regexp_matches(lower({o.clean('c2')}), '/ *(mo|month)$') then 'month' else 'other' end"
_HISTS = [_hist_sql("1", "city", "coalesce(c3, '')"), _hist_sql("2", "city", "c3"), _hist_sql("3", "city", "c2"), _hist_sql("1", "phone", _prefix("c2")), _hist_sql("3", "phone", _prefix("c1")), _hist_sql("1", "date", _shape_sql("c6")), _hist_sql("3", "verified", "c3"), _hist_sql("2", "status", "c4"), _hist_sql("2", "rate", _UNIT)]


@query("profile_histograms", f"with {BASE} " + " union all ".join(_HISTS))
def profile_histograms(spark, sf_dir):
    return profile.histograms(raw_all(spark, sf_dir))


_LOOSE = lambda c: rf"case when regexp_full_match(trim({c}), '\S+@\S+\.\S+') then lower(trim({c})) end"
_SHORT = lambda c: f"nullif(right({o.digits(c)}, 10), '')"
_KEYS = "keys as materialized (select * from (" + " union all ".join(
    f"select 'source{t}' as source, '{kind}' as kind, {key} as key, row_no from raw{t}"
    for t, kind, key in (("1", "email", _LOOSE("c1")), ("2", "email", _LOOSE("c0")), ("1", "phone", _SHORT("c2")), ("3", "phone", _SHORT("c1")), ("1", "name", o.name_key("c0")), ("2", "name", o.name_key("c1")), ("3", "name", o.name_key("c0")))
) + ") where key is not null and key <> '')"


@query("duplicate_keys", f"with {BASE}, {_KEYS} select source, kind, key, count(*) as n, min(row_no) as first_row, max(row_no) as last_row from keys group by source, kind, key having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return profile.repeated_keys(profile.keys(raw_all(spark, sf_dir)))


@query("duplicate_members", f"with {BASE}, {_KEYS}, held as (select *, count(*) over (partition by source, kind, key) as n from keys) select source, kind, key, row_no from held where n > 1")
def duplicate_members(spark, sf_dir):
    return profile.repeated_members(profile.keys(raw_all(spark, sf_dir)))


@query("key_overlap", f"with {BASE}, {_KEYS}, held as (select kind, key, string_agg(distinct source, '+' order by source) as sources from keys group by kind, key) select kind, sources, count(*) as n from held group by kind, sources")
def key_overlap(spark, sf_dir):
    return profile.overlaps(profile.keys(raw_all(spark, sf_dir)))


@query("name_overlap", f"with {BASE}, {_KEYS} select key from keys where kind = 'name' and source = 'source2' intersect select key from keys where kind = 'name' and source = 'source3'")
def name_overlap(spark, sf_dir):
    return profile.name_only(profile.keys(raw_all(spark, sf_dir)))


@query("unit_split", f"with {BASE}, u as (select {o.ctc('c5')[1]} as unit from raw1) select count(*) filter (where unit = 'lpa') as lakhs, count(*) filter (where unit = 'inr_annual') as rupees, count(*) filter (where unit is null) as neither from u")
def unit_split(spark, sf_dir):
    return profile.unit_split(raw(spark, sf_dir, "source1"))


# signals: each embedding is read as 64 samples at 16 kHz, in frames of 8 by steps of 4

_SIGNAL = "sig as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as s from embeddings)"
_RMS = lambda s: f"sqrt(list_sum(list_transform({s}, lambda v: v * v)) / len({s}))"
_DB = lambda x: f"20 * log10(greatest({x}, {fixed.EPSILON}))"
_LEVELS = "levels as (select vec_id, s, list_transform(range(0, 1 + (len(s) - 8) // 4), lambda i: " + _RMS("s[i * 4 + 1 : i * 4 + 8]") + ") as l from sig)"


def signal(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("s")).withColumn("l", audio.frame_rms(F.col("s"), F.lit(8), F.lit(4)))


@query("signal_rms_db", f"with {_SIGNAL} select vec_id, round({_DB(_RMS('s'))}, 2) as loudness_db from sig")
def signal_rms_db(spark, sf_dir):
    return signal(spark, sf_dir).select("vec_id", F.round(audio.decibels(audio.rms(F.col("s"))), 2).alias("loudness_db"))


@query("signal_peak_db", f"with {_SIGNAL} select vec_id, round({_DB('list_max(list_transform(s, lambda v: abs(v)))')}, 2) as peak_db from sig")
def signal_peak_db(spark, sf_dir):
    return signal(spark, sf_dir).select("vec_id", F.round(audio.decibels(audio.peak(F.col("s"))), 2).alias("peak_db"))


@query("clipping_pct", "with sig as (select vec_id, list_transform(embedding, lambda x: 4 * cast(x as double)) as s from embeddings) " + f"select vec_id, round(len(list_filter(s, lambda v: abs(v) >= {fixed.CLIP_AT})) * 100.0::double / len(s), 4) as clipping_pct from sig")
def clipping_pct(spark, sf_dir):
    loud = F.transform("s", lambda v: v.cast("double") * 4)
    return signal(spark, sf_dir).select("vec_id", audio.clipping_pct(loud).alias("clipping_pct"))


@query("frame_rms", f"with {_SIGNAL}, {_LEVELS} select vec_id, len(l) as frames, round(list_max(l), 6) as loudest, round(list_min(l), 6) as quietest from levels")
def frame_rms(spark, sf_dir):
    return signal(spark, sf_dir).select("vec_id", F.size("l").cast("long").alias("frames"), F.round(F.array_max("l"), 6).alias("loudest"), F.round(F.array_min("l"), 6).alias("quietest"))


_Q = lambda q: f"list_aggregate(l, 'quantile_cont', {q})"
_SNR = f"round({_DB(_Q(0.9))} - {_DB(_Q(0.1))}, 2)"
_SILENT = f"round(len(list_filter(l, lambda v: v < {_Q(0.9)} * pow(10.0, {fixed.SILENCE_DB / 20}))) * 100.0::double / len(l), 2)"


@query("snr_silence", f"with {_SIGNAL}, {_LEVELS} select vec_id, {_SNR} as est_snr_db, {_SILENT} as silence_pct from levels")
def snr_silence(spark, sf_dir):
    return signal(spark, sf_dir).select("vec_id", audio.snr_db(F.col("l")).alias("est_snr_db"), audio.silence_pct(F.col("l")).alias("silence_pct"))


_ZCR = "round(len(list_filter(range(1, len(s)), lambda i: sign(s[i]) <> sign(s[i + 1])))::double / (len(s) - 1), 5)"


@query("zcr", f"with {_SIGNAL} select vec_id, {_ZCR} as zcr_mean from sig")
def zcr(spark, sf_dir):
    return signal(spark, sf_dir).select("vec_id", audio.crossings(F.col("s")).alias("zcr_mean"))


_GRADE = f"""graded as (select vec_id, {_SNR} as snr, round({_DB(_RMS('s'))}, 2) as loud, {_SILENT} as silence, {_ZCR} as flat from levels)
, scored as (select vec_id, 100 - case when snr < 10 then 40 when snr < 20 then 15 else 0 end - case when loud < -45 then 30 when loud < -35 then 10 when loud > -8 then 15 else 0 end - case when silence > 70 then 25 else 0 end - 30 - case when flat > 0.4 then 15 else 0 end as score from graded)"""


@query("quality_grade", f"with {_SIGNAL}, {_LEVELS}, {_GRADE} select vec_id, case when score >= 80 then 'good' when score >= 55 then 'fair' else 'poor' end as quality_label from scored")
def quality_grade(spark, sf_dir):
    rows = signal(spark, sf_dir)
    # The crossings stand in for flatness, so that SQL can say the same.
    label, _ = audio.grade(F.round(audio.decibels(audio.rms(F.col("s"))), 2), audio.snr_db(F.col("l")), F.lit(0.0), audio.silence_pct(F.col("l")), F.size("s") / 16000.0, F.lit(16.0), audio.crossings(F.col("s")))
    return rows.select("vec_id", label.alias("quality_label"))


def measured_grade() -> Column:
    """Label of (s, l), signals at 16 kHz with their frames' levels, by what each fault
    is measured with in audio.properties()."""
    s, l = F.col("s"), F.col("l")  # noqa: E741
    flatness = F.round(audio.spectral_flatness(s, F.lit(8)), 5)
    return audio.grade(F.round(audio.decibels(audio.rms(s)), 2), audio.snr_db(l), audio.clipping_pct(s), audio.silence_pct(l), F.round(F.size(s) / 16000.0, 3), F.lit(16.0), flatness)[0]


@query("quality_grade_measured")
def quality_grade_measured(spark, sf_dir):
    """quality_grade with clipping and spectral flatness, which its SQL leaves out."""
    return signal(spark, sf_dir).select("vec_id", measured_grade().alias("quality_label"))


@query("spectral_flatness")
def spectral_flatness(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", audio.spectral_flatness("embedding", F.lit(8)).alias("flatness"))


# streaming


@query("stream_events", "select date_trunc('minute', ts) as minute, event_type, count(*) as n from events group by 1, 2")
def stream_events(spark, sf_dir):
    """The event table worked off as a stream with a watermark, so that state holds the
    open minutes only. Each batch writes what it changed under its own number, and the
    last word on a minute counts. Batches are files, here one."""
    import uuid

    from weftline.runtime import shared_dir
    from weftline.streaming.submissions import events_per_minute

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    counted = events_per_minute(stream).select(F.col("window.start").alias("minute"), "event_type", "n")

    def each(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/counts/at={number}")

    q = counted.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    told = spark.read.schema("minute timestamp, event_type string, n long, batch int").option("recursiveFileLookup", "true").parquet(f"{base}/counts")
    return told.groupBy("minute", "event_type").agg(F.max_by("n", "batch").alias("n"))
