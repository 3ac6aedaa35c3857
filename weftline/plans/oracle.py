"""SQL for DuckDB that says independently what each registered query returns."""

from __future__ import annotations

from weftline.functions import fixed
from weftline.plans.derived import BASE, WIDTH


def _map(table: dict[str, str], key: str) -> str:
    return "case " + key + " " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def clean(c: str) -> str:
    return rf"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"


def codes(*pairs: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {when} then '{code}' end" for when, code in pairs) + ")"


def capital(p: str) -> str:
    return f"upper({p}[1:1]) || lower({p}[2:])"


def name(c: str) -> tuple[str, str]:
    s = clean(c)
    parts = f"list_filter(string_split({s}, ' '), lambda p: p <> '' and lower(trim(p, '.')) not in ({_list(fixed.TITLES)}))"
    value = f"case when {s} = '' then '' else coalesce(array_to_string(list_transform({parts}, lambda p: {capital('p')}), ' '), '') end"
    short = f"len(list_filter({parts}, lambda p: regexp_full_match(p, '[A-Za-z]\\.?'))) > 0"
    return value, codes((f"{s} = ''", "MISSING_NAME"), (f"upper({s}) <> lower({s}) and ({s} = upper({s}) or {s} = lower({s}))", "NAME_CASING"), (f"{s} <> '' and {short}", "NAME_ABBREVIATED"))


def name_key(c: str) -> str:
    return f"trim(regexp_replace(lower({clean(c)}), '[^a-z ]', '', 'g'))"


def name_tokens(c: str) -> str:
    return f"list_filter(string_split({name_key(c)}, ' '), lambda t: t <> '')"


EMAIL = fixed.EMAIL_PATTERN


def email(c: str) -> tuple[str, str]:
    s = clean(c)
    sound = f"regexp_matches(lower({s}), '{EMAIL}')"
    return f"case when {sound} then lower({s}) end", codes((f"{s} = ''", "MISSING_EMAIL"), (f"{s} <> lower({s})", "EMAIL_CASING"), (f"{s} <> '' and not {sound}", "EMAIL_MALFORMED"))


def digits(c: str) -> str:
    return rf"regexp_replace(coalesce({c}, ''), '\D', '', 'g')"


def phone(c: str) -> tuple[str, str]:
    s, d = clean(c), digits(c)
    ten = f"case when length({d}) = 12 and {d}[1:2] = '91' then {d}[3:] when length({d}) = 11 and {d}[1:1] = '0' then {d}[2:] when length({d}) = 13 and {d}[1:3] = '091' then {d}[4:] else {d} end"
    sound = f"{s} <> '' and length({ten}) = 10"
    value = f"case when {sound} then '+91' || {ten} end"
    return value, codes((f"{s} = ''", "MISSING_PHONE"), (f"{s} <> '' and length({ten}) <> 10", "PHONE_UNPARSEABLE"), (f"{sound} and {s} <> '+91' || {ten}", "PHONE_FORMAT"), (f"{sound} and ({ten})[1:1] not in ('6', '7', '8', '9')", "PHONE_IMPLAUSIBLE"))


def phone_key(c: str) -> str:
    return f"case when length({digits(c)}) >= 10 then right({digits(c)}, 10) end"


def city(c: str) -> tuple[str, str]:
    s = clean(c)
    known = _map(fixed.CITIES, f"lower({s})")
    title = f"array_to_string(list_transform(regexp_extract_all({s}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: {capital('w')}), '')"
    value = f"case when {s} = '' then null else coalesce({known}, {title}) end"
    return value, codes((f"{s} = ''", "MISSING_CITY"), (f"{s} <> '' and {s} <> {c}", "CITY_WHITESPACE"), (f"{s} <> '' and {known} is null", "CITY_UNKNOWN"), (f"{known} <> {s}", "CITY_VARIANT"))


def date(c: str) -> tuple[str, str]:
    s = clean(c)
    iso, dash, slash, text = (f"regexp_full_match({s}, '{p}')" for p in (r"\d{4}-\d{2}-\d{2}", r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2} [A-Za-z]{3,} \d{4}"))
    part = lambda sep, i: f"try_cast(split_part({s}, '{sep}', {i}) as integer)"
    read = lambda form: f"cast(try_strptime({s}, '{form}') as date)"
    swapped = f"{part('/', 1)} > 12"
    value = f"case when {iso} then {read('%Y-%m-%d')} when {dash} and {part('-', 2)} <= 12 then {read('%d-%m-%Y')} when {slash} and {swapped} then {read('%d/%m/%Y')} when {slash} then {read('%m/%d/%Y')} when {text} then coalesce({read('%d %b %Y')}, {read('%d %B %Y')}) end"
    slash_day = f"case when {swapped} then {part('/', 1)} else {part('/', 2)} end"
    some = f"({value}) is not null"
    return value, codes(
        (f"{s} = ''", "MISSING_DATE"), (f"{dash} and {some}", "DATE_FORMAT_DDMMYYYY"), (f"{slash} and {some}", "DATE_FORMAT_MMDDYYYY"),
        (f"{some} and (({dash} and {part('-', 1)} <= 12) or ({slash} and {slash_day} <= 12))", "DATE_AMBIGUOUS"), (text, "DATE_FORMAT_TEXT"), (f"{s} <> '' and not {some}", "DATE_UNPARSEABLE"), (f"({value}) > date '{fixed.AS_OF}'", "DATE_IN_FUTURE"),
    )


def number(s: str) -> str:
    return rf"case when regexp_full_match({s}, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') then try_cast({s} as double) end"


def ctc(c: str) -> tuple[str, str, str]:
    s = f"replace({clean(c)}, ',', '')"
    v = f"({number(s)})"
    annual = f"case when {v} > 0 then cast(round_even(case when {v} < {fixed.LAKHS_BELOW} then {v} * {fixed.LAKH} else {v} end, 0) as bigint) end"
    unit = f"case when {v} <= 0 then null when {v} < {fixed.LAKHS_BELOW} then 'lpa' when {v} is not null then 'inr_annual' end"
    low, high = fixed.PAY_RANGE
    return annual, unit, codes((f"{s} = ''", "MISSING_CTC"), (f"{s} <> '' and {v} is null", "CTC_UNPARSEABLE"), (f"{v} <= 0", "CTC_NON_POSITIVE"), (f"{v} > 0 and {v} < {fixed.LAKHS_BELOW}", "CTC_UNIT_LAKHS"), (f"({annual}) not between {low} and {high}", "CTC_OUT_OF_RANGE"))


def rate(c: str) -> tuple[str, str, str, str]:
    s = f"replace(lower({clean(c)}), ' ', '')"
    part = lambda i: f"regexp_extract({s}, '{fixed.RATE_PATTERN}', {i})"
    v = f"(({number(part(1))}) * case when {part(2)} = 'k' then 1000 else 1 end)"
    hour = f"case when {part(3)} in ('hr', 'hour') then {v} else {v} / {fixed.HOURS_PER_MONTH} end"
    month = f"case when {part(3)} in ('hr', 'hour') then {v} * {fixed.HOURS_PER_MONTH} else {v} end"
    unit = f"case when {v} is null then null when {part(3)} in ('hr', 'hour') then 'per_hour' else 'per_month' end"
    return f"round_even({hour}, 2)", f"cast(round_even({month}, 0) as bigint)", unit, codes((f"{s} = ''", "MISSING_RATE"), (f"{s} <> '' and {v} is null", "RATE_UNPARSEABLE"), (f"{v} is not null", "RATE_MIXED_UNITS"), (f"{month} > {fixed.RATE_CONFLICT_ABOVE}", "RATE_SCALE_CONFLICT"))


def whole(c: str) -> tuple[str, str]:
    s = clean(c)
    return f"cast(trunc({number(s)}) as bigint)", codes((f"{s} = ''", "MISSING_INT"), (f"{s} <> '' and ({number(s)}) is null", "INT_UNPARSEABLE"))


def real(c: str) -> tuple[str, str]:
    s, (low, high) = clean(c), fixed.EXPERIENCE_RANGE
    v = number(s)
    return v, codes((f"{s} = ''", "MISSING_FLOAT"), (f"{s} <> '' and ({v}) is null", "FLOAT_UNPARSEABLE"), (f"({v}) not between {low} and {high}", "EXPERIENCE_OUT_OF_RANGE"))


def status(c: str) -> tuple[str, str]:
    s = clean(c)
    known = f"lower({s}) in ({_list(fixed.STATUSES)})"
    return f"nullif(lower({s}), '')", codes((f"{s} = ''", "MISSING_STATUS"), (f"{s} <> '' and not {known}", "STATUS_UNKNOWN"), (f"{known} and lower({s}) <> {s}", "STATUS_CASING"))


def flag(c: str) -> tuple[str, str]:
    s = clean(c)
    v = f"case when lower({s}) in ({_list(fixed.TRUE_WORDS)}) then 1 when lower({s}) in ({_list(fixed.FALSE_WORDS)}) then 0 end"
    return v, codes((f"{s} = ''", "MISSING_BOOL"), (f"{s} <> '' and ({v}) is null", "BOOL_UNPARSEABLE"), (f"({v}) is not null and {s} not in ('Yes', 'No')", "BOOL_VARIANT"))


def skill_tokens(c: str) -> str:
    return f"list_filter(list_transform(string_split({clean(c)}, ','), lambda t: {clean('t')}), lambda t: t <> '')"


def skill_list(c: str) -> str:
    """In order, each once: a list keeps what no earlier place holds."""
    named = f"list_transform({skill_tokens(c)}, lambda t: coalesce({_map(fixed.SKILLS, 'lower(t)')}, t))"
    return f"list_filter({named}, lambda v, i: list_position({named}, v) = i)"


def skills(c: str) -> tuple[str, str]:
    s, tokens, made = clean(c), skill_tokens(c), skill_list(c)
    unknown = f"array_to_string(list_transform(list_filter({tokens}, lambda t: {_map(fixed.SKILLS, 'lower(t)')} is null), lambda t: 'SKILL_UNKNOWN'), ',')"
    return f"array_to_string({made}, '|')", f"concat_ws(',', case when {s} = '' then 'MISSING_SKILLS' end, case when {s} <> '' and len({made}) <> len({tokens}) then 'SKILL_DUPLICATE' end, nullif({unknown}, ''))"


def lcs(a: str, b: str) -> str:
    inner = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, jj: list_append(acc, case when substr({a}, ii[1], 1) = substr({b}, jj[1], 1) then prev[jj[1]] + 1 else greatest(prev[jj[1] + 1], acc[jj[1]]) end), [0::bigint])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda prev, ii: {inner}, list_transform(range(0, length({b}) + 1), lambda z: 0::bigint))[length({b}) + 1]"


def indel(a: str, b: str) -> str:
    return f"case when length({a}) + length({b}) = 0 then 100.0::double when {a} = '' or {b} = '' then 0.0 else 200.0::double * {lcs(a, b)} / (length({a}) + length({b})) end"


def sort_tokens(k: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({k}, ' '), lambda t: t <> '')), ' ')"


# rows after repair

_CELLS = {s: [f"c{i}" for i in range(n)] for s, n in WIDTH.items()}


def _shape(source: str, header: list[str]) -> str:
    n, t = WIDTH[source], source[-1]
    cells = _CELLS[source]
    given = lambda f: "[" + ", ".join(f.format(c=c) for c in cells) + "][1:width]"
    head = "[" + ", ".join(f"'{h.strip().lower()}'" for h in header) + "]"
    filled = ", ".join(f"coalesce({c}, '') as {c}" for c in cells)
    out = f"""shape{t} as (
  select row_no, width, {filled}, {given("coalesce({c}, '')")} as cells_raw,
    case when len(list_filter({given("trim(coalesce({c}, ''))")}, lambda x: x <> '')) = 0 then 'blank' when {given("lower(trim(coalesce({c}, '')))")} = {head} then 'header' else 'row' end as kind
  from raw{t}
)"""
    if source == "source2":
        seen = " ".join(f"when regexp_matches({clean(c)}, '{EMAIL}') then {i}" for i, c in enumerate(cells))
        turned = ", ".join(f"case shift {' '.join(f'when {k} then {cells[(i + k) % n]}' for k in range(n))} end as {c}" for i, c in enumerate(cells))
        out += f""", turned{t} as (
  select row_no, width, kind, cells_raw, case when kind = 'row' then coalesce(case {seen} end, 0) else 0 end as shift, {', '.join(cells)} from shape{t}
), fixed{t} as (select row_no, width, kind, cells_raw, shift, {turned} from turned{t})"""
    else:
        out += f", fixed{t} as (select *, 0 as shift from shape{t})"
    fold = "{c}" if source == "source1" else "lower({c})"
    key = " || chr(31) || ".join(fold.format(c=f"trim({c})") for c in cells)
    reject = f"when {clean('c1')} = '' then 'rejected' " if source == "source2" else ""
    out += f""", first{t} as (select min(row_no) as first_row, {key} as same from fixed{t} where kind = 'row' group by all)
, parsed{t} as (
  select f.*, first_row, case when kind <> 'row' then 'skipped' when row_no > first_row then 'duplicate_row' {reject}else 'ingested' end as status
  from fixed{t} f left join first{t} g on f.kind = 'row' and g.same = {key.replace('trim(c', 'trim(f.c')}
)"""
    return out


HEADERS = {
    "source1": ["Full Name", "Email", "Phone", "City", "Experience (Years)", "Current CTC", "Applied Date", "Skills"],
    "source2": ["email_id", "worker_name", "rate", "location", "status", "skill_tags"],
    "source3": ["Name", "Phone Number", "City", "Verified", "Projects Completed"],
}
PARSED = ",\n".join(_shape(s, HEADERS[s]) for s in WIDTH)

FIELDS = {
    "1": [("name", name("c0")), ("email", email("c1")), ("phone", phone("c2")), ("city", city("c3")), ("experience_years", real("c4")), ("ctc", (None, ctc("c5")[2])), ("applied_date", date("c6")), ("skills", skills("c7"))],
    "2": [("email", email("c0")), ("name", name("c1")), ("rate", (None, rate("c2")[3])), ("city", city("c3")), ("gig_status", status("c4")), ("skills", skills("c5"))],
    "3": [("name", name("c0")), ("phone", phone("c1")), ("city", city("c2")), ("contact_verified", flag("c3")), ("projects_completed", whole("c4"))],
}

RECORDS = f"""rec as (
  select 'source1' as source, 1 * 281474976710656 + row_no as ord, row_no, {name('c0')[0]} as name, {email('c1')[0]} as email, {phone('c2')[0]} as phone, {city('c3')[0]} as city, {clean('c0')} as raw_name, {skill_list('c7')} as skills,
    {real('c4')[0]} as experience_years, {ctc('c5')[0]} as current_ctc_inr, {date('c6')[0]} as applied_date, null::bigint as gig_rate_inr_month, null::varchar as gig_status, null::integer as contact_verified, null::bigint as projects_completed
  from parsed1 where status = 'ingested'
  union all
  select 'source2', 2 * 281474976710656 + row_no, row_no, {name('c1')[0]}, {email('c0')[0]}, null, {city('c3')[0]}, {clean('c1')}, {skill_list('c5')}, null, null, null, {rate('c2')[1]}, {status('c4')[0]}, null, null from parsed2 where status = 'ingested' and {name('c1')[0]} <> ''
  union all
  select 'source3', 3 * 281474976710656 + row_no, row_no, {name('c0')[0]}, null, {phone('c1')[0]}, {city('c2')[0]}, {clean('c0')}, null, null, null, null, null, null, {flag('c3')[0]}, {whole('c4')[0]} from parsed3 where status = 'ingested'
), keyed as materialized (
  select *, nullif(lower(trim(email)), '') as ekey, {phone_key('phone')} as pkey, array_to_string({name_tokens('name')}, ' ') as nkey, coalesce({name_tokens('name')}[-1], '') as surname from rec
)"""

STRONG = """email_edges as (select first_ord as a, ord as b from (select ord, min(ord) over (partition by ekey) as first_ord from keyed where ekey is not null) where ord <> first_ord)
, phone_edges as (select first_ord as a, ord as b from (select ord, min(ord) over (partition by pkey) as first_ord from keyed where pkey is not null) where ord <> first_ord)
, edges as materialized (select a, b from email_edges union select a, b from phone_edges union select b, a from email_edges union select b, a from phone_edges)
, reach as (select ord as node, ord as root from keyed union select e.b, r.root from reach r join edges e on e.a = r.node where r.root < e.b)
, placed as materialized (select k.*, component from keyed k join (select node, min(root) as component from reach group by node) on node = ord)"""

PRIORITY = "case source when 'source1' then 0 when 'source3' then 1 else 2 end"

GOLDEN = f"""names as materialized (
  select component, arg_min(name, [-len(list_filter({name_tokens('name')}, lambda t: length(t) > 1)), -length(name), {PRIORITY}, ord]) as full_name from placed group by component
), mails as (
  select p.component, email, min([{PRIORITY}, ord]) as spot, any_value(full_name) as full_name from placed p join names n on n.component = p.component where email is not null group by p.component, email
), scored as (
  select *, replace(array_to_string({name_tokens('full_name')}, ' '), ' ', '') as key, regexp_replace(lower(split_part(email, '@', 1)), '[^a-z]', '', 'g') as letters from mails
), best_mail as (
  select component, arg_min(email, [-round({indel('key', 'letters')}, 9), length(split_part(email, '@', 1))::double, spot[1]::double, spot[2]::double]) as primary_email from scored group by component
), best_phone as (select component, arg_min(phone, [{PRIORITY}, ord]) as primary_phone from placed where phone is not null group by component
), votes as (select component, city, count(*) as votes, min([ord, {PRIORITY}]) as first from placed where city is not null group by component, city
), best_city as (select component, arg_min(city, [-votes, first[2], first[1]]) as city from votes group by component
), own as (
  select component, cast(count(distinct source) as integer) as source_count, cast(max((source = 'source1')::int) as integer) as in_source1, cast(max((source = 'source2')::int) as integer) as in_source2, cast(max((source = 'source3')::int) as integer) as in_source3 from placed group by component
), last_of as (select *, row_number() over (partition by component, source order by row_no desc) as back from placed
), person as materialized (
  select row_number() over (order by o.component) as person_id, o.component, full_name, primary_email, primary_phone, bc.city, source_count, in_source1, in_source2, in_source3,
    l1.current_ctc_inr, strftime(l1.applied_date, '%Y-%m-%d') as applied_date, l2.gig_rate_inr_month, l2.gig_status, l3.contact_verified, l3.projects_completed
  from own o join names n on n.component = o.component left join best_mail bm on bm.component = o.component left join best_phone bp on bp.component = o.component left join best_city bc on bc.component = o.component
    left join last_of l1 on l1.component = o.component and l1.source = 'source1' and l1.back = 1 left join last_of l2 on l2.component = o.component and l2.source = 'source2' and l2.back = 1
    left join last_of l3 on l3.component = o.component and l3.source = 'source3' and l3.back = 1
)"""


def over(*parts: str) -> str:
    return "with recursive " + ",\n".join([BASE.strip(), *parts]) + "\n"


def scalar(source: str, value: str, code: str | None = None) -> str:
    more = f", {code} as codes" if code else ""
    return f"with {BASE} select row_no, {value} as value{more} from raw{source[-1]}"


def issue_rows() -> str:
    """(source, row_no, code) of every finding about rows."""
    found = []
    for t, cols in FIELDS.items():
        for _, (_, code) in cols:
            found.append(f"select 'source{t}' as source, row_no, unnest(string_split({code}, ',')) as code from parsed{t} where status in ('ingested', 'rejected')")
        kinds = [("kind = 'blank'", "BLANK_ROW"), ("kind = 'header'", "REPEATED_HEADER"), (f"kind = 'row' and width <> {WIDTH[f'source{t}']}", "COLUMN_COUNT_MISMATCH"), ("shift > 0", "COLUMN_SHIFT"), ("status = 'duplicate_row'", "EXACT_DUPLICATE_ROW")]
        found += [f"select 'source{t}', row_no, '{code}' from parsed{t} where {when}" for when, code in kinds]
    found.append(f"select 'source3', row_no, 'NO_JOIN_KEY' from parsed3 where status = 'ingested' and ({phone('c1')[0]}) is null")
    return "found as materialized (select * from (" + " union all ".join(found) + ") where code <> '')"


SEVERITY = {
    "high": "MISSING_NAME EMAIL_MALFORMED PHONE_UNPARSEABLE DATE_UNPARSEABLE DATE_IN_FUTURE CTC_UNPARSEABLE CTC_NON_POSITIVE RATE_UNPARSEABLE RATE_SCALE_CONFLICT BOOL_UNPARSEABLE INT_UNPARSEABLE FLOAT_UNPARSEABLE REPEATED_HEADER COLUMN_COUNT_MISMATCH EXACT_DUPLICATE_ROW COLUMN_SHIFT EXPERIENCE_OUT_OF_RANGE NO_JOIN_KEY".split(),
    "medium": "NAME_CASING NAME_ABBREVIATED EMAIL_CASING PHONE_IMPLAUSIBLE CITY_UNKNOWN DATE_AMBIGUOUS CTC_OUT_OF_RANGE STATUS_UNKNOWN BLANK_ROW".split(),
}
SEVERITY_SQL = f"case when code in ({_list(SEVERITY['high'])}) then 'high' when code in ({_list(SEVERITY['medium'])}) then 'medium' else 'low' end"
