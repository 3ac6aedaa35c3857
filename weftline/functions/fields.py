"""Field normalisers: from a raw cell to a value and the findings about it.

Each takes a string Column and returns a Field: the value, and for every finding that
may arise a struct that is null where it does not. Nothing is repaired silently. All
are expressions over built-in functions, so a row is normalised in one narrow stage.
Nulls count as empty cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import fixed

ISSUE = "struct<code:string,field:string,raw_value:string,action:string,resolved_value:string,severity:string>"


@dataclass
class Field:
    value: Column
    issues: list[Column] = field(default_factory=list)
    #: array<ISSUE>, for a finding that may arise several times in a cell.
    several: Column | None = None

    def found(self) -> Column:
        """array<ISSUE> of the findings that arose."""
        return gather(self.issues) if self.several is None else F.concat(gather(self.issues), self.several)

    def codes(self) -> Column:
        return F.array_join(F.transform(self.found(), lambda x: x["code"]), ",")


def gather(issues: list[Column]) -> Column:
    return F.array_compact(F.array(*issues)) if issues else F.array().cast(f"array<{ISSUE}>")


def issue(when: Column, code: str, name: str, raw, action, resolved=None, severity: str = "medium") -> Column:
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    made = F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"), text(raw).alias("raw_value"), text(action).alias("action"), text(resolved).alias("resolved_value"), F.lit(severity).alias("severity"))
    return F.when(when, made).cast(ISSUE)


def raw_text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clean(c: Column) -> Column:
    """White space, Unicode's included, collapsed to single spaces and trimmed."""
    return F.trim(F.regexp_replace(raw_text(c), r"(?U)\s+", " "))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


# names


def _capital(p: Column) -> Column:
    return F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))


def name(raw: Column) -> Field:
    s = clean(raw)
    parts = F.filter(F.split(s, " "), lambda p: ~F.lower(F.regexp_replace(p, r"^\.+|\.+$", "")).isin(*fixed.TITLES) & (p != ""))
    made = F.array_join(F.transform(parts, _capital), " ")
    cased = F.upper(s) != F.lower(s)
    short = F.exists(parts, lambda p: p.rlike(r"^[A-Za-z]\.?$"))
    return Field(
        F.when(s == "", "").otherwise(made),
        [
            issue(s == "", "MISSING_NAME", "name", raw_text(raw), "no name given", severity="high"),
            issue(cased & ((s == F.upper(s)) | (s == F.lower(s))), "NAME_CASING", "name", s, "shown with capitals; compared without case"),
            issue((s != "") & short, "NAME_ABBREVIATED", "name", s, "initial kept; compared by surname and initial", made),
        ],
    )


def name_key(c: Column) -> Column:
    """Lower-case letters a-z and single spaces only."""
    return F.trim(F.regexp_replace(F.lower(clean(c)), "[^a-z ]", ""))


def name_tokens(c: Column) -> Column:
    return F.filter(F.split(name_key(c), " +"), lambda t: t != "")


def first_name(c: Column) -> Column:
    return F.coalesce(F.try_element_at(name_tokens(c), F.lit(1)), F.lit(""))


def surname(c: Column) -> Column:
    return F.coalesce(F.try_element_at(name_tokens(c), F.lit(-1)), F.lit(""))


# email


def email(raw: Column) -> Field:
    s = clean(raw)
    low = F.lower(s)
    sound = low.rlike(fixed.EMAIL_PATTERN)
    return Field(
        F.when(sound, low),
        [
            issue(s == "", "MISSING_EMAIL", "email", raw_text(raw), "left empty; other keys decide", severity="low"),
            issue(s != low, "EMAIL_CASING", "email", s, "lower-cased", low),
            issue((s != "") & ~sound, "EMAIL_MALFORMED", "email", raw, "rejected; kept in the audit trail", severity="high"),
        ],
    )


def email_key(c: Column) -> Column:
    """Dots and tags stand: they tell mailboxes apart."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def is_email(c: Column) -> Column:
    return clean(c).rlike(fixed.EMAIL_PATTERN)


# phone


def digits(c: Column) -> Column:
    return F.regexp_replace(raw_text(c), r"\D", "")


def phone(raw: Column) -> Field:
    """+91 and ten digits."""
    s = clean(raw)
    d = digits(s)
    ten = F.when((F.length(d) == 12) & d.startswith("91"), F.substring(d, 3, 10)).when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10)).when((F.length(d) == 13) & d.startswith("091"), F.substring(d, 4, 10)).otherwise(d)
    sound = (s != "") & (F.length(ten) == 10)
    made = F.concat(F.lit("+91"), ten)
    return Field(
        F.when(sound, made),
        [
            issue(s == "", "MISSING_PHONE", "phone", raw_text(raw), "left empty", severity="low"),
            issue((s != "") & ~sound, "PHONE_UNPARSEABLE", "phone", raw, "left empty; the row stays", severity="high"),
            issue(sound & (s != made), "PHONE_FORMAT", "phone", raw, "brought to +91 and ten digits", made, "low"),
            issue(sound & ~ten.rlike("^[6-9]"), "PHONE_IMPLAUSIBLE", "phone", raw, "kept; mobile numbers begin with 6 to 9", made),
        ],
    )


def phone_key(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) >= 10, F.right(d, F.lit(10)))


# city


def title_case(c: Column) -> Column:
    """A capital after every character that is no letter."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def city(raw: Column) -> Field:
    s = clean(raw)
    known = lookup(fixed.CITIES, F.lower(s))
    unknown = (s != "") & known.isNull()
    return Field(
        F.when(s == "", None).otherwise(F.coalesce(known, title_case(s))),
        [
            issue(s == "", "MISSING_CITY", "city", raw_text(raw), "left empty", severity="low"),
            issue((s != "") & (s != raw), "CITY_WHITESPACE", "city", F.concat(F.lit("'"), raw, F.lit("'")), "trimmed", s, "low"),
            issue(unknown, "CITY_UNKNOWN", "city", raw, "shown with capitals; not in the list", title_case(s)),
            issue(known != s, "CITY_VARIANT", "city", raw, F.concat(F.lit("read as "), known), known, "low"),
        ],
    )


# dates


def date(raw: Column) -> Field:
    """ISO, D-M-Y, M/D/Y (D/M/Y where only that fits) and day month-name year. An
    impossible date of a known shape is unparseable."""
    s = clean(raw)
    iso, dash, slash, text = s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), s.rlike(r"^\d{1,2} [A-Za-z]{3,} \d{4}$")
    number = lambda sep, i: F.split_part(s, F.lit(sep), F.lit(i)).try_cast("int")
    dash_day, dash_month = number("-", 1), number("-", 2)
    swapped = number("/", 1) > 12
    slash_day = F.when(swapped, number("/", 1)).otherwise(number("/", 2))
    tidy = F.initcap(F.lower(s))
    parsed = (
        F.when(iso, F.try_to_date(s, "yyyy-MM-dd"))
        .when(dash & (dash_month <= 12), F.try_to_date(s, "d-M-yyyy"))
        .when(slash & swapped, F.try_to_date(s, "d/M/yyyy"))
        .when(slash, F.try_to_date(s, "M/d/yyyy"))
        .when(text, F.coalesce(F.try_to_date(tidy, "d MMM yyyy"), F.try_to_date(tidy, "d MMMM yyyy")))
    )
    shown = F.date_format(parsed, "yyyy-MM-dd")
    some = parsed.isNotNull()
    f = "applied_date"
    return Field(
        parsed,
        [
            issue(s == "", "MISSING_DATE", f, raw_text(raw), "left empty", severity="low"),
            issue(dash & some, "DATE_FORMAT_DDMMYYYY", f, raw, "read as day-month-year", shown, "low"),
            issue(slash & some, "DATE_FORMAT_MMDDYYYY", f, raw, "read as month/day/year", shown, "low"),
            issue(some & ((dash & (dash_day <= 12)) | (slash & (slash_day <= 12))), "DATE_AMBIGUOUS", f, raw, "day and month could change places", shown),
            issue(text, "DATE_FORMAT_TEXT", f, raw, "read with a month's name", shown, "low"),
            issue((s != "") & ~some, "DATE_UNPARSEABLE", f, raw, "left empty", severity="high"),
            issue(parsed > F.lit(fixed.AS_OF).cast("date"), "DATE_IN_FUTURE", f, raw, f"kept; after {fixed.AS_OF}", shown, "high"),
        ],
    )


# numbers

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def _number(s: Column) -> Column:
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def ctc(raw: Column) -> Field:
    """struct<annual bigint, unit string>."""
    s = F.replace(clean(raw), F.lit(","), F.lit(""))
    v = _number(s)
    good = v > 0
    lakhs = v < fixed.LAKHS_BELOW
    annual = F.when(good, F.rint(F.when(lakhs, v * fixed.LAKH).otherwise(v))).cast("bigint")
    low, high = fixed.PAY_RANGE
    return Field(
        F.struct(annual.alias("annual"), F.when(good & lakhs, "lpa").when(good, "inr_annual").alias("unit")),
        [
            issue(s == "", "MISSING_CTC", "current_ctc", raw_text(raw), "left empty", severity="low"),
            issue((s != "") & v.isNull(), "CTC_UNPARSEABLE", "current_ctc", raw, "left empty", severity="high"),
            issue(v <= 0, "CTC_NON_POSITIVE", "current_ctc", raw, "left empty", severity="high"),
            issue(good & lakhs, "CTC_UNIT_LAKHS", "current_ctc", raw, "read as lakhs a year", annual, "low"),
            issue(~annual.between(low, high), "CTC_OUT_OF_RANGE", "current_ctc", raw, "kept; outside the plausible range", annual),
        ],
    )


def rate(raw: Column) -> Field:
    """struct<hourly double, monthly bigint, unit string>."""
    s = F.replace(F.lower(clean(raw)), F.lit(" "), F.lit(""))
    part = lambda i: F.regexp_extract(s, fixed.RATE_PATTERN, i)
    v = _number(part(1)) * F.when(part(2) == "k", 1000).otherwise(1)
    hourly = part(3).isin("hr", "hour")
    hour = F.when(hourly, v).otherwise(v / fixed.HOURS_PER_MONTH)
    month = F.when(hourly, v * fixed.HOURS_PER_MONTH).otherwise(v)
    unit = F.when(v.isNotNull() & hourly, "per_hour").when(v.isNotNull(), "per_month")
    shown = F.concat(F.format_string("%.2f", hour), F.lit("/hr | "), F.format_string("%.0f", F.rint(month)), F.lit("/month"))
    return Field(
        F.struct(F.bround(hour, 2).alias("hourly"), F.rint(month).cast("bigint").alias("monthly"), unit.alias("unit")),
        [
            issue(s == "", "MISSING_RATE", "rate", raw_text(raw), "left empty", severity="low"),
            issue((s != "") & v.isNull(), "RATE_UNPARSEABLE", "rate", raw, "left empty", severity="high"),
            issue(v.isNotNull(), "RATE_MIXED_UNITS", "rate", raw, F.concat(F.lit("read "), unit, F.lit(f"; the other by {fixed.HOURS_PER_MONTH} hours a month")), shown, "low"),
            issue(month > fixed.RATE_CONFLICT_ABOVE, "RATE_SCALE_CONFLICT", "rate", raw, "kept; hourly and monthly rates do not agree in scale", F.concat(F.format_string("%.0f", F.rint(month)), F.lit("/month")), "high"),
        ],
    )


def whole(raw: Column, name_: str = "value") -> Field:
    s = clean(raw)
    v = _number(s)
    made = F.when(F.abs(v) < 9e18, v).cast("bigint")
    return Field(made, [issue(s == "", "MISSING_INT", name_, raw_text(raw), "left empty", severity="low"), issue((s != "") & made.isNull(), "INT_UNPARSEABLE", name_, raw, "left empty", severity="high")])


def real(raw: Column, name_: str = "value") -> Field:
    s = clean(raw)
    v = _number(s)
    return Field(v, [issue(s == "", "MISSING_FLOAT", name_, raw_text(raw), "left empty", severity="low"), issue((s != "") & v.isNull(), "FLOAT_UNPARSEABLE", name_, raw, "left empty", severity="high")])


def experience(raw: Column) -> Field:
    found = real(raw, "experience_years")
    low, high = fixed.EXPERIENCE_RANGE
    out = issue(~found.value.between(low, high), "EXPERIENCE_OUT_OF_RANGE", "experience_years", raw, "kept; outside the plausible range", found.value, "high")
    return Field(found.value, [*found.issues, out])


# enumerations


def status(raw: Column) -> Field:
    s = clean(raw)
    low = F.lower(s)
    known = low.isin(*fixed.STATUSES)
    return Field(
        F.nullif(low, F.lit("")),
        [
            issue(s == "", "MISSING_STATUS", "gig_status", raw_text(raw), "left empty", severity="low"),
            issue((s != "") & ~known, "STATUS_UNKNOWN", "gig_status", raw, "kept in lower case", low),
            issue(known & (low != s), "STATUS_CASING", "gig_status", raw, "lower-cased", low, "low"),
        ],
    )


def flag(raw: Column, name_: str = "verified") -> Field:
    """A boolean; empty is unknown, not false."""
    s = clean(raw)
    low = F.lower(s)
    v = F.when(low.isin(*fixed.TRUE_WORDS), True).when(low.isin(*fixed.FALSE_WORDS), False)
    return Field(
        v,
        [
            issue(s == "", "MISSING_BOOL", name_, raw_text(raw), "left unknown", severity="low"),
            issue((s != "") & v.isNull(), "BOOL_UNPARSEABLE", name_, raw, "left unknown", severity="high"),
            issue(v.isNotNull() & ~s.isin("Yes", "No"), "BOOL_VARIANT", name_, raw, "read as a boolean", F.initcap(v.cast("string")), "low"),
        ],
    )


def skills(raw: Column) -> Field:
    """array<string>, known ones by their proper spelling, each once, in order."""
    s = clean(raw)
    tokens = F.filter(F.transform(F.split(s, ","), clean), lambda t: t != "")
    canon = lambda t: lookup(fixed.SKILLS, F.lower(t))
    named = F.transform(tokens, lambda t: F.coalesce(canon(t), t))
    made = F.array_distinct(named)
    strange = F.filter(tokens, lambda t: canon(t).isNull())
    return Field(
        F.when(s == "", F.array().cast("array<string>")).otherwise(made),
        [
            issue(s == "", "MISSING_SKILLS", "skills", raw_text(raw), "no skills", severity="low"),
            issue((s != "") & (F.size(made) != F.size(tokens)), "SKILL_DUPLICATE", "skills", raw, "repeated ones dropped", F.array_join(made, ", "), "low"),
        ],
        F.transform(strange, lambda t: issue(F.lit(True), "SKILL_UNKNOWN", "skills", t, "kept as written", t, "low")),
    )


def row_digest(cells: Column) -> Column:
    return F.sha1(F.array_join(cells, "\x1f", "").cast("binary"))


def category(raw: Column) -> Column:
    """One of the categories, or null."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin(*fixed.CATEGORIES), low)


def date_shape(raw: Column) -> Column:
    s = clean(raw)
    return F.when(s == "", "empty").when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), "YYYY-MM-DD").when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), "D-M-Y").when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), "M/D/Y").when(s.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), "D Month Y").otherwise("other")


def rate_unit(raw: Column) -> Column:
    s = F.lower(clean(raw))
    return F.when(s.rlike("/ *(hr|hour)$"), "hour").when(s.rlike("/ *(mo|month)$"), "month").otherwise("other")
