"""Normalisers against tables of (raw, expected)."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import fields, fuzzy


def one(spark, make, raw, show=lambda v: v):
    made = make(F.col("raw"))
    r = spark.createDataFrame([(raw,)], "raw string").select(show(made.value).alias("value"), made.codes().alias("codes")).first()
    return r.value, set(filter(None, r.codes.split(",")))


def many(spark, make, cases, show=lambda v: v):
    made = make(F.col("raw"))
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(c[0] for c in cases)], "i int, raw string")
    rows = df.select("i", show(made.value).alias("value"), made.codes().alias("codes")).orderBy("i").collect()
    for (raw, value, codes), r in zip(cases, rows):
        assert (r.value, set(filter(None, r.codes.split(",")))) == (value, set(codes.split())), raw


def test_phone(spark):
    many(spark, fields.phone, [
        ("+919123456789", "+919123456789", ""), ("9123456789", "+919123456789", "PHONE_FORMAT"), ("09123456789", "+919123456789", "PHONE_FORMAT"), ("919123456789", "+919123456789", "PHONE_FORMAT"),
        ("+91-91234 56789", "+919123456789", "PHONE_FORMAT"), ("0919123456789", "+919123456789", "PHONE_FORMAT"), ("12345", None, "PHONE_UNPARSEABLE"), ("", None, "MISSING_PHONE"), (None, None, "MISSING_PHONE"),
        ("1123456789", "+911123456789", "PHONE_FORMAT PHONE_IMPLAUSIBLE"), ("phone", None, "PHONE_UNPARSEABLE"),
    ])


def test_email(spark):
    many(spark, fields.email, [("A.b@X.org", "a.b@x.org", "EMAIL_CASING"), ("a@b", None, "EMAIL_MALFORMED"), (" a+t@b.co ", "a+t@b.co", ""), ("sql, react", None, "EMAIL_MALFORMED"), ("", None, "MISSING_EMAIL"), (None, None, "MISSING_EMAIL")])


def test_name(spark):
    many(spark, fields.name, [
        ("ROHIT  verma", "Rohit Verma", ""), ("ROHIT VERMA", "Rohit Verma", "NAME_CASING"), ("rohit", "Rohit", "NAME_CASING"), ("R. Verma", "R. Verma", "NAME_ABBREVIATED"), ("Dr. Asha Rao", "Asha Rao", ""), ("Dr.", "", ""),
        ("", "", "MISSING_NAME"), ("  ", "", "MISSING_NAME"), ("o'BRIEN x", "O'brien X", "NAME_ABBREVIATED"), (None, "", "MISSING_NAME"),
    ])


def test_city(spark):
    many(spark, fields.city, [
        ("Bengaluru", "Bengaluru", ""), ("BLR", "Bengaluru", "CITY_VARIANT"), ("gurugram ", "Gurugram", "CITY_WHITESPACE CITY_VARIANT"), ("New  Delhi", "Delhi", "CITY_WHITESPACE CITY_VARIANT"), ("navi-mumbai", "Navi-Mumbai", "CITY_UNKNOWN"), ("", None, "MISSING_CITY"), (None, None, "MISSING_CITY"),
    ])


def test_date(spark):
    show = lambda v: F.date_format(v, "yyyy-MM-dd")
    many(spark, fields.date, [
        ("2026-08-08", "2026-08-08", ""), ("24-07-2026", "2026-07-24", "DATE_FORMAT_DDMMYYYY"), ("07/13/2026", "2026-07-13", "DATE_FORMAT_MMDDYYYY"), ("7 Jul 2026", "2026-07-07", "DATE_FORMAT_TEXT"), ("7 july 2026", "2026-07-07", "DATE_FORMAT_TEXT"),
        ("07/03/2026", "2026-07-03", "DATE_FORMAT_MMDDYYYY DATE_AMBIGUOUS"), ("13/07/2026", "2026-07-13", "DATE_FORMAT_MMDDYYYY"), ("22-08-2026", "2026-08-22", "DATE_FORMAT_DDMMYYYY DATE_IN_FUTURE"), ("01-13-2026", None, "DATE_UNPARSEABLE"),
        ("31-02-2026", None, "DATE_UNPARSEABLE"), ("soon", None, "DATE_UNPARSEABLE"), ("", None, "MISSING_DATE"), (None, None, "MISSING_DATE"),
    ], show)


def test_money(spark):
    pay = lambda v: F.concat_ws(" ", v["annual"].cast("string"), v["unit"])
    many(spark, fields.ctc, [("4.2", "420000 lpa", "CTC_UNIT_LAKHS"), ("417964", "417964 inr_annual", ""), ("4,17,964", "417964 inr_annual", ""), ("0", "", "CTC_NON_POSITIVE"), ("x", "", "CTC_UNPARSEABLE"), ("nan", "", "CTC_UNPARSEABLE"), ("3d", "", "CTC_UNPARSEABLE"), ("0.5", "50000 lpa", "CTC_UNIT_LAKHS CTC_OUT_OF_RANGE"), ("", "", "MISSING_CTC")], pay)
    rate = lambda v: F.concat_ws(" ", v["hourly"].cast("string"), v["monthly"].cast("string"), v["unit"])
    many(spark, fields.rate, [("1415/hr", "1415.0 226400 per_hour", "RATE_MIXED_UNITS RATE_SCALE_CONFLICT"), ("15k/month", "93.75 15000 per_month", "RATE_MIXED_UNITS"), ("15 K / Mo", "93.75 15000 per_month", "RATE_MIXED_UNITS"), ("1.2.3/hr", "", "RATE_UNPARSEABLE"), ("5/day", "", "RATE_UNPARSEABLE"), ("", "", "MISSING_RATE")], rate)


def test_enumerations_and_numbers(spark):
    many(spark, fields.status, [("Active", "active", "STATUS_CASING"), ("active", "active", ""), ("retired", "retired", "STATUS_UNKNOWN"), ("", None, "MISSING_STATUS")])
    many(spark, fields.flag, [("Yes", True, ""), ("y", True, "BOOL_VARIANT"), ("No", False, ""), ("N", False, "BOOL_VARIANT"), ("maybe", None, "BOOL_UNPARSEABLE"), (None, None, "MISSING_BOOL")])
    many(spark, fields.whole, [("3.7", 3, ""), ("-3.7", -3, ""), ("x", None, "INT_UNPARSEABLE"), ("", None, "MISSING_INT"), ("1e99", None, "INT_UNPARSEABLE")])
    many(spark, fields.experience, [("4.2", 4.2, ""), ("77", 77.0, "EXPERIENCE_OUT_OF_RANGE"), ("?", None, "FLOAT_UNPARSEABLE")])


def test_skills(spark):
    show = lambda v: F.array_join(v, "|")
    many(spark, fields.skills, [("n8n, LangChain, rest api", "n8n|LangChain|REST APIs", ""), ("SQL, sql ,React", "SQL|React", "SKILL_DUPLICATE"), ("Rust, sql", "Rust|SQL", "SKILL_UNKNOWN"), (",", "", ""), ("", "", "MISSING_SKILLS")], show)
    assert one(spark, fields.skills, "A1, B2", F.size)[0] == 2


def indel(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_similarity(spark):
    pairs = [("nikhilchopra", "altnikhilchopra"), ("isha chopra", "sneha chopra"), ("", ""), ("a", ""), ("same", "same"), ("abcdef", "badcfe")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", fuzzy.indel_ratio(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()
    for (a, b), r in zip(pairs, rows):
        assert r.v == pytest.approx(indel(a, b))


def test_names_compatible(spark):
    cases = [("R. Verma", "Rohit Verma", True), ("Rohit Verma", "Kavya Verma", False), ("Isha Chopra", "Sneha Chopra", False), ("Verma Rohit", "Rohit Verma", True), ("", "x", False), ("...", "...", False), ("Rohit Vermaa", "Rohit Verma", True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", fuzzy.names_compatible(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()
    assert [r.v for r in rows] == [c[2] for c in cases]


def test_common_subsequence_by_bits():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd é", k=rng.randint(1, 70))) for _ in range(2))
        assert 200.0 * fuzzy.common(a, b) / (len(a) + len(b)) == pytest.approx(indel(a, b))


def test_compatible_pairs_as_the_expression(spark):
    rng = random.Random(4)
    first, last = ("Rohit", "Rohti", "R.", "Kavya", "", "Kavyaa", "Mr."), ("Verma", "Varma", "Vermaa", "Rao", "")
    rows = [(i, *(f"{rng.choice(first)} {rng.choice(last)}".strip() for _ in range(2))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    expected = {r.i for r in df.where(fuzzy.names_compatible(F.col("a"), F.col("b"))).collect()}
    assert {r.i for r in fuzzy.compatible_pairs(df, "a", "b").collect()} == expected
