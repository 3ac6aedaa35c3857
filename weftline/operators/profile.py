"""The profiler of raw rows: widths, histograms, shapes, repeated keys, overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import fields


def widths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", F.size("cells").alias("width")).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, what: str, value: Column) -> DataFrame:
    return rows.groupBy("source", F.lit(what).alias("what"), value.alias("value")).agg(F.count("*").alias("n"))


def cell(i: int) -> Column:
    return fields.raw_text(F.get("cells", F.lit(i)))


def histograms(raw: dict[str, DataFrame]) -> DataFrame:
    """(source, what, value, n) of cities, phone prefixes, date shapes, flags, statuses
    and rate units, as written."""
    s1, s2, s3 = raw["source1"], raw["source2"], raw["source3"]
    pre = lambda c: F.concat(F.left(fields.digits(c), F.lit(2)), F.lit("/"), F.length(fields.digits(c)).cast("string"))
    parts = [
        histogram(s1, "city", cell(3)), histogram(s2, "city", cell(3)), histogram(s3, "city", cell(2)), histogram(s1, "phone", pre(cell(2))), histogram(s3, "phone", pre(cell(1))),
        histogram(s1, "date", fields.date_shape(cell(6))), histogram(s3, "verified", cell(3)), histogram(s2, "status", cell(4)), histogram(s2, "rate", fields.rate_unit(cell(2))),
    ]
    return reduce(DataFrame.unionByName, parts)


def loose_email(c: Column) -> Column:
    """Anything with an @ and a dot after it."""
    return F.when(F.trim(c).rlike(r"^\S+@\S+\.\S+$"), F.lower(F.trim(c)))


def short_phone(c: Column) -> Column:
    """The last ten digits, or fewer if there are no more; null without any."""
    d = fields.digits(c)
    return F.when(d != "", F.right(d, F.lit(10)))


def keys(raw: dict[str, DataFrame]) -> DataFrame:
    """(source, kind, key, row_no) of every email, phone and name key."""
    s1, s2, s3 = raw["source1"], raw["source2"], raw["source3"]
    pick = lambda df, kind, key: df.select("source", F.lit(kind).alias("kind"), key.alias("key"), "row_no").where("key is not null and key <> ''")
    parts = [
        pick(s1, "email", loose_email(cell(1))), pick(s2, "email", loose_email(cell(0))), pick(s1, "phone", short_phone(cell(2))), pick(s3, "phone", short_phone(cell(1))),
        pick(s1, "name", fields.name_key(cell(0))), pick(s2, "name", fields.name_key(cell(1))), pick(s3, "name", fields.name_key(cell(0))),
    ]
    return reduce(DataFrame.unionByName, parts)


def repeated_keys(all_keys: DataFrame) -> DataFrame:
    """Keys that several rows of a source have: how many, the first and the last."""
    return all_keys.groupBy("source", "kind", "key").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row")).where("n > 1")


def repeated_members(all_keys: DataFrame) -> DataFrame:
    """(source, kind, key, row_no): every row of the keys that several rows of a source
    have, one row each, so that a key of any number of rows gathers nowhere."""
    return all_keys.join(repeated_keys(all_keys).select("source", "kind", "key"), ["source", "kind", "key"], "left_semi")


def overlaps(all_keys: DataFrame) -> DataFrame:
    """(kind, sources, n): distinct keys by the sources that have them."""
    held = all_keys.select("kind", "key", "source").distinct().groupBy("kind", "key").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return held.groupBy("kind", "sources").agg(F.count("*").alias("n"))


def name_only(all_keys: DataFrame) -> DataFrame:
    """Names that source2 and source3 share."""
    names = all_keys.where("kind = 'name'")
    return names.where("source = 'source2'").select("key").intersect(names.where("source = 'source3'").select("key"))


def unit_split(raw: DataFrame, i: int = 5) -> DataFrame:
    v = fields.ctc(cell(i))
    return raw.agg(F.count_if(v.value["unit"] == "lpa").alias("lakhs"), F.count_if(v.value["unit"] == "inr_annual").alias("rupees"), F.count_if(v.value["unit"].isNull()).alias("neither"))
