"""Survivorship: one golden record for each cluster, its child tables, and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import fields, fixed
from weftline.functions.fuzzy import indel_ratio
from weftline.runtime import materialize


def priority(source: str | Column) -> Column:
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(*[F.when(c == s, F.lit(i)) for i, s in enumerate(fixed.SOURCE_PRIORITY)])


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with 1, 2, 3, ... in the order of a column without ties or nulls. Ranges of
    the order are numbered side by side; one row for each range meets in the sum."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.withColumn("_part", part).withColumn("_inside", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_inside") + 1).drop("_at", "_part", "_inside", "_start")


def pick_names(members: DataFrame) -> DataFrame:
    """(component, full_name): most whole tokens, then longest, then by source."""
    full = F.size(F.filter(fields.name_tokens(F.col("name")), lambda t: F.length(t) > 1))
    return members.groupBy("component").agg(F.min_by("name", F.struct(-full, -F.length("name"), priority("source"), "ord")).alias("full_name"))


def pick_emails(members: DataFrame, names: DataFrame) -> DataFrame:
    """(component, primary_email): the address most like the name, then the shortest
    local part, then by source."""
    mails = members.where("email is not null").groupBy("component", "email").agg(F.min(F.struct(priority("source").alias("p"), "ord")).alias("at"))
    key = F.replace(F.array_join(fields.name_tokens(F.col("full_name")), " "), F.lit(" "), F.lit(""))
    local = F.split_part("email", F.lit("@"), F.lit(1))
    letters = F.regexp_replace(F.lower(local), r"[^\p{L}]", "")
    scored = mails.join(names, "component").withColumn("score", indel_ratio(key, letters))
    return scored.groupBy("component").agg(F.min_by("email", F.struct(-F.col("score"), F.length(local), "at.p", "at.ord")).alias("primary_email"))


def pick_cities(members: DataFrame) -> DataFrame:
    """(component, city): most votes, then by the source of the first that has it."""
    votes = members.where("city is not null").groupBy("component", "city").agg(F.count("*").alias("votes"), F.min(F.struct("ord", priority("source").alias("p"))).alias("first"))
    return votes.groupBy("component").agg(F.min_by("city", F.struct(-F.col("votes"), "first.p", "first.ord")).alias("city"))


def pick_phones(members: DataFrame) -> DataFrame:
    return members.where("phone is not null").groupBy("component").agg(F.min_by("phone", F.struct(priority("source"), "ord")).alias("primary_phone"))


def owned(members: DataFrame) -> DataFrame:
    """(component, ...): each field from the last record of the source that owns it,
    null if that record has none; and which sources a person is in."""
    made = []
    for source, names in fixed.OWNED_FIELDS.items():
        made += [F.max_by(n, F.when(F.col("source") == source, F.col("row_no"))).alias(n) for n in names]
    flags = [F.max((F.col("source") == f"source{i}").cast("int")).alias(f"in_source{i}") for i in (1, 2, 3)]
    return members.groupBy("component").agg(F.count_distinct("source").cast("int").alias("source_count"), *flags, *made)


def methods(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(component, match_methods, match_confidence) of clusters that links made."""
    placed = links.join(clusters.withColumnRenamed("ord", "a"), "a").groupBy("component", "method").agg(F.min("confidence").alias("confidence"))
    return placed.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("match_methods"), F.min("confidence").alias("match_confidence"))


def golden(members: DataFrame, links: DataFrame) -> DataFrame:
    """person: members are records() with their component (the cluster's first ord)."""
    names = materialize(pick_names(members))
    p = owned(members).join(names, "component")
    for part in (pick_emails(members, names), pick_phones(members), pick_cities(members), methods(links, members.select("ord", "component"))):
        p = p.join(part, "component", "left")
    p = p.withColumns({"match_methods": F.coalesce("match_methods", F.lit("single_source")), "match_confidence": F.coalesce("match_confidence", F.lit(1.0))})
    p = dense_ids(p, "component", "person_id")
    last = [f for names_ in fixed.OWNED_FIELDS.values() for f in names_]
    return p.select("person_id", "component", "full_name", "primary_email", "primary_phone", "city", *last, "source_count", "in_source1", "in_source2", "in_source3", "match_methods", "match_confidence")


def _first(members: DataFrame, value: str, person: DataFrame) -> DataFrame:
    held = members.where(F.col(value).isNotNull()).groupBy("component", value).agg(F.min_by("source", "ord").alias("source"))
    return held.join(person, "component")


def person_email(members: DataFrame, person: DataFrame) -> DataFrame:
    return _first(members, "email", person.select("component", "person_id", "primary_email")).select("person_id", "email", "source", (F.col("email") == F.col("primary_email")).cast("int").alias("is_primary"))


def person_phone(members: DataFrame, person: DataFrame) -> DataFrame:
    return _first(members, "phone", person.select("component", "person_id", "primary_phone")).select("person_id", "phone", "source", (F.col("phone") == F.col("primary_phone")).cast("int").alias("is_primary"))


def person_alias(members: DataFrame, person: DataFrame) -> DataFrame:
    named = members.withColumn("alias", F.coalesce(F.nullif("raw_name", F.lit("")), "name"))
    return _first(named, "alias", person.select("component", "person_id")).select("person_id", F.col("alias").alias("name"), "source")


def skill_rows(members: DataFrame) -> DataFrame:
    return members.select("component", "source", "ord", F.posexplode("skills").alias("at", "skill"))


def skills(members: DataFrame) -> DataFrame:
    """(skill_id, name): numbered as first seen, person by person."""
    first = skill_rows(members).groupBy("skill").agg(F.min(F.struct("component", "ord", "at")).alias("first"))
    return dense_ids(first, "first", "skill_id").select(F.col("skill_id").cast("bigint").alias("skill_id"), F.col("skill").alias("name"))


def person_skill(members: DataFrame, person: DataFrame, known: DataFrame) -> DataFrame:
    rows = skill_rows(members).select("component", "skill", "source").distinct()
    return rows.join(person.select("component", "person_id"), "component").join(known.withColumnRenamed("name", "skill"), "skill").select("person_id", "skill_id", "source")


def person_full(person: DataFrame, person_skills: DataFrame, known: DataFrame) -> DataFrame:
    """Persons with their skills' names, each once, in order."""
    names = person_skills.join(known, "skill_id").select("person_id", "name").distinct()
    listed = names.groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("skills"))
    return person.join(listed, "person_id", "left")


def merge_findings(members: DataFrame, person: DataFrame) -> DataFrame:
    """(source, row_no, issue_code, severity, field, raw_value, resolved_value): what
    merging a cluster showed, told at its first record. Only distinct values of a
    cluster are gathered."""
    anchor = members.where("ord = component").select("component", F.col("source").alias("at"), F.col("row_no").alias("at_row"))

    def distinct_in_order(value: str, out: str) -> DataFrame:
        d = members.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy("component", value).agg(F.min("ord").alias("o"))
        return d.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))).alias("_all")).select("component", F.transform("_all", lambda x: x["v"]).alias(out))

    cities = members.where("city is not null").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat("source", F.lit("="), "city").alias("v")))).alias("_c"), F.count_distinct("city").alias("_n"))
    cities = cities.where("_n > 1").select("component", F.array_join(F.transform("_c", lambda x: x["v"]), " | ").alias("said_cities"))
    two = members.where("source in ('source1', 'source2') and size(skills) > 0").groupBy("component").agg(F.count("*").alias("_n"), F.min_by("skills", "ord").alias("_a"), F.max_by("skills", "ord").alias("_b")).where("_n = 2")
    two = two.select("component", F.array_sort("_a").alias("_a"), F.array_sort("_b").alias("_b")).where(F.col("_a") != F.col("_b"))
    two = two.select("component", F.concat(F.lit("source1=["), F.array_join("_a", ", "), F.lit("] source2=["), F.array_join("_b", ", "), F.lit("]")).alias("said_skills"))
    all_ = anchor.join(person.select("component", "full_name", F.col("city").alias("won_city"), "primary_email"), "component")
    for part in (distinct_in_order("name", "names"), distinct_in_order("email", "emails"), cities, two):
        all_ = all_.join(part, "component", "left")
    row = lambda when, code, name, raw, resolved, severity: F.when(when, F.struct(F.lit(code).alias("issue_code"), F.lit(severity).alias("severity"), F.lit(name).alias("field"), raw.alias("raw_value"), resolved.cast("string").alias("resolved_value")))
    others = F.concat(F.array("primary_email"), F.filter("emails", lambda e: e != F.col("primary_email")))
    found = F.array_compact(
        F.array(
            row(F.size("names") > 1, "NAME_VARIANTS_MERGED", "full_name", F.array_join("names", " | "), F.lit(None), "low"),
            row(F.col("said_cities").isNotNull(), "CROSS_SOURCE_CITY_CONFLICT", "city", F.col("said_cities"), F.col("won_city"), "medium"),
            row(F.size("emails") > 1, "ALTERNATE_EMAIL", "primary_email", F.array_join(others, " | "), F.col("primary_email"), "low"),
            row(F.size("emails") > 1, "MULTIPLE_EMAILS_ONE_PERSON", "email", F.array_join("emails", " | "), F.col("primary_email"), "high"),
            row(F.col("said_skills").isNotNull(), "SKILL_SET_DIVERGENCE", "skills", F.col("said_skills"), F.lit(None), "medium"),
        )
    )
    return all_.select(F.col("at").alias("source"), F.col("at_row").alias("row_no"), F.inline(found))


def source_records(parsed: DataFrame, members: DataFrame, person: DataFrame) -> DataFrame:
    """The audit trail: every raw row, its digest, its cells as JSON, its person."""
    who = members.select("source", "row_no", "component").join(person.select("component", "person_id"), "component").drop("component")
    audit = parsed.select("source", "row_no", fields.row_digest(F.col("cells")).alias("row_hash"), F.to_json("cells").alias("raw_json"), F.to_json("cells_raw").alias("raw_cells"), "status", "note")
    return audit.join(who, ["source", "row_no"], "left")


def issue_log(parsed: DataFrame, merged: DataFrame | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """(source, row_no, issue_code, severity, field, raw_value, resolved_value) of rows,
    of merges, and of identities left open."""
    rows = parsed.select("source", "row_no", F.inline("issues")).select("source", "row_no", F.col("code").alias("issue_code"), "severity", "field", "raw_value", "resolved_value")
    if merged is not None:
        rows = rows.unionByName(merged)
    if reviewed is not None:
        rows = rows.unionByName(reviewed.select("source", "row_no", F.lit("AMBIGUOUS_IDENTITY").alias("issue_code"), F.lit("high").alias("severity"), F.lit("name+city").alias("field"), F.col("shown").alias("raw_value"), F.lit(None).cast("string").alias("resolved_value")))
    return rows
