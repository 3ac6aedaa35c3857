"""What the serving surface asks: lists, match checks, submissions, write-back, counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import fields, fixed
from weftline.operators.survive import dense_ids


def list_people(full: DataFrame, untagged: bool = False, limit: int = 200) -> DataFrame:
    """Persons by id, at most 1000; untagged: those with skills and no category."""
    if untagged:
        full = full.where("skill_category is null and skills is not null")
    return full.orderBy("person_id").limit(max(0, min(limit, 1000)))


def list_submissions(submissions: DataFrame, person: DataFrame, limit: int = 100) -> DataFrame:
    joined = submissions.orderBy(F.desc("submission_id")).limit(max(0, min(limit, 1000))).join(person.select("person_id", "full_name"), "person_id", "left")
    return joined.orderBy(F.desc("submission_id"))


def submission_stats(submissions: DataFrame) -> DataFrame:
    return submissions.agg(F.count("*").alias("n"), F.round(F.sum("duration_sec") / 60, 1).alias("minutes"), F.count_if(F.col("quality_label") == "good").alias("good"), F.count_if(F.col("quality_label") == "poor").alias("poor"))


def match_check(probes: DataFrame, person: DataFrame, emails: DataFrame, phones: DataFrame) -> DataFrame:
    """(probe_id, person_id, matched_on, confidence): for each probe (probe_id, name,
    email, phone) the persons found by its email; else by its phone's last ten digits;
    else by its name without case. Keys are joined as they stand, so no scan of
    patterns is needed."""
    p = probes.select("probe_id", fields.email_key(F.col("email")).alias("e"), fields.phone_key(F.col("phone")).alias("p"), F.nullif(F.lower(F.trim("name")), F.lit("")).alias("n"))
    keys = [
        ("e", "email", emails.select(F.lower("email").alias("e"), "person_id").distinct()),
        ("p", "phone", phones.select(fields.phone_key(F.col("phone")).alias("p"), "person_id").distinct()),
        ("n", "name", person.select(F.lower("full_name").alias("n"), "person_id")),
    ]
    hits = None
    for key, told, held in keys:  # a probe goes on to the next key only where it found nobody
        asked = p if hits is None else p.join(hits, "probe_id", "left_anti")
        found = asked.join(held, key).select("probe_id", "person_id", F.lit(told).alias("matched_on"))
        hits = found if hits is None else hits.unionByName(found)
    conf = fields.lookup({k: str(v) for k, v in fixed.CHECK_CONFIDENCE.items()}, F.col("matched_on")).cast("double")
    return hits.select("probe_id", "person_id", "matched_on", conf.alias("confidence"))


def resolve_submitters(submissions: DataFrame, phones: DataFrame) -> DataFrame:
    """submissions (submission_id, submitted_name, submitted_phone) with person_id (the
    smallest that has the phone) and matched_by; without one, matched_by is
    `new_person` and the row is one to add."""
    held = phones.select(fields.phone_key(F.col("phone")).alias("pkey"), "person_id").where("pkey is not null").groupBy("pkey").agg(F.min("person_id").alias("person_id"))
    asked = submissions.withColumn("pkey", fields.phone_key(F.col("submitted_phone")))
    return asked.join(held, "pkey", "left").withColumn("matched_by", F.when(F.col("person_id").isNotNull(), "phone").otherwise("new_person")).drop("pkey")


def new_people(resolved: DataFrame, person: DataFrame) -> tuple[DataFrame, DataFrame]:
    """resolve_submitters() with everyone placed, and the persons to add: one for each
    phone without a person (for each name where there is no phone), numbered after
    those there are, in no source, matched by `audio_app`."""
    mark = F.coalesce(fields.phone_key(F.col("submitted_phone")), F.concat(F.lit("name "), F.coalesce(fields.name_key(F.col("submitted_name")), F.lit(""))))
    open_ = resolved.where("person_id is null").withColumn("mark", mark)
    first = open_.groupBy("mark").agg(F.min("submission_id").alias("submission"), F.min_by("submitted_name", "submission_id").alias("name"), F.min_by("submitted_phone", "submission_id").alias("phone"))
    top = person.agg(F.coalesce(F.max("person_id"), F.lit(0)).alias("top")).withColumn("_", F.lit(1))
    made = dense_ids(first, "submission", "at").withColumn("_", F.lit(1)).join(F.broadcast(top), "_").withColumn("person_id", F.col("top") + F.col("at"))
    people = made.select("person_id", fields.name(F.col("name")).value.alias("full_name"), fields.phone(F.col("phone")).value.alias("primary_phone"), F.lit(0).alias("source_count"), F.lit("audio_app").alias("match_methods"))
    placed = open_.drop("person_id").join(made.select("mark", "person_id"), "mark").select(resolved.columns)
    return resolved.where("person_id is not null").unionByName(placed), people


def submit(properties: DataFrame, forms: DataFrame, phones: DataFrame, person: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions to append, and persons to add: audio.properties() of uploads with
    their forms (path, submission_id, submitted_name, submitted_phone)."""
    resolved = resolve_submitters(properties.join(forms, "path"), phones)
    return new_people(resolved, person)


def append(df: DataFrame, path: str) -> None:
    """Submissions or persons to add, behind those that are there, in a file of their own."""
    df.write.mode("append").parquet(path)


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for a stream: each batch in its own place, so that one that is repeated
    after a failure takes the place of what it wrote before."""

    def each(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def duplicate_uploads(submissions: DataFrame) -> DataFrame:
    """(submission_id, duplicate_of): uploads whose bytes an earlier one had."""
    first = submissions.groupBy("sha256").agg(F.min("submission_id").alias("duplicate_of"))
    return submissions.select("submission_id", "sha256").join(first, "sha256").where("submission_id <> duplicate_of").select("submission_id", "duplicate_of")


def accepted_categories(updates: DataFrame, person: DataFrame) -> DataFrame:
    """updates (person_id, skill_category, confidence, tagged_by, told_at) with status 200,
    404 (no such person) or 422 (no such category), and the category brought to form."""
    known = person.select("person_id", F.lit(True).alias("known"))
    made = updates.join(known, "person_id", "left").withColumn("category", fields.category(F.col("skill_category")))
    return made.withColumn("status", F.when(F.col("category").isNull(), 422).when(F.col("known").isNull(), 404).otherwise(200)).drop("known")


def latest_category(updates: DataFrame, person: DataFrame) -> DataFrame:
    """Persons with the last accepted update, as an overlay: nothing is overwritten."""
    good = accepted_categories(updates, person).where("status = 200")
    last = good.groupBy("person_id").agg(F.max_by(F.struct("category", "confidence", "tagged_by"), F.struct("told_at", "category")).alias("u"))
    return person.join(last, "person_id", "left").select(*[person[c] for c in person.columns], F.col("u.category").alias("skill_category"), F.col("u.confidence").alias("skill_category_conf"), F.col("u.tagged_by").alias("skill_category_by"))


def dashboard(person: DataFrame, issues: DataFrame, reviews: DataFrame, submissions: DataFrame) -> DataFrame:
    """Six counters in one row."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_", F.lit(1))
    parts = [one(person, F.count("*").alias("people"), F.count_if(F.col("source_count") > 1).alias("merged"), F.count_if(F.col("skill_category").isNotNull()).alias("tagged"))]
    parts += [one(issues, F.count("*").alias("issues")), one(reviews, F.count_if(F.col("resolved") == 0).alias("open_reviews")), one(submissions, F.count("*").alias("submissions"))]
    made = parts[0]
    for part in parts[1:]:
        made = made.join(part, "_")
    return made.drop("_")


def first_examples(issues: DataFrame) -> DataFrame:
    """One row for each code: its count, severity, sources, and its first example."""
    order = F.struct("source", "row_no", "field", "raw_value")
    g = issues.groupBy("issue_code", "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min(order).alias("_f"))
    return g.select("issue_code", "severity", "n", "sources", F.col("_f.source").alias("example_source"), F.col("_f.row_no").alias("example_row"), F.left("_f.raw_value", F.lit(120)).alias("example"))


def by_severity(issues: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return issues.groupBy("severity").agg(F.count("*").alias("n")).orderBy(rank)


def markdown_report(issues: DataFrame) -> str:
    """The findings as a Markdown page; what is collected is one row for each code."""
    lines = ["# Findings", "", "| severity | count |", "|---|---|"]
    lines += [f"| {r.severity} | {r.n} |" for r in by_severity(issues).collect()]
    lines += ["", "| code | severity | count | sources | example |", "|---|---|---|---|---|"]
    rows = sorted(first_examples(issues).collect(), key=lambda r: (-r.n, r.issue_code))
    lines += [f"| {r.issue_code} | {r.severity} | {r.n} | {r.sources} | {r.example_source}:{r.example_row} {(r.example or '').replace('|', '/')} |" for r in rows]
    return "\n".join(lines) + "\n"
