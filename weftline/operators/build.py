"""The whole build: parse, resolve, survive, write, summarise."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import ingest, resolve, survive
from weftline.runtime import materialize


@dataclass
class Build:
    parsed: DataFrame
    members: DataFrame
    resolution: resolve.Resolution
    person: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def build(raw: dict[str, DataFrame]) -> Build:
    """All tables from raw rows (source, row_no, cells) of each source. Where rows name
    their file, row_no in the tables counts through a source's files in the order of
    their paths, and the table source_file tells where each begins."""
    parsed = materialize(ingest.parse_all(raw))
    records = materialize(ingest.records(parsed))
    found = resolve.resolve(records)
    members = materialize(records.join(found.clusters, "ord"))
    person = materialize(survive.golden(members, found.links))
    known = materialize(survive.skills(members))
    tagged = survive.person_skill(members, person, known)
    merged = survive.merge_findings(members, person)
    made = Build(parsed, members, found, person)
    made.tables = {
        "person": person.drop("component"),
        "person_email": survive.person_email(members, person),
        "person_phone": survive.person_phone(members, person),
        "person_name_alias": survive.person_alias(members, person),
        "skill": known,
        "person_skill": tagged,
        "source_record": survive.source_records(parsed, members, person),
        "data_issue": survive.issue_log(parsed, merged, found.reviews),
        "match_review": found.reviews.select("reason", "candidates", F.lit(0).alias("resolved")),
    }
    filed = [ingest.files_of(df) for df in raw.values() if "file" in df.columns]
    if filed:
        made.tables["source_file"] = reduce(DataFrame.unionByName, filed)
    return made


def write(made: Build, path: str) -> None:
    """Each table as Parquet under path, a full rebuild."""
    for name, df in made.tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts."""
    rows, person, issues = tables["source_record"], tables["person"], tables["data_issue"]
    n = F.col("in_source1") + F.col("in_source2") + F.col("in_source3")
    a = rows.agg(F.count("*").alias("rows_read"), F.count_if(F.col("status") == "ingested").alias("rows_ingested"), F.count_if(F.col("status") != "ingested").alias("rows_skipped"))
    b = person.agg(F.count("*").alias("persons"), F.count_if(n == 3).alias("in_all_three"), F.count_if(n == 2).alias("in_two"), F.count_if(n == 1).alias("single_source"))
    c = issues.agg(F.count("*").alias("issues"), F.count_distinct("issue_code").alias("issue_types"))
    d = tables["match_review"].agg(F.count("*").alias("reviews"))
    one = a.withColumn("_", F.lit(1))
    for part in (b, c, d):  # single rows
        one = one.join(part.withColumn("_", F.lit(1)), "_")
    return one.drop("_")
