"""The three sources: their columns, their repair and their typed records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import fields
from weftline.functions.fields import Field
from weftline.operators.structure import repair

#: Columns of each source by position; names are shown, only their number counts.
HEADERS = {
    "source1": ["Full Name", "Email", "Phone", "City", "Experience (Years)", "Current CTC", "Applied Date", "Skills"],
    "source2": ["email_id", "worker_name", "rate", "location", "status", "skill_tags"],
    "source3": ["Name", "Phone Number", "City", "Verified", "Projects Completed"],
}
REPAIR = {"source1": {"fold_case": False}, "source2": {"email_at": 0, "name_at": 1}, "source3": {}}

#: Columns of a record, with their types; what a source lacks is null.
RECORD = {
    "name": "string", "email": "string", "phone": "string", "city": "string", "raw_name": "string", "skills": "array<string>",
    "experience_years": "double", "current_ctc_inr": "bigint", "ctc_source_unit": "string", "applied_date": "date",
    "gig_rate_inr_hour": "double", "gig_rate_inr_month": "bigint", "gig_rate_unit": "string", "gig_status": "string",
    "contact_verified": "boolean", "projects_completed": "bigint",
}


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


def _source1() -> tuple[dict[str, Column], list[Field]]:
    n, e, p, c = fields.name(_cell(0)), fields.email(_cell(1)), fields.phone(_cell(2)), fields.city(_cell(3))
    x, pay, d, s = fields.experience(_cell(4)), fields.ctc(_cell(5)), fields.date(_cell(6)), fields.skills(_cell(7))
    made = {"name": n, "email": e, "phone": p, "city": c, "experience_years": x, "applied_date": d, "skills": s}
    return {k: f.value for k, f in made.items()} | {"current_ctc_inr": pay.value["annual"], "ctc_source_unit": pay.value["unit"], "raw_name": fields.clean(_cell(0))}, [n, e, p, c, x, pay, d, s]


def _source2() -> tuple[dict[str, Column], list[Field]]:
    e, n, r, c, t, s = fields.email(_cell(0)), fields.name(_cell(1)), fields.rate(_cell(2)), fields.city(_cell(3)), fields.status(_cell(4)), fields.skills(_cell(5))
    made = {"name": n, "email": e, "city": c, "gig_status": t, "skills": s}
    pay = {"gig_rate_inr_hour": r.value["hourly"], "gig_rate_inr_month": r.value["monthly"], "gig_rate_unit": r.value["unit"]}
    return {k: f.value for k, f in made.items()} | pay | {"raw_name": fields.clean(_cell(1))}, [e, n, r, c, t, s]


def _source3() -> tuple[dict[str, Column], list[Field]]:
    n, p, c, v, w = fields.name(_cell(0)), fields.phone(_cell(1)), fields.city(_cell(2)), fields.flag(_cell(3), "contact_verified"), fields.whole(_cell(4), "projects_completed")
    none = Field(F.lit(None), [fields.issue(p.value.isNull(), "NO_JOIN_KEY", "phone", _cell(1), "only name and city can link this row", severity="high")])
    made = {"name": n, "phone": p, "city": c, "contact_verified": v, "projects_completed": w}
    return {k: f.value for k, f in made.items()} | {"raw_name": fields.clean(_cell(0))}, [n, p, c, v, w, none]


READERS = {"source1": _source1, "source2": _source2, "source3": _source3}


def files_of(rows: DataFrame) -> DataFrame:
    """(source, file, rows_before): the files of raw rows (source, file, row_no, cells) in
    the order of their paths, and by how much a row's number in its source is more than
    its number in its file."""
    last = rows.groupBy("source", F.coalesce("file", F.lit("")).alias("file")).agg(F.max("row_no").alias("last"))
    before = Window.partitionBy("source").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("source", "file", F.coalesce(F.sum("last").over(before), F.lit(0)).alias("rows_before"))


def numbered(rows: DataFrame) -> DataFrame:
    """(source, row_no, cells): where rows name their file, they are numbered as if a
    source's files stood one after the other, so that a number is one row's."""
    if "file" not in rows.columns:
        return rows.select("source", "row_no", "cells")
    placed = rows.withColumn("file", F.coalesce("file", F.lit(""))).join(files_of(rows), ["source", "file"])
    return placed.select("source", (F.col("row_no") + F.col("rows_before")).alias("row_no"), "cells")


def parse(rows: DataFrame, source: str) -> DataFrame:
    """Raw rows (source, row_no, cells, and file where there are several) of one source,
    repaired and normalised: the audit columns, issues, and the record's columns (null
    unless ingested)."""
    fixed_rows = repair(numbered(rows), HEADERS[source], **REPAIR[source])
    values, found = READERS[source]()
    read = F.col("status").isin("ingested", "rejected")
    more = F.when(read, F.concat(*[f.found() for f in found])).otherwise(F.array().cast(f"array<{fields.ISSUE}>"))
    out = fixed_rows.select("source", "row_no", "cells", "cells_raw", "status", "note", F.concat("issues", more).alias("issues"), *[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in RECORD.items()])
    # A name that is only a title leaves nothing to go by: source2 rejects it too.
    if source == "source2":
        out = out.withColumn("note", F.when((F.col("status") == "ingested") & (F.col("name") == ""), "no name").otherwise(F.col("note"))).withColumn("status", F.when((F.col("status") == "ingested") & (F.col("name") == ""), "rejected").otherwise(F.col("status")))
    return out


def parse_all(raw: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [parse(raw[s], s) for s in sorted(raw)])


def records(parsed: DataFrame) -> DataFrame:
    """Ingested rows with their identity (rid), their place in the global order (ord)
    and their match keys."""
    number = F.substring("source", -1, 1).cast("bigint")
    r = parsed.where("status = 'ingested'")
    return r.withColumns(
        {
            "rid": F.concat(F.lit("s"), number.cast("string"), F.lit(":"), F.col("row_no").cast("string")),
            "ord": number * F.lit(1 << 48) + F.col("row_no"),
            "ekey": fields.email_key(F.col("email")),
            "pkey": fields.phone_key(F.col("phone")),
            "nkey": F.array_join(fields.name_tokens(F.col("name")), " "),
            "surname": fields.surname(F.col("name")),
        }
    ).drop("cells", "cells_raw", "status", "note", "issues")
