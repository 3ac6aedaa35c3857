"""Structural repair of ragged rows: blank rows, repeated headers, widths, rotated
columns, exact duplicates and rejects, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.fields import clean, gather, is_email, issue


def _tidy(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(F.trim(c)))


def rotate(cells: Column, at: int) -> Column:
    """The row turned so that its first cell that is an email stands at `at`; the row
    itself if that cell is one already, or none is. `at` counts from 0."""
    first = F.array_position(F.transform(cells, is_email), True)
    shift = F.pmod(first - 1 - at, F.size(cells)).cast("int")
    turned = F.concat(F.slice(cells, shift + 1, F.size(cells)), F.slice(cells, 1, shift))
    return F.when((first > 0) & (shift > 0) & ~is_email(F.get(cells, F.lit(at))), turned).otherwise(cells)


def repair(rows: DataFrame, header: list[str], email_at: int | None = None, name_at: int | None = None, fold_case: bool = True) -> DataFrame:
    """(source, row_no, cells) with cells_raw, status, note and issues.

    status is skipped (blank row, repeated header), duplicate_row, rejected (name_at
    given and that cell without a name) or ingested. cells holds header-wide cells,
    rotated where email_at is given and an email stands elsewhere; skipped rows keep
    theirs as read. Null cells count as empty, a null row as blank. Of equal rows
    (after repair; without case if fold_case; known by their SHA-256) of a source the
    one with the smallest row number stays. Row numbers are those of one row. Copies are
    counted by an aggregation that combines before it shuffles, and only digests that
    several rows have meet the rows again, so a row repeated any number of times gathers
    nowhere."""
    width = len(header)
    raw = F.coalesce(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), F.array().cast("array<string>"))
    rows = rows.withColumn("cells_raw", raw)
    blank = F.forall("cells_raw", lambda c: F.trim(c) == "")
    again = _tidy(F.col("cells_raw")) == F.array(*[F.lit(h.strip().lower()) for h in header])
    rows = rows.withColumn("kind", F.when(blank, "blank").when(again, "header").otherwise("row"))
    wide = F.slice(F.concat("cells_raw", F.array_repeat(F.lit(""), width)), 1, width)
    rows = rows.withColumn("padded", wide)
    rows = rows.withColumn("cells", F.when(F.col("kind") == "row", rotate(F.col("padded"), email_at) if email_at is not None else F.col("padded")).otherwise(F.col("cells_raw")))
    shown = F.transform("cells", lambda c: F.trim(c))
    told = F.array_join(F.transform(shown, F.lower) if fold_case else shown, "\x1f")
    rows = rows.withColumn("digest", F.when(F.col("kind") == "row", F.sha2(told.cast("binary"), 256)))
    first = rows.where("digest is not null").groupBy("source", "digest").agg(F.min("row_no").alias("first_row"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    rows = rows.join(first, ["source", "digest"], "left")
    copy = F.coalesce(F.col("row_no") > F.col("first_row"), F.lit(False))
    status = F.when(F.col("kind") != "row", "skipped").when(copy, "duplicate_row")
    if name_at is not None:
        status = status.when(clean(F.get("cells", F.lit(name_at))) == "", "rejected")
    rows = rows.withColumn("status", status.otherwise("ingested"))
    row = F.col("kind") == "row"
    said = F.concat(F.lit("identical to row "), F.col("first_row").cast("string"))
    found = [
        issue(F.col("kind") == "blank", "BLANK_ROW", "*", "", "skipped"),
        issue(F.col("kind") == "header", "REPEATED_HEADER", "*", F.array_join("cells_raw", ","), "skipped", severity="high"),
        issue(row & (F.size("cells_raw") != width), "COLUMN_COUNT_MISMATCH", "*", F.concat(F.size("cells_raw").cast("string"), F.lit(f" cells for {width}")), "filled up or cut to the header's width", severity="high"),
        issue(row & (F.col("padded") != F.col("cells")), "COLUMN_SHIFT", "*", F.array_join("padded", ","), "turned back by the cell that is an email", F.array_join("cells", ","), "high"),
        issue(copy, "EXACT_DUPLICATE_ROW", "*", said, "dropped", severity="high"),
    ]
    note = F.when(copy, said).when(F.col("status") == "rejected", "no name")
    return rows.select("source", "row_no", "cells", "cells_raw", "status", note.alias("note"), gather(found).alias("issues"))
