"""Ragged CSV as a data source: rows keep their width, blank lines their number."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import ship


def read_ragged(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, file, row_no, cells) of each file under path, its header left out.

    Records are numbered from 2, blank lines counted, as spreadsheets show them; a byte
    order mark is dropped; quoted fields may hold commas and line breaks. Files are
    read through Spark, from any store; as quoted line breaks forbid splitting, each
    file is one task's work. A path without files raises."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                reader = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""))
                next(reader, None)
                held: list[tuple[int, list[str]]] = []
                for number, row in enumerate(reader, 2):
                    held.append((number, row))
                    if len(held) == 10_000:
                        yield _batch(name, held)
                        held = []
                if held:
                    yield _batch(name, held)

    rows = files.mapInArrow(run, "file string, row_no long, cells array<string>")
    return rows.select(F.lit(source).alias("source"), "file", "row_no", "cells")


def _batch(name: str, held: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([n for n, _ in held], pa.int64()), pa.array([c for _, c in held], pa.list_(pa.string()))], ["file", "row_no", "cells"])
