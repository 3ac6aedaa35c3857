"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of text that one step of a Python worker holds at most (one
#: longer text is a step of its own).
STEP_ROWS, STEP_BYTES = 512, 4_000_000


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices bounded by rows and by bytes of one string column."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= STEP_ROWS or held + n > STEP_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)


def remainder(column, modulus: int):
    """crc32 of the column as text, modulo a number; null where the column is null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, under the operator's own names, so that extra columns of
    the caller, whatever they are called, never meet those made here."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def with_columns(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])
