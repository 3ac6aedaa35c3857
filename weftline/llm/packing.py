"""Packing: length buckets that waste least padding, and token-budget batches in them.

A dynamic programme over the global histogram of lengths chooses the bucket
boundaries; inside each bucket, rows in key order fill batches up to a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import narrow
from weftline.runtime import materialize, table

#: Buckets at most, and tokens (with padding) of a batch.
BUCKETS, BUDGET = 8, 16_384


def optimal(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` buckets, ascending, with the least padding.

    padding(i, j) of one bucket for the lengths i..j is what they lack to the longest.
    cost[b][j] = min over i of cost[b-1][i-1] + padding(i, j): every split of the
    sorted lengths into b runs, hence an optimum. For one b the sum is a line in
    lengths[j] for each i, whose slopes fall with i, so the lower hull of the lines
    gives each minimum, in O(buckets * lengths) steps on exact whole numbers. Of equal
    optima the one with fewest buckets, then with the earliest cut."""
    order = np.argsort(lengths)
    v, c = [int(x) for x in np.asarray(lengths)[order]], [int(x) for x in np.asarray(counts)[order]]
    n = len(v)
    if not n:
        return []
    rows, tokens = [0], [0]
    for x, m in zip(v, c):
        rows.append(rows[-1] + m)
        tokens.append(tokens[-1] + x * m)
    cost = [v[j] * rows[j + 1] - tokens[j + 1] for j in range(n)]
    cuts = []
    best, used = cost[-1], 1
    for b in range(2, min(buckets, n) + 1):
        now, cut = [0] * n, [0] * n
        hull: list[tuple[int, int, int]] = []  # (rows before, height, i), the first still needed at `at`
        at = 0
        for j in range(b - 1, n):
            r, h = rows[j], cost[j - 1] + tokens[j]
            while len(hull) - at >= 2 and (h - hull[-2][1]) * (hull[-1][0] - hull[-2][0]) <= (hull[-1][1] - hull[-2][1]) * (r - hull[-2][0]):
                hull.pop()
            hull.append((r, h, j))
            while at + 1 < len(hull) and hull[at + 1][1] - v[j] * hull[at + 1][0] < hull[at][1] - v[j] * hull[at][0]:
                at += 1
            now[j], cut[j] = hull[at][1] - v[j] * hull[at][0] + v[j] * rows[j + 1] - tokens[j + 1], hull[at][2]
        cuts.append(cut)
        cost = now
        if cost[-1] < best:
            best, used = cost[-1], b
    bounds, j = [], n - 1
    for b in range(used, 0, -1):
        bounds.append(v[j])
        if b > 1:
            j = cuts[b - 2][j] - 1
    return bounds[::-1]


def pack(df: DataFrame, key: str = "doc_id", length: str = "length", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(key, length, bucket, bucket_length, batch, slot) of every row.

    Null or negative lengths count as 0. bucket
    numbers the chosen boundaries from 0; bucket_length is what a row is padded to. A
    batch holds budget // bucket_length rows (one at least, so a row longer than the
    budget is a batch of its own; rows of a bucket of length 0 count as of length 1).
    Rows fill batches in order of key, as Spark orders its type, ties in order of length;
    a repeated row takes a slot each time. Null keys come first. An empty table gives no
    rows; other columns are left out.

    The histogram of exact lengths is all that reaches the driver: n different lengths
    need n * (n - 1) / 2 tokens, so 30 GB of text have some 100,000 at most. Rows are
    sorted in ranges of bucket and key, equal rows among them dealt to any; a row's place
    in its bucket is its place in the range plus the bucket's rows in the ranges before,
    of which there is one count for each range and bucket."""
    rows = narrow(df, key=key, length=length)
    rows = rows.withColumn("length", F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0)))
    rows = materialize(rows)
    seen = rows.groupBy("length").count().collect()
    bounds = optimal(np.array([r.length for r in seen]), np.array([r["count"] for r in seen]), buckets) or [0]
    number = F.coalesce(*[F.when(F.col("length") <= b, F.lit(i)) for i, b in enumerate(bounds)])
    rows = rows.withColumn("bucket", number).withColumn("bucket_length", F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket") + 1))

    order = ["bucket", "key", "length", "tie"]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    sorted_ = materialize(sorted_.drop("tie").withColumn("at", F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumns({"range": F.shiftright("at", 33).cast("int"), "inside": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted_.groupBy("range", "bucket").agg(F.count("*").alias("n"), F.min("inside").alias("first"))
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range", "bucket", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    placed = sorted_.join(F.broadcast(starts), ["range", "bucket"])  # at most ranges + buckets rows
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    at = F.col("start") + F.col("inside")
    return placed.select(
        F.col("key").alias(key),
        "length",
        F.col("bucket").cast("int").alias("bucket"),
        "bucket_length",
        F.floor(at / fit).cast("long").alias("batch"),
        (at % fit).cast("long").alias("slot"),
    )


def words(text):
    """Tokens of a text: its words, by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pack_documents(documents: DataFrame) -> DataFrame:
    return pack(documents.select("doc_id", words(F.col("text")).alias("length")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket and batch, by its number of words."""
    return pack_documents(table(spark, sf_dir, "documents"))
