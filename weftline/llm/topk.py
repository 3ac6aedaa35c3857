"""Exact top-k search by no-random-access aggregation.

A vector's coordinates are read from one sorted list for each dimension (from the
large end where the query's weight is positive, from the small end where it is
negative). After each depth, what has been read gives every candidate a lower and an
upper bound of its score: a coordinate not yet read is at most what the list stands
at, and at least the list's other end. Reading stops when no outsider's upper bound
reaches the k-th lower bound; the scores of those left are then resolved. Lists are built
for blocks of rows, and the k-th best score of the blocks that a task has resolved is a
lower bound from the start in its next ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import narrow
from weftline.runtime import table

SCALE, TOP = 256, 5
#: Candidates whose lists are built together, queries that are run on them at a time, and
#: blocks that a task goes through one after the other.
BLOCK, QUERIES, RUN = 1024, 256, 8
#: Whole numbers up to here are exact in double precision; scores go up to LONG_MAX.
EXACT, LONG_MAX = 2**53, 2**63 - 1
#: Depths, as shares of a list, at which bounds are taken, and the share of a block that is
#: resolved when no more than it, or a few times k, is left.
DEPTHS, LEFT = (1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 1), 1 / 8


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole-number doubles as sums of limb[i] * 2^(bits * i), each under 2^bits in size."""
    top = int(np.frexp(np.abs(x).max(initial=0))[1])
    found = []
    for i in range(max(0, (top - 1) // bits), -1, -1):
        part = np.trunc(np.ldexp(x, -bits * i))
        x = x - np.ldexp(part, bits * i)
        found.append(part)
    return found[::-1]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (queries by rows) of whole numbers of any size, as Python ints:
    limbs are narrow enough that every sum of their products is exact."""
    bits = (52 - queries.shape[1].bit_length()) // 2
    a, b = limbs(queries, bits), limbs(rows, bits)
    total = np.zeros((len(queries), len(rows)), object)
    for s in range(len(a) + len(b) - 1):
        part = sum((a[i] @ b[s - i].T).astype(np.int64) for i in range(max(0, s - len(b) + 1), min(s, len(a) - 1) + 1))
        total += part.astype(object) * (1 << bits * s)
    return total


def beyond(score: int) -> bytes:
    """Sorts scores of one value of the long column: those past its ends by their size."""
    if -LONG_MAX - 1 <= score <= LONG_MAX:
        return b"\1"
    size = abs(score).to_bytes(300, "big")
    return b"\2" + size if score > 0 else b"\0" + bytes(255 - x for x in size)


class Lists:
    """Sorted lists of one block of integer vectors (rows by dimensions)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order].astype(np.float64), ids[order]
        self.sorted = np.sort(self.vectors, axis=0)

    def bounds(self, queries: np.ndarray, depth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries by rows) when `depth` entries of every list
        have been read from the end that each query's sign asks for. An entry read is
        at or beyond the value that its list stands at, so clipping to that value is
        the upper bound; for the lower, what is unread falls to the other end."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        x = self.vectors[rows]
        n = len(self.sorted)
        high, low = self.sorted[n - depth], self.sorted[depth - 1]
        first, last = self.sorted[0], self.sorted[-1]
        upper = up @ np.maximum(x, high).T
        upper += down @ np.minimum(x, low).T
        lower = up @ np.where(x >= high, x, first).T
        lower += down @ np.where(x <= low, x, last).T
        return lower, upper

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """(query's position, ids, exact scores, depth read) of each query's best k in this
        block, itself left out; ties to the smaller id. known[q] is a score that k other
        rows reach: rows below it are left out, those that equal it are not. Where a sum of
        whole numbers may pass 2^53, up to which doubles are exact, all scores are
        resolved in limbs."""
        n = len(self.ids)
        if float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1] >= EXACT:
            for q in range(len(queries)):
                scores = products(queries[q : q + 1], self.vectors)[0]
                best = heapq.nsmallest(k, np.flatnonzero(self.ids != query_ids[q]).tolist(), key=lambda i: (-scores[i], self.ids[i]))
                if best:
                    yield q, self.ids[best], scores[best], 1.0
            return
        open_ = np.arange(len(queries))
        rows = np.arange(n)
        floor = np.full(len(queries), -np.inf) if known is None else known.copy()
        for share in DEPTHS:
            depth = max(1, int(n * share))
            if not len(open_):
                break
            lower, upper = self.bounds(queries[open_], depth, rows)
            own = self.ids[rows][None, :] == query_ids[open_][:, None]
            lower[own] = -np.inf
            upper[own] = -np.inf
            if len(rows) >= k:
                floor[open_] = np.maximum(floor[open_], -np.partition(-lower, k - 1, axis=1)[:, k - 1])
            left = (upper >= floor[open_][:, None]) & np.isfinite(upper)
            few = left.sum(axis=1)
            done = (few <= max(4 * k, n * LEFT)) | (depth >= n)
            for q in np.flatnonzero(done):
                at = rows[left[q]]
                scores = self.vectors[at] @ queries[open_[q]]
                best = np.lexsort((self.ids[at], -scores))[:k]
                best = best[scores[best] >= floor[open_[q]]]
                yield int(open_[q]), self.ids[at][best], scores[best].astype(np.int64), share
            open_ = open_[~done]
            rows = rows[left[~done].any(axis=0)]  # an outsider of every query is read no further


def _blocks(df: DataFrame, rows: int, salt: int) -> tuple[DataFrame, int]:
    """(block, width, ids, vectors), and how many blocks: rows dealt by width and a hash
    of the id into blocks of about `rows` rows at most, packed as little-endian 64-bit
    integers and, where all components of a block fit, 32-bit ones, else doubles. Ids that repeat may overfill a block, which is then several rows."""
    n = max(1, -(-df.count() // rows))
    dealt = df.withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        for at in range(0, held.num_rows, 2 * rows):
            part = held.slice(at, 2 * rows).combine_chunks()
            ids = part["id"].to_numpy().astype("<i8")
            vectors = pc.list_flatten(part["v"]).to_numpy()
            vectors = vectors.astype("<i4" if np.abs(vectors).max(initial=0) < 2**31 else "<f8")
            yield pa.RecordBatch.from_pydict({"block": pa.array([part["block"][0].as_py()], pa.int32()), "width": pa.array([part["width"][0].as_py()], pa.int32()), "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

    return dealt.withColumn("width", F.size("v")).groupBy("width", "block").applyInArrow(gather, "block int, width int, ids binary, vectors binary"), n


def unpacked(vectors: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(vectors, "<i4" if len(vectors) == 4 * rows * width else "<f8").reshape(rows, width).astype(np.float64)


def whole_numbers(column, scale: int):
    """floor(scale * x) of each component, as a double; null for a vector that is null,
    empty or holds a null, an infinite or a missing number, or one that times scale is
    past what a double holds. Doubles from 2^53 on are whole already."""

    def floor(y):
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    made = F.transform(column, lambda x: floor(x.cast("double") * scale))
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return F.when(sound & (F.size(column) > 0), made)


def search(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, key, score): each query's k best rows by integer inner product.

    Components become floor(scale * x). Rows and queries whose vector is null, empty,
    holds null or non-finite components take no part, nor do null keys; vectors are
    compared with those of their own width. Scores are exact and ranked as such; one
    past the ends of a long is shown as that end. A query's
    own key is no candidate of it, in any of its rows; a key that is repeated stands
    once for each of its rows, and as a query once. Ties go to the smaller key. Fewer
    candidates than k give them all, none gives no row. Other columns are left out.

    Rows and queries are dealt by hash into blocks of bounded size; each pair of blocks
    is searched by itself, so nothing is broadcast, and every search passes on at most
    k rows a query; these meet in a ranking that keeps k before it shuffles. Of several
    vectors of a query's key the first in order is the query's. An empty table gives
    no rows."""
    use = lambda t: narrow(t, id=key, v=vector).select(F.col("id").cast("long").alias("id"), whole_numbers(F.col("v"), scale).alias("v")).where("id is not null and v is not null")
    rows, asked = use(df), use(queries).groupBy("id").agg(F.min("v").alias("v"))
    left, n = _blocks(rows, BLOCK, 1)
    right, _ = _blocks(asked, QUERIES, 2)
    # The stated queries against all rows, block by block: every block of queries is
    # sent to every run of blocks of rows, and runs are dealt evenly to tasks.
    runs = -(-n // RUN)
    left = left.withColumn("run", F.col("block") % runs)
    right = right.select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "width", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = left.repartition(runs, "run", "width").join(right.repartition(runs, "run", "width"), ["run", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lists = None, None
        reached: dict[tuple[int, int], list[int]] = {}  # a query's k best scores here so far
        clamp = lambda s: [max(-LONG_MAX - 1, min(LONG_MAX, int(x))) for x in s]
        for batch in batches:
            for i in range(batch.num_rows):
                width, ids, vectors, q_ids, q_vectors = (batch.column(c)[i].as_py() for c in ("width", "ids", "vectors", "q_ids", "q_vectors"))
                if (width, ids) != last:
                    last, lists = (width, ids), Lists(unpacked(vectors, len(ids) // 8, width), np.frombuffer(ids, "<i8"))
                q = np.frombuffer(q_ids, "<i8")
                keys = [(width, x) for x in q.tolist()]
                known = np.array([reached[x][-1] if len(reached.get(x, ())) == k else -np.inf for x in keys], float)
                out = []
                for at, a, scores, _ in lists.search(unpacked(q_vectors, len(q), width), q, k, known):
                    if len(a):
                        reached[keys[at]] = sorted([*reached.get(keys[at], ()), *scores.tolist()], reverse=True)[:k]
                        out.append((np.full(len(a), q[at]), a, scores))
                if out:
                    asked_, held, scores = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(asked_), pa.array(held), pa.array(clamp(scores), pa.int64()), pa.array([beyond(int(x)) for x in scores], pa.binary())], ["query_id", "id", "score", "beyond"])

    found = pairs.select("width", "ids", "vectors", "q_ids", "q_vectors").mapInArrow(run, "query_id long, id long, score long, beyond binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 50 = 0"))


OP1_SQL = """
with sound as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from sound q join sound c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
