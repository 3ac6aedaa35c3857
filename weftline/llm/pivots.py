"""Embedding near-dedup: a pivot-permutation index.

Every vector is described by the ordered list of its nearest reference points
(pivots). Inverted lists, one for each label and pivot, retrieve vectors that share
pivots; those that share enough of them are verified by their cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.graph import connected_components
from weftline.llm.common import narrow
from weftline.runtime import discard, materialize, table

LIMIT = 0.98
#: Pivots: EACH for the square root of the rows of the largest label, up to MOST (a bounded
#: sample by hash; 16,384 of 64 dimensions are 8 MB).
EACH, MOST = 4, 16_384
#: A vector's description is its NEAREST pivots, nearest first; it stands in the lists of
#: the first POSTED; two vectors must share SHARED of their descriptions.
NEAREST, POSTED, SHARED = 8, 4, 3
#: Rows of one tile of an inverted list; a label and width with no more has one list.
TILE = 1024


def fit_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """At most `count` unit vectors of the table (v), as rows: a bounded sample by hash.
    Fewer distinct vectors give fewer pivots."""
    rows = vectors.select("v").distinct().orderBy(F.xxhash64("v"), F.col("v").cast("string")).limit(count).collect()
    return _scaled(np.array([r.v for r in rows], float).reshape(len(rows), -1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Unit vectors; first by the largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(column) -> np.ndarray:
    return _scaled(pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float))


def described(units: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Numbers of each unit vector's nearest pivots, nearest first, ties to the smaller."""
    found = np.empty((len(units), min(nearest, len(pivots))), np.int32)
    step = max(1, (1 << 22) // max(1, len(pivots)))
    for at in range(0, len(units), step):
        close = -(units[at : at + step] @ pivots.T)
        some = np.sort(np.argpartition(close, found.shape[1] - 1, axis=1)[:, : found.shape[1]], axis=1)
        order = np.argsort(np.take_along_axis(close, some, axis=1), axis=1, kind="stable")
        found[at : at + step] = np.take_along_axis(some, order, axis=1)
    return found


def _posted(vectors: DataFrame, pivots: dict[int, np.ndarray], nearest: int, posted: int) -> DataFrame:
    """(label, width, pivot, name, tag, near, many, v): a posting of each vector for each of
    its first `posted` pivots. A width without pivots has one list of all."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                widths = pc.list_value_length(part.column("v")).to_numpy()
                for width in np.unique(widths).tolist():
                    own = part.filter(pa.array(widths == width))
                    known = held.value.get(width)
                    near = np.zeros((own.num_rows, 1), np.int32) if known is None else described(_units(own.column("v")), known, nearest)
                    kept = near[:, :posted]
                    row = np.repeat(np.arange(own.num_rows), kept.shape[1])
                    taken = own.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column("label"), pa.array(np.full(len(row), width, np.int32)), pa.array(kept.ravel()), taken.column("name"), taken.column("tag"), pa.array(list(near[row]), pa.list_(pa.int32())), taken.column("many"), taken.column("v")],
                        ["label", "width", "pivot", "name", "tag", "near", "many", "v"],
                    )

    kind, v = (vectors.schema[c].dataType.simpleString() for c in ("label", "v"))
    return vectors.mapInArrow(run, f"label {kind}, width int, pivot int, name long, tag long, near array<int>, many long, v {v}")


def near_classes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", limit: float = LIMIT, each: int = EACH, nearest: int = NEAREST, posted: int = POSTED, shared: int = SHARED) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows of one label link when the cosine of their vectors, in double precision, is
    at least limit; n_links counts the rows linked directly, component_id is the
    smallest key reachable, kept tells whether that is the row itself. Rows whose
    label or key is null, or whose vector is null, empty, zero or holds null or
    non-finite components, link with nothing: 0 links, a class of their own (a null
    key gets a null class and is not kept). Vectors of different widths never link.
    Equal vectors of a label are one node that counts as often as it stands there, so
    a vector that many rows share costs what one does. A key that is repeated counts
    each of its rows, and its vectors, alike or not, are in one class. An empty table gives no rows; other columns are left out.

    Pairs that share fewer than `shared` of their `nearest` pivots, or none of their
    first `posted`, are missed; every link found is verified. With P pivots a list holds
    posted / P of a label's rows, so lists hold posted^2 / P of its pairs. They are cut
    into tiles of about TILE rows, and each two tiles of a list meet in a task of their
    own; a pair counts only in the list of the first pivot it meets by. A tile passes on
    one count and one edge for each of its rows, never its pairs."""
    rows = narrow(df, key=key, v=vector, label=label)
    sound = F.col("key").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    use = rows.where(sound).select("key", "label", "v")
    nodes = materialize(use.groupBy("label", "v").agg(F.count("*").alias("many"), F.min(F.col("key").cast("long")).alias("name")).withColumn("tag", F.xxhash64("v")))
    # Widths with a label of more than a tile: one, in any table of one model's vectors.
    sizes = nodes.groupBy("label", F.size("v").alias("width")).agg(F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("n"))
    units = {r.width: fit_pivots(nodes.where(F.size("v") == r.width), min(MOST, math.ceil(each * math.sqrt(r.n)))) for r in sizes.where(F.col("n") > TILE).collect()}

    postings = materialize(_posted(nodes, units, nearest, posted))
    lists = ["label", "width", "pivot"]
    tiles = postings.groupBy(*lists).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = postings.join(tiles, lists).withColumn("tile", F.pmod(F.xxhash64("name", "tag"), F.col("tiles")).cast("int"))
    # Each row goes to every pair (i, j), i <= j, of tiles that its own belongs to.
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select(*lists, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "name", "tag", "near", "many", "v")
    told = materialize(met.groupBy(*lists, "i", "j").applyInArrow(_verifier(limit, posted, shared), "kind int, name long, tag long, n long"))
    discard(postings)
    total = told.where("kind = 0").groupBy("name", "tag").agg(F.sum("n").alias("n"))
    linked = told.where("kind = 1").select(F.col("name").alias("a"), F.col("n").alias("b"))
    classes = connected_components(linked).withColumnsRenamed({"node": "name", "component": "root"})
    # A node's name is its smallest key, its tag a hash of its vector: where one key has
    # several vectors its nodes share the name, hence the component, but not the links.
    known = nodes.join(total, ["name", "tag"], "left").join(classes, "name", "left")
    known = known.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "name").alias("component_id"))
    out = rows.withColumn("plain", F.when(sound, F.col("v"))).drop("v").join(known.withColumnsRenamed({"label": "l2", "v": "v2"}), (F.col("label") == F.col("l2")) & (F.col("plain") == F.col("v2")), "left")
    root = F.coalesce("component_id", F.col("key").cast("long"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("key") == root, F.lit(False)).alias("kept"))


def _verifier(limit: float, posted: int, shared: int):
    """Of two tiles (or one with itself): for each row how many rows of the other it
    links with (kind 0), and one edge to the smallest of its class here (kind 1).

    Shared pivots are counted first on 64-bit maps of the descriptions, which count too
    many rather than too few, then exactly; cosines are taken of what is left."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches).combine_chunks()
        pivot, i, j = (x.as_py() for x in key[2:])
        tile, name, tag, many = (held[c].to_numpy() for c in ("tile", "name", "tag", "many"))
        units = _units(held["v"].combine_chunks())
        near = pc.list_flatten(held["near"].combine_chunks()).to_numpy().reshape(len(name), -1)
        least_shared = min(shared, near.shape[1])
        bits = np.bitwise_or.reduce(np.uint64(1) << (near % 64).astype(np.uint64), axis=1)
        enough = np.array([len(set(x)) for x in (near % 64).tolist()])
        slack = near.shape[1] - enough  # pivots of a row that fall on one bit
        left = np.flatnonzero(tile == i)
        right = left if i == j else np.flatnonzero(tile == j)
        n = np.zeros(len(name), np.int64)
        least = np.arange(len(name))
        found = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            common = np.bitwise_count(bits[rows][:, None] & bits[right][None, :])
            met = common + np.minimum(slack[rows][:, None], slack[right][None, :]) >= least_shared
            if i == j:
                met &= rows[:, None] < right[None, :]
            a, b = np.nonzero(met)
            a, b = rows[a], right[b]
            for part in range(0, len(a), 1 << 16):  # a bounded number of pairs at a time
                x, y = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
                equal = near[x][:, :, None] == near[y][:, None, :]
                first = np.where(equal[:, :posted, :posted].any(axis=2), near[x][:, :posted], np.iinfo(np.int32).max).min(axis=1)
                kept = (equal.sum(axis=(1, 2)) >= least_shared) & (first == pivot)
                x, y = x[kept], y[kept]
                sure = np.einsum("ij,ij->i", units[x], units[y]) >= limit
                x, y = x[sure], y[sure]
                n += np.bincount(x, many[y], len(name)).astype(np.int64) + np.bincount(y, many[x], len(name)).astype(np.int64)
                found.append((x.astype(np.int32), y.astype(np.int32)))
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            while len(a):  # the smallest row reachable: neighbours' labels, then labels of labels
                before = least.copy()
                np.minimum.at(least, a, before[b])
                np.minimum.at(least, b, before[a])
                least = np.minimum(least, least[least])
                if (least == before).all():
                    break
        counted = np.flatnonzero(n)
        tied = np.flatnonzero(least != np.arange(len(name)))
        kinds = np.repeat(np.array([0, 1], np.int32), [len(counted), len(tied)])
        if len(kinds):
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([name[counted], name[tied]])), pa.array(np.concatenate([tag[counted], tag[tied]])), pa.array(np.concatenate([n[counted], name[least[tied]]]))], ["kind", "name", "tag", "n"])

    return run


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings, within labels, by cosine 0.98."""
    return near_classes(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
with recursive sound as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.98
), reach as (
  select vec_id as node, vec_id as root from embeddings
  union
  select l.b, r.root from reach r join links l on l.a = r.node where r.root < l.b
), roots as (select node, min(root) as component_id from reach group by node)
, degrees as (select a, count(*) as n from links group by a)
select e.vec_id, cast(coalesce(d.n, 0) as bigint) as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join roots r on r.node = e.vec_id left join degrees d on d.a = e.vec_id
"""
