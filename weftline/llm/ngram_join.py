"""N-gram Jaccard join: a size-aware heavy-light set similarity join, and its classes.

Sets of word shingles that are alike in at least `threshold` are linked exactly.

* Equal sets are one node from the start, known by a 128-bit hash of the set.
* Every set orders its shingles by one global order, rare before frequent; two sets
  that overlap in t shingles share at least k of the first n - t + k of either.
* Light (small) sets enumerate the k = 2 subsets of that beginning as signatures;
  heavy (large) sets are found through the inverted lists of single shingles (k = 1).
  The boundary is the size at which lists become cheaper, by a cost over the global
  histogram of sizes and the lists that the beginnings of each size meet. Light sets
  that may link with a heavy one are in the lists too.
* A list is not expanded into all its pairs. Each round pairs a list's members with its
  hub, the one that stands in most lists; of its hubs a member keeps the one that it
  meets most often, and these pairs are verified. Components that the links make are
  joined; a list whose members are in one component is done. What is left is searched
  for all pairs of different components that fit in size, share enough signatures and
  meet so early in the global order that the rest of both can hold the overlap; they
  are verified pair by pair, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.graph import connected_components
from weftline.llm.common import narrow, steps
from weftline.runtime import discard, materialize, table

WORDS = 5
#: Similarity as a fraction, so that sizes compare in whole numbers.
THRESHOLD = (75, 100)
#: Shingles held to be frequent, in the global order, at most; a hint that costs speed
#: where it misses, never a link.
FREQUENT = 500_000
#: Shingles that a worker counts together, and sets among them that must share a shingle
#: for it to be counted as frequent.
COUNTED, LOCAL = 1 << 20, 2
#: Bits of a hash by which a set is searched for frequent shingles.
BEGIN = 22
#: Rows of a list, by the count of its shingle, that one task looks at together.
HOT = 1 << 20
#: Rounds of hubs at most before the remaining pairs are verified one by one (a round that
#: links fewer than one in USEFUL of its pairs is the last), and the part of the signatures
#: that a pair must share which it must share with a hub, in the lists where that is the hub.
ROUNDS, USEFUL, PART = 3, 10, 2
#: Bits of a hash that can be summed over any number of rows without passing a long.
MASK = (1 << 28) - 1
#: Slots of the map that tells workers which rows' sets are asked for: so many for each
#: row, and at most (32 MB); more rows are told by a join.
SLOTS_EACH, SLOTS_MAX = 16, 1 << 28


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. A-Z count as a-z; words
    are what stands between spaces and the characters 0x09 to 0x0D. Fewer words than a
    shingle has make one shingle of all; no words make none."""
    said = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, said), np.uint64, len(said))
    width = min(size, len(h))
    n = len(h) - width + 1
    mixed = np.full(n, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def name_of(found: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A set's name (signed, of that many bits) and tail: a 128-bit hash of its shingles."""
    name, tail = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), ">i8")
    return int(name) >> (64 - bits), int(tail)


def least_overlap(n, threshold: tuple[int, int] = THRESHOLD):
    """Fewest shingles that a set of n shares with any set it links with."""
    return np.maximum(1, -(-n * threshold[0] // threshold[1]))


def beginning(n, k: int, threshold: tuple[int, int] = THRESHOLD):
    """Length of the beginning of which two linked sets share k shingles."""
    return np.minimum(n, n - least_overlap(n, threshold) + k)


def boundary(sizes: dict[int, int], met: dict[int, float], threshold: tuple[int, int] = THRESHOLD) -> int:
    """The size up to which sets are light, chosen by cost: 0, or one of the sizes.

    sizes counts the sets of each size; met[n] is the mean number of other rows in a
    list that a posting of a set of n meets. A light set of n costs its 2-subsets, and
    the lists as well if it may link with a heavy one; a heavy set costs, for each
    shingle of its beginning, a posting and the rows it meets, one hub a round at most."""
    n = np.array(sorted(sizes), np.int64)
    if not len(n):
        return 0
    sets = np.array([sizes[x] for x in n.tolist()], float)
    listed = sets * beginning(n, 1, threshold) * (1 + np.minimum(ROUNDS, [met.get(x, 0.0) for x in n.tolist()]))
    pairs = beginning(n, 2, threshold).astype(float)
    light = np.concatenate([[0], np.cumsum(sets * pairs * (pairs - 1) / 2)])
    after = np.concatenate([np.cumsum(listed[::-1])[::-1], [0]])
    at = np.concatenate([[0], n])
    # Sizes from which a set is heavy or may link with one.
    first = np.searchsorted(n * threshold[1], (at + 1) * threshold[0], "left")
    return int(at[np.argmin(light + after[first])])


def _meets_heavy(n: int, light: int, threshold: tuple[int, int]) -> bool:
    return (light + 1) * threshold[0] <= n * threshold[1]


class Frequent:
    """The frequent shingles (sorted), the place of each in the global order, and how
    many sets were counted to hold it."""

    def __init__(self, counts: dict[int, int]):
        self.hashes = np.array(sorted(counts), np.uint64)
        self.counts = np.array([counts[h] for h in self.hashes.tolist()], np.int64)
        self.places = np.empty(len(counts), np.int64)
        self.places[np.lexsort((self.hashes, self.counts))] = np.arange(len(counts))
        # By the first bits of a hash, whether a frequent one begins so.
        self.begins = np.zeros(1 << BEGIN, bool)
        self.begins[self.hashes >> np.uint64(64 - BEGIN)] = True

    def ordered(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set in the global order, those not frequent first, and the counts (0 for those)."""
        maybe = np.flatnonzero(self.begins[found >> np.uint64(64 - BEGIN)])
        at = np.searchsorted(self.hashes, found[maybe])
        late = self.hashes[np.minimum(at, len(self.hashes) - 1)] == found[maybe] if len(self.hashes) else np.zeros(0, bool)
        at, maybe = at[late], maybe[late]
        if not len(maybe):
            return found, np.zeros(len(found), np.int64)
        at = at[np.argsort(self.places[at])]
        return np.concatenate([np.delete(found, maybe), self.hashes[at]]), np.concatenate([np.zeros(len(found) - len(at), np.int64), self.counts[at]])


def signatures(found: np.ndarray, frequent: Frequent, light: int, threshold: tuple[int, int] = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of one set (sorted hashes), how many sets are known to hold each at most
    (0 where that is not known, and few), and each one's place in the global order, of
    a pair that of its later shingle."""
    n = len(found)
    if not n:
        return found, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, counts = frequent.ordered(found)
    parts, held, places = [], [], []
    if n > light or _meets_heavy(n, light, threshold):
        k = beginning(n, 1, threshold)
        parts.append(first[:k])
        held.append(counts[:k])
        places.append(np.arange(k))
    if n <= light:
        k = beginning(n, 2, threshold)
        if k < 2:
            pairs, both, j = first[:k], counts[:k], np.arange(k)
        else:
            i, j = np.triu_indices(k, 1)
            low, high = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            pairs = low * np.uint64(0xD6E8FEB86659FD93) ^ (high + np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xFF51AFD7ED558CCD)
            both = np.minimum(counts[i], counts[j])
        parts.append(pairs ^ np.uint64(0x5555555555555555))
        held.append(both)
        places.append(j)
    return np.concatenate(parts), np.concatenate(held), np.concatenate(places)


def _tally(own: list[np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Of sets counted together: the shingles that LOCAL or more hold, their counts, and
    for each size the other sets that postings of its beginnings, rare first, meet."""
    every = np.concatenate(own)
    every.sort()
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    n = np.diff(starts, append=len(every))
    shared = n > 1
    h, n = every[starts[shared]], n[shared]
    del every, starts, shared
    met: dict[int, int] = {}
    for found in own if len(h) else ():
        size = len(found)
        at = np.minimum(np.searchsorted(h, found), len(h) - 1)
        others = n[at[h[at] == found]] - 1
        alone, k = size - len(others), int(beginning(size, 1, threshold))
        if alone < k:
            others.sort()
            met[size] = met.get(size, 0) + int(others[: k - alone].sum())
    often = n >= LOCAL
    return h[often], n[often], met


#: What the rows of _read() are: texts, frequent shingles, lists met by sizes, and tallies.
TEXT, SHINGLE, MET, TALLY = range(4)


def _read(df: DataFrame, size: int, threshold: tuple[int, int], bits: int) -> DataFrame:
    """One reading of every text: a row (key, n, name, tail) for each, and beside them,
    of the sets that a worker counts together, rows (n, name) of how many hold a
    shingle, of how many other sets the beginnings of a size meet, and of the tally
    itself. Every row is counted; equal texts counted together count once."""
    kind = df.schema["key"].dataType.simpleString()

    def told(key: pa.DataType, what: int, n: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        rows = len(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, what, np.int32)), pa.nulls(rows, key), pa.array(n), pa.array(name), pa.nulls(rows, pa.int64())], ["what", "key", "n", "name", "tail"])

    def tally(key: pa.DataType, own: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, n, met = _tally(list(own.values()), threshold)
        yield told(key, SHINGLE, n.astype(np.int64), h.view(np.int64))
        yield told(key, MET, np.array(list(met), np.int64), np.array(list(met.values()), np.int64))
        yield told(key, TALLY, np.array([1], np.int64), np.array([0], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        own: dict[tuple[int, int], np.ndarray] = {}
        counted = 0
        for batch in steps(batches):
            key = batch.schema.field("key").type
            names: list[int | None] = []
            tails: list[int | None] = []
            sizes: list[int] = []
            for t in batch.column("text").to_pylist():
                found = shingles(t, size)
                sizes.append(len(found))
                if not len(found):
                    names.append(None)
                    tails.append(None)
                    continue
                name = name_of(found, bits)
                names.append(name[0])
                tails.append(name[1])
                if name not in own:
                    own[name] = found
                    counted += len(found)
                    if counted >= COUNTED:
                        yield from tally(key, own)
                        own, counted = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), TEXT, np.int32)), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(tails, pa.int64())], ["what", "key", "n", "name", "tail"])
        if own:
            yield from tally(key, own)

    return df.mapInArrow(run, f"what int, key {kind}, n long, name long, tail long")


def _posted(df: DataFrame, size: int, frequent: Frequent, light: int, threshold: tuple[int, int], renamed: dict[tuple[int, int], int], bits: int) -> DataFrame:
    """(sig, part, name, n, pos): signatures of every row's set, each set once a step, and
    their places in its order. `part` deals the rows of a list too long for one task."""
    held = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sigs, parts, names, sizes, places = [], [], [], [], []
            seen = set()
            for t in batch.column("text").to_pylist():
                found = shingles(t, size)
                if not len(found) or (name := name_of(found, bits)) in seen:
                    continue
                seen.add(name)
                own, many, at = signatures(found, held.value, light, threshold)
                name = renamed.get(name, name[0])
                sigs.append(own)
                places.append(at)
                parts.append(np.where(many < HOT, -1, (name & 0x7FFFFFFF) % (1 + many // HOT)))
                names.append(np.full(len(own), name, np.int64))
                sizes.append(np.full(len(own), len(found), np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(parts).astype(np.int32)), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places).astype(np.int32))], ["sig", "part", "name", "n", "pos"])

    return df.select("text").mapInArrow(run, "sig long, part int, name long, n int, pos int")


def _items(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, renamed: dict[tuple[int, int], int], bits: int) -> DataFrame:
    """(name, items): the shingles of each set that a pair names, from one of its rows.

    Which rows those are, by a hash of the key in a map of slots, is all that is sent to
    the workers. Rows that share a slot with one may bring a set that no pair names,
    or one again; one of each is kept, and a join with the pairs passes over the former.
    Where the map would be too large, rows and keys are joined."""
    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    wanted = materialize(names.join(nodes.select("name", "first"), "name").select("first"))
    many = wanted.count()
    if many * SLOTS_EACH > SLOTS_MAX:
        asked = rows.join(wanted.withColumnRenamed("first", "key"), "key", "left_semi").select(F.lit(0).alias("slot"), "text")
        bitmap = np.array([1], np.int64)
    else:
        slots = 1 << max(16, (many * SLOTS_EACH - 1).bit_length())
        slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(slots)).cast("int")
        words = wanted.select(slot("first").alias("slot")).groupBy(F.expr("slot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits")).toArrow()  # at most slots / 64 rows
        bitmap = np.zeros(slots // 64, np.int64)
        bitmap[words["at"].to_numpy()] = words["bits"].to_numpy()
        asked = rows.select(slot("key").alias("slot"), "text")
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            kept = batch.filter(pa.array((held.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for part in steps(iter([kept])):
                names, items = [], []
                for t in part.column("text").to_pylist():
                    if len(found := shingles(t, size)):
                        name = name_of(found, bits)
                        names.append(renamed.get(name, name[0]))
                        items.append(found.tobytes())
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(items, pa.binary())], ["name", "items"])

    return materialize(asked.mapInArrow(run, "name long, items binary").groupBy("name").agg(F.first("items").alias("items")))


def _verified(pairs: DataFrame, items: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike enough."""
    over, under = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, z in zip(batch.column("x"), batch.column("y")):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(z.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(common * under >= over * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(items.withColumnsRenamed({"name": "a", "items": "x"}), "a").join(items.withColumnsRenamed({"name": "b", "items": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _renamed(nodes: DataFrame) -> dict[tuple[int, int], int]:
    """New names of all but one of the sets whose 64-bit names are the same: of s sets
    some s^2 / 2^65 (three of 10^10)."""
    twice = nodes.groupBy("name").agg(F.count("*").alias("sets")).where("sets > 1")
    again: dict[int, list[int]] = {}
    for r in nodes.join(twice, "name", "left_semi").select("name", "tail").collect():
        again.setdefault(r.name, []).append(r.tail)
    digest = lambda name, tail: int(np.frombuffer(xxhash.xxh3_64_digest(f"{name} {tail}"), ">i8")[0])
    return {(name, tail): digest(name, tail) for name, tails in again.items() for tail in sorted(tails)[1:]}


def _rename(df: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    if not renamed:
        return df.drop("tail")
    given = df.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "name long, tail long, given long")
    return df.join(F.broadcast(given), ["name", "tail"], "left").withColumn("name", F.coalesce("given", "name")).drop("given", "tail")


def link_sets(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, threshold: tuple[int, int] = THRESHOLD, bits: int = 64) -> DataFrame:
    """(key, n_shingles, component_id): the class of every row under the join's links.

    Two rows link when the Jaccard similarity of their sets of word shingles reaches
    threshold[0] / threshold[1]; component_id is the smallest key reachable by links,
    the row's own included. A null or empty text, or one without words, has an empty
    set, 0 shingles, and is a class of its own. Rows with equal texts link; a row
    that is repeated with its key comes out as often as it stands there. Rows with a
    null key get a null class and link nothing. An empty table gives no rows. Other
    columns are left out.

    Shingles are known by 64-bit hashes, sets by 128-bit ones, of which `bits` are the
    name and 64 the tail; sets with one name get names of their own. Texts are read
    several times rather than kept; what is shuffled is a quarter of each set's hashes,
    the sets of those that share enough signatures with another, and pairs."""
    over, under = threshold
    if 2 * over <= under:
        raise ValueError("sets that link have to share more than half")
    rows = narrow(df, key=key, text=text)
    read = materialize(_read(rows, size, threshold, bits))
    sets = read.where(F.col("what") == TEXT).select("key", "n", "name", "tail")
    nodes = materialize(sets.where("name is not null and key is not null").groupBy("name", "tail").agg(F.min("key").alias("first"), F.first("n").alias("n")))
    renamed = _renamed(nodes)
    nodes, sets = _rename(nodes, renamed), _rename(sets, renamed)
    told = read.where(F.col("what") != TEXT).groupBy("what", F.when(F.col("what") == SHINGLE, F.col("name")).otherwise(F.col("n")).alias("of")).agg(F.sum(F.when(F.col("what") == MET, F.col("name")).otherwise(F.col("n"))).alias("n"))
    told = materialize(told)
    frequent = Frequent({r.of & 0xFFFFFFFFFFFFFFFF: r.n for r in told.where(F.col("what") == SHINGLE).orderBy(F.desc("n"), "of").limit(FREQUENT).collect()})  # bounded by FREQUENT
    sizes = {r.n: r.sets for r in nodes.groupBy("n").agg(F.count("*").alias("sets")).collect()}  # n sizes need n^2 / 2 words of text
    beside = {(r.what, r.of): r.n for r in told.where(F.col("what") != SHINGLE).collect()}  # a row for each size
    tallies = beside.get((TALLY, 1), 1)
    met = {n: beside.get((MET, n), 0) * tallies / (sets_ * int(beginning(n, 1, threshold))) for n, sets_ in sizes.items()}
    light = boundary(sizes, met, threshold)

    rows = rows.where("key is not null")
    posted = _posted(rows, size, frequent, light, threshold, renamed, bits)
    every = Window.partitionBy("sig", "part")
    posted = posted.withColumns({"low": F.min("name").over(every), "high": F.max("name").over(every)}).where("low <> high or part >= 0")
    lists = materialize(posted.groupBy("sig", "part", "name").agg(F.first("n").alias("n"), F.first("pos").alias("pos")).drop("part"))

    # Lists with the same members (known by a sum and an exclusive or of hashes) are one
    # list, that which comes first in the global order, as often as there are.
    marks = F.sum(F.xxhash64("name", F.lit(1)).bitwiseAND(F.lit(MASK))), F.bit_xor(F.xxhash64("name", F.lit(2)))
    same = lists.groupBy("sig").agg(marks[0].alias("x"), marks[1].alias("y"), F.sum("pos").alias("pos"))
    same = same.groupBy("x", "y").agg(F.min_by("sig", F.struct("pos", "sig")).alias("sig"), F.count("*").alias("times")).select("sig", "times")
    once = materialize(lists.join(same, "sig"))
    discard(lists)

    def verified(pairs: DataFrame) -> DataFrame:
        items = _items(rows, pairs, nodes, size, renamed, bits)
        found = materialize(_verified(pairs, items, threshold))
        discard(items)
        return found

    links = _links(once, light, threshold, verified)

    if links is not None:
        held = nodes.join(links, "name", "left").select("name", "first", F.coalesce("component", "name").alias("root"))
        least = held.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = held.join(least, "root").select("name", "component_id")
    else:
        classes = nodes.select("name", F.col("first").alias("component_id"))
    out = sets.join(classes, "name", "left")
    own = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _links(lists: DataFrame, light: int, threshold: tuple[int, int], verified: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(name, component) of the sets that link with another, of lists (sig, name, n, pos,
    times); None if none does. verified() keeps those of pairs (a, b) that link."""
    over, under = threshold
    overlap = F.expr(f"((n + m) * {over}L + {over + under - 1}) div {over + under}")

    def sized() -> Column:
        return (F.col("n") * under >= F.col("m") * over) & (F.col("m") * under >= F.col("n") * over)

    def needed() -> Column:
        """Signatures that linked sets of n and m share at least: of two sets in
        single-shingle lists, all that they have in common beyond their shared
        signatures lies behind the beginning of one of them; two light sets share one
        shingle more, and all pairs of those."""
        low = [F.greatest(F.lit(1), F.expr(f"({c} * {over}L + {under - 1}) div {under}")) for c in "nm"]
        must = overlap - F.greatest(*low) + 1
        return F.when(F.greatest("n", "m") <= light, (must + 1) * must / 2).otherwise(must)

    def live(links: DataFrame | None) -> DataFrame:
        """Lists whose members lie in several components, with these."""
        if links is None:
            return lists.withColumn("component", F.col("name"))
        now = lists.join(links.withColumnRenamed("component", "joined"), "name", "left")
        now = now.withColumn("component", F.coalesce("joined", "name")).drop("joined")
        mixed = now.groupBy("sig").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select("sig")
        return now.join(mixed, "sig")

    def counted(now: DataFrame) -> DataFrame:
        """With k: in how many of these lists a set stands."""
        now = materialize(now)
        with_k = materialize(now.join(now.groupBy("name").agg(F.sum("times").alias("k")), "name"))
        discard(now)
        return with_k

    def verify(pairs: DataFrame, links: DataFrame | None) -> tuple[DataFrame | None, bool]:
        """Links and what the pairs add, and whether that was much."""
        pairs = materialize(pairs)
        if pairs.isEmpty():
            return links, False
        found = verified(pairs)
        much = found.count() * USEFUL >= pairs.count()
        both = found if links is None else found.unionByName(links.select(F.col("name").alias("a"), F.col("component").alias("b")))
        return connected_components(both).withColumnRenamed("node", "name"), much

    links = None
    for number in range(ROUNDS):
        now = counted(live(links))
        # After the first round chance gives others a turn.
        weight = F.col("k") * (1024 + F.pmod(F.xxhash64("name", F.lit(number)), F.lit(1024 if number else 1)))
        hub = F.max(F.struct(weight.alias("weight"), "name", "n", "component")).alias("hub")
        met = now.join(now.groupBy("sig").agg(hub), "sig").where("component <> hub.component")
        met = met.select(F.col("name").alias("a"), "n", "k", F.col("hub.name").alias("b"), F.col("hub.n").alias("m"), "times").where(sized() & (F.col("k") >= needed()))
        met = met.groupBy("a", "b").agg(F.sum("times").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
        best = met.where(F.col("shared") * PART >= needed()).groupBy("a").agg(F.max(F.struct("shared", "b")).alias("best"))
        links, much = verify(best.select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct(), links)
        discard(now)
        if not much:
            break

    now = counted(live(links))
    other = now.select("sig", F.col("name").alias("b"), F.col("n").alias("m"), F.col("k").alias("k2"), F.col("pos").alias("pos2"), F.col("component").alias("other"))
    # The first shingle that two linked sets share (of light ones, the second) has the
    # whole overlap at and behind it in both.
    ahead = F.when(F.greatest("n", "m") <= light, 1).otherwise(0) - overlap
    early = (F.col("pos") <= F.col("n") + ahead) & (F.col("pos2") <= F.col("m") + ahead)
    pairs = now.withColumnRenamed("name", "a").join(other, "sig").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & sized() & early & (F.least("k", "k2") >= needed()))
    links, _ = verify(pairs.select("a", "b").distinct(), links)
    discard(now)
    return links


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: five words, similarity 0.75 or more."""
    return link_sets(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with recursive said as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), sets as materialized (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
  from said
), members as materialized (select doc_id, len(s) as n, unnest(s) as x from sets
), links as materialized (
  select a.doc_id as a, b.doc_id as b from members a join members b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach as (
  select doc_id as node, doc_id as root from sets
  union
  select l.b, r.root from reach r join links l on l.a = r.node where r.root < l.b
)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles, min(r.root) as component_id
from sets d join reach r on r.node = d.doc_id group by d.doc_id, len(d.s)
"""
