"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import narrow, remainder, steps
from weftline.runtime import table

BITS, LONGEST = 15, 3
BUCKETS = 1 << BITS
#: Labelled rows that a model is fitted on at most, those first by a hash of the key;
#: every language keeps its share, as the hash knows nothing of it.
TRAIN_ROWS = 20_000
UNKNOWN = "und"
#: Letters of a text that are counted at a time, and numbers of a batch's sparse rows times
#: languages that are held at a time (one row may be more).
STRETCH, HELD = 1 << 16, 1 << 21

#: Lower-cased letter of each code point of the basic plane, a space for all else.
FOLD = np.full(1 << 16, 32, np.uint32)
FOLD[[c for c in range(1 << 16) if chr(c).isalpha()]] = [ord(chr(c).lower()[0]) for c in range(1 << 16) if chr(c).isalpha()]


def letters(text: str) -> np.ndarray:
    """Code points of a text, lower-cased, with a space for whatever is no letter."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    folded = FOLD[np.minimum(raw, 0xFFFF)]
    if len(high := np.flatnonzero(raw > 0xFFFF)):
        folded[high] = [c if chr(c).isalpha() else 32 for c in raw[high]]
    return folded


def pad(folded: np.ndarray) -> np.ndarray:
    return np.concatenate([[32], folded, [32]]).astype(np.uint32)


def buckets(folded: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Bucket of each n-gram of 1 to LONGEST letters that begins within `starts`. An n-gram that is only spaces
    or holds two spaces in a row goes to bucket BUCKETS, which has no weight; a
    longer n-gram may hold the space before or after a word."""
    space = folded == 32
    found = []
    h = np.zeros(len(folded), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(folded) < n:
            break
        h = h[: len(folded) - n + 1] * np.uint32(0x01000193) + folded[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        void = space[: len(h)] if n == 1 else np.logical_and.reduce([space[i : len(h) + i] for i in range(n)]) | np.logical_or.reduce([space[i : len(h) + i] & space[i + 1 : len(h) + i + 1] for i in range(n - 1)])
        found.append(np.where(void, BUCKETS, mixed.astype(np.int64))[:starts])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and how often each stands there: a sparse row."""
    padded = pad(letters(text))
    counts = np.zeros(BUCKETS + 1, np.int64)
    for at in range(0, len(padded), STRETCH):
        counts += np.bincount(buckets(padded[at : at + STRETCH + LONGEST - 1], STRETCH), minlength=BUCKETS + 1)
    used = np.flatnonzero(counts[:BUCKETS])
    return used, counts[used]


@dataclass
class Model:
    """Languages, and log-probabilities of (bucket, language). A language takes 2^15
    numbers, 256 KB."""

    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, posterior and evidence of each text. The counts of the texts'
        buckets are sparse rows; these times the dense matrix of logs, some rows at a
        time, and the prior are the scores. Evidence is how much likelier, as the mean
        logarithm of an n-gram, the text is in its language than among buckets drawn
        evenly; unlike the posterior it does not grow with the text."""
        names, sure, evidence = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        rows: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            if text and self.languages:
                used, counts = counts_of(text)
                if len(used):
                    rows.append((i, used, counts))
                    size += len(used) * len(self.languages)
            if rows and (size >= HELD or i == len(texts) - 1):
                starts = np.cumsum([0] + [len(used) for _, used, _ in rows[:-1]])
                of, times = np.concatenate([used for _, used, _ in rows]), np.concatenate([counts for *_, counts in rows])
                total = np.add.reduceat(self.logs[of] * times[:, None], starts, axis=0)
                best = (total + self.prior).argmax(axis=1)
                for (at, _, counts), t, b in zip(rows, total, best):
                    scores = t + self.prior
                    names[at], sure[at] = self.languages[b], float(1 / np.exp(scores - scores[b]).sum())
                    evidence[at] = float(t[b] / counts.sum() + np.log(BUCKETS))
                rows, size = [], 0
        return names, sure, evidence


def fit(df: DataFrame, key: str, text: str, lang: str, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most `rows` labelled rows. Null texts or languages are passed
    over, rows with a null key teach; equal rows teach once. The sample is taken by a
    distributed top-k of keys and hashes, ties in order of key, language and hash of the
    text; workers count its buckets per language, which Spark sums, and the driver gets
    one row of at most 2^15 counts for each language. An empty table, or one without
    labels, gives a model without languages."""
    labelled = narrow(df, key=key, text=text, lang=lang).where("text is not null and lang is not null")
    order = [F.xxhash64(F.col("key").cast("string")), "key", "lang", "said"]
    chosen = labelled.select("key", "lang", F.xxhash64("text").alias("said")).distinct().orderBy(*order).limit(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                used, counts = counts_of(t)
                if name not in held:
                    held[name] = np.zeros(BUCKETS + 1, np.int64)
                held[name][used] += counts
                held[name][BUCKETS] += 1  # the texts themselves
        for name, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"])

    # What was chosen, keys and a hash of the text, goes back to the table by a join, so
    # that texts are not sorted and counting runs on many tasks; equal rows teach once.
    said = labelled.withColumn("said", F.xxhash64("text"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("key", "lang", "said")]
    sample = said.alias("x").join(F.broadcast(chosen.alias("y")), same, "left_semi").groupBy("key", "lang", "said").agg(F.min("text").alias("text"))
    summed = sample.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = summed.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    if not found:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    counts = np.zeros((BUCKETS + 1, len(found)))
    for i, r in enumerate(found):
        counts[r.buckets, i] = r.n
    smooth = counts[:BUCKETS] + 0.5
    return Model([r.lang for r in found], np.log(counts[BUCKETS] / counts[BUCKETS].sum()), np.log(smooth / smooth.sum(axis=0)))


def identify(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, evidence): the most probable language of every whole text.

    A text that is null, empty or without any letter is `und` with score and evidence 0,
    as is every text under a model without languages. score is the posterior, evidence
    what Model.score() says; of equally probable languages the first by name is taken. Rows come
    out as they went in, repeated ones too, null keys kept; other columns are left
    out. No shuffle: the model is broadcast, and texts are read in bounded steps."""
    rows = narrow(df, key=key, text=text)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            names, sure, evidence = held.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(evidence, pa.float64())], ["key", "lang_pred", "score", "evidence"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, evidence double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """Rows that never teach: those whose crc32 of the key as text leaves 1 modulo 3."""
    return F.coalesce(remainder(F.col(key), 3) == 1, F.lit(False))


def fit_documents(documents: DataFrame) -> Model:
    return fit(documents.where(~held_out()), "doc_id", "text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those not held out."""
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, fit_documents(documents))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
