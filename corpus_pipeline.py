"""A corpus pipeline: drop toxic documents, drop those of no known language, keep one
document of each near-duplicate group, and pack what is left into batches.

Each stage works on all that its predecessor kept. All but the last return the
columns of documents, whatever further columns the table has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, ngram_join, packing, toxicity
from weftline.runtime import materialize, table

#: A document is rejected from this toxicity on, below this posterior of a language, and
#: below this evidence for it (0: no likelier than among n-grams drawn evenly).
TOXIC, SURE, EVIDENCE = 0.5, 0.5, 0.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, by a lexicon learnt from these documents and
    the labels not held out. Null and empty texts have nothing toxic and stay."""
    lexicon = toxicity.learn_documents(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct("*").alias("row"), "text"), lexicon, key="row")
    return scored.where(F.col("score") < TOXIC).select("row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learnt from those of these documents that are
    not held out. Texts that are null or without a letter, and texts whose best
    language has a posterior below SURE or evidence below EVIDENCE, go: the posterior
    tells the learnt languages apart, the evidence tells text in one of them from text
    in none. Where no document teaches a language, all go."""
    model = langid.fit_documents(docs)
    found = langid.identify(docs.select(F.struct("*").alias("row"), "text"), model, key="row")
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE) & (F.col("evidence") >= EVIDENCE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of the n-gram join, one row of it.
    A document is a doc_id with a text, so that an id which stands on several texts is
    judged in the class of each. Documents without an id are in no class and stay."""
    same = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("said"))
    found = ngram_join.link_sets(docs.where("doc_id is not null").select(same.alias("same"), "text"), key="same")
    found = materialize(found.groupBy("same").agg(F.first("component_id").alias("kept"), F.count("*").alias("n")))
    marked = docs.select(F.struct("*").alias("row"), same.alias("same"))
    left = marked.join(found.where("same <> kept").select("same"), "same", "left_anti")
    repeated = found.where("same = kept and n > 1").select("same")
    once = left.join(repeated, "same", "left_semi").groupBy("same").agg(F.first("row").alias("row"))
    return left.join(repeated, "same", "left_anti").select("row.*").unionByName(once.select("row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document left, by its number of words."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_join", drop_near_duplicates),
    ("packing", pack),
]

#: Learnt models judge in the first two stages, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written before the next reads it.

    An empty table gives no rows. A repeated row is judged as often as it stands there
    by the first two stages, and once by the third; null and empty texts are not toxic,
    are in no language and go with the second stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
