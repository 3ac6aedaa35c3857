"""Enrichment: a classifier, validation of its answers, and a gate by confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import fixed


def classify(skills: Column) -> tuple[Column, Column]:
    """(category, share) of a comma-separated list: the vocabulary with most hits (the
    first of equals), and its share of all hits; generalist without a hit or below
    the floor."""
    tokens = F.filter(F.transform(F.split(F.lower(F.coalesce(skills, F.lit(""))), ","), lambda t: F.trim(t)), lambda t: t != "")
    tokens = F.array_distinct(tokens)
    hits = {c: F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))) for c, words in fixed.CATEGORY_WORDS.items()}
    total = sum(hits.values(), F.lit(0))
    best = F.greatest(*hits.values())
    share = F.when(total > 0, best / total).otherwise(0.0)
    made = F.coalesce(*[F.when(n == best, F.lit(c)) for c, n in hits.items()])
    return F.when((total == 0) | (share < fixed.SHARE_FLOOR), "generalist").otherwise(made), F.round(share, 2)


def answers(people: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(person_id, category, confidence, reason) for people with skills. `model` takes
    and returns DataFrames, so any batch classifier fits; the rules stand in for it."""
    asked = people.where("skills is not null and skills <> ''")
    if model is not None:
        return model(asked)
    category, share = classify(F.col("skills"))
    return asked.select("person_id", category.alias("category"), share.alias("confidence"), F.lit("rules").alias("reason"))


def validate(found: DataFrame, least: float = fixed.FLOW_CONFIDENCE) -> DataFrame:
    """Answers with accepted and note; a category or confidence out of range becomes
    generalist or 0 and is not accepted."""
    low = F.lower(F.trim("category"))
    known = F.coalesce(low.isin(*fixed.CATEGORIES), F.lit(False))
    c = F.col("confidence").cast("double")
    number = F.coalesce(~F.isnan(c) & c.between(0, 1), F.lit(False))
    note = F.when(~known, "unknown category").when(~number, "no confidence").when(c < least, "below the gate")
    return found.select("person_id", F.when(known, low).otherwise("generalist").alias("category"), F.when(number, c).otherwise(0.0).alias("confidence"), note.isNull().alias("accepted"), note.alias("note"))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those to write and those to review."""
    return checked.where("accepted"), checked.where("not accepted")


def enrich(people: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, limit: int = fixed.BATCH_LIMIT, least: float = fixed.FLOW_CONFIDENCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(written, reviewed, answer): one batch of untagged people through classifier and
    gate. The answer, (ok, tagged, source), comes even if nothing was accepted."""
    batch = people.where("skill_category is null and skills is not null").orderBy("person_id").limit(limit)
    good, rest = split(validate(answers(batch, model), least))
    return good, rest, good.agg(F.lit(True).alias("ok"), F.count("*").alias("tagged"), F.lit("weftline").alias("source"))


def tag_all(people: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None, limit: int = 200, least: float = fixed.SHARE_FLOOR, by: str = "rules") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updates, left for review, counts): untagged people through the classifier, those
    below `least` left for review. updates (person_id, skill_category, confidence,
    tagged_by) are what serve.accepted_categories() takes, once given their time; counts
    has one row (written, skipped). People without skills are answered too."""
    batch = people.where("skill_category is null").orderBy("person_id").limit(limit)
    if model is None:
        category, share = classify(F.col("skills"))
        found = batch.select("person_id", category.alias("category"), share.alias("confidence"))
    else:
        found = model(batch)
    enough = F.coalesce(F.col("confidence") >= least, F.lit(False))
    updates = found.where(enough).select("person_id", F.col("category").alias("skill_category"), "confidence", F.lit(by).alias("tagged_by"))
    return updates, found.where(~enough), found.agg(F.count_if(enough).alias("written"), F.count_if(~enough).alias("skipped"))
