"""Identity resolution in three tiers: equal emails, equal phones, then compatible names
in one city where nothing speaks against it.

Tiers one and two are stars around the first record of a key, and their connected
components. Tier three is greedy: each link accepted changes what later pairs may do.
It is replayed exactly, but only inside groups that strong links and candidate pairs
connect; those groups are independent, so they are replayed side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import fixed
from weftline.functions.fuzzy import compatible_pairs
from weftline.graph import connected_components
from weftline.runtime import materialize


@dataclass
class Resolution:
    """links (a, b, method, confidence, by ord); clusters (ord, component); reviews."""

    links: DataFrame
    clusters: DataFrame
    reviews: DataFrame


def key_links(records: DataFrame, key: str, method: str) -> DataFrame:
    """Every record of a key with the key's first record. The first comes from an
    aggregation that combines before it shuffles, so a hot key gathers nowhere."""
    r = records.where(F.col(key).isNotNull()).select(key, "ord")
    heads = r.groupBy(key).agg(F.min("ord").alias("a"))
    return r.join(heads, key).where("ord <> a").select("a", F.col("ord").alias("b"), F.lit(method).alias("method"), F.lit(fixed.CONFIDENCE[method]).alias("confidence"))


def with_components(records: DataFrame, links: DataFrame) -> DataFrame:
    """records with the smallest ord that links reach."""
    found = connected_components(links.select("a", "b")).withColumnsRenamed({"node": "ord"})
    return records.join(found, "ord", "left").withColumn("component", F.coalesce("component", "ord"))


def alike_names(placed: DataFrame) -> DataFrame:
    """(surname, city, name, name_b): the compatible names of each block, each with
    itself too. Distinct names are compared, and each two of them once."""
    names = placed.where("surname <> '' and city is not null").select("surname", "city", "name").distinct()
    two = names.join(names.withColumnRenamed("name", "name_b"), ["surname", "city"]).where("name < name_b")
    alike = materialize(compatible_pairs(two, "name", "name_b"))
    back = alike.select("surname", "city", F.col("name_b").alias("name"), F.col("name").alias("name_b"))
    return alike.unionByName(back).unionByName(names.withColumn("name_b", F.col("name")))


def block_candidates(placed: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """Pairs (a before b) of one surname and city, of different sources and components,
    with compatible names."""
    alike = alike_names(placed) if alike is None else alike
    r = placed.where("surname <> '' and city is not null")
    left = r.select("surname", "city", "name", F.col("ord").alias("a"), F.col("source").alias("source_a"), F.col("component").alias("comp_a"))
    right = r.select("surname", "city", F.col("name").alias("name_b"), F.col("ord").alias("b"), F.col("source").alias("source_b"), F.col("component").alias("comp_b"))
    pairs = left.join(alike, ["surname", "city", "name"]).join(right, ["surname", "city", "name_b"])
    return pairs.where("a < b and source_a <> source_b and comp_a <> comp_b")


def ambiguous_names(placed: DataFrame, alike: DataFrame | None = None) -> DataFrame:
    """(surname, city, name, appears): names that several records of one source in the
    block are compatible with; appears tells how often in which source."""
    alike = alike_names(placed) if alike is None else alike
    r = placed.where("surname <> '' and city is not null")
    held = r.groupBy("surname", "city", F.col("name").alias("name_b"), "source").agg(F.count("*").alias("n"))
    per = alike.join(held, ["surname", "city", "name_b"]).groupBy("surname", "city", "name", "source").agg(F.sum("n").alias("n"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit("x in "), x["source"])), ", ")
    return per.groupBy("surname", "city", "name").agg(shown.alias("appears"), F.max("n").alias("most")).where("most > 1").drop("most")


REPLAYED = "kind string, a bigint, b bigint, reason string, surname string, city string, block bigint"


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """One independent group in its sequential order. Rows are members (kind m: a is
    the record, b its strong component, with its keys) and pairs (kind p)."""
    parent: dict[int, int] = {}
    emails: dict[int, set] = {}
    phones: dict[int, set] = {}
    for r in pdf[pdf.kind == "m"].itertuples():
        root = parent.setdefault(r.b, r.b)
        parent[r.a] = root
        emails.setdefault(root, set()).update([r.ekey] if isinstance(r.ekey, str) else [])
        phones.setdefault(root, set()).update([r.pkey] if isinstance(r.pkey, str) else [])

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for r in pdf[pdf.kind == "p"].sort_values(["block", "a", "b"]).itertuples():
        x, y = find(r.a), find(r.b)
        if x == y:
            continue
        mails, numbers = emails[x] | emails[y], phones[x] | phones[y]
        if isinstance(r.reason, str):
            reason = r.reason
        elif len(mails) > 1:
            reason = f"{len(mails)} different emails would meet: {sorted(mails)}"
        elif len(numbers) > 1:
            reason = f"{len(numbers)} different phones would meet: {sorted(numbers)}"
        else:
            parent[y], emails[x], phones[x] = x, mails, numbers
            out.append(("link", r.a, r.b, None, r.surname, r.city, r.block))
            continue
        out.append(("review", r.a, r.b, reason, r.surname, r.city, r.block))
    return pd.DataFrame(out, columns=["kind", "a", "b", "reason", "surname", "city", "block"])


def resolve(records: DataFrame) -> Resolution:
    """All tiers over records(). The result does not depend on how rows are dealt."""
    records = materialize(records)
    strong = materialize(key_links(records, "ekey", "email").unionByName(key_links(records, "pkey", "phone")))
    placed = materialize(with_components(records, strong))
    blocks = placed.where("surname <> '' and city is not null").groupBy("surname", "city").agg(F.min("ord").alias("block"))
    alike = alike_names(placed)
    pairs = block_candidates(placed, alike).join(ambiguous_names(placed, alike), ["surname", "city", "name"], "left").join(blocks, ["surname", "city"])
    reason = F.when(F.col("appears").isNotNull(), F.concat(F.lit("ambiguous: '"), F.col("name"), F.lit("' in "), F.col("city"), F.lit(" stands "), F.col("appears")))
    pairs = materialize(pairs.select("a", "b", "comp_a", "comp_b", reason.alias("reason"), "surname", "city", "block"))
    groups = connected_components(pairs, "comp_a", "comp_b").withColumnsRenamed({"node": "b", "component": "group"})
    members = placed.select(F.lit("m").alias("kind"), F.col("ord").alias("a"), F.col("component").alias("b"), "ekey", "pkey").join(groups, "b")
    asked = pairs.join(groups.withColumnRenamed("b", "comp_a"), "comp_a").withColumn("kind", F.lit("p")).drop("comp_a", "comp_b")
    replayed = materialize(members.unionByName(asked, allowMissingColumns=True).groupBy("group").applyInPandas(_replay, REPLAYED))
    weak = replayed.where("kind = 'link'").select("a", "b", F.lit("name_city").alias("method"), F.lit(fixed.CONFIDENCE["name_city"]).alias("confidence"))
    links = materialize(strong.unionByName(weak))
    clusters = materialize(with_components(records.select("ord"), links))
    both = replayed.where("kind = 'review'").select("reason", "surname", "city", F.explode(F.array("a", "b")).alias("ord")).distinct()
    return Resolution(links, clusters, reviews(both, records))


def reviews(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each (reason, surname, city), its candidates as JSON in their order.
    A block's records of one name are what is gathered here, nothing larger."""
    shown = F.struct("city", "email", "name", "phone", "rid", F.col("row_no").alias("row"), "source")
    told = candidates.join(records.select("ord", "email", "name", "phone", "rid", "row_no", "source", F.col("city").alias("own_city")), "ord").drop("own_city")
    grouped = told.groupBy("reason", "surname", "city").agg(F.array_sort(F.collect_list(F.struct("ord", shown.alias("shown")))).alias("rows"))
    cands = F.transform("rows", lambda x: x["shown"])
    text = F.to_json(F.struct(F.struct("city", "surname").alias("block"), cands.alias("candidates"), "reason"), {"ignoreNullFields": "false"})
    vs = F.array_join(F.transform(cands, lambda c: F.concat(c["source"], F.lit(":"), c["row"].cast("string"), F.lit(" "), c["name"], F.lit(" ("), c["city"], F.lit(")"))), " vs ")
    return grouped.select("reason", "surname", "city", F.size("rows").alias("n_candidates"), text.alias("candidates"), vs.alias("shown"), F.get("rows", F.lit(0))["shown"]["source"].alias("source"), F.get("rows", F.lit(0))["shown"]["row"].alias("row_no"))


