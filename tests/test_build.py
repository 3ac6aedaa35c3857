"""Repair, resolution and survivorship: fixtures with planted traps, a sequential model
on random records, and invariants."""

import json
import random
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_fields import indel
from weftline.operators import build, enrich, ingest, resolve, serve
from weftline.operators.survive import dense_ids
from weftline.sources.ragged import read_ragged

S1 = """﻿Full Name,Email,Phone,City,Experience (Years),Current CTC,Applied Date,Skills\r
Rohit Verma,rohit.verma1@example.com,+919000000001,Pune,4.2,417964,2026-08-08,"n8n, SQL"\r
Nikhil Chopra,nikhil.chopra@example.com,9000000002,blr,2,4.2,24-07-2026,"React, Docker"\r
Nikhil Chopra,alt.nikhil.chopra@example.com,09000000002,BLR,2,4.2,24-07-2026,React\r
\r
Arjun Mehta,arjun@example.com,9000000003,Noida,1,5.5,07/13/2026,SQL\r
Deepak Nair,deepak1@example.com,9000000004,Delhi,1,5.5,1 Jul 2026,SQL\r
"""
S2 = """email_id,worker_name,rate,location,status,skill_tags
ROHIT.VERMA1@example.com,R. Verma,15k/month,pune,Active,"n8n, sql"
"n8n, sql",rohit.verma1@example.com,R. Verma,15k/month,pune,active
arjun2@example.com,Arjun Mehta,1415/hr,Noida,paused,sql
kiran@example.com,Kiran Rao,500/hr,Delhi,Active,react
,,1/hr,Delhi,Active,sql
deepak2@example.com,Deepak Nair,500/hr,Bengaluru,Active,sql
"""
S3 = """Name,Phone Number,City,Verified,Projects Completed
ROHIT VERMA,919000000001,Pune,Y,3
Name,Phone Number,City,Verified,Projects Completed
Kiran Rao,+91-9000000009,NCR,No,x
Arjun Mehta,9000000003,Noida,yes,1
Arjun Mehta,9000000008,Noida,no,2
Short Row,9000000010
"""


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sources")
    raw = {}
    for i, text in enumerate((S1, S2, S3), 1):
        (at / f"s{i}.csv").write_text(text, encoding="utf-8", newline="")
        raw[f"source{i}"] = read_ragged(spark, f"file://{at}/s{i}.csv", f"source{i}")
    return build.build(raw)


def test_statuses(made):
    odd = {(r.source, r.row_no): (r.status, r.note) for r in made.parsed.where("status <> 'ingested'").collect()}
    assert odd == {("source1", 5): ("skipped", None), ("source2", 3): ("duplicate_row", "identical to row 2"), ("source2", 6): ("rejected", "no name"), ("source3", 3): ("skipped", None)}


def test_people(made):
    people = {r.full_name: r for r in made.person.collect()}
    assert people["Rohit Verma"].source_count == 3 and people["Rohit Verma"].match_methods == "email,phone" and people["Rohit Verma"].match_confidence == 0.99
    assert people["Nikhil Chopra"].primary_email == "nikhil.chopra@example.com"
    assert people["Kiran Rao"].match_methods == "name_city" and people["Kiran Rao"].match_confidence == 0.8
    assert made.person.where("full_name = 'Arjun Mehta'").count() == 3 and made.person.where("full_name = 'Deepak Nair'").count() == 2
    review = made.tables["match_review"].collect()
    assert len(review) == 1 and review[0].candidates.count('"rid"') == 4
    assert made.tables["person_name_alias"].where("name in ('R. Verma', 'ROHIT VERMA', 'Rohit Verma')").count() == 3


def test_findings(made):
    codes = {r.issue_code: r.n for r in made.tables["data_issue"].groupBy("issue_code").agg(F.count("*").alias("n")).collect()}
    for code in "BLANK_ROW COLUMN_SHIFT REPEATED_HEADER COLUMN_COUNT_MISMATCH MULTIPLE_EMAILS_ONE_PERSON ALTERNATE_EMAIL NAME_VARIANTS_MERGED AMBIGUOUS_IDENTITY INT_UNPARSEABLE".split():
        assert codes[code] == 1, code
    assert serve.markdown_report(made.tables["data_issue"]).count("\n| ") > 20


def test_invariants(made):
    t = made.tables
    assert t["person_email"].groupBy("email").count().where("count > 1").count() == 0
    assert t["person_phone"].groupBy("phone").count().where("count > 1").count() == 0
    assert t["source_record"].where("status = 'ingested' and person_id is null").count() == 0
    assert t["person_email"].groupBy("person_id").agg(F.sum("is_primary").alias("n")).where("n <> 1").count() == 0
    n = t["person"].count()
    assert t["person"].agg(F.min("person_id"), F.max("person_id"), F.count_distinct("person_id")).first() == (1, n, n)


def test_written_tables_read_back(made, spark, tmp_path):
    build.write(made, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/person").count() == made.person.count()
    assert build.summary(made.tables).first().persons == made.person.count()


def test_several_files_of_a_source_keep_all_rows(spark, tmp_path):
    for i, text in enumerate((S1, S2, S3), 1):
        head, *lines = text.lstrip("\ufeff").splitlines(keepends=True)
        (tmp_path / f"s{i}").mkdir()
        for part, own in (("a", lines[: len(lines) // 2]), ("b", lines[len(lines) // 2 :]), ("c", [])):
            (tmp_path / f"s{i}" / f"{part}.csv").write_text(head + "".join(own), encoding="utf-8", newline="")
    raw = {f"source{i}": read_ragged(spark, f"file://{tmp_path}/s{i}/*.csv", f"source{i}") for i in (1, 2, 3)}
    split = build.build(raw)
    (tmp_path / "one").mkdir()
    for i, text in enumerate((S1, S2, S3), 1):
        (tmp_path / "one" / f"s{i}.csv").write_text(text, encoding="utf-8", newline="")
    whole = build.build({f"source{i}": read_ragged(spark, f"file://{tmp_path}/one/s{i}.csv", f"source{i}") for i in (1, 2, 3)})
    told = lambda made: sorted(map(str, made.person.select("full_name", "primary_email", "primary_phone", "source_count", "match_methods").collect()))
    assert told(split) == told(whole)
    for name in ("source_record", "person_skill", "data_issue", "match_review"):
        assert split.tables[name].count() == whole.tables[name].count(), name
    rows = split.tables["source_record"]
    assert rows.count() == rows.select("source", "row_no").distinct().count()
    assert {r.rows_before for r in split.tables["source_file"].collect()} == {0, 4}


def test_published_outcome(spark):
    """The published counts on the published inputs, where these are at hand."""
    files = {f"source{i}": sorted(Path("/root").glob(f"*/data/raw/source{i}*.csv")) for i in (1, 2, 3)}
    if not all(files.values()):
        pytest.skip("no published inputs here")
    made = build.build({s: read_ragged(spark, f"file://{at[0]}", s) for s, at in files.items()})
    n = build.summary(made.tables).first()
    assert (n.rows_read, n.rows_ingested, n.rows_skipped) == (105, 102, 3)
    assert (n.persons, n.in_all_three, n.in_two, n.single_source) == (56, 15, 14, 27)
    assert (n.issues, n.issue_types, n.reviews) == (308, 24, 1)
    assert {r.match_methods: r["count"] for r in made.person.groupBy("match_methods").count().collect()} == {"single_source": 25, "email,phone": 16, "phone": 11, "name_city": 4}
    assert {r.severity: r["count"] for r in made.tables["data_issue"].groupBy("severity").count().collect()} == {"high": 20, "medium": 28, "low": 260}


def test_enrichment_flow(made):
    from weftline.operators import survive

    full = survive.person_full(made.person, made.tables["person_skill"], made.tables["skill"]).withColumn("skill_category", F.lit(None).cast("string"))
    good, rest, answer = enrich.enrich(full)
    assert answer.first().tagged == good.count() and good.count() + rest.count() == full.where("skills is not null").count()
    odd = full.limit(3).select("person_id", F.lit("Bogus").alias("category"), F.lit(float("nan")).alias("confidence"))
    assert {(r.category, r.accepted) for r in enrich.validate(odd).collect()} == {("generalist", False)}


def sequential(rows):
    """The rules one record and one pair after another: rows of dicts in order."""
    parent = {r["ord"]: r["ord"] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key in ("ekey", "pkey"):
        first = {}
        for r in rows:
            if r[key]:
                x, y = find(first.setdefault(r[key], r["ord"])), find(r["ord"])
                parent[max(x, y)] = min(x, y)

    def alike(a, b):
        ka, kb = a.lower(), b.lower()
        if ka == kb:
            return True
        ta, tb = ka.split(), kb.split()
        if ta[-1] == tb[-1] and ta[0][0] == tb[0][0] and 1 in (len(ta[0]), len(tb[0])):
            return True
        return indel(" ".join(sorted(ta)), " ".join(sorted(tb))) >= 88

    blocks, links, reviews = {}, set(), set()
    for r in rows:
        if r["city"]:
            blocks.setdefault((r["name"].lower().split()[-1], r["city"]), []).append(r)
    for block in blocks.values():
        for a, b in combinations(block, 2):
            if find(a["ord"]) == find(b["ord"]) or a["source"] == b["source"] or not alike(a["name"], b["name"]):
                continue
            same = [r["source"] for r in block if alike(r["name"], a["name"])]
            merged = [r for r in rows if find(r["ord"]) in (find(a["ord"]), find(b["ord"]))]
            if max(same.count(s) for s in same) > 1 or len({r["ekey"] for r in merged if r["ekey"]}) > 1 or len({r["pkey"] for r in merged if r["pkey"]}) > 1:
                reviews |= {a["ord"], b["ord"]}
                continue
            links.add((a["ord"], b["ord"]))
            x, y = find(a["ord"]), find(b["ord"])
            parent[max(x, y)] = min(x, y)
    return links, {r["ord"]: find(r["ord"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_against_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows = []
    for source in (1, 2, 3):
        for n in range(40):
            name = f"{rng.choice(['Asha', 'A', 'Amit', 'Amita', 'Ravi', 'R'])} {rng.choice(['Rao', 'Roy', 'Sen', 'Das', 'Bose'])}"
            rows.append({
                "rid": f"s{source}:{n}", "ord": source * 1000 + n, "source": f"source{source}", "row_no": n, "name": name, "city": rng.choice(["Pune", "Delhi", "Noida", "Agra", "Goa", None]),
                "ekey": f"e{rng.randrange(60)}" if source < 3 and rng.random() < 0.6 else None, "pkey": f"p{rng.randrange(60)}" if source != 2 and rng.random() < 0.6 else None,
            })
    schema = "rid string, ord long, source string, row_no long, name string, city string, ekey string, pkey string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    df = df.withColumns({"email": F.col("ekey"), "phone": F.col("pkey"), "surname": F.lower(F.element_at(F.split("name", " "), -1))}).repartition(5)
    found = resolve.resolve(df)
    links, clusters = sequential(rows)
    assert {(r.a, r.b) for r in found.links.where("method = 'name_city'").collect()} == links
    assert {r.ord: r.component for r in found.clusters.collect()} == clusters


def modelled(spark, sf):
    """The query records of the smallest input, and what the sequential model makes of them."""
    from weftline.plans import queries as plans

    rows = [r.asDict() for r in plans.records(spark, sf).orderBy("ord").collect()]
    rows = [r | {"name": r["nkey"] or "?", "city": r["city"] if r["surname"] else None} for r in rows]
    return rows, *sequential(rows)


def test_dashboard_counts_merges_and_reviews(spark, sf):
    from weftline.plans import queries as plans

    rows, _, clusters = modelled(spark, sf)
    got = plans.QUERIES["dashboard_stats_all_tiers"](spark, sf).first()
    sources = {}
    for r in rows:
        sources.setdefault(clusters[r["ord"]], set()).add(r["source"])
    assert (got.people, got.merged) == (len(sources), sum(len(s) > 1 for s in sources.values()))
    tables = build.build(plans.raw_all(spark, sf)).tables
    assert got.open_reviews == tables["match_review"].count() > 0
    assert got.issues == tables["data_issue"].count() > plans.QUERIES["dashboard_stats"](spark, sf).first().issues
    log = plans.QUERIES["issue_log_all_tiers"](spark, sf)
    assert log.count() == got.issues and log.where("issue_code = 'AMBIGUOUS_IDENTITY'").count() == got.open_reviews
    assert plans.QUERIES["issues_by_code_all_tiers"](spark, sf).where("issue_code = 'AMBIGUOUS_IDENTITY'").first().n == got.open_reviews


def test_people_by_method_over_all_tiers(spark, sf):
    import __spark_entry__ as entry

    rows, weak, clusters = modelled(spark, sf)
    found = {c: set() for c in clusters.values()}
    for key, method in (("ekey", "email"), ("pkey", "phone")):
        first = {}
        for r in rows:
            if r[key] and first.setdefault(r[key], r["ord"]) != r["ord"]:
                found[clusters[r["ord"]]].add(method)
    for a, _ in weak:
        found[clusters[a]].add("name_city")
    said = [",".join(sorted(m)) or "single_source" for m in found.values()]
    assert {r.match_methods: r.n for r in entry.entry(spark).collect()} == {m: said.count(m) for m in said}
    assert "name_city" in said
    assert entry.queries()["golden_person_all_tiers"](spark, sf).count() == len(found)


def test_dense_ids(spark):
    df = spark.range(0, 5000, 7).repartition(9)
    got = dense_ids(df, "id", "n").collect()
    assert sorted((r.id, r.n) for r in got) == [(i * 7, i + 1) for i in range(len(got))]


def test_serving(spark):
    person = spark.createDataFrame([(1, "Asha Rao"), (2, "Ravi Sen"), (3, "Asha Rao")], "person_id long, full_name string")
    emails = spark.createDataFrame([(1, "a@x.org")], "person_id long, email string")
    phones = spark.createDataFrame([(2, "+919000000001")], "person_id long, phone string")
    probes = spark.createDataFrame([(1, "x", " A@X.org", "9000000001"), (2, "ravi", None, "09000000001"), (3, "asha rao", "no@x.org", None), (4, None, None, None)], "probe_id int, name string, email string, phone string")
    got = sorted(tuple(r) for r in serve.match_check(probes, person, emails, phones).collect())
    assert got == [(1, 1, "email", 1.0), (2, 2, "phone", 0.99), (3, 1, "name", 0.5), (3, 3, "name", 0.5)]
    updates = spark.createDataFrame([(1, " Data ", 0.9, "me", 1), (1, "web-dev", 0.8, "me", 2), (9, "data", 0.7, "me", 3), (2, "bogus", 0.7, "me", 4)], "person_id long, skill_category string, confidence double, tagged_by string, told_at long")
    assert {r.told_at: r.status for r in serve.accepted_categories(updates, person).collect()} == {1: 200, 2: 200, 3: 404, 4: 422}
    assert {r.person_id: r.skill_category for r in serve.latest_category(updates, person).collect()} == {1: "web-dev", 2: None, 3: None}


def test_empty_sources(spark):
    none = {s: spark.createDataFrame([], "source string, row_no long, cells array<string>") for s in ingest.HEADERS}
    assert build.build(none).person.count() == 0
    nulls = spark.createDataFrame([("source3", 2, None), ("source3", 3, [None, None]), ("source3", 4, ["A B", None])], "source string, row_no long, cells array<string>")
    assert [r.status for r in ingest.parse(nulls, "source3").orderBy("row_no").collect()] == ["skipped", "skipped", "ingested"]


def test_people_from_json_are_tagged_and_counted(spark, tmp_path):
    from weftline.sources.people import read_people, read_people_lines

    people = [{"person_id": 1, "full_name": "A", "skills": "sql, pandas, python"}, {"person_id": 2, "full_name": "B", "skills": None}, {"person_id": 3, "skills": "react", "skill_category": "web-dev"}, {"full_name": "nobody"}, {"person_id": 4, "skills": "knitting", "more": 1}]
    (tmp_path / "list.json").write_text(json.dumps(people))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, people)) + "\nnot json\n")
    for read, name in ((read_people, "list.json"), (read_people_lines, "lines.json")):
        got = read(spark, f"file://{tmp_path}/{name}")
        assert sorted(r.person_id for r in got.collect()) == [1, 2, 3, 4]
        updates, rest, counts = enrich.tag_all(got)
        assert [r.person_id for r in updates.collect()] == [1] and sorted(r.person_id for r in rest.collect()) == [2, 4]
        assert tuple(counts.first()) == (1, 2)
    answer = lambda df: df.select("person_id", F.lit("data").alias("category"), (F.col("person_id") / 4).alias("confidence"))
    assert tuple(enrich.tag_all(got, answer, least=0.5)[2].first()) == (2, 1)


def test_appended_batches_are_there_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "submission_id int, sha256 string")
    serve.append(df, f"file://{tmp_path}/all")
    serve.append(df, f"file://{tmp_path}/all")
    assert spark.read.parquet(f"file://{tmp_path}/all").count() == 4
    each = serve.append_batch(f"file://{tmp_path}/stream")
    for number in (0, 1, 1):
        each(df, number)
    assert spark.read.parquet(f"file://{tmp_path}/stream").count() == 4
