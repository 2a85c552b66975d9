"""Merges, lifecycle, sources and views on a few rows."""

import json

import pytest
from pyspark.sql import functions as F

from postlake.operators import entities, lifecycle, store, views
from postlake.sources import boards, feeds, pages
from postlake.streaming.sync import Snapshots, start

POSTING = "job_id string, title string, description string, track array<string>, resume_fit_score double, fit_reason string, posted_at date, first_seen string, last_seen string, status string, company_id long"


def one(frame):
    (row,) = frame.collect()
    return row.asDict()


def test_batch_folds_then_merges_by_column_rule(spark):
    rows = [("a", "T1", "d1", ["x"], 0.5, "r", None, "1", "1", "open", 1, 0), ("a", "T2", None, ["y"], None, "", None, "2", "2", "closed", 2, 1)]
    batch = store.fold(spark.createDataFrame(rows, POSTING + ", ordinal int"))
    got = one(batch)
    assert (got["title"], got["description"], got["track"], got["resume_fit_score"], got["fit_reason"], got["first_seen"], got["status"], got["company_id"]) == ("T2", None, ["x", "y"], 0.5, "r", "1", "closed", 1)
    stored = spark.createDataFrame([("a", "T0", "d0", ["w"], 0.9, "old", None, "0", "0", "open", None)], POSTING)
    merged = one(store.merge_postings(stored, batch))
    assert (merged["title"], merged["description"], merged["track"], merged["resume_fit_score"], merged["first_seen"], merged["company_id"], merged["is_new"]) == ("T2", None, ["w", "x", "y"], 0.5, "0", None, False)
    assert one(store.merge_postings(stored, batch, relink=True))["company_id"] == 1


def test_merge_is_idempotent(spark):
    rows = [(f"j{i % 5}", f"t{i}", None, [f"k{i % 3}"], i / 10, None, None, str(i), str(i), "open", i, i) for i in range(20)]
    batch = store.fold(spark.createDataFrame(rows, POSTING + ", ordinal int"))
    once = store.merge_postings(batch.limit(0), batch).drop("is_new")
    twice = store.merge_postings(once, batch.select(*once.columns)).drop("is_new")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))


def test_companies_keep_known_values_and_unite_tags(spark):
    schema = "name string, ats string, tags array<string>"
    out = store.merge_companies(spark.createDataFrame([("Acme", "lever", ["b"])], schema), spark.createDataFrame([("Acme", None, ["a"]), ("New", "x", None)], schema))
    assert {r["name"]: (r["ats"], r["tags"]) for r in out.collect()} == {"Acme": ("lever", ["a", "b"]), "New": ("x", [])}
    tagged = store.with_tag(out, "ACME", "watch")
    assert {r["name"]: r["tags"] for r in tagged.collect()}["Acme"] == ["a", "b", "watch"]


def test_scores_overwrite_with_nulls(spark):
    stored = spark.createDataFrame([("a", 0.5, "r"), ("b", 0.6, "s")], "job_id string, fit double, why string")
    out = store.update_scores(stored, spark.createDataFrame([("a", None, "new")], "job_id string, fit double, why string"))
    assert {r["job_id"]: (r["fit"], r["why"]) for r in out.collect()} == {"a": (None, "new"), "b": (0.6, "s")}


STORED = "company_id long, job_id string, url string, title string, status string, first_seen timestamp_ntz, last_seen timestamp_ntz, closed_at timestamp_ntz, posted_at timestamp_ntz"
SNAPSHOT = "company_id long, job_id string, url string, title string, posted_at timestamp_ntz, pos long"


def synced(spark, stored, snapshot, **options):
    rows = spark.createDataFrame([(c, j, u, t, s, None, None, None, None) for c, j, u, t, s in stored], STORED).withColumn("last_seen", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    snap = spark.createDataFrame([(*x, None, i) for i, x in enumerate(snapshot)], SNAPSHOT)
    out = lifecycle.sync_statuses(rows, snap, F.lit(options.pop("now", "2024-02-01 00:00:00")).cast("timestamp_ntz"), **options)
    return {r["job_id"]: (r["status"], r["closed_at"] is not None, r["change"]) for r in out.collect()}


def test_vanished_native_row_closes_and_external_one_waits(spark):
    stored = [(1, "gh_acme_1", "u1", "A", "open"), (1, "gh_acme_2", "u2", "B", "open"), (1, "linkedin_aaa", "u3", "C", "open")]
    snapshot = [(1, "gh_acme_2", "u2", "B")]
    assert synced(spark, stored, snapshot, now="2024-01-02 00:00:00") == {"gh_acme_1": ("closed", True, "closed"), "gh_acme_2": ("open", False, None), "linkedin_aaa": ("open", False, None)}
    assert synced(spark, stored, snapshot)["linkedin_aaa"] == ("closed", True, "closed")


def test_recycled_title_shields_external_rows_only(spark):
    stored = [(1, "gh_acme_old", "u1", "Algorithm Engineer", "open"), (1, "linkedin_bbb", "u9", "algorithm  engineer", "closed"), (2, "gh_other_1", "u", "X", "open")]
    out = synced(spark, stored, [(1, "gh_acme_new", "u2", "Algorithm Engineer")])
    assert out == {"gh_acme_old": ("closed", True, "closed"), "linkedin_bbb": ("open", False, "reopened"), "gh_other_1": ("open", False, None)}


def test_sync_is_idempotent_on_one_snapshot(spark):
    stored = [(1, f"gh_a_{i}", f"u{i}", f"t{i}", "open") for i in range(6)]
    snapshot = [(1, f"gh_a_{i}", f"u{i}", f"t{i}") for i in range(3)]
    first = synced(spark, stored, snapshot)
    again = synced(spark, [(1, j, "u", "t", s) for j, (s, _, _) in first.items()], snapshot)
    assert {j: s for j, (s, _, _) in first.items()} == {j: s for j, (s, _, _) in again.items()}


def test_ranking_leaves_out_closed_and_dispositioned(spark):
    rows = spark.createDataFrame([("a", 1, 0.9, "open", None), ("b", 1, 0.8, "closed", None), ("c", 2, 0.7, None, "saved"), ("d", 2, 0.6, "open", "applied"), ("e", 9, 0.5, "open", None)], "job_id string, company_id long, fit double, status string, disposition string")
    firms = spark.createDataFrame([(1, 0.1), (2, 0.9)], "company_id long, mission_score double")
    order = lambda **k: [r["job_id"] for r in views.ranked(rows, firms, F.lit(False), **k).collect()]
    assert order() == ["c", "a", "e"]
    assert order(include_closed=True, include_dispositioned=True, limit=2) == ["c", "d"]
    assert order(min_mission=0.5) == ["c", "e"]


def test_resolve_stages(spark):
    known = spark.createDataFrame([("gh_a_1", "https://a.io/1"), ("gh_a_12", "https://a.io/2")], "job_id string, url string")
    refs = spark.createDataFrame([("gh_a_1",), ("HTTP://A.io/2/?x",), ("A_1",), ("none",)], "ref string")
    got = {(r["ref"], r["job_id"], r["stage"]) for r in store.resolve(known, refs).collect()}
    assert got == {("gh_a_1", "gh_a_1", 1), ("HTTP://A.io/2/?x", "gh_a_12", 3), ("A_1", "gh_a_1", 2), ("A_1", "gh_a_12", 2)}
    known = spark.createDataFrame([("lv_x_abc", "u"), ("gh_y_1", "https://abc"), (None, None)], "job_id string, url string")
    refs = spark.createDataFrame([("abc",), ("y_",), ("",), (None,)], "ref string")
    assert {(r["ref"], r["job_id"], r["stage"]) for r in store.resolve(known, refs).collect()} == {("abc", "lv_x_abc", 2), ("y_", "gh_y_1", 2)}


def test_merge_with_null_statuses(spark):
    schema = "job_id string, company_id long, first_seen string, title string, status string, closed_at string"
    stored = spark.createDataFrame([("a", 1, "d1", "old", None, None), ("b", 1, "d1", "old", "closed", "d2")], schema)
    batch = spark.createDataFrame([("b", 2, "d3", "new", None, None), ("c", 2, "d3", "new", None, None)], schema)
    got = {r["job_id"]: tuple(r)[1:] for r in store.merge_postings(stored, batch).collect()}
    assert got == {"a": (1, "d1", "old", None, None, False), "b": (1, "d1", "new", None, None, False), "c": (2, "d3", "new", None, None, True)}


def test_confirmed_boards(spark):
    rows = [("a", 0, 0, "lever", "a", True, 0), ("b", 0, 0, "smartrecruiters", "b", True, 0), ("b", 1, 0, "jazzhr", "b1", True, 3), ("c", 0, 0, "lever", "c", False, 0)]
    frame = spark.createDataFrame(rows, "company string, slug_pos int, ats_pos int, ats string, slug string, ok boolean, n_jobs int")
    assert {tuple(r) for r in entities.confirmed(frame).collect()} == {("a", "lever", "a", 0), ("b", "jazzhr", "b1", 3)}


def test_hydration_by_id_then_title(spark):
    rows = [("j1", 1, "Data  Engineer", ""), ("j2", 1, "analyst", None), ("j3", 2, "analyst", None), ("j4", 1, "x", "own")]
    postings = spark.createDataFrame(rows, "job_id string, company_id long, title string, description string")
    details = spark.createDataFrame([("j1", 1, "other", "by id"), ("k", 1, "Analyst ", "by title"), ("j4", 1, "x", "longer than own")], "job_id string, company_id long, title string, description string")
    assert {r["job_id"]: r["description"] for r in boards.hydrated(postings, details).collect()} == {"j1": "by id", "j2": "by title", "j3": None, "j4": "own"}


def test_empty_stream_store(spark, tmp_path):
    empty = Snapshots(spark, f"file://{tmp_path}/none")
    with pytest.raises(ValueError):
        empty.read()
    with pytest.raises(ValueError):
        start(None, empty, f"file://{tmp_path}/checkpoint")


def bronze(spark, platform, body, status=200):
    return spark.createDataFrame([(platform, "acme", "Acme", body if isinstance(body, str) else json.dumps(body), status)], "platform string, board string, company string, body string, status int")


def test_board_payloads(spark):
    gh = {"jobs": [{"id": 7, "title": "Data Engineer", "absolute_url": "u", "location": {}, "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "first_published": "2026-01-02T00:00:00Z", "offices": [{"name": "Remote US"}]}]}
    row = one(boards.parse(bronze(spark, "greenhouse", gh), "greenhouse"))
    assert (row["job_id"], row["location"], row["remote_hint"]) == ("gh_acme_7", "Unknown", "office") and row["description"].startswith("Hi & bye")
    lever = [{"id": "x", "text": "Dev", "createdAt": 1767225600000, "workplaceType": "remote", "categories": {"location": "Durham", "allLocations": ["Durham", "Cary"]}}]
    row = one(boards.parse_all(bronze(spark, "lever", lever), F.lit("2026-03-01").cast("date")))
    assert (row["location"], row["remote_hint"], str(row["posted_at"])) == ("Durham; Cary", "remote", "2026-01-01")
    for key in ("jobs", "jobPostings"):
        row = one(boards.parse(bronze(spark, "ashby", {key: [{"id": "1", "title": "R", "isRemote": False, "workplaceType": "Remote"}]}), "ashby"))
        assert row["remote_hint"] == "remote"
    assert boards.parse(bronze(spark, "greenhouse", gh, 500), "greenhouse").count() == 0
    assert boards.parse(bronze(spark, "greenhouse", "[1]"), "greenhouse").count() == 0
    assert boards.parse(bronze(spark, "lever", "not json"), "lever").count() == 0


def test_pages_and_feeds(spark):
    html = '<a href="/jobs/data-engineer-1">Data Engineer</a><a href="/jobs/all">All jobs</a><a href="/jobs/dev-2"><b>Dev</b> Ops</a><a href="/about">About</a><a href="/jobs/dev-2">again here</a>'
    page = spark.createDataFrame([(1, "http://x", html)], "page_id long, url string, html string")
    assert sorted((r["href"], r["title"]) for r in pages.job_links(page).collect()) == [("/jobs/data-engineer-1", "Data Engineer"), ("/jobs/dev-2", "Dev Ops")]
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "T", "url": "u", "jobLocationType": "TELECOMMUTE", "hiringOrganization": {"name": "Acme"},}]}</script>'
    row = one(pages.linked_data(spark.createDataFrame([(1, "x", ld)], "page_id long, url string, html string")))
    assert (row["title"], row["company"], row["location"]) == ("T", "Acme", "Remote")
    layers = spark.createDataFrame([("a", "u", "short", 0), ("a", "u", "much longer", 1), ("b", "U/", "x", 1), ("c", "v", "y", 1)], "job_id string, url string, title string, layer int")
    assert sorted((r["job_id"], r["title"]) for r in pages.merged_layers(layers, ["url", "title"]).collect()) == [("a", "much longer"), ("c", "y")]
    titles = spark.createDataFrame([("Acme: Data Engineer | EU",), ("Dev at Beta (US)",), ("Plain",)], "t string")
    parts = feeds.title_parts(F.col("t"))
    assert [tuple(r) for r in titles.select(*[c.alias(k) for k, c in parts.items()]).collect()] == [("Data Engineer", "Acme", "EU"), ("Dev", "Beta", "US"), ("Plain", None, None)]
    header = feeds.header_fields(F.col("t"))
    post = spark.createDataFrame([("Acme Inc. | Remote | $150k | Senior Engineer\nbody",)], "t string")
    assert tuple(post.select(*[c.alias(k) for k, c in header.items()]).first()) == ("Acme Inc.", "Senior Engineer", "Remote")


def test_entities(spark):
    urls = ["https://boards.greenhouse.io/acme/jobs/1", "https://jobs.lever.co/embed", "https://co.wd5.myworkdayjobs.com/x", "https://none.example"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(entities.detected_board("url").alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in rows] == [("greenhouse", "acme"), None, ("workday", "co"), None]
    (row,) = spark.createDataFrame([("Acme Bio Labs (US)",)], "n string").select(entities.slug_variants("n").alias("s")).collect()
    assert row["s"][:4] == ["acme-bio-labs", "acmebiolabs", "acme", "acmebio"] and "acme-bio" in row["s"]


def test_decisions_by_reference(spark):
    rows = [(f"gh_acme_{i}", f"Role {i}", f"https://x.org/{i}", None, None, None) for i in range(12)] + [("lv_b_77", None, "https://y.org/j", "saved", "n", "2024-01-01")]
    postings = spark.createDataFrame(rows, "job_id string, title string, url string, disposition string, disposition_note string, disposition_at string")
    asked = spark.createDataFrame([("gh_acme_3", "Applied", "yes", "2024-02-01"), ("acme", "saved", None, "2024-02-01"), ("nothing", "saved", None, "t"), ("lv_b_77", "clear", "x", "t"), ("https://x.org/5", "saved", "by url", "2024-02-02"), ("gh_acme_7", "loved", None, "t"), ("gh_acme_8", None, None, "t")], "ref string, disposition string, note string, at string")
    after, outcomes = store.disposed(postings, asked)
    got = {r["job_id"]: (r["disposition"], r["disposition_note"], r["disposition_at"]) for r in after.collect()}
    assert got["gh_acme_3"] == ("applied", "yes", "2024-02-01") and got["gh_acme_5"] == ("saved", "by url", "2024-02-02") and got["lv_b_77"] == (None, None, None)
    assert sum(v != (None, None, None) for v in got.values()) == 2
    errors = {r["ref"]: r["error"] for r in outcomes.collect()}
    assert errors["gh_acme_3"] is errors["lv_b_77"] is None and "no posting matches" in errors["nothing"] and "unknown disposition loved" in errors["gh_acme_7"] and "unknown disposition null" in errors["gh_acme_8"]
    assert errors["acme"].startswith("acme is ambiguous (12 matches):") and len(errors["acme"].splitlines()) == 9


def test_postings_marked_as_seen(spark):
    schema = "job_id string, company_id long, company_name string, title string, description string, status string, closed_at string, geo_mode string, track array<string>, resume_fit_score double"
    stored = spark.createDataFrame([("a", 1, "A", "old", "d", "closed", "t", "onsite", ["x"], 0.5)], schema)
    found = spark.createDataFrame([("a", "Other", "new", None, None), ("b", "B", "role", "e" * 20_000, 0.7)], "id string, company string, title string, description string, resume_fit_score double")
    got = {r["job_id"]: r for r in store.marked_seen(stored, found, "y").collect()}
    assert (got["a"]["company_id"], got["a"]["title"], got["a"]["geo_mode"], got["a"]["track"], got["a"]["resume_fit_score"]) == (1, "new", "onsite", ["x", "y"], 0.5)
    assert (got["b"]["company_name"], len(got["b"]["description"]), got["b"]["track"], got["b"]["is_new"]) == ("B", 12_000, ["y"], True)


def test_resolving_broadcasts_nothing(spark):
    """Ids and their runs grow with the store, so no side of a join is sent through the driver."""
    rows = spark.createDataFrame([("gh_1", "u", "t", None, None, None)], "job_id string, url string, title string, disposition string, disposition_note string, disposition_at timestamp_ntz")
    asked = spark.createDataFrame([("gh_1", "saved", None, None)], "ref string, disposition string, note string, at timestamp_ntz")
    after, outcomes = store.disposed(rows, asked)
    for frame in (after, outcomes):
        assert "Broadcast" not in frame._jdf.queryExecution().toString()
    assert [(r["job_id"], r["disposition"]) for r in after.collect()] == [("gh_1", "saved")]
