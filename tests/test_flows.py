"""Flows, discovery, views and page parsers on small frames."""

import datetime as dt
import json

from pyspark.sql import functions as F

from postlake.functions import predicates as P
from postlake.functions import scoring as S
from postlake.functions.text import norm_title
from postlake.operators import entities, flows, judging, reports, store, views
from postlake.profile import Excludes, Profile, Vocabulary
from postlake.sources import feeds, listings, pages

AT = dt.datetime(2024, 5, 1)


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_names(spark):
    rows = [("https://www.acme-health.com/x", "Acme Health"), ("https://medicaljobs.com", "Sampson Regional Medical Center"), (None, None), ("jobs.org", "")]
    assert one(spark, rows, "u string, n string", P.host_matches("u", "n")) == [(True,), (False,), (False,), (False,)]
    rows = [("acme", "Acme Health"), ("nc", "Novamed NC"), ("novamedinc", "Novamed"), (None, "Acme"), ("acme", None)]
    assert one(spark, rows, "s string, n string", P.slug_matches("s", "n")) == [(True,), (False,), (True,), (False,), (False,)]
    names = ["Acme Robotics", "home page", "acme_robotics", "12345", "Ab", None, "x" * 45, "Best Startups of 2024", " Careers"]
    assert one(spark, [(n,) for n in names], "n string", P.plausible_company("n")) == [(n == "Acme Robotics",) for n in names]
    got = entities.gathered_names([spark.createDataFrame([("Acme", 1), ("", 2)], "name string, ordinal long"), spark.createDataFrame([("ACME", 0), (" Beta ", 1), (None, 2)], "name string, ordinal long")])
    assert sorted(map(tuple, got.collect())) == [("Acme", 0, 1), ("Beta", 1, 1)]


def test_scores_after_the_judge(spark):
    answers = ['["geo", "nonsense", "geo"]', '{"geo": true, "level": false, "phd": 0}', "words", None, "[", "{}"]
    known = ("geo", "level", "phd")
    assert one(spark, [(a,) for a in answers], "a string", S.known_gates("a", known)) == [(["geo", "geo"],), (["geo"],), ([],), ([],), ([],), ([],)]
    rows = [(["geo"], " Management "), (["management"], "program-product"), ([], "ic"), ([], None)]
    assert one(spark, rows, "g array<string>, s string", S.seat_gates(F.col("g"), "s")) == [(["geo", "management"],), (["management"],), ([],), ([],)]
    rows = [(" good ", 5, "IC", ["a", " ", "b", "c", "d"]), (None, None, None, None), ("x", 0, "", [])]
    got = one(spark, rows, "r string, y int, s string, g array<string>", S.deep_reason("r", "y", "s", F.col("g")))
    assert got == [("deep: good [5+yrs | ic | gaps: a; b; c]",), ("deep: ",), ("deep: x",)]
    assert one(spark, [("0.4",), ("7",), ("x",), (None,)], "s string", S.judged_score("s")) == [(0.4,), (1.0,), (None,), (None,)]


STORE = "job_id string, company_id long, status string, closed_at timestamp_ntz, first_seen timestamp_ntz, last_seen timestamp_ntz, title string, location string, geo_mode string, company_name string"


def test_ingest_keeps_the_place_gate_for_curated_postings(spark):
    companies = spark.createDataFrame([(2, "ACME", ["watch"]), (1, "acme", ["watch"]), (3, "Beta", None)], "company_id long, name string, tags array<string>")
    rows = [
        ("a", "Nurse", "Acme", "u", "Durham", "d", 1), ("b", "Nurse", "Acme", "u", "Remote - US", "d", 2), ("c", "Nurse", "Beta", "u", "Remote - US", "d", 3),
        (None, "Engineer", None, "u", "Durham", None, 4), ("e", "Engineer", "Beta", "u", None, None, 5), ("f", "Engineer", "Beta", "u", "Durham", "missile", 6),
        ("old", "Engineer", "Beta", "u", "Durham", "x", 7), ("old", "Engineer II", "Beta", "u", "Durham", "x", 8),
    ]
    incoming = spark.createDataFrame(rows, "id string, title string, company string, url string, location string, description string, ordinal long")
    stored = spark.createDataFrame([("old", 3, "closed", AT, AT, AT, "Engineer", "Durham", None, "Beta"), ("z", 3, None, None, None, None, None, None, None, None)], STORE)
    profile = Profile(excludes=Excludes(strong=("missile",)), technical_title="engineer", local_names=("durham",))
    ids = lambda frame: {r["job_id"]: (r["company_id"], r["geo_mode"], r["is_new"]) for r in frame.collect()}
    plain = flows.ingested(incoming, companies, stored, "cap", profile)
    got = ids(plain)
    assert {k: v for k, v in got.items() if not k.startswith("cap_")} == {"old": (3, "onsite", False)} and len(got) == 2
    curated = ids(flows.ingested(incoming, companies, stored, "cap", profile, curated=True))
    assert {k for k in curated if not k.startswith("cap_")} == {"a", "b", "f", "old"} and curated["b"] == (1, "remote", True)
    after = {r["job_id"]: r for r in flows.stored_after_ingest(stored, plain, now()).collect()}
    assert len(after) == 3 and (after["old"]["status"], after["old"]["closed_at"], after["old"]["last_seen"], after["old"]["title"]) == ("open", None, AT, "Engineer")
    assert after["z"]["status"] is None and [r["status"] for k, r in after.items() if k.startswith("cap_")] == ["open"]
    assert flows.ingested(incoming.limit(0), companies.limit(0), stored.limit(0), "cap", profile).count() == 0


def test_crawl(spark):
    companies = spark.createDataFrame([(1, "Acme", ["watch"]), (2, "Big", None)], "company_id long, name string, tags array<string>")
    rows = [(1, "a", "Engineer", "d", "Durham"), (1, "b", "Engineer", "missile", "Boston"), (1, "c", "Engineer", "d", "Durham"), (2, "d", "Engineer", "d", "Boston"), (2, "e", "Engineer", "eeg", "Boston"), (2, "f", None, None, None)]
    fetched = spark.createDataFrame(rows, "company_id long, job_id string, title string, description string, location string")
    stored = spark.createDataFrame([("c",), (None,)], "job_id string")
    profile = Profile(excludes=Excludes(strong=("missile",)), technical_title="engineer", local_names=("durham",), multi_division=("Big",))
    profile = Profile(**{**profile.__dict__, "vocabulary": profile.vocabulary.__class__(core=("eeg",))})
    got = flows.crawled(fetched, companies, stored, profile)
    flags = {r["job_id"]: (r["kept"], r["fresh"], r["watch_hit"]) for r in got.collect()}
    assert flags == {"a": (True, True, True), "b": (False, False, True), "c": (True, False, False), "d": (False, False, False), "e": (True, True, False), "f": (False, False, False)}
    assert sorted(map(tuple, flows.crawl_funnel(got).collect())) == [("Acme", 3, 2, 1, 2), ("Big", 3, 1, 1, 0)]


def test_sources_caches_and_titles(spark):
    schema = "kind string, spec string, pos long"
    groups = [spark.createDataFrame([("rss", "B", 1), ("rss", "a", 0)], schema), spark.createDataFrame([("rss", "b", 0), ("hn", "b", 1)], schema)]
    assert [(r["kind"], r["spec"]) for r in flows.sources_in_order(groups).collect()] == [("rss", "a"), ("rss", "B"), ("hn", "b")]
    cache = spark.createDataFrame([(1, dt.datetime(2024, 4, 30)), (2, dt.datetime(2024, 4, 20)), (3, None)], "k int, fetched_at timestamp_ntz")
    assert [r["k"] for r in flows.still_valid(cache, now(), 7).collect()] == [1]
    mine = spark.createDataFrame([("a", 1, " Data  Engineer"), ("b", 2, "Data Engineer"), ("c", 1, None)], "job_id string, company_id long, title string")
    board = spark.createDataFrame([("x", 1, "data engineer"), ("y", 1, "Data Engineer"), ("z", 1, None)], "job_id string, company_id long, title string")
    assert [tuple(r) for r in flows.titles_on_board(mine, board, norm_title).collect()] == [("a", "y")]


def test_store_updates(spark):
    stored = spark.createDataFrame([("a", 1, "open", None, None, None, "t", None, None, None), ("b", 1, None, None, None, None, "t", None, None, None)], STORE)
    got = {r["job_id"]: (r["status"], r["closed_at"]) for r in store.with_status(stored, spark.createDataFrame([("a", "closed"), ("q", "open")], "job_id string, status string"), now()).collect()}
    assert got == {"a": ("closed", AT), "b": (None, None)}
    companies = spark.createDataFrame([("Acme", True)], "name string, active boolean")
    seen = spark.createDataFrame([("ACME", "x"), (" Beta", None), ("beta", "https://beta.com"), ("", None), (None, None)], "name string, careers_url string")
    assert sorted(map(tuple, store.with_leads(companies, seen, "linkedin").collect())) == [("Acme", True), ("Beta", False)]
    bodies = spark.createDataFrame([("a", 1, None, "x" * 10), ("b", None, None, None), ("c", 1, "closed", None), ("d", 1, "open", "y" * 300)], "job_id string, company_id long, status string, description string")
    assert [r["job_id"] for r in store.short_descriptions(bodies).collect()] == ["a"]


def test_views(spark):
    rows = [("a", 1, 0.2, None, True), ("b", 5, None, ["watch"], True), ("c", 5, 0.1, [], False), ("d", 5, 0.9, [], True)]
    frame = spark.createDataFrame(rows, "name string, n_open long, mission_score double, tags array<string>, active boolean")
    assert [r["name"] for r in views.companies_tab(frame).collect()] == ["b", "d", "c", "a"]
    assert [r["name"] for r in views.companies_tab(frame, " D ", active_only=True).collect()] == ["d"]
    assert tuple(views.company_tiles(frame).first()) == (3, 1)
    scored = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.9), (4, 0.0)], "pos int, s double")
    assert [r["pos"] for r in views.matches_in_order(scored, "s", "pos").collect()] == [3, 2, 4, 1]
    synced = spark.createDataFrame([(1, "closed"), (1, "reopened"), (2, None), (3, "closed")], "company_id long, change string")
    assert tuple(views.change_counts(synced).first()) == (1, 2, 2)
    checked = views.board_health(spark.createDataFrame([("x", "n", 200, 3), ("a", "n", 200, None), ("b", "n", None, None), ("c", "n", 500, 9)], "ats string, name string, status int, n_jobs long"))
    assert [(r["ats"], r["health"]) for r in checked.collect()] == [("a", "degraded"), ("b", "blocked"), ("c", "broken"), ("x", "ok")]
    assert tuple(views.health_counts(checked).first()) == (4, 1, 1, 1, 1)
    shown = views.job_rows(spark.createDataFrame([("a", None)], "job_id string, location string"), F.lit("2024-01-01").cast("date"), "durham").first().asDict()
    assert len(shown) == 30 and (shown["age"], shown["geo_bucket"], shown["us_ok"], shown["watched"], shown["rank"]) == ("?", "relocation", True, False, None)
    assert len(views.detail(spark.createDataFrame([("a", "x" * 5000)], "job_id string, description string"), "a").first()["description"]) == 4000


def test_header_fields(spark):
    texts = {
        "Acme (YC S21) | Senior Engineer | Remote | $100k": ("Acme", "Senior Engineer", "Remote"),
        "Acme | Boston | full-time | https://x.org\nwords\n- Data Scientist": ("Acme", "Data Scientist", "Boston"),
        "Acme | Boston | Chief of Staff": ("Acme", "Chief of Staff", "Boston"),
        "Acme Labs. We hire": ("Acme Labs", None, None),
        "": (None, None, None),
    }
    f = feeds.header_fields(F.col("t"))
    assert one(spark, [(t,) for t in texts], "t string", f["company"], f["role"], f["location"]) == list(texts.values())
    threads = spark.createDataFrame([(1, "Ask HN: Who is hiring? (May)"), (2, "Who wants to be hired?")], "thread_id long, title string")
    comments = spark.createDataFrame([(10, 1, "Acme | Data Engineer | Remote<p>See https://acme.com/jobs"), (11, 2, "Me | Engineer"), (12, 1, None)], "comment_id long, thread_id long, text string")
    assert [(r["job_id"], r["title"], r["url"]) for r in feeds.hiring_posts(threads, comments).collect()] == [("hn_10", "Data Engineer", "https://acme.com/jobs")]


def test_captured_pages(spark):
    guest = '<div class="base-card x"><a href="https://www.linkedin.com/jobs/view/data-engineer-at-acme-77?ref=1">t</a><h3 class="base-search-card__title">Data Engineer</h3><h4 class="base-search-card__subtitle">Acme</h4><span class="job-search-card__location">Cary, NC</span></div>'
    detail = '<html><head><title>(3) Dev Ops | Acme | LinkedIn</title></head><a href="/jobs/view/5/">Dev OpsDev Ops</a><a href="/jobs/view/6/">Apply</a><span>Durham, NC (Hybrid)</span><h2>About the job</h2><p>Do things.</p></html>'
    rows = [(1, "https://www.linkedin.com/jobs", guest), (2, "", detail), (3, "file:x", "<p>nothing</p>"), (4, None, None), (5, "https://x.org/careers", '<a href="/jobs/data-engineer">Data Engineer</a>')]
    got = {r["page_id"]: r for r in pages.captured(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got) == {1, 2, 5}
    assert tuple(got[1])[1:] == ("linkedin", "linkedin_77", "Data Engineer", "Acme", "https://www.linkedin.com/jobs/view/77/", "Cary, NC", "")
    assert tuple(got[2])[1:] == ("linkedin", "linkedin_5", "Dev Ops", "Acme", "https://www.linkedin.com/jobs/view/5/", "Durham, NC (Hybrid)", "Do things.")
    assert got[5]["title"] == "Data Engineer"


def test_career_pages(spark):
    html = '<a href="/about">About</a><a href="/current-openings">See open roles</a><a href="https://indeed.com/jobs">Open jobs</a>' + "".join(f'<a href="/careers/role-{i}">Role {i} Durham, NC</a>' for i in range(3)) + '<a href="/careers/open-positions">Open positions</a>'
    frame = spark.createDataFrame([("https://acme.com/careers", html), ("https://b.com", None)], "url string, html string")
    assert sorted((r["url"], r["location"]) for r in pages.custom_postings(frame, F.lit("Acme")).collect()) == [(f"https://acme.com/careers/role-{i}", "Durham, NC") for i in range(3)]
    assert [tuple(r) for r in pages.is_board(frame).collect()] == [("https://acme.com/careers", 3)]
    assert [tuple(r) for r in pages.openings_links(frame).collect()] == [("https://acme.com/careers", "https://acme.com/current-openings")]
    rows = [("https://www.linkedin.com/acme", "https://acme.com/x"), (None, "ftp://x"), ("https://a.org", None)]
    assert one(spark, rows, "a string, b string", pages.own_site("a", "b")) == [("https://acme.com",), (None,), ("https://a.org",)]
    base = [("https://a.org/x/y?q", "z"), ("https://a.org", "z"), ("https://a.org/x/", "/z"), ("https://a.org/x", "//b.org/z"), ("https://a.org/x", "http://c.org")]
    assert one(spark, base, "b string, h string", pages.absolute(F.col("b"), F.col("h"))) == [("https://a.org/x/z",), ("https://a.org/z",), ("https://a.org/z",), ("https://b.org/z",), ("http://c.org",)]


def test_listings_of_nothing(spark):
    schema = "board string, company string, url string, html string"
    for empty in (spark.createDataFrame([], schema), spark.createDataFrame([("b", "c", None, None), ("b", "c", "https://x.org", "")], schema)):
        bodies = empty.withColumnRenamed("html", "body")
        frames = [listings.jazzhr(empty, empty), listings.successfactors(empty), listings.icims(empty, bodies, empty), listings.kula(empty), listings.peopleadmin(bodies, "x"), listings.nlx(bodies.withColumn("status", F.lit(200)))]
        assert [f.count() for f in frames] == [0] * 6


def test_a_whole_crawl_is_scored_guarded_and_stored(spark):
    """New postings are judged, or stored unscored where the guard stops; they are not new again; known ones are seen."""
    profile = Profile(vocabulary=Vocabulary(core=("eeg",), skill=("python",)), technical_title="engineer|scientist", local_words=("nc",), local_names=("durham",))
    schema = "job_id string, company_id long, company_name string, title string, url string, location string, description string, posted_at string, status string, closed_at string, first_seen string, last_seen string, geo_mode string, track array<string>, resume_fit_score double, fit_reason string, fit_gates array<string>, fit_domain double, fit_function double, fit_stack double, fit_seniority double"
    stored = spark.createDataFrame([("k", 1, "Acme", "Data Engineer", "u", "Durham, NC", "EEG", None, "closed", "t0", "t0", "t0", "onsite", ["x"], 0.4, "old", None, None, None, None, None)], schema)
    body = "EEG with Python. " * 20
    fetched = spark.createDataFrame([(1, "k", "Data Engineer", "u", "Durham, NC", body, None), (1, "n", "Engineer", "u2", "Durham, NC", body, "2024-01-01"), (1, "x", "Chef", "u3", "Durham, NC", body, None), (2, "w", "Scientist", "u4", "Boston, MA", body, None)], "company_id long, job_id string, title string, url string, location string, description string, posted_at string")
    companies = spark.createDataFrame([(1, "Acme", ["local"]), (2, "Brain", ["watch"])], "company_id long, name string, tags array<string>")
    now = F.lit("t1")
    first, funnel, said = flows.crawl(stored, fetched, companies, profile, now, judging.keyword_scorer(profile), track="t", excludes=False)
    got = {r["job_id"]: r for r in first.collect()}
    assert set(got) == {"k", "n", "w"} and said["scored"] and not said["stopped"]
    assert got["n"]["resume_fit_score"] > 0 and got["n"]["track"] == ["t"] and got["n"]["is_new"] and got["n"]["first_seen"] == "t1"
    assert got["w"]["resume_fit_score"] is None and (got["k"]["status"], got["k"]["last_seen"], got["k"]["resume_fit_score"], got["k"]["is_new"]) == ("open", "t1", 0.4, False)
    assert {r["company_name"]: r["fresh"] for r in funnel.collect()} == {"Acme": 1, "Brain": 0}
    unscored, _, said = flows.crawl(stored, fetched, companies, profile, now, judging.keyword_scorer(profile), guard=-1, track="t", excludes=False)
    assert said["stopped"] and {r["job_id"]: r["resume_fit_score"] for r in unscored.collect()} == {"k": 0.4, "n": None, "w": None}
    again, funnel, _ = flows.crawl(unscored.drop("is_new"), fetched, companies, profile, now, excludes=False)
    assert again.where("is_new").count() == 0 and sum(r["fresh"] for r in funnel.collect()) == 0


def lines(frame):
    return [r["line"] for r in frame.orderBy("pos").collect()]


def test_reports(spark):
    matches = spark.createDataFrame([("Acme", "A | B", "u", "Durham", "eeg", None, 0.5, True), (None, "C", "v", None, None, "remote", None, False)], "company string, title string, url string, location string, neural_signal string, remote_signal string, resume_fit_score double, remote_eligible boolean")
    got = lines(reports.matches_digest(matches, "neural", "2024-01-01", [F.desc_nulls_last("resume_fit_score")]))
    assert got[1] == "2 posting(s), 1 of them remote-eligible" and got[2].startswith("| Fit |") and got[4].startswith("| 0.50 | [neural] | Acme | [A \\| B](u)") and "n/a" in got[5]
    assert lines(reports.matches_digest(matches.limit(0), "n", "d", [F.col("title")]))[1:] == ["No posting this time"]
    rows = [("keyword", "eeg", "a"), ("keyword", " eeg", "b"), ("keyword", "BCI", "a"), ("title", "Analyst", "a"), ("keyword", "", "a")]
    found = reports.suggestions(spark.createDataFrame(rows, "kind string, term string, seed string"), ("Bci",))
    assert [(r["term"], r["surfaced"], r["listed"]) for r in found.where("kind = 'keyword'").orderBy("rank").collect()] == [("eeg", 2, False), ("BCI", 1, True)]
    report = lines(reports.suggestion_report(found, (("keyword", "Keywords"), ("title", "Titles"), ("sector", "Sectors")), "today"))
    assert report[0] == "# Suggestions of today" and report.index("## Keywords") < report.index("| `eeg` | 2 | new |") < report.index("## Titles") < report.index("## Sectors")
    health = spark.createDataFrame([("lever", "V", "ok", 5, None), ("ashby", "W", "broken", 0, "404"), ("kula", "P", "ok", 1, "")], "ats string, name string, status string, jobs int, detail string")
    table = lines(reports.health_report(health, "noon"))
    assert table[1] == "2/3 platforms healthy, checked noon" and [x.split("`")[1] for x in table[4:]] == ["kula", "lever", "ashby"]
    assert json.loads(reports.health_badge(health).first()[0]) == {"schemaVersion": 1, "label": "boards", "message": "2/3 healthy", "color": "red"}
    whole = json.loads(reports.health_json(health, "noon").first()[0])
    assert (whole["healthy"], whole["total"], whole["boards"][0]["ats"]) == (2, 3, "ashby")
