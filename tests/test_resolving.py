"""Workday's places, paging, probes, stages of resolving and the table of platforms."""

import json

import pytest
from pyspark.sql import functions as F

from postlake.operators import resolving
from postlake.sources import dispatch, paging, workday


def facets(spark, body):
    return spark.createDataFrame([("b", 200, body if isinstance(body, str) else json.dumps(body))], "board string, status int, body string")


def test_facets_at_any_depth(spark):
    inner = {"id": "deep", "descriptor": "Cary, NC"}
    for depth in range(6):
        inner = {"id": f"d{depth}", "descriptor": "Region", "values": [inner]}
    body = {"facets": [{"facetParameter": "locations", "values": [inner, {"id": "x", "descriptor": "Durham, NC", "facetParameter": "cities"}, {"id": "", "descriptor": "NC"}]}, {"facetParameter": "workerType", "values": [{"id": "no", "descriptor": "NC"}]}, {"facetParameter": "city"}]}
    assert {(r["param"], tuple(r["ids"])) for r in workday.place_facets(facets(spark, body), "NC").collect()} == {("locations", ("deep",)), ("cities", ("x",))}
    for broken in ("", "[]", '{"facets": {"a": 1}}', "not json"):
        assert workday.place_facets(facets(spark, broken), "NC").collect() == []


def test_several_places(spark):
    rows = [("a", "/job/Boston/R1", "2 Locations"), ("b", "/job/Boston/R2", "2 Locations"), ("c", "/job/Cary-NC/R3", "12 locations"), ("d", None, "3 Locations"), ("e", "/job/x/R5", None)]
    listed = spark.createDataFrame(rows, "k string, path string, location string").withColumn("board", F.lit("b"))
    detail = [("b", "/job/Boston/R1", 200, json.dumps({"jobPostingInfo": {"location": "Boston, MA", "additionalLocations": ["Durham, NC", ""]}})), ("b", "/job/Boston/R2", 500, "")]
    details = spark.createDataFrame(detail, "board string, path string, status int, body string")
    assert {r["k"]: r["location"] for r in workday.located(listed, details, "NC").collect()} == {"a": "Boston, MA; Durham, NC", "c": "Cary NC (12 locations)"}
    everywhere = {r["k"]: r["location"] for r in workday.located(listed, details).collect()}
    assert everywhere == {"a": "Boston, MA; Durham, NC", "b": "2 Locations", "c": "12 locations", "d": "3 Locations", "e": ""}


def test_workday_addresses(spark):
    urls = ["https://vhr-u.wd5.myworkdayjobs.com/en-US/Ext/job/Durham-NC/Eng_R1?x=1", "https://t.wd1.myworkdayjobs.com/Ext/job/A/B", "https://t.wd1.myworkdayjobs.com/job/A", "https://x.org/job/1", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(workday.detail_url(F.col("u"))).collect()]
    assert got == ["https://vhr-u.wd5.myworkdayjobs.com/wday/cxs/vhr-u/Ext/job/Durham-NC/Eng_R1", "https://t.wd1.myworkdayjobs.com/wday/cxs/t/Ext/job/A/B", None, None, None]
    answers = [("v-u", 5, "Ext", "v-u", 422, ""), ("v-u", 5, "Ext", "v_u", 200, '{"total": 3}'), ("t", 1, "E", "t", 200, '{"total": "many"}'), ("w-x", 1, "E", "w-x", 200, '{"total": 0}'), ("w-x", 1, "E", "w_x", 200, '{"total": 5}')]
    frame = spark.createDataFrame(answers, "tenant string, pod int, site string, id string, status int, body string")
    assert {r["tenant"]: r["id"] for r in workday.tenants(frame).collect()} == {"v-u": "v_u", "t": "t", "w-x": "w-x"}


@pytest.mark.parametrize(
    "pages, size, wanted",
    [
        ([(0, 200, 20), (1, 200, 20), (2, 200, 5), (3, 200, 20)], 20, [0, 1, 2]),
        ([(0, 200, 20), (1, 500, 0), (2, 200, 20)], 20, [0]),
        ([(0, 200, 20), (2, 200, 20)], 20, [0]),
        ([(1, 200, 20)], 20, []),
        ([(0, 200, 0)], 20, []),
        ([(0, 500, None), (0, 200, 20), (1, 200, 0), (1, 200, 7)], 20, [0, 1]),
        ([(0, 200, 3), (1, 200, 1)], None, [0, 1]),
    ],
)
def test_where_a_listing_ends(spark, pages, size, wanted):
    frame = spark.createDataFrame([("b", *p) for p in pages], "board string, page int, status int, n int")
    assert sorted(r["page"] for r in paging.ended(frame, size).collect()) == wanted


def test_last_page_by_number_and_dry_pages(spark):
    frame = spark.createDataFrame([("b", p, 200, 9, 2) for p in range(4)], "board string, page int, status int, n int, pages int")
    assert sorted(r["page"] for r in paging.ended(frame, last="pages").collect()) == [0, 1]
    items = [("b", 0, "x"), ("b", 0, "y"), ("b", 1, "y"), ("b", 1, "z"), ("b", 2, "x"), ("b", 3, "new"), ("c", 1, "x")]
    got = paging.new_until_none(spark.createDataFrame(items, "board string, page int, url string"), "url").collect()
    assert {(r["board"], r["url"], r["page"]) for r in got} == {("b", "x", 0), ("b", "y", 0), ("b", "z", 1)}


def test_a_stage_sees_only_what_is_left(spark):
    seen = []

    def stage(names):
        def run(rest):
            seen.append(sorted(r["company"] for r in rest.collect()))
            return rest.where(F.col("company").isin(*names)).select("company")

        return run

    rows = spark.createDataFrame([(c,) for c in "abcd"], "company string")
    got = {r["company"]: r["via"] for r in resolving.by_stages(rows, "company", [("one", stage("ac")), ("two", stage("abc")), ("three", stage("x"))]).collect()}
    assert got == {"a": "one", "c": "one", "b": "two"} and seen == [["a", "b", "c", "d"], ["b", "d"], ["d"]]


def test_search_results_in_their_order(spark):
    leads = spark.createDataFrame([("Acme Robotics",)], "company string")
    page = '<a href="https://jobs.lever.co/other">x</a>'
    results = spark.createDataFrame([("Acme Robotics", 0, "https://jobs.lever.co/elsewhere", ""), ("Acme Robotics", 1, "https://acmerobotics.com/careers", page), ("Acme Robotics", 2, "https://jobs.ashbyhq.com/acmerobotics", "")], "company string, pos int, url string, html string")
    none = spark.createDataFrame([], "company string, url string, html string")
    boards = spark.createDataFrame([("lever", "elsewhere", 4, 0), ("lever", "other", 4, 1), ("ashby", "acmerobotics", 0, 0)], "ats string, slug string, n_jobs int, n_local int")
    assert [tuple(r) for r in resolving.resolved(leads, boards, none, results).collect()] == [("Acme Robotics", "lever", "other", "https://acmerobotics.com/careers", 4, 1, "search")]


def test_every_platform_by_one_table(spark):
    gh = json.dumps({"jobs": [{"id": 7, "title": "Engineer", "absolute_url": "https://x/7", "location": {"name": "Durham, NC"}}]})
    rows = [
        ("greenhouse", "acme", "Acme", None, gh, 200), ("greenhouse", "gone", "Gone", None, gh, 404), ("kula", "acme", "Acme", "https://careers.kula.ai/acme", '<div><p>Lab group</p><h3>Scientist</h3><p>Cary, NC</p><a href="/acme/1">Go</a></div>', 200),
        ("successfactors", "duke", "Duke", "https://careers.duke.org/search/", '<a class="jobTitle-link" href="/job/Durham,-NC-Nurse/12/">Nurse</a>', 200), ("custom", "own", "Own", "https://own.com/careers", '<div>Austin, TX<a href="/jobs/role-1">Own role</a></div><a href="/jobs/role-2">Two role</a><a href="/jobs/role-3">Third role</a>', 200),
        ("peopleadmin", "uni", "Uni", None, '<feed><title>Uni</title><entry><title>Dean</title><link href="https://uni.edu/postings/5"/><summary>In Durham now</summary></entry></feed>', 200), ("nothing", "x", "X", None, "{}", 200),
    ]
    bronze = spark.createDataFrame(rows, "platform string, board string, company string, url string, body string, status int")
    details = spark.createDataFrame([], "url string, html string")
    got = {(r["platform"], r["title"], r["company"], r["location"]) for r in dispatch.postings(bronze, details, F.current_date(), "(?i)(Durham|Cary)").collect()}
    assert {("greenhouse", "Engineer", "Acme", "Durham, NC"), ("kula", "Scientist", "Acme", "Cary, NC"), ("successfactors", "Nurse", "Duke", "Durham, NC"), ("custom", "Own role", "Own", "Austin, TX"), ("peopleadmin", "Dean", "Uni", "Durham")} <= got and len(got) == 7
    counts = {(r["platform"], r["board"]): (r["n_jobs"], r["n_local"]) for r in dispatch.board_counts(bronze, "NC").collect()}
    assert counts[("greenhouse", "acme")] == (1, 1)
    companies = spark.createDataFrame([("A",), ("B",), ("C",)], "company string")
    found = spark.createDataFrame([("A", "Durham, NC")], "company string, location string")
    own = spark.createDataFrame([("B", "<p>Durham, NC"), ("C", None)], "company string, html string")
    assert {r["company"]: r["has_office"] for r in dispatch.has_office(companies, found, own, "Durham, NC").collect()} == {"A": True, "B": True, "C": False}
