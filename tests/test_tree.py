"""Page trees and the parsers on them: nested, unclosed, reordered and broken markup."""

import time

import pytest
from pyspark.sql import functions as F

from postlake.sources import listings, pages, tree


def page(spark, html, url="https://a.com/careers"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def one(spark, html, column):
    return tree.tree(page(spark, html), "url").select(column).first()[0]


@pytest.mark.parametrize(
    "html, text",
    [("<ul><li>a<li>b</ul>c", ["a", "b"]), ("<p>one<p>two<div>three</div>", ["one", "two", "three"]), ("<table><tr><td>x<td>y<tr><td>z</table>", ["x", "y", "z"]), ("</b>loose<b>bold", ["bold"]), ("<img src=x>after<br/>more", []), ("", []), (None, [])],
)
def test_elements_and_their_strings(spark, html, text):
    leaf = F.filter("elements", lambda e: tree.is_tag(e, "li", "p", "div", "td", "b"))
    assert one(spark, html, F.transform(leaf, tree.text_of)) == text


def test_ancestors_scripts_and_entities(spark):
    html = '<div id="1"><section><a HREF="/x?a=1&amp;b=2" CLASS="big job-title">R&amp;D<script>var t = "<p>no</p>"</script></a></section></div>'
    a = tree.all_of(lambda e: tree.is_tag(e, "a"))[0]
    got = tree.tree(page(spark, html), "url").select(tree.text_of(a), tree.attribute(a, "href"), F.transform(tree.ancestors(a), lambda e: e["tag"]), tree.climbed(a, lambda e: tree.is_tag(e, "div"))["attrs"], tree.has_class(a, "big"), tree.has_class(a, "job")).first()
    assert tuple(got) == ("R&D", "/x?a=1&b=2", ["section", "div", "[document]"], {"id": "1"}, True, False)


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert one(spark, deep, F.array_max(F.transform("elements", lambda e: F.size(e["above"])))) == tree.DEEPEST
    assert one(spark, deep, tree.text_of(F.col("elements")[0])) == "x"
    assert one(spark, "<a href='x", tree.text_of(F.col("elements")[0])) is not None
    assert one(spark, "<![CDATA[x]]><!DOCTYPE html><?php x ?>t", F.size("elements")) >= 1


def test_kula_climbs_eight_ancestors(spark):
    far = "<div>Research<b>Role</b>" + "<i>" * 9 + '<a href="/acme/12">Go</a>' + "</i>" * 9 + "</div>"
    near = "<div>Research<b>Role</b>" + "<i>" * 7 + '<a href="/acme/13">Go</a>' + "</i>" * 7 + "</div>"
    frame = spark.createDataFrame([("acme", "Acme", "https://careers.kula.ai/acme", far + near + '<a href="/acme/14x">no</a><a href="/other/15">no</a>')], "board string, company string, url string, html string")
    got = {r["job_id"]: (r["title"], r["location"]) for r in listings.kula(frame).collect()}
    assert got == {"kula_acme_12": ("Unknown", "See posting"), "kula_acme_13": ("Role", "See posting")}


def test_descriptions_of_containers(spark):
    long = "word " * 40
    rows = [("a", f'<div class="jobDisplay">{long}chrome</div><div class="job-description">{long}</div>'), ("b", f'<div class="job-description">short</div><div class="jobDisplay">{long}</div>'), ("c", None), ("d", f'<p class="description">{long}</p>')]
    got = {r["url"]: r["description"] for r in pages.descriptions(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"a": long.strip(), "b": "", "c": "", "d": ""}


def test_careers_links_take_headings_and_near_places(spark):
    html = '<div><a href="/jobs/alpha-1"><h2>Alpha</h2>Raleigh, NC</a></div><div>Durham, NC<span><a href="/jobs/beta-22">Beta role</a></span></div><a href="/jobs/alpha-1">Again</a><a href="/careers/team">Team page</a><a href="/jobs/gamma-3">view all roles</a>'
    got = {(r["href"], r["title"], r["location"]) for r in pages.careers_links(page(spark, html), "Durham, NC").collect()}
    assert got == {("/jobs/alpha-1", "Alpha", "Alpha Raleigh, NC"), ("/jobs/beta-22", "Beta role", "Durham, NC")}


def test_hop_is_taken_once_and_only_to_the_own_host(spark):
    first = page(spark, '<a href="/open-positions">Open positions</a>')
    far = page(spark, '<a href="https://b.com/openings">Openings</a>')
    hops = spark.createDataFrame([("https://a.com/open-positions", '<a href="/openings">More</a><a href="/jobs/role-1">Role one</a>'), ("https://a.com/openings", '<a href="/jobs/role-2">Role two</a>'), ("https://b.com/openings", '<a href="/jobs/role-3">Role three</a>')], "url string, html string")
    assert [r["title"] for r in pages.custom_postings(first, F.lit("A"), hops=hops).collect()] == ["Role one"]
    assert pages.custom_postings(far, F.lit("A"), hops=hops).collect() == []


def test_pages_share_batches(monkeypatch):
    """Trees of many pages come in few batches, each page with its own elements, attributes and strings."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([None if i == 7 else f'<p id="{i}" hidden>a{i}<b>c</b>' for i in range(300)])], names=["k", "html"])
    for together, number in ((1 << 18, 1), (1, 300)):
        monkeypatch.setattr(tree, "_TOGETHER", together)
        out = list(tree._parsed(iter([batch])))
        assert len(out) == number
        rows = pa.Table.from_batches(out).to_pylist()
        assert [r["k"] for r in rows] == list(range(300)) and rows[7]["strings"] == [] and len(rows[7]["elements"]) == 1
        assert rows[8]["strings"] == ["a8", "c"] and rows[8]["elements"][1]["attrs"] == [("id", "8"), ("hidden", "")]
        assert [e["above"] for e in rows[299]["elements"]] == [[], [0], [1, 0]]


def test_kula_reads_a_long_page_once(spark):
    """Of 5,000 links on one page none looks at the whole page's lines, which the document, an ancestor of each, holds."""
    html = "".join(f"<div><p>Labs\n  of  \n x</p><h3>Role {i}</h3><p>\n Cary, NC;b </p><a href='/acme/{i}'>Go</a></div>" for i in range(5000))
    frame = spark.createDataFrame([("acme", "Acme", "https://careers.kula.ai/acme", html)], "board string, company string, url string, html string")
    begun = time.monotonic()
    got = {(r["job_id"], r["title"], r["location"]) for r in listings.kula(frame).collect()}
    assert got == {(f"kula_acme_{i}", f"Role {i}", "Cary, NC") for i in range(5000)}
    assert time.monotonic() - begun < 15
