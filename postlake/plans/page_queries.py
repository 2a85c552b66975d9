"""Queries of parsers that need a page's tree; each order is a page, in markup that is nested, unclosed or out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.plans.queries import dealt, query, table
from postlake.sources import listings, pages

_DECOY = '<nav><ul><li><a href="/about">About us<li><a href="/c0x/9/">Elsewhere and more</ul></nav>'


def _pages(spark: SparkSession, d: str, forms: tuple[str, ...], urls: tuple[str, ...]) -> DataFrame:
    """A page for each order, in the form of its number's remainder; %1$d is the order and %2$d the customer."""
    fill = lambda x: F.format_string(x, "o_orderkey", "o_custkey")
    of = lambda xs: F.get(F.array(*map(fill, xs)), (F.col("o_orderkey") % len(xs)).cast("int"))
    return dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", of(urls).alias("url"), of(forms).alias("html"))


_KULA = (
    _DECOY + '<div class="card"><section><p>Research<h3>Role %1$d</h3><p>Durham, NC; Boston, MA<div><span><b><a href="/c%2$d/%1$d">Go</a></b></span></div></section></div>',
    _DECOY + '<ol><li><div><a href="https://careers.kula.ai/c%2$d/%1$d/"><i>Go</i></a></div><div>Research<div>Role %1$d<div>Cary, NC</div><li><div>Other<div>Other role</ol>',
    '<html><body><script>var a = "<p>Hidden words</p>";</script><table><tr><td>Role %1$d<td><a href="/c%2$d/%1$d">x</a></table>',
    '<main>\n<article>Research\nRole %1$d\n<a href="/c%2$d/%1$d"></a></article>' + _DECOY + "</main>",
)


@query("""SELECT concat('kula_c', o_custkey, '_', o_orderkey) AS job_id, concat('Role ', o_orderkey) AS title, ['Durham, NC', 'Cary, NC', 'See posting', 'See posting'][1 + o_orderkey % 4] AS location,
 concat('https://careers.kula.ai/c', o_custkey, '/', o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN '/' ELSE '' END) AS url FROM orders""")
def kula_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards by climbing from the link: nested ones, unclosed ones, one line only and lines in one string."""
    seen = _pages(spark, d, _KULA, ("https://careers.kula.ai/c%2$d",))
    rows = seen.select(F.concat(F.lit("c"), "o_custkey").alias("board"), F.lit("Kula").alias("company"), "url", "html")
    return listings.kula(rows).select("job_id", "title", "location", "url")


_META = (
    '<ul><li><div><a href="/profile/job_details/%1$d/"><span>Save</span><h3>Engineer, Reality %1$d</h3></a><p>Menlo Park, CA<li><a href="/profile/job_details/9999%1$d/?x=1">Analyst</a>Remote, US</ul>',
    '<head><meta property="og:title" content="Role %1$d | Meta Careers"><meta property="og:description" content="All about %1$d"><title>Meta</title></head><body><h1>Role %1$d</h1><p>Austin, TX',
    '<title>Role %1$d - Meta Careers</title><div><div><a href="/profile/job_details/%1$d/"></a></div><h4>Role</h4>Multiple Locations</div>',
)


@query("""SELECT o_orderkey AS page_id, concat('meta_', n) AS job_id, title, location, description FROM (
 SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS n, CASE WHEN o_orderkey % 3 = 0 THEN concat('Engineer, Reality ', o_orderkey) ELSE concat('Role ', o_orderkey) END AS title, ['Menlo Park, CA', 'Austin, TX', 'Multiple Locations'][1 + o_orderkey % 3] AS location, CASE WHEN o_orderkey % 3 = 1 THEN concat('All about ', o_orderkey) ELSE '' END AS description FROM orders
 UNION ALL SELECT o_orderkey, concat('9999', o_orderkey), 'Analyst', 'Remote, US', '' FROM orders WHERE o_orderkey % 3 = 0)""")
def meta_pages(spark: SparkSession, d: str) -> DataFrame:
    """Meta's listing and detail pages, and a page that is both."""
    detail = "https://www.metacareers.com/profile/job_details/%1$d/"
    seen = _pages(spark, d, _META, ("https://www.metacareers.com/jobs", detail, detail))
    return pages.metacareers(seen.withColumnRenamed("o_orderkey", "page_id")).select("page_id", "job_id", "title", "location", "description")


_TEXT = "Work on things. " * 8
_DETAIL = (
    f'<div class="jobDisplay">Chrome {_TEXT}</div><div><span data-careersite-propertyid="description"><p>Order %1$d <b>{_TEXT}',
    f'<div class="x _flow job-description"><p>Order %1$d<p>{_TEXT}<script>var x = 1</script></div><p>Footer',
    '<div class="jobDescription">Order %1$d</div>',
    f'<script type="application/ld+json">{{"@type": "JobPosting", "title": "T", "description": "<p>Order %1$d</p> {_TEXT}"}}</script><div class="jobDisplay">Other {_TEXT}</div>',
    f"<div>No container, Order %1$d {_TEXT}</div>",
)


@query(f"SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 IN (2, 4) THEN '' ELSE concat('Order ', o_orderkey, ' {_TEXT.strip()}') END AS description FROM orders")
def page_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """A posting's text from its own page: linked data, the surest container with 120 characters, or none."""
    seen = _pages(spark, d, _DETAIL, ("u",)).select(F.col("o_orderkey").alias("page_id"), "html")
    return pages.descriptions(seen, "page_id").select("page_id", F.trim(F.regexp_replace("description", r"\s+", " ")).alias("description"))


_CAREERS = (
    '<ul><li><a href="/careers/role-%1$d"><h3>Role %1$d</h3><p>Alameda, CA | Durham, NC</a><li><a href="/jobs/second-%1$d"><span class="job-title">Second</span> Boston, MA</a><li><div><a href="/jobs/third-%1$d">Third role</a></div><div>Durham, NC</div><li><a href="/careers/benefits">Benefits here</a></ul>',
    '<p>We hire. <a href="/openings">See current openings</a> <a href="https://www.indeed.com/jobs/x">All open jobs</a>',
    '<p>Nothing here. <a href="/about">About</a>',
)
_OPENINGS = '<div class="row"><div><a href="/positions/hop-%1$d">Hop role %1$d</a></div><span>Durham, NC</span></div>'


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('Role ', o_orderkey) ELSE concat('Hop role ', o_orderkey) END AS title, 'Durham, NC' AS location, concat('https://c', o_orderkey, '.com', CASE WHEN o_orderkey % 3 = 0 THEN '/careers/role-' ELSE '/positions/hop-' END, o_orderkey) AS url, concat('https://c', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '.com/careers' ELSE '.com/openings' END) AS page FROM orders WHERE o_orderkey % 3 < 2
UNION ALL SELECT 'Third role', 'Durham, NC', concat('https://c', o_orderkey, '.com/jobs/third-', o_orderkey), concat('https://c', o_orderkey, '.com/careers') FROM orders WHERE o_orderkey % 3 = 0""")
def career_places(spark: SparkSession, d: str) -> DataFrame:
    """Postings in Durham of employers' own pages, by the place nearest to the link, one hop to an openings page where the first has few links."""
    seen = _pages(spark, d, _CAREERS, ("https://c%1$d.com/careers",))
    hops = _pages(spark, d, (_OPENINGS,), ("https://c%1$d.com/openings",))
    rows = pages.custom_postings(seen.select("url", "html"), F.lit("Acme"), "Durham, NC", hops=hops.select("url", "html"))
    return rows.select("title", "location", "url", "page")
