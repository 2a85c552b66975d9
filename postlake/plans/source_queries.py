"""Queries of Workday's places and texts, of paging, of probes and of resolving names to boards; payloads are built from the given tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators import resolving
from postlake.plans.queries import dealt, query, table
from postlake.sources import paging, workday

LOCAL = r"\bNC\b|North Carolina"


def _of(forms, number: str, *args: str):
    """The form that a number's remainder picks, filled with columns."""
    fill = lambda x: F.lit(None).cast("string") if x is None else F.format_string(x, *args)
    return F.get(F.array(*map(fill, forms)), (F.col(number) % len(forms)).cast("int"))


_FACETS = """{"facets": [{"facetParameter": "jobFamily", "values": [{"id": "no", "descriptor": "Durham, NC"}]},
 {"facetParameter": "locationMainGroup", "values": [{"facetParameter": "locationHierarchy", "descriptor": "US", "values": [{"id": "s%1$d", "descriptor": "North Carolina", "values": [{"id": "d%1$d", "descriptor": "Durham, NC"}, {"id": "s%1$d", "descriptor": "North Carolina"}]}, {"id": "t", "descriptor": "Texas"}]}, {"id": "l%1$d", "descriptor": "Cary, NC"}, {"descriptor": "NC"}]}]}"""


@query("""SELECT concat('c', c_custkey) AS board, param, CASE param WHEN 'locationHierarchy' THEN [concat('d', c_custkey), concat('s', c_custkey)] ELSE [concat('l', c_custkey)] END AS ids FROM customer, (VALUES ('locationHierarchy'), ('locationMainGroup')) p(param) WHERE c_custkey % 4 = 0""")
def workday_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facet values of local places at three depths, one of them named twice."""
    body = _of((_FACETS, '{"facets": []}', "<html>", None), "c_custkey", "c_custkey")
    bronze = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("board"), F.lit(200).alias("status"), body.alias("body"))
    return workday.place_facets(bronze, LOCAL)


@query("""SELECT o_orderkey, CASE r WHEN 0 THEN 'Durham, NC' WHEN 1 THEN 'US NC Remote (2 Locations)' WHEN 2 THEN concat('Boston, MA; Cary, NC ', o_orderkey) WHEN 5 THEN 'US NC Cary' END AS location FROM (SELECT o_orderkey, o_orderkey % 7 AS r FROM orders) WHERE r IN (0, 1, 2, 5)""")
def workday_located(spark: SparkSession, d: str) -> DataFrame:
    """Postings kept by their place, by their path and by their detail's list; others go."""
    place = _of(("Durham, NC", "2 Locations", "3 Locations", "2 Locations", "4 locations ", "", "Austin, TX"), "o_orderkey")
    path = _of(("/job/Durham/A_%1$d", "/job/US-NC-Remote/B_%1$d", "/job/Boston/C_%1$d", "/job/Boston/D_%1$d", "/job/Boston/E_%1$d", "/job/US-NC-Cary/F_%1$d", "/job/Austin/G_%1$d"), "o_orderkey", "o_orderkey")
    listed = table(spark, d, "orders").select("o_orderkey", F.lit("b").alias("board"), path.alias("path"), place.alias("location"))
    detail = '{"jobPostingInfo": {"location": "Boston, MA", "additionalLocations": ["%s"]}}'
    place = F.when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit("Cary, NC "), "o_orderkey")).otherwise("Reno, NV")
    details = listed.where("o_orderkey % 7 IN (2, 3, 6)").select("board", "path", F.lit(200).alias("status"), F.format_string(detail, place).alias("body"))
    return workday.located(listed, details, LOCAL).select("o_orderkey", "location")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('Text of ', o_orderkey) WHEN 1 THEN 'Posted Today' WHEN 2 THEN repeat('long ', 50) ELSE concat('Text of ', o_orderkey) END AS description FROM orders""")
def workday_texts(spark: SparkSession, d: str) -> DataFrame:
    """Short texts by the details of the site's interface, whose path may have the tenant's id with underscores."""
    url = _of(("https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/Durham/R_%1$d", "https://acme.wd5.myworkdayjobs.com/Ext/job/Durham/none_%1$d", "https://acme.wd5.myworkdayjobs.com/Ext/job/Durham/R_%1$d", "https://a-b.wd1.myworkdayjobs.com/Ext/job/Cary/R_%1$d"), "o_orderkey", "o_orderkey")
    text = _of(("Posted Today", "Posted Today", "long " * 50, ""), "o_orderkey")
    tenant = F.when(F.col("o_orderkey") % 4 == 3, "a_b")
    postings = table(spark, d, "orders").select("o_orderkey", url.alias("url"), text.alias("description"), tenant.alias("tenant_id"))
    api = _of(("https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Ext/job/Durham/R_%1$d", None, "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Ext/job/Durham/R_%1$d", "https://a-b.wd1.myworkdayjobs.com/wday/cxs/a_b/Ext/job/Cary/R_%1$d"), "o_orderkey", "o_orderkey")
    details = postings.select(api.alias("url"), F.lit(200).alias("status"), F.format_string('{"jobPostingInfo": {"jobDescription": "<p>Text of <b>%d</b></p>"}}', "o_orderkey").alias("body"))
    return workday.described(postings, details).select("o_orderkey", F.regexp_replace("description", r"\n$", "").alias("description"))


@query("""WITH p AS (SELECT l_orderkey AS board, l_linenumber - 1 AS page, max(CASE WHEN l_tax < 0.07 THEN CAST(l_quantity AS INTEGER) END) AS n FROM lineitem GROUP BY ALL)
SELECT board, page, n FROM p WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p q WHERE q.board = p.board AND q.page < p.page AND (q.n IS NULL OR q.n < 10)) AND (SELECT count(*) FROM p q WHERE q.board = p.board AND q.page < p.page) = page""")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as pages of listings: failed ones, gaps and short pages end a listing."""
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("board"), (F.col("l_linenumber") - 1).alias("page"), F.when(F.col("l_tax") < 0.07, 200).otherwise(500).alias("status"), F.col("l_quantity").cast("int").alias("n"))
    return paging.ended(pages, size=10)


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS board, l_linenumber - 1 AS page, l_suppkey % 5 AS address FROM lineitem),
first AS (SELECT board, address, min(page) AS page FROM i GROUP BY ALL),
dry AS (SELECT board, min(page) AS page FROM (SELECT DISTINCT board, x.page FROM i, (SELECT unnest(range(8)) AS page) x) c WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.board = c.board AND f.page = c.page) GROUP BY board)
SELECT board, address, page FROM first JOIN dry USING (board) WHERE first.page < dry.page""".replace("JOIN dry USING (board)", "JOIN (SELECT board, page AS stop FROM dry) USING (board)").replace("first.page < dry.page", "page < stop"))
def listing_until_dry(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as pages that name addresses: the first page with nothing new ends a listing."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("board"), (F.col("l_linenumber") - 1).alias("page"), (F.col("l_suppkey") % 5).alias("address"))
    return paging.new_until_none(items, "address")


_ANSWERS = (
    ("greenhouse", '{"jobs": [{"id": %1$d}, {"id": 2}]}', 2), ("lever", "[]", 0), ("ashby", '{"jobPostings": [1]}', 1), ("kula", "k" * 1001, 0), ("kula", "short", None), ("jazzhr", '<a href="/apply/a%1$d/x"><a href="/apply/b/y">', 2),
    ("bamboohr", '{"result": null}', 0), ("smartrecruiters", '{"totalFound": 0}', None), ("smartrecruiters", '{"totalFound": 7}', 7), ("paylocity", 'var pageData = {"Jobs": [{"JobId": %1$d}]}; x', 1), ("paylocity", "<html>", None), ("rippling", "[1, 2, 3]", 3),
    ("rippling", '{"jobs": []}', None), ("ultipro", '{"opportunities": [1, 2]}', 2), ("greenhouse", "not json %1$d", None), ("unknown", "[]", None),
)


@query("SELECT c_custkey, ats, n IS NOT NULL AND c_nationkey > 0 AS ok, CASE WHEN c_nationkey > 0 THEN coalesce(n, 0) ELSE 0 END AS n_jobs FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{a}', {'NULL' if n is None else n})" for i, (a, _, n) in enumerate(_ANSWERS)) + ") v(i, ats, n) ON c_custkey % 16 = i")
def probe_class(spark: SparkSession, d: str) -> DataFrame:
    """What answers of ten platforms say of a board."""
    ats, body = _of([a for a, *_ in _ANSWERS], "c_custkey"), _of([b for _, b, _ in _ANSWERS], "c_custkey", "c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", ats.alias("ats"), F.when(F.col("c_nationkey") > 0, 200).otherwise(404).alias("status"), body.alias("body"))
    return rows.select("c_custkey", "ats", resolving.probe_class(F.col("ats"), F.col("status"), F.col("body")).alias("p")).select("c_custkey", "ats", "p.*")


# Employers by remainder: a board under another platform than claimed; two platforms for one slug; a guessed slug before the name; a page's board with its answer; a Workday page that is known; a lead only; a Workday page without an answer; nothing.
@query("""SELECT name AS company, CASE r WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'jazzhr' WHEN 4 THEN 'workday' WHEN 5 THEN 'unknown' WHEN 6 THEN 'workday' END AS ats,
 CASE r WHEN 0 THEN concat('acme', k) WHEN 1 THEN concat('acme', k) WHEN 2 THEN concat('guess-', k) WHEN 3 THEN concat('opaque', k) WHEN 4 THEN concat('t', k, '|5|Ext') WHEN 6 THEN concat('t', k, '|5|Ext') END AS slug,
 CAST(CASE r WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 9 ELSE 0 END AS INTEGER) AS n_jobs, r <> 5 AS confirmed, CASE r WHEN 5 THEN concat('eightfold @ acme', k, '.eightfold.ai') END AS lead,
 ['probe', 'probe', 'probe', 'sniff', 'sniff', 'lead', 'workday'][r + 1] AS via FROM (SELECT c_custkey AS k, concat('Acme ', c_custkey) AS name, c_custkey % 8 AS r FROM customer) WHERE r < 7""")
def validated_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by what confirms them, through all four stages."""
    c = dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("k"), F.concat(F.lit("Acme "), "c_custkey").alias("company"))
    candidates = c.select("company", _of(("greenhouse", "ashby", "greenhouse", "lever", None, "unknown", "workday", "lever"), "k").alias("ats"), _of((None, None, "guess-%1$d", None, None, None, None, None), "k", "k").alias("slug_guess"))
    answer = lambda rest, ats, slug, body: c.where(f"k % 8 = {rest}").select(F.lit(ats).alias("ats"), F.format_string(slug, "k").alias("slug"), F.lit(200).alias("status"), F.lit(body).alias("body"))
    answers = answer(0, "lever", "acme%d", "[1]").unionByName(answer(1, "greenhouse", "acme%d", '{"jobs": [1]}')).unionByName(answer(1, "ashby", "acme%d", '{"jobPostings": [1, 2]}'))
    answers = answers.unionByName(answer(2, "greenhouse", "guess-%d", '{"jobs": []}')).unionByName(answer(2, "lever", "acme%d", "[1]")).unionByName(answer(3, "jazzhr", "opaque%d", '<a href="/apply/x/y">'))
    page = _of((None, None, None, '<a href="https://opaque%1$d.applytojob.com/">', '<a href="https://t%1$d.wd5.myworkdayjobs.com/Ext">', '<a href="https://acme%1$d.eightfold.ai/careers">', '<a href="https://t%1$d.wd5.myworkdayjobs.com/Ext">', "<p>"), "k", "k")
    pages = c.select("company", F.lit("https://x.org/careers").alias("url"), page.alias("html"))
    known = c.where("k % 8 = 4").select(F.format_string("t%d|5|Ext", "k").alias("slug"), F.lit(9).alias("n_jobs"))
    return resolving.validated(candidates, answers, pages, known).select("company", "ats", "slug", "n_jobs", "confirmed", "lead", "via")


@query("""SELECT name AS company, ['greenhouse', 'custom', 'lever', 'ashby', 'workday', 'custom'][r + 1] AS ats,
 CASE r WHEN 0 THEN concat('board', k) WHEN 2 THEN concat('acme', k) WHEN 3 THEN concat('acme', k) WHEN 4 THEN concat('t', k, '|5|Ext') WHEN 1 THEN concat('https://acme', k, '.com/careers') ELSE concat('https://www.acme', k, '.org/jobs') END AS slug, r + 1 AS n_jobs, r AS n_local,
 ['sniff', 'sniff', 'probe', 'search', 'search', 'search'][r + 1] AS via FROM (SELECT c_custkey AS k, concat('Acme', c_custkey, ' Robotics') AS name, CAST(c_custkey % 8 AS INTEGER) AS r FROM customer) WHERE r < 6""")
def resolve_boards(spark: SparkSession, d: str) -> DataFrame:
    """Leads by the stage that finds their board; a dead board on the employer's page leaves the row to the next stage."""
    c = dealt(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("k"), F.format_string("Acme%d Robotics", "c_custkey").alias("company"), (F.col("c_custkey") % 8).cast("int").alias("r"))
    three = "".join(f'<a href="/careers/role-{i}x">Role number {i}</a>' for i in range(3))
    html = _of(('<a href="https://boards.greenhouse.io/board%1$d">', three, '<a href="https://boards.greenhouse.io/dead%1$d">', "", "", "", three, ""), "r", "k")
    own = c.where("r <> 6").select("company", F.format_string("https://acme%d.com/careers", "k").alias("url"), html.alias("html"))
    found = _of(("x", "x", "x", "https://jobs.ashbyhq.com/acme%1$d", "https://www.acme%1$d.com/work", "https://www.acme%1$d.org/jobs", "https://jobs.ashbyhq.com/other%1$d", "https://elsewhere.net/jobs"), "r", "k")
    html = _of(("", "", "", "", '<a href="https://t%1$d.wd5.myworkdayjobs.com/Ext">', three, "", three), "r", "k")
    results = c.select("company", F.lit(0).alias("pos"), found.alias("url"), html.alias("html"))
    slug = _of(("board%1$d", "https://acme%1$d.com/careers", "acme%1$d", "acme%1$d", "t%1$d|5|Ext", "https://www.acme%1$d.org/jobs", "other%1$d", "https://elsewhere.net/jobs"), "r", "k")
    ats = _of(("greenhouse", "custom", "lever", "ashby", "workday", "custom", "ashby", "custom"), "r")
    boards = c.select(ats.alias("ats"), F.when((F.col("r") == 2), F.format_string("acme%drobotics", "k")).otherwise(slug).alias("slug"), (F.col("r") + 1).alias("n_jobs"), F.col("r").alias("n_local")).distinct()
    dead = c.where("r = 2").select(F.lit("greenhouse").alias("ats"), F.format_string("dead%d", "k").alias("slug"), F.lit(0).alias("n_jobs"), F.lit(0).alias("n_local"))
    rows = resolving.resolved(c, boards.unionByName(dead), own, results)
    return rows.select("company", "ats", F.when(F.col("via") == "probe", F.regexp_replace("slug", "robotics$", "")).otherwise(F.col("slug")).alias("slug"), "n_jobs", "n_local", "via")
