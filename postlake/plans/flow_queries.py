"""Queries of flows, discovery, views and page parsers; pages and payloads are built from the given tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import predicates as P
from postlake.functions import scoring as S
from postlake.functions import text as T
from postlake.operators import entities, flows, store, views
from postlake.plans.queries import POSTINGS_SQL, TODAY, companies, dealt, described, postings, query, table
from postlake.profile import Profile
from postlake.sources import listings, pages

PROFILE = Profile(technical_title="the|que|der|el", local_words=("nc",), local_names=("durham",))
_SEEN = "2024-03-01 00:00:00"
_PLACES = ("Durham, NC", "Remote - US", "Boston, MA")
_PLACE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'Durham, NC' WHEN 1 THEN 'Remote - US' WHEN 2 THEN 'Boston, MA' END"
_EMPLOYERS = "employers AS (SELECT s_suppkey AS company_id, s_name AS name, s_acctbal > 3000 AS watched FROM supplier)"
_TECHNICAL = "regexp_matches(coalesce(title, ''), '(?i)the|que|der|el')"


def employers(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("s_acctbal") > 3000, F.array(F.lit("watch"))).otherwise(F.array(F.lit("local")))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"), tags.alias("tags"))


def outside(spark: SparkSession, d: str) -> DataFrame:
    """Documents as postings of employers: of every four one is local, one remote, one elsewhere and one without a place."""
    i = F.col("doc_id")
    place = F.get(F.array(*map(F.lit, _PLACES)), (i % 4).cast("int"))
    return described(spark, d).select(
        F.when(i % 3 > 0, F.concat(F.lit("ext_"), i)).alias("id"), "title", F.concat(F.lit("supplier#"), F.lpad((i % 15).cast("string"), 9, "0")).alias("company"), F.concat(F.lit("https://x.org/"), i % 7).alias("url"),
        place.alias("location"), F.lit(None).cast("string").alias("description"), i.alias("ordinal"), (i % 15).alias("company_id"),
    )


def _known(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("ext_"), "doc_id").alias("job_id"))


_OUTSIDE = f"""outside AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN concat('ext_', doc_id) END AS id, split_part(text, chr(10), 1) AS title, concat('supplier#', lpad(CAST(doc_id % 15 AS VARCHAR), 9, '0')) AS company,
  concat('https://x.org/', doc_id % 7) AS url, {_PLACE_SQL} AS location, doc_id % 15 AS company_id FROM documents),
{_EMPLOYERS}, known AS (SELECT concat('ext_', doc_id) AS job_id FROM documents WHERE doc_id % 5 = 0)"""


@query(f"""WITH {_OUTSIDE}, r AS (SELECT *, coalesce(id, concat('cap_', substr(md5(concat(url, title, company)), 1, 12))) AS job_id, CASE doc_id % 4 WHEN 0 THEN 'onsite' WHEN 1 THEN 'remote' END AS geo_mode FROM outside),
p AS (SELECT r.*, e.company_id AS linked_id FROM r LEFT JOIN employers e ON lower(e.name) = r.company WHERE (geo_mode = 'onsite' OR (geo_mode = 'remote' AND coalesce(watched, false))) AND {_TECHNICAL}),
l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY doc_id DESC) AS n FROM p)
SELECT l.job_id, linked_id AS company_id, location, geo_mode, known.job_id IS NULL AS is_new FROM l LEFT JOIN known ON l.job_id = known.job_id WHERE n = 1""")
def ingest_external(spark: SparkSession, d: str) -> DataFrame:
    rows = flows.ingested(outside(spark, d).drop("company_id"), employers(spark, d), _known(spark, d), "cap", PROFILE, excludes=False)
    return rows.select("job_id", "company_id", "location", "geo_mode", "is_new")


@query(f"""WITH {_OUTSIDE}, r AS (SELECT o.*, e.name, watched, concat('ext_', doc_id) IN (SELECT job_id FROM known) AS known, {_TECHNICAL} AS technical FROM outside o JOIN employers e USING (company_id)),
k AS (SELECT *, technical AND (NOT watched OR doc_id % 4 < 2) AS kept FROM r)
SELECT name AS company_name, count(*) AS fetched, count(*) FILTER (kept) AS kept, count(*) FILTER (kept AND NOT known) AS fresh, count(*) FILTER (watched AND technical AND NOT known) AS watch_hits FROM k GROUP BY name""")
def crawl_funnel(spark: SparkSession, d: str) -> DataFrame:
    fetched = outside(spark, d).withColumn("job_id", F.concat(F.lit("ext_"), "ordinal"))
    return flows.crawl_funnel(flows.crawled(fetched, employers(spark, d), _known(spark, d), PROFILE, excludes=False))


@query(f"WITH {POSTINGS_SQL}, n AS (SELECT company_id, count(*) AS n_local FROM postings GROUP BY company_id) SELECT name, round(mission_score, 6) AS mission_score, n_local FROM companies LEFT JOIN n USING (company_id) ORDER BY mission_score DESC NULLS LAST, n_local DESC NULLS LAST, name LIMIT 100")
def company_order(spark: SparkSession, d: str) -> DataFrame:
    n = postings(spark, d).groupBy("company_id").agg(F.count("*").alias("n_local"))
    rows = views.companies_in_order(companies(spark, d).join(n, "company_id", "left"), active_only=False)
    return rows.limit(100).select("name", F.round("mission_score", 6).alias("mission_score"), "n_local")


@query(f"WITH {POSTINGS_SQL} SELECT disposition, CASE disposition WHEN 'applied' THEN 1 ELSE 3 END AS group_pos, count(*) AS n FROM postings WHERE disposition IS NOT NULL GROUP BY disposition")
def disposition_groups(spark: SparkSession, d: str) -> DataFrame:
    return views.disposition_groups(postings(spark, d))


_HOST = "split_part(split_part(url, '//', 2), '/', 1)"


@query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, concat(split_part({_HOST}, '.', 1 + page_id % 2), ' Medical Group') AS name, split_part({_HOST}, '.', 2) AS slug FROM pages),
t AS (SELECT *, regexp_replace(replace(host, 'www.', ''), '[^a-z0-9]', '', 'g') AS h, list_concat([regexp_replace(lower(name), '[^a-z0-9]', '', 'g')], list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda w: len(w) >= 4 AND w NOT IN ('medical', 'group'))) AS parts FROM p)
SELECT page_id, len(list_filter(parts, lambda x: len(x) >= 4 AND contains(h, x))) > 0 AS host_ok, len(slug) >= 3 AND len(list_filter(parts, lambda x: len(x) >= 3 AND (contains(x, slug) OR contains(slug, x)))) > 0 AS slug_ok FROM t""")
def name_matches(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"//([^/]*)", 1)
    label = lambda i: F.get(F.split(host, r"\."), i)
    name = F.concat(label((F.col("page_id") % 2).cast("int")), F.lit(" Medical Group"))
    return table(spark, d, "pages").select("page_id", P.host_matches("url", name).alias("host_ok"), P.slug_matches(label(F.lit(1)), name).alias("slug_ok"))


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part) SELECT p_partkey, array_to_string([concat(array_to_string(w, ''), 'labsco'), concat(array_to_string(w, '-'), '-labs-co'), array_to_string(w, '')], ',') AS slugs FROM w""")
def slug_candidates(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" Labs (US), Co."))
    return table(spark, d, "part").select("p_partkey", F.array_join(entities.slug_candidates(name), ",").alias("slugs"))


@query("""WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w, p_partkey % 3 AS r FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'found on lever, not on ashby' END, CASE WHEN len(w) >= 2 AND r = 0 THEN 'slug is the first word only' WHEN len(w) >= 2 AND r = 1 THEN 'generic slug neuro' WHEN len(w) = 1 AND (r = 1 OR (r = 0 AND len(w[1]) <= 5)) THEN concat('short slug of one word ', CASE r WHEN 0 THEN w[1] ELSE 'neuro' END) END], lambda x: x IS NOT NULL), '; ') AS flags FROM p""")
def verify_flags(spark: SparkSession, d: str) -> DataFrame:
    r, first = F.col("p_partkey") % 3, F.lower(F.substring_index("p_name", " ", 1))
    slug = F.when(r == 0, first).when(r == 1, "neuro").otherwise(F.concat(first, F.lit("-x")))
    claimed = F.when(F.col("p_partkey") % 2 == 0, "ashby").otherwise("lever")
    return table(spark, d, "part").select("p_partkey", F.array_join(entities.verify_flags("p_name", slug, F.lit("lever"), claimed), "; ").alias("flags"))


#: Addresses with a number for {}, and what they are detected as.
_ADDRESSES = (
    ("https://acme{}.wd5.myworkdayjobs.com/en-US/Site_{}/x", "fetchable", "workday", "acme{}|5|Site_{}"),
    ("https://acme{}.wd5.myworkdayjobs.com/login https://acme{}.wd1.myworkdayjobs.com/wday/cxs/acme/Main/jobs", "fetchable", "workday", "acme{}|1|Main"),
    ("https://workforcenow.adp.com/x?cid=0123abcd{}&amp;ccId=19000_{}", "fetchable", "adp", "0123abcd{}|19000_{}"),
    ("https://recruiting2.ultipro.com/CO{}/JobBoard/01234567-89ab-cdef-0123-456789abcdef", "fetchable", "ultipro", "CO{}|01234567-89ab-cdef-0123-456789abcdef"),
    ("https://job-boards.greenhouse.io/acme{}", "fetchable", "greenhouse", "acme{}"),
    ("https://jobs.lever.co/acme{}/1", "fetchable", "lever", "acme{}"),
    ("https://jobs.ashbyhq.com/Acme{}", "fetchable", "ashby", "Acme{}"),
    ("https://careers.kula.ai/acme{}", "fetchable", "kula", "acme{}"),
    ("https://acme{}.applytojob.com/apply", "fetchable", "jazzhr", "acme{}"),
    ("https://www.bamboohr.com/ https://acme{}.icims.com/jobs", "semi", "icims", "acme{}"),
    ("https://acme{}.bamboohr.com/jobs", "fetchable", "bamboohr", "acme{}"),
    ("https://careers.smartrecruiters.com/Acme{}", "fetchable", "smartrecruiters", "Acme{}"),
    ("https://ats.rippling.com/acme{}/jobs", "fetchable", "rippling", "acme{}"),
    ("https://acme{}.sapsf.eu/", "semi", "successfactors", "acme{}"),
    ("https://apply.workable.com/acme{}/", "lead", "workable", "apply.workable.com/acme{}"),
    ("https://acme{}.taleo.net/", "lead", "taleo", "acme{}.taleo.net"),
)
_ADDRESS_SQL = "CASE page_id % 17 " + " ".join(f"WHEN {i} THEN struct_pack(kind := '{k}', ats := '{a}', slug := replace('{s}', '{{}}', CAST(page_id AS VARCHAR)))" for i, (_, k, a, s) in enumerate(_ADDRESSES)) + " END"


@query(f"SELECT page_id, s.kind, s.ats, s.slug FROM (SELECT page_id, {_ADDRESS_SQL} AS s FROM pages)")
def board_signatures(spark: SparkSession, d: str) -> DataFrame:
    address = F.replace(F.get(F.array(*[F.lit(a) for a, *_ in _ADDRESSES]), (F.col("page_id") % 17).cast("int")), F.lit("{}"), F.col("page_id").cast("string"))
    html = F.concat("html", F.coalesce(F.concat(F.lit('<a href="'), address, F.lit('">')), F.lit("")))
    return table(spark, d, "pages").select("page_id", entities.detected(html, "url").alias("s")).select("page_id", "s.*")


@query("""SELECT event_id, event_type AS ats, CASE WHEN event_id % 6 IN (0, 1) THEN 'blocked' WHEN event_id % 6 = 2 THEN 'broken' WHEN floor(value) >= 40 THEN 'ok' ELSE 'degraded' END AS health FROM events""")
def board_health(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(F.lit(None).cast("int"), F.lit(429), F.lit(404)), (F.col("event_id") % 6).cast("int"))
    status = F.when(F.col("event_id") % 6 > 2, 200).otherwise(status)
    probes = table(spark, d, "events").select("event_id", F.col("event_type").alias("ats"), F.col("user_id").cast("string").alias("name"), status.alias("status"), F.floor("value").alias("n_jobs"))
    return views.board_health(probes, least=40).select("event_id", "ats", "health")


@query("""WITH s AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 3 > 0 THEN source END AS description, left(text, 12000) AS live, length(text) AS n FROM documents)
SELECT job_id, md5(CASE WHEN job_id % 2 = 1 AND coalesce(n, 0) > length(coalesce(description, '')) THEN live ELSE description END) AS digest FROM s""")
def longer_descriptions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "job_id")
    stored = docs.select("job_id", F.when(F.col("job_id") % 3 > 0, F.col("source")).alias("description"))
    live = docs.where("job_id % 2 = 1").select("job_id", F.col("text").alias("description"))
    return store.with_longer_descriptions(stored, live).select("job_id", F.md5("description").alias("digest"))


@query(f"WITH {POSTINGS_SQL} SELECT job_id, CASE WHEN fit < 0.3 THEN 'open' ELSE status END AS status, CASE WHEN fit >= 0.3 AND status = 'closed' THEN first_seen END AS closed_at, CASE WHEN fit < 0.3 THEN DATE '{TODAY}' ELSE first_seen END AS last_seen FROM postings")
def touched(spark: SparkSession, d: str) -> DataFrame:
    rows = postings(spark, d)
    stored = rows.select("job_id", "status", F.when(F.col("status") == "closed", F.col("first_seen")).alias("closed_at"), F.col("first_seen").alias("last_seen"))
    return store.touched(stored, rows.where("fit < 0.3"), F.lit(TODAY).cast(stored.schema["last_seen"].dataType))


@query(f"""WITH {POSTINGS_SQL}, k AS (SELECT company_id, first_value(company_id) OVER (PARTITION BY segment, nation ORDER BY coalesce(-mission_score, 1), company_id) AS kept FROM companies)
SELECT job_id, coalesce(kept, company_id) AS company_id FROM postings LEFT JOIN k USING (company_id)""")
def repointed(spark: SparkSession, d: str) -> DataFrame:
    rank = [F.coalesce(-F.col("mission_score"), F.lit(1.0))]
    return store.repointed(postings(spark, d), companies(spark, d), ["segment", "nation"], rank).select("job_id", "company_id")


_GATES = tuple(S.GATE_PENALTIES)[:3]


@query(f"""SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN l_linenumber % 3 = 0 THEN [] WHEN l_linenumber % 3 = 1 THEN list_filter(['{_GATES[0]}', CASE WHEN l_returnflag = 'A' THEN '{_GATES[1]}' END], lambda x: x IS NOT NULL) ELSE list_filter([CASE WHEN l_returnflag = 'R' THEN '{_GATES[1]}' END, CASE WHEN l_linestatus = 'O' THEN '{_GATES[2]}' END], lambda x: x IS NOT NULL) END, '+') AS gates FROM lineitem""")
def known_gates(spark: SparkSession, d: str) -> DataFrame:
    one, two, three = _GATES
    listed = F.to_json(F.array_compact(F.array(F.lit(one), F.lit("other"), F.when(F.col("l_returnflag") == "A", two))))
    flags = F.to_json(F.create_map(F.lit(two), F.col("l_returnflag") == "R", F.lit("other"), F.lit(True), F.lit(three), F.col("l_linestatus") == "O"))
    answer = F.when(F.col("l_linenumber") % 3 == 0, "none").when(F.col("l_linenumber") % 3 == 1, listed).otherwise(flags)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(S.known_gates(answer), "+").alias("gates"))


@query("""SELECT c_custkey, CASE WHEN regexp_matches(lower(c_name), '7$') THEN 'bullseye' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN lower(c_mktsegment) END AS tier, CASE WHEN regexp_matches(lower(c_name), '7$') THEN 1.0 WHEN c_custkey % 4 > 0 THEN round(least(1, greatest(0, c_acctbal / 5000)), 6) END AS score FROM customer""")
def mission_scores(spark: SparkSession, d: str) -> DataFrame:
    told = F.when(F.col("c_custkey") % 4 > 0, (F.col("c_acctbal") / 5000).cast("string")).otherwise("unknown")
    rows = table(spark, d, "customer").select("c_custkey", S.mission("c_name", "c_mktsegment", told, ("building", "machinery"), "7$", "bullseye").alias("m"))
    return rows.select("c_custkey", "m.tier", F.round("m.score", 6).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, concat('deep: ', l_comment_, ' [', array_to_string(list_filter([CASE WHEN l_linenumber > 1 THEN concat(l_linenumber, '+yrs') END, CASE WHEN l_returnflag <> 'N' THEN lower(l_returnflag) END, CASE WHEN l_linenumber % 2 = 0 THEN concat('gaps: ', l_linestatus, '; b; c') END], lambda x: x IS NOT NULL), ' | '), ']') AS reason
FROM (SELECT *, concat('part ', l_partkey) AS l_comment_ FROM lineitem) WHERE l_linenumber > 1 OR l_returnflag <> 'N' UNION ALL SELECT l_orderkey, l_linenumber, concat('deep: part ', l_partkey) FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'N'""")
def deep_reason(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    gaps = F.when(n % 2 == 0, F.array(F.col("l_linestatus"), F.lit(" b"), F.lit(""), F.lit("c"), F.lit("d")))
    reason = S.deep_reason(F.concat(F.lit(" part "), "l_partkey"), F.when(n > 1, n), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), gaps)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query(f"""WITH {POSTINGS_SQL} SELECT job_id, CASE WHEN first_seen = DATE '{TODAY}' THEN 'NEW' WHEN posted_at IS NULL THEN '?' ELSE concat(date_diff('day', posted_at, DATE '{TODAY}'), 'd', CASE WHEN date_diff('day', posted_at, DATE '{TODAY}') >= 45 THEN '!' ELSE '' END) END AS age,
CASE company_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' ELSE 'relocation' END AS geo_bucket, company_id % 3 = 2 AS relocation_required, company_id % 3 < 2 AS us_ok, disposition IS NOT NULL AS verified FROM postings""")
def job_rows(spark: SparkSession, d: str) -> DataFrame:
    place = F.get(F.array(F.lit("Durham, NC"), F.lit("Remote"), F.lit("Berlin, Germany")), (F.col("company_id") % 3).cast("int"))
    rows = postings(spark, d).withColumns({"location": F.when(F.col("company_id").isNotNull(), place), "fit_reason": F.when(F.col("disposition").isNotNull(), "deep: yes")})
    return views.job_rows(rows, F.lit(TODAY).cast("date"), P.locality_pattern(("nc",), ("durham",))).select("job_id", "age", "geo_bucket", "relocation_required", "us_ok", "verified")


@query("WITH b AS (SELECT o_custkey, o_orderpriority AS t, max(concat('b', o_orderkey)) AS board_job_id FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) SELECT concat('s', o_orderkey) AS job_id, board_job_id FROM orders JOIN b ON orders.o_custkey = b.o_custkey AND o_orderpriority = t WHERE o_orderstatus = 'F'")
def titles_on_board(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda prefix, status: table(spark, d, "orders").where(F.col("o_orderstatus") == status).select(F.concat(F.lit(prefix), "o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("title"))
    return flows.titles_on_board(rows("s", "F"), rows("b", "O"), T.norm_title)


def _markup(template: str, *columns: str):
    return F.format_string(template, *columns)


@query("""WITH o AS (SELECT *, concat('Role ', o_orderkey) AS t, concat('Customer ', o_custkey) AS c, o_orderkey % 4 AS r FROM orders)
SELECT o_orderkey AS page_id, CASE r WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' WHEN 2 THEN 'metacareers' ELSE 'page' END AS source,
 CASE r WHEN 0 THEN concat('linkedin_', o_orderkey) WHEN 1 THEN concat('indeed_', o_orderkey) WHEN 2 THEN concat('meta_', o_orderkey) ELSE concat('jsonld_', substr(sha1(concat('https://x.org/p/', o_orderkey, '||', t)), 1, 16)) END AS job_id, t AS title, CASE WHEN r = 2 THEN 'Meta' ELSE c END AS company, 'Austin, TX' AS location FROM o""")
def captured_pages(spark: SparkSession, d: str) -> DataFrame:
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    forms = {
        0: '<html><title>Jobs</title><ul><li><a class="k" href="https://www.linkedin.com/jobs/view/%1$d/?x=1"><b>Role %1$d</b> <span>Customer %2$d · Austin, TX</span></a></li></ul></html>',
        1: '<div class="job_seen_beacon"><h2><a href="/rc/clk?jk=%1$d&amp;x=1">Role %1$d</a></h2><span data-testid="company-name">Customer %2$d</span><div data-testid="text-location">Austin, TX</div></div>',
        2: '<div><a href="/profile/job_details/%1$d/"><h3>Role %1$d</h3></a><span>Austin, TX</span></div>',
        3: '<script type="application/ld+json">{"@type": "JobPosting", "title": "Role %1$d", "url": "https://x.org/p/%1$d", "hiringOrganization": {"name": "Customer %2$d"}, "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX"}},}</script>',
    }
    r = (F.col("o_orderkey") % 4).cast("int")
    html = F.get(F.array(*[_markup(forms[i], "o_orderkey", "o_custkey") for i in range(4)]), r)
    url = F.get(F.array(*[F.lit(x) for x in ("https://www.linkedin.com/jobs", "https://www.indeed.com/jobs", "https://www.metacareers.com/jobs", "https://x.org/p")]), r)
    rows = pages.captured(o.select(F.col("o_orderkey").alias("page_id"), url.alias("url"), html.alias("html")))
    return rows.select("page_id", "source", "job_id", "title", "company", "location")


def _listing(spark: SparkSession, d: str, template: str, url: str) -> DataFrame:
    """A page for each customer with one piece of markup for each order."""
    o = dealt(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").withColumn("_m", _markup(template, "o_orderkey", "o_custkey"))
    page = o.groupBy("o_custkey").agg(F.array_join(F.collect_list("_m"), "\n").alias("html"))
    return page.select(F.concat(F.lit("c"), "o_custkey").alias("board"), F.concat(F.lit("Customer "), "o_custkey").alias("company"), _markup(url, "o_custkey").alias("url"), "html")


def _listed(prefix: str, title: str, location: str, url: str) -> str:
    return f"SELECT concat('{prefix}_c', o_custkey, '_', o_orderkey) AS job_id, {title} AS title, concat('Customer ', o_custkey) AS company, {location} AS location, {url} AS url FROM orders"


@query(_listed("sf", "concat('Role ', o_orderkey)", "'Holly Springs, NC'", "concat('https://jobs.c', o_custkey, '.org/job/Holly-Springs,-NC-Role/', o_orderkey, '/')"))
def successfactors_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = listings.successfactors(_listing(spark, d, '<tr><a class="jobTitle-link" href="/job/Holly-Springs,-NC-Role/%1$d/">Role %1$d</a></tr>', "https://jobs.c%d.org/search/?startrow=0"))
    return rows.select("job_id", "title", "company", "location", "url")


@query(_listed("icims", "CASE WHEN o_custkey % 3 = 0 THEN concat('Data - Role ', o_orderkey) ELSE concat('Role ', o_orderkey, ' in Cary, NC') END", "CASE WHEN o_custkey % 3 > 0 THEN 'Cary, NC' WHEN o_orderkey % 2 = 0 THEN 'Wake, NC' END", "concat('https://c', o_custkey, '.icims.com/jobs/', o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN concat('/data---role-', o_orderkey, '/job') ELSE '/job' END)").replace("'Data - Role '", "'data - role '"))
def icims_listing(spark: SparkSession, d: str) -> DataFrame:
    by_site = F.substring("board", 2, 20).cast("long") % 3 == 0
    seen = _listing(spark, d, '<a href="/jobs/%1$d/job"><span>Requisition Title</span> Role %1$d in Cary, NC</a>', "https://c%d.icims.com/jobs/search").where(~by_site)
    site = _listing(spark, d, "<url><loc>https://c%2$d.icims.com/jobs/%1$d/data---role-%1$d/job</loc></url>", "https://c%d.icims.com/sitemap.xml").where(by_site).withColumnRenamed("html", "body").drop("url")
    o = table(spark, d, "orders").where("o_custkey % 3 = 0 and o_orderkey % 2 = 0")
    told = '<script type="application/ld+json">{"@type": "JobPosting", "title": "x", "jobLocation": {"address": {"addressLocality": "Wake", "addressRegion": "NC"}}}</script>'
    details = o.select(_markup("https://c%2$d.icims.com/jobs/%1$d/data---role-%1$d/job", "o_orderkey", "o_custkey").alias("url"), F.lit(told).alias("html"))
    return listings.icims(seen, site, details).select("job_id", "title", "company", "location", "url")


@query(_listed("kula", "concat('Role ', o_orderkey)", "'Durham, NC'", "concat('https://careers.kula.ai/c', o_custkey, '/', o_orderkey)"))
def kula_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = listings.kula(_listing(spark, d, '<div><p>Research</p><h3>Role %1$d</h3><p>Durham, NC; Boston, MA</p><a href="/c%2$d/%1$d">Go</a></div>', "https://careers.kula.ai/c%d"))
    return rows.select("job_id", "title", "company", "location", "url")


@query("SELECT concat('jsonld_', substr(sha1(concat('||Role ', o_orderkey)), 1, 16)) AS job_id, concat('Role ', o_orderkey) AS title, concat('Customer ', o_custkey) AS company, '' AS location, concat('https://c', o_custkey, '.applytojob.com/apply/', o_orderkey, '/Role') AS url FROM orders WHERE o_orderkey % 5 > 0")
def jazzhr_listing(spark: SparkSession, d: str) -> DataFrame:
    seen = _listing(spark, d, '<a href="https://c%2$d.applytojob.com/apply/%1$d/Role">a</a><a href="/apply/%1$d/Role">b</a>', "https://c%d.applytojob.com/")
    o = table(spark, d, "orders").where("o_orderkey % 5 > 0")
    details = o.select(_markup("https://c%2$d.applytojob.com/apply/%1$d/Role", "o_orderkey", "o_custkey").alias("url"), _markup('<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": "Role %1$d"}, {"@type": "Thing"}]}</script>', "o_orderkey").alias("html"))
    return listings.jazzhr(seen, details).select("job_id", "title", "company", "location", "url")


@query(_listed("peopleadmin", "concat('Role ', o_orderkey)", "CASE WHEN o_orderkey % 2 = 0 THEN 'Durham' ELSE concat('Campus ', o_custkey) END", "concat('https://c.edu/postings/', o_orderkey)"))
def peopleadmin_feed(spark: SparkSession, d: str) -> DataFrame:
    entry = '<entry><title>Role %1$d</title><link href="https://c.edu/postings/%1$d"/><summary>A post</summary></entry>'
    seen = _listing(spark, d, entry, "%d")
    durham = F.regexp_replace("html", r"(postings/\d*[02468]\"/><summary>A post)", "$1 | Durham")
    body = F.concat(F.lit("<feed><title>Campus "), F.substring("board", 2, 20), F.lit("</title>"), durham, F.lit("</feed>"))
    rows = listings.peopleadmin(seen.select("board", "company", body.alias("body")), "(?i)(Durham|Raleigh)")
    return rows.select("job_id", "title", "company", "location", "url")


@query("SELECT concat('nlx_', o_orderkey) AS job_id, concat('Role ', o_orderkey) AS title, concat('Customer ', o_custkey) AS company, 'Cary' AS location FROM orders WHERE o_orderkey % 2 = 0")
def nlx_results(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Customer "), F.col("o_custkey"), F.lit(", Inc."))).otherwise(F.concat(F.lit("Other "), F.col("o_custkey")))
    job = F.struct(F.col("o_orderkey").cast("string").alias("JvId"), F.concat(F.lit(" Role "), "o_orderkey").alias("JobTitle"), asked.alias("Company"), F.lit(" Cary ").alias("Location"))
    bodies = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(job).alias("Jobs"))).alias("body"))
    return listings.nlx(bodies.select(F.concat(F.lit("Customer "), "o_custkey").alias("company"), "body", F.lit(200).alias("status"))).select("job_id", "title", "company", "location")
