"""Employers and their boards: slugs, board detection, candidate checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import col, name_key

# Corporate suffixes, and the address forms of hosted boards in the order they are tried.
SUFFIXES = ("inc", "llc", "corp", "corporation", "co", "ltd", "company", "technologies", "labs")
BOARD_URLS = (
    ("workday", r"https?://([a-z0-9-]+)\.wd\d+\.myworkdayjobs\.com"),
    ("greenhouse", r"greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9-]+)"),
    ("lever", r"jobs\.lever\.co/([a-z0-9-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9-]+)"),
    ("bamboohr", r"https?://([a-z0-9-]+)\.bamboohr\.com"),
    ("smartrecruiters", r"smartrecruiters\.com/([a-z0-9-]+)"),
    ("rippling", r"ats\.rippling\.com/([a-z0-9-]+)"),
    ("paylocity", r"recruiting\.paylocity\.com/recruiting/jobs/all/([a-z0-9-]+)"),
)
STOP_SLUGS = ("embed", "jobs", "www", "api", "careers")


def detected_board(url) -> Column:
    """struct(ats, slug) of the first address form, in order, that a URL has; null for none and for stop slugs."""
    low = F.lower(col(url))
    out = F.lit(None).cast("struct<ats:string,slug:string>")
    for ats, pattern in reversed(BOARD_URLS):
        slug = F.regexp_extract(low, pattern, 1)
        out = F.when((slug != "") & ~slug.isin(*STOP_SLUGS), F.struct(F.lit(ats).alias("ats"), slug.alias("slug"))).otherwise(out)
    return out


def slug_variants(name, most: int = 8) -> Column:
    """Board slugs that a company of this name may use: hyphened, joined, first word and first two, then without suffixes."""
    bare = F.regexp_replace(F.lower(col(name)), r"\([^)]*\)", " ")
    words = F.filter(F.split(bare, "[^a-z0-9]+"), lambda w: w != "")
    short = F.filter(words, lambda w: ~w.isin(*SUFFIXES))
    forms = lambda ws: [F.array_join(ws, "-"), F.array_join(ws, ""), F.get(ws, F.lit(0)), F.array_join(F.slice(ws, 1, 2), "")]
    both = F.filter(F.array_distinct(F.array(*forms(words), *forms(short))), lambda s: F.length(s) >= 3)
    return F.slice(both, 1, most)


def boards_of(pages: DataFrame, url: str = "url") -> DataFrame:
    """Each board once, with the number of addresses that name it."""
    found = pages.select(detected_board(url).alias("b"), F.col(url)).where("b is not null")
    return found.groupBy(F.col("b.ats").alias("ats"), F.col("b.slug").alias("slug")).agg(F.countDistinct(url).alias("n_urls"))


#: Platforms that answer for boards that do not exist as well: only postings prove a board there.
ANSWERS_ALWAYS = ("jazzhr", "smartrecruiters", "paylocity", "rippling", "ultipro")


def confirmed(probes: DataFrame) -> DataFrame:
    """The best probe of each company (company, slug_pos, ats_pos, ats, slug, ok, n_jobs): slugs before platforms.

    An answer confirms a board even without postings, but for ANSWERS_ALWAYS.
    """
    good = probes.where(F.col("ok") & (~F.col("ats").isin(*ANSWERS_ALWAYS) | (F.col("n_jobs") > 0)))
    return good.groupBy("company").agg(F.min(F.struct("slug_pos", "ats_pos", "ats", "slug", "n_jobs")).alias("s")).select("company", "s.ats", "s.slug", "s.n_jobs")


def unknown_boards(found: DataFrame, companies: DataFrame) -> DataFrame:
    """Confirmed boards whose (ats, slug) no company has yet; of several companies on one board the shortest name stays."""
    new = found.join(companies.select("ats", "slug"), ["ats", "slug"], "left_anti")
    return new.groupBy("ats", "slug").agg(F.min(F.struct(F.length("company"), F.col("company").alias("company")))["company"].alias("company"))


def keyword_counts(docs: DataFrame, text: str, key: str, terms: tuple[str, ...], pattern) -> DataFrame:
    """(term, n): documents that hold each term; one pass, one row for each term and partition before the shuffle."""
    hits = F.array_compact(F.array(*[F.when(F.lower(F.col(text)).rlike(pattern(t)), F.lit(t)) for t in terms]))
    return docs.select(F.explode(hits).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


# Words that a board's slug leaves out, slugs that many employers could have, and the
# signatures of hosted boards in the order they are tried (kind, platform, pattern of the slug).
SLUG_STOP_WORDS = ("inc", "incorporated", "corp", "corporation", "ltd", "llc", "co", "company", "technologies", "systems", "therapeutics", "biosciences", "pharmaceuticals", "pharma", "sciences", "bio", "labs", "group", "health", "holdings")
GENERIC_SLUGS = ("signal", "neuro", "neural", "brain", "medical", "health", "data", "bio", "tech", "labs", "lab", "systems", "smart", "micro", "nano", "bci", "ai", "research", "digital", "care", "vision", "sense")
WORKDAY_API = r"(?i)https?://([a-z0-9-]+)\.wd(\d+)\.myworkdayjobs\.com/wday/cxs/[a-z0-9-]+/([A-Za-z0-9_-]+)/"
WORKDAY_BOARD = r"(?i)https?://([a-z0-9-]+)\.wd(\d+)\.myworkdayjobs\.com(?:/[a-z]{2}-[A-Z]{2})?/([A-Za-z0-9_-]+)"
WORKDAY_NO_SITE = ("wday", "cxs", "api", "static", "assets", "login")
ADP_CID, ADP_CCID = r"(?i)[?&]cid=([0-9a-f-]{8,})", r"(?i)[?&]ccid=([0-9A-Za-z_]+)"
UKG = r"(?i)recruiting2?\.ultipro\.com/([A-Za-z0-9]+)/JobBoard/([0-9a-fA-F\-]{36})"
SIGNATURES = (
    ("fetchable", "greenhouse", r"(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)"),
    ("fetchable", "lever", r"jobs\.lever\.co/([a-z0-9_-]+)"),
    ("fetchable", "ashby", r"jobs\.ashbyhq\.com/([a-zA-Z0-9_-]+)"),
    ("fetchable", "kula", r"careers\.kula\.ai/([a-z0-9_-]+)"),
    ("fetchable", "jazzhr", r"([a-z0-9-]+)\.applytojob\.com"),
    ("fetchable", "bamboohr", r"([a-z0-9-]+)\.bamboohr\.com"),
    ("fetchable", "smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([A-Za-z0-9_-]+)"),
    ("fetchable", "smartrecruiters", r"api\.smartrecruiters\.com/v1/companies/([A-Za-z0-9]+)/"),
    ("fetchable", "paylocity", r"recruiting\.paylocity\.com/[Rr]ecruiting/[Jj]obs/All/([0-9a-fA-F-]{36})"),
    ("fetchable", "rippling", r"ats\.rippling\.com/([a-z0-9][a-z0-9-]+)/jobs"),
    ("semi", "icims", r"([a-z0-9-]+)\.icims\.com"),
    ("semi", "successfactors", r"([a-z0-9-]+)\.(?:successfactors|sapsf)\.(?:com|eu)"),
    ("lead", "eightfold", r"([a-z0-9-]+\.eightfold\.ai)"),
    ("lead", "dayforce", r"(dayforcehcm\.com/[a-zA-Z-]+/[a-zA-Z0-9_-]+)"),
    ("lead", "workable", r"(apply\.workable\.com/[a-z0-9-]+)"),
    ("lead", "recruitee", r"([a-z0-9-]+\.recruitee\.com)"),
    ("lead", "teamtailor", r"([a-z0-9-]+\.teamtailor\.com)"),
    ("lead", "jobvite", r"(jobs\.jobvite\.com/[a-z0-9-]+)"),
    ("lead", "taleo", r"([a-z0-9-]+\.taleo\.net)"),
    ("lead", "ukg", r"([a-z0-9-]+\.ultipro\.com)"),
    ("lead", "paycom", r"(paycomonline\.net/[A-Za-z0-9/_-]+)"),
    ("lead", "breezy", r"([a-z0-9-]+\.breezy\.hr)"),
    ("lead", "gohire", r"([a-z0-9-]+\.gohire\.io)"),
)
NO_SUBDOMAINS = ("www", "help", "support", "blog", "app", "careers", "jobs", "secure")


def slug_candidates(name) -> Column:
    """Slugs to try for a name, best first: words joined, hyphened, joined without stop words; never the first word alone."""
    words = F.filter(F.split(F.lower(F.regexp_replace(col(name), r"\s*\([^)]*\)", "")), "[^a-z0-9]+"), lambda w: w != "")
    return F.filter(F.array_distinct(F.array(F.array_join(words, ""), F.array_join(words, "-"), F.array_join(F.filter(words, lambda w: ~w.isin(*SLUG_STOP_WORDS)), ""))), lambda s: s != "")


def verify_flags(name, slug, ats, claimed) -> Column:
    """Why a confirmed board needs a look, as a list: another platform than claimed, and slugs that other employers may have."""
    words, slug = F.filter(F.split(F.lower(col(name)), "[^a-z0-9]+"), lambda w: w != ""), col(slug)
    single, generic = ~slug.contains("-"), slug.isin(*GENERIC_SLUGS)
    other = F.when(col(claimed) != col(ats), F.concat(F.lit("found on "), col(ats), F.lit(", not on "), col(claimed)))
    collides = (
        F.when((F.size(words) >= 2) & (slug == F.get(words, F.lit(0))), "slug is the first word only")
        .when((F.size(words) >= 2) & single & generic, F.concat(F.lit("generic slug "), slug))
        .when((F.size(words) == 1) & single & (generic | (F.length(slug) <= 5)), F.concat(F.lit("short slug of one word "), slug))
    )
    return F.array_compact(F.array(other, collides))


def workday_board(text) -> Column:
    """struct(tenant, pod, site) of the first Workday address in a text: of its API, or else of a public board; null for none."""

    def triple(found: Column, pattern: str) -> Column:
        part = lambda i: F.regexp_extract(found, pattern, i)
        return F.struct(F.lower(part(1)).alias("tenant"), part(2).try_cast("int").alias("pod"), part(3).alias("site"))

    every = lambda p: F.transform(F.regexp_extract_all(col(text), F.lit(p), 0), lambda u: triple(u, p))
    public = F.filter(every(WORKDAY_BOARD), lambda t: ~F.lower(t["site"]).isin(*WORKDAY_NO_SITE))
    return F.coalesce(F.get(every(WORKDAY_API), F.lit(0)), F.get(public, F.lit(0)))


def detected(text, url=None) -> Column:
    """struct(kind, ats, slug) of the board that an address and a page name: Workday, ADP and UKG Pro, then SIGNATURES in order.

    kind says how far a board can be read: fetchable, semi, or a lead only.
    Workday's slug is tenant|pod|site.
    """
    blob = F.concat_ws("\n", *([] if url is None else [col(url)]), F.coalesce(col(text), F.lit("")))
    plain = F.replace(blob, F.lit("&amp;"), F.lit("&"))
    board = lambda kind, ats, slug: F.struct(F.lit(kind).alias("kind"), F.lit(ats).alias("ats"), slug.alias("slug"))
    out = F.lit(None).cast("struct<kind:string,ats:string,slug:string>")
    for kind, ats, pattern in reversed(SIGNATURES):
        slug = F.regexp_extract(blob, "(?i)" + pattern, 1)
        good = F.length(slug) >= 2 if kind == "lead" else (F.length(slug) >= 2) & ~F.lower(slug).isin(*NO_SUBDOMAINS)
        out = F.when(good, board(kind, ats, slug)).otherwise(out)
    pair = lambda p, q=None: F.concat_ws("|", F.regexp_extract(plain, p, 1), F.regexp_extract(plain, q or p, 1 if q else 2))
    adp = F.lower(blob).contains("workforcenow.adp.com") & plain.rlike(ADP_CID) & plain.rlike(ADP_CCID)
    workday = workday_board(blob)
    triple = F.concat_ws("|", workday["tenant"], workday["pod"].cast("string"), workday["site"])
    return F.when(workday.isNotNull(), board("fetchable", "workday", triple)).when(adp, board("fetchable", "adp", pair(ADP_CID, ADP_CCID))).when(plain.rlike(UKG), board("fetchable", "ultipro", pair(UKG))).otherwise(out)


def gathered_names(sources: list[DataFrame]) -> DataFrame:
    """Names of all sources (name, ordinal) once each whatever their case, in the first spelling; earlier sources come first."""
    rows = [s.select(F.trim("name").alias("name"), F.struct(F.lit(i).alias("source"), "ordinal").alias("at")) for i, s in enumerate(sources)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.where(name_key("name") != "").groupBy(F.lower("name").alias("_n")).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("at")).select("name", "at.source", "at.ordinal")
