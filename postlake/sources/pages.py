"""Captured pages to postings: links, linked data and layers of one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from postlake.functions.text import col, html_text, norm_url, stable_id
from postlake.sources import tree

# Addresses of postings on career pages, slugs and texts of links that are none, places, and hosts that are no employer's.
JOB_HREF = r"(?i)/(careers?|jobs?|positions?|openings?|roles?|job)/([a-z0-9][a-z0-9\-_/]{2,})"
NAV_SLUGS = ("open-positions", "open-roles", "career-opportunities", "current-openings", "job-openings", "openings", "opportunities", "jobs", "job", "careers", "career", "apply", "application", "search", "all", "browse", "students", "internships", "benefits", "culture", "life", "teams", "team", "departments", "locations", "faq", "contact", "index", "home", "overview")
NAV_TEXT = r"(?i)^(careers?|jobs?|view (all|current|open)|open (positions?|roles?)|see (all|open)|apply|search|browse|all (jobs|openings|roles)|current openings|open positions|view (job )?openings|join( us)?|work (with|at) us|learn more|explore|opportunities|all roles)\b"
PLACE = r"[A-Z][A-Za-z.\-']+(?:\s+[A-Z][A-Za-z.\-']+)*,\s*(?:[A-Z]{2}|[A-Z][a-z]+)\b|\b(?i:remote)\b"
OPENINGS_HREF = r"(?i)/(open-positions|open-roles|career-opportunities|current-openings|job-openings|openings|opportunities|positions|jobs)\b"
OPENINGS_TEXT = r"(?i)(current|open|view|see|all).{0,12}(opening|position|role|job)"
OFFSITE = r"(?i)indeed|linkedin|glassdoor|ziprecruiter|simplyhired|monster|dice|greenhouse|lever\.co|ashbyhq|myworkdayjobs|smartrecruiters|icims|paylocity|bamboohr|jobvite|google\.com|builtin"
NO_OWN_SITE = r"(?i)linkedin\.|indeed\.|glassdoor\.|ziprecruiter\.|simplyhired|monster\.|dice\.|greenhouse\.|lever\.co|ashbyhq|myworkdayjobs|smartrecruiters|icims|bamboohr|jazzhr|applytojob|paylocity|paycom|workable|breezy|google\.com|facebook\.|twitter\.|x\.com|youtube\.|instagram\.|crunchbase|builtin|wellfound|schema\.org"


def saved(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages of a folder as (url, html), the file's path for the URL."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def watched(spark: SparkSession, path: str) -> DataStreamReader:
    """New files of a folder as a stream of (url, html)."""
    return spark.readStream.option("wholetext", "true").text(path).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def anchors(html: Column) -> Column:
    """array<struct<href, text>> of a page's links, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*href\s*=\s*\"[^\"]*\"[^>]*>.*?</a>)"), 1)
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?is)href\s*=\s*\"([^\"]*)\"", 1).alias("href"), html_text(a).alias("text")))


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Every link of every page: (key, pos, href, text)."""
    return pages.select(key, F.posexplode(anchors(F.col("html")))).select(key, "pos", F.col("col.href").alias("href"), F.col("col.text").alias("text"))


def job_links(pages: DataFrame, key: str = "page_id", pattern: str = JOB_HREF) -> DataFrame:
    """Links that look like postings, once for each page and address: not navigation by slug (the pattern's second group) or text."""
    found = links(pages, key).where(F.col("href").rlike(pattern))
    slug = F.lower(F.element_at(F.split(F.regexp_replace(F.regexp_extract("href", pattern, 2), r"/+$", ""), "/"), -1))
    good = (~slug.isin(*NAV_SLUGS)) & (F.length(slug) >= 4) & (F.length("text") >= 4) & ~F.col("text").rlike(NAV_TEXT)
    return found.where(good).groupBy(key, "href").agg(F.min(F.struct("pos", "text")).alias("s")).select(key, "href", F.col("s.pos").alias("pos"), F.col("s.text").alias("title"))


def generic_postings(pages: DataFrame, key: str = "page_id") -> DataFrame:
    found = careers_links(pages, None, key)
    return found.select(F.concat(F.lit("cap_"), stable_id("href")).alias("job_id"), F.left("title", F.lit(120)).alias("title"), F.col("href").alias("url"), key)


_LD = "`@type` string, title string, description string, datePosted string, validThrough string, jobLocationType string, url string, hiringOrganization struct<name:string>, jobLocation variant"


def linked_data(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Postings in ld+json blocks, also in lists and @graph; a trailing comma is forgiven."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    body = pages.select(key, F.explode(blocks).alias("b")).select(key, F.try_parse_json(F.regexp_replace(F.regexp_replace("b", "^﻿", ""), r",\s*([}\]])", "$1")).alias("v")).where("v is not null")
    listed = F.coalesce(F.try_variant_get("v", "$['@graph']", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    items = body.select(key, F.explode(listed).alias("v"))
    get = lambda path: F.try_variant_get("v", path, "string")
    kind = F.coalesce(F.try_variant_get("v", "$['@type']", "array<string>"), F.array(get("$['@type']")))
    rows = items.where(F.array_contains(kind, "JobPosting"))
    place = F.concat_ws(", ", get("$.jobLocation.address.addressLocality"), get("$.jobLocation.address.addressRegion"))
    return rows.select(
        F.concat(F.lit("jsonld_"), stable_id(F.coalesce(get("$.url"), F.lit("")), get("$.title"))).alias("job_id"),
        get("$.title").alias("title"), get("$.hiringOrganization.name").alias("company"), get("$.url").alias("url"),
        F.when(F.upper(F.coalesce(get("$.jobLocationType"), F.lit(""))) == "TELECOMMUTE", F.concat_ws("; ", F.nullif(place, F.lit("")), F.lit("Remote"))).otherwise(place).alias("location"),
        html_text(F.coalesce(get("$.description"), F.lit(""))).alias("description"), F.left(get("$.datePosted"), F.lit(10)).alias("posted_raw"), key,
    )


def merged_layers(layers: DataFrame, fields: list[str], key: str = "job_id") -> DataFrame:
    """Layers of one page (layer 0 first) by id: the longer value of each field wins, the earlier of equal ones.

    Rows of later layers go if an earlier layer has their normalised URL under another id.
    """
    longest = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("layer"))).alias(c)
    out = layers.groupBy(key).agg(*[longest(c) for c in fields], F.min("layer").alias("layer"))
    return out.withColumn("_u", norm_url("url")).transform(_one_of_url, key).drop("_u")


def _one_of_url(rows: DataFrame, key: str) -> DataFrame:
    first = rows.where(F.coalesce("_u", F.lit("")) != "").groupBy("_u").agg(F.min("layer").alias("_first"))
    return rows.join(first, "_u", "left").where(F.col("_first").isNull() | (F.col("layer") == F.col("_first"))).drop("_first")


def own_site(*urls) -> Column:
    """https and the host of the first address that is the employer's own; null if none is."""
    host = lambda u: F.nullif(F.regexp_extract(F.trim(col(u)), r"^https?://([^/]+)", 1), F.lit(""))
    own = [F.when(~host(u).rlike(NO_OWN_SITE), F.concat(F.lit("https://"), host(u))) for u in urls]
    return F.coalesce(*own)


def place_in(text: Column, local: str | None = None) -> Column:
    """The first local place in a text, or else the first City, ST or remote; null for none."""
    found = F.nullif(F.regexp_extract(text, PLACE, 0), F.lit(""))
    return found if local is None else F.coalesce(F.nullif(F.regexp_extract(text, local, 0), F.lit("")), found)


_HEADINGS = ("h1", "h2", "h3", "h4", "h5")


def careers_links(pages: DataFrame, local: str | None = None, key: str = "url") -> DataFrame:
    """Links to postings by the page's tree, once for each page and address: (key, pos, href, title, location).

    The title is the first heading, or else the first element of a class with
    ``title``, inside the link, or else the link's text.  The place is looked for in
    the link, its parent and that one's parent, in each a local one first.
    """
    def link(a: Column) -> Column:
        within = lambda test: tree.bound(tree.inside(a, test), lambda e: F.when(e.isNotNull(), tree.text_of(e)))
        near = F.concat(F.array(tree.text_of(a)), F.transform(tree.ancestors(a, 2), tree.text_of))
        places = F.filter(F.transform(near, lambda t: place_in(t, local)), lambda x: x.isNotNull())
        title = F.coalesce(within(lambda e: tree.is_tag(e, *_HEADINGS)), within(lambda e: tree.attribute(e, "class").contains("title")), tree.text_of(a))
        return F.struct(tree.attribute(a, "href").alias("href"), tree.text_of(a).alias("text"), title.alias("title"), F.get(places, 0).alias("location"))

    pages = pages.where(F.col("html").rlike(JOB_HREF) | F.col("html").contains("&"))  # no other page has such an address, even with letters written as entities
    found = tree.tree(pages, key).select(key, F.posexplode(F.transform(tree.links_to(JOB_HREF), link)).alias("pos", "a")).select(key, "pos", "a.*")
    slug = F.lower(F.substring_index(F.element_at(F.split(F.regexp_replace(F.regexp_extract("href", JOB_HREF, 2), r"/+$", ""), "/"), -1), "?", 1))
    good = found.where(~slug.isin(*NAV_SLUGS) & (F.length(slug) >= 4) & (F.length("text") >= 4) & ~F.col("text").rlike(NAV_TEXT))
    first = good.groupBy(key, "href").agg(F.min(F.struct("pos", "title", "location")).alias("s"))
    return first.select(key, F.col("s.pos").alias("pos"), "href", F.col("s.title").alias("title"), F.col("s.location").alias("location"))


def custom_postings(pages: DataFrame, employer: Column, local: str | None = None, key: str = "url", hops: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Postings that an employer's own career pages (url, html) link to.

    A page with fewer than ``least`` links is left for the openings page of its own
    host that it links to, if that one is among ``hops`` (url, html), which are not
    followed further.  With a local pattern only postings in such a place count.
    """
    own = careers_links(pages, local, key)
    if hops is not None:
        counts = pages.select(key).join(own.groupBy(key).agg(F.count("*").alias("n")), key, "left")
        poor = counts.where(F.coalesce("n", F.lit(0)) < least).select(key)
        there = F.regexp_replace("next", "/+$", "")
        nexts = openings_links(pages.join(poor, key, "left_semi"), key).where(there != F.regexp_replace(key, "/+$", ""))
        landed = nexts.join(hops.select(F.col("url").alias("next")), "next")
        beyond = careers_links(hops.join(landed.select(F.col("next").alias("url")).distinct(), "url", "left_semi"), local, "url").withColumnRenamed("url", "next")
        own = own.join(landed, key, "left_anti").withColumn("_page", F.col(key)).unionByName(beyond.join(landed, "next").withColumnRenamed("next", "_page"))
        own = own.drop(key).withColumnRenamed("_page", key)
    found = own.withColumnRenamed(key, "_page").where(F.lit(True) if local is None else F.coalesce(F.col("location").rlike(local), F.lit(False)))
    url = absolute(F.col("_page"), F.col("href"))
    return found.select(F.concat(F.lit("custom_"), stable_id(url)).alias("job_id"), F.left("title", F.lit(90)).alias("title"), employer.alias("company"), url.alias("url"), F.left("location", F.lit(70)).alias("location"), F.col("_page").alias("page"))


# Containers of descriptions, by attribute and text in it, the surest first.
DESCRIPTIONS = (("data-careersite-propertyid", "description", True), ("data-careersite-propertyid", "jobdescription", True), ("class", "job-description", False), ("class", "jobDescription", False), ("class", "jobDisplay", False))


def descriptions(pages: DataFrame, key: str = "url", least: int = 120, most: int = 12_000) -> DataFrame:
    """(key, description) of detail pages (key, html): by linked data, or else by the first container that the page has; empty below ``least`` characters."""
    keyed = pages.select(F.col(key).alias("_page"), "html")
    told = linked_data(keyed, "_page").where(F.length("description") >= least).groupBy(F.col("_page").alias(key)).agg(F.max_by("description", F.length("description")).alias("told"))
    test = lambda attr, part, whole: lambda e: tree.attribute(e, attr) == part if whole else tree.attribute(e, attr).contains(part)
    first = F.coalesce(*[F.get(tree.all_of(test(*d)), 0) for d in DESCRIPTIONS])
    found = tree.tree(pages, key).select(key, tree.bound(first, lambda e: F.when(e.isNotNull(), tree.text_of(e))).alias("found"))
    text = F.coalesce("told", F.when(F.length("found") >= least, F.col("found")), F.lit(""))
    return found.join(told, key, "left").select(key, F.left(text, F.lit(most)).alias("description"))


def absolute(base: Column, href: Column) -> Column:
    """An address as seen from a page: as it is, from the host's root, or from the page's folder."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"(?<=[^/]/)[^/]*$", "")
    return F.when(href.rlike("^(?i)https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), href))


def is_board(pages: DataFrame, least: int = 3, key: str = "url") -> DataFrame:
    """Pages (key, n_links) with so many links to postings that they are a board themselves."""
    return job_links(pages, key).groupBy(key).agg(F.count("*").alias("n_links")).where(F.col("n_links") >= least)


def openings_links(pages: DataFrame, key: str = "url") -> DataFrame:
    """(key, next): the first link of each page to its own host's openings, by address or text."""
    rows = links(pages, key).withColumn("to", absolute(F.col(key), F.col("href")))
    host = lambda c: F.regexp_extract(c, r"^https?://([^/]+)", 1)
    good = (host("to") == host(key)) & ~F.col("to").rlike(OFFSITE) & (F.col("href").rlike(OPENINGS_HREF) | F.col("text").rlike(OPENINGS_TEXT))
    return rows.where(good).groupBy(key).agg(F.min_by("to", "pos").alias("next"))


def by_class(html: Column, *classes: str) -> Column:
    """The text of the first element, over the classes in order, that has one of them; null for none."""
    one = lambda c: F.nullif(html_text(F.regexp_extract(html, rf"(?is)<(\w+)\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{c}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1>", 2)), F.lit(""))
    return F.coalesce(*map(one, classes))


def _strings(html: Column) -> Column:
    """The texts between tags, in order, without empty ones."""
    return F.filter(F.transform(F.split(html, r"<[^>]*>"), lambda x: F.trim(html_text(x))), lambda x: x != "")


_NO_TITLE = r"(?i)^(apply|easy apply|save|saved|dismiss|x)$"
_CAPTURED = ("job_id", "title", "company", "url", "location", "description")


def _captured(rows: DataFrame, key: str) -> DataFrame:
    """Postings cut to what is stored; without a title or id there is none."""
    cut = {"title": 120, "company": 80, "location": 80, "description": 12_000}
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    out = rows.select(key, *[(F.left(text(c), F.lit(cut[c])) if c in cut else F.col(c)).alias(c) for c in _CAPTURED])
    return out.where("title <> '' and job_id is not null")


def linkedin(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Postings of LinkedIn pages: cards in either form, and the detail page that the page's title names.

    A detail without a number of its own fills a card of the same title that names
    no company; else it is a posting by title and company.
    """
    chunks = F.split(F.col("html"), r"(?i)<li(?=[\s>])|(?=<div[^>]*class\s*=\s*[\"'][^\"']*\bbase-card\b)")
    cards = pages.select(key, F.explode(chunks).alias("c"))
    link = r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*/jobs/view/(?:[^\"'/]*-)?(\d+)[^\"']*[\"'][^>]*>(.*?)</a>"
    found = cards.select(key, "c", F.regexp_extract("c", link, 1).alias("n"), _strings(F.regexp_extract("c", link, 2)).alias("s")).where("n <> ''")
    said = F.get(F.filter(F.slice("s", 2, 3), lambda x: x.contains("·")), F.lit(0))
    first = F.coalesce(by_class(F.col("c"), "base-search-card__title"), F.get("s", F.lit(0)))
    split = lambda i: F.trim(F.get(F.split(said, "·", 2), F.lit(i)))
    rows = found.where(~F.coalesce(first, F.lit("")).rlike(_NO_TITLE)).select(
        key, F.concat(F.lit("linkedin_"), "n").alias("job_id"), F.regexp_replace(first, r"^(.+?)\1$", "$1").alias("title"),
        F.coalesce(split(0), by_class(F.col("c"), "artdeco-entity-lockup__subtitle", "job-card-container__primary-description", "base-search-card__subtitle")).alias("company"),
        F.concat(F.lit("https://www.linkedin.com/jobs/view/"), "n", F.lit("/")).alias("url"),
        F.coalesce(split(1), by_class(F.col("c"), "job-card-container__metadata-wrapper", "artdeco-entity-lockup__caption", "job-search-card__location")).alias("location"), F.lit("").alias("description"),
    )
    named = r"^(?:\(\d+\)\s*)?(.+?)\s*\|\s*(.+?)\s*\|\s*LinkedIn$"
    head = html_text(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    about = F.regexp_extract("html", r"(?is)>\s*About the job\s*<(.*)", 1)
    place = F.get(F.filter(_strings(F.col("html")), lambda x: x.rlike(r"\((Remote|Hybrid|On-site)\)")), F.lit(0))
    detail = pages.select(key, "html", head.alias("t")).where(F.col("t").rlike(named)).select(key, F.regexp_extract("t", named, 1).alias("title"), F.regexp_extract("t", named, 2).alias("company"), place.alias("location"), html_text(F.concat(F.lit("<"), about)).alias("description"))
    alike = rows.groupBy(key, "job_id").agg(*[F.max_by(c, F.length(F.coalesce(c, F.lit("")))).alias(c) for c in _CAPTURED if c != "job_id"])
    twins = alike.where(F.coalesce("company", F.lit("")) == "").select(key, F.lower("title").alias("_t"), "job_id", "url")
    twin = twins.groupBy(key, "_t").agg(F.min(F.struct("job_id", "url")).alias("_twin"))
    joined = detail.withColumn("_t", F.lower("title")).join(twin, [key, "_t"], "left")
    filled = joined.select(key, F.coalesce("_twin.job_id", F.concat(F.lit("linkedin_"), stable_id("title", "company"))).alias("job_id"), "title", "company", F.coalesce("_twin.url", F.lit("")).alias("url"), "location", "description")
    return _captured(alike.join(filled.select(key, "job_id"), [key, "job_id"], "left_anti").unionByName(filled), key)


def indeed(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Postings of Indeed pages: one for each card."""
    card = r"(?i)(?=<(?:div|td)[^>]*class\s*=\s*[\"'][^\"']*\b(?:job_seen_beacon|resultContent)\b)"
    link = r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    field = lambda name, cls: F.coalesce(F.nullif(html_text(F.regexp_extract("c", rf"(?is)data-testid\s*=\s*[\"']{name}[\"'][^>]*>(.*?)<", 1)), F.lit("")), by_class(F.col("c"), cls))
    found = pages.select(key, F.explode(F.split("html", card)).alias("c")).where(F.col("c").rlike(r"(?i)^<(div|td)[^>]*\b(job_seen_beacon|resultContent)\b"))
    found = found.select(key, "c", F.replace(F.regexp_extract("c", link, 1), F.lit("&amp;"), F.lit("&")).alias("href"), html_text(F.regexp_extract("c", link, 2)).alias("title")).where("href <> ''")
    number = F.coalesce(F.nullif(F.regexp_extract("href", r"(?i)[?&]jk=([0-9a-f]+)", 1), F.lit("")), F.nullif(F.regexp_extract("c", r"(?i)data-jk\s*=\s*[\"']([^\"']+)", 1), F.lit("")), stable_id("href", "title"))
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit("https://www.indeed.com"), "href"))
    rows = found.select(key, F.concat(F.lit("indeed_"), number).alias("job_id"), "title", field("company-name", "companyName").alias("company"), url.alias("url"), field("text-location", "companyLocation").alias("location"), F.lit("").alias("description"))
    return _captured(_richest(rows, key), key)


_META_PLACE = r"([A-Z][A-Za-z.\-]+(?:\s[A-Z][A-Za-z.\-]+)*,\s*[A-Z]{2}\b|Remote(?:,\s*[A-Za-z .]+)?|Multiple Locations)"
_META_ID = r"/profile/job_details/(\d+)"
_CARD, _OWN = "struct<pos:int,title:string,text:string>", "struct<title:string,text:string,description:string>"


def metacareers(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Postings of Meta's career pages (key, url, html): a card for each linked number, and the page's own posting by its head.

    A card is the link's nearest div or li; its place is looked for in the card's
    text without the title.  A page whose address has a number of its own gives its
    posting from og:title, or else the page's title, and og:description; the longer
    value of a field wins over the card's.
    """
    def rest(text: Column, title: Column) -> Column:
        at = F.call_function("instr", text, title)
        return F.when((at > 0) & (title != ""), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(title), F.length(text)))).otherwise(text)

    def card(a: Column, pos: Column) -> Column:
        def of(box: Column) -> Column:
            head = tree.bound(tree.inside(box, lambda e: tree.is_tag(e, "h1", "h2", "h3", "h4")), lambda e: F.when(e.isNotNull(), tree.text_of(e)))
            title = F.coalesce(F.get(F.filter(tree.strings_of(a), lambda x: ~x.rlike(_NO_TITLE)), 0), head, F.lit(""))
            return F.struct(pos.alias("pos"), title.alias("title"), tree.text_of(box).alias("text"))

        box = F.coalesce(tree.climbed(a, lambda e: tree.is_tag(e, "div", "li")), a)
        return F.struct(F.regexp_extract(tree.attribute(a, "href"), _META_ID, 1).alias("n"), tree.bound(box, of).alias("card"), F.lit(None).cast(_OWN).alias("own"))

    def own(raw: Column) -> Column:
        plain = F.trim(F.regexp_replace(raw, r"\s*[|\-–—]\s*Meta\b.*$", ""))
        return F.struct(F.coalesce(F.nullif(plain, F.lit("")), raw).alias("title"), tree.text_of(F.get("elements", F.lit(0))).alias("text"), meta("og:description").alias("description"))

    meta = lambda name: F.coalesce(tree.attribute(F.get(tree.all_of(lambda e: tree.is_tag(e, "meta") & (tree.attribute(e, "property") == name)), 0), "content"), F.lit(""))
    page_title = tree.bound(F.get(tree.all_of(lambda e: tree.is_tag(e, "title")), 0), tree.text_of)
    detail = F.struct(F.regexp_extract("url", _META_ID, 1).alias("n"), F.lit(None).cast(_CARD).alias("card"), tree.bound(F.coalesce(F.nullif(meta("og:title"), F.lit("")), page_title), own).alias("own"))
    # a page is parsed once for both
    details = F.when(F.col("url").rlike(_META_ID), F.array(detail)).otherwise(F.array().cast(f"array<struct<n:string,card:{_CARD},own:{_OWN}>>"))
    found = tree.tree(pages, key, "url").select(key, F.explode(F.concat(F.transform(tree.links_to(_META_ID), card), details)).alias("c")).select(key, "c.*")
    first = found.groupBy(key, "n", "own").agg(F.min("card").alias("card"))
    rows = first.select(key, "n", *[F.coalesce(f"own.{c}", f"card.{c}").alias(c) for c in ("title", "text")], F.coalesce("own.description", F.lit("")).alias("description"))
    out = rows.select(key, F.concat(F.lit("meta_"), "n").alias("job_id"), "title", F.lit("Meta").alias("company"), F.concat(F.lit("https://www.metacareers.com/profile/job_details/"), "n", F.lit("/")).alias("url"), F.regexp_extract(rest(F.col("text"), F.col("title")), _META_PLACE, 1).alias("location"), "description")
    return _captured(_richest(out, key), key)


def _richest(rows: DataFrame, key: str) -> DataFrame:
    """One row for each page and posting, with the longest value of each field."""
    return rows.groupBy(key, "job_id").agg(*[F.max_by(c, F.length(F.coalesce(c, F.lit("")))).alias(c) for c in rows.columns if c not in (key, "job_id")])


def site_of(url: Column, html: Column) -> Column:
    """linkedin, indeed, metacareers or page: by the address, or without one by the canonical address or marks in the page."""
    canonical = F.regexp_extract(html, r"(?is)(?:<link[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*href|<meta[^>]*property\s*=\s*[\"']og:url[\"'][^>]*content)\s*=\s*[\"']([^\"']*)", 1)
    low = F.lower(F.coalesce(F.nullif(url, F.lit("")), canonical))
    marks = (
        F.when(html.rlike(r"(?is)LinkedIn\s*</title>|linkedin\.com/jobs/view/|data-occludable-job-id|\bjob-card-container\b|\bbase-search-card__title\b|licdn\.com"), "linkedin")
        .when(html.rlike(r"\bjob_seen_beacon\b|\bjcs-JobTitle\b"), "indeed")
        .when(html.contains("/profile/job_details/"), "metacareers")
    )
    by_url = F.when(low.contains("linkedin."), "linkedin").when(low.contains("indeed."), "indeed").when(low.contains("metacareers."), "metacareers")
    return F.coalesce(by_url, F.when(~low.startswith("http"), marks), F.lit("page"))


def captured(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Postings of captured pages (key, url, html) by their site, with source.

    A site's own parser comes first and linked data second; other pages are read
    by linked data, then by links.  The longer value of a field wins.
    """
    rows = pages.withColumn("source", site_of(F.col("url"), F.col("html")))
    of = lambda *sites: rows.where(F.col("source").isin(*sites))
    layers = [(0, linkedin(of("linkedin"), key)), (0, indeed(of("indeed"), key)), (0, metacareers(of("metacareers"), key)), (1, _captured(linked_data(of("linkedin", "indeed", "page"), key), key))]
    found = generic_postings(of("page"), key)
    layers.append((2, _captured(found.withColumns({c: F.lit("") for c in ("company", "location", "description")}), key)))
    every = None
    for at, frame in layers:
        one = frame.withColumn("layer", F.lit(at))
        every = one if every is None else every.unionByName(one)
    merged = every.groupBy(key, "job_id").agg(*[F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("layer"))).alias(c) for c in _CAPTURED if c != "job_id"], F.min("layer").alias("layer"))
    merged = merged.withColumn("_u", F.nullif(norm_url("url"), F.lit("")))
    first = merged.where("_u is not null").groupBy(key, "_u").agg(F.min("layer").alias("_first"))
    kept = merged.join(first, [key, "_u"], "left").where("_first is null or layer = _first")
    return kept.join(rows.select(key, "source"), key).select(key, "source", *_CAPTURED)
