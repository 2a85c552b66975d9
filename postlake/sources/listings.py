"""Boards that are read from listing pages: landed HTML or Atom, and detail pages where the listing lacks something.

Listings are (board, company, url, html) rows, one for each landed page; a posting
that several pages show counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.predicates import company_tokens, same_company
from postlake.functions.text import html_text, stable_id
from postlake.operators.store import first_of
from postlake.sources import pages, tree

UNKNOWN = "See posting"
_ANCHOR = r"(?is)(<a\s[^>]*href\s*=\s*[\"'][^\"']*{0}[^\"']*[\"'][^>]*>.*?</a>)"


def _anchors(listings: DataFrame, part: str) -> DataFrame:
    """Links whose address has a part that matches: (board, company, page, pos, href, text)."""
    found = listings.select("board", "company", F.col("url").alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR.format(part)), 1)).alias("pos", "a"))
    href = F.replace(F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)", 1), F.lit("&amp;"), F.lit("&"))
    return found.select("board", "company", "page", "pos", href.alias("href"), html_text("a").alias("text"))


def _once(rows: DataFrame, key: str = "job_id") -> DataFrame:
    return first_of(rows, [F.col(key)], [F.col("page"), F.col("pos")]).drop("page", "pos")


def jazzhr(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Postings in the linked data of the detail pages (url, html) that a board's listing names."""
    path = F.explode(F.regexp_extract_all("html", F.lit(r"(/apply/[A-Za-z0-9]+/[A-Za-z0-9_-]+)"), 1))
    named = listings.select("board", "company", path.alias("path")).distinct()
    named = named.select("board", "company", F.concat(F.lit("https://"), "board", F.lit(".applytojob.com"), "path").alias("page"))
    found = pages.linked_data(named.join(details.select(F.col("url").alias("page"), "html"), "page"), "page")
    rows = found.join(named.groupBy("page").agg(F.min("company").alias("_company")), "page")
    return rows.withColumns({"company": F.coalesce("company", "_company"), "url": F.coalesce("url", "page")}).drop("_company", "page")


def successfactors(listings: DataFrame) -> DataFrame:
    """Postings that listing pages link to; the place is at the head of a link's slug: City,-ST-Title."""
    rows = _anchors(listings, "/job/").withColumn("url", pages.absolute(F.col("page"), F.col("href")))
    slug = r"/job/(.+?),-([A-Z]{2})-"
    plain = F.try_url_decode("url")
    place = F.concat(F.trim(F.replace(F.regexp_extract(plain, slug, 1), F.lit("-"), F.lit(" "))), F.lit(", "), F.regexp_extract(plain, slug, 2))
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"/job/[^/]+/(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("url", r"/job/([^/?#]+)", 1), F.lit("")))
    out = rows.select(F.concat_ws("_", F.lit("sf"), "board", number).alias("job_id"), F.col("text").alias("title"), "company", "url", F.when(plain.rlike(slug), place).otherwise(UNKNOWN).alias("location"), "page", "pos")
    return _once(out.where("title <> ''"))


def icims(listings: DataFrame, sitemaps: DataFrame, details: DataFrame) -> DataFrame:
    """Postings by listing pages, or for boards without any link there by their sitemap (board, company, body).

    A place that the link's text lacks comes from the detail page's linked data
    (url, html), as does the description.  Titles of sitemaps are their slugs.
    """
    rows = _anchors(listings, r"/jobs/\d+/")
    host = F.concat(F.lit("https://"), "board", F.lit(".icims.com"))
    number = F.regexp_extract("href", r"/jobs/(\d+)/", 1)
    title = F.trim(F.regexp_replace("text", r"^\s*Requisition Title\s*", ""))
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(host, "href"))
    listed = rows.select("board", "company", number.alias("n"), title.alias("title"), url.alias("url"), pages.place_in(F.col("text")).alias("location"), "page", "pos").where("title <> ''")
    shells = sitemaps.join(listed.select("board").distinct(), "board", "left_anti")
    mapped = shells.select("board", "company", F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+/jobs/\d+/[^/<\s]+/job[^<\s]*)\s*</loc>"), 1)).alias("pos", "url"))
    slug = F.try_url_decode(F.regexp_extract("url", r"/jobs/\d+/([^/]+)/job", 1))
    spoken = F.trim(F.replace(F.replace(slug, F.lit("---"), F.lit(" – ")), F.lit("-"), F.lit(" ")))
    spoken = F.replace(spoken, F.lit("–"), F.lit("-"))
    mapped = mapped.select("board", "company", F.regexp_extract("url", r"/jobs/(\d+)/", 1).alias("n"), spoken.alias("title"), "url", F.lit(None).cast("string").alias("location"), F.col("url").alias("page"), "pos")
    every = _once(listed.unionByName(mapped).withColumn("job_id", F.concat_ws("_", F.lit("icims"), "board", "n")))
    told = pages.linked_data(details.select(F.col("url").alias("_url"), "html"), "_url").groupBy("_url").agg(F.max("location").alias("_place"), F.max("description").alias("description"))
    out = every.join(told, F.col("url") == F.col("_url"), "left")
    return out.select("job_id", "title", "company", "url", F.coalesce("location", F.nullif("_place", F.lit(""))).alias("location"), "description")


def kula(listings: DataFrame) -> DataFrame:
    """Postings of boards whose cards hold department, title and place, in this order.

    A card is the nearest of the link's eight ancestors with two lines or more, or
    else the furthest of them; lines of up to three characters are no field.  Of
    several places the first counts.
    """
    cards = tree.tree(listings, "board", "company", "url", over=3).withColumnRenamed("url", "page")
    link = F.concat(F.lit(r"/\Q"), "board", F.lit(r"\E/\d+/?$"))
    card = lambda a: F.coalesce(tree.climbed(a, lambda e: e["until"] - e["first"] >= 2, 8), F.element_at(tree.ancestors(a, 8), -1))
    fields = lambda a: tree.bound(card(a), lambda e: F.slice(F.col("strings"), e["first"] + 1, F.least(e["until"] - e["first"], F.lit(3))))
    found = tree.all_of(lambda e: tree.is_tag(e, "a") & F.call_function("rlike", tree.attribute(e, "href"), link))
    rows = cards.select("board", "company", "page", F.posexplode(F.transform(found, lambda a: F.struct(tree.attribute(a, "href").alias("href"), fields(a).alias("l")))).alias("pos", "c"))
    rows = rows.select("board", "company", "page", "pos", "c.*")
    title = F.coalesce(F.get("l", F.lit(1)), F.get("l", F.lit(0)), F.lit("Unknown"))
    place = F.trim(F.substring_index(F.coalesce(F.get("l", F.lit(2)), F.lit(UNKNOWN)), ";", 1))
    return _once(rows.select(F.concat_ws("_", F.lit("kula"), "board", F.regexp_extract("href", r"/(\d+)/?$", 1)).alias("job_id"), title.alias("title"), "company", pages.absolute(F.col("page"), F.col("href")).alias("url"), place.alias("location"), "page", "pos"))


_ATOM = "title string, entry array<struct<title:string,link:struct<_href:string>,summary:string,content:string>>"


def peopleadmin(feeds: DataFrame, place: str, relevant: Column | None = None) -> DataFrame:
    """Entries of Atom feeds (board, company, body) as postings; ``relevant`` is a test on title and description.

    The place is what the pattern ``place`` finds in an entry's text, or else in the
    feed's title, or else that title's first 60 characters.
    """
    found = feeds.select("board", "company", F.from_xml("body", _ATOM).alias("f")).select("board", "company", F.trim("f.title").alias("feed"), F.explode("f.entry").alias("e"))
    body = html_text(F.coalesce("e.summary", "e.content", F.lit("")))
    edge = r"^[ ,\-]+|[ ,\-]+$"
    near = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(c, place, 0), edge, ""), F.lit(""))
    rows = found.select("board", "company", "feed", F.trim("e.title").alias("title"), F.col("e.link._href").alias("url"), body.alias("description")).where("title <> '' and url <> ''")
    number = F.coalesce(F.nullif(F.regexp_extract("url", r"/postings/(\d+)", 1), F.lit("")), stable_id("url"))
    out = rows.select(F.concat_ws("_", F.lit("peopleadmin"), "board", number).alias("job_id"), "title", "company", "url", F.coalesce(near(F.col("description")), near(F.col("feed")), F.nullif(F.left("feed", F.lit(60)), F.lit("")), F.lit(UNKNOWN)).alias("location"), "description")
    return out if relevant is None else out.where(relevant)


_NLX = "Jobs array<struct<JvId:string,JobTitle:string,Company:string,URL:string,Location:string>>"


def nlx(bronze: DataFrame) -> DataFrame:
    """Search results (company, body, status) as postings of the company that was asked for; other employers' go."""
    rows = bronze.where("status = 200").select("company", F.explode(F.from_json("body", _NLX)["Jobs"]).alias("j"))
    mine = rows.where(same_company(company_tokens("j.Company"), company_tokens("company")))
    number = F.coalesce(F.nullif(F.col("j.JvId"), F.lit("")), stable_id("j.URL", "j.JobTitle"))
    out = mine.select(F.concat(F.lit("nlx_"), number).alias("job_id"), F.trim("j.JobTitle").alias("title"), "company", F.coalesce("j.URL", F.lit("")).alias("url"), F.trim(F.coalesce("j.Location", F.lit(""))).alias("location"), F.lit("").alias("description"))
    return first_of(out, [F.col("job_id")], [F.col("company"), F.col("title")])
