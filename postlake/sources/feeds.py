"""Feeds and free text to postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import html_text, stable_id

_FEED = "channel struct<item:array<struct<title:string,link:string,guid:string,description:string,pubDate:string>>>, entry array<struct<title:string,id:string,summary:string,updated:string>>"


def rss(bronze: DataFrame, source: str, default_location: str = "Remote") -> DataFrame:
    """Items of RSS, or else entries of Atom feeds (body), as postings."""
    rows = bronze.where("status = 200").select("board", F.from_xml("body", _FEED).alias("f"))
    one = lambda t, link, guid, text, date: F.struct(t.alias("title"), link.alias("link"), guid.alias("guid"), text.alias("text"), date.alias("date"))
    items = F.transform("f.channel.item", lambda x: one(x["title"], x["link"], F.coalesce(x["guid"], x["link"]), x["description"], x["pubDate"]))
    entries = F.transform("f.entry", lambda x: one(x["title"], x["id"], x["id"], x["summary"], x["updated"]))
    found = rows.select("board", F.explode(F.coalesce(items, entries)).alias("x"))
    parts = title_parts(F.col("x.title"))
    return found.select(F.concat(F.lit("rss_"), stable_id("x.guid")).alias("job_id"), parts["role"].alias("title"), F.coalesce(parts["company"], F.lit(source)).alias("company"), F.col("x.link").alias("url"), F.coalesce(parts["region"], F.lit(default_location)).alias("location"), html_text(F.coalesce("x.text", F.lit(""))).alias("description"), F.col("x.date").alias("posted_raw"))


def title_parts(title: Column) -> dict[str, Column]:
    """Role, company and region of "Company: Role | region" or "Role at Company (Region)"; else the title is the role."""
    t = F.trim(title)
    colon, at = r"^([^:]{1,60}[^:,. ]): +([^|]+?)(?: *\| *(.+))?$", r"^(.+?) at ([^()]+?)(?: *\(([^)]*)\))?$"
    first, second = t.rlike(colon), t.rlike(at)
    pick = lambda i, j: F.nullif(F.when(first, F.regexp_extract(t, colon, i)).when(second, F.regexp_extract(t, at, j)), F.lit(""))
    return {"role": F.coalesce(pick(2, 1), t), "company": pick(1, 2), "region": pick(3, 3)}


# What tells the fields of a post's header apart.
ROLE = r"(?i)\b(engineer|engineering|developer|dev\b|scientist|analyst|manager|designer|architect|researcher|programmer|consultant|specialist|director|lead|head\s+of|founding|technician|administrator|devops|sre|data|machine\s+learning|\bml\b|\bai\b|full[\s-]?stack|back[\s-]?end|front[\s-]?end|\bqa\b|quality|test|product|software|research|infrastructure|platform|security|biostat|bioinformatic)\b"
PLACE = r"(?i)\b(remote|onsite|on-site|hybrid|wfh|anywhere|relocation|visa|usa?|uk|eu|emea|apac|canada|europe|worldwide|global|nationwide|(north|south|latin)\s+america|america|americas|latam|united\s+states|new\s+york|boston|london|berlin|austin|seattle|durham|raleigh|san\s+francisco|sf\b|nyc\b)\b"
PAY = r"(?i)(\$|€|£|\d{2,3}\s*[-–]\s*\d{2,3}\s*k|\bk\+|/yr|/year|salary|equity|benefits|compensation|\bcomp\b)"
TERMS = r"(?i)^\s*(full[\s-]?time|part[\s-]?time|contract|permanent|intern(ship)?|w2|c2c|freelance|multiple\s+roles?|various\s+roles?)\s*$"
ADDRESS = r"(?i)https?://|www\.|\.(com|io|ai|org|net|co|health|dev)\b"
_EDGES = r"^[ \-—|·•:,]+|[ \-—|·•:,]+$"


def _is_role(x: Column) -> Column:
    return x.rlike(ROLE) & ~x.rlike(PAY) & ~x.rlike(ADDRESS)


def _is_place(x: Column) -> Column:
    return x.rlike(PLACE) & ~x.rlike(ROLE)


def header_fields(text: Column) -> dict[str, Column]:
    """Company, role and location of a free-text post whose first line has fields between bars or dots, in any order.

    A first line without bars is read up to its first sentence's end.  The role is
    the first field that looks like one, or else one of the next five lines, or
    else a field that is no place, pay, terms or address.  What is missing is null.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    head = F.when(line.contains("|"), line).otherwise(F.substring_index(line, ". ", 1))
    fields = F.filter(F.transform(F.split(head, r"[|•·]"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(fields, lambda _, i: i > 0)
    first = lambda xs, test: F.get(F.filter(xs, test), F.lit(0))
    below = F.transform(F.slice(lines, 2, 5), lambda x: F.trim(F.regexp_replace(x, r"^[-*•·]\s*", "")))
    other = lambda x: ~_is_place(x) & ~x.rlike(PAY) & ~x.rlike(TERMS) & ~x.rlike(ADDRESS)
    role = F.coalesce(first(rest, _is_role), first(below, lambda x: _is_role(x) & (F.length(x) <= 110)), first(rest, other))
    tidy = F.regexp_replace(F.regexp_replace(role, r"\s+", " "), _EDGES, "")
    company = F.regexp_replace(F.regexp_replace(F.get(fields, F.lit(0)), r"https?://[^\s<>\"']+", ""), r"[\(\[][^)\]]*[\)\]]?", "")
    return {
        "company": F.nullif(F.regexp_replace(F.regexp_replace(company, r"\s+", " "), _EDGES, ""), F.lit("")),
        "role": F.when(F.length(tidy) > 110, F.concat(F.rtrim(F.left(tidy, F.lit(107))), F.lit("..."))).otherwise(tidy),
        "location": first(rest, lambda x: _is_place(x) & (x != F.coalesce(role, F.lit("")))),
    }


def hiring_posts(threads: DataFrame, comments: DataFrame, title: str = r"(?i)who is hiring") -> DataFrame:
    """Posts (comment_id, thread_id, text) under threads (thread_id, title) of that title, as postings."""
    rows = comments.join(threads.where(F.col("title").rlike(title)).select("thread_id"), "thread_id", "left_semi").withColumn("t", html_text("text"))
    f = header_fields(F.col("t"))
    out = rows.select(F.concat(F.lit("hn_"), F.col("comment_id").cast("string")).alias("job_id"), f["role"].alias("title"), f["company"].alias("company"), F.nullif(F.regexp_extract("t", r"https?://[^\s<>\"']+", 0), F.lit("")).alias("url"), f["location"].alias("location"), F.col("t").alias("description"))
    return out.where("title is not null and company is not null")


def sitemap_urls(bronze: DataFrame, pattern: str, depth: int = 2) -> DataFrame:
    """(url) of landed sitemaps (url, body), following nested indexes up to ``depth`` joins."""
    locs = bronze.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("loc"), F.col("body").contains("<sitemapindex").alias("is_index"))
    index, pages = locs.where("is_index").select("url", "loc"), locs.where("not is_index").select("url", "loc")
    nested = bronze.select("url").join(index.select(F.col("loc").alias("url")), "url", "left_anti")
    out = nested.join(pages, "url").select(F.col("loc").alias("url"))
    level = nested.join(index, "url").select(F.col("loc").alias("url"))
    for _ in range(depth):
        out = out.unionByName(level.join(pages, "url").select(F.col("loc").alias("url")))
        level = level.join(index, "url").select(F.col("loc").alias("url"))
    return out.where(F.col("url").rlike(pattern)).distinct()
