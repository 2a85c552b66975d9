"""Workday boards: places by facet, the rescue of postings with several places, and texts by the site's own interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import html_text
from postlake.operators.store import union_all

# Facets of places, rows that only count their places, and public addresses.
PLACE_FACETS = r"(?i)location|country|region|city|state"
SEVERAL = r"(?i)^\s*\d+\s+locations?\s*$"
PUBLIC = r"^https?://([^./]+)\.wd(\d+)\.myworkdayjobs\.com(?:/[a-z]{2}-[A-Z]{2})?/([^/?#]+)(/job/[^?#]+)"


def place_facets(bronze: DataFrame, local: str) -> DataFrame:
    """(board, param, ids): the facet values, at any depth, whose name is a local place; bronze: first pages (board, status, body).

    A value without a parameter of its own belongs to that of the value around it.
    A level of all boards is a step; the steps end with the deepest value.
    """
    text = lambda v, path: F.try_variant_get(v, path, "string")
    values = lambda v, path: F.explode(F.try_variant_get(v, path, "array<variant>"))
    top = bronze.where("status = 200").select("board", values(F.try_parse_json("body"), "$.facets").alias("v"))
    top = top.select("board", text("v", "$.facetParameter").alias("param"), "v").where(F.col("param").rlike(PLACE_FACETS))
    level, found = top, []
    while not level.isEmpty():
        inner = level.select("board", "param", values("v", "$.values").alias("v"))
        level = inner.select("board", F.coalesce(F.nullif(text("v", "$.facetParameter"), F.lit("")), "param").alias("param"), "v")
        found.append(level.select("board", "param", text("v", "$.id").alias("id")).where((F.col("id") != "") & text("v", "$.descriptor").rlike(local)))
    rows = union_all(found) if found else top.select("board", "param", F.lit("").alias("id"))
    return rows.groupBy("board", "param").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def detail_places(details: DataFrame) -> DataFrame:
    """(board, path, places): all places of postings by their landed details (board, path, status, body); no row where none is known."""
    info = F.try_parse_json("body")
    main = F.array(F.try_variant_get(info, "$.jobPostingInfo.location", "string"))
    more = F.coalesce(F.try_variant_get(info, "$.jobPostingInfo.additionalLocations", "array<string>"), F.array().cast("array<string>"))
    places = F.filter(F.array_compact(F.concat(main, more)), lambda x: x != "")
    rows = details.where("status = 200").select("board", "path", places.alias("places")).where(F.size("places") > 0)
    return rows.groupBy("board", "path").agg(F.max_by("places", F.struct(F.size("places"), F.array_join("places", ";"))).alias("places"))


def located(listed: DataFrame, details: DataFrame, local: str | None = None) -> DataFrame:
    """Listed postings (board, path, location, ..) that are in a local place, with their real places.

    A row whose own text is no local place is kept by its path's place, or, where it
    only says how many places there are, by the full list of its detail.  With no
    ``local`` all rows stay, and such counts are replaced where the list is known.
    """
    place = F.coalesce("location", F.lit(""))
    path = F.coalesce("path", F.lit(""))
    several = place.rlike(SEVERAL) & (path != "")
    ok = lambda x: F.lit(True) if local is None else x.rlike(local)
    spoken = F.replace(F.regexp_extract(path, r"^/job/([^/]+)/", 1), F.lit("-"), F.lit(" "))
    by_path = F.when(place == "", spoken).otherwise(F.concat(spoken, F.lit(" ("), place, F.lit(")")))
    rows = listed.withColumn("_several", several).join(detail_places(details).select("board", "path", F.col("places").alias("_places"), F.lit(True).alias("_several")), ["board", "path", "_several"], "left")
    listed_all = F.array_join("_places", "; ")
    rescued = F.when(ok(spoken), by_path).when(F.col("_several") & F.exists("_places", ok), listed_all)
    real = F.when(ok(place), F.when(F.col("_several"), F.coalesce(listed_all, place)).otherwise(place)).otherwise(rescued)
    return rows.withColumn("location", real).where("location IS NOT NULL").select(*listed.columns)


def detail_url(url: Column, tenant: Column | None = None) -> Column:
    """The interface's address of a posting by its public one; null for other addresses.  tenant: the id in its path, where that is known."""
    part = lambda i: F.regexp_extract(url, PUBLIC, i)
    return F.when(url.rlike(PUBLIC), F.concat(F.lit("https://"), part(1), F.lit(".wd"), part(2), F.lit(".myworkdayjobs.com/wday/cxs/"), part(1) if tenant is None else F.coalesce(tenant, part(1)), F.lit("/"), part(3), part(4)))


def tenant_ids(host: Column) -> Column:
    """Ids to try in the interface's path, in order: the host's name, and with underscores for hyphens."""
    return F.array_distinct(F.array(host, F.replace(host, F.lit("-"), F.lit("_"))))


def tenants(answers: DataFrame) -> DataFrame:
    """(tenant, pod, site, id): the first id that answered with a number of postings, or else the host's name; answers: (tenant, pod, site, id, status, body)."""
    total = F.try_variant_get(F.try_parse_json("body"), "$.total", "int")
    at = F.array_position(tenant_ids(F.col("tenant")), F.col("id"))
    good = F.when((F.col("status") == 200) & total.isNotNull() & (at > 0), F.struct(at.alias("at"), "id"))
    return answers.groupBy("tenant", "pod", "site").agg(F.min(good).alias("s")).select("tenant", "pod", "site", F.coalesce("s.id", "tenant").alias("id"))


def described(postings: DataFrame, details: DataFrame, shorter_than: int = 200) -> DataFrame:
    """Postings (url, description) with the text of their details (url of the interface, status, body) where their own is short.

    What a listing says of the day of posting stands in for a text that is not known.
    """
    told = html_text(F.coalesce(F.try_variant_get(F.try_parse_json("body"), "$.jobPostingInfo.jobDescription", "string"), F.lit("")))
    texts = details.where("status = 200").select(F.col("url").alias("_url"), told.alias("_told")).where("_told <> ''").groupBy("_url").agg(F.max_by("_told", F.struct(F.length("_told"), "_told")).alias("_told"))
    own = F.coalesce("description", F.lit(""))
    rows = postings.withColumn("_url", F.when(F.length(own) < shorter_than, detail_url(F.col("url"), F.col("tenant_id") if "tenant_id" in postings.columns else None)))
    return rows.join(texts, "_url", "left").withColumn("description", F.coalesce("_told", "description")).select(*postings.columns)
