"""One table of platforms: which parser reads what a platform's boards have landed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import posted_date
from postlake.operators.store import union_all
from postlake.sources import boards, listings, pages


@dataclass(frozen=True)
class Landed:
    """bronze: (platform, board, company, url, body, status); details: (url, html) of postings' own pages and of openings pages; local: a pattern of places."""

    bronze: DataFrame
    details: DataFrame
    local: str

    def of(self, platform: str, body: str = "html") -> DataFrame:
        rows = self.bronze.where((F.col("platform") == platform) & (F.col("status") == 200))
        return rows.select("board", "company", "url", F.col("body").alias(body))


def _custom(x: Landed) -> DataFrame:
    seen = x.of("custom").withColumnRenamed("company", "_employer")
    found = pages.custom_postings(seen.select("url", "html"), F.lit(None).cast("string"), hops=x.details)
    root = lambda c: F.regexp_extract(c, r"^(https?://[^/]+)", 1)
    named = seen.groupBy(root("url").alias("_root")).agg(F.min("_employer").alias("_employer"))
    return found.withColumn("_root", root("url")).join(named, "_root").withColumn("company", F.col("_employer")).drop("_root", "_employer", "page")


def _icims(x: Landed) -> DataFrame:
    rows = x.of("icims")
    sitemap = F.coalesce(F.col("url"), F.lit("")).rlike(r"(?i)sitemap|\.xml$")
    return listings.icims(rows.where(~sitemap), rows.where(sitemap).select("board", "company", F.col("html").alias("body")), x.details)


#: Platforms whose boards are pages or feeds; all of boards.BOARDS besides are payloads.
LISTED: dict[str, Callable[[Landed], DataFrame]] = {
    "successfactors": lambda x: listings.successfactors(x.of("successfactors")),
    "kula": lambda x: listings.kula(x.of("kula")),
    "jazzhr": lambda x: listings.jazzhr(x.of("jazzhr"), x.details),
    "icims": _icims,
    "peopleadmin": lambda x: listings.peopleadmin(x.of("peopleadmin", "body"), x.local),
    "custom": _custom,
}
PLATFORMS = (*boards.BOARDS, *LISTED)


def postings(bronze: DataFrame, details: DataFrame, today: Column, local: str, local_only: bool = False) -> DataFrame:
    """Postings of every platform's landed boards (platform, ..boards.COLUMNS, posted_at); rows of unknown platforms give none."""
    landed = Landed(bronze, details, local)
    missing = lambda df: [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in boards.COLUMNS]
    listed = [parse(landed) for parse in LISTED.values()]
    rows = [df.select(F.lit(name).alias("platform"), *missing(df)) for name, df in zip(LISTED, listed, strict=True)]
    payloads = boards.parse_all(bronze, today)
    every = union_all([payloads, union_all(rows).withColumn("posted_at", posted_date("posted_raw", today))])
    return every.where(F.coalesce("location", F.lit("")).rlike(local)) if local_only else every


def board_counts(bronze: DataFrame, local: str) -> DataFrame:
    """(platform, board, n_jobs, n_local) of landed payloads; a total that Workday answers for a search by place counts as local."""
    found = []
    for name, board in boards.BOARDS.items():
        rows = bronze.where((F.col("platform") == name) & (F.col("status") == 200)).withColumn("p", boards._payload(board))
        items = rows.select("board", F.explode_outer(board.items(F.col("p"))).alias("j"))
        place = board.columns(F.col("j"))["location"]
        counted = items.select("board", F.col("j").isNotNull().alias("_is"), F.coalesce(place.rlike(local), F.lit(False)).alias("_local"))
        found.append(counted.groupBy("board").agg(F.count_if("_is").alias("n_jobs"), F.count_if(F.col("_is") & F.col("_local")).alias("n_local")).select(F.lit(name).alias("platform"), "board", "n_jobs", "n_local"))
    return union_all(found)


def has_office(companies: DataFrame, found: DataFrame, own_pages: DataFrame, office: str) -> DataFrame:
    """(company, has_office): whether a place of the company's postings (company, location) or else a page of its site (company, html) is an office in the area."""
    placed = found.where(F.col("location").rlike(office)).select("company").distinct().withColumn("_a", F.lit(True))
    rest = own_pages.join(placed, "company", "left_anti").where(F.col("html").rlike(office)).select("company").distinct().withColumn("_b", F.lit(True))
    return companies.select("company").distinct().join(placed, "company", "left").join(rest, "company", "left").select("company", F.coalesce("_a", "_b", F.lit(False)).alias("has_office"))
