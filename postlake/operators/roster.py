"""The roster of employers: export and import, pruning, and what discovery adds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import name_key
from postlake.operators.store import first_of, merge_companies

#: Boards that a parser reads, and slugs that can be one.
FETCHABLE = ("greenhouse", "lever", "ashby", "bamboohr", "adp", "paylocity", "rippling", "ultipro", "workday", "smartrecruiters", "wpjson", "jazzhr", "kula", "icims", "successfactors", "peopleadmin", "custom")
SLUG = r"^[A-Za-z0-9][A-Za-z0-9_.|-]*$"


def export_roster(companies: DataFrame, path: str) -> None:
    """JSON lines by name, without the surrogate id."""
    companies.drop("id").orderBy("name").write.mode("overwrite").json(path)


def import_roster(spark: SparkSession, path: str, companies: DataFrame) -> DataFrame:
    """The roster merged with an exported one; of repeated names the first in order of board and slug."""
    read = spark.read.schema(companies.drop("id").schema).json(path).where(F.coalesce("name", F.lit("")) != "")
    once = first_of(read, [F.col("name")], [F.col("ats"), F.col("slug")])
    return merge_companies(companies.drop("id"), once)


def pruned(companies: DataFrame, probes: DataFrame, multi_division: tuple[str, ...] = (), off_mission: bool = False) -> DataFrame:
    """Boards that a probe (name, ok) found dead become inactive, with a note.

    With ``off_mission`` so do employers of that tier, but for watched and
    multi-division ones.
    """
    rows = companies.join(probes.select("name", "ok"), "name", "left")
    dead = F.col("active") & (F.col("ok") == F.lit(False))
    spared = F.coalesce(F.array_contains("tags", "watch"), F.lit(False)) | F.lower("name").isin(*[x.lower() for x in multi_division])
    off = F.lit(off_mission) & F.col("active") & (F.coalesce("mission_tier", F.lit("")) == "off-mission") & ~spared
    dead, off = F.coalesce(dead, F.lit(False)), F.coalesce(off, F.lit(False))
    notes = F.when(dead, "board not found").when(off, "off mission").otherwise(F.col("notes"))
    return rows.withColumns({"active": F.when(dead | off, False).otherwise(F.col("active")), "notes": notes}).select(*companies.columns)


def discovered(companies: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """New employers (name, ats, slug, pos) from discovery: parsable boards with plausible slugs that no employer has, of each name and board the first."""
    good = found.where(F.col("ats").isin(*FETCHABLE) & F.col("slug").rlike(SLUG)).withColumn("_k", name_key("name"))
    fresh = good.join(companies.select(name_key("name").alias("_k")).distinct(), "_k", "left_anti").join(companies.select("ats", "slug").distinct(), ["ats", "slug"], "left_anti")
    by_name = first_of(fresh, [F.col("_k")], [F.col("pos")])
    by_board = first_of(by_name, [F.col("ats"), F.col("slug")], [F.col("pos")])
    return by_board.select("name", "ats", "slug", F.lit(f"discovery:{source}").alias("source"), F.lit(True).alias("active"))
