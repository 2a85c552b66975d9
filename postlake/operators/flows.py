"""Crawl and ingest: gates, links and the store put together.

Rows of all companies go through at once; one company's crawl is the same over its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import predicates
from postlake.functions.text import ingest_id
from postlake.operators.judging import Scorer, judged, within_budget
from postlake.operators.store import first_of, fold, merge_postings, touched, union_all
from postlake.profile import Profile


def _local(profile: Profile) -> str | None:
    return predicates.locality_pattern(profile.local_words, profile.local_names) if profile.local_words or profile.local_names else None


def sources_in_order(groups: list[DataFrame]) -> DataFrame:
    """Sources (kind, spec, pos) of all groups, each once: earlier groups before later ones, specs equal whatever their case."""
    rows = union_all([g.withColumn("_group", F.lit(i)) for i, g in enumerate(groups)])
    once = first_of(rows, [F.col("kind"), F.lower("spec")], [F.col("_group"), F.col("pos")])
    return once.orderBy("_group", "pos").drop("_group")


def linked(incoming: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings (company) with the company_id and company_tags of the company of that name, whatever its case; of several the smallest id."""
    once = companies.where("name <> ''").groupBy(F.lower("name").alias("_name")).agg(F.min(F.struct("company_id", "tags")).alias("_c"))
    rows = incoming.join(once, F.lower("company") == F.col("_name"), "left")
    return rows.select(*incoming.columns, F.col("_c.company_id").alias("company_id"), F.col("_c.tags").alias("company_tags"))


def watched() -> Column:
    return F.coalesce(F.array_contains("company_tags", "watch"), F.lit(False))


def ingested(incoming: DataFrame, companies: DataFrame, stored: DataFrame, source: str, profile: Profile, curated: bool = False, excludes: bool = True) -> DataFrame:
    """Postings from outside (id, title, company, url, location, description, ordinal) that pass, with is_new.

    With localities in the profile only local postings pass, and remote ones of
    watched companies; picked by hand (``curated``) or not.  Other postings also
    need a technical title and no reason against them.  A posting without id gets
    one from its address, title and company; of equal ids the last counts.
    geo_mode is onsite unless known.
    """
    given = F.nullif(F.col("id"), F.lit(""))
    rows = linked(incoming.withColumn("job_id", F.coalesce(given, ingest_id(F.lit(source), "url", "title", "company"))), companies)
    local = _local(profile)
    if local is not None:
        mode = predicates.geo_mode("location", "description", local)
        near = F.lower(F.coalesce("location", F.lit(""))).rlike(local) | (watched() & F.coalesce(mode == "remote", F.lit(False)))
        rows = rows.withColumn("geo_mode", mode).where(near)
    else:
        rows = rows.withColumn("geo_mode", F.lit(None).cast("string"))
    if not curated:
        rows = rows.where(predicates.is_technical("title", profile.technical_title))
        if excludes:
            rows = rows.where(predicates.exclude_reason("title", "description", profile.excludes, profile.vocabulary.boilerplate).isNull())
    last = first_of(rows, [F.col("job_id")], [-F.col("ordinal")])
    known = stored.select("job_id").where("job_id is not null").distinct().withColumn("_known", F.lit(True))
    out = last.join(known, "job_id", "left").withColumn("is_new", F.col("_known").isNull())
    return out.withColumn("geo_mode", F.coalesce("geo_mode", F.lit("onsite"))).drop("_known", "id", "ordinal")


def stored_after_ingest(stored: DataFrame, passed: DataFrame, now: Column) -> DataFrame:
    """The store with new postings, open and seen now, and known ones touched: they are not scored again."""
    new = passed.where("is_new").withColumnRenamed("company", "company_name").withColumns({"status": F.lit("open"), "first_seen": now, "last_seen": now})
    seen = touched(stored, passed.where("not is_new"), now)
    return seen.unionByName(new.select(*[c for c in new.columns if c in stored.columns]), allowMissingColumns=True)


def crawled(fetched: DataFrame, companies: DataFrame, stored: DataFrame, profile: Profile, whole_board: tuple[str, ...] = ("watch",), excludes: bool = True) -> DataFrame:
    """Fetched postings (company_id, job_id, title, description, location) with kept, fresh and watch_hit.

    kept: all gates of the company's board pass; boards of companies with a tag of
    ``whole_board`` were fetched as a whole.  fresh: kept and not stored yet.
    watch_hit: not stored yet, at a watched company, technical and not excluded,
    wherever it is; those that are not fresh are stored without a score.
    """
    multi = [x.lower() for x in profile.multi_division]
    rows = fetched.join(companies.select("company_id", F.col("name").alias("company_name"), F.col("tags").alias("company_tags")), "company_id")
    known = stored.select("job_id").where("job_id is not null").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "job_id", "left")
    kept = predicates.keep_job(
        "title", "description", "location", technical=profile.technical_title, vocabulary=profile.vocabulary, excludes=profile.excludes if excludes else None, local=_local(profile),
        multi_division=F.lower(F.trim("company_name")).isin(*multi) if multi else False, watched=watched(), boilerplate=profile.vocabulary.boilerplate,
        whole_board=F.coalesce(F.arrays_overlap("company_tags", F.array(*map(F.lit, whole_board))), F.lit(False)),
    )
    hit = watched() & predicates.is_technical("title", profile.technical_title)
    if excludes:
        hit &= predicates.exclude_reason("title", "description", profile.excludes, profile.vocabulary.boilerplate, allow_defense=True).isNull()
    new = F.col("_known").isNull()
    rows = rows.withColumn("kept", F.coalesce(kept, F.lit(False)))
    return rows.withColumns({"fresh": F.col("kept") & new, "watch_hit": F.coalesce(hit, F.lit(False)) & new}).drop("_known")


def crawl(stored: DataFrame, fetched: DataFrame, companies: DataFrame, profile: Profile, now: Column, scorer: Scorer | None = None, guard: int = 300, confirmed: bool = False, track: str | None = None, excludes: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """From fetched boards to the next store: (store, funnel by company, what the guard said).

    Postings that pass their company's gates and are new are judged and merged in; the
    store keeps them without a score where there is no scorer or the guard stops
    (more than ``guard`` of them, not confirmed), so that a later run heals them and
    none counts as new again.  New hits at watched companies that do not pass are
    stored without a score too.  Known ones are only seen again.  A single company's
    crawl is the same over its rows.
    """
    rows = crawled(fetched, companies, stored, profile, excludes=excludes)
    fresh = rows.where("fresh OR watch_hit")
    allowed, cost = within_budget(fresh.where("fresh"), guard, confirmed) if scorer else (False, 0.0)
    mode = F.coalesce(predicates.geo_mode("location", "description", _local(profile)) if _local(profile) else F.lit(None), F.lit("onsite"))
    known = {"company_id", "company_name", "job_id", "title", "url", "location", "description", "posted_at"} & set(rows.columns)
    new = fresh.select(*sorted(known), mode.alias("geo_mode"), F.lit("open").alias("status"), now.alias("first_seen"), now.alias("last_seen"), *([F.array(F.lit(track)).alias("track")] if track else []), F.lit(0).alias("ordinal"))
    if scorer and allowed:
        scores = judged(fresh.where("fresh").select("job_id", "title", "description").dropDuplicates(["job_id"]), scorer, profile)
        new = new.join(scores, "job_id", "left")
    new = new.select(*[c for c in new.columns if c in (*stored.columns, "ordinal")])
    seen = touched(stored, rows.where("kept AND NOT fresh"), now)
    return merge_postings(seen, fold(new)), crawl_funnel(rows), {"scored": bool(scorer and allowed), "stopped": bool(scorer and not allowed), "cost": cost}


def crawl_funnel(rows: DataFrame, by: str = "company_name") -> DataFrame:
    """(by, fetched, kept, fresh, watch_hits) of crawled rows."""
    counts = [F.count_if(F.col(c)).alias(n) for c, n in (("kept", "kept"), ("fresh", "fresh"), ("watch_hit", "watch_hits"))]
    return rows.groupBy(by).agg(F.count("*").alias("fetched"), *counts)


def titles_on_board(postings: DataFrame, board: DataFrame, normalised) -> DataFrame:
    """(job_id, board_job_id) of postings whose title is on their company's board; of several postings of the board with that title the last by id."""
    alike = board.groupBy("company_id", normalised("title").alias("_t")).agg(F.max("job_id").alias("board_job_id")).where("_t <> ''")
    mine = postings.select("job_id", "company_id", normalised("title").alias("_t"))
    return mine.join(alike, ["company_id", "_t"]).select("job_id", "board_job_id")


def still_valid(cache: DataFrame, now: Column, days: float, at: str = "fetched_at") -> DataFrame:
    """Cached rows that are younger than ``days``; rows without a time are not."""
    return cache.where(F.col(at) > now - F.make_dt_interval(F.lit(int(days)), F.lit(int(days % 1 * 24))))
