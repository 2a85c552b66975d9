"""Ranked and summarised views over postings and companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import predicates
from postlake.functions.scoring import effective_mission, with_mission
from postlake.functions.text import age_tag

#: Dispositions that take a posting out of the ranking.
OUT_OF_RANKING = ("applied", "interviewing", "offer", "rejected", "dismissed")


def not_closed(status: str = "status") -> Column:
    """Written so that it reaches the Parquet scan."""
    return F.col(status).isNull() | (F.col(status) != "closed")


def ranked(postings: DataFrame, companies: DataFrame, multi_division: Column, floor: float = 0.6, rank_by: str = "combined", min_mission: float | None = None, local: str | None = None, allow_modes: tuple[str, ...] = (), include_closed: bool = False, include_dispositioned: bool = False, track: str | None = None, limit: int | None = None) -> DataFrame:
    """Postings with their company's mission, best first; ties by job_id.

    With ``local``, a posting needs a local location, or one of ``allow_modes`` at a
    watched company.  An unknown mission passes ``min_mission``.  A limit is part of
    the order, so Spark keeps the best of each partition only.
    """
    rows = postings
    if not include_closed:
        rows = rows.where(not_closed())
    if not include_dispositioned:
        rows = rows.where(F.col("disposition").isNull() | ~F.col("disposition").isin(*OUT_OF_RANKING))
    if track is not None:
        rows = rows.where(F.array_contains("track", track))
    rows = rows.join(companies, "company_id", "left")
    if local is not None:
        here = F.lower(F.coalesce("location", F.lit(""))).rlike(local)
        rows = rows.where(here | (F.col("geo_mode").isin(*allow_modes) & F.coalesce(F.array_contains("tags", "watch"), F.lit(False))))
    rows = rows.withColumn("mission", effective_mission("mission_score", multi_division, floor)).withColumn("combined", with_mission("fit", "mission"))
    if min_mission is not None:
        rows = rows.where(F.col("mission").isNull() | (F.col("mission") >= min_mission))
    low = lambda c: F.coalesce(F.col(c), F.lit(-1.0)).desc()
    rows = rows.orderBy(low(rank_by), low("combined"), low("fit"), low("mission"), "job_id")
    return rows.limit(limit) if limit is not None else rows


def numbered(rows: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """Ranks from 1 within groups."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def pipeline(postings: DataFrame) -> DataFrame:
    return postings.where(F.col("disposition").isNotNull()).orderBy(F.desc_nulls_last("disposition_at"), "job_id")


def open_counts(companies: DataFrame, postings: DataFrame) -> DataFrame:
    counts = postings.where(not_closed()).groupBy("company_id").agg(F.count("*").alias("n_open"))
    return companies.join(counts, "company_id", "left").withColumn("n_open", F.coalesce("n_open", F.lit(0)).cast("long"))


def stats(postings: DataFrame, today: Column) -> DataFrame:
    """All tiles in one pass."""
    is_open = not_closed()
    out = postings.agg(
        F.count_if(is_open).alias("n_open"),
        F.count_if(~is_open).alias("n_closed"),
        F.count_if(is_open & (F.col("first_seen").cast("date") == today)).alias("new_today"),
        F.count_if(is_open & F.col("posted_at").isNotNull()).alias("n_dated"),
        F.count("disposition").alias("n_pipeline"),
        F.count_if(F.col("disposition") == "saved").alias("n_saved"),
    )
    return out.withColumn("dated_percent", F.coalesce(F.round(100 * F.col("n_dated") / F.nullif(F.col("n_open"), F.lit(0)), 0), F.lit(0.0)))


def funnel(rows: DataFrame, source: str, relevant: Column, kept: Column, new: Column) -> DataFrame:
    rows = rows.select(source, relevant.alias("_relevant"), kept.alias("_kept"), new.alias("_new"))  # a gate is a reading of the text
    relevant, kept, new = F.col("_relevant"), F.col("_kept"), F.col("_new")
    return rows.groupBy(source).agg(F.count("*").alias("fetched"), F.count_if(relevant).alias("gate1"), F.count_if(relevant & kept).alias("kept"), F.count_if(relevant & kept & new).alias("n_new"))


def diversified(rows: DataFrame, company: str, pos: str, n: int) -> DataFrame:
    """n rows, round after round one of each company, companies in the order of their first row."""
    first = rows.groupBy(F.col(company).alias("_company")).agg(F.min(pos).alias("first_pos"))
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(company).orderBy(pos))).where(F.col("turn") <= n)  # Spark keeps n rows a task before the shuffle
    return turn.join(first, F.col(company).eqNullSafe(F.col("_company"))).drop("_company").orderBy("turn", "first_pos").limit(n)


def digest(ranked_rows: DataFrame, title: str = "Ranked postings") -> DataFrame:
    """Markdown lines (pos, line) of a ranked frame with rank, job_id, title, fit and age."""
    line = F.format_string("%d. [%.2f] %s — %s (%s)", "rank", F.coalesce("fit", F.lit(0.0)), F.coalesce("title", F.lit("?")), "job_id", "age")
    body = ranked_rows.select(F.col("rank").cast("long").alias("pos"), line.alias("line"))
    head = ranked_rows.sparkSession.createDataFrame([(0, f"# {title}")], "pos long, line string")
    return head.unionByName(body)


def shown(rows: DataFrame, search: str = "", min_fit: float = 0.0, relocation: bool = False, age: str | None = None, watched_only: bool = False, verified_only: bool = False) -> DataFrame:
    """The user's filters over ranked rows with bucket, us_ok, age, watched and verified.

    Remote postings elsewhere than in the US never show; relocation only on demand.
    age is new, fresh (up to 7 days) or stale (45 and more).
    """
    days = F.regexp_extract("age", r"^(\d+)d", 1).try_cast("int")
    keep = (F.coalesce("fit", F.lit(0.0)) >= min_fit) & ~((F.col("bucket") == "remote") & ~F.col("us_ok"))
    if search:
        keep &= F.lower(F.concat_ws(" ", "title", "company", "location")).contains(search.lower())
    if not relocation:
        keep &= F.col("bucket") != "relocation"
    if age is not None:
        keep &= {"new": F.col("age") == "NEW", "fresh": (F.col("age") == "NEW") | (days <= 7), "stale": days >= 45}[age]
    if watched_only:
        keep &= F.col("watched")
    if verified_only:
        keep &= F.col("verified")
    return rows.where(F.coalesce(keep, F.lit(False)))


def write_digest(ranked_rows: DataFrame, path: str, title: str = "Ranked postings") -> None:
    """The digest as one text file in rank order; it is as long as its ranking is cut."""
    digest(ranked_rows, title).repartitionByRange(1, "pos").sortWithinPartitions("pos").select("line").write.mode("overwrite").text(path)


def companies_in_order(companies: DataFrame, active_only: bool = True, tiers: tuple[str, ...] = (), tag: str | None = None, n_local: str = "n_local") -> DataFrame:
    """Companies by mission and local postings, unknown numbers last, ties by name."""
    rows = companies.where("active") if active_only else companies
    if tiers:
        rows = rows.where(F.col("mission_tier").isin(*tiers))
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    return rows.orderBy(F.desc_nulls_last("mission_score"), F.desc_nulls_last(n_local), "name")


def companies_tab(counted: DataFrame, search: str = "", active_only: bool = False) -> DataFrame:
    """Companies with n_open and tags: watched ones first, then by open postings and mission (unknown as 0), ties by name."""
    rows = counted.withColumn("watched", F.coalesce(F.array_contains("tags", "watch"), F.lit(False)))
    rows = rows.where("active") if active_only else rows
    rows = rows.where(F.lower("name").contains(search.strip().lower())) if search.strip() else rows
    return rows.orderBy(F.desc("watched"), F.desc("n_open"), F.coalesce("mission_score", F.lit(0.0)).desc(), "name")


def company_tiles(companies: DataFrame) -> DataFrame:
    active = F.coalesce("active", F.lit(False))
    return companies.agg(F.count_if(active).alias("n_active"), F.count_if(F.coalesce(F.array_contains("tags", "watch"), F.lit(False))).alias("n_watched"))


def matches_in_order(rows: DataFrame, score: str, pos: str) -> DataFrame:
    """Scored rows first, best first; equal ones as they came."""
    return rows.orderBy(F.col(score).isNotNull().desc(), F.coalesce(score, F.lit(0.0)).desc(), pos)


#: The groups of decided postings, in the order in which they are shown.
GROUPS = ("applied", "interviewing", "saved", "rejected", "dismissed")


def disposition_groups(postings: DataFrame) -> DataFrame:
    """(disposition, group_pos, n) of the groups that hold postings, in their order; other dispositions show nowhere."""
    place = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("disposition"))
    return postings.where(F.col("disposition").isin(*GROUPS)).groupBy("disposition").agg(F.count("*").alias("n")).select("disposition", place.alias("group_pos"), "n").orderBy("group_pos")


def change_counts(synced: DataFrame) -> DataFrame:
    """How many postings a sync reopened and closed, and in how many companies."""
    return synced.agg(F.count_if(F.col("change") == "reopened").alias("n_reopened"), F.count_if(F.col("change") == "closed").alias("n_closed"), F.countDistinct(F.when(F.col("change").isNotNull(), F.col("company_id"))).alias("n_companies"))


def board_health(probes: DataFrame, least: int = 1) -> DataFrame:
    """Probes (ats, name, status, n_jobs) with ``health``; what is not ok comes first, then by platform and name.

    ok: answered with ``least`` postings or more; degraded: answered with fewer, or
    unreadable (n_jobs null); blocked: refused or challenged (401, 403, 429, 503, or
    no answer at all: status null); broken: every other status.
    """
    http = F.col("status")
    health = F.when(http.isNull() | http.isin(401, 403, 429, 503), "blocked").when(~http.between(200, 299), "broken").when(F.coalesce("n_jobs", F.lit(0)) >= least, "ok").otherwise("degraded")
    return probes.withColumn("health", health).orderBy(F.col("health") == "ok", "ats", "name")


def health_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("n"), *[F.count_if(F.col("health") == h).alias(f"n_{h}") for h in ("ok", "degraded", "blocked", "broken")])


# The fields of a posting that a view shows.
JOB_FIELDS = ("job_id", "title", "company_name", "url", "location", "geo_mode", "resume_fit_score", "combined_score", "mission_tier", "mission_score", "fit_reason", "fit_gates", "fit_domain", "fit_function", "fit_stack", "fit_seniority", "posted_at", "first_seen", "last_seen", "status", "disposition", "disposition_note", "disposition_at")


def job_rows(rows: DataFrame, today: Column, local: str) -> DataFrame:
    """What a view shows of each posting: JOB_FIELDS (null where the rows lack one), its rank if it has one, and what follows from them."""
    has = set(rows.columns)
    known = lambda c: F.col(c) if c in has else F.lit(None)
    text = lambda c: known(c).cast("string")
    bucket = predicates.geo_bucket(text("location"), known("remote_eligible").cast("boolean"), text("geo_mode"), local)
    return rows.select(
        *[known(c).alias(c) for c in JOB_FIELDS], known("rank").cast("long").alias("rank"), age_tag(known("first_seen").cast("date"), known("posted_at").cast("date"), today).alias("age"),
        F.coalesce(text("fit_reason").contains("deep:"), F.lit(False)).alias("verified"), bucket.alias("geo_bucket"), (bucket == "relocation").alias("relocation_required"),
        predicates.us_eligible(text("location")).alias("us_ok"), F.coalesce(F.array_contains(known("company_tags").cast("array<string>"), "watch"), F.lit(False)).alias("watched"),
    )


def detail(postings: DataFrame, job_id: str, most: int = 4000) -> DataFrame:
    """One posting with its description's beginning: what a panel has room for."""
    return postings.where(F.col("job_id") == job_id).withColumn("description", F.left("description", F.lit(most)))
