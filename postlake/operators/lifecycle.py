"""Open and closed: stored postings reconciled with board snapshots, for all companies in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import id_namespace, norm_title, norm_url


def _keyed(snapshot: DataFrame, value: Column, name: str) -> DataFrame:
    """For each company and value: that it was seen, and the posting date of its first row with one."""
    rows = snapshot.select("company_id", value.alias(name), "posted_at", "pos").where(F.coalesce(F.col(name), F.lit("")) != "")
    return rows.groupBy("company_id", name).agg(F.min_by("posted_at", F.when(F.col("posted_at").isNotNull(), F.col("pos"))).alias(f"{name}_date"), F.lit(True).alias(f"{name}_seen"))


def sync_statuses(stored: DataFrame, snapshot: DataFrame, now: Column, grace_days: int = 3, track: str | None = None) -> DataFrame:
    """The stored postings after one snapshot, with ``change``: reopened, closed or null.

    snapshot: company_id, job_id, url, title, posted_at and pos, its order.  A
    company without rows in it is left alone.  Ids of the board's own namespaces
    match by id only and close at once; others match by id, normalised URL or
    title too, and close when not seen for ``grace_days``.  With ``track``, only
    its postings close; all reopen.  Known posting dates stay, others come from the
    snapshot by id, URL, title.

    Each kind of match is an equi-join with one row for each key, so no join
    compares postings pairwise and none multiplies them.
    """
    boards = snapshot.select("company_id").distinct().withColumn("on_board", F.lit(True))
    spaces = snapshot.select("company_id", id_namespace_of_snapshot(F.col("job_id")).alias("space")).where("space is not null").distinct().withColumn("native", F.lit(True))
    rows = stored.withColumn("space", id_namespace(F.col("job_id"))).withColumn("u", norm_url("url")).withColumn("t", norm_title("title"))
    for side, on in ((boards, ["company_id"]), (spaces, ["company_id", "space"]), (_keyed(snapshot, F.col("job_id"), "job_id"), ["company_id", "job_id"]), (_keyed(snapshot, norm_url("url"), "u"), ["company_id", "u"]), (_keyed(snapshot, norm_title("title"), "t"), ["company_id", "t"])):
        rows = rows.join(side, on, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    was_open = F.coalesce(F.col("status"), F.lit("open"))
    present = yes("on_board") & (yes("job_id_seen") | (~yes("native") & (yes("u_seen") | yes("t_seen"))))
    of_track = F.lit(True) if track is None else F.coalesce(F.array_contains("track", track), F.lit(False))
    seen = F.coalesce("last_seen", "first_seen")
    gone = yes("on_board") & ~present & of_track & (was_open != "closed") & (yes("native") | seen.isNull() | (seen < now - F.expr(f"INTERVAL {grace_days} DAYS")))
    date = F.coalesce("posted_at", F.when(present, F.coalesce("job_id_date", "u_date", "t_date")))
    out = {
        "status": F.when(present, "open").when(gone, "closed").otherwise(F.col("status")),
        "closed_at": F.when(present, None).when(gone, now).otherwise(F.col("closed_at")),
        "last_seen": F.when(present, now).otherwise(F.col("last_seen")),
        "posted_at": date,
    }
    change = F.when(present & (was_open != "open"), "reopened").when(gone, "closed")
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in stored.columns], change.alias("change"))


def id_namespace_of_snapshot(job_id: Column) -> Column:
    """The namespace that a board's id opens: its first two parts, or the whole id if there are only two."""
    return F.when(job_id.contains("_"), F.concat(F.substring_index(job_id, "_", 2), F.lit("_")))


def closed_when_stale(stored: DataFrame, probes: DataFrame, now: Column, stale_days: int = 2) -> DataFrame:
    """Close open postings that were not seen lately and whose page is known to be gone (probe false; null says nothing)."""
    seen = F.coalesce("last_seen", "first_seen")
    rows = stored.join(probes.select("job_id", "is_open"), "job_id", "left")
    gone = (F.coalesce("status", F.lit("open")) == "open") & (seen.isNull() | (seen < now - F.expr(f"INTERVAL {stale_days} DAYS"))) & (F.col("is_open") == F.lit(False))
    gone = F.coalesce(gone, F.lit(False))
    swap = {"status": F.when(gone, "closed").otherwise(F.col("status")), "closed_at": F.when(gone, now).otherwise(F.col("closed_at"))}
    return rows.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in stored.columns])


def probe_open(http_status: Column, text: Column, valid_through: Column, has_posting: Column, gated: Column, today: Column) -> Column:
    """Whether a page shows an open posting: false, true or null for not known."""
    closed = r"(?i)no longer (accepting applications|available|open)|position has been (filled|closed)|job (is )?closed|posting (has )?expired"
    return (
        F.when(gated, None)
        .when(http_status.isin(404, 410) | F.coalesce(text.rlike(closed), F.lit(False)), False)
        .when(valid_through < today, False)
        .when(has_posting, True)
    )
