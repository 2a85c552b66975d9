"""Scores from a pluggable judge: what to score, how to fold its answer in, and when to ask again.

A scorer turns (job_id, title, description) into (job_id, domain, function, stack,
seniority, gates, reason); all arithmetic after it is columns.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postlake.functions import predicates, scoring
from postlake.functions.text import any_of, clipped, keyword_pattern
from postlake.operators.store import update_scores, with_longer_descriptions
from postlake.operators.views import OUT_OF_RANKING, not_closed
from postlake.profile import AXES, Profile

#: Shorter descriptions are not scored.
LEAST_BODY = 200


class Scorer(Protocol):
    def __call__(self, postings: DataFrame) -> DataFrame: ...


def keyword_scorer(profile: Profile) -> Scorer:
    """An offline judge: each axis is the share of its vocabulary that a posting holds, up to three terms."""
    words = profile.vocabulary
    tiers = {"domain": words.core + words.domain, "function": words.skill, "stack": words.skill + words.extra, "seniority": ("senior", "lead", "staff")}

    def score(postings: DataFrame) -> DataFrame:
        text = F.lower(F.concat_ws(" ", "title", "description"))
        share = lambda terms: F.least(F.lit(1.0), sum((F.when(text.rlike(keyword_pattern(t)), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / 3)
        management = F.when(F.lower("title").rlike(any_of(["manager", "director", "head of"])), F.lit("management"))
        axes = [F.round(share(terms), 2).alias(a) for a, terms in tiers.items()]
        return postings.select("job_id", *axes, F.array_compact(F.array(management)).alias("gates"), F.lit("keywords").alias("reason"))

    return score


def has_body(description="description") -> Column:
    """Whether a description is long enough to score, white space at its ends not counted."""
    return F.length(F.regexp_replace(F.coalesce(F.col(description), F.lit("")), r"^\s+|\s+$", "")) >= LEAST_BODY


def judged(postings: DataFrame, scorer: Scorer, profile: Profile, most: int = 12_000) -> DataFrame:
    """Score columns (job_id, resume_fit_score, fit_reason, fit_gates, fit_<axis>) of the postings with a body.

    A clearance that the full text demands fails its gate even where the clipped
    text or the judge misses it.
    """
    rows = postings.where(has_body()).select("job_id", "title", "description")
    answers = scorer(rows.withColumn("description", clipped("description", most)))
    flagged = rows.select("job_id", predicates.needs_clearance("description").alias("_clear"))
    out = answers.join(flagged, "job_id")
    gates = F.when(F.col("_clear"), F.array_union("gates", F.array(F.lit("clearance")))).otherwise(F.col("gates"))
    out = out.withColumn("gates", gates)
    axes = {a: scoring.clamped(a) for a in AXES}
    fit = scoring.combined_fit(axes, F.col("gates"), profile.weights, profile.penalties)
    return out.select("job_id", fit.alias("resume_fit_score"), scoring.reason_text(axes, F.col("gates"), "reason").alias("fit_reason"), "gates", *[c.alias(f"fit_{a}") for a, c in axes.items()]).withColumnRenamed("gates", "fit_gates")


def within_budget(postings: DataFrame, guard: int, confirmed: bool = False, tokens_each: int = 820, price: float = 4.0) -> tuple[bool, float]:
    """Whether so many postings may be scored, and the estimated cost; a guard of 0 never stops."""
    n = postings.count()
    return bool(confirmed or not guard or n <= guard), n * tokens_each * price / 1e6


def unscored(stored: DataFrame) -> DataFrame:
    """Open, ranked postings with a body and no score."""
    return stored.where(not_closed() & F.col("resume_fit_score").isNull() & (F.col("disposition").isNull() | ~F.col("disposition").isin(*OUT_OF_RANKING)) & has_body())


def healed(stored: DataFrame, scorer: Scorer, profile: Profile) -> DataFrame:
    """The store with its unscored postings scored."""
    return update_scores(stored, judged(unscored(stored), scorer, profile))


def rescored(stored: DataFrame, scorer: Scorer, profile: Profile) -> DataFrame:
    """All open postings judged anew; scores of those whose body is too short are cleared, with the reason."""
    fresh = judged(stored.where(not_closed()), scorer, profile)
    short = stored.where(not_closed() & ~has_body()).select("job_id", F.lit("description too short to score").alias("fit_reason"))
    return update_scores(stored, fresh.unionByName(short, allowMissingColumns=True).select(*fresh.columns))


def verified(postings: DataFrame, scorer: Scorer, profile: Profile) -> DataFrame:
    """Score columns of a second, deep look; the reason starts with ``deep:``.

    What the scorer extracts in columns years, seat and gaps, if it has them, goes into
    the reason, and a management seat fails its gate.
    """
    def deep(rows: DataFrame) -> DataFrame:
        answers = scorer(rows)
        part = lambda c, kind: F.col(c) if c in answers.columns else F.lit(None).cast(kind)
        reason = scoring.deep_reason("reason", part("years", "int"), part("seat", "string"), part("gaps", "array<string>"))
        return answers.withColumn("gates", scoring.seat_gates(F.col("gates"), part("seat", "string"))).withColumn("reason", reason)

    return judged(postings, deep, profile)


def verified_rounds(stored: DataFrame, scorer: Scorer, profile: Profile, top: int = 15, rounds: int = 2, drop: float = 0.25, share: float = 0.8, least: int = 5, order: list[Column] | None = None, live: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """The store with its best postings verified, and what each round did.

    A round ranks the postings anew, takes those of the best ``top`` without a deep
    reason, judges them by their longest known text (``live``: job_id, description) and
    writes the answers back, so that what a demotion lifts is verified next.  It is
    over when all of the best are verified, after ``rounds``, or when a round looks
    broken: ``least`` or more were scored and ``share`` of them fell by more than
    ``drop``.  That round's answers stay, but none follows.  Postings that the judge
    cannot score keep what they have.  A round's answers are at most ``top`` rows;
    they are kept as such, so that the judge is asked once.
    """
    ranking = order or [F.desc_nulls_last("resume_fit_score"), F.col("job_id")]
    log: list[dict] = []
    for number in range(1, rounds + 1):
        best = stored.where(not_closed()).orderBy(*ranking).limit(top)
        todo = best.where(~F.coalesce(F.col("fit_reason"), F.lit("")).contains("deep:"))
        if live is not None:
            todo = with_longer_descriptions(todo, live)
        answers = verified(todo, scorer, profile).where("resume_fit_score IS NOT NULL")
        rows = answers.join(todo.select("job_id", F.col("resume_fit_score").alias("_old"), F.col("description").alias("_text")), "job_id")
        known = rows.collect()  # at most ``top``
        if not known:
            break
        fell = sum(r["_old"] is not None and r["_old"] - r["resume_fit_score"] > drop for r in known)
        log.append({"round": number, "scored": len(known), "fell": fell, "broken": len(known) >= least and fell >= share * len(known)})
        kept = stored.sparkSession.createDataFrame(known, rows.schema)
        stored = update_scores(stored, kept.drop("_old", "_text"))
        if live is not None:
            stored = with_longer_descriptions(stored, kept.select("job_id", F.col("_text").alias("description")))
        if log[-1]["broken"]:
            break
    return stored, log


def verified_top(stored: DataFrame, scorer: Scorer, profile: Profile, top: int = 10, drop: float = 0.25, share: float = 0.8, least: int = 5) -> tuple[DataFrame, bool]:
    """One round over the best postings that have no deep reason yet; a round that looks broken leaves the store as it is."""
    best = stored.where(not_closed() & ~F.coalesce(F.col("fit_reason"), F.lit("")).contains("deep:")).orderBy(F.desc_nulls_last("resume_fit_score"), "job_id").limit(top)
    deep = verified(best, scorer, profile)
    fell = deep.join(best.select("job_id", F.col("resume_fit_score").alias("_old")), "job_id").agg(F.count("*").alias("n"), F.count_if(F.col("_old") - F.col("resume_fit_score") > drop).alias("fell")).first()
    broken = fell["n"] >= least and fell["fell"] >= share * fell["n"]
    return (stored if broken else update_scores(stored, deep)), broken


# Counters of a judge's calls.
USAGE = ("calls", "uncached_input", "cache_write", "cache_read", "output")


def counted(answers: DataFrame, name: str = "usage") -> tuple[DataFrame, Observation]:
    """Answers (with the counters of their call, null for none) and what sums them up as the job runs, without another pass.

    The sums are there when an action on the frame is over; a task that is run again
    counts once.
    """
    seen = Observation(name)
    sums = [F.count_if(F.coalesce(*[F.col(c) for c in USAGE[1:]]).isNotNull()).alias("calls")]
    sums += [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in USAGE[1:]]
    return answers.observe(seen, *sums), seen


def usage_line(sums: dict) -> str:
    """One line on a run's counters; hit is the share of the cacheable part that was read from the cache."""
    cached = sums["cache_read"] + sums["cache_write"]
    hit = 100.0 * sums["cache_read"] / cached if cached else 0.0
    return f"{sums['calls']} call(s) | input {cached + sums['uncached_input']:,} tok (cache read {sums['cache_read']:,}, wrote {sums['cache_write']:,}, uncached {sums['uncached_input']:,}; {hit:.0f}% of cacheable prefix hit) | output {sums['output']:,} tok"
