"""From names to boards: what probes say, candidates' validation, and the stages of resolving a lead.

Every stage sees only the rows that the stages before it left, and its hits are
checked before they settle a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.predicates import host_matches, slug_matches
from postlake.operators.entities import detected, slug_candidates, verify_flags
from postlake.operators.store import union_all
from postlake.sources.pages import OFFSITE, is_board


def _size(path: str) -> Callable[[Column], Column]:
    """Items of an array in the body; a JSON body without it has none."""
    return lambda body: F.when(F.try_parse_json(body).isNotNull(), F.coalesce(F.size(F.try_variant_get(F.try_parse_json(body), path, "array<variant>")), F.lit(0)))


def _array(body: Column) -> Column:
    return F.when(F.try_parse_json(body).isNotNull(), F.greatest(F.coalesce(F.size(F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")), F.lit(0)), F.lit(0)))


_PAGE_DATA = r"(?s)pageData\s*=\s*(\{.*?\});"

#: Platforms in the order of probing: how many postings a body with status 200 shows, null for no board; and whether only postings prove one.
PROBES: dict[str, tuple[Callable[[Column], Column], bool]] = {
    "greenhouse": (_size("$.jobs"), False),
    "lever": (_array, False),
    "ashby": (_size("$.jobPostings"), False),
    "kula": (lambda body: F.when(F.length(body) > 1000, 0), False),
    "jazzhr": (lambda body: F.regexp_count(body, F.lit("/apply/[A-Za-z0-9]+/")), True),
    "bamboohr": (_size("$.result"), False),
    "smartrecruiters": (lambda body: F.try_variant_get(F.try_parse_json(body), "$.totalFound", "int"), True),
    "paylocity": (lambda body: _size("$.Jobs")(F.nullif(F.regexp_extract(body, _PAGE_DATA, 1), F.lit(""))), True),
    "rippling": (lambda body: F.greatest(_array(body), _size("$.jobs")(body)), True),
    "ultipro": (_size("$.opportunities"), True),
}


def probe_class(ats: Column, status: Column, body: Column) -> Column:
    """struct(ok, n_jobs) of a probe's answer by its platform; anything but a readable answer with status 200 is no board."""
    none = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("n_jobs"))
    out = none
    for name, (count, proven) in PROBES.items():
        n = F.coalesce(count(body), F.lit(-1))
        good = n > 0 if proven else n >= 0
        out = F.when(ats == name, F.when((status == 200) & good, F.struct(F.lit(True).alias("ok"), n.cast("int").alias("n_jobs"))).otherwise(none)).otherwise(out)
    return out


def classified(answers: DataFrame) -> DataFrame:
    """(ats, slug, n_jobs) of the boards that answers (ats, slug, status, body) confirm; of several answers the best."""
    rows = answers.select("ats", "slug", probe_class(F.col("ats"), F.col("status"), F.col("body")).alias("p")).where("p.ok")
    return rows.groupBy("ats", "slug").agg(F.max("p.n_jobs").alias("n_jobs"))


def by_stages(rows: DataFrame, key: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Hits of all stages with ``via``, the stage's name; a stage is given the rows without a hit of those before it.

    A stage's hits are written to the checkpoint folder before the next stage looks at
    the rest, so none is evaluated again; without such a folder they stay in the plan.
    """
    keep = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
    found: list[DataFrame] = []
    for name, stage in stages:
        hits = stage(rows).withColumn("via", F.lit(name))
        hits = hits.checkpoint() if keep else hits
        found.append(hits)
        rows = rows.join(hits.select(key), key, "left_anti")
    return union_all(found)


def validated(candidates: DataFrame, answers: DataFrame, pages: DataFrame, workday: DataFrame) -> DataFrame:
    """Candidates (company, ats, slug_guess) that a board confirms, or a lead: (company, ats, slug, n_jobs, confirmed, lead, flags, via).

    Slugs come before platforms, the claimed platform before the others.  Then the
    careers page's (company, url, html) board counts, if its own answer confirms it;
    a Workday board if ``workday`` (slug tenant|pod|site, n_jobs) knows it.  A board
    that cannot be read is a lead.  At last, unless another platform is claimed, a
    page's Workday board counts without an answer as well.
    """
    boards = classified(answers)
    order = F.array(*map(F.lit, PROBES))
    claimed = F.lower(F.coalesce("ats", F.lit("unknown")))
    named = candidates.select("company", claimed.alias("claimed"), F.array_distinct(F.array_compact(F.concat(F.array(F.nullif("slug_guess", F.lit(""))), slug_candidates("company")))).alias("slugs"))
    sniffed = pages.select("company", "url", detected("html", "url").alias("b")).where("b IS NOT NULL").groupBy("company").agg(F.min_by("b", "url").alias("b"), F.min("url").alias("from_url"))
    shape = lambda df, flags: df.select("company", "ats", "slug", F.col("n_jobs").cast("int").alias("n_jobs"), F.lit(True).alias("confirmed"), F.lit(None).cast("string").alias("lead"), flags.alias("flags"))

    def probed(rest: DataFrame) -> DataFrame:
        tried = rest.select("company", "claimed", F.posexplode("slugs").alias("slug_pos", "slug")).join(boards, "slug")
        at = F.when(F.col("ats") == F.col("claimed"), 0).otherwise(F.array_position(order, F.col("ats")))
        best = tried.groupBy("company").agg(F.min(F.struct("slug_pos", at.alias("at"), "ats", "slug", "n_jobs", "claimed")).alias("s")).select("company", "s.*")
        said = F.when(F.col("claimed").isin(*PROBES), F.col("claimed")).otherwise(F.col("ats"))
        return shape(best, verify_flags("company", "slug", "ats", said))

    def read(rest: DataFrame) -> DataFrame:
        seen = rest.join(sniffed, "company").select("company", "b.*")
        known = boards.unionByName(workday.select(F.lit("workday").alias("ats"), "slug", "n_jobs"))
        return shape(seen.join(known, ["ats", "slug"]), F.array(F.concat(F.lit("read from the careers page: "), "ats")))

    def led(rest: DataFrame) -> DataFrame:
        seen = rest.join(sniffed, "company").where("b.ats <> 'workday'")
        return seen.select("company", F.col("claimed").alias("ats"), F.lit(None).cast("string").alias("slug"), F.lit(0).alias("n_jobs"), F.lit(False).alias("confirmed"), F.concat("b.ats", F.lit(" @ "), "b.slug").alias("lead"), F.array().cast("array<string>").alias("flags"))

    def unanswered(rest: DataFrame) -> DataFrame:
        open_claim = rest.where("claimed IN ('unknown', 'workday')")
        seen = open_claim.join(sniffed, "company").where("b.ats = 'workday'").select("company", "b.ats", "b.slug", F.lit(0).alias("n_jobs"))
        return shape(seen, F.array(F.lit("not validated")))

    return by_stages(named, "company", [("probe", probed), ("sniff", read), ("lead", led), ("workday", unanswered)])


def resolved(leads: DataFrame, boards: DataFrame, own_pages: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """Boards of leads (company): (company, ats, slug, careers_url, n_jobs, n_local, via); only boards with postings count.

    boards (ats, slug, n_jobs, n_local) are those that were read; a self-hosted one has
    the platform custom and its page's address for slug.  The board on the employer's own
    page (company, url, html) is trusted; a slug guessed by name comes second and is
    for a look, as ``via`` says; third come search results (company, pos, url, html):
    boards in an address if the slug fits the name, then boards in the first pages
    if the page or the slug fits it, and pages of the employer's own host that are boards.
    """
    live = boards.where("n_jobs > 0")
    out = ("company", "ats", "slug", "careers_url", "n_jobs", "n_local")

    def confirmed(hits: DataFrame) -> DataFrame:
        """The first hit (company, at, ats, slug, careers_url) of each company whose board has postings."""
        good = hits.join(live, ["ats", "slug"])
        return good.groupBy("company").agg(F.min_by(F.struct(*out[1:]), "at").alias("s")).select("company", "s.*")

    def hits_of(pages: DataFrame, at: Column, trusted: Column) -> DataFrame:
        found = pages.withColumn("b", detected("html", "url")).where((F.col("b.kind").isin("fetchable", "semi")) & trusted)
        return found.select("company", at.alias("at"), "b.ats", "b.slug", F.col("url").alias("careers_url"))

    def listings(pages: DataFrame, at: Column) -> DataFrame:
        own = pages.join(is_board(pages.select("url", "html").distinct()).select("url"), "url", "left_semi")
        return own.select("company", at.alias("at"), F.lit("custom").alias("ats"), F.col("url").alias("slug"), F.col("url").alias("careers_url"))

    def sniffed(rest: DataFrame) -> DataFrame:
        pages = own_pages.join(rest, "company", "left_semi")
        return confirmed(hits_of(pages, F.struct(F.lit(0).alias("step"), "url"), F.lit(True)).unionByName(listings(pages, F.struct(F.lit(1).alias("step"), "url"))))

    def probed(rest: DataFrame) -> DataFrame:
        slugs = rest.select("company", F.posexplode(slug_candidates("company")).alias("p", "slug"))
        order = F.array_position(F.array(*map(F.lit, PROBES)), F.col("ats"))
        guessed = slugs.join(live.where(F.col("ats").isin(*PROBES)).select("ats", "slug"), "slug")
        return confirmed(guessed.select("company", F.struct("p", order.alias("o")).alias("at"), "ats", "slug", F.lit(None).cast("string").alias("careers_url")))

    def searched(rest: DataFrame) -> DataFrame:
        rows = results.join(rest, "company", "left_semi")
        named = rows.withColumn("html", F.lit(None).cast("string")).where(F.col("url").rlike(r"(?i)myworkdayjobs|greenhouse|lever\.co|ashbyhq|kula\.ai|icims|smartrecruiters|bamboohr|applytojob|paylocity|rippling|ultipro|successfactors|sapsf|workforcenow"))
        first = hits_of(named, F.struct(F.lit(0).alias("step"), "pos"), slug_matches(F.col("b.slug"), "company"))
        pages = rows.where((F.col("pos") < most) & ~F.col("url").rlike(OFFSITE) & (F.length(F.coalesce("html", F.lit(""))) > 0))
        own = host_matches("url", "company")
        at = lambda step: F.struct(F.lit(step).alias("step"), "pos")
        return confirmed(first.unionByName(hits_of(pages, at(1), own | slug_matches(F.col("b.slug"), "company"))).unionByName(listings(pages.where(own), at(2))))

    return by_stages(leads.select("company").distinct(), "company", [("sniff", sniffed), ("probe", probed), ("search", searched)]).select(*out, "via")
