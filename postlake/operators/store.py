"""Keyed merges of companies and postings, as joins that make the next snapshot.

A batch may observe a key several times; ``fold`` first reduces it to one row for
each key by the columns' own rules, with partial aggregation, so that the merge
itself is one full outer join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.text import norm_url
from postlake.profile import DISPOSITIONS

#: How a posting's columns merge: the new value always (even null); the new one if
#: it is known; the first known one; never after the insert; the union of sets.
OVERWRITE = ("title", "url", "location", "description", "last_seen", "status")
KNOWN_NEW = ("geo_mode", "remote_eligible", "remote_signal", "neural_signal", "resume_fit_score", "fit_reason", "fit_domain", "fit_function", "fit_stack", "fit_seniority", "fit_gates")
FIRST_KNOWN = ("posted_at",)
INSERT_ONLY = ("company_id", "company_name", "first_seen")
UNION = ("track",)


def fold(batch: DataFrame, key: str = "job_id", ordinal: str = "ordinal") -> DataFrame:
    """One row for each key, as if its rows were merged in the order of ``ordinal``."""

    def folded(c: str) -> Column:
        known = F.when(F.nullif(F.col(c), F.lit("")).isNotNull() if c == "fit_reason" else F.col(c).isNotNull(), F.col(ordinal))
        if c in UNION:
            return F.when(F.max(F.col(c).isNotNull()), F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))))
        if c in KNOWN_NEW:
            return F.max_by(c, known)
        if c in FIRST_KNOWN:
            return F.min_by(c, known)
        return (F.min_by if c in INSERT_ONLY else F.max_by)(F.struct(c), ordinal)[c]

    return batch.groupBy(key).agg(*[folded(c).alias(c) for c in batch.columns if c not in (key, ordinal)])


def merge_postings(stored: DataFrame, batch: DataFrame, key: str = "job_id", relink: bool = False) -> DataFrame:
    """The next snapshot: stored rows merged with a folded batch, and is_new for rows of the batch alone.

    Both sides have the same columns.  A status other than closed clears closed_at;
    dispositions are not for batches to change.  ``relink`` lets a batch name the
    company of a row that has none.
    """
    both = stored.withColumn("_here", F.lit(True)).alias("o").join(batch.withColumn("_here", F.lit(True)).alias("n"), key, "full_outer")
    seen, known = F.col("n._here").isNotNull(), F.col("o._here").isNotNull()

    def merged(c: str) -> Column:
        if c not in batch.columns:
            return F.col(f"o.{c}")
        new, old = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in UNION:
            return F.when(new.isNull(), old).otherwise(F.array_sort(F.array_union(new, F.coalesce(old, F.array().cast("array<string>")))))
        if c == "fit_reason":
            return F.coalesce(F.nullif(new, F.lit("")), old)
        if c in KNOWN_NEW:
            return F.coalesce(new, old)
        if c in FIRST_KNOWN:
            return F.coalesce(old, new)
        if c in INSERT_ONLY:
            return F.when(known & (~F.lit(relink) | old.isNotNull()), old).otherwise(new)
        if c == "closed_at":
            return F.when(seen, F.when(F.col("n.status") == "closed", old)).otherwise(old)
        return F.when(seen, new).otherwise(old)

    columns = [c for c in stored.columns if c != key]
    return both.select(key, *[merged(c).alias(c) for c in columns], (~known).alias("is_new"))


def merge_companies(stored: DataFrame, batch: DataFrame, key: str = "name") -> DataFrame:
    """Known new values win, null ones change nothing, tags unite."""
    both = stored.alias("o").join(batch.alias("n"), key, "full_outer")
    empty = F.array().cast("array<string>")
    out = []
    for c in stored.columns:
        if c == key:
            continue
        if c not in batch.columns:
            out.append(F.col(f"o.{c}"))
        elif c == "tags":
            out.append(F.array_sort(F.array_union(F.coalesce("o.tags", empty), F.coalesce("n.tags", empty))).alias("tags"))
        else:
            out.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return both.select(key, *out)


def update_scores(stored: DataFrame, scores: DataFrame, key: str = "job_id") -> DataFrame:
    """Scored rows take all columns of the scores, nulls included, which a merge never does."""
    new = [c for c in scores.columns if c != key]
    both = stored.alias("o").join(scores.withColumn("_scored", F.lit(True)).alias("n"), key, "left")
    return both.select(*[F.when(F.col("_scored"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in new else F.col(key if c == key else f"o.{c}") for c in stored.columns])


def with_tag(companies: DataFrame, name: str, tag: str, add: bool = True) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    changed = F.array_sort(F.array_union(tags, F.array(F.lit(tag)))) if add else F.array_remove(tags, tag)
    return companies.withColumn("tags", F.when(F.lower("name") == name.lower(), changed).otherwise(F.col("tags")))


def resolve(postings: DataFrame, refs: DataFrame, key: str = "job_id", url: str = "url") -> DataFrame:
    """(ref, job_id, stage) of the first stage that finds anything: 1 the id itself, 2 part of an id, 3 the normalised URL.

    Several rows for one ref mean that it is ambiguous.  Parts are found by
    equi-joins too: a ref meets the ids that hold its rarest run of three
    characters (of one, if it is shorter) and is compared with these.  Letters of
    either case are equal in parts.  The joins sort: runs of all ids are many times
    what Spark takes from a file's size, so it would broadcast them.
    """
    refs = refs.select("ref").distinct()
    exact = refs.join(postings.select(F.col(key).alias("ref"), F.col(key)).hint("merge"), "ref").select("ref", key, F.lit(1).alias("stage"))
    open_ = refs.join(exact.select("ref").hint("merge"), "ref", "left_anti")
    part = _holding(open_.where("ref <> ''"), postings.select(key).where(F.col(key).isNotNull()), key)
    left = open_.join(part.select("ref").hint("merge"), "ref", "left_anti")
    by_url = left.withColumn("u", norm_url("ref")).where("u <> ''").join(postings.select(norm_url(url).alias("u"), key).hint("merge"), "u").select("ref", key, F.lit(3).alias("stage"))
    every = exact.unionByName(part).unionByName(by_url)
    return every.withColumn("first", F.min("stage").over(Window.partitionBy("ref"))).where("stage = first").drop("first")


def _runs(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.array_distinct(F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def _holding(refs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(ref, key, stage 2) of the ids that hold a ref."""
    found = None
    for size, mine in ((3, refs.where("length(ref) >= 3")), (1, refs.where("length(ref) < 3"))):
        runs = ids.select(key, F.explode(_runs(F.lower(key), size)).alias("run"))
        number = runs.groupBy("run").agg(F.count("*").alias("n"))
        asked = mine.select("ref", F.explode(_runs(F.lower("ref"), size)).alias("run")).join(number.hint("merge"), "run", "left")
        rarest = asked.groupBy("ref").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("s")).where("s.n > 0").select("ref", "s.run")
        part = rarest.join(runs.hint("merge"), "run").where(F.lower(key).contains(F.lower("ref"))).select("ref", key, F.lit(2).alias("stage"))
        found = part if found is None else found.unionByName(part)
    return found


def with_disposition(postings: DataFrame, decided: DataFrame, key: str = "job_id") -> DataFrame:
    """Apply decisions (job_id, disposition, note, at); unknown dispositions are refused when the plan runs."""
    known = F.col("n.disposition").isin(*DISPOSITIONS)
    checked = F.when(F.col("n.disposition").isNull() | known, F.col("n.disposition")).otherwise(F.raise_error(F.concat(F.lit("unknown disposition "), F.col("n.disposition"))))
    both = postings.alias("o").join(decided.withColumn("_set", F.lit(True)).alias("n").hint("merge"), key, "left")
    swap = {"disposition": checked, "disposition_note": F.col("n.note"), "disposition_at": F.col("n.at")}
    return both.select(*[F.when(F.col("_set"), swap[c]).otherwise(F.col(f"o.{c}")).alias(c) if c in swap else F.col(key if c == key else f"o.{c}") for c in postings.columns])


def disposed(postings: DataFrame, asked: DataFrame, key: str = "job_id", shown: int = 8) -> tuple[DataFrame, DataFrame]:
    """Decide on postings by reference: (postings after it, outcomes).

    asked: (ref, disposition, note, at), one row for each ref; none or clear takes a
    decision back.  outcomes: (ref, job_id, error); nothing changes where an error
    says that the disposition is unknown, that nothing matches, or that several do,
    of which it names the first ``shown``.
    """
    said = F.lower(F.trim(F.coalesce("disposition", F.lit(""))))
    rows = asked.select("ref", said.alias("_said"), "disposition", "note", "at")
    matches = resolve(postings, rows).join(postings.select(key, "title").hint("merge"), key)
    first = matches.withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy(key))).where(F.col("_n") <= shown)
    line = F.concat(F.col(key), F.lit("  "), F.left(F.coalesce("title", F.lit("")), F.lit(50)))
    named = first.groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("_named"), F.min(key).alias(key))
    found = rows.join(matches.groupBy("ref").agg(F.count("*").alias("_matches")).hint("merge"), "ref", "left").join(named.hint("merge"), "ref", "left")
    clearing = F.col("_said").isin("none", "clear")
    error = (
        F.when(~clearing & ~F.col("_said").isin(*DISPOSITIONS), F.concat(F.lit("unknown disposition "), F.coalesce("disposition", F.lit("null")), F.lit(": use one of " + ", ".join(DISPOSITIONS) + " or clear")))
        .when(F.col("_matches").isNull(), F.concat(F.lit("no posting matches "), "ref"))
        .when(F.col("_matches") > 1, F.concat("ref", F.lit(" is ambiguous ("), F.col("_matches").cast("string"), F.lit(" matches):\n"), "_named"))
    )
    outcomes = found.select("ref", F.when(error.isNull(), F.col(key)).alias(key), error.alias("error"), F.when(~clearing, F.col("_said")).alias("disposition"), F.when(~clearing, F.col("note")).alias("note"), F.when(~clearing, F.col("at")).alias("at"))
    last = outcomes.where("error IS NULL").groupBy(key).agg(F.max_by(F.struct("disposition", "note", "at"), F.struct(F.coalesce(F.col("at").cast("string"), F.lit("")), "ref")).alias("s")).select(key, "s.*")
    return with_disposition(postings, last, key), outcomes.select("ref", key, "error")


def marked_seen(stored: DataFrame, found: DataFrame, track: str | None = None, most: int = 12_000) -> DataFrame:
    """The store with fetched postings (id, company, title, url, ..) merged in for callers that know no company's key.

    Company and geographic mode stay as stored; of rows with one id the last by
    ``ordinal``, if they have it, counts; score columns are taken where the
    rows have them, and never replace a score by null.
    """
    names = {"job_id": "id", "company_name": "company"}
    own = [c for c in stored.columns if names.get(c, c) in found.columns and c not in ("company_id", "geo_mode")]
    take = lambda c: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(most)) if c == "description" else F.col(names.get(c, c))
    tracks = [F.array(F.lit(track)).alias("track")] if track else [F.col("track")] if "track" in own else []
    at = F.col("ordinal") if "ordinal" in found.columns else F.lit(0).alias("ordinal")
    rows = found.select(*[take(c).alias(c) for c in own if c != "track"], *tracks, at)
    return merge_postings(stored, fold(rows))


def best_of_boards(companies: DataFrame, board: list[str], rank: list[Column], key: str = "name", active: str = "active", tags: str = "tags") -> DataFrame:
    """Companies that share a board merge into the best one by ``rank``: it gets all tags, and is active if any is.

    Returns board, the kept key, n merged, tags and active; aggregated without
    gathering a group's rows, so a board with very many entries is no problem.
    """
    chosen = companies.withColumn("_best", F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(key).alias("key")))
    exploded = chosen.select(*board, "_best", F.col(active), F.explode_outer(tags).alias("_tag"))
    out = exploded.groupBy(*board).agg(F.min("_best")["key"].alias(key), F.countDistinct("_best.key").alias("n_merged"), F.array_sort(F.collect_set("_tag")).alias(tags), F.bool_or(active).alias(active))
    return out


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; the row is carried through a partial aggregate, so a hot key is no sort."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rows.columns).alias("row")).alias("s"))
    return keyed.groupBy(*names).agg(F.min("s").alias("s")).select("s.row.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def touched(stored: DataFrame, seen: DataFrame, now: Column, key: str = "job_id") -> DataFrame:
    """Stored postings that were seen (job_id) are open and seen now; nothing else changes."""
    rows = stored.join(seen.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True)), key, "left")
    swap = {"status": F.lit("open"), "closed_at": F.lit(None), "last_seen": now}
    return rows.select(*[F.when(F.col("_seen"), swap[c]).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in stored.columns])


def with_status(stored: DataFrame, decided: DataFrame, now: Column, key: str = "job_id") -> DataFrame:
    """Apply (job_id, status), one row for each id; closed_at is now for closed, else null."""
    both = stored.alias("o").join(decided.select(key, F.col("status").alias("_status"), F.lit(True).alias("_set")), key, "left")
    swap = {"status": F.col("_status"), "closed_at": F.when(F.col("_status") == "closed", now)}
    return both.select(*[F.when(F.col("_set"), swap[c]).otherwise(F.col(f"o.{c}")).alias(c) if c in swap else F.col(key if c == key else f"o.{c}") for c in stored.columns])


def with_longer_descriptions(stored: DataFrame, live: DataFrame, most: int = 12_000, key: str = "job_id") -> DataFrame:
    """Take live descriptions (job_id, description) that are longer than the stored ones, up to ``most`` characters of each.

    Of several live ones the longest counts, of equally long ones the last in order.
    """
    best = live.groupBy(key).agg(F.max(F.struct(F.length("description").alias("n"), F.left("description", F.lit(most)).alias("d"))).alias("_live"))
    rows = stored.join(best, key, "left")
    longer = F.coalesce(F.col("_live.n"), F.lit(0)) > F.length(F.coalesce("description", F.lit("")))
    return rows.withColumn("description", F.when(longer, F.col("_live.d")).otherwise(F.col("description"))).select(*stored.columns)


def short_descriptions(stored: DataFrame, least: int = 200) -> DataFrame:
    """Open, linked postings whose description is still to be filled."""
    still_open = F.col("status").isNull() | (F.col("status") != "closed")
    return stored.where(still_open & F.col("company_id").isNotNull() & (F.length(F.coalesce("description", F.lit(""))) < least))


def with_leads(companies: DataFrame, seen: DataFrame, site: str) -> DataFrame:
    """Companies plus the new names (name, careers_url) that a page showed, inactive until their board is found.

    A name is known whatever its case; of several spellings the first in order stays.
    """
    named = seen.select(F.trim("name").alias("name"), "careers_url").where("name <> ''").withColumn("_n", F.lower("name"))
    new = named.join(companies.select(F.lower("name").alias("_n")), "_n", "left_anti").groupBy("_n").agg(F.min("name").alias("name"), F.max("careers_url").alias("careers_url"))
    rows = new.select("name", "careers_url", F.lit(False).alias("active"), F.lit("page_capture").alias("source"), F.lit(f"seen on {site}").alias("notes"))
    return companies.unionByName(rows.select(*[c for c in rows.columns if c in companies.columns]), allowMissingColumns=True)


def repointed(postings: DataFrame, companies: DataFrame, board: list[str], rank: list[Column], key: str = "company_id") -> DataFrame:
    """Postings of companies that share a board belong to the one that best_of_boards keeps; companies without a board stay."""
    has_board = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in board])
    kept = best_of_boards(companies.withColumns({"_a": F.lit(True), "_t": F.array(F.lit(""))}).where(has_board), board, rank, key, "_a", "_t")
    moves = companies.join(kept.select(*board, F.col(key).alias("_kept")), board).select(key, "_kept")
    return postings.join(moves, key, "left").withColumn(key, F.coalesce("_kept", key)).select(*postings.columns)
