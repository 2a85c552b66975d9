"""Reports as lines of Markdown (pos, line) and one-row JSON, made by the job that ranks or counts; as long as what they list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.operators.store import union_all


def _cell(c: Column) -> Column:
    """A value as a cell of a table: bars and line ends are no part of it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " "), r"\|", r"\\|")


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, cells)), F.lit(" |"))


def _headed(counted: DataFrame, heads: list[Column], body: DataFrame) -> DataFrame:
    """Lines over a one-row frame, then numbered lines (n, line)."""
    head = counted.select(F.posexplode(F.array_compact(F.array(*heads))).alias("pos", "line"))
    return head.select((F.col("pos") - 1_000).cast("long").alias("pos"), "line").unionByName(body.select(F.col("n").cast("long").alias("pos"), "line"))


def matches_digest(matches: DataFrame, tag: str, day: str, order: list[Column]) -> DataFrame:
    """The postings of a sweep as a table, with the number that may be done remotely; the fit's column only if one has a fit."""
    counted = matches.agg(F.count("*").alias("n"), F.count_if("remote_eligible").alias("remote"), F.count("resume_fit_score").alias("fits"))
    rows = matches.withColumn("n", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(counted.select("fits")))  # one row
    cells = [F.lit(f"[{tag}]"), F.coalesce("company", F.lit("")), F.concat(F.lit("["), _cell(F.col("title")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")")), F.col("location"), F.col("neural_signal"), F.col("remote_signal")]
    fit = F.when(F.col("resume_fit_score").isNotNull(), F.format_string("%.2f", "resume_fit_score")).otherwise("n/a")
    line = F.when(F.col("fits") > 0, _row(fit, *cells[:2])).otherwise(_row(*cells[:2]))
    line = F.concat(F.regexp_replace(line, r" \|$", ""), F.lit(" | "), cells[2], F.lit(" "), _row(*cells[3:]))
    some = F.col("n") > 0
    names = "| Tag | Company | Title | Location | Anchor | Remote signal |"
    heads = [
        F.lit(f"# [{tag}] postings of {day}"),
        F.when(some, F.format_string("%d posting(s), %d of them remote-eligible", "n", "remote")).otherwise("No posting this time"),
        F.when(some, F.when(F.col("fits") > 0, F.lit("| Fit " + names)).otherwise(names)),
        F.when(some, F.when(F.col("fits") > 0, F.lit("|---:|---|---|---|---|---|---|")).otherwise("|---|---|---|---|---|---|")),
    ]
    return _headed(counted, heads, rows.select("n", line.alias("line")))


def suggestions(expanded: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(kind, term, surfaced, listed, rank) of a judge's suggestions (kind, term, seed): the terms that most seeds brought up come first, ties by name."""
    rows = expanded.select("kind", F.trim("term").alias("term"), "seed").where("term <> ''")
    counted = rows.groupBy("kind", "term").agg(F.count("*").alias("surfaced"))
    listed = F.lower("term").isin(*[k.lower() for k in known]) if known else F.lit(False)
    order = Window.partitionBy("kind").orderBy(F.desc("surfaced"), F.lower("term"), "term")
    return counted.select("kind", "term", "surfaced", listed.alias("listed"), F.row_number().over(order).alias("rank"))


def suggestion_report(found: DataFrame, kinds: tuple[tuple[str, str], ...], day: str) -> DataFrame:
    """Suggestions as one table for each kind (kind, heading), in the order given."""
    parts = []
    for i, (kind, heading) in enumerate(kinds):
        own = found.where(F.col("kind") == kind)
        line = _row(F.concat(F.lit("`"), _cell(F.col("term")), F.lit("`")), F.col("surfaced"), F.when(F.col("listed"), "listed").otherwise("new"))
        parts.append(_headed(own.agg(F.count("*").alias("n")), [F.lit(f"## {heading}"), F.lit("| Suggestion | Surfaced by | Status |"), F.lit("|---|---:|---|")], own.select(F.col("rank").alias("n"), line.alias("line"))).withColumn("part", F.lit(i)))
    every = union_all(parts)
    title = every.sparkSession.createDataFrame([(-2_000, f"# Suggestions of {day}", -1)], "pos long, line string, part int")
    return every.unionByName(title).select(F.row_number().over(Window.orderBy("part", "pos")).cast("long").alias("pos"), "line")


# Marks of health, and the share of healthy boards from which a badge is yellow.
MARKS = {"ok": "✅", "degraded": "⚠️", "blocked": "🚧", "broken": "❌"}
YELLOW = 0.7


def health_report(health: DataFrame, checked_at: str) -> DataFrame:
    """Boards (ats, name, status, jobs, detail) as a table: those that are not ok last, then by platform."""
    counted = health.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"))
    mark = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair]), "status"), F.lit("?"))
    line = _row(mark, F.concat(F.lit("`"), "ats", F.lit("`")), F.col("name"), F.col("jobs"), F.coalesce(F.nullif("detail", F.lit("")), F.col("status")))
    rows = health.select(F.row_number().over(Window.orderBy(F.col("status") != "ok", "ats", "name")).alias("n"), line.alias("line"))
    heads = [F.lit("# Board health"), F.concat(F.format_string("%d/%d platforms healthy, checked ", "ok", "n"), F.lit(checked_at)), F.lit("| | Platform | Board | Postings | Detail |"), F.lit("|---|---|---|---:|---|")]
    return _headed(counted, heads, rows)


def health_json(health: DataFrame, checked_at: str) -> DataFrame:
    """One row (json): the check's time, the numbers and all boards."""
    boards = F.array_sort(F.collect_list(F.struct("ats", "name", "status", "jobs", "detail")))
    return health.agg(F.to_json(F.struct(F.lit(checked_at).alias("checked_at"), F.count_if(F.col("status") == "ok").alias("healthy"), F.count("*").alias("total"), boards.alias("boards"))).alias("json"))


def health_badge(health: DataFrame) -> DataFrame:
    """One row (json): a badge's endpoint with the number of healthy boards."""
    ok, n = F.count_if(F.col("status") == "ok"), F.count("*")
    colour = F.when(ok == n, "brightgreen").when(ok >= n * YELLOW, "yellow").otherwise("red")
    message = F.concat(ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" healthy"))
    return health.agg(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit("boards").alias("label"), message.alias("message"), colour.alias("color"))).alias("json"))
