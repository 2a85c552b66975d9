"""Queries of decisions, versions, counters, reports and clearances over the given tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import predicates
from postlake.operators import judging, reports, store
from postlake.operators.versions import Conflict, Versions
from postlake.plans.queries import POSTINGS_SQL, _shared, postings, query, table
from postlake.sources import dispatch

_DEMANDS = ("an active TS/SCI clearance", "Current DoD Top-Secret security clearance", "eligible for a clearance", "active us government secret clearance", "ability to obtain a security clearance", "inactive clearance")
_DEMAND_SQL = "[" + ", ".join(f"'{x}'" for x in _DEMANDS) + "]"


@query(rf"SELECT doc_id, regexp_matches(concat(coalesce(text, ''), ' ', {_DEMAND_SQL}[1 + doc_id % 6]), '(?i)\b(active|current)\s+((us|u\.s\.|government|dod|top[-\s]?secret|ts/?\s?sci|secret)\s+)*(security\s+)?clearance') AS demanded FROM documents")
def clearance_demands(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a sentence on clearances put behind each: held today, or to be had."""
    said = F.get(F.array(*map(F.lit, _DEMANDS)), (F.col("doc_id") % 6).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), said).alias("text"))
    return rows.select("doc_id", predicates.needs_clearance("text").alias("demanded"))


@query("SELECT count(*)::BIGINT AS calls, sum(l_quantity::BIGINT)::BIGINT AS uncached_input, coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END), 0)::BIGINT AS cache_write, sum(l_linenumber)::BIGINT AS cache_read, sum(l_orderkey % 100)::BIGINT AS output FROM lineitem")
def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of judging calls, one a line of an order, summed up while the rows are aggregated for something else."""
    calls = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("uncached_input"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("cache_write"), F.col("l_linenumber").alias("cache_read"), (F.col("l_orderkey") % 100).alias("output"), "l_returnflag")
    frame, usage = judging.counted(calls)
    frame.groupBy("l_returnflag").count().collect()  # a few flags
    return spark.createDataFrame([tuple(usage.get[c] for c in judging.USAGE)], ", ".join(f"{c} long" for c in judging.USAGE))


@query("""SELECT kind, term, surfaced, listed, CAST(row_number() OVER (PARTITION BY kind ORDER BY surfaced DESC, lower(term)) AS INTEGER) AS rank FROM (SELECT c_mktsegment AS kind, concat('Term ', c_nationkey) AS term, count(*) AS surfaced, c_nationkey IN (3, 4) AS listed FROM customer GROUP BY c_mktsegment, c_nationkey)""")
def suggested_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("kind"), F.concat(F.lit(" Term "), "c_nationkey").alias("term"), F.col("c_custkey").cast("string").alias("seed"))
    return reports.suggestions(rows, ("TERM 3", "term 4"))


_HEALTH = "CASE WHEN s_nationkey % 4 < 2 THEN 'ok' WHEN s_nationkey % 4 = 2 THEN 'blocked' ELSE 'broken' END"


@query(f"""WITH h AS (SELECT s_name, {_HEALTH} AS status, s_suppkey FROM supplier)
SELECT -1000 + i AS pos, line FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest(['# Board health', concat(count(*) FILTER (status = 'ok'), '/', count(*), ' platforms healthy, checked noon'), '| | Platform | Board | Postings | Detail |', '|---|---|---|---:|---|']) AS line FROM h)
UNION ALL SELECT row_number() OVER (ORDER BY status <> 'ok', s_name), concat('| ', CASE status WHEN 'ok' THEN '✅' WHEN 'blocked' THEN '🚧' ELSE '❌' END, ' | `', s_name, '` | Board ', s_suppkey, ' | ', s_suppkey, ' | ', status, ' |') FROM h""")
def health_report(spark: SparkSession, d: str) -> DataFrame:
    nation = F.col("s_nationkey") % 4
    status = F.when(nation < 2, "ok").when(nation == 2, "blocked").otherwise("broken")
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("ats"), F.concat(F.lit("Board "), "s_suppkey").alias("name"), status.alias("status"), F.col("s_suppkey").alias("jobs"), F.lit("").alias("detail"))
    return reports.health_report(rows, "noon")


@query(f"""WITH {POSTINGS_SQL}, asked AS (SELECT job_id, CASE WHEN company_id % 7 = 0 THEN 'loved' WHEN company_id % 7 = 1 THEN 'clear' ELSE 'saved' END AS d FROM postings WHERE company_id % 3 = 0)
SELECT job_id, CASE WHEN d IS NULL OR d = 'loved' THEN disposition WHEN d = 'clear' THEN NULL ELSE d END AS disposition, CASE WHEN d = 'saved' THEN 'by hand' END AS disposition_note, coalesce(d = 'loved', false) AS refused FROM postings LEFT JOIN asked USING (job_id)""")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions by id: taken, taken back, and refused for an unknown word."""
    rows = postings(spark, d).withColumns({"url": F.lit(None).cast("string"), "title": F.col("job_id"), "disposition_note": F.lit(None).cast("string")})
    seven = F.col("company_id") % 7
    said = F.when(seven == 0, "loved").when(seven == 1, "Clear ").otherwise("saved")
    asked = rows.where("company_id % 3 = 0").select(F.col("job_id").alias("ref"), said.alias("disposition"), F.lit("by hand").alias("note"), F.lit("1998-09-01").cast("timestamp_ntz").alias("at"))
    after, outcomes = store.disposed(rows, asked)
    refused = outcomes.where("error LIKE 'unknown disposition loved%'").select(F.col("ref").alias("job_id"), F.lit(True).alias("refused"))
    return after.join(refused.hint("merge"), "job_id", "left").select("job_id", "disposition", "disposition_note", F.coalesce("refused", F.lit(False)).alias("refused"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 < 3")
def versioned_writers(spark: SparkSession, d: str) -> DataFrame:
    """Three writers add a third of the events each; two of them meet, and one batch comes twice."""
    rows = table(spark, d, "events").select("event_id", "event_type")
    third = lambda i: rows.where(F.col("event_id") % 3 == i)
    mine = Versions(spark, f"{_shared(spark)}/versions")
    other = Versions(spark, mine.root)
    base = mine.commit(third(0), None)
    other.update(lambda stored: stored.unionByName(third(1)), app="other", batch=1)
    try:
        mine.commit(mine.read(base.number).unionByName(third(2)), base)
    except Conflict:
        mine.update(lambda stored: stored.unionByName(third(2)))
    other.update(lambda stored: stored.unionByName(third(1)), app="other", batch=1)
    return mine.read()


@query("SELECT 'greenhouse' AS platform, concat('c', o_custkey) AS board, count(*) AS n_jobs, count(*) FILTER (o_orderkey % 3 = 0) AS n_local FROM orders GROUP BY o_custkey")
def local_counts(spark: SparkSession, d: str) -> DataFrame:
    """Postings and local postings of landed boards."""
    place = F.when(F.col("o_orderkey") % 3 == 0, "Durham, NC").otherwise("Boston, MA")
    job = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Role "), "o_orderkey").alias("title"), F.struct(place.alias("name")).alias("location"))
    boards = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("body"))
    bronze = boards.select(F.lit("greenhouse").alias("platform"), F.concat(F.lit("c"), "o_custkey").alias("board"), F.lit("C").alias("company"), F.lit(200).alias("status"), "body")
    return dispatch.board_counts(bronze, "NC").where("n_jobs > 0")


@query("SELECT concat('C', c_custkey) AS company, c_custkey % 4 IN (0, 1) AS has_office FROM customer")
def office_signal(spark: SparkSession, d: str) -> DataFrame:
    """Employers with an office in the area, by their postings' places or else their own pages."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("company"), (F.col("c_custkey") % 4).alias("r"))
    found = c.select("company", F.when(F.col("r") == 0, "Durham, NC").otherwise("Reno, NV").alias("location"))
    own = c.select("company", F.when(F.col("r") == 1, "<p>Offices: Cary, NC</p>").when(F.col("r") == 2, "<p>Care</p>").alias("html"))
    return dispatch.has_office(c, found, own, "(Durham|Cary), NC")
