"""Queries of the library's operators over the given tables, and the same in DuckDB's SQL.

The tables hold no postings, so each query first views one as what its operator
works on: orders as postings of customers, events as board snapshots of users,
documents as descriptions, lineitem columns as axes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.functions import predicates as P
from postlake.functions import scoring as S
from postlake.functions import text as T
from postlake.operators import entities, lifecycle, store, views
from postlake.profile import AXES, AXIS_WEIGHTS, GATE_PENALTIES, NON_US_REGIONS, REMOTE_BODY_PHRASES, REMOTE_LOCATION_TOKENS, REMOTE_NEGATIONS, US_MARKERS, Excludes, Vocabulary
from postlake.sources import boards, pages
from postlake.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VOCABULARY = Vocabulary(core=("general public license", "apache", "scum", "idiot"), domain=("medical", "der", "les", "ther"), skill=("und", "que", "ation", "the"), extra=("rights reserved",), exclude=("worthless",), exclude_title=("zu und",), boilerplate=(r"all\s+rights\s+reserved", r"under\s+the\s+mit\s+license"))
EXCLUDES = Excludes(role_phrases=("moron", "trash"), title_tokens=("der", "las"), strong=("pathetic",), weak=("clown", "loser", "stupid", "disgusting"), nonclinical=("license",))
TODAY, NOW = "1998-08-02", "2024-01-16 00:00:00"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small file by a key over all shuffle partitions: what is made of one is a page, a hundred times as large and slow to read."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_first(text: str, terms, pattern) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_quoted(pattern(t))}) THEN {_quoted(t)}" for t in terms) + " END"


def _sql_any(text: str, terms, pattern) -> str:
    return f"regexp_matches({text}, {_quoted(T.any_of(map(pattern, terms)))})"


# Orders as postings: a third of the statuses is unknown, urgent ones are applied to.
POSTINGS_SQL = """
postings AS (
  SELECT concat('gh_c', o_custkey % 40, '_', o_orderkey) AS job_id, o_custkey AS company_id, o_totalprice / 600000 AS fit,
    CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'applied' WHEN '2-HIGH' THEN 'saved' END AS disposition,
    o_orderdate AS first_seen, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS posted_at, o_orderdate AS disposition_at
  FROM orders),
companies AS (
  SELECT c_custkey AS company_id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation,
    CASE WHEN c_acctbal >= 0 THEN c_acctbal / 10000 END AS mission_score FROM customer)"""


def postings(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open")
    disposition = F.when(F.col("o_orderpriority") == "1-URGENT", "applied").when(F.col("o_orderpriority") == "2-HIGH", "saved")
    return table(spark, d, "orders").select(
        F.concat(F.lit("gh_c"), F.col("o_custkey") % 40, F.lit("_"), F.col("o_orderkey")).alias("job_id"), F.col("o_custkey").alias("company_id"), (F.col("o_totalprice") / 600000).alias("fit"), status.alias("status"),
        disposition.alias("disposition"), F.col("o_orderdate").alias("first_seen"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("posted_at"), F.col("o_orderdate").alias("disposition_at"),
    )


def companies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10000).alias("mission_score"))


_RANKED = """
  SELECT job_id, company_id, nation, fit, CASE WHEN segment = 'MACHINERY' THEN greatest(coalesce(mission_score, 0), 0.6) ELSE mission_score END AS mission
  FROM postings LEFT JOIN companies USING (company_id)
  WHERE (status IS NULL OR status <> 'closed') AND (disposition IS NULL OR disposition = 'saved')"""


@query(f"WITH {POSTINGS_SQL}, r AS ({_RANKED}) SELECT job_id, company_id, round(fit, 6) AS fit, round(mission, 6) AS mission, round(CASE WHEN fit >= 0 AND mission >= 0 THEN sqrt(fit * mission) END, 6) AS combined FROM r WHERE mission IS NULL OR mission >= 0.2")
def ranked_postings(spark: SparkSession, d: str) -> DataFrame:
    rows = views.ranked(postings(spark, d), companies(spark, d), F.col("segment") == "MACHINERY", min_mission=0.2)
    return rows.select("job_id", "company_id", *[F.round(c, 6).alias(c) for c in ("fit", "mission", "combined")])


@query(f"WITH {POSTINGS_SQL}, r AS ({_RANKED}), c AS (SELECT *, CASE WHEN fit >= 0 AND mission >= 0 THEN sqrt(fit * mission) END AS combined FROM r) SELECT nation, rank, job_id FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY coalesce(combined, -1) DESC, fit DESC, job_id) AS rank FROM c) WHERE rank <= 10")
def ranked_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = views.ranked(postings(spark, d), companies(spark, d), F.col("segment") == "MACHINERY")
    order = [F.coalesce("combined", F.lit(-1.0)).desc(), F.desc("fit"), F.col("job_id")]
    return views.numbered(rows, order, ["nation"]).where("rank <= 10").select("nation", "rank", "job_id")


_LOW = "lower(concat(split_part(text, chr(10), 1), ' ', text))"
_SCRUB = f"regexp_replace(%s, {_quoted('(?i)' + T.any_of(VOCABULARY.boilerplate))}, ' ', 'g')"
_HEAD = "lower(concat(split_part(text, chr(10), 1), ' ', left(text, 1200)))"
_TIER = f"""SELECT doc_id, CASE
  WHEN {_sql_any('t', VOCABULARY.exclude, lambda x: T.escaped(x.lower()))} OR {_sql_any('ti', VOCABULARY.exclude_title, lambda x: T.escaped(x.lower()))} THEN NULL
  WHEN {_sql_any('t', VOCABULARY.core, T.keyword_pattern)} THEN 'CORE' WHEN {_sql_any('t', VOCABULARY.extra, T.keyword_pattern)} THEN 'EXTRA'
  WHEN {_sql_any('h', VOCABULARY.domain, T.keyword_pattern)} AND {_sql_any('h', VOCABULARY.skill, T.keyword_pattern)} THEN 'DOMAIN+SKILL' END AS tier
FROM (SELECT doc_id, {_SCRUB % _LOW} AS t, {_SCRUB % _HEAD} AS h, lower(split_part(text, chr(10), 1)) AS ti FROM documents)"""


def described(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("title", F.substring_index("text", "\n", 1))


@query(f"WITH tiers AS ({_TIER}) SELECT doc_id, tier, tier IS NOT NULL AS relevant FROM tiers")
def relevance_tier(spark: SparkSession, d: str) -> DataFrame:
    tier = P.relevance_tier("title", "text", VOCABULARY)
    return described(spark, d).select("doc_id", tier.alias("tier")).withColumn("relevant", F.col("tier").isNotNull())


@query(f"SELECT doc_id, {_sql_first(_LOW, VOCABULARY.core, T.keyword_pattern)} AS anchor FROM documents")
def core_anchor(spark: SparkSession, d: str) -> DataFrame:
    return described(spark, d).select("doc_id", P.core_anchor("title", "text", VOCABULARY).alias("anchor"))


_WEAK = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(s, {_quoted(T.token_pattern(x))}) THEN {_quoted(x)} END" for x in EXCLUDES.weak) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT doc_id, CASE WHEN p IS NOT NULL THEN concat('role: ', p) WHEN k IS NOT NULL THEN concat('role-title: ', upper(k)) WHEN st IS NOT NULL THEN concat('defense: ', st)
  WHEN len(w) >= 2 THEN concat('defense: ', array_to_string(w[1:3], '+')) WHEN n IS NOT NULL THEN concat('non-clinical: ', n) END AS reason FROM (
  SELECT doc_id, {_sql_first('t', EXCLUDES.role_phrases, T.whole_word)} AS p, {_sql_first('ti', EXCLUDES.title_tokens, T.whole_word)} AS k, {_sql_first('s', EXCLUDES.strong, T.token_pattern)} AS st,
    {_WEAK} AS w, {_sql_first('t', EXCLUDES.nonclinical, T.whole_word)} AS n
  FROM (SELECT doc_id, {_LOW} AS t, {_SCRUB % _LOW} AS s, lower(split_part(text, chr(10), 1)) AS ti FROM documents))""")
def exclude_reason(spark: SparkSession, d: str) -> DataFrame:
    return described(spark, d).select("doc_id", P.exclude_reason("title", "text", EXCLUDES, VOCABULARY.boilerplate).alias("reason"))


@query("SELECT p_partkey, regexp_matches(concat(p_name, ' ', p_type), '(?i)widget|bolt|standard') AS technical FROM part")
def technical_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", P.is_technical(F.concat_ws(" ", "p_name", "p_type"), "widget|bolt|standard").alias("technical"))


@query(f"SELECT doc_id, md5(s) AS scrubbed_md5, length(s)::BIGINT AS n FROM (SELECT doc_id, {_SCRUB % 'text'} AS s FROM documents)")
def boilerplate_scrub(spark: SparkSession, d: str) -> DataFrame:
    s = T.scrubbed("text", VOCABULARY.boilerplate)
    return table(spark, d, "documents").select("doc_id", F.md5(s).alias("scrubbed_md5"), F.length(s).cast("long").alias("n"))


# Suppliers as postings of places: every fourth is remote somewhere, some say so in the body.
_PLACES = "(SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'Remote - US' WHEN 1 THEN concat(n_name, ', Remote') WHEN 2 THEN 'Berlin, Germany' WHEN 3 THEN 'Durham, NC' WHEN 4 THEN '' WHEN 5 THEN 'Anywhere' WHEN 6 THEN 'Austria' ELSE n_name END AS loc, CASE s_suppkey % 5 WHEN 0 THEN 'This role is remote.' WHEN 1 THEN 'On-site only; a distributed team.' WHEN 2 THEN 'Fully remote, wfh.' WHEN 3 THEN 'Our Durham office' ELSE 'Distributed training' END AS body FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
LOCAL = P.locality_pattern(("nc",), ("durham", "nation_7"))


def _remote_sql(loc: str, body: str) -> str:
    return f"CASE WHEN {_sql_any(f'concat({loc}, chr(32), chr(10), chr(32), {body})', REMOTE_NEGATIONS, P._remote_pattern)} THEN NULL ELSE coalesce('location:' || ({_sql_first(loc, REMOTE_LOCATION_TOKENS, P._remote_pattern)}), 'body:' || ({_sql_first(body, REMOTE_BODY_PHRASES, P._remote_pattern)})) END"


@query(f"""SELECT s_suppkey, signal, (loc = '' OR {_sql_any('loc', US_MARKERS, P._region_pattern)} OR NOT {_sql_any('loc', NON_US_REGIONS, P._region_pattern)}) AS us_ok, mode,
  CASE WHEN regexp_matches(loc, {_quoted(LOCAL)}) THEN 'local' WHEN mode = 'remote' OR by_place IS NOT NULL THEN 'remote' ELSE 'relocation' END AS bucket FROM (
  SELECT *, CASE WHEN regexp_matches(concat(loc, ' ', body), {_quoted(LOCAL)}) THEN 'onsite' WHEN signal IS NOT NULL THEN 'remote' END AS mode FROM (
    SELECT s_suppkey, loc, body, {_remote_sql('loc', 'body')} AS signal, {_remote_sql('loc', "''")} AS by_place FROM (SELECT s_suppkey, lower(loc) AS loc, lower(body) AS body FROM {_PLACES})))""")
def geo_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    loc = F.expr("CASE s_suppkey % 8 WHEN 0 THEN 'Remote - US' WHEN 1 THEN concat(n_name, ', Remote') WHEN 2 THEN 'Berlin, Germany' WHEN 3 THEN 'Durham, NC' WHEN 4 THEN '' WHEN 5 THEN 'Anywhere' WHEN 6 THEN 'Austria' ELSE n_name END")
    body = F.expr("CASE s_suppkey % 5 WHEN 0 THEN 'This role is remote.' WHEN 1 THEN 'On-site only; a distributed team.' WHEN 2 THEN 'Fully remote, wfh.' WHEN 3 THEN 'Our Durham office' ELSE 'Distributed training' END")
    rows = rows.select("s_suppkey", loc.alias("loc"), body.alias("body")).withColumn("mode", P.geo_mode("loc", "body", LOCAL))
    return rows.select("s_suppkey", P.remote_signal("loc", "body").alias("signal"), P.us_eligible("loc").alias("us_ok"), "mode", P.geo_bucket("loc", F.lit(False), "mode", LOCAL).alias("bucket"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 4000 THEN text ELSE concat(left(text, 2000), chr(10), '[... middle of posting elided ...]', chr(10), right(text, 2000)) END) AS clipped_md5 FROM documents")
def clip_description(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.clipped("text", 4000, 3000)).alias("clipped_md5"))


# Lineitem columns as axes, return flags as gates.
_AXES = {"domain": "l_discount * 10", "function": "l_tax * 10", "stack": "l_quantity / 50", "seniority": "l_extendedprice / 105000"}
_BASE = "exp((" + " + ".join(f"{AXIS_WEIGHTS[a]} * ln(greatest(1e-6, {_AXES[a]}))" for a in AXES) + f") / {sum(AXIS_WEIGHTS.values())})"
_FACTOR = "CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 0.2 ELSE 0.45 END WHEN 'A' THEN 1.0 ELSE 1.0 END"


def axes() -> dict:
    return {a: F.expr(x) for a, x in _AXES.items()}


def gates() -> F.Column:
    phd = F.when(F.col("l_returnflag") == "R", F.lit("phd"))
    geo = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.lit("geo"))
    return F.array_compact(F.array(phd, geo, F.when(F.col("l_returnflag") == "A", F.lit("unheard-of"))))


@query(f"SELECT l_orderkey, l_linenumber, round({_BASE} * ({_FACTOR}), 6) AS fit FROM lineitem")
def axis_combine(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.combined_fit(axes(), gates(), AXIS_WEIGHTS, GATE_PENALTIES, 6).alias("fit"))


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"printf('%.2f', {_AXES[a]})::DOUBLE AS {a}" for a in AXES) + ", CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linestatus = 'F' THEN 'phd+geo' ELSE 'phd' END WHEN 'A' THEN 'unheard-of' END AS gates, l_linestatus AS reason FROM lineitem")
def reason_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    written = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.reason_text(axes(), gates(), "l_linestatus").alias("r"))
    read = S.parsed_axes("r")
    return written.select("l_orderkey", "l_linenumber", *[read[a].alias(a) for a in AXES], F.array_join(read["gates"], "+").alias("gates"), S.clean_reason("r").alias("reason"))


# Events as two batches of observations of postings (one of each user and type), the second from mid-January on.
_OBSERVED = "SELECT concat('gh_u', user_id, '_', event_type) AS job_id, event_id AS ordinal, CASE WHEN event_id % 4 > 0 THEN concat('t', event_id % 7) END AS title, CASE WHEN event_id % 3 > 0 THEN value END AS resume_fit_score, CASE WHEN event_id % 5 > 0 THEN ts END AS posted_at, ts AS first_seen, ts AS last_seen, CASE WHEN event_id % 11 > 0 THEN CASE WHEN event_type = 'error' THEN 'closed' ELSE 'open' END END AS status, ts >= TIMESTAMP '2024-01-16 00:00:00' AS late FROM events"


def observed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("gh_u"), "user_id", F.lit("_"), "event_type").alias("job_id"), F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("t"), F.col("event_id") % 7)).alias("title"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("resume_fit_score"),
        F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("posted_at"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.when(F.col("event_id") % 11 > 0, F.when(F.col("event_type") == "error", "closed").otherwise("open")).alias("status"), (F.col("ts") >= F.lit(NOW).cast("timestamp_ntz")).alias("late"),
    )


_FOLD = "SELECT job_id, arg_max(title, ordinal) FILTER (title IS NOT NULL) AS t0, arg_max(coalesce(title, chr(1)), ordinal) AS title, arg_max(resume_fit_score, ordinal) FILTER (resume_fit_score IS NOT NULL) AS resume_fit_score, arg_min(posted_at, ordinal) FILTER (posted_at IS NOT NULL) AS posted_at, min(first_seen) AS first_seen, max(last_seen) AS last_seen, arg_max(coalesce(status, chr(1)), ordinal) AS status, true AS here FROM observed WHERE late = %s GROUP BY job_id"


@query(f"""WITH observed AS ({_OBSERVED}), o AS ({_FOLD % 'false'}), n AS ({_FOLD % 'true'})
SELECT job_id, nullif(coalesce(n.title, o.title), chr(1)) AS title, coalesce(n.resume_fit_score, o.resume_fit_score) AS resume_fit_score, coalesce(o.posted_at, n.posted_at) AS posted_at, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen, nullif(coalesce(n.status, o.status), chr(1)) AS status, o.here IS NULL AS is_new FROM o FULL JOIN n USING (job_id)""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = observed(spark, d)
    first, second = (store.fold(rows.where("late" if late else "not late").drop("late")) for late in (False, True))
    return store.merge_postings(first, second)


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tracks, count(DISTINCT event_type)::BIGINT AS n FROM events GROUP BY user_id")
def track_union(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    return sets.select("user_id", F.array_join("t", ",").alias("tracks"), F.size("t").cast("long").alias("n"))


# Before mid-January the store fills; what users did in the week after is their board's snapshot.
_STORED = "SELECT user_id % 50 AS company_id, CASE WHEN event_id % 6 = 0 THEN concat('linkedin_', event_id) ELSE concat('gh_', user_id % 50, '_', event_id) END AS job_id, concat('https://x.org/', user_id, '/', event_type, '?e=', event_id) AS url, concat('  ', event_type, ' ', event_id % 90) AS title, CASE WHEN event_id % 4 = 0 THEN 'closed' ELSE 'open' END AS status, ts AS last_seen, CASE WHEN event_id % 3 = 0 THEN ts END AS posted_at FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00'"
_SNAPSHOT = "SELECT user_id % 50 AS company_id, concat('gh_', user_id % 50, '_', event_id - 4000 + 7 * (event_id % 2)) AS job_id, concat('http://x.org/', user_id, '/', event_type, '#f') AS url, upper(concat(event_type, ' ', event_id % 90)) AS title, ts AS posted_at, event_id AS pos FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' AND ts < TIMESTAMP '2024-01-23 00:00:00' AND user_id % 50 <> 3"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, mid = table(spark, d, "events"), F.lit(NOW).cast("timestamp_ntz")
    company, name = F.col("user_id") % 50, F.concat("event_type", F.lit(" "), F.col("event_id") % 90)
    old = e.where(F.col("ts") < mid).select(
        company.alias("company_id"), F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("linkedin_"), "event_id")).otherwise(F.concat(F.lit("gh_"), company, F.lit("_"), "event_id")).alias("job_id"), F.concat(F.lit("https://x.org/"), "user_id", F.lit("/"), "event_type", F.lit("?e="), "event_id").alias("url"),
        F.concat(F.lit("  "), name).alias("title"), F.when(F.col("event_id") % 4 == 0, "closed").otherwise("open").alias("status"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("closed_at"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("posted_at"),
    )
    new = e.where((F.col("ts") >= mid) & (F.col("ts") < mid + F.expr("INTERVAL 7 DAYS")) & (company != 3)).select(
        company.alias("company_id"), F.concat(F.lit("gh_"), company, F.lit("_"), F.col("event_id") - 4000 + 7 * (F.col("event_id") % 2)).alias("job_id"), F.concat(F.lit("http://x.org/"), "user_id", F.lit("/"), "event_type", F.lit("#f")).alias("url"), F.upper(name).alias("title"), F.col("ts").alias("posted_at"), F.col("event_id").alias("pos"),
    )
    return old, new


_NORM_URL = "rtrim(split_part(split_part(regexp_replace(lower(trim(%s)), '^[a-z]+://', ''), '#', 1), '?', 1), '/')"
_NORM_TITLE = r"lower(trim(regexp_replace(%s, '\s+', ' ', 'g')))"


@query(f"""WITH o AS ({_STORED}), s AS ({_SNAPSHOT}),
b AS (SELECT DISTINCT company_id FROM s),
ids AS (SELECT company_id, job_id, arg_min(posted_at, pos) AS d FROM s GROUP BY ALL),
us AS (SELECT company_id, {_NORM_URL % 'url'} AS u, arg_min(posted_at, pos) AS d FROM s GROUP BY ALL),
ts AS (SELECT company_id, {_NORM_TITLE % 'title'} AS t, arg_min(posted_at, pos) AS d FROM s GROUP BY ALL),
m AS (SELECT o.*, b.company_id IS NOT NULL AS on_board, o.job_id LIKE 'gh%' AND b.company_id IS NOT NULL AS native, ids.job_id IS NOT NULL AS by_id, us.u IS NOT NULL AS by_u, ts.t IS NOT NULL AS by_t, coalesce(ids.d, us.d, ts.d) AS d
  FROM o LEFT JOIN b ON o.company_id = b.company_id LEFT JOIN ids ON o.company_id = ids.company_id AND o.job_id = ids.job_id
  LEFT JOIN us ON o.company_id = us.company_id AND {_NORM_URL % 'o.url'} = us.u LEFT JOIN ts ON o.company_id = ts.company_id AND {_NORM_TITLE % 'o.title'} = ts.t),
p AS (SELECT *, on_board AND (by_id OR (NOT native AND (by_u OR by_t))) AS present FROM m),
g AS (SELECT *, on_board AND NOT present AND status <> 'closed' AND (native OR last_seen < TIMESTAMP '2024-01-23 00:00:00' - INTERVAL 12 DAY) AS gone FROM p)
SELECT job_id, CASE WHEN present THEN 'open' WHEN gone THEN 'closed' ELSE status END AS status, CASE WHEN gone THEN TIMESTAMP '2024-01-23 00:00:00' END AS closed_at, CASE WHEN present THEN TIMESTAMP '2024-01-23 00:00:00' ELSE last_seen END AS last_seen,
  coalesce(posted_at, CASE WHEN present THEN d END) AS posted_at, CASE WHEN present AND status <> 'open' THEN 'reopened' WHEN gone THEN 'closed' END AS change FROM g""")
def sync_statuses(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    rows = lifecycle.sync_statuses(old, new, F.lit("2024-01-23 00:00:00").cast("timestamp_ntz"), grace_days=12)
    return rows.select("job_id", "status", "closed_at", "last_seen", "posted_at", "change")


@query(f"""WITH o AS ({_STORED}), p AS (SELECT concat('gh_', user_id % 50, '_', event_id) AS job_id, CASE WHEN value > 60 THEN NULL ELSE value > 20 END AS is_open FROM events)
SELECT o.job_id, CASE WHEN o.status = 'open' AND last_seen < TIMESTAMP '2024-01-14 00:00:00' AND is_open = false THEN 'closed' ELSE status END AS status FROM o LEFT JOIN p ON o.job_id = p.job_id""")
def stale_close(spark: SparkSession, d: str) -> DataFrame:
    old, _ = _snapshots(spark, d)
    e = table(spark, d, "events")
    probes = e.select(F.concat(F.lit("gh_"), F.col("user_id") % 50, F.lit("_"), "event_id").alias("job_id"), F.when(F.col("value") <= 60, F.col("value") > 20).alias("is_open"))
    return lifecycle.closed_when_stale(old, probes, F.lit(NOW).cast("timestamp_ntz")).select("job_id", "status")


@query(f"WITH {POSTINGS_SQL} SELECT job_id, disposition, disposition_at, status FROM postings WHERE disposition IS NOT NULL")
def pipeline_view(spark: SparkSession, d: str) -> DataFrame:
    return views.pipeline(postings(spark, d)).select("job_id", "disposition", "disposition_at", "status")


@query(f"WITH {POSTINGS_SQL} SELECT c.company_id, c.name, count(p.job_id)::BIGINT AS n_open FROM companies c LEFT JOIN postings p ON c.company_id = p.company_id AND (status IS NULL OR status <> 'closed') GROUP BY ALL")
def company_open_counts(spark: SparkSession, d: str) -> DataFrame:
    return views.open_counts(companies(spark, d), postings(spark, d)).select("company_id", "name", "n_open")


@query(f"""WITH {POSTINGS_SQL}, s AS (SELECT count(*) FILTER (status IS NULL OR status <> 'closed') AS n_open, count(*) FILTER (status = 'closed') AS n_closed, count(*) FILTER ((status IS NULL OR status <> 'closed') AND first_seen::DATE = DATE '{TODAY}') AS new_today,
  count(*) FILTER ((status IS NULL OR status <> 'closed') AND posted_at IS NOT NULL) AS n_dated, count(disposition) AS n_pipeline, count(*) FILTER (disposition = 'saved') AS n_saved FROM postings) SELECT *, coalesce(round(100 * n_dated / nullif(n_open, 0), 0), 0)::DOUBLE AS dated_percent FROM s""")
def stats_tiles(spark: SparkSession, d: str) -> DataFrame:
    return views.stats(postings(spark, d), F.lit(TODAY).cast("date"))


@query(f"WITH tiers AS ({_TIER}), r AS (SELECT d.source, t.tier IS NOT NULL AS rel, d.n_chars >= 500 AS kept, l.doc_id IS NULL AS new FROM documents d JOIN tiers t USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) SELECT source, count(*) AS fetched, count(*) FILTER (rel) AS gate1, count(*) FILTER (rel AND kept) AS kept, count(*) FILTER (rel AND kept AND new) AS n_new FROM r GROUP BY source")
def source_funnel(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = described(spark, d).join(known, "doc_id", "left")
    return views.funnel(rows, "source", P.is_relevant("title", "text", VOCABULARY), F.col("n_chars") >= 500, F.col("known").isNull())


@query("""WITH s AS (SELECT s_nationkey AS board, s_name AS name, s_suppkey % 4 AS tag, s_acctbal > 0 AS active, s_acctbal FROM supplier) SELECT board, arg_min(name, struct_pack(a := -s_acctbal, b := length(name), c := name)) AS name, count(DISTINCT name) AS n_merged, array_to_string(list_sort(list(DISTINCT concat('t', tag))), ',') AS tags, bool_or(active) AS active FROM s GROUP BY board""")
def dedup_companies(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_nationkey").alias("board"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("t"), F.col("s_suppkey") % 4)).alias("tags"), (F.col("s_acctbal") > 0).alias("active"), "s_acctbal")
    out = store.best_of_boards(rows, ["board"], [-F.col("s_acctbal"), F.length("name")])
    return out.withColumn("tags", F.array_join("tags", ","))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("m"))
    return store.first_of(rows, [F.col("m")], [F.col("source"), F.col("doc_id")]).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fresh_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def watched_semi(spark: SparkSession, d: str) -> DataFrame:
    watched = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(watched, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) ORDER BY turn, f LIMIT 50")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    return views.diversified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 50).select("doc_id", "source", "turn")


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate::DATE = DATE '{TODAY}' THEN 'NEW' WHEN o_orderkey % 3 = 0 THEN '?' ELSE concat(datediff('day', o_orderdate::DATE, DATE '{TODAY}'), 'd', CASE WHEN datediff('day', o_orderdate::DATE, DATE '{TODAY}') >= 45 THEN '!' ELSE '' END) END AS age FROM orders")
def age_tag(spark: SparkSession, d: str) -> DataFrame:
    posted = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", T.age_tag("o_orderdate", posted, F.lit(TODAY).cast("date")).alias("age"))


@query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN ts::DATE WHEN 1 THEN ts::DATE WHEN 2 THEN ts::DATE WHEN 3 THEN DATE '2024-02-01' WHEN 4 THEN DATE '2024-01-31' WHEN 5 THEN DATE '2024-02-01' - (event_id % 40)::INT END AS posted FROM events""")
def posted_date_normalise(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = F.expr("CASE event_id % 7 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") WHEN 3 THEN 'Posted Today' WHEN 4 THEN 'Posted Yesterday' WHEN 5 THEN concat('Posted ', event_id % 40, '+ Days Ago') WHEN 6 THEN 'See posting' END")
    raw = F.when(F.col("event_id") % 7 == 1, (seconds * 1000).cast("string")).when(F.col("event_id") % 7 == 2, seconds.cast("string")).otherwise(raw)
    return table(spark, d, "events").select("event_id", T.posted_date(raw, F.lit("2024-02-01").cast("date")).alias("posted"))


@query(f"SELECT page_id, {_NORM_URL % 'url'} AS u, md5({_NORM_TITLE % 'html'}) AS t, left(sha1(concat(url, '||', page_id)), 16) AS id FROM pages")
def norm_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.norm_url("url").alias("u"), F.md5(T.norm_title("html")).alias("t"), T.stable_id("url", "page_id").alias("id"))


@query(f"""WITH p AS (SELECT concat('pg_', page_id) AS job_id, url FROM pages), r AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN concat('pg_', page_id) WHEN 1 THEN concat('G_', page_id) ELSE concat('HTTPS://', {_NORM_URL % 'url'}, '/?q') END AS ref FROM pages),
f AS (SELECT ref, job_id, 1 AS stage FROM r JOIN p ON ref = job_id UNION ALL SELECT ref, job_id, 2 FROM r JOIN p ON contains(lower(job_id), lower(ref)) UNION ALL SELECT ref, job_id, 3 FROM r JOIN p ON {_NORM_URL % 'ref'} = {_NORM_URL % 'url'})
SELECT ref, job_id, stage FROM (SELECT *, min(stage) OVER (PARTITION BY ref) AS m FROM f) WHERE stage = m""")
def resolve_ref(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    known = p.select(F.concat(F.lit("pg_"), "page_id").alias("job_id"), "url")
    refs = p.select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("pg_"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("G_"), "page_id")).otherwise(F.concat(F.lit("HTTPS://"), T.norm_url("url"), F.lit("/?q"))).alias("ref")).distinct()
    return store.resolve(known, refs)


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(%s, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?i)<br[^>]*>|</(p|div|li|ul|ol|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"""
_TEXT = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(%s, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ')""" % _HTML


@query(f"SELECT page_id, md5(t) AS text_md5, length(t)::BIGINT AS n FROM (SELECT page_id, {_TEXT % 'html'} AS t FROM pages)")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_text("html").alias("t")).select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\s[^>]*href\s*=\s*"[^"]*"[^>]*>.*?</a>)', 1)) AS x FROM pages), l AS (SELECT page_id, regexp_extract(x, '(?is)href\s*=\s*"([^"]*)"', 1) AS href FROM a) SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM l GROUP BY page_id""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets"))


@query("SELECT event_type, (props->>'$.k')::BIGINT AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def json_payload_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT concat('gh_c', o_custkey, '_', o_orderkey) AS job_id, concat('Order ', o_orderpriority) AS title, concat('Customer ', o_custkey) AS company, CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE concat('Place ', o_custkey % 9) END AS location, o_orderdate::DATE AS posted_at, CASE WHEN o_orderkey % 4 = 0 THEN 'office' END AS remote_hint FROM orders")
def board_payloads(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    job = F.struct(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.concat(F.lit("Place "), F.col("o_custkey") % 9).alias("name"))).alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_published"), F.array(F.struct(F.when(F.col("o_orderkey") % 4 == 0, "Remote US").otherwise("HQ").alias("name"))).alias("offices"),
    )
    bodies = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("body"))
    bronze = bodies.select(F.lit("greenhouse").alias("platform"), F.concat(F.lit("c"), "o_custkey").alias("board"), F.concat(F.lit("Customer "), "o_custkey").alias("company"), "body", F.lit(200).alias("status"))
    rows = boards.parse(bronze, "greenhouse").withColumn("posted_at", T.posted_date("posted_raw", F.lit(TODAY).cast("date")))
    return rows.select("job_id", "title", "company", "location", "posted_at", "remote_hint")


@query("""SELECT s_suppkey, array_to_string(list_filter([concat('supplier-', n, '-labs'), concat('supplier', n, 'labs'), 'supplier', concat('supplier', n), concat('supplier-', n)], lambda x: x IS NOT NULL), ',') AS slugs FROM (SELECT s_suppkey, split_part(lower(s_name), '#', 2) AS n FROM supplier)""")
def slug_variants(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("s_name", F.lit(" (Holding) Labs"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(entities.slug_variants(name), ",").alias("slugs"))


@query("""SELECT ats, slug, count(DISTINCT u) AS n_urls FROM (SELECT CASE page_id % 4 WHEN 0 THEN 'lever' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'workday' END AS ats, concat('co', page_id % 25) AS slug, url AS u FROM pages) WHERE ats IS NOT NULL GROUP BY ALL""")
def ats_detect(spark: SparkSession, d: str) -> DataFrame:
    slug = F.concat(F.lit("co"), F.col("page_id") % 25)
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://jobs.lever.co/"), slug, F.lit("/x?u="), "url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://boards.greenhouse.io/embed/job_board?for="), slug, F.lit("&u="), "url"))
    url = url.when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://"), slug, F.lit(".wd5.myworkdayjobs.com/en?u="), "url")).otherwise(F.concat(F.lit("https://jobs.lever.co/embed?u="), "url"))
    return entities.boards_of(table(spark, d, "pages").select(url.alias("url")))


@query("""WITH t AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS w FROM part) SELECT a.p_partkey, len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) = 0 OR len(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) = 0 AS same FROM t a JOIN t b ON a.p_partkey = b.p_partkey + 1""")
def token_subset_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", P.company_tokens(F.concat("p_name", F.lit(" Inc."))).alias("w"))
    return rows.join(rows.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("w").alias("v")), "p_partkey").select("p_partkey", P.same_company(F.col("w"), F.col("v")).alias("same"))


_TERMS = ("license", "idiot", "that", "der", "queue", "nicht", "para")


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest([{', '.join(f'CASE WHEN regexp_matches(lower(text), {_quoted(T.keyword_pattern(t))}) THEN {_quoted(t)} END' for t in _TERMS)}]) AS term FROM documents) WHERE term IS NOT NULL GROUP BY term")
def keyword_frequency(spark: SparkSession, d: str) -> DataFrame:
    return entities.keyword_counts(table(spark, d, "documents"), "text", "doc_id", _TERMS, T.keyword_pattern)


@query(f"SELECT round(avg(abs({_BASE} * ({_FACTOR}) - l_discount * 10)), 6) AS mae, count(*) AS n FROM lineitem")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((S.base_fit(axes()) * S.gate_factor(gates())).alias("p"), (F.col("l_discount") * 10).alias("w"))
    return S.mean_error(rows, "p", "w").withColumn("mae", F.round("mae", 6))


@query("""WITH o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS w FROM lineitem),
s AS (SELECT a.l_orderkey, avg(CASE WHEN a.w < b.w THEN 1 ELSE -1 END) AS g FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.p < b.p GROUP BY ALL) SELECT l_orderkey, round(coalesce(g, 1), 6) AS agreement FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN s USING (l_orderkey)""")
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    return S.rank_agreement(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey"]).withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {POSTINGS_SQL} SELECT disposition, rank, job_id FROM (SELECT disposition, job_id, row_number() OVER (PARTITION BY disposition ORDER BY disposition_at DESC, job_id) AS rank FROM postings WHERE disposition IS NOT NULL) WHERE rank <= 6")
def few_shot_examples(spark: SparkSession, d: str) -> DataFrame:
    return views.numbered(postings(spark, d).where("disposition is not null"), [F.desc("disposition_at"), F.col("job_id")], ["disposition"]).where("rank <= 6").select("disposition", "rank", "job_id")


@query(f"WITH {POSTINGS_SQL} SELECT segment, count(*) AS n, count(*) FILTER (fit < 0.3) AS low_fit, count(*) FILTER (posted_at IS NULL) AS undated, count(*) FILTER (fit >= 0.3 AND posted_at IS NOT NULL) AS shown FROM postings JOIN companies USING (company_id) GROUP BY segment")
def hidden_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = postings(spark, d).join(companies(spark, d), "company_id")
    low, undated = F.col("fit") < 0.3, F.col("posted_at").isNull()
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.count_if(low).alias("low_fit"), F.count_if(undated).alias("undated"), F.count_if(~low & ~undated).alias("shown"))


@query("SELECT job_id, status, closed_at, last_seen, posted_at FROM (" + SQL["sync_statuses"] + ")")
def stream_sync(spark: SparkSession, d: str) -> DataFrame:
    """sync_statuses fed by a stream: the snapshot's rows are written to a folder, which a stream then reads."""
    root = _shared(spark)
    old, new = _snapshots(spark, d)
    stored = sync.Snapshots(spark, f"{root}/store")
    stored.publish(old)
    sizes = new.groupBy("company_id").agg(F.count("*").alias("snapshot_rows"))
    rows = new.join(sizes, "company_id").withColumn("ts", F.lit("2024-01-23 00:00:00").cast("timestamp_ntz"))
    rows.repartition(3, "job_id").write.parquet(f"{root}/in")  # a board's rows are in several files
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    sync.start(stream, stored, f"{root}/checkpoint", grace_days=12).awaitTermination()
    return stored.read().select("job_id", "status", "closed_at", "last_seen", "posted_at")


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors share; on one machine a temporary one if none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/stream-{uuid.uuid4().hex}"
