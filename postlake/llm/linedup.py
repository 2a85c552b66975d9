"""Line dedup with a log-template tree, in DataFrame functions only.

Lines are parsed as logs are: a fixed-depth tree sends a line to a leaf by its
number of words and its first words, words with digits being variable from the
start.  Within a leaf a word is a constant of its position if enough lines of
different documents have it there, and a variable field otherwise; constants and
<*> for fields make the line's template.  A template that recurs in enough
documents is boilerplate: its lines go, but for the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import NO_ID, id_of, written

FIELD = "<*>"
_WORD = r"[^\x20\x09-\x0D]"


def masked_lines(text) -> F.Column:
    """The lines of a text with single spaces, and <*> for words with digits."""
    masked = F.regexp_replace(text, rf"(?<!{_WORD})[^\x20\x09-\x0D0-9]*+[0-9]{_WORD}*+", FIELD)  # a word is looked at once, whatever its length
    spaced = F.regexp_replace(masked, r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(spaced, "\n"), lambda x: F.trim(x))


def _leaf(line, depth: int) -> F.Column:
    words = F.split(line, " ")
    return F.xxhash64(F.size(words), F.array_join(F.slice(words, 1, depth), " "))


#: Up to this many places of lines (16 bytes each) are broadcast; beyond, the texts are shuffled to them.
FEW_PLACES = 1_000_000


def _met(texts: DataFrame, places: DataFrame, number: int, how: str) -> DataFrame:
    """Texts (k, h, text) with what a written frame has of their (k, h), number places in all."""
    return texts.join(F.broadcast(places) if number <= FEW_PLACES else places, ["k", "h"], how)


def _parsed(texts: DataFrame, depth: int) -> DataFrame:
    """(k, h, leaf, m, at, ats) of the different masked lines of each text: m the line's hash, at the first of its places."""
    lines = texts.where("text is not null").select("k", "h", F.posexplode(masked_lines(F.col("text"))).alias("at", "line")).where("line <> ''")
    lines = lines.select("k", "h", "at", _leaf(F.col("line"), depth).alias("leaf"), F.xxhash64("line").alias("m"))
    return lines.groupBy("k", "h", "leaf", "m").agg(F.collect_set("at").alias("ats"), F.min("at").alias("at"))


def _templates(texts: DataFrame, each: DataFrame, depth: int, least_docs: int, constant: float) -> DataFrame:
    """(leaf, m, template) of all masked lines of leaves with several documents.

    Only lines of leaves that hold several different ones are read again, each from
    one document.  The alone in its leaf is its own template, as the words of its
    positions don't vary.
    """
    kinds = written(each.groupBy("leaf", "m").agg(F.count("*").alias("docs"), F.min(F.struct("k", "h", "at")).alias("one")))
    varied = kinds.groupBy("leaf").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo <> hi").select("leaf")
    wanted = written(kinds.join(varied, "leaf").groupBy("one.k", "one.h").agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "leaf", "m", "docs")).alias("wanted")))
    number = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
    read = _met(texts, wanted, number, "inner").withColumn("lines", masked_lines(F.col("text")))
    words = read.select("lines", F.explode("wanted").alias("x")).select("x.leaf", "x.m", "x.docs", F.split(F.col("lines")[F.col("x.at")], " ").alias("words"))
    words = written(words.dropDuplicates(["leaf", "m"]))
    plain = F.size(F.filter(F.slice("words", 1, depth), lambda w: w != FIELD))
    placed = F.filter(F.transform(F.col("words"), lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda x: (x["p"] >= depth) & (x["w"] != FIELD))
    each_word = words.select("leaf", "m", "docs", F.explode(placed).alias("x")).select("leaf", "m", "docs", F.xxhash64("leaf", "x.p", "x.w").alias("g"))
    constants = each_word.groupBy("g").agg(F.sum("docs").alias("d")).where(F.col("d") >= least_docs).select("g")
    fixed = each_word.join(constants, "g").groupBy("leaf", "m").agg(F.count("*").alias("c"), F.bit_xor("g").alias("all"))
    shaped = words.select("leaf", "m", plain.alias("plain"), F.size("words").alias("n")).join(fixed, ["leaf", "m"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    general = shaped.where((F.col("plain") + F.col("c")) / F.col("n") >= constant).select("leaf", "m", F.xxhash64("leaf", "c", F.coalesce("all", F.lit(0))).alias("template"))
    return kinds.select("leaf", "m").join(general, ["leaf", "m"], "left").select("leaf", "m", F.coalesce("template", F.xxhash64("m", "leaf")).alias("template"))


def drop_template_lines(docs: DataFrame, depth: int = 3, least_docs: int = 3, constant: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose template recurs in ``least_docs`` documents or more, except its first occurrence.

    A leaf is the number of words of a line and its first ``depth`` words.  At
    other positions a word is constant if ``least_docs`` (document, masked line)
    pairs of the leaf have it there.  A line with a smaller share of constant
    words than ``constant`` (the first ``depth`` included) is its own template.
    First means the smallest id, then the first line.

    Returns one row per input row: the id, kept_text (kept lines joined by line
    feeds), n_lines and n_dropped.  Lines without words always stay.  A null text
    has no lines and a null kept_text; an empty one has one empty line.  A null id
    counts as smaller than every other.  Rows that repeat id and text are one
    document, returned once for each row; different texts of one id are
    documents of their own, in the order of their hashes.  A text of any length is
    parsed whole.  Other columns are not read.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    parsed = written(_parsed(texts, depth))
    live = parsed.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") >= least_docs).select("leaf")
    each = written(parsed.join(live, "leaf"))
    told = written(each.join(_templates(texts, each, depth, least_docs, constant), ["leaf", "m"]).select("k", "h", "template", "at", "ats"))
    documents = told.groupBy("template", "k", "h").agg(F.min("at").alias("at"))
    recurring = documents.groupBy("template").agg(F.count("*").alias("c"), F.min(F.struct("k", "h", "at")).alias("first")).where(F.col("c") >= least_docs)
    gone = told.drop("at").join(recurring.select("template", "first"), "template").withColumn("at", F.explode("ats"))
    gone = written(gone.where(F.struct("k", "h", "at") != F.col("first")).groupBy("k", "h").agg(F.collect_set("at").alias("gone")))
    number = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    met = _met(texts, gone, number, "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return met.select(id_of(F.col("k")).alias(id_col), kept.alias("kept_text"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


#: The same in DuckDB's SQL for table documents, with depth 3, 3 documents and half of the words.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, trim(list_extract(ls, i + 1), ' ') AS line FROM (
    SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)) AS ls
      FROM documents WHERE text IS NOT NULL))),
parsed AS (
  SELECT doc_id, pos, line, string_split(line, ' ') AS ws FROM lines WHERE line <> ''),
keyed AS (
  SELECT doc_id, pos, line, ws, concat(len(ws), ' ', array_to_string(ws[1:3], ' ')) AS leaf FROM parsed),
pairs AS (SELECT DISTINCT doc_id, leaf, line FROM keyed),
live AS (SELECT leaf FROM pairs GROUP BY leaf HAVING count(*) >= 3),
kinds AS (SELECT leaf, line, count(*) AS docs FROM pairs JOIN live USING (leaf) GROUP BY leaf, line),
words AS (SELECT leaf, line, docs, p, string_split(line, ' ')[p + 1] AS word FROM (SELECT leaf, line, docs, unnest(range(len(string_split(line, ' ')))) AS p FROM kinds)),
constants AS (SELECT leaf, p, word FROM words GROUP BY leaf, p, word HAVING sum(docs) >= 3 OR p < 3),
marked AS (SELECT w.leaf, w.line, w.p, w.word, (c.word IS NOT NULL AND w.word <> '<*>') AS fixed FROM words w LEFT JOIN constants c ON w.leaf = c.leaf AND w.p = c.p AND w.word = c.word),
templates AS (
  SELECT leaf, line, CASE WHEN avg(fixed::INT) >= 0.5 THEN concat('T ', string_agg(CASE WHEN fixed THEN word ELSE '<*>' END, ' ' ORDER BY p)) ELSE concat('L ', line) END AS template
  FROM marked GROUP BY leaf, line),
told AS (SELECT k.doc_id, k.pos, t.template FROM keyed k JOIN templates t USING (leaf, line)),
recurring AS (
  SELECT template, min(doc_id) AS first_doc FROM (SELECT DISTINCT doc_id, template FROM told) GROUP BY template HAVING count(*) >= 3),
firsts AS (SELECT r.template, r.first_doc, min(t.pos) AS first_at FROM recurring r JOIN told t ON t.template = r.template AND t.doc_id = r.first_doc GROUP BY ALL),
gone AS (SELECT DISTINCT t.doc_id, t.pos FROM told t JOIN firsts f USING (template) WHERE t.doc_id <> f.first_doc OR t.pos <> f.first_at),
lists AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id),
split AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS ls, l.ats FROM documents d LEFT JOIN lists l USING (doc_id))
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(len(ats), 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN ats IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(ats, i)), lambda i: ls[i + 1]), chr(10)) END) AS kept_sha256
FROM split
"""
