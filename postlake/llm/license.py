"""License scans: canonical digests of texts looked up among those of known licences.

Canonical form: A-Z lower-cased, copyright lines left out, everything but letters
and digits a space, equivalent spellings made one, single spaces.  Entire texts
and entire lines are digested and hash-joined to the known digests.  So are runs of words, over line ends or inside a line, that
begin with the first words of a known text and have its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm.common import NO_ID, batch_texts, id_of
from postlake.llm.license_texts import TEXTS

# Names and notices of public licences, and spellings that licence
# texts use for the same word.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: So many first words of a known text are its head.  Shorter texts are found as lines and whole texts only.
HEAD = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COPYRIGHT = r"(^|\n)[\x20\x09]*((copyright|\(c\)|©)[^\n]*|all rights reserved[^\n]*)"
_SEPARATORS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical_lines(text) -> F.Column:
    """The canonical form of a text, line by line; copyright lines and others without words are empty."""
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), _COPYRIGHT, "$1")
    out = F.regexp_replace(out, _SEPARATORS, " ")
    known = rf"(?<![^\x20\n])({'|'.join(a for a, _ in SPELLINGS)})(?![^\x20\n])"
    changed = F.regexp_replace(out, known, "\u0001$1\u0001")
    for a, b in SPELLINGS:
        changed = F.replace(changed, F.lit(f"\u0001{a}\u0001"), F.lit(b))
    fixed = F.when(out.rlike(known), changed).otherwise(out)
    return F.transform(F.split(fixed, "\n"), lambda x: F.trim(x))


def _whole(lines) -> F.Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _words(whole) -> F.Column:
    return F.filter(F.split(whole, " "), lambda x: x != "")


def known_licenses(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(digest, license, n_words, head) of NOTICES and TEXTS, or of a table (license, text); a digest of several licences keeps the first by name."""
    rows = spark.createDataFrame(NOTICES, "license string, text string") if texts is None else texts
    words = rows.where(F.col("text").isNotNull()).select("license", _words(_whole(canonical_lines(F.col("text")))).alias("w"))
    known = words.select(F.sha2(F.array_join("w", " "), 256).alias("digest"), "license", F.size("w").alias("n_words"), F.array_join(F.slice("w", 1, HEAD), " ").alias("head"))
    if texts is None:
        known = known.union(spark.createDataFrame(TEXTS, "license string, head string, n_words int, digest string").select(*known.columns))
    return known.groupBy("digest").agg(*[F.min(x).alias(x) for x in ("license", "n_words", "head")])


def _digested(lengths: dict[str, list[int]]):
    """Rows (k, h, lines, digest) of each line of ``ls`` and each run of words that has a head and one of its lengths."""
    firsts = {x.split(" ")[0] for x in lengths}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, covered, digests = [], [], []
            for row, lines in enumerate(batch.column("ls").to_pylist()):
                found = [([j], sha(x)) for j, x in enumerate(lines or ())]
                words = " ".join(lines or ()).split(" ")
                starts = [i for i, x in enumerate(words) if x in firsts and " ".join(words[i : i + HEAD]) in lengths]
                at = [j for j, x in enumerate(lines) for _ in x.split(" ")] if starts else []
                for i in starts:
                    found += [(sorted(set(at[i : i + n])), sha(" ".join(words[i : i + n]))) for n in lengths[" ".join(words[i : i + HEAD])] if i + n <= len(words)]
                rows += [row] * len(found)
                covered += [x[0] for x in found]
                digests += [x[1] for x in found]
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k").take(row), batch.column("h").take(row), pa.array(covered, pa.list_(pa.int32())), pa.array(digests, pa.string())], names=["k", "h", "lines", "digest"])

    return run


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find documents, lines and passages whose canonical form is a known licence text.

    Returns one row per input row: the id, digest (of the entire canonical text),
    license (the licence that the entire text is, or null), licenses (those of its
    lines and of runs of its words, in order, once each) and n_license_lines (the
    lines that they cover, in whole or in part).

    ``known`` has digest and license; only with n_words and head, as known_licenses
    gives them, are its texts found inside lines and over several lines.

    A null text has a null digest and no licences; a text without words has the
    digest of the empty text.  Null and repeated ids are rows like others, those
    with equal id and text sharing their result.  Other columns are not read.  The
    known digests are joined as Spark sees fit; they may be many.  The different
    pairs of head and n_words go through the driver to all tasks.
    """
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), F.filter(canonical_lines(text), lambda x: x != "").alias("ls"))
    lengths: dict[str, list[int]] = {}
    if {"n_words", "head"} <= set(known.columns):
        for r in known.where(F.col("n_words") >= HEAD).select("head", "n_words").distinct().collect():
            lengths.setdefault(r["head"], []).append(r["n_words"])
    batch_texts(spark)
    digests = rows.mapInArrow(_digested(lengths), "k long, h long, lines array<int>, digest string")
    covered = digests.join(known.select("digest", "license"), "digest").select("k", "h", F.explode("lines").alias("line"), "license")
    found = covered.groupBy("k", "h", "line").agg(F.collect_set("license").alias("some")).groupBy("k", "h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("some")))).alias("licenses"), F.count("*").alias("n_license_lines"))
    whole = rows.select("k", "h", F.sha2(F.array_join("ls", " "), 256).alias("digest")).join(known.select("digest", "license"), "digest", "left")
    out = whole.join(found, ["k", "h"], "left")
    return out.select(id_of(F.col("k")).alias(id_col), "digest", "license", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))


def oracle_sql() -> str:
    """The scan of table documents for NOTICES in DuckDB's SQL: words get a space on either side, so that spellings can be replaced in turn."""
    notices = ", ".join(f"('{name}', '{text}')" for name, text in NOTICES)
    spelled = "concat(' ', replace(x, ' ', '  '), ' ')"
    for a, b in SPELLINGS:
        spelled = f"replace({spelled}, ' {a} ', ' {b} ')"
    return rf"""
WITH raw AS (
  SELECT doc_id, NULL::VARCHAR AS license, text FROM documents
  UNION ALL SELECT NULL, * FROM (VALUES {notices})),
spaced AS (
  SELECT doc_id, license, regexp_replace(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{_COPYRIGHT}', '\1', 'g'), '{_SEPARATORS}', ' ', 'g') AS c FROM raw),
canonical AS (
  SELECT doc_id, license, list_transform(string_split(c, chr(10)), lambda x: trim(replace({spelled}, '  ', ' '), ' ')) AS ls FROM spaced),
digested AS (
  SELECT doc_id, license, sha256(array_to_string(list_filter(ls, lambda x: x <> ''), ' ')) AS digest, list_filter(ls, lambda x: x <> '') AS ls FROM canonical),
known AS (SELECT digest, min(license) AS license FROM digested WHERE license IS NOT NULL GROUP BY digest),
lines AS (SELECT doc_id, sha256(line) AS digest FROM (SELECT doc_id, unnest(ls) AS line FROM digested WHERE license IS NULL)),
found AS (SELECT doc_id, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS licenses, count(*) AS n FROM lines JOIN known k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(f.licenses, '') AS licenses, coalesce(f.n, 0)::BIGINT AS n_license_lines
FROM digested d LEFT JOIN known k USING (digest) LEFT JOIN found f ON f.doc_id = d.doc_id WHERE d.license IS NULL
"""
