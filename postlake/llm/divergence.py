"""Source divergence audit: how far each source's use of terms is from the other sources of its language.

Texts are factored into chunks, the runs between ASCII white space.  A task holds some
megabytes of documents at a time, tokenizes each of their chunks once and joins the
terms back to the documents that hold the chunk, so counts of documents are exact.  It
adds them up by language, source and term before anything is shuffled; a term's counts
then meet in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import batch_texts, settled

#: Bytes of terms, a-z for A-Z: ASCII letters and all bytes beyond ASCII; blanks for others, so no term goes beyond its chunk.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[65:91] = _LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
#: Fresh counts handed on at once, and bytes of texts that a task holds to add their counts up.
_FRESH, _HELD = 20_000, 16 << 20
#: Cells (sources x terms) of a block in which all pairs of sources are compared.
_CELLS = 1_000_000
_COUNTED = "lang string, source string, term string, n_docs long, n long"


def _terms(chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The terms of chunks, and whose each is."""
    data, offsets = tokens.text_bytes(chunks)
    words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(chunks), [None, pa.py_buffer(offsets), pa.py_buffer(_LETTERS[data])]))
    of, terms = pc.list_parent_indices(words), pc.list_flatten(words)
    held = pc.greater(pc.binary_length(terms), 0)
    return np.asarray(of.filter(held)), terms.filter(held)


def _counted(text: pa.Array, group: np.ndarray) -> pa.RecordBatch:
    """Documents and their groups to (group, term, n_docs, n)."""
    words = pc.ascii_split_whitespace(text)
    chunks = pc.list_flatten(words).dictionary_encode()
    chunk, terms = _terms(chunks.dictionary)
    terms = terms.dictionary_encode()
    code, width = np.asarray(chunks.indices), max(len(terms.dictionary), 1)
    first = np.searchsorted(chunk, np.arange(len(chunks.dictionary) + 1))
    size = np.diff(first)[code]
    at = np.repeat(first[code] - np.cumsum(size) + size, size) + np.arange(size.sum())
    row = np.repeat(np.asarray(pc.list_parent_indices(words)).astype(np.int64), size)
    held, times = np.unique(row * width + np.asarray(terms.indices)[at], return_counts=True)  # a term in a document
    keys = group[held // width] * width + held % width
    by = np.argsort(keys)
    keys, times = keys[by], times[by]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    n = np.add.reduceat(times, heads) if len(heads) else times
    keys = keys[heads]
    term = terms.dictionary.take(pa.array(keys % width)).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(keys // width), term, pa.array(np.diff(np.append(heads, len(by)))), pa.array(n)], names=["group", "term", "n_docs", "n"])


def _held(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``limit`` bytes together, or a single longer one."""
    held, size = [], 0
    for batch in batches:
        for part in tokens.slices(batch, limit=limit):
            if held and size + part.nbytes > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def _counts(limit: int, rows: int):
    """Rows (lang, source, text) to counts of terms, added up over the documents held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _held(batches, limit):
            codes: dict[tuple[str, str], int] = {}
            of = [codes.setdefault(x, len(codes)) for x in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)]
            langs, sources = (pa.array(x, pa.string()) for x in zip(*codes, strict=True))
            counted = _counted(part.column("text"), np.array(of, np.int64))
            for at in range(0, len(counted), rows):
                batch = counted.slice(at, rows)
                group = batch.column("group")
                yield pa.RecordBatch.from_arrays([langs.take(group), sources.take(group), *batch.columns[1:]], names=["lang", "source", *batch.schema.names[1:]])
            del counted
            pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return run


def term_counts(docs: DataFrame, min_docs: int = 3, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, count, whole, leads) of the terms that at least ``min_docs`` documents of the language hold.

    whole is the count in the language, leads marks one of a term's rows there.  Each
    row is a document, whatever its id.  Null texts, languages and sources are empty
    ones.  min_docs is 1, 2 or 3.
    """
    if min_docs not in (1, 2, 3):
        raise ValueError("min_docs is 1, 2 or 3")
    batch_texts(docs.sparkSession)
    plain = lambda c, name: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(name)
    rows = docs.select(plain(lang_col, "lang"), plain(source_col, "source"), plain(text_col, "text"))
    counts = rows.mapInArrow(_counts(_HELD, _FRESH), _COUNTED).repartition("term", "lang")  # all rows of a term in one place: one for each source and each time of holding texts at most
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("count"), F.sum("n_docs").alias("docs"))
    whole = Window.partitionBy("term", "lang")  # a row for each source
    counts = counts.select("lang", "source", "term", "count", F.sum("docs").over(whole).alias("docs"), F.sum("count").over(whole).alias("whole"), (F.col("source") == F.min("source").over(whole)).alias("leads"))
    return counts.where(F.col("docs") >= min_docs).drop("docs")


def _share(scale: int, smoothing: int, count: Column, total: str = "total") -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * terms)), exactly."""
    over = F.lit(scale).cast("decimal(12,0)") * (count + smoothing).cast("decimal(19,0)")
    under = (F.col(total) + F.col("terms") * smoothing).cast("decimal(19,0)")
    return F.when(under > 0, 1 + F.call_function("div", over, under))


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """All ordered pairs of the sources in one block of terms; rows without a term give a source's share of terms that it lacks."""
    sources = np.sort(pdf.loc[pdf.term.isna(), "source"].to_numpy(dtype=object))
    at = {s: i for i, s in enumerate(sources)}
    absent = np.ones(len(sources), np.int64)
    none = pdf[pdf.term.isna()]
    absent[[at[s] for s in none.source]] = none.p.fillna(1).to_numpy(np.int64)
    held = pdf[pdf.term.notna()]
    terms, column = np.unique(held.term.to_numpy(dtype=object), return_inverse=True)
    shares = np.repeat(absent[:, None], len(terms), axis=1)
    shares[[at[s] for s in held.source], column] = held.p.to_numpy(np.int64)
    out = []
    for i, source in enumerate(sources):
        value = ((shares[i] - shares) ** 2 // shares).sum(axis=1)
        rest = np.arange(len(sources)) != i
        out.append(pd.DataFrame({"lang": pdf.lang.iloc[0], "source": source, "item": sources[rest], "value": value[rest]}))
    return pd.concat(out)


def source_divergence(docs: DataFrame, min_docs: int = 3, most_terms: int = 200, scale: int = 1_000_000_000, smoothing: int = 1, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Which sources of a language differ, and by which terms: rows (lang, source, part, item, value, rank).

    A term's share is 1 + floor(scale (count + smoothing) / (N + smoothing V)), over
    the language's V kept terms, also those that a source lacks; its part of the
    divergence of shares p from q is floor((p - q)^2 / q).  Part ``pair`` has every
    other source of the language with the sum over all kept terms; part ``term`` the
    ``most_terms`` terms that a source uses more than its language as a whole.
    Ranks go by value, ties by the item's bytes.

    Terms are lower-cased runs of letters.  Null texts, languages and sources are
    empty ones; a source without terms is compared as well; an only source has no
    pairs.  Each row counts as a document, repeated ones too.  An empty table gives
    none.  Other columns are not read.

    The pairs are as many as the result asks for, compared in blocks of terms; the
    terms of one source are ranked in two steps, by task and then overall.
    """
    counts = settled(term_counts(docs, min_docs, lang_col, source_col, text_col))
    plain = lambda c, name: F.coalesce(docs[f"`{c}`"].cast("string"), F.lit("")).alias(name)
    groups = docs.select(plain(lang_col, "lang"), plain(source_col, "source")).distinct()
    langs = counts.groupBy("lang").agg(F.sum("count").alias("whole_total"), F.count_if("leads").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = settled(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "whole_total", "terms")]))
    widths = groups.groupBy("lang").agg(F.ceil(F.count("*") * F.max("terms") / _CELLS).cast("int").alias("blocks"))
    groups = groups.join(widths, "lang").withColumn("blocks", F.greatest("blocks", F.lit(1)))
    p, q = _share(scale, smoothing, F.col("count")), _share(scale, smoothing, F.col("whole"), "whole_total")
    shares = settled(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"), F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")))
    absent = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), _share(scale, smoothing, F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = shares.drop("q").unionByName(absent).groupBy("lang", "block").applyInPandas(_compared, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    excess = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))
    terms = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), F.call_function("div", excess, F.col("q")).alias("value"), F.lit("term").alias("part"))
    first = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(first))
    out = ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= most_terms))
    return out.select("lang", "source", "part", "item", "value", "rank")
