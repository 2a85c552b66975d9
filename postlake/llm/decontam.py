"""Benchmark decontamination through a positional inverted index of the corpus.

The index holds postings (term, document, position).  A test phrase is looked up
by its rarest terms: their postings are shifted by the term's offset in the
phrase, so that lists that agree on (document, start) intersect, and what is left
is compared word for word in the document.  Only the rarest terms of some phrase
need postings, so the index stays small next to the corpus; term frequencies come
from a count over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import batch_texts, id_of, keyed, with_names, without, written

#: Terms looked up in one pass (8 bytes each, sent to every task); more take more passes.
TERMS_A_PASS = 1_000_000
_FOUND = "k long, h long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,length:long>>"


def _phrases(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                words = tokens.Words(part.column("text"), tokens.ALNUM_FOLDED)
                ids, items, lists = [], [], []
                for i, item in enumerate(part.column("item").to_pylist()):
                    own = words.hashes[words.first[i] : words.first[i + 1]]
                    size = min(window, len(own))
                    starts = np.arange(len(own) - size + 1 if size else 0)
                    if len(starts):
                        ids.append(tokens.Spans(own)(starts, size).view(np.int64))
                        items += [item] * len(starts)
                        lists += [own[s : s + size].view(np.int64).tolist() for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else [], pa.int64()), pa.array(items, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["w", "item", "terms"])

    return run


def phrases(items: DataFrame, window: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The different windows of the items: (w, terms, items); a shorter item is one window."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    each = rows.mapInArrow(_phrases(window), "w long, item string, terms array<long>")
    return each.groupBy("w").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set("item")).alias("items"))


class _Lookup:
    """Finds terms among sorted hashes; most other words fail at a bit table."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms.view(np.uint64))
        self.near = np.zeros(1 << 22, dtype=bool)
        self.near[(self.terms & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known terms, and which terms they are."""
        at = np.flatnonzero(self.near[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.terms, hashes[at]), max(len(self.terms) - 1, 0))
        ok = self.terms[which] == hashes[at] if len(self.terms) else np.zeros(len(at), bool)
        return at[ok], which[ok]


def term_counts(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): how often each of the terms occurs in all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(sent.value)
        counts = np.zeros(len(lookup.terms), np.int64)
        for batch in batches:
            for part in tokens.slices(batch):
                counts += np.bincount(lookup(tokens.Words(part.column("text"), tokens.ALNUM_FOLDED).hashes)[1], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lookup.terms[some].view(np.int64)), pa.array(counts[some])], names=["term", "n"])

    return texts.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index of the terms over texts (k, ord, text): (term, k, ord, pos)."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(sent.value)
        for batch in batches:
            for part in tokens.slices(batch):
                words = tokens.Words(part.column("text"), tokens.ALNUM_FOLDED)
                at, which = lookup(words.hashes)
                row = np.searchsorted(words.first, at, side="right") - 1
                k, order = np.asarray(part.column("k"))[row], np.asarray(part.column("ord"))[row]
                yield pa.RecordBatch.from_arrays([pa.array(lookup.terms[which].view(np.int64)), pa.array(k), pa.array(order), pa.array(at - words.first[row])], names=["term", "k", "ord", "pos"])

    return texts.select("k", "ord", "text").mapInArrow(run, "term long, k long, ord long, pos long")


def _rarest(found: DataFrame, counts: DataFrame, number: int, key: str) -> DataFrame:
    """(key, term, offset) of the terms of each phrase that the corpus has least often."""
    placed = found.select(key, F.posexplode("terms").alias("offset", "term")).join(counts, "term", "left").fillna(0, ["n"])
    return placed.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("n", "term", "offset"))).where(F.col("r") <= number).select(key, "term", "offset")


def _term_blocks(frame: DataFrame) -> list[np.ndarray]:
    """The distinct terms of a frame, dealt by their hashes into blocks of about TERMS_A_PASS."""
    distinct = written(frame.select("term").distinct())
    blocks = -(-distinct.count() // TERMS_A_PASS)
    of = F.pmod(F.xxhash64("term"), F.lit(max(blocks, 1)))
    return [distinct.where(of == b).toPandas()["term"].to_numpy(np.int64) for b in range(blocks)]


def _over_blocks(texts: DataFrame, frame: DataFrame, one_pass) -> DataFrame | None:
    """What a pass over the texts gives for each block of a frame's terms; a pass is sent one block only."""
    frames = [one_pass(texts, terms) for terms in _term_blocks(frame)]
    return reduce(DataFrame.unionByName, frames) if frames else None


def phrase_candidates(texts: DataFrame, found: DataFrame, anchors: int = 2) -> DataFrame | None:
    """(k, ord, start, w) where the rarest terms of a phrase stand at its offsets."""
    counts = _over_blocks(texts, found.select(F.explode("terms").alias("term")), term_counts)
    if counts is None:
        return None
    rare = written(_rarest(found, counts, anchors, "w"))
    met = _over_blocks(texts, rare, postings).join(rare, "term").select("k", "ord", (F.col("pos") - F.col("offset")).alias("start"), "w")
    needed = rare.groupBy("w").agg(F.count("*").alias("needed"))
    agree = met.where("start >= 0").groupBy("k", "ord", "start", "w").agg(F.count("*").alias("lists")).join(needed, "w")
    return agree.where("lists >= needed").select("k", "ord", "start", "w")


def near_matches(docs: DataFrame, items: DataFrame, within: int = 50, terms: int = 4, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Proximity matches: (doc, item, start) where the item's rarest terms all lie within so many words, in any order.

    Items without words match nothing; ties between equally rare terms go to the
    smaller hash, so reruns agree.  Null texts have no words.  A null id is given back
    as null; repeated rows and texts that share an id give a row for each of the
    different texts.  Empty tables give none; other columns are not read.
    """
    texts = keyed(docs, doc_id, text_col)
    whole = phrases(items, 1 << 30, item_id, text_col).select("w", F.array_distinct("terms").alias("terms"), "items")
    counts = _over_blocks(texts, whole.select(F.explode("terms").alias("term")), term_counts)
    if counts is None:
        return texts.select(id_of(F.col("k")).alias(doc_id), F.lit("").alias(item_id), F.lit(0).cast("long").alias("start")).limit(0)
    rare = written(_rarest(whole, counts, terms, "w"))
    met = _over_blocks(texts, rare, postings).join(rare, "term").select("w", "term", "k", "ord", "pos")
    ahead = Window.partitionBy("w", "k", "ord").orderBy("pos").rangeBetween(0, within - 1)
    needed = rare.groupBy("w").agg(F.count("*").alias("needed"))
    near = met.withColumn("got", F.size(F.collect_set("term").over(ahead))).join(needed, "w").where("got >= needed")
    first = near.groupBy("w", "k", "ord").agg(F.min("pos").alias("start")).join(whole.select("w", "items"), "w")
    return first.select(id_of(F.col("k")).alias(doc_id), F.explode("items").alias(item_id), "start")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    for batch in batches:
        for part in tokens.slices(batch):
            words = tokens.Words(part.column("text"), tokens.ALNUM_FOLDED)
            hits, items, spans = np.zeros(part.num_rows, np.int64), [[]] * part.num_rows, [[]] * part.num_rows
            lists, orders = part.column("places"), np.asarray(part.column("ord"))
            for i in np.flatnonzero(np.asarray(lists.is_valid())):
                own = words.hashes[words.first[i] : words.first[i + 1]]
                hit, names = np.zeros(len(own), bool), set()
                for place in lists[int(i)].as_py():
                    terms = np.array(place["terms"], np.int64).view(np.uint64)
                    at = slice(place["start"], place["start"] + len(terms))
                    if place["ord"] == orders[i] and np.array_equal(own[at], terms):
                        hit[at] = True
                        names.update(place["items"])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                hits[i], items[i] = hit.sum(), sorted(names)
                spans[i] = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("h"), pa.array(words.counts), pa.array(hits), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)], names=["k", "h", "n_words", "n_hit", "items", "spans"])


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, per_cent: int = 5, id_col: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Find the windows of benchmark items in documents, word for word.

    Words are runs of ASCII letters, digits and any characters beyond ASCII, A-Z
    lower-cased.  A window is ``window`` consecutive words of an item; a shorter
    item is one window.  Returns one row per input row: the id, n_words, n_hit
    (words inside any occurrence), items (ids as strings, in order), spans (of hit
    words) and contaminated: some word hit, and ``per_cent`` of the words or more.

    Null texts have no words, and items without words match nothing; so does an
    empty benchmark.  A null item id gets no name in items but its words count.
    Rows that repeat a document id are documents of their own.
    Other columns are not read.  Texts and items are read whole.
    """
    out = _hits(docs, benchmark, window, per_cent, id_col, item_id, text_col)
    return out.select(id_of(F.col("k")).alias(id_col), "n_words", "n_hit", "items", "spans", "contaminated")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, per_cent: int, id_col: str, item_id: str, text_col: str) -> DataFrame:
    """What benchmark_hits returns, with k and h (the hash of the text) for the id."""
    batch_texts(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    found = written(phrases(benchmark, window, item_id, text_col))
    candidates = phrase_candidates(texts, found)
    place = "array<struct<ord:long,start:long,terms:array<long>,items:array<string>>>"
    if candidates is None:
        met = texts.withColumn("places", F.lit(None).cast(place))
    else:
        listed = candidates.join(found, "w").groupBy("k", "ord").agg(F.collect_list(F.struct("ord", "start", "terms", "items")).alias("places"))
        met = texts.join(listed, ["k", "ord"], "left")
    out = met.select("k", F.xxhash64("text").alias("h"), "ord", "text", "places").mapInArrow(_verify, _FOUND)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * per_cent))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, per_cent: int = 5, id_col: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, without those that benchmark_hits finds contaminated.

    A text goes wherever it stands under its id, repeated rows all of them; a null id
    is an id like others here, so another text without an id stays.  Null and empty
    texts stay, and all rows do if the benchmark is empty.
    """
    gone = written(_hits(docs, benchmark, window, per_cent, id_col, item_id, text_col).where("contaminated").select("k", "h").distinct())
    return without(with_names(docs, id_col, text_col), gone).select("_row.*")
