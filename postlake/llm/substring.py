"""Substring dedup: repeated word spans through a compacted De Bruijn graph.

The edges of the graph are the runs of ``window`` consecutive words.  Equal edges
share their minimizer, the smallest hash among their ``k``-word parts, so edges
are dealt out by minimizer and consecutive edges of a document with the same
minimizer travel as one piece, about one row for nine words.

* A minimizer that occurs once holds no repeated edge and goes.
* A minimizer with a single distinct piece is a vertex of the compacted graph; an
  arc leads from a piece to the one that directly follows it in a document.  Where
  every occurrence of a vertex is followed by another one, and that one occurs
  nowhere else, neither branches: a join finds these arcs, and the pieces along
  them become one path, each of whose occurrences is one row from then on.
* A minimizer with several pieces is a branch.  Equal pieces are compacted in
  the same way; the first occurrence of each different piece is opened into
  single edges, read again from the source text at its coordinates and compared
  there by two independent hashes.

Pieces are equal by the hash of their words and that of their minimizer.  Every
join is on hashes or places with a pre-aggregated side, and the texts move once,
when spans are cut out of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import batch_texts, id_of, keyed, settled

_ORD = 40  # a place is ord << 40 | word position
_OCC = "m long, u long, k long, at long, n long"
_EDGE = "w1 long, w2 long, k long, at long"
_KEPT = "k long, kept_text string, n_words long, n_removed long, spans array<struct<start:long,length:long>>"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(x) - width + 1], out[width - size :]) if size < width else out


def pieces(first: np.ndarray, hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows of a row whose minimizer is at one place: minimizers, contents, first windows, numbers of windows.

    Windows of one piece differ, as equal windows have their minimizer at equal offsets.
    """
    starts = tokens.run_starts(first, window)
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    spans = tokens.Spans(hashes)
    grams = spans(np.arange(len(hashes) - k + 1), k)
    low = sliding_min(grams, window - k + 1)[starts]
    left = low == grams[starts]  # the first minimum is the window's first part, so the next window has another
    cut = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | left[:-1] | (starts[1:] != starts[:-1] + 1)) | np.isin(starts, first))
    number = np.diff(np.append(cut, len(starts)))
    return low[cut], spans(starts[cut], number + window - 1), starts[cut], number


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _occurrences(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                words = tokens.Words(part.column("text"), tokens.SPACED)
                low, content, starts, number = pieces(words.first, words.hashes, window, k)
                row = np.searchsorted(words.first, starts, side="right") - 1
                at = starts - words.first[row] + (np.asarray(part.column("ord")).astype(np.int64)[row] << _ORD)
                yield pa.RecordBatch.from_arrays([_signed(low), _signed(content), pa.array(np.asarray(part.column("k"))[row]), pa.array(at), pa.array(number)], names=["m", "u", "k", "at", "n"])

    return run


def _places(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and number of the places listed with each text of a slice."""
    lists = part.column("places")
    row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
    flat = lists.flatten()
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    return row, np.asarray(flat.field("at")) & ((1 << _ORD) - 1), np.asarray(flat.field("n"))


def _edges(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                row, at, number = _places(part)
                words = tokens.Words(part.column("text"), tokens.SPACED)
                starts = words.first[row] + at
                starts = np.unique(np.repeat(starts - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum()))
                row = np.searchsorted(words.first, starts, side="right") - 1
                k, order = np.asarray(part.column("k"))[row], np.asarray(part.column("ord"))[row]
                w1, w2 = tokens.Spans(words.hashes)(starts, window), tokens.Spans(words.hashes, salt=0x5EED)(starts, window)
                yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), pa.array(k), pa.array(starts - words.first[row] + (order << _ORD))], names=["w1", "w2", "k", "at"])

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.slices(batch):
            row, at, length = _places(part)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            out = []
            for i, (k, text) in enumerate(zip(part.column("k").to_pylist(), part.column("text").to_pylist(), strict=True)):
                words = tokens.bytes_split(text)
                mine = slice(bounds[i], bounds[i + 1])
                if mine.start == mine.stop:
                    out.append((k, b" ".join(words).decode(), len(words), 0, []))
                    continue
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, at[mine], 1)
                np.add.at(covered, at[mine] + length[mine], -1)
                gone = np.cumsum(covered)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                out.append((k, b" ".join(compress(words, ~gone)).decode(), len(words), int(gone.sum()), spans))
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    types = {"k": pa.int64(), "kept_text": pa.string(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": span}
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def inner_arcs(live: DataFrame) -> DataFrame:
    """(m): heads of arcs that do not branch; live: vertices (m, f, n, c, sums).

    The arc from a vertex to the one at the end of its first occurrence does not
    branch if the places where the first ends are those where the second starts:
    as many, and with the same sum of hashes.  sums holds 32 bits for the starts and
    32 for the ends; sums that agree by chance do no harm, as paths() joins only
    pieces that touch.
    """
    tails = live.select("c", F.col("f.k").alias("k"), (F.col("f.at") + F.col("n")).alias("at"), F.col("sums").bitwiseAND((1 << 32) - 1).alias("sum"))
    heads = live.select("m", "c", "f.k", "f.at", F.shiftrightunsigned("sums", 32).alias("sum"))
    return heads.join(tails, ["k", "at", "c", "sum"]).select("m")


def paths(pieces: DataFrame) -> DataFrame:
    """(k, at, n): n edges from a place; pieces: (k, at, n, opens), those that do not open a path go on with the one they touch."""
    here = Window.partitionBy("k", "ord").orderBy("at", F.desc("opens"))
    touches = F.lag(F.col("at") + F.col("n")).over(here) >= F.col("at")
    rows = pieces.withColumn("ord", F.shiftright("at", _ORD)).withColumn("first", F.when(~F.col("opens") & touches, 0).otherwise(1))
    runs = rows.withColumn("run", F.sum("first").over(here))
    return runs.groupBy("k", "ord", "run").agg(F.min("at").alias("at"), (F.max(F.col("at") + F.col("n")) - F.min("at")).alias("n")).select("k", "at", "n")


def repeated_spans(texts: DataFrame, dealt: DataFrame, window: int, k: int) -> DataFrame:
    """(k, at, n): n words from place at repeat words that start earlier.

    dealt: the texts dealt out by (k, ord), which the caller joins by them as well.
    The occurrences of repeated minimizers are written once, as four paths read them,
    and single edges before the rest, so that their shuffles do not stand side by side.
    """
    occ = texts.mapInArrow(_occurrences(window, k), _OCC)
    place = F.struct("k", "at")
    low = lambda at: F.xxhash64("k", at).bitwiseAND((1 << 32) - 1)
    sums = F.bit_xor(F.shiftleft(low("at"), 32).bitwiseOR(low(F.col("at") + F.col("n"))))
    live = occ.groupBy("m").agg(F.min(place).alias("f"), F.count("*").alias("c"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.min("n").alias("n"), sums.alias("sums"))
    live = settled(live.where("c > 1"))
    inner = inner_arcs(live.where("lo = hi")).withColumn("inside", F.lit(True))
    vertices = live.join(inner, "m", "left").select("m", "f", (F.col("lo") != F.col("hi")).alias("branch"), F.col("inside").isNull().alias("opens"))
    vertices = settled(vertices)  # a plain side lets Spark split a minimizer that a great many documents share
    met = settled(occ.join(vertices, "m"))
    later = (F.col("k") != F.col("f.k")) | (F.col("at") != F.col("f.at"))
    piece = ("k", "at", (F.col("n") + (window - 1)).alias("n"))
    whole = paths(met.where(~F.col("branch") & later).select("k", "at", "n", "opens")).select(*piece)
    forks = met.where("branch").select("m", "u", "k", "at", "n")
    firsts = settled(forks.groupBy("m", "u").agg(F.min(place).alias("f"), F.min("n").alias("n"), F.count("*").alias("c")))
    copies = forks.join(firsts.where("c > 1").select("m", "u", "f"), ["m", "u"]).where(later).select(*piece)
    opened = firsts.groupBy(F.col("f.k").alias("k"), F.shiftright("f.at", _ORD).alias("ord")).agg(F.collect_list(F.struct(F.col("f.at").alias("at"), "n")).alias("places"))
    edges = dealt.join(opened.hint("shuffle_hash"), ["k", "ord"]).select("k", "ord", "text", "places").mapInArrow(_edges(window), _EDGE)
    edges = settled(edges)  # the dealt texts go before edges are shuffled, and edges before paths are
    known = edges.groupBy("w1", "w2").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1")
    single = edges.join(known.select("w1", "w2", "f"), ["w1", "w2"]).where(later).select("k", "at", F.lit(window).cast("long").alias("n"))
    return whole.unionByName(copies).unionByName(settled(single))


def drop_repeated_spans(docs: DataFrame, window: int = 20, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every word that lies in a run of ``window`` words which also starts earlier.

    Earlier means a smaller id, or the same document and a smaller position.
    Returns one row per input row: the id, kept_text (kept words joined by one
    space), n_words, n_removed and spans (start and length of each cut, in words).

    Null and empty texts have no words and give an empty kept_text.  A null id
    counts as smaller than every other.  Rows repeating id and text are one
    document, returned once for each row; different texts under one id come in
    the order of their hashes.  Other columns are not read.  No row is skipped,
    whatever its length.
    """
    if not 0 < k < window:
        raise ValueError("k must be positive and smaller than window")
    batch_texts(docs.sparkSession)
    texts = keyed(docs, id_col, text_col).select("k", "ord", "text")
    dealt = texts.repartition("k", "ord")
    cuts = repeated_spans(texts, dealt, window, k).groupBy("k", F.shiftright("at", _ORD).alias("ord")).agg(F.collect_set(F.struct("at", "n")).alias("places"))
    kept = texts.repartition("k", "ord").join(settled(cuts).hint("shuffle_hash"), ["k", "ord"], "left").select("k", "ord", "text", "places").mapInArrow(_keep, _KEPT)
    return kept.select(id_of(F.col("k")).alias(id_col), "kept_text", "n_words", "n_removed", "spans")
