"""Suffix-array dedup: bytes of long strings that an earlier document has as well, by external induced sorting.

Strings of ``window`` bytes are dealt out by their minimizer, the smallest hash among
their ``gram``-byte parts: equal strings have it in common.  Consecutive strings of a
document with one minimizer travel as a piece, about one for sixteen bytes.

* A minimizer that one document alone holds goes.
* Where all occurrences of a minimizer are one piece, the smallest document that
  holds it holds all of its strings first.
* Other minimizers branch.  One occurrence of each different piece is read at its
  source, and its bytes go to a shard.  Strings whose bytes around the minimizer no
  other piece has are in this piece alone; they stay out of the order.  The
  suffixes of the rest are put in order, with common prefixes, by :mod:`induced`;
  suffixes of a run with ``window`` bytes in common are equal strings, and the
  smallest document of the run has them first.

Pieces are named by 128 bits of two hashes.  Minimizers of very many different
pieces are dealt out once more, by a second minimizer, so no shard has to hold them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import batch_texts, id_of, keyed, settled
from postlake.llm.induced import MEMORY, suffix_order
from postlake.llm.substring import sliding_min

#: Bytes scanned at once; their hashes stay in a core's cache.
_SLICE = 1 << 18
#: Bytes of pieces that are put in order together; a minimizer's pieces stay together.
SHARD_BYTES = 4 << 20
#: Different pieces of a minimizer from which on a second one deals them out.
MANY_PIECES = 20_000
#: Salt of second minimizers.
_SECOND = 0xB0A7
#: Strings of a piece are compared by their surroundings in classes of so many places of the minimizer.
_STEP = 8
_ORD = 40  # a place is ord << 40 | byte position
_MINIMIZER = "m long, k long"
_OCC = "m long, u long, k long, at long, n long"
_PIECE = "g long, m long, u long, lo long, hi long, off long, bytes binary"
_RUN = "m long, u long, off long, n long, lo long"
_KEPT = "k long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>"


def gram_hashes(data: np.ndarray, gram: int, salt: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each ``gram`` consecutive bytes, or of those that start at ``at``."""
    n = max(len(data) - gram + 1, 0) if at is None else len(at)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out, factor = np.full(n, salt, np.uint64), 0x9E3779B97F4A7C15
    for step in [*range(0, gram - 7, 8), *([max(gram - 8, 0)] if gram % 8 else [])]:
        part = eights[step : step + n] if at is None else eights[at + step]
        out += (part & np.uint64((1 << 8 * gram) - 1) if gram < 8 else part) * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 & (2**64 - 1) | 1
    return tokens.mix(out)


_SALTED = tokens.mix(np.arange(256, dtype=np.uint64) ^ np.uint64(0x5EED))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tokens.powers(tokens._Q, n), tokens.powers(tokens._Q_INVERSE, n)


def content_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, as tokens.Spans has them for words."""
    power, inverse = _powers(1 << len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SALTED[data] * power[: len(data)], out=sums[1:])
    return tokens.mix((sums[starts + lengths] - sums[starts]) * inverse[starts] + lengths.astype(np.uint64) * tokens._GOLD)


def pieces(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows of a row with their minimizer at one place: minimizers, first windows, numbers of windows."""
    n = len(data) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(data, gram, salt)
    low = sliding_min(grams, window - gram + 1)
    new = np.ones(n, bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= low[:-1] == grams[: n - 1]  # the first minimum is the window's first part, so the next window has another
    new[offsets[:-1][offsets[:-1] < n]] = True
    cut = np.flatnonzero(new)
    end = offsets[np.searchsorted(offsets, cut, side="right")] - window + 1
    number = np.minimum(np.append(cut[1:], n), end) - cut
    held = number > 0  # others go beyond their row
    return low[cut[held]], cut[held], number[held]


def stretches(text: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """Rows and byte ranges (first row, from, to) to scan at once: whole rows, or parts of a long one that overlap by a window."""
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SLICE, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        for at in range(lo, max(hi, lo + 1), _SLICE if last == row + 1 else max(hi - lo, 1)):
            yield row, at, min(at + _SLICE + window - 1, hi) if last == row + 1 else hi
        row = last


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _scanned(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[tuple]:
    """Batches of texts to their pieces, a stretch at a time: bytes, minimizers, first windows in them, numbers, rows, places in the row."""
    for batch in batches:
        text, offsets = tokens.text_bytes(batch.column("text"))
        for _, lo, hi in stretches(text, offsets, window):
            inner = offsets[(offsets >= lo) & (offsets <= hi)] - lo
            inner = np.unique(np.concatenate(([0], inner, [hi - lo])))
            low, starts, number = pieces(text[lo:hi], inner, window, gram)
            of = np.searchsorted(offsets, starts + lo, side="right") - 1
            yield batch, text[lo:hi], low, starts, number, of, starts + lo - offsets[of]


def _minimizers(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, low, _, _, of, _ in _scanned(batches, window, gram):
            yield pa.RecordBatch.from_arrays([_signed(low), pa.array(np.asarray(batch.column("k"))[of])], names=["m", "k"])

    return run


def _occurrences(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, low, starts, number, of, at in _scanned(batches, window, gram):
            content = content_hashes(data, starts, number + window - 1)
            at = at + (np.asarray(batch.column("ord"))[of] << _ORD)
            yield pa.RecordBatch.from_arrays([_signed(low), _signed(content), pa.array(np.asarray(batch.column("k"))[of]), pa.array(at), pa.array(number)], names=["m", "u", "k", "at", "n"])

    return run


def _slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Stretches of bytes as a binary column."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def second_gram(window: int) -> int:
    """Bytes of the parts of which a second minimizer is one."""
    return max(window // 4, 1)


def _contents(window: int):
    """Texts with the places of pieces first found there to the bytes of these pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in tokens.slices(batch, limit=_SLICE):
                data, offsets = tokens.text_bytes(part.column("text"))
                lists = part.column("places")
                k, order = np.asarray(part.column("k")), np.asarray(part.column("ord"))
                again = (k == np.append(last[0] if last else 0, k[:-1])) & (order == np.append(last[1] if last else -1, order[:-1]))  # a repeated row
                last = int(k[-1]), int(order[-1])
                row = np.repeat(np.arange(len(lists)), np.where(again, 0, np.asarray(lists.value_lengths())))
                flat = lists.filter(pa.array(~again)).flatten()
                m, u, hi, at, n = (np.asarray(flat.field(c)) for c in ("m", "u", "hi", "at", "n"))
                many = np.asarray(flat.field("many"))
                starts, one = offsets[row] + at, np.flatnonzero(~many)
                columns = [m[one], m[one], u[one], k[row[one]], hi[one], np.zeros(len(one), np.int64), _slices(data, starts[one], n[one] + window - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "m", "u", "lo", "hi", "off", "bytes"])
                for i in np.flatnonzero(many).tolist():
                    content = data[starts[i] : starts[i] + n[i] + window - 1]
                    low, first, number = pieces(content, np.array([0, len(content)]), window, second_gram(window), _SECOND)
                    g = (low ^ m[i : i + 1].view(np.uint64)).view(np.int64)
                    same = [pa.array(np.full(len(g), x[i])) for x in (m, u, k[row], hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(g), *same, pa.array(first), _slices(content, first, number + window - 1)], names=["g", "m", "u", "lo", "hi", "off", "bytes"])

    return run


def minimizer_places(data: np.ndarray, starts: np.ndarray, n: np.ndarray, wanted: np.ndarray, window: int, gram: int, salt: int) -> np.ndarray:
    """Where pieces of n windows have the minimizer of all of these; -1 where they have none."""
    grams = gram_hashes(data, gram, salt)
    out, at = np.full(len(starts), -1), starts + n - 1  # the first one in the last window
    live = np.arange(len(starts))
    while len(live):
        hit = grams[at[live]] == wanted[live]
        out[live[hit]] = at[live[hit]]
        live = live[~hit]
        at[live] += 1
        live = live[at[live] <= starts[live] + window - gram]
    return out


def shared_windows(data: np.ndarray, starts: np.ndarray, length: np.ndarray, g: np.ndarray, m: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window but one of each piece that another piece with this g may have as well; equal if none.

    Equal windows have their minimizer at one place.  With that at lo to hi bytes from
    the window's begin, they agree from lo bytes before the minimizer to as many
    behind it as the window has from hi on.
    """
    n = length - window + 1
    begin, end = n.copy(), np.zeros(len(n), np.int64)
    for of, minimizer, size, salt in ((g == m, m, gram, 0), (g != m, g ^ m, second_gram(window), _SECOND)):
        rows = np.flatnonzero(of)
        if not len(rows):
            continue
        place = minimizer_places(data, starts[rows], n[rows], minimizer[rows].view(np.uint64), window, size, salt)
        begin[rows[place < 0]], end[rows[place < 0]] = 0, n[rows[place < 0]]
        rows, place = rows[place >= 0], place[place >= 0]
        for lo in range(0, window - size + 1, _STEP):
            hi = min(lo + _STEP - 1, window - size)
            a = np.maximum(place - hi - starts[rows], 0)
            b = np.minimum(place - lo - starts[rows] + 1, n[rows])
            some = np.flatnonzero(a < b)
            around = gram_hashes(data, window - hi + lo, at=place[some] - lo)
            around = tokens.mix(around ^ g[rows[some]].view(np.uint64))
            by = np.argsort(around)
            equal = around[by[1:]] == around[by[:-1]]
            shared = some[np.unique(np.concatenate([by[1:][equal], by[:-1][equal]]))]
            begin[rows[shared]] = np.minimum(begin[rows[shared]], a[shared])
            end[rows[shared]] = np.maximum(end[rows[shared]], b[shared])
    return np.minimum(begin, end), end


def shard_runs(m: np.ndarray, u: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: np.ndarray, data: np.ndarray, starts: np.ndarray, length: np.ndarray, window: int, memory: int = MEMORY) -> list[np.ndarray]:
    """Columns (m, u, off, n, lo): stretches of the pieces' strings by the smallest document that has them, where it is below ``hi``.

    lo and hi are the smallest and the largest document of each piece.
    """
    first = np.append(0, np.cumsum(length + 1))
    text = data[np.minimum(np.repeat(starts - first[:-1], length + 1) + np.arange(first[-1]), len(data) - 1)]
    text = np.append(text + np.uint8(2), np.uint8(0))  # no byte of UTF-8 is above 0xF4
    first = first[:-1]
    text[first + length] = 1  # a piece ends
    order, prefix = suffix_order(text, 256, memory, window)
    piece = np.append(np.repeat(np.arange(len(length)), length + 1), len(length) - 1)
    place = np.arange(len(text)) - first[piece]
    run = np.cumsum(prefix < window)
    whole = (place + window <= length[piece])[order]
    order, run = order[whole], run[whole]
    heads = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else np.zeros(0, np.int64)
    least, size = np.minimum.reduceat(lo[piece[order]], heads) if len(heads) else lo[:0], np.diff(np.append(heads, len(run)))
    at, least = order, np.repeat(least, size)
    later = least < hi[piece[at]]
    at, least = at[later], least[later]
    by = np.argsort(at)
    at, least = at[by], least[by]
    new = np.append(True, (np.diff(at) != 1) | (np.diff(least) != 0) | (np.diff(piece[at]) != 0)) if len(at) else np.zeros(0, bool)
    cut = np.flatnonzero(new)
    of = piece[at[cut]]
    return [m[of], u[of], off[of] + place[at[cut]], np.diff(np.append(cut, len(at))), least[cut]]


def first_strings(g: np.ndarray, m: np.ndarray, u: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: np.ndarray, contents: pa.Array, window: int, gram: int) -> list[np.ndarray]:
    """As shard_runs(), of all strings of the pieces; those of one piece alone are not sorted."""
    starts = np.frombuffer(contents.buffers()[1], np.int32)[contents.offset : contents.offset + len(contents) + 1].astype(np.int64)
    data = np.frombuffer(contents.buffers()[2], np.uint8)
    starts, length = starts[:-1], np.diff(starts)
    begin, end = shared_windows(data, starts, length, g, m, window, gram)
    n, copied = length - window + 1, lo < hi
    out = []
    for a, b in ((np.zeros(len(n), np.int64), begin), (end, n)):
        alone = np.flatnonzero(copied & (a < b))
        out.append([m[alone], u[alone], off[alone] + a[alone], (b - a)[alone], lo[alone]])
    rest = np.flatnonzero(begin < end)
    if len(rest):
        begin, end = begin[rest], end[rest]
        out.append(shard_runs(m[rest], u[rest], lo[rest], hi[rest], off[rest] + begin, data, starts[rest] + begin, end - begin + window - 1, window))
    return [np.concatenate(column) for column in zip(*out, strict=True)]


def _sorted_shards(window: int, gram: int, shard_bytes: int):
    """Pieces in the order of g to runs, a shard at a time; a shard ends between two values of g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            g, m, u, lo, hi, off = (whole.column(c).to_numpy() for c in ("g", "m", "u", "lo", "hi", "off"))
            columns = first_strings(g, m, u, lo, hi, off, pa.concat_arrays(whole.column("bytes").chunks), window, gram)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["m", "u", "off", "n", "lo"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.asarray(batch.column("g"))
            changes = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy()))
            begun = 0
            for lo, hi in zip(changes, changes[1:], strict=False):
                fresh = lo > 0 or not held or held[-1].column("g")[-1].as_py() != g[0]
                if fresh and size + ends[lo] - ends[begun] >= shard_bytes:
                    if lo > begun:
                        held.append(batch.slice(begun, lo - begun))
                    yield shard()
                    held, size, begun = [], 0, lo
            held.append(batch.slice(begun))
            size += int(ends[-1] - ends[begun])
        if size:
            yield shard()

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.slices(batch, limit=_SLICE):
            data, offsets = tokens.text_bytes(part.column("text"))
            lists = part.column("places")
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
            flat = lists.flatten()
            at = np.asarray(flat.field("at")) if len(flat) else np.zeros(0, np.int64)
            starts, ends = merged(offsets[row] + at, np.asarray(flat.field("n")) if len(flat) else at, row)
            of = np.searchsorted(offsets, starts, side="right") - 1
            gone = np.zeros(len(data) + 1, np.int8)
            gone[starts] += 1
            gone[ends[ends < len(data)]] -= 1
            kept = np.cumsum(gone[:-1], dtype=np.int8) == 0
            left = np.append(0, np.cumsum(kept))[offsets]
            removed = np.diff(offsets) - np.diff(left)
            spans = pa.StructArray.from_arrays([pa.array(starts - offsets[of]), pa.array(ends - starts)], names=["start", "length"])
            cuts = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)), pa.int32()), spans)
            texts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[kept])])
            yield pa.RecordBatch.from_arrays([part.column("k"), texts, pa.array(np.diff(offsets)), pa.array(removed), cuts], names=["k", "kept", "n_bytes", "n_removed", "spans"])


def merged(at: np.ndarray, n: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of stretches of a row that overlap or touch; rows do not."""
    by = np.argsort(at, kind="stable")
    at, end, row = at[by], (at + n)[by], row[by]
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.append(True, (at[1:] > reach[:-1]) | (row[1:] != row[:-1])) if len(at) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return at[heads], reach[np.append(heads[1:], len(at)) - 1] if len(at) else at


def earlier_spans(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(k, ord, at, n): n bytes of a text whose strings of ``window`` bytes all start in a text with a smaller k."""
    seen = texts.mapInArrow(_minimizers(window, gram), _MINIMIZER)
    live = settled(seen.groupBy("m").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("m"))
    occ = texts.mapInArrow(_occurrences(window, gram), _OCC)
    met = settled(occ.join(live, "m"), hash_joins=True)  # a plain side lets Spark split a minimizer that a great many documents share
    contents = met.groupBy("m", "u").agg(F.min("k").alias("lo"), F.min_by("at", "k").alias("at"), F.max("k").alias("hi"), F.min("n").alias("n"))
    contents = settled(contents.withColumn("v", F.count("*").over(Window.partitionBy("m"))))
    alone = contents.where("v = 1 AND lo < hi").select("m", "u", F.lit(0).cast("long").alias("off"), "n", "lo")
    reads = F.struct(F.col("at").bitwiseAND((1 << _ORD) - 1).alias("at"), "n", "m", "u", "hi", (F.col("v") > MANY_PIECES).alias("many"))
    reads = contents.where("v > 1").groupBy(F.col("lo").alias("k"), F.shiftright("at", _ORD).alias("ord")).agg(F.collect_list(reads).alias("places"))
    dealt = settled(texts.join(reads, ["k", "ord"]).select("k", "ord", "text", "places").mapInArrow(_contents(window), _PIECE))
    shards = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_sorted_shards(window, gram, SHARD_BYTES), _RUN)
    runs = settled(alone.unionByName(shards))
    strings = met.select("m", "u", "k", "at").join(runs, ["m", "u"]).where("k > lo")
    return strings.select("k", F.shiftright("at", _ORD).alias("ord"), (F.col("at").bitwiseAND((1 << _ORD) - 1) + F.col("off")).alias("at"), (F.col("n") + (window - 1)).alias("n"))


def drop_earlier_bytes(docs: DataFrame, window: int = 50, gram: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every byte that lies in ``window`` bytes which also start in a document with a smaller id.

    Returns one row per input row: the id, kept (the remaining UTF-8 bytes, which may
    begin or end inside a character), n_bytes, n_removed and spans (start and
    length of each maximal run cut, in bytes).  Strings do not go beyond their
    document and are judged on the input.

    Null and empty texts have no bytes.  A null id is smaller than every other and
    equal to other null ids; rows of one id, repeated or with different texts, do
    not cut each other.  Texts of any length are read whole, long ones in parts that
    overlap.  Other columns are not read.  An empty table gives none.
    """
    if not 0 < gram < window:
        raise ValueError("gram must be positive and smaller than window")
    batch_texts(docs.sparkSession)
    texts = keyed(docs, id_col, text_col).select("k", "ord", "text")
    cuts = earlier_spans(texts, window, gram).groupBy("k", "ord").agg(F.collect_set(F.struct("at", "n")).alias("places"))
    kept = texts.join(settled(cuts, hash_joins=True), ["k", "ord"], "left").select("k", "text", "places").mapInArrow(_keep, _KEPT)
    return kept.select(id_of(F.col("k")).alias(id_col), "kept", "n_bytes", "n_removed", "spans")
