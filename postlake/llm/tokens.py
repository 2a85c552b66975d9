"""Vectorised word scanning and hashing over Arrow text columns.

Everything here runs inside Spark tasks on one slice of rows at a time.  Words
are runs of bytes of an :class:`Alphabet`; every alphabet treats bytes from 0x80
up as word bytes, so UTF-8 text can be scanned without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer document is scanned in pieces.
SLICE_BYTES = 2 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Alphabet:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    def __init__(self, words: np.ndarray, fold_case: bool):
        self.is_word = words
        self.fold = None
        if fold_case:
            self.fold = np.arange(256, dtype=np.uint8)
            self.fold[65:91] += 32


def _spaces() -> np.ndarray:
    words = np.ones(256, dtype=bool)
    words[[0x20, *range(0x09, 0x0E)]] = False
    return words


def _alphanumerics() -> np.ndarray:
    words = np.zeros(256, dtype=bool)
    words[0x30:0x3A] = words[0x41:0x5B] = words[0x61:0x7B] = words[0x80:] = True
    return words


#: Words are what ASCII white space separates.
SPACED = Alphabet(_spaces(), fold_case=False)
SPACED_FOLDED = Alphabet(_spaces(), fold_case=True)
#: Words are ASCII letters and digits, and all characters beyond ASCII.
ALNUM_FOLDED = Alphabet(_alphanumerics(), fold_case=True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text each."""
    text = batch.column(column)
    if not len(text):
        return
    _, offsets = text_bytes(text)
    lo = 0
    while lo < len(text):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(text))
        yield batch.slice(lo, hi - lo)
        lo = hi


def strings(text: pa.Array) -> pa.Array:
    """The column with nulls as empty strings."""
    return text.fill_null("") if text.null_count else text


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 row offsets; null rows are empty."""
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice: ``hashes`` of all rows, those of row i being ``[first[i], first[i + 1])``."""

    def __init__(self, text: pa.Array, alphabet: Alphabet, spans: bool = False):
        data, offsets = text_bytes(text)
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(data):
            to = min(at + SLICE_BYTES, len(data))
            if to < len(data):  # end the piece where a row ends, or else between words
                row_end = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
                to = row_end if row_end > at else _next_gap(data, to, alphabet, int(offsets[np.searchsorted(offsets, at, side="right")]))
            s, e, h = _scan(data[at:to], offsets[(offsets >= at) & (offsets < to)] - at, alphabet)
            starts.append(s + at)
            if spans:
                ends.append(e + at)
            hashes.append(h)
            at = to
        empty = np.zeros(0, np.int64)
        self.offsets = offsets
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        self.hashes = np.concatenate(hashes) if hashes else empty.astype(np.uint64)
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _next_gap(data: np.ndarray, at: int, alphabet: Alphabet, end: int) -> int:
    while at < end:
        gap = np.flatnonzero(~alphabet.is_word[data[at : min(at + 4096, end)]])
        if len(gap):
            return at + int(gap[0])
        at += 4096
    return end


def _scan(data: np.ndarray, row_starts: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = alphabet.is_word[data]
    edge = inside[1:] != inside[:-1]  # edge[i]: a word starts or ends before byte i
    begins, stops = edge[:-1] & inside[1:-1], edge[1:] & inside[1:-1]
    row_starts = row_starts[row_starts < len(data)]
    begins[row_starts] = inside[row_starts + 1]
    stops[row_starts[row_starts > 0] - 1] = inside[row_starts[row_starts > 0]]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, hash_words(data, starts, ends - starts, alphabet)


_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def hash_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Hash each word eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = alphabet.fold[data] if alphabet.fold is not None else data
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    out = mix(lengths.astype(np.uint64) * _GOLD + (eights[starts] & _MASKS[np.minimum(lengths, 8)]))
    longer, at = np.flatnonzero(lengths > 8), 8
    while len(longer):
        rest = np.minimum(lengths[longer] - at, 8)
        out[longer] = mix(out[longer] * _BASE + (eights[starts[longer] + at] & _MASKS[rest]) + np.uint64(1))
        at += 8
        longer = longer[lengths[longer] > at]
    return out


_Q = 0xA0761D6478BD642F
_Q_INVERSE = pow(_Q, -1, 1 << 64)


class Spans:
    """Hashes of any run of consecutive words, from prefix sums."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        n = len(hashes)
        self.inverse = powers(_Q_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        salted = mix(hashes ^ np.uint64(salt)) if salt else hashes
        np.cumsum(salted * powers(_Q, n), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, lengths) -> np.ndarray:
        raw = (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + np.asarray(lengths).astype(np.uint64) * _GOLD)


def run_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k consecutive words of one row start."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return np.repeat(first[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())


def bytes_split(text: str | None) -> list[bytes]:
    """The words of the SPACED alphabet: bytes.split() splits at 0x20 and 0x09-0x0D."""
    return text.encode().split() if text else []
