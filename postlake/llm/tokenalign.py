"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often a pair of ids does so.

Token ends are byte offsets in ascending order.  Of a document's two lists of
ends the shorter one drives a galloping search (doubling steps, then a binary
search) through the longer; the common indices cut both lists into groups, and
differences of ranks say which tokens of a group overlap.  How many documents hold
an id pair is counted over the corpus and joined back: the pairs that make up more
than a hundred-thousandth of all rows are at most a hundred thousand and are
broadcast, all others are joined by a shuffle in which none is frequent.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import batch_texts, settled

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SLICE = 1 << 20
#: Of this many parts of all pair rows a frequent pair has one at least, so there are no more of them than that.
_FREQUENT = 100_000
_ID_BITS = 20
_ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """Encoder of a byte-level vocabulary and the bytes of each id; ids are merge ranks, and special tokens are plain text."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {x["content"] for x in vocabulary["added_tokens"]}
    byte = _byte_level()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
    spelt = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        spelt[i] = token
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), spelt


@lru_cache(maxsize=2)
def piece_bpe(path: str):
    """Encoder of a sentence-piece model and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]


#: Of so many ends of the shorter list the first one gallops; the others then lie between two known places.
_STRIDE = 16


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in a and in b of the values that both ascending lists hold; the shorter one gallops through the longer."""
    if len(a) > len(b):
        at_b, at_a = common_ends(b, a)
        return at_a, at_b
    n, view = len(b), memoryview(b)
    places, lo = [], 0
    for x in a[::_STRIDE].tolist():
        step, hi = 1, lo
        while hi < n and view[hi] < x:
            lo, hi, step = hi + 1, hi + step, step * 2
        lo = bisect_left(view, x, lo, min(hi, n))
        places.append(lo)
    lower = np.repeat(np.array(places, np.int64), _STRIDE)[: len(a)]
    upper = np.repeat(np.array([*places[1:], n], np.int64), _STRIDE)[: len(a)]
    while (lower < upper).any():
        middle = (lower + upper) >> 1
        less = (lower < upper) & (b[np.minimum(middle, n - 1)] < a)
        lower, upper = np.where(less, middle + 1, lower), np.where(less, upper, np.minimum(middle, upper))
    both = np.flatnonzero((lower < n) & (b[np.minimum(lower, n - 1)] == a)) if n else np.zeros(0, np.int64)
    return both, lower[both]


class Spelling:
    """The bytes of ids, as one array."""

    def __init__(self, spelt: list[bytes]):
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.length = np.array(list(map(len, spelt)))
        self.first = np.append(0, np.cumsum(self.length)[:-1])

    def ends(self, ids: np.ndarray, raw: np.ndarray) -> np.ndarray | None:
        """Where each id ends in the text that they spell; null if that is not ``raw``."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if not len(ids) or ends[-1] != len(raw):
            return None
        at = np.repeat(self.first[ids] - ends + length, length) + np.arange(len(raw))
        return ends if np.array_equal(self.flat[at], raw) else None


class Speller:
    """The text a1,a2|b1;a3|b2,b3 of a document's groups, put together from the ids' decimal forms."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.parts = [f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)] + [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)]

    def __call__(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        codes = np.empty(len(a) + len(b), np.int64)
        of_a, of_b = a.copy(), b + 2 * self.n_a
        of_a[last_a] += self.n_a
        of_b[last_b] += self.n_b
        group_a, group_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        group_a[last_a[:-1] + 1] = np.diff(last_b, prepend=-1)[:-1]
        group_b[last_b[:-1] + 1] = np.diff(last_a, prepend=-1)[1:]
        group_b[0] = last_a[0] + 1
        codes[np.arange(len(a)) + np.cumsum(group_a)] = of_a
        codes[np.arange(len(b)) + np.cumsum(group_b)] = of_b
        return "".join(map(self.parts.__getitem__, codes.tolist()))[:-1]


def id_pairs(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct id pairs a << 20 | b of overlapping tokens and how often each occurs.

    Within a group of several tokens equal ids are counted first, so a long group costs its distinct ids.
    """
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    plain = (n_a == 1) & (n_b == 1)
    keys, times = [a[last_a[plain]] << _ID_BITS | b[last_b[plain]]], [np.ones(int(plain.sum()), np.int64)]
    if not plain.all():
        keep_a, keep_b = np.repeat(~plain, n_a), np.repeat(~plain, n_b)
        groups = np.arange(len(n_a))
        ua, ta = np.unique(np.repeat(groups, n_a)[keep_a] << _ID_BITS | a[: len(keep_a)][keep_a], return_counts=True)
        ub, tb = np.unique(np.repeat(groups, n_b)[keep_b] << _ID_BITS | b[: len(keep_b)][keep_b], return_counts=True)
        group = ua >> _ID_BITS
        first = np.searchsorted(ub, group << _ID_BITS)
        n = np.searchsorted(ub, (group + 1) << _ID_BITS) - first
        at = np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        mask = (1 << _ID_BITS) - 1
        keys.append(np.repeat(ua & mask, n) << _ID_BITS | ub[at] & mask)
        times.append(np.repeat(ta, n) * tb[at])
    key, weight = np.concatenate(keys), np.concatenate(times)
    if weight.sum() <= 4 * len(key):  # few repeats: sort them all, which is quicker than to sort with weights
        return np.unique(np.repeat(key, weight) if len(weight) and weight.max() > 1 else key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[heads], np.add.reduceat(weight, heads)


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, spelt_a = byte_bpe(path_a)
        encode_b, spelt_b = piece_bpe(path_b)
        spelling_a, spelling_b = Spelling(spelt_a), Spelling(spelt_b)
        spell = Speller(len(spelt_a), len(spelt_b))
        nothing = 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)

        def one(text: str) -> tuple:
            spaced = " " + text
            if not text:
                return nothing
            raw = np.frombuffer(spaced.encode(), np.uint8)
            ids_a = np.array(encode_a.encode_ordinary(spaced), np.int64)
            ends_a = spelling_a.ends(ids_a, raw)
            ids_b = np.array(encode_b.encode(text), np.int64)
            ends_b = spelling_b.ends(ids_b, raw)
            if ends_a is None or ends_b is None:
                return nothing
            last_a, last_b = common_ends(ends_a, ends_b)
            pairs, times = id_pairs(ids_a, ids_b, last_a, last_b)
            digest = hashlib.sha256(spell(ids_a, ids_b, last_a, last_b).encode()).hexdigest()
            return len(ids_a), len(ids_b), len(last_a), int(times.sum()), digest, pairs, times

        for batch in batches:
            for part in tokens.slices(batch, limit=_SLICE):
                found = list(zip(*map(one, tokens.strings(part.column("text")).to_pylist()), strict=True))
                counts = [pa.array(found[i], pa.int64()) for i in range(4)]
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in found[5]])), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found[i]))) for i in (5, 6)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *counts, pa.array(found[4], pa.string()), *lists], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): documents that hold an id pair linked, and whether no pair of its first id has more."""
    counts = settled(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
    a = F.shiftright("pair", _ID_BITS)
    best = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # a row for each id of the vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align each text's tokens by a byte-level vocabulary (a) and by a sentence-piece model (b).

    Returns one row per input row: the id, n_a and n_b tokens, n_groups between
    common ends, n_links pairs of tokens in one group, n_best of them whose id pair
    is in as many documents as any of its first id, count_sum (documents of the id
    pair, summed over links) and groups_sha256 (of the groups' ids, written
    a1,a2|b1;a3|b2,b3).  Every row counts as a document, repeated ones too.

    Both encode a space and the text.  Null and empty texts, and those whose tokens
    of either kind do not spell these bytes (white space or characters that a model
    changes), have no tokens: zeros and an empty digest.  Other columns are not read;
    an empty table gives none.  The two files must be on every executor.
    """
    batch_texts(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    aligned = settled(rows.mapInArrow(_aligned(path_a, path_b), _ALIGNED))
    counts = settled(pair_counts(aligned))
    total = aligned.select(F.sum(F.size("pairs"))).first()[0] or 0
    frequent = F.col("docs") * _FREQUENT > total
    pairs = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    links = pairs.join(F.broadcast(counts.where(frequent)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")]
    known = links.where("docs IS NOT NULL").groupBy("row").agg(*sums)
    rest = links.where("docs IS NULL").select("row", "pair", "times").join(counts.where(~frequent), "pair").groupBy("row").agg(*sums)
    summed = known.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = aligned.drop("pairs", "times").join(summed, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256")
