"""N-gram Jaccard join: all document pairs whose shingle sets overlap enough, as linked classes.

Sets of one size band meet in tiles.  If two sets differ in at most H shingles,
then of K > H hashed parts of the shingle space at least K - H hold exactly the
same shingles in both.  H follows from the band and the threshold, so a tile is
(band, part, content of that part), and no linked pair is missed: not a filter
by chance but a pigeonhole bound.  A part holds a few shingles, so a passage that
many documents share does not bring them together unless they are alike as a
whole.

Linked sets share K - H tiles at least, so each set may leave out the K - H - 1
tiles that most sets have (less its empty parts), all sets in one order of tiles:
the rarest common tile of a linked pair is left to both.  That takes away what
sets have in common by shared passages.

Pairs are bounded by the bit counts of hashed bitmaps, about 8 to 16 bits a
shingle: bits set in one bitmap only belong to shingles of that set only, which
bounds the overlap from above.  What the bound leaves is decided on the sorted
shingle arrays, first a pair a set, then what these links do not connect.

The pairs of small tiles are listed once each.  Those of a large tile are not: its
sets are compared with one leader each, and what is still unconnected is compared
in blocks, together with other tiles of the leader; only as many links come out of
a block as connect what is linked there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm import tokens
from postlake.llm.common import NO_ID, batch_texts, components, id_of, with_names, without, written

_BAND = 1.6
_SLACK = 1.3
_BITS = 8  # of a bitmap for each shingle, at least
_BLOCK = 1024  # sets compared with each other at once
_LISTED = 64  # sets of a tile whose pairs are listed
_BUCKET = 500_000  # tile entries that meet in a task at once
_SALTED = 8  # sets of a slice with one tile from which on only the first goes to the tile's bucket
_MOST_SPARE = (1 << 14) - 1
_SEEN = 200_000  # sets remembered by a task, to send copies once
#: Up to this many ids (16 bytes each) are broadcast; beyond, the texts are shuffled to them.
_BROADCAST_IDS = 500_000


def most_apart(smaller: int, percent: int) -> int:
    """The largest symmetric difference of linked sets whose smaller one has at most this many shingles."""
    both = smaller + 100 * smaller // percent
    return both * (100 - percent) // (100 + percent)


class Bands:
    """Size bands and the number of parts in each."""

    def __init__(self, percent: int):
        self.percent = percent
        lows = [1]
        while lows[-1] < 1 << 31:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * _BAND)))
        self.lows = np.array(lows)
        self.apart = np.array([most_apart(hi - 1, percent) for hi in lows[1:]])
        self.parts = np.where(self.apart == 0, 1, np.ceil(self.apart * _SLACK).astype(np.int64) + 1)

    def of(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last band a set enters: those of all sets it may be linked with as the larger one."""
        least = -(-sizes * self.percent // 100)
        return tuple(np.searchsorted(self.lows, x, side="right") - 1 for x in (least, sizes))


class Sets:
    """The sorted distinct n-word shingles of each row of a slice; fewer words make one shingle.

    ``members[first[i] : first[i + 1]]`` is the set of row i, ``names[i]`` a 64-bit
    hash of it (the sum of its mixed members, mixed again), 0 for an empty set.
    """

    def __init__(self, text: pa.Array, n: int):
        words = tokens.Words(text, tokens.SPACED_FOLDED)
        counts = words.counts
        size = np.minimum(counts, n)
        number = np.where(counts > 0, counts - size + 1, 0)
        row = np.repeat(np.arange(len(counts)), number)
        starts = np.arange(number.sum()) - np.repeat(np.append(0, np.cumsum(number)[:-1]), number) + words.first[row]
        grams = tokens.Spans(words.hashes)(starts, size[row])
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        if len(grams):
            new = np.append(True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1]))
            grams, row = grams[new], row[new]
        self.members, self.row = grams, row
        self.first = np.searchsorted(row, np.arange(len(counts) + 1))
        self.sizes = np.diff(self.first)
        self.mixed = tokens.mix(grams)
        some = np.flatnonzero(self.sizes)
        names = np.zeros(len(counts), np.uint64)
        if len(some):
            names[some] = tokens.mix(np.add.reduceat(self.mixed, self.first[some]) + self.sizes[some].astype(np.uint64))
        self.names = names.view(np.int64)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.members[self.first[i] : self.first[i + 1]]


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    for batch in batches:
        for part in tokens.slices(batch):
            yield part, Sets(part.column("text"), n)


def _named(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([part.column("k"), part.column("h"), pa.array(sets.sizes), pa.array(sets.names)], names=["k", "h", "n", "c"])

    return run


def _key(sums, parts, bands):
    return tokens.mix(sums + tokens.mix(np.asarray(parts).astype(np.uint64) + ((np.asarray(bands).astype(np.uint64) + np.uint64(1)) << np.uint64(40))))


def tiles(sets: Sets, wanted: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, rows, spare) of the tiles of the wanted rows: a key for each part of each band that partners may share.

    Members are sorted and parts are ranges of hashes, so a part is a run of a set.
    Of H + 1 or more equal parts one holds a shingle as long as fewer parts than
    that are empty; then empty parts need no tile.  Linked sets share one tile more
    than spare says, at least.
    """
    low, high = bands.of(np.maximum(sets.sizes, 1))
    for step in range(int((high - low).max(initial=0)) + 1):
        band = low + step
        mine = wanted & (band <= high) & (sets.sizes > 0)
        take = mine[sets.row]
        members, row = sets.members[take], sets.row[take]
        if not len(members):
            continue
        part = ((members >> np.uint64(32)) * bands.parts[band[row]].astype(np.uint64)) >> np.uint64(32)
        cut = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])))
        held, owner = part[cut], row[cut]
        filled = np.bincount(owner, minlength=len(mine))
        spare = np.maximum(filled - bands.apart[band] - 1, 0)
        yield _key(np.add.reduceat(sets.mixed[take], cut), held, band[owner]), owner, spare[owner]
        for i in np.flatnonzero(mine & (filled <= bands.apart[band])):
            empty = np.setdiff1d(np.arange(bands.parts[band[i]]), held[slice(*np.searchsorted(owner, [i, i + 1]))].astype(np.int64))
            yield _key(np.zeros(len(empty), np.uint64), empty, np.full(len(empty), band[i])), np.full(len(empty), i), np.zeros(len(empty), np.int64)


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of values, cut at the bounds."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _values(column: pa.ChunkedArray, kind) -> np.ndarray:
    out = [np.zeros(0, kind)]
    for chunk in column.cast(pa.large_binary()).chunks:
        _, offsets, data = chunk.buffers()
        offsets = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        if offsets[-1] > offsets[0]:
            out.append(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind))
    return np.concatenate(out)


def _packed(n: int, percent: int, buckets: int):
    """The tiles of each slice, packed by bucket: keys, names of the sets, and spare * 4 + how.

    Where many sets of a slice share a tile, the first goes to the tile's bucket
    (how 2) and the others, known to be in a shared tile, to any (how 1): so a tile
    that holds a great part of all sets burdens no bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for _, sets in _sets(batches, n):
            wanted = np.zeros(len(sets.names), bool)
            for i, name in enumerate(sets.names.tolist()):
                wanted[i] = name not in seen
                if len(seen) < _SEEN:
                    seen.add(name)
            found = list(tiles(sets, wanted, bands))
            if not found:
                continue
            keys, rows, spare = map(np.concatenate, zip(*found, strict=True))
            names, info = sets.names[rows], np.minimum(spare, _MOST_SPARE).astype(np.uint16) << np.uint16(2)
            order = np.argsort(keys, kind="stable")
            cut = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
            number = np.diff(np.append(cut, len(keys)))
            many = np.repeat(number >= _SALTED, number)
            info[order[many]] |= np.uint16(1)
            info[order[cut[number >= _SALTED]]] ^= np.uint16(3)
            salt = np.where(info & np.uint16(1), tokens.mix(names.view(np.uint64)), np.uint64(0))
            bucket = ((keys ^ salt) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            bounds = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]]), *[_binaries(x[order], bounds) for x in (keys, names, info)]], names=["bucket", "keys", "names", "infos"])

    return run


def _shared(table: pa.Table) -> pa.Table:
    """(key, c, spare, sets) of the tiles of a bucket that several sets have; sets is the largest number for those shared within a slice."""
    keys, names, info = _values(table.column("keys"), np.uint64), _values(table.column("names"), np.int64), _values(table.column("infos"), np.uint16)
    order = np.lexsort((names, keys, info & np.uint16(1)))
    keys, names, info = keys[order], names[order], info[order]
    salted, known = (info & np.uint16(1)).astype(bool), (info & np.uint16(2)).astype(bool)
    other = np.append(True, (keys[1:] != keys[:-1]) | (salted[1:] != salted[:-1]))[: len(keys)]
    new = other | np.append(True, names[1:] != names[:-1])[: len(keys)]
    tile = np.cumsum(other) - 1
    sets = np.bincount(tile, weights=new).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
    hot = np.bincount(tile, weights=known | salted) > 0 if len(keys) else np.zeros(0, bool)
    sets = np.where(hot, np.iinfo(np.int32).max, sets)[tile]
    keep = new & (sets > 1)
    return pa.table({"key": keys[keep].view(np.int64), "c": names[keep], "spare": (info[keep] >> np.uint16(2)).astype(np.int32), "sets": sets[keep].astype(np.int32)})


def bitmap(members: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap whose width is the power of two from _BITS bits a shingle up."""
    width = 1 << max(6, (_BITS * len(members) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(members & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as one of fewer bytes: as if made with that width."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0) if len(bits) > size else bits


def _arrays(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, n):
            each = [sets[i] for i in range(len(sets.names))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sets.names), pa.array(sets.sizes), pa.array([bitmap(x).tobytes() for x in each], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())],
                names=["c", "n", "bits", "members"],
            )

    return run


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _filtered(keep):
    """mapInArrow function: the pairs (a, b) of the rows for which keep(row values) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, batch.num_columns)), strict=True)
            mask = pa.array([bool(keep(*row)) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def may_overlap(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes, percent: int) -> bool:
    """Whether sizes and bitmaps allow two sets to be linked."""
    if not linked(min(n_a, n_b), n_a, n_b, percent):
        return False
    size = min(len(bits_a), len(bits_b))
    p, q = (folded(np.frombuffer(x, np.uint8), size).view(np.uint64) for x in (bits_a, bits_b))
    most = min(n_a - int(np.bitwise_count(p & ~q).sum()), n_b - int(np.bitwise_count(q & ~p).sum()))
    return linked(most, n_a, n_b, percent)


def overlap(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets, given as sorted arrays, are linked."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    return linked(int((q[at] == p).sum()), len(p), len(q), percent)


def _joined(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    for s in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("c").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in columns]), s)
    return pairs.select("a", "b", *[f"{x}_{s}" for s in ("a", "b") for x in columns])


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to be linked."""
    return _joined(pairs, sets, "n", "bits").mapInArrow(_filtered(lambda *row: may_overlap(*row, percent)), "a long, b long")


def exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their sorted arrays."""
    return _joined(pairs, sets, "members").mapInArrow(_filtered(lambda x, y: overlap(x, y, percent)), "a long, b long")


def common_counts(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact sizes of the intersections of all xs with all ys, sorted arrays both.

    Only shingles that some x and some y hold count; a matrix product over
    ``width`` of them at a time counts all pairs.
    """
    flat = [np.concatenate(side) for side in (xs, ys)]
    rows = [np.repeat(np.arange(len(side)), [len(m) for m in side]) for side in (xs, ys)]
    if xs is ys:
        shared, count = np.unique(flat[0], return_counts=True)
        shared = shared[count > 1]
    else:
        shared = np.intersect1d(*flat)
    counts = np.zeros((len(xs), len(ys)), np.int64)
    if xs is ys:
        counts[np.arange(len(xs)), np.arange(len(xs))] = [len(x) for x in xs]
    places = []
    for members, row in zip(flat, rows, strict=True):
        at = np.searchsorted(shared, members)
        known = at < len(shared)
        known[known] = shared[at[known]] == members[known]
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], row[known][order]))
    for lo in range(0, len(shared), width):
        parts = []
        for (at, row), side in zip(places, (xs, ys), strict=True):
            some = slice(*np.searchsorted(at, [lo, lo + width]))
            held = np.zeros((len(side), min(width, len(shared) - lo)), np.float32)
            held[row[some], at[some] - lo] = 1
            parts.append(held)
        product = (parts[0] @ parts[1].T).astype(np.int64)
        if xs is ys:
            product[np.arange(len(xs)), np.arange(len(xs))] = 0
        counts += product
    return counts


def _across(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Links between components within the blocks of each key, as few as connect what is linked there."""
        out: list[tuple[int, int]] = []
        for _, rows in group.groupby("key"):
            out += _connecting(*_sides(rows), percent)
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _allowed(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs are in different components and may be linked by their sizes and bitmaps."""
    size = min(map(len, pd.concat((x["bits"], y["bits"]))))
    bx, by = (np.stack([folded(np.frombuffer(v, np.uint8), size) for v in s["bits"]]).view(np.uint64) for s in (x, y))
    (nx, compx), (ny, compy) = ([s[c].to_numpy() for c in ("n", "comp")] for s in (x, y))
    allowed = np.zeros((len(x), len(y)), bool)
    for i in range(len(x)):
        near = np.flatnonzero((compy != compx[i]) & linked(np.minimum(nx[i], ny), nx[i], ny, percent))
        most = np.minimum(nx[i] - np.bitwise_count(bx[i] & ~by[near]).sum(1, dtype=np.int64), ny[near] - np.bitwise_count(by[near] & ~bx[i]).sum(1, dtype=np.int64))
        allowed[i, near[linked(most, nx[i], ny[near], percent)]] = True
    return allowed


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks of a key's rows, the same frame twice for a block with itself."""
    lo, hi = rows["i"].iloc[0], rows["j"].iloc[0]
    x = rows[rows["block"] == lo].reset_index(drop=True)
    return x, x if lo == hi else rows[rows["block"] == hi].reset_index(drop=True)


_MET = ["grp", "key", "i", "j", "block", "c", "comp"]


def _possible(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """The rows of a block pair that have a partner there by sizes and bitmaps."""
        out = [group[_MET].iloc[:0]]
        for _, rows in group.groupby("key"):
            x, y = _sides(rows)
            if len(x) and len(y):
                allowed = _allowed(x, y, percent)
                out.append(x[allowed.any(1)][_MET])
                if x is not y:
                    out.append(y[allowed.any(0)][_MET])
        return pd.concat(out)

    return run


def _connecting(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    if not len(x) or not len(y):  # a block may have got no row
        return []
    (cx, compx), (cy, compy) = ([s[c].tolist() for c in ("c", "comp")] for s in (x, y))
    allowed, xs, ys = _allowed(x, y, percent), x["members"].tolist(), y["members"].tolist()
    label, out = {c: c for c in compx + compy}, []

    def root(c: int) -> int:
        while label[c] != c:
            label[c] = c = label[label[c]]
        return c

    for i, j in np.argwhere(np.triu(allowed) if x is y else allowed).tolist():
        p, q = root(compx[i]), root(compy[j])
        if p != q and overlap(xs[i], ys[j], percent):
            label[max(p, q)] = min(p, q)
            out.append((min(cx[i], cy[j]), max(cx[i], cy[j])))
    return out


def _dealt(rows: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (key, c, m, ...) with their sets' columns, dealt out as (grp, key, i, j, block).

    Keys of up to _BLOCK rows travel many in a group; the blocks of a larger key
    meet pairwise, so each of its rows goes to as many groups as it has blocks.
    """
    groups = max(1, -(-rows.count() // _BLOCK))
    rows = rows.withColumn("blocks", F.ceil(F.col("m") / _BLOCK).cast("int")).withColumn("block", F.pmod(F.hash("c"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grp = F.when(F.col("blocks") == 1, F.pmod(F.hash("key"), F.lit(groups)).cast("long")).otherwise(F.col("key"))
    rows = rows.withColumn("grp", grp).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("m", "blocks", "other")
    return rows.join(sets.select("c", *columns), "c")


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the components (comp) of sets with one key: (key, c, comp, m), m the rows of the key.

    Bitmaps go to the blocks first; arrays follow only for sets that have a partner
    there by the bound.
    """
    met = _dealt(rows, sets, ["n", "bits"]).groupBy("grp", "i", "j").applyInPandas(_possible(percent), "grp long, key long, i int, j int, block int, c long, comp long")
    met = written(met).join(sets.select("c", "n", "bits", "members"), "c")
    return met.groupBy("grp", "i", "j").applyInPandas(_across(percent), "a long, b long")


def _counted(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """(c, links) of each component's blocks in the group: copies of the sets that a set is linked with."""
        out = [pd.DataFrame({"c": [], "links": []}).astype("int64")]
        for _, rows in group.groupby("key"):
            lo, hi = rows["i"].iloc[0], rows["j"].iloc[0]
            x = rows[rows["block"] == lo]
            y = x if lo == hi else rows[rows["block"] == hi]
            if not len(x) or not len(y):
                continue
            xs = [np.frombuffer(m, np.uint64) for m in x["members"]]
            ys = xs if x is y else [np.frombuffer(m, np.uint64) for m in y["members"]]
            met = linked(common_counts(xs, ys), x["n"].to_numpy()[:, None], y["n"].to_numpy()[None, :], percent)
            if x is y:
                np.fill_diagonal(met, False)
            else:
                out.append(pd.DataFrame({"c": y["c"], "links": met.T.astype(np.int64) @ x["copies"].to_numpy()}))
            out.append(pd.DataFrame({"c": x["c"], "links": met.astype(np.int64) @ y["copies"].to_numpy()}))
        return pd.concat(out).astype("int64")

    return run


def link_counts(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(c, links): for each set of a component with others, how many documents with other sets it is linked with.

    classes: (c, comp, copies).  Links lie within components.  Small components
    travel many in a group, those beyond _BLOCK sets as pairs of blocks; pairs are
    counted where they meet and not listed.
    """
    sizes = classes.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1")
    rows = written(classes.join(sizes, "comp").withColumnRenamed("comp", "key"))
    met = _dealt(rows, sets, ["n", "members"])
    return met.groupBy("grp", "i", "j").applyInPandas(_counted(percent), "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of n-word shingles have a Jaccard similarity of percent / 100 or more.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    A text of fewer words is one shingle; null texts and texts without words have
    none and link with nothing, not even each other.  Returns one row per input
    row: the id, n_shingles, component_id (the smallest id reachable by links,
    the row's own included), n_copies (rows with the same set, 1 if none) and
    n_links (other rows that the row is linked with, copies included).

    A null id counts as smaller than every other and gives a null component_id.
    Rows that repeat an id are documents of their own under that id.  Other
    columns are not read.  Sets are named by 64-bit hashes.
    """
    out = _components_of(docs, n, percent, id_col, text_col, count_links=True)
    return out.select(id_of(F.col("k")).alias(id_col), F.col("n").alias("n_shingles"), id_of(F.col("component")).alias("component_id"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"))


def _components_of(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, count_links: bool = False) -> DataFrame:
    """(k, h, n, comp, component, copies, links) of each row: h is the hash of the text, comp the component's own name."""
    batch_texts(docs.sparkSession)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = written(texts.mapInArrow(_named(n), "k long, h long, n long, c long"))
    classes = rows.where("n > 0").groupBy("c").agg(F.min("k").alias("first"), F.count("*").alias("copies"))
    members = _members(texts, rows, n, percent)
    sets = _sets_of(texts, members, rows, n)
    labels = _linked_labels(members, sets, percent)
    joined = classes.join(labels, classes["c"] == labels["node"], "left").select("c", "first", "copies", F.coalesce("comp", "c").alias("comp"))
    joined = written(joined) if count_links else joined
    lowest = joined.groupBy("comp").agg(F.min("first").alias("component"))
    found = joined.join(lowest, "comp").select("c", "comp", "component", "copies")
    if count_links:
        found = found.join(link_counts(joined.select("c", "comp", "copies"), sets, percent), "c", "left")
    else:
        found = found.withColumn("links", F.lit(0).cast("long"))
    found = found.withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = rows.where("n = 0").select("k", "h", "n", zero.alias("comp"), F.col("k").alias("component"), one.alias("copies"), zero.alias("links"))
    return rows.where("n > 0").join(found, "c").select("k", "h", "n", "comp", "component", "copies", "links").unionByName(alone)


def _linked_labels(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of all sets that are linked; members: (key, c, m, leader), m the sets of the tile and leader one of them."""
    small = members.where(F.col("m") <= _LISTED)
    pairs = small.select("key", F.col("c").alias("a")).join(small.select("key", F.col("c").alias("b")), "key").where("a < b").select("a", "b")
    stars = members.where((F.col("m") > _LISTED) & (F.col("c") != F.col("leader"))).groupBy("leader", "c").agg(F.count("*").alias("often"))
    stars = stars.groupBy("c").agg(F.max(F.struct("often", "leader"))["leader"].alias("a")).select("a", F.col("c").alias("b"))
    maybe = written(bounded(pairs.unionByName(stars).distinct(), sets, percent))
    one = maybe.groupBy("b").agg(F.min("a").alias("one"))
    links = written(exact(one.select(F.col("one").alias("a"), "b"), sets, percent))
    labels = components(links)
    apart = _labelled(_labelled(maybe.join(one, "b").where("a <> one"), labels, "a"), labels, "b").where("comp_a <> comp_b").select("a", "b")
    labels = _merged(labels, written(exact(apart, sets, percent)))
    large = members.where(F.col("m") > _LISTED).select("key", "c")
    if not large.isEmpty():
        labels = _merged(labels, written(block_links(_unconnected(large, labels), sets, percent)))
    return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) after further links (a, b), which are few between two components at most."""
    ends = _labelled(_labelled(links, labels, "a"), labels, "b").where("comp_a <> comp_b").select(F.least("comp_a", "comp_b").alias("a"), F.greatest("comp_a", "comp_b").alias("b"))
    ends = written(ends.distinct())
    if ends.isEmpty():
        return labels
    further = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti")
    nodes = labels.unionByName(fresh.withColumn("comp", F.col("node")))
    return written(nodes.join(further, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp")))


def _unconnected(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, c, comp, m) of large tiles that still hold several components.

    Tiles with one leader are put together, as one key, where this sends fewer rows
    to the blocks than the tiles by themselves: near copies of one text share many.
    """
    named = written(_labelled(large, labels, "c").select("key", "c", F.col("comp_c").alias("comp")))
    held = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("c").alias("leader"), F.count("*").alias("m")).where("lo <> hi")
    rows = written(named.join(held.select("key", "leader", "m"), "key"))
    each = rows.groupBy("leader", "c", "comp").agg(F.sum(F.ceil(F.col("m") / _BLOCK)).alias("alone"))
    sets = each.groupBy("leader").agg(F.count("*").alias("sets"), F.sum("alone").alias("alone"))
    together = written(sets.where(F.col("sets") * F.ceil(F.col("sets") / _BLOCK) < F.col("alone")).select("leader", "sets"))
    alone = rows.join(together, "leader", "left_anti").select("key", "c", "comp", "m")
    joint = each.join(together, "leader").select(F.col("leader").alias("key"), "c", "comp", F.col("sets").alias("m"))
    return written(alone.unionByName(joint))


def _labelled(rows: DataFrame, labels: DataFrame, c: str) -> DataFrame:
    """Rows with comp_<c>, the component of column c: its own name if it is linked with nothing."""
    named = rows.join(labels.select(F.col("node").alias(c), F.col("comp").alias("_comp")), c, "left")
    return named.withColumn(f"comp_{c}", F.coalesce("_comp", c)).drop("_comp")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, but only one of each component of jaccard_components.

    The one with the smallest id stays, of several texts under that id the one with
    the smallest hash, of repeated rows any.  Documents without words all stay.  A null
    id counts as the smallest.  An empty table stays empty.
    """
    rows = written(_components_of(docs, n, percent, id_col, text_col)).where("n > 0")
    stay = written(rows.groupBy("comp").agg(F.min(F.struct("k", "h")).alias("s")).select("s.k", "s.h"))
    gone = written(rows.select("k", "h").distinct().join(stay, ["k", "h"], "left_anti"))
    kept = without(with_names(docs, id_col, text_col), gone)
    repeated = written(rows.groupBy("k", "h").agg(F.count("*").alias("rows")).where("rows > 1").join(stay, ["k", "h"], "left_semi").select("k", "h"))
    if not repeated.isEmpty():
        once = kept.join(repeated, ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
        kept = kept.join(repeated, ["k", "h"], "left_anti").select("_row", "k", "h").unionByName(once.select("_row", "k", "h"))
    return kept.select("_row.*")


def _members(texts: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(key, c, m, leader) of the tiles that m > 1 sets have in common, without those that a set may leave out."""
    shingles = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = 1 + int(shingles * 1.5 * _SLACK * most_apart(100, percent) / 100) // _BUCKET
    packed = texts.mapInArrow(_packed(n, percent, buckets), "bucket long, keys binary, names binary, infos binary")
    found = packed.groupBy("bucket").applyInArrow(_shared, "key long, c long, spare int, sets int")
    order = Window.partitionBy("c", "spare").orderBy(F.desc("sets"), F.desc("key"))
    kept = written(found.withColumn("rank", F.dense_rank().over(order)).where("rank > spare").select("key", "c"))
    sizes = kept.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("leader"), F.max("c").alias("last")).where("leader <> last").drop("last")
    return written(kept.join(sizes, "key"))


def _sets_of(texts: DataFrame, members: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Size, bitmap and sorted shingles of every set that is a member of a tile, from one document each."""
    needed = members.select("c").distinct()
    bearers = written(rows.where("n > 0").join(needed, "c", "left_semi").groupBy("c").agg(F.min(F.struct("k", "h")).alias("one")).select("one.*"))
    few = bearers.count()
    read = texts.join(F.broadcast(bearers) if few <= _BROADCAST_IDS else bearers, ["k", "h"], "left_semi")
    sets = read.mapInArrow(_arrays(n), "c long, n long, bits binary, members binary")
    if rows.join(bearers, ["k", "h"], "left_semi").count() > few:  # some of these rows are repeated
        sets = sets.dropDuplicates(["c"])
    return written(sets)
