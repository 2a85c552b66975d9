"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Vectors are dealt to the cells of coarse centroids; each keeps its cell and one
byte for each part of its residual.  A query looks into its most promising cells,
adds up table entries (its inner products with the centroid and with the codebook
of each part) and ranks the best of each group of cells again by exact inner
products of the original vectors, which are filed with their codes.

How many cells a query must look into depends on the query and the data: among
clustered vectors a few, among vectors without structure nearly all.  So each query
skips only those cells that cannot hold a neighbour of it: no vector of a cell has
an inner product beyond that of the centroid plus the length of the query times the
cell's radius, and the k-th best vector of the training sample, which is part of the
table, sets the least that counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import written

#: Vectors that one task scores at once (a group of cells, or a block of a group), and queries that it scores them for.
BLOCK = 16384
#: The most coarse centroids; they are sent to every task.
MOST_CELLS = 4096


@dataclass(frozen=True)
class Index:
    """centroids: cells x dim; books: parts x codes x (dim / parts); known: sample vectors, by known_ids."""

    centroids: np.ndarray
    books: np.ndarray
    known: np.ndarray
    known_ids: np.ndarray

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centroids)

    def encode(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = vectors - self.centroids[cells]
        width = self.books.shape[2]
        return np.stack([_nearest(rest[:, i * width : (i + 1) * width], book) for i, book in enumerate(self.books)], 1).astype(np.uint8)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres**2).sum(1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (norms - 2 * x[i : i + 4096] @ centres.T).argmin(1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k different points; a cell that runs empty keeps its centre."""
    different = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = different[rng.permutation(len(different))[:k]].astype(np.float32)
    for _ in range(rounds):
        cell = _nearest(x, centres)
        count = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: no null, no null or non-finite component, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = F.col(vector_col) if dict(rows.dtypes)[vector_col] == "array<float>" else v
    return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), own.alias("v")).where(F.coalesce(fine, F.lit(False)))


def train(vectors: DataFrame, count: int, sample: int = 20_000, parts: int = 16, codes: int = 256, rounds: int = 8, seed: int = 0) -> Index | None:
    """Fit the index to at most ``sample`` vectors, those with the smallest hashes of their ids.

    There are about sqrt(count) cells, MOST_CELLS at most.  Vectors of another
    length than the sample's most frequent one are not indexed.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(rows):
        return None
    dim = int(rows["v"].map(len).mode()[0])
    rows = rows[rows["v"].map(len) == dim]
    x = np.stack([np.asarray(v, np.float32) for v in rows["v"]])
    centroids = kmeans(x, min(MOST_CELLS, max(1, int(np.sqrt(count)))), rounds, seed)
    width = next(w for w in range(max(1, dim // parts), dim + 1) if dim % w == 0)
    rest = x - centroids[_nearest(x, centroids)]
    books = [kmeans(rest[:, i : i + width], codes, rounds, seed + 1) for i in range(0, dim, width)]
    most = max(len(b) for b in books)
    books = [np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books]
    return Index(centroids, np.stack(books), x, rows["vec_id"].to_numpy())


def cells_needed(index: Index, size: np.ndarray, radius: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, probes: int | None = None) -> np.ndarray:
    """queries x cells, true where a query must look: where one of its k best vectors may be.

    With ``probes``, so many cells in order of inner product, and more until they
    hold k vectors besides the query's own.
    """
    near = q.astype(np.float64) @ index.centroids.T.astype(np.float64)
    if probes is not None:
        order = np.argsort(-near, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        looks = np.zeros(near.shape, bool)
        np.put_along_axis(looks, order, (np.arange(near.shape[1]) < probes) | (before < k + 1), axis=1)
        return looks & (size > 0)
    least = np.full((len(q), 1), -np.inf)
    if len(index.known) >= k:
        known = q @ index.known.T
        known[ids[:, None] == index.known_ids] = -np.inf
        least = np.partition(known, -k, axis=1)[:, [-k]].astype(np.float64)
    length = np.linalg.norm(q.astype(np.float64), axis=1)[:, None]
    reach = np.linalg.norm(index.centroids.astype(np.float64), axis=1) + radius
    most = near + length * (radius + 1e-5 * reach.max(initial=0))  # the share allows for rounding
    return ~(most < least) & (size > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float32)
    return flat.reshape(len(column), -1)


def _indexed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                cells = index.assign(x)
                codes = index.encode(x, cells)
                off = np.linalg.norm(x.astype(np.float64) - index.centroids[cells], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("v"), pa.array(off)], names=["cell", "vec_id", "code", "v", "off"])

    return run


def _probes(sent, size: np.ndarray, radius: np.ndarray, k: int, probes: int | None, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and group, with the query's cells in that group."""
        index = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                looks = cells_needed(index, size, radius, some.column("vec_id").to_numpy(), _matrix(some.column("v")), k, probes)
                lists = [(i, g, cells[cells % groups == g].tolist()) for i, cells in enumerate(map(np.flatnonzero, looks)) for g in np.unique(cells % groups).tolist()]
                row = pa.array([x[0] for x in lists], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in lists], pa.int32()), some.column("vec_id").take(row), some.column("v").take(row), pa.array([x[2] for x in lists], pa.list_(pa.int32()))], names=["grp", "query_id", "q", "cells"])

    return run


def _best(near: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest values of each row; of equal ones, the first columns."""
    bits = (near + np.float32(0)).view(np.int32).astype(np.int64)
    ordered = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)
    keys = (ordered << 32) - np.arange(near.shape[1])
    if near.shape[1] <= keep:
        return np.argsort(-keys, axis=1)
    return np.argpartition(-keys, keep - 1, axis=1)[:, :keep]


def _scores(sent, k: int, rerank: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best vectors of a block for each query that looks into its cells."""
        index = sent.value
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        left = left.sort_values(["cell", "vec_id"])
        vectors = np.stack(left["v"].to_numpy()).astype(np.float64) if len(left) else None
        ids, width = left["vec_id"].to_numpy(), index.books.shape[2]
        codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), len(index.books))
        cells, starts = np.unique(left["cell"].to_numpy(), return_index=True)
        bounds = np.append(starts, len(left))
        by_id = np.argsort(ids)
        for lo in range(0, len(right) if len(left) else 0, 128):
            some = right.iloc[lo : lo + 128]
            q, own = np.stack(some["q"].to_numpy()).astype(np.float32), some["query_id"].to_numpy()
            tables = [q[:, i * width : (i + 1) * width] @ book.T for i, book in enumerate(index.books)]
            looks = np.zeros((len(some), len(index.centroids)), bool)
            looks[np.repeat(np.arange(len(some)), some["cells"].map(len)), np.concatenate(some["cells"].to_numpy())] = True
            near = np.full((len(some), len(ids)), -np.inf, np.float32)
            for cell, a, b in zip(cells, bounds[:-1], bounds[1:], strict=True):
                if len(rows := np.flatnonzero(looks[:, cell])):
                    sums = np.repeat((q[rows] @ index.centroids[cell])[:, None], b - a, 1)
                    for table, code in zip(tables, codes[a:b].T, strict=True):
                        sums += table[rows][:, code]
                    near[rows, a:b] = sums
            at = np.minimum(np.searchsorted(ids, own, sorter=by_id), len(ids) - 1)
            mine = ids[by_id[at]] == own
            near[np.flatnonzero(mine), by_id[at[mine]]] = -np.inf
            best = _best(near, rerank)
            for i, query in enumerate(some["q"]):
                short = best[i][np.isfinite(near[i, best[i]])]
                exact = (vectors[short] * np.asarray(query, np.float64)).sum(1)
                first = np.lexsort((ids[short], -exact))[:k]
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[short[first]], "score": exact[first]}))
        return pd.concat(out)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, probes: int | None = None, rerank: int = 800, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest inner products for each query, out of all rows but the query's own id.

    Returns query_id, rank (from 1), vec_id and score, the inner product of the
    original vectors in double precision; ties go to smaller ids.  Each query
    looks into all cells that may hold a neighbour, or with ``probes`` into so many
    and more until they hold k, and ranks ``rerank`` vectors of each block exactly,
    so that even a dense bunch of vectors which the codes cannot tell apart is
    ranked well.

    Vectors that are null or zero, or hold null or non-finite components, and rows
    with null ids take no part; nor do vectors of another length than most.  A
    query has k rows, or all candidates if the table has fewer.  Rows that repeat
    an id count once, by their first vector in order of its components.
    Other columns are not read.
    """
    spark = rows.sparkSession
    once = lambda df: usable(df, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors = written(once(rows))
    count = vectors.count()
    index = train(vectors, count, sample)
    if index is None:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    sent, dim, groups = spark.sparkContext.broadcast(index), index.centroids.shape[1], min(-(-count // BLOCK), len(index.centroids))
    vectors = vectors.where(F.size("v") == dim)
    kind = dict(vectors.dtypes)["v"]
    asked = written(once(queries).where(F.size("v") == dim))
    parts = max(1, -(-asked.count() // BLOCK))
    filed = written(vectors.mapInArrow(_indexed(sent), f"cell int, vec_id long, code binary, v {kind}, off double").withColumn("grp", F.col("cell") % groups))
    cells = filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("off")).toPandas()  # MOST_CELLS rows at most
    size, radius = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    size[cells["cell"]], radius[cells["cell"]] = cells["n"], cells["off"]
    blocks = filed.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # MOST_CELLS rows at most
    dealt = filed.drop("off").join(F.broadcast(blocks), "grp").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    looks = asked.mapInArrow(_probes(sent, size, radius, k, probes, groups), f"grp int, query_id long, q {dict(asked.dtypes)['v']}, cells array<int>").join(F.broadcast(blocks), "grp")
    looks = looks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    looks = looks.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    found = dealt.groupBy("grp", "block", "part").cogroup(looks.groupBy("grp", "block", "part")).applyInPandas(_scores(sent, k, max(k, rerank)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
