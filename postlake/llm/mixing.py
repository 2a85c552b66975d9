"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is due target / source size times.  The whole part is
taken outright; the fractions start as inclusion probabilities and walk through
the null space of two balance constraints, the source's words and its documents,
until they are 0 or 1.  A walk holds three fractional documents at a time, so a
block of documents leaves at most two; blocks of what is left are walked again
until one block a source remains.  The landing settles what this block leaves and
a few more of its documents, of all sizes, by the sample nearest to both balances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import NO_ID, id_of, written

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
_FAN = 1024  # blocks whose remainders meet at the next level
_EPS = 1e-9
_FREE = 14  # documents of a source that are left to the landing
_UNIT = "source string, block long, k long, h long, size long, n long, source_size long, target double, whole long, x double"
_UNIT_NAMES = [field.split()[0] for field in _UNIT.split(", ")]


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add weight and target to (source, source_size): a row for each source, null included.

    Sources in code point order, null last, take the weights in turn.  They share
    ``share`` of all sizes by weight; no target exceeds ``most`` times its source,
    and the excess goes to the others by weight.  That is one level for all
    sources that stay below their bound, which prefix sums over the sources in
    order of bound to weight find at once.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    bound = totals.withColumn("weight", turn).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("bound") / F.col("weight"), F.asc_nulls_last("source"))
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("bound").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    levels = bound.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("bound"))
    common = F.min(F.when(F.col("fits"), F.struct(F.col("bound") / F.col("weight"), F.col("level").alias("level")))).over(every)
    return levels.withColumn("common", common["level"]).select("source", "source_size", "weight", F.least("bound", F.coalesce(F.col("common") * F.col("weight"), F.col("bound"))).alias("target"))


def walk(sizes: list[int], x: list[float], draws: list[float]) -> list[float]:
    """Move probabilities to 0 or 1, three at a time, keeping sum(x) and sum(sizes * x); at most two stay fractional.

    Directions are drawn so that expectations stay.
    """
    x = list(x)
    active: list[int] = []
    for i, value in enumerate(x):
        if not _EPS < value < 1 - _EPS:
            x[i] = float(round(value))
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            _step(x, active, u if any(u) else (1, -1, 0), draws[i])
            active = [j for j in active if 0.0 < x[j] < 1.0]
    return x


def land(sizes: list[int], x: list[float], draws: list[float]) -> list[float]:
    """Settle what is still fractional, 20 at most: of all samples that with the least error in words and documents.

    A document of error weighs like an eighth of the mean size; draws decide between equals.
    """
    x = np.array(x, float)
    active = np.flatnonzero((x > 0) & (x < 1))[:20]
    if len(active):
        size, due, draw = (np.asarray(v, float)[active] for v in (sizes, x, draws))
        picks = (np.arange(1 << len(active))[:, None] >> np.arange(len(active)) & 1).astype(np.int8)
        unlike = picks @ (draw - due)  # small if what is picked had draws below its probability
        error = np.abs(picks @ size - size @ due) * 8 / max(size.mean(), 1.0) + np.abs(picks.sum(1) - due.sum())
        x[active] = picks[np.lexsort((unlike, error.round(9)))[0]]
    return x.tolist()


def _step(x: list[float], at: list[int], u: tuple, draw: float) -> None:
    ahead = min(((1 - x[i]) / v if v > 0 else x[i] / -v) for i, v in zip(at, u, strict=True) if v)
    back = min((x[i] / v if v > 0 else (1 - x[i]) / -v) for i, v in zip(at, u, strict=True) if v)
    move = ahead if draw * (ahead + back) < back else -back
    for i, v in zip(at, u, strict=True):
        value = x[i] + move * v
        x[i] = 0.0 if value < _EPS else 1.0 if value > 1 - _EPS else value


def _settle(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "h", "k", "x"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes, draws, x = group["size"].to_numpy(), ((group["h"].to_numpy().view("uint64") * 0x9E3779B97F4A7C15) >> 11) / float(1 << 53), group["x"].to_numpy(copy=True)
        walks = np.ones(len(x), bool)
        if last:
            open_ = np.flatnonzero((x > _EPS) & (x < 1 - _EPS))
            walks[open_[np.unique(np.linspace(0, len(open_) - 1, _FREE).round().astype(int))] if len(open_) else []] = False
        x[walks] = walk(sizes[walks].tolist(), x[walks].tolist(), draws[walks].tolist())
        group["x"] = land(sizes.tolist(), x.tolist(), draws.tolist()) if last else x
        return group

    return run


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"),
        F.xxhash64(F.col(id_col), text).alias("h"),
        F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.col(source_col).cast("string").alias("source"),
    )


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, k, h, size, n): n rows that repeat id, text and source are one unit."""
    return written(sized(docs, id_col, text_col, source_col).groupBy("source", "k", "h", "size").agg(F.count("*").alias("n")))


def taken_copies(units: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int = 0) -> DataFrame:
    """Decide how often the n rows of each unit are taken together: adds source_size, target and copies."""
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(totals.drop("docs"), weights, share, most)
    plan = written(targets.alias("t").join(totals.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.source", "t.source_size", "target", "docs"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = plan.withColumn("blocks", F.ceil(F.col("docs") / BLOCK)).withColumn("rate", rate)
    named = units.alias("r").join(dealt.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "source_size", "target", (F.col("rate") * F.col("n")).alias("due"), F.pmod(F.xxhash64("h", F.lit(seed)), "blocks").alias("block"))
    named = named.withColumn("whole", F.floor(F.col("due") + _EPS))
    blocks = plan.agg(F.max(F.ceil(F.col("docs") / BLOCK))).first()[0] or 1
    left, done = named.select(*_UNIT_NAMES[:-1], F.greatest(F.col("due") - F.col("whole"), F.lit(0.0)).alias("x")), None
    while True:
        last = blocks <= 1
        walked = written(left.groupBy("source", "block").applyInPandas(_settle(last), _UNIT))
        settled = walked.where("x = 0 or x = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        left = walked.where("x > 0 and x < 1").withColumn("block", F.floor(F.col("block") / _FAN))
        blocks = -(-blocks // _FAN)
    return done.select("k", "h", "size", "source", "n", "source_size", "target", (F.col("whole") + F.col("x")).cast("long").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document, so that sources come near their targets.

    Size is the number of words (runs of characters other than ASCII white space)
    of the whole text, however long.  Returns one row per input row: the id,
    source, size, source_size, target (its source's) and copies, at most ``most``
    rounded up.  Copies of a source differ by at most one, are decided by hashes
    alone and balance the source's words and documents.

    Null and empty texts have size 0 and are taken at their source's rate; a
    source without words has target 0.  Null is a source of its own.  Rows that
    repeat id, text and source are taken together and share their copies evenly.
    Other columns are not read.
    """
    out = taken_copies(_units(docs, id_col, text_col, source_col), weights, share, most, seed)
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.select(id_of(F.col("k")).alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _shared(F.col("copies"), F.col("n"), F.col("_i")).alias("copies"))


def _shared(copies, n, i) -> F.Column:
    """Of the copies of n equal rows those of row i."""
    return (F.floor(copies / n) + F.when(i <= copies % n, 1).otherwise(0)).cast("long")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row as often as mix_sources takes it, with all its columns.

    Rows that repeat id, text and source are told apart only by their number, so
    the copies that they are due together are spread over them.  Null texts have size
    0, null ids and sources are values like others.  An empty table stays empty.
    """
    due = taken_copies(_units(docs, id_col, text_col, source_col), weights, share, most, seed).select("k", "h", F.col("source").alias("_s"), F.col("n").alias("_rows"), F.col("copies").alias("_sum"))
    keys = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    at = lambda c: F.col("_row").getField(c)
    keys = keys.withColumn("k", F.coalesce(at(id_col).cast("long"), F.lit(NO_ID))).withColumn("h", F.xxhash64(at(id_col), at(text_col).cast("string"))).withColumn("_s", at(source_col).cast("string"))
    met = (F.col("d.k") == F.col("c.k")) & (F.col("d.h") == F.col("c.h")) & F.col("d._s").eqNullSafe(F.col("c._s"))
    joined = keys.alias("d").join(due.where("_sum > 0").alias("c"), met).select("_row", "c.k", "c.h", "c._s", "_sum", "_rows")
    single = joined.where("_rows = 1").withColumn("_n", F.col("_sum"))
    number = F.row_number().over(Window.partitionBy("k", "h", "_s").orderBy("k"))
    repeated = joined.where("_rows > 1").withColumn("_n", _shared(F.col("_sum"), F.col("_rows"), number)).where("_n > 0") if not due.where("_rows > 1").isEmpty() else None
    often = single if repeated is None else single.unionByName(repeated)
    return often.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")
