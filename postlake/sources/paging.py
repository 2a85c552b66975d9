"""Landed pages of one listing: which of them count, as a fetch that stops early would have it.

Pages are (board, page, status, n) rows, numbered from 0.  A listing ends before
the first page that is missing, failed or empty, and after one that is short; what
was landed beyond its end is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ended(pages: DataFrame, size: int | None = None, last: str | None = None, board: tuple[str, ...] = ("board",)) -> DataFrame:
    """The pages that count; n is the number of items of each.

    A page with fewer than ``size`` items, or with a number not below its own column
    ``last``, ends the listing and is its last page.  Of a page landed several times
    the one with most items counts.
    """
    fits = F.when((F.col("status") == 200) & (F.coalesce("n", F.lit(0)) > 0), F.struct("n", *[c for c in pages.columns if c not in (*board, "page", "status", "n")]))
    once = pages.groupBy(*board, "page").agg(F.max(fits).alias("_p")).where("_p IS NOT NULL").select(*board, "page", "_p.*")
    by = Window.partitionBy(*board).orderBy("page")
    ends = F.lit(False)
    if size is not None:
        ends = ends | (F.col("n") < size)
    if last is not None:
        ends = ends | (F.col("page") + 1 >= F.coalesce(last, F.lit(1)))
    before = F.coalesce(F.max(ends).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    gapless = F.col("page") == F.row_number().over(by) - 1
    return once.withColumn("_ok", gapless & ~before).where("_ok").drop("_ok")


def new_until_none(items: DataFrame, address: str, board: tuple[str, ...] = ("board",)) -> DataFrame:
    """Items (board, page, address, ..) of pages up to the first that names no new address, each address once, where it first stands.

    A page without items is missing here and ends the listing as well.
    """
    first = items.groupBy(*board, address).agg(F.min_by(F.struct(*[c for c in items.columns if c not in (*board, address)]), "page").alias("_i"))
    fresh = first.select(*board, address, "_i.*")
    pages = fresh.groupBy(*board, "page").agg(F.count("*").alias("_new"))
    rank = F.row_number().over(Window.partitionBy(*board).orderBy("page")) - 1
    counted = pages.withColumn("_rank", rank).where("page = _rank").select(*board, "page")
    return fresh.join(counted, [*board, "page"], "left_semi")
