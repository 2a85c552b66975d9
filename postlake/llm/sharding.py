"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard levels.  At each level every child
makes a draw from the document's id, its own name and its weight (the sum of its
shards), and the smallest exponential draw wins, so children win in proportion to
weight.  A draw depends on nothing but its own child: when weights grow or a
subtree is added, documents move only into the subtrees whose weights grew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import NO_ID, id_of

#: (region, rack, shard, weight) of each leaf.
Leaf = tuple[str, str, int, float]
#: Parts of a shard that are numbered on their own; the offsets table has shards x SLOT_PARTS rows.
SLOT_PARTS = 64


def even_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """Shards 0, 1, ... with weight 1 under so many racks of so many regions."""
    return [(f"region{i // (racks * shards)}", f"rack{i // shards % racks}", i, 1.0) for i in range(regions * racks * shards)]


def grown_tree(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a new region: no other region's weight changes, so documents move only into it."""
    new = max(x[2] for x in tree) + 1
    return [*tree, (f"region-of-{new}", "rack0", new, weight)]


def _draw(key: F.Column, name: str, weight: float) -> F.Column:
    """An exponential draw with rate weight; the hash gives 53 uniform bits, never 0."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _pick(key: F.Column, children: dict[str, float]) -> F.Column:
    """The name of the child with the smallest draw; ties go to the smaller name."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.array_min(F.array(*[F.struct(_draw(key, c, w).alias("draw"), F.lit(c).alias("name")) for c, w in children.items()]))["name"]


def _descend(key: F.Column, tree: Sequence[tuple[tuple[str, ...], float]], depth: int = 0) -> F.Column:
    groups: dict[str, list] = {}
    for path, weight in tree:
        groups.setdefault("/".join(path[: depth + 1]), []).append((path, weight))
    choice = _pick(key, {name: sum(w for _, w in group) for name, group in groups.items()})
    if depth == 2:
        return choice
    out = None
    for name, group in groups.items():
        below = _descend(key, group, depth + 1)
        out = F.when(choice == name, below) if out is None else out.when(choice == name, below)
    return out


def shard_of(key: F.Column, tree: Sequence[Leaf]) -> F.Column:
    """The shard number of an id, from the id and the tree alone."""
    if any(w <= 0 for *_, w in tree) or len({x[2] for x in tree}) < len(tree):
        raise ValueError("weights must be positive and shard numbers different")
    leaves = [((region, rack, str(shard)), weight) for region, rack, shard, weight in tree]
    return F.element_at(F.split(_descend(key, leaves), "/"), -1).cast("int")


def shard_documents(docs: DataFrame, tree: Sequence[Leaf] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place documents on the leaves of a hash tree.

    Returns one row per input row: the id, size (UTF-8 bytes of the text plus 1),
    text_crc32, shard, slot (0, 1, ... without gaps in each shard, in the order of
    slot parts, ids, checksums and sizes) and grown_shard, the shard under
    ``grown_tree``.

    A null text has no bytes: size 1 and checksum 0, as an empty text.  Null ids all draw as one id.
    Repeated rows share a shard and get slots of their own.  Other columns are not
    read.  A shard is numbered in SLOT_PARTS parts with counted offsets, so none
    is sorted in one task.
    """
    tree = even_tree() if tree is None else list(tree)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    key = F.col("k")
    placed = rows.withColumn("shard", shard_of(key, tree)).withColumn("grown_shard", shard_of(key, grown_tree(tree))).withColumn("part", F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(SLOT_PARTS)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("r", F.row_number().over(Window.partitionBy("shard", "part").orderBy("k", "text_crc32", "size")))
    out = numbered.join(F.broadcast(offsets), ["shard", "part"])
    return out.select(id_of(F.col("k")).alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("r") - 1).alias("slot"), "grown_shard")
