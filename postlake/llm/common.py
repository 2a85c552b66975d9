"""What the operators share: the scratch folder, row keys and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: below every other id.
NO_ID = -(1 << 63)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that setting is absent a temporary folder serves a session on one machine;
    on a cluster it would lose data, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "postlake-scratch")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def batch_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in smaller Arrow batches than the default of 10,000 rows, unless the session sets a number itself."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def written(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Shuffle files go with the query that made them; and joins whose smaller side has partitions up to this size, as measured, hash it instead of sorting both.
_TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_HASH = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m"}


def settled(df: DataFrame, hash_joins: bool = False) -> DataFrame:
    """As written(); the shuffle files behind the frame go as soon as it is written, so a job of many steps holds those of one."""
    conf, own = df.sparkSession.conf, _TIDY | (_HASH if hash_joins else {})
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        return written(df)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as (k, ord, text): (k, ord) names a text.

    k is the id, NO_ID for null.  ord numbers the different texts that share an
    id, so rows that repeat id and text have equal names.  It is 0 throughout
    when ids are unique, which a shuffle of id and text hash alone finds out; the
    texts move only if some id has several.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.col(text_col).cast("string").alias("text"))
    hashed = rows.select("k", F.xxhash64("text").alias("h"))
    several = hashed.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("k")
    if several.isEmpty():
        return rows.withColumn("ord", F.lit(0).cast("long"))
    order = Window.partitionBy("k").orderBy("h")
    names = hashed.join(several, "k", "left_semi").distinct().withColumn("ord", F.row_number().over(order) - 1)
    rows = rows.withColumn("h", F.xxhash64("text")).join(names, ["k", "h"], "left")
    return rows.select("k", F.coalesce("ord", F.lit(0)).cast("long").alias("ord"), "text")


def id_of(k) -> F.Column:
    return F.when(k != NO_ID, k)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b): rows (node, comp), comp the smallest node.

    Minimum labels spread over the edges and jump through the label of the label,
    so the rounds grow with the logarithm of a component's diameter.  Every round
    is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        stepped = written(lower.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        labels = stepped.select("node", "comp")
        if stepped.where("comp < old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Up to this many rows (k, h) are broadcast to be left out; beyond, the texts are shuffled to them.
FEW_ROWS = 500_000


def with_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as (_row, k, h): all columns in a struct, the id as in keyed() and the hash of the text."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    return row.select("_row", F.coalesce(F.col("_row").getField(id_col).cast("long"), F.lit(NO_ID)).alias("k"), F.xxhash64(F.col("_row").getField(text_col).cast("string")).alias("h"))


def without(named: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows (_row, k, h) whose (k, h) is not in a written frame."""
    return named.join(F.broadcast(gone) if gone.count() <= FEW_ROWS else gone, ["k", "h"], "left_anti").select("_row", "k", "h")
