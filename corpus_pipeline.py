"""The corpus pipeline: five stages over documents, each by one operator of postlake.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the
last return the columns of documents.  The rows that come in may have nulls in any
column, empty texts, repeated rows or further columns; what each operator makes
of them stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlake.llm.common import written
from postlake.llm.decontam import drop_contaminated
from postlake.llm.jaccard import one_of_each
from postlake.llm.mixing import mixed_documents
from postlake.llm.sharding import shard_documents
from postlake.llm.toxicity import drop_toxic, fit


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the model is fitted to the labelled ones among docs."""
    return drop_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 on five-word shingles the document with the smallest id stays."""
    return one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if 13-word windows of benchmark items hit 5 % of their words or more."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, per_cent=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, most=2.0)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard, slot and size of each document of the mix."""
    return shard_documents(docs).drop("grown_shard")


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The model of the first stage and the cube method of the fourth are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
