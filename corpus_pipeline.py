"""A corpus pipeline: toxic documents go, one document of each near-duplicate class stays, leaked ones go, sources are mixed, and the rest is sharded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes what a
stage returns to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from remora.llm import op03_toxicity, op06_near_dedup, op08_shards, op09_mixing
from remora.llm import op10_decontaminate as op10
from remora.llm.common import keyed, packed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score under one half. The model learns from the labelled part of the table that the labels belong to.

    Null and empty texts have nothing toxic and stay; repeated rows are judged alike.
    """
    model = op03_toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return op03_toxicity.scored(docs, model).filter("score < 0.5").select("_whole.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by doc_id, of each class. Of null and empty texts, which are equal, and of repeated rows, one stays."""
    return op06_near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark window. Null and empty texts hold none and stay; repeated rows are judged alike."""
    rows, _ = keyed(packed(docs, "doc_id", "text"), "_whole")
    found = op10.find_leaks(rows.select(rows["_k"].alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaked = found.filter("contaminated").select(found["doc_id"].alias("_k"))
    return rows.join(leaked, "_k", "left_anti").select("_whole.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them, twice at most. Null and empty texts have no words and are not taken."""
    return op09_mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot; equal texts, null ones too, are in one shard. A column that is named like one of the operator's gets an underscore."""
    return op08_shards.assign_shards(docs, carry=True)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]

#: The first stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
