"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hotelspark.llm import mixing, packing, quality, simhash, suffixes
from hotelspark.llm.common import shared_folder, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects. It learns from the labelled rows outside its held-out fold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash group; of repeated rows one stays."""
    return simhash.representatives(docs)


#: Repeated passages the stage removes: 200 bytes or more (about 35 words), found in windows of these widths. No
#: contract fixes them; op7 keeps its 400 bytes, which lets most passages of 50 to 65 words through.
LENGTH, WIDTHS = 200, (100, 20, 4, 1)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of ``LENGTH`` bytes or more that stand anywhere else; every copy goes, the first included."""
    return suffixes.strip_repeats(docs, LENGTH, WIDTHS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's share of words; documents are repeated or cut as the budgets ask."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids with their sequence and place."""
    return packing.pack_documents(docs).drop("k0", "k1")


STAGES = [
    ("quality", good_documents), ("simhash", one_of_each_group), ("suffixes", without_repeats), ("mixing", mixed), ("packing", packed),
]

#: No stage but mixing can be said in SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
