"""The corpus pipeline: quality, toxicity, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame, which is written
and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontaminate, overlap, packing, quality, toxicity
from skein.llm.queries import documents, tokenizer_path
from skein.llm.tables import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return overlap.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), 4096)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near duplicates", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]
#: No stage is a SQL expression; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not i else cut(docs), sf_dir)
    return docs
