"""The corpus pipeline: documents through five of the operators, each stage written and reread before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import cut
from sparkloom.llm.decontaminate import drop_contaminated
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.near_dup import drop_near_duplicates
from sparkloom.llm.quality import keep_accepted
from sparkloom.llm.queries import table
from sparkloom.llm.sharding import assign_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality, toxic ones and those without text (null, empty, blank) go; rows without an id and repeated rows are judged each."""
    return keep_accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, of rows without an id too, and one row of a repeated id; rows without a token stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, in one passage or in several, go; each row, with an id or without, by its own text."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources, drawn to their target weights, as rows of documents; a null source is one source. No documents give no blocks."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every block with its shard: by a hash of the block, so that every shard draws from all sources as the blocks do, and blocks of
    one document part. No blocks give no shards."""
    return assign_shards(docs, whole=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Fitted weights, consistent samples, tiles and multinomial draws are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every stage's result is Parquet in the cluster's shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
