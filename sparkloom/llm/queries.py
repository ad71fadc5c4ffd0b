"""The ten operators over their whole tables, and the pipeline, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_table

    return shard_table(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    return score(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import sanitise

    return sanitise(table(spark, sf_dir, "documents"))


SPLIT_LIMIT = 400_000


def sharding_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4_sharding with shards so small that small tables have several."""
    from .sharding import shard_table

    return shard_table(table(spark, sf_dir, "documents"), SPLIT_LIMIT)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"sharding_split": sharding_split}


def oracle_sql() -> dict[str, str]:
    from .sharding import sql

    return {"op4_sharding": sql(), "sharding_split": sql(SPLIT_LIMIT)}
