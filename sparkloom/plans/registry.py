"""Queries and their SQL, registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import spread

#: Tables of whose rows much is computed.
TEXTS = ("documents", "pages", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, and relations derived from them by SQL that both engines read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(df) if name in TEXTS else df

    def derived(self, sql: str) -> DataFrame:
        import re

        names = set(re.findall(r"\b(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\b", sql))
        marked = sql.replace("{", "{{").replace("}", "}}")
        for n in names:
            marked = re.sub(rf"(?i)\b(from|join)\s+{n}\b", rf"\1 {{{n}}} {n}", marked)
        return self.spark.sql(marked, **{n: self(n) for n in names if f"{{{n}}}" in marked})


def query(name: str, sql: str | None = None):
    """Register f(tables) as a query, with the SQL of the same rows."""

    def add(f):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return add
