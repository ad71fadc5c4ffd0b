"""Replicated state as aggregations over an operation log; merging replicas is a union of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orset_elements(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """(elem) present: some add tag of it was not observed by a removal. adds, removes: (elem, tag)."""
    return adds.select("elem", "tag").distinct().join(removes.select("elem", "tag").distinct(), ["elem", "tag"], "left_anti").select("elem").distinct()


def observed_removals(log: DataFrame) -> DataFrame:
    """(elem, tag): the add tags that each removal of the log (elem, op, stamp, tag) saw, those stamped no later than itself.

    Of an element only the last removal matters, so there is no join of all with all.
    """
    last = log.filter("op = 'remove'").groupBy("elem").agg(F.max("stamp").alias("until"))
    return log.filter("op = 'add'").join(last, "elem").filter("stamp <= until").select("elem", "tag")


def merge_tags(*replicas: DataFrame) -> DataFrame:
    out = replicas[0]
    for r in replicas[1:]:
        out = out.unionByName(r)
    return out.distinct()


def lww(log: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, stamp, replica) of the last write of each key: by stamp, then by replica, so merging is commutative."""
    return log.groupBy(key).agg(F.max(F.struct("stamp", "replica", value)).alias("m")).select(key, f"m.{value}", "m.stamp", "m.replica")


def two_phase(added: DataFrame, removed: DataFrame) -> DataFrame:
    """Added and never removed; a removal is for good."""
    return added.distinct().join(removed.distinct(), added.columns, "left_anti")
