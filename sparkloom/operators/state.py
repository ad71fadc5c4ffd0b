"""A graph as replicated state: its records become a log of operations, logs of replicas are united, the last state becomes records again.

log: (kind, key, op, stamp, replica, tag, value). kind: namespace (observed-remove), meta and node (last writer wins), edge (two-phase).
value is a record in JSON. Stamps are numbers that a replica counts up; replica breaks ties, so merging commutes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import dsl
from . import crdt, graph

FIELDS = [f.split()[0] for f in dsl.RECORDS.split(", ")]
_KEY_NODE, _KEY_EDGE = ("path", "name"), ("src", "kind", "dst")


def _value() -> Column:
    return F.to_json(F.struct(*[F.col(f) for f in FIELDS]))


def log_of(records: DataFrame, replica: str) -> DataFrame:
    """The operations that make up the records of one graph (as sources.dsl reads them), stamped by their order."""
    one = lambda record, kind, key: records.filter(F.col("record") == record).select(F.lit(kind).alias("kind"), key.alias("key"), F.lit("add").alias("op"), F.col("ord").alias("stamp"), F.lit(replica).alias("replica"), F.concat(F.lit(f"{replica}:"), F.col("ord").cast("string")).alias("tag"), _value().alias("value"))
    edge = F.concat_ws(" ", *_KEY_EDGE)
    return one("namespace", "namespace", F.col("path")).unionByName(one("namespace", "meta", F.col("path"))).unionByName(one("node", "node", F.concat_ws(".", *_KEY_NODE))).unionByName(one("edge", "edge", edge))


def move(log: DataFrame, bounds: DataFrame, stamp: int, replica: str) -> DataFrame:
    """log with new boxes (key, x, y, w, h) of nodes that it has, written at the stamp."""
    now = crdt.lww(log.filter("kind = 'node'"), "key", "value").select("key", F.from_json("value", dsl.RECORDS).alias("r"))
    own = now.join(bounds, "key").select("key", *[F.col(f"r.{f}").alias(f) if f not in ("x", "y", "w", "h") else F.col(f) for f in FIELDS])
    return log.unionByName(own.select(F.lit("node").alias("kind"), "key", F.lit("add").alias("op"), F.lit(stamp).cast("long").alias("stamp"), F.lit(replica).alias("replica"), F.lit(f"{replica}:{stamp}").alias("tag"), _value().alias("value")))


def link(log: DataFrame, edges: DataFrame, stamp: int, replica: str, op: str = "add") -> DataFrame:
    """log with edges (src, kind, dst) added or, for good, removed."""
    made = edges.select(*[F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c) for c in _KEY_EDGE])
    blank = {f: F.lit(None).cast(t) for f, t in (x.split(" ", 1) for x in dsl.RECORDS.split(", ")) if f not in _KEY_EDGE}
    rows = made.withColumns(blank | {"record": F.lit("edge"), "ord": F.lit(stamp).cast("long")})
    return log.unionByName(rows.select(F.lit("edge").alias("kind"), F.concat_ws(" ", *_KEY_EDGE).alias("key"), F.lit(op).alias("op"), F.lit(stamp).cast("long").alias("stamp"), F.lit(replica).alias("replica"), F.lit(f"{replica}:{stamp}").alias("tag"), _value().alias("value")))


def merge(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other)
    return out.distinct()


def records_of(log: DataFrame, graph_id: str) -> DataFrame:
    """The records of the state that a log ends in: namespaces that some add keeps, with their last meta; the last write of each node;
    edges never removed. Nodes and namespaces of a namespace that isn't there become rows with an error."""
    spaces = log.filter("kind = 'namespace'")
    alive = crdt.orset_elements(spaces.filter("op = 'add'").select(F.col("key").alias("elem"), "tag"), crdt.observed_removals(spaces.select(F.col("key").alias("elem"), "op", "stamp", "tag"))).withColumnRenamed("elem", "key")
    last = lambda kind: crdt.lww(log.filter(F.col("kind") == kind), "key", "value").select("key", "value")
    edges = log.filter("kind = 'edge'")
    kept = crdt.two_phase(edges.filter("op = 'add'").select("key"), edges.filter("op = 'remove'").select("key"))
    rows = last("meta").join(alive, "key", "left_semi").unionByName(last("node")).unionByName(last("edge").join(kept, "key", "left_semi"))
    read = rows.select(F.from_json("value", dsl.RECORDS).alias("r")).select(*[F.col(f"r.{f}").alias(f) for f in FIELDS])
    above = F.when(F.col("record") == "node", F.col("path")).when((F.col("record") == "namespace") & F.contains("path", F.lit(".")), F.regexp_replace("path", r"\.[^.]*$", ""))
    there = alive.select(F.col("key").alias("__there"))
    out = read.withColumn("__above", above).join(there, F.col("__above") == F.col("__there"), "left")
    error = F.when(F.col("__above").isNotNull() & F.col("__there").isNull(), F.concat(F.lit("no namespace "), "__above"))
    return out.select(F.lit(graph_id).alias("graph_id"), error.alias("error"), *FIELDS)


def origins(records: DataFrame) -> DataFrame:
    """(path, ox, oy, depth): where each namespace begins, with the offsets of all above it added up."""
    spaces = records.filter("record = 'namespace'").select("path", "x", "y")
    up = graph.ancestors(spaces.select("path"), "path")
    return up.join(spaces.select(F.col("path").alias("ancestor"), "x", "y"), "ancestor").groupBy("path").agg(F.sum("x").alias("ox"), F.sum("y").alias("oy"), (F.count("*") - 1).cast("int").alias("depth"))


def boxes(records: DataFrame) -> DataFrame:
    """(fqn, x, y, w, h, depth): the boxes of nodes in the coordinates of the whole graph; depth is one below that of the namespace."""
    nodes = records.filter("record = 'node'").select("path", "name", "x", "y", "w", "h")
    return nodes.join(origins(records), "path").select(F.concat_ws(".", "path", "name").alias("fqn"), (F.col("ox") + F.col("x")).alias("x"), (F.col("oy") + F.col("y")).alias("y"), "w", "h", (F.col("depth") + 1).alias("depth"))
