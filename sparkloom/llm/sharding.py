"""Operator 4. Sharding by extendible hashing: only buckets beyond the byte limit split, one hash bit at a time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fits

LIMIT_BYTES = 16 << 20
BITS = 60  # of the hash
SLACK = 3  # bits of the first look beyond those that even buckets would need
STEP = 8  # bits by which unresolved buckets are looked at again
SALTS = 4096  # keys over which rows of one hash and text are spread


def hash60(ident: Column, text: Column, whole: bool = False) -> Column:
    """The first 60 bits of the MD5 of the id, or of the text where the id is null; whole: of both."""
    body = F.coalesce(text, F.lit(""))
    key = F.coalesce(ident.cast("string"), F.concat(F.lit("text "), body))
    if whole:
        key = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(" "), body)
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("h", BITS - bits) if bits else F.lit(0).cast("long")


def directory(rows: DataFrame, limit: int) -> tuple[list[int], DataFrame]:
    """The split tree of written rows (h, bytes), as (bits, slot, depth): all documents whose first bits are slot are in
    the bucket of their first depth bits. bits: the widths of slots that occur, in order; most need the first one only.

    A bucket splits while it holds more than the limit and more than one hash. Buckets are sums over their slots, added up
    before they are shuffled.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits, found, left, base = min(BITS, SLACK + max(0, math.ceil(math.log2(max(total, 1) / limit)))), [], rows, 0
    widths = []
    while True:
        widths.append(bits)
        slots = cut(left.groupBy(_prefix(bits).alias("slot")).agg(F.sum("bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        levels = slots.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(bits)))).withColumn("node", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
        nodes = levels.groupBy("depth", "node").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        ok = nodes.filter((F.col("b") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "node", F.lit(True).alias("ok"))
        tree = cut(levels.select("slot", "depth", "node").join(ok, ["depth", "node"], "left").groupBy("slot").agg(F.min(F.when(F.col("ok"), F.col("depth"))).alias("depth")).select(F.lit(bits).alias("bits"), "slot", "depth"))
        found.append(tree.filter("depth is not null"))
        open_ = tree.filter("depth is null").select("slot")
        if bits == BITS or open_.isEmpty():
            break
        left = cut(left.join(open_, _prefix(bits) == F.col("slot"), "left_semi"))
        base, bits = bits + 1, min(BITS, bits + STEP)
    done = found[0]
    for x in found[1:]:
        done = done.unionByName(x)
    return widths, cut(done)


def _pages(over: DataFrame, limit: int) -> DataFrame:
    """over (h, md, shard_bytes, salt, ...) with shard_page: half limits of the bytes before and in a row, in the order of the texts' MD5.

    Sums before a row are those of earlier ranges of MD5, of earlier texts in its range, and of the rows before it under its salt;
    no task holds all rows of a hash or of a text.
    """
    each = cut(over.groupBy("h", F.substring("md", 1, 3).alias("range"), "md", "salt").agg(F.sum("shard_bytes").alias("b")))
    ranges = each.groupBy("h", "range").agg(F.sum("b").alias("r"))
    ranges = ranges.withColumn("before", F.sum("r").over(Window.partitionBy("h").orderBy("range")) - F.col("r")).drop("r")  # 4096 rows of a hash at most
    texts = each.withColumn("inside", F.sum("b").over(Window.partitionBy("h", "range").orderBy("md", "salt")) - F.col("b")).drop("b")
    starts = texts.join(ranges, ["h", "range"]).select("h", "md", "salt", (F.col("before") + F.col("inside")).alias("start"))
    own = F.sum("shard_bytes").over(Window.partitionBy("h", "md", "salt").orderBy("shard_bytes").rowsBetween(Window.unboundedPreceding, 0))
    return over.withColumn("own", own).join(starts, ["h", "md", "salt"]).withColumn("shard_page", F.floor((F.col("start") + F.col("own")) / max(1, limit // 2)).cast("long"))


def assign_shards(docs: DataFrame, limit: int = LIMIT_BYTES, whole: bool = False) -> DataFrame:
    """docs with shard (the bits of its bucket, as text), shard_depth, shard_page and shard_bytes (of the row's text).

    Bytes are those of the text in UTF-8. The directory is indexed by the first bits of a hash of doc_id (of the text where
    that is null; whole: of both, for tables of parts of documents); only buckets beyond the limit split on the next bit,
    until each fits or holds one hash only. Rows of one hash that together exceed the limit fill overflow pages in the order of
    their texts: pages 0, 1, ... hold no more than the limit each, unless a single text does. Everything else is in page 0.

    Null and empty texts have 0 bytes. An empty table gives no rows. Repeated rows are placed each. Columns of docs of the
    result's names are replaced, all others kept, whatever their names.
    """
    docs = docs.drop("shard", "shard_depth", "shard_page", "shard_bytes")
    names = docs.columns
    kept = [f"c{i}" for i in range(len(names))]
    ident, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    out = docs.toDF(*kept).withColumns({"h": hash60(ident, text, whole), "shard_bytes": text_bytes(text)})
    rows = cut(out.select("h", F.col("shard_bytes").alias("bytes")))
    widths, tree = directory(rows, limit)
    depth = F.lit(None).cast("int")
    for bits in widths:
        own = tree.filter(F.col("bits") == bits).select(F.col("slot").alias(f"slot{bits}"), F.col("depth").alias(f"depth{bits}"))
        own = F.broadcast(own) if fits(own) else own
        out = out.join(own, _prefix(bits) == F.col(f"slot{bits}"), "left")
        depth = F.coalesce(depth, F.col(f"depth{bits}"))
    out = out.withColumn("shard_depth", depth).withColumn("shard", F.expr("substring(lpad(bin(h), 60, '0'), 1, shard_depth)"))
    full = cut(rows.groupBy("h").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).filter((F.col("b") > limit) & (F.col("n") > 1)).select(F.col("h").alias("full")))
    final = [*kept, "shard", "shard_depth", "shard_page", "shard_bytes"]
    result = [*names, "shard", "shard_depth", "shard_page", "shard_bytes"]
    if full.isEmpty():
        return out.withColumn("shard_page", F.lit(0).cast("long")).select(*final).toDF(*result)
    full = F.broadcast(full) if fits(full) else full
    # Written, since a row's salt must stay what its sums were made with.
    over = cut(out.join(full, F.col("h") == F.col("full"), "left_semi").withColumns({"md": F.md5(F.coalesce(text, F.lit(""))), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}))
    rest = out.join(full, F.col("h") == F.col("full"), "left_anti").withColumn("shard_page", F.lit(0).cast("long"))
    return _pages(over, limit).select(*final).unionByName(rest.select(*final)).toDF(*result)


def shard_table(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(doc_id, shard, shard_depth, shard_page, shard_bytes) of every document; see assign_shards."""
    return assign_shards(docs.select("doc_id", "text"), limit).drop("text")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write the shards as Parquet folders, each by one task, of no more than the limit; pages are apart.

    A null doc_id or text is written as such. An empty table writes no folder. docs must not have a column __shard.
    """
    assign_shards(docs, limit).withColumn("__shard", F.concat_ws("-", F.concat(F.lit("s"), F.col("shard")), "shard_page")).repartition("__shard").write.partitionBy("__shard").parquet(path)


def sql(limit: int = LIMIT_BYTES) -> str:
    """shard_table over the view documents: the least depth at which the bucket fits or holds one hash is where splitting ends."""
    return f"""
WITH m AS (SELECT doc_id, text, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))), 1, 15))::BIGINT AS h,
  coalesce(strlen(text), 0)::BIGINT AS b FROM documents),
v AS (SELECT DISTINCT h, d, h >> (60 - d) AS node FROM m, range(0, 61) t(d)),
s AS (SELECT v.d, v.node, min(m.h) = max(m.h) OR sum(m.b) <= {limit} AS ok
  FROM v JOIN m ON v.h = m.h GROUP BY v.d, v.node),
p AS (SELECT v.h, min(v.d) AS depth FROM v JOIN s ON v.d = s.d AND v.node = s.node WHERE s.ok GROUP BY v.h),
o AS (SELECT h, sum(b) > {limit} AND count(*) > 1 AS full_ FROM m GROUP BY h)
SELECT m.doc_id, substr(lpad(bin(m.h), 60, '0'), 1, p.depth::INT) AS shard, p.depth::INT AS shard_depth,
  CASE WHEN o.full_ THEN (sum(m.b) OVER (PARTITION BY m.h ORDER BY md5(coalesce(m.text, '')) ROWS UNBOUNDED PRECEDING)) // {limit // 2} ELSE 0 END::BIGINT AS shard_page,
  m.b AS shard_bytes
FROM m JOIN p ON m.h = p.h JOIN o ON m.h = o.h
"""
