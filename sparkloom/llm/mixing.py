"""Operator 3. Mixing sources to target weights: packed blocks, multinomial shards, pseudorandom index permutations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, pieces, raw, record

BLOCK_TOKENS = 1024
SHARD_SLOTS = 256
SEED = 11
#: Without given weights, a source weighs (its blocks) ** POWER.
POWER = 0.5
SEPARATOR = "\n\n"  # stands for the token that ends a document
#: Tokens of a lane, the part of a source that one task packs; larger if there were more lanes than MOST_LANES.
LANE_TOKENS, MOST_LANES, SUBS = 2_000_000, 200_000, 1 << 18
_CHUNK = 1024  # shards drawn together


def word_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words (runs of bytes above blank) end, and each text's first word."""
    word = data > 32
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    after[inner] = False
    ends = np.flatnonzero(word & ~after) + 1
    return ends, np.searchsorted(ends - 1, offsets)


def _sizes(batches):
    for batch in pieces(batches):
        data, offsets = raw(batch.column("text"))
        _, first = word_ends(data, offsets)
        n = np.diff(first)
        yield record("key source sub tokens", batch.column("key"), batch.column("source"), batch.column("sub"), n + (n > 0))


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 ... n - 1: a Feistel network of six rounds over the next even number of bits, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(6, dtype=np.uint64) + np.uint64((key & (1 << 60) - 1) * 8))
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        x[todo] = left << shift | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def draw(shard: int, last: int, total: int, slots: int, weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.random.Generator]:
    """The multinomial counts by source of a shard's slots; the last shard has what is left of the total."""
    rng = np.random.default_rng([seed, shard])
    return rng.multinomial(total - last * slots if shard == last else slots, weights), rng


def mix_sources(docs: DataFrame, weights: dict | None = None, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, lane_tokens: int = LANE_TOKENS) -> DataFrame:
    """(shard, slot, source, block, epoch, n_tokens, doc_id, lang, text): one packed block for each slot.

    A token is a word with the blanks before it; a document has one more, its end. Each source is packed in lanes, which
    hash its documents evenly; a lane's documents follow by doc_id, text, then lang, and are cut every block_tokens tokens; a
    lane's last block may be shorter. Blocks are numbered through a source's lanes. There are as many slots as blocks, by
    shard_slots in a shard (the last may have less). A shard's counts by source are multinomial over the weights. A
    source's slots are counted through the shards; the n-th is in epoch n div (its blocks), and gets the block of the epoch's
    keyed permutation: no block comes again before every other of the source came. Blocks and slots meet by index.

    weights: by source, normalised over the sources that have blocks; sources without one, or of weight 0, are left out; if
    none is left there are no rows. Without weights, (blocks) ** POWER. doc_id and lang are those of the block's first document.
    A null source is one source, its weight is under None. Null ids come first in their lanes. Documents without words
    have no tokens. Repeated rows are packed as often as they stand. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "source", "lang").withColumn("key", F.xxhash64("source")).withColumn("sub", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(SUBS)))
    subs = cut(docs.select("key", "source", "sub", "text").mapInArrow(_sizes, "key long, source string, sub long, tokens long").filter("tokens > 0").groupBy("key", "sub").agg(F.sum("tokens").alias("tokens"), F.first("source").alias("source")))
    totals = subs.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.first("source").alias("source")).orderBy("key").collect()  # a row for each source
    per_lane = max(lane_tokens, sum(r["tokens"] for r in totals) // MOST_LANES)
    lanes_of = {r["key"]: max(1, -(-r["tokens"] // per_lane)) for r in totals}
    lane_table = spark.createDataFrame([*lanes_of.items()] or [(0, 1)], "key long, lanes long")
    lane = F.floor(F.col("sub") * F.col("lanes") / F.lit(SUBS))
    counted = subs.join(F.broadcast(lane_table), "key").groupBy("key", lane.alias("lane")).agg(F.sum("tokens").alias("tokens")).orderBy("key", "lane").collect()  # MOST_LANES and a row for each source at most
    names = {r["key"]: r["source"] for r in totals}
    starts: dict[int, tuple[list, list]] = {}
    for r in counted:
        where, base = starts.setdefault(r["key"], ([], [0]))
        where.append(r["lane"])
        base.append(base[-1] + -(-r["tokens"] // block_tokens))
    keys = [k for k in starts if weights is None or weights.get(names[k], 0) > 0]
    blocks = np.array([starts[k][1][-1] for k in keys], np.int64)
    share = np.array([float(b) ** POWER if weights is None else weights[names[k]] for k, b in zip(keys, blocks)])
    share = share / share.sum() if len(share) else share
    total = int(sum(s[1][-1] for s in starts.values())) if keys else 0
    shards = -(-total // shard_slots)
    chunks = -(-shards // _CHUNK)
    schema = "key long, lane long, place long, shard long, slot int, block long, epoch long"

    def sums(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                s = sum((draw(i, shards - 1, total, shard_slots, share, seed)[0] for i in range(c * _CHUNK, min(shards, (c + 1) * _CHUNK))), np.zeros(len(keys), np.int64))
                yield record("chunk counts", [c], pa.array([s.tolist()], pa.list_(pa.int64())))

    # 8 bytes for each source and _CHUNK shards
    before = np.cumsum([np.zeros(len(keys), np.int64), *(r[1] for r in sorted(spark.range(chunks, numPartitions=max(1, min(chunks, 64))).mapInArrow(sums, "chunk long, counts array<long>").collect()))], axis=0)
    shared = spark.sparkContext.broadcast((before, [(np.array(starts[k][0]), np.array(starts[k][1])) for k in keys]))

    def slots(batches):
        before, lanes = shared.value
        for batch in batches:
            for c in batch.column(0).to_pylist():
                at = before[c].copy()
                out: list[list] = [[] for _ in keys]
                for i in range(c * _CHUNK, min(shards, (c + 1) * _CHUNK)):
                    counts, rng = draw(i, shards - 1, total, shard_slots, share, seed)
                    slot, end = rng.permutation(counts.sum()), np.cumsum(counts)
                    for s, n in enumerate(counts):
                        if n:
                            out[s].append((np.full(n, i), slot[end[s] - n : end[s]], at[s] + np.arange(n)))
                    at += counts
                for s, own in enumerate(out):
                    if own:
                        shard, slot, nth = (np.concatenate(x) for x in zip(*own))
                        epoch, place = nth // blocks[s], nth % blocks[s]
                        for e in np.unique(epoch):
                            place[epoch == e] = permute(place[epoch == e], int(blocks[s]), hash((seed, s, int(e))))
                        which = np.searchsorted(lanes[s][1], place, "right") - 1
                        yield record("key lane place shard slot block epoch", np.full(len(slot), keys[s]), lanes[s][0][which], place - lanes[s][1][which], shard, slot.astype(np.int32), place, epoch)

    wanted = spark.range(chunks, numPartitions=max(1, min(chunks, 4096))).mapInArrow(slots, schema)
    packed = docs.join(F.broadcast(lane_table.filter(F.col("key").isin(keys)) if len(keys) < len(starts) else lane_table), "key").withColumn("lane", lane).drop("sub", "lanes")

    def fill(key, left, right):
        return _fill(left, right, block_tokens)

    result = "shard long, slot int, source string, block long, epoch long, n_tokens int, doc_id long, lang string, text string"
    return packed.groupBy("key", "lane").cogroup(wanted.groupBy("key", "lane")).applyInArrow(fill, result)


def _fill(left, right, block_tokens: int):
    """The blocks of one lane (left: its documents) that the slots (right) ask for by their places in it."""
    left = left.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("lang", "ascending")]).combine_chunks() if len(left) else left
    ids, langs, sources = (left.column(c).to_pylist() for c in ("doc_id", "lang", "source"))
    if None in ids:  # they come first
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        left = left.take(pa.array(order))
        ids, langs, sources = (left.column(c).to_pylist() for c in ("doc_id", "lang", "source"))
    texts = left.column("text").combine_chunks()
    data, offsets = raw(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks else texts if not isinstance(texts, pa.ChunkedArray) else pa.array([], pa.string()))
    ends, first = word_ends(data, offsets)
    words = np.diff(first)
    base = np.concatenate([[0], np.cumsum(words + (words > 0))])  # tokens before each document

    def block(b: int) -> tuple[int, int, str]:
        a, z = b * block_tokens, min((b + 1) * block_tokens, base[-1])
        d = int(np.searchsorted(base, a, "right")) - 1
        out, head = [], None
        while d < len(ids) and base[d] < z:
            if words[d]:
                head = d if head is None else head
                i, j = max(a - base[d], 0), min(z - base[d], words[d])
                last = z - base[d] > words[d]
                start = ends[first[d] + i - 1] if i else offsets[d]
                stop = offsets[d + 1] if last else ends[first[d] + j - 1]
                out.append(data[start:stop].tobytes())
                if last:
                    out.append(SEPARATOR.encode())
            d += 1
        return head, int(z - a), b"".join(out).decode("utf-8", "replace")

    made = {b: block(b) for b in pc.unique(right.column("place")).to_pylist()}
    rows = [made[b] for b in right.column("place").to_pylist()]
    return pa.table({
        "shard": right.column("shard"), "slot": right.column("slot"), "source": pa.array([sources[r[0]] for r in rows], pa.string()), "block": right.column("block"), "epoch": right.column("epoch"),
        "n_tokens": pa.array([r[1] for r in rows], pa.int32()), "doc_id": pa.array([ids[r[0]] for r in rows], pa.int64()), "lang": pa.array([langs[r[0]] for r in rows], pa.string()), "text": pa.array([r[2] for r in rows], pa.string()),
    })


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The blocks of mix_sources as rows of documents: text is the block, n_chars its length; doc_id and lang are those of its first
    document. Nulls, ties and repeated rows as in mix_sources; an empty table gives no rows."""
    return mix_sources(docs).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
