"""Operator 2. Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, by_id, cut, filter_rows, fits, lowered, mix, pieces, record

MIN_MATCH = 4  # tokens of the shortest tile
COVERAGE = 0.6  # share of a benchmark item's tokens in tiles, from which on a document is contaminated
FIRST_LENGTH = 20  # of the running search
#: Benchmarks are broadcast up to so many bytes of text; beyond, documents and items meet in a join by seed.
BENCHMARK_BYTES = 16 << 20
#: Bits of the map of seeds that is broadcast where items are not: 8 MB.
MAP_BITS = 26
_P = np.uint64(0x9E3779B97F4A7C15)


def _windows(x: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and Karp-Rabin hashes of the runs of so many unmarked tokens."""
    if len(x) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.cumsum(np.concatenate([[0], free.astype(np.int64)]))
    at = np.flatnonzero(at[size:] - at[:-size] == size)
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = h * _P + x[at + j]
    return at, h


def _matches(p: np.ndarray, t: np.ndarray, pf: np.ndarray, tf: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(-length, place in p, place in t) of every maximal run of at least size equal unmarked tokens."""
    pa_, ph = _windows(p, pf, size)
    ta, th = _windows(t, tf, size)
    if not len(pa_) or not len(ta):
        return []
    order = np.argsort(ph, kind="stable")
    keys = ph[order]
    lo, hi = np.searchsorted(keys, th, "left"), np.searchsorted(keys, th, "right")
    found = []
    for k in np.flatnonzero(hi > lo):
        b = int(ta[k])
        for i in order[lo[k] : hi[k]]:
            a = int(pa_[i])
            if a and b and pf[a - 1] and tf[b - 1] and p[a - 1] == t[b - 1] or not np.array_equal(p[a : a + size], t[b : b + size]):
                continue
            n = size
            while a + n < len(p) and b + n < len(t) and pf[a + n] and tf[b + n] and p[a + n] == t[b + n]:
                n += 1
            found.append((-n, a, b))
    return sorted(found)


def tiles(p: np.ndarray, t: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in p, place in t, length), longest first, then by places.

    Each round marks the longest matches between unmarked tokens, as the places come, if earlier ones left them free.
    The search length runs from the length of what it finds, or FIRST_LENGTH, down to the least by halves.
    """
    pf, tf, out = np.ones(len(p), bool), np.ones(len(t), bool), []
    size = max(least, min(FIRST_LENGTH, len(p), len(t)))
    while True:
        found = _matches(p, t, pf, tf, size)
        if not found:
            if size == least:
                return out
            size = max(least, size // 2)
            continue
        longest = -found[0][0]
        for n, a, b in found:
            if -n < longest:
                break
            if pf[a : a + longest].all() and tf[b : b + longest].all():
                pf[a : a + longest] = tf[b : b + longest] = False
                out.append((a, b, longest))


class Index:
    """The items' tokens, and their seeds: the runs of MIN_MATCH tokens, or the whole of a shorter item."""

    def __init__(self, ids: list[int], texts: pa.Array, least: int):
        tok = Tokens(*lowered(record("text", texts)))
        self.least, self.ids = least, ids
        self.items = [tok.hash[a:b] for a, b in zip(tok.first, tok.first[1:])]
        self.sizes = np.array([len(x) for x in self.items])
        self.seeds = {}
        for k in np.unique(np.minimum(self.sizes, least)).tolist():
            if k:
                own = [i for i, n in enumerate(self.sizes) if min(n, least) == k]
                h = [_windows(self.items[i], np.ones(self.sizes[i], bool), k) for i in own]
                item = np.repeat(own, [len(a) for a, _ in h])
                keys, place = mix(np.concatenate([x for _, x in h])), np.concatenate([a for a, _ in h])
                order = np.argsort(keys, kind="stable")
                bits = np.zeros(1 << 20, bool)
                bits[keys >> np.uint64(44)] = True
                self.seeds[k] = keys[order], item[order], place[order], bits

    def candidates(self, tok: Tokens) -> list[tuple[int, int]]:
        """(text's place, item's place) where the seeds they share could cover enough of the item."""
        pairs: dict[tuple[int, int], list] = {}
        for k, (keys, item, place, bits) in self.seeds.items():
            n = len(tok.hash) - k + 1
            if n < 1:
                continue
            h = np.zeros(n, np.uint64)
            for j in range(k):
                h = h * _P + tok.hash[j : j + n]
            h = mix(h)
            hit = np.flatnonzero(bits[h >> np.uint64(44)] & (tok.doc[:n] == tok.doc[k - 1 :]))
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            for x in np.flatnonzero(hi > lo):
                for y in range(lo[x], hi[x]):
                    pairs.setdefault((int(tok.doc[hit[x]]), int(item[y])), []).append((int(place[y]), k))
        return sorted(pair for pair, seeds in pairs.items() if len({a + j for a, k in set(seeds) for j in range(k)}) >= self.need(pair[1]))

    def need(self, i: int) -> float:
        return self.coverage * self.sizes[i] - 1e-9

    coverage = COVERAGE

    def covered(self, i: int, text: np.ndarray) -> tuple[int, int]:
        found = tiles(self.items[i], text, min(self.least, int(self.sizes[i])))
        return sum(n for _, _, n in found), len(found)


_RESULT = "doc_id long, item_id long, covered int, item_tokens int, tiles int, coverage double"


def _rows(index: Index, hits: list[tuple]) -> pa.RecordBatch:
    """hits: (doc_id, item's place, covered, tiles)."""
    hits = [x for x in hits if x[2] >= index.need(x[1])]
    return record("doc_id item_id covered item_tokens tiles coverage", pa.array([x[0] for x in hits], pa.int64()), pa.array([index.ids[x[1]] for x in hits], pa.int64()), pa.array([x[2] for x in hits], pa.int32()), pa.array([int(index.sizes[x[1]]) for x in hits], pa.int32()), pa.array([x[3] for x in hits], pa.int32()), pa.array([round(float(x[2] / index.sizes[x[1]]), 6) for x in hits], pa.float64()))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, broadcast_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, item_id, covered, item_tokens, tiles, coverage) where tiles of the document cover the share of the item.

    Tiles may lie in any order, so reordered passages count. A document and an item are tiled if the seeds that they
    share (runs of least tokens) could cover the share, which loses none. Items shorter than a tile must occur whole.

    Null, empty or token-free texts and items match nothing; rows without doc_id or item_id are not reported; repeated
    rows are reported as often as they stand; empty tables give no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    benchmark = _items(benchmark)
    if not _small(benchmark, broadcast_bytes):
        rows = cut(docs.withColumn("row", F.monotonically_increasing_id()))
        return _by_seed(rows, benchmark, coverage, least).drop("row")
    shared = docs.sparkSession.sparkContext.broadcast(_index(benchmark, coverage, least))

    def run(batches):
        for batch in pieces(batches):
            hits = _hits(shared.value, batch)
            if hits:
                ids = batch.column("doc_id")
                yield _rows(shared.value, [(ids[d].as_py(), *x) for d, *x in hits])

    return docs.mapInArrow(run, _RESULT)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()


def _small(benchmark: DataFrame, limit: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= limit


def _index(benchmark: DataFrame, coverage: float, least: int) -> Index:
    """Of a benchmark that is known to be small."""
    rows = benchmark.orderBy("item_id", "text").collect()
    index = Index([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()), least)
    index.coverage = coverage
    return index


def _hits(index: Index, batch: pa.RecordBatch) -> list[tuple]:
    """(text's place, item's place, covered, tiles) of the candidates."""
    tok = Tokens(*lowered(batch))
    return [(d, i, *index.covered(i, tok.hash[tok.first[d] : tok.first[d + 1]])) for d, i in index.candidates(tok)]


def _seeds(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k tokens."""
    n = max(0, len(x) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _P + x[j : j + n]
    return mix(h)


def _map(seeds: DataFrame) -> np.ndarray:
    """A bit for the first MAP_BITS bits of each seed: of fixed size, put together from 64 parts."""
    part = MAP_BITS - 6

    def mark(key, table):
        bits = np.zeros(1 << part, bool)
        bits[table.column("low").to_numpy()] = True
        return pa.table({"part": [key[0].as_py()], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    cell = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    low = seeds.select(F.shiftrightunsigned(cell, part).alias("part"), cell.bitwiseAND((1 << part) - 1).alias("low")).distinct()
    out = np.zeros((64, 1 << part), bool)
    for r in low.groupBy("part").applyInArrow(mark, "part long, bits binary").collect():  # 64 rows of 128 kB
        out[r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return np.packbits(out.ravel())


def _by_seed(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int) -> DataFrame:
    """The same for benchmarks of any size, with the rows' numbers: docs (row, doc_id, text), written. Seeds of the texts that the map
    lets pass meet those of the items; what shares enough seeds to cover an item is tiled."""
    items = cut(benchmark.withColumn("item", F.monotonically_increasing_id()))

    def split(batches):
        for batch in pieces(batches):
            index = Index(batch.column("item").to_pylist(), batch.column("text"), least)
            for k, (keys, item, place, _) in index.seeds.items():
                yield record("k seed item place size", pa.array(np.full(len(keys), k), pa.int32()), keys.view(np.int64), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(place, pa.int32()), pa.array(index.sizes[item], pa.int32()))

    seeds = cut(items.mapInArrow(split, "k int, seed long, item long, place int, size int"))
    sizes = sorted(r[0] for r in seeds.select("k").distinct().collect())  # least and below
    known = docs.sparkSession.sparkContext.broadcast(_map(seeds))

    def texts(batches):
        for batch in pieces(batches):
            tok = Tokens(*lowered(batch))
            for k in sizes:
                h = _seeds(tok.hash, k)
                if not len(h):
                    continue
                cell = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                at = np.flatnonzero((known.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool) & (tok.doc[: len(h)] == tok.doc[k - 1 :]))
                if len(at):
                    pair = np.unique(np.stack([tok.doc[at].astype(np.uint64), h[at]]), axis=1)
                    yield record("k seed row", pa.array(np.full(pair.shape[1], k), pa.int32()), pair[1].view(np.int64), batch.column("row").take(pa.array(pair[0].astype(np.int64))))

    hits = docs.select("row", "text").mapInArrow(texts, "k int, seed long, row long").join(F.broadcast(seeds) if fits(seeds, 32) else seeds, ["k", "seed"])
    covered = hits.select("row", "item", "size", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("k") - 1)).alias("at")).distinct().groupBy("row", "item", "size").count()
    pairs = cut(covered.filter(F.col("count") >= F.col("size") * F.lit(coverage) - 1e-9).select("row", "item"))
    own = by_id(docs, cut(pairs.select(F.col("row").alias("__id")).distinct()), "left_semi", "row")

    def tile(batches):
        for batch in pieces(pieces(batches), "body"):
            tok = Tokens(*lowered(batch))
            index = Index(batch.column("item_id").to_pylist(), batch.column("body"), least)
            index.coverage = coverage
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row")
            hits = [(d, *index.covered(d, tok.hash[tok.first[d] : tok.first[d + 1]])) for d in range(batch.num_rows)]
            hits = [x for x in hits if x[1] >= index.need(x[0])]
            found = _rows(index, [(ids[d], d, *x) for d, *x in hits])
            yield pa.RecordBatch.from_arrays([rows.take(pa.array([x[0] for x in hits], pa.int64())), *found.columns], ["row", *found.schema.names])

    return pairs.join(own, "row").join(items.withColumnRenamed("text", "body"), "item").select("row", "doc_id", "text", "item_id", "body").mapInArrow(tile, f"row long, {_RESULT}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, broadcast_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns, whatever their names; see contaminated.

    Each row is judged by its own text, those without doc_id and those of repeated ids too. Rows with null or empty texts stay;
    an empty table gives no rows, an empty benchmark keeps all.
    """
    benchmark = _items(benchmark)
    if not _small(benchmark, broadcast_bytes):
        names = docs.columns
        rows = cut(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()))
        texts = rows.select("row", F.lit(0).cast("long").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text")).filter("text is not null")
        gone = cut(_by_seed(texts, benchmark, coverage, least).select(F.col("row").alias("__id")).distinct())
        return by_id(rows, gone, "left_anti", "row").drop("row").toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(_index(benchmark, coverage, least))

    def judge(batch):
        keep = np.ones(batch.num_rows, bool)
        keep[[d for d, i, n, _ in _hits(shared.value, batch) if n >= shared.value.need(i)]] = False
        return keep

    return filter_rows(docs, judge)
