"""Operator 1. Near copies: consistent weighted sampling over TF-IDF shingles, bands, weighted Jaccard."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, by_id, cut, doc_grams, fits, lists, lowered, mix, one_row_per_id, pieces, record
from .components import components

K = 3  # tokens of a shingle
THRESHOLD = 0.5  # weighted Jaccard similarity of near copies
BANDS, ROWS = 16, 3
BLOCK = 1024  # groups of a bucket that are compared with as many others at once
SLACK = 0.2  # by so much less than the threshold may the samples of two texts agree that are compared exactly
SLOT = 1_500_000  # shingles of prefixes that meet in one task
FAR = 1e30
MEETINGS = 2_000_000  # pairs of them that are looked at at once
SKETCH_BITS, SKETCH_MOST, SKETCH_ROWS = 19, 22, 2  # document frequencies: at least the true ones, about shingles / 2**bits texts too high
SKETCH_BYTES = 512  # of text to a cell, about 64 shingles: a larger table has a wider sketch, up to 2**SKETCH_MOST cells a row (32 MB)
MAP_BITS, MAP_MOST = 24, 28  # of the map of the shingles whose frequencies are counted exactly: 2 MB, and up to 32 MB if many are asked for
TOLD = 1 << 20  # frequencies that a task gathers before it sends them

_rng = np.random.default_rng(7)
_SKETCH = _rng.integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_ODD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gamma() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at 2**16 even steps."""
    x = np.linspace(0, 40, 1 << 21)
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)


_R = _gamma().astype(np.float32)
_INV, _LNC = (1 / _R).astype(np.float32), np.log(_R).astype(np.float32)


def cells(ids: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (ids * _SKETCH[row] >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(text_bytes: int) -> int:
    """Bits of a cell's place, so that about as many shingles share a cell however large the table is, up to SKETCH_MOST."""
    return min(max(SKETCH_BITS, (text_bytes // SKETCH_BYTES).bit_length()), SKETCH_MOST)


def _count(bits: int):
    """Each partition's sketch of document frequencies, in slices that are merged apart; slice -1 has the number of texts."""

    def run(batches):
        sketch, n, parts = np.zeros((SKETCH_ROWS, 1 << bits), np.uint32), 0, 64
        for batch in pieces(batches):
            _, ids, _ = doc_grams(Tokens(*lowered(batch)), K)
            n += batch.num_rows
            ids = mix(ids)
            for row in range(SKETCH_ROWS):
                np.add.at(sketch[row], cells(ids, row, bits), np.uint32(1))
        if n:
            yield record("part counts", [-1, *range(parts)], pa.array([np.array([n]).tobytes(), *(_pack([x]) for x in sketch.reshape(parts, -1))], pa.binary()))

    return run


def _merge(bits: int):
    def run(key, table):
        part, counts = key[0].as_py(), table.column("counts").to_pylist()
        if part < 0:
            total = sum((np.frombuffer(x, np.int64) for x in counts), np.zeros(1, np.int64))
        else:
            total = np.zeros(SKETCH_ROWS * (1 << bits) // 64, np.int64)
            for blob in counts:
                total += _unpack((("u4",),), (len(total),), blob)[0]
            total = total.astype(np.float32)
        return pa.table({"part": [part], "counts": pa.array([total.tobytes()], pa.binary())})

    return run


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts, and a count-min sketch of the shingles' document frequencies over all of them."""
    bits, schema = sketch_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0), "part long, counts binary"
    merge = _merge(bits)
    rows = docs.select("text").mapInArrow(_count(bits), schema).groupBy("part").applyInArrow(lambda key, table: merge(key, table), schema).collect()
    by = {r["part"]: np.frombuffer(r["counts"], np.int64 if r["part"] < 0 else np.float32) for r in rows}
    if not by:
        return 0, np.zeros((SKETCH_ROWS, 1 << bits), np.float32)
    return int(by[-1][0]), np.concatenate([by[p] for p in range(64)]).reshape(SKETCH_ROWS, -1)


def weights(ids: np.ndarray, counts: np.ndarray, n: int, sketch: np.ndarray) -> np.ndarray:
    """TF-IDF: count x ln(1 + n / document frequency). ids: mixed."""
    return counts * np.log1p(n / np.maximum(frequencies(ids, sketch), 1)).astype(np.float32)


def frequencies(ids: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([own[cells(ids, r, len(own).bit_length() - 1)] for r, own in enumerate(sketch)])


def signature(ids: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of one text: hashes of (shingle, level), equal with the probability of the weighted Jaccard similarity."""
    best, out = np.full(len(_ODD), np.inf, np.float32), np.zeros(len(_ODD), np.uint64)
    for a in range(0, len(ids), 2048):
        own, lw = ids[a : a + 2048], np.log(w[a : a + 2048]).astype(np.float32)
        z = _ODD[:, None] * own[None, :]
        i = z >> np.uint64(48)
        beta = ((z >> np.uint64(16)).astype(np.uint16)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(lw * _INV[i] + beta)
        score = _LNC[(z >> np.uint64(32)).astype(np.uint16)] - _R[i] * (t - beta + 1)
        at = score.argmin(1)
        rows = np.arange(len(_ODD))
        low, hit = score[rows, at], own[at] + (t[rows, at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out = np.where(low < best, hit, out)
        best = np.minimum(best, low)
    return mix(out)


def _content(data: np.ndarray, offsets: np.ndarray, d: int) -> bytes:
    return hashlib.blake2b(data[offsets[d] : offsets[d + 1]], digest_size=16).digest()


def _signatures(n: int, sketch):
    def run(batches):
        for batch in pieces(batches):
            data, offsets = lowered(batch)
            doc, ids, counts = doc_grams(Tokens(data, offsets), K)
            ids = mix(ids)
            w = weights(ids, counts, n, sketch.value)
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            full = np.flatnonzero(np.diff(edges))
            keys = np.zeros((len(full), BANDS), np.uint64)
            content, samples = np.zeros((len(full), 2), np.int64), []
            for row, d in enumerate(full):
                own = slice(edges[d], edges[d + 1])
                sample = signature(ids[own], w[own])
                samples.append((sample >> np.uint64(56)).astype(np.uint8).tobytes())
                keys[row] = mix((sample * _BAND).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                content[row] = np.frombuffer(_content(data, offsets, d), np.int64)
            yield record("id c0 c1 bands samples", batch.column("doc_id").take(pa.array(full)), content[:, 0], content[:, 1], lists(keys.view(np.int64).ravel(), np.full(len(full), BANDS)), pa.array(samples, pa.binary()))

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (ids, weights), ids in order."""
    ids = np.concatenate([a[0], b[0]])
    order = np.argsort(ids, kind="stable")
    ids, w = ids[order], np.concatenate([a[1], b[1]])[order]
    same = np.flatnonzero(ids[1:] == ids[:-1])
    low = np.minimum(w[same], w[same + 1]).sum(dtype=np.float64)
    return float(low / max(w.sum(dtype=np.float64) - low, 1e-30))


def bounds(ids: np.ndarray, n: int, sketch: np.ndarray, least: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ln(1 + n / document frequency) is at least, by the sketch, and at most, if so many texts have the shingle. ids: mixed."""
    low = np.log1p(n / np.maximum(frequencies(ids, sketch).astype(np.float64), 1))
    return low, np.maximum(low, np.log1p(n / np.asarray(least, np.float64)))


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of two texts' (ids, counts), with the less and the greater count of each."""
    ids, counts = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(ids, kind="stable")
    ids, counts = ids[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    most = np.maximum.reduceat(counts, at)
    return ids[at], np.add.reduceat(counts, at) - most, most


_JUDGED = "a long, b long, open boolean, pairs long, shingles long, data binary"
_PACKED = "slot long, pairs long, shingles long, data binary"
_ASKED, _TOLD = (("i8", "i8", "i8", "u4"), ("V5", "u4", "u4")), ((), ("V5", "u4"))


def _judge(n: int, sketch, threshold: float, packed: bool):
    """(a, b) of the pairs of texts that reach the threshold whatever the true document frequencies are, which the sketch bounds.

    And those that may reach it, as open; packed: many to a row, ids, a hash of the two texts and number of shingles of each pair; then
    id, less and greater count of each shingle.
    """

    def run(batches):
        for batch in pieces(pieces(batches, "text_a"), "text_b"):
            own = [batch.column(c).to_numpy() for c in "ab"]
            sides, raw_texts = [], []
            for c in ("text_a", "text_b"):
                data, offsets = lowered(batch, c)
                doc, ids, counts = doc_grams(Tokens(data, offsets), K)
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                sides.append([(ids[x:y], counts[x:y]) for x, y in zip(edges, edges[1:])])
                raw_texts.append((data, offsets))
            sure, unsure = [], []
            for i, (x, y) in enumerate(zip(*sides)):
                if not len(x[0]) or not len(y[0]):
                    continue
                ids, less, most = _overlap(x, y)
                gain = less - threshold * most  # they reach the threshold if the sum of gain x ln(1 + n / df) is no less than 0
                low, high = bounds(mix(ids), n, sketch.value, np.where(less > 0, 2, 1))
                slack = 1e-6 * float(high @ most)
                if float(np.where(gain > 0, low, high) @ gain) > slack:
                    sure.append(i)
                elif float(np.where(gain > 0, high, low) @ gain) >= -slack:
                    texts = np.frombuffer(b"".join(_content(*t, i) for t in raw_texts), np.uint64)
                    unsure.append((i, mix(texts + np.arange(4, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64), ids, less, most))
            if sure:
                yield _rows(a=own[0][sure], b=own[1][sure])
            at = [u[0] for u in unsure]
            if unsure and not packed:
                yield _rows(a=own[0][at], b=own[1][at], open=[True] * len(at))
            elif unsure:
                texts, count = np.array([u[1] for u in unsure], np.int64), np.array([len(u[2]) for u in unsure], np.uint32)
                ids, less, most = (np.concatenate([u[c] for u in unsure]) for c in (2, 3, 4))
                data = _pack([own[0][at], own[1][at], texts, count, _short(ids), less.astype(np.uint32), most.astype(np.uint32)])
                yield _rows(open=[True], pairs=[len(at)], shingles=[len(ids)], data=[data])

    return run


def _split(slots: int):
    """The packed pairs by slots of their shingles."""

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pairs", "shingles", "data"))):
                a, b, texts, count, short, less, most = _unpack(_ASKED, row[:2], row[2])
                pair, ids, rows = np.repeat(np.arange(len(a)), count), _long(short), []
                short = _short(ids // np.uint64(slots))
                for slot, k in _by_slot(ids, slots):
                    some, own = np.unique(pair[k], return_counts=True)
                    rows.append((slot, len(some), len(k), _pack([a[some], b[some], texts[some], own.astype(np.uint32), short[k], less[k], most[k]])))
                yield _packed("pairs", rows)

    return run


def _packed(counted: str, rows: list[tuple]) -> pa.RecordBatch:
    return record(f"slot {counted} shingles data", *[pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))])


def _rows(**columns) -> pa.RecordBatch:
    """Rows of _JUDGED; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    kinds = {"data": pa.binary(), "open": pa.bool_()}
    return record("a b open pairs shingles data", *[pa.array(columns.get(c, [None] * size), kinds.get(c, pa.int64())) for c in ("a", "b", "open", "pairs", "shingles", "data")])


def _by_slot(ids: np.ndarray, slots: int) -> list[tuple[int, np.ndarray]]:
    """The places of the ids of each slot, in order; in a slot the quotients by the number of slots tell them apart."""
    slot = (ids % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    edge = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))
    return [(int(slot[x]), order[x:y]) for x, y in zip(edge, edge[1:])]


def _short(ids: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(ids).view(np.uint8).reshape(-1, 8)[:, :5]


def _long(ids: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ids), 8), np.uint8)
    out[:, :5] = ids.view(np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _pack(columns: list[np.ndarray]) -> bytes:
    """The columns, of each all first bytes, then all second ones and so on, compressed: those that hardly differ take next to nothing."""
    return pa.Codec("zstd", 1).compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns if len(c)), asbytes=True)


def _unpack(kinds: tuple, sizes: tuple, data: bytes) -> list[np.ndarray]:
    """Columns of the kinds, so many of each tuple of kinds."""
    columns = [(np.dtype(k), n) for some, n in zip(kinds, sizes) for k in some]
    flat, at, out = pa.Codec("zstd").decompress(data, sum(k.itemsize * n for k, n in columns), asbytes=True), 0, []
    for kind, n in columns:
        planes = np.frombuffer(flat, np.uint8, kind.itemsize * n, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += kind.itemsize * n
    return out


def _marks(asked: DataFrame, bits: int) -> np.ndarray:
    """A bit for the first so many bits of the mixed id of each shingle asked for: put together from 64 parts."""
    size = (1 << bits) // 512

    def mark(batches):
        map_ = np.zeros(64 * size, np.uint8)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pairs", "shingles", "data"))):
                cell = np.unique(mix(_long(_unpack(_ASKED, row[:2], row[2])[4])) >> np.uint64(64 - bits)).astype(np.int64)
                np.bitwise_or.at(map_, cell >> 3, np.uint8(128) >> (cell & 7).astype(np.uint8))
        parts = [(i, _pack([x])) for i, x in enumerate(map_.reshape(64, -1)) if x.any()]
        if parts:
            yield record("part bits", pa.array([i for i, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary()))

    def merge(key, table):
        total = np.zeros(size, np.uint8)
        for x in table.column("bits").to_pylist():
            total |= _unpack((("u1",),), (size,), x)[0]
        return pa.table({"part": key[0:1], "bits": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((64, size), np.uint8)
    for r in asked.mapInArrow(mark, "part long, bits binary").groupBy("part").applyInArrow(lambda key, table: merge(key, table), "part long, bits binary").collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _tell(known, bits: int, slots: int):
    """Of the shingles that the map lets pass, packed by slots: quotient less that before, and number of texts, of TOLD shingles at once."""

    def told(parts):
        ids, count = np.unique(np.concatenate(parts), return_counts=True)
        of_slots = [(slot, k, np.diff(ids[k] // np.uint64(slots), prepend=np.uint64(0))) for slot, k in _by_slot(ids, slots)]
        return _packed("pairs", [(slot, 0, len(k), _pack([_short(steps), count[k].astype(np.uint32)])) for slot, k, steps in of_slots])

    def run(batches):
        parts, size = [], 0
        for batch in pieces(batches):
            _, ids, _ = doc_grams(Tokens(*lowered(batch)), K)
            cell = (mix(ids) >> np.uint64(64 - bits)).astype(np.int64)
            ids = ids[(known.value[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)]
            parts.append(ids)
            size += len(ids)
            if size >= TOLD:
                yield told(parts)
                parts, size = [], 0
        if size:
            yield told(parts)

    return run


def _weigh(n: int, threshold: float):
    """(a, b, texts, score, scale) of the pairs of a slot by true document frequencies: their sum is no less than 0 where they reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, told = [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("pairs", "shingles", "data"))):
                (asked if row[0] else told).append(row)
        if not asked:
            return
        a, b, texts, count, ids, less, most = (np.concatenate(c) for c in zip(*(_unpack(_ASKED, row[:2], row[2]) for row in asked)))
        ids, at = np.unique(_long(ids), return_inverse=True)
        df = np.zeros(len(ids), np.int64)
        for row in told:
            own, texts_with = _unpack(_TOLD, row[:2], row[2])
            own = np.cumsum(_long(own))
            place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            hit = ids[place] == own
            df[place[hit]] += texts_with[hit]  # ids of a row differ
        g = np.log1p(n / df)[at]
        pair = np.repeat(np.arange(len(a)), count)
        score, scale = np.bincount(pair, g * (less - threshold * most), len(a)), np.bincount(pair, g * most, len(a))
        yield record("a b texts score scale", a, b, texts, score, scale)

    return run


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids with their texts; only texts in pairs are shuffled."""
    texts = docs.select(F.col("doc_id").alias("__d"), "text")
    sides = [by_id(texts, cut(pairs.select(F.col(c).alias("__id")).distinct()), "left_semi", "__d").select(F.col("__d").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")


def _compared(pairs: DataFrame, docs: DataFrame, n: int, sketch, threshold: float) -> DataFrame:
    """(a, b, sure) of the pairs of ids whose texts may reach the threshold; sure: they do, whatever the true document frequencies are."""
    return cut(_with_texts(pairs, docs).mapInArrow(_judge(n, sketch, threshold, False), _JUDGED).select("a", "b", F.col("open").isNull().alias("sure")))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b), once each, whose labels (node, label) differ."""
    for c in "ab":
        own = label.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
        pairs = pairs.join(own, c, "left").withColumn(f"label_{c}", F.coalesce(f"label_{c}", c))
    return cut(pairs.filter("label_a <> label_b").select("a", "b").distinct())


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, n: int, sketch, threshold: float, shingles: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts reach the threshold by the true document frequencies over docs, which have so many shingles.

    Where the sketch's bounds leave it open, the frequencies of the pair's shingles are counted: pairs and texts send theirs to slots, of
    which there are as many as these need.
    """
    judged = cut(_with_texts(pairs, known).mapInArrow(_judge(n, sketch, threshold, True), _JUDGED))
    sure = judged.filter("open is null").select("a", "b")
    asked = judged.filter("open").select("pairs", "shingles", "data")
    size = asked.agg(F.sum("shingles")).first()[0]
    if not size:
        return sure
    bits = min(max(MAP_BITS, (4 * size).bit_length()), MAP_MOST)
    marks = _marks(asked, bits)
    passing = float(np.bitwise_count(marks).sum()) / (1 << bits)
    slots = int((size + passing * shingles / 8) / SLOT) + 1  # frequencies stay packed in a task, in an eighth of the room or less
    marks = docs.sparkSession.sparkContext.broadcast(marks)
    told = docs.select("text").mapInArrow(_tell(marks, bits, slots), _PACKED)
    parts = asked.mapInArrow(_split(slots), _PACKED).unionByName(told).groupBy("slot").applyInArrow(_weigh(n, threshold), "a long, b long, texts long, score double, scale double")
    sums = parts.groupBy("a", "b", "texts").agg(F.sum("score").alias("score"), F.sum("scale").alias("scale"))
    return cut(sure.unionByName(sums.filter("score >= -1e-9 * scale").select("a", "b")))


def _alike(least: float):
    """(a, b) of the rows of one place: of each key, those of block i with those of block j whose samples agree as often as least or more."""

    def run(table):
        rep, key, block = (table.column(c).to_numpy() for c in ("rep", "key", "block"))
        samples = np.frombuffer(b"".join(table.column("samples").to_pylist()), np.uint8).reshape(len(rep), -1)
        order = np.lexsort((rep, block, key))
        rep, key, block, samples = rep[order], key[order], block[order], samples[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        found = []
        for x, y in zip(edge, edge[1:]):
            mid = x + int(np.searchsorted(block[x:y], block[x], "right"))  # the second block begins here, if there is one
            for i in range(x, mid if mid < y else y - 1):
                near = samples[mid if mid < y else i + 1 : y]
                hit = np.flatnonzero((near == samples[i]).sum(1) >= least)
                other = rep[(mid if mid < y else i + 1) + hit]
                found.append(np.stack([np.minimum(rep[i], other), np.maximum(rep[i], other)]))
        a, b = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": a, "b": b})

    return run


def _between(apart: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the groups of each bucket (key, rep) that may be near copies by their samples.

    A bucket of more than BLOCK groups is split into blocks, each pair of which is a task's of its own; small buckets share tasks.
    """
    sizes = cut(apart.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).filter("n > 1"))
    places = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // (4 * BLOCK))
    rows = apart.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lone = F.concat(F.lit("p"), F.pmod(F.xxhash64("key"), F.lit(places)).cast("string"))
    pair = F.concat_ws(" ", F.col("key").cast("string"), F.least("block", "j").cast("string"), F.greatest("block", "j").cast("string"))
    rows = rows.select("key", "rep", "block", F.when(F.col("blocks") == 1, lone).otherwise(pair).alias("place"))
    ids = cut(rows.select(F.col("rep").alias("__id")).distinct())
    own = by_id(first.select(F.col("rep").alias("__r"), "samples"), ids, "left_semi", "__r")
    least = max(1.0, (threshold - SLACK) * BANDS * ROWS)
    met = rows.join(own, F.col("rep") == F.col("__r")).select("place", "key", "rep", "block", "samples")
    return met.groupBy("place").applyInArrow(lambda table: _alike(least)(table), "a long, b long").distinct()


def _prefixes(n: int, sketch, threshold: float, slots: int):
    """Each text's prefix, by slots of shingles: the rarest shingles, up to where less than the threshold of its weight is left.

    Shingles are in one order for all texts, by the sketch's frequency and id, so the first that two near copies share is in both
    prefixes. Their true weights g lie between low and high. If texts x and y reach the threshold t, then the sum of g (1 + t) less
    over what they share is t times that of g (x + y) or more, where less is the less of the two counts; low for g beyond what they
    share, and high there, shows that the sum of less ((1 - t) high + 2 t low) is t times the low weights of both or more. For one text,
    the sum of less ((1 - t) high + t low) is t times its low weight or more.

    A row holds prefixes of some texts in one slot, packed: id less that before, label less id, low weight, joint weight
    ((1 - t) high + 2 t low) / (1 + t), that beyond the prefix, frequency at the prefix's end and number of shingles of each text; then
    quotient, joint weight and share of the text's joint weight from there on of each shingle. The low weight is rounded down, the others
    up. The more slots there are, the more often a text comes, so what comes of it is short.
    """

    def run(batches):
        for batch in pieces(batches):
            data, offsets = lowered(batch)
            doc, ids, counts = doc_grams(Tokens(data, offsets), K)
            skip = np.zeros(batch.num_rows, bool)
            for d, hashes in enumerate(batch.column("copies").to_pylist()):
                skip[d] = bool(hashes) and np.frombuffer(_content(data, offsets, d), np.int64)[0] in hashes
            keep = ~skip[doc]
            doc, ids, counts = doc[keep], ids[keep], counts[keep]
            if not len(doc):
                continue
            mixed = mix(ids)
            df = frequencies(mixed, sketch.value)
            order = np.lexsort((ids, df, doc))
            doc, ids, mixed, counts, df = doc[order], ids[order], mixed[order], counts[order], df[order]
            low, high = bounds(mixed, n, sketch.value, 2)  # one that they share is in two texts
            start = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            weight, joint, single = counts * low, counts * ((1 - threshold) * high + 2 * threshold * low) / (1 + threshold), counts * ((1 - threshold) * high + threshold * low)
            sums, joint_sums, single_sums = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, joint, single))
            total, joint_total = (x[start[1:]] - x[start[:-1]] for x in (sums, joint_sums))
            left, single_left = (x[start[doc + 1]] - x[:-1] for x in (joint_sums, single_sums))
            at = np.flatnonzero(single_left >= threshold * total[doc] * (1 - 1e-6))
            size = np.bincount(doc[at], minlength=batch.num_rows)
            last = np.maximum(start[:-1] + size - 1, 0)  # a text's prefix are its first shingles
            last = np.minimum(last, len(doc) - 1)
            end, rest = df[last], left[last] - joint[last]
            own, label = (batch.column(c).to_numpy() for c in ("doc_id", "label"))
            low_, joint_, rest_ = _brief(total, np.floor), _brief(joint_total, np.ceil), _brief(rest, np.ceil)
            brief, rows = (low_, joint_ - low_, joint_ - rest_, _brief(end, np.ceil)), []  # differences modulo 2**16
            for slot, k in _by_slot(ids[at], slots):
                i = at[k]
                texts, count = np.unique(doc[i], return_counts=True)
                share = np.ceil(left[i] / joint_total[doc[i]] * 255).clip(0, 255).astype(np.uint8)
                with np.errstate(over="ignore"):
                    most = (joint[i] * 1.001).astype(np.float16)
                of_texts = [x[texts] for x in brief]
                rows.append((slot, len(texts), len(i), _pack([np.diff(own[texts], prepend=0), label[texts] - own[texts], *of_texts, count.astype(np.uint32), _short(ids[i] // np.uint64(slots)), most, share])))
            yield _packed("texts", rows)

    return run


_KINDS = ("i8", "i8", "u2", "u2", "u2", "u2", "u4"), ("V5", "f2", "u1")  # of each text, of each shingle


def _brief(x: np.ndarray, rounded) -> np.ndarray:
    """The logarithms of numbers up to 1e12 in 16 bits, in order; what is 1e-7 or less is 0, or next to it if it is rounded up."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, (rounded((np.log(np.maximum(x, 0).astype(np.float64)) + 16) * 1500) + 1).clip(rounded(0.5), 65535), 0).astype(np.uint16)


def _full(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.exp((x.astype(np.float64) - 1) / 1500 - 16), 0)


def _meet(threshold: float):
    """(a, b, common, lack) of the texts of different labels that share shingles of their prefixes in a slot, if their weights allow.

    common: the joint weight shared there; lack: what near copies share of both prefixes at least, or FAR if none of the shingles leaves
    as much from there on as near copies share, as the first that they share does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        parts = [_unpack(_KINDS, row[:2], row[2]) for row in zip(*(table.column(c).to_pylist() for c in ("texts", "shingles", "data")))]
        own, label, total, joint, rest, end, count, raw_key, weight, share = (np.concatenate(c) for c in zip(*([np.cumsum(p[0]), *p[1:]] for p in parts)))
        label = own + label
        joint += total
        total, joint, rest = _full(total), _full(joint), _full(joint - rest)
        text, key = np.repeat(np.arange(len(own)), count), _long(raw_key)
        order = np.lexsort((label[text], key))
        key, text, weight, share = key[order], text[order], weight[order].astype(np.float32), share[order]
        total, joint, rest = total * (1 - 1e-9), joint * (1 + 1e-9), rest * (1 + 1e-5)
        tag = label[text]
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        run_ends = np.flatnonzero(new | np.concatenate([[True], tag[1:] != tag[:-1], [True]]))
        key_ends = np.flatnonzero(new)
        after = np.repeat(run_ends[1:], np.diff(run_ends))  # each meets those of its key from there on, whose labels are others
        n = np.repeat(key_ends[1:], np.diff(key_ends)) - after
        some = np.flatnonzero(n)
        at = 0
        sums = np.cumsum(n[some])
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + MEETINGS, "right")))
            i = np.repeat(some[at:to], n[some[at:to]])
            first = np.cumsum(n[some[at:to]]) - n[some[at:to]]
            j = after[i] + np.arange(len(i)) - np.repeat(first, n[some[at:to]])
            at = to
            need = threshold / (1 + threshold) * (total[text[i]] + total[text[j]]) * (1 - 1e-4)
            fit = np.minimum(joint[text[i]], joint[text[j]]) >= need
            i, j, need = i[fit], j[fit], need[fit]
            x, y = text[i], text[j]
            early = np.minimum(joint[x] * share[i], joint[y] * share[j]) >= need * 255
            beyond = np.where(end[x] < end[y], rest[x], np.where(end[x] > end[y], rest[y], np.maximum(rest[x], rest[y])))
            a, b = np.minimum(own[x], own[y]), np.maximum(own[x], own[y])
            lack = np.where(early, np.maximum(need - beyond, 0), FAR)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            edge = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            if len(edge):
                low = np.minimum(weight[i], weight[j]).astype(np.float64)[order]
                yield record("a b common lack", a[edge], b[edge], (np.add.reduceat(low, edge) * (1 + 1e-6)).astype(np.float32), (np.minimum.reduceat(lack[order], edge) * (1 - 1e-6)).astype(np.float32))

    return run


def _missed(known: DataFrame, copies: DataFrame, label: DataFrame, done: DataFrame, docs: DataFrame, n: int, sketch, threshold: float, shingles: float) -> DataFrame:
    """Exactly the pairs (a, b) of different labels (node, label) that reach the threshold, by prefixes; known rows whose contents (id, c0) are copies
    and the pairs that are done are left out."""
    marks = label.select(F.col("node").alias("__id"), "label", F.lit(None).cast("long").alias("c0")).unionByName(copies.select(F.col("id").alias("__id"), F.lit(None).cast("long").alias("label"), "c0"))
    marks = cut(marks.groupBy("__id").agg(F.max("label").alias("label"), F.collect_set("c0").alias("copies")))
    side = F.broadcast(marks) if fits(marks, 64) else marks
    rows = known.join(side, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", F.coalesce("label", "doc_id").alias("label"), "copies")
    packed = rows.mapInArrow(_prefixes(n, sketch, threshold, int(shingles / 2 / SLOT) + 1), "slot long, texts long, shingles long, data binary")
    met = packed.groupBy("slot").applyInArrow(_meet(threshold), "a long, b long, common float, lack float")
    sums = met.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("lack").alias("lack"))
    may = cut(sums.filter((F.col("lack") < FAR / 2) & (F.col("common") >= F.col("lack"))).select("a", "b").join(done, ["a", "b"], "left_anti"))
    return _verified(may, known, docs, n, sketch, threshold, shingles)


def _links(label: DataFrame) -> DataFrame:
    return label.select(F.col("node").alias("a"), F.col("label").alias("b"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id): every document that has near copies, but the one of the least id of its group, with that one.

    Shingles of K tokens weigh count x ln(1 + N / df). Two documents are near copies if the weighted Jaccard similarity
    is at least the threshold; groups are the connected components. First, most groups are found by bands of ROWS consistent
    weighted samples: each document of a bucket is compared with its first; of the groups that this leaves apart, one document
    each is compared with those of the others, by their samples, in blocks. That misses pairs; so all documents that are still
    in different groups meet by prefix filtering, which misses none, and those that may reach the threshold are compared
    exactly. A sketch bounds the document frequencies df; where the bounds leave a pair open, they are counted. Texts that are equal in lower case are one before that, so thousands of copies cost one comparison.

    Null and empty texts, and texts without a token, have no shingles and no copies. Rows without doc_id count in the
    frequencies only. Repeated rows of a doc_id count once here. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    n, frequencies = document_frequencies(docs)
    sketch = docs.sparkSession.sparkContext.broadcast(frequencies)
    known = docs.filter("doc_id is not null")
    signed = cut(known.mapInArrow(_signatures(n, sketch), "id long, c0 long, c1 long, bands array<long>, samples binary"))
    first = cut(signed.groupBy("c0", "c1").agg(F.min(F.struct("id", "bands", "samples")).alias("first")).select("c0", "c1", F.col("first.id").alias("rep"), "first.bands", "first.samples"))
    alike = cut(signed.select("id", "c0", "c1").join(first.select("c0", "c1", "rep"), ["c0", "c1"]).filter("id <> rep").select("id", "rep", "c0").distinct())
    rows = first.select("rep", F.explode("bands").alias("key"))
    leads = rows.groupBy("key").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).filter("size > 1").drop("size")
    rows = cut(rows.join(leads, "key"))
    pairs = cut(rows.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    led = _compared(pairs, known, n, sketch, threshold)
    label = components(led.filter("sure").select("a", "b"))
    apart = rows.join(label, F.col("rep") == F.col("node"), "left").groupBy("key", F.coalesce("label", "rep").alias("group")).agg(F.min("rep").alias("rep"))
    new = _between(cut(apart.select("key", "rep")), first, threshold)
    met = _compared(cut(new.join(pairs, ["a", "b"], "left_anti")), known, n, sketch, threshold)
    found = led.unionByName(met)
    label = components(found.filter("sure").select("a", "b").unionByName(alike.select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    shingles = float(frequencies[0].sum(dtype=np.float64))
    asked = _apart(found.filter("not sure").select("a", "b"), label)
    label = components(_links(label).unionByName(_verified(asked, known, docs, n, sketch, threshold, shingles)))
    missed = _missed(known, alike, label, asked, docs, n, sketch, threshold, shingles)
    label = components(_links(label).unionByName(missed))
    return label.select(F.col("node").alias("doc_id"), F.col("label").alias("kept_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near copies: that of the least id, or one row without an id where no other is; a repeated id
    keeps one row."""
    if docs.filter("doc_id is null").isEmpty():
        gone = cut(near_duplicates(docs, threshold).select(F.col("doc_id").alias("__id")))
        return by_id(one_row_per_id(docs), gone, "left_anti")
    names = docs.columns
    known = docs.filter("doc_id is not null")
    lost = _numbered(docs.filter("doc_id is null").toDF(*[f"c{i}" for i in range(len(names))]), known)
    texts = known.select("doc_id", "text").unionByName(lost.select(F.col("row").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text")))
    near = cut(near_duplicates(texts, threshold))
    near = near.unionByName(near.select(F.col("kept_id").alias("doc_id"), "kept_id").distinct())
    near = cut(near.join(lost.select("row"), F.col("doc_id") == F.col("row"), "left").select("doc_id", "kept_id", F.col("row").isNotNull().alias("lost")))
    kept = near.groupBy("kept_id").agg(F.min(F.struct("lost", "doc_id")).alias("kept"))
    gone = cut(near.join(kept, "kept_id").filter("doc_id <> kept.doc_id").select(F.col("doc_id").alias("__id")))
    return by_id(one_row_per_id(known), gone, "left_anti").unionByName(by_id(lost, gone, "left_anti", "row").drop("row").toDF(*names))


def _numbered(lost: DataFrame, known: DataFrame) -> DataFrame:
    """The rows without an id, written, with a number (row) each that is no id of the known ones."""
    rows = cut(lost.withColumn("row", F.monotonically_increasing_id()))
    rng = random.Random(11)
    while True:
        own = rows.withColumn("row", F.col("row").bitwiseXOR(F.lit(rng.getrandbits(63))))
        if own.select("row").join(known.select("doc_id"), F.col("row") == F.col("doc_id"), "left_semi").isEmpty():
            return own
