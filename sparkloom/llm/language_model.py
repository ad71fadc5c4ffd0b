"""Operator 7. LM scoring: quantised n-gram counts in a log-frequency Bloom filter, read back by repeated probes."""

from __future__ import annotations

import math
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, cut, lowered, mix, pieces, raw, record

ORDER = 3
BASE = 1.5  # counts are told apart by powers of it
WEIGHTS = (0.1, 0.3, 0.6)  # of the orders 1, 2, 3 in the interpolation
FLOOR = 1.0  # added to the count of every word
BITS_PER_ENTRY, PROBE_BITS = 16, 5
#: Filters are broadcast up to so many bytes, of which every worker holds a copy; beyond, the documents' n-grams go to the
#: filter's slices, and their levels come back.
BROADCAST_BYTES = 8 << 20
SLICE_BYTES = 6_000_000  # of the corpus for each slice of the filter
MOST_SLICES = 1 << 17
PART_BYTES = 4 << 20  # of texts whose n-grams are counted together; a longer text is a part of its own

_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1], np.uint64)
LEVELS = 1 + int(math.log(2**62, BASE))
#: The count that a level stands for: the middle, on the log scale, of those quantised to it.
VALUE = np.array([0.0, *[max(1.0, BASE ** (q - 0.5)) if q > 1 else 1.0 for q in range(1, LEVELS + 2)]])


def quantise(counts: np.ndarray) -> np.ndarray:
    """Levels 1, 2, ... of counts 1, 2, ...: 1 + floor(log BASE of the count)."""
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def ngrams(tok: Tokens) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each order: the place of each n-gram's last token, and its hash. N-grams lie within a text."""
    out, h = [], tok.hash
    for k in range(1, ORDER + 1):
        n = max(0, len(h) - k + 1)
        acc = np.zeros(n, np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        at = np.flatnonzero(tok.doc[:n] == tok.doc[k - 1 : k - 1 + n]) if n else np.zeros(0, np.int64)
        out.append((at + k - 1, mix(acc[at] ^ _SALT[k - 1])))
    return out


def slices_of(h: np.ndarray, n: int) -> np.ndarray:
    """The slice of each hash; sorted hashes have sorted slices."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as their differences, seven bits a byte."""
    d = np.diff(values, prepend=np.uint64(0))
    out = np.zeros((len(d), 10), np.uint8)
    width = np.ones(len(d), np.int64)
    for k in range(10):
        part = d >> np.uint64(7 * k)
        more = part >= np.uint64(128)
        out[:, k] = (part & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8) << 7
        width += more
        if not more.any():
            break
    return out[np.arange(10)[None, :] < width[:, None]].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.cumsum(np.add.reduceat(parts, first), dtype=np.uint64)


def _parts(batches):
    """Rows of about PART_BYTES of texts, packed: (part, blob). Numbers of parts are random, and so distinct; they are written before use."""
    held, size = [], 0

    def hand_on():
        table = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.combine_chunks())
        return record("part blob", pa.array([secrets.randbits(62)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()))

    for batch in pieces(batches):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if size >= PART_BYTES:
            yield hand_on()
            held, size = [], 0
    if held:
        yield hand_on()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def _part_grams(table: pa.Table) -> tuple[Tokens, list[tuple[np.ndarray, np.ndarray]]]:
    """The tokens of a part, and of each order the places and hashes of its n-grams."""
    text = table.column("text")
    data, offsets = raw(pc.utf8_lower(pc.fill_null(text.chunk(0) if text.num_chunks else pa.array([], pa.string()), "")))
    tok = Tokens(data, offsets)
    return tok, ngrams(tok)


def _gather(slices: int, counts: bool, asks: bool):
    """The distinct n-grams of each part, as (slice, part, gram, packed hashes, packed counts). Without counts they are only asked for;
    where nothing is asked, part is -1."""

    def run(batches):
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob")):
                _, grams = _part_grams(_unpacked(blob.as_buffer()))
                for k, (_, h) in enumerate(grams):
                    h = np.sort(h >> np.uint64(16))  # 48 bits
                    if not len(h):
                        continue
                    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                    n = np.diff(np.append(edge, len(h))) if counts else np.zeros(len(edge), np.int64)
                    h = h[edge]
                    bounds = np.searchsorted(slices_of(h << np.uint64(16), slices), np.arange(slices + 1))
                    some = np.flatnonzero(np.diff(bounds))
                    spans = list(zip(bounds[some], bounds[some + 1]))
                    yield record("slice part gram grams counts", some, pa.array(np.full(len(some), part if asks else -1), pa.int64()), pa.array(np.full(len(some), k), pa.int32()), pa.array([pack(h[a:b]) for a, b in spans], pa.binary()), pa.array([pack(np.cumsum(n[a:b], dtype=np.uint64)) for a, b in spans], pa.binary()))

    return run


def masks(entries: np.ndarray) -> np.ndarray:
    """The bits of a 64-bit word that stand for an entry."""
    x, out = mix(entries), np.zeros(len(entries), np.uint64)
    for p in range(PROBE_BITS):
        out |= np.uint64(1) << (x >> np.uint64(6 * p) & np.uint64(63))
    return out


def _entry(h: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """The entry of the n-gram hashes (their first 48 bits) at the level."""
    return mix((h >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(level).astype(np.uint64))


def _word(entry: np.ndarray, words: np.ndarray | int) -> np.ndarray:
    return ((entry >> np.uint64(32)) * np.asarray(words).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _slice(table: pa.Table) -> tuple[np.ndarray, int, int, list, dict]:
    """One slice of the filter from its rows: bits, in which every n-gram is at all levels from 1 to its own; tokens and distinct words;
    the rows (part, order, hashes, counts); and of each order the distinct hashes, its rows, and where in them each row's are."""
    rows = [(p, k, unpack(g), np.diff(unpack(c), prepend=np.uint64(0))) for p, k, g, c in zip(*(table.column(x).to_pylist() for x in ("part", "gram", "grams", "counts")))]
    entries, tokens, kinds, distinct = [], 0, 0, {}
    for k in range(ORDER):
        own = [i for i, r in enumerate(rows) if r[1] == k]
        if not own:
            continue
        g, c = (np.concatenate([rows[i][x] for i in own]) for x in (2, 3))
        order = np.argsort(g, kind="stable")  # merges the rows, which are sorted
        g = g[order]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        c, g = np.add.reduceat(c[order], np.flatnonzero(first)), g[first]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(first) - 1
        distinct[k] = g, own, np.split(place, np.cumsum([len(rows[i][2]) for i in own])[:-1])
        g, c = g[c > 0], c[c > 0]
        if k == 0:
            tokens, kinds = int(c.sum()), len(g)
        level = quantise(c)
        h = np.repeat(g << np.uint64(16), level)
        entries.append(_entry(h, np.arange(len(h)) - np.repeat(np.cumsum(level) - level, level) + 1))
    entries = np.concatenate([np.zeros(0, np.uint64), *entries])
    words = max(1, -(-len(entries) * BITS_PER_ENTRY // 64))
    at, bit = _word(entries, words), masks(entries)
    order = np.argsort(at)
    at, bit = at[order], bit[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    bits = np.zeros(words, np.uint64)
    bits[at[start]] = np.bitwise_or.reduceat(bit, start) if len(at) else 0
    return bits, tokens, kinds, rows, distinct


def _fill(key, table):
    """One slice of the filter, to be broadcast."""
    bits, tokens, kinds, *_ = _slice(table)
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary()), "tokens": pa.array([tokens], pa.int64()), "kinds": pa.array([kinds], pa.int64())})


def _answer(slices: int):
    """The levels of all n-grams that parts ask one slice for, in their order; its first row has the slice's tokens and words."""

    def run(key, table):
        s = key[0].as_py()
        bits, tokens, kinds, rows, distinct = _slice(table)
        held, out = Filter(slices, [(s, bits.tobytes())]), []
        for k, (g, own, places) in distinct.items():
            level = held.levels(g << np.uint64(16)).astype(np.uint8)  # each n-gram is probed once
            out += [(rows[i][0], k, level[place].tobytes()) for i, place in zip(own, places) if rows[i][0] >= 0]
        n = len(out)
        totals = [pa.array([x, *[0] * n], pa.int64()) for x in (tokens, kinds)]
        return pa.table({"part": pa.array([-1, *[x[0] for x in out]], pa.int64()), "slice": pa.array(np.full(n + 1, s), pa.int64()), "gram": pa.array([-1, *[x[1] for x in out]], pa.int32()), "levels": pa.array([b"", *[x[2] for x in out]], pa.binary()), "tokens": totals[0], "kinds": totals[1]})

    return run


class Filter:
    """The slices of the log-frequency filter one after another."""

    def __init__(self, slices: int, parts: list[tuple[int, bytes]]):
        self.slices = slices
        self.words, blobs = np.zeros(slices, np.int64), [b""] * slices
        for s, blob in parts:
            self.words[s], blobs[s] = len(blob) // 8, blob
        self.start = np.cumsum(self.words) - self.words
        self.bits = np.frombuffer(b"".join(blobs) or bytes(8), np.uint64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The levels of n-gram hashes: probes go up from 1 until one is absent."""
        out = np.zeros(len(h), np.int64)
        s = slices_of(h, self.slices)
        todo = np.flatnonzero(self.words[s] > 0)
        level = 1
        while len(todo) and level <= LEVELS:
            entry, own = _entry(h[todo], level), s[todo]
            m = masks(entry)
            hit = self.bits[self.start[own] + _word(entry, self.words[own])] & m == m
            todo = todo[hit]
            out[todo] = level
            level += 1
        return out


_GRAMS = "slice long, part long, gram int, grams binary, counts binary"


def packed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as a written table of parts."""
    return cut(docs.mapInArrow(_parts, "part long, blob binary"))


def slices_for(docs: DataFrame) -> int:
    return min(MOST_SLICES, 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES)


def train(docs: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The filter's slices (slice, bits, tokens, kinds) as a written table, their number, and the corpus's tokens and distinct words."""
    slices = slices_for(docs)
    counted = packed(docs.select("doc_id", "text")).mapInArrow(_gather(slices, True, False), _GRAMS)
    table = cut(counted.groupBy("slice").applyInArrow(_fill, "slice long, bits binary, tokens long, kinds long"))
    tokens, kinds = table.agg(F.sum("tokens"), F.sum("kinds")).first()
    return table, slices, tokens or 0, kinds or 0


def log_probabilities(level: list[np.ndarray], doc: np.ndarray, tokens: int, kinds: int) -> np.ndarray:
    """log10 of the interpolated probability of each token. level: of the n-grams that end at each token, by order; 0 where none.

    p(w | u v) = sum of WEIGHTS x (count of the n-gram / count of its history); a history of count 0, or before the text,
    gives its weight to the next lower order. Words have FLOOR more, over all kinds and one unknown.
    """
    n = len(doc)
    count = [np.where(x > 0, VALUE[x], 0.0) for x in level]
    p = (count[0] + FLOOR) / (tokens + FLOOR * (kinds + 1))
    weight = np.full(n, WEIGHTS[0])
    for k in range(1, ORDER):
        history = np.zeros(n)
        inside = np.zeros(n, bool)
        inside[k:] = doc[k:] == doc[:-k] if n > k else False
        at = np.flatnonzero(inside)
        history[at] = count[k - 1][at - 1]
        seen = history > 0
        share = WEIGHTS[k] / (WEIGHTS[k] + weight)
        ratio = np.minimum(count[k] / np.maximum(history, 1), 1)
        p = np.where(seen, share * ratio + (1 - share) * p, p)
        weight = np.where(seen, weight + WEIGHTS[k], weight)
    return np.log10(p)


_SCORES = "doc_id long, n_tokens long, unknown long, log10_prob double, perplexity double"


def _summed(ids: pa.Array, tok: Tokens, level: list[np.ndarray], tokens: int, kinds: int) -> pa.RecordBatch:
    rows = len(ids)
    n = np.diff(tok.first)
    total = np.bincount(tok.doc, log_probabilities(level, tok.doc, tokens, kinds), rows) if len(tok.doc) else np.zeros(rows)
    unknown = np.bincount(tok.doc, level[0] == 0, rows).astype(np.int64) if len(tok.doc) else np.zeros(rows, np.int64)
    return record("doc_id n_tokens unknown log10_prob perplexity", ids, n, unknown, pa.array(total, mask=n == 0), pa.array(10 ** np.minimum(300, -total / np.maximum(n, 1)), mask=n == 0))


def _levels(tok: Tokens, look) -> list[np.ndarray]:
    """Levels of the n-grams that end at each token; those of which a shorter part is unknown aren't looked up."""
    out: list[np.ndarray] = []
    for k, (at, h) in enumerate(ngrams(tok)):
        level = np.zeros(len(tok.hash), np.int64)
        if k:
            may = (out[k - 1][at] > 0) & (out[k - 1][at - 1] > 0)
            at, h = at[may], h[may]
        level[at] = look(h)
        out.append(level)
    return out


def score(docs: DataFrame, corpus: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_tokens, unknown, log10_prob, perplexity) of every document, in place of its row, under a model of the corpus.

    The model has the counts of all n-grams of up to ORDER tokens over the whole corpus (docs, if none is given); a count is
    kept as its level (1 for 1), by entries (n-gram, 1) ... (n-gram, level) in a Bloom filter, and read by probes until one is
    absent. unknown: tokens that the model lacks. The filter is broadcast up to broadcast_bytes; a larger one stays in slices,
    to which the documents' distinct n-grams are sent, part by part of the documents, and from which their levels come back.

    Null and empty texts, and those without a token, have 0 tokens and null scores. Rows without doc_id are scored and
    counted. Repeated rows are scored each and count each. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    own = corpus is None
    corpus = docs if own else corpus.select(F.lit(None).cast("long").alias("doc_id"), "text")
    slices = slices_for(corpus)
    # Every token is an entry at least, but copies repeat them: whether a broadcast may fit is known only when the slices are filled.
    if slices * SLICE_BYTES <= 4 * broadcast_bytes:
        table, _, tokens, kinds = train(corpus)
        if (table.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= broadcast_bytes:
            model = docs.sparkSession.sparkContext.broadcast(Filter(slices, [(r[0], bytes(r[1])) for r in table.select("slice", "bits").toLocalIterator()]))

            def run(batches):
                for batch in pieces(batches):
                    tok = Tokens(*lowered(batch))
                    yield _summed(batch.column("doc_id"), tok, _levels(tok, model.value.levels), tokens, kinds)

            return docs.mapInArrow(run, _SCORES)
    return _by_slices(docs, None if own else corpus, slices)


def _by_slices(docs: DataFrame, corpus: DataFrame | None, slices: int) -> DataFrame:
    """The same with a filter of any size, of which no task holds more than a slice."""
    parts = packed(docs)
    asked = parts.mapInArrow(_gather(slices, corpus is None, True), _GRAMS)
    if corpus is not None:
        asked = asked.unionByName(packed(corpus).mapInArrow(_gather(slices, True, False), _GRAMS))
    answers = cut(asked.groupBy("slice").applyInArrow(_answer(slices), "part long, slice long, gram int, levels binary, tokens long, kinds long"))
    tokens, kinds = answers.agg(F.sum("tokens"), F.sum("kinds")).first()

    def run(key, part, found):
        table = _unpacked(part.column("blob")[0].as_buffer())
        tok, grams = _part_grams(table)
        found = found.sort_by([("gram", "ascending"), ("slice", "ascending")]) if len(found) else found
        which = found.column("gram").to_numpy()
        blobs = found.column("levels")
        out: list[np.ndarray] = []
        for k, (at, h) in enumerate(grams):
            level = np.zeros(len(tok.hash), np.int64)
            # Slices go by the hash, so that their answers follow each other as the sorted hashes do.
            own = np.frombuffer(b"".join(blobs[i].as_py() for i in np.flatnonzero(which == k).tolist()), np.uint8)
            level[at] = own[np.unique(h >> np.uint64(16), return_inverse=True)[1]] if len(h) else 0
            if k and len(at):
                level[at[(out[k - 1][at] == 0) | (out[k - 1][at - 1] == 0)]] = 0  # as above: parts of it are unknown
            out.append(level)
        ids = table.column("doc_id")
        return pa.Table.from_batches([_summed(ids.chunk(0) if ids.num_chunks else pa.array([], pa.int64()), tok, out, tokens or 0, kinds or 0)])

    return parts.groupBy("part").cogroup(answers.filter("part >= 0").groupBy("part")).applyInArrow(run, _SCORES)
