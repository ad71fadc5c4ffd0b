"""Operator 5. Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised overlap."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, cut, fits, lists, mix, one_each, pieces, raw, record, span_hashes

SIZE = 64  # bytes of a feature
POPULAR = 16  # of SIZE windows, in how many a feature must be the rarest
LEVELS = 1001  # entropies are told apart in thousandths of the most
FILTER_BITS, FILTER_FEATURES, PROBES = 2048, 160, 5
FEWEST = 16  # features, below which the features themselves are compared, as filters of so few bits overlap by chance
SCORE = 21  # of 100, from which on a document is reported as similar
QUERY_EVERY = 100  # documents whose ids it divides are compared with all
CELL_BITS = 18  # features are ordered by how many documents have one of their cell
SLACK = 0.1  # by so much less of the shorter one's features than their score stands for, documents still meet

_F = np.concatenate([[0.0], np.arange(1, SIZE + 1) * np.log2(np.arange(1, SIZE + 1))])
_GAIN = np.diff(_F, append=0.0)


def entropies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows within texts, and their entropies in 0 ... LEVELS - 1.

    Byte counts slide: of each byte, how often it stands in the SIZE - 1 bytes before and after it.
    """
    n = len(data) - SIZE + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, SIZE):
        same = data[lag:] == data[:-lag]
        before[lag:] += same
        after[:-lag] += same
    step = np.zeros(n)
    step[0] = sum(_F[c] for c in np.bincount(data[:SIZE]))
    step[1:] = _GAIN[before[SIZE:]] - _GAIN[after[: n - 1]]
    total = np.cumsum(step)
    level = np.rint((1 - total / (SIZE * np.log2(SIZE))) * (LEVELS - 1))
    ok = np.ones(n, bool)
    for end in offsets[1:-1]:
        ok[max(0, end - SIZE + 1) : max(0, min(end, n))] = False
    at = np.flatnonzero(ok)
    return at, np.clip(level[at], 0, LEVELS - 1).astype(np.int16)


def _histogram(batches):
    total = np.zeros(LEVELS, np.int64)
    for batch in pieces(batches):
        total += np.bincount(entropies(*raw(batch.column("text")))[1], minlength=LEVELS)
    yield record("level n", np.flatnonzero(total).astype(np.int32), total[total > 0])


def ranks(docs: DataFrame) -> np.ndarray:
    """Of each entropy, how many rarer ones the windows of all texts have; ties go to the lower entropy."""
    counts = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(_histogram, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():  # LEVELS rows at most
        counts[r["level"]] = r["n"]
    order = np.argsort(counts, kind="stable")
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def features(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the selected windows: each is the rarest (the leftmost of ties) in POPULAR or more of the runs of SIZE windows."""
    at, level = entropies(data, offsets)
    if not len(at):
        return at
    full = np.full(len(data), np.int64(LEVELS) << 40)
    full[at] = rank[level] << 40 | at
    low = full
    for shift in (1, 2, 4, 8, 16, 32):  # the least of the next 64
        low = np.minimum(low[:-shift], low[shift:]) if len(low) > shift else low[:0]
    valid = np.zeros(len(data), bool)
    valid[at] = True
    run = np.cumsum(np.concatenate([[0], valid]))
    start = np.flatnonzero(run[SIZE:] - run[:-SIZE] == SIZE)
    # Windows of two texts never follow each other without a gap of SIZE - 1 places, so a run lies in one text.
    best = low[start] & ((1 << 40) - 1)
    place, popular = np.unique(best, return_counts=True)
    return place[popular >= POPULAR]


def bloom(hashes: np.ndarray) -> bytes:
    """Chained filters: FILTER_FEATURES distinct features each, in the order of the text."""
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    out = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), np.uint8)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for p in range(PROBES):
        out[row, (hashes >> np.uint64(11 * p) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def score(a: bytes, na: int, b: bytes, nb: int) -> int:
    """0 ... 100: the mean, over the filters of the digest with fewer, of the best normalised overlap with the other's; -1 if either has too few features.

    Overlap: shared bits beyond those that chance gives, over the most that there could be. A last filter of fewer than FEWEST
    features is left out: its few bits overlap by chance.
    """
    if min(na, nb) < FEWEST:
        return -1
    full = lambda n: max(1, n // FILTER_FEATURES + (n % FILTER_FEATURES >= FEWEST))
    x, y = (np.unpackbits(np.frombuffer(d, np.uint8)).reshape(-1, FILTER_BITS)[: full(n)].astype(np.float32) for d, n in ((a, na), (b, nb)))
    if (len(x), na, a) > (len(y), nb, b):
        x, y = y, x
    both, ex, ey = x @ y.T, x.sum(1)[:, None], y.sum(1)[None, :]
    chance, most = ex * ey / FILTER_BITS, np.minimum(ex, ey)
    cut_off = chance + 0.3 * (most - chance)
    value = np.where(both > cut_off, 100 * (both - cut_off) / np.maximum(most - cut_off, 1e-9), 0)
    return int(round(float(value.max(1).mean())))


def score_few(shared: int, na: int, nb: int) -> int:
    """The score of so many shared features, where one has too few for its filter to tell: as for digests, but of the features themselves."""
    return int(round(100 * max(0.0, shared / min(na, nb) - 0.3) / 0.7))


def digests(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc_id, n_bytes, n_features, n_filters, digest, same, anchors) of every row, in place of it.

    same: a hash of the digest, or of a text without features; null for null and empty texts. anchors: the hashes of all
    distinct features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)  # LEVELS numbers

    def run(batches):
        for batch in pieces(batches):
            data, offsets = raw(batch.column("text"))
            place = features(data, offsets, shared.value)
            h = span_hashes(data, place, place + SIZE) if len(place) else np.zeros(0, np.uint64)
            edges = np.searchsorted(place, offsets)
            out, counts, keys = [], [], []
            for a, b in zip(edges, edges[1:]):
                own = np.unique(h[a:b])
                out.append(bloom(h[a:b]))
                counts.append(len(own))
                keys.append(mix(own).view(np.int64))
            same = [_same(x, b"digest") if x else _same(data[a:b].tobytes(), b"text") if a < b else None for x, a, b in zip(out, offsets, offsets[1:])]
            null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
            yield record("doc_id n_bytes n_features n_filters digest same anchors", batch.column("doc_id"), np.diff(offsets), pa.array(counts, pa.int32()), pa.array([len(x) * 8 // FILTER_BITS for x in out], pa.int32()), pa.array(out, pa.binary(), mask=null), pa.array(same, pa.int64()), lists(np.concatenate([np.zeros(0, np.int64), *keys]), np.array([len(k) for k in keys])))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_features int, n_filters int, digest binary, same long, anchors array<long>")


def _same(content: bytes, kind: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8, person=kind).digest(), "big", signed=True)


def cells(classes: DataFrame) -> np.ndarray:
    """How many features of all classes are in each cell of their hashes; 2**CELL_BITS numbers, whatever the input."""
    found = np.zeros(1 << CELL_BITS, np.int64)
    keys = classes.select(F.explode("anchors").alias("key")).groupBy(F.shiftrightunsigned("key", 64 - CELL_BITS).alias("cell")).count()
    for r in keys.collect():  # 2**CELL_BITS rows at most
        found[r["cell"]] = r["count"]
    return found


def _marked(common, share: float):
    """(same, key, n, rare) of each class and feature, n being the class's. rare: it is among so many of the class's rarest that whoever
    has the share of its features has one of them."""

    def run(batches):
        for batch in batches:
            anchors = batch.column("anchors").combine_chunks() if isinstance(batch.column("anchors"), pa.ChunkedArray) else batch.column("anchors")
            n = np.diff(anchors.offsets.to_numpy())
            key = anchors.flatten().to_numpy()
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((key, common.value[(key.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int64)], owner))
            key, place = key[order], np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
            most = n - np.ceil(share * n - 1e-9).astype(np.int64) + 1
            yield record("same key n rare", batch.column("same").take(pa.array(owner)), key, pa.array(n[owner], pa.int32()), place < most[owner])

    return run


def compare(known: DataFrame, queries: DataFrame, least: int) -> DataFrame:
    """(a, b, score) of the digests a of queries (same) and all other digests b of known that score least or more against them.

    Equal digests are one. A score of least stands for a share of the features of the document with fewer; by prefix filtering,
    pairs that share so many (less SLACK, as filters blur them) meet in one of the rarest features of either, so common
    passages bring nobody together who has more of his own.
    """
    share = max(0.0, 0.3 + 0.7 * least / 100 - SLACK)
    classes = cut(one_each(known.select("same", "n_features", "digest", "anchors").filter("n_features > 0"), "same"))
    common = known.sparkSession.sparkContext.broadcast(cells(classes))
    marks = lambda df: df.select("same", "anchors").mapInArrow(_marked(common, share), "same long, key long, n int, rare boolean")
    ask = cut(marks(by_id(classes, queries.withColumnRenamed("same", "__id"), "left_semi", "same")).toDF("a", "key", "n_a", "rare_a"))
    ask = F.broadcast(ask) if fits(ask, 24) else ask
    met = marks(classes).join(ask, "key").filter("same <> a and (rare or rare_a)")
    pairs = cut(met.groupBy("a", F.col("same").alias("b")).agg((F.least(F.first("n_a"), F.first("n")) < FEWEST).alias("few")))

    def told(rows: DataFrame, what: str, judge) -> DataFrame:
        for c in "ab":
            ids = cut(rows.select(F.col(c).alias("__id")).distinct())
            rows = rows.join(by_id(classes, ids, "left_semi", "same").select(F.col("same").alias(c), F.col(what).alias(f"x_{c}"), F.col("n_features").alias(f"n_{c}")), c)

        def run(batches):
            for batch in batches:
                found = np.array([judge(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("x_a", "n_a", "x_b", "n_b")))], np.int32)
                at = pa.array(np.flatnonzero(found >= least))
                yield record("a b score", batch.column("a").take(at), batch.column("b").take(at), pa.array(found).take(at))

        return rows.select("a", "b", "x_a", "n_a", "x_b", "n_b").mapInArrow(run, "a long, b long, score int")

    few = told(pairs.filter("few").drop("few"), "anchors", lambda x, m, y, n: score_few(len(set(x) & set(y)), m, n))
    return told(pairs.filter("not few").drop("few"), "digest", score).unionByName(few)


def fingerprints(docs: DataFrame, least: int = SCORE, every: int = QUERY_EVERY) -> DataFrame:
    """(doc_id, n_bytes, n_features, n_filters, digest, class_id, similar, nearest_id, nearest_score) of every document, in place of its row; digests in base64.

    Features are windows of SIZE bytes. The rarer their entropy among all windows of all texts, the lower their rank; those
    that are of the lowest rank in POPULAR or more of the SIZE windows around are selected, and inserted into chained Bloom
    filters of FILTER_BITS bits. class_id is the least id of the documents of the same digest. Documents whose ids every divides
    are queries, compared with all others: similar is the number of those whose digests overlap theirs by least or more,
    nearest_id the one that does most, ties to the least id (both null if there is none); the rest have nulls there.

    Null texts have null digests; texts shorter than a window have empty ones. Where one of two documents has fewer than FEWEST
    features, they are compared by the features themselves; texts without features, if equal. Null and empty texts have no
    class and, if queries, 0 similar ones.
    Rows without doc_id are no queries and count nowhere; their class is that of their digest, null if only such have it. Of
    repeated ids each row is a query by its own digest, and never has its own id. An empty table gives no rows; other columns
    are not read.
    """
    table = cut(digests(docs, ranks(docs)))
    known = table.filter("same is not null")
    ids = known.filter("doc_id is not null").select("same", "doc_id").distinct()
    groups = cut(ids.groupBy("same").agg(F.min("doc_id").alias("one"), F.count("*").alias("members")))
    query = F.col("doc_id") % every == 0
    asked = cut(ids.filter(query).toDF("a", "id"))
    found = cut(compare(known, asked.select(F.col("a").alias("same")).distinct(), least))
    own = asked.select("a").distinct()
    both = found.unionByName(own.select("a", F.col("a").alias("b"), F.lit(100).alias("score")))
    # The least two ids of a class are enough: one of them isn't that of the row that asks.
    alone = F.broadcast(asked.select("id").distinct()) if fits(asked) else asked.select("id").distinct()
    first = groups.filter("members > 1").join(alone, F.col("one") == F.col("id"), "left_semi")
    two = ids.join(first.select("same", "one"), "same").filter("doc_id > one").groupBy("same").agg(F.min("doc_id").alias("two"))
    parts = groups.join(two, "same", "left").withColumnRenamed("same", "b")
    repeated = cut(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    mine = ids.join(F.broadcast(repeated) if fits(repeated) else repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.col("same").alias("b"), F.lit(1).alias("mine"))
    met = both.join(parts, "b").join(asked, "a").join(mine, ["id", "b"], "left")
    self_ = F.greatest((F.col("a") == F.col("b")).cast("int"), F.coalesce("mine", F.lit(0)))
    other = F.when(F.col("one") != F.col("id"), F.col("one")).otherwise(F.col("two"))
    best = F.min(F.when(other.isNotNull(), F.struct((-F.col("score")).alias("s"), other.alias("id"))))
    top = met.groupBy(F.col("id").alias("__q"), F.col("a").alias("__a")).agg(F.sum(F.col("members") - self_).alias("similar"), best.alias("best"))
    top = cut(top.select("__q", "__a", "similar", F.col("best.id").alias("nearest_id"), (-F.col("best.s")).alias("nearest_score")))
    several = groups.filter("members > 1").select(F.col("same").alias("__same"), "one")
    several = F.broadcast(several) if fits(several) else several
    # Only classes of several documents, and only queries, are joined with more than their own rows.
    rows = table.drop("anchors").withColumn("digest", F.translate(F.base64("digest"), "\r\n", "")).join(several, F.col("same") == F.col("__same"), "left")
    rows = rows.withColumn("class_id", F.coalesce("one", F.when(F.col("same").isNotNull(), F.col("doc_id"))))
    asking = F.coalesce(query, F.lit(False))
    told = rows.filter(asking).join(F.broadcast(top) if fits(top, 48) else top, (F.col("doc_id") == F.col("__q")) & (F.col("same") == F.col("__a")), "left").withColumn("similar", F.coalesce("similar", F.lit(0).cast("long")))
    rest = rows.filter(~asking).withColumns({"similar": F.lit(None).cast("long"), "nearest_id": F.lit(None).cast("long"), "nearest_score": F.lit(None).cast("int")})
    names = ["doc_id", "n_bytes", "n_features", "n_filters", "digest", "class_id", "similar", "nearest_id", "nearest_score"]
    return told.select(*names).unionByName(rest.select(*names))
