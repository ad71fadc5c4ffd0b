"""What the operators share: vectorised tokens over Arrow buffers, cut lineage, size-checked joins by id."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of joins by id are broadcast up to so many bytes (16 a row), and shuffled beyond.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that are tokenised at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of rows that go to a Python worker at once, a row at least.
BATCH_BYTES = 4 << 20

_FOLDERS: set[str] = set()
_COUNT = itertools.count()


def small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_BYTES between executors and Python workers, unless the session has a smaller limit: both sides hold
    several at once, and what was once taken for them stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key).lower())
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Give free memory of this process back; Python workers stay when their tasks have ended."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, or in the checkpoint folder of its context. Only a local master may go without:
    its executors see the same disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        folder = set_.get()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = f"{folder}/sparkloom-{uuid.UUID(int=hash(spark.sparkContext.applicationId) & (1 << 128) - 1).hex}"
    if own not in _FOLDERS:
        _FOLDERS.add(own)
        atexit.register(_forget, spark, own)
    return own


def _forget(spark: SparkSession, folder: str) -> None:
    """Remove what this application wrote, while its session still answers."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is not None and context is not None and not context.sc().isStopped():
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it: lineage ends there, and the written copy outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{next(_COUNT)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, row_bytes: int = 16, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written df is small enough to broadcast. It counts the rows."""
    return df.count() * row_bytes <= limit


def by_id(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id", on: str = "__id") -> DataFrame:
    """Semi or anti join of docs with written ids (one column, named by on): broadcast if they fit, else shuffled."""
    side = F.broadcast(ids) if fits(ids) else ids
    return docs.join(side, docs[key] == side[on], how)


def filter_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs, of whatever columns, for which judge(record batch with doc_id and text) has true."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_, text = names.index("doc_id"), names.index("text")

    def run(batches):
        for batch in pieces(batches, f"c{text}"):
            own = pa.RecordBatch.from_arrays([batch.column(id_), batch.column(text)], ["doc_id", "text"])
            yield batch.filter(pa.array(judge(own), pa.bool_()))

    return safe.mapInArrow(run, safe.schema).toDF(*names)


def one_each(df: DataFrame, key: str) -> DataFrame:
    """df with one row of each key, whose other columns follow from it; only rows of repeated keys are shuffled with all columns.

    Rows without a key are left out.
    """
    df = df.filter(F.col(key).isNotNull())
    twice = cut(df.groupBy(F.col(key).alias("__id")).count().filter("count > 1").select("__id"))
    return by_id(df, twice, "left_anti", key).unionByName(by_id(df, twice, "left_semi", key).dropDuplicates([key]))


def one_row_per_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs, with one row (the first by its values) of each repeated id; rows without an id all stay.

    Only rows whose id repeats are shuffled with their texts.
    """
    repeated = cut(docs.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).count().filter("count > 1").select("__id"))
    if repeated.isEmpty():
        return docs
    names = docs.columns
    twice = by_id(docs, repeated, "left_semi", key)
    first = twice.groupBy(F.col(key).alias("__id")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in names])).alias("__row"))
    once = first.select(*[F.col("__row").getField(c).alias(c) for c in names])
    return by_id(docs, repeated, "left_anti", key).unionByName(once)


# Tokens.

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit multiply-xorshift hash."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, by prefix sums of a polynomial."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M1)


class Tokens:
    """Lower-cased tokens of a chunk of texts: maximal runs of ASCII letters, digits, underscores and other code points.

    hash, start, end: of each token; doc: its text's place; first: each text's first token, and the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD, symbols: bool = False):
        n = len(data)
        kind = word[data].astype(np.int8)
        if symbols:  # runs of other printable signs are tokens too
            kind[(kind == 0) & (data > 32)] = 2
        before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        inner = offsets[:-1][offsets[:-1] < n]
        before[inner] = 0
        inner = offsets[1:][offsets[1:] > 0] - 1
        after[inner] = 0
        self.data = data
        self.start = np.flatnonzero((kind > 0) & (before != kind))
        self.end = np.flatnonzero((kind > 0) & (after != kind)) + 1
        self.hash = span_hashes(data, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and texts of all runs of k tokens; a shorter text has its whole run as its only one."""
        h, first = self.hash, self.first
        if not len(h):
            return h, self.doc
        acc = np.zeros(len(h), np.uint64)
        for j in range(k):
            acc[: max(0, len(h) - j)] += mix(h[j:] + np.uint64(j)) if j else h
        keep = np.zeros(len(h), bool)
        if len(h) >= k:
            keep[: len(h) - k + 1] = self.doc[: len(h) - k + 1] == self.doc[k - 1 :]
        for d in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k)):
            a, b = first[d], first[d + 1]
            keep[a] = True
            acc[a] = np.bitwise_xor.reduce(mix(h[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))
        at = np.flatnonzero(keep)
        return mix(acc[at]), self.doc[at]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of the record batches whose texts hold about so many bytes."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
    batch = lengths = group = None
    release()


def lowered(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    return raw(pc.utf8_lower(pc.fill_null(batch.column(column), "")))


def record(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Lists of so many of the values in turn."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def doc_grams(tokens: Tokens, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct k-grams of each text: its place, a 40-bit id and the count, ordered by place and id."""
    h, doc = tokens.grams(k)
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([edge, [len(key)]]))
    key = key[edge]
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1), count
