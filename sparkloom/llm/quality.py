"""Operator 8. Quality classifier: naive Bayes support vectors, fitted by dual coordinate descent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tokens, cut, doc_grams, filter_rows, lists, lowered, pieces, record, release

FEATURE_BITS = 18
#: The fit uses so many labelled documents at most: those whose ids have the least hashes.
TRAIN_DOCS = 8000
C, EPOCHS, ALPHA = 1.0, 12, 1.0
HEADS = ("quality", "toxic")


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, and where each text's begin: hashed runs of one and two tokens, signs included."""
    tok = Tokens(*lowered(batch), symbols=True)
    shift = np.uint64(40 - FEATURE_BITS)
    key = np.concatenate([doc.astype(np.uint64) << np.uint64(FEATURE_BITS) | ids >> shift for doc, ids, _ in (doc_grams(tok, 1), doc_grams(tok, 2))])
    key = np.unique(key)
    edges = np.searchsorted(key, np.arange(batch.num_rows + 1, dtype=np.uint64) << np.uint64(FEATURE_BITS))
    return (key & np.uint64((1 << FEATURE_BITS) - 1)).astype(np.int32), edges


def log_count_ratios(flat: np.ndarray, owner: np.ndarray, y: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """log of the smoothed and normalised counts of each feature in the class over those outside it."""
    size = 1 << FEATURE_BITS
    p = alpha + np.bincount(flat[y[owner]], minlength=size)
    q = alpha + np.bincount(flat[~y[owner]], minlength=size)
    return np.log(p / p.sum() / (q / q.sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, c: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights, the bias last, of the linear hinge-loss machine with the bound c for each example."""
    w, alpha, rng = np.zeros(size + 1), np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([v @ v + 1 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights by feature, squared ratios by feature, and the bias. One class only gives zeros."""
    size = 1 << FEATURE_BITS
    if not len(y) or y.all() or not y.any():
        return np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0
    r = log_count_ratios(np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows]), y)
    values = [r[x] / max(float(np.linalg.norm(r[x])), 1e-9) for x in rows]
    balance = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    w = dual_coordinate_descent(rows, values, np.where(y, 1.0, -1.0), size, C * balance)
    return (w[:-1] * r).astype(np.float32), r**2, float(w[-1])


def _train(table):
    table = table.sort_by("doc_id")
    rows = [x.values.to_numpy() for x in table.column("features")]
    out = {"head": [], "weights": [], "squares": [], "bias": []}
    for head in HEADS:
        label = table.column(head).to_pylist()
        own = [i for i, v in enumerate(label) if v is not None and len(rows[i])]
        w, s, b = fit([rows[i] for i in own], np.array([label[i] > 0 for i in own], bool))
        for k, v in zip(out, (head, w.tobytes(), s.tobytes(), b)):
            out[k].append(v)
    del rows
    release()
    return pa.table({"head": out["head"], "weights": pa.array(out["weights"], pa.binary()), "squares": pa.array(out["squares"], pa.binary()), "bias": out["bias"]})


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Both heads' models, fitted in one task on at most so many labelled documents. Their size is fixed."""
    one = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = F.broadcast(cut(one.orderBy(F.xxhash64("__id"), "__id").limit(most)))  # bounded by most
    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))

    def extract(batches):
        for batch in pieces(batches):
            flat, edges = features(batch)
            yield record("doc_id quality toxic features", *[batch.column(c) for c in ("doc_id", "quality", "toxic")], lists(flat, np.diff(edges)))

    found = rows.mapInArrow(extract, "doc_id long, quality int, toxic int, features array<int>").groupBy().applyInArrow(_train, "head string, weights binary, squares binary, bias double").collect()
    none = np.zeros(1 << FEATURE_BITS, np.float32)
    return {h: (none, none, 0.0) for h in HEADS} | {r["head"]: (np.frombuffer(r["weights"], np.float32), np.frombuffer(r["squares"], np.float32), r["bias"]) for r in found}


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, quality_score, toxic_score, accepted) of every document, in place of its row.

    Indicators of hashed runs of one and two tokens are scaled by the log-count ratio of the class and to unit length; a
    linear hinge-loss machine is fitted to them by dual coordinate descent, for quality and for toxicity. A document is
    accepted if the quality is not below 0 and the toxicity not above 0. Labels of a repeated doc_id: the lowest quality,
    the highest toxicity. A head without labels of both classes scores 0, and so accepts all.

    Null and empty texts, and texts of blanks, have null scores and are not accepted. Rows without doc_id are scored.
    Repeated rows are scored each. An empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))

    def run(batches):
        for batch in pieces(batches):
            quality, toxic, full, ok = scores(batch, model.value)
            yield record("doc_id quality_score toxic_score accepted", batch.column("doc_id"), pa.array(quality, mask=~full), pa.array(toxic, mask=~full), ok)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, quality_score double, toxic_score double, accepted boolean")


def scores(batch: pa.RecordBatch, model: dict[str, tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quality and toxicity of each text, whether it has a feature, and whether it is accepted."""
    flat, edges = features(batch)
    full = np.diff(edges) > 0
    owner = np.repeat(np.arange(batch.num_rows), np.diff(edges))
    found = []
    for head in HEADS:
        w, s, b = model[head]
        norm = np.sqrt(np.bincount(owner, s[flat], batch.num_rows))
        found.append(np.bincount(owner, w[flat], batch.num_rows) / np.maximum(norm, 1e-9) + b)
    return *found, full, full & (found[0] >= 0) & (found[1] <= 0)


def keep_accepted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; see classify. Each row is judged by its own text."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, most))
    return filter_rows(docs, lambda batch: scores(batch, model.value)[3])
