import random

import numpy as np
import pytest

from sparkloom.llm import quality as qc
from sparkloom.llm.queries import op8_quality

from .conftest import make, odd_rows, prose

JUNK = "BUY | CLICK | FREE *** $$$".split()


def labelled(n=300):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 60, 300).split()
        bad, toxic = i % 4 == 0, i % 5 == 0
        for _ in range(12 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(JUNK))
        for _ in range(6 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "slur", "spite"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qc.classify(make(spark, rows), known).collect()}
    right = [got[i].accepted == bool(q and not t) for i, q, t in labels[200:]]
    assert np.mean(right) > 0.97
    kept = {r.doc_id for r in qc.keep_accepted(make(spark, rows), known).collect()}
    assert kept == {i for i, r in got.items() if r.accepted}


def test_toxic_documents_of_the_tables_go_and_clean_ones_stay(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    got = op8_quality(spark, sf).toPandas().set_index("doc_id").join(labels, how="inner")
    assert not got[got.toxic == 1].accepted.any()
    clean = got[(got.toxic == 0) & (got.quality == 1)]
    assert clean.accepted.mean() > 0.97


def test_dual_coordinate_descent_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(80)]
    values = [rng.normal(size=8) for _ in rows]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    c = np.full(80, 0.5)
    w = qc.dual_coordinate_descent(rows, values, y, 40, c, epochs=400)
    dense = np.zeros((80, 41))
    for i, (r, v) in enumerate(zip(rows, values)):
        dense[i, r], dense[i, -1] = v, 1
    loss = lambda u: 0.5 * u @ u + (c * np.maximum(0, 1 - y * (dense @ u))).sum()
    assert all(loss(w) <= loss(w + 0.01 * rng.normal(size=41)) + 1e-3 for _ in range(200))


def test_scores_by_brute_force(spark):
    """Whole documents with plain sets and loops: indicators, their ratios from counts, unit length, margins."""
    from sparkloom.llm.common import Tokens, doc_grams, lowered, record

    rows, labels = labelled(80)
    known = spark.createDataFrame(labels[:50], "doc_id long, quality int, toxic int")
    docs = make(spark, rows)
    model = qc.train(docs, known)
    got = {r.doc_id: r for r in qc.classify(docs, known).collect()}
    bags = []
    for _, text in rows:
        tok = Tokens(*lowered(record("text", [text])), symbols=True)
        bags.append({int(i) >> 40 - qc.FEATURE_BITS for k in (1, 2) for i in doc_grams(tok, k)[1]})
    for head, column in (("quality", 1), ("toxic", 2)):
        size, inside, outside = 1 << qc.FEATURE_BITS, {}, {}
        for bag, label in zip(bags, labels[:50]):
            side = inside if label[column] else outside
            for f in bag:
                side[f] = side.get(f, 0) + 1
        p, q = size + sum(inside.values()), size + sum(outside.values())
        ratio = lambda f: np.log((1 + inside.get(f, 0)) / p / ((1 + outside.get(f, 0)) / q))  # noqa: B023, E731
        w, squares, bias = model[head]
        for (d, _), bag in zip(rows, bags):
            assert all(abs(squares[f] - ratio(f) ** 2) < 1e-3 for f in bag)
            score = sum(float(w[f]) for f in bag) / max(sum(ratio(f) ** 2 for f in bag) ** 0.5, 1e-9) + bias
            assert getattr(got[d], f"{head}_score") == pytest.approx(score, abs=1e-3)
        # Each labelled document's margin is that of the fitted machine: on the right side for nearly all of them.
        right = [(getattr(got[d], f"{head}_score") > 0) == bool(label[column]) for (d, _), label in zip(rows[:50], labels[:50])]
        assert np.mean(right) > 0.95


def test_ratios_by_hand():
    r = qc.log_count_ratios(np.array([0, 1, 1, 2]), np.array([0, 0, 1, 1]), np.array([True, False]))
    size = 1 << qc.FEATURE_BITS
    p, q = np.ones(size), np.ones(size)
    p[[0, 1]] += 1
    q[[1, 2]] += 1
    assert np.allclose(r[:4], np.log(p[:4] / p.sum() / (q[:4] / q.sum())), atol=1e-6)


def test_odd_rows(spark, odd, empty):
    rows, labels = labelled(60)
    known = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None), (0, 0, 1)], "doc_id long, quality int, toxic int").withColumn("text", known_text())
    docs = make(spark, rows).unionByName(odd)
    got = qc.classify(docs, known).collect()
    assert len(got) == len(rows) + len(odd_rows())
    none = [r for r in got if r.quality_score is None]
    assert len(none) == 4 and not any(r.accepted for r in none)  # two nulls, an empty text and one of blanks
    assert qc.keep_accepted(docs, known).columns == docs.columns
    assert qc.classify(empty, known).count() == 0
    assert qc.keep_accepted(empty, known).count() == 0
    free = qc.classify(odd, known.limit(0)).collect()
    assert all(r.accepted for r in free if r.quality_score is not None)


def known_text():
    from pyspark.sql import functions as F

    return F.lit("x")
