import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import fingerprint as fp
from sparkloom.llm.common import raw, span_hashes

from .conftest import make, odd_rows, prose


def arrays(texts):
    import pyarrow as pa

    return raw(pa.array(texts))


def level(window):
    h = -sum(c / fp.SIZE * math.log2(c / fp.SIZE) for c in Counter(window).values())
    return round(h / math.log2(fp.SIZE) * (fp.LEVELS - 1))


def brute_features(text, rank):
    b = text.encode()
    levels = [level(b[i : i + fp.SIZE]) for i in range(len(b) - fp.SIZE + 1)]
    popular = Counter()
    for i in range(len(levels) - fp.SIZE + 1):
        popular[min(range(i, i + fp.SIZE), key=lambda k: (rank[levels[k]], k))] += 1
    return sorted(k for k, n in popular.items() if n >= fp.POPULAR)


def texts():
    return [prose(1, 60), "", "short", "aa" * 200, prose(2, 30) + " é中 " + prose(3, 20), "ab" * 31, prose(4, 90)]


def test_entropies_and_features_against_brute_force():
    data, offsets = arrays(texts())
    at, levels = fp.entropies(data, offsets)
    want = {}
    for o, t in zip(offsets, texts()):
        b = t.encode()
        want |= {int(o) + i: level(b[i : i + fp.SIZE]) for i in range(len(b) - fp.SIZE + 1)}
    assert at.tolist() == sorted(want)
    assert max(abs(want[a] - v) for a, v in zip(at.tolist(), levels.tolist())) <= 1  # halves round either way
    rank = np.random.default_rng(2).permutation(fp.LEVELS)
    got = fp.features(data, offsets, rank)
    exact = {a: v for a, v in zip(at.tolist(), levels.tolist())}
    mine = []
    for o, t in zip(offsets, texts()):
        n = len(t.encode()) - fp.SIZE + 1
        popular = Counter()
        for i in range(n - fp.SIZE + 1):
            popular[min(range(i, i + fp.SIZE), key=lambda k: (rank[exact[o + k]], k))] += 1
        mine += [int(o) + k for k, c in sorted(popular.items()) if c >= fp.POPULAR]
    assert got.tolist() == mine


def test_filters_hold_their_features():
    h = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    digest = fp.bloom(h)
    assert len(digest) == 3 * fp.FILTER_BITS // 8
    bits = np.unpackbits(np.frombuffer(digest, np.uint8)).reshape(-1, fp.FILTER_BITS)
    for i, x in enumerate(h.tolist()):
        assert all(bits[i // fp.FILTER_FEATURES, x >> 11 * p & fp.FILTER_BITS - 1] for p in range(fp.PROBES))
    assert fp.score(digest, 400, digest, 400) == 100
    other = fp.bloom(np.random.default_rng(2).integers(0, 1 << 63, 400, dtype=np.uint64))
    assert fp.score(digest, 400, other, 400) < 10
    half = fp.bloom(np.concatenate([h[:80], np.random.default_rng(3).integers(0, 1 << 63, 80, dtype=np.uint64)]))
    assert 20 < fp.score(digest, 400, half, 160) == fp.score(half, 160, digest, 400) < 80
    assert fp.score(digest, 400, fp.bloom(h[:3]), 3) == -1


def test_ranks_count_all_windows(spark):
    docs = make(spark, list(enumerate(texts())))
    counts = Counter()
    for t in texts():
        counts += Counter(fp.entropies(*arrays([t]))[1].tolist())
    order = sorted(range(fp.LEVELS), key=lambda v: (counts[v], v))
    assert fp.ranks(docs).tolist() == [order.index(v) for v in range(fp.LEVELS)]


def test_odd_rows(spark, odd, empty):
    out = fp.fingerprints(odd, every=1).collect()
    assert len(out) == len(odd_rows())
    assert sum(r.digest is None for r in out) == 2
    assert all(r.n_features == 0 and r.digest == "" for r in out if r.doc_id in (3, 4, 5, 7))
    assert all(r.class_id is None and r.similar == 0 for r in out if r.doc_id in (2, 3))
    assert all(r.similar is None and r.class_id is None for r in out if r.doc_id is None)
    assert fp.fingerprints(empty).count() == 0
    again = fp.fingerprints(odd.unionByName(odd).unionByName(make(spark, [(80, prose(8)), (88, prose(88))])), every=1).collect()
    assert len(again) == 2 * len(odd_rows()) + 2
    assert {(r.class_id, r.nearest_id, r.similar) for r in again if r.doc_id in (80, 88)} == {(8, 8, 1)}
    assert {(r.class_id, r.nearest_id, r.similar) for r in again if r.doc_id == 8} == {(8, 80, 1), (8, 88, 1)}


def brute(rows, rank):
    """Scores of all pairs by their digests, and the features of each."""
    digest, own = {}, {}
    for d, t in rows:
        data, offsets = arrays([t])
        at = fp.features(data, offsets, rank)
        h = span_hashes(data, at, at + fp.SIZE)
        own[d], digest[d] = set(h.tolist()), (fp.bloom(h), len(set(h.tolist())))
    scores = defaultdict(dict)
    for a in own:
        for b in own:
            few = min(digest[a][1], digest[b][1]) < fp.FEWEST
            if a != b and own[a] and own[b]:
                s = fp.score_few(len(own[a] & own[b]), digest[a][1], digest[b][1]) if few else fp.score(*digest[a], *digest[b])
                if s >= fp.SCORE:
                    scores[a][b] = s
    return scores, own, digest


def test_queries_against_all_rows_by_brute_force(spark):
    """Chains of near copies, exact copies, parts of others, and a passage that all share; every query's best and number of partners."""
    shared = prose(777, 40)
    rows = []
    for g in range(15):
        w = prose(g, 200).split()
        for k in range(5):  # each shares most with its neighbours in the chain
            rows.append((100 * g + 7 * k % 5, " ".join(w[30 * k :] + prose(1000 + 10 * g + k, 30 * k + 1).split()) + " " + shared))
        rows += [(100 * g + 50, rows[-1][1]), (100 * g + 51, rows[-1][1]), (100 * g + 52, " ".join(w[:40]))]
    docs = make(spark, rows + [(None, rows[0][1])])
    scores, _, digest = brute(rows, fp.ranks(docs))
    assert len(scores) > 60
    table = fp.fingerprints(docs, every=1).collect()
    got = {r.doc_id: r for r in table}
    assert len(table) == len(rows) + 1
    met = sum(got[d].similar for d in got if d is not None) / sum(map(len, scores.values()))
    assert 0.98 <= met <= 1
    same = sum((got[d].nearest_score, got[d].nearest_id) == (max(((s, -b) for b, s in scores[d].items()))[0], -max(((s, -b) for b, s in scores[d].items()))[1]) for d in scores)
    assert same >= 0.98 * len(scores)
    for d, r in got.items():
        if d is not None:
            assert r.n_features == digest[d][1] and r.class_id == min(b for b, _ in rows if digest[b] == digest[d])
    # The same queries, and only those, with the usual divisor.
    some = {r.doc_id: r for r in fp.fingerprints(docs).collect()}
    for d, r in some.items():
        assert (r.similar, r.nearest_id, r.nearest_score) == ((got[d].similar, got[d].nearest_id, got[d].nearest_score) if d is not None and d % 100 == 0 else (None, None, None))


def test_recall_on_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores, _, _ = brute(rows, fp.ranks(docs))
    got = {r.doc_id: r for r in fp.fingerprints(docs, every=1).collect()}
    want = sum(map(len, scores.values()))
    assert sum(min(got[d].similar, len(scores[d])) for d in scores) >= 0.95 * want


def test_shuffled_index_and_queries_make_no_difference(spark, monkeypatch):
    import sparkloom.llm.common as common

    docs = make(spark, [(i, prose(i // 3, 100 + i % 3)) for i in range(60)])
    one = sorted(map(tuple, fp.fingerprints(docs, every=2).collect()))
    for module in (common, fp):
        monkeypatch.setattr(module, "fits", lambda *_, **__: False)
    assert sorted(map(tuple, fp.fingerprints(docs, every=2).collect())) == one


def test_texts_of_few_features_are_compared(spark):
    copies = ["no feature here", prose(1, 14), prose(2, 30), prose(3, 50)]
    rows = [(10 * i + k, t) for i, t in enumerate(copies) for k in range(3)]
    rows += [(100, prose(2, 30) + " " + prose(9, 200)), (101, ""), (102, ""), (103, None), (104, None), (105, "another without")]
    got = {r.doc_id: r for r in fp.fingerprints(make(spark, rows), every=1).collect()}
    few = [got[10 * i].n_features for i in range(4)]
    assert few[0] == 0 and 0 < few[2] < fp.FEWEST and 0 < few[3] < fp.FEWEST
    for i in range(len(copies)):
        a, b, c = (got[10 * i + k] for k in range(3))
        assert (a.nearest_id, b.nearest_id, c.nearest_id) == (10 * i + 1, 10 * i, 10 * i)
        assert a.class_id == b.class_id == c.class_id == 10 * i and a.similar >= 2
        assert a.nearest_score == b.nearest_score == c.nearest_score == 100
    assert got[100].nearest_id == 20 and got[100].nearest_score >= fp.SCORE and got[100].similar == 3
    assert all(got[d].nearest_id is None and got[d].similar == 0 for d in range(101, 106))
    assert [fp.score_few(*x) for x in ((3, 3, 400), (2, 4, 5), (1, 4, 4), (1, 1, 9))] == [100, 29, 0, 100]
