import itertools
import math
import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import near_dup as nd
from sparkloom.llm.common import Tokens, doc_grams, lowered, record
from sparkloom.llm.components import components

from .conftest import make, odd_rows, prose


def shingles(texts):
    doc, ids, counts = doc_grams(Tokens(*lowered(record("text", texts))), nd.K)
    return [{i: c for d, i, c in zip(doc, ids, counts) if d == k} for k in range(len(texts))]


def brute_pairs(texts, threshold):
    """All pairs by exact weighted Jaccard similarity, with exact document frequencies."""
    bags = shingles(texts)
    df = {}
    for b in bags:
        for t in b:
            df[t] = df.get(t, 0) + 1
    w = [{t: c * math.log1p(len(texts) / df[t]) for t, c in b.items()} for b in bags]
    out = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if w[i] and w[j] and w[i].keys() & w[j].keys():
            low = sum(min(w[i][t], w[j][t]) for t in w[i].keys() & w[j].keys())
            s = low / (sum(w[i].values()) + sum(w[j].values()) - low)
            if s >= threshold:
                out[i, j] = s
    return out


def groups(n, pairs):
    top = list(range(n))
    for a, b in sorted(pairs):
        x, y = top[a], top[b]
        if x != y:
            top = [min(x, y) if t in (x, y) else t for t in top]
    return {i: t for i, t in enumerate(top) if i != t}


def near(seed, share, words=120):
    rng = random.Random(f"{seed} {share}")
    return " ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in prose(seed, words).split())


def test_groups_against_brute_force(spark):
    texts = []
    for g in range(30):
        texts += [prose(g, 120)] + [near(g, 0.02 * k) for k in range(1, 4)] + [prose(g, 120).upper()]
    texts += [prose(1000 + k, 120) for k in range(60)]
    random.Random(3).shuffle(texts)
    want = groups(len(texts), brute_pairs(texts, nd.THRESHOLD))
    got = {r.doc_id: r.kept_id for r in nd.near_duplicates(make(spark, list(enumerate(texts)))).collect()}
    assert len(want.keys() & got.keys()) >= 0.95 * len(want)
    assert not got.keys() - want.keys()


@pytest.mark.parametrize("slot, meetings", [(1_500_000, 2_000_000), (300, 50)])
def test_no_link_is_left_out(spark, monkeypatch, slot, meetings):
    """Pairs just above the threshold, and copies and repeated ids of their texts: groups are those of brute force over all pairs."""
    monkeypatch.setattr(nd, "SLOT", slot)
    monkeypatch.setattr(nd, "MEETINGS", meetings)
    texts = []
    for g in range(100):
        texts += [prose(g, 60 + g % 90), near(g, 0.1 + 0.0003 * g, 60 + g % 90)]
        texts += [texts[-1].upper()] * (g % 3)
    texts += [f"{prose(2000 + k, 30)} {prose(k, 60 + k % 90)}" for k in range(40)]
    random.Random(5).shuffle(texts)
    pairs = brute_pairs(texts, nd.THRESHOLD)
    assert sum(s < 0.6 for s in pairs.values()) > 40
    want = groups(len(texts), pairs)
    got = {r.doc_id: r.kept_id for r in nd.near_duplicates(make(spark, list(enumerate(texts)))).collect()}
    assert got == want


def test_a_repeated_id_links_by_each_of_its_texts(spark):
    """The second text of an id is no copy, though its first is."""
    rows = [(i, t) for g in range(20) for i, t in ((1000 + g, prose(g, 120)), (3000 + g, prose(500 + g, 120)), (2000 + g, prose(g, 120)), (2000 + g, near(500 + g, 0.1)))]
    texts = [t for _, t in rows]
    pairs = brute_pairs(texts, nd.THRESHOLD)
    ids = sorted({i for i, _ in rows})
    want = groups(len(ids), {tuple(sorted((ids.index(rows[i][0]), ids.index(rows[j][0])))) for i, j in pairs if rows[i][0] != rows[j][0]})
    got = {r.doc_id: r.kept_id for r in nd.near_duplicates(make(spark, rows)).collect()}
    assert got == {ids[i]: ids[j] for i, j in want.items()}


def test_real_documents_against_brute_force(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
    want = groups(len(rows), brute_pairs([t for _, t in rows], nd.THRESHOLD))
    got = {r.doc_id: r.kept_id for r in nd.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    want = {rows[i][0]: rows[j][0] for i, j in want.items()}
    assert len(want.keys() & got.keys()) >= 0.9 * len(want)
    assert not got.keys() - want.keys()


def test_prefixes_over_many_slots_stay_small():
    """What is shuffled of the prefixes hardly grows with the slots, of which larger tables have more."""
    texts = [prose(k, 120, 10**6) for k in range(300)]
    ids = np.arange(300) * 7919 + 10**12
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(ids), pa.array([None] * 300, pa.list_(pa.int64()))], ["doc_id", "text", "label", "copies"])
    sketch = SimpleNamespace(value=np.ones((nd.SKETCH_ROWS, 1 << nd.SKETCH_BITS), np.float32))
    size = [sum(len(x) for out in nd._prefixes(300, sketch, nd.THRESHOLD, slots)([batch]) for x in out.column("data").to_pylist()) for slots in (1, 42)]
    assert size[1] < 1.5 * size[0]


def test_the_sketch_widens_with_the_texts():
    """About as many shingles share a cell of a small table as of one five times as large."""
    bits = [nd.sketch_bits(x) for x in (0, 200 << 20, 1000 << 20, 1 << 50)]
    assert bits == sorted(bits) and bits[0] == nd.SKETCH_BITS < bits[2] and bits[3] == nd.SKETCH_MOST


def test_what_is_rounded_keeps_its_side():
    x = np.concatenate([[0], np.exp(np.random.default_rng(1).uniform(-18, 27, 10_000))])
    assert (nd._full(nd._brief(x, np.floor)) <= x * (1 + 1e-9)).all() and (nd._full(nd._brief(x, np.ceil)) * (1 + 1e-9) >= x).all()
    assert (np.diff(nd._brief(np.sort(x), np.ceil).astype(int)) >= 0).all()


def test_samples_meet_with_the_probability_of_the_similarity():
    rng = np.random.default_rng(5)
    ids = np.sort(rng.choice(1 << 40, 600, replace=False).astype(np.uint64))
    a = (ids[:400], rng.uniform(0.5, 3, 400).astype(np.float32))
    b = (ids[100:], np.concatenate([a[1][100:], rng.uniform(0.5, 3, 200)]).astype(np.float32))
    hits = []
    for salt in range(40):
        x, y = (nd.signature(nd.mix(i + np.uint64(salt * 977)), w) for i, w in (a, b))
        hits.append(np.mean(x == y))
    assert np.mean(hits) == pytest.approx(nd.similarity(a, b), abs=0.04)


def test_odd_rows(spark, odd, empty):
    assert nd.near_duplicates(odd).count() == 0
    assert nd.near_duplicates(empty).count() == 0
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(odd_rows()) - 2  # one row of the three with id 8
    assert nd.drop_near_duplicates(empty).count() == 0


def test_thousands_of_copies_keep_the_least_id(spark):
    rows = [(i, prose(1)) for i in range(500, 1500)] + [(i, near(2, 0.01 * (i % 5))) for i in range(300)] + [(7000, prose(3))]
    got = {r.doc_id: r.kept_id for r in nd.near_duplicates(make(spark, rows)).collect()}
    assert {i for i, k in got.items() if k == 500} == set(range(501, 1500))
    assert {i for i, k in got.items() if k == 0} == set(range(1, 300))
    assert 7000 not in got


@pytest.mark.parametrize("block", [3, 1024])
def test_groups_of_a_bucket_meet_in_blocks(spark, monkeypatch, block):
    """All pairs of a key whose samples agree often enough, once each, however many blocks there are; no others."""
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = np.random.default_rng(3)
    size = nd.BANDS * nd.ROWS
    base = rng.integers(0, 256, (6, size), dtype=np.uint8)
    samples = {}
    for rep in range(40):
        own = base[rep % 6].copy()
        own[rng.choice(size, rng.integers(0, size), replace=False)] = 0
        samples[rep] = own
    rows = [(k, rep) for k in range(5) for rep in range(40) if rng.random() < 0.5] + [(77, 1)]
    want = set()
    for k in range(5):
        own = sorted(r for x, r in rows if x == k)
        want |= {(a, b) for a, b in itertools.combinations(own, 2) if (samples[a] == samples[b]).sum() >= (0.5 - nd.SLACK) * size}
    first = spark.createDataFrame([(r, bytearray(s.tobytes())) for r, s in samples.items()], "rep long, samples binary")
    got = nd._between(spark.createDataFrame(rows, "key long, rep long"), first, 0.5).collect()
    assert sorted(map(tuple, got)) == sorted(want) and 20 < len(want)
    assert nd._between(spark.createDataFrame([], "key long, rep long"), first, 0.5).count() == 0


def test_components_over_the_cluster_equal_those_of_one_task(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (1, 0)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = sorted(map(tuple, components(df).collect()))
    assert one == sorted(map(tuple, components(df, one_task=0).collect()))
    assert components(df.limit(0)).count() == 0
