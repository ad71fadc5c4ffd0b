import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate as dc
from sparkloom.llm.common import Tokens, lowered, record

from .conftest import make, odd_rows, prose


def brute_tiles(p, t, least):
    """Greedy string tiling as first published: all matches of all places in every round."""
    pf, tf, out = [True] * len(p), [True] * len(t), []
    while True:
        best, found = least, []
        for a in range(len(p)):
            for b in range(len(t)):
                n = 0
                while a + n < len(p) and b + n < len(t) and pf[a + n] and tf[b + n] and p[a + n] == t[b + n]:
                    n += 1
                if n > best or n == best and n:
                    found = [(a, b)] if n > best else [*found, (a, b)]
                    best = n
        if not found:
            return out
        for a, b in found:
            if all(pf[a : a + best]) and all(tf[b : b + best]):
                pf[a : a + best], tf[b : b + best] = [False] * best, [False] * best
                out.append((a, b, best))


def hashes(text):
    return Tokens(*lowered(record("text", [text]))).hash


def brute(docs, items, coverage=dc.COVERAGE, least=dc.MIN_MATCH):
    out = set()
    for d, text in docs:
        for i, item in items:
            if d is not None and text and item:
                p, t = hashes(item).tolist(), hashes(text).tolist()
                if p and (n := sum(x[2] for x in brute_tiles(p, t, min(least, len(p))))) >= coverage * len(p) - 1e-9:
                    out.add((d, i, n))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_tiles_equal_the_plain_algorithm(seed):
    import numpy as np

    rng = random.Random(seed)
    p, t = ([rng.randrange(4 + seed) for _ in range(rng.randrange(1, 60))] for _ in "ab")
    got = dc.tiles(np.array(p, np.uint64), np.array(t, np.uint64), 3)
    want = brute_tiles(p, t, 3)
    assert sorted(got) == sorted(want)


def cases():
    rng = random.Random(2)
    items = [(k, prose(k, rng.randrange(20, 60))) for k in range(8)] + [(50, "one two"), (51, ""), (52, None)]
    docs = []
    for k in range(8):
        w = items[k][1].split()
        third = len(w) // 3
        docs.append((100 + k, f"{prose(900 + k, 30)} {' '.join(w)} {prose(800 + k, 30)}"))
        docs.append((200 + k, f"{' '.join(w[2 * third :])} {prose(700 + k, 5)} {' '.join(w[:third])} {prose(600 + k, 9)} {' '.join(w[third : 2 * third])}"))  # reordered
        docs.append((300 + k, " ".join(w[: len(w) // 3]) + " " + prose(500 + k, 30)))  # too little
        docs.append((400 + k, prose(400 + k, 60)))
    return docs + [(500, "say One, TWO!"), (501, "two one")], items


@pytest.mark.parametrize("limit", [dc.BENCHMARK_BYTES, 0])
def test_documents_against_brute_force(spark, limit):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(make(spark, docs), bench, broadcast_bytes=limit).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id, r.covered) for r in got} == want
    assert {d for d, _, _ in want} >= {*range(100, 108), *range(200, 208), 500}
    kept = {r.doc_id for r in dc.drop_contaminated(make(spark, docs), bench, broadcast_bytes=limit).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in want}


def test_real_documents_against_brute_force(spark, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' where length(text) < 1500").fetchall()
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    want = set()
    for d, text in docs:  # tiles need a common run of tokens: skip pairs without one
        t = hashes(text).tolist()
        seeds = {tuple(t[k : k + dc.MIN_MATCH]) for k in range(len(t))}
        for i, item in items:
            p = hashes(item).tolist()
            if any(tuple(p[k : k + dc.MIN_MATCH]) in seeds for k in range(len(p) - dc.MIN_MATCH + 1)):
                want |= brute([(d, text)], [(i, item)])
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {(r.doc_id, r.item_id, r.covered) for r in got.collect()} == want


def test_both_ways_keep_the_same_rows(spark, monkeypatch):
    """Repeated and missing ids, repeated items, reordered and partial passages; small and large benchmarks decide alike."""
    docs, items = cases()
    rows = docs + [(None, docs[0][1]), (None, prose(12)), (docs[3][0], docs[1][1]), (docs[0][0], prose(13)), (docs[0][0], docs[0][1])]
    frame = make(spark, rows).withColumn("row", F.lit(1)).withColumn("c0", F.lit(2)).repartition(3)
    bench = spark.createDataFrame(items + [items[2], (2, prose(77, 40))], "item_id long, text string")
    kept = [sorted(map(repr, dc.drop_contaminated(frame, bench, broadcast_bytes=limit).collect())) for limit in (dc.BENCHMARK_BYTES, 0)]
    found = [sorted(map(repr, dc.contaminated(frame, bench, broadcast_bytes=limit).collect())) for limit in (dc.BENCHMARK_BYTES, 0)]
    assert kept[0] == kept[1] and found[0] == found[1] and 0 < len(kept[0]) < len(rows)
    monkeypatch.setattr(dc, "fits", lambda *_: False)
    assert sorted(map(repr, dc.contaminated(frame, bench, broadcast_bytes=0).collect())) == found[0]


@pytest.mark.parametrize("limit", [dc.BENCHMARK_BYTES, 0])
def test_odd_rows(spark, odd, empty, limit):
    bench = spark.createDataFrame([(1, prose(8)), (1, prose(8)), (2, None), (None, "word"), (3, "?"), (4, "")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in dc.contaminated(odd, bench, broadcast_bytes=limit).collect()]
    assert set(got) == {(8, 1)}
    kept = dc.drop_contaminated(odd, bench, broadcast_bytes=limit)
    assert kept.columns == odd.columns
    assert kept.count() == len(odd_rows()) - 2
    assert dc.contaminated(empty, bench, broadcast_bytes=limit).count() == 0
    assert dc.contaminated(odd, bench.limit(0), broadcast_bytes=limit).count() == 0
