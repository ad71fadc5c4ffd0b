import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing as mx

from .conftest import make, odd_rows, prose

SMALL = dict(block_tokens=50, shard_slots=8)


def corpus(spark):
    rng = random.Random(1)
    rows = [(i, prose(i, rng.randrange(1, 400)), f"s{min(3, rng.randrange(8))}") for i in range(120)]
    return rows, make(spark, rows)


def tokens(text):
    return text.split()


@pytest.mark.parametrize("lane_tokens", [10**9, 2000])
def test_packing_keeps_every_token_once(spark, lane_tokens):
    rows, docs = corpus(spark)
    out = mx.mix_sources(docs, weights={f"s{k}": 1 for k in range(4)}, lane_tokens=lane_tokens, **SMALL).collect()
    for s in {r[2] for r in rows}:
        own = {r.block: r for r in out if r.source == s}
        made = collections.Counter(w for r in own.values() for w in tokens(r.text))
        have = collections.Counter(w for _, t, x in rows if x == s for w in tokens(t))
        if {r.epoch for r in out if r.source == s} != {0}:  # all blocks came
            assert made == have
        assert not made - have
        assert all(r.n_tokens == 50 for r in own.values()) or lane_tokens < 10**9 or sum(r.n_tokens != 50 for r in own.values()) == 1


def brute_mix(rows, weights, block_tokens, slots, seed=mx.SEED):
    """(shard, slot, source, block, epoch, words) with one lane for each source: packing, drawing and joining by plain loops."""
    blocks = {}
    for s in sorted({r[2] for r in rows}):
        flow = []
        for _, text, _ in sorted(r for r in rows if r[2] == s):
            if text.split():
                flow += [*text.split(), None]  # the end of a document is a token
        blocks[s] = [[w for w in flow[k : k + block_tokens] if w] for k in range(0, len(flow), block_tokens)]
    return blocks, sum(map(len, blocks.values()))


def test_blocks_slots_and_draws_by_brute_force(spark):
    """Without lanes: every block's words, every shard's multinomial counts, and each source's n-th slot by the permutation of its epoch."""
    rows, docs = corpus(spark)
    weights = {"s0": 4, "s1": 1, "s2": 0.5, "s3": 0}
    blocks, total = brute_mix(rows, weights, 50, 8)
    out = mx.mix_sources(docs, weights=weights, lane_tokens=10**9, **SMALL).collect()
    assert len(out) == total and {r.source for r in out} == {"s0", "s1", "s2"}
    for r in out:
        assert r.text.split() == blocks[r.source][r.block] and r.n_tokens in (50, len(blocks[r.source][r.block]) + 1, len(blocks[r.source][r.block]))
    key = {r["source"]: r["k"] for r in docs.selectExpr("source", "xxhash64(source) k").distinct().collect()}
    order = sorted((s for s in weights if weights[s]), key=key.get)
    share = np.array([weights[s] for s in order]) / sum(weights.values())
    got = {(r.shard, r.slot): r for r in out}
    at = dict.fromkeys(order, 0)
    shards = -(-total // 8)
    for shard in range(shards):
        n = total - 8 * (shards - 1) if shard == shards - 1 else 8
        rng = np.random.default_rng([mx.SEED, shard])
        counts = rng.multinomial(n, share)
        places = rng.permutation(n).tolist()
        for s, c in zip(order, counts):
            for _ in range(c):
                r, size = got.pop((shard, places.pop(0))), len(blocks[s])
                epoch = at[s] // size
                want = mx.permute(np.array([at[s] % size]), size, hash((mx.SEED, order.index(s), epoch)))[0]
                assert (r.source, r.epoch, r.block) == (s, epoch, want)
                at[s] += 1
    assert not got


def test_ties_are_broken_by_all_that_is_shown(spark):
    rows = [(1, "a b c", "s")] * 3 + [(1, "a b c d", "s")]
    docs = make(spark, rows, extra=False).withColumn("lang", F.concat(F.lit("l"), (F.monotonically_increasing_id() % 3).cast("string")))
    docs = spark.createDataFrame([tuple(r) for r in docs.collect()], docs.schema)
    one = sorted(map(tuple, mx.mix_sources(docs, block_tokens=2, shard_slots=3).collect()))
    assert one == sorted(map(tuple, mx.mix_sources(docs.repartition(3, "lang").sort(F.desc("lang")), block_tokens=2, shard_slots=3).collect()))


def test_no_block_twice_before_all_others(spark):
    _, docs = corpus(spark)
    out = mx.mix_sources(docs, weights={"s0": 30, "s1": 1, "s3": 1}, **SMALL).collect()
    assert {r.source for r in out} == {"s0", "s1", "s3"}
    for s in ("s0", "s1", "s3"):
        per = collections.defaultdict(collections.Counter)
        for r in out:
            if r.source == s:
                per[r.epoch][r.block] += 1
        last = max(per)
        sizes = {e: len(c) for e, c in per.items() if e < last}
        assert all(v == 1 for c in per.values() for v in c.values())
        assert len(set(sizes.values())) <= 1
        assert len(per[last]) <= max(sizes.values(), default=10**9)
        assert {(r.block, r.text) for r in out if r.source == s and r.epoch == 0} >= {(r.block, r.text) for r in out if r.source == s and r.epoch == 1}


def test_shares_follow_the_weights(spark):
    rows = [(i, prose(i, 300), f"s{i % 3}") for i in range(400)]
    w = {"s0": 0.6, "s1": 0.3, "s2": 0.1}
    out = mx.mix_sources(make(spark, rows), weights=w, block_tokens=50, shard_slots=256).collect()
    n = collections.Counter(r.source for r in out)
    for s, share in w.items():
        assert n[s] / len(out) == pytest.approx(share, abs=4 * (share * (1 - share) / len(out)) ** 0.5)
    places = collections.Counter((r.shard, r.slot) for r in out)
    assert set(places.values()) == {1}
    per = collections.Counter(r.shard for r in out)
    assert all(per[s] == 256 for s in range(max(per))) and per[max(per)] <= 256


def test_same_result_however_it_is_partitioned(spark):
    _, docs = corpus(spark)
    a = sorted(map(tuple, mx.mix_sources(docs, **SMALL).collect()))
    assert a == sorted(map(tuple, mx.mix_sources(docs.repartition(7, "n_chars"), **SMALL).collect()))


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutations(n):
    for key in (0, 7, -(1 << 61), 1 << 62):
        assert sorted(mx.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_odd_rows(spark, odd, empty):
    out = mx.mix_sources(odd, **SMALL).collect()
    words = [w for _, t in odd_rows() for w in tokens(t or "")]
    once = {r.block: r.text for r in out}
    assert collections.Counter(w for t in once.values() for w in tokens(t)) == collections.Counter(words)
    assert mx.mix_sources(empty).count() == 0
    assert mx.mix_sources(odd, weights={"other": 1}).count() == 0
    docs = mx.mixed_documents(make(spark, [(1, "a b", None), (2, "c", None), (None, "d", "s")]))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.source for r in docs.collect()} <= {None, "s"} and docs.count() == 2  # two blocks, so two slots
