import collections
import itertools

import duckdb
import numpy as np

import corpus_pipeline as cp
from sparkloom.llm import near_dup as nd
from sparkloom.llm.common import Tokens, cut, doc_grams, lowered, record
from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.near_dup import near_duplicates
from sparkloom.llm.quality import classify
from sparkloom.llm.sharding import LIMIT_BYTES

from .conftest import make, odd_rows, prose
from .test_decontaminate import brute as brute_tiles_of
from .test_near_dup import brute_pairs, groups, near


def test_stages_take_effect_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in cp.STAGES:
        kept.append(cut(stage(spark, kept[-1], sf)))
    names = docs.columns
    assert all(k.columns == names for k in kept[:-1])
    rows = [{r.doc_id: r.text for r in k.collect()} for k in kept[:4]]
    ok = {r.doc_id for r in classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("accepted").collect()}
    assert rows[1].keys() == ok and all(rows[0][d] == t for d, t in rows[1].items())
    ids = sorted(rows[1])
    want = groups(len(ids), brute_pairs([rows[1][i] for i in ids], 0.5))
    assert rows[2].keys() >= {i for k, i in enumerate(ids) if k not in want}
    assert len(rows[1]) - len(rows[2]) >= 0.9 * len(want)
    short = {d: t for d, t in rows[2].items() if len(t) < 1200}
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    bad = {r.doc_id for r in contaminated(kept[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert rows[3].keys() == rows[2].keys() - bad
    some = sorted(short)[:12]
    assert {d for d, _, _ in brute_tiles_of([(d, short[d]) for d in some], items)} == bad & set(some)
    blocks = kept[4].collect()
    words = collections.Counter(w for t in rows[3].values() for w in t.split())
    assert not {w for b in blocks for w in b.text.split()} - words.keys()
    assert {b.doc_id for b in blocks} <= rows[3].keys()
    shards = collections.defaultdict(int)
    for r in kept[5].collect():
        shards[r.shard, r.shard_page] += r.shard_bytes
    assert kept[5].count() == len(blocks) and max(shards.values()) <= LIMIT_BYTES
    assert near_duplicates(kept[2]).count() <= 0.1 * len(want) + 1


def test_no_near_copy_just_above_the_threshold_stays(spark):
    """The stage keeps one document of each group that brute force over all pairs finds."""
    texts = [t for g in range(100) for t in (prose(g, 60 + g % 90), near(g, 0.1 + 0.0003 * g, 60 + g % 90))]
    gone = groups(len(texts), brute_pairs(texts, 0.5))
    kept = cp.near_duplicates(spark, make(spark, list(enumerate(texts)), extra=False), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in range(len(texts)) if i not in gone]


def test_near_copies_by_true_frequencies(spark):
    """Texts with so many shingles that the sketch of frequencies is far too high: near copies are those of the exact ones, neither fewer
    (the pairs that differ in frequent passages) nor more (those that share them)."""
    long = [prose(f"long {k}", 40_000, 10**6) for k in range(90)]
    often = [prose(f"often {k}", 300) for k in range(6)]
    texts = []
    for g in range(80):
        passages = [" ".join(often[(g + k) % 6].split()[: 70 + g * 3 // 4]) for k in (0, 1 + g % 5)]
        texts += [f"{prose(g, 100)} {p}" for p in passages]
    for g in range(80):
        passage = " ".join(often[g % 6].split()[: 100 + g * 15 // 8])
        texts += [f"{prose(f'{g} {k}', 50)} {passage}" for k in range(2)]
    every = texts + long
    grams = [doc_grams(Tokens(*lowered(record("text", [t]))), nd.K)[1:] for t in every]
    ids, at, df = np.unique(np.concatenate([i for i, _ in grams]), return_inverse=True, return_counts=True)
    idf = dict(zip(ids[at[: sum(len(i) for i, _ in grams[: len(texts)])]].tolist(), np.log1p(len(every) / df[at]).tolist()))
    w = [(i, np.array([idf[x] for x in i.tolist()]) * c) for i, c in grams[: len(texts)]]
    pairs = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if nd.similarity(w[i], w[j]) >= 0.5}
    gone = groups(len(texts), pairs)
    assert 20 < len(gone) < 140
    kept = cp.near_duplicates(spark, make(spark, list(enumerate(every)), extra=False), "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in range(len(every)) if i not in gone]


def test_near_copies_without_an_id(spark):
    """Rows without an id go if a document with one is a near copy; of groups that have none, one row stays."""
    rows = [(i, prose(i, 120)) for i in range(20)] + [(i, None) for i in (100, None, None)] + [(None, "?!"), (None, "?!")]
    rows += [(None, near(g, 0.02 * k)) for g in range(10, 30) for k in range(3)] + [(200 + g, prose(g, 120).upper()) for g in range(25, 30)]
    rows += [(None, prose(900, 120))]
    docs = make(spark, rows)
    kept = cp.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
    named = {k for k in kept if k[0] is not None}
    assert named == {r for r in rows if r[0] is not None}
    assert kept[None, None] == kept[None, "?!"] == 2 and kept[None, prose(900, 120)] == 1
    assert sum(kept[None, t] for t in {near(g, 0.02 * k) for g in range(20, 25) for k in range(3)}) == 5
    assert sum(kept.values()) == len(named) + 10


def test_long_rows_reach_workers_in_small_batches(spark, tmp_path):
    """However many rows a batch may have, it holds few bytes after the first stage has read its tables; smaller limits stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    make(spark, [(i, prose(i, 10)) for i in range(9)], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get(key)
    try:
        cp.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        sizes = spark.range(0, 3000, 1, 1).selectExpr("repeat(string(id % 10), 10000) text").mapInArrow(lambda batches: (record("n", [b.nbytes] * b.num_rows) for b in batches), "n long").collect()
        assert len(sizes) == 3000 and max(r.n for r in sizes) < 6 << 20
        spark.conf.set(key, 1000)
        cp.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)


def test_shards_keep_the_mix(spark, tmp_path, monkeypatch):
    """Sources by shard after the last stage: each shard's shares are those of all blocks, but for chance; one long document parts."""
    from sparkloom.llm import sharding

    rows = [(i, prose(i, 400), f"s{i % 3}") for i in range(90)] + [(500, prose(500, 40_000), "s0")]
    blocks = cut(cp.mixing(spark, make(spark, rows, extra=False), ""))
    out = sharding.assign_shards(blocks, 60_000, whole=True).collect()
    assert {r.shard for r in out} and len({r.shard for r in out if r.doc_id == 500}) > 1
    whole = collections.Counter(r.source for r in out)
    for shard in {r.shard for r in out}:
        own = collections.Counter(r.source for r in out if r.shard == shard)
        n = sum(own.values())
        for s, c in whole.items():
            share = c / len(out)
            assert abs(own[s] - n * share) <= 5 * (n * share * (1 - share)) ** 0.5 + 1


def test_run_repeats_itself(spark, sf):
    a, b = (sorted(map(str, cp.run(spark, sf).collect())) for _ in "ab")
    assert a == b and a


def test_odd_rows(spark, tmp_path):
    docs = make(spark, odd_rows() + [(i, prose(i)) for i in range(100, 130)], extra=False)
    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        at = str(tmp_path / name)
        rows.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(100, 130)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, prose(500))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        out = cp.run(spark, at)
        assert (out.count() > 0) == (name == "odd")
