import hashlib

import duckdb

from sparkloom.llm import sharding as sh

from .conftest import make, odd_rows, prose


def brute(rows, limit):
    """Extendible hashing, bucket by bucket."""
    hashed = [(int(hashlib.md5((str(d) if d is not None else "text " + (t or "")).encode()).hexdigest()[:15], 16), d, len((t or "").encode())) for d, t in rows]
    done, todo = {}, [("", hashed)]
    while todo:
        prefix, own = todo.pop()
        if own and (sum(b for *_, b in own) <= limit or len({h for h, *_ in own}) == 1):
            for h, d, b in own:
                done.setdefault((d, b), set()).add(prefix)
        elif own:
            for bit in "01":
                todo.append((prefix + bit, [x for x in own if format(x[0], "060b")[len(prefix)] == bit]))
    return done


def test_against_brute_force(spark):
    rows = [(i, prose(i, 1 + i % 90)) for i in range(400)] + odd_rows()
    for limit in (3000, 50_000, 10**9):
        got = sh.assign_shards(make(spark, rows), limit)
        want = brute(rows, limit)
        out = got.collect()
        assert len(out) == len(rows)
        assert all(r.shard in want[r.doc_id, r.shard_bytes] for r in out)
        pages = {}
        for r in out:
            assert r.shard_depth == len(r.shard)
            pages.setdefault((r.shard, r.shard_page), []).append(r.shard_bytes)
        assert all(sum(p) <= limit or len(p) == 1 for p in pages.values())


def test_hash_of_many_rows_overflows_into_pages(spark):
    rows = [(1, prose(i, 100)) for i in range(50)] + [(2, "x")]
    out = sh.assign_shards(make(spark, rows), 4000).collect()
    pages = {}
    for r in out:
        pages.setdefault((r.shard, r.shard_page), []).append(r.shard_bytes)
    assert all(sum(p) <= 4000 or len(p) == 1 for p in pages.values()) and len(out) == 51


def test_one_text_of_one_id_many_times(spark):
    """Rows of one hash and text are spread over salts; pages hold no more than the limit all the same."""
    rows = [(1, prose(7, 20))] * 300 + [(1, prose(8, 40))] * 20 + [(None, "z" * 900)] * 30
    out = sh.assign_shards(make(spark, rows).repartition(3), 4000).collect()
    pages = {}
    for r in out:
        pages.setdefault((r.shard, r.shard_page), []).append(r.shard_bytes)
    assert len(out) == 350 and all(sum(p) <= 4000 for p in pages.values()) and len(pages) > 10


def test_sql_has_the_same_rows_where_buckets_split(spark, sf):
    sf = sf.replace("0.001", "0.01")
    duckdb.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
    for limit in (30_000, 400_000):
        want = duckdb.sql(sh.sql(limit)).fetchall()
        got = sh.shard_table(spark.read.parquet(f"{sf}/documents.parquet"), limit).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        assert max(r.shard_depth for r in got) > 1


def test_columns_of_any_name_are_kept(spark):
    docs = make(spark, [(i, prose(i, 30)) for i in range(40)])
    for name in ("__h", "h", "md", "salt", "full", "slot9", "depth9", "c0", "own"):
        docs = docs.withColumn(name, docs.n_chars + 5)
    out = sh.assign_shards(docs, 700).collect()
    assert all(r[n] == r.n_chars + 5 for r in out for n in ("__h", "h", "md", "salt", "full", "slot9", "depth9", "c0", "own"))


def test_parts_of_one_document_can_split(spark):
    docs = make(spark, [(1, prose(i, 30)) for i in range(60)])
    assert {r.shard_depth for r in sh.assign_shards(docs, 2000).collect()} == {0}
    out = sh.assign_shards(docs, 2000, whole=True).collect()
    size = {}
    for r in out:
        size[r.shard] = size.get(r.shard, 0) + r.shard_bytes
    assert max(size.values()) <= 2000 and len(size) > 4


def test_odd_rows(spark, odd, empty):
    clash = odd.withColumnRenamed("count", "shard").withColumnRenamed("term", "slot")
    out = sh.assign_shards(clash, 1000)
    assert out.columns == [c for c in clash.columns if c != "shard"] + ["shard", "shard_depth", "shard_page", "shard_bytes"]
    assert out.count() == len(odd_rows())
    assert sh.assign_shards(empty).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    sh.write_shards(make(spark, [(i, prose(i)) for i in range(50)], extra=False), str(tmp_path / "out"), 5000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_sql_has_the_same_rows(spark, sf):
    duckdb.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
    want = duckdb.sql(sh.sql()).fetchall()
    got = sh.shard_table(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
