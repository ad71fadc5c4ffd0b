"""Every registered query of the library against its SQL in DuckDB."""

import math

import duckdb
import pytest

from sparkloom.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{FOLDER}/{t}.parquet'")
    return con


def key(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) else v


@pytest.fixture(scope="module", autouse=True)
def shared_parts():
    """What many queries begin with is computed once for all of them."""
    from pyspark.sql import DataFrame

    from sparkloom.functions.lineage import written
    from sparkloom.plans import bench_queries, graph_queries, rank_queries

    made, own = {}, []

    def once(name, f):
        def run(t, *args):
            if (name, t.folder, args) not in made:
                out = f(t, *args)
                made[name, t.folder, args] = written(out) if isinstance(out, DataFrame) else out
            return made[name, t.folder, args]

        return run

    for module, names in ((rank_queries, ["_signals", "_nodes"]), (bench_queries, ["_facts", "_old_found", "_edges"]), (graph_queries, ["_ranks"])):
        for n in names:
            own.append((module, n, getattr(module, n)))
            setattr(module, n, once(n, getattr(module, n)))
    for n in ("_signals", "_nodes"):
        own.append((bench_queries, n, getattr(bench_queries, n)))
        setattr(bench_queries, n, getattr(rank_queries, n))
    yield
    for module, n, f in reversed(own):
        setattr(module, n, f)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_rows_equal_those_of_the_sql(spark, duck, name):
    df = all_queries.QUERIES[name](spark, FOLDER)
    got = [tuple(key(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = duck.execute(all_queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(key(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_every_query_has_sql():
    assert all_queries.QUERIES.keys() == all_queries.SQL.keys()


def test_thirty_iterations_against_brute_force(spark):
    """Ranks, their cap and weights of neighbourhoods with the operator's own number of iterations, on a small graph."""
    from sparkloom.operators import graph

    edges = [(f"n{i}", f"n{i * i % 23}", 1.0 + i % 3) for i in range(40)] + [(f"n{i}", f"n{i + 1}", 0.5) for i in range(39)]
    nodes = sorted({x for e in edges for x in e[:2]} | {"alone"})
    out = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(30):
        loose = sum(rank[n] for n in nodes if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * loose / len(nodes) for n in nodes}
        for a, b, w in edges:
            new[b] += 0.85 * rank[a] * w / out[a]
        rank = new
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "node string"), df).cache()
    assert {r.node: r["rank"] for r in got.collect()} == pytest.approx(rank, abs=1e-9)
    assert graph.rank_cap(got).first()[0] == pytest.approx(sorted(rank.values(), reverse=True)[len(nodes) // 10], abs=1e-9)
    assert {"pagerank_30", "pr_cap_30", "expand_weighted_30"} <= all_queries.QUERIES.keys()
