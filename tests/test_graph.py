"""Graph operators against plain loops, and what they gather on the way."""

from sparkloom.operators import graph


def _edges(spark):
    """Two stars whose leaves meet, a chain, an edge to itself."""
    rows = [("A", f"x{i:02}", "import") for i in range(30)] + [("B", f"x{i:02}", "call") for i in range(25, 40)] + [("B", "x30", "inherit"), ("c1", "c2", "call"), ("c2", "c3", "odd"), ("c3", "c3", "call"), ("c3", "c4", "import")]
    return rows, spark.createDataFrame(rows, "src string, dst string, edge_type string")


def _near(rows, seed, hops, both=True):
    """hop of each node."""
    found, front = {seed: 0}, {seed}
    for hop in range(1, hops + 1):
        front = {b for s, d, _ in rows for a, b in ([(s, d), (d, s)] if both else [(s, d)]) if a in front} - found.keys()
        found |= dict.fromkeys(front, hop)
    return found


def test_expansion_against_brute_force(spark, monkeypatch):
    """Neighbourhoods beyond the direct ones are made only for seeds whose direct neighbours don't fill the rows."""
    rows, edges = _edges(spark)
    ranks = {n: (k % 7) / 10 for k, n in enumerate(sorted({x for r in rows for x in r[:2]})) if n != "x01"}
    asked, khop = [], graph.khop
    monkeypatch.setattr(graph, "khop", lambda e, s, *a: asked.extend(r.seed for r in s.collect()) or khop(e, s, *a))
    seeds = ["A", "B", "c1", "c3", "x27", "none"]
    got = graph.expand(edges, spark.createDataFrame(list(ranks.items()), "node string, rank double"), spark.createDataFrame([(s,) for s in seeds], "seed string"), 2, 5)
    want = []
    for s in seeds:
        weight = {n: max([graph.PRIORS.get(t, graph.OTHER_PRIOR) for a, b, t in rows if n != s and {a, b} == {s, n}], default=0.0) * (1 + ranks.get(n, 0.0)) for n in _near(rows, s, 2)}
        want += [(s, n, round(w, 9), k) for k, (n, w) in enumerate(sorted(weight.items(), key=lambda x: (x[0] != s, -round(x[1], 9), x[0]))[:5], 1)]
    assert sorted((r.seed, r.node, round(r.weight, 9), r.place) for r in got.collect()) == sorted(want)
    assert sorted(asked) == ["c1", "c3", "none", "x27"]


def _sides(spark, edges, monkeypatch):
    """Once with all groups walked in tasks, once with all of them by joins."""
    yield edges
    monkeypatch.setattr(graph, "GROUP_STEPS", -1)
    yield edges.union(edges).union(edges).repartition(1)


def test_walks_against_brute_force(spark, monkeypatch):
    rows = [(f"n{i}", f"n{i * i % 23}", ["call", "import", "odd", "inherit"][i % 4]) for i in range(40)] + [(f"n{i}", f"n{i + 1}", None) for i in range(39)] + [(None, "n1", "call"), ("n1", None, "call")]
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(0, 40, 3)] + [("none",), ("n3",)], "seed string")
    whole = [r for r in rows if None not in r[:2]]
    monkeypatch.setattr(graph, "GROUP_SEEDS", 5)
    for edges in _sides(spark, spark.createDataFrame(rows, "src string, dst string, edge_type string"), monkeypatch):
        for direction, hops in (("both", 2), ("out", 3)):
            both = direction == "both"
            got = graph.khop(edges, seeds, hops, direction)
            assert sorted(map(tuple, got.collect())) == sorted((s, n, h) for s in {r.seed for r in seeds.collect()} for n, h in _near(whole, s, hops, both).items())
            want = []
            for s in {r.seed for r in seeds.collect()}:
                front, best = {s: 1.0}, {}
                for h in range(1, hops + 1):
                    found = {}
                    for a, b, t in [*whole, *([(d, c, t) for c, d, t in whole] if both else [])]:
                        if a in front and b != s:
                            found[b] = min(found.get(b, (9,)), (-front[a] * graph.PRIORS.get(t, graph.OTHER_PRIOR) * graph.DECAY ** (h - 1), t is not None, t or ""))
                    front = {n: -x[0] for n, x in found.items()}
                    for n, x in found.items():
                        best[n] = min(best.get(n, (9,)), (x[0], h, x[2] if x[1] else None), key=lambda y: y[:2])
                want += [(s, n, round(-x[0], 12), x[1], x[2]) for n, x in best.items()]
            got = graph.propagate(edges, seeds, hops, direction)
            assert sorted(map(repr, [(r.seed, r.node, round(r.score, 12), r.hop, r.via) for r in got.collect()])) == sorted(map(repr, want))


def test_pairs_on_the_way_are_not_shuffled(spark):
    """Two hops through 40 hubs make 40 times as many pairs as there are found."""
    edges = spark.range(200).crossJoin(spark.range(40).toDF("hub")).selectExpr("concat('a', id) AS src", "concat('h', hub) AS dst", "'call' AS edge_type")
    seeds = edges.select(edges.src.alias("seed")).distinct()
    found = graph.khop(edges, seeds, 2, "both")
    assert found.count() == 200 * 240
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_paths_of_one_stem_meet_in_many_tasks(spark, monkeypatch):
    """The rows are those of the SQL for blocks of any size, and no task has all pairs of a stem."""
    import duckdb

    from sparkloom.functions import lineage
    from sparkloom.plans import all_queries, text_queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view pages as from '{folder}/pages.parquet'")
    want = sorted(con.execute(all_queries.SQL["path_match"]).fetchall())
    monkeypatch.setattr(text_queries, "BLOCK", 3)
    monkeypatch.setattr(lineage, "TASK_PAIRS", 2)
    got = all_queries.QUERIES["path_match"](spark, folder)
    assert sorted(map(tuple, got.collect())) == want
    assert max(len(x) for x in got.rdd.glom().collect()) < len(want) / 2


def test_signals_are_dealt_to_tasks_and_pairs_are_not_joined(spark, monkeypatch):
    """A name that all nodes and texts share makes a row for each pair; no task has all of these, and no pair is shuffled."""
    from sparkloom.functions import lineage
    from sparkloom.operators import rank

    monkeypatch.setattr(lineage, "TASK_PAIRS", 200)
    nodes = rank.with_defaults(spark.range(60).selectExpr("id AS node_id", "concat('pkg', id % 3, '/mod', id, '.py') AS path", "concat('Mod', id) AS name", "1 AS line_start", "9 AS line_end"), spark.range(60).selectExpr("id AS node_id", "'normal' AS kind", "array('QuerySet', concat('Field', id)) AS symbols", "0.1D AS pr", "id % 3 AS calls", "id % 2 AS inherits", "concat('c', id % 4) AS cluster"))
    queries = spark.range(40).selectExpr("id AS query_id", "concat('QuerySet of `Field', id, '.x` and QuerySet.Field', id + 1, ' in mod', id, '.py') AS text")
    by_map = rank.signals(nodes, queries, 0.04)
    assert max(len(x) for x in by_map.rdd.glom().collect()) <= 2400 / 4
    plan = by_map.select("query_id", "node_id", "lex")._jdf.queryExecution().executedPlan().toString()
    assert "query_id" not in "".join(line for line in plan.splitlines() if "SortMergeJoin" in line)
    seen = lambda df: sorted((r.query_id, r.node_id, *(round(r[c], 9) for c in rank.BETAS)) for r in df.collect())
    got = seen(by_map)
    assert len(got) == 2400 and all(sum(r[2 + list(rank.BETAS).index(c)] > 0 for r in got) > 30 for c in ("lex", "symbol_exact", "term_idf"))
    monkeypatch.setattr(rank, "MAP_QUERIES", 0)
    assert seen(rank.signals(nodes, queries, 0.04)) == got
