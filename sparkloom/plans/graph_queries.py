"""Graphs of suppliers and parts: lookups, traversal, centrality; rectangles; replicated state over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import written
from ..operators import crdt, graph, spatial
from .registry import query

NODES = """SELECT concat('world.', r_name, '.', replace(n_name, ' ', '_'), '.N', s_suppkey % 60) AS fqn, concat('N', s_suppkey % 60) AS name, concat('world.', r_name, '.', replace(n_name, ' ', '_')) AS ns_path, s_suppkey AS node_ord FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT concat('parts.', p_brand, '.', 'P', p_partkey), concat('P', p_partkey), concat('parts.', p_brand), p_partkey + 1000000000 FROM part"""
EDGES = """SELECT DISTINCT concat('S', l_suppkey) AS src, concat('P', l_partkey) AS dst, CASE l_returnflag WHEN 'A' THEN 'inherit' WHEN 'N' THEN 'import' ELSE 'call' END AS edge_type FROM lineitem
 UNION ALL SELECT concat('P', p_partkey), concat('P', CAST(floor(p_partkey / 2) AS BIGINT)), 'config-ref' FROM part WHERE p_partkey > 1"""
SEEDS = "SELECT concat('S', s_suppkey) AS seed FROM supplier"
_PRIOR = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in graph.PRIORS.items()) + f" ELSE {graph.OTHER_PRIOR}::DOUBLE END"
_G = f"WITH e AS ({EDGES}), s AS ({SEEDS})"


@query("find_node_bare", f"WITH n AS ({NODES}), r AS (SELECT DISTINCT name AS ref FROM n) SELECT ref, (SELECT CASE WHEN count(*) = 1 THEN min(fqn) END FROM n WHERE n.name = ref) AS fqn FROM r")
def find_node_bare(t):
    n = t.derived(NODES)
    return graph.find_bare(n, n.select(F.col("name").alias("ref")).distinct())


_REFS = "SELECT DISTINCT concat(split_part(ns_path, '.', -1), '.', name) AS ref FROM n"


@query("find_node_dotted", f"WITH n AS ({NODES}), r AS ({_REFS}) SELECT ref, (SELECT arg_min(fqn, node_ord) FROM n WHERE fqn = ref OR ends_with(fqn, '.' || ref)) AS fqn FROM r")
def find_node_dotted(t):
    n = t.derived(NODES)
    return graph.find_dotted(n, n.select(F.concat_ws(".", F.split_part("ns_path", F.lit("."), F.lit(-1)), "name").alias("ref")).distinct())


#: Where inbound traversal begins: suppliers have no edge that leads to them.
ENDS = "SELECT concat('P', p_partkey) AS seed FROM part WHERE p_partkey % 17 = 1"


def _khop(direction, hops=2):
    d = {"out": "SELECT src, dst FROM e", "in": "SELECT dst AS src, src AS dst FROM e", "both": "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"}[direction]
    start = _G if direction != "in" else f"WITH e AS ({EDGES}), s AS ({ENDS})"
    return f"""{start}, d AS (SELECT DISTINCT src, dst FROM ({d})), h0 AS (SELECT seed, seed AS node, 0 AS hop FROM s), h1 AS (SELECT DISTINCT seed, dst AS node, 1 AS hop FROM h0 JOIN d ON node = src),
 h2 AS (SELECT DISTINCT seed, dst AS node, 2 AS hop FROM h1 JOIN d ON node = src), k AS (SELECT seed, node, min(hop) AS hop FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2) GROUP BY ALL)"""


for _d in ("out", "in", "both"):

    @query(f"khop_{_d}", f"{_khop(_d)} SELECT * FROM k")
    def khop(t, d=_d):
        return graph.khop(t.derived(EDGES), t.derived(ENDS if d == "in" else SEEDS), 2, d)


@query("slice_edges", f"{_khop('out')} SELECT k.seed, e.src, e.dst, e.edge_type FROM e JOIN k ON e.src = k.node JOIN k b ON e.dst = b.node AND b.seed = k.seed")
def slice_edges(t):
    e = t.derived(EDGES)
    return graph.slice_edges(e, graph.khop(e, t.derived(SEEDS), 2, "out")).select("seed", "src", "dst", "edge_type")


@query("slice_namespaces", f"WITH n AS ({NODES}) SELECT DISTINCT array_to_string(string_split(ns_path, '.')[1:i], '.') AS namespace, i::INT AS level, count(*)::BIGINT AS nodes FROM n, range(1, 10) r(i) WHERE i <= len(string_split(ns_path, '.')) GROUP BY 1, 2")
def slice_namespaces(t):
    return graph.ancestors(t.derived(NODES), "ns_path").groupBy(F.col("ancestor").alias("namespace")).agg(F.first(F.size(F.split("ancestor", r"\."))).alias("level"), F.count("*").alias("nodes"))


@query("typed_propagation", f"""{_G}, d AS (SELECT src, dst, max(p) AS p, first(edge_type ORDER BY p DESC, edge_type) AS via FROM (SELECT *, {_PRIOR} AS p FROM (SELECT src, dst, edge_type FROM e UNION ALL SELECT dst, src, edge_type FROM e)) GROUP BY src, dst),
 h1 AS (SELECT seed, dst AS node, p AS carry, via FROM s JOIN d ON seed = src WHERE dst <> seed), h2 AS (SELECT seed, dst AS node, max(x) AS carry, first(via ORDER BY x DESC, via) AS via FROM (SELECT seed, dst, carry * p * 0.82::DOUBLE AS x, d.via FROM h1 JOIN d ON node = src WHERE dst <> seed) GROUP BY ALL)
 SELECT seed, node, round(max(carry), 9) AS score, first(hop ORDER BY carry DESC, hop)::INT AS hop, first(via ORDER BY carry DESC, hop) AS via FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 AS hop FROM h2) GROUP BY ALL""")
def typed_propagation(t):
    return graph.propagate(t.derived(EDGES), t.derived(SEEDS), 2).withColumn("score", F.round("score", 9))


_ALL = "SELECT DISTINCT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst AS node FROM e)"


def _pagerank(n):
    rounds = "".join(f", r{i} AS (SELECT v.node, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(f.flow, 0) + coalesce(l.loose, 0) / c.n) AS rank FROM v CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank * share) AS flow FROM r{i - 1} JOIN w ON node = src GROUP BY dst) f ON f.dst = v.node CROSS JOIN (SELECT sum(rank) AS loose FROM r{i - 1} WHERE node NOT IN (SELECT src FROM w)) l)" for i in range(1, n + 1))
    return f"{_G}, v AS ({_ALL}), c AS (SELECT count(*) AS n FROM v), w AS (SELECT src, dst, sum(p) / sum(sum(p)) OVER (PARTITION BY src) AS share FROM (SELECT src, dst, {_PRIOR} AS p FROM e) GROUP BY src, dst), r0 AS (SELECT node, 1::DOUBLE / n AS rank FROM v, c){rounds}"


def _edges(t):
    """Written, as several steps read them."""
    return written(t.derived(EDGES))


def _ranks(t, n, e=None):
    e = (_edges(t) if e is None else e).withColumn("weight", graph.prior(F.col("edge_type")))
    return graph.pagerank(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))), e, n)


@query("pagerank_5", f"{_pagerank(5)} SELECT node, round(rank, 9) AS rank FROM r5")
def pagerank_5(t):
    return _ranks(t, 5).withColumn("rank", F.round("rank", 9))


@query("pr_cap", f"{_pagerank(2)} SELECT round(rank, 9) AS cap FROM (SELECT rank, row_number() OVER (ORDER BY rank DESC) AS k, count(*) OVER () AS n FROM r2) WHERE k = (n // 10) + 1")
def pr_cap(t):
    return graph.rank_cap(_ranks(t, 2)).withColumn("cap", F.round("cap", 9))


# The same with the operator's own number of iterations; rounds are materialised, or they would be computed again for each use.
ITERATIONS = 30
_R30 = _pagerank(ITERATIONS).replace(" AS (SELECT v.node", " AS MATERIALIZED (SELECT v.node").replace(", v AS (", ", v AS MATERIALIZED (").replace(", w AS (", ", w AS MATERIALIZED (")


@query("pagerank_30", f"{_R30} SELECT node, round(rank, 9) AS rank FROM r30")
def pagerank_30(t):
    return _ranks(t, ITERATIONS).withColumn("rank", F.round("rank", 9))


@query("pagerank_30_mass", f"{_R30} SELECT round(sum(rank), 6) AS mass, count(*)::BIGINT AS nodes, round(sum(rank * rank), 9) AS squares FROM r30")
def pagerank_30_mass(t):
    return _ranks(t, ITERATIONS).agg(F.round(F.sum("rank"), 6).alias("mass"), F.count("*").alias("nodes"), F.round(F.sum(F.col("rank") * F.col("rank")), 9).alias("squares"))


@query("pr_cap_30", f"{_R30} SELECT round(rank, 9) AS cap FROM (SELECT rank, row_number() OVER (ORDER BY rank DESC) AS k, count(*) OVER () AS n FROM r30) WHERE k = (n // 10) + 1")
def pr_cap_30(t):
    return graph.rank_cap(_ranks(t, ITERATIONS)).withColumn("cap", F.round("cap", 9))


@query("in_degree_by_type", f"{_G} SELECT dst AS node, count(*) FILTER (edge_type = 'call')::BIGINT AS calls, count(*) FILTER (edge_type = 'inherit')::BIGINT AS inherits FROM e GROUP BY dst")
def in_degree_by_type(t):
    return graph.in_degrees(t.derived(EDGES))


@query("direct_neighbors", f"{_G} SELECT src AS node, 'import' AS role, count(DISTINCT dst)::BIGINT AS n FROM e GROUP BY src UNION ALL SELECT dst, 'dependent', count(DISTINCT src)::BIGINT FROM e GROUP BY dst")
def direct_neighbors(t):
    e = t.derived(EDGES)
    one = e.groupBy(F.col("src").alias("node")).agg(F.lit("import").alias("role"), F.countDistinct("dst").alias("n"))
    return one.unionByName(e.groupBy(F.col("dst").alias("node")).agg(F.lit("dependent").alias("role"), F.countDistinct("src").alias("n")))


@query("expand_weighted", _pagerank(2) + _khop("both")[len(_G):] + f""", m AS (SELECT src AS ms, dst AS md, max({_PRIOR}) AS p FROM (SELECT src, dst, edge_type FROM e UNION ALL SELECT dst, src, edge_type FROM e) GROUP BY ALL)
 SELECT seed, node, round(weight, 9) AS weight, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (node = seed) DESC, round(weight, 9) DESC, node)::INT AS place FROM (SELECT seed, k.node, CASE WHEN k.node = seed THEN 0::DOUBLE ELSE coalesce(p * (1 + coalesce(rank, 0)), 0) END AS weight FROM k LEFT JOIN m ON seed = ms AND k.node = md LEFT JOIN r2 ON r2.node = k.node)) WHERE place <= 10""")
def expand_weighted(t):
    e = _edges(t)
    return graph.expand(e, _ranks(t, 2, e), t.derived(SEEDS), 2, 10).withColumn("weight", F.round("weight", 9))


@query("expand_weighted_30", _R30 + _khop("both")[len(_G):] + f""", m AS (SELECT src AS ms, dst AS md, max({_PRIOR}) AS p FROM (SELECT src, dst, edge_type FROM e UNION ALL SELECT dst, src, edge_type FROM e) GROUP BY ALL)
 SELECT seed, node, round(weight, 9) AS weight, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY (node = seed) DESC, round(weight, 9) DESC, node)::INT AS place FROM (SELECT seed, k.node, CASE WHEN k.node = seed THEN 0::DOUBLE ELSE coalesce(p * (1 + coalesce(rank, 0)), 0) END AS weight FROM k LEFT JOIN m ON seed = ms AND k.node = md LEFT JOIN r30 ON r30.node = k.node)) WHERE place <= 10""")
def expand_weighted_30(t):
    e = _edges(t)
    return graph.expand(e, _ranks(t, ITERATIONS, e), t.derived(SEEDS), 2, 10).withColumn("weight", F.round("weight", 9))


# Rectangles from the first four numbers of each embedding.
RECTS = "SELECT vec_id AS id, CAST({0} AS DOUBLE) * 100 AS x, CAST({1} AS DOUBLE) * 100 AS y, abs(CAST({2} AS DOUBLE)) * 10 AS w, abs(CAST({3} AS DOUBLE)) * 10 AS h FROM embeddings"
_R = RECTS.format(*[f"embedding[{k}]" for k in (1, 2, 3, 4)])


def _rects(t):
    return t.derived(RECTS.format(*[f"element_at(embedding, {k})" for k in (1, 2, 3, 4)]))


@query("world_coords", f"SELECT id, round(x * pow(2, greatest(id % 5, 1)), 6) AS u, round(ln(pow(2, greatest(id % 5, 1))), 6) AS v FROM ({_R})")
def world_coords(t):
    return spatial.world(_rects(t).withColumn("depth", F.col("id") % 5)).select("id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query("rect_overlap", f"WITH r AS ({_R}) SELECT a.id, b.id AS other FROM r a JOIN r b ON a.id < b.id AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h")
def rect_overlap(t):
    r = _rects(t)
    return spatial.overlapping(r, r.toDF("other", "x2", "y2", "w2", "h2")).filter("id < other")


@query("point_query", f"WITH r AS ({_R}), p AS (SELECT id AS point_id, x + w / 2 AS px, y + h / 2 AS py FROM r) SELECT point_id, id FROM p JOIN r ON px BETWEEN x AND x + w AND py BETWEEN y AND y + h")
def point_query(t):
    r = _rects(t)
    return spatial.containing(r, r.select(F.col("id").alias("point_id"), (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py")))


@query("knn", f"WITH r AS (SELECT id, x + w / 2 AS a, y + h / 2 AS b FROM ({_R})), d AS (SELECT r.id, o.id AS other, sqrt((r.a - o.a) ** 2 + (r.b - o.b) ** 2) AS distance FROM r JOIN r o ON r.id <> o.id) SELECT id, other, round(distance, 6) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), other)::INT AS place FROM d) WHERE place <= 4")
def knn(t):
    return spatial.nearest(_rects(t), 4).withColumn("distance", F.round("distance", 6))


# Replicated state: events are operations; a quarter of the users' events come from each replica.
LOG = "SELECT user_id AS elem, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, event_id AS stamp, event_id AS tag, concat('r', event_id % 4) AS replica, value FROM events"


@query("orset_elements", f"WITH l AS ({LOG}) SELECT DISTINCT elem FROM l a WHERE op = 'add' AND NOT EXISTS (SELECT 1 FROM l b WHERE b.elem = a.elem AND b.op = 'remove' AND b.stamp >= a.stamp)")
def orset_elements(t):
    log = t.derived(LOG)
    return crdt.orset_elements(log.filter("op = 'add'"), crdt.observed_removals(log))


@query("orset_merge", f"WITH l AS ({LOG}) SELECT DISTINCT elem FROM l a WHERE op = 'add' AND NOT EXISTS (SELECT 1 FROM l b WHERE b.elem = a.elem AND b.op = 'remove' AND b.replica = a.replica AND b.stamp >= a.stamp)")
def orset_merge(t):
    """Each replica removes what it saw itself; tags and removals are merged."""
    log = t.derived(LOG)
    own = [log.filter(F.col("replica") == f"r{k}") for k in range(4)]
    return crdt.orset_elements(crdt.merge_tags(*[r.filter("op = 'add'").select("elem", "tag") for r in own]), crdt.merge_tags(*[crdt.observed_removals(r) for r in own]))


@query("lww_merge", f"SELECT elem, round(arg_max(value, stamp), 6) AS value, max(stamp) AS stamp, arg_max(replica, stamp) AS replica FROM ({LOG}) GROUP BY elem")
def lww_merge(t):
    return crdt.lww(t.derived(LOG), "elem", "value").withColumn("value", F.round("value", 6))


@query("twopset_elements", f"WITH l AS ({LOG}) SELECT DISTINCT elem, replica FROM l WHERE op = 'add' EXCEPT SELECT elem, replica FROM l WHERE op = 'remove'")
def twopset_elements(t):
    log = t.derived(LOG)
    return crdt.two_phase(log.filter("op = 'add'").select("elem", "replica"), log.filter("op = 'remove'").select("elem", "replica"))


_CHANGES = "SELECT vec_id % 97 AS id, vec_id AS seq, vec_id % 5 = 0 AS gone, x, y, w, h FROM (SELECT vec_id, {0} AS x, {1} AS y, {2} AS w, {3} AS h FROM embeddings) c WHERE vec_id % 3 = 0"


def _changes(parts):
    return _CHANGES.format(*[f"CAST({p} AS DOUBLE)" for p in parts])


_CH = _changes([f"embedding[{k}]" for k in (1, 2, 3, 4)])


@query("rect_upsert", f"WITH r AS ({_R}), l AS (SELECT id, max(seq) AS seq FROM ({_CH}) GROUP BY id), c AS (SELECT c.* FROM ({_CH}) c JOIN l USING (id, seq)) SELECT id, x, y, w, h FROM r WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, x, y, w, h FROM c WHERE NOT gone")
def rect_upsert(t):
    return spatial.upsert(_rects(t), t.derived(_changes([f"element_at(embedding, {k})" for k in (1, 2, 3, 4)])))
