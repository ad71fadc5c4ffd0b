"""Selection phases over the ranked nodes, bundles and reports; metrics, verification and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.lineage import written
from ..operators import graph, metrics, rank, rank_v1, select, verify
from .rank_queries import _ANCHOR, CAP, ISSUES, LINKS, NODES, _nodes, _signals
from .registry import query
from .text_queries import _B, _CAMEL, _CLUSTER, _CM, _PLAIN, _STEM, SQL_FLINE, SQL_FPATH, _FRAMES1, _names, _pys, _quoted, sql_first, sql_numbered


def _limits(t):
    p = text.preset(F.col("text"))
    return t.derived(ISSUES).select("query_id", "text", p.alias("preset"), select.preset_value(p, 0).alias("most"), select.preset_value(p, 2).alias("hops"))


def _facts(t):
    places = written(select.ordered(rank.scored(_signals(t), CAP)).drop("low"))
    found = written(rank.anchors(places.drop("place")))
    return places, found, written(select.facts_of(places, found, _limits(t)))


def _edges(t):
    return written(t.derived(LINKS))


_PRE = "CASE WHEN regexp_matches(lower(text), 'traceback|crash|exception|error') THEN 'crash-fix' WHEN regexp_matches(lower(text), 'test|assert|failure') THEN 'test-fix' ELSE 'issue-fix' END"
_A = (
    _ANCHOR
    + f""", fx AS MATERIALIZED (SELECT *, CASE preset WHEN 'crash-fix' THEN 10 WHEN 'test-fix' THEN 7 ELSE 8 END AS most, CASE preset WHEN 'crash-fix' THEN 3 ELSE 2 END AS hops FROM (SELECT query_id, {_PRE} AS preset FROM q) JOIN (SELECT query_id, max(score) FILTER (place = 1) AS primary_, any_value(round(p1, 3)) AS confidence, any_value(p1 - p2 < 0.08::DOUBLE) AS low_margin FROM c GROUP BY query_id) USING (query_id)),
 a AS MATERIALIZED (SELECT query_id, node_id, place FROM c WHERE place = 1 OR (p1 - p2 < 0.08::DOUBLE AND place <= 3 AND p >= p1 - 0.12::DOUBLE)), sel0 AS MATERIALIZED (SELECT query_id, node_id, 'anchor' AS phase, place::INT AS ord FROM a JOIN fx USING (query_id) WHERE place <= most)"""
)


def _add(k, name, candidates, budget, order="place"):
    return f""", sel{k} AS MATERIALIZED (SELECT query_id, node_id, phase, ord FROM sel{k - 1} UNION ALL SELECT query_id, node_id, {name}, (n + have)::INT FROM (SELECT d.*, have, fx.most, fx.low_margin, fx.confidence, row_number() OVER (PARTITION BY d.query_id ORDER BY {order}) AS n FROM ({candidates}) d JOIN fx ON fx.query_id = d.query_id JOIN (SELECT query_id, count(*) AS have FROM sel{k - 1} GROUP BY query_id) h ON h.query_id = d.query_id
 WHERE NOT EXISTS (SELECT 1 FROM sel{k - 1} s WHERE s.query_id = d.query_id AND s.node_id = d.node_id)) WHERE n <= {budget} AND n + have <= most)"""


_GUARDS = _A
for _k, (_s, _t, _l, _p) in enumerate([("explicit_path", 0.5, 1, "explicit_path > 0"), ("mgmt_command", 0.5, 1, "mgmt_command > 0"), ("error_code", 0.5, 1, "error_code > 0"), ("upper_const", 0.5, 2, "upper_const > 0"), ("domain", 0.4, 1, "abs(domain) >= 0.4::DOUBLE AND greatest(stem, path_term, explicit_path, symbol_exact) > 0")], 1):
    _GUARDS += _add(_k, f"'guard:{_s}'", f"SELECT o.query_id, node_id, place FROM o JOIN fx f USING (query_id) WHERE place <= greatest(12, 4 * f.most) AND {_p} AND o.query_id NOT IN (SELECT query_id FROM o JOIN a USING (query_id, node_id) WHERE abs({_s}) >= {_t}::DOUBLE)", _l)
_BUDGET = "CASE WHEN low_margin OR have > 1 THEN most - have WHEN confidence >= 0.55::DOUBLE THEN least(2, most - have) WHEN confidence >= 0.4::DOUBLE THEN least(3, most - have) ELSE least(4, most - have) END"
_PENALTY = "CASE WHEN abs(domain) >= 0.4::DOUBLE OR lex > 1.5::DOUBLE OR term_idf > 1 OR greatest(explicit_path, path_term, stem, symbol_exact, mgmt_command, upper_const) > 0 THEN 1::DOUBLE WHEN kind = 'registry' THEN 0.65::DOUBLE WHEN kind = 'test' THEN 0.25::DOUBLE WHEN kind = 'migration' THEN 0.2::DOUBLE ELSE 1::DOUBLE END"
_PRIOR = "CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in graph.PRIORS.items()) + f" ELSE {graph.OTHER_PRIOR}::DOUBLE END"
_STEPS = f", le AS MATERIALIZED ({LINKS}), st AS MATERIALIZED (SELECT src, dst, max(p) AS p, first(edge_type ORDER BY p DESC, edge_type) AS via FROM (SELECT *, {_PRIOR} AS p FROM (SELECT src, dst, edge_type FROM le UNION ALL SELECT dst, src, edge_type FROM le)) GROUP BY src, dst)"


def _spread(tag, start, hops, limit=""):
    """The best weighted path of up to so many hops from the nodes of start."""
    out, rounds = f", {tag}0 AS MATERIALIZED (SELECT query_id, node_id, 1::DOUBLE AS w FROM {start})", []
    for h in range(1, hops + 1):
        out += f", {tag}{h} AS MATERIALIZED (SELECT query_id, dst AS node_id, max(x) AS w, first(via ORDER BY x DESC, via) AS via FROM (SELECT query_id, dst, w * p * {0.82 ** (h - 1)!r}::DOUBLE AS x, st.via FROM {tag}{h - 1} JOIN st ON node_id = src) y WHERE NOT EXISTS (SELECT 1 FROM {start} s WHERE s.query_id = y.query_id AND s.node_id = y.dst) GROUP BY query_id, dst)"
        rounds.append(f"SELECT query_id, node_id, w, via, {h} AS hop FROM {tag}{h}")
    return out + f", {tag} AS MATERIALIZED (SELECT query_id, node_id, max(w) AS w, first(hop ORDER BY w DESC, hop, via) AS hop, first(via ORDER BY w DESC, hop, via) AS via FROM ({' UNION ALL '.join(rounds)}) {limit} GROUP BY query_id, node_id)"


_CAP = "place <= greatest(6, most * CASE WHEN low_margin THEN 3 ELSE 2 END) + 1"
_UNTYPED = """, u0 AS (SELECT query_id, node_id, 0 AS hop FROM a WHERE query_id NOT IN (SELECT query_id FROM nb)), u1 AS (SELECT DISTINCT query_id, dst AS node_id, 1 AS hop FROM u0 JOIN st ON node_id = src), u2 AS (SELECT DISTINCT query_id, dst AS node_id, 2 AS hop FROM u1 JOIN st ON node_id = src), u3 AS (SELECT DISTINCT query_id, dst AS node_id, 3 AS hop FROM u2 JOIN st ON node_id = src),
 uu AS (SELECT query_id, node_id, min(hop) AS hop FROM (FROM u0 UNION ALL FROM u1 UNION ALL FROM u2 UNION ALL FROM u3) GROUP BY ALL)"""
_NEAR = (
    _GUARDS + _STEPS + _spread("nb", "a", 3, "JOIN fx USING (query_id) WHERE hop <= hops") + f", na AS MATERIALIZED (SELECT o.*, nb.w * {_PENALTY} AS adjusted, nb.via, nb.hop, fx.most AS m FROM nb JOIN o USING (query_id, node_id) JOIN fx USING (query_id) WHERE {_CAP} OR nb.w * {_PENALTY} >= 0.12::DOUBLE)"
    + _add(6, "'typed:' || via || ':' || hop", "SELECT query_id, node_id, place, adjusted, via, hop FROM na", _BUDGET, "round(adjusted, 12) DESC, place") + _UNTYPED
    + _add(7, "'radius'", f"SELECT o.query_id, o.node_id, place FROM uu JOIN o USING (query_id, node_id) JOIN fx USING (query_id) WHERE uu.hop <= hops AND ({_CAP} OR score > 0)", _BUDGET)
)
_SEL = "(SELECT o.query_id, o.cluster FROM o JOIN {} USING (query_id, node_id))"


def _floor(low, high):
    return f"CASE WHEN primary_ > 0 THEN primary_ * CASE WHEN fx.low_margin THEN {low}::DOUBLE ELSE {high}::DOUBLE END ELSE 0 END"


def _rest(base, k):
    """The phases that follow no edge, from the k-th selection on."""
    out = base + _add(k + 1, "'sibling'", f"SELECT o.query_id, node_id, place FROM o JOIN fx USING (query_id) WHERE (o.query_id, cluster) IN {_SEL.format(f'sel{k}')} AND score >= {_floor(0.25, 0.35)} AND place <= greatest(16, 5 * fx.most) + 1", "CASE WHEN low_margin OR confidence < 0.3::DOUBLE THEN 3 ELSE 2 END")
    out += _add(k + 2, "'init'", f"SELECT query_id, node_id, place FROM o WHERE split_part(path, '/', -1) = '__init__.py' AND score > 0 AND (query_id, cluster) IN {_SEL.format(f'sel{k + 1}')}", "most")
    above = f"(SELECT o.query_id, regexp_replace(o.cluster, '/[^/]*$', '') FROM o JOIN sel{k + 2} USING (query_id, node_id) WHERE contains(o.cluster, '/'))"
    return out + _add(k + 3, "'parent'", f"SELECT o.query_id, node_id, place FROM o JOIN fx USING (query_id) WHERE (o.query_id, cluster) IN {above} AND score >= {_floor(0.2, 0.3)} AND place <= greatest(20, 6 * fx.most) + 1", "most")


_ALL = _rest(_NEAR, 7)
_FILLED = _ALL + _spread("gf", "sel10", 2) + _add(11, "'fill:' || via || ':' || hop", "SELECT o.query_id, o.node_id, place, via, hop FROM gf JOIN o USING (query_id, node_id) JOIN fx USING (query_id) WHERE place <= greatest(15, 5 * fx.most) + 1", "most")


@query("guards", f"{_GUARDS} SELECT * FROM sel5")
def guards(t):
    return select.guards(*_facts(t))


@query("neighbor_phase", f"{_NEAR} SELECT * FROM sel7")
def neighbor_phase(t):
    places, found, facts = _facts(t)
    return select.typed_neighbors(places, select.guards(places, found, facts), found, facts, _edges(t))


@query("sibling_phase", f"{_rest(_GUARDS, 5)} SELECT * FROM sel6")
def sibling_phase(t):
    places, found, facts = _facts(t)
    return select.siblings(places, select.guards(places, found, facts), facts)


@query("blast_v2_nodes", f"{_rest(_GUARDS, 5)} SELECT * FROM sel8")
def blast_v2_nodes(t):
    return select.bundle(*_facts(t))


@query("graph_fill", f"{_ALL + _spread('gf', 'sel10', 2)} SELECT query_id, node_id, round(w, 9) AS weight, hop::INT AS hop, via FROM gf")
def graph_fill(t):
    """What the last phase chooses from."""
    places, found, facts = _facts(t)
    edges = _edges(t)
    chosen = select.typed_neighbors(places, select.guards(places, found, facts), found, facts, edges)
    for phase in (select.siblings, select.package_markers, select.parents):
        chosen = phase(places, chosen, facts)
    near = graph.best_path(graph.propagate_from(edges, chosen.select(F.col("query_id").alias("seed"), F.col("node_id").alias("node")), 2))
    return near.select(F.col("seed").alias("query_id"), F.col("node").alias("node_id"), F.round("weight", 9).alias("weight"), "hop", "via")


@query("blast_bundle", f"{_FILLED} SELECT * FROM sel11")
def blast_bundle(t):
    places, found, facts = _facts(t)
    return select.bundle(places, found, facts, _edges(t))


_SUMMARY = f"""{_FILLED}, ow AS (SELECT sel11.*, path FROM sel11 JOIN o USING (query_id, node_id)), al AS (SELECT query_id, count(*) AS n, count(DISTINCT path) AS f FROM o GROUP BY query_id)
 SELECT query_id, preset, arg_min(node_id, ord) AS anchor, arg_min(path, ord) AS anchor_file, any_value(confidence) AS confidence, count(*)::BIGINT AS nodes, count(DISTINCT path) FILTER (node_id % 6 > 0)::BIGINT AS files, (any_value(al.n) - count(*))::BIGINT AS omitted_nodes, (any_value(al.f) - count(DISTINCT path) FILTER (node_id % 6 > 0))::BIGINT AS omitted_files, any_value(low_margin)::INT::BIGINT AS warnings, any_value(greatest(1, length(text) // 4))::BIGINT AS token_estimate
 FROM ow JOIN al USING (query_id) JOIN fx USING (query_id) JOIN q USING (query_id) GROUP BY query_id, preset"""


@query("bundle_summary", _SUMMARY)
def bundle_summary(t):
    """Every sixth file isn't there."""
    places, found, facts = _facts(t)
    chosen = select.bundle(places, found, facts, _edges(t))
    # A path that several nodes share is there if one of them is.
    files = _nodes(t).filter("node_id % 6 > 0").join(_nodes(t).filter("node_id % 6 = 0").select("path"), "path", "left_anti").select("path")
    out = select.summary(places, chosen, found, _limits(t), files, CAP)
    return out.select("query_id", "preset", "anchor", "anchor_file", "confidence", F.size("nodes").cast("long").alias("nodes"), F.size("files").cast("long").alias("files"), "omitted_nodes", "omitted_files", F.size("warnings").cast("long").alias("warnings"), "token_estimate")


_REASONS = [("explicit_path", "explicit-path=%.1f", 1), ("symbol_exact", "symbol-exact=%.1f", 1), ("dunder", "dunder=%.1f", 1), ("domain", "domain=%+.2f", 0), ("error_code", "error-code=%.1f", 1), ("upper_const", "upper-const=%.1f", 1), ("mgmt_command", "mgmt-cmd=%.1f", 1)]


@query("reasons", f"""{_ANCHOR} SELECT query_id, node_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {k} {'> 0' if p else '<> 0'} THEN printf('{f}', {k}) END" for k, f, p in _REASONS)}, CASE WHEN trace > 0 THEN 'trace-overlap' END, CASE WHEN sym >= 0.85::DOUBLE THEN 'symbol-match' END, CASE WHEN lex > 0 THEN 'bm25-lex' END, CASE WHEN reg > 0 THEN 'registry-prior' END, CASE WHEN cent > 0 THEN printf('pagerank=%.4f', least(pr, {CAP}::DOUBLE)) END, 'cluster-idf(size=' || greatest(1, cluster_size) || ')', CASE WHEN calls > 0 THEN 'call-target(' || calls || ')' END, CASE WHEN inherits > 0 THEN 'inherit-target(' || inherits || ')' END,
 CASE WHEN term_idf > 0 THEN printf('term-idf=%.2f', term_idf) END, CASE WHEN tg THEN 'test-penalty' END, CASE WHEN mg THEN 'migration-penalty' END, CASE WHEN stem > 0 THEN 'stem-in-text' END, CASE WHEN path_term > 0 THEN 'path-term' END], lambda r: r IS NOT NULL), ', ') AS reasons FROM z""")
def reasons(t):
    return rank.scored(_signals(t), CAP).select("query_id", "node_id", F.array_join(rank.reasons(CAP), ", ").alias("reasons"))


# The first generation: the same nodes and issues; symbols of files as syntax would give them.
_SPANS = "{0}(lower(concat('Field', node_id % 20)), lower(concat('Field', node_id % 20, '.save_to')), 'save_to', concat('run_', node_id % 11))"


def _old(t):
    nodes = t.derived(f"SELECT node_id, path, line_start, line_end, CASE WHEN node_id % 6 > 0 THEN {_SPANS.format('array')} END AS spans, concat('Root.', replace(path, '/', '.')) AS ns_path, CASE WHEN node_id % 19 = 0 THEN 'config' ELSE 'code' END AS node_type FROM ({NODES.format('array')})")
    return nodes.withColumn("name", F.when(F.col("node_id") % 5 == 0, F.concat(F.lit("run_"), (F.col("node_id") % 11).cast("string"))).otherwise(F.concat(F.lit("Mod"), (F.col("node_id") % 50).cast("string"))))


_OLD = rf"""WITH qs AS (SELECT * FROM ({ISSUES})), sc AS (SELECT query_id, text, regexp_extract_all(text, '(?s)```(.*?)```', 1) AS b, regexp_replace(text, '(?s)```.*?```', ' ', 'g') AS s FROM qs),
 qq AS MATERIALIZED (SELECT query_id, lower(text) AS low, list_transform({sql_first('c')}, lambda x: lower(x)) AS lows, words FROM (SELECT *, list_concat(list_concat(flatten(list_transform(b, lambda x: list_concat({_pys('x')}, {_names('x')}))), {_quoted('s')}), list_concat({_pys('s')}, {_names('s')})) AS c, list_distinct(list_filter(regexp_extract_all(lower(s), '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda w: w NOT IN ({_PLAIN}))) AS words FROM sc)),
 ff AS MATERIALIZED (SELECT query_id, lower(path) AS fp, line, lower(symbol) AS fs, min(i) AS i FROM (SELECT query_id, f.i, {SQL_FPATH} AS path, {SQL_FLINE} AS line, CASE WHEN starts_with(f.x, 'File "') THEN regexp_extract(f.x, ', in ([A-Za-z_][A-Za-z0-9_.]*)$', 1) ELSE '' END AS symbol FROM (SELECT query_id, unnest({sql_numbered(_FRAMES1)}) AS f FROM qs)) GROUP BY ALL),
 nn AS MATERIALIZED (SELECT *, lower(path) AS p, lower({_B}) AS bs, lower({_STEM}) AS sm, lower(nm) AS n, lower('Root.' || replace(path, '/', '.')) AS ns FROM (SELECT *, CASE WHEN node_id % 6 > 0 THEN {_SPANS.format('list_value')} END AS spans, CASE WHEN node_id % 5 = 0 THEN 'run_' || (node_id % 11) ELSE 'Mod' || (node_id % 50) END AS nm, node_id % 19 = 0 AS cf FROM ({NODES.format('list_value')}))),
 fm AS (SELECT query_id, node_id, sum(ms + CASE WHEN ms > 0 AND line BETWEEN line_start AND line_end THEN 24 ELSE 0 END + CASE WHEN fs <> '' AND (fs = n OR ends_with(fs, '.' || n) OR ends_with(n, '.' || fs)) THEN 10 ELSE 0 END) AS v, sum(CASE WHEN fs = '' OR spans IS NULL THEN 0 WHEN list_contains(spans, fs) THEN 20 WHEN list_contains(spans, split_part(fs, '.', -1)) THEN 12 ELSE 0 END) AS sv
  FROM (SELECT *, CASE WHEN ends_with(p, fp) OR ends_with(fp, p) THEN 18 WHEN bs = split_part(fp, '/', -1) THEN 12 WHEN sm = regexp_replace(split_part(fp, '/', -1), '(.)\.[^.]*$', '\1') THEN 8 ELSE 0 END AS ms FROM ff CROSS JOIN nn) GROUP BY ALL),
 tm AS (SELECT query_id, node_id, sum(CASE WHEN ends_with(t, '.py') AND split_part(t, '/', -1) = bs THEN 12 ELSE 0 END + CASE WHEN contains(t, '/') AND (ends_with(p, t) OR bs = split_part(t, '/', -1)) THEN 12 ELSE 0 END + CASE WHEN t = n OR ends_with(t, '.' || n) THEN 10 ELSE 0 END + CASE WHEN tl = n THEN 6 ELSE 0 END + CASE WHEN contains(p, tl) THEN 6 ELSE 0 END) AS v,
  sum(CASE WHEN spans IS NULL OR NOT contains(t, '.') OR ends_with(t, '.py') THEN 0 WHEN list_contains(spans, t) THEN 30 WHEN list_contains(spans, tl) THEN 20 ELSE 0 END) AS sv, bool_or(contains(t, '.') AND NOT ends_with(t, '.py')) AS any_ FROM (SELECT query_id, t, split_part(t, '.', -1) AS tl FROM (SELECT query_id, unnest(lows) AS t FROM qq)) CROSS JOIN nn GROUP BY ALL),
 km AS (SELECT query_id, node_id, sum(3 * contains(n, w)::INT + 3 * contains(p, w)::INT + contains(ns, w)::INT) AS v FROM (SELECT query_id, unnest(words) AS w FROM qq) CROSS JOIN nn GROUP BY ALL),
 v0 AS (SELECT query_id, node_id, path, low, p, CASE WHEN list_has_any(words, [{','.join(repr(w) for w in rank_v1.SETTINGS)}]) AND (bs IN ('settings.py', 'global_settings.py', '__init__.py', 'config.py') OR contains(p, 'conf/') OR cf) THEN 50 ELSE 0 END + 8 * contains(low, sm)::INT + 8 * contains(low, bs)::INT + 8 * contains(low, n)::INT + coalesce(fm.v, 0) + CASE WHEN coalesce(any_, false) THEN coalesce(fm.sv, 0) ELSE 0 END + coalesce(tm.v, 0) + coalesce(tm.sv, 0) + coalesce(km.v, 0) AS s
  FROM qq CROSS JOIN nn LEFT JOIN fm USING (query_id, node_id) LEFT JOIN tm USING (query_id, node_id) LEFT JOIN km USING (query_id, node_id)),
 v1 AS MATERIALIZED (SELECT query_id, node_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::INT AS place FROM (SELECT *, CASE WHEN s > 0 AND contains(p, 'tests/') AND NOT regexp_matches(low, 'testcase|test_runner|runtests|pytest|unittest|test suite|test framework') THEN greatest(0, s - 40) ELSE s END::BIGINT AS score FROM v0) WHERE score > 0)"""


def _old_found(t):
    return written(rank_v1.scores(_old(t), t.derived(ISSUES)))


@query("v1_score", f"{_OLD} SELECT query_id, node_id, score FROM v1")
def v1_score(t):
    return _old_found(t).select("query_id", "node_id", "score")


_REACH = f""", le AS MATERIALIZED ({LINKS}), bo AS (SELECT src, dst FROM le UNION SELECT dst, src FROM le), lm AS (SELECT query_id, CASE WHEN {_PRE} = 'crash-fix' THEN 10 WHEN {_PRE} = 'test-fix' THEN 7 ELSE 8 END AS most, CASE WHEN {_PRE} = 'crash-fix' THEN 3 ELSE 2 END AS hops FROM qs), an AS MATERIALIZED (SELECT query_id, node_id, path, round(score / greatest(score + coalesce((SELECT score FROM v1 w WHERE w.query_id = v1.query_id AND w.place = 2), 0), 1)::DOUBLE, 2) AS confidence FROM v1 WHERE place = 1),
 w1 AS (SELECT query_id, dst AS node_id, 1 AS hop FROM an JOIN bo ON node_id = src), w2 AS (SELECT DISTINCT query_id, dst AS node_id, 2 AS hop FROM w1 JOIN bo ON node_id = src), w3 AS (SELECT DISTINCT query_id, dst AS node_id, 3 AS hop FROM w2 JOIN bo ON node_id = src), ww AS MATERIALIZED (SELECT query_id, node_id, min(hop) AS hop FROM (SELECT query_id, node_id, 0 AS hop FROM an UNION ALL FROM w1 UNION ALL FROM w2 UNION ALL FROM w3) GROUP BY ALL),
 k1 AS MATERIALIZED (SELECT * FROM (SELECT ww.query_id, ww.node_id, nn.path, coalesce(score, 0)::BIGINT AS score, most, row_number() OVER (PARTITION BY ww.query_id ORDER BY ww.node_id <> an.node_id, nn.path <> an.path, coalesce(score, 0) DESC, ww.node_id)::INT AS ord FROM ww JOIN lm USING (query_id) JOIN an USING (query_id) JOIN nn ON nn.node_id = ww.node_id LEFT JOIN v1 ON v1.query_id = ww.query_id AND v1.node_id = ww.node_id WHERE hop <= hops) WHERE ord <= most),
 k2 AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS n FROM v1 WHERE score >= 5 AND {_B} <> '__init__.py' AND NOT contains(path, 'tests/') AND (query_id, {_CLUSTER}) IN (SELECT query_id, {_CLUSTER} FROM k1) AND (query_id, node_id) NOT IN (SELECT query_id, node_id FROM k1))"""


@query("v1_bundle", f"{_OLD}{_REACH} SELECT query_id, k1.node_id, CASE WHEN k1.node_id = an.node_id THEN 'anchor' ELSE 'neighbor' END AS phase, ord, score, confidence FROM k1 JOIN an USING (query_id) UNION ALL SELECT query_id, k2.node_id, 'sibling', (n + (SELECT count(*) FROM k1 WHERE k1.query_id = k2.query_id))::INT, score, confidence FROM k2 JOIN an USING (query_id) WHERE n <= 2")
def v1_bundle(t):
    return rank_v1.bundle(_old(t), _old_found(t), _edges(t), _limits(t))


_ROLE = rf"""{_OLD}, le AS ({LINKS}), an AS (SELECT query_id, node_id FROM v1 WHERE place = 1), rl AS (SELECT query_id, node_id, min(k) AS k FROM (SELECT query_id, node_id, 1 AS k FROM an UNION ALL SELECT query_id, dst, 2 FROM an JOIN le ON node_id = src UNION ALL SELECT query_id, src, 3 FROM an JOIN le ON node_id = dst UNION ALL SELECT query_id, node_id, 4 FROM v1) GROUP BY ALL),
 fl AS (SELECT query_id, node_id, arg_min(line, i) AS line FROM (SELECT query_id, node_id, line, i FROM (SELECT * FROM ff JOIN nn ON ends_with(p, fp) OR ends_with(fp, p) OR bs = split_part(fp, '/', -1) OR sm = regexp_replace(split_part(fp, '/', -1), '(.)\.[^.]*$', '\1')) WHERE line BETWEEN line_start AND line_end) GROUP BY ALL)
 SELECT query_id, ['ground_zero', 'direct_import', 'direct_dependent', 'structural_neighbor'][k] AS role, node_id, path, line, score, ord FROM (SELECT rl.query_id, k, rl.node_id, nn.path, coalesce(fl.line, nn.line_start)::BIGINT AS line, coalesce(score, 0)::BIGINT AS score, row_number() OVER (PARTITION BY rl.query_id ORDER BY k, coalesce(score, 0) DESC, rl.node_id)::INT AS ord FROM rl JOIN nn ON nn.node_id = rl.node_id LEFT JOIN v1 ON v1.query_id = rl.query_id AND v1.node_id = rl.node_id LEFT JOIN fl ON fl.query_id = rl.query_id AND fl.node_id = rl.node_id) WHERE ord <= 6"""


@query("anchor_report", _ROLE)
def anchor_report(t):
    return rank_v1.report(_old(t), _old_found(t), _edges(t), t.derived(ISSUES))


CASES = """SELECT item_id AS case_id, CASE WHEN item_id % 11 = 0 THEN {0}() ELSE {0}(concat('src/a', item_id % 7, '.py'), concat('/src/b', item_id % 5, '.py'), concat('x', chr(92), 'c', item_id % 3, '.py'), 'd.py') END AS predicted, CASE WHEN item_id % 9 = 0 THEN {0}() ELSE {0}(concat('b', item_id % 4, '.py'), concat('c', item_id % 2, '.py'), concat('lib/d', CASE WHEN item_id % 6 = 0 THEN '' ELSE 'x' END, '.py')) END AS gold FROM benchmark"""
_CASES = r"WITH c AS (SELECT case_id, list_transform(predicted, lambda p: trim(replace(p, '\', '/'), '/')) AS p, gold AS g FROM (" + CASES.format("list_value") + ")), "


def _cases(t):
    return t.derived(CASES.format("array"))


@query("nav_metrics", _CASES + """m AS (SELECT case_id, len(p) = 0 OR len(g) = 0 AS none, len(p) AS n, coalesce(list_position(list_transform(p, lambda x: len(list_filter(g, lambda y: ends_with(x, y))) > 0), true), 0) AS k FROM c)
 SELECT case_id, NOT none AND k > 0 AS hit, NOT none AND k = 1 AS hit1, CASE WHEN none THEN 'inf'::DOUBLE WHEN k > 0 THEN k - 1 ELSE n END::DOUBLE AS rot FROM m""")
def nav_metrics(t):
    return metrics.navigation(_cases(t))


@query("trace_hits", _CASES + "m AS (SELECT case_id, list_transform(p, lambda x: len(list_filter(g, lambda y: ends_with(x, y) OR ends_with(y, x))) > 0) AS m FROM c) SELECT case_id, list_contains(m, true) AS hit, coalesce(m[1], false) AS hit1, list_contains(m[:3], true) AS hit3 FROM m")
def trace_hits(t):
    return metrics.trace_hits(_cases(t))


@query("test_commands", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'echo "NO_TESTS_SPECIFIED"' WHEN 1 THEN 'python -m pytest -xvs "t/a.py::T::m' || page_id || '" || RESULT=1' WHEN 2 THEN 'python -m django test app.T --settings=tests.test_settings -v 2 2>/dev/null || python tests/runtests.py app.T.m' || page_id || ' -v 2 || RESULT=1'
 ELSE 'python tests/runtests.py all -v 2 || RESULT=1' || chr(10) || 'python -m pytest -xvs "x::y" || RESULT=1' END AS commands FROM pages""")
def test_commands(t):
    tests = t.derived("SELECT page_id, CASE page_id % 4 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array(concat('t/a.py::T::m', page_id)) WHEN 2 THEN array(concat('app.T.m', page_id)) ELSE array('all', 'x::y') END AS tests FROM pages")
    return tests.select("page_id", metrics.test_commands(F.col("tests")).alias("commands"))


RUNS = "SELECT doc_id AS case_id, quality = 1 AS hit, quality = 1 AND toxic = 0 AS hit1, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 6 END AS rot, (doc_id % 5) * 700 AS tokens, 129652 AS control, CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS error FROM labels"


@query("bench_summary", f"SELECT *, round(1 - t / c, 6) AS reduction FROM (SELECT count(*)::BIGINT AS total, count(*) FILTER (error IS NULL)::BIGINT AS completed, round(avg(hit::INT) FILTER (error IS NULL), 6) AS hit_rate, round(avg(hit1::INT) FILTER (error IS NULL), 6) AS hit1_rate, round(avg(rot) FILTER (error IS NULL), 6) AS rot, avg(tokens) FILTER (error IS NULL AND tokens > 0) AS t, avg(control) FILTER (error IS NULL AND control > 0) AS c FROM ({RUNS}))".replace("SELECT *, round(1 - t / c, 6)", "SELECT total, completed, hit_rate, hit1_rate, rot, round(t, 6) AS tokens, round(c, 6) AS control, round(1 - t / c, 6)"))
def bench_summary(t):
    out = metrics.summary(t.derived(RUNS))
    return out.select("total", "completed", *[F.round(c, 6).alias(c) for c in ("hit_rate", "hit1_rate", "rot", "tokens", "control", "reduction")])


CALLS = "SELECT user_id AS case_id, CASE WHEN user_id % 6 = 0 THEN 'blast' WHEN user_id % 6 = 1 AND event_type = 'click' THEN 'rg' WHEN user_id % 6 = 1 THEN 'blast' WHEN user_id % 6 = 2 AND event_type = 'view' THEN 'locate' WHEN user_id % 6 = 2 THEN 'blast' WHEN user_id % 6 = 3 THEN 'expand' WHEN event_type = 'click' THEN 'blast' WHEN event_type = 'view' THEN 'locate' WHEN event_type = 'signup' THEN 'expand' ELSE 'rg' END AS tool, event_id % 3 > 0 AS success, event_id % 500 AS tokens FROM events"


_COUNTS = ", ".join(f"count(*) FILTER (tool = '{t}')::BIGINT AS {t}" for t in metrics.TOOLS)
_MODES = f"WITH u AS (SELECT case_id, coalesce(list(DISTINCT tool) FILTER (success), []) AS used, count(*)::BIGINT AS n_calls, sum(tokens)::BIGINT AS tokens, {_COUNTS} FROM ({CALLS}) GROUP BY case_id), md AS (SELECT case_id, CASE WHEN used = ['blast'] THEN 'blast_only' WHEN list_contains(used, 'rg') AND NOT list_has_any(used, ['locate', 'expand']) THEN 'blast+rg' WHEN list_contains(used, 'locate') AND NOT list_contains(used, 'rg') THEN 'blast+locate' WHEN len(used) > 2 THEN 'multi_tool' ELSE 'unknown' END AS mode, n_calls, tokens, {', '.join(metrics.TOOLS)} FROM u)"


@query("solve_mode", f"{_MODES} SELECT * FROM md")
def solve_mode(t):
    return metrics.solve_modes(t.derived(CALLS))


def _runs(t):
    """What the tool calls came to; hits and errors by the case's number."""
    return metrics.solve_modes(t.derived(CALLS)).withColumnRenamed("n_calls", "calls").withColumns({"hit": F.col("case_id") % 2 == 0, "hit1": F.col("case_id") % 6 == 0, "hit3": F.col("case_id") % 4 == 0, "error": F.when(F.col("case_id") % 7 == 0, "timeout")})


_RUN = f"{_MODES}, rn AS (SELECT *, n_calls AS calls, case_id % 2 = 0 AS hit, case_id % 6 = 0 AS hit1, case_id % 4 = 0 AS hit3 FROM md WHERE case_id % 7 <> 0)"


@query("comparison", f"{_RUN} SELECT (SELECT count(*) FROM md)::BIGINT AS total, count(*)::BIGINT AS completed, round(avg(hit1::INT), 6) AS hit1_rate, round(avg(hit3::INT), 6) AS hit3_rate, round(avg(hit::INT), 6) AS hit_rate, round(avg(tokens), 6) AS tokens, round(avg(calls), 6) AS calls, round(avg((mode = 'blast_only')::INT), 6) AS blast_only_rate, round(avg(contains(mode, 'rg')::INT), 6) AS rg_rate, round(avg(contains(mode, 'locate')::INT), 6) AS locate_rate, round(50000 / avg(tokens), 6) AS compression FROM rn")
def comparison(t):
    out = metrics.comparison(_runs(t))
    return out.select("total", "completed", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("total", "completed")])


@query("mode_distribution", f"{_RUN} SELECT mode, count(*)::BIGINT AS cases, round(count(*) / (SELECT count(*) FROM rn)::DOUBLE, 6) AS share, round(avg(hit::INT), 6) AS hit_rate FROM rn GROUP BY mode")
def mode_distribution(t):
    return metrics.distribution(_runs(t), "mode").select("mode", "cases", F.round("share", 6).alias("share"), F.round("hit_rate", 6).alias("hit_rate"))


_KNOWN = "SELECT 'mini' AS name, 1 AS ord, CAST(0.35 AS DOUBLE) AS rate UNION ALL SELECT 'a/mini', 2, CAST(0.30 AS DOUBLE) UNION ALL SELECT 'b/large', 3, CAST(0.40 AS DOUBLE)"
_MODELS = "SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN 'mini' WHEN 1 THEN 'a/mini' WHEN 2 THEN 'large' WHEN 3 THEN concat('x/b/large') ELSE concat('other', page_id % 10) END AS model FROM pages"


@query("baseline_lookup", f"WITH k AS ({_KNOWN}), m AS ({_MODELS}) SELECT model, arg_min(name, (model <> name)::INT * 10 + ord) AS name, arg_min(rate, (model <> name)::INT * 10 + ord) AS rate FROM m LEFT JOIN k ON ends_with(model, name) OR ends_with(name, model) GROUP BY model")
def baseline_lookup(t):
    return metrics.baselines(t.derived(_MODELS), t.spark.sql(_KNOWN))


@query("summary_table", f"WITH s AS (SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS completed FROM ({RUNS})) SELECT 0 AS ord, '| Metric | Value |' AS line UNION ALL SELECT 1, '|---|---:|' UNION ALL SELECT 2, '| Cases | ' || total || ' |' FROM s UNION ALL SELECT 3, '| Completed | ' || completed || ' |' FROM s")
def summary_table(t):
    """The first rows; the others' numbers are those of bench_summary."""
    return metrics.table_of(metrics.summary(t.derived(RUNS))).filter("ord < 4")


@query("control_tokens", "SELECT doc_id, least(80000 + 5 * length(text), 200000)::BIGINT AS tokens FROM documents")
def control_tokens(t):
    return t("documents").select("doc_id", metrics.control_tokens(F.col("text")).alias("tokens"))


@query("resume_filter", f"SELECT doc_id AS case_id FROM documents WHERE doc_id NOT IN (SELECT case_id FROM ({RUNS}) WHERE error IS NULL)")
def resume_filter(t):
    return metrics.pending(t("documents").select(F.col("doc_id").alias("case_id")), t.derived(RUNS))


@query("confidence_tiers", f"SELECT tier, count(*)::BIGINT AS cases, round(avg(hit::INT), 6) AS hit_rate FROM (SELECT *, CASE WHEN coalesce(rot, 9) < 2 THEN 'HIGH' WHEN coalesce(rot, 9) < 4 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM ({RUNS})) GROUP BY tier")
def confidence_tiers(t):
    rot = F.coalesce("rot", F.lit(9))
    tier = F.when(rot < 2, "HIGH").when(rot < 4, "MEDIUM").otherwise("LOW")
    return t.derived(RUNS).groupBy(tier.alias("tier")).agg(F.count("*").alias("cases"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"))


# Nodes with paths, edges declared between their names, imports by modules; every eleventh file isn't there, every seventh is elsewhere.
_VN = "SELECT p_partkey AS ord, concat('World.P', p_partkey) AS fqn, concat('P', p_partkey) AS name, CASE WHEN p_partkey % 13 > 0 THEN concat('pkg', p_partkey % 9, '/m', p_partkey, '.py') END AS src_path FROM part"
_VF = "SELECT concat('root/', CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE concat('pkg', p_partkey % 9) END, '/m', p_partkey, '.py') AS path FROM part WHERE p_partkey % 11 > 0"
_VD = "SELECT concat('P', p_partkey) AS src, concat('P', p_partkey + 1) AS dst FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT concat('P', p_partkey), concat('P', p_partkey * 2) FROM part"
_VI = "SELECT concat('root/', CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE concat('pkg', p_partkey % 9) END, '/m', p_partkey, '.py') AS path, concat('pkg', (p_partkey + 1) % 9, '.m', p_partkey + 1, CASE WHEN p_partkey % 2 = 0 THEN '.Thing' ELSE '' END) AS mod FROM part UNION ALL SELECT concat('root/', CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE concat('pkg', p_partkey % 9) END, '/m', p_partkey, '.py'), concat('other.m', p_partkey * 2) FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT concat('root/pkg', p_partkey % 9, '/m', p_partkey, '.py'), 'os.path' FROM part"
_V = f"""WITH n AS MATERIALIZED ({_VN}), f AS ({_VF}), i AS ({_VI}), d AS (SELECT DISTINCT * FROM ({_VD})),
 rf AS MATERIALIZED (SELECT fqn, name, src_path, arg_min(path, CASE WHEN ends_with(path, src_path) THEN 'a' ELSE 'b' END || path) AS file FROM n LEFT JOIN f ON split_part(f.path, '/', -1) = split_part(n.src_path, '/', -1) GROUP BY ALL),
 md AS (SELECT mod, k.x AS c, k.i AS k FROM (SELECT mod, unnest({sql_numbered("list_concat(list_transform(range(len(ps), 0, -1), lambda j: array_to_string(ps[:j], '/') || '.py'), [ps[-1] || '.py'])")}) AS k FROM (SELECT mod, string_split(mod, '.') AS ps FROM (SELECT DISTINCT mod FROM i)))),
 mn AS MATERIALIZED (SELECT mod, arg_min(name, k * 1000000 + ord) AS name FROM md JOIN n ON split_part(c, '/', -1) = split_part(src_path, '/', -1) AND (src_path = c OR ends_with(src_path, '/' || c) OR ends_with(c, '/' || src_path)) GROUP BY mod),
 r AS MATERIALIZED (SELECT DISTINCT rf.fqn, mn.name AS dst FROM rf JOIN i ON i.path = rf.file JOIN mn USING (mod) WHERE mn.name <> rf.name), s AS (SELECT rf.fqn, d.dst FROM rf JOIN d ON d.src = rf.name WHERE file IS NOT NULL),
 v AS (SELECT 'missing' AS kind, fqn AS src, dst FROM (FROM r EXCEPT FROM s) UNION ALL SELECT 'ghost', fqn, dst FROM (FROM s EXCEPT FROM r) WHERE dst IN (SELECT name FROM n WHERE src_path IS NOT NULL) UNION ALL SELECT 'unresolved', fqn, src_path FROM rf WHERE src_path IS NOT NULL AND file IS NULL)"""


def _verified(t):
    return verify.verify(t.derived(_VN), t.derived(_VD), t.derived(_VI), t.derived(_VF))


for _kind in ("missing", "ghost", "unresolved"):

    @query(f"verify_{_kind}", f"{_V} SELECT kind, src, dst FROM v WHERE kind = '{_kind}'")
    def verified(t, kind=_kind):
        return _verified(t).filter(F.col("kind") == kind)


@query("verify_report", f"{_V} SELECT kind, count(*)::BIGINT AS n, kind <> 'unresolved' AS failed FROM v GROUP BY kind")
def verify_report(t):
    return verify.report(_verified(t))


@query("unique_match", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n, CASE WHEN length(text) - length(replace(text, 'the', '')) = 3 THEN replace(text, 'the', 'THE') END AS edited FROM documents")
def unique_match(t):
    text = F.col("text")
    return t("documents").select("doc_id", verify.occurrences(text, F.lit("the")).alias("n"), verify.replace_unique(text, F.lit("the"), F.lit("THE")).alias("edited"))
