"""Ranking: BM25 of documents for benchmark texts, and all signals of source paths for marked-up issues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import rank
from .registry import query
from .text_queries import _B, _CAMEL, _CLUSTER, _CM, _KIND, _STEM, SQL_CODE, SQL_CODES, SQL_CONSTS, SQL_DUNDERS, SQL_EXPLICIT, SQL_FLINE, SQL_FPATH, SQL_FRAMES2, SQL_TOKENS, SQL_VERBS, sql_first, sql_numbered

_TOK = SQL_TOKENS


def _bm25(docs: str, queries: str) -> str:
    """CTEs up to bm (query_id, doc_id, score)."""
    return f"""bd AS (SELECT doc_id, len(terms) AS dl, terms FROM ({docs})), bt AS (SELECT count(*) AS n, greatest(avg(dl), 1) AS a FROM bd), bq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM ({queries})) GROUP BY ALL),
 bp AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(terms) AS term FROM bd) GROUP BY ALL), bf AS (SELECT term, count(*) AS df FROM bp GROUP BY ALL),
 bm AS (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score FROM bp JOIN bf USING (term) JOIN bq USING (term) CROSS JOIN bt GROUP BY ALL)"""


_DOCS, _QS = f"SELECT doc_id, {_TOK.format('text')} AS terms FROM documents", f"SELECT item_id AS query_id, {_TOK.format('text')} AS terms FROM benchmark"


@query("bm25_topk", f"WITH {_bm25(_DOCS, _QS)} SELECT query_id, doc_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS place FROM bm) WHERE place <= 3")
def bm25_topk(t):
    terms = lambda name, key, to: t(name).select(F.col(key).alias(to), text.tokens(F.col("text")).alias("terms"))
    return rank.top(rank.bm25(terms("documents", "doc_id", "doc_id"), terms("benchmark", "item_id", "query_id")), 3).withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score", "place")


@query("idf", f"WITH d AS (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM documents) SELECT term, count(*)::BIGINT AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM d GROUP BY term")
def idf(t):
    docs = t("documents").select(F.array_distinct(text.tokens(F.col("text"))).alias("terms"))
    n = docs.count()
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.round(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6))


NODES = """SELECT page_id AS node_id, CASE page_id % 15 WHEN 0 THEN concat('app', page_id % 5, '/tests/test_m', page_id, '.py') WHEN 1 THEN concat('app', page_id % 5, '/migrations/', lpad(concat('', page_id), 4, '0'), '_initial.py')
 WHEN 2 THEN concat('lib', page_id % 3, '/db/models/fields', CASE WHEN page_id % 4 = 0 THEN '' ELSE concat('', page_id) END, '/__init__.py') WHEN 3 THEN concat('core/checks/models_checks', page_id, '.py') WHEN 4 THEN concat('core', page_id % 4, '/management/commands/', CASE page_id % 3 WHEN 0 THEN 'runserver' WHEN 1 THEN 'sqlmigrate' ELSE 'flush' END, '.py') WHEN 5 THEN concat('conf', page_id % 6, '/settings.py')
 WHEN 6 THEN concat('src/forms/x', page_id, '.py') WHEN 7 THEN concat('pkg', page_id % 4, '/sub/mod', page_id % 50, '.py') WHEN 8 THEN concat('db/lookups', page_id, '.py') WHEN 9 THEN concat('src/app/models/base/m', page_id, '.py') WHEN 10 THEN concat('conf/global_settings', CASE WHEN page_id % 2 = 0 THEN '' ELSE concat('', page_id) END, '.py')
 WHEN 11 THEN concat('sub/mod', page_id % 9, '.py') WHEN 12 THEN concat('x/db/migrations/', CASE WHEN page_id % 2 = 0 THEN 'executor' ELSE 'loader' END, '.py') WHEN 13 THEN concat('pkg', page_id % 4, '/sub/', CASE WHEN page_id % 2 = 0 THEN '__init__' ELSE concat('App', page_id % 4) END, '.py')
 ELSE concat(replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '.', '/'), '.py') END AS path, CAST(length(html) % 40 AS BIGINT) AS loc, {0}(concat('Field', page_id % 20), concat('run_', page_id % 11), concat('QuerySet', page_id % 5, 'Mixin'), CASE WHEN page_id % 3 = 0 THEN 'IContains' WHEN page_id % 7 = 0 THEN 'save_to' ELSE 'QuerySet' END) AS symbols,
 CAST(1 AS INT) AS line_start, CAST(1 + length(html) % 40 AS INT) AS line_end, CAST(1 AS DOUBLE) / (20 + page_id % 97) AS pr, page_id % 7 AS calls, page_id % 5 AS inherits FROM pages"""
ISSUES = """SELECT item_id AS query_id, concat(text, CASE WHEN item_id % 3 = 0 THEN ' Traceback:' ELSE ' Seen:' END, ' File "pkg', item_id % 4, '/sub/mod', item_id % 50, '.py", line ', item_id % 45, CASE WHEN item_id % 2 = 0 THEN concat(', in run_', item_id % 11) ELSE '' END, ' then sub/mod', item_id % 9, '.py:', item_id % 60, ' and C:', chr(92), 'sub', chr(92), 'App', item_id % 4, '.py:3 raised ', CASE item_id % 4 WHEN 0 THEN 'fields' WHEN 1 THEN 'core.models' ELSE 'auth' END, '.E', lpad(concat('', item_id % 1000), 3, '0'), ' in `Field', item_id % 20, '.save_to` of Field', (item_id + 3) % 20, '.run_', item_id % 11, ', QuerySet', item_id % 5,
 'Mixin and QuerySet with MAX_LENGTH_', item_id % 7, CASE WHEN item_id % 5 = 0 THEN ' when ./manage.py sqlmigrate or' WHEN item_id % 5 = 1 THEN ' when flush or' ELSE ' but' END, ' runserver met field__icontains, foreignkey and primary_key in ', CASE WHEN item_id % 2 = 0 THEN 'src/app/models/base' ELSE 'Sub/mod3.py' END, CASE WHEN item_id % 4 = 0 THEN ' under pytest' WHEN item_id % 4 = 1 THEN ' with a widget' WHEN item_id % 4 = 2 THEN ' in 0001_initial.py' ELSE ' ' END) AS text FROM benchmark"""
#: Typed edges between the nodes.
LINKS = """SELECT a.page_id AS src, b.page_id AS dst, a.edge_type FROM (SELECT page_id, CAST(floor(page_id / 2) AS BIGINT) AS other, CASE page_id % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'call' WHEN 2 THEN 'inherit' ELSE 'descriptor' END AS edge_type FROM pages WHERE page_id > 1
 UNION ALL SELECT page_id, page_id + 13, CASE page_id % 2 WHEN 0 THEN 'config-ref' ELSE 'test-of' END FROM pages WHERE page_id % 3 = 0) a JOIN (SELECT page_id FROM pages) b ON a.other = b.page_id WHERE a.page_id % 10 <> 7 AND b.page_id % 10 <> 7"""
CAP = 0.04


def _any(words, low="low"):
    return " + ".join(f"CAST(contains({low}, '{w}') AS INT)" for w in words)


_PLAIN_PAIR = "SELECT query_id, node_id, sum(trace)::DOUBLE AS trace, bool_or(into_) AS into_ FROM (SELECT query_id, node_id, CASE WHEN ends_with(lp, fp) OR ends_with(fp, lp) THEN 1 + CASE WHEN line BETWEEN line_start AND line_end THEN 1.5 ELSE 0 END WHEN lower(bs) = split_part(fp, '/', -1) THEN 0.5 ELSE 0 END AS trace, ends_with(lp, fp) OR ends_with(fp, lp) OR lower(bs) = split_part(fp, '/', -1) AS into_ FROM f CROSS JOIN n) GROUP BY ALL"
_CTE = f"""WITH n0 AS MATERIALIZED (SELECT *, {_KIND} AS kind, {_CM} AS cm, {_CLUSTER} AS cluster, lower(path) AS lp, lower({_STEM}) AS stem_, {_B} AS bs, list_transform(symbols, lambda s: lower(s)) AS lows FROM ({NODES.format('list_value')})),
 n AS MATERIALIZED (SELECT *, {_CAMEL} AS name, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM n0),
 q0 AS (SELECT *, lower(text) AS low, {SQL_CODE} AS c FROM ({ISSUES})),
 q AS MATERIALIZED (SELECT *, {sql_first('c')} AS terms, {sql_first(SQL_CODES, 'x')} AS codes, {sql_first(SQL_CONSTS, 'x')} AS consts, {SQL_VERBS} AS verbs, {SQL_DUNDERS} AS dunders, {sql_first(SQL_EXPLICIT, 'x')} AS explicit, ({_any(rank.ORM)}) - ({_any(rank.FORMS)}) AS net, {_any(rank.ADMIN)} AS adm FROM q0),
 f AS (SELECT DISTINCT query_id, lower(path) AS fp, line FROM (SELECT query_id, {SQL_FPATH} AS path, {SQL_FLINE} AS line FROM (SELECT query_id, unnest({sql_numbered(SQL_FRAMES2)}) AS f FROM q))),
 tr AS ({_PLAIN_PAIR}),
 sy AS (SELECT query_id, node_id, max(CASE WHEN s = lower(t) THEN 1 WHEN s = lower(split_part(t, '.', -1)) THEN 0.85 WHEN contains(s, lower(t)) OR contains(lower(t), s) THEN 0.5 ELSE 0 END)::DOUBLE AS sym FROM (SELECT query_id, unnest(terms) AS t FROM q) CROSS JOIN (SELECT node_id, unnest(lows) AS s FROM n) GROUP BY ALL),
 lt AS (SELECT DISTINCT query_id, lower(t) AS term FROM (SELECT query_id, unnest(terms) AS t FROM q)), nk AS (SELECT DISTINCT node_id, k FROM (SELECT node_id, unnest(list_concat(lows, [stem_])) AS k FROM n)),
 th AS (SELECT DISTINCT query_id, term, node_id FROM lt JOIN nk ON k = term OR k = split_part(term, '.', -1)), td AS (SELECT term, count(DISTINCT node_id) AS df FROM th GROUP BY term),
 ti AS (SELECT query_id, node_id, sum(ln(1 + (SELECT count(*) FROM n) / df::DOUBLE)) AS term_idf FROM th JOIN td USING (term) GROUP BY ALL),
 sp AS (SELECT node_id, l, s, 1.0::DOUBLE + CASE WHEN length(s) >= 8 THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(substr(s, 2), '\\p{{Lu}}') THEN 0.5 ELSE 0 END AS w FROM (SELECT node_id, lower(s.x) AS l, arg_max(s.x, s.i) AS s FROM (SELECT node_id, unnest({sql_numbered('symbols')}) AS s FROM n) GROUP BY ALL)),
 qt AS (SELECT query_id, lower(t.x) AS term, t.i AS pos FROM (SELECT query_id, unnest({sql_numbered('terms')}) AS t FROM q)),
 cd AS (SELECT query_id, pos, 0 AS at_, term AS l, 0 AS part FROM qt UNION ALL SELECT query_id, pos, p.i, p.x, 1 FROM (SELECT query_id, pos, unnest({sql_numbered("string_split(term, '.')")}) AS p FROM qt WHERE contains(term, '.')) WHERE p.x <> ''),
 ex AS (SELECT query_id, node_id, sum(w * CASE WHEN part = 1 THEN 0.7::DOUBLE WHEN s IN ({','.join(repr(g) for g in rank.GENERIC)}) THEN 0.4::DOUBLE ELSE 1 END) AS symbol_exact FROM (SELECT query_id, node_id, l, arg_min(part, pos * 1000 + at_) AS part, any_value(s) AS s, any_value(w) AS w FROM cd JOIN sp USING (l) GROUP BY query_id, node_id, l) GROUP BY ALL),
 ec AS (SELECT query_id, node_id, sum(CASE WHEN contains(lp, 'checks/' || c) OR contains(lp, c || '_checks') OR ends_with(lp, c || '/checks.py') OR contains(lp, '/' || c || '/checks.py') THEN 1.0 WHEN contains(lp, '/checks/') AND contains(lp, c) THEN 0.7 WHEN c = 'fields' AND contains(lp, 'db/models/fields/__init__') THEN 0.6 WHEN c = 'models' AND contains(lp, 'db/models/') AND contains(lp, 'checks') THEN 0.8 ELSE 0 END)::DOUBLE AS error_code FROM (SELECT query_id, split_part(unnest(codes), '.', 1) AS c FROM q) CROSS JOIN n GROUP BY ALL),
 mc AS (SELECT query_id, node_id, sum(CASE WHEN ends_with(lp, 'management/commands/' || v || '.py') THEN 1.0 WHEN v IN ('sqlmigrate', 'migrate', 'makemigrations', 'showmigrations') AND (ends_with(lp, 'db/migrations/executor.py') OR ends_with(lp, 'db/migrations/loader.py')) THEN 0.4 ELSE 0 END)::DOUBLE AS mgmt_command FROM (SELECT query_id, unnest(verbs) AS v FROM q) CROSS JOIN n GROUP BY ALL),
 xp AS (SELECT query_id, node_id, arg_min(v, i)::DOUBLE AS explicit_path FROM (SELECT query_id, node_id, e.i, CASE WHEN ends_with(lp, e.x) THEN 1.0 WHEN NOT ends_with(e.x, '.py') AND contains('/' || lp || '/', '/' || e.x || '/') THEN 0.5 ELSE 0 END AS v FROM (SELECT query_id, unnest({sql_numbered('explicit')}) AS e FROM q) CROSS JOIN n) WHERE v > 0 GROUP BY ALL),
 pt AS (SELECT DISTINCT query_id, node_id, 1::DOUBLE AS path_term FROM (SELECT * FROM lt WHERE ends_with(term, '.py')) CROSS JOIN n WHERE ends_with(lp, term) OR lower(bs) = split_part(term, '/', -1)),
 {_bm25(f"SELECT node_id AS doc_id, list_concat(list_concat({_TOK.format(chr(39).join(['translate(path, ', '/.', ', ', '  ', ')']))}, {_TOK.format('name')}), {_TOK.format("array_to_string(symbols, ' ')")}) AS terms FROM n", f"SELECT query_id, {_TOK.format('text')} AS terms FROM q")},
 x AS MATERIALIZED (SELECT q.query_id, n.node_id, path, cluster, name, kind, pr, low, lp, n.calls, n.inherits, n.cluster_size, coalesce(bm.score, 0) AS lex, coalesce(trace, 0) AS trace, coalesce(sym, 0) AS sym, ln(1 + least(pr, {CAP}::DOUBLE) * 1000) AS cent, ln(1 + 1 / greatest(1, cluster_size)::DOUBLE) AS idf, (kind = 'registry')::INT::DOUBLE AS reg,
 (length(stem_) > 3 AND stem_ <> '__init__' AND contains(low, stem_))::INT::DOUBLE AS stem, coalesce(path_term, 0) AS path_term, coalesce(explicit_path, 0) AS explicit_path,
 coalesce(symbol_exact, 0) AS symbol_exact, (CASE WHEN len(dunders) = 0 THEN 0 ELSE contains(lp, 'lookups')::INT + len(list_filter(dunders, lambda d: list_contains(lows, d))) + len(list_filter(dunders, lambda d: list_contains(lows, replace(d, '_', '')))) END)::DOUBLE AS dunder,
 (CASE WHEN contains('/' || lp, '/db/models/') THEN 1.0::DOUBLE WHEN contains('/' || lp, '/db/') THEN 0.5 ELSE 0 END - contains('/' || lp, '/forms/')::INT) * tanh(net / 3.0::DOUBLE) + CASE WHEN contains('/' || lp, '/contrib/admin/') AND adm >= 1 THEN 0.5 ELSE 0 END AS domain,
 coalesce(error_code, 0) AS error_code, (CASE WHEN len(consts) = 0 THEN 0 WHEN contains(lp, 'conf/global_settings') OR ends_with(lp, 'conf/__init__.py') THEN least(3, len(consts)) WHEN contains(lp, 'settings') THEN 0.5 ELSE 0 END)::DOUBLE AS upper_const,
 coalesce(mgmt_command, 0) AS mgmt_command, least(1, 0.2::DOUBLE * calls) AS call_target, least(1, 0.25::DOUBLE * inherits) AS inherit_target, coalesce(term_idf, 0) AS term_idf, coalesce(into_, false) AS into_
 FROM q CROSS JOIN n LEFT JOIN tr USING (query_id, node_id) LEFT JOIN sy USING (query_id, node_id) LEFT JOIN ti USING (query_id, node_id) LEFT JOIN ex USING (query_id, node_id) LEFT JOIN ec USING (query_id, node_id) LEFT JOIN mc USING (query_id, node_id) LEFT JOIN xp USING (query_id, node_id) LEFT JOIN pt USING (query_id, node_id) LEFT JOIN bm ON bm.query_id = q.query_id AND bm.doc_id = n.node_id)"""
_ADMIT = lambda terms: "(" + _any(terms) + ") > 0"
_SCORE = (
    _CTE
    + ", w AS (SELECT *, "
    + " + ".join(f"{b}::DOUBLE * {s}" for s, b in rank.BETAS.items())
    + f""" AS s0, (kind = 'test' OR contains('/' || lp, '/tests/') OR starts_with(split_part(lp, '/', -1), 'test_')) AND NOT into_ AND NOT {_ADMIT(rank.TEST_TERMS)} AS tg, (regexp_matches(lp, '/migrations/[0-9]{{4}}_[a-z][a-z0-9_]+[.]py$') OR kind = 'migration' AND regexp_matches(split_part(lp, '/', -1), '^[0-9]{{4}}_[a-z]')) AND NOT into_ AND NOT regexp_matches(low, '(?:^|[^\\p{{L}}\\p{{N}}_])[0-9]{{4}}_[a-z][a-z0-9_]+[.]py(?:$|[^\\p{{L}}\\p{{N}}_])') AND NOT {_ADMIT(rank.MIGRATION_TERMS)} AS mg FROM x),
 g AS (SELECT *, CASE WHEN tg THEN s0 * 0.25::DOUBLE - 2.5 ELSE s0 END AS s1 FROM w), h AS (SELECT *, CASE WHEN mg THEN s1 * 0.15::DOUBLE - 3 ELSE s1 END AS s2 FROM g),
 z AS MATERIALIZED (SELECT *, CASE WHEN pr > 0.8::DOUBLE * {CAP}::DOUBLE AND symbol_exact + explicit_path + trace + error_code = 0 THEN s2 * 0.85::DOUBLE ELSE s2 END AS score FROM h)"""
)


def _nodes(t):
    from ..functions import paths

    p = F.col("path")
    nodes = t.derived(NODES.format("array")).withColumns({"kind": paths.kind(p, F.col("loc")), "name": paths.camel(p), "cluster": paths.cluster(p)})
    sizes = nodes.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    return nodes.join(sizes, "cluster")


def _signals(t):
    return rank.signals(_nodes(t), t.derived(ISSUES), CAP)


for _s in rank.BETAS:

    @query(f"sig_{_s}", f"{_CTE} SELECT query_id, node_id, round({_s}, 6)::DOUBLE AS {_s} FROM x")
    def signal(t, s=_s):
        return _signals(t).select("query_id", "node_id", F.round(s, 6).alias(s))


@query("score_v2", f"{_SCORE} SELECT query_id, node_id, round(score, 6) AS score FROM z")
def score_v2(t):
    return rank.scored(_signals(t), CAP).select("query_id", "node_id", F.round("score", 6).alias("score"))


@query("gates", f"{_SCORE} SELECT query_id, node_id, tg AS test, mg AS migration FROM z")
def gates(t):
    test, migration = rank.gates()
    return _signals(t).select("query_id", "node_id", test.alias("test"), migration.alias("migration"))


_ANCHOR = _SCORE + """, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, node_id)::INT AS place FROM z), b AS (SELECT *, exp((score - max(score) OVER (PARTITION BY query_id)) / 0.5::DOUBLE) AS e FROM o WHERE place <= 6),
 p AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS p FROM b), c AS (SELECT *, max(p) FILTER (place = 1) OVER (PARTITION BY query_id) AS p1, coalesce(max(p) FILTER (place = 2) OVER (PARTITION BY query_id), 0) AS p2 FROM p)"""


@query("anchors", f"{_ANCHOR} SELECT query_id, node_id, place, round(p, 6) AS p, round(p1, 3) AS confidence, p1 - p2 < 0.08::DOUBLE AS low_margin FROM c WHERE place = 1 OR (p1 - p2 < 0.08::DOUBLE AND place <= 3 AND p >= p1 - 0.12::DOUBLE)")
def anchors(t):
    return rank.anchors(rank.scored(_signals(t), CAP)).withColumn("p", F.round("p", 6))


@query("locate_topk", f"{_ANCHOR} SELECT query_id, node_id, path, place, round(score, 4) AS score FROM o WHERE place <= 3")
def locate_topk(t):
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "path", "node_id")
    return rank.scored(_signals(t), CAP).withColumn("place", F.row_number().over(order)).filter("place <= 3").select("query_id", "node_id", "path", "place", F.round("score", 4).alias("score"))
