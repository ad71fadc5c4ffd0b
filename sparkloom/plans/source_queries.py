"""The graph language over part and supplier rows, sources made from pages, and the streaming twins of replicated state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths
from ..functions.lineage import folder, written
from ..operators import extract, state
from ..sources import code, dsl
from ..streaming import crdt
from .graph_queries import LOG
from .registry import query

ROWS = "SELECT p_partkey, concat('  P', p_partkey, ' [', p_partkey % 97, ',', p_size, ',8,4] src/p', p_partkey % 50, '.py lines=', 1 + p_size, '..', 9 + p_size, ' {new -> ', lower(replace(p_brand, '#', '')), ' ~> done}') AS line FROM part"
_NUM = lambda k: f"regexp_extract(line, '^\\s*([A-Za-z_][A-Za-z0-9_.]*) \\[(-?\\d+),(-?\\d+),(-?\\d+),(-?\\d+)\\]', {k})"


@query("dsl_node_lines", f"SELECT p_partkey, {_NUM(1)} AS name, {_NUM(2)}::INT AS x, {_NUM(3)}::INT AS y, regexp_extract(line, '\\s([A-Za-z0-9_./*~-]+\\.py)', 1) AS src, regexp_extract(line, 'lines=(\\d+)\\.\\.(\\d+)', 1)::INT AS line_start, regexp_extract(line, 'lines=(\\d+)\\.\\.(\\d+)', 2)::INT AS line_end, array_to_string(regexp_split_to_array(regexp_extract(line, '\\{{([^{{}}]*)\\}}', 1), '\\s*(->|~>)\\s*'), '|') AS states FROM ({ROWS})")
def dsl_node_lines(t):
    head = r"^\s*([A-Za-z_][A-Za-z0-9_.]*) \[(-?\d+),(-?\d+),(-?\d+),(-?\d+)\]"
    x = lambda p, k: F.regexp_extract("line", p, k)
    return t.derived(ROWS).select("p_partkey", x(head, 1).alias("name"), x(head, 2).cast("int").alias("x"), x(head, 3).cast("int").alias("y"), x(r"\s([A-Za-z0-9_./*~-]+\.py)", 1).alias("src"), x(r"lines=(\d+)\.\.(\d+)", 1).cast("int").alias("line_start"), x(r"lines=(\d+)\.\.(\d+)", 2).cast("int").alias("line_end"), F.array_join(F.split(x(r"\{([^{}]*)\}", 1), r"\s*(->|~>)\s*"), "|").alias("states"))


def _graphs(t):
    """A document for each brand."""
    rows = t.derived(ROWS.replace("SELECT p_partkey,", "SELECT p_brand, p_partkey,"))
    body = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    name = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    return rows.groupBy(name.alias("graph_id")).agg(F.concat(F.lit("@L0 "), F.first(name), F.lit(' [0,0,100,100] "src/*.py" {\n'), body, F.lit("\n}\n=== edges ===\nA -> B\n")).alias("text"))


@query("dsl_parse", f"SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS graph_id, 'P' || p_partkey AS name, (p_partkey % 97)::INT AS x, p_size::INT AS y, 'src/p' || (p_partkey % 50) || '.py' AS src, (1 + p_size)::INT AS line_start FROM part")
def dsl_parse(t):
    return dsl.records(_graphs(t)).filter("record = 'node'").select("graph_id", "name", "x", "y", "src", "line_start")


@query("dsl_counts", "SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS graph_id, 1::BIGINT AS namespaces, count(*)::BIGINT AS nodes, 1::BIGINT AS edges FROM part GROUP BY 1")
def dsl_counts(t):
    return dsl.records(_graphs(t)).groupBy("graph_id").agg(*[F.count_if(F.col("record") == r).alias(f"{r}s") for r in ("namespace", "node", "edge")])


@query("dsl_roundtrip", "SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS graph_id, string_agg(concat('  P', p_partkey, ' [', p_partkey % 97, ',', p_size, ',8,4] src/p', p_partkey % 50, '.py lines=', 1 + p_size, '..', 9 + p_size, ' {new -> ', lower(replace(p_brand, '#', '')), ' -> done}'), chr(10) ORDER BY p_size, p_partkey % 97, 'P' || p_partkey) AS rows FROM part GROUP BY 1")
def dsl_roundtrip(t):
    """The canonical text, written twice: its node rows."""
    again = dsl.texts(dsl.records(dsl.texts(dsl.records(_graphs(t)))))
    return again.select("graph_id", F.array_join(F.filter(F.split("text", "\n"), lambda x: x.startswith("  P")), "\n").alias("rows"))


#: Sources of five kinds: classes with bases and calls, package files, tests, migrations, and files that don't parse.
SOURCES = """SELECT page_id, concat('app', page_id % 5, CASE page_id % 7 WHEN 0 THEN '/tests/test_m' WHEN 1 THEN '/migrations/0' ELSE '/m' END, CASE page_id % 7 WHEN 0 THEN concat('', page_id + 4) WHEN 2 THEN concat('', page_id, '/__init__') ELSE concat('', page_id) END, '.py') AS path, CASE page_id % 7
 WHEN 0 THEN concat('import unittest, os', chr(10), 'from app', (page_id + 4) % 5, ' import m', page_id + 4, chr(10), 'class Test', page_id, '(unittest.TestCase):', chr(10), '    def test_it(self):', chr(10), '        m', page_id + 4, '.run(1)', chr(10))
 WHEN 1 THEN concat('from db import migrations', chr(10), 'dependencies = [("APP', page_id % 5, '", "0001")]', chr(10), 'operations = [migrations.CreateModel(name="M', page_id + 2, '"), migrations.AddField("c', page_id + 3, '", model_name="run_', page_id + 3, '"), migrations.RenameIndex("m', page_id + 4, '")]', chr(10))
 WHEN 2 THEN concat('# package', chr(10), 'from app', page_id % 5, '.m', page_id + 5, ' import C', page_id + 5, ' as Z', chr(10), CASE WHEN page_id % 2 = 0 THEN repeat(concat('X = "conf.settings.m', page_id, '"', chr(10)), 12) ELSE '' END)
 WHEN 3 THEN concat('import app', (page_id + 2) % 5, '.m', page_id + 2, chr(10), 'from m', page_id + 1, ' import f, g', chr(10), 'def broken(:', chr(10))
 ELSE concat('import os', chr(10), 'from app', (page_id + 1) % 5, '.m', page_id + 1, ' import C', page_id + 1, ', f', chr(10), 'class C', page_id, '(C', page_id + 1, '):', chr(10), '    def go(self):', chr(10), '        return f(C', page_id + 1, '.make(1))', chr(10), 'def run_', page_id, '():', chr(10), '    return "app', (page_id + 2) % 5, '.m', page_id + 2, '.Value"', chr(10), 'class D', page_id, '(app.C', page_id + 3, '):', chr(10), '    x = g(1)', chr(10)) END AS content FROM pages"""
_S = f"WITH s AS MATERIALIZED ({SOURCES})"
_IMPORTS = r"SELECT path, unnest(regexp_extract_all(content, '(?m)^import ([\w.]+)', 1)) AS m FROM s"
_FROMS = r"SELECT path, m, trim(unnest(string_split(ns, ','))) AS n FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^from ([\w.]+) import (.+)$', 1)) AS m, unnest(regexp_extract_all(content, '(?m)^from ([\w.]+) import (.+)$', 2)) AS ns FROM s)"
#: What syntax tells of these sources, by patterns; broken ones have what lines show.
_REFS = rf"""{_S}, im AS ({_IMPORTS} UNION ALL SELECT path, 'os' FROM s WHERE contains(content, 'unittest, os')), fr AS (SELECT path, m, split_part(n, ' ', 1) AS n FROM ({_FROMS})), ok AS (SELECT * FROM s WHERE NOT contains(content, 'broken(:')), kn AS (SELECT path, split_part(m, '.', -1) AS k FROM im UNION ALL SELECT path, n FROM fr),
 rf AS MATERIALIZED (SELECT DISTINCT path, edge_type, target FROM (SELECT path, 'import' AS edge_type, m AS target FROM im WHERE m <> 'os' OR path NOT IN (SELECT path FROM s WHERE contains(content, 'broken(:')) UNION ALL SELECT path, 'import', m FROM fr UNION ALL SELECT path, 'import', m || '.' || n FROM fr
 UNION ALL SELECT path, 'inherit', unnest(regexp_extract_all(content, '(?m)^class \w+\(([\w.]+)\)', 1)) FROM ok UNION ALL SELECT path, 'call', c FROM (SELECT path, unnest(regexp_extract_all(content, '(\w+)(?:\.\w+)?\(', 1)) AS c FROM ok) JOIN kn USING (path) WHERE c = k
 UNION ALL SELECT path, 'config-ref', unnest(regexp_extract_all(content, '"([a-z_][a-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"', 1)) FROM ok))"""


@query("extract_symbols", rf"{_S} SELECT path, array_to_string(regexp_extract_all(content, '(?m)^(?:class|def) (\w+)', 1), '|') AS symbols, len(string_split(rtrim(content, chr(10)), chr(10)))::BIGINT AS loc FROM s")
def extract_symbols(t):
    return t.derived(SOURCES).select("path", F.array_join(code.symbols(F.col("content")), "|").alias("symbols"), code.line_count(F.col("content")).alias("loc"))


@query("imports", f"{_S}, a AS (SELECT path, m AS x FROM ({_IMPORTS}) UNION ALL SELECT path, m FROM ({_FROMS}) UNION ALL SELECT path, m || '.' || split_part(n, ' ', 1) FROM ({_FROMS})) SELECT path, array_to_string(list_sort(list(DISTINCT x)), '|') AS targets FROM a GROUP BY path")
def imports(t):
    return t.derived(SOURCES).select("path", F.array_join(F.array_sort(code.imports(F.col("content"))), "|").alias("targets"))


@query("typed_references", f"{_REFS} SELECT * FROM rf")
def typed_references(t):
    return code.typed_references(t.derived(SOURCES))


_DEPTH = "len(string_split(path, '/')) || '/' || regexp_replace(path, '/[^/]*$', '') || ' ' || path"
_KINDS = f"""kd AS MATERIALIZED (SELECT *, CASE WHEN contains(path, '/tests/') THEN 'test' WHEN contains(path, '/migrations/') THEN 'migration' WHEN ends_with(path, '__init__.py') THEN 'registry' ELSE 'normal' END AS kind FROM s WHERE NOT (ends_with(path, '__init__.py') AND len(string_split(rtrim(content, chr(10)), chr(10))) < 10)),
 nm AS MATERIALIZED (SELECT path, CASE WHEN regexp_matches(b, '^[0-9]') THEN 'N' || b WHEN b = '__init__' THEN 'Init' ELSE array_to_string(list_transform(string_split(b, '_'), lambda x: upper(x[1]) || x[2:]), '') END AS name FROM (SELECT path, regexp_replace(split_part(path, '/', -1), '[.]py$', '') AS b FROM kd)),
 md AS MATERIALIZED (SELECT key, arg_min(path, {_DEPTH}) AS file FROM (SELECT path, unnest([replace(regexp_replace(path, '[.]py$', ''), '/', '.'), regexp_replace(split_part(path, '/', -1), '[.]py$', '')]) AS key FROM s WHERE NOT ends_with(path, '__init__.py')) GROUP BY key),
 sy AS MATERIALIZED (SELECT key, arg_min(path, {_DEPTH}) AS file FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^(?:class|def) (\\w+)', 1)) AS key FROM kd WHERE NOT contains(content, 'broken(:')) GROUP BY key)"""
_RESOLVED = f"""{_REFS}, {_KINDS}, c0 AS (SELECT rf.*, md.file, 0 AS k FROM rf JOIN md ON key = target UNION ALL SELECT rf.*, sy.file, 1 FROM rf JOIN sy ON key = split_part(target, '.', -1) WHERE edge_type IN ('inherit', 'call')
 UNION ALL SELECT rf.*, md.file, 10 - j FROM rf, range(1, 8) r(j), md WHERE j < len(string_split(target, '.')) AND md.key = array_to_string(string_split(target, '.')[:j], '.')), rs AS MATERIALIZED (SELECT path, edge_type, target, arg_min(file, k) AS file FROM c0 GROUP BY ALL)"""


@query("import_resolution", f"{_RESOLVED} SELECT * FROM rs WHERE file <> path")
def import_resolution(t):
    src = t.derived(SOURCES).select("path", "content")
    facts = code.facts(src)
    admitted = facts.join(src.filter(paths.admitted(F.col("path"), code.line_count(F.col("content")))).select("path"), "path", "left_semi")
    return extract.resolve(facts.select("path", F.inline("refs")), extract.modules(src), extract.owners(admitted))


_EDGES = f"""{_RESOLVED}, mr AS (SELECT path, lower(unnest([regexp_extract(content, '\\("(\\w+)", "0001"', 1), regexp_extract(content, 'name="(\\w+)"\\), migrations.Add', 1), regexp_extract(content, 'AddField\\("(\\w+)"', 1), regexp_extract(content, 'model_name="(\\w+)"', 1)])) AS key FROM kd WHERE kind = 'migration'),
 te AS (SELECT path, regexp_replace(regexp_replace(split_part(path, '/', -1), '[.]py$', ''), '^test_', '') AS key FROM kd WHERE contains(path, '/tests/')),
 ed AS MATERIALIZED (SELECT DISTINCT edge_type, path, file FROM (SELECT edge_type, path, file FROM rs WHERE path IN (SELECT path FROM kd) UNION ALL SELECT 'migration-of', mr.path, coalesce(md.file, sy.file) FROM mr LEFT JOIN md USING (key) LEFT JOIN sy USING (key) UNION ALL SELECT 'test-of', te.path, coalesce(sy.file, md.file) FROM te LEFT JOIN sy USING (key) LEFT JOIN md USING (key)) WHERE file <> path AND file IN (SELECT path FROM kd))"""


def _graph(t):
    src = written(t.derived(SOURCES).select("path", "content"))
    facts = written(code.facts(src))
    found = written(extract.nodes(src, extract.namespaces(src)))
    return src, facts, found, extract.file_edges(src, facts, found)


for _kind, _type in (("typed_edges_ast", "('import', 'inherit', 'call', 'config-ref')"), ("migration_edges", "('migration-of')"), ("test_of_edges", "('test-of')")):

    @query(_kind, f"{_EDGES} SELECT edge_type, path, file FROM ed WHERE edge_type IN {_type}")
    def edges_of(t, kinds=_type):
        return _graph(t)[3].filter(f"edge_type IN {kinds}")


@query("edge_dedup", f"{_EDGES} SELECT DISTINCT edge_type, a.name AS src, b.name AS dst FROM ed JOIN nm a ON a.path = ed.path JOIN nm b ON b.path = ed.file WHERE a.name <> b.name")
def edge_dedup(t):
    _, _, found, edges = _graph(t)
    return extract.named_edges(edges, found)


@query("node_naming", f"{_S}, {_KINDS}, fo AS (SELECT *, row_number() OVER (ORDER BY len(string_split(folder, '/')), folder) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM s)), ns AS (SELECT folder, i, least(5, n) AS cols, c || CASE WHEN k > 1 THEN k::VARCHAR ELSE '' END AS ns FROM (SELECT *, upper(b[1]) || b[2:] AS c, row_number() OVER (PARTITION BY upper(b[1]) || b[2:] ORDER BY len(string_split(folder, '/')), folder) AS k FROM (SELECT *, split_part(folder, '/', -1) AS b FROM fo))) SELECT path, 'App.' || ns || '.' || name AS fqn, kind, (i % cols * (100 // cols) + 1)::INT AS ns_x, (i // cols * 40 + 1)::INT AS ns_y, len(string_split(rtrim(content, chr(10)), chr(10)))::INT AS line_end FROM kd JOIN nm USING (path) JOIN ns ON folder = regexp_replace(path, '/[^/]*$', '')")
def node_naming(t):
    src = t.derived(SOURCES).select("path", "content")
    spaces = extract.namespaces(src)
    return extract.nodes(src, spaces).join(spaces.select("folder", F.col("x").alias("ns_x"), F.col("y").alias("ns_y")), "folder").select("path", "fqn", "kind", "ns_x", "ns_y", "line_end")


@query("sidecar_roundtrip", f"{_S}, {_KINDS} SELECT path, kind, len(string_split(rtrim(content, chr(10)), chr(10)))::BIGINT AS loc, regexp_replace(path, '/[^/]*$', '') AS cluster, count(*) OVER (PARTITION BY regexp_replace(path, '/[^/]*$', ''))::BIGINT AS cluster_size FROM kd")
def sidecar_roundtrip(t):
    """Metadata written as a sidecar and read again; ranks are those of PageRank over the typed edges."""
    made = extract.generate(t.derived(SOURCES))
    meta, _ = extract.read_sidecar(extract.sidecar(made["meta"], made["typed"]))
    return meta.join(made["nodes"].select("fqn", "path"), "fqn").select("path", "kind", "loc", "cluster", "cluster_size")


@query("symbol_spans", rf"""{_S}, l AS (SELECT path, k.x AS line, k.i AS i FROM (SELECT path, unnest(list_transform(string_split(rtrim(content, chr(10)), chr(10)), lambda x, i: {{'x': x, 'i': i}})) AS k FROM s WHERE NOT contains(content, 'broken(:'))), top AS (SELECT path, regexp_extract(line, '^(?:class|def) (\w+)', 1) AS n, i, starts_with(line, 'class') AS c FROM l WHERE regexp_matches(line, '^(?:class|def) ')),
 b AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY path ORDER BY i), (SELECT max(i) + 1 FROM l WHERE l.path = top.path)) - 1 AS z FROM top), m AS (SELECT l.path, regexp_extract(line, 'def (\w+)', 1) AS n, l.i, l.i + 1 AS z, b.n AS owner FROM l JOIN b ON b.path = l.path AND l.i BETWEEN b.i AND b.z AND b.c WHERE starts_with(line, '    def '))
 SELECT path, n AS symbol, i::BIGINT AS line_start, z::BIGINT AS line_end FROM b UNION ALL SELECT path, owner || '.' || n, i, z FROM m UNION ALL SELECT path, n, i, z FROM m""")
def symbol_spans(t):
    return code.symbol_spans(t.derived(SOURCES))


@query("graph_state", "SELECT 'node' AS record, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS path, 'P' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN 1000 ELSE p_partkey % 97 END::INT AS x FROM part UNION ALL SELECT DISTINCT 'namespace', regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'), regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'), 0 FROM part")
def graph_state(t):
    """Records as a log, boxes moved by another replica, logs merged, and the state read back; the only edge was removed."""
    read = written(dsl.records(_graphs(t)).filter("error is null"))
    one = state.log_of(read, "a")
    moved = state.move(one, read.filter("record = 'node' and int(substr(name, 2)) % 4 = 0").select(F.concat_ws(".", "path", "name").alias("key"), F.lit(1000).alias("x"), "y", "w", "h"), 10**9, "b")
    cut = state.link(one, t.spark.createDataFrame([("A", "->", "B")], "src string, kind string, dst string"), 10**9, "c", "remove")
    return state.records_of(state.merge(moved, cut), "all").filter("error is null").select("record", "path", "name", "x")


@query("absolute_boxes", "SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '.P' || p_partkey AS fqn, (7 + p_partkey % 97)::BIGINT AS x, (3 + p_size)::BIGINT AS y, 1 AS depth FROM part")
def absolute_boxes(t):
    shifted = dsl.records(_graphs(t)).withColumns({"x": F.when(F.col("record") == "namespace", 7).otherwise(F.col("x")), "y": F.when(F.col("record") == "namespace", 3).otherwise(F.col("y"))})
    return state.boxes(shifted).select("fqn", "x", "y", "depth")


def _stream(t, run):
    spark = t.spark
    schema = t("events").schema
    name = uuid.uuid4().hex
    ops = spark.readStream.schema(schema).parquet(f"{t.folder}/events.parquet*")
    log = ops.selectExpr("user_id as elem", "CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op", "event_id as stamp", "concat('r', event_id % 4) as replica", "value")
    out = f"{folder(spark)}/stream-{name}"
    crdt.run_to_table(run(log), out, f"{out}-state")
    return spark.read.parquet(out)


@query("lww_stream", f"SELECT elem, round(arg_max(value, stamp), 6) AS value, max(stamp) AS stamp, arg_max(replica, stamp) AS replica FROM ({LOG}) GROUP BY elem")
def lww_stream(t):
    return _stream(t, lambda log: crdt.lww(log, "elem", "value")).withColumn("value", F.round("value", 6))


@query("orset_stream", f"SELECT elem, coalesce(max(stamp) FILTER (op = 'add') > max(stamp) FILTER (op = 'remove'), max(stamp) FILTER (op = 'add') IS NOT NULL) AS present FROM ({LOG}) GROUP BY elem")
def orset_stream(t):
    return _stream(t, crdt.orset).select("elem", "present")
