"""Text mining over every document, marked up as an issue, and over the pages' paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lineage, paths, text
from ..functions.lineage import written
from .registry import query

ISSUES = """SELECT doc_id, concat(coalesce(text, ''), ' Traceback: File "pkg/sub/mod', doc_id % 50, '.py", line ', n_chars % 900, ', in run_', doc_id % 11, '.go then lib/core/x', doc_id % 9, '.py:', doc_id % 300, ' or Lib/core/X', doc_id % 9, '.py:', doc_id % 300, ':7 or C:', chr(92), 'src', chr(92), 'App', doc_id % 4, '.py:12 and File "pkg/other.py", line 12',
 ' raised core.models.E', lpad(concat('', doc_id % 1000), 3, '0'), ', fields.w12 and Auth.W003; in `Field', doc_id % 20, '.save_to` of QuerySet', doc_id % 5, 'Mixin, querySET', doc_id % 5, 'mixin and URLField with MAX_LENGTH_', doc_id % 7, ' POSTGRES ROLLBACK DATABASES CSRF_ DEBUG when ./manage.py sqlmigrate or "validate" or migrate. or (shell) met name__icontains or a__averyveryverylongname or email__is_null',
 ' in src/app/models/base or SRC/app/models/base and Lib/x1/y_2.py, a/9b/c.py, ', chr(10), '```', chr(10), 'see aB_c in x-y/z.py', chr(10), '```', chr(10), ' self test error of the CamelCaseName') AS text FROM documents"""
PATHS = """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN concat('app', page_id % 5, '/tests/test_m', page_id, '.py') WHEN page_id % 7 = 0 THEN concat('app', page_id % 5, '/migrations/', lpad(concat('', page_id), 4, '0'), '_initial.py')
 WHEN page_id % 5 = 0 THEN concat('app', page_id % 9, '/sub', page_id, '/__init__.py') WHEN page_id % 3 = 0 THEN concat('node_modules/x', page_id, '/admin.py') WHEN page_id % 4 = 0 THEN concat(CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'tests_util/' ELSE 'conf/' END, CASE page_id % 5 WHEN 1 THEN 'global_settings.py' WHEN 2 THEN 'config.py' WHEN 3 THEN 'registry.py' WHEN 4 THEN 'conftest.py' ELSE 'settings.py' END)
 ELSE concat(replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '.', '/'), '.py') END AS path, CAST(length(html) % 40 AS BIGINT) AS loc FROM pages"""
#: Paths of one stem that meet at once.
BLOCK = 1000
_STOP, _PLAIN = (",".join(f"'{w}'" for w in words) for words in (text.STOPWORDS, text.PLAIN))
_U = r"[\p{L}\p{N}_]+"
_BL = r"\s\x0B\x1C-\x1F\x85\p{Z}"
_I = "[A-Za-z_][A-Za-z0-9_]*"


def sql_numbered(values: str) -> str:
    return f"list_transform({values}, lambda x, i: {{'x': x, 'i': i}})"


def sql_first(values: str, key: str = "lower(x)") -> str:
    """The list without later values of a key seen before."""
    return f"list_transform(list_sort(list_transform(list_distinct(list_transform({values}, lambda x: {key})), lambda k: list_position(list_transform({values}, lambda x: {key}), k))), lambda k: ({values})[k])"


SQL_TOKENS = rf"list_filter(flatten(list_transform(regexp_extract_all({{}}, '[A-Za-z][A-Za-z0-9_]*'), lambda t: list_concat([lower(t)], string_split(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '_')))), lambda t: length(t) > 2 AND t NOT IN ({_STOP}))"


def _quoted(of: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all({of}, '`([^`\n]+)`', 1), lambda x: regexp_replace(x, '^[{_BL}]+|[{_BL}]+$', '', 'g')), lambda x: x <> '')"


SQL_CODE = rf"list_concat(list_concat({_quoted('text')}, regexp_extract_all(text, '{_I}(?:\.{_I})+|[A-Za-z0-9_./-]+\.py')), list_filter(regexp_extract_all(text, '{_U}'), lambda t: regexp_matches(t, '^[A-Z][a-zA-Z0-9_]{{2,}}$')))"
_SHORT = rf"(?:[A-Za-z]:[\\/])?[^:\"''{_BL}]+?\.py:[0-9]+"
_FRAMES1 = rf"""list_concat(regexp_extract_all(text, 'File "[^"\n]+", line [0-9]+, in [A-Za-z_][A-Za-z0-9_.]*'), regexp_extract_all(text, '{_SHORT}'))"""
SQL_FRAMES2 = rf"""regexp_extract_all(text, 'File "[^"\n]+", line [0-9]+|{_SHORT}')"""
SQL_FPATH = r"""replace(CASE WHEN starts_with(f.x, 'File "') THEN regexp_extract(f.x, '^File "([^"\n]+)"', 1) ELSE regexp_extract(f.x, '(?s)^(.*\.py):[0-9]+$', 1) END, '\', '/')"""
SQL_FLINE = r"""CASE WHEN starts_with(f.x, 'File "') THEN regexp_extract(f.x, '", line ([0-9]+)', 1) ELSE regexp_extract(f.x, ':([0-9]+)$', 1) END::BIGINT"""
SQL_EXPLICIT = rf"list_transform(regexp_extract_all(text, '(?:{_I}/)+{_I}\.py|{_I}/{_I}(?:/{_I})+'), lambda x: lower(x))"
_CHAINS = rf"flatten(list_transform(list_transform(regexp_extract_all(text, '{_U}(?:\.{_U})+'), lambda c: string_split(c, '.')), lambda p: list_transform(range(1, len(p)), lambda i: p[i] || '.' || p[i + 1])))"
SQL_CODES = rf"list_transform(list_filter({_CHAINS}, lambda t: regexp_matches(t, '^[A-Za-z][A-Za-z_]{{1,15}}\.[EWew][0-9]{{3,4}}$')), lambda t: lower(split_part(t, '.', 1)) || '.' || upper(split_part(t, '.', 2)))"
SQL_CONSTS = f"list_filter(regexp_extract_all(text, '{_U}'), lambda t: regexp_matches(t, '^[A-Z][A-Z0-9_]{{4,}}$') AND (contains(t, '_') OR length(t) >= 8) AND t NOT IN ({','.join(repr(c) for c in text.NO_CONSTANTS)}))"
SQL_VERBS = "list_filter([" + ",".join(f"'{v}'" for v in text.VERBS) + rf"], lambda v: regexp_matches(lower(text), '(?:^|[`''\"./{_BL}])' || v || '(?:[`''\":({_BL}]|$)'))"
SQL_DUNDERS = f"list_filter(list_transform(regexp_extract_all(lower(text), '{_U}'), lambda w: regexp_extract(w, '__([a-z][a-z0-9_]{{1,15}})$', 1)), lambda x: x <> '')"


def _sql(body: str) -> str:
    return f"WITH i AS ({ISSUES}) {body}"


def _paths(body: str) -> str:
    return f"WITH p AS ({PATHS}) {body}"


_JOIN = "array_to_string({}, '|')"


def _list(name, column, expression):
    @query(name, _sql(f"SELECT doc_id, array_to_string({expression}, '|') AS {name} FROM i"))
    def run(t):
        return t.derived(ISSUES).select("doc_id", F.concat_ws("|", column(F.col("text"))).alias(name))


_list("tokens", text.tokens, SQL_TOKENS.format("text"))
_list("keywords", lambda c: F.array_sort(text.keywords(c)), f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(text, '(?s)```.*?```', ' ', 'g')), '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: t NOT IN ({_PLAIN}))))")
_list("upper_consts", text.upper_constants, sql_first(SQL_CONSTS, "x"))
_list("error_codes", text.error_codes, sql_first(SQL_CODES, "x"))
_list("mgmt_verbs", text.verbs, SQL_VERBS)
_list("dunders", text.dunders, SQL_DUNDERS)
_list("explicit_paths", text.explicit_paths, sql_first(SQL_EXPLICIT, "x"))


def _listed(name, column, inner, values):
    """A list that SQL makes in two steps."""

    @query(name, _sql(f"SELECT doc_id, array_to_string({sql_first('c')}, '|') AS {name} FROM (SELECT doc_id, {values} AS c FROM ({inner}))"))
    def run(t):
        return t.derived(ISSUES).select("doc_id", F.concat_ws("|", column(F.col("text"))).alias(name))


_listed("code_terms", text.code_terms, "FROM i", SQL_CODE)


def _names(of: str) -> str:
    return rf"list_filter(regexp_extract_all({of}, '[A-Za-z_][A-Za-z0-9_.]{{2,}}'), lambda t: contains(t, '.') OR contains(t, '_') OR regexp_matches(substr(t, 2), '\p{{Lu}}'))"


def _pys(of: str) -> str:
    return rf"regexp_extract_all({of}, '[A-Za-z0-9_./-]+\.py')"


_listed("issue_terms", text.issue_terms, "SELECT doc_id, regexp_extract_all(text, '(?s)```(.*?)```', 1) AS b, regexp_replace(text, '(?s)```.*?```', ' ', 'g') AS text FROM i", f"list_concat(list_concat(flatten(list_transform(b, lambda x: list_concat({_pys('x')}, {_names('x')}))), {_quoted('text')}), list_concat({_pys('text')}, {_names('text')}))")


def _frames(name, column, found, symbol):
    fields = "path, line, symbol" if symbol else "path, line"
    own = """CASE WHEN starts_with(f.x, 'File "') THEN regexp_extract(f.x, ', in ([A-Za-z_][A-Za-z0-9_.]*)$', 1) ELSE '' END""" if symbol else "''"

    @query(name, _sql(f"SELECT doc_id, {fields} FROM (SELECT doc_id, arg_min(path, i) AS path, line, arg_min(symbol, i) AS symbol FROM (SELECT doc_id, f.i, {SQL_FPATH} AS path, {SQL_FLINE} AS line, {own} AS symbol FROM (SELECT doc_id, unnest({sql_numbered(found)}) AS f FROM i)) GROUP BY doc_id, lower(path), line, lower(symbol))"))
    def run(t):
        return t.derived(ISSUES).select("doc_id", F.inline(column(F.col("text"))))


_frames("trace_frames", text.trace_frames, _FRAMES1, True)
_frames("frames", text.frames, SQL_FRAMES2, False)


@query("token_estimate", _sql("SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, CASE WHEN regexp_matches(lower(text), 'traceback|crash|exception|error') THEN 'crash-fix' WHEN regexp_matches(lower(text), 'test|assert|failure') THEN 'test-fix' ELSE 'issue-fix' END AS preset FROM i"))
def token_estimate(t):
    return t.derived(ISSUES).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), text.preset(F.col("text")).alias("preset"))


@query("preset_select", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'traceback|crash|exception|error') THEN 'crash-fix' WHEN regexp_matches(lower(text), 'test|assert|failure') THEN 'test-fix' ELSE 'issue-fix' END AS preset, greatest(1, length(text) // 4)::BIGINT AS tokens FROM conversations")
def preset_select(t):
    return t("conversations").select("conv_id", "turn", text.preset(F.col("text")).alias("preset"), text.token_estimate(F.col("text")).alias("tokens"))


_PATCH = "SELECT page_id, concat('diff --git a/', path, ' b/', path, chr(10), '--- a/', path, chr(10), '+++ b/', path, chr(10), '-x', chr(10), 'diff --git a/zz.py b/zz.py', chr(10)) AS patch FROM (" + PATHS + ")"


@query("gold_files", f"WITH p AS ({_PATCH})" + r" SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(patch, '(?m)^diff --git a/(\S+)', 1), regexp_extract_all(patch, '(?m)^--- a/(\S+)', 1)))), '|') AS files FROM p")
def gold_files(t):
    return t.derived(_PATCH).select("page_id", F.concat_ws("|", text.gold_files(F.col("patch"))).alias("files"))


_B = "split_part(path, '/', -1)"
_KIND = f"""CASE WHEN len(list_filter(string_split(path, '/'), lambda x: starts_with(x, 'tests') OR starts_with(x, 'test_'))) > 0 OR {_B} = 'conftest.py' THEN 'test'
 WHEN list_contains(string_split(path, '/'), 'migrations') AND starts_with({_B}, '0') AND ends_with(path, '.py') THEN 'migration' WHEN {_B} IN ({','.join(f"'{r}'" for r in paths.REGISTRY)}) AND NOT ({_B} = '__init__.py' AND loc < 10) THEN 'registry' ELSE 'normal' END"""
_STEM = rf"regexp_replace({_B}, '(.)\.[^.]*$', '\1')"
_CAMEL = f"CASE WHEN cm = '' THEN 'Node' WHEN regexp_matches(cm, '^[0-9]') THEN 'N' || cm ELSE cm END"
_CM = f"array_to_string(list_transform(list_filter(regexp_split_to_array({_STEM}, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: upper(x[1]) || substr(x, 2)), '')"
_CLUSTER = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"


@query("classify_kind", _paths(f"SELECT page_id, path, {_KIND} AS kind, {_CAMEL} AS name, cluster FROM (SELECT *, {_CM} AS cm, {_CLUSTER} AS cluster FROM p)"))
def classify_kind(t):
    p = F.col("path")
    return t.derived(PATHS).select("page_id", "path", paths.kind(p, F.col("loc")).alias("kind"), paths.camel(p).alias("name"), paths.cluster(p).alias("cluster"))


@query("scan_paths_admitted", _paths(f"SELECT page_id, path FROM p WHERE NOT ({_B} = '__init__.py' AND loc < 10) AND NOT list_has_any(string_split(path, '/')[:-2], [{','.join(repr(s) for s in paths.SKIPPED)}])"))
def scan_paths_admitted(t):
    p = F.col("path")
    return t.derived(PATHS).filter(paths.admitted(p, F.col("loc")) & ~paths.skipped_folder(p)).select("page_id", "path")


@query("ignore_match", _paths("SELECT page_id, path FROM p WHERE path GLOB 'app1*' OR path GLOB '*/admin.py' OR path = 'settings.py' OR path LIKE '%/settings.py'"))
def ignore_match(t):
    return t.derived(PATHS).filter(paths.ignored(F.col("path"), ["# comment", "", "app1*", "admin.py", "settings.py"])).select("page_id", "path")


@query("cluster_size", _paths(f"SELECT {_CLUSTER} AS cluster, count(*)::BIGINT AS files FROM p GROUP BY 1"))
def cluster_size(t):
    return t.derived(PATHS).groupBy(paths.cluster(F.col("path")).alias("cluster")).agg(F.count("*").alias("files"))


@query("scan_by_folder", _paths(f"SELECT {_CLUSTER} AS folder, array_to_string(list_sort(list({_B})), '|') AS files FROM p GROUP BY 1"))
def scan_by_folder(t):
    return t.derived(PATHS).groupBy(paths.cluster(F.col("path")).alias("folder")).agg(F.concat_ws("|", F.sort_array(F.collect_list(paths.base(F.col("path"))))).alias("files"))


@query("path_match", _paths(f"""SELECT a.page_id, b.page_id AS other, CASE WHEN ends_with(a.path, b.path) OR ends_with(b.path, a.path) THEN 18 WHEN a.b = b.b THEN 12 WHEN a.s = b.s THEN 8 ELSE 0 END AS score
 FROM (SELECT page_id, lower(path) AS path, lower({_B}) AS b, lower({_STEM}) AS s FROM p) a JOIN (SELECT page_id, lower(path) AS path, lower({_B}) AS b, lower({_STEM}) AS s FROM p) b ON a.s = b.s AND a.page_id < b.page_id"""))
def path_match(t):
    """Every score but 0 needs the same stem, so paths meet by it: those of a stem in blocks, each two of which are a task's own."""
    low = F.lower("path")
    rows = written(t.derived(PATHS).select("page_id", low.alias("path"), paths.base(low).alias("b"), F.lower(paths.stem(F.col("path"))).alias("s")))
    many = rows.groupBy("s").agg(F.count("*").alias("n"))
    pairs = many.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-pairs // (2 * lineage.TASK_PAIRS)))
    own = rows.join(many.select("s", F.ceil(F.col("n") / BLOCK).cast("int").alias("k")), "s").withColumn("own", F.pmod(F.xxhash64("page_id"), F.col("k")).cast("int"))
    a = own.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("i", F.col("k") - 1)))
    b = own.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "j"))).select("s", "i", "j", F.col("page_id").alias("other"), F.col("path").alias("path2"), F.col("b").alias("b2"))
    met = a.repartition(tasks, "s", "i", "j").join(b.repartition(tasks, "s", "i", "j").hint("merge"), ["s", "i", "j"]).filter("i < j and page_id <> other or page_id < other")
    score = F.when(F.endswith("path", "path2") | F.endswith("path2", "path"), 18).when(F.col("b") == F.col("b2"), 12).otherwise(8)
    return met.select(F.least("page_id", "other").alias("page_id"), F.greatest("page_id", "other").alias("other"), score.alias("score"))


@query("ns_dedup", _paths(f"SELECT folder, CASE WHEN n > 1 THEN c || n ELSE c END AS name FROM (SELECT folder, {_CAMEL.replace('cm', 'c0')} AS c, row_number() OVER (PARTITION BY {_CAMEL.replace('cm', 'c0')} ORDER BY CASE WHEN folder = '.' THEN 0 ELSE len(string_split(folder, '/')) END, folder) AS n FROM (SELECT folder, {_CM.replace('path', 'folder')} AS c0 FROM (SELECT DISTINCT {_CLUSTER} AS folder FROM p)))"))
def ns_dedup(t):
    from ..operators.layout import namespaces

    return namespaces(t.derived(PATHS), "path").select("folder", "name")


@query("grid_layout_node", _paths(f"""SELECT page_id, (1 + ((rn - 1) % cols) * (greatest(8, 96 // cols - 1) + 1))::BIGINT AS x, (1 + ((rn - 1) // cols) * 5)::BIGINT AS y, greatest(8, 96 // cols - 1)::BIGINT AS w, 4::BIGINT AS h
 FROM (SELECT page_id, row_number() OVER (PARTITION BY {_CLUSTER} ORDER BY path, page_id) AS rn, least(3, count(*) OVER (PARTITION BY {_CLUSTER})) AS cols FROM p)"""))
def grid_layout_node(t):
    from ..operators.layout import grid

    return grid(t.derived(PATHS).withColumn("folder", paths.cluster(F.col("path"))), "folder", ["path", "page_id"], 98).select("page_id", "x", "y", "w", "h")
