"""Python sources: scans, symbols, typed references, spans and snippets. Syntax trees need Python; the rest is expressions."""

from __future__ import annotations

import ast
import itertools
import os
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths

#: A folder with one of these is a virtual environment.
MARKERS = ("pyvenv.cfg", "Lib/site-packages", "Scripts/activate", "bin/activate")
MOST_SYMBOLS, MOST_CALLS, MOST_LITERALS = 32, 128, 64
_LITERAL = re.compile(r"""["']([a-z_][a-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)["']""")
_BROKEN = (SyntaxError, ValueError, RecursionError, MemoryError)
_OPERATIONS = frozenset(f"{verb}{what}" for verb, things in {"Create": "Model", "Delete": "Model", "Add": "Field Index Constraint", "Remove": "Field Index Constraint", "Rename": "Field Model", "Alter": "Field ModelOptions ModelManagers ModelTable UniqueTogether IndexTogether OrderWithRespectTo", "Run": "Python SQL", "Separate": "DatabaseAndState"}.items() for what in things.split())


class SourceFiles(DataSource):
    """spark.read.format("loomsources").load(folder): (path, content) of the .py files of a folder (a path or URI) that all workers see.

    Built-in file formats hide names that begin with an underscore, and so package files.
    """

    @classmethod
    def name(cls) -> str:
        return "loomsources"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def files_below(path: str, keep) -> tuple[fs.FileSystem, str, list[str]]:
    """The file system of a path or URI, the folder in it, and the paths of the files below (relative, sorted) that keep admits."""
    system, root = place(path)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True))
    names = sorted(i.path[len(root) :].lstrip("/") for i in infos if i.type == fs.FileType.File)
    return system, root, keep(names)


class _Files(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    @staticmethod
    def _keep(names: list[str]) -> list[str]:
        below = {n[: -len(m) - 1] for n in names for m in MARKERS if n.endswith("/" + m)} | {n.partition("/Lib/site-packages/")[0] for n in names if "/Lib/site-packages/" in n}
        folders = lambda n: [n[:k] for k, c in enumerate(n) if c == "/"]
        return [n for n in names if n.endswith(".py") and not any(f in below or f.rpartition("/")[2] in paths.SKIPPED for f in folders(n))]

    def partitions(self):
        _, _, found = files_below(self.path, self._keep)
        return [InputPartition(found[i : i + 256]) for i in range(0, len(found), 256)]

    def read(self, partition):
        system, root = place(self.path)
        for path in partition.value:
            with system.open_input_stream(f"{root}/{path}") as f:
                yield path, f.readall().decode("utf-8-sig", "replace")


def scan(spark: SparkSession, path: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, content, loc) of the .py files below a folder that scans admit; virtual environments are left out whole."""
    spark.dataSource.register(SourceFiles)
    out = spark.read.format("loomsources").load(path).withColumn("loc", line_count(F.col("content")))
    return out.filter(paths.admitted(F.col("path"), F.col("loc")) & ~paths.skipped_folder(F.col("path")) & ~paths.ignored(F.col("path"), ignore or []))


def line_count(content: Column) -> Column:
    """Lines, the last with or without its end."""
    return F.when(content == "", 0).otherwise(F.size(F.split(F.regexp_replace(content, r"(\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029])\z", ""), r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"))).cast("long")


def symbols(content: Column) -> Column:
    """Names of top-level classes and functions, as lines show them; the first 32."""
    return F.slice(F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?m)^(?:class|def|async def)\s+([A-Za-z_]\w*)"), F.lit(1))), 1, MOST_SYMBOLS)


def imports(content: Column) -> Column:
    """Modules and names that lines import: M and M.name of from-imports. A name after an opening bracket and a blank is overlooked."""
    plain = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_.]*)"), F.lit(1))
    lines = F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*from[ \t]+[A-Za-z_][A-Za-z0-9_.]*[ \t]+import[ \t]+[^\n]+"), F.lit(0))
    module = lambda x: F.regexp_extract(x, r"^[ \t]*from[ \t]+([A-Za-z_][A-Za-z0-9_.]*)", 1)
    pieces = lambda x: F.split(F.regexp_replace(F.regexp_extract(x, r"[ \t]import[ \t]+([^\n]+)$", 1), "#.*$", ""), ",")
    first = lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)
    names = lambda x: F.filter(F.transform(pieces(x), lambda y: F.regexp_replace(first(y), r"^[()]+|[()]+$", "")), lambda y: (y != "") & (y != "*"))
    froms = F.flatten(F.transform(lines, lambda x: F.concat(F.array(module(x)), F.transform(names(x), lambda y: F.concat(module(x), F.lit("."), y)))))
    return F.array_distinct(F.concat(plain, froms))


def line_imports(content: str) -> list[str]:
    """The same for one text."""
    out = dict.fromkeys(re.findall(r"(?m)^[ \t]*import[ \t]+([A-Za-z_][A-Za-z0-9_.]*)", content))
    for module, names in re.findall(r"(?m)^[ \t]*from[ \t]+([A-Za-z_][A-Za-z0-9_.]*)[ \t]+import[ \t]+([^\n]+)", content):
        out[module] = None
        for piece in names.partition("#")[0].split(","):
            name = (piece.split() or [""])[0].strip("()")
            if name not in ("", "*"):
                out[f"{module}.{name}"] = None
    return list(out)


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def references(content: str) -> list[tuple[str, str]]:
    """(edge type, target): imports, bases, calls of imported names or of their attributes (the name is the target), dotted literals;
    of what doesn't parse the imports that lines show. Relative imports without a module have no target."""
    content = content or ""
    try:
        tree = ast.parse(content)
    except _BROKEN:
        return [("import", m) for m in line_imports(content)]
    out: dict[tuple[str, str], None] = {}
    known: set[str] = set()
    nodes = list(ast.walk(tree))
    for node in nodes:
        if isinstance(node, ast.Import):
            for a in node.names:
                out["import", a.name] = None
                known.add(a.name.rpartition(".")[2])
        elif isinstance(node, ast.ImportFrom) and node.module:
            out["import", node.module] = None
            for a in node.names:
                out["import", f"{node.module}.{a.name}"] = None
                known.add(a.name)
        elif isinstance(node, ast.ClassDef):
            out.update({("inherit", name): None for base in node.bases if (name := _dotted(base))})
    calls = 0
    for node in nodes:
        if isinstance(node, ast.Call) and calls < MOST_CALLS:
            head = node.func.value if isinstance(node.func, ast.Attribute) else node.func
            if isinstance(head, ast.Name) and head.id in known:
                calls += 1
                out["call", head.id] = None
    for m in itertools.islice(_LITERAL.finditer(content), MOST_LITERALS):
        out["config-ref", m[1]] = None
    return list(out)


def top_symbols(content: str) -> list[str]:
    """Names of top-level classes and functions; the first 32."""
    try:
        tree = ast.parse(content or "")
    except _BROKEN:
        return []
    return list(dict.fromkeys(n.name for n in tree.body if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))))[:MOST_SYMBOLS]


def module_imports(content: str) -> list[str]:
    """What a file really imports, for verification: modules, and their names; nothing of what doesn't parse."""
    try:
        nodes = list(ast.walk(ast.parse(content or "")))
    except _BROKEN:
        return []
    plain = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
    froms = [m for n in nodes if isinstance(n, ast.ImportFrom) and n.module for m in (n.module, *(f"{n.module}.{a.name}" for a in n.names))]
    return list(dict.fromkeys(plain + froms))


def migrations(content: str) -> list[str]:
    """Lower-cased models and apps that a migration's operations and dependencies name."""
    try:
        nodes = list(ast.walk(ast.parse(content or "")))
    except _BROKEN:
        return []
    out: dict[str, None] = {}
    for node in nodes:
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            if name in _OPERATIONS:
                values = [k.value for k in node.keywords if k.arg in ("model_name", "name")] + node.args[:1]
                out.update({str(v.value).lower(): None for v in values if isinstance(v, ast.Constant)})
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "dependencies" for t in node.targets) and isinstance(node.value, ast.List):
            out.update({str(e.elts[0].value).lower(): None for e in node.value.elts if isinstance(e, ast.Tuple) and e.elts and isinstance(e.elts[0], ast.Constant)})
    return list(out)


def spans(content: str) -> list[tuple[str, int, int]]:
    """(symbol, first line, last line) of classes, functions and methods, these also without their class if the name is free."""
    try:
        tree = ast.parse(content or "")
    except _BROKEN:
        return []
    out: dict[str, tuple[int, int]] = {}
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, (ast.ClassDef, *functions)):
            out[node.name] = node.lineno, node.end_lineno
        if isinstance(node, ast.ClassDef):
            for m in node.body:
                if isinstance(m, functions):
                    out[f"{node.name}.{m.name}"] = m.lineno, m.end_lineno
                    out.setdefault(m.name, (m.lineno, m.end_lineno))
    return [(k, *v) for k, v in out.items()]


def locators(content: str) -> dict[str, ast.AST]:
    """Dotted names of classes and functions, nested ones too."""
    out: dict[str, ast.AST] = {}

    def walk(body: list, prefix: str) -> None:
        for node in body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                out[prefix + node.name] = node
                walk(node.body, f"{prefix}{node.name}.")

    try:
        walk(ast.parse(content or "").body, "")
    except _BROKEN:
        return {}
    return out


def locate(content: str, locator: str) -> dict | None:
    """Where a dotted locator stands: by its whole name, else by the only one that ends with it; null if there is none, or several.

    line_start, line_end from 1; char_start, char_end and byte_start, byte_end from 0. Columns of the syntax tree are bytes of
    their line, and are turned into signs.
    """
    found = locators(content)
    name = locator if locator in found else None
    if name is None:
        ends = [n for n in found if n.endswith("." + locator)]
        if len(ends) != 1:
            return None
        name = ends[0]
    node, lines = found[name], content.splitlines(keepends=True)

    def at(line: int, column: int) -> int:
        return sum(map(len, lines[: line - 1])) + len(lines[line - 1].encode()[:column].decode("utf-8", "replace"))

    a, b = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
    return {"locator": name, "line_start": node.lineno, "line_end": node.end_lineno, "char_start": a, "char_end": b, "byte_start": len(content[:a].encode()), "byte_end": len(content[:b].encode())}


def edit(content: str, locator: str, old: str, new: str) -> str | None:
    """content with the only occurrence of old within the located span replaced; null if there is no such place, or several. A byte order
    mark at the beginning stays."""
    mark, body = ("\ufeff", content[1:]) if content and content[0] == "\ufeff" else ("", content or "")
    at = locate(body, locator)
    if at is None or not old:
        return None
    scope = body[at["char_start"] : at["char_end"]]
    if scope.count(old) != 1:
        return None
    return mark + body[: at["char_start"]] + scope.replace(old, new) + body[at["char_end"] :]


def edits(wanted: DataFrame) -> DataFrame:
    """wanted (path, content, locator, old, new) with the span found and the edited content, nulls where there is none. Files aren't written."""

    def run(frames):
        for f in frames:
            spots = [locate((c or "").removeprefix("\ufeff"), x or "") for c, x in zip(f.content, f.locator)]
            done = [edit(c, x or "", o or "", n or "") for c, x, o, n in zip(f.content, f.locator, f.old, f.new)]
            yield pd.DataFrame({"path": f.path, "locator": f.locator, **{k: pd.array([s and s[k] for s in spots], "Int64") for k in ("line_start", "line_end", "char_start", "char_end", "byte_start", "byte_end")}, "edited": done})

    return wanted.select("path", "content", "locator", "old", "new").mapInPandas(run, "path string, locator string, line_start long, line_end long, char_start long, char_end long, byte_start long, byte_end long, edited string")


def _window(low: int, high: int, focus: int, most: int) -> tuple[int, int]:
    """So many lines at most around the focus, within the bounds."""
    if high - low < most:
        return low, high
    a = max(low, focus - most // 2)
    b = min(high, a + most - 1)
    return max(low, b - most + 1), b


def snippet(path: str, content: str, terms: list[str], words: list[str], frames: list[tuple[str, int]], most: int, lines_at: tuple[int, int] | None = None) -> tuple[str, str]:
    """(label, numbered code): the symbol that terms and words speak for most, else around a frame's line, else the declared lines, else
    the head. frames: (path, line) of a trace; those of other files don't count."""
    name, lines = path.replace("\\", "/").rpartition("/")[2], (content or "").splitlines()
    if not lines:
        return f"{name}:0-0 (empty-file)", ""
    show = lambda a, b, why: (f"{name}:{a}-{b} ({why})", "\n".join(f"{i}: {lines[i - 1]}" for i in range(a, b + 1)))
    low, high = 1, len(lines)
    if lines_at:
        low, high = max(1, min(lines_at)), min(high, max(lines_at))
    inside = [(s, max(a, low), min(b, high)) for s, a, b in spans(content) if not lines_at or not (b < low or a > high)]
    best, top = None, 0
    for symbol, a, b in inside:
        own, value = symbol.lower(), 0
        for t in (x.lower() for x in terms):
            whole = t == own or t.endswith("." + own) or own.endswith("." + t)
            value += 10 if whole else 6 if t.rpartition(".")[2] == own.rpartition(".")[2] else 0
        value += sum(w in own for w in words)
        if value > top:
            best, top = (symbol, a, b), value
    if best:
        symbol, a, b = best
        size = b - a + 1
        pad = max(3, (min(most, max(12, size + 10)) - size) // 2)
        x, y = max(low, a - pad), min(high, b + pad)
        return show(*((x, y) if y - x < most else _window(low, high, a, most)), symbol)
    for file, line in frames:
        if (paths.match(path, file) or paths.match(name, file)) and low <= line <= high:
            return show(*_window(low, high, line, most), f"trace-line {line}")
    return show(low, min(high, low + most - 1), "declared-lines" if lines_at else "file-head")


def snippets(wanted: DataFrame) -> DataFrame:
    """wanted (query_id, node_id, path, content, terms, words, frames, line_start, line_end, most) as (query_id, node_id, label, code)."""

    def run(frames):
        for f in frames:
            rows = [snippet(r.path, r.content, list(r.terms), list(r.words), [(x["path"], int(x["line"])) for x in r.frames], int(r.most), None if pd.isna(r.line_start) else (int(r.line_start), int(r.line_end))) for r in f.itertuples()]
            yield pd.DataFrame({"query_id": f.query_id, "node_id": f.node_id, "label": [x for x, _ in rows], "code": [x for _, x in rows]})

    kinds = {x.name: x.dataType.simpleString() for x in wanted.schema}
    return wanted.mapInPandas(run, f"query_id {kinds['query_id']}, node_id {kinds['node_id']}, label string, code string")


def _each(sources: DataFrame, f, schema: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            rows = [(p, *r) for p, c in zip(frame.path, frame.content) for r in f(c)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in f"path string, {schema}".split(", ")])

    return sources.select("path", "content").mapInPandas(run, f"path string, {schema}")


def typed_references(sources: DataFrame) -> DataFrame:
    """(path, edge_type, target) of sources (path, content); null contents have none."""
    return _each(sources, references, "edge_type string, target string")


def migration_references(sources: DataFrame) -> DataFrame:
    return _each(sources, lambda c: [(m,) for m in migrations(c)], "target string")


def symbol_spans(sources: DataFrame) -> DataFrame:
    return _each(sources, spans, "symbol string, line_start long, line_end long")


def facts(sources: DataFrame) -> DataFrame:
    """sources (path, content) with (symbols, refs, migrations, spans, mods): all that syntax tells, read in one pass."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({
                "path": f.path, "symbols": [top_symbols(c) for c in f.content], "refs": [[{"edge_type": k, "target": t} for k, t in references(c)] for c in f.content], "migrations": [migrations(c) for c in f.content],
                "spans": [sorted({s.lower() for s, _, _ in spans(c)}) for c in f.content], "mods": [module_imports(c) for c in f.content],
            })

    return sources.select("path", "content").mapInPandas(run, "path string, symbols array<string>, refs array<struct<edge_type: string, target: string>>, migrations array<string>, spans array<string>, mods array<string>")
