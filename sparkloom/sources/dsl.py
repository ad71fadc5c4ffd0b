"""The graph language: read into rows, and written in canonical form. One document is one row of text; a job has many."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS = "record string, ord long, level int, name string, path string, x int, y int, w int, h int, src string, line_start int, line_end int, node_type string, states array<string>, dst string, kind string"
_FIELDS = [f.split()[0] for f in RECORDS.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([("graph_id", pa.string()), ("error", pa.string()), *((f.split()[0], _KINDS[f.split()[1]]) for f in RECORDS.split(", "))])
_BOX = r"\[\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\]"
_OPEN = re.compile(rf'@L(\d+)\s+([A-Za-z_][\w.]*)\s*{_BOX}\s*(?:"([^"\n]*)")?\s*\{{')
_NODE = re.compile(rf"([A-Za-z_][\w.]*)\s*{_BOX}")
_PART = re.compile(r'\s*(?:lines=(?P<a>\d+)\.\.(?P<b>\d+)|type:(?P<type>\w+)|\{(?P<states>[^{}\n]*)\}|"(?P<quoted>[^"\n]*)"|(?P<bare>[\w\-./*~]*[./*][\w\-./*~]*))')
_EDGE = re.compile(r"([A-Za-z_][\w.]*)\s*(->|~>)\s*([A-Za-z_][\w.]*)")
_EDGES = re.compile(r"===\s*edges\s*===")
_SKIP = re.compile(r"(?:[ \t\r\n]+|#[^\n]*)+")


class ParseError(ValueError):
    """What was found where it doesn't belong; line and col count from 1."""

    def __init__(self, what: str, text: str, at: int):
        self.line, self.col = text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{what} at {self.line}:{self.col}")


def parse(text: str) -> list[dict]:
    """Records of a document: its namespaces (one root), nodes in the order of their rows, and edges, pooled.

    After an edges block in a namespace only its end may follow.
    """
    out: list[dict] = []
    stack: list[str] = []
    at, rooted, in_edges, ords = 0, False, False, {"namespace": 0, "node": 0, "edge": 0}

    def emit(record: str, **fields) -> None:
        out.append({"record": record, "ord": ords[record], **fields})
        ords[record] += 1

    while True:
        if m := _SKIP.match(text, at):
            at = m.end()
        if at >= len(text):
            break
        if m := _EDGES.match(text, at):
            if not rooted:
                raise ParseError("edges before the root", text, at)
            in_edges = True
        elif in_edges and (m := _EDGE.match(text, at)):
            emit("edge", src=m[1], kind=m[2], dst=m[3])
        elif text[at] == "}" and stack:
            stack.pop()
            in_edges = False
            at += 1
            continue
        elif not in_edges and (m := _OPEN.match(text, at)) and (stack or not rooted):
            rooted = True
            stack.append(f"{stack[-1]}.{m[2]}" if stack else m[2])
            emit("namespace", level=int(m[1]), name=m[2], path=stack[-1], **dict(zip("xywh", map(int, m.group(3, 4, 5, 6)))), src=m[7])
        elif not in_edges and stack and (m := _NODE.match(text, at)):
            node = {"name": m[1], "path": stack[-1], "states": [], "node_type": "code", **dict(zip("xywh", map(int, m.group(2, 3, 4, 5))))}
            end = m.end()
            while p := _PART.match(text, end):
                if "\n" in text[end : p.start() + len(p[0]) - len(p[0].lstrip())]:
                    break
                if p["a"]:
                    node |= {"line_start": int(p["a"]), "line_end": int(p["b"])}
                elif p["type"]:
                    node["node_type"] = p["type"]
                elif p["states"] is not None:
                    node["states"] = [s for s in re.split(r"\s*(?:->|~>)\s*", p["states"].strip()) if s]
                    if not node["states"]:
                        raise ParseError("a machine without states", text, end)
                else:
                    node["src"] = p["quoted"] if p["quoted"] is not None else p["bare"]
                end = p.end()
            emit("node", **node)
            newline = text.find("\n", end)
            at = len(text) if newline < 0 else newline
            if "}" in text[end:at]:
                at = end + text[end:at].index("}")
            continue
        else:
            raise ParseError(f"unexpected {text[at : at + 12]!r}", text, at)
        at = m.end()
    if stack or not rooted:
        raise ParseError("the document ends too early", text, len(text))
    return out


def serialize(records: list[dict]) -> str:
    """The canonical text: nodes and namespaces by y, x, name, edges by their ends and kind. Types other than code are kept."""
    box = lambda r: f"[{r['x']},{r['y']},{r['w']},{r['h']}]"
    place = lambda r: (r["y"], r["x"], r["name"])
    have = lambda r, k: r.get(k) is not None and r.get(k) == r.get(k)
    spaces = [r for r in records if r["record"] == "namespace"]
    nodes: dict[str, list[dict]] = {}
    for r in records:
        if r["record"] == "node":
            nodes.setdefault(r["path"], []).append(r)
    lines: list[str] = []

    def write(space: dict, depth: int) -> None:
        pad = "  " * depth
        glob = f' "{space["src"]}"' if have(space, "src") and space["src"] else ""
        lines.append(f"{pad}@L{int(space['level'])} {space['name']} {box(space)}{glob} {{")
        for n in sorted(nodes.get(space["path"], []), key=place):
            row = [n["name"], box(n)]
            if have(n, "src") and n["src"]:
                row.append(f'"{n["src"]}"' if re.search(r"[ \t]", n["src"]) or not re.fullmatch(r"[\w\-./*~]*[./*][\w\-./*~]*", n["src"]) else n["src"])
            if have(n, "line_start"):
                row.append(f"lines={int(n['line_start'])}..{int(n['line_end'])}")
            if have(n, "node_type") and n["node_type"] != "code":
                row.append(f"type:{n['node_type']}")
            if n.get("states") is not None and len(n["states"]):
                row.append("{" + " -> ".join(n["states"]) + "}")
            lines.append(f"{pad}  {' '.join(row)}")
        for child in sorted((s for s in spaces if s["path"].rpartition(".")[0] == space["path"] and s["path"] != space["path"]), key=place):
            write(child, depth + 1)
        lines.append(pad + "}")

    for root in (s for s in spaces if "." not in s["path"]):
        write(root, 0)
    edges = sorted((r["src"], r["dst"], r["kind"]) for r in records if r["record"] == "edge")
    if edges:
        lines += ["=== edges ===", *(f"{a} {k} {b}" for a, b, k in edges)]
    return "\n".join(lines) + "\n"


def records(docs: DataFrame) -> DataFrame:
    """(graph_id, error, RECORDS) of docs (graph_id, text): a row for each record, or one with the error of a text that doesn't parse.

    A null text is such an error.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for graph, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [{"graph_id": graph, "error": None, **r} for r in parse(text)]
                except (ParseError, TypeError) as e:
                    rows.append({"graph_id": graph, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return docs.select("graph_id", "text").mapInArrow(run, f"graph_id string, error string, {RECORDS}")


def texts(found: DataFrame) -> DataFrame:
    """(graph_id, text): the canonical text of each graph's records."""

    def run(table):
        rows = table.to_pylist()
        return pa.table({"graph_id": pa.array([rows[0]["graph_id"]], pa.string()), "text": [serialize(rows)]})

    return found.filter("error is null").groupBy("graph_id").applyInArrow(run, "graph_id string, text string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all graph files below path; graph_id is the file."""
    return records(spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("graph_id"), F.col("value").alias("text")))


class GraphSource(DataSource):
    """spark.read.format("loomgraph").load(folder): the records of the graph files of a folder that all workers see."""

    @classmethod
    def name(cls) -> str:
        return "loomgraph"

    def schema(self) -> str:
        return f"graph_id string, error string, {RECORDS}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from .code import files_below

        return [InputPartition(n) for n in files_below(self.path, list)[2]]

    def read(self, partition):
        from .code import place

        system, root = place(self.path)
        name = f"{root}/{partition.value}"
        with system.open_input_stream(name) as f:
            text = f.readall().decode("utf-8-sig", "replace")
        try:
            for r in parse(text):
                yield (name, None, *[r.get(k) for k in _FIELDS])
        except ParseError as e:
            yield (name, str(e), *[None] * len(_FIELDS))
