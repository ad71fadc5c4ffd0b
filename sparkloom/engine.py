"""One method for each thing that can be asked of a code graph; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.lineage import written
from .operators import extract, graph, rank, rank_v1, select, state, verify
from .sources import code, dsl, inputs


class GraphEngine:
    """A graph of source files, made from them (init) or read from the graph language (load), and what it can be asked.

    Graphs and files are tables; nodes are named by their fqn, by a dotted end of it, or by a name that only one has.
    """

    def __init__(self, spark: SparkSession, root: str = "App"):
        self.spark, self.root = spark, root
        self.files = self.meta = self.typed = self.records = None

    # --- making and reading

    def init(self, path: str | None = None, files: DataFrame | None = None, fast: bool = False, ignore: list[str] | None = None) -> DataFrame:
        """Records of the graph of a folder's sources, or of files (path, content)."""
        self.files = written((code.scan(self.spark, path, ignore) if files is None else files).select("path", "content"))
        made = extract.generate(self.files, self.root, fast)
        self.records, self.meta, self.typed, self.facts = written(made["records"]), written(made["meta"]), made["typed"], made["facts"]
        return self.records

    def load(self, path: str | None = None, graph_text: str | None = None, sidecar: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
        """Records of a graph file or text, with metadata of its sidecar (value) if there is one. A text that doesn't parse raises."""
        docs = self.spark.createDataFrame([(self.root, inputs.read_text(path) if graph_text is None else graph_text)], "graph_id string, text string")
        self.records = written(dsl.records(docs))
        wrong = self.records.filter("error is not null").select("error").first()
        if wrong:
            raise ValueError(wrong[0])
        self.meta = self.typed = None
        if sidecar is not None:
            self.meta, self.typed = extract.read_sidecar(sidecar)
        self.files, self.facts = (None, None) if files is None else (files, written(code.facts(files)))
        return self.records

    parse = load

    def text(self) -> DataFrame:
        """(graph_id, text): the graph in the graph language."""
        return dsl.texts(self.records)

    def sidecar(self) -> DataFrame:
        return extract.sidecar(self.meta, self.typed)

    # --- nodes and edges

    def nodes(self) -> DataFrame:
        """(fqn, name, ns_path, src_path, line_start, line_end, node_type, node_ord)."""
        own = self.records.filter("record = 'node'")
        return own.select(F.concat_ws(".", "path", "name").alias("fqn"), "name", F.col("path").alias("ns_path"), F.col("src").alias("src_path"), "line_start", "line_end", "node_type", F.coalesce("ord", F.lit(0)).alias("node_ord"))

    def edges(self) -> DataFrame:
        """(src, dst) by fqn, of names that only one node has, and of fqns."""
        ends = self.records.filter("record = 'edge'").select("src", "dst")
        return ends.select(F.col("src").alias("__s"), F.col("dst").alias("__d")).join(self._names().toDF("__s", "src"), "__s").join(self._names().toDF("__d", "dst"), "__d").select("src", "dst")

    def _names(self) -> DataFrame:
        n = self.nodes()
        return n.select("name", "fqn").unionByName(n.select(F.col("fqn").alias("name"), "fqn")).distinct()

    def find(self, target: str) -> str:
        """The fqn that a reference means; KeyError if there is none."""
        ref = self.spark.createDataFrame([(target,)], "ref string")
        row = (graph.find_dotted if "." in target else graph.find_bare)(self.nodes(), ref).first()
        if row is None or row["fqn"] is None:
            raise KeyError(f"no node {target}")
        return row["fqn"]

    def neighbours(self, target: str, hops: int = 1, direction: str = "both") -> DataFrame:
        """(fqn, hop) within so many hops, the target with 0."""
        seed = self.spark.createDataFrame([(self.find(target),)], "seed string")
        return graph.khop(self.edges(), seed, hops, direction).select(F.col("node").alias("fqn"), "hop")

    def deps(self, target: str, hops: int = 1) -> DataFrame:
        """Nodes that the target leads to, without itself."""
        return self.neighbours(target, hops, "out").filter("hop > 0")

    def callers(self, target: str, hops: int = 1) -> DataFrame:
        return self.neighbours(target, hops, "in").filter("hop > 0")

    def query(self, target: str, hops: int = 1, direction: str = "both", bounds: bool = True) -> DataFrame:
        """Records of the slice around the target: the nodes, the namespaces above them, and the edges between them; without bounds,
        namespaces have empty boxes."""
        near = written(self.neighbours(target, hops, direction).select("fqn"))
        nodes = self.records.filter("record = 'node'").withColumn("fqn", F.concat_ws(".", "path", "name")).join(near, "fqn", "left_semi").drop("fqn")
        above = graph.ancestors(nodes.select("path").distinct(), "path").select(F.col("ancestor").alias("path")).distinct()
        spaces = self.records.filter("record = 'namespace'").join(above, "path", "left_semi").select(*self.records.columns)
        if not bounds:
            spaces = spaces.withColumns({c: F.lit(0) for c in ("x", "y", "w", "h")})
        names = near.join(self.nodes(), "fqn").select(F.explode(F.array("fqn", "name")).alias("n")).distinct()
        edges = self.records.filter("record = 'edge'").join(names.select(F.col("n").alias("src")), "src", "left_semi").join(names.select(F.col("n").alias("dst")), "dst", "left_semi").select(*self.records.columns)
        return spaces.unionByName(nodes.select(*self.records.columns)).unionByName(edges)

    def graph(self) -> DataFrame:
        """Records of the graph after a way through its replicated state."""
        return state.records_of(state.log_of(self.records, "a"), self.root)

    def boxes(self) -> DataFrame:
        return state.boxes(self.records)

    def verify(self) -> DataFrame:
        """Missing, ghost and unresolved edges against what the files import."""
        declared = self.records.filter("record = 'edge' and kind = '->'").select("src", "dst")
        imports = self.facts.select("path", F.explode("mods").alias("mod"))
        return verify.verify(self.nodes().withColumnRenamed("node_ord", "ord"), declared, imports, self.files.select("path"))

    # --- ranking

    def _ranked(self) -> DataFrame:
        nodes = self.nodes().select(F.col("fqn").alias("node_id"), F.col("src_path").alias("path"), "name", "line_start", "line_end")
        if self.meta is None:
            known = self.spark.createDataFrame([], "node_id string, kind string, symbols array<string>, pr double, calls long, inherits long, cluster string")
        else:
            degrees = graph.in_degrees(self.typed).withColumnRenamed("node", "node_id")
            known = self.meta.select(F.col("fqn").alias("node_id"), "kind", "symbols", F.col("pagerank").alias("pr"), "cluster").join(degrees, "node_id", "left").fillna(0, ["calls", "inherits"])
        return rank.with_defaults(nodes, known)

    def _places(self, issues: DataFrame, weights: dict) -> tuple[DataFrame, float]:
        nodes = written(self._ranked())
        cap = graph.rank_cap(nodes.select(F.col("pr").alias("rank"))).first()[0]
        return written(select.ordered(rank.scored(rank.signals(nodes, issues, cap), cap, weights["betas"]))), cap

    def locate(self, issues: DataFrame, topk: int = 3, config: str | None = None) -> DataFrame:
        """(query_id, place, node_id, path, score, confidence, low_margin, reasons): the best nodes for issues (query_id, text)."""
        w = inputs.weights(config)
        places, cap = self._places(issues, w)
        found = written(rank.anchors(places.drop("place"), w["topk"], w["temperature"], w["margin"]))
        told = found.groupBy("query_id").agg(F.first("confidence").alias("confidence"), F.first("low_margin").alias("low_margin"), F.count("*").alias("n"))
        return places.join(told, "query_id").filter(F.col("place") <= F.greatest(F.lit(topk), "n")).select("query_id", "place", "node_id", "path", F.round("score", 4).alias("score"), "confidence", "low_margin", rank.reasons(cap).alias("reasons"))

    def blast(self, issues: DataFrame, preset: str = "test-fix", scoring: str | None = None) -> DataFrame:
        """(query_id, node_id, phase, ord) of what to read for issues (query_id, text): by the second ranker if there are metadata, else by the
        first; scoring ("v1" or "v2") decides otherwise."""
        p = text.preset(F.col("text"), preset)
        limits = written(issues.select("query_id", "text", p.alias("preset"), select.preset_value(p, 0).alias("most"), select.preset_value(p, 2).alias("hops")))
        if (scoring or ("v2" if self.meta is not None else "v1")) == "v1":
            return rank_v1.bundle(self._old(), written(rank_v1.scores(self._old(), issues)), self.edges(), limits).select("query_id", "node_id", "phase", "ord")
        places, _ = self._places(issues, inputs.weights())
        found = written(rank.anchors(places.drop("place")))
        edges = self.typed if self.typed is not None else self.edges().withColumn("edge_type", F.lit("import"))
        return select.bundle(places, found, select.facts_of(places, found, limits), written(edges))

    def summary(self, issues: DataFrame, preset: str = "test-fix") -> DataFrame:
        """One row for each issue: its bundle's anchor, files, omissions, warnings and reasons; see operators.select.summary."""
        places, cap = self._places(issues, inputs.weights())
        found = written(rank.anchors(places.drop("place")))
        told = issues.select("query_id", "text", text.preset(F.col("text"), preset).alias("preset"))
        return select.summary(places, self.blast(issues, preset, "v2"), found, told, self.files.select("path"), cap)

    def snippets(self, issues: DataFrame, chosen: DataFrame, lines: int = 120) -> DataFrame:
        """(query_id, node_id, label, code): what to show of each chosen node's file."""
        t = F.col("text")
        read = issues.select("query_id", text.issue_terms(t).alias("terms"), text.keywords(t).alias("words"), F.transform(text.trace_frames(t), lambda f: F.struct(f["path"].alias("path"), f["line"].alias("line"))).alias("frames"))
        placed = inputs.resolve(self.nodes().select(F.col("fqn").alias("node_id"), "src_path", "line_start", "line_end"), self.files)
        own = chosen.select("query_id", "node_id").join(placed, "node_id").join(self.files, F.col("file") == F.col("path")).join(read, "query_id")
        return code.snippets(own.select("query_id", "node_id", "path", "content", "terms", "words", "frames", "line_start", "line_end", F.lit(lines).alias("most")))

    def expand(self, target: str, hops: int = 1, most: int = 10) -> DataFrame:
        """(seed, node, weight, place): the neighbourhood of a node by the weight of direct typed edges."""
        seed = self.spark.createDataFrame([(self.find(target),)], "seed string")
        ranks = self.meta.select(F.col("fqn").alias("node"), F.col("pagerank").alias("rank"))
        return graph.expand(self.typed, ranks, seed, hops, most)

    def _old(self) -> DataFrame:
        n = inputs.resolve(self.nodes(), self.files) if self.files is not None else self.nodes().withColumn("file", F.lit(None).cast("string"))
        spans = self.facts.select("path", "spans") if self.facts is not None else self.spark.createDataFrame([], "path string, spans array<string>")
        return n.join(spans, F.col("file") == F.col("path"), "left").select(F.col("fqn").alias("node_id"), F.col("src_path").alias("path"), "name", "ns_path", "node_type", "line_start", "line_end", "spans")

    def anchor(self, issues: DataFrame, most: int = 6) -> DataFrame:
        """(query_id, role, node_id, path, line, score, ord): where a trace begins, and what is around it."""
        old = written(self._old())
        return rank_v1.report(old, written(rank_v1.scores(old, issues)), self.edges(), issues, most)

    def edit(self, wanted: DataFrame) -> DataFrame:
        """wanted (path, locator, old, new) with the edited contents; files aren't written."""
        return code.edits(wanted.join(self.files, "path"))

    # --- texts

    @staticmethod
    def as_json(rows: DataFrame) -> DataFrame:
        """(value) of any result, a row of JSON each."""
        return rows.select(F.to_json(F.struct("*")).alias("value"))

    @staticmethod
    def as_markdown(summary: DataFrame, snippets: DataFrame) -> DataFrame:
        """(query_id, value): a bundle as a Markdown text, its snippets in the order of its nodes."""
        shown = snippets.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.struct("label", "code")))).alias("by"))
        code_ = F.filter(F.transform("nodes", lambda n: F.try_element_at("by", n)), lambda s: s.isNotNull())
        facts = {"Preset": "preset", "Anchor": "anchor", "Anchor file": "anchor_file", "Confidence": "confidence", "Tokens": "token_estimate", "Omitted nodes": "omitted_nodes", "Omitted files": "omitted_files"}
        lines = F.array(F.lit("# Bundle"), F.lit(""), *[F.concat(F.lit(f"- {k}: "), F.coalesce(F.col(v).cast("string"), F.lit("")), F.lit("")) for k, v in facts.items()], F.lit(""), F.lit("## Reasons"))
        parts = F.concat(lines, F.transform("reasons", lambda r: F.concat(F.lit("- "), r)), F.transform("warnings", lambda w: F.concat(F.lit("- warning: "), w)), F.array(F.lit(""), F.lit("## Snippets")), F.flatten(F.transform(code_, lambda s: F.array(F.lit(""), F.concat(F.lit("### "), s["label"]), F.lit("```python"), s["code"], F.lit("```")))))
        return summary.join(shown, "query_id", "left").select("query_id", F.array_join(parts, "\n").alias("value"))
