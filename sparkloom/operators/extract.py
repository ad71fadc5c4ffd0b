"""From source files to a graph: namespaces, named nodes on a grid, typed edges resolved by modules and symbols, ranks.

files: (path, content). Folders and files follow by depth, then path, as do first writers of a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.lineage import written
from ..sources import code, dsl
from . import graph, layout

COLUMNS, WIDTH = 5, 100


def _depth(folder: Column) -> Column:
    return F.when(folder == ".", 0).otherwise(F.size(F.split(folder, "/")))


def namespaces(files: DataFrame, root: str = "App") -> DataFrame:
    """(folder, ns, x, y, w, h, glob) of every folder with files: up to five columns, boxes in rows of 40."""
    named = layout.namespaces(files, "path", root).withColumn("one", F.lit(1))
    # Folders are far fewer than files; ranks over ranges of depth would save nothing here.
    order = Window.partitionBy("one").orderBy(_depth(F.col("folder")), "folder")
    n = F.row_number().over(order) - 1
    cols = F.greatest(F.lit(1), F.least(F.lit(COLUMNS), F.count("*").over(Window.partitionBy("one"))))
    placed = named.withColumns({"i": n, "cols": cols}).withColumn("step", F.floor(F.lit(WIDTH) / F.col("cols")).cast("int"))
    glob = F.when(F.col("folder") == ".", "*.py").otherwise(F.concat("folder", F.lit("/*.py")))
    return placed.select("folder", F.col("name").alias("ns"), (F.col("i") % F.col("cols") * F.col("step") + 1).cast("int").alias("x"), (F.floor(F.col("i") / F.col("cols")) * 40 + 1).cast("int").alias("y"), (F.col("step") - 2).cast("int").alias("w"), F.lit(38).alias("h"), glob.alias("glob"))


def nodes(files: DataFrame, spaces: DataFrame, root: str = "App") -> DataFrame:
    """(path, folder, ns, name, fqn, kind, loc, line_start, line_end, x, y, w, h) of admitted files; a later file of a name in its folder
    carries its number there."""
    own = files.withColumns({"folder": paths.cluster(F.col("path")), "loc": code.line_count(F.col("content"))}).filter(paths.admitted(F.col("path"), F.col("loc"))).select("path", "folder", "loc")
    folder = Window.partitionBy("folder").orderBy("path")
    own = own.withColumns({"j": F.row_number().over(folder) - 1, "files": F.count("*").over(Window.partitionBy("folder")), "base": paths.camel(F.col("path"))})
    again = F.row_number().over(Window.partitionBy("folder", "base").orderBy("path")) > 1
    own = own.withColumn("name", F.when(again, F.concat("base", F.col("j").cast("string"))).otherwise(F.col("base"))).join(spaces.select("folder", "ns", F.col("w").alias("nw")), "folder")
    cols = F.least(F.lit(3), F.col("files"))
    own = own.withColumns({"cols": cols, "w": F.greatest(F.lit(8), F.floor((F.col("nw") - 2) / cols) - 1).cast("int")})
    return own.select("path", "folder", "ns", "name", F.concat_ws(".", F.lit(root), "ns", "name").alias("fqn"), paths.kind(F.col("path"), F.col("loc")).alias("kind"), "loc", F.lit(1).alias("line_start"), F.greatest(F.lit(1), F.col("loc")).cast("int").alias("line_end"), (F.col("j") % F.col("cols") * (F.col("w") + 1) + 1).cast("int").alias("x"), (F.floor(F.col("j") / F.col("cols")) * 5 + 1).cast("int").alias("y"), "w", F.lit(4).alias("h"))


def _first(rows: DataFrame, key: str) -> DataFrame:
    """(key, file): the first file of each key by depth and path."""
    folder = paths.cluster(F.col("path"))
    return rows.groupBy(key).agg(F.min_by("path", F.struct(_depth(folder), folder, "path")).alias("file"))


def modules(files: DataFrame) -> DataFrame:
    """(key, file): dotted paths and last parts of files that aren't package files."""
    plain = files.select("path").filter(paths.base(F.col("path")) != "__init__.py")
    dotted = F.translate(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    return _first(plain.select("path", F.explode(F.array_distinct(F.array(dotted, F.element_at(F.split(dotted, r"\."), -1)))).alias("key")), "key")


def owners(facts: DataFrame) -> DataFrame:
    """(key, file): the first file that has the symbol."""
    return _first(facts.select("path", F.explode("symbols").alias("key")), "key")


def resolve(refs: DataFrame, mods: DataFrame, syms: DataFrame) -> DataFrame:
    """refs (path, edge_type, target) with file: the module that the target names, else (bases and calls) the owner of its last part,
    else the module of its longest dotted head. A file's own references are left out."""
    parts = F.split("target", r"\.")
    heads = refs.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("n", "key"))
    one = heads.join(mods, "key").select("path", "edge_type", "target", "file", F.when(F.col("key") == F.col("target"), 0).otherwise(2).alias("rank"), (-F.col("n")).alias("n"))
    two = refs.filter(F.col("edge_type").isin("inherit", "call")).withColumn("key", F.element_at(parts, -1)).join(syms, "key").select("path", "edge_type", "target", "file", F.lit(1).alias("rank"), F.lit(0).alias("n"))
    best = one.unionByName(two).groupBy("path", "edge_type", "target").agg(F.min(F.struct("rank", "n", "file")).alias("m"))
    return best.select("path", "edge_type", "target", F.col("m.file").alias("file")).filter("file <> path")


def either(refs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """refs (path, key) with the file of the first table, else of the second; own ones are left out."""
    one, two = first.withColumnRenamed("file", "__a"), second.withColumnRenamed("file", "__b")
    return refs.join(one, "key", "left").join(two, "key", "left").withColumn("file", F.coalesce("__a", "__b")).filter("file is not null and file <> path").select("path", "key", "file")


def file_edges(files: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    """(edge_type, path, file): imports, inherits, calls and literals; migration-of (exact names only); test-of by the file's stem."""
    facts = facts.join(found.select("path", "kind"), "path")
    mods, syms = written(modules(files)), written(owners(facts))
    typed = resolve(facts.select("path", F.inline("refs")), mods, syms).select("edge_type", "path", "file")
    moved = either(facts.filter("kind = 'migration'").select("path", F.explode("migrations").alias("key")), mods, syms).select(F.lit("migration-of").alias("edge_type"), "path", "file")
    tests = facts.filter(paths.base(F.col("path")).startswith("test_") | F.contains(F.concat(F.lit("/"), "path"), F.lit("/tests/"))).select("path", F.regexp_replace(paths.stem(F.col("path")), "^test_", "").alias("key"))
    tested = either(tests, syms, mods).select(F.lit("test-of").alias("edge_type"), "path", "file")
    return typed.unionByName(moved).unionByName(tested).join(found.select(F.col("path").alias("file")), "file", "left_semi").distinct()


def named_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(edge_type, src, dst) between short names, each once; edges between nodes of one name are left out."""
    name = found.select("path", "name")
    return edges.join(name.withColumnRenamed("name", "src"), "path").join(name.toDF("file", "dst"), "file").filter("src <> dst").select("edge_type", "src", "dst").distinct()


def qualified(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(edge_type, src, dst) by fqn: of several nodes of a short name the first in the order of folders and files."""
    first = found.groupBy("name").agg(F.min_by("fqn", F.struct(_depth(F.col("folder")), "folder", "path")).alias("fqn"))
    return edges.join(first.toDF("src", "__s"), "src").join(first.toDF("dst", "__d"), "dst").select("edge_type", F.col("__s").alias("src"), F.col("__d").alias("dst"))


def metadata(found: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(fqn, kind, symbols, loc, pagerank, cluster, cluster_size) of the nodes; edges: qualified. Tests pass their rank on from what they test."""
    turned = F.col("edge_type") == "test-of"
    flow = edges.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), graph.prior(F.col("edge_type")).alias("weight"))
    ranks = graph.pagerank(found.select(F.col("fqn").alias("node")), flow)
    sizes = found.groupBy("folder").agg(F.count("*").alias("cluster_size"))
    return found.join(facts.select("path", "symbols"), "path").join(sizes, "folder").join(ranks, F.col("fqn") == F.col("node")).select("fqn", "kind", "symbols", "loc", F.col("rank").alias("pagerank"), F.col("folder").alias("cluster"), "cluster_size")


def generate(files: DataFrame, root: str = "App", fast: bool = False) -> dict[str, DataFrame]:
    """The graph of the files: namespaces, nodes, edges (short names), typed (by fqn), meta, and records of the graph language.

    fast: imports only, as lines show them. No files give a root without anything in it.
    """
    files = files.select("path", "content")
    facts = code.facts(files)
    if fast:
        plain = files.select("path", F.transform(code.imports(F.col("content")), lambda m: F.struct(F.lit("import").alias("edge_type"), m.alias("target"))).alias("refs"))
        facts = facts.drop("refs").join(plain, "path")
    facts = written(facts)
    spaces = written(namespaces(files, root))
    found = written(nodes(files, spaces, root))
    edges = written(named_edges(file_edges(files, facts, found), found))
    typed = written(qualified(edges, found))
    return {"namespaces": spaces, "nodes": found, "edges": edges, "typed": typed, "facts": facts, "meta": metadata(found, facts, typed), "records": records(spaces, found, edges, root)}


def records(spaces: DataFrame, found: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Rows as sources.dsl has them, of one graph: the root, its namespaces, their nodes, and an edge for each pair but those of tests."""
    spark = spaces.sparkSession
    box = ["x", "y", "w", "h"]
    top = spark.createDataFrame([("namespace", 0, root, root, 0, 0, 100, 100)], "record string, level int, name string, path string, x int, y int, w int, h int")
    own = spaces.select(F.lit("namespace").alias("record"), F.lit(1).alias("level"), F.col("ns").alias("name"), F.concat(F.lit(f"{root}."), "ns").alias("path"), *box, F.col("glob").alias("src"))
    rows = found.select(F.lit("node").alias("record"), "name", F.concat(F.lit(f"{root}."), "ns").alias("path"), *box, F.col("path").alias("src"), "line_start", "line_end", F.lit("code").alias("node_type"))
    flat = edges.filter("edge_type <> 'test-of'").select("src", "dst").distinct().select(F.lit("edge").alias("record"), "src", "dst", F.lit("->").alias("kind"))
    out = top
    for part in (own, rows, flat):
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.withColumns({"graph_id": F.lit(root), "error": F.lit(None).cast("string"), "states": F.lit(None).cast("array<string>"), "ord": F.monotonically_increasing_id()})
    return out.select("graph_id", "error", *[f.split()[0] for f in dsl.RECORDS.split(", ")])


def sidecar(meta: DataFrame, typed: DataFrame) -> DataFrame:
    """One row of JSON (value): version, nodes, edges_by_type, edge_priors, cluster_size. The document is one value, as readers want it;
    at scale keep meta and typed as tables."""
    item = F.struct("fqn", "kind", "symbols", "loc", "pagerank", "cluster")
    body = meta.agg(F.array_sort(F.collect_list(item)).alias("nodes"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("cluster", "cluster_size")))).alias("cluster_size"))
    pairs = typed.groupBy("edge_type").agg(F.array_sort(F.collect_list(F.array("src", "dst"))).alias("pairs")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "pairs")))).alias("edges_by_type"))
    priors = F.create_map(*[x for k, v in sorted(graph.PRIORS.items()) for x in (F.lit(k), F.lit(v))])
    return body.crossJoin(pairs).select(F.to_json(F.struct(F.lit(3).alias("version"), "nodes", "edges_by_type", priors.alias("edge_priors"), "cluster_size")).alias("value"))


def read_sidecar(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meta, typed) of sidecars (value); texts that are no JSON have nothing. Nodes lack what theirs lacks, but for defaults."""
    schema = "version int, nodes array<struct<fqn: string, kind: string, symbols: array<string>, loc: long, pagerank: double, cluster: string>>, edges_by_type map<string, array<array<string>>>, edge_priors map<string, double>, cluster_size map<string, long>"
    read = texts.select(F.from_json("value", schema).alias("j"))
    own = read.select(F.explode("j.nodes").alias("n"), F.col("j.cluster_size").alias("sizes"))
    meta = own.select("n.fqn", F.coalesce("n.kind", F.lit("normal")).alias("kind"), F.coalesce("n.symbols", F.array().cast("array<string>")).alias("symbols"), F.coalesce("n.loc", F.lit(0)).alias("loc"), F.coalesce("n.pagerank", F.lit(0.0)).alias("pagerank"), F.coalesce("n.cluster", F.lit("")).alias("cluster"), F.try_element_at("sizes", F.coalesce("n.cluster", F.lit(""))).alias("cluster_size"))
    typed = read.select(F.explode("j.edges_by_type").alias("edge_type", "pairs")).select("edge_type", F.explode("pairs").alias("p")).select("edge_type", F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))
    return meta, typed
