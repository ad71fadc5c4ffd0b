"""The additive ranker of the first generation, its bundles, and reports of anchors around a trace.

nodes: node_id, path, name, ns_path, node_type, line_start, line_end, spans (lower-cased symbols of the file, methods with and
without their classes; null where there is no file). queries: query_id, text. Equal scores follow by node_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.lineage import few, product_tasks, written
from . import graph

SETTINGS = sorted("upload permission permissions env environ settings default config configuration".split())
TEST_INFRA = sorted("testcase test_runner runtests pytest unittest".split() + ["test suite", "test framework"])
SIBLINGS, SIBLING_SCORE = 2, 5


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def _ends(a: Column, b: Column) -> Column:
    return F.endswith(a, F.concat(F.lit("."), b))


def scores(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, path, name, line_start, line_end, score, reasons) of every pair with a positive score.

    The product of nodes and queries is what is asked for; the side of the queries is read into every task. reasons: one label
    for each kind of evidence, in a fixed order.
    """
    t = F.col("text")
    q = queries.withColumns({"low": F.lower(t), "terms": text.issue_terms(t), "words": text.keywords(t), "frames": text.trace_frames(t)})
    lows = F.transform("terms", F.lower)
    q = q.withColumns({"lows": lows, "pys": F.transform(F.filter(lows, lambda x: F.endswith(x, F.lit(".py"))), paths.base), "symbols_": F.filter(lows, lambda x: F.contains(x, F.lit(".")) & ~F.endswith(x, F.lit(".py"))), "config": F.arrays_overlap("words", text.strings(SETTINGS)), "infra": F.exists(text.strings(TEST_INFRA), lambda x: F.contains(F.lower(t), x))})
    # Whatever a text or a node alone tells is told before they meet.
    f_path = lambda f: F.lower(F.translate(f["path"], "\\", "/"))
    tail = lambda x: F.element_at(F.split(x, r"\."), -1)
    called = lambda f: F.lower(f["symbol"])
    q = q.withColumns({
        "frames": F.transform("frames", lambda f: F.struct(f_path(f).alias("path"), paths.base(f_path(f)).alias("base"), paths.stem(f_path(f)).alias("stem"), f["line"].alias("line"), called(f).alias("symbol"), tail(called(f)).alias("tail"))),
        "lows": F.transform("lows", lambda x: F.struct(x.alias("x"), tail(x).alias("tail"), paths.base(x).alias("base"), F.contains(x, F.lit("/")).alias("slash"))),
        "symbols_": F.transform("symbols_", lambda x: F.struct(x.alias("symbol"), tail(x).alias("tail"))),
    })
    q = written(q.drop("text", "terms"))
    n = nodes.withColumns({"p": F.lower(F.coalesce("path", F.lit(""))), "n": F.lower("name"), "ns": F.lower("ns_path"), "k": F.coalesce("spans", F.array().cast("array<string>")), "filed": F.col("spans").isNotNull()}).withColumns({"b": paths.base(F.col("p")), "st": paths.stem(F.col("p")), "x": F.translate("p", "\\", "/")}).withColumns({"xb": paths.base(F.col("x")), "xs": paths.stem(F.col("x"))})
    p, b, name, low, keys = (F.col(c) for c in ("p", "b", "n", "low", "k"))
    x = F.col("x")
    hit = lambda f: F.when(p == "", 0).when(F.endswith(x, f["path"]) | F.endswith(f["path"], x), 18).when(F.col("xb") == f["base"], 12).when(F.col("xs") == f["stem"], 8).otherwise(0)
    inside = lambda f: f["line"].between(F.col("line_start"), F.col("line_end"))
    add = lambda values, f: F.aggregate(values, F.lit(0), lambda acc, x: acc + f(x))
    in_keys = lambda x, whole, part: F.when(F.array_contains(keys, x["symbol"]), whole).when(F.array_contains(keys, x["tail"]), part).otherwise(0)
    traced = (F.size("symbols_") > 0) & F.col("filed")
    evidence = {
        "config": F.when(F.col("config") & (b.isin("settings.py", "global_settings.py", "__init__.py", "config.py") | F.contains(p, F.lit("conf/")) | F.coalesce(F.col("node_type") == "config", F.lit(False))), 50).otherwise(0),
        "stem": F.when((p != "") & F.contains(low, F.col("st")), 8).otherwise(0),
        "file": F.when(F.contains(low, b), 8).otherwise(0),
        "trace": add("frames", lambda f: hit(f) + F.when((hit(f) > 0) & inside(f), 24).otherwise(0)),
        "trace-symbol": add("frames", lambda f: F.when((f["symbol"] != "") & ((f["symbol"] == name) | _ends(f["symbol"], name) | _ends(name, f["symbol"])), 10).otherwise(0)),
        "path-term": 12 * _count(F.col("pys"), lambda x: x == b),
        "name": F.when(F.contains(low, name), 8).otherwise(0),
        "exact-path": 12 * _count(F.col("lows"), lambda x: x["slash"] & (F.endswith(p, x["x"]) | (x["base"] == b))),
        "exact-symbol": 10 * _count(F.col("lows"), lambda x: (x["x"] == name) | _ends(x["x"], name)),
        "tail": 6 * _count(F.col("lows"), lambda x: x["tail"] == name),
        "path-tail": 6 * _count(F.col("lows"), lambda x: F.contains(p, x["tail"])),
        "syntax-symbol": F.when(traced, add("symbols_", lambda x: in_keys(x, 30, 20))).otherwise(0),
        "syntax-trace": F.when(traced, add("frames", lambda f: F.when(f["symbol"] == "", 0).otherwise(in_keys(f, 20, 12)))).otherwise(0),
        "keyword": add("words", lambda w: F.when(F.contains(name, w), 3).otherwise(0) + F.when(F.contains(p, w), 3).otherwise(0) + F.when(F.contains(F.col("ns"), w), 1).otherwise(0)),
    }
    made = {f"e_{i}": v for i, v in enumerate(evidence.values())}
    total = sum((F.col(c) for c in made), F.lit(0))
    held = (F.col("total") > 0) & F.contains(F.translate(p, "\\", "/"), F.lit("tests/")) & ~F.col("infra")
    tasks = product_tasks(n.sparkSession, n.count(), q.count())
    pairs = n.repartition(tasks).crossJoin(few(q, 10_000))
    # Made in a row of its own, or the filter below would make all of it again.
    pairs = pairs.select(*[c for c in ("query_id", "node_id", "path", "name", "line_start", "line_end", "p", "infra")], F.inline(F.array(F.struct(*[v.alias(c) for c, v in made.items()]))))
    out = pairs.withColumn("total", total).withColumn("score", F.when(held, F.greatest(F.lit(0), F.col("total") - 40)).otherwise(F.col("total")))
    why = F.array_compact(F.array(*[F.when(F.col(c) > 0, k) for c, k in zip(made, evidence)], F.when(held, "test-penalty")))
    return out.filter("score > 0").select("query_id", "node_id", "path", "name", "line_start", "line_end", F.col("score").cast("long").alias("score"), why.alias("reasons"))


def placed(found: DataFrame) -> DataFrame:
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id")))


def bundle(nodes: DataFrame, found: DataFrame, edges: DataFrame, limits: DataFrame) -> DataFrame:
    """(query_id, node_id, phase, ord, score, confidence): the best node, its neighbourhood (the same file first, then by score) cut to
    the query's most, and two good files of the folders chosen.

    found: scores; edges: (src, dst); limits: (query_id, most, hops).
    """
    found = written(placed(found))
    first = found.filter("place = 1").select("query_id", F.col("node_id").alias("anchor"), F.col("path").alias("anchor_path"), F.col("score").alias("top"))
    second = found.filter("place = 2").select("query_id", F.col("score").alias("next"))
    anchor = written(first.join(second, "query_id", "left").join(limits, "query_id").withColumn("confidence", F.round(F.col("top") / F.greatest(F.col("top") + F.coalesce("next", F.lit(0)), F.lit(1)), 2)))
    hops = anchor.agg(F.max("hops")).first()[0] or 0
    near = graph.khop(edges, anchor.select(F.col("anchor").alias("seed")).distinct(), hops, "both")
    own = anchor.join(near, anchor.anchor == near.seed).filter("hop <= hops").select("query_id", F.col("node").alias("node_id"), "anchor", "anchor_path", "most", "confidence")
    own = own.join(nodes.select("node_id", "path"), "node_id").join(found.select("query_id", "node_id", "score"), ["query_id", "node_id"], "left").fillna(0, ["score"])
    order = Window.partitionBy("query_id").orderBy((F.col("node_id") != F.col("anchor")), (~F.col("path").eqNullSafe(F.col("anchor_path"))), F.col("score").desc(), "node_id")
    chosen = written(own.withColumn("ord", F.row_number().over(order)).filter("ord <= most"))
    slashed = F.translate("path", "\\", "/")
    folders = chosen.filter("path <> ''").select("query_id", paths.cluster(slashed).alias("folder")).distinct()
    others = found.filter((F.col("score") >= SIBLING_SCORE) & (F.col("path") != "") & (paths.base(slashed) != "__init__.py") & ~F.contains(slashed, F.lit("tests/"))).withColumn("folder", paths.cluster(slashed)).join(folders, ["query_id", "folder"], "left_semi").join(chosen.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    extra = others.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "node_id"))).filter(F.col("n") <= SIBLINGS)
    have = chosen.groupBy("query_id").agg(F.count("*").alias("have"), F.first("confidence").alias("confidence"))
    kept = chosen.select("query_id", "node_id", F.when(F.col("node_id") == F.col("anchor"), "anchor").otherwise("neighbor").alias("phase"), "ord", "score", "confidence")
    return kept.unionByName(extra.join(have, "query_id").select("query_id", "node_id", F.lit("sibling").alias("phase"), (F.col("have") + F.col("n")).cast("int").alias("ord"), "score", "confidence"))


def line_of(frames: Column) -> Column:
    """The line of the first frame that meets the node (within its lines, if it has any), else where the node begins, else 1."""
    fits = F.filter(frames, lambda f: (paths.match_score(F.coalesce("path", F.lit("")), f["path"]) > 0) & (F.coalesce("path", F.lit("")) != "") & (F.col("line_start").isNull() | f["line"].between(F.col("line_start"), F.col("line_end"))))
    return F.coalesce(F.get(fits, F.lit(0))["line"], F.col("line_start"), F.lit(1)).cast("long")


def report(nodes: DataFrame, found: DataFrame, edges: DataFrame, queries: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, role, node_id, path, line, score, ord): the best node (ground_zero), what it leads to (direct_import), what leads to it
    (direct_dependent), then the other ranked ones with a file (structural_neighbor); at most so many, each once by its first role."""
    found = written(placed(found))
    zero = found.filter("place = 1").select("query_id", F.col("node_id").alias("anchor"))
    ends = edges.select("src", "dst").filter("src <> dst").distinct()
    out = zero.join(ends, zero.anchor == ends.src).select("query_id", F.lit(2).alias("k"), F.col("dst").alias("node_id"))
    into = zero.join(ends, zero.anchor == ends.dst).select("query_id", F.lit(3).alias("k"), F.col("src").alias("node_id"))
    rest = found.filter("place > 1 and path <> ''").select("query_id", F.lit(4).alias("k"), "node_id")
    roles = zero.select("query_id", F.lit(1).alias("k"), F.col("anchor").alias("node_id")).unionByName(out).unionByName(into).unionByName(rest).groupBy("query_id", "node_id").agg(F.min("k").alias("k"))
    own = roles.join(found.select("query_id", "node_id", "score"), ["query_id", "node_id"], "left").fillna(0, ["score"]).join(nodes.select("node_id", "path", "line_start", "line_end"), "node_id")
    order = Window.partitionBy("query_id").orderBy("k", F.col("score").desc(), "node_id")
    cut = own.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= most)
    role = F.element_at(text.strings(["ground_zero", "direct_import", "direct_dependent", "structural_neighbor"]), F.col("k"))
    return cut.join(queries.select("query_id", text.trace_frames(F.col("text")).alias("frames")), "query_id").select("query_id", role.alias("role"), "node_id", "path", line_of(F.col("frames")).alias("line"), "score", "ord")
