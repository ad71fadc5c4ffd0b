"""Budgeted selection of nodes as set phases: each takes what was selected before, and adds at most its budget for each query.

places: (query_id, node_id, path, cluster, kind, score, place, the signals); place counts from 1.
facts: one row for each query: (query_id, primary, confidence, low_margin, most, hops).
selected: (query_id, node_id, phase, ord). Each phase is written before the next names it several times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.lineage import written
from . import graph, rank

STRONG = ("explicit_path", "path_term", "stem", "symbol_exact", "mgmt_command", "upper_const")
#: (files, snippets, hops, lines of a snippet) of each preset.
PRESETS = {"default": (6, 3, 1, 80), "test-fix": (7, 4, 2, 100), "issue-fix": (8, 5, 2, 120), "crash-fix": (10, 6, 3, 140)}


def preset_value(preset: Column, k: int) -> Column:
    """The k-th number of the preset; those of default for an unknown one."""
    out = F.lit(PRESETS["default"][k])
    for name, values in PRESETS.items():
        out = F.when(preset == name, values[k]).otherwise(out)
    return out


def ordered(scored: DataFrame) -> DataFrame:
    """scored with place: by score, then path and id, within each query."""
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "path", "node_id")))


def facts_of(places: DataFrame, found: DataFrame, limits: DataFrame) -> DataFrame:
    """The facts of queries, from the anchors found and the limits (query_id, most, hops)."""
    told = found.groupBy("query_id").agg(F.first("confidence").alias("confidence"), F.first("low_margin").alias("low_margin"))
    return places.filter("place = 1").select("query_id", F.col("score").alias("primary")).join(told, "query_id").join(limits.select("query_id", "most", "hops"), "query_id")


def add(selected: DataFrame, candidates: DataFrame, facts: DataFrame, phase: Column, budget: Callable[[Column], Column], order: list[Column]) -> DataFrame:
    """selected and the first candidates that it lacks: as many as the budget (of those selected so far) and the query's most allow."""
    have = selected.groupBy("query_id").agg(F.count("*").alias("__have"))
    own = facts.join(have, "query_id", "left").fillna(0, ["__have"])
    fresh = candidates.join(selected.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").join(own, "query_id")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    kept = fresh.withColumn("__n", n).filter((F.col("__n") <= budget(F.col("__have"))) & (F.col("__n") + F.col("__have") <= F.col("most")))
    return written(selected.unionByName(kept.select("query_id", "node_id", phase.alias("phase"), (F.col("__n") + F.col("__have")).cast("int").alias("ord"))))


def guards(places: DataFrame, anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """The anchors, then for each telling signal that none of them has, the first nodes of the top window that have it."""
    selected = written(anchors.join(facts.select("query_id", "most"), "query_id").filter("place <= most").select("query_id", "node_id", F.lit("anchor").alias("phase"), F.col("place").cast("int").alias("ord")))
    window = places.join(facts.select("query_id", F.col("most").alias("__m")), "query_id").filter(F.col("place") <= F.greatest(F.lit(12), 4 * F.col("__m"))).drop("__m")
    held = places.join(anchors.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi")
    rules: list[tuple[str, float, int, Callable[[], Column]]] = [(c, 0.5, 2 if c == "upper_const" else 1, lambda c=c: F.col(c) > 0) for c in ("explicit_path", "mgmt_command", "error_code", "upper_const")]
    rules.append(("domain", 0.4, 1, lambda: (F.abs("domain") >= 0.4) & (F.greatest("stem", "path_term", "explicit_path", "symbol_exact") > 0)))
    for signal, bound, limit, test in rules:
        lacking = window.join(held.filter(F.abs(signal) >= bound).select("query_id").distinct(), "query_id", "left_anti")
        selected = add(selected, lacking.filter(test()), facts, F.lit(f"guard:{signal}"), lambda have, n=limit: F.lit(n), [F.col("place")])
    return selected


def neighbor_budget(have: Column) -> Column:
    left, sure = F.greatest(F.lit(0), F.col("most") - have), F.col("confidence")
    return F.when(F.col("low_margin") | (have > 1), left).when(sure >= 0.55, F.least(F.lit(2), left)).when(sure >= 0.40, F.least(F.lit(3), left)).otherwise(F.least(F.lit(4), left))


def penalty() -> Column:
    """What lowers neighbours of weak kinds that no signal speaks for."""
    strong = (F.abs("domain") >= 0.4) | (F.col("lex") > 1.5) | (F.col("term_idf") > 1.0)
    for s in STRONG:
        strong = strong | (F.col(s) > 0)
    return F.when(strong, 1.0).when(F.col("kind") == "registry", 0.65).when(F.col("kind") == "test", 0.25).when(F.col("kind") == "migration", 0.20).otherwise(1.0)


def typed_neighbors(places: DataFrame, selected: DataFrame, anchors: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that typed edges (src, dst, edge_type) lead to from the anchors, by their weakened weight; where they lead nowhere, those
    within hops of any edge, by place. Both only near the top, or if the weight (the score) speaks for them."""
    hops = facts.agg(F.max("hops")).first()[0] or 0
    starts = anchors.select(F.col("query_id").alias("seed"), "node_id")
    reach = facts.select("query_id", "hops")
    near = graph.propagate_from(edges, starts.withColumnRenamed("node_id", "node"), hops).join(reach.withColumnRenamed("query_id", "seed"), "seed").filter("hop <= hops")
    near = written(graph.best_path(near).select(F.col("seed").alias("query_id"), F.col("node").alias("node_id"), "weight", "hop", "via"))
    cap = lambda low: F.greatest(F.lit(6), F.col("most") * F.when(low, 3).otherwise(2)) + 1
    adjusted = near.join(places, ["query_id", "node_id"]).withColumn("adjusted", F.col("weight") * penalty())
    good = adjusted.join(facts.select("query_id", "most", "low_margin"), "query_id").filter((F.col("place") <= cap(F.col("low_margin"))) | (F.col("adjusted") >= 0.12)).drop("most", "low_margin")
    selected = add(selected, good, facts, F.concat(F.lit("typed:"), "via", F.lit(":"), F.col("hop").cast("string")), neighbor_budget, [F.round("adjusted", 12).desc(), F.col("place")])
    without = facts.join(near.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    lost = starts.join(without.withColumnRenamed("query_id", "seed"), "seed", "left_semi").withColumn("start", F.col("node_id"))
    if lost.isEmpty():
        return selected
    found = graph.khop(edges, lost.select(F.col("start").alias("seed")).distinct(), hops, "both")
    around = lost.select(F.col("seed").alias("query_id"), "start").join(found.withColumnRenamed("seed", "start"), "start").join(reach, "query_id").filter("hop <= hops").select("query_id", F.col("node").alias("node_id")).distinct()
    good = around.join(places, ["query_id", "node_id"]).join(facts.select("query_id", "most", "low_margin"), "query_id").filter((F.col("place") <= cap(F.col("low_margin"))) | (F.col("score") > 0)).drop("most", "low_margin")
    return add(selected, good, facts, F.lit("radius"), neighbor_budget, [F.col("place")])


def _floor(share_low: float, share: float) -> Column:
    return F.when(F.col("primary") > 0, F.col("primary") * F.when(F.col("low_margin"), share_low).otherwise(share)).otherwise(0.0)


def _folders(places: DataFrame, selected: DataFrame) -> DataFrame:
    return places.join(selected.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi").select("query_id", "cluster").distinct()


def _near(own: DataFrame, facts: DataFrame, floor: Column, least: int, times: int) -> DataFrame:
    """Those whose score reaches the floor, down to the place that the query's most allows."""
    held = own.join(facts, "query_id").filter((F.col("score") >= floor) & (F.col("place") <= F.greatest(F.lit(least), times * F.col("most")) + 1))
    return held.select(*own.columns)


def siblings(places: DataFrame, selected: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes of the folders selected so far, good enough against the first."""
    own = places.filter("path <> ''").join(_folders(places, selected).filter("cluster <> ''"), ["query_id", "cluster"], "left_semi")
    budget = F.when(F.col("low_margin") | (F.col("confidence") < 0.30), 3).otherwise(2)
    return add(selected, _near(own, facts, _floor(0.25, 0.35), 16, 5), facts, F.lit("sibling"), lambda have: budget, [F.col("place")])


def package_markers(places: DataFrame, selected: DataFrame, facts: DataFrame) -> DataFrame:
    """Package files of folders selected so far."""
    own = places.filter((paths.base(F.col("path")) == "__init__.py") & (F.col("score") > 0)).join(_folders(places, selected), ["query_id", "cluster"], "left_semi")
    return add(selected, own, facts, F.lit("init"), lambda have: F.col("most"), [F.col("place")])


def parents(places: DataFrame, selected: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes of the folders above those selected; the root is none."""
    above = _folders(places, selected).filter(F.contains("cluster", F.lit("/"))).select("query_id", F.regexp_replace("cluster", "/[^/]*$", "").alias("cluster")).filter("cluster <> ''").distinct()
    own = places.join(above, ["query_id", "cluster"], "left_semi")
    return add(selected, _near(own, facts, _floor(0.20, 0.30), 20, 6), facts, F.lit("parent"), lambda have: F.col("most"), [F.col("place")])


def graph_fill(places: DataFrame, selected: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes within two typed edges of any selected one, near the top, by score."""
    near = graph.best_path(graph.propagate_from(edges, selected.select(F.col("query_id").alias("seed"), F.col("node_id").alias("node")), 2))
    own = near.select(F.col("seed").alias("query_id"), F.col("node").alias("node_id"), "hop", "via").join(places, ["query_id", "node_id"])
    good = own.join(facts.select("query_id", "most"), "query_id").filter(F.col("place") <= F.greatest(F.lit(15), 5 * F.col("most")) + 1).drop("most")
    return add(selected, good, facts, F.concat(F.lit("fill:"), "via", F.lit(":"), F.col("hop").cast("string")), lambda have: F.col("most"), [F.col("place")])


def bundle(places: DataFrame, anchors: DataFrame, facts: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """All phases in turn; without edges, those that follow none."""
    selected = guards(places, anchors, facts)
    if edges is not None:
        selected = typed_neighbors(places, selected, anchors, facts, edges)
    for phase in (siblings, package_markers, parents):
        selected = phase(places, selected, facts)
    return selected if edges is None else graph_fill(places, selected, facts, edges)


def summary(places: DataFrame, selected: DataFrame, anchors: DataFrame, queries: DataFrame, files: DataFrame, cap: float) -> DataFrame:
    """One row for each query: (query_id, preset, anchor, anchor_file, confidence, nodes, files, omitted_nodes, omitted_files, warnings,
    token_estimate, reasons).

    queries: (query_id, text, preset). files: (path) of the sources that exist; selected nodes without one count as nodes only.
    token_estimate is that of the text; snippets add theirs.
    """
    total = places.groupBy("query_id").agg(F.count("*").alias("all_nodes"), F.countDistinct(F.when(F.col("path") != "", F.col("path"))).alias("all_files"))
    own = selected.join(places, ["query_id", "node_id"]).join(files.select("path", F.lit(True).alias("__real")).distinct(), "path", "left").withColumn("why", rank.reasons(cap))
    item = F.struct("ord", "node_id", "path", "__real", "phase", "why", F.round(F.col("score") * 100).cast("long").alias("score"))
    told = anchors.groupBy("query_id").agg(F.first("confidence").alias("confidence"), F.first("low_margin").alias("low_margin"), F.count("*").alias("tied"))
    out = own.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items")).join(total, "query_id").join(told, "query_id").join(queries, "query_id")
    real = F.array_distinct(F.transform(F.filter("items", lambda i: i["__real"]), lambda i: i["path"]))
    why = lambda i, n: F.array_join(F.slice(i["why"], 1, n), ", ")
    reason = F.transform("items", lambda i: F.concat(F.when(i["ord"] == 1, F.concat(F.when(F.col("low_margin"), "low-margin top-K; ").otherwise(""), why(i, 5))).when(i["phase"] == "anchor", F.concat(F.lit("margin-tied: "), why(i, 4))).otherwise(F.concat(why(i, 3), F.lit("; "), i["phase"])), F.lit(" (score "), i["score"].cast("string"), F.lit(")")))
    warning = F.when(F.col("low_margin"), F.concat(F.lit("low-confidence anchor; returning "), F.col("tied").cast("string"), F.lit(" candidates")))
    size = lambda c: F.size(c).cast("long")
    return out.withColumn("files", real).select("query_id", "preset", F.element_at("items", 1)["node_id"].alias("anchor"), F.element_at("items", 1)["path"].alias("anchor_file"), "confidence", F.transform("items", lambda i: i["node_id"]).alias("nodes"), "files", F.greatest(F.lit(0), F.col("all_nodes") - size("items")).alias("omitted_nodes"), F.greatest(F.lit(0), F.col("all_files") - size("files")).alias("omitted_files"), F.array_compact(F.array(warning)).alias("warnings"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("token_estimate"), reason.alias("reasons"))
