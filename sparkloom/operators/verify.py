"""Declared against real dependencies, and edits of unique places in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def _ends(path: Column) -> Column:
    """All ends of a path that begin at a part."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes with file: that whose path is theirs or ends with it, else one of the same name (the least of several); null if there is none.

    files: (path). Every node is joined by the last part of its path.
    """
    own = nodes.withColumn("__p", F.translate("src_path", "\\", "/"))
    there = files.select(F.col("path").alias("__f"), paths.base(F.col("path")).alias("__b")).distinct()
    met = own.filter("src_path is not null").join(there, paths.base(F.col("__p")) == F.col("__b"))
    rank = F.when(F.col("__f") == F.col("__p"), 0).when(F.endswith("__f", F.col("__p")), 1).otherwise(2)
    best = met.groupBy("src_path").agg(F.min_by("__f", F.struct(rank, "__f")).alias("file"))
    return nodes.join(best, "src_path", "left")


def module_nodes(mods: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mod, name): the node that a dotted module is: a/b/c.py, a/b.py, a.py, then c.py, whichever comes first; paths meet if one is the
    end of the other at a part. Of several nodes the first by ord. mods: (mod); nodes: (name, src_path, ord)."""
    parts = F.split("mod", r"\.")
    heads = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit(".py")))
    wanted = mods.select("mod").distinct().select("mod", F.posexplode(F.concat(heads, F.array(F.concat(F.element_at(parts, -1), F.lit(".py"))))).alias("k", "c"))
    own = nodes.filter("src_path is not null").select("name", "ord", F.translate("src_path", "\\", "/").alias("p"))
    inner = wanted.join(own.select("name", "ord", F.explode(_ends(F.col("p"))).alias("c")), "c").select("mod", "k", "name", "ord")
    outer = wanted.select("mod", "k", F.explode(_ends(F.col("c"))).alias("p")).join(own, "p").select("mod", "k", "name", "ord")
    return inner.unionByName(outer).groupBy("mod").agg(F.min_by("name", F.struct("k", "ord")).alias("name"))


def verify(nodes: DataFrame, declared: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, src, dst): missing (a file imports a node's file, and no edge says so), ghost (an edge that no import bears out, to a node with
    a path), unresolved (a node whose file isn't there; dst is its path).

    nodes: (fqn, name, src_path, ord); src of missing and ghost is the fqn, dst a name. declared: (src, dst) by name. imports: (path,
    mod). files: (path). Edges of a node's own name don't count.
    """
    placed = resolve_files(nodes, files)
    known = placed.filter("file is not null")
    real = known.join(imports, F.col("file") == F.col("path")).select("fqn", F.col("name").alias("own"), "mod").join(module_nodes(imports.select("mod"), nodes), "mod").filter("name <> own").select("fqn", F.col("name").alias("dst")).distinct()
    said = known.select("fqn", F.col("name").alias("src")).join(declared.select("src", "dst").distinct(), "src").select("fqn", "dst").distinct()
    missing = real.join(said, ["fqn", "dst"], "left_anti").select(F.lit("missing").alias("kind"), F.col("fqn").alias("src"), "dst")
    ends = nodes.filter("src_path is not null").select(F.col("name").alias("dst")).distinct()
    ghost = said.join(real, ["fqn", "dst"], "left_anti").join(ends, "dst", "left_semi").select(F.lit("ghost").alias("kind"), F.col("fqn").alias("src"), "dst")
    lost = placed.filter("src_path is not null and file is null").select(F.lit("unresolved").alias("kind"), F.col("fqn").alias("src"), F.col("src_path").alias("dst"))
    return missing.unionByName(ghost).unionByName(lost)


def report(found: DataFrame) -> DataFrame:
    """(kind, n, failed): diagnostics by kind; whether they make the check fail."""
    return found.groupBy("kind").agg(F.count("*").alias("n")).withColumn("failed", F.col("kind") != "unresolved")


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def replace_unique(text: Column, part: Column, new: Column) -> Column:
    """text with its only occurrence of part replaced; null if there are none or several."""
    return F.when(occurrences(text, part) == 1, F.replace(text, part, new))
