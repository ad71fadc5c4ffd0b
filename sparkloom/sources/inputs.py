"""What a job reads beside sources and graphs: presets and weights, issue texts, cases, and where files and roots are."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import rank, select
from .code import place

_JSON_NAMES = {"path": "path_term"}  # names of weights in files that differ from ours


def read_text(path: str) -> str:
    """A small file on any file system, on the driver."""
    system, name = place(path)
    with system.open_input_stream(name) as f:
        return f.readall().decode("utf-8-sig", "replace")


def presets(path: str | None = None) -> dict[str, dict]:
    """Presets by name, each with most, snippets, hops, lines, direction, same_file and budget; those of a JSON file, or the built-in ones."""
    if path is None:
        return {k: dict(zip(("most", "snippets", "hops", "lines"), v)) | {"direction": "both", "same_file": True, "budget": 900} for k, v in select.PRESETS.items()}
    rows = json.loads(read_text(path)).get("presets", {})
    return {k: {"most": int(v["max_files"]), "snippets": int(v["max_snippets"]), "hops": int(v["hops"]), "lines": int(v["max_snippet_lines"]), "direction": str(v.get("direction", "both")), "same_file": bool(v.get("prefer_same_file", True)), "budget": int(v.get("summary_budget_tokens", 900))} for k, v in rows.items()}


def weights(path: str | None = None) -> dict:
    """betas, margin, topk, temperature and the lower-cased terms that admit tests and migrations; of a JSON file, or the built-in ones.

    Weights that a file lacks are rank.FALLBACK's.
    """
    if path is None:
        return {"betas": dict(rank.BETAS), "margin": rank.MARGIN, "topk": rank.TOPK, "temperature": rank.TEMPERATURE, "tests": rank.TEST_TERMS, "migrations": rank.MIGRATION_TERMS}
    read = json.loads(read_text(path))
    bounds = read.get("thresholds", {})
    low = lambda k: [t.lower() for t in bounds.get(k, [])]
    betas = {_JSON_NAMES.get(k, k): float(v) for k, v in read["betas"].items()}
    return {"betas": {k: betas.get(k, v) for k, v in rank.FALLBACK.items()}, "margin": float(bounds.get("anchor_margin", 0.10)), "topk": int(bounds.get("topk", 3)), "temperature": float(bounds.get("softmax_temp", 0.6)), "tests": low("test_admit_terms"), "migrations": low("migration_admit_terms")}


def issue_text(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """(query_id, text) of one issue: the text given, else the file's, else what stands in the standard input."""
    body = text if text is not None else read_text(path) if path else sys.stdin.read()
    return spark.createDataFrame([(1, body)], "query_id long, text string")


def infer_root(graph_path: str, glob: str | None = None, given: str | None = None) -> str:
    """The folder of the sources: the one given, else the root's glob if that is a folder, else the graph file's own."""
    if given:
        return given
    if glob:
        system, name = place(glob)
        if system.get_file_info(name).type.name == "Directory":
            return glob
    return os.path.dirname(graph_path) or "."


def resolve(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """nodes (src_path, ...) with file: the one of that path, else the first (by path) of its name, else null. files: (path)."""
    own = files.select("path").distinct()
    exact = own.select(F.col("path").alias("src_path"), F.col("path").alias("__a"))
    named = own.groupBy(paths.base(F.col("path")).alias("__b")).agg(F.min("path").alias("__c"))
    out = nodes.join(exact, "src_path", "left").withColumn("__n", paths.base(F.col("src_path"))).join(named, F.col("__n") == F.col("__b"), "left")
    return out.withColumn("file", F.coalesce("__a", "__c")).drop("__a", "__b", "__c", "__n")


def cases(spark: SparkSession, path: str, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """The benchmark's cases of Parquet or JSON files: those of a repository, and the first so many by instance_id if a limit is given.

    Lists of tests given as JSON texts are read; columns that are missing are empty.
    """
    read = spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    names = "instance_id repo base_commit patch test_patch problem_statement hints_text created_at version environment_setup_commit".split()
    columns = [F.col(n).cast("string").alias(n) if n in read.columns else F.lit("").alias(n) for n in names]
    for n in ("FAIL_TO_PASS", "PASS_TO_PASS"):
        kind = dict(read.dtypes).get(n)
        columns.append((F.from_json(n, "array<string>") if kind == "string" else F.col(n) if kind else F.array().cast("array<string>")).alias(n))
    out = read.select(*columns)
    out = out.filter(F.col("repo") == repo) if repo else out
    return out.orderBy("instance_id").limit(limit) if limit else out
