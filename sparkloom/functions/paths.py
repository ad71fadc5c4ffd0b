"""Names, kinds and matches of source paths as column expressions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SKIPPED = sorted("dist build target env ENV venv .venv .git .hg .svn .nox .tox .next .eggs node_modules site-packages __pycache__ .ruff_cache .mypy_cache .pytest_cache".split())
#: Beginnings of the names of temporary folders.
TEMPORARY = (".smoke-",)
REGISTRY = sorted("urls.py apps.py admin.py config.py settings.py global_settings.py __init__.py".split())


def base(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part without its last suffix; a leading dot is none."""
    return F.regexp_replace(base(path), r"(?<=.)\.[^.]*$", "")


def cluster(path: Column) -> Column:
    """The folder, a dot for the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def camel(name: Column) -> Column:
    """A type name from a file name: parts joined, each with its first letter raised; Node if none, N before digits."""
    parts = F.filter(F.split(stem(name), "[^A-Za-z0-9]+"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")
    return F.when(joined == "", "Node").when(joined.rlike("^[0-9]"), F.concat(F.lit("N"), joined)).otherwise(joined)


def kind(path: Column, loc: Column) -> Column:
    """test, migration, registry or normal; a part that begins with tests or test_, the name's own too, makes a test."""
    parts, name = F.split(path, "/"), base(path)
    test = F.exists(parts, lambda p: p.startswith("tests") | p.startswith("test_")) | (name == "conftest.py")
    registry = name.isin(REGISTRY) & ~((name == "__init__.py") & (loc < 10))
    migration = F.array_contains(parts, "migrations") & name.startswith("0") & name.endswith(".py")
    return F.when(test, "test").when(migration, "migration").when(registry, "registry").otherwise("normal")


def inferred_kind(path: Column) -> Column:
    """The kind of a node of which only the path is known (null counts as none): test, registry or normal."""
    low = F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/"))
    test = F.contains(F.concat(F.lit("/"), low), F.lit("/tests/")) | base(low).startswith("test_")
    return F.when(test, "test").when(base(low).isin("__init__.py", "apps.py", "urls.py", "settings.py", "global_settings.py"), "registry").otherwise("normal")


def admitted(path: Column, loc: Column) -> Column:
    """Small package markers are left out."""
    return ~((base(path) == "__init__.py") & (loc < 10))


def skipped_folder(path: Column) -> Column:
    """Whether a folder above the file is one of those that scans leave out."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda p: p.isin(SKIPPED) | F.array_contains(F.transform(F.array(*[F.lit(t) for t in TEMPORARY]), lambda t: F.startswith(p, t)), True) | p.endswith(".egg-info"))


def ignore_regex(pattern: str) -> str:
    """A glob of an ignore file as a regular expression over paths: of the whole path, its last part, or what lies below it."""
    glob = re.sub(r"\\Z$|\\z$", "", fnmatch.translate(pattern.strip().lstrip("./").rstrip("/")))
    return f"^(?:{glob}|.*/{glob}|{glob}/.*)$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a line of an ignore file (blank ones and comments don't count) matches."""
    kept = [p for p in patterns if p.strip() and not p.strip().startswith("#")]
    hit = F.lit(False)
    for p in kept:
        hit = hit | path.rlike(ignore_regex(p))
    return hit


def match_score(a: Column, b: Column) -> Column:
    """18 if either path ends the other, 12 for the same file name, 8 for the same stem, else 0; case and slash direction aside."""
    x, y = (F.lower(F.translate(p, "\\", "/")) for p in (a, b))
    return F.when(F.endswith(x, y) | F.endswith(y, x), 18).when(base(x) == base(y), 12).when(stem(x) == stem(y), 8).otherwise(0)


def match(a: str, b: str) -> bool:
    """Whether match_score of two paths is positive."""
    x, y = (p.replace("\\", "/").lower() for p in (a, b))
    ends = lambda p: (p.rpartition("/")[2], re.sub(r"(?<=.)\.[^.]*$", "", p.rpartition("/")[2]))
    return x.endswith(y) or y.endswith(x) or any(i == j for i, j in zip(ends(x), ends(y)))
