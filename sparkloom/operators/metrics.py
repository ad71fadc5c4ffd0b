"""Metrics of retrieval: hits, rank of the first gold file, summaries, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")


def navigation(cases: DataFrame) -> DataFrame:
    """cases (case_id, predicted, gold: arrays of paths) with hit, hit1 and rot: the place from 0 of the first prediction that
    ends with a gold file, the number of predictions if none does, infinite if either list is empty (or null)."""
    p, g = F.transform("predicted", norm), F.transform("gold", norm)
    match = F.transform(p, lambda x: F.exists(g, lambda y: F.endswith(x, y)))
    none = (F.coalesce(F.size("predicted"), F.lit(0)) <= 0) | (F.coalesce(F.size("gold"), F.lit(0)) <= 0)
    first = F.array_position(match, True)
    return cases.select("case_id", F.when(none, False).otherwise(first > 0).alias("hit"), F.when(none, False).otherwise(first == 1).alias("hit1"), F.when(none, float("inf")).when(first > 0, (first - 1).cast("double")).otherwise(F.size("predicted").cast("double")).alias("rot"))


def summary(runs: DataFrame) -> DataFrame:
    """One row of rates over the runs (hit, hit1, rot, tokens, control, error) without error; token means skip zeros."""
    ok = F.col("error").isNull()
    mean = lambda c, if_: F.avg(F.when(ok & if_, c.cast("double")))
    out = runs.agg(F.count("*").alias("total"), F.count_if(ok).alias("completed"), mean(F.col("hit").cast("int"), F.lit(True)).alias("hit_rate"), mean(F.col("hit1").cast("int"), F.lit(True)).alias("hit1_rate"), mean(F.col("rot"), F.col("rot").isNotNull()).alias("rot"), mean(F.col("tokens"), F.col("tokens") > 0).alias("tokens"), mean(F.col("control"), F.col("control") > 0).alias("control"))
    return out.withColumn("reduction", 1 - F.col("tokens") / F.col("control"))


TOOLS = ("blast", "rg", "locate", "expand")
#: Tokens that reading the files itself takes a model, assumed.
RAW_TOKENS = 50_000


def solve_modes(calls: DataFrame) -> DataFrame:
    """(case_id, mode, n_calls, tokens, a count for each of TOOLS) from tool calls (case_id, tool, success, tokens): the mode by the tools
    that succeeded."""
    used = F.collect_set(F.when(F.col("success"), F.col("tool")))
    out = calls.groupBy("case_id").agg(used.alias("used"), F.count("*").alias("n_calls"), F.sum("tokens").alias("tokens"), *[F.count_if(F.col("tool") == t).alias(t) for t in TOOLS])
    has = lambda t: F.array_contains("used", t)
    mode = F.when((F.size("used") == 1) & has("blast"), "blast_only").when(has("rg") & ~has("locate") & ~has("expand"), "blast+rg").when(has("locate") & ~has("rg"), "blast+locate").when(F.size("used") > 2, "multi_tool").otherwise("unknown")
    return out.select("case_id", mode.alias("mode"), "n_calls", "tokens", *TOOLS)


def trace_hits(cases: DataFrame) -> DataFrame:
    """cases (case_id, predicted, gold) with hit, hit1 and hit3: whether any, the first, or one of the first three predictions meets a gold
    file, either being the end of the other."""
    p, g = F.transform("predicted", norm), F.transform("gold", norm)
    match = F.transform(p, lambda x: F.exists(g, lambda y: F.endswith(x, y) | F.endswith(y, x)))
    return cases.select("case_id", F.array_contains(match, True).alias("hit"), F.coalesce(F.get(match, F.lit(0)), F.lit(False)).alias("hit1"), F.array_contains(F.slice(match, 1, 3), True).alias("hit3"))


def comparison(runs: DataFrame) -> DataFrame:
    """One row for runs (hit, hit1, hit3, tokens, calls, mode, error): rates over those without error, and how many times fewer tokens than
    reading the files. Nulls where no run ended."""
    ok = F.col("error").isNull()
    share = lambda test: F.avg(F.when(ok, test.cast("int").cast("double")))
    mode = F.col("mode")
    out = runs.agg(F.count("*").alias("total"), F.count_if(ok).alias("completed"), *[share(F.col(c)).alias(f"{c}_rate") for c in ("hit1", "hit3", "hit")], F.avg(F.when(ok, F.col("tokens"))).alias("tokens"), F.avg(F.when(ok, F.col("calls"))).alias("calls"), share(mode == "blast_only").alias("blast_only_rate"), share(mode.contains("rg")).alias("rg_rate"), share(mode.contains("locate")).alias("locate_rate"))
    return out.withColumn("compression", F.when(F.col("tokens") > 0, RAW_TOKENS / F.col("tokens")).otherwise(float("inf")))


def distribution(runs: DataFrame, by: str) -> DataFrame:
    """(by, cases, share, hit_rate) of the runs without error."""
    done = runs.filter("error is null")
    n = done.count()
    return done.groupBy(by).agg(F.count("*").alias("cases"), (F.count("*") / F.lit(max(n, 1))).alias("share"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def baselines(models: DataFrame, known: DataFrame) -> DataFrame:
    """models (model) with the known one of that name, else the first (by ord) of which either name ends the other, else nulls. known:
    (name, ord, ...), a short list, which every task reads."""
    exact = F.col("model") == F.col("name")
    met = models.join(F.broadcast(known), exact | F.endswith("model", F.col("name")) | F.endswith("name", F.col("model")), "left")
    best = met.groupBy("model").agg(F.min_by(F.struct(*known.columns), F.struct(F.when(exact, 0).otherwise(1), "ord")).alias("m"))
    return best.select("model", *[F.col(f"m.{c}").alias(c) for c in known.columns if c != "ord"])


def test_command(test: Column) -> Column:
    """The shell line that runs a failing test: by its file, or by its dotted name."""
    failed, runner = " || RESULT=1", F.concat(F.lit("python tests/runtests.py "), test, F.lit(" -v 2"))
    module = F.regexp_replace(test, r"\.[^.]*$", "")
    dotted = F.concat(F.lit("python -m django test "), module, F.lit(" --settings=tests.test_settings -v 2"), F.lit(" 2>/dev/null || "), runner, F.lit(failed))
    return F.when(F.contains(test, F.lit("::")), F.concat(F.lit('python -m pytest -xvs "'), test, F.lit('"' + failed))).when(F.contains(test, F.lit(".")), dotted).otherwise(F.concat(runner, F.lit(failed)))


def test_commands(tests: Column) -> Column:
    """A line for each failing test; one that says so if there are none."""
    return F.when(F.coalesce(F.size(tests), F.lit(0)) <= 0, 'echo "NO_TESTS_SPECIFIED"').otherwise(F.array_join(F.transform(tests, test_command), "\n"))


def table_of(summary_: DataFrame) -> DataFrame:
    """(ord, line) of the summary as a table in Markdown."""
    pct = lambda c: F.concat(F.round(F.col(c) * 100, 1).cast("string"), F.lit(" %"))
    rows = {"Cases": F.col("total").cast("string"), "Completed": F.col("completed").cast("string"), "Hit rate": pct("hit_rate"), "Hit@1 rate": pct("hit1_rate"), "Mean place of the first gold file": F.round("rot", 2).cast("string"), "Mean tokens": F.round("tokens", 0).cast("string"), "Mean control tokens": F.round("control", 0).cast("string"), "Token reduction": pct("reduction")}
    lines = [F.lit("| Metric | Value |"), F.lit("|---|---:|"), *[F.concat(F.lit(f"| {k} | "), F.coalesce(v, F.lit("-")), F.lit(" |")) for k, v in rows.items()]]
    return summary_.select(F.posexplode(F.array(*lines)).alias("ord", "line"))


def control_tokens(text: Column) -> Column:
    return F.least(80000 + 5 * F.length(text), F.lit(200000)).cast("long")


def pending(cases: DataFrame, done: DataFrame) -> DataFrame:
    """Cases that weren't done without error."""
    return cases.join(done.filter("error is null").select("case_id").distinct(), "case_id", "left_anti")
