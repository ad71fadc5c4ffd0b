"""The rules of text mining, kinds, anchors and phases against plain loops over made-up cases that tell near rules apart."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import paths, text
from sparkloom.operators import rank, select

STOP = set("actual and are bug can case does error exception expected fix for from get into issue its not self should test tests that the their this traceback use used uses when while with without".split())
TEXTS = [
    'File "a\\b.py", line 3, in f.g then C:\\x\\Y.py:7:2 and q/z.py:9, Q/Z.py:9 File "k.py", line 4',
    "`  Foo.bar ` is Foo.Bar, foo.bar; core.models.E028 fields.w12 auth.E0033x ünder.E001 a.E0012",
    "./x-y/z.py a.b/c.py django/db/Models.py Lib/x/y_2 a/9b/c.py one/two one/two/three/ x/y.pyc",
    "__icontains email__isnull __averyverylongname12345 a__b__c __fooé x___foo __x",
    "ROLLBACK POSTGRES MAX_LEN MIDDLEWARE DEBUG ABCDE_ éMAX_LENGTH MAX_LENGTHé _MAX_LEN2",
    "./manage.py sqlmigrate: run migrate. test( xtest 'flush' \"check\" runserver\nshell validate,",
    "éFoo Fooé URLField Model ab Ab Abc HTTPServer snake_Case mixedCase self Test errors error",
    "before ```\nab.py a_b Ccc aBc x.y\n``` after_it the keyword Keyword `co de` ``` open fence z_z",
    "", "x", "```", "a.b.c.d.py:12 a.py:12b.py:3 C:/q.py:1 abcC:\\x.py:5 'in q.py:6'",
]


def first(values, key=str.lower):
    seen = {}
    for v in values:
        seen.setdefault(key(v), v)
    return list(seen.values())


def tokens(t):
    out = []
    for word in re.findall("[A-Za-z][A-Za-z0-9_]*", t):
        for part in [word] + [p for p in re.split("(?<=[a-z0-9])(?=[A-Z])|_", word) if p]:
            if len(part) > 2 and part.lower() not in STOP:
                out.append(part.lower())
    return out


def code_terms(t):
    quoted = [q.strip() for q in re.findall("`([^`\n]+)`", t) if q.strip()]
    names = [m[0] for m in re.finditer(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+|[A-Za-z0-9_./-]+\.py", t, re.A)]
    return first(quoted + names + re.findall(r"\b[A-Z][a-zA-Z0-9_]{2,}\b", t))


def issue_terms(t):
    out, rest = [], re.sub("(?s)```.*?```", " ", t)
    for block in [*re.findall("(?s)```(.*?)```", t), None]:
        if block is None:
            block, out = rest, out + [q.strip() for q in re.findall("`([^`\n]+)`", rest) if q.strip()]
        out += re.findall(r"[A-Za-z0-9_./-]+\.py", block)
        out += [n for n in re.findall(r"[A-Za-z_][A-Za-z0-9_\.]{2,}", block) if "." in n or "_" in n or any(c.isupper() for c in n[1:])]
    return first(out)


def old_frames(t):
    found = [(m[1], int(m[2]), m[3]) for m in re.finditer(r'File "([^"\n]+)", line (\d+), in ([A-Za-z_][\w.]*)', t, re.A)]
    found += [(m[1], int(m[2]), "") for m in re.finditer(r"""((?:[A-Za-z]:[\\/])?[^:\s"']+?\.py):(\d+)""", t)]
    return first([(p.replace("\\", "/"), n, s) for p, n, s in found], lambda f: (f[0].lower(), f[1], f[2].lower()))


def frames(t):
    found = [(m[1] or m[3], int(m[2] or m[4])) for m in re.finditer(r"""File "([^"\n]+)", line (\d+)|((?:[A-Za-z]:[\\/])?[^:\s"']+?\.py):(\d+)""", t)]
    return first([(p.replace("\\", "/"), n) for p, n in found], lambda f: (f[0].lower(), f[1]))


def codes(t):
    return first([f"{m[1].lower()}.{m[2].upper()}" for m in re.finditer(r"\b([a-zA-Z][a-zA-Z_]{1,15})\.([EWew]\d{3,4})\b", t)], str)


def constants(t):
    return first([m for m in re.findall(r"\b[A-Z][A-Z0-9_]{4,}\b", t) if m not in ("ROLLBACK", "POSTGRES") and ("_" in m or len(m) >= 8)], str)


def verbs(t):
    return [v for v in text.VERBS if re.search(r"(?:^|[\s`'\"./])" + v + r"(?:[\s`'\":(]|$)", t.lower())]


def explicit(t):
    w = "[A-Za-z_][A-Za-z0-9_]*"
    return first([m[0].lower() for m in re.finditer(rf"(?:{w}/)+{w}\.py|{w}/{w}(?:/{w})+", t)], str)


def dunders(t):
    return re.findall(r"__([a-z][a-z0-9_]{1,15})\b", t.lower())


RULES = {"tokens": tokens, "code_terms": code_terms, "issue_terms": issue_terms, "trace_frames": old_frames, "frames": frames, "error_codes": codes, "upper_constants": constants, "verbs": verbs, "explicit_paths": explicit, "dunders": dunders}


@pytest.fixture(scope="module")
def mined(spark):
    rng = random.Random(5)
    parts = ["File \"", '", line ', "12", ", in ", "a", "B", "_", ".", "/", "\\", ".py", ":", " ", "\n", "`", "```", "E001", "models", "é", "__", "MAX", "migrate", "Foo", "bar", "C:", "-", "'"]
    texts = TEXTS + ["".join(rng.choices(parts, k=30)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    rows = df.select("i", *[getattr(text, n)(F.col("t")).alias(n) for n in RULES]).collect()
    return texts, {r.i: r for r in rows}


@pytest.mark.parametrize("name", sorted(RULES))
def test_text_rules(mined, name):
    texts, rows = mined
    plain = lambda v: tuple(v) if isinstance(v, tuple) else v
    for i, t in enumerate(texts):
        assert [plain(v) for v in rows[i][name]] == RULES[name](t), (t, rows[i][name])


def test_long_runs_are_read_once(spark):
    long = "a" * 100_000 + " " + "a." * 50_000 + " " + "/".join(["ab"] * 50_000) + " " + "-" * 50_000
    row = spark.createDataFrame([(long,)], "t string").select(*[F.size(getattr(text, n)(F.col("t"))).alias(n) for n in RULES]).first()
    assert row.explicit_paths == 1 and row.frames == 0


def test_kinds(spark):
    cases = {
        ("a/tests_util/x.py", 3): "test", ("a/tests/x.py", 3): "test", ("testsuite.py", 1): "test", ("tests.py", 1): "test", ("a/conftest.py", 1): "test", ("a/migrations/0001_x.py", 1): "migration", ("a/migrations/0001_x.txt", 1): "normal",
        ("conf/global_settings.py", 2): "registry", ("config.py", 2): "registry", ("registry.py", 2): "normal", ("a/__init__.py", 9): "normal", ("a/__init__.py", 10): "registry", ("test_a/x.py", 1): "test",
    }
    df = spark.createDataFrame([(p, n, k) for (p, n), k in cases.items()], "p string, n long, k string")
    assert df.filter(paths.kind(F.col("p"), F.col("n")) != F.col("k")).collect() == []
    guess = {"tests/x.py": "test", "A\\Tests\\x.py": "test", "test_x.py": "test", "a/apps.py": "registry", "a/admin.py": "normal", None: "normal"}
    df = spark.createDataFrame(list(guess.items()), "p string, k string")
    assert df.filter(paths.inferred_kind(F.col("p")) != F.col("k")).collect() == []


def test_anchors_are_several_only_where_the_first_is_not_sure(spark):
    rows = [(1, 1, "a", 9.0), (1, 2, "b", 8.9), (1, 3, "c", 1.0), (2, 1, "a", 9.0), (2, 2, "b", 8.94), (2, 3, "c", 8.93), (2, 4, "d", 8.92), (3, 1, "a", 9.0), (3, 2, "b", 8.85), (4, 5, "z", -3.0)]
    got = {}
    for r in rank.anchors(spark.createDataFrame(rows, "query_id long, node_id long, path string, score double")).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.node_id, r.low_margin))
    # Shares: .550 and .450; nearly equal; .574 and .426.
    assert got == {1: [(1, False)], 2: [(1, True), (2, True), (3, True)], 3: [(1, False)], 4: [(5, False)]}


def places_of(spark, rows):
    """rows: (node_id, path, score), in order."""
    out = spark.createDataFrame([(1, i, p, p.rpartition("/")[0] or ".", "normal", s, k + 1) for k, (i, p, s) in enumerate(rows)], "query_id long, node_id long, path string, cluster string, kind string, score double, place int")
    return out.withColumns({c: F.lit(0.0) for c in rank.BETAS})


def facts_of(spark, primary, low=False, confidence=0.6, most=8, hops=2):
    return spark.createDataFrame([(1, primary, confidence, low, most, hops)], "query_id long, primary double, confidence double, low_margin boolean, most int, hops int")


def chosen(df):
    return [(r.node_id, r.phase) for r in df.orderBy("ord").collect()]


def test_places_of_siblings_and_parents_count_from_zero(spark):
    start = spark.createDataFrame([(1, 0, "anchor", 1)], "query_id long, node_id long, phase string, ord int")
    # The cap is 40 for most 8, from zero: the 41st place is still in, the 42nd isn't.
    rows = [(0, "f/a.py", 10.0)] + [(i, f"other{i}/x.py", 9.0) for i in range(1, 40)] + [(40, "f/b.py", 8.0), (41, "f/c.py", 8.0)]
    assert chosen(select.siblings(places_of(spark, rows), start, facts_of(spark, 10.0))) == [(0, "anchor"), (40, "sibling")]
    # A first score that isn't positive has the floor 0.
    rows = [(0, "f/a.py", -1.0), (1, "f/b.py", -2.0), (2, "f/c.py", -0.2)]
    assert chosen(select.siblings(places_of(spark, rows), start, facts_of(spark, -1.0))) == [(0, "anchor")]
    # A folder at the top has none above it; files at the root aren't parents.
    rows = [(0, "f/a.py", 5.0), (1, "g.py", 4.0), (2, "f/g/x.py", 4.0)]
    assert chosen(select.parents(places_of(spark, rows), start, facts_of(spark, 5.0))) == [(0, "anchor")]
    rows = [(0, "f/g/a.py", 5.0), (1, "f/b.py", 4.0), (2, "f/c.py", 1.0)]
    assert chosen(select.parents(places_of(spark, rows), start, facts_of(spark, 5.0))) == [(0, "anchor"), (1, "parent")]
    # Only whole names are package files.
    rows = [(0, "f/a.py", 5.0), (1, "f/x__init__.py", 4.0), (2, "f/__init__.py", 1.0), (3, "g/__init__.py", 4.0)]
    assert chosen(select.package_markers(places_of(spark, rows), start, facts_of(spark, 5.0))) == [(0, "anchor"), (2, "init")]


def test_neighbours_by_edges_and_their_budget(spark):
    start = spark.createDataFrame([(1, 0, "anchor", 1)], "query_id long, node_id long, phase string, ord int")
    found = spark.createDataFrame([(1, 0, 1)], "query_id long, node_id long, place int")
    rows = [(i, f"f{i}/x.py", 10.0 - i) for i in range(6)]
    edges = spark.createDataFrame([(0, 1, "test-of"), (0, 2, "config-ref"), (3, 0, "inherit"), (2, 4, "call"), (5, 4, "call")], "src long, dst long, edge_type string")
    got = chosen(select.typed_neighbors(places_of(spark, rows), start, found, facts_of(spark, 10.0, low=True), edges))
    # .41, .32, .41 x .28 x .82, then .05; the sixth is three hops off.
    assert got == [(0, "anchor"), (2, "typed:config-ref:1"), (3, "typed:inherit:1"), (4, "typed:call:2"), (1, "typed:test-of:1")]
    assert len(chosen(select.typed_neighbors(places_of(spark, rows), start, found, facts_of(spark, 10.0, confidence=0.6), edges))) == 3
    alone = spark.createDataFrame([(7, 8, "call")], "src long, dst long, edge_type string")
    assert chosen(select.typed_neighbors(places_of(spark, rows), start, found, facts_of(spark, 10.0), alone)) == [(0, "anchor")]


def test_exact_symbols_count_by_what_comes_first(spark):
    nodes = spark.createDataFrame([(1, ["FieldThree", "save", "Model"])], "node_id long, symbols array<string>")
    ask = lambda *terms: rank.symbol_exact(nodes, spark.createDataFrame([(1, list(terms))], "query_id long, terms array<string>")).first().symbol_exact
    assert ask("fieldthree.save", "FieldThree") == pytest.approx(0.7 * 2 + 0.7)  # parts first: the whole name adds nothing
    assert ask("FieldThree", "fieldthree.save") == pytest.approx(2 + 0.7)
    assert ask("Model") == pytest.approx(0.4) and ask("model.x") == pytest.approx(0.7)


def test_term_frequencies_by_tails(spark):
    nodes = spark.createDataFrame([(1, ["save"], "a"), (2, [], "save"), (3, ["x.save"], "b")], "node_id long, lows array<string>, stem_ string")
    q = spark.createDataFrame([(1, ["pkg.save", "x.save"])], "query_id long, terms array<string>")
    got = {r.node_id: r.term_idf for r in rank.term_idf(nodes, q, 3).collect()}
    import math

    pkg, x = math.log(1 + 3 / 2), math.log(1 + 3 / 3)
    assert got == pytest.approx({1: pkg + x, 2: pkg + x, 3: x})
