import pytest

from sparkloom.operators import graph
from sparkloom.sources import code, dsl

DOC = """# a comment
@L0 App [0,0,100,100] "src" {
  boot [1,1,8,4] main.py lines=10..40 {new -> ready ~> done}
  @L1 Core [2,2,36,46] "core/*.py" {
    Scene [1,6,12,6] "my scene.py" type:test
    Other [1,1,12,6]
  }
}
=== edges ===
boot -> Scene
Scene ~> Scene
"""


def test_records_of_a_document():
    rows = dsl.parse(DOC)
    assert [(r["record"], r.get("name")) for r in rows] == [("namespace", "App"), ("node", "boot"), ("namespace", "Core"), ("node", "Scene"), ("node", "Other"), ("edge", None), ("edge", None)]
    boot, scene = rows[1], rows[3]
    assert (boot["src"], boot["line_start"], boot["line_end"], boot["states"], boot["path"]) == ("main.py", 10, 40, ["new", "ready", "done"], "App")
    assert (scene["src"], scene["node_type"], scene["path"], scene["y"]) == ("my scene.py", "test", "App.Core", 6)
    assert [(r["src"], r["kind"], r["dst"]) for r in rows[5:]] == [("boot", "->", "Scene"), ("Scene", "~>", "Scene")]


def test_writing_is_a_fixed_point():
    once = dsl.serialize(dsl.parse(DOC))
    assert dsl.serialize(dsl.parse(once)) == once
    assert once.index("Other") < once.index("Scene [")
    strip = lambda rows: sorted(str({k: v for k, v in r.items() if k != "ord"}) for r in rows)
    assert strip(dsl.parse(once)) == strip(dsl.parse(DOC))


@pytest.mark.parametrize("text, line", [("", 1), ("@L0 A [0,0,1,1] {", 1), ("@L0 A [0,0,1,1] {\n}\n@L0 B [0,0,1,1] {\n}", 3), ("@L0 A [0,0,1,1] {\n  ?\n}", 2), ("=== edges ===\na -> b", 1), ("@L0 A [0,0,1,1] {\n=== edges ===\na -> b\nc [0,0,1,1]\n}", 4)])
def test_errors_have_places(text, line):
    with pytest.raises(dsl.ParseError) as e:
        dsl.parse(text)
    assert e.value.line == line


def test_files_by_format_and_by_function(spark, tmp_path):
    (tmp_path / "a.graph").write_text(DOC)
    (tmp_path / "bad.graph").write_text("nothing")
    spark.dataSource.register(dsl.GraphSource)
    one = spark.read.format("loomgraph").load(str(tmp_path)).collect()
    two = dsl.read(spark, str(tmp_path)).collect()
    assert len(one) == len(two) == 8
    assert sum(r.error is not None for r in one) == sum(r.error is not None for r in two) == 1
    docs = spark.createDataFrame([("x", DOC), ("y", None)], "graph_id string, text string")
    assert {r.graph_id: r.text for r in dsl.texts(dsl.records(docs)).collect()} == {"x": dsl.serialize(dsl.parse(DOC))}


SOURCE = '''import os
from app.models import Base, helper as h

class Child(Base, app.Mixin):
    def go(self):
        return h("conf.settings.value")

def free():
    return 1
'''


def test_references_spans_edits_and_snippets():
    assert code.references(SOURCE) == [("import", "os"), ("import", "app.models"), ("import", "app.models.Base"), ("import", "app.models.helper"), ("inherit", "Base"), ("inherit", "app.Mixin"), ("config-ref", "conf.settings.value")]
    assert code.references("def (:\nimport x.y") == [("import", "x.y")]
    assert code.references(None) == []
    assert code.spans(SOURCE) == [("Child", 4, 6), ("Child.go", 5, 6), ("go", 5, 6), ("free", 8, 9)]
    go = code.locate(SOURCE, "go")
    assert (go["locator"], go["line_start"], go["line_end"], SOURCE[go["char_start"] : go["char_end"]].split("\n")[0]) == ("Child.go", 5, 6, "def go(self):") and code.locate(SOURCE, "absent") is None
    odd = "class É:\n    def é(self): x = 'ü'; return 1\ndef g():\n    def é(): pass\n"
    at = code.locate(odd, "É.é")
    assert odd[at["char_start"] : at["char_end"]] == odd.encode()[at["byte_start"] : at["byte_end"]].decode() == "def é(self): x = 'ü'; return 1"
    assert code.locate(odd, "é") is None and code.locate(odd, "g.é")["line_start"] == 4
    assert code.edit("\ufeff" + odd, "É.é", "return 1", "return 2") == "\ufeff" + odd.replace("return 1", "return 2")
    assert code.edit(SOURCE, "free", "return 1", "return 2").endswith("return 2\n")
    assert code.edit(SOURCE, "Child.go", "return 1", "x") is None
    assert code.edit(SOURCE, "Child", "e", "x") is None
    assert code.references("import a.b\nfrom c import d\na.x(1)\nb.y(2)\nd(3)\nd.e.f(4)")[-2:] == [("call", "b"), ("call", "d")]
    assert code.snippet("p/m.py", SOURCE, ["free"], [], [], 80) == ("m.py:3-9 (free)", "\n".join(f"{i}: {x}" for i, x in enumerate(SOURCE.splitlines(), 1) if i > 2))
    assert code.snippet("p/m.py", SOURCE, [], [], [("other.py", 2), ("m.py", 5)], 2)[0] == "m.py:4-5 (trace-line 5)"
    assert code.snippet("p/m.py", SOURCE, [], [], [], 3, (4, 9))[0] == "m.py:4-6 (declared-lines)"
    assert code.snippet("p/m.py", SOURCE, [], [], [], 3)[0] == "m.py:1-3 (file-head)"
    assert code.snippet("p/m.py", "", ["free"], [], [], 3, (1, 1)) == ("m.py:0-0 (empty-file)", "")
    assert code.line_imports("from m import ( a, b\nfrom n import (c), d as e # x\nimport q.r as z\nfrom . import y") == ["q.r", "m", "m.b", "n", "n.c", "n.d"]
    migration = "dependencies = [('Auth', '0001')]\nx = [migrations.AddField(model_name='Book', name='title'), migrations.RunSQL('select')]"
    assert code.migrations(migration) == ["auth", "book", "title", "select"]


def test_scans_leave_out_folders_and_markers(spark, tmp_path):
    for p, text in {"a/x.py": "import os\n", "a/__init__.py": "", "node_modules/y.py": "x", "b/skip.py": "x", "own/pyvenv.cfg": "", "own/z.py": "x", "b/__init__.py": "x\n" * 12}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    got = {r.path: r.loc for r in code.scan(spark, str(tmp_path), ["# none", "skip.py"]).collect()}
    assert got == {"a/x.py": 1, "b/__init__.py": 12}


def test_ranks_of_a_small_graph(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 0.5), ("a", "z", 1.0), ("a", "c", 0.0)], "src string, dst string, weight double")
    got = {r.node: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    assert got == pytest.approx({"a": 0.331974, "b": 0.319678, "c": 0.310848, "d": 0.0375}, abs=1e-5)
