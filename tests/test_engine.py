"""The whole way over a small project: from files to a graph, and what can be asked of it."""

import json

import pytest

from sparkloom.engine import GraphEngine
from sparkloom.operators import state
from sparkloom.sources import dsl, inputs

FILES = {
    "db/models/fields/__init__.py": "from db import validators\n\n\nclass Field:\n    def clean(self):\n        return validators.check(1)\n\n\nclass CharField(Field):\n    pass\n\n\nclass IntegerField(Field):\n    pass\n",
    "db/models/fields/related.py": "from db.models.fields import Field\n\n\nclass ForeignKey(Field):\n    def resolve(self):\n        return Field()\n",
    "db/validators.py": "def check(x):\n    return x\n",
    "tests/test_fields.py": "from db.models.fields.related import ForeignKey\n\n\ndef test_it():\n    ForeignKey()\n",
    "db/__init__.py": "",
    "main.py": "import db.validators\nfrom db.models.fields import related\n\nrelated.ForeignKey()\n",
}
ISSUE = 'Traceback:\n  File "db/models/fields/related.py", line 5, in resolve\nForeignKey.resolve of `CharField` fails with a queryset and models.Model'


@pytest.fixture(scope="module")
def engine(spark):
    e = GraphEngine(spark)
    e.init(files=spark.createDataFrame(list(FILES.items()), "path string, content string"))
    return e


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame([(1, ISSUE)], "query_id long, text string")


def test_graph_of_the_files(engine):
    nodes = {r.src_path: r.fqn for r in engine.nodes().collect()}
    assert nodes == {"db/models/fields/__init__.py": "App.Fields.Init", "db/models/fields/related.py": "App.Fields.Related", "db/validators.py": "App.Db.Validators", "tests/test_fields.py": "App.Tests.TestFields", "main.py": "App.App.Main"}
    typed = {(r.edge_type, r.src, r.dst) for r in engine.typed.collect()}
    assert ("inherit", "App.Fields.Related", "App.Fields.Init") in typed and ("test-of", "App.Tests.TestFields", "App.Fields.Related") not in typed
    assert ("call", "App.App.Main", "App.Fields.Related") in typed and ("import", "App.Tests.TestFields", "App.Fields.Related") in typed
    text = engine.text().first().text
    assert dsl.serialize(dsl.parse(text)) == text and "Main -> Validators" in text
    meta = json.loads(engine.sidecar().first().value)
    assert {n["fqn"]: n["kind"] for n in meta["nodes"]}["App.Fields.Init"] == "registry" and sum(n["pagerank"] for n in meta["nodes"]) == pytest.approx(1)


def test_lookups_and_slices(engine):
    assert engine.find("Related") == "App.Fields.Related" == engine.find("Fields.Related")
    with pytest.raises(KeyError):
        engine.find("absent")
    assert {r.fqn for r in engine.deps("Main").collect()} == {"App.Db.Validators", "App.Fields.Related"}
    assert {r.fqn for r in engine.callers("Validators", 1).collect()} == {"App.App.Main", "App.Fields.Init"}
    cut = engine.query("Validators", 1, bounds=False).collect()
    assert {r.name for r in cut if r.record == "node"} == {"Main", "Init", "Validators"} and {r.path for r in cut if r.record == "namespace"} == {"App", "App.App", "App.Db", "App.Fields"}
    assert all(r.w == 0 for r in cut if r.record == "namespace") and {(r.src, r.dst) for r in cut if r.record == "edge"} == {("Main", "Validators"), ("Init", "Validators")}
    assert [r.node for r in engine.expand("Related").orderBy("place").collect()][:2] == ["App.Fields.Related", "App.Fields.Init"]


def test_ranking_bundles_and_snippets(engine, issues):
    best = engine.locate(issues).orderBy("place").collect()
    assert best[0].node_id == "App.Fields.Related" and "trace-overlap" in best[0].reasons and best[0].confidence >= 0.3
    for scoring in ("v1", "v2"):
        chosen = engine.blast(issues, scoring=scoring).orderBy("ord").collect()
        assert chosen[0].node_id == "App.Fields.Related" and chosen[0].phase == "anchor"
        assert 2 <= len(chosen) <= 10 and len({r.node_id for r in chosen}) == len(chosen)
    places = engine.locate(issues, 5).orderBy("place").collect()
    assert [r.node_id for r in places].index("App.Fields.Init") < [r.node_id for r in places].index("App.Tests.TestFields")
    shown = {r.node_id: r for r in engine.snippets(issues, engine.blast(issues)).collect()}
    assert shown["App.Fields.Related"].label.startswith("related.py:") and "ForeignKey" in shown["App.Fields.Related"].label
    whole = engine.summary(issues)
    row = whole.first()
    assert row.anchor_file == "db/models/fields/related.py" and row.preset == "crash-fix" and row.omitted_nodes == 5 - len(row.nodes)
    page = engine.as_markdown(whole, engine.snippets(issues, engine.blast(issues))).first().value
    assert "## Snippets" in page and "class ForeignKey" in page
    assert json.loads(engine.as_json(engine.locate(issues)).first().value)["node_id"]


def test_trace_report(engine, issues):
    rows = engine.anchor(issues).orderBy("ord").collect()
    assert (rows[0].role, rows[0].path, rows[0].line) == ("ground_zero", "db/models/fields/related.py", 5)
    assert {r.node_id for r in rows if r.role == "direct_import"} == {"App.Fields.Init"} and {r.node_id for r in rows if r.role == "direct_dependent"} == {"App.App.Main", "App.Tests.TestFields"}


def test_verification(engine, spark):
    bad = engine.records.filter("not (record = 'edge' and src = 'Main' and dst = 'Validators')").unionByName(spark.createDataFrame([("edge", "Validators", "Main", "->")], "record string, src string, dst string, kind string"), allowMissingColumns=True)
    bad = bad.unionByName(spark.createDataFrame([("node", "Lost", "App", "gone/lost.py")], "record string, name string, path string, src string"), allowMissingColumns=True)
    fresh = GraphEngine(spark)
    fresh.records, fresh.files, fresh.facts = bad, engine.files, engine.facts
    got = {(r.kind, r.src, r.dst) for r in fresh.verify().collect()}
    assert ("missing", "App.App.Main", "Validators") in got and ("ghost", "App.Db.Validators", "Main") in got and ("unresolved", "App.Lost", "gone/lost.py") in got
    # Imports of a package file resolve to it by no module name, so its edge has no import to bear it out.
    assert {g for g in got if g[0] == "missing"} == {("missing", "App.App.Main", "Validators")}


def test_state_without_metadata_and_edits(engine, spark, issues):
    again = engine.graph()
    assert dsl.texts(again.withColumn("error", again.error)).first().text == engine.text().first().text
    bare = GraphEngine(spark)
    bare.load(graph_text=engine.text().first().text, files=engine.files)
    assert bare.blast(issues).filter("ord = 1").first().node_id == "App.Fields.Related"  # by the first ranker
    assert bare.locate(issues).orderBy("place").first().node_id == "App.Fields.Related"
    with pytest.raises(ValueError):
        bare.load(graph_text="@L0 A [0,0")
    done = engine.edit(spark.createDataFrame([("db/validators.py", "check", "return x", "return -x"), ("db/validators.py", "absent", "a", "b")], "path string, locator string, old string, new string")).collect()
    assert sorted(map(lambda r: r.edited or "", done)) == ["", "def check(x):\n    return -x\n"]
    boxes = {r.fqn: (r.x, r.y, r.depth) for r in engine.boxes().collect()}
    assert len(boxes) == 5 and all(d == 2 for _, _, d in boxes.values())
    orphan = state.records_of(state.log_of(engine.records.filter("not (record = 'namespace' and path = 'App.Db')"), "a"), "App")
    assert orphan.filter("error is not null").first().error == "no namespace App.Db"


def test_inputs(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"betas": {"lex": 2, "path": 3}, "thresholds": {"topk": 5, "test_admit_terms": ["PyTest"]}}))
    w = inputs.weights(str(tmp_path / "w.json"))
    assert (w["betas"]["lex"], w["betas"]["path_term"], w["betas"]["dunder"], w["topk"], w["margin"], w["tests"]) == (2, 3, 8, 5, 0.1, ["pytest"])
    (tmp_path / "p.json").write_text(json.dumps({"presets": {"x": {"max_files": 3, "max_snippets": 1, "hops": 2, "max_snippet_lines": 9}}}))
    assert inputs.presets(f"file://{tmp_path}/p.json")["x"]["most"] == 3 and inputs.presets()["crash-fix"]["hops"] == 3
    (tmp_path / "i.txt").write_text("text of the file")
    assert inputs.issue_text(spark, path=str(tmp_path / "i.txt")).first().text == "text of the file" and inputs.issue_text(spark, "given", "unread").first().text == "given"
    assert inputs.infer_root(str(tmp_path / "g.txt")) == str(tmp_path) and inputs.infer_root("x/g", str(tmp_path)) == str(tmp_path) and inputs.infer_root("x/g", "none", "own") == "own"
    nodes = spark.createDataFrame([("a/b.py",), ("z/c.py",), ("q.py",)], "src_path string")
    files = spark.createDataFrame([("a/b.py",), ("k/c.py",), ("m/c.py",)], "path string")
    assert {r.src_path: r.file for r in inputs.resolve(nodes, files).collect()} == {"a/b.py": "a/b.py", "z/c.py": "k/c.py", "q.py": None}
    rows = [{"instance_id": f"i{k}", "repo": "r" if k else "s", "FAIL_TO_PASS": '["a.b", "c"]'} for k in range(4)]
    (tmp_path / "cases.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = inputs.cases(spark, str(tmp_path / "cases.jsonl"), "r", 2).collect()
    assert [r.instance_id for r in got] == ["i1", "i2"] and got[0].FAIL_TO_PASS == ["a.b", "c"] and got[0].PASS_TO_PASS == []
