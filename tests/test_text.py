from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import paths, tokens
from sparkloom.functions.stem import stem
from sparkloom.operators import architecture, changes, effects, ingest, modules, search, workspace
from sparkloom.sources import diff, files, manifests, providers, scip
from sparkloom.sources.ignore import Rule, ignored, ignored_with_parents, load_rules
from sparkloom.streaming import watch


def test_token_arithmetic():
    assert [tokens.count(t) for t in ("", "Hello world", "a")] == [0, 3, 1]
    assert tokens.count("def foo():\n    pass", True) == 6
    assert tokens.allocate(1000, {"a": 0.5, "b": 0.3, "c": 0.2}) == {"a": 500, "b": 300, "c": 200}
    assert tokens.allocate(100, {"a": 2, "b": 2}) == {"a": 50, "b": 50}
    assert tokens.window_budget(8192, "repomap") == 2000 and tokens.window_budget(200_000, "zoom") == 8000
    assert tokens.resolve_budget("123") == 123 and tokens.resolve_budget("x", "zoom") == 4000 and tokens.resolve_budget("x", "zoom", 7) == 7
    assert tokens.model_window("m-large-2", {"m": 10, "m-large": 20}) == 10
    assert tokens.status("abcdefg", 1)["remaining"] == -1


def test_truncation():
    text = "word " * 1000
    out = tokens.truncate(text, 50)
    assert len(out) < len(text) and "more" in out
    parts = "# Title\n\nintro\n\n### Small\n\n" + "x " * 400 + "\n\n## Big\n\nkept"
    out = tokens.truncate(parts, 20)
    assert "# Title" in out and "## Big" in out and "### Small" not in out and out.index("# Title") < out.index("## Big")
    assert tokens.truncate("short", 50) == "short" and tokens.truncate("", 5) == "" and tokens.truncate(None, 5) == ""


def test_sections_in_columns_are_those_of_the_function(spark):
    text = "lead\n# A\nbody\n\n## B\n### C\nx\n#### not\n## D  \n"
    rows = tokens.section_rows(spark.createDataFrame([(1, text), (2, "")], "id int, text string"), "id", "text").orderBy("pos").collect()
    want = tokens.sections(text)
    assert [(r["header"], r["priority"], r["tokens"]) for r in rows] == [(p.header, p.priority, tokens.count(p.whole())) for p in want]


@pytest.mark.parametrize("word,want", [("running", "run"), ("authorization", "author"), ("authenticate", "authent"), ("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("relational", "relat"), ("hopping", "hop"), ("generalizations", "gener"), ("adjustable", "adjust"), ("sky", "sky"), ("happy", "happi"), ("ab", "ab")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_search(spark):
    names = spark.createDataFrame([(1, "authenticate"), (2, "authorization"), (3, "login"), (4, "func_a"), (5, "running_job"), (6, "runner"), (7, None), (8, "a func")], "id bigint, name string")
    index = search.postings(names)

    def ids(q):
        return sorted(r["doc_id"] for r in search.search(index, q).collect())

    assert ids("auth*") == [1, 2] and ids("run") == [5] and ids("running*") == [5, 6]
    assert ids('"func a"') == [4] and ids("func_a") == [4] and ids("func AND a") == [4, 8] and ids("^func") == [4]
    assert ids("login OR run") == [3, 5] and ids("func NOT ^func") == [8] and ids("(login OR func) a") == [4, 8]
    assert ids("nothing") == []
    for bad in ("a.b", "x$", "", "(a"):
        with pytest.raises(search.SearchSyntaxError):
            search.search(index, bad)
    assert search.search(search.postings(names.where("false")), "auth*").count() == 0
    radius = search.blast_radius(spark.createDataFrame([("func_a",), (None,)], "name string"), names, index)
    assert [r["symbol_id"] for r in radius.collect()] == [8]


def test_ignore_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("src/main.py", "src/test.pyc", "important.pyc", "build", "build/x", "src/build", "a.log", ".git", "node_modules/p.json", ".hidden/a.py")], "path string")
    from pyspark.sql import functions as F

    rules = load_rules(["# comment", "*.pyc", "node_modules/", "/build", "!important.pyc", "*.log", ""])
    assert len(rules) == 5

    def kept(c):
        return {r[0] for r in df.where(~c).collect()}

    assert kept(ignored(F.col("path"), rules)) == {"src/main.py", "important.pyc", "src/build", "node_modules/p.json", ".hidden/a.py"}
    assert kept(ignored_with_parents(F.col("path"), rules)) == {"src/main.py", "important.pyc", "src/build"}
    assert "a.log" in kept(ignored(F.col("path"), rules, include=[Rule("a.*")])) and "src/main.py" not in kept(ignored(F.col("path"), rules, exclude=[Rule("src")]))


def test_scan_tree(spark, tmp_path):
    for p in ("src/main.py", "src/utils.py", "src/test.pyc", "tests/test_main.py", "node_modules/package.json", "big.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x" * (50 if p != "big.py" else 5000))
    got = files.scan_tree(spark, str(tmp_path), load_rules(["*.pyc", "node_modules/"]), extensions={".py"}, max_size=1000).collect()
    assert {r["path"] for r in got} == {"src/main.py", "src/utils.py", "tests/test_main.py"}
    assert all(r["language"] == "python" and r["size"] == 50 and len(r["content_hash"]) == 64 for r in got)


PY = '''import os, sys
from a.b import c
class Shape(Base):
    """A shape."""
    def area(self):
        return helper(self.width)
    async def load(self):
        pass
def helper(x):
    return os.path.join(x)
'''


def test_line_parsers(spark):
    rows = [(1, "m.py", PY), (2, "v.go", "package main"), (3, "a.cpp", "#include <vector>\nnamespace n { class K {};\nint add(int a) { return go(a); }"), (4, "x.ts", "import {a} from 'mod'\nexport const f = async (x) => x\nclass Q {}"), (5, "l.rs", "use std::io;\npub fn run() {}\nstruct S;"), (6, "e.py", "  \n"), (7, "n.py", None)]
    lines = ingest.lines(spark.createDataFrame(rows, "file_id bigint, path string, text string"))
    found = {}
    for r in ingest.symbols(lines).collect():
        found.setdefault(r["path"], {})[r["name"]] = (r["kind"], r["line"], r["parent_name"], r["docstring"])
    assert found["m.py"] == {"Shape": ("class", 3, None, "A shape."), "area": ("method", 5, "Shape", None), "load": ("method", 7, "Shape", None), "helper": ("function", 9, None, None)}
    assert found["v.go"] == {"v": ("file", 1, None, None)}
    assert {n: k[0] for n, k in found["a.cpp"].items()} == {"n": "namespace", "K": "class", "add": "function"}
    assert {n: k[0] for n, k in found["x.ts"].items()} == {"f": "function", "Q": "class"}
    assert {n: k[0] for n, k in found["l.rs"].items()} == {"run": "function", "S": "class"}
    assert set(found) == {"m.py", "v.go", "a.cpp", "x.ts", "l.rs"}
    assert {(r["file_id"], r["module"], r["name"]) for r in ingest.imports(lines).collect()} == {(1, "os", None), (1, "a.b", "c"), (3, "vector", None), (4, "mod", "{a}"), (5, "std::io", None)}
    assert {(r["name"], r["line_end"]) for r in ingest.symbols(lines).where("file_id = 1").collect()} == {("Shape", 8), ("area", 6), ("load", 8), ("helper", 10)}
    assert {(r["name"], r["line_end"]) for r in ingest.symbols(lines).where("file_id in (3, 5)").collect()} == {("n", 3), ("K", 3), ("add", 3), ("run", 2), ("S", 3)}
    calls = ingest.callsites(lines)
    assert {(r["callee"], r["confidence"]) for r in calls.where("file_id = 1").collect()} == {("helper", 0.3), ("os.path.join", 0.6)}
    assert {r["callee"] for r in calls.where("file_id = 3").collect()} == {"add", "go"}
    named = spark.createDataFrame([(1, 1, "Shape", "class", 3), (2, 1, "area", "method", 5), (3, 1, "helper", "function", 9), (4, 9, "go", "function", 1)], "id bigint, file_id bigint, name string, kind string, line_start int").selectExpr("*", "case line_start when 3 then 8 when 5 then 6 when 9 then 10 else 1 end line_end", "concat('f', file_id) path")
    assert {(r["source_id"], r["target_id"], r["confidence"], r["line"]) for r in ingest.resolve_calls(calls, named).collect()} == {(2, 3, 0.6, 6)}


def test_block_ends():
    py = ["def f():", "", "    if x:", "        y", "", "  # c", "z", "class A:", "    pass", ""]
    assert ingest.block_ends("\n".join(py), "python") == [6, 2, 4, 4, 5, 6, 7, 9, 9, 10]
    c = ["struct S;", "int f(int a)", "{", "  if (a) {", "    g(); }", "}", "class K { int x; };", "void h() {"]
    assert ingest.block_ends("\n".join(c), "cpp") == [1, 6, 6, 5, 5, 6, 7, 8]
    assert ingest.block_ends("", "python") == [1] and ingest.block_ends("", None) == [1]


def test_line_parsers_place_calls(spark):
    lines = ingest.lines(spark.createDataFrame([(1, "m.py", PY)], "file_id bigint, path string, text string"))
    calls = ingest.callsites(lines)
    assert {(r["line"], r["callee"]) for r in calls.collect()} == {(6, "helper"), (10, "os.path.join")}



def test_manifests(spark):
    rows = [
        ("package.json", '{"name": "root", "version": "1", "workspaces": ["packages/*"], "dependencies": {"left": "^1"}, "devDependencies": {"jest": "2"}}'),
        ("packages/a/package.json", '{"name": "a", "dependencies": {"root": "*"}}'),
        ("node_modules/z/package.json", '{"name": "z"}'),
        ("py/pyproject.toml", '[project]\nname = "tool"\ndependencies = ["numpy>=1.2", "plain", "win; sys_platform"]\n[project.optional-dependencies]\ndev = ["pytest"]'),
        ("svc/requirements.txt", "# c\n-r x\nflask==2.0\nrequests\n"),
        ("old/setup.py", "setup(name='old', version='3', install_requires=['six>=1', \"attrs\"])"),
        ("go.mod", "module ex.org/m\n\ngo 1.2\nrequire (\n  a.b/c v1 // indirect\n)\nrequire d.e/f v2\n"),
        ("rs/Cargo.toml", '[package]\nname = "crate"\n[dependencies]\nserde = {version = "1", optional = true}\nrand = "0.8"\n[dev-dependencies]\nq = "1"'),
        ("CMakeLists.txt", "project(App)\nadd_library(core a.cpp)\ntarget_link_libraries(core PUBLIC fmt PRIVATE z)"),
        ("broken/package.json", "{"),
    ]
    m = manifests.parse_manifests(spark.createDataFrame(rows, "path string, text string"))
    assert {r["id"] for r in m.collect()} == {"js:root", "js:a", "py:tool", "py:req:svc", "py:old", "go:ex.org/m", "rs:crate", "cpp:App"}
    edges = manifests.module_edges(m)
    got = [(r["source"], r["target"], r["kind"], r["version"]) for r in edges.collect()]
    D, V = manifests.DEPENDS, manifests.DEV
    assert {("js:root", "js:left", D, "^1"), ("js:root", "js:jest", V, "2"), ("js:root", "js:a", "EXPORTS_TO", None), ("js:a", "js:root", "IMPORTS_FROM", None), ("py:tool", "py:numpy", D, ">=1.2"), ("py:tool", "py:win", D, None), ("py:tool", "py:pytest", V, None), ("py:req:svc", "py:flask", D, "==2.0"), ("py:old", "py:six", D, ">=1"), ("go:ex.org/m", "go:a.b/c", D, "v1"), ("go:ex.org/m", "go:d.e/f", D, "v2"), ("rs:crate", "rs:serde", D, "1"), ("rs:crate", "rs:q", V, "1"), ("cpp:App", "cpp:core", "EXPORTS_TO", None), ("cpp:core", "cpp:fmt", D, None), ("cpp:core", "cpp:z", D, None)} <= set(got)
    assert got.count(("js:a", "js:root", D, "*")) == 2  # once of its own, once by the workspace
    inner = modules.resolve_internal(edges, m).where("is_internal and kind = 'MODULE_DEPENDS_ON'").select("target").distinct().collect()
    assert [r[0] for r in inner] == ["js:root"]
    assert "subgraph GO" in modules.to_mermaid(m, edges) and '[label="^1"]' in modules.to_dot(m, edges)
    assert {r["direction"] for r in modules.dependencies_of(edges, "js:a").collect()} == {"depends_on", "depended_by"}


def test_diff_hunks(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n-old\n+new\n+more\n@@ -9 +10 @@ def f\n-a\n+b\n+++ b/y.py\n@@ -0,0 +1 @@\n+z"
    rows = diff.hunks(spark.createDataFrame([(1, text)], "diff_id int, text string")).orderBy("hunk").collect()
    assert [tuple(r)[1:] for r in rows] == [("x.py", 1, 1, 2, 1, 3, 2, 1), ("x.py", 2, 9, 1, 10, 1, 1, 1), ("y.py", 3, 0, 0, 1, 1, 1, 0)]
    assert {r["path"] for r in diff.changed_files(spark.createDataFrame([(1, text)], "diff_id int, text string")).collect()} == {"x.py", "y.py"}


def test_scip(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"documents": [{"relative_path": "a.py", "language": "python", "occurrences": [{"range": [3, 4, 9], "symbol": "s1", "symbol_roles": 1}, {"range": [7, 0, 5], "symbol": "s1", "symbol_roles": 0}], "symbols": [{"symbol": "s2", "relationships": [{"symbol": "s1", "is_reference": true}]}]}]}')
    docs = scip.read_index(spark, str(tmp_path / "i.json"))
    occ = scip.occurrences(docs)
    at = spark.createDataFrame([(1, "a.py", 7, 20), (2, "a.py", 8, 0)], "point_id int, path string, line int, character int")
    assert [(r["point_id"], r["line"]) for r in scip.definitions(occ, at).collect()] == [(1, 3)]
    assert scip.references(occ, at).count() == 2
    assert {(r["other"], r["direction"], r["line"]) for r in scip.call_hierarchy(scip.symbols(docs), occ).collect()} == {("s1", "incoming", 3), ("s1", "incoming", 7)}
    assert tuple(scip.statistics(docs).first())[:3] == (1, 2, 1)


def test_first_provider_that_answers(spark):
    raw = spark.createDataFrame([([("a.py", "python", [([0, 4], "f", 1)], [("f", "F", "17", ["doc"], [])])],), ([("b.py", "python", [([3, 1], "g", 1)], [("g", "G", "Module", [], [])])],)], scip.SCHEMA)
    one, two = (scip.documents(raw.where(F.col("documents")[0]["relative_path"] == p)) for p in ("a.py", "b.py"))
    every = providers.Composite([providers.NoProvider(spark), providers.ScipProvider(one), providers.ScipProvider(one.unionAll(two))])
    points = spark.createDataFrame([(1, "a.py", 0, 5), (2, "b.py", 3, 0), (3, "c.py", 0, 0)], "point_id bigint, path string, line int, character int")
    assert sorted(map(tuple, every.definitions(points).select("point_id", "symbol", "path").collect())) == [(1, "f", "a.py"), (2, "g", "b.py")]
    assert sorted(map(tuple, every.document_symbols().select("symbol", "kind").collect())) == [("f", "file"), ("g", "Module")]
    assert [tuple(r) for r in every.imports().select("path", "symbol").collect()] == [("b.py", "g")]


def test_effects(spark):
    t = spark.createDataFrame([(1, "a.py", 1, "x = session.query(A)\nraise ValueError(x)"), (2, "a.py", 5, "return a + b"), (3, "a.py", 9, "raise KeyError")], "symbol_id int, path string, line int, text string")
    e = effects.function_effects(t)
    got = {(r["symbol_id"], r["effect"]): r["n"] for r in e.collect()}
    assert got == {(1, "DB_READ"): 2, (1, "THROWS_EXCEPTION"): 2, (2, "PURE"): 1, (3, "THROWS_EXCEPTION"): 1}
    assert {r["symbol_id"]: r["is_pure"] for r in effects.purity(e).collect()} == {1: False, 2: True, 3: True}
    assert tuple(effects.totals(e).first()) == (3, 2, 1, 0)
    assert {r["symbol_id"]: r["exceptions"] for r in effects.thrown(t).collect()} == {1: ["ValueError"], 3: ["KeyError"]}
    assert (1, "DB_READ", 1) in {(r["symbol_id"], r["effect"], r["line"]) for r in effects.effect_lines(t).collect()}


def test_architecture(spark):
    c = spark.createDataFrame([("app/routes/a.py", "from flask import Flask\n@app.route('/')"), ("app/models/m.py", "class UserModel: pass"), ("app/x.py", "import flask\nclass ThingFactory:\n  def create(self): pass"), ("app/n.txt", None)], "path string, text string")
    f = {r["name"]: (r["confidence"], r["n_files"]) for r in architecture.frameworks(c, ["python"]).collect()}
    assert f["Flask"] == (0.7, 2) and "Qt" not in f
    assert {r["path"]: r["layer"] for r in architecture.layers(c).collect()} == {"app/routes/a.py": "routes", "app/models/m.py": "models"}
    assert {r["pattern"] for r in architecture.patterns(c).where("found").collect()} == {"Factory Pattern"}
    assert architecture.advice(c).count() == 1
    assert architecture.entry_snippets(c).where("name = 'Flask'").count() == 1


def test_risk_and_queue(spark):
    changed = spark.createDataFrame([("src/api/__init__.py", "Pub", "class", 1, "class Pub:"), ("src/x.py", "_own", "function", 1, "def _own():"), ("w.rs", "run", "function", 1, "pub fn run()")], "path string, name string, kind string, line_start int, line_text string")
    risk = changes.api_risk(changed)
    assert {r["path"]: r["level"] for r in risk.collect()} == {"src/api/__init__.py": "high", "src/x.py": "low", "w.rs": "medium"}
    queue = changes.inspection_queue(changed, risk, spark.createDataFrame([("other",)], "name string")).collect()
    assert [(r["priority"], r["symbol"]) for r in queue] == [(1, "Pub"), (1, "run"), (2, "Pub"), (2, "_own"), (2, "run"), (3, "other")]


def test_workspace(spark, tmp_path):
    w = workspace.Workspace.create(["/a/one", "/a/two"])
    w.add("/b/three")
    assert [(r.name, r.priority) for r in w.repos] == [("one", 2), ("two", 1), ("three", 2)] and w.remove("two") and not w.remove("two")
    w.save(str(tmp_path / "w.json"))
    assert workspace.Workspace.load(str(tmp_path / "w.json")) == w
    s = spark.createDataFrame([(1, 1, "Pay_Total", "f", 3)], "id bigint, file_id bigint, name string, kind string, line_start int")
    f = spark.createDataFrame([(1, "x.py")], "id bigint, path string")
    hit = workspace.find_symbol(workspace.unite({"one": s, "two": s}), workspace.unite({"one": f, "two": f}), "y_t").collect()
    assert sorted(r["repo"] for r in hit) == ["one", "two"]


def test_debounce_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("2024-01-01 00:00:00", "modified", "a.py"), ("2024-01-01 00:00:01", "modified", "b.py"), ("2024-01-01 00:00:01", "created", "a.py"), ("2024-01-01 00:00:10", "modified", "c.py"), ("2024-01-01 00:00:11", "modified", "node_modules/d.js"), ("2024-01-01 01:00:00", "modified", "z.py")]
    batch = spark.createDataFrame(rows, "ts string, change_type string, path string").selectExpr("cast(ts as timestamp) ts", "change_type", "path")
    batch.write.parquet(str(src))
    want = {(r["n_changes"], tuple(r["paths"])) for r in watch.debounce(watch.relevant(batch)).collect()}
    assert want == {(3, ("a.py", "b.py")), (1, ("c.py",)), (1, ("z.py",))}
    got: list = []
    stream = watch.debounce(watch.relevant(spark.readStream.schema(batch.schema).parquet(str(src))))
    q = watch.on_batches(stream, lambda df, epoch: got.extend((r["n_changes"], tuple(r["paths"])) for r in df.collect()), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert set(got) == want - {(1, ("z.py",))}  # the last batch waits for the watermark to pass it


def test_path_labels(spark):
    rows = [("a/b.test.PY",), (".bashrc",), ("x/noext",), ("src/foo_test.go",)]
    df = spark.createDataFrame(rows, "p string")
    from pyspark.sql import functions as F

    got = df.select(paths.language_of(F.col("p")), paths.stem(F.col("p")), paths.is_test_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("python", "b.test", False), (None, ".bashrc", False), (None, "noext", False), ("go", "foo_test", True)]
