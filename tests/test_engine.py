from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkloom.__main__ import parser, run
from sparkloom.config import Config
from sparkloom.engine import Engine
from sparkloom.operators import store
from sparkloom.streaming.watch import Watch

FILES = {
    "src/main.py": "from flask import Flask\nfrom utils import helper, Box\n\ndef main():\n    x = 1\n    helper(x)\n    return Box()\n",
    "src/utils.py": 'class Box:\n    """A box."""\n    def open(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n',
    "tests/test_main.py": "def test_main():\n    y = 2\n    main()\n",
    "src/__init__.py": "",
    "package.json": '{"name": "app"}',
    "node_modules/x/index.js": "function gone() {}",
}


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def seen(t) -> dict[str, set]:
    """The tables without numbers, which depend on history."""
    files = t["files"].select(F.col("id").alias("file_id"), "path")
    s = t["symbols"].join(files, "file_id")
    named = s.select("id", F.concat_ws(":", "path", "name", "line_start").alias("n"))
    e = t["edges"].join(named.select(F.col("id").alias("source_id"), F.col("n").alias("a")), "source_id").join(named.select(F.col("id").alias("target_id"), F.col("n").alias("b")), "target_id").join(files, "file_id")
    c = t["callsites"].join(e.select(F.col("id").alias("edge_id"), "a", "b"), "edge_id")
    pick = lambda df, *cols: set(map(tuple, df.select(*cols).collect()))
    assert t["edges"].count() == e.count() and t["callsites"].count() == c.count()
    return {
        "files": pick(t["files"], "path", "size", "content_hash", "language"),
        "symbols": pick(s, "path", "name", "kind", "line_start", "line_end", "signature", "docstring"),
        "edges": pick(e, "a", "b", "kind", "confidence", "path"),
        "callsites": pick(c, "a", "b", "line", "context"),
        "imports": pick(t["imports"].join(files, "file_id"), "path", "line", "module", "name", "alias"),
        "postings": pick(t["postings"].join(named, F.col("id") == F.col("doc_id")), "n", "term", "tf"),
    }


def test_index_and_commands(spark, tmp_path):
    root, at = tmp_path / "repo", str(tmp_path / "index")
    put(root, FILES)
    ask = lambda *a: run(spark, parser().parse_args(["--root", str(root), "--store", at, *a]))
    assert json.loads(ask("index")[1])["new"] == 4
    t = Engine(spark, str(root), at).tables()
    ids = {r["name"]: r["id"] for r in t["symbols"].collect()}
    assert set(ids) == {"main", "Box", "open", "helper", "test_main", "__init__"}
    edges = {(r["source_id"], r["target_id"], r["kind"]) for r in t["edges"].collect()}
    call = {("main", "helper"), ("main", "Box"), ("open", "helper"), ("test_main", "main")}
    assert edges == {(ids[a], ids[b], "call") for a, b in call} | {(ids["main"], ids["helper"], "import"), (ids["main"], ids["Box"], "import")}
    assert t["symbols"].where("name = 'open'").first()["parent_id"] == ids["Box"]
    assert {(r["line"], r["context"]) for r in t["callsites"].collect()} == {(6, "helper"), (7, "Box"), (4, "helper"), (3, "main")}
    assert json.loads(ask("index")[1])["unchanged"] == 4
    (root / "src/utils.py").write_text("def helper(x):\n    return 3\n")
    os.remove(root / "src/__init__.py")
    stats = json.loads(ask("index")[1])
    assert (stats["changed"], stats["deleted"], stats["unchanged"]) == (1, 1, 2)
    assert "`src/main.py`" in ask("repomap")[1]
    assert "helper" in ask("find", "help*")[1]
    code, text = ask("zoom", "main")
    assert code == 0 and "def main():" in text and "return Box()" in text and "test_main" in text
    assert ask("zoom", "nothing")[0] == 1
    assert "src/main.py" in ask("impact", "src/main.py")[1]
    assert "Change analysis" in ask("impact", "--include-tests", "src/main.py")[1]
    assert "graph TD" in ask("graph", "main")[1]
    assert "[app]" in ask("depgraph")[1]
    assert "Flask" in ask("architecture")[1] and "Flask" in ask("--format", "json", "architecture")[1]
    assert json.loads(ask("index", "-e", "tests/")[1])["deleted"] == 1
    assert json.loads(ask("index", "-s", "30")[1])["scanned"] == 1


@pytest.mark.parametrize("uri", [False, True])
def test_an_increment_gives_what_a_forced_run_gives(spark, tmp_path, uri):
    root = tmp_path / "repo"
    put(root, FILES | {"lib/a.cpp": '#include "b.h"\nint go(int x) {\n  return step(x);\n}\n', "lib/b.h": "int step(int x) {\n  return x; }\n"})
    at = lambda name: (tmp_path / name).as_uri() if uri else str(tmp_path / name)
    e = Engine(spark, root.as_uri() if uri else str(root), at("index"))
    assert e.index().first()["new"] == 6
    # a callee's file is altered, a nearer callee comes, a file goes and one moves
    put(root, {"src/utils.py": "\n\ndef helper(x, y):\n    return x\n", "src/again.py": "def step(x):\n    return helper(x, 2)\n"})
    os.remove(root / "tests/test_main.py")
    os.rename(root / "lib/b.h", root / "lib/c.h")
    assert tuple(e.index().first()) == (6, 2, 1, 3, 2)
    whole = Engine(spark, e.root, at("other"))
    whole.index(force=True)
    increment, forced = seen(e.tables()), seen(whole.tables())
    assert increment == forced
    assert ("src/main.py:main:4", "src/utils.py:helper:3", "call", 0.4, "src/main.py") in forced["edges"]
    assert e.has_index() and not Engine(spark, e.root, at("none")).has_index()


def test_one_writer_at_a_time_and_whole_snapshots(spark, tmp_path):
    at = str(tmp_path)
    with store.lock(at):
        with pytest.raises(store.Locked), store.lock(at, wait=0):
            pass
    (tmp_path / "lock").write_text(json.dumps({"host": __import__("socket").gethostname(), "pid": 2**22 + 1, "since": 0}))
    with store.lock(at, wait=0):
        pass
    t = store.empty_tables(spark)
    first = store.write_snapshot(t, at)
    with pytest.raises(Exception):
        store.write_snapshot(t | {"meta": spark.range(1).select(F.raise_error(F.lit("no")).alias("key"))}, at)
    assert store.current(at) == first
    for _ in range(store.KEPT):
        last = store.write_snapshot(t, at)
    assert store.current(at) == last and not (tmp_path / first).exists() and len(store._versions(at)) == store.KEPT


def test_watch_indexes_after_changes(spark, tmp_path):
    root = tmp_path / "repo"
    put(root, {"a.py": "def f():\n    return 1\n"})
    w = Watch(Engine(spark, str(root), str(tmp_path / "index")), quiet=0.1, period=0.1)
    runs = w.run(batches=2)
    assert next(runs)["new"] == 1
    put(root, {"b.py": "def g():\n    return 2\n", "skipped.log": "x"})
    assert tuple(next(runs).values()) == (2, 1, 0, 1, 0)
    assert list(runs) == [] and w.stats == {"runs": 2, "changed_files": 2}


def test_workspace_and_settings(spark, tmp_path):
    put(tmp_path, {"one/util.py": "def f():\n    return 1\n", "two/main.py": "import util\n\ndef g():\n    return 2\n", "c.json": '{"max_size": 99, "ignore": ["x/"]}'})
    assert Config.load(tmp_path / "c.json").max_size == 99 and Config.load(tmp_path / "none").max_size == 1 << 20
    Config(max_size=5).save(tmp_path / "d.json")
    assert Config.load(tmp_path / "d.json") == Config(max_size=5)
    (tmp_path / "bad.json").write_text('{"what": 1}')
    with pytest.raises(ValueError):
        Config.load(tmp_path / "bad.json")
    ask = lambda *a: run(spark, parser().parse_args([*a]))[1]
    w = str(tmp_path / "w.json")
    ask("workspace-init", w, str(tmp_path / "one"), str(tmp_path / "two"))
    for name in ("one", "two"):
        Engine(spark, str(tmp_path / name)).index()
    assert json.loads(ask("workspace-graph", w))["links"] == [{"from_repo": "two", "to_repo": "one", "module": "util", "n": 1}]
    assert [r["name"] for r in json.loads(ask("workspace-find", w, "g"))] == ["g"]
