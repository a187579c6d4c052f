from __future__ import annotations

import json
import random

import pytest

from sparkloom.operators import export, graph, packs, ranking, relations, store
from sparkloom.schema import EDGES, FILES, SYMBOLS


def tables(spark, files, symbols, edges):
    """files: paths; symbols: (name, kind, file number, start, end); edges: (source, target, kind, confidence or None)."""
    f = [(i, p, 0, 1, "h", 0, "python", "python") for i, p in enumerate(files, 1)]
    s = [(i, fid, n, k, a, b, None, None, None, None, None) for i, (n, k, fid, a, b) in enumerate(symbols, 1)]
    e = [(i, a, b, k, 1, 1.0, None if c is None else json.dumps({"confidence": c})) for i, (a, b, k, c) in enumerate(edges, 1)]
    return {"files": spark.createDataFrame(f, FILES), "symbols": spark.createDataFrame(s, SYMBOLS), "edges": spark.createDataFrame(e, EDGES)}


@pytest.fixture(scope="module")
def chain(spark):
    fun = [(n, "function", 1, i * 10 + 1, i * 10 + 5) for i, n in enumerate(["func_a", "func_b", "func_c", "func_d"])]
    return tables(spark, ["src/test.py"], fun, [(2, 3, "call", 0.9), (1, 2, "call", 0.85), (4, 3, "import", 0.4)])


def names(df):
    return [r["name"] for r in df.collect()]


def test_callers_by_id_and_name(chain):
    s, e, f = chain["symbols"], chain["edges"], chain["files"]
    assert names(graph.callers(s, e, f, 3, 1)) == ["func_b", "func_d"]  # 0.9 before the import's floor of 0.85
    assert set(names(graph.callers(s, e, f, "func_c", 2))) == {"func_a", "func_b", "func_d"}
    assert names(graph.callers(s, e, f, 2, 1, 0.95)) == []
    assert names(graph.callers(s, e, f, 2, 1, 0.9)) == ["func_a"]
    assert names(graph.callers(s, e, f, "no_such", 3)) == []
    assert names(graph.callees(s, e, f, "pkg.func_a", 2)) == ["func_b", "func_c"]


def test_cycle_ends_and_leaves_the_root_out(spark):
    t = tables(spark, ["src/cycle.py"], [(n, "function", 1, 1, 2) for n in "abc"], [(1, 2, "call", None), (2, 3, "call", None), (3, 1, "call", None)])
    for walk in (graph.callers, graph.callees):
        assert sorted(names(walk(t["symbols"], t["edges"], t["files"], 1, 10))) == ["b", "c"]


def test_impact_reports_nearer_than_depth(spark):
    sym = [("main", "function", 1, 1, 10), ("helper", "function", 2, 1, 10), ("utils_func", "function", 2, 15, 25), ("test_main", "function", 3, 1, 10), ("other_func", "function", 1, 30, 40)]
    t = tables(spark, ["src/main.py", "src/utils.py", "tests/test_main.py"], sym, [(1, 2, "call", 0.9), (1, 3, "call", 0.8), (4, 1, "call", 0.95), (5, 2, "call", 0.7)])
    s, e, f = t["symbols"], t["edges"], t["files"]
    r = graph.impact(s, e, f, ["helper"], 2)
    assert set(names(r["affected_symbols"])) == {"helper", "main", "other_func"}  # test_main is at distance 2
    assert {x[0] for x in r["affected_files"].collect()} == {"src/main.py", "src/utils.py"}
    assert {x["symbol_id"]: x["fan_in"] for x in r["total_fan_in"].collect()}[2] == 2
    assert [x[0] for x in graph.impact(s, e, f, ["main"], 2)["affected_tests"].collect()] == ["tests/test_main.py"]
    whole = graph.impact(s, e, f, ["src/utils.py"], 2)
    assert "src/utils.py" not in [x["path"] for x in whole["ranked_inspection"].collect()]


def queue_walk(edges, root, depth, floor):
    """First-visit search with a queue, the plain way."""
    sure = {"call": 0.9, "import": 0.85}
    seen, queue = {}, [(root, 1.0, 0)]
    while queue:
        node, conf, d = queue.pop(0)
        if d == depth:
            continue
        for _, a, b, kind, c in edges:
            x = conf * min(1.0, max(c, sure.get(kind, 0.0)))
            if b == node and a != root and a not in seen and x >= floor:
                seen[a] = (round(x, 9), d + 1)
                queue.append((a, x, d + 1))
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_same_as_a_queue(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(1, 14), rng.randint(1, 14), rng.choice(["call", "import", "inherit"]), round(rng.random(), 2)) for _ in range(45)]
    t = tables(spark, ["a.py"], [(f"s{i}", "function", 1, 1, 2) for i in range(14)], pairs)
    got = graph.reach(graph.arcs(t["edges"], t["symbols"]), spark.createDataFrame([(1,), (2,), (2,)], "root bigint"), 3, 0.3).collect()
    for root in (1, 2):
        want = queue_walk([(i, *p) for i, p in enumerate(pairs, 1)], root, 3, 0.3)
        assert {r["node"]: (round(r["confidence"], 9), r["depth"]) for r in got if r["root"] == root} == want


def test_packs_stay_in_their_budget(spark):
    files = [f"src/m{i:02}.py" for i in range(20)] + ["README.md"]
    sym = [(f"func_{i}_{k}", "function", i + 1, 1 + 20 * k, 10 + 20 * k) for i in range(20) for k in range(5)]
    t = tables(spark, files, sym, [(1, 6, "call", 0.9), (11, 6, "call", 0.9), (6, 6, "call", 0.9)])
    full, small = packs.repo_map(t, 100_000), packs.repo_map(t, 300)
    assert len(full["top_files"]) == 20 and 5 <= len(small["top_files"]) < 20
    assert [f["score"] for f in full["top_files"]] == sorted((f["score"] for f in full["top_files"]), reverse=True)
    assert "└── src" in full["tree"] or "├── src" in full["tree"]
    assert next(f for f in full["top_files"] if f["path"] == "src/m01.py")["fan_in"] == 2
    code = spark.createDataFrame([("src/m01.py", "\n".join(f"line {i}" for i in range(1, 200)))], "path string, text string")
    z = packs.zoom(t, "func_1_0", 4000, code)
    assert z["code"].split("\n")[0] == "line 1" and z["code"].split("\n")[-1] == "line 12" and len(z["callers"]) == 2
    assert packs.zoom(t, "src/m01.py:23")["symbol"]["name"] == "func_1_1"
    assert packs.zoom(t, "nothing") is None
    assert packs.impact_pack(t, ["func_1_0"])["affected_files"]


def test_subgraph_walk(spark):
    t = tables(spark, ["a.py"], [(n, "function", 1, 1, 2) for n in "abcd"], [(1, 2, "call", None), (2, 3, "import", None), (1, 3, "call", None), (4, 1, "call", None)])
    nodes, edges = export.subgraph(t["edges"], t["symbols"], 1, 2)
    assert set(nodes) == {1, 2, 3, 4}
    assert (1, 3, "call") not in edges and (2, 3, "import") in edges
    drawn = export.to_mermaid([{"id": i, "name": "x" * 50, "kind": "class"} for i in nodes], edges, "t")
    assert "n2 -.-> n3" in drawn and "x" * 38 not in drawn
    assert "style=dashed" in export.to_dot([{"id": 1, "name": "a", "kind": "class"}], edges)


def test_file_upsert_keeps_ids(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id bigint, path string, size bigint")
    new = spark.createDataFrame([("b", 9), ("d", 4), ("c", 3)], "path string, size bigint")
    assert sorted(map(tuple, store.upsert_files(old, new).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3), (4, "d", 4)]
    empty = old.where("false")
    assert sorted(map(tuple, store.upsert_files(empty, new).select("id", "path").collect())) == [(1, "b"), (2, "c"), (3, "d")]
    assert store.upsert_files(empty, new.where("false")).count() == 0


def test_diff_and_snapshot(spark, tmp_path):
    kind = "path string, mtime bigint, size bigint, content_hash string"
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, None)], kind)
    new = spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("d", 1, 1, "x")], kind)
    assert dict(map(tuple, store.diff_files(new, old).collect())) == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert tuple(store.run_stats(store.diff_files(new, old)).first()) == (3, 1, 1, 1, 1)
    t = store.empty_tables(spark)
    store.write_snapshot(t, str(tmp_path))
    store.write_snapshot(t | {"meta": spark.createDataFrame([("k", "v")], t["meta"].schema)}, str(tmp_path))
    assert store.read_snapshot(spark, str(tmp_path))["meta"].collect()[0]["value"] == "v"


def test_related_tests(spark):
    files = spark.createDataFrame([("src/pay.py",), ("src/tests/test_pay.py",), ("src/pay_test.py",), ("tests/test_total.py",), ("tests/other.py",), ("tests/unrelated.py",)], "path string")
    texts = spark.createDataFrame([("tests/other.py", "from src import pay"), ("tests/unrelated.py", "x")], "path string, text string")
    changed = spark.createDataFrame([("src/pay.py", "Total")], "path string, symbol string")
    got = {r["test_path"]: r["strategy"] for r in relations.related_tests(changed, files, texts).collect()}
    assert got == {"tests/test_total.py": 1, "src/tests/test_pay.py": 2, "src/pay_test.py": 3, "tests/other.py": 4}


def test_ranking_of_empty_tables(spark):
    t = store.empty_tables(spark)
    assert ranking.rank_files(t["files"], t["symbols"], t["edges"]).count() == 0
    assert packs.tree(t["files"]) == "(no files)"
