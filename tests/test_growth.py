"""Work that follows the input: no step makes more rows, or holds more of them, than it must."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import effects, ingest, search, store
from sparkloom.plans import code, sources
from sparkloom.plans.views import Index
from sparkloom.sources import diff, scip
from tests.plans import rows_of_nodes
from tests.test_queries import SF

_OCCURRENCE = "path string, at int, symbol string, line int, character int, is_definition boolean"
_POINT = "point_id bigint, path string, line int, character int"


def _crowded(spark, n: int):
    """n occurrences and n points on one line, at few characters."""
    occ = spark.createDataFrame([("a", k, f"s{k % 7}", 1, (k * 7 + 60) % 200, k % 5 == 0) for k in range(n)], _OCCURRENCE)
    return occ, spark.createDataFrame([(k, "a", 1, k % 230 - 20) for k in range(n)], _POINT)


def test_symbol_at_doesnt_compare_every_point_with_every_occurrence(spark):
    occ, points = _crowded(spark, 2000)
    found = scip.symbol_at(occ, points)
    want = {k: min((at, f"s{at % 7}") for at in range(2000) if abs((at * 7 + 60) % 200 - (k % 230 - 20)) < 50)[1] for k in range(2000)}
    assert {r["point_id"]: r["symbol"] for r in found.collect()} == want
    assert max(rows_of_nodes(found)) < 60_000  # each with each: 1 million near ones


def test_reference_counts_makes_no_row_for_each_reference(spark):
    occ, points = _crowded(spark, 1000)
    counted = scip.reference_counts(occ, points)
    each = {}
    for r in scip.references(occ, points).collect():
        n, k = each.get((r["point_id"], r["symbol"]), (0, 0))
        each[r["point_id"], r["symbol"]] = n + 1, k + r["is_definition"]
    assert {(r["point_id"], r["symbol"]): (r["n"], r["n_definitions"]) for r in counted.collect()} == each
    assert max(rows_of_nodes(counted)) < 60_000  # references: 140 thousand


def _text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_file_is_parsed_in_one_pass(spark):
    """No shuffle of lines, and the function that finds block ends stands in the plan once."""
    files = spark.createDataFrame([(1, "a.py", "class A:\n    def f(self):\n        pass\ndef g(): pass\n    def h(): pass"), (2, "b.py", "x = 1"), (3, "c.cpp", "namespace n {\nclass K {\n};\n}"), (4, "d.go", "package p")], "file_id bigint, path string, text string")
    found = ingest.symbols(ingest.lines(files))
    plan = _text(found)
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert sorted((r["file_id"], r["line"], r["name"], r["kind"], r["parent_name"]) for r in found.collect() if r["parent_name"]) == [(1, 2, "f", "method", "A"), (1, 5, "h", "method", "A")]
    assert sorted((r["file_id"], r["name"], r["kind"]) for r in found.where("kind <> 'method'").collect()) == [(1, "A", "class"), (1, "g", "function"), (2, "b", "file"), (3, "K", "class"), (3, "n", "namespace"), (4, "d", "file")]


def test_work_on_files_is_shared_out(spark, monkeypatch):
    monkeypatch.setattr("sparkloom.runtime.ROWS", 20)
    x = Index(spark, SF)
    n = -(-x.raw("part").count() // 20)
    assert n > 4 and code.contents(x).rdd.getNumPartitions() == n
    symbols = code.numbered(x)
    assert symbols.rdd.getNumPartitions() > 4
    ordered = [r["id"] for r in symbols.orderBy("path", "line_start", "ord").select("id").collect()]
    assert ordered == list(range(1, len(ordered) + 1))


def test_ids_follow_the_order_of_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartitionByRange(7, "k")
    for got in (store.with_ids(rows, ["k"], 5, ranged=True), store.in_order(rows.sortWithinPartitions("k"), 5)):
        assert {r["k"]: r["id"] for r in got.collect()} == {k: k + 5 for k in range(1000)}


@pytest.mark.parametrize("text", ['CONFIG["a"] = x', "global  n; sys.path", "a" * 500, "x = [1] + {}\ny = {2}", "", None])
def test_mutations_are_those_of_the_plain_pattern(spark, text):
    texts = spark.createDataFrame([(1, text)], "symbol_id int, text string")
    spec = effects.patterns_of(next(s for n, _, s in effects.CATALOGUE if n == "GLOBAL_MUTATION"))
    plain = [F.regexp_extract_all("text", F.lit(rf"(?s)(.{{0,20}}(?-s:{p}).{{0,20}})"), 1) for p in spec]
    want = texts.select(F.explode(F.array_distinct(F.transform(F.flatten(F.array(*plain)), F.trim))).alias("m"))
    assert sorted(r["mutation"] for r in effects.mutations(texts).collect()) == sorted(r["m"] for r in want.collect())


def test_mutations_look_before_they_capture(spark):
    """The costly pattern stands behind the plain one."""
    texts = spark.createDataFrame([(1, "x")], "symbol_id int, text string")
    assert _text(effects.mutations(texts)).count("RLIKE") == 7


def test_lines_of_diffs_are_neither_sent_nor_sorted(spark):
    text = "+++ b/x.py\r\n@@ -1 +1 @@\n-a\n+++ y.py\n@@ -2,3 +2 @@ f\n+++ "
    diffs = spark.createDataFrame([(1, text), (2, None), (3, "")], "diff_id int, text string")
    rows = diff.diff_lines(diffs)
    assert "Window" not in _text(rows) and "Exchange" not in _text(rows)
    got = [(r["at"], r["path"], r["hunk"]) for r in rows.where("diff_id = 1").orderBy("at").collect()]
    assert got == [(0, "x.py", 0), (1, "x.py", 1), (2, "x.py", 1), (3, "y.py", 1), (4, "y.py", 2), (5, "y.py", 2)]
    files = diff.changed_files(diffs.unionAll(diffs))
    assert "Window" not in _text(files)
    assert sorted((r["diff_id"], r["path"]) for r in files.collect()) == [(1, "x.py"), (1, "y.py")]


def test_postings_of_a_common_word_are_shared_out(spark):
    """All names hold one word, and many ask for it: its join and the counts after it are split."""
    names = spark.createDataFrame([(k, f"common w{k % 50}") for k in range(2000)], "id bigint, name string")
    found = search.blast_radius(names.where("id < 50").select("name"), names, search.postings(names), per_symbol=3)
    assert "share#" in _text(found)
    assert found.count() == 0  # all texts with both words have the same name
    other = search.blast_radius(spark.createDataFrame([("common",), ("W7 common",), (None,)], "name string"), names, search.postings(names), per_symbol=3)
    assert sorted((r["changed_name"], r["symbol_id"]) for r in other.collect()) == [("W7 common", 7), ("W7 common", 57), ("W7 common", 107), ("common", 0), ("common", 1), ("common", 2)]


def test_conditions_on_texts_are_tested_where_the_files_are_sent(spark):
    plan = _text(code.contents(Index(spark, SF)).where(F.col("text").rlike("needle")))
    assert 0 < plan.index("needle") < plan.index("Exchange")  # the plan has its source last


def test_targets_are_found_without_edges(spark, monkeypatch):
    """Neither call is resolved nor an edge numbered to look a symbol up; a zoom makes its edges once."""
    made = []
    resolve = ingest.resolve_calls
    monkeypatch.setattr(ingest, "resolve_calls", lambda *a: made.append(a) or resolve(*a))
    x = Index(spark, SF)
    assert set(sources._named_tables(x)) == {"files", "symbols"} and not made
    edges = sources._code_tables(x)["edges"]
    assert len(made) == 1 and edges.select("id").distinct().count() == edges.count() > 0
