"""More queries over texts made from the driver's columns: manifests, diffs, code-intelligence indexes, search, reports, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.benchmark import parse_stats
from sparkloom.functions import tokens
from sparkloom.operators import changes, graph, ingest, modules, packs, ranking, relations, search, store, workspace
from sparkloom.plans.code import _RESOLVED, code, contents, numbered, placed
from sparkloom.plans.queries import ROOT, _AFFECTED, _CALLERS, _nodes, _walk, query
from sparkloom.plans.views import Index
from sparkloom.runtime import cut
from sparkloom.sources import diff, manifests, scip
from sparkloom.sources.ignore import ignored_with_parents, load_rules
from sparkloom.streaming.watch import relevant

# manifests -----------------------------------------------------------------------

_S = "CAST(s_suppkey AS STRING)"


def _mod(n: int) -> str:
    return f"CAST(s_suppkey % {n} AS STRING)"


def _lines(*parts: str) -> str:
    return "concat(" + ", ".join(f"{p}, chr(10)" for p in parts) + ")"


_TEXTS = [
    f"""concat('{{"name": "app', {_S}, '", "version": "1.', {_mod(9)}, '", "dependencies": {{"dep', {_mod(5)}, '": "^', {_mod(3)}, '"}}, "devDependencies": {{"jest": "29"}}', CASE WHEN s_suppkey % 21 = 0 THEN ', "workspaces": ["sub"]' ELSE '' END, '}}')""",
    _lines("'[project]'", f"concat('name = \"py', {_S}, '\"')", f"concat('dependencies = [\"req', {_mod(5)}, '>=1.', {_mod(3)}, '\", \"plain\"]')", "'[project.optional-dependencies]'", "'dev = [\"pytest\"]'"),
    _lines("'# what is needed'", f"concat('flask==2.', {_mod(3)})", "'-r other.txt'", "'numpy'"),
    f"""concat('setup(name="set', {_S}, '", version="0.1", install_requires=["a', {_mod(4)}, '>=1", "b"])')""",
    _lines(f"concat('module ex.com/m', {_S})", "'go 1.20'", "'require ('", f"concat(chr(9), 'ex.com/dep', {_mod(6)}, ' v1.0.0')", "concat(chr(9), 'ex.com/ind v2.0.0 // indirect')", "')'", "'require ex.com/one v0.1.0'"),
    _lines("'[package]'", f"concat('name = \"crate', {_S}, '\"')", "'version = \"0.2.0\"'", "'[dependencies]'", f"concat('serde = \"1.', {_mod(4)}, '\"')", "'opt = { version = \"2\", optional = true }'", "'[dev-dependencies]'", "'proptest = \"1\"'"),
    _lines(f"concat('project(proj', {_S}, ')')", f"concat('add_library(lib', {_S}, ' a.cpp)')", f"concat('target_link_libraries(lib', {_S}, ' PUBLIC core', {_mod(3)}, ' util)')"),
]
_MANIFEST = "CASE s_suppkey % 7" + "".join(f" WHEN {k} THEN {t}" for k, t in enumerate(_TEXTS)) + " END"
_MANIFEST_PATH = f"concat('pkg', {_S}, '/', CASE s_suppkey % 7" + "".join(f" WHEN {k} THEN '{n}'" for k, n in enumerate(manifests.NAMES)) + " END)"
_SUB = f"""concat('{{"name": "sub', {_S}, '", "dependencies": {{"left": "1"}}}}')"""


def manifest_files(x: Index) -> DataFrame:
    own = x.raw("supplier").selectExpr(f"{_MANIFEST_PATH} as path", f"{_MANIFEST} as text")
    return own.unionAll(x.raw("supplier").where("s_suppkey % 21 = 0").selectExpr(f"concat('pkg', {_S}, '/sub/package.json')", _SUB))


def _edge(kind: int, source: str, target: str, edge: str = "MODULE_DEPENDS_ON", version: str = "NULL", optional: str = "false", also: str = "") -> str:
    return f"SELECT {kind} AS reader, {source} AS source, {target} AS target, '{edge}' AS kind, {version} AS version, {optional} AS is_optional, {'true' if edge == 'DEV_DEPENDS_ON' else 'false'} AS is_dev FROM supplier WHERE s_suppkey % 7 = {kind}{also}"


_APP = f"concat('js:app', {_S})"
_OWN_EDGES = [
    _edge(0, _APP, f"concat('js:dep', {_mod(5)})", version=f"concat('^', {_mod(3)})"),
    _edge(0, _APP, "'js:jest'", "DEV_DEPENDS_ON", "'29'"),
    _edge(0, f"concat('js:sub', {_S})", "'js:left'", version="'1'", also=" AND s_suppkey % 21 = 0"),
    _edge(1, f"concat('py:py', {_S})", f"concat('py:req', {_mod(5)})", version=f"concat('>=1.', {_mod(3)})"),
    _edge(1, f"concat('py:py', {_S})", "'py:plain'"),
    _edge(1, f"concat('py:py', {_S})", "'py:pytest'", "DEV_DEPENDS_ON"),
    _edge(2, f"concat('py:req:pkg', {_S})", "'py:flask'", version=f"concat('==2.', {_mod(3)})"),
    _edge(2, f"concat('py:req:pkg', {_S})", "'py:numpy'"),
    _edge(3, f"concat('py:set', {_S})", f"concat('py:a', {_mod(4)})", version="'>=1'"),
    _edge(3, f"concat('py:set', {_S})", "'py:b'"),
    _edge(4, f"concat('go:ex.com/m', {_S})", f"concat('go:ex.com/dep', {_mod(6)})", version="'v1.0.0'"),
    _edge(4, f"concat('go:ex.com/m', {_S})", "'go:ex.com/ind'", version="'v2.0.0'", optional="true"),
    _edge(4, f"concat('go:ex.com/m', {_S})", "'go:ex.com/one'", version="'v0.1.0'"),
    _edge(5, f"concat('rs:crate', {_S})", "'rs:serde'", version=f"concat('1.', {_mod(4)})"),
    _edge(5, f"concat('rs:crate', {_S})", "'rs:opt'", version="'2'", optional="true"),
    _edge(5, f"concat('rs:crate', {_S})", "'rs:proptest'", "DEV_DEPENDS_ON", "'1'"),
    _edge(6, f"concat('cpp:proj', {_S})", f"concat('cpp:lib', {_S})", "EXPORTS_TO"),
    _edge(6, f"concat('cpp:lib', {_S})", f"concat('cpp:core', {_mod(3)})"),
    _edge(6, f"concat('cpp:lib', {_S})", "'cpp:util'"),
]
_SPACES = [
    _edge(0, _APP, f"concat('js:sub', {_S})", "EXPORTS_TO", also=" AND s_suppkey % 21 = 0"),
    _edge(0, f"concat('js:sub', {_S})", _APP, "IMPORTS_FROM", also=" AND s_suppkey % 21 = 0"),
    _OWN_EDGES[2],
]
_EDGE = "source, target, kind, version, is_optional, is_dev"


def _reader_query(k: int, name: str) -> None:
    def run(x: Index) -> DataFrame:
        files = manifest_files(x).where(F.col("path").endswith("/" + manifests.NAMES[k]))
        return manifests.parse_manifests(files).select(F.explode("edges").alias("e")).select("e.*")

    run.__name__ = name
    query(f"SELECT {_EDGE} FROM ({' UNION ALL '.join(_OWN_EDGES)}) t WHERE reader = {k}", views=False)(run)


for _k, _n in enumerate(("s9_package_json", "s10_pyproject", "s11_requirements", "s12_setup_py", "s13_go_mod", "s14_cargo", "s15_cmake")):
    _reader_query(_k, _n)

_MODULES = f"""mods AS (SELECT CASE s_suppkey % 7 WHEN 0 THEN {_APP} WHEN 1 THEN concat('py:py', {_S}) WHEN 2 THEN concat('py:req:pkg', {_S}) WHEN 3 THEN concat('py:set', {_S}) WHEN 4 THEN concat('go:ex.com/m', {_S})
    WHEN 5 THEN concat('rs:crate', {_S}) ELSE concat('cpp:proj', {_S}) END AS id, CASE s_suppkey % 7 WHEN 0 THEN 'javascript' WHEN 4 THEN 'go' WHEN 5 THEN 'rust' WHEN 6 THEN 'cpp' ELSE 'python' END AS language FROM supplier
  UNION ALL SELECT concat('js:sub', {_S}), 'javascript' FROM supplier WHERE s_suppkey % 21 = 0),
  links AS ({' UNION ALL '.join(_OWN_EDGES + _SPACES)})"""


@query(f"WITH {_MODULES} SELECT {_EDGE}, id AS resolved_target, id IS NOT NULL AS is_internal FROM links LEFT JOIN (SELECT id, regexp_replace(id, '^(py:req|[a-z]+):', '') AS name FROM mods) m ON regexp_replace(target, '^[a-z]+:', '') = name", views=False)
def m1_module_graph(x: Index) -> DataFrame:
    m = cut(manifests.parse_manifests(manifest_files(x)))
    return modules.resolve_internal(manifests.module_edges(m), m)


@query(f"WITH {_MODULES} SELECT language, CAST(count(*) AS BIGINT) AS n_modules, list_sort(list(id)) AS ids FROM mods GROUP BY language", views=False)
def a16_modules_by_language(x: Index) -> DataFrame:
    return modules.by_language(manifests.parse_manifests(manifest_files(x)))


@query(f"WITH {_MODULES} SELECT {_EDGE}, 'depends_on' AS direction FROM links WHERE source = 'js:app0' UNION ALL SELECT {_EDGE}, 'depended_by' FROM links WHERE target = 'js:app0'", views=False)
def j11_dependencies(x: Index) -> DataFrame:
    return modules.dependencies_of(manifests.module_edges(cut(manifests.parse_manifests(manifest_files(x)))), "js:app0")


@query(f"WITH {_MODULES}, m AS (SELECT DISTINCT language AS to_repo, id AS module FROM mods), i AS (SELECT split_part(source, ':', 1) AS repo, target AS module FROM links) SELECT repo AS from_repo, to_repo, module, CAST(count(*) AS BIGINT) AS n FROM i JOIN m USING (module) WHERE repo <> to_repo GROUP BY 1, 2, 3", views=False)
def j16_across_repositories(x: Index) -> DataFrame:
    m = cut(manifests.parse_manifests(manifest_files(x)))
    used = manifests.module_edges(m).select(F.substring_index("source", ":", 1).alias("repo"), F.col("target").alias("module"))
    return workspace.cross_repo_edges(used, m.select(F.col("language").alias("repo"), F.col("id").alias("name")))


# diffs, rules ---------------------------------------------------------------------

_O = "CAST(o_orderkey AS STRING)"
_DIFF = "concat(" + ", chr(10), ".join([f"'diff --git a/src/o', {_O}, '.py b/src/o', {_O}, '.py'", f"'--- a/src/o', {_O}, '.py'", f"'+++ b/src/o', {_O}, '.py'", "'@@ -', CAST(o_orderkey % 50 + 1 AS STRING), ',2 +', CAST(o_orderkey % 50 + 1 AS STRING), ' @@ def f'", "'-old ', o_orderpriority", "'-gone'", "'+new'", "'@@ -90 +88,', CAST(o_orderkey % 3 AS STRING), ' @@'", "CASE WHEN o_orderkey % 3 = 0 THEN '-x' ELSE '+x' END"]) + ")"


@query("""SELECT o_orderkey AS diff_id, 'src/o' || o_orderkey || '.py' AS path, 1 AS hunk, CAST(o_orderkey % 50 + 1 AS INTEGER) AS old_start, 2 AS old_count, CAST(o_orderkey % 50 + 1 AS INTEGER) AS new_start, 1 AS new_count, CAST(1 AS BIGINT) AS added, CAST(2 AS BIGINT) AS removed FROM orders
  UNION ALL SELECT o_orderkey, 'src/o' || o_orderkey || '.py', 2, 90, 1, 88, CAST(o_orderkey % 3 AS INTEGER), CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END FROM orders""", views=False)
def s16_diff_hunks(x: Index) -> DataFrame:
    h = diff.hunks(x.raw("orders").selectExpr("o_orderkey as diff_id", f"{_DIFF} as text"))
    return h.select("diff_id", "path", F.col("hunk").cast("int").alias("hunk"), "old_start", "old_count", "new_start", "new_count", "added", "removed")


@query("SELECT o_orderkey AS diff_id, 'src/o' || o_orderkey || '.py' AS path FROM orders", views=False)
def s16_changed_files(x: Index) -> DataFrame:
    return diff.changed_files(x.raw("orders").selectExpr("o_orderkey as diff_id", f"{_DIFF} as text"))


@code("SELECT path, CASE WHEN regexp_matches(path, '^(tests|lib)/') THEN true WHEN starts_with(path, 'src/core/') THEN true WHEN starts_with(path, 'src/') THEN false ELSE regexp_matches(path, '[.]rs$') END AS ignored FROM v_code")
def s2_ignored(x: Index) -> DataFrame:
    rules = load_rules(["# comment", "*.rs", "!src/*", "/lib", "tests/"])
    return contents(x).select("path", ignored_with_parents(F.col("path"), rules, exclude=load_rules(["core/"])).alias("ignored"))


@query("SELECT event_id, path FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'src/u' || user_id || '.py' WHEN 1 THEN 'node_modules/u.js' WHEN 2 THEN 'doc/u.md' WHEN 3 THEN 'web/u' || user_id || '.tsx' ELSE 'a/build/u.rs' END AS path FROM events) t WHERE path LIKE 'src/%' OR path LIKE 'web/%'", views=False)
def t3_relevant_changes(x: Index) -> DataFrame:
    path = F.expr("case event_id % 5 when 0 then concat('src/u', user_id, '.py') when 1 then 'node_modules/u.js' when 2 then 'doc/u.md' when 3 then concat('web/u', user_id, '.tsx') else 'a/build/u.rs' end")
    return relevant(x.raw("events").select("event_id", path.alias("path"))).select("event_id", "path")


# code-intelligence indexes --------------------------------------------------------------

_PLACES = """occ AS (SELECT 'd' || user_id % 97 AS path, CAST(row_number() OVER (PARTITION BY user_id % 97 ORDER BY event_id) - 1 AS INTEGER) AS "at", 's' || event_id % 500 AS symbol, CAST(event_id % 40 AS INTEGER) AS line, CAST(event_id * 7 % 200 AS INTEGER) AS character, event_id % 5 = 0 AS is_definition FROM events)"""
_POINTS = "pts AS (SELECT o_orderkey AS point_id, 'd' || o_custkey % 97 AS path, CAST(o_orderkey % 40 AS INTEGER) AS line, CAST(o_orderkey % 200 AS INTEGER) AS character FROM orders)"
_AT = f"""{_PLACES}, {_POINTS}, hit AS (SELECT point_id, arg_min(symbol, "at") AS symbol FROM pts JOIN occ USING (path, line) WHERE abs(occ.character - pts.character) < 50 GROUP BY point_id)"""
_RELATED = "rel AS (SELECT 's' || k AS symbol, 's' || (k * 3 + 1) % 500 AS other, CASE WHEN k % 6 = 0 THEN 'outgoing' ELSE 'incoming' END AS direction FROM range(500) r(k) WHERE k % 2 = 0)"


def documents(x: Index) -> DataFrame:
    """An index's documents: an occurrence for each event, all symbols in the first document."""
    e = x.raw("events").select(F.expr("concat('d', user_id % 97)").alias("path"), F.struct("event_id", F.expr("named_struct('range', array(int(event_id % 40), int(event_id * 7 % 200)), 'symbol', concat('s', event_id % 500), 'symbol_roles', if(event_id % 5 = 0, 1, 0))").alias("o")).alias("e"))
    docs = e.groupBy("path").agg(F.expr("transform(array_sort(collect_list(e)), e -> e.o)").alias("occurrences"))
    symbols = F.expr("""transform(sequence(0, 499), k -> named_struct('symbol', concat('s', k), 'display_name', concat('S', k), 'kind', if(k % 10 = 0, 'Module', string(k % 20)), 'documentation', array('a', 'b'),
      'relationships', array(named_struct('symbol', concat('s', (k * 3 + 1) % 500), 'is_reference', k % 2 = 0, 'is_definition', k % 6 = 0, 'is_implementation', false))))""")
    return docs.select("path", F.when(F.col("path") < "d5", "python").otherwise("go").alias("language"), "occurrences", F.when(F.col("path") == "d0", symbols).alias("symbols"))


def _points(x: Index) -> DataFrame:
    return x.raw("orders").selectExpr("o_orderkey as point_id", "concat('d', o_custkey % 97) as path", "int(o_orderkey % 40) as line", "int(o_orderkey % 200) as character")


@query(f"""WITH {_PLACES} SELECT path, "at", symbol, line, character, is_definition FROM occ""", views=False)
def s17_occurrences(x: Index) -> DataFrame:
    return scip.occurrences(documents(x))


@query(f"WITH {_AT} SELECT point_id, symbol FROM hit", views=False)
def j14_symbol_at(x: Index) -> DataFrame:
    return scip.symbol_at(scip.occurrences(documents(x)), _points(x))


@query(f"WITH {_AT} SELECT point_id, symbol, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (is_definition) AS BIGINT) AS n_definitions FROM hit JOIN occ USING (symbol) GROUP BY 1, 2", views=False)
def v4_references(x: Index) -> DataFrame:
    o = cut(scip.occurrences(documents(x)))
    return scip.reference_counts(o, _points(x))


@query(f"""WITH {_PLACES}, {_RELATED}, few AS (SELECT * FROM (SELECT symbol AS other, path, line, row_number() OVER (PARTITION BY symbol ORDER BY path, "at") AS k FROM occ) t WHERE k <= 5) SELECT symbol, other, direction, path, line FROM rel JOIN few USING (other)""", views=False)
def j15_call_hierarchy(x: Index) -> DataFrame:
    d = cut(documents(x))
    return scip.call_hierarchy(scip.symbols(d), scip.occurrences(d))


@query("SELECT CAST(count(DISTINCT user_id % 97) AS BIGINT) AS n_documents, CAST(count(*) AS BIGINT) AS n_occurrences, CAST(500 AS BIGINT) AS n_symbols, ['go', 'python'] AS languages FROM events", views=False)
def a20_index_statistics(x: Index) -> DataFrame:
    return scip.statistics(documents(x))


@query("SELECT 'd0' AS path, 's' || k AS symbol FROM range(500) r(k) WHERE k % 10 = 0", views=False)
def v4_import_symbols(x: Index) -> DataFrame:
    return scip.import_symbols(documents(x))


# search --------------------------------------------------------------------------------

_NAME = "concat('n', CAST(p_partkey % 40 AS STRING), ' m', CAST(p_partkey % 7 AS STRING), '_q', CAST(p_size AS STRING))"
_POSTINGS = f"post AS (SELECT term, doc_id, CAST(count(*) AS BIGINT) AS tf FROM (SELECT p_partkey AS doc_id, unnest(string_split_regex({_NAME}, '[ _]')) AS term FROM part) t GROUP BY 1, 2), size AS (SELECT count(DISTINCT doc_id) AS n, sum(tf) / count(DISTINCT doc_id)::DOUBLE AS mean FROM post), len AS (SELECT doc_id, sum(tf) AS length FROM post GROUP BY 1)"


def _postings(x: Index) -> DataFrame:
    return search.postings(x.raw("part").selectExpr("p_partkey as id", f"{_NAME} as name"))


def _bm25(tf: str) -> str:
    return f"greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * {tf} * 2.2::DOUBLE / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))"


@query(f"WITH {_POSTINGS} SELECT term, doc_id, tf FROM post", views=False)
def u15_postings(x: Index) -> DataFrame:
    return _postings(x).select("term", "doc_id", "tf")


_SEARCHED = f"""{_POSTINGS}, a AS (SELECT doc_id, count(*) AS tf FROM post WHERE starts_with(term, 'n1') GROUP BY 1), b AS (SELECT doc_id, tf FROM post WHERE term = 'm3'),
  found AS (SELECT doc_id FROM a UNION (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM post WHERE term = 'q5')),
  parts AS (SELECT doc_id, {_bm25('tf')} AS s FROM a, (SELECT count(*) AS df FROM a) d, size JOIN len USING (doc_id) UNION ALL SELECT doc_id, {_bm25('tf')} FROM b, (SELECT count(*) AS df FROM b) d, size JOIN len USING (doc_id)),
  scored AS (SELECT doc_id, -sum(s) AS rank FROM parts JOIN found USING (doc_id) GROUP BY 1)""".replace("FROM a, (SELECT count(*) AS df FROM a) d, size JOIN len USING (doc_id)", "FROM a JOIN len USING (doc_id), (SELECT count(*) AS df FROM a) d, size").replace("FROM b, (SELECT count(*) AS df FROM b) d, size JOIN len USING (doc_id)", "FROM b JOIN len USING (doc_id), (SELECT count(*) AS df FROM b) d, size")


@query(f"WITH {_SEARCHED} SELECT doc_id, round(rank, 6) AS rank FROM scored", views=False)
def u15_search(x: Index) -> DataFrame:
    return search.search(cut(_postings(x)), "n1* OR (m3 NOT q5)", None).select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_SEARCHED} SELECT doc_id, CAST(row_number() OVER (ORDER BY round(rank, 9), doc_id) AS INTEGER) AS place FROM scored QUALIFY place <= 50", views=False)
def o5_search_order(x: Index) -> DataFrame:
    return placed(search.search(cut(_postings(x)), "n1* OR (m3 NOT q5)", 50).select("doc_id"))


@query(f"""WITH {_POSTINGS}, asked AS (SELECT DISTINCT 'n' || p_partkey % 40 || ' m' || p_partkey % 7 AS changed_name FROM part WHERE p_partkey % 97 = 0), t AS (SELECT changed_name, unnest(string_split(changed_name, ' ')) AS term FROM asked),
  df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), hit AS (SELECT changed_name, doc_id, count(*) AS have, round(sum({_bm25('tf')}), 9) AS score FROM t JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id), size GROUP BY 1, 2 HAVING count(*) = 2),
  top AS (SELECT *, row_number() OVER (PARTITION BY changed_name ORDER BY score DESC, doc_id) AS k FROM hit) SELECT changed_name, doc_id AS symbol_id, {_NAME} AS name FROM top JOIN part ON p_partkey = doc_id WHERE k <= 50""", views=False)
def j13_blast_radius(x: Index) -> DataFrame:
    changed = x.raw("part").where("p_partkey % 97 = 0").selectExpr("concat('n', p_partkey % 40, ' m', p_partkey % 7) as name")
    return changes.blast_radius(changed, x.raw("part").selectExpr("p_partkey as id", f"{_NAME} as name"), cut(_postings(x)))


# changes ------------------------------------------------------------------------------------

_CHANGED = "hit AS (SELECT path, name, kind, signature AS line_text, regexp_extract(path, '[.]([a-z]+)$', 1) AS ext FROM v_sym WHERE file_id % 3 = 0), ex AS (SELECT *, CASE WHEN line_text IS NULL THEN false WHEN ext = 'py' THEN NOT starts_with(name, '_') WHEN ext = 'js' THEN contains(line_text, 'export ') WHEN ext = 'go' THEN regexp_matches(name, '^[A-Z]') WHEN ext = 'rs' THEN contains(line_text, 'pub ') ELSE false END AS exported FROM hit)"
_RISK = f"""{_CHANGED}, risk AS (SELECT path, CAST(sum(CASE WHEN exported THEN 1 ELSE 0 END + CASE WHEN exported AND kind IN ('class', 'interface') THEN 1 ELSE 0 END) + CASE WHEN regexp_matches(path, '{changes.PUBLIC_FILE}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(path, '{changes.ENDPOINT}|{changes.COMMAND}') THEN 1 ELSE 0 END AS BIGINT) AS n_reasons FROM ex GROUP BY path)"""


def _changed(x: Index) -> DataFrame:
    return numbered(x).where("file_id % 3 = 0").select("path", "name", "kind", "line_start", F.col("signature").alias("line_text"))


@code(f"{_RISK} SELECT path, CASE WHEN n_reasons >= 3 THEN 'high' WHEN n_reasons >= 1 THEN 'medium' ELSE 'low' END AS level, n_reasons FROM risk")
def p9_api_risk(x: Index) -> DataFrame:
    return changes.api_risk(_changed(x))


@code(f"{_CHANGED} SELECT path, name, exported FROM ex")
def p8_exported(x: Index) -> DataFrame:
    return _changed(x).select("path", "name", changes.is_exported(F.col("path"), F.col("name"), F.col("line_text")).alias("exported"))


@code(f"""{_RISK}, q AS (SELECT 1 AS priority, name AS symbol, path AS file, 'Public API change' AS reason FROM ex WHERE exported AND path IN (SELECT path FROM risk WHERE n_reasons >= 1)
  UNION ALL SELECT 2, name, path, 'Changed symbol, impact unknown' FROM ex UNION ALL SELECT 3, name, 'unknown', 'Referenced by changed code' FROM (SELECT DISTINCT p_name AS name FROM part ORDER BY 1 LIMIT 20) t)
  SELECT priority, symbol, file, reason, CAST(row_number() OVER (ORDER BY priority, file, symbol) AS INTEGER) AS place FROM q""")
def o6_inspection_queue(x: Index) -> DataFrame:
    c = cut(_changed(x))
    return placed(changes.inspection_queue(c, changes.api_risk(c), x.raw("part").select(F.col("p_name").alias("name"))))


# orders, reports ---------------------------------------------------------------------------------


@query(_nodes("callers", 2).replace("SELECT s.id AS symbol_id", "SELECT CAST(row_number() OVER (ORDER BY round(confidence, 3) DESC, s.name, path_depth, s.id) AS INTEGER) AS place, s.id AS symbol_id").replace("s.name, s.kind, f.path AS file_path, s.line_start, round(confidence, 3) AS confidence, CAST(path_depth AS INTEGER) AS path_depth", "round(confidence, 3) AS confidence"))
def o1_callers_order(x: Index) -> DataFrame:
    return placed(graph.callers(x.symbols, cut(x.edges), x.files, ROOT, 2).select("symbol_id", "confidence"))


def _sure_walk() -> str:
    """Callers two steps deep of at least 0.95 along their path."""
    return _walk("callers", 2).replace("WHERE true", "WHERE w.confidence * e.arc >= 0.95")


@query(_sure_walk() + " SELECT node AS symbol_id, round(confidence, 3) AS confidence FROM walk1 UNION ALL SELECT node, round(confidence, 3) FROM walk2")
def p7_sure_callers(x: Index) -> DataFrame:
    return graph.callers(x.symbols, cut(x.edges), x.files, ROOT, 2, 0.95).select("symbol_id", "confidence")


@query("""arcs AS (SELECT target_id AS node, source_id AS next, e.id, arc FROM v_sure e JOIN v_symbols t ON t.id = source_id), one AS (SELECT a.node AS root, next AS node, arg_min(arc, a.id) AS c, min(a.id) AS edge FROM arcs a JOIN v_symbols r ON r.id = a.node WHERE next <> a.node GROUP BY 1, 2),
  two AS (SELECT root, a.next AS node, arg_min(c * arc, {'a': edge, 'b': id}) AS c FROM one JOIN arcs a ON a.node = one.node WHERE a.next <> root GROUP BY 1, 2),
  every AS (SELECT root, node, 1 AS depth, c FROM one UNION ALL SELECT root, node, 2, c FROM two WHERE (root, node) NOT IN (SELECT (root, node) FROM one))
  SELECT root, CAST(depth AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS n, min(node) AS least, max(node) AS most, CAST(sum(CAST(round(c * 10000) AS BIGINT)) AS BIGINT) AS sum_e4 FROM every GROUP BY 1, 2""".replace("(root, node) NOT IN (SELECT (root, node) FROM one)", "NOT EXISTS (SELECT 1 FROM one o WHERE o.root = two.root AND o.node = two.node)"))
def g1_callers_of_all(x: Index) -> DataFrame:
    found = graph.reach(cut(graph.arcs(x.edges, x.symbols)), x.symbols.select(F.col("id").alias("root")), 2)
    return found.groupBy("root", "depth").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.sum(F.round(F.col("confidence") * 10000).cast("bigint")).alias("sum_e4"))


_RANKED = _CALLERS + """, per AS (SELECT s.file_id, count(*) AS symbol_count, coalesce(sum(k), 0) AS fan_in FROM v_symbols s LEFT JOIN callers ON s.id = target_id GROUP BY s.file_id),
  ranked AS (SELECT path, round(least(coalesce(symbol_count, 0) / 10.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + least(coalesce(fan_in, 0) / 5.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + CASE WHEN regexp_matches(path, '(core|lib|utils|common)/') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score FROM v_files LEFT JOIN per ON id = file_id)"""


def _tables(x: Index) -> dict[str, DataFrame]:
    return {"files": x.files, "symbols": x.symbols, "edges": cut(x.edges)}


def _top(x: Index, **how) -> DataFrame:
    pack = packs.repo_map(_tables(x), **how)
    return x.spark.createDataFrame([(k, f["path"], f["score"]) for k, f in enumerate(pack["top_files"], 1)], "place int, path string, score double")


@query(_RANKED + " SELECT CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS place, path, score FROM ranked QUALIFY place <= 20")
def o3_map_order(x: Index) -> DataFrame:
    return _top(x, budget=10**6)


@query(_RANKED + " SELECT CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS place, path, score FROM ranked QUALIFY place <= 5")
def k6_map_cut_to_budget(x: Index) -> DataFrame:
    return _top(x, budget=1)


@query(_RANKED + " SELECT CAST(row_number() OVER (ORDER BY score DESC, path) AS INTEGER) AS place, path, score FROM ranked WHERE starts_with(path, 'src') QUALIFY place <= 20")
def p3_focus(x: Index) -> DataFrame:
    return _top(x, budget=10**6, focus="src")


@query(_AFFECTED + " SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place, path FROM (SELECT DISTINCT path FROM hit JOIN v_symbols s ON s.id = node JOIN v_files f ON f.id = s.file_id) t QUALIFY place <= 30")
def k11_impact_files(x: Index) -> DataFrame:
    pack = packs.impact_pack(_tables(x), [ROOT], 2, 10**6)
    return x.spark.createDataFrame(list(enumerate(pack["affected_files"], 1)), "place int, path string")


def _named_tables(x: Index) -> dict[str, DataFrame]:
    return {"files": contents(x).select(F.col("file_id").alias("id"), "path"), "symbols": numbered(x)}


def _code_tables(x: Index) -> dict[str, DataFrame]:
    t = _named_tables(x)
    edges = ingest.resolve_calls(ingest.callsites(ingest.lines(contents(x))), t["symbols"]).groupBy("source_id", "target_id", "kind", "file_id").agg(F.max("confidence").alias("confidence"))
    return t | {"edges": store.with_ids(cut(edges.withColumn("metadata", F.to_json(F.struct("confidence")))), ["source_id", "target_id"])}  # cut, since numbering reads them twice


@code(f"{_RESOLVED}, me AS (SELECT * FROM v_sym WHERE id = {ROOT}), e AS (SELECT DISTINCT source_id, target_id FROM resolved) SELECT field, value FROM (SELECT 'name' AS field, name AS value FROM me UNION ALL SELECT 'kind', kind FROM me UNION ALL SELECT 'file', path FROM me UNION ALL SELECT 'line', CAST(line AS STRING) FROM me"
      " UNION ALL SELECT 'signature', signature FROM me UNION ALL SELECT 'code', array_to_string(string_split(c.text, chr(10))[greatest(1, me.line - 2):coalesce(me.line_end, me.line) + 2], chr(10)) FROM me JOIN v_code c USING (file_id)"
      " UNION ALL SELECT 'caller', s.name FROM me JOIN e ON target_id = me.id AND source_id <> me.id JOIN v_sym s ON s.id = source_id UNION ALL SELECT 'callee', s.name FROM me JOIN e ON source_id = me.id AND target_id <> me.id JOIN v_sym s ON s.id = target_id"
      " UNION ALL (SELECT 'context', 'Line ' || s.line || ': ' || coalesce(s.signature, s.name) FROM me JOIN v_sym s ON s.file_id = me.file_id AND s.id <> me.id AND s.kind IN ('class', 'function', 'method') ORDER BY s.line, s.id LIMIT 10)) t")
def k7_zoom(x: Index) -> DataFrame:
    p = packs.zoom(_code_tables(x), str(ROOT), 10**6, contents(x))
    rows = [(k, str(p["symbol"][k])) for k in ("name", "kind", "file", "line")] + [("signature", p["signature"]), ("code", p["code"])]
    rows += [("caller", r["name"]) for r in p["callers"]] + [("callee", r["name"]) for r in p["callees"]] + [("context", c) for c in p["file_context"]]
    return x.spark.createDataFrame(rows, "field string, value string")


@code(f"SELECT 'id' AS way, CAST({ROOT} AS BIGINT) AS id UNION ALL SELECT 'line', (SELECT arg_min(s.id, -s.line * 1000000 + s.id) FROM v_sym s, (SELECT file_id, line + 1 AS line FROM v_sym WHERE id = {ROOT}) p WHERE s.file_id = p.file_id AND s.line <= p.line AND (s.line_end IS NULL OR s.line_end >= p.line)) UNION ALL SELECT 'name', (SELECT min(id) FROM v_sym WHERE name = (SELECT name FROM v_sym WHERE id = {ROOT}))")
def g5_targets(x: Index) -> DataFrame:
    t = _named_tables(x)
    me = t["symbols"].where(F.col("id") == ROOT).first()
    said = [("id", str(ROOT)), ("line", f"{me['path']}:{me['line_start'] + 1}"), ("name", me["name"])]
    return x.spark.createDataFrame([(way, packs.resolve_target(t, text)) for way, text in said], "way string, id bigint")


# tables -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, name FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'x_pb2' WHEN 1 THEN 'a_auto_b' WHEN 2 THEN 'GeneratedThing' WHEN 3 THEN 'swagger_api' ELSE p_name END AS name FROM part) t WHERE p_partkey % 6 > 3", views=False)
def p10_without_generated(x: Index) -> DataFrame:
    return ranking.without_generated(x.raw("part").selectExpr("p_partkey as id", "case p_partkey % 6 when 0 then 'x_pb2' when 1 then 'a_auto_b' when 2 then 'GeneratedThing' when 3 then 'swagger_api' else p_name end as name"))


@query("SELECT id, file_id, name FROM v_symbols WHERE file_id NOT IN (SELECT id FROM v_files WHERE size < 3000) UNION ALL SELECT id + 1000000, file_id, name || '2' FROM v_symbols WHERE file_id IN (SELECT id FROM v_files WHERE size < 3000)")
def t2_replaced_symbols(x: Index) -> DataFrame:
    changed = x.files.where("size < 3000").select(F.col("id").alias("file_id"))
    old = x.symbols.select("id", "file_id", "name")
    fresh = old.join(changed, "file_id", "left_semi").select((F.col("id") + 1_000_000).alias("id"), "file_id", F.concat("name", F.lit("2")).alias("name"))
    return store.replace_changed(old, fresh, changed)


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (value < 50) AS BIGINT) AS success, CAST(count(*) FILTER (value >= 50) AS BIGINT) AS failed, CAST(sum(user_id) AS BIGINT) AS symbols, round(count(*) / sum(value), 3) AS files_per_second FROM events", views=False)
def a14_parse_stats(x: Index) -> DataFrame:
    return parse_stats(x.raw("events").selectExpr("event_id as path", "value < 50 as ok", "user_id as n_symbols", "value as seconds"))


# texts -------------------------------------------------------------------------------------------------

_MARKDOWN = "concat('intro ', p_name, chr(10), '# ', p_brand, chr(10), p_type, chr(10), chr(10), '## Part ', CAST(p_partkey AS STRING), chr(10), p_name, ' ', p_type, chr(10), '### Small', chr(10), '#### deeper', chr(10), '#tag ', p_brand)"


@query(f"""WITH l AS (SELECT p_partkey AS file_id, unnest(string_split({_MARKDOWN}, chr(10))) AS text, unnest(range(1, 10)) AS line FROM part), h AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^#{{1,3}}[^#]') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line) AS k FROM l WHERE text IS NOT NULL),
  s AS (SELECT file_id, k, trim(string_agg(text, chr(10) ORDER BY line), chr(10) || ' ') AS piece FROM h GROUP BY 1, 2), p AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY k) - 1 AS INTEGER) AS pos, regexp_extract(piece, '^([^\\n]*)', 1) AS header, regexp_replace(piece, '^[^\\n]*\\n?', '') AS body FROM s)
  SELECT file_id, pos, header, CASE WHEN starts_with(header, '# ') THEN 10 WHEN starts_with(header, '## ') THEN 5 WHEN starts_with(header, '### ') THEN 3 ELSE 0 END AS priority, CAST(greatest(1, floor((length(header) + 1 + length(body)) / 3.5)) AS INTEGER) AS tokens FROM p""", views=False)
def k15_sections(x: Index) -> DataFrame:
    return tokens.section_rows(x.raw("part").selectExpr("p_partkey as file_id", f"{_MARKDOWN} as text"), "file_id", "text")
