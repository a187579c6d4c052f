"""One query for each operator over whole tables, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.benchmark import summary
from sparkloom.functions import confidence, paths, tokens
from sparkloom.functions.stem import words
from sparkloom.operators import graph, modules, ranking, relations, store, workspace
from sparkloom.operators.export import label
from sparkloom.plans.views import Index, with_views
from sparkloom.runtime import cut
from sparkloom.streaming.watch import change_stats, debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The symbol that the point queries ask for.
ROOT = 42


def query(sql: str | None = None, views: bool = True) -> Callable[[Callable[[Index], DataFrame]], Callable]:
    """Register a function of an Index under its name."""

    def add(f: Callable[[Index], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Index(spark, sf_dir))

        run.module = f.__globals__["__name__"]
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = with_views(sql) if views else sql
        return f

    return add


# scans and sinks ---------------------------------------------------------


@query("SELECT file_id, sha256(text) AS content_hash FROM v_content WHERE text IS NOT NULL")
def s6_content_hash(x: Index) -> DataFrame:
    return x.content.where("text is not null").select("file_id", F.sha2(F.col("text"), 256).alias("content_hash"))


@query("SELECT language, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (regexp_extract(path, '(\\.[^./]+)$', 1) = '.py') AS BIGINT) AS n_py FROM v_files GROUP BY language")
def s5_language_counts(x: Index) -> DataFrame:
    return x.files.groupBy("language").agg(F.count("*").alias("n"), F.count_if(paths.language_of(F.col("path")) == "python").alias("n_py"))


def _next_scan(x: Index) -> DataFrame:
    """A later scan: some files gone, some altered, some new."""
    kept = x.files.where("size <= 9000").select("path", F.when(F.col("size") < 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "size", "content_hash", "language")
    new = x.raw("nation").select(F.concat(F.lit("gen/n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.col("n_nationkey").cast("bigint").alias("mtime"), F.lit(1).cast("bigint").alias("size"), F.col("n_name").alias("content_hash"), F.lit("python").alias("language"))
    return kept.unionByName(new)


_NEXT = """scan2 AS (SELECT path, CASE WHEN size < 0 THEN mtime + 1 ELSE mtime END AS mtime, size, content_hash, language FROM v_files WHERE size <= 9000
  UNION ALL SELECT 'gen/n' || n_nationkey || '.py', CAST(n_nationkey AS BIGINT), 1, n_name, 'python' FROM nation)"""
_DIFF = """diffed AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted'
  WHEN n.mtime IS NOT DISTINCT FROM o.mtime AND n.size IS NOT DISTINCT FROM o.size AND n.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM scan2 n FULL JOIN v_files o ON n.path = o.path)"""


@query(f"{_NEXT}, {_DIFF} SELECT path, status FROM diffed")
def p5_change_diff(x: Index) -> DataFrame:
    return store.diff_files(_next_scan(x), x.files)


@query(f"""{_NEXT}, {_DIFF} SELECT CAST(count(*) FILTER (status <> 'deleted') AS BIGINT) AS scanned, CAST(count(*) FILTER (status = 'new') AS BIGINT) AS new,
  CAST(count(*) FILTER (status = 'changed') AS BIGINT) AS changed, CAST(count(*) FILTER (status = 'unchanged') AS BIGINT) AS unchanged, CAST(count(*) FILTER (status = 'deleted') AS BIGINT) AS deleted FROM diffed""")
def a11_run_stats(x: Index) -> DataFrame:
    return store.run_stats(store.diff_files(_next_scan(x), x.files))


@query(f"""{_NEXT}, last AS (SELECT max(id) AS last FROM v_files), fresh AS (SELECT *, row_number() OVER (ORDER BY path) AS k FROM scan2 WHERE path NOT IN (SELECT path FROM v_files))
  SELECT o.id, o.path, coalesce(n.size, o.size) AS size, coalesce(n.mtime, o.mtime) AS mtime, coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.language, o.language) AS language
  FROM v_files o LEFT JOIN scan2 n ON n.path = o.path UNION ALL SELECT k + last, path, size, mtime, content_hash, language FROM fresh, last""")
def w1_upsert_files(x: Index) -> DataFrame:
    return store.upsert_files(x.files, _next_scan(x))


@query("""raw AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS source_id, CAST(l_suppkey AS BIGINT) AS target_id, l_returnflag AS kind, CAST(l_linenumber AS BIGINT) AS file_id, l_discount AS confidence FROM lineitem)
  SELECT id, source_id, target_id, kind, file_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, kind, file_id ORDER BY id, confidence) AS k FROM raw) t WHERE k = 1""")
def w3_first_edges(x: Index) -> DataFrame:
    raw = x.raw("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source_id"), F.col("l_suppkey").cast("bigint").alias("target_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").cast("bigint").alias("file_id"), F.col("l_discount").alias("confidence"))
    return relations.first_edges(raw)


@query("""gone AS (SELECT id FROM v_files WHERE path LIKE 'tests/%'), lost AS (SELECT id FROM v_symbols WHERE file_id IN (SELECT id FROM gone))
  SELECT 'files' AS table_name, CAST(count(*) AS BIGINT) AS n FROM v_files WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'symbols', count(*) FROM v_symbols WHERE id NOT IN (SELECT id FROM lost)
  UNION ALL SELECT 'edges', count(*) FROM v_edges WHERE file_id NOT IN (SELECT id FROM gone) AND source_id NOT IN (SELECT id FROM lost) AND target_id NOT IN (SELECT id FROM lost)""")
def w5_cascade_delete(x: Index) -> DataFrame:
    gone = x.files.where(F.col("path").startswith("tests/"))
    return store.table_counts(store.delete_files({"files": x.files, "symbols": x.symbols, "edges": x.edges}, gone))


@query(f"{_NEXT} SELECT path FROM v_files WHERE path NOT IN (SELECT path FROM scan2)")
def w6_stale_files(x: Index) -> DataFrame:
    return store.stale_files(_next_scan(x), x.files).select("path")


# predicates and scalars ----------------------------------------------------


@query("SELECT s.name, s.kind, f.path, s.line_start FROM v_symbols s JOIN v_files f ON s.file_id = f.id WHERE s.name ILIKE '%GIZ%'")
def p2_name_like(x: Index) -> DataFrame:
    one = lambda df: df.withColumn("repo", F.lit("here"))
    return workspace.find_symbol(one(x.symbols), one(x.files), "GIZ").select("name", "kind", "path", "line_start")


@query(r"SELECT path FROM v_files WHERE regexp_matches(lower(path), 'test_|_test\.|_spec\.|\.spec\.|tests/|__tests__/')")
def p6_test_files(x: Index) -> DataFrame:
    return x.files.where(paths.is_test_path(F.col("path"))).select("path")


@query("SELECT id, round(arc, 3) AS confidence FROM v_sure")
def p11_edge_confidence(x: Index) -> DataFrame:
    return x.edges.select("id", F.round(confidence.edge_confidence(F.col("metadata"), F.col("kind")), 3).alias("confidence"))


@query("""SELECT id, round(0.5::DOUBLE + CASE WHEN contains(callee, '.') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(callee, '^[A-Za-z_][A-Za-z0-9_]*$') THEN 0.1::DOUBLE ELSE 0 END, 2) AS confidence
  FROM (SELECT id, CASE WHEN kind = 'class' THEN replace(name, ' ', '.') WHEN kind = 'method' THEN replace(name, ' ', '_') ELSE name END AS callee FROM v_symbols) t""")
def p12_call_confidence(x: Index) -> DataFrame:
    callee = F.when(F.col("kind") == "class", F.replace("name", F.lit(" "), F.lit("."))).when(F.col("kind") == "method", F.replace("name", F.lit(" "), F.lit("_"))).otherwise(F.col("name"))
    return x.symbols.select("id", F.round(confidence.call_confidence(callee), 2).alias("confidence"))


@query("SELECT id, translate(signature, ':-.', '___') AS safe FROM v_symbols")
def u17_safe_ids(x: Index) -> DataFrame:
    return x.symbols.select("id", modules.safe_id("signature").alias("safe"))


@query("SELECT page_id, CASE WHEN length(url) > 40 THEN left(url, 37) || '...' ELSE url END AS short FROM pages", views=False)
def x1_url_labels(x: Index) -> DataFrame:
    return x.raw("pages").select("page_id", label(F.col("url")).alias("short"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", views=False)
def u18_json_field(x: Index) -> DataFrame:
    return x.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# joins ---------------------------------------------------------------------


@query("SELECT s.id, s.name, f.path AS file_path FROM v_symbols s JOIN v_files f ON s.file_id = f.id")
def j1_symbol_file(x: Index) -> DataFrame:
    return relations.with_file(x.symbols, x.files).select("id", "name", "file_path")


@query("SELECT e.id, s.name AS target_name, s.kind AS target_kind FROM v_edges e JOIN v_symbols s ON e.target_id = s.id")
def j2_outgoing(x: Index) -> DataFrame:
    return relations.outgoing(x.edges, x.symbols).select("id", "target_name", "target_kind")


@query("SELECT e.id, s.name AS source_name, s.kind AS source_kind FROM v_edges e JOIN v_symbols s ON e.source_id = s.id")
def j3_incoming(x: Index) -> DataFrame:
    return relations.incoming(x.edges, x.symbols).select("id", "source_name", "source_kind")


@query("""points AS (SELECT o_orderkey AS point_id, o_custkey % n AS file_id, CAST(o_orderkey % 64 AS INTEGER) AS line FROM orders, n_files),
  best AS (SELECT point_id, arg_min(s.id, -CAST(s.line_start AS BIGINT) * 1000000000 + s.id) AS symbol_id FROM points p JOIN v_symbols s ON p.file_id = s.file_id AND p.line BETWEEN s.line_start AND s.line_end GROUP BY point_id)
  SELECT p.point_id, p.file_id, p.line, b.symbol_id FROM points p LEFT JOIN best b USING (point_id)""")
def j5_innermost_symbol(x: Index) -> DataFrame:
    points = x.raw("orders").crossJoin(x._n_files()).select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % F.col("_n")).alias("file_id"), (F.col("o_orderkey") % 64).cast("int").alias("line"))
    return relations.innermost(points, x.symbols).select("point_id", "file_id", "line", "symbol_id")


@query("""SELECT a.id, max(b.id) AS parent_id FROM v_symbols a LEFT JOIN v_symbols b ON a.file_id = b.file_id AND b.id < a.id AND b.line_start <= a.line_start AND b.line_end >= a.line_end GROUP BY a.id""")
def j7_enclosing_parent(x: Index) -> DataFrame:
    return relations.enclosing_parent(x.symbols)


@query("""p AS (SELECT id, file_id, name, CASE WHEN kind = 'method' THEN name END AS parent_name FROM v_symbols)
  SELECT a.id, max(b.id) AS parent_id FROM p a LEFT JOIN p b ON a.file_id = b.file_id AND a.parent_name = b.name AND b.id < a.id GROUP BY a.id""")
def j8_parent_by_name(x: Index) -> DataFrame:
    return relations.parent_by_name(x.symbols.withColumn("parent_name", F.when(F.col("kind") == "method", F.col("name"))))


@query("""m AS (SELECT 'py:' || n_name AS id, n_name AS name FROM nation UNION ALL SELECT 'rs:' || r_name, r_name FROM region),
  e AS (SELECT c_name AS source, CASE WHEN c_acctbal < 0 THEN 'js:outside' ELSE 'js:' || n_name END AS target FROM customer JOIN nation ON c_nationkey = n_nationkey),
  last AS (SELECT name, max(id) AS resolved_target FROM m GROUP BY name)
  SELECT source, target, resolved_target, resolved_target IS NOT NULL AS is_internal FROM e LEFT JOIN last ON split_part(target, ':', 2) = name""")
def j10_internal_modules(x: Index) -> DataFrame:
    nation = x.raw("nation")
    m = nation.select(F.concat(F.lit("py:"), "n_name").alias("id"), F.col("n_name").alias("name")).unionAll(x.raw("region").select(F.concat(F.lit("rs:"), "r_name"), "r_name"))
    e = x.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source"), F.when(F.col("c_acctbal") < 0, "js:outside").otherwise(F.concat(F.lit("js:"), "n_name")).alias("target"))
    return modules.resolve_internal(e, m).select("source", "target", "resolved_target", "is_internal")


@query("""r AS (SELECT user_id AS key, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS provider_rank, event_id AS value FROM events)
  SELECT key, provider_rank, value FROM r JOIN (SELECT key, min(provider_rank) AS provider_rank FROM r GROUP BY key) USING (key, provider_rank)""")
def v2_first_provider(x: Index) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return workspace.first_provider(x.raw("events").select(F.col("user_id").alias("key"), rank.alias("provider_rank"), F.col("event_id").alias("value")))


# aggregates ------------------------------------------------------------------


@query("SELECT 'files' AS table_name, CAST(count(*) AS BIGINT) AS n FROM v_files UNION ALL SELECT 'symbols', count(*) FROM v_symbols UNION ALL SELECT 'edges', count(*) FROM v_edges")
def a1_table_counts(x: Index) -> DataFrame:
    return store.table_counts({"files": x.files, "symbols": x.symbols, "edges": x.edges})


@query("SELECT DISTINCT language FROM v_files")
def a2_languages(x: Index) -> DataFrame:
    return ranking.languages(x.files)


@query("SELECT target_id AS symbol_id, CAST(count(*) AS BIGINT) AS fan_in FROM v_edges WHERE source_id IN (SELECT id FROM v_symbols) GROUP BY target_id")
def a3_fan_in(x: Index) -> DataFrame:
    return graph.fan_in(x.edges, x.symbols)


@query("SELECT target_id AS symbol_id, CAST(count(DISTINCT source_id) AS BIGINT) AS callers FROM v_edges WHERE source_id <> target_id AND source_id IN (SELECT id FROM v_symbols) GROUP BY target_id")
def a5_distinct_callers(x: Index) -> DataFrame:
    return ranking.distinct_callers(x.edges, x.symbols)


@query("""c AS (SELECT language AS repo, CAST(count(*) AS BIGINT) AS files, CAST(0 AS BIGINT) AS symbols, CAST(0 AS BIGINT) AS edges FROM v_files GROUP BY language
  UNION ALL SELECT language, 0, count(*), 0 FROM v_symbols s JOIN v_files f ON s.file_id = f.id GROUP BY language
  UNION ALL SELECT language, 0, 0, count(*) FROM v_edges e JOIN v_files f ON e.file_id = f.id GROUP BY language)
  SELECT repo, CAST(sum(files) AS BIGINT) AS files, CAST(sum(symbols) AS BIGINT) AS symbols, CAST(sum(edges) AS BIGINT) AS edges FROM c GROUP BY ROLLUP (repo)""")
def a6_workspace_totals(x: Index) -> DataFrame:
    repo = x.files.select(F.col("id").alias("file_id"), F.col("language").alias("repo"))
    return workspace.summary(repo, x.symbols.select("file_id").join(repo, "file_id"), x.edges.select("file_id").join(repo, "file_id"))


@query("SELECT l_returnflag AS operation, CAST(count(*) AS BIGINT) AS n, round(min(l_quantity), 2) AS least, round(max(l_quantity), 2) AS most, round(avg(l_quantity), 2) AS mean, round(median(l_quantity), 2) AS median, round(sum(l_quantity), 1) AS total FROM lineitem GROUP BY l_returnflag", views=False)
def a13_run_summary(x: Index) -> DataFrame:
    return summary(x.raw("lineitem").select(F.col("l_returnflag").alias("operation"), F.col("l_quantity").alias("seconds")))


@query("SELECT CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT path) AS BIGINT) AS n_paths, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 2) AS seconds FROM v_changes")
def a12_watch_stats(x: Index) -> DataFrame:
    return change_stats(x.changes).select("n_events", "n_paths", F.round("seconds", 2).alias("seconds"))


# ranking and top-k -------------------------------------------------------------


_CALLERS = """callers AS (SELECT target_id, count(DISTINCT source_id) AS k FROM v_edges WHERE source_id <> target_id AND source_id IN (SELECT id FROM v_symbols) GROUP BY target_id)"""


@query(_CALLERS + """, per AS (SELECT s.file_id, count(*) AS symbol_count, coalesce(sum(k), 0) AS fan_in FROM v_symbols s LEFT JOIN callers ON s.id = target_id GROUP BY s.file_id),
  j AS (SELECT path, coalesce(symbol_count, 0) AS symbol_count, coalesce(fan_in, 0) AS fan_in FROM v_files LEFT JOIN per ON id = file_id)
  SELECT path, round(least(symbol_count / 10.0::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + least(fan_in / 5.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE
    + CASE WHEN regexp_matches(path, '(core|lib|utils|common)/') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 3) AS score, CAST(symbol_count AS BIGINT) AS symbol_count, CAST(fan_in AS BIGINT) AS fan_in FROM j""")
def k3_file_ranking(x: Index) -> DataFrame:
    return ranking.rank_files(x.files, x.symbols, x.edges).select("path", "score", "symbol_count", "fan_in")


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN kind IN ('class', 'function') THEN 0 ELSE 1 END, length(signature) DESC, id) AS rank FROM v_symbols)
  SELECT f.path, CAST(rank AS INTEGER) AS rank, name, kind, signature, line_start AS line FROM r JOIN v_files f ON file_id = f.id WHERE rank <= 5""")
def o4_key_symbols(x: Index) -> DataFrame:
    return ranking.key_symbols(x.symbols, x.files)


@query("""r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY id) AS k FROM v_symbols)
  SELECT file_id, CASE WHEN k <= 10 THEN id END AS id, CASE WHEN k <= 10 THEN name ELSE '__TRUNCATED__' END AS name, CASE WHEN k <= 10 THEN kind ELSE 'meta' END AS kind FROM r WHERE k <= 11""")
def o9_symbol_cap(x: Index) -> DataFrame:
    return ranking.cap_symbols(x.symbols, 10)


@query("""p AS (SELECT string_split(path, '/') AS parts FROM v_files), n AS (SELECT unnest(range(1, least(len(parts), 4) + 1)) AS depth, parts FROM p)
  SELECT DISTINCT array_to_string(parts[1:depth], '/') AS node, CAST(depth AS INTEGER) AS depth FROM n""")
def k2_tree_nodes(x: Index) -> DataFrame:
    return ranking.tree_nodes(x.files)


# graph ---------------------------------------------------------------------------


def _walk(direction: str, depth: int) -> str:
    """Expressions walk1..walkN (node, confidence, pos): levels of a queue from ROOT."""
    near, far = ("target_id", "source_id") if direction == "callers" else ("source_id", "target_id")
    out = [f"walk0 AS (SELECT CAST({ROOT} AS BIGINT) AS node, 1.0::DOUBLE AS confidence, CAST(0 AS BIGINT) AS pos FROM v_symbols WHERE id = {ROOT})"]
    for d in range(1, depth + 1):
        seen = "".join(f" AND e.{far} NOT IN (SELECT node FROM walk{k})" for k in range(d))
        out.append(f"""walk{d} AS (SELECT node, confidence, row_number() OVER (ORDER BY pos, edge) AS pos FROM (SELECT e.{far} AS node, w.confidence * e.arc AS confidence, w.pos, e.id AS edge,
          row_number() OVER (PARTITION BY e.{far} ORDER BY w.pos, e.id) AS k FROM walk{d - 1} w JOIN v_sure e ON e.{near} = w.node JOIN v_symbols t ON t.id = e.{far} WHERE true{seen}) x WHERE k = 1)""")
    return ", ".join(out)


def _nodes(direction: str, depth: int) -> str:
    found = " UNION ALL ".join(f"SELECT node, confidence, {d} AS path_depth FROM walk{d}" for d in range(1, depth + 1))
    return _walk(direction, depth) + f""", found AS ({found}) SELECT s.id AS symbol_id, s.name, s.kind, f.path AS file_path, s.line_start, round(confidence, 3) AS confidence, CAST(path_depth AS INTEGER) AS path_depth
      FROM found JOIN v_symbols s ON s.id = node JOIN v_files f ON f.id = s.file_id"""


@query(_nodes("callers", 1))
def g1_callers(x: Index) -> DataFrame:
    return graph.callers(x.symbols, x.edges, x.files, ROOT, 1).drop("root")


@query(_nodes("callers", 2))
def g1_callers_depth2(x: Index) -> DataFrame:
    return graph.callers(x.symbols, cut(x.edges), x.files, ROOT, 2).drop("root")


@query(_nodes("callees", 2))
def g2_callees_depth2(x: Index) -> DataFrame:
    return graph.callees(x.symbols, cut(x.edges), x.files, ROOT, 2).drop("root")


_AFFECTED = _walk("callers", 1) + ", hit AS (SELECT node, 0 AS path_depth FROM walk0 UNION ALL SELECT node, 1 FROM walk1)"


@query(_AFFECTED + " SELECT node, CAST(path_depth AS INTEGER) AS path_depth FROM hit")
def g3_impact(x: Index) -> DataFrame:
    starts, _ = graph.impact_targets(x.symbols, x.files, [ROOT])
    return graph.affected(x.edges, x.symbols, starts, 2)


@query(_AFFECTED + """, into_ AS (SELECT target_id, count(*) AS k FROM v_edges WHERE source_id IN (SELECT id FROM v_symbols) GROUP BY target_id),
  per AS (SELECT s.file_id, count(*) AS symbol_count, coalesce(sum(k), 0) AS fan_in FROM hit JOIN v_symbols s ON s.id = node LEFT JOIN into_ ON target_id = node GROUP BY s.file_id),
  j AS (SELECT path, CAST(symbol_count AS BIGINT) AS symbol_count, CAST(fan_in AS BIGINT) AS fan_in, regexp_matches(lower(path), 'test_|tests/') AS is_test, least(fan_in / 10.0::DOUBLE, 1.0::DOUBLE) AS share FROM per JOIN v_files ON id = file_id)
  SELECT path, round(share + CASE WHEN is_test THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + least(symbol_count / 5.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE, 3) AS score, fan_in, symbol_count, is_test,
    CASE WHEN is_test THEN 'test_file' WHEN share > 0.7 THEN 'high_fan_in' WHEN share > 0.3 THEN 'moderate_fan_in' ELSE 'low_fan_in' END AS reason FROM j""")
def g6_inspection_ranking(x: Index) -> DataFrame:
    starts, _ = graph.impact_targets(x.symbols, x.files, [ROOT])
    edges = cut(x.edges)
    return graph.rank_for_inspection(graph.affected(edges, x.symbols, starts, 2), edges, x.symbols, x.files)


@query("SELECT min(id) AS root FROM v_symbols WHERE name = 'red widget' HAVING min(id) IS NOT NULL")
def g4_resolve_name(x: Index) -> DataFrame:
    return graph.resolve(x.symbols, "red widget")


@query(f"""up AS (SELECT node FROM walk0 UNION SELECT node FROM walk1), near AS (SELECT node FROM up UNION SELECT target_id FROM v_edges JOIN v_symbols ON v_symbols.id = target_id WHERE source_id = {ROOT})
  SELECT id, source_id, target_id, kind FROM v_edges WHERE source_id IN (SELECT node FROM near) AND target_id IN (SELECT node FROM near)""".replace("up AS", _walk("callers", 1) + ", up AS", 1))
def g7_neighbourhood(x: Index) -> DataFrame:
    return graph.neighbourhood(cut(x.edges), x.symbols, ROOT, 1)


@query("SELECT 1")
def g9_call_chain(x: Index) -> DataFrame:
    return graph.walks(cut(x.edges.select("source_id", "target_id")), ROOT, 3)


ORACLES["g9_call_chain"] = with_views(f"""walk AS (SELECT node, depth FROM (WITH RECURSIVE w(node, depth) AS (SELECT CAST({ROOT} AS BIGINT), 0 UNION ALL SELECT e.target_id, w.depth + 1 FROM w JOIN v_edges e ON e.source_id = w.node WHERE w.depth < 3) SELECT * FROM w) t)
  SELECT node, depth, CAST(count(*) AS BIGINT) AS walks FROM walk GROUP BY node, depth""")


# tokens and budgets -----------------------------------------------------------------


@query("SELECT file_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5)) END AS INTEGER) AS n_tokens, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.0)) END AS INTEGER) AS n_code_tokens FROM v_content")
def k14_token_estimate(x: Index) -> DataFrame:
    return x.content.select("file_id", tokens.estimate(F.col("text")).alias("n_tokens"), tokens.estimate(F.col("text"), True).alias("n_code_tokens"))


@query("""t AS (SELECT conv_id, turn, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5)) END AS n FROM conversations),
  s AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT conv_id, turn, CAST(used AS BIGINT) AS used_tokens FROM s WHERE used <= 400""")
def k16_greedy_budget(x: Index) -> DataFrame:
    t = x.raw("conversations").select("conv_id", "turn", tokens.estimate(F.col("text")).cast("bigint").alias("n"))
    return tokens.greedy_prefix(t, "conv_id", [F.col("turn")], "n", 400).select("conv_id", "turn", "used_tokens")


@query("SELECT o_orderkey AS id, CAST(least(greatest(floor(floor(o_totalprice * 0.5::DOUBLE * 0.9::DOUBLE) * 0.3::DOUBLE), 2000), 16000) AS BIGINT) AS budget FROM orders", views=False)
def k19_window_budget(x: Index) -> DataFrame:
    return x.raw("orders").select(F.col("o_orderkey").alias("id"), tokens.window_budget_column(F.col("o_totalprice")).alias("budget"))


@query()
def k17_truncate(x: Index) -> DataFrame:
    return x.content.select("file_id", tokens.truncate_column(F.col("text"), 200).alias("text"))


# search --------------------------------------------------------------------------------


@query("""w AS (SELECT id, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS word FROM v_symbols) SELECT word, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS n_symbols FROM w WHERE word <> '' GROUP BY word""")
def u15_words(x: Index) -> DataFrame:
    said = x.symbols.select("id", F.explode(words(F.col("name"))).alias("word"))
    return said.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_symbols"))


# changes over time -----------------------------------------------------------------------------


@query("""g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM v_changes),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS batch FROM g)
  SELECT user_id, min(ts) AS started, max(ts) AS last_change, CAST(count(*) AS BIGINT) AS n_changes FROM s GROUP BY user_id, batch""")
def t4_debounce(x: Index) -> DataFrame:
    return debounce(x.changes, "10 minutes", by="user_id").select("user_id", "started", "last_change", "n_changes")
