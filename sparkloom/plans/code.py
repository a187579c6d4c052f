"""Queries over code: source texts, manifests, diffs and documents made from the driver's columns, and the SQL each is checked against.

The driver's tables hold no code, so every view here writes some: a file for each
part, a manifest for each supplier, a diff for each order. The texts are one
expression, which Spark and DuckDB evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import tokens
from sparkloom.operators import architecture, changes, effects, graph, ingest, modules, packs, ranking, relations, search, store, workspace
from sparkloom.plans.queries import ROOT, _walk, query
from sparkloom.plans.views import Index
from sparkloom.runtime import spread
from sparkloom.sources import diff, manifests, scip
from sparkloom.sources.ignore import ignored_with_parents, load_rules
from sparkloom.streaming.watch import relevant

_K = "p_partkey"
_S = "CAST(p_partkey AS STRING)"
_W = "replace(p_name, ' ', '_')"


def _mod(n: int, plus: int = 0) -> str:
    return f"CAST((p_partkey + {plus}) % {n} AS STRING)"


def _lines(*parts: str) -> str:
    return "concat(" + ", ".join(f"{p}, chr(10)" for p in parts) + ")"


def _pick(key: str, *texts: str) -> str:
    return "CASE " + key + "".join(f" WHEN {k} THEN {t}" for k, t in enumerate(texts[:-1])) + f" ELSE {texts[-1]} END"


_CLASS = f"concat('C', {_S}, {_pick('p_partkey % 7', *[repr(x) for x in ('UserRepository', 'OrderController', 'PayService', 'DataModel', 'BoxFactory', 'MainView', 'Thing')])})"
_BODY = _pick("p_size % 8", "'helper.save(x)'", """'open(x, "w")'""", "'requests.get(x)'", """'CONFIG["a"] = x'""", "'return x + 1'", f"concat('return f', {_mod(50, 1)}, '(x)')", "'bus.subscribe(x); bus.emit(x)'", "'os.remove(x)'")
_PY = _lines(
    _pick("p_partkey % 4", "'from flask import Flask as App'", "'import os, sys'", "'import pytest'", f"concat('from src.m', {_mod(40)}, ' import f', {_mod(50)})"),
    f"concat('from lib.m', {_mod(60, 3)}, ' import f', {_mod(50, 3)}, ' as other')",
    "''",
    f"""CASE WHEN p_partkey % 11 = 0 THEN '@app.route("/x")' ELSE '# no route' END""",
    f"concat('class ', {_CLASS}, '(Base):')",
    f"CASE WHEN p_partkey % 2 = 0 THEN concat('    \"\"\"Holds ', {_W}, '.\"\"\"') ELSE '    size = 1' END",
    f"concat('    def find_by_', {_W}, '(self):')",
    f"concat('        return session.query(self.', {_W}, ').all()')",
    "CASE WHEN p_size % 4 = 0 THEN '        raise KeyError(1)' ELSE '' END",
    "''",
    f"concat('def f', {_mod(50)}, '(x):')",
    f"concat('    ', {_BODY})",
    f"concat('    if x: helper(f', {_mod(50, 7)}, '(x))')",
)
_JS = _lines(
    f"concat('import {{ g', {_mod(50)}, ' }} from ''./m', {_mod(40)}, '''')".replace("{{", "{").replace("}}", "}"),
    "CASE WHEN p_partkey % 3 = 0 THEN 'const app = require(''express'')' ELSE '// plain' END",
    f"concat('export function g', {_mod(50)}, '(a) {{')".replace("{{", "{"),
    "'  return go(a);'",
    "'}'",
    f"concat('const h', {_mod(9)}, ' = async (x) => x;')",
    f"concat('class V', {_S}, ' {{}}')".replace("{{}}", "{}"),
)
_RS = _lines(
    _pick("p_partkey % 2", "'use std::io as sysio;'", f"concat('use crate::m', {_mod(40)}, '::Thing;')"),
    f"concat('pub fn run_', {_W}, '() {{')".replace("{{", "{"),
    "'    step();'",
    "'}'",
    f"concat('struct S', {_S}, ';')",
)
_CC = _lines(
    _pick("p_partkey % 2", "'#include <vector>'", f"concat('#include \"m', {_mod(40)}, '.h\"')"),
    f"concat('namespace n', {_mod(4)}, ' {{')".replace("{{", "{"),
    f"concat('class K', {_S}, ' {{')".replace("{{", "{"),
    "'};'",
    f"concat('int add_', {_W}, '(int a) {{')".replace("{{", "{"),
    "'  if (a) step(a);'",
    "'  return n::over(a);'",
    "'}'",
    "'}'",
)
_TEXT = f"CASE WHEN p_partkey % 40 = 39 THEN concat(' ', chr(10)) WHEN p_partkey % 25 = 7 THEN 'package main' WHEN p_partkey % 5 IN (0, 1) THEN {_PY} WHEN p_partkey % 5 = 2 THEN {_JS} WHEN p_partkey % 5 = 3 THEN {_RS} ELSE {_CC} END"
_PATH = (
    f"concat(CASE WHEN p_partkey % 10 = 0 THEN 'tests/test_m' WHEN p_partkey % 9 = 1 THEN 'src/api/m' WHEN p_partkey % 9 = 2 THEN 'src/core/m' WHEN p_partkey % 2 = 0 THEN 'src/m' ELSE 'lib/m' END, {_S}, "
    "CASE WHEN p_partkey % 25 = 7 THEN '.go' WHEN p_partkey % 5 IN (0, 1) THEN '.py' WHEN p_partkey % 5 = 2 THEN '.js' WHEN p_partkey % 5 = 3 THEN '.rs' ELSE '.cpp' END)"
)
_ID = r"[A-Za-z_]\w*"
_NON_BLANK = r"regexp_matches(text, '\S')"
_NO_SYMBOL = f"regexp_extract(text, '{ingest.PY_CLASS}', 1) = '' AND regexp_extract(text, '{ingest.PY_DEF}', 1) = ''"


def _name(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(text, '{pattern.replace(chr(39), chr(39) * 2)}', {group}), '')"


#: The views in DuckDB: v_code, its lines, the symbols on them and their numbers.
SQL = f"""
v_code AS (SELECT p_partkey AS file_id, {_PATH} AS path, {_TEXT} AS text FROM part),
v_lines AS (SELECT *, lead(text) OVER (PARTITION BY file_id ORDER BY line) AS next, CASE WHEN {_NON_BLANK} THEN length(text) - length(ltrim(text)) END AS indent,
    sum(length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', ''))) OVER (PARTITION BY file_id ORDER BY line) AS deep
  FROM (SELECT file_id, path, CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'cpp' THEN 'cpp' ELSE 'go' END AS language,
    unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM v_code WHERE {_NON_BLANK}) t),
v_py AS (SELECT *, last_value(cls IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside,
    CASE WHEN cls IS NULL THEN {_name(ingest.PY_DEF)} END AS fn FROM (SELECT *, {_name(ingest.PY_CLASS)} AS cls FROM v_lines WHERE language = 'python') t),
v_found AS (
  SELECT file_id, path, language, line, 0 AS ord, coalesce(cls, fn) AS name, CASE WHEN cls IS NOT NULL THEN 'class' WHEN inside IS NOT NULL AND starts_with(text, '    ') THEN 'method' ELSE 'function' END AS kind,
    CASE WHEN cls IS NOT NULL THEN instr(text, 'class') ELSE instr(text, 'def') END - 1 AS column_start, trim(text) AS signature,
    CASE WHEN starts_with(trim(next), '\"\"\"') OR starts_with(trim(next), '''''''') THEN regexp_replace(trim(next), '^["'']+|["'']+$', '', 'g') END AS docstring,
    CASE WHEN cls IS NULL AND inside IS NOT NULL AND starts_with(text, '    ') THEN inside END AS parent_name FROM v_py WHERE cls IS NOT NULL OR fn IS NOT NULL
  UNION ALL SELECT file_id, path, language, line, ord, name, kind, instr(text, name) - 1, CASE WHEN language <> 'rust' THEN trim(text) END, NULL, NULL FROM (
    SELECT *, 0 AS ord, 'namespace' AS kind, {_name(ingest.CPP_SPACE)} AS name FROM v_lines WHERE language = 'cpp'
    UNION ALL SELECT *, 1, 'class', {_name(ingest.CPP_CLASS)} FROM v_lines WHERE language = 'cpp'
    UNION ALL SELECT *, 2, 'function', {_name(ingest.CPP_DEF)} FROM v_lines WHERE language = 'cpp'
    UNION ALL SELECT *, 0, 'function', coalesce({_name(ingest.JS_DEF)}, {_name(ingest.JS_ARROW)}) FROM v_lines WHERE language = 'javascript'
    UNION ALL SELECT *, 1, 'class', {_name(ingest.JS_CLASS)} FROM v_lines WHERE language = 'javascript'
    UNION ALL SELECT *, 0, 'function', {_name(ingest.RS_DEF)} FROM v_lines WHERE language = 'rust'
    UNION ALL SELECT *, 1, 'class', {_name(ingest.RS_TYPE)} FROM v_lines WHERE language = 'rust') t WHERE name IS NOT NULL),
v_stop AS (SELECT f.file_id, f.line, min(n.line) AS stop FROM v_found f JOIN v_lines h ON h.file_id = f.file_id AND h.line = f.line
  JOIN v_lines n ON n.file_id = f.file_id AND CASE WHEN f.language = 'python' THEN n.line > f.line AND n.indent <= h.indent
    ELSE n.line >= f.line AND contains(h.text, '{{') AND n.deep <= h.deep - (length(h.text) - length(replace(h.text, '{{', '')) - length(h.text) + length(replace(h.text, '}}', ''))) END GROUP BY 1, 2),
v_parsed AS (SELECT f.*, CAST(CASE WHEN f.language <> 'python' THEN coalesce(s.stop, f.line)
    ELSE (SELECT max(n.line) FROM v_lines n WHERE n.file_id = f.file_id AND n.indent IS NOT NULL AND n.line >= f.line AND (s.stop IS NULL OR n.line < s.stop)) END AS INTEGER) AS line_end
  FROM v_found f LEFT JOIN v_stop s ON s.file_id = f.file_id AND s.line = f.line
  UNION ALL SELECT file_id, path, language, 1, 0, regexp_extract(path, '([^/]*)[.][a-z]+$', 1), 'file', NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT file_id, path, language FROM v_lines) t WHERE file_id NOT IN (SELECT file_id FROM v_found)),
v_sym AS (SELECT *, row_number() OVER (ORDER BY path, line, ord) AS id, line AS line_start FROM v_parsed),
v_called AS (SELECT file_id, path, language, line, callee, CASE WHEN language = 'cpp' THEN 0.5::DOUBLE WHEN contains(callee, '.') THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM (
    SELECT *, unnest(regexp_extract_all(text, '{ingest.PY_CALL}', 1)) AS callee FROM v_lines WHERE language = 'python' AND {_NO_SYMBOL}
    UNION ALL SELECT *, unnest(list_filter(regexp_extract_all(text, '{ingest.CPP_CALL}', 1), lambda x: x NOT IN ('for', 'if', 'return', 'switch', 'while'))) FROM v_lines WHERE language = 'cpp') t),
v_around AS (SELECT c.file_id, c.line, arg_min(s.id, -CAST(s.line AS BIGINT) * 1000000 + s.id) AS symbol_id FROM (SELECT DISTINCT file_id, line FROM v_called) c JOIN v_sym s ON s.file_id = c.file_id AND s.kind <> 'file' AND c.line BETWEEN s.line AND s.line_end GROUP BY 1, 2)
"""


def with_code(body: str) -> str:
    return f"WITH {SQL.strip()}{' ' if body.strip().upper().startswith('SELECT') else ', '}{body.strip()}"


def code(sql: str):
    """Register a query and its SQL over the views of this module."""
    return query(with_code(sql), views=False)


def contents(x: Index, by_path: bool = False) -> DataFrame:
    """(file_id, path, text) of every code file; the texts are made, and parsed, where the keys are sent. by_path: partitions are ranges of paths."""
    keys = x.raw("part").select("p_partkey", "p_name", "p_size")
    keys = spread(keys.withColumn("path", F.expr(_PATH)), "path", ranged=True) if by_path else spread(keys, "p_partkey")
    return keys.select(F.col("p_partkey").alias("file_id"), F.expr(_PATH).alias("path"), F.expr(_TEXT).alias("text"))


def parsed(x: Index, by_path: bool = False) -> DataFrame:
    return ingest.symbols(ingest.lines(contents(x, by_path)))


def numbered(x: Index) -> DataFrame:
    """Symbols of the code files with ids, line_start and path."""
    return store.with_ids(parsed(x, by_path=True).withColumnRenamed("line", "line_start"), ["path", "line_start", "ord"], ranged=True)


def placed(df: DataFrame) -> DataFrame:
    """Rows with their place in the order in which they come."""
    return store.in_order(df).withColumn("place", F.col("id").cast("int")).drop("id")


# parsing -------------------------------------------------------------------

_SYMBOL = "file_id, path, CAST(line AS INTEGER) AS line, CAST(ord AS INTEGER) AS ord, name, kind, CAST(column_start AS INTEGER) AS column_start, signature, docstring, parent_name, line_end"


def _parse_query(name: str, where: str, spark_where: str) -> None:
    def run(x: Index) -> DataFrame:
        return parsed(x).where(spark_where)

    run.__name__ = name
    code(f"SELECT {_SYMBOL} FROM v_parsed WHERE {where}")(run)


_parse_query("u2_python_symbols", "language = 'python' AND kind <> 'file'", "path like '%.py' and kind <> 'file'")
_parse_query("u3_cpp_symbols", "language = 'cpp' AND kind <> 'file'", "path like '%.cpp' and kind <> 'file'")
_parse_query("u4_js_symbols", "language = 'javascript' AND kind <> 'file'", "path like '%.js' and kind <> 'file'")
_parse_query("u5_rust_symbols", "language = 'rust' AND kind <> 'file'", "path like '%.rs' and kind <> 'file'")
_parse_query("u6_go_symbols", "language = 'go'", "path like '%.go'")
_parse_query("u8_file_symbols", "kind = 'file'", "kind = 'file'")


@code("SELECT path, name, docstring FROM v_parsed WHERE docstring IS NOT NULL")
def u7_docstrings(x: Index) -> DataFrame:
    return parsed(x).where("docstring is not null").select("path", "name", "docstring")


@code("SELECT CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' WHEN 'cpp' THEN 'cpp' WHEN 'go' THEN 'go' END AS language, CAST(count(*) AS BIGINT) AS n FROM v_code GROUP BY 1")
def u1_languages(x: Index) -> DataFrame:
    from sparkloom.functions.paths import PARSER_EXTENSIONS, language_of

    return contents(x).groupBy(language_of(F.col("path"), PARSER_EXTENSIONS).alias("language")).agg(F.count("*").alias("n"))


@code("SELECT file_id, CAST(line AS INTEGER) AS line, callee, confidence FROM v_called")
def u2_calls(x: Index) -> DataFrame:
    return ingest.callsites(ingest.lines(contents(x)))


_IMPORTED = f"""imported AS (SELECT file_id, path, language, line, trim(text) AS raw_text,
    CASE language WHEN 'python' THEN CASE WHEN regexp_matches(text, '{ingest.PY_IMPORT}') AND {_NO_SYMBOL} THEN coalesce({_name(ingest.PY_IMPORT)}, trim(split_part(split_part(regexp_extract(text, '{ingest.PY_IMPORT}', 2), ',', 1), ' as ', 1))) END
      WHEN 'cpp' THEN {_name(ingest.CPP_INCLUDE)} WHEN 'javascript' THEN {_name(ingest.JS_IMPORT)} WHEN 'rust' THEN regexp_replace(trim({_name(ingest.RS_USE)}), '\\s+as\\s+\\w+$', '') END AS module,
    CASE language WHEN 'python' THEN CASE WHEN {_name(ingest.PY_IMPORT)} IS NOT NULL THEN split_part(trim(regexp_extract(text, '{ingest.PY_IMPORT}', 2)), ' as ', 1) END WHEN 'javascript' THEN nullif(regexp_extract(text, 'import\\s+(\\{{[^}}]+\\}}|\\*\\s+as\\s+\\w+|\\w+)', 1), '') END AS name,
    CASE language WHEN 'python' THEN nullif(regexp_extract(text, '\\sas\\s+(\\w+)\\s*$', 1), '') WHEN 'rust' THEN nullif(regexp_extract(trim({_name(ingest.RS_USE)}), '\\sas\\s+(\\w+)$', 1), '') END AS alias FROM v_lines)"""


@code(f"{_IMPORTED} SELECT file_id, CAST(line AS INTEGER) AS line, module, name, alias, raw_text FROM imported WHERE module IS NOT NULL")
def u11_imports(x: Index) -> DataFrame:
    return ingest.imports(ingest.lines(contents(x)))


@code("SELECT path, name, kind, line_start, id FROM v_sym")
def w2_numbered_symbols(x: Index) -> DataFrame:
    return numbered(x).select("path", "name", "kind", "line_start", "id")


@code("SELECT c.file_id, CAST(c.line AS INTEGER) AS line, a.symbol_id FROM (SELECT DISTINCT file_id, line FROM v_called) c LEFT JOIN v_around a USING (file_id, line)")
def j6_enclosing_symbol(x: Index) -> DataFrame:
    points = ingest.callsites(ingest.lines(contents(x))).select("file_id", "line").distinct().withColumn("point_id", F.struct("file_id", "line"))
    return relations.innermost(points, numbered(x).where("kind <> 'file'")).select("file_id", "line", "symbol_id")


_RESOLVED = """n AS (SELECT DISTINCT file_id, line, callee, regexp_extract(callee, '(\\w+)$', 1) AS name FROM v_called),
  far AS (SELECT name, arg_min(id, id) AS id FROM v_sym WHERE kind <> 'file' GROUP BY name), near AS (SELECT file_id, name, min(id) AS id FROM v_sym WHERE kind <> 'file' GROUP BY file_id, name),
  resolved AS (SELECT a.symbol_id AS source_id, coalesce(near.id, far.id) AS target_id, 'call' AS kind, n.file_id, CASE WHEN near.id IS NOT NULL THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS confidence, CAST(n.line AS INTEGER) AS line, callee
    FROM n JOIN v_around a USING (file_id, line) JOIN far USING (name) LEFT JOIN near ON near.file_id = n.file_id AND near.name = n.name)"""


@code(f"{_RESOLVED} SELECT source_id, target_id, kind, file_id, confidence, line, callee FROM resolved")
def w4_callsites(x: Index) -> DataFrame:
    return ingest.resolve_calls(ingest.callsites(ingest.lines(contents(x))), numbered(x))


@code(f"{_IMPORTED}, own AS (SELECT file_id, path, string_split(regexp_replace(path, '[.][a-z]+$', ''), '/') AS bare FROM v_code), keyed AS (SELECT file_id, path, array_to_string(bare[k:], '/') AS key FROM own, range(1, 9) r(k) WHERE k <= len(bare)),"
      r"""owners AS (SELECT key, arg_min(file_id, path) AS to_file FROM keyed GROUP BY key), heads AS (SELECT file_id, arg_min(id, line * 1000000 + id) AS head FROM v_sym GROUP BY file_id), taken AS (SELECT file_id, name, arg_min(id, line * 1000000 + id) AS own FROM v_sym GROUP BY 1, 2),
  w AS (SELECT file_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(module, '::\w+$|::[*]$|::[{].*$', ''), '^(?:[.]/|[.][.]/|[.]+)+|[.](?:h|hh|hpp|js|ts)$', '', 'g'), '[.]', '/', 'g'), '::', '/', 'g') AS key,
    trim(regexp_replace(coalesce(name, CASE WHEN contains(module, '::') THEN regexp_extract(module, '(\w+)$', 1) END), '[{}]', '', 'g')) AS wanted FROM imported WHERE module IS NOT NULL),
  e AS (SELECT h.head AS source_id, coalesce(t.own, th.head) AS target_id, 'import' AS kind, w.file_id, CASE WHEN t.own IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence
    FROM w JOIN owners o ON o.key = w.key AND o.to_file <> w.file_id JOIN heads h ON h.file_id = w.file_id JOIN heads th ON th.file_id = o.to_file LEFT JOIN taken t ON t.file_id = o.to_file AND t.name = w.wanted)
  SELECT source_id, target_id, kind, file_id, max(confidence) AS confidence FROM e GROUP BY 1, 2, 3, 4""")
def w3_import_edges(x: Index) -> DataFrame:
    files = contents(x).select(F.col("file_id").alias("id"), "path")
    return ingest.resolve_imports(ingest.imports(ingest.lines(contents(x))), files, numbered(x))


@code("SELECT a.id, max(b.id) AS parent_id FROM v_sym a LEFT JOIN v_sym b ON a.file_id = b.file_id AND a.parent_name = b.name AND b.id < a.id GROUP BY a.id")
def j8_class_of_method(x: Index) -> DataFrame:
    return relations.parent_by_name(numbered(x))


# effects --------------------------------------------------------------------

_FUNCTION_TEXTS = "fun AS (SELECT s.id AS symbol_id, s.name AS function, s.path, s.line, array_to_string(string_split(c.text, chr(10))[s.line:s.line_end], chr(10)) AS text FROM v_sym s JOIN v_code c USING (file_id) WHERE s.kind IN ('function', 'method'))"


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _count(spec: str) -> str:
    return " + ".join(f"len(regexp_extract_all(text, {_quoted(p)}))" for p in effects.patterns_of(spec))


_EFFECTS = f"{_FUNCTION_TEXTS}, hit AS (" + " UNION ALL ".join(f"SELECT symbol_id, '{name}' AS effect, {sure}::DOUBLE AS confidence, CAST({_count(spec)} AS BIGINT) AS n FROM fun" for name, sure, spec in effects.CATALOGUE) + """),
  eff AS (SELECT * FROM hit WHERE n > 0 UNION ALL SELECT symbol_id, 'PURE', 0.6::DOUBLE, 1 FROM hit GROUP BY symbol_id HAVING sum(n) = 0)"""


def function_texts(x: Index) -> DataFrame:
    return effects.function_texts(contents(x), numbered(x))


@code(f"{_FUNCTION_TEXTS} SELECT symbol_id, function, path, CAST(line AS INTEGER) AS line, text FROM fun")
def d3_function_texts(x: Index) -> DataFrame:
    return function_texts(x)


@code(f"{_EFFECTS} SELECT symbol_id, effect, confidence, n FROM eff")
def d1_function_effects(x: Index) -> DataFrame:
    return effects.function_effects(function_texts(x))


@code(f"{_FUNCTION_TEXTS}, rows AS (SELECT symbol_id, line + k - 1 AS line, string_split(text, chr(10))[k] AS text FROM fun, range(1, 40) r(k) WHERE k <= len(string_split(text, chr(10)))), n AS ("
      + " UNION ALL ".join(f"SELECT symbol_id, '{name}' AS effect, line, {_count(spec)} AS n FROM rows" for name, _, spec in effects.CATALOGUE) + ") SELECT symbol_id, effect, CAST(line AS INTEGER) AS line FROM n, range(1, 20) r(k) WHERE k <= n")
def d2_effect_lines(x: Index) -> DataFrame:
    return effects.effect_lines(function_texts(x))


@code(f"{_EFFECTS} SELECT effect, CAST(sum(n) AS BIGINT) AS n FROM eff GROUP BY effect")
def a7_effect_summary(x: Index) -> DataFrame:
    return effects.effect_summary(effects.function_effects(function_texts(x)))


_PURITY = f"{_EFFECTS}, flags AS (SELECT symbol_id, max(CASE WHEN effect IN ({', '.join(map(repr, effects.IMPURE))}) THEN 1 ELSE 0 END) = 0 AS is_pure, max(CASE WHEN starts_with(effect, 'DB_') THEN 1 ELSE 0 END) = 1 AS touches_db, max(CASE WHEN effect IN ({', '.join(map(repr, effects.IO))}) THEN 1 ELSE 0 END) = 1 AS does_io FROM eff GROUP BY symbol_id)"


@code(f"{_PURITY} SELECT symbol_id, is_pure, touches_db, does_io FROM flags")
def p13_purity(x: Index) -> DataFrame:
    return effects.purity(effects.function_effects(function_texts(x)))


@code(f"{_PURITY} SELECT CAST(count(*) AS BIGINT) AS n_functions, CAST(count(*) FILTER (is_pure) AS BIGINT) AS n_pure, CAST(count(*) FILTER (touches_db) AS BIGINT) AS n_db, CAST(count(*) FILTER (does_io) AS BIGINT) AS n_io FROM flags")
def a8_effect_totals(x: Index) -> DataFrame:
    return effects.totals(effects.function_effects(function_texts(x)))


@code(rf"{_FUNCTION_TEXTS} SELECT symbol_id, list_sort(list_distinct(regexp_extract_all(text, 'raise\s+(\w+)', 1))) AS exceptions FROM fun WHERE len(regexp_extract_all(text, 'raise\s+(\w+)', 1)) > 0")
def a17_exceptions(x: Index) -> DataFrame:
    return effects.thrown(function_texts(x))


@code(f"{_FUNCTION_TEXTS}, m AS (" + " UNION ".join(f"SELECT symbol_id, trim(unnest(regexp_extract_all(text, {_quoted(f'(?s)(.{{0,20}}(?-s:{p}).{{0,20}})')}, 1)), ' ') AS mutation FROM fun" for p in effects.patterns_of(next(s for n, _, s in effects.CATALOGUE if n == "GLOBAL_MUTATION"))) + ") SELECT DISTINCT symbol_id, mutation FROM m")
def a17_mutations(x: Index) -> DataFrame:
    return effects.mutations(function_texts(x))


# architecture ------------------------------------------------------------------


def _hit(pattern: str) -> str:
    return f"regexp_matches(text, {_quoted(pattern)})"


_FRAMEWORKS = "fw AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, '{kind}' AS type, {k} AS pos, path, {_hit(use)} AS used FROM v_code WHERE {_hit(imp)} OR {_hit(use)}" for k, (n, kind, _, imp, use) in enumerate(architecture.FRAMEWORKS)) + """),
  ranked AS (SELECT name, type, pos, round(least(1.0::DOUBLE, count(*) * 0.2::DOUBLE + max(CASE WHEN used THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)), 3) AS confidence, CAST(count(*) AS BIGINT) AS n_files, min(path) AS first_file FROM fw GROUP BY 1, 2, 3)"""


@code(f"{_FRAMEWORKS} SELECT name, type, confidence, n_files, first_file FROM ranked")
def r1_frameworks(x: Index) -> DataFrame:
    return architecture.frameworks(contents(x))


@code(f"{_FRAMEWORKS} SELECT name, type, path, used FROM fw")
def a9_framework_files(x: Index) -> DataFrame:
    return architecture.framework_files(contents(x)).select("name", "type", "path", "used")


@code(f"{_FRAMEWORKS} SELECT name, confidence, CAST(row_number() OVER (ORDER BY confidence DESC, name) AS INTEGER) AS place FROM ranked")
def o8_framework_order(x: Index) -> DataFrame:
    return placed(architecture.frameworks(contents(x)).select("name", "confidence"))


_LAYER = "CASE" + "".join(f" WHEN regexp_matches(path, {_quoted(p)}) OR {_hit(t)} THEN '{n}'" for n, p, t in architecture.LAYERS) + "".join(f" WHEN {_hit(p)} THEN '{n}'" for n, p in architecture.LATE) + " END"


@code(f"SELECT layer, path FROM (SELECT {_LAYER} AS layer, path FROM v_code) t WHERE layer IS NOT NULL")
def r2_layers(x: Index) -> DataFrame:
    return architecture.layers(contents(x))


@code(f"SELECT layer, CAST(count(*) AS BIGINT) AS n_files FROM (SELECT {_LAYER} AS layer FROM v_code) t WHERE layer IS NOT NULL GROUP BY layer")
def a10_layer_sizes(x: Index) -> DataFrame:
    return architecture.layer_sizes(contents(x))


_PATTERNS = f"have AS (SELECT list(DISTINCT {_LAYER}) AS ls FROM v_code), found AS (" + " UNION ALL ".join(
    [f"SELECT '{n}' AS pattern, list_has_all(ls, [{', '.join(map(repr, ls))}]) AS found FROM have" for n, ls in architecture.BY_LAYERS]
    + [f"SELECT '{n}', bool_or({' AND '.join(map(_hit, ps))}) FROM v_code" for n, ps in architecture.BY_TEXT]
) + ")"


@code(f"{_PATTERNS} SELECT pattern, found FROM found")
def r3_patterns(x: Index) -> DataFrame:
    return architecture.patterns(contents(x))


@code(f"{_FRAMEWORKS}, {_PATTERNS} SELECT recommendation FROM (SELECT unnest([CASE WHEN (SELECT count(*) FROM ranked WHERE type = 'web') > 1 THEN 'Several web frameworks are in use; settling on one would help.' END,"
      " CASE WHEN list_contains(ls, 'controllers') AND NOT list_contains(ls, 'services') THEN 'Controllers without a service layer: business logic could move to services.' END,"
      " CASE WHEN NOT list_contains(ls, 'models') THEN 'No model layer is apparent; data structures could be gathered in models.' END,"
      " CASE WHEN list_contains(ls, 'models') AND NOT (SELECT found FROM found WHERE pattern = 'Repository Pattern') THEN 'Data access could go through repositories.' END]) AS recommendation FROM have) t WHERE recommendation IS NOT NULL")
def r4_advice(x: Index) -> DataFrame:
    return architecture.advice(contents(x))
