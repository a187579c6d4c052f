"""The code index as views over the driver's tables, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.runtime import table

#: Part keys are below this, so an edge's id can be made of its two ends and its kind.
ID_SPAN = 1 << 30


class Index:
    """Tables of one sf folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def files(self) -> DataFrame:
        k = F.col("s_suppkey")
        folder = F.when(k % 4 == 0, "tests/test_s").when(k % 4 == 1, "src/core/s").when(k % 4 == 2, "lib/s").otherwise("src/s")
        language = F.when(F.col("s_nationkey") % 4 == 0, "python").when(F.col("s_nationkey") % 4 == 1, "javascript").when(F.col("s_nationkey") % 4 == 2, "go").otherwise("rust")
        return self.raw("supplier").select(k.alias("id"), F.concat(folder, k.cast("string"), F.lit(".py")).alias("path"), F.floor("s_acctbal").cast("bigint").alias("size"), F.col("s_nationkey").cast("bigint").alias("mtime"), F.col("s_name").alias("content_hash"), language.alias("language"))

    def _n_files(self) -> DataFrame:
        return F.broadcast(self.raw("supplier").agg(F.count("*").alias("_n")))  # one row

    @property
    def symbols(self) -> DataFrame:
        kind = F.when(F.col("p_size") % 3 == 0, "function").when(F.col("p_size") % 3 == 1, "class").otherwise("method")
        start = F.col("p_size")
        return self.raw("part").crossJoin(self._n_files()).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % F.col("_n")).alias("file_id"), F.col("p_name").alias("name"), kind.alias("kind"), start.alias("line_start"), (start + 10).alias("line_end"), F.concat_ws(" ", "p_brand", "p_type").alias("signature"))

    @property
    def edges(self) -> DataFrame:
        item = self.raw("lineitem")
        a = item.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_id"), "l_returnflag", F.round(1 - 8 * F.col("l_discount"), 2).alias("confidence"))
        b = item.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("target_id"))
        kind = F.when(F.col("l_returnflag") == "R", "import").when(F.col("l_returnflag") == "A", "call").otherwise("inherit")
        pairs = a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("source_id", "target_id", kind.alias("kind")).agg(F.max("confidence").alias("confidence"))
        code = F.when(F.col("kind") == "call", 0).when(F.col("kind") == "import", 1).otherwise(2)
        edge_id = (F.col("source_id") * ID_SPAN + F.col("target_id")) * 4 + code
        return pairs.crossJoin(self._n_files()).select(edge_id.alias("id"), "source_id", "target_id", "kind", (F.col("source_id") % F.col("_n")).alias("file_id"), "confidence", F.concat(F.lit('{"confidence": '), F.col("confidence").cast("string"), F.lit("}")).alias("metadata"))

    @property
    def content(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")

    @property
    def changes(self) -> DataFrame:
        return self.raw("events").select("event_id", "ts", F.col("event_type").alias("change_type"), F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"), "user_id", "value", "props")


#: The same views for DuckDB, as common table expressions.
SQL = f"""
n_files AS (SELECT count(*) AS n FROM supplier),
v_files AS (SELECT s_suppkey AS id,
    CASE s_suppkey % 4 WHEN 0 THEN 'tests/test_s' WHEN 1 THEN 'src/core/s' WHEN 2 THEN 'lib/s' ELSE 'src/s' END || s_suppkey || '.py' AS path,
    CAST(floor(s_acctbal) AS BIGINT) AS size, CAST(s_nationkey AS BIGINT) AS mtime, s_name AS content_hash,
    CASE s_nationkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'go' ELSE 'rust' END AS language FROM supplier),
v_symbols AS (SELECT p_partkey AS id, p_partkey % n AS file_id, p_name AS name,
    CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS kind,
    p_size AS line_start, p_size + 10 AS line_end, p_brand || ' ' || p_type AS signature FROM part, n_files),
v_pairs AS (SELECT a.l_partkey AS source_id, b.l_partkey AS target_id,
    CASE a.l_returnflag WHEN 'R' THEN 'import' WHEN 'A' THEN 'call' ELSE 'inherit' END AS kind, max(round(1 - 8 * a.l_discount, 2)) AS confidence
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2, 3),
v_edges AS (SELECT (source_id * {ID_SPAN} + target_id) * 4 + CASE kind WHEN 'call' THEN 0 WHEN 'import' THEN 1 ELSE 2 END AS id,
    source_id, target_id, kind, source_id % n AS file_id, confidence FROM v_pairs, n_files),
v_sure AS (SELECT *, least(1.0::DOUBLE, greatest(confidence, CASE kind WHEN 'call' THEN 0.9::DOUBLE WHEN 'import' THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END)) AS arc FROM v_edges),
v_content AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id AS path, text FROM documents),
v_changes AS (SELECT event_id, ts, event_type AS change_type, 'src/u' || user_id || '.py' AS path, user_id, value, props FROM events)
"""


def with_views(body: str) -> str:
    """DuckDB SQL over the views; `body` may begin with further expressions, `name AS (...), ... SELECT`."""
    body = body.strip()
    return f"WITH {SQL.strip()}{' ' if body.upper().startswith('SELECT') else ', '}{body}"
