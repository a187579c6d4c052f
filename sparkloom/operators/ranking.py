"""Importance of files, key symbols, guardrails, directory trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.paths import GENERATED

ENTRY = r"(?:main\.(?:rs|cpp|py)|__init__\.py|app\.py|index\.js)$"
CORE = r"(?:common|core|lib|utils)/"
CONFIG = r"(?:\.(?:toml|ya?ml|json)|CMakeLists\.txt)$"
TRUNCATED = "__TRUNCATED__"


def distinct_callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, callers): different sources other than the symbol itself."""
    live = edges.where("source_id <> target_id").join(symbols.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    # two steps, each with map-side combine, and no expansion of rows
    return live.select("target_id", "source_id").distinct().groupBy(F.col("target_id").alias("symbol_id")).agg(F.count("*").alias("callers"))


def importance(symbol_count: Column, fan_in: Column, path: Column) -> Column:
    density = F.least(symbol_count / 10.0, F.lit(1.0)) * 0.3
    inbound = F.least(fan_in / 5.0, F.lit(1.0)) * 0.4
    return F.round(density + inbound + F.when(path.rlike(ENTRY), 0.5).otherwise(0.0) + F.when(path.rlike(CORE), 0.2).otherwise(0.0) + F.when(path.rlike(CONFIG), 0.1).otherwise(0.0), 3)


def rank_files(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, score, reason, symbol_count, fan_in) of every file."""
    per_file = symbols.select(F.col("id").alias("symbol_id"), "file_id").join(distinct_callers(edges, symbols), "symbol_id", "left").groupBy("file_id").agg(F.count("*").alias("symbol_count"), F.coalesce(F.sum("callers"), F.lit(0)).cast("bigint").alias("fan_in"))
    all_files = files.select(F.col("id").alias("file_id"), "path").join(per_file, "file_id", "left").fillna(0, ["symbol_count", "fan_in"])
    path = F.col("path")
    reason = F.concat_ws(
        ", ",
        F.when(F.col("symbol_count") > 0, F.concat(F.col("symbol_count").cast("string"), F.lit(" symbols"))),
        F.when(F.col("fan_in") > 0, F.concat(F.col("fan_in").cast("string"), F.lit(" inbound calls"))),
        F.when(path.rlike(ENTRY), F.lit("entry point")),
        F.when(path.rlike(CORE), F.lit("core module")),
    )
    return all_files.select("path", importance(F.col("symbol_count"), F.col("fan_in"), path).alias("score"), F.when(reason == "", F.lit("standard file")).otherwise(reason).alias("reason"), "symbol_count", "fan_in")


def key_symbols(symbols: DataFrame, files: DataFrame, per_file: int = 5) -> DataFrame:
    """(path, rank, name, kind, signature, line): of each file classes and functions first, longer signatures first; ties by id."""
    first = Window.partitionBy("file_id").orderBy(F.when(F.col("kind").isin("class", "function"), 0).otherwise(1), F.desc(F.length(F.coalesce("signature", F.lit("")))), "id")
    ranked = symbols.select("id", "file_id", "name", "kind", "signature", "line_start", F.row_number().over(first).alias("rank")).where(F.col("rank") <= per_file)
    return ranked.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "rank", "name", "kind", "signature", F.col("line_start").alias("line"))


def cap_symbols(symbols: DataFrame, most: int = 1000) -> DataFrame:
    """(file_id, id, name, kind): the first `most` symbols of a file by id, then a marker row for files that had more."""
    w = Window.partitionBy("file_id").orderBy("id")
    ranked = symbols.select("file_id", "id", "name", "kind", F.row_number().over(w).alias("rank")).where(F.col("rank") <= most + 1)
    return ranked.select("file_id", F.when(F.col("rank") <= most, F.col("id")).alias("id"), F.when(F.col("rank") <= most, F.col("name")).otherwise(TRUNCATED).alias("name"), F.when(F.col("rank") <= most, F.col("kind")).otherwise("meta").alias("kind"))


def without_generated(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.coalesce(F.col("name"), F.lit("")).rlike(GENERATED))


def tree_nodes(files: DataFrame, max_depth: int = 4) -> DataFrame:
    """(node, depth): every directory and file down to max_depth."""
    parts = F.split("path", "/")
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max_depth))), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("node"), k.alias("depth")))
    return files.select(F.explode(cuts).alias("x")).select("x.node", "x.depth").distinct()


def languages(files: DataFrame) -> DataFrame:
    """(language) of each language that files have."""
    return files.select("language").distinct()
