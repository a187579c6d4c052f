"""Code-intelligence indexes in JSON: documents, occurrences, symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "documents array<struct<relative_path:string,language:string,occurrences:array<struct<range:array<int>,symbol:string,symbol_roles:int>>,symbols:array<struct<symbol:string,display_name:string,kind:string,documentation:array<string>,relationships:array<struct<symbol:string,is_reference:boolean,is_definition:boolean,is_implementation:boolean>>>>>>"
NEAR = 50


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, language, occurrences, symbols) of each document; gzip is read by its suffix."""
    return documents(spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def documents(raw: DataFrame) -> DataFrame:
    d = raw.select(F.explode("documents").alias("d"))
    return d.select(F.col("d.relative_path").alias("path"), "d.language", "d.occurrences", "d.symbols")


def occurrences(docs: DataFrame) -> DataFrame:
    """(path, at, symbol, line, character, is_definition)."""
    o = docs.select("path", F.posexplode("occurrences").alias("at", "o"))
    return o.select("path", "at", "o.symbol", F.get("o.range", F.lit(0)).alias("line"), F.get("o.range", F.lit(1)).alias("character"), (F.coalesce("o.symbol_roles", F.lit(0)).bitwiseAND(1) == 1).alias("is_definition"))


def symbols(docs: DataFrame) -> DataFrame:
    s = docs.select("path", F.explode("symbols").alias("s"))
    return s.select("path", "s.symbol", "s.display_name", "s.kind", F.array_join("s.documentation", "\n").alias("documentation"), "s.relationships")


def symbol_at(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    """points(point_id, path, line, character) -> (point_id, symbol): the first occurrence on the line less than 50 characters away.

    Of the occurrences at one character only the first can be an answer, and equal
    places have equal answers. So each different place is compared with the few
    characters near it, by buckets of NEAR, however many points and occurrences a line has.
    """
    bucket = F.floor(F.col("character") / NEAR)
    firsts = occurrences.where("character is not null").groupBy("path", "line", "character").agg(F.min(F.struct("at", "symbol")).alias("_first"))
    firsts = firsts.select("path", "line", F.col("character").alias("_c"), "_first", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    places = points.select("path", "line", "character").distinct().withColumn("_bucket", bucket)
    hit = places.join(firsts, ["path", "line", "_bucket"]).where(F.abs(F.col("character") - F.col("_c")) < NEAR)
    answers = hit.groupBy("path", "line", "character").agg(F.min("_first").alias("_first"))
    return points.join(answers, ["path", "line", "character"]).groupBy("point_id").agg(F.min("_first").getField("symbol").alias("symbol"))


def definitions(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    return symbol_at(occurrences, points).join(occurrences.where("is_definition"), "symbol").select("point_id", "symbol", "path", "line", "character")


def references(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    return symbol_at(occurrences, points).join(occurrences, "symbol").select("point_id", "symbol", "path", "line", "character", "is_definition")


def reference_counts(occurrences: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, symbol, n, n_definitions): how many rows references() has for each point. Counted once a symbol, so the rows themselves aren't made."""
    per = occurrences.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("is_definition").alias("n_definitions"))
    return symbol_at(occurrences, points).join(per, "symbol").select("point_id", "symbol", "n", "n_definitions")


def call_hierarchy(symbols: DataFrame, occurrences: DataFrame, per_symbol: int = 5) -> DataFrame:
    """(symbol, other, direction, path, line): for each relationship that is a reference the first places of the related symbol."""
    rel = symbols.select("symbol", F.explode("relationships").alias("r")).where("r.is_reference").select("symbol", F.col("r.symbol").alias("other"), F.when(F.coalesce("r.is_definition", F.lit(False)), "outgoing").otherwise("incoming").alias("direction"))
    first = Window.partitionBy("symbol").orderBy("path", "at")  # Spark keeps the first few of each partition before the shuffle
    places = occurrences.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_symbol).select(F.col("symbol").alias("other"), "path", "line")
    return rel.join(places, "other").select("symbol", "other", "direction", "path", "line")



def statistics(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(F.size("occurrences")), F.lit(0)).alias("n_occurrences"), F.coalesce(F.sum(F.size("symbols")), F.lit(0)).alias("n_symbols"), F.array_sort(F.collect_set("language")).alias("languages"))


#: Kinds of symbols by their numbers in an index.
KINDS = dict(enumerate("array assertion associated_type attribute axiom boolean class constant constructor data_family enum enum_member error event fact field file function".split(), 1))


def kind_name(kind):
    """The name of a kind; names and unknown numbers stay."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (str(k), v)]), kind), kind)


def import_symbols(docs: DataFrame) -> DataFrame:
    """(path, symbol) of the symbols that stand for imports: modules, and ids that say so."""
    s = symbols(docs)
    return s.where((F.lower("kind") == "module") | F.lower("symbol").contains("import")).select("path", "symbol")
