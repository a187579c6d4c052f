"""Joins between symbols, files, edges and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTAINERS = ("class", "function", "method")
#: Lines per bucket of a containment join.
BUCKET = 64


def with_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with file_path; a symbol without a file goes."""
    return symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")


def outgoing(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with name and kind of their target; dangling ones go."""
    return edges.join(symbols.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind")), "target_id")


def incoming(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges with name and kind of their source; dangling ones go."""
    return edges.join(symbols.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind")), "source_id")


def innermost(points: DataFrame, symbols: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """points(point_id, file_id, line) with the innermost symbol around each: symbol_id, null where there is none.

    A symbol with a null end reaches to the end of its file. A range join by
    buckets of lines: a symbol goes to each bucket that it touches, open-ended
    ones are joined on the file alone. Of equal starts the least id wins.
    """
    s = symbols.select("file_id", F.col("id").alias("symbol_id"), "line_start", "line_end")
    closed = s.where("line_end is not null and line_end >= line_start").withColumn("bucket", F.explode(F.sequence((F.col("line_start") / bucket).cast("int"), (F.col("line_end") / bucket).cast("int"))))
    p = points.withColumn("bucket", (F.col("line") / bucket).cast("int"))
    inside = p.join(closed, ["file_id", "bucket"]).where("line between line_start and line_end").select("point_id", "symbol_id", "line_start")
    open_ended = points.join(s.where("line_end is null"), "file_id").where("line >= line_start").select("point_id", "symbol_id", "line_start")
    best = inside.unionAll(open_ended).groupBy("point_id").agg(F.min(F.struct((-F.col("line_start")).alias("k"), "symbol_id")).getField("symbol_id").alias("symbol_id"))
    return points.join(best, "point_id", "left")


def enclosing_parent(symbols: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(id, parent_id): the last symbol before it in its file's list that spans it and may contain others; null without one.

    A symbol can only lie in what touches the bucket of lines in which it starts,
    so a file's symbols are compared bucket by bucket, not each with each.
    """
    inner = symbols.select("id", "file_id", "line_start", F.coalesce("line_end", "line_start").alias("line_end")).withColumn("bucket", (F.col("line_start") / bucket).cast("int"))
    outer = symbols.where(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("outer_id"), "file_id", F.col("line_start").alias("outer_start"), F.coalesce("line_end", "line_start").alias("outer_end"))
    outer = outer.where("outer_end >= outer_start").withColumn("bucket", F.explode(F.sequence((F.col("outer_start") / bucket).cast("int"), (F.col("outer_end") / bucket).cast("int"))))
    spans = inner.join(outer, ["file_id", "bucket"]).where("outer_id < id and outer_start <= line_start and outer_end >= line_end")
    return symbols.select("id").join(spans.groupBy("id").agg(F.max("outer_id").alias("parent_id")), "id", "left")


def parent_by_name(symbols: DataFrame) -> DataFrame:
    """symbols(id, file_id, name, parent_name) -> (id, parent_id): the last earlier symbol of that name in the file."""
    child = symbols.where("parent_name is not null").select("id", "file_id", F.col("parent_name").alias("name"))
    known = symbols.select(F.col("id").alias("other"), "file_id", "name")
    best = child.join(known, ["file_id", "name"]).where("other < id").groupBy("id").agg(F.max("other").alias("parent_id"))
    return symbols.select("id").join(best, "id", "left")


def first_edges(edges: DataFrame) -> DataFrame:
    """Of edges of the same source, target, kind and file the one of the least id."""
    rest = [c for c in edges.columns if c not in ("source_id", "target_id", "kind", "file_id")]
    keys = ["source_id", "target_id", "kind", "file_id"]
    first = edges.groupBy(*keys).agg(F.min(F.struct("id", *[c for c in rest if c != "id"])).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in edges.columns])


def related_tests(changed: DataFrame, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """(path, test_path, strategy): tests of changed(path, symbol) files, by the first way that finds them.

    1 test named after the symbol, 2 name in a test folder beside an ancestor,
    3 name in the same folder, 4 a Python test whose text (contents(path, text))
    names the module or its stem. All are equi-joins on derived keys, but for stems with white space in 4 and
    the "name contains the stem" test, which runs within one folder.
    """
    test_dirs = ["tests", "test", "__tests__", "spec"]
    f = files.select(F.col("path").alias("test_path"), F.split("path", "/").alias("parts"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"))
    in_tests = f.where(F.arrays_overlap(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), F.array(*map(F.lit, [*test_dirs, "e2e"]))))
    c = changed.select("path", "symbol", F.split("path", "/").alias("own"), F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "").alias("stem"))
    named = c.where("symbol is not null").select("path", F.explode(F.array(F.concat("symbol", F.lit("Test")), F.concat(F.lit("Test"), "symbol"), F.concat(F.lit("test_"), F.lower("symbol")), F.concat(F.lower("symbol"), F.lit("_test")))).alias("name"))
    by_name = (
        in_tests.where(F.element_at("parts", -2).isin(*test_dirs, "e2e") & F.col("base").rlike(r"^[^.]+\.(?:java|rs|go|ts|js|py)$"))
        .select("test_path", F.regexp_extract("base", r"^([^.]+)\.", 1).alias("name"))
        .join(named, "name")
        .select("path", "test_path", F.lit(1).alias("strategy"))
    )
    # each file under a test folder is posted at the folder that holds the test folder
    posted = in_tests.select("test_path", "base", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.when(F.element_at("parts", k).isin(*test_dirs), F.array_join(F.slice("parts", 1, k - 1), "/"))), lambda x: x.isNotNull())).alias("home"))
    above = c.select("path", "stem", F.explode(F.transform(F.sequence(F.lit(0), F.size("own") - 1), lambda k: F.array_join(F.slice("own", 1, k), "/"))).alias("home"))
    adjacent = posted.join(above, "home").where(F.col("base").contains(F.col("stem"))).select("path", "test_path", F.lit(2).alias("strategy"))
    folder = f.select("test_path", "base", F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("home"))
    beside = (
        folder.join(c.select("path", "stem", F.array_join(F.slice("own", 1, F.size("own") - 1), "/").alias("home")), "home")
        .where(F.expr("base like concat('%', replace(replace(stem, '_', '\\\\_'), '%', '\\\\%'), '%test%') or base like concat('%test%', replace(replace(stem, '_', '\\\\_'), '%', '\\\\%'), '%') or base like concat('%', replace(replace(stem, '_', '\\\\_'), '%', '\\\\%'), '%spec%')"))
        .select("path", "test_path", F.lit(3).alias("strategy"))
    )
    ways = by_name.unionAll(adjacent).unionAll(beside)
    if contents is not None:
        texts = in_tests.where(F.col("base").endswith(".py")).select("test_path").join(contents.select(F.col("path").alias("test_path"), "text"), "test_path")
        # the module path contains the stem, so the stem alone decides. A stem stands within a run of
        # non-space characters; of each different run the pieces as long as some stem are looked up
        stems = c.select("path", "stem").distinct()
        plain = stems.where(~F.col("stem").rlike(r"\s") & (F.col("stem") != ""))
        sizes = plain.select(F.length("stem").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("sizes"))  # a file's name has at most 255 bytes
        said = texts.select("test_path", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where("word <> ''")
        pieces = said.select("word").distinct().crossJoin(F.broadcast(sizes)).select("word", F.explode(F.expr("filter(sizes, n -> n <= length(word))")).alias("n"))
        pieces = pieces.select("word", F.explode(F.expr("array_distinct(transform(sequence(1, length(word) - n + 1), i -> substring(word, i, n)))")).alias("stem"))
        mentions = said.join(pieces.join(plain, "stem").select("word", "path").distinct(), "word").select("path", "test_path")
        odd = texts.join(stems.where(F.col("stem").rlike(r"\s") | (F.col("stem") == "")), F.col("text").contains(F.col("stem"))).select("path", "test_path")
        mentions = mentions.unionAll(odd).distinct().select("path", "test_path", F.lit(4).alias("strategy"))
        ways = ways.unionAll(mentions)
    return ways.groupBy("path", "test_path").agg(F.min("strategy").alias("strategy"))
