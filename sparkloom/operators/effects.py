"""Side effects of functions: which patterns of input, output and mutation their lines show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: effect, how sure, patterns; a pattern that stands under two effects counts for both
CATALOGUE: list[tuple[str, float, str]] = [
    ("DB_READ", 0.8, r"\.all\( ;; \.fetch\( ;; \.filter\( ;; \.find\( ;; \.get\( ;; \.query\( ;; \.read\( ;; \.select\( ;; \.where\( ;; execute\(.*SELECT ;; objects\.filter ;; session\.query"),
    ("DB_WRITE", 0.8, r"\.add\( ;; \.bulk_create ;; \.commit\( ;; \.create\( ;; \.insert\( ;; \.save\( ;; \.update\( ;; execute\(.*INSERT ;; execute\(.*UPDATE"),
    ("DB_DELETE", 0.8, r"\.delete\( ;; \.destroy\( ;; \.remove\( ;; execute\(.*DELETE"),
    ("FILE_READ", 0.9, r"""open\([^,]+[,"']r ;; Path\([^)]+\)\.read ;; \.from_file ;; \.load\( ;; \.read\( ;; \.readline ;; \.readlines ;; json\.load ;; pickle\.load ;; yaml\.load"""),
    ("FILE_WRITE", 0.9, r"""open\([^,]+[,"']a ;; open\([^,]+[,"']w ;; Path\([^)]+\)\.write ;; \.dump\( ;; \.to_file ;; \.write\( ;; json\.dump ;; pickle\.dump ;; yaml\.dump"""),
    ("FILE_DELETE", 0.9, r"os\.remove\( ;; os\.unlink\( ;; Path\([^)]+\)\.unlink ;; shutil\.rmtree"),
    ("NETWORK_READ", 0.85, r"\.fetch\( ;; \.get\([^)]*http ;; \.recv\( ;; httpx\.get ;; httpx\.post ;; requests\.get\( ;; requests\.post\( ;; socket\. ;; urllib\.request"),
    ("NETWORK_WRITE", 0.85, r"\.broadcast ;; \.emit\( ;; \.publish ;; \.send\( ;; requests\.patch\( ;; requests\.post\( ;; requests\.put\("),
    ("GLOBAL_MUTATION", 0.7, r"CONFIG\[ ;; global\s+\w+ ;; os\.environ\[ ;; settings\. ;; sys\.path ;; \w+\s*=\s*\[.*\] ;; \w+\s*=\s*\{.*\}"),
    ("THROWS_EXCEPTION", 0.9, r"\.catch\( ;; raise\s+(\w+) ;; raise\s+\w+\s*\( ;; throw\s+new"),
]
IMPURE = [name for name, _, _ in CATALOGUE if name != "THROWS_EXCEPTION"]
DATABASE = ("DB_READ", "DB_WRITE", "DB_DELETE")
#: Deletions of files don't count as input or output.
IO = ("FILE_READ", "FILE_WRITE", "NETWORK_READ", "NETWORK_WRITE")


def patterns_of(spec: str) -> list[str]:
    return [p.strip() for p in spec.split(" ;; ")]


def effect_count(text: Column, spec: str) -> Column:
    """How often all patterns of an effect match."""
    out = F.lit(0)
    for p in patterns_of(spec):
        out = out + F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return out


def function_texts(contents: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, function, path, line, text): the lines of each function and method of contents(file_id, path, text).

    Without an end the function has eleven lines.
    """
    s = symbols.where(F.col("kind").isin("function", "method")).select(F.col("id").alias("symbol_id"), "file_id", F.col("name").alias("function"), F.col("line_start").alias("line"), F.coalesce("line_end", F.col("line_start") + 10).alias("_end"))
    lines = contents.select("file_id", "path", F.split("text", "\n").alias("_lines"))
    text = F.array_join(F.slice("_lines", F.greatest("line", F.lit(1)), F.greatest(F.col("_end") - F.col("line") + 1, F.lit(0))), "\n")
    return s.join(lines, "file_id").select("symbol_id", "function", "path", "line", text.alias("text"))


def function_effects(texts: DataFrame, carry: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """carry + (effect, confidence, n): a row for each effect of each text, PURE (0.6) for those without any."""
    counted = [F.struct(F.lit(name).alias("effect"), F.lit(sure).alias("confidence"), effect_count(F.col("text"), spec).cast("bigint").alias("n")) for name, sure, spec in CATALOGUE]
    found = F.filter(F.array(*counted), lambda x: x["n"] > 0)
    none = F.array(F.struct(F.lit("PURE").alias("effect"), F.lit(0.6).alias("confidence"), F.lit(1).cast("bigint").alias("n")))
    rows = texts.select(*carry, found.alias("_f")).select(*carry, F.explode(F.when(F.size("_f") == 0, none).otherwise(F.col("_f"))).alias("x"))
    return rows.select(*carry, "x.effect", "x.confidence", "x.n")


def purity(effects: DataFrame, key: str = "symbol_id") -> DataFrame:
    """(key, is_pure, touches_db, does_io): exceptions alone leave a function pure."""
    e = F.col("effect")
    return effects.groupBy(key).agg((F.max(e.isin(*IMPURE).cast("int")) == 0).alias("is_pure"), (F.max(e.isin(*DATABASE).cast("int")) == 1).alias("touches_db"), (F.max(e.isin(*IO).cast("int")) == 1).alias("does_io"))


def effect_summary(effects: DataFrame) -> DataFrame:
    """(effect, n): occurrences of each effect."""
    return effects.groupBy("effect").agg(F.sum("n").cast("bigint").alias("n"))


def totals(effects: DataFrame, key: str = "symbol_id") -> DataFrame:
    flags = purity(effects, key)
    return flags.agg(F.count("*").alias("n_functions"), F.count_if("is_pure").alias("n_pure"), F.count_if("touches_db").alias("n_db"), F.count_if("does_io").alias("n_io"))


def thrown(texts: DataFrame, carry: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """carry + (exceptions): the different names after `raise`, in order."""
    return texts.select(*carry, F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"raise\s+(\w+)"), 1))).alias("exceptions")).where(F.size("exceptions") > 0)


def mutations(texts: DataFrame, carry: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """carry + (mutation): the different snippets around mutations of global state, up to 20 characters either side."""
    spec = next(s for n, _, s in CATALOGUE if n == "GLOBAL_MUTATION")
    # with what may stand before it a pattern is tried some twenty times at each character, so only where it matches at all
    around = [F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(rf"(?s)(.{{0,20}}(?-s:{p}).{{0,20}})"), 1)).otherwise(F.array().cast("array<string>")) for p in patterns_of(spec)]
    every = F.flatten(F.array(*around))
    return texts.select(*carry, F.explode(F.array_distinct(F.transform(every, F.trim))).alias("mutation"))


def effect_lines(texts: DataFrame, carry: tuple[str, ...] = ("symbol_id",)) -> DataFrame:
    """carry + (effect, line): the line of every single match, counted from the function's first line.

    A function's lines are matched one by one, so a match that spans lines has none.
    """
    rows = texts.select(*carry, F.col("line").alias("_first"), F.posexplode(F.split("text", "\n")).alias("_at", "_text"))
    counted = [F.struct(F.lit(name).alias("effect"), effect_count(F.col("_text"), spec).alias("n")) for name, _, spec in CATALOGUE]
    hits = rows.select(*carry, (F.col("_first") + F.col("_at")).alias("line"), F.explode(F.filter(F.array(*counted), lambda x: x["n"] > 0)).alias("x"))
    return hits.select(*carry, "x.effect", "line", F.explode(F.sequence(F.lit(1), "x.n")).alias("_k")).drop("_k")
