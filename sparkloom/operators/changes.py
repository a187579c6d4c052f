"""Impact of a change set: API risk, blast radius, affected tests, inspection queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.relations import related_tests
from sparkloom.operators.search import blast_radius

PUBLIC_FILE = r"/(?:api|exports|public)/|__init__\.py|index\.[jt]s|lib\.rs"
ENDPOINT = r"controllers|endpoint|handlers|route|urls\.py|views\.py"
COMMAND = r"@click|@typer|c(?:li|md)/|command"


def is_public_file(path: Column) -> Column:
    return path.rlike(PUBLIC_FILE)


def is_endpoint(path: Column) -> Column:
    return path.rlike(f"{ENDPOINT}|{COMMAND}")


def is_exported(path: Column, name: Column, line_text: Column) -> Column:
    """By language: Python names without a leading underscore, JS and TS lines with `export `, Go capitals, Rust lines with `pub `."""
    return (
        F.when(line_text.isNull(), False)
        .when(path.endswith(".py"), ~name.startswith("_"))
        .when(path.rlike(r"\.[jt]sx?$"), line_text.contains("export "))
        .when(path.endswith(".go"), name.rlike(r"^\p{Lu}"))
        .when(path.endswith(".rs"), line_text.contains("pub "))
        .otherwise(False)
    )


def risk_level(n_reasons: Column) -> Column:
    return F.when(n_reasons >= 3, "high").when(n_reasons >= 1, "medium").otherwise("low")


def api_risk(changed: DataFrame) -> DataFrame:
    """(path, level, n_reasons) of changed(path, name, kind, line_text), a row for each changed symbol."""
    exported = is_exported(F.col("path"), F.col("name"), F.col("line_text"))
    whole_class = exported & F.col("kind").isin("class", "interface")
    n = F.sum(exported.cast("int") + whole_class.cast("int"))
    per = changed.groupBy("path").agg(n.alias("symbols"))
    reasons = F.coalesce("symbols", F.lit(0)) + is_public_file(F.col("path")).cast("int") + is_endpoint(F.col("path")).cast("int")
    return per.select("path", risk_level(reasons).alias("level"), reasons.cast("bigint").alias("n_reasons"))


def inspection_queue(changed: DataFrame, risk: DataFrame, radius: DataFrame, most_affected: int = 20) -> DataFrame:
    """(priority, symbol, file, reason): exported symbols of risky files, all changed symbols, then up to 20 affected ones by name."""
    risky = risk.where("level <> 'low'").select("path")
    exported = changed.where(is_exported(F.col("path"), F.col("name"), F.col("line_text"))).join(risky, "path", "left_semi")
    first = exported.select(F.lit(1).alias("priority"), F.col("name").alias("symbol"), F.col("path").alias("file"), F.lit("Public API change").alias("reason"))
    second = changed.select(F.lit(2), "name", "path", F.lit("Changed symbol, impact unknown"))
    third = radius.select("name").distinct().orderBy("name").limit(most_affected).select(F.lit(3), "name", F.lit("unknown"), F.lit("Referenced by changed code"))
    return first.unionAll(second).unionAll(third).orderBy("priority", "file", "symbol")


def analyze(changed: DataFrame, symbols: DataFrame, files: DataFrame, index: DataFrame, contents: DataFrame | None = None) -> dict[str, DataFrame]:
    """changed(path, name, kind, line_start, line_text) -> risk, radius, affected_files, tests, queue."""
    risk = api_risk(changed)
    radius = blast_radius(changed.select("name"), symbols, index)
    ids = radius.select(F.col("symbol_id").alias("id")).distinct().join(symbols.select("id", "file_id"), "id")
    return {
        "risk": risk,
        "radius": radius,
        "affected_files": ids.select(F.col("file_id").alias("id")).distinct().join(files.select("id", "path"), "id").select("path"),
        "tests": related_tests(changed.select("path", F.col("name").alias("symbol")), files, contents),
        "queue": inspection_queue(changed, risk, radius),
    }


def report(found: dict[str, DataFrame], changed_files: list[str], most: int = 20) -> dict:
    """What analyze() found, in lists of at most `most` rows."""
    rows = lambda df, *order: [r.asDict() for r in df.orderBy(*order).limit(most).collect()]
    return {
        "changed_files": sorted(changed_files),
        "risk": rows(found["risk"], F.desc("n_reasons"), "path"),
        "affected_symbols": [r["name"] for r in rows(found["radius"].select("name").distinct(), "name")],
        "affected_files": [r["path"] for r in rows(found["affected_files"], "path")],
        "tests": [r["test_path"] for r in rows(found["tests"].groupBy("test_path").agg(F.min("strategy").alias("strategy")), "strategy", "test_path")],
        "queue": rows(found["queue"], "priority", "file", "symbol"),
    }


def render(pack: dict) -> str:
    """report() for people."""
    out = ["# Change analysis", "", "## Risk", "", *[f"- `{r['path']}`: {r['level']} ({r['n_reasons']} reasons)" for r in pack["risk"]]]
    for title, key in (("Affected symbols", "affected_symbols"), ("Affected files", "affected_files"), ("Tests to run", "tests")):
        out += ["", f"## {title}", "", *[f"- `{x}`" for x in pack[key]]]
    return "\n".join([*out, "", "## Inspection queue", "", *[f"{r['priority']}. `{r['symbol']}` in {r['file']}: {r['reason']}" for r in pack["queue"]]])
