"""What the texts of a repository say of its architecture: frameworks, layers, patterns, advice.

Catalogues are rows of a table; each file is matched against all of them in one
scan, without a Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name, kind, languages, pattern of imports, pattern of use
FRAMEWORKS = [
    ("Flask", "web", "python", r"(?:import|from) flask", r"@.*\.route"),
    ("Django", "web", "python", r"(?:import|from) django", r"@.*\.dispatch|class.*View"),
    ("FastAPI", "web", "python", r"(?:import|from) fastapi", r"@.*\.(?:delete|get|post|put)"),
    ("Express", "web", "javascript typescript", r"""require\(['"]express['"]\)""", r"app\.(?:delete|get|post|put)"),
    ("Spring Boot", "web", "java kotlin", r"import org\.springframework", r"@Re(?:stController|questMapping)"),
    ("Click", "cli", "python", r"(?:import|from) click", r"@click\.(?:group|command)"),
    ("Typer", "cli", "python", r"(?:import|from) typer", r"@app\.command|typer\.Typer"),
    ("Argparse", "cli", "python", r"(?:import|from) argparse", r"ArgumentParser"),
    ("Celery", "event_driven", "python", r"(?:import|from) celery", r"@.*\.task"),
    ("RQ", "event_driven", "python", r"(?:import|from) rq", r"@job"),
    ("pytest", "testing", "python", r"(?:import|from) pytest", r"@pytest\.fixture|def test_"),
    ("unittest", "testing", "python", r"(?:import|from) unittest", r"class.*TestCase"),
    ("Qt", "web", "cpp", r"#include <Q|QT_", r"Q_OBJECT|S(?:LOT|IGNAL)S"),
    ("MFC", "web", "cpp", r"#include <afx|include <atl", r"DECLARE_MESSAGE_MAP"),
]
#: layer, pattern of paths, pattern of texts; the first that hits decides
LAYERS = [
    ("routes", r"[/\\](?:endpoints|routes|urls)", r"@.*\.(?:route|delete|get|post|put)"),
    ("controllers", r"[/\\](?:controller|handler)", r"class.*Controller|def handle"),
    ("services", r"[/\\](?:business|core|engine|logic|service)", r"class.*Service|def process"),
    ("models", r"[/\\](?:model|entitie|data|db|domain)", r"class.*Model|@dataclass|BaseModel"),
    ("views", r"[/\\](?:view|template|ui|gui|frontend)", r"class.*View|def render|QWidget"),
    ("middleware", r"[/\\]middleware", r"class.*Middleware|def process_request"),
    ("commands", r"[/\\](?:cli|command)", r"@.*\.command"),
    ("handlers", r"[/\\](?:consumer|handler)", r"def (?:consume|handle)"),
    ("config", r"[/\\](?:config|settings)", r"class.*Config|SETTINGS|CONFIG"),
    ("utils", r"[/\\](?:common|helper|shared|util)", r"def (?:helper|util)"),
]
#: what makes a file of none of these layers a model or a service after all
LATE = [("models", r"class.*:\s*\n.*="), ("services", r"def.*(?:process|handle)")]
#: name, layers that must be there
BY_LAYERS = [("MVC Architecture", ("controllers", "models", "views")), ("Layered Architecture", ("controllers", "models", "services"))]
#: name, patterns that one text must all have
BY_TEXT = [
    ("Repository Pattern", (r"class.*Repository", r"def.*find.*by")),
    ("Dependency Injection", (r"@inject", r"def __init__")),
    ("Factory Pattern", (r"class.*Factory", r"def create")),
    ("Observer Pattern", (r"\.subscribe", r"\.emit", r"@.*\.listen")),
]


def frameworks(contents: DataFrame, languages: list[str] | None = None, catalogue: list[tuple[str, str, str, str, str]] = FRAMEWORKS) -> DataFrame:
    """(name, type, confidence, n_files, files, entry_points) of each framework that a file of contents(path, text) imports or uses.

    Confidence is 0.2 a file, 0.3 more if any uses it, at most 1. Entry points
    are up to five different snippets around uses, the least in order. `files`
    of a framework is a list for a report: see framework_files() for the rows.
    """
    hits = framework_files(contents, languages, catalogue)
    return hits.groupBy("name", "type", "at").agg(
        F.least(F.lit(1.0), F.count("*") * 0.2 + F.max(F.when(F.col("used"), 0.3).otherwise(0.0))).alias("confidence"),
        F.count("*").alias("n_files"),
        F.min("path").alias("first_file"),
    ).select("name", "type", F.round("confidence", 3).alias("confidence"), "n_files", "first_file").orderBy(F.desc("confidence"), "name")


def framework_files(contents: DataFrame, languages: list[str] | None = None, catalogue: list[tuple[str, str, str, str, str]] = FRAMEWORKS) -> DataFrame:
    """(name, type, at, path, used): each file with each framework it imports or uses; `at` is the place in the catalogue."""
    rows = [(k, x) for k, x in enumerate(catalogue) if not languages or set(languages) & set(x[2].split())]
    text = F.col("text")
    tests = [F.struct(F.lit(x[0]).alias("name"), F.lit(x[1]).alias("type"), F.lit(k).alias("at"), text.rlike(x[3]).alias("imported"), text.rlike(x[4]).alias("used")) for k, x in rows]
    if not tests:
        return contents.select(F.lit("").alias("name"), F.lit("").alias("type"), F.lit(0).alias("at"), "path", F.lit(False).alias("used")).where(F.lit(False))
    found = contents.select("path", F.explode(F.filter(F.array(*tests), lambda x: x["imported"] | x["used"])).alias("x"))
    return found.select("x.name", "x.type", "x.at", "path", "x.used")


def entry_snippets(contents: DataFrame, catalogue: list[tuple[str, str, str, str, str]] = FRAMEWORKS, most: int = 5) -> DataFrame:
    """(name, snippet): up to `most` different snippets around uses of each framework, 50 characters from up to 50 before the use."""
    out = None
    for name, _, _, _, use in catalogue:
        around = contents.select(F.explode(F.regexp_extract_all("text", F.lit(rf"(?s)((?:.{{0,50}}?)(?-s:{use}).{{0,50}})"), 1)).alias("snippet"))
        own = around.select(F.lit(name).alias("name"), F.substring(F.trim("snippet"), 1, 50).alias("snippet")).distinct().orderBy("snippet").limit(most)
        out = own if out is None else out.unionAll(own)
    return out


def layer_of(path: Column, text: Column) -> Column:
    """The first layer whose path or text pattern hits, null without one."""
    layer = F.lit(None).cast("string")
    for name, pattern in reversed(LATE):
        layer = F.when(text.rlike(pattern), F.lit(name)).otherwise(layer)
    for name, in_path, in_text in reversed(LAYERS):
        layer = F.when(path.rlike(in_path) | F.coalesce(text.rlike(in_text), F.lit(False)), F.lit(name)).otherwise(layer)
    return layer


def layers(contents: DataFrame) -> DataFrame:
    """(layer, path) of each file that has one."""
    return contents.select(layer_of(F.col("path"), F.col("text")).alias("layer"), "path").where("layer is not null")


def layer_sizes(contents: DataFrame) -> DataFrame:
    return layers(contents).groupBy("layer").agg(F.count("*").alias("n_files"))


def patterns(contents: DataFrame) -> DataFrame:
    """(pattern, found) of each architectural pattern, in one scan."""
    own = contents.select("text", layer_of(F.col("path"), F.col("text")).alias("layer"))  # found once, asked for by each flag
    flags = [F.max(F.when(F.col("layer") == x, 1).otherwise(0)).alias(f"has_{x}") for x in sorted({y for _, ys in BY_LAYERS for y in ys})]
    texts = [F.max(F.when(_all(F.col("text"), ps), 1).otherwise(0)).alias(f"text_{k}") for k, (_, ps) in enumerate(BY_TEXT)]
    one = own.agg(*flags, *texts)
    by_layers = [F.struct(F.lit(name).alias("pattern"), (sum((F.coalesce(F.col(f"has_{x}"), F.lit(0)) for x in ys), F.lit(0)) == len(ys)).alias("found")) for name, ys in BY_LAYERS]
    by_text = [F.struct(F.lit(name).alias("pattern"), (F.coalesce(F.col(f"text_{k}"), F.lit(0)) == 1).alias("found")) for k, (name, _) in enumerate(BY_TEXT)]
    return one.select(F.explode(F.array(*by_layers, *by_text)).alias("x")).select("x.pattern", "x.found")


def _all(text: Column, needed: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in needed:
        out = out & F.coalesce(text.rlike(p), F.lit(False))
    return out


def advice(contents: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(recommendation) rows."""
    have = {r[0] for r in layers(contents).select("layer").distinct().collect()}  # ten at most
    found = {r[0] for r in patterns(contents).where("found").collect()}  # six at most
    web = frameworks(contents, languages).where("type = 'web'").count()
    rules = [
        (web > 1, "Several web frameworks are in use; settling on one would help."),
        ("controllers" in have and "services" not in have, "Controllers without a service layer: business logic could move to services."),
        ("models" not in have, "No model layer is apparent; data structures could be gathered in models."),
        ("models" in have and "Repository Pattern" not in found, "Data access could go through repositories."),
    ]
    return contents.sparkSession.createDataFrame([(t,) for yes, t in rules if yes], "recommendation string")


def render(pack: dict) -> str:
    """A report of frameworks, layers, patterns and recommendations for people."""
    out = ["# Architecture", "", "## Frameworks", ""]
    out += [f"- {f['name']} ({f['type']}), confidence {f['confidence']}, {f['n_files']} files, first `{f['first_file']}`" for f in pack["frameworks"]] or ["- none found"]
    out += ["", "## Layers", "", *([f"- {x['layer']}: {x['n_files']} files" for x in pack["layers"]] or ["- none found"])]
    out += ["", "## Patterns", "", *([f"- {p}" for p in pack["patterns"]] or ["- none found"])]
    return "\n".join([*out, "", "## Recommendations", "", *([f"- {r}" for r in pack["recommendations"]] or ["- none"])])
