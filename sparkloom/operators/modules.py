"""The module graph: which dependencies are internal, what depends on what, drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLOURS = {"rust": "#dea584", "go": "#00add8", "python": "#3776ab", "javascript": "#f7df1e"}


def resolve_internal(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """edges with is_internal and resolved_target: the module (greatest id of a name) whose name the target has, whatever its language."""
    named = modules.groupBy("name").agg(F.max("id").alias("resolved_target"))
    bare = F.when(F.col("target").contains(":"), F.regexp_replace("target", r"^[^:]*:", "")).otherwise(F.col("target"))
    return edges.withColumn("name", bare).join(named, "name", "left").drop("name").withColumn("is_internal", F.col("resolved_target").isNotNull())


def dependencies_of(edges: DataFrame, module_id: str) -> DataFrame:
    """Edges of a module with `direction`: depends_on or depended_by."""
    return edges.where(F.col("source") == module_id).withColumn("direction", F.lit("depends_on")).unionAll(edges.where(F.col("target") == module_id).withColumn("direction", F.lit("depended_by")))


def by_language(modules: DataFrame) -> DataFrame:
    """(language, n_modules, ids)."""
    return modules.groupBy("language").agg(F.count("*").alias("n_modules"), F.array_sort(F.collect_list("id")).alias("ids"))


def safe_id(c):
    return F.translate(c, ":-.", "___")


def to_mermaid(modules: DataFrame, edges: DataFrame) -> str:
    """A drawing for people, so of a size that the driver holds."""
    out = ["graph TD"]
    for r in by_language(modules).orderBy("language").collect():
        out.append(f"    subgraph {r['language'].upper()}")
        names = {m["id"]: m["name"] for m in modules.where(F.col("language") == r["language"]).select("id", "name").collect()}
        out += [f"        {i.replace(':', '_').replace('-', '_')}[{names[i]}]" for i in r["ids"]] + ["    end"]
    for e in edges.where("kind = 'MODULE_DEPENDS_ON'").orderBy("source", "target", "version").collect():
        arrow = f"-->|{e['version']}|" if e["version"] else "-->"
        out.append(f"    {_safe(e['source'])} {arrow} {_safe(e['target'])}")
    return "\n".join(out)


def to_dot(modules: DataFrame, edges: DataFrame) -> str:
    out = ["digraph modules {", "    rankdir=TB;", ""]
    rows = modules.select("language", "id", "name").orderBy("language", "id").collect()
    for lang in sorted({r["language"] for r in rows}):
        c = COLOURS.get(lang, "#cccccc")
        out += [f"    subgraph cluster_{lang} {{", f'        label="{lang.upper()}"; style=filled; color="{c}40";']
        out += [f'        {_safe(r["id"])} [label="{r["name"]}", fillcolor="{c}"];' for r in rows if r["language"] == lang]
        out += ["    }", ""]
    for e in edges.where("kind = 'MODULE_DEPENDS_ON'").orderBy("source", "target", "version").collect():
        out.append(f"    {_safe(e['source'])} -> {_safe(e['target'])}" + (f' [label="{e["version"]}"];' if e["version"] else ";"))
    return "\n".join([*out, "}"])


def _safe(x: str) -> str:
    return x.replace(":", "_").replace("-", "_")
