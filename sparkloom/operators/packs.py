"""Reports within a token budget: repository map, zoom on a symbol, impact.

The rows of a report are queries; only a report's few dozen rows come to the
driver, where they are cut to the budget and rendered.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.tokens import count
from sparkloom.operators import graph, ranking
from sparkloom.operators.store import table_counts

TOP_FILES = 20
#: Rows of a drawn tree, the upper levels first.
TREE_ROWS = 2000
Tables = dict[str, DataFrame]


def repo_map(t: Tables, budget: int = 4000, focus: str | None = None, depth: int = 4) -> dict:
    """tree, top_files, symbols and summary of a repository; with `focus` only paths that begin so."""
    files = t["files"].where(F.col("path").startswith(focus.rstrip("/"))) if focus else t["files"]
    ranked = ranking.rank_files(files, t["symbols"], t["edges"]).orderBy(F.desc("score"), "path").limit(TOP_FILES)
    top = [r.asDict() for r in ranked.collect()]
    best = files.where(F.col("path").isin([r["path"] for r in top]))
    by_file: dict[str, list[dict]] = {r["path"]: [] for r in top}
    for r in ranking.key_symbols(t["symbols"], best).orderBy("path", "rank").collect():
        by_file[r["path"]].append({"name": r["name"], "kind": r["kind"], "signature": r["signature"], "line": r["line"]})
    pack = {"tree": tree(files, depth), "top_files": top, "symbols": by_file, "summary": {r["table_name"]: r["n"] for r in table_counts(t).collect()}}
    while len(pack["top_files"]) > 5 and count(render_map(pack)) > budget:
        pack["top_files"].pop()
    if count(render_map(pack)) > budget:
        pack["symbols"] = {p: s[:2] for p, s in pack["symbols"].items()}
    return pack


def tree(files: DataFrame, depth: int = 4, most: int = 40) -> str:
    """The folders and files down to `depth` as a drawing; of a folder `most` entries and how many more there are."""
    nodes = ranking.tree_nodes(files, depth).withColumn("home", F.regexp_replace("node", r"/?[^/]*$", ""))
    first = Window.partitionBy("home").orderBy("node")
    shown = nodes.withColumn("place", F.row_number().over(first)).withColumn("n", F.count("*").over(Window.partitionBy("home"))).where(F.col("place") <= most)
    rows = shown.orderBy("depth", "node").limit(TREE_ROWS).collect()
    if not rows:
        return "(no files)"
    children: dict[str, list[str]] = {}
    total: dict[str, int] = {}
    for r in rows:
        children.setdefault(r["home"], []).append(r["node"])
        total[r["home"]] = r["n"]
    out: list[str] = []

    def draw(at: str, indent: str) -> None:
        own = sorted(children.get(at, []), key=lambda n: n.rpartition("/")[2])
        more = total.get(at, 0) - len(own)
        for n in own:
            last = n == own[-1] and not more
            out.append(f"{indent}{'└' if last else '├'}── {n.rpartition('/')[2]}")
            draw(n, indent + ("    " if last else "│   "))
        if own and more:
            out.append(f"{indent}└── ... {more} more")

    draw("", "")
    return "\n".join(out)


def render_map(pack: dict) -> str:
    out = ["# Repository map", "", "## Structure", "", pack["tree"], "", "## Key files", ""]
    out += [f"- `{f['path']}` ({f['score']}): {f['reason']}" for f in pack["top_files"]]
    out += ["", "## Key symbols", ""]
    shown = {f["path"] for f in pack["top_files"]}
    for path, symbols in [(p, s) for p, s in pack["symbols"].items() if p in shown][:10]:
        out += [f"### {path}", *[f"- {s['kind']} `{s['signature'] or s['name']}` (line {s['line']})" for s in symbols[:5]], ""]
    out += ["## Totals", "", *[f"- {k}: {v}" for k, v in pack["summary"].items()]]
    return "\n".join(out)


def resolve_target(t: Tables, target: str) -> int | None:
    """The symbol meant by an id, by file:line (the innermost there) or by a name."""
    s = t["symbols"]
    if target.isdigit():
        return (r := s.where(F.col("id") == int(target)).select("id").first()) and r[0]
    if m := re.fullmatch(r"(.+):(\d+)", target):
        file_id = t["files"].where(F.col("path") == m[1]).select(F.col("id").alias("file_id"))
        line = int(m[2])
        inside = s.join(file_id, "file_id", "left_semi").where((F.col("line_start") <= line) & (F.col("line_end").isNull() | (F.col("line_end") >= line)))
        return (r := inside.orderBy(F.desc("line_start"), "id").select("id").first()) and r[0]
    return (r := s.where(F.col("name") == target).agg(F.min("id")).first()) and r[0]


def code_slice(contents: DataFrame, path: str, start: int, end: int | None, context: int = 2) -> str:
    """Lines start to end of a file with `context` more either side; without an end the first line alone."""
    first = max(1, start - context)
    r = contents.where(F.col("path") == path).select(F.array_join(F.slice(F.split("text", "\n"), first, (end or start) + context - first + 1), "\n")).first()
    return r[0] if r else f"# Error loading code: {path}"


def zoom(t: Tables, target: str, budget: int = 4000, contents: DataFrame | None = None) -> dict | None:
    """A symbol with its code, callers, callees and neighbours in its file; None if there is no such symbol."""
    at = resolve_target(t, target)
    if at is None:
        return None
    s = t["symbols"].where(F.col("id") == at).join(t["files"].select(F.col("id").alias("file_id"), "path"), "file_id").first()
    if s is None:
        return None
    near = lambda f: [r.asDict() for r in f(t["symbols"], t["edges"], t["files"], at, 1).collect()]
    others = t["symbols"].where((F.col("file_id") == s["file_id"]) & (F.col("id") != at) & F.col("kind").isin("class", "function", "method")).orderBy("line_start", "id").limit(10)
    pack = {
        "symbol": {"id": at, "name": s["name"], "kind": s["kind"], "file": s["path"], "line": s["line_start"]},
        "signature": s["signature"],
        "docstring": s["docstring"],
        "code": code_slice(contents, s["path"], s["line_start"], s["line_end"]) if contents is not None else "",
        "callers": near(graph.callers),
        "callees": near(graph.callees),
        "file_context": [f"Line {r['line_start']}: {r['signature'] or r['name']}" for r in others.collect()],
    }
    lines = pack["code"].split("\n")
    keep = 50
    while len(lines) > keep and count(render_zoom(pack)) > budget and keep >= 0:
        pack["code"] = "\n".join([*lines[:keep], "# ... truncated"])
        keep -= 10
    for side in ("callers", "callees"):
        while len(pack[side]) > 3 and count(render_zoom(pack)) > budget:
            pack[side].pop()
    if count(render_zoom(pack)) > budget:
        pack["docstring"] = None
    return pack


def render_zoom(pack: dict) -> str:
    s = pack["symbol"]
    out = [f"# {s['name']}", "", f"{s['kind']} in `{s['file']}:{s['line']}`", "", "## Signature", "", pack["signature"] or s["name"]]
    if pack["docstring"]:
        out += ["", "## Documentation", "", pack["docstring"]]
    out += ["", "## Code", "", "```", pack["code"], "```"]
    for side in ("callers", "callees"):
        out += ["", f"## {side.title()}", "", *[f"- `{n['name']}` ({n['file_path']}:{n['line_start']}), confidence {n['confidence']}" for n in pack[side][:10]]]
    return "\n".join([*out, "", "## In the same file", "", *pack["file_context"]])


def impact_pack(t: Tables, targets: list[int | str], depth: int = 2, budget: int = 4000) -> dict:
    """Affected symbols, files and tests of targets, and what to look at first, cut to the budget."""
    r = graph.impact(t["symbols"], t["edges"], t["files"], targets, depth)
    pack = {
        "targets": [str(x) for x in targets],
        "affected_symbols": [x.asDict() for x in r["affected_symbols"].orderBy("path_depth", "symbol_id").limit(1000).collect()],
        "affected_files": [x[0] for x in r["affected_files"].orderBy("path").limit(30).collect()],
        "affected_tests": [x[0] for x in r["affected_tests"].orderBy("path").limit(20).collect()],
        "ranked_inspection": [x.asDict() for x in r["ranked_inspection"].limit(20).collect()],
    }
    for part, least in (("affected_files", 20), ("affected_tests", 15), ("ranked_inspection", 10)):
        while len(pack[part]) > least and count(render_impact(pack)) > budget:
            pack[part].pop()
    return pack


def render_impact(pack: dict) -> str:
    out = ["# Impact analysis", "", "Targets: " + ", ".join(pack["targets"]), "", f"## Affected files ({len(pack['affected_files'])})", ""]
    out += [f"- `{p}`" for p in pack["affected_files"]]
    out += ["", "## Affected tests", "", *[f"- `{p}`" for p in pack["affected_tests"]]]
    return "\n".join([*out, "", "## Inspect first", "", *[f"- `{r['path']}` ({r['score']}): {r['reason']}" for r in pack["ranked_inspection"]]])


def to_json(pack: dict) -> str:
    return json.dumps(pack, indent=2, default=str)
