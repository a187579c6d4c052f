"""python -m sparkloom COMMAND: index a repository and ask about it."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.config import NAME, Config
from sparkloom.functions.paths import stem
from sparkloom.functions.tokens import resolve_budget
from sparkloom import benchmark
from sparkloom.operators import architecture, changes, export, modules, packs, search, workspace
from sparkloom.runtime import cut
from sparkloom.streaming.watch import Watch
from sparkloom.sources.manifests import module_edges, parse_manifests


def _rows(df: DataFrame) -> list[dict]:
    """Rows of a report, which is small."""
    return [r.asDict() for r in df.collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom")
    p.add_argument("--root", default=".")
    p.add_argument("--store", help="folder of the index")
    p.add_argument("--format", choices=["markdown", "json", "mermaid", "dot"], default="markdown")
    p.add_argument("--max-tokens", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    p.add_argument("--config", dest="settings", help=f"settings; {NAME} of the root if there is one")
    p.add_argument("--output", help="file for the report instead of standard output")
    for name, about in (("index", "bring the index up to date"), ("watch", "index again after each batch of changes")):
        x = sub.add_parser(name, help=about)
        x.add_argument("--force", action="store_true")
        x.add_argument("-i", "--include", action="append", help="a pattern of paths to keep, whatever is ignored")
        x.add_argument("-e", "--exclude", action="append", help="a pattern of paths to leave out")
        x.add_argument("-s", "--max-size", type=int, help="bytes of the largest file to read")
    x.add_argument("--batches", type=int, help="stop after so many")
    b = sub.add_parser("benchmark", help="index a generated repository, then alter it, and time both")
    b.add_argument("--files", type=int, default=100)
    m = sub.add_parser("repomap")
    m.add_argument("--focus")
    m.add_argument("--depth", type=int, default=2)
    f = sub.add_parser("find")
    f.add_argument("query")
    f.add_argument("--limit", type=int, default=50)
    sub.add_parser("zoom").add_argument("target")
    i = sub.add_parser("impact")
    i.add_argument("targets", nargs="*")
    i.add_argument("--git-diff", help="a range of revisions")
    i.add_argument("--depth", type=int, default=2)
    i.add_argument("--include-tests", action="store_true", help="also the tests that changed files call for, risk and an inspection queue")
    g = sub.add_parser("graph")
    g.add_argument("symbol")
    g.add_argument("--depth", type=int, default=2)
    sub.add_parser("depgraph")
    sub.add_parser("architecture")
    w = sub.add_parser("workspace-init")
    w.add_argument("config")
    w.add_argument("repos", nargs="+", help="folders, the first has the highest priority")
    sub.add_parser("workspace-graph").add_argument("config")
    w = sub.add_parser("workspace-find")
    w.add_argument("config")
    w.add_argument("name")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[int, str]:
    """(exit code, text)."""
    config = Config.load(args.settings or f"{args.root}/{NAME}")
    e = Engine(spark, args.root, args.store, config)
    as_json = args.format == "json"
    show = lambda pack, render: packs.to_json(pack) if as_json else render(pack)
    budget = lambda kind: resolve_budget(args.max_tokens, kind, config.budgets.get(kind))
    if args.command in ("index", "watch"):
        e.config = config.with_(include=args.include and config.include + args.include, exclude=args.exclude and config.exclude + args.exclude, max_size=args.max_size)
    if args.command == "index":
        return 0, json.dumps(_rows(e.index(args.force))[0])
    if args.command == "watch":
        return 0, "\n".join(json.dumps(stats) for stats in Watch(e, config.debounce_seconds).run(args.batches))
    if args.command == "benchmark":
        return 0, json.dumps(benchmark.run(spark, args.files))
    if args.command == "depgraph":
        m = cut(parse_manifests(e.manifests()))
        edges = module_edges(m)
        if as_json:
            return 0, json.dumps({"nodes": _rows(m.select("id", "name", "type", "language", "version")), "edges": _rows(edges)})
        return 0, (modules.to_dot if args.format == "dot" else modules.to_mermaid)(m, edges)
    if args.command == "architecture":
        c = e.contents()
        pack = {"frameworks": _rows(architecture.frameworks(c)), "layers": _rows(architecture.layer_sizes(c)), "patterns": [r["pattern"] for r in _rows(architecture.patterns(c).where("found"))], "recommendations": [r["recommendation"] for r in _rows(architecture.advice(c))]}
        return 0, json.dumps(pack, indent=2) if as_json else architecture.render(pack)
    if args.command == "workspace-init":
        made = workspace.Workspace.create(args.repos)
        made.save(args.config)
        return 0, "\n".join(f"{r.priority} {r.name} {r.path}" for r in made.repos)
    if args.command == "workspace-graph":
        repos = [r for r in workspace.Workspace.load(args.config).repos if r.enabled]
        t = {r.name: Engine(spark, r.path).tables() for r in repos}
        provided = workspace.unite({k: v["files"].select(stem(F.col("path")).alias("name")) for k, v in t.items()})
        links = workspace.cross_repo_edges(workspace.unite({k: v["imports"].select("module") for k, v in t.items()}), provided).orderBy("from_repo", "to_repo", "module")
        return 0, json.dumps({"repos": [r.name for r in repos], "links": _rows(links.limit(200))})
    if args.command == "workspace-find":
        repos = [r for r in workspace.Workspace.load(args.config).repos if r.enabled]
        t = {r.name: Engine(spark, r.path).tables() for r in repos}
        hits = workspace.find_symbol(workspace.unite({k: v["symbols"] for k, v in t.items()}), workspace.unite({k: v["files"] for k, v in t.items()}), args.name)
        return 0, json.dumps(_rows(hits.limit(200)))
    t = e.tables()
    if args.command == "repomap":
        return 0, show(packs.repo_map(t, budget("repomap"), args.focus, args.depth), packs.render_map)
    if args.command == "find":
        hits = search.search(t["postings"], args.query, args.limit).withColumnRenamed("doc_id", "id")
        rows = _rows(hits.join(t["symbols"].select("id", "name", "kind", "file_id", "line_start"), "id").join(t["files"].select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("rank", "id"))
        return 0, json.dumps(rows) if as_json else "\n".join(f"- `{r['name']}` ({r['kind']}) {r['path']}:{r['line_start']}" for r in rows)
    if args.command == "zoom":
        pack = packs.zoom(t, args.target, budget("zoom"), e.contents())
        return (0, show(pack, packs.render_zoom)) if pack else (1, f"not found: {args.target}")
    if args.command == "impact":
        targets = list(args.targets)
        if args.git_diff:
            targets += subprocess.run(["git", "-C", args.root, "diff", "--name-only", args.git_diff, "--"], capture_output=True, text=True, check=True).stdout.split()
        pack = packs.impact_pack(t, targets, args.depth, budget("impact"))
        if args.include_tests:
            changed = t["symbols"].join(t["files"].where(F.col("path").isin(targets)).select(F.col("id").alias("file_id"), "path"), "file_id")
            found = changes.analyze(changed.select("path", "name", "kind", "line_start", F.col("signature").alias("line_text")), t["symbols"], t["files"], t["postings"], e.contents())
            pack["analysis"] = changes.report(found, targets)
            return 0, show(pack, lambda p: packs.render_impact(p) + "\n\n" + changes.render(p["analysis"]))
        return 0, show(pack, packs.render_impact)
    at = packs.resolve_target(t, args.symbol)
    if at is None:
        return 1, f"not found: {args.symbol}"
    nodes, edges = export.subgraph(t["edges"], t["symbols"], at, args.depth)
    named = _rows(t["symbols"].where(F.col("id").isin(nodes)).select("id", "name", "kind"))
    return 0, export.to_dot(named, edges) if args.format == "dot" else export.to_mermaid(named, edges)


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("sparkloom").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    code, text = run(spark, args)
    if args.output:
        Path(args.output).write_text(text + "\n")
    else:
        print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
