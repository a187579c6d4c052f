"""Symbol graphs as nodes, edges and drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import neighbourhood

SHAPES = {"class": ("[[", "]]"), "function": ("(", ")"), "method": ("([", "])")}


def label(c):
    """At most 40 characters: longer ones are cut to 37 and dots."""
    return F.when(F.length(c) > 40, F.concat(F.substring(c, 1, 37), F.lit("..."))).otherwise(c)


def subgraph(edges: DataFrame, symbols: DataFrame, root: int, depth: int = 2, up: bool = True, down: bool = True) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Nodes and edges as a depth-first walk meets them: an edge only if its far end is new at that moment.

    The k-step neighbourhood is found in Spark; the walk itself goes one step
    after another over that subset, on the driver. Above the root only callers
    are followed, below it only callees.
    """
    known = {r[0] for r in symbols.where(F.col("id") == root).select("id").collect()}
    if root not in known:
        return [], []
    rows = neighbourhood(edges, symbols, root, depth).orderBy("id").collect()
    into: dict[int, list] = {}
    out_of: dict[int, list] = {}
    for r in rows:
        into.setdefault(r["target_id"], []).append(r)
        out_of.setdefault(r["source_id"], []).append(r)
    nodes, drawn, seen = [], [], set()

    def walk(node: int, at: int, ups: bool, downs: bool) -> None:
        if at > depth or node in seen:
            return
        seen.add(node)
        nodes.append(node)
        for go, links, end in ((ups, into, "source_id"), (downs, out_of, "target_id")):
            for e in links.get(node, []) if go else []:
                if e[end] not in seen:
                    drawn.append((e["source_id"], e["target_id"], e["kind"]))
                    walk(e[end], at + 1, end == "source_id", end == "target_id")

    walk(root, 0, up, down)
    return nodes, [e for e in drawn if e[0] in seen and e[1] in seen]


def to_mermaid(nodes: list[dict], edges: list[tuple[int, int, str]], title: str | None = None) -> str:
    """nodes: dicts of id, name and kind."""
    out = (["---", f"title: {title}", "---"] if title else []) + ["graph TD"]
    for n in sorted(nodes, key=lambda n: str(n["id"])):
        a, b = SHAPES.get(n["kind"], ("[", "]"))
        out.append(f"    n{n['id']}{a}\"{_short(n['name'])}\"{b}")
    out += [f"    n{s} {'-.->' if k == 'import' else '-->'} n{t}" for s, t, k in edges]
    return "\n".join(out)


def to_dot(nodes: list[dict], edges: list[tuple[int, int, str]]) -> str:
    out = ["digraph symbols {"]
    out += [f'    n{n["id"]} [label="{_short(n["name"])}"];' for n in sorted(nodes, key=lambda n: str(n["id"]))]
    out += [f"    n{s} -> n{t}{' [style=dashed]' if k == 'import' else ''};" for s, t, k in edges]
    return "\n".join([*out, "}"])


def _short(x: str) -> str:
    return x if len(x) <= 40 else x[:37] + "..."
