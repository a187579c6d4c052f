"""Several repositories as one: union by a repo column, totals, search across."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Repo:
    path: str
    name: str
    enabled: bool = True
    exclude_patterns: list[str] = field(default_factory=list)
    priority: int = 0


@dataclass
class Workspace:
    repos: list[Repo] = field(default_factory=list)

    @classmethod
    def create(cls, paths: list[str]) -> Workspace:
        return cls([Repo(p, Path(p).name, priority=len(paths) - i) for i, p in enumerate(paths)])

    def add(self, path: str, name: str | None = None) -> None:
        self.repos.append(Repo(path, name or Path(path).name, priority=len(self.repos)))

    def remove(self, name: str) -> bool:
        before = len(self.repos)
        self.repos = [r for r in self.repos if r.name != name]
        return len(self.repos) < before

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"repos": [asdict(r) for r in self.repos]}, indent=2))

    @classmethod
    def load(cls, path: str) -> Workspace:
        return cls([Repo(**r) for r in json.loads(Path(path).read_text())["repos"]])


def unite(tables: dict[str, DataFrame]) -> DataFrame:
    """The same table of several repositories with a column `repo`."""
    return reduce(DataFrame.unionByName, [df.withColumn("repo", F.lit(name)) for name, df in tables.items()])


def summary(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, files, symbols, edges) of each repo, and a row of totals with null repo."""
    parts = [df.groupBy("repo").agg(F.count("*").alias("n")).select("repo", F.lit(kind).alias("kind"), "n") for kind, df in (("files", files), ("symbols", symbols), ("edges", edges))]
    counts = reduce(DataFrame.unionAll, parts)
    return counts.rollup("repo").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("bigint").alias(k) for k in ("files", "symbols", "edges")])


def find_symbol(symbols: DataFrame, files: DataFrame, part: str) -> DataFrame:
    """(repo, name, kind, path, line_start) of symbols whose name holds `part`, whatever the case."""
    safe = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hit = symbols.where(F.col("name").ilike(f"%{safe}%"))
    return hit.join(files.select("repo", F.col("id").alias("file_id"), "path"), ["repo", "file_id"]).select("repo", "name", "kind", "path", "line_start")


def cross_repo_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(from_repo, to_repo, module, n): imports(repo, module) of what another repository's modules(repo, name) provide."""
    other = modules.select(F.col("repo").alias("to_repo"), F.col("name").alias("module")).distinct()
    return imports.join(other, "module").where("repo <> to_repo").groupBy(F.col("repo").alias("from_repo"), "to_repo", "module").agg(F.count("*").alias("n"))


def first_provider(results: DataFrame) -> DataFrame:
    """results(key, provider_rank, value): of each key the rows of the first provider that has any."""
    best = results.groupBy("key").agg(F.min("provider_rank").alias("provider_rank"))
    return results.join(best, ["key", "provider_rank"], "left_semi")
