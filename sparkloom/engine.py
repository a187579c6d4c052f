"""A repository's index from its files: built whole or brought up to date, and kept as snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.config import Config
from sparkloom.operators import graph, ingest, relations, search, store
from sparkloom.runtime import cut
from sparkloom.schema import TABLES, VERSION
from sparkloom.sources.files import list_tree, read_contents, read_text
from sparkloom.sources.ignore import Rule, load_rules, parse_rules

FOLDER = ".sparkloom"


def _typed(df: DataFrame, table: str) -> DataFrame:
    """Columns as the table has them; those that are missing are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])


@dataclass
class Engine:
    """Reads a tree of files and keeps its tables. root and store may be paths or URIs of any file system that the executors see too."""

    spark: SparkSession
    root: str
    store_at: str | None = None
    config: Config = field(default_factory=Config)

    @property
    def base(self) -> str:
        return self.store_at or f"{self.root.rstrip('/')}/{FOLDER}"

    def rules(self) -> list[Rule]:
        own = read_text(f"{self.root.rstrip('/')}/.gitignore") if self.config.use_gitignore else None
        return load_rules(self.config.ignore) + parse_rules((own or "").splitlines())

    def listing(self, extensions: set[str] | None = None) -> DataFrame:
        """(path, mtime, size) of the files that count."""
        return list_tree(self.spark, self.root, self.rules(), load_rules(self.config.include), load_rules(self.config.exclude), extensions or set(self.config.extensions), self.config.max_size)

    def scan(self, extensions: set[str] | None = None) -> DataFrame:
        """(path, mtime, size, language, content_hash, text) of the files that count."""
        return read_contents(self.listing(extensions), self.root)

    def manifests(self) -> DataFrame:
        """(path, text) of files of any suffix, for the readers of manifests."""
        return read_contents(list_tree(self.spark, self.root, self.rules(), load_rules(self.config.include), load_rules(self.config.exclude), None, self.config.max_size), self.root).select("path", "text")

    def contents(self) -> DataFrame:
        """(path, text) of all files that count."""
        return self.scan().select("path", "text")

    def tables(self) -> dict[str, DataFrame]:
        return store.read_snapshot(self.spark, self.base)

    def has_index(self) -> bool:
        return store.current(self.base) is not None

    def index(self, force: bool = False, wait: float | None = None) -> DataFrame:
        """Bring the index up to date and give run_stats(); unless forced only files whose time or size differ are read, and only those whose contents differ parsed.

        One writer at a time: another one waits up to `wait` seconds (for ever if None) and then gets store.Locked.
        """
        with store.lock(self.base, wait):
            return self._index(force)

    def _index(self, force: bool) -> DataFrame:
        old = store.empty_tables(self.spark) if force or not self.has_index() else self.tables()
        listed = cut(self.listing())
        before = old["files"].select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("content_hash").alias("_h"), F.col("language").alias("_l"))
        both = listed.join(before, "path", "left")
        same = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s"))
        read = cut(read_contents(both.where(~same).select("path", "mtime", "size"), self.root))  # the rest is as it was
        scanned = read.drop("text").unionByName(both.where(same).select("path", "mtime", "size", F.col("_l").alias("language"), F.col("_h").alias("content_hash")))
        seen = scanned.select("path", "mtime", "size", "content_hash", "language", F.col("language").alias("lang"), F.unix_timestamp().alias("indexed_at"))
        diff = cut(store.diff_files(scanned, old["files"]))
        kept = store.delete_files(old, diff.where("status = 'deleted'"))
        files = cut(_typed(store.upsert_files(kept["files"], seen), "files"))
        parse = files.join(diff.where("status in ('new', 'changed')").select("path"), "path", "left_semi").select(F.col("id").alias("file_id"), "path")
        kept = store._without_file_ids(kept, parse.select("file_id"))
        lines = cut(ingest.lines(parse.join(read.select("path", "text"), "path")))
        found = ingest.symbols(lines).withColumnRenamed("line", "line_start")
        # a blank file still has a symbol of its own
        blank = parse.join(found.select("file_id"), "file_id", "left_anti").select("file_id", "path", F.lit(1).alias("line_start"), F.lit(0).alias("ord"), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("name"), F.lit("file").alias("kind"))
        found = found.unionByName(blank, allowMissingColumns=True)
        last = kept["symbols"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        fresh = cut(store.with_ids(found, ["path", "line_start", "ord"], last + 1))
        symbols = cut(kept["symbols"].unionByName(_typed(fresh.join(relations.parent_by_name(fresh), "id"), "symbols")))
        calls = cut(kept["calls"].unionByName(_typed(ingest.callsites(lines), "calls")))
        imports = cut(kept["imports"].unionByName(_typed(ingest.imports(lines), "imports")))
        edges, callsites = self._edges(files, symbols, calls, imports)
        stats = store.run_stats(diff)
        postings = store.replace_rows(kept["postings"], _typed(search.postings(fresh), "postings"), "doc_id", symbols.select(F.col("id").alias("doc_id")))
        meta = self.spark.createDataFrame([("schema_version", str(VERSION)), ("indexed_files", str(files.count())), ("indexed_symbols", str(symbols.count()))], TABLES["meta"])
        store.write_snapshot({"files": files, "symbols": symbols, "edges": edges, "callsites": callsites, "calls": calls, "imports": imports, "postings": postings, "meta": meta}, self.base)
        return stats

    def _edges(self, files: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges and callsites. A changed file may give or take the target of any other file's calls, so all stored calls and imports are resolved again: two hash joins, no text."""
        named = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        resolved = cut(ingest.resolve_calls(calls, named))
        keys = ["source_id", "target_id", "kind", "file_id"]
        every = resolved.groupBy(*keys).agg(F.max("confidence").alias("confidence")).unionByName(ingest.resolve_imports(imports, files, named))
        edges = cut(_typed(store.with_ids(every.withColumn("metadata", F.to_json(F.struct("confidence"))), keys), "edges"))
        placed = resolved.join(edges.select(F.col("id").alias("edge_id"), *keys), keys).select("edge_id", "line", F.col("callee").alias("context"))
        return edges, cut(_typed(store.with_ids(placed, ["edge_id", "line", "context"]), "callsites"))

    # questions to the stored index

    def callers(self, symbol: int | str, depth: int = 1, min_conf: float = 0.0) -> DataFrame:
        t = self.tables()
        return graph.callers(t["symbols"], t["edges"], t["files"], symbol, depth, min_conf)

    def callees(self, symbol: int | str, depth: int = 1, min_conf: float = 0.0) -> DataFrame:
        t = self.tables()
        return graph.callees(t["symbols"], t["edges"], t["files"], symbol, depth, min_conf)

    def impact(self, targets: list[int | str], depth: int = 2) -> dict[str, DataFrame]:
        t = self.tables()
        return graph.impact(t["symbols"], t["edges"], t["files"], targets, depth)

    def find(self, query: str, limit: int | None = 50) -> DataFrame:
        return search.search(self.tables()["postings"], query, limit)
