"""File trees as tables."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.paths import language_of, suffix
from sparkloom.sources.ignore import Rule, ignored_path

MAX_SIZE = 1 << 20
#: Contents sent on at once by a task.
BATCH_BYTES = 8 << 20
#: Folders that the driver lists itself before executors go on.
FRONTIER = 256


def _open(root: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else Path(root).resolve().as_uri())


def read_text(path: str) -> str | None:
    """The text of one small file, None if there is no such file."""
    source, at = _open(path)
    try:
        with source.open_input_stream(at) as f:
            return f.read().decode("utf-8", "replace")
    except (FileNotFoundError, IsADirectoryError):
        return None


def list_tree(spark: SparkSession, root: str, rules: list[Rule] = (), include: list[Rule] = (), exclude: list[Rule] = (), extensions: set[str] | None = None, max_size: int | None = None) -> DataFrame:
    """(path, mtime, size) of the files under root that pass the rules, underscored and empty ones too, which Spark's own listing leaves out.

    Folders that the rules leave out aren't entered. The driver goes down only
    until it knows some FRONTIER folders; executors list those and walk on below them.
    """
    from pyarrow import fs

    rules, include, exclude = list(rules), list(include), list(exclude)

    def children(source, base: str, folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
        """Files and folders of a folder that pass the rules."""
        files, folders = [], []
        try:
            found = source.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
        except FileNotFoundError:
            return [], []
        for f in found:
            path = f"{folder}/{f.base_name}" if folder else f.base_name
            if ignored_path(path, rules, include, exclude, f.type == fs.FileType.Directory):
                continue
            if f.type == fs.FileType.Directory:
                folders.append(path)
            elif f.type == fs.FileType.File:
                files.append((path, (f.mtime_ns or 0) // 10**9, f.size))
        return files, folders

    source, base = _open(root)
    base = base.rstrip("/")
    known, edge = [], [""]
    while edge and len(edge) + len(known) < FRONTIER:
        known += edge
        edge = [d for folder in edge for d in children(source, base, folder)[1]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = _open(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder, deep in zip(*(c.to_pylist() for c in batch.columns)):
                todo = [folder]
                while todo:
                    files, folders = children(source, base, todo.pop())
                    if deep:
                        todo += folders
                    if files:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*files), (pa.string(), pa.int64(), pa.int64()))], ["path", "mtime", "size"])

    start = spark.createDataFrame([(d, False) for d in known] + [(d, True) for d in edge], "folder string, deep boolean")
    out = start.repartition(max(1, min(len(known) + len(edge), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(walk, "path string, mtime bigint, size bigint")
    if extensions:
        out = out.where(suffix(F.col("path")).isin(*extensions))
    return out.where(F.col("size") <= max_size) if max_size else out


def scan_tree(spark: SparkSession, root: str, rules: list[Rule] = (), include: list[Rule] = (), exclude: list[Rule] = (), extensions: set[str] | None = None, max_size: int | None = MAX_SIZE) -> DataFrame:
    """(path, mtime, size, language, content_hash, text) of the files under root that pass the rules. root must be a folder that all executors see."""
    return read_contents(list_tree(spark, root, rules, include, exclude, extensions, max_size), root)


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """files(path, mtime, size) under root with language, content_hash and text. A file that is gone by then is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = _open(root)
        names = ["path", "mtime", "size", "content"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for path, mtime, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with source.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        rows.append((path, mtime, size, f.read()))
                except FileNotFoundError:
                    continue
                held += size
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    got = files.select("path", "mtime", "size").mapInArrow(read, "path string, mtime bigint, size bigint, content binary")
    return got.select("path", "mtime", "size", language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
