"""Maintaining the tables: upsert, append, cascade deletes, incremental differences, snapshots.

Tables are Parquet snapshots. A change gives a new snapshot, written whole to a
new folder; then a file of the folder's name is put among the versions, in one
step. The version of the greatest number is the current one, so a job that fails
at any point leaves the old one. Old snapshots but the last KEPT are removed. Paths may be URIs.
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.schema import TABLES

#: Snapshots that stay, the current one among them; readers of older ones must begin anew.
KEPT = 3
#: Files of the postings of a snapshot.
BUCKETS = 16
#: Seconds after which the lock of a writer that gives no sign is taken from it.
STALE = 6 * 3600
DIFF = ("new", "changed", "unchanged", "deleted")


def diff_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """(path, status) of files(path, mtime, size, content_hash): new, changed, unchanged or deleted."""
    n = new.select("path", "mtime", "size", F.col("content_hash").alias("hash"), F.lit(True).alias("is_new"))
    o = old.select("path", F.col("mtime").alias("mtime0"), F.col("size").alias("size0"), F.col("content_hash").alias("hash0"), F.lit(True).alias("is_old"))
    same = F.col("mtime").eqNullSafe(F.col("mtime0")) & F.col("size").eqNullSafe(F.col("size0")) & F.col("hash").eqNullSafe(F.col("hash0"))
    status = F.when(F.col("is_old").isNull(), "new").when(F.col("is_new").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return n.join(o, "path", "full_outer").select("path", status.alias("status"))


def run_stats(diff: DataFrame) -> DataFrame:
    """One row: scanned, new, changed, unchanged and deleted files."""
    return diff.agg(F.count_if(F.col("status") != "deleted").alias("scanned"), *[F.count_if(F.col("status") == s).alias(s) for s in DIFF])


def upsert_files(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """`old` with rows of `new` taking over by path; ids stay, new paths get ids after the last one in order of path."""
    last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    values = [c for c in old.columns if c not in ("id", key)]
    fresh = new.join(old.select(key), key, "left_anti")
    numbered = with_ids(fresh.drop("id"), [key]).crossJoin(F.broadcast(last)).withColumn("id", F.col("id") + F.col("last")).drop("last")
    n = new.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in values])
    updated = old.join(n, key, "left").select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])
    return updated.unionByName(numbered.select(*old.columns))


def with_ids(rows: DataFrame, order: list[str], first: int = 1, ranged: bool = False) -> DataFrame:
    """Rows numbered in the given order. Ranges are sorted in parallel and numbered by the counts of those before, so no task sees all rows.

    ranged: the partitions of `rows` are already ranges of the order's first column,
    each value in one of them. Otherwise the rows are made twice, to find the ranges and to fill them.
    """
    from sparkloom.runtime import cut

    if not ranged:
        rows = rows.repartitionByRange(*order)
    return _counted(cut(_located(rows.sortWithinPartitions(*order))), first)  # the numbers must not change if a task is run again


def in_order(rows: DataFrame, first: int = 1) -> DataFrame:
    """Rows numbered as they come, partition by partition."""
    from sparkloom.runtime import cut

    return _counted(cut(_located(rows)), first)


def _located(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))


def _counted(located: DataFrame, first: int) -> DataFrame:
    counts = {r[0]: r[1] for r in located.groupBy("_part").count().collect()}  # one number for each task
    if not counts:
        return located.drop("_part", "_at").withColumn("id", F.lit(0).cast("bigint"))
    before, starts = first, []
    for part in range(max(counts) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    start = F.get(F.array(*[F.lit(k) for k in starts]).cast("array<bigint>"), F.col("_part"))
    return located.withColumn("id", (start + F.col("_at")).cast("bigint")).drop("_part", "_at")


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files of gone(path) and what hangs on them."""
    out = dict(tables)
    file_ids = tables["files"].join(gone.select("path"), "path", "left_semi").select(F.col("id").alias("file_id"))
    out["files"] = tables["files"].join(gone.select("path"), "path", "left_anti").select(*tables["files"].columns)
    return _without_file_ids(out, file_ids)


def _without_file_ids(tables: dict[str, DataFrame], file_ids: DataFrame) -> dict[str, DataFrame]:
    out = dict(tables)
    lost = tables["symbols"].join(file_ids, "file_id", "left_semi").select("id")
    out["symbols"] = tables["symbols"].join(file_ids, "file_id", "left_anti").select(*tables["symbols"].columns)
    edges = tables["edges"].join(file_ids, "file_id", "left_anti")
    for end in ("source_id", "target_id"):
        edges = edges.join(lost.withColumnRenamed("id", end), end, "left_anti")
    out["edges"] = edges.select(*tables["edges"].columns)
    for raw in ("calls", "imports"):
        if raw in tables:
            out[raw] = tables[raw].join(file_ids, "file_id", "left_anti").select(*tables[raw].columns)
    if "callsites" in tables:
        out["callsites"] = tables["callsites"].join(out["edges"].select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select(*tables["callsites"].columns)
    return out


def replace_changed(old: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows of `old` whose file_id isn't in changed(file_id), and the fresh rows."""
    return old.join(changed.select("file_id"), "file_id", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def replace_rows(old: DataFrame, fresh: DataFrame, key: str, live: DataFrame) -> DataFrame:
    """Rows of `old` whose key is still in live(key) and not among the fresh ones, and the fresh rows."""
    kept = old.join(live.select(key), key, "left_semi").join(fresh.select(key), key, "left_anti")
    return kept.select(*old.columns).unionByName(fresh.select(*old.columns))


def stale_files(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Known files(path, ...) whose path no scan shows any more."""
    return files.join(scanned.select("path"), "path", "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def _fs(base: str):
    """(file system, folder) of a path or URI."""
    from pyarrow import fs

    source, at = fs.FileSystem.from_uri(base if "://" in base else Path(base).absolute().as_uri())
    return source, at.rstrip("/")


def _versions(base: str) -> list[tuple[int, str]]:
    """(number, folder) of the snapshots, the oldest first."""
    from pyarrow import fs

    source, at = _fs(base)
    found = source.get_file_info(fs.FileSelector(f"{at}/versions", allow_not_found=True))
    return sorted((int(f.base_name.partition("-")[0]), f.base_name.partition("-")[2]) for f in found if f.is_file and f.base_name[:1].isdigit())


def current(base: str) -> str | None:
    """The folder of the current snapshot; None without one."""
    every = _versions(base)
    return every[-1][1] if every else None


def write_snapshot(tables: dict[str, DataFrame], base: str) -> str:
    """Write all tables to a new folder under base and make it the current one; gives the folder's name."""
    name = f"v{uuid.uuid4().hex}"
    for table, df in tables.items():
        out = df.repartition(BUCKETS, "term").sortWithinPartitions("term") if table == "postings" else df  # so that a term is in one file, and found by its statistics
        out.write.parquet(f"{base}/{name}/{table}")
    source, at = _fs(base)
    every = _versions(base)
    number = every[-1][0] + 1 if every else 1
    source.create_dir(f"{at}/versions")
    with source.open_output_stream(f"{at}/versions/{number:012d}-{name}") as f:  # its name says all
        f.write(b"")
    for old, folder in every[: max(0, len(every) + 1 - KEPT)]:
        source.delete_file(f"{at}/versions/{old:012d}-{folder}")
        with contextlib.suppress(FileNotFoundError):
            source.delete_dir(f"{at}/{folder}")
    return name


def read_snapshot(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    name = current(base)
    if name is None:
        raise FileNotFoundError(f"no index at {base}")
    return {t: spark.read.schema(s).parquet(f"{base}/{name}/{t}") for t, s in TABLES.items()}


class Locked(RuntimeError):
    """Another writer has the index."""


@contextlib.contextmanager
def lock(base: str, wait: float | None = None, stale: float = STALE) -> Iterator[None]:
    """Hold the index for writing. One writer's folder `lock` at a time; a writer that died on this host, or is older than `stale` seconds, loses it."""
    source, at = _fs(base)
    local = "://" not in base or base.startswith("file:")
    mine = f"{at}/lock"
    source.create_dir(at)
    said = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "since": time.time()})
    began = time.time()
    while True:
        if local:
            try:
                with open(os.open(mine, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(said)
                break
            except FileExistsError:
                pass
        elif not source.get_file_info(mine).is_file:
            # object stores have no exclusive creation: the last to write has it, which each sees after a moment
            with source.open_output_stream(mine) as f:
                f.write(said.encode())
            time.sleep(0.5)
        with contextlib.suppress(FileNotFoundError, ValueError):
            with source.open_input_stream(mine) as f:
                text = f.read().decode()
            if text == said:
                break
            holder = json.loads(text)
            dead = holder["host"] == socket.gethostname() and not Path(f"/proc/{holder['pid']}").exists() and Path("/proc/self").exists()
            if dead or time.time() - holder["since"] > stale:
                source.delete_file(mine)
                continue
        if wait is not None and time.time() - began >= wait:
            raise Locked(f"another writer has {base}")
        time.sleep(0.05)
    try:
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            source.delete_file(mine)


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
