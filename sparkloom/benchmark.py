"""Times of an index over a generated repository: built cold, brought up to date, and asked."""

from __future__ import annotations

import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.operators import packs, search


def module(i: int, extra: str = "") -> str:
    return f"""import os
from pkg.mod_{max(i - 1, 0)} import first_{max(i - 1, 0)}


def first_{i}(x):
    return x{extra}


def second_{i}(x):
    return first_{i}(x) + first_{max(i - 1, 0)}(x)


class Thing{i}:
    def run(self):
        return second_{i}(1)
"""


def run(spark: SparkSession, n_files: int = 100, n_changed: int = 10) -> dict[str, float]:
    """Seconds of each step."""
    root = Path(tempfile.mkdtemp(prefix="sparkloom-benchmark-"))
    try:
        (root / "pkg").mkdir()
        for i in range(n_files):
            (root / "pkg" / f"mod_{i}.py").write_text(module(i))
        e = Engine(spark, str(root))
        out: dict[str, float] = {}

        def timed(name: str, f) -> None:
            began = time.time()
            f()
            out[name] = round(time.time() - began, 3)

        timed("cold_index", lambda: e.index().collect())
        for i in range(min(n_changed, n_files)):
            (root / "pkg" / f"mod_{i}.py").write_text(module(i, " + 1"))
        timed("incremental_index", lambda: e.index().collect())
        t = e.tables()
        timed("repository_map", lambda: packs.repo_map(t))
        timed("zoom", lambda: packs.zoom(t, f"first_{n_files // 2}", contents=e.contents()))
        timed("impact", lambda: packs.impact_pack(t, [f"first_{n_files // 2}"]))
        timed("search", lambda: search.search(t["postings"], "first*").collect())
        return out
    finally:
        shutil.rmtree(root, ignore_errors=True)


def summary(runs: DataFrame) -> DataFrame:
    """(operation, n, least, most, mean, median, total) of runs(operation, seconds)."""
    s = F.col("seconds")
    two = lambda c: F.round(c, 2)
    return runs.groupBy("operation").agg(F.count("*").alias("n"), two(F.min(s)).alias("least"), two(F.max(s)).alias("most"), two(F.avg(s)).alias("mean"), two(F.median(s)).alias("median"), F.round(F.sum(s), 1).alias("total"))


def parse_stats(outcomes: DataFrame) -> DataFrame:
    """One row of outcomes(path, ok, n_symbols, seconds): total, success, failed, symbols and files a second."""
    total = F.sum("seconds")
    return outcomes.agg(F.count("*").alias("total"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("n_symbols"), F.lit(0)).cast("bigint").alias("symbols"), F.round(F.when(total > 0, F.count("*") / total), 3).alias("files_per_second"))
