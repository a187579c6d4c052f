"""Session helpers shared by every operator."""

from __future__ import annotations

import math
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where much is made of each row.
ROWS = 10_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a context; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="sparkloom-ship-")) / "sparkloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a private one only on a local master, where all tasks see it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on reliable storage and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str, ranged: bool = False) -> DataFrame:
    """`df` shared out among tasks of some ROWS rows by its key, or by ranges of it.

    A file of a few MB is read by one task or two, whatever is made of its rows
    afterwards; and partitions by bytes would see only how small the rows still are.
    A condition on what is made of the rows would be tested before they are sent; the
    one here, which depends on the task, keeps it behind.
    """
    n = max(1, math.ceil(df.count() / ROWS))
    dealt = df.repartitionByRange(n, key) if ranged else df.repartition(n, key)
    return dealt.where(F.spark_partition_id() >= 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
