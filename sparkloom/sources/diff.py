"""Unified diffs as tables of changed files, hunks and lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
NEW_PATH = r"^\+\+\+ (?:b/)?(.+)$"
_HUNK = re.compile(HUNK, re.ASCII)
_ENDS = "\r\x85\u2028\u2029"  # with the line feed, what ends a line in Java's patterns
_NEW_PATH = re.compile(rf"^\+\+\+ (?:b/)?([^{_ENDS}]+)[{_ENDS}]?\Z")


def _places(text: str) -> tuple[list[str | None], list[int]]:
    """For each line of a diff its file and the number of its hunk."""
    paths, hunks, path, hunk = [], [], None, 0
    for row in text.split("\n"):
        if m := _NEW_PATH.match(row):
            path = m[1]
        if _HUNK.match(row):
            hunk += 1
        paths.append(path)
        hunks.append(hunk)
    return paths, hunks


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, at, text, path, hunk) of each line of diffs(diff_id, text): the file and hunk it stands in. Each text is gone over once; no lines are sent or sorted."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(None, None) if t is None else _places(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([h for _, h in found], pa.list_(pa.int64()))], ["diff_id", "text", "paths", "hunks"])

    own = diffs.select("diff_id", "text")
    schema = T.StructType([*own.schema.fields, T.StructField("paths", T.ArrayType(T.StringType())), T.StructField("hunks", T.ArrayType(T.LongType()))])
    rows = own.mapInArrow(located, schema).select("diff_id", "paths", "hunks", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return rows.select("diff_id", "at", "text", F.get("paths", F.col("at")).alias("path"), F.get("hunks", F.col("at")).alias("hunk"))


def hunks(diffs: DataFrame) -> DataFrame:
    """(diff_id, path, hunk, old_start, old_count, new_start, new_count, added, removed); a count left out is 1."""
    head = F.col("text").rlike(HUNK)
    # the header of the next file isn't part of the hunk before it
    rows = diff_lines(diffs).where((F.col("hunk") > 0) & ~F.col("text").rlike(r"^(?:\+\+\+|---) "))

    def part(k: int):
        x = F.max(F.when(head, F.coalesce(F.nullif(F.regexp_extract("text", HUNK, k), F.lit("")), F.lit("1"))))
        return x.cast("int")

    body = ~head
    return rows.groupBy("diff_id", "path", "hunk").agg(part(1).alias("old_start"), part(2).alias("old_count"), part(3).alias("new_start"), part(4).alias("new_count"), F.count_if(body & F.col("text").startswith("+")).alias("added"), F.count_if(body & F.col("text").startswith("-")).alias("removed"))


def changed_files(diffs: DataFrame) -> DataFrame:
    """(diff_id, path) of the files that diffs(diff_id, text) name, once each."""
    rows = diffs.select("diff_id", F.explode(F.split("text", "\n")).alias("row"))
    return rows.select("diff_id", F.nullif(F.regexp_extract("row", NEW_PATH, 1), F.lit("")).alias("path")).where("path is not null").distinct()
