"""File changes as streams: filter, debounce, incremental runs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

IGNORED_DIRS = ("node_modules", "target", "venv", "build", "dist", "__pycache__", ".git", ".venv")
WATCHED = r"\.(?:py|[jt]sx?|rs|go)$"


def relevant(changes: DataFrame) -> DataFrame:
    """Of changes(ts, change_type, path) those in watched languages outside ignored folders."""
    return changes.where(F.col("path").rlike(WATCHED) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_DIRS))))


def debounce(changes: DataFrame, gap: str = "1 second", by: str | None = None, late: str | None = None) -> DataFrame:
    """(started, last_change, n_changes, paths): changes at most `gap` apart make one batch of different paths.

    Batch or stream. A stream is watermarked by `late` (the gap, if not given):
    events later than that are dropped, and a batch comes out when the watermark
    passes its end. Without `by` all changes are one
    sequence, so one task orders them: give a column of repositories to share the work.
    """
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late or gap)
    # a stream needs a key beside the session; this one is the same for all rows
    one = [F.substring("path", 1, 0).alias("_all")] if changes.isStreaming else []
    keys = [F.session_window("ts", gap).alias("w"), *([F.col(by)] if by else one)]
    out = changes.groupBy(*keys).agg(F.count("*").alias("n_changes"), F.array_sort(F.collect_set("path")).alias("paths"), F.max("ts").alias("last_change"))
    return out.select(*([by] if by else []), F.col("w.start").alias("started"), "last_change", "n_changes", "paths")


def on_batches(batches: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Call update(batch, epoch) for each debounced batch; one query writes, and its checkpoint makes it exactly-once per epoch."""
    return batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(update).start()


def change_stats(changes: DataFrame) -> DataFrame:
    """One row: events, different paths, seconds from first to last, events a minute."""
    span = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts"))
    return changes.agg(F.count("*").alias("n_events"), F.count_distinct("path").alias("n_paths"), (span / 1e6).alias("seconds"), F.when(span > 0, F.count("*") / (span / 6e7)).alias("per_minute"))


@dataclass
class Watch:
    """Keeps an index up to date: the tree is listed every `period` seconds, and once it has been still for `quiet` seconds the index is run.

    The listing goes through the index's own rules, so what it ignores wakes nobody.
    """

    engine: object
    quiet: float = 1.0
    period: float = 0.5
    stats: dict = field(default_factory=lambda: {"runs": 0, "changed_files": 0})
    _stop: threading.Event = field(default_factory=threading.Event)

    def stop(self) -> None:
        """End run() after what it is doing now."""
        self._stop.set()

    def _state(self) -> tuple:
        """One row that differs when a path, a time or a size does."""
        return tuple(self.engine.listing().agg(F.count("*"), F.sum(F.xxhash64("path", "mtime", "size").cast("decimal(38,0)"))).first())

    def run(self, batches: int | None = None) -> Iterator[dict]:
        """run_stats() of each index run, the first at once; ends after so many, or at stop()."""
        indexed, seen, since = None, None, 0.0
        while not self._stop.is_set():
            now = self._state()
            if now != seen:
                seen, since = now, time.monotonic()
            if now != indexed and (indexed is None or time.monotonic() - since >= self.quiet):
                row = self.engine.index().first().asDict()
                indexed = now
                self.stats["runs"] += 1
                self.stats["changed_files"] += row["new"] + row["changed"] + row["deleted"]
                yield row
                if batches is not None and self.stats["runs"] >= batches:
                    return
            self._stop.wait(self.period)
