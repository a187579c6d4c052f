"""Operator 1. Substring dedup by content-defined chunks.

A 32-bit gear hash, h = (h << 1) + gear[byte], rolls over each text; its value
depends on the last 32 bytes alone, so it is computed for all positions at once by
doubling. A chunk ends where five bits of it are 0 (every 32 bytes on
average); they are bits that the last 13 bytes decide, so the cuts of a repeated
passage agree soon after its start. None ends there if the candidate before it is
nearer than `min_bytes`; both tests see only local content, so an insertion shifts no cut beyond its own
neighbourhood. A stretch without a cut is cut every `max_bytes`.

Chunks are deduplicated by a 64-bit digest: the first occurrence (least doc_id,
of its texts the least by hash, then least offset) owns it. Adjacent chunks owned elsewhere make spans, and spans
of at least `min_span` bytes are duplicates: together such a span is many digests
long or one of a long chunk, so chance collisions don't show.

The chunk rows are shuffled once, by digest; counting and joining back both use
that partitioning. Only duplicate chunks are shuffled again, by document.

Defined cases: null or empty text has no span; rows with a null doc_id are left
out; a repeated row repeats nothing of itself (equal doc_id, text and offset are one
occurrence); a doc_id with several texts has the spans of each; a text that repeats itself has spans owned by itself; the earliest
occurrence is never reported; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import Bytes, slices, text_bytes

MIN_BYTES, MAX_BYTES, MIN_SPAN = 8, 512, 128
_GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)
#: A place is 32 bits of the text's digest before 32 bits of offset: with the doc_id it stands for a text and a byte of it.
CHUNKS = "digest bigint, doc_id bigint, place bigint, n_bytes int"


def gear_hashes(b: Bytes) -> np.ndarray:
    """The rolling hash after each byte; it starts at 0 in every text."""
    n_docs = len(b.offs) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(b.offs))
    at = np.arange(len(b.data)) + 32 * (doc + 1)  # 32 bytes that add nothing stand before each text
    h = np.zeros(len(b.data) + 32 * n_docs, np.uint32)
    h[at] = _GEAR[b.data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h[at]


def cuts(b: Bytes, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all chunks of all texts."""
    hit = np.flatnonzero((gear_hashes(b) >> np.uint32(8)) & np.uint32(31) == 0) + 1
    if len(hit):
        doc = np.searchsorted(b.offs, hit - 1, "right")
        alone = np.ones(len(hit), bool)
        alone[1:] = (np.diff(hit) >= min_bytes) | (doc[1:] != doc[:-1])
        hit = hit[alone]
    edges = np.union1d(hit, b.offs)
    gaps = np.diff(edges)
    n = (gaps + max_bytes - 1) // max_bytes  # pieces of each stretch
    starts = np.repeat(edges[:-1] - max_bytes * (np.cumsum(n) - n), n) + max_bytes * np.arange(int(n.sum()))
    ends = np.append(starts[1:], edges[-1:]) if len(starts) else starts
    return starts, ends


def chunk(docs: DataFrame, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """CHUNKS of docs(doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch):
                b = text_bytes(part.column(1))
                starts, ends = cuts(b, min_bytes, max_bytes)
                if not len(starts):
                    continue
                view = memoryview(b.data)
                digest = np.fromiter((one(view[x:y]) for x, y in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)).view(np.int64)
                doc = np.searchsorted(b.offs, starts, "right") - 1
                texts = np.fromiter((one(view[x:y]) & 0x7FFFFFFF for x, y in zip(b.offs.tolist(), b.offs[1:].tolist())), np.int64, len(b.offs) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest), part.column(0).take(pa.array(doc)), pa.array((texts[doc] << 32) + starts - b.offs[doc]), pa.array((ends - starts).astype(np.int32))],
                    ["digest", "doc_id", "place", "n_bytes"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("doc_id is not null and text is not null").mapInArrow(rows, CHUNKS)


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN, min_bytes: int = MIN_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, byte_start, byte_end, n_chunks, source_doc_ids): spans that occurred before, and the documents that own their chunks."""
    chunks = chunk(docs, min_bytes, max_bytes).repartition("digest")
    place = F.struct("doc_id", "place")
    # all columns are read on both sides, so that one exchange serves them
    owners = chunks.groupBy("digest").agg(F.min(place).alias("own"), F.max(place).alias("last"), F.max("n_bytes").alias("size")).where("own <> last and size > 0").select("digest", "own")
    again = (
        chunks.join(owners.hint("shuffle_hash"), "digest")
        .where(place != F.col("own"))
        .select("doc_id", "place", "n_bytes", F.col("own.doc_id").alias("owner"))
        .distinct()
    )
    order = Window.partitionBy("doc_id", "txt").orderBy("place")
    spans = (
        again.withColumn("txt", F.shiftright("place", 32))
        .withColumn("new", F.coalesce(F.lag(F.col("place") + F.col("n_bytes")).over(order) != F.col("place"), F.lit(True)).cast("int"))
        .withColumn("span", F.sum("new").over(order))
        .groupBy("doc_id", "txt", "span")
        .agg(
            F.min("place").alias("first"),
            F.max(F.col("place") + F.col("n_bytes")).alias("end"),
            F.count("*").cast("int").alias("n_chunks"),
            F.array_sort(F.collect_set("owner")).alias("source_doc_ids"),
        )
    )
    start = F.col("first").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    return spans.where(F.col("end") - F.col("first") >= min_span).select("doc_id", start.alias("byte_start"), (start + (F.col("end") - F.col("first")).cast("int")).alias("byte_end"), "n_chunks", "source_doc_ids")
