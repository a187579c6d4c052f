"""Operator 8. Benchmark decontamination with training suffix arrays.

The training side is cut into shards (runs of one task's documents,
`shard_bytes` of text each). Over the words of a shard a suffix array is built:
sorted by the first three words, then by rank doubling among ties until all
suffixes differ. Every suffix of every benchmark item is binary-searched in every
shard for its first `min_words` words; each suffix in the interval is extended to
the longest verbatim match. A document with a match is affected and removed. An
item shorter than `min_words` counts when it occurs whole, if it has at least
`least_words`.

Words are runs of letters, marks and digits as Unicode has them, compared in lower
case, so punctuation, typographic signs and white space don't hide a match. Training documents are read once and never
shuffled. The benchmark goes to the executors in blocks of at most
`block_chars`, as many passes as blocks; its size is measured first.

Defined cases: null or empty texts on either side match nothing; null doc_id is
carried and null item_id is carried; repeated rows are reported each; of several
matches of a document with an item the longest is reported, of equal ones the
first in the document, then in the item; other columns are not touched; empty tables give
empty reports and leave documents alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import UNICODE, slices, words

MIN_WORDS = 8
LEAST_WORDS = 5
SHARD_BYTES = 4 << 20
BLOCK_CHARS = 16 << 20
LEAKS = "doc_id bigint, item_id bigint, n_words int, doc_word int, item_word int"


class SuffixArray:
    """Suffixes of texts of word ids 1.. with a 0 after each text; zeros differ from one another."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.ids = ids
        pad = np.concatenate([ids, np.zeros(3, np.int64)])
        v = int(ids.max(initial=0)) + 1
        first = pad[:n] * v + pad[1 : n + 1]
        # nothing beyond a text's end takes part in the order of its suffixes
        first = first * v + np.where(pad[1 : n + 1] == 0, 0, pad[2 : n + 2])
        self.order = order = np.argsort(first, kind="stable")
        key = first[order]
        head = np.ones(n, bool)
        head[1:] = key[1:] != key[:-1]
        head[ids[order] == 0] = True
        rank = np.zeros(n + 1, np.int64)  # 0 beyond the end
        width = 3
        slots = np.arange(n)
        while True:
            starts = slots[head]
            sizes = np.diff(np.append(np.flatnonzero(head), len(slots)))
            rank[order[slots]] = np.repeat(starts, sizes) + 1
            many = np.repeat(sizes > 1, sizes)
            slots = slots[many]
            if not len(slots):
                break
            pos = order[slots]
            key = rank[pos] * (n + 2) + rank[np.minimum(pos + width, n)]
            by = np.argsort(key, kind="stable")
            order[slots] = pos[by]
            key = key[by]
            head = np.ones(len(slots), bool)
            head[1:] = key[1:] != key[:-1]
            width *= 2
            if width > 2 * n:
                break

    def interval(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the suffixes that begin with each row of queries (n, words)."""
        n, k = len(self.order), queries.shape[1]
        pad = np.concatenate([self.ids, np.zeros(k, np.int64)])

        def bound(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                at = self.order[np.minimum(mid, n - 1)]
                sign = np.zeros(len(queries), np.int64)
                for j in range(k):
                    sign = np.where(sign == 0, np.sign(pad[at + j] - queries[:, j]), sign)
                right = (sign <= 0) if after else (sign < 0)
                lo = np.where(open_ & right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            return lo

        return bound(False), bound(True)


def longest_matches(w_first: np.ndarray, h: np.ndarray, item_hashes: np.ndarray, item_first: np.ndarray, min_words: int, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words, word of text, word of item) over one shard; the longest of each text and item.

    Item i has the words item_hashes[item_first[i]:item_first[i + 1]].
    """
    n_docs = len(w_first) - 1
    known, inverse = np.unique(h, return_inverse=True)
    if not len(known) or not len(item_hashes):
        return []
    at = np.minimum(np.searchsorted(known, item_hashes), len(known) - 1)
    coded = np.where(known[at] == item_hashes, at + 1, -1)
    size = np.diff(item_first)
    item = np.repeat(np.arange(len(size)), size)
    need = np.where(size >= min_words, min_words, np.where(size >= least_words, size, 0))[item]
    place = np.arange(len(coded)) - item_first[item]
    strange = np.concatenate([[0], np.cumsum(coded < 0)])  # words that the shard doesn't have
    starts = np.flatnonzero((need > 0) & (place + need <= size[item]))
    starts = starts[strange[starts + need[starts]] == strange[starts]]
    if not len(starts):
        return []
    doc = np.repeat(np.arange(n_docs), np.diff(w_first))
    ids = np.zeros(len(h) + n_docs, np.int64)
    ids[np.arange(len(h)) + doc] = inverse + 1
    begins = w_first[:-1] + np.arange(n_docs)
    sa = SuffixArray(ids)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in np.unique(need[starts]).tolist():
        own = starts[need[starts] == k]
        low, high = sa.interval(coded[own[:, None] + np.arange(k)])
        for s, a, b in zip(own[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist()):
            i, j = int(item[s]), int(place[s])
            at = sa.order[a:b]
            rest = coded[s : item_first[i + 1]]
            n = np.full(b - a, k)
            live = np.arange(b - a)
            for x in range(k, len(rest)):
                live = live[ids[np.minimum(at[live] + x, len(ids) - 1)] == rest[x]]
                live = live[at[live] + x < len(ids)]
                if rest[x] < 0 or not len(live):
                    break
                n[live] += 1
            texts = np.searchsorted(begins, at, "right") - 1
            for t, m, p in zip(texts.tolist(), n.tolist(), (at - begins[texts]).tolist()):
                x = (-m, p, j)
                if (t, i) not in best or x < best[t, i]:
                    best[t, i] = x
    return [(t, i, -m, p, j) for (t, i), (m, p, j) in sorted(best.items())]


def _item_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all items, and where each item's begin."""
    w = words(pc.utf8_lower(pa.array(texts, pa.string())), UNICODE)
    return w.hashes(), w.first


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[int | None, str]]]:
    """The items in blocks that fit; only one block's rows are sent at a time."""
    items = benchmark.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = total // block_chars + 1
    if n == 1:
        yield [(r[0], r[1]) for r in items.collect()] if total else []
    else:
        for k in range(n):
            yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()]


def _shards(batches: Iterator[pa.RecordBatch], at: int, shard_bytes: int) -> Iterator[pa.Table]:
    kept, size = [], 0
    for batch in batches:
        for part in slices(batch, batch.schema.names[at], shard_bytes // 4):
            kept.append(part)
            size += part.column(at).nbytes
            if size >= shard_bytes:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _matches(text: pa.ChunkedArray, items: tuple[np.ndarray, np.ndarray], min_words: int, least_words: int) -> list[tuple[int, int, int, int, int]]:
    w = words(pc.utf8_lower(text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text), UNICODE)
    return longest_matches(w.first, w.hashes(), *items, min_words, least_words)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS, shard_bytes: int = SHARD_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """LEAKS: for each affected document and item the longest verbatim match and its place."""
    src = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")

    def one(block: list[tuple[int | None, str]]) -> DataFrame:
        item_ids, hashes = [x[0] for x in block], _item_hashes([x[1] for x in block])

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, 1, shard_bytes):
                found = _matches(shard.column(1), hashes, min_words, least_words)
                if found:
                    t, i, n, p, j = zip(*found)
                    ids = shard.column(0).combine_chunks().take(pa.array(t))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([item_ids[x] for x in i], pa.int64()), *(pa.array(x, pa.int32()) for x in (n, p, j))], [x.split()[0] for x in LEAKS.split(", ")])

        return src.mapInArrow(rows, LEAKS)

    return reduce(DataFrame.union, map(one, _blocks(benchmark, block_chars)))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, least_words: int = LEAST_WORDS, shard_bytes: int = SHARD_BYTES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the affected ones; columns and other rows stay as they are."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, block_chars):
        hashes = _item_hashes([x[1] for x in block])

        def keep(batches: Iterator[pa.RecordBatch], hashes=hashes) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, at, shard_bytes):
                ok = np.ones(shard.num_rows, bool)
                ok[[x[0] for x in _matches(shard.column(at), hashes, min_words, least_words)]] = False
                yield from shard.filter(pa.array(ok)).to_batches()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
