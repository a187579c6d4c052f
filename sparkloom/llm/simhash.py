"""Operator 9. SimHash near-duplicates by the generalised pigeonhole principle.

Every document gets a 256-bit SimHash of its distinct lower-case words, weighted
by length and by the logarithm of their count. Two documents are near copies if
their first 64 bits differ in at most `probe_bits` places and all 256 in at most
`verify_bits`.

Probing is exact for the first condition: the 64 bits are put into partitions,
correlated bits together, and partition i gets a threshold t_i of its own such
that sum(t_i) = probe_bits - partitions + 1; any pair within probe_bits is then
within t_i in some partition i. The thresholds, and the number of partitions, are
those of least estimated cost, found by dynamic programming over estimated
candidate counts; the estimates come from the bit frequencies of all
fingerprints. A partition with threshold t posts each value once for every choice
of t bits left out, so two values within t meet under some choice. Fingerprints
that meet are verified by vectorised popcounts. Within a large bucket only pairs
not yet connected are compared, so groups of copies cost little more than their
number, and no partner is left out: the groups are exactly the connected
components of all pairs. A bucket of more than `hot_rows` is cut into blocks for
as many tasks; when the components so far are known, its rows outside the bucket's
largest component are held against every block, so nothing between blocks is lost.

Equal fingerprints are collapsed before probing. Components are found by
contraction rounds on checkpointed edges.

Defined cases: a text without words (null, empty, punctuation) is near no other;
null doc_id takes no part and stays; rows that repeat a doc_id and text are one
document, of which one row stays; a doc_id with several texts is as many
documents, each with groups of its own, and rows are dropped, not ids; of a group
the least doc_id stays (of several texts of that, the least by hash); other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import cut

from .arrowtext import PLAIN, mix, slices, words
from .components import connected_components

PROBE_BITS = 10
VERIFY_BITS = 40
#: Rows of a bucket that one task takes at once; larger ones are cut into blocks.
HOT_ROWS = 1 << 15
#: Estimated seconds of posting one key and of verifying one pair.
COST_KEY, COST_PAIR = 4e-6, 3e-9
_F = ("f0", "f1", "f2", "f3")
_BITS = "f0 bigint, f1 bigint, f2 bigint, f3 bigint"
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in (1, 2, 3, 4)]


def fingerprint_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) uint64 fingerprints, and which texts have words."""
    w = words(pc.utf8_lower(col), PLAIN)
    n = len(w.offs) - 1
    h = w.hashes()
    order = np.lexsort((h, w.doc))
    h, doc, size = h[order], w.doc[order], (w.ends - w.starts)[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    weight = np.rint(4 * (1 + np.log(times)) * (np.minimum(size[at], 8) - 0.5)).astype(np.float32)
    first = np.searchsorted(doc, np.arange(n + 1))
    out = np.zeros((n, 4), np.uint64)
    for k, salt in enumerate(_SALTS):
        bits = np.unpackbits(mix(h + salt).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in np.flatnonzero(first[1:] > first[:-1]):
            a, b = first[i], first[i + 1]
            ww = weight[a:b]
            # whole numbers below 2**24: the sums are exact in any order
            one = ww @ bits[a:b].astype(np.float32)
            out[i, k] = np.packbits(one * 2 > ww.sum(dtype=np.float64), bitorder="little").view("<u8")[0]
    return out, first[1:] > first[:-1]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, txt, f0, f1, f2, f3) of the documents that have words; txt is a digest of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                f, has = fingerprint_column(part.column(2))
                f = f[has].view(np.int64)
                ids = part.filter(pa.array(has)).columns[:2]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.ascontiguousarray(f[:, k])) for k in range(4))], ["doc_id", "txt", *_F])

    usable = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("doc_id is not null and text is not null")
    return usable.select("doc_id", F.xxhash64("text").alias("txt"), "text").mapInArrow(rows, f"doc_id bigint, txt bigint, {_BITS}")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of bits set together) over all first words of the fingerprints."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        n = 0
        for batch in batches:
            f = np.ascontiguousarray(batch.column(0).to_numpy())
            x = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(f)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"])

    cells = dict(prints.select("f0").mapInArrow(rows, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect())  # 4,097 numbers
    return cells.get(4096, 0), np.array([cells.get(k, 0) for k in range(4096)], float).reshape(64, 64)


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m partitions of nearly equal width, each grown by the bits most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        group = [min(free)]
        free.discard(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (round(float(tie[b, group].sum()), 9), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def near_law(p: np.ndarray, bits: list[int]) -> np.ndarray:
    """Chance that two fingerprints differ in d of these bits, for each d."""
    law = np.ones(1)
    for b in bits:
        x = 2 * p[b] * (1 - p[b])
        law = np.append(law * (1 - x), 0) + np.append(0, law * x)
    return law


def allocate(n: int, together: np.ndarray, probe_bits: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, of least estimated cost."""
    p = np.diag(together) / max(n, 1)
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, min(probe_bits + 1, 16) + 1):
        parts = group_bits(n, together, m)
        costs = []
        for bits in parts:
            law, w = near_law(p, bits), len(bits)
            row = [0.0]  # threshold -1: not probed
            for t in range(min(w - 1, 5) + 1):
                meets = sum(law[d] * comb(w - d, t - d) for d in range(t + 1))
                row.append(n * comb(w, t) * COST_KEY + n * n / 2 * meets * COST_PAIR)
            costs.append(row)
        need = probe_bits - m + 1 + m  # thresholds counted from -1
        table = {0: (0.0, ())}
        for row in costs:
            step: dict[int, tuple[float, tuple]] = {}
            for used, (cost, taken) in table.items():
                for t, c in enumerate(row):
                    to = min(used + t, need)
                    if to not in step or cost + c < step[to][0]:
                        step[to] = cost + c, (*taken, t - 1)
            table = step
        if need in table and table[need][0] < best[0]:
            best = table[need][0], [(b, t) for b, t in zip(parts, table[need][1]) if t >= 0]
    return best[1]


def _keys(f0: np.ndarray, plan: list[tuple[list[int], int]]) -> list[np.ndarray]:
    out = []
    for i, (bits, t) in enumerate(plan):
        mask = np.uint64(sum(1 << b for b in bits))
        for j, left_out in enumerate(combinations(bits, t)):
            hole = np.uint64(sum(1 << b for b in left_out))
            out.append(mix((f0 & mask & ~hole) + np.uint64(((i << 40) + j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))))
    return out


def _within(a: np.ndarray, b: np.ndarray, probe: int, verify: int) -> np.ndarray:
    """Which rows of a are near the same rows of b (or the one row b)."""
    ok = np.flatnonzero(np.bitwise_count(a[:, 0] ^ b[..., 0]) <= probe)
    if len(ok):
        rest = b[ok] if b.ndim == 2 else b
        ok = ok[np.bitwise_count(a[ok] ^ rest).sum(axis=1) <= verify]
    return ok


def link_bucket(ids: np.ndarray, f: np.ndarray, probe: int, verify: int) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs of one bucket."""
    out = []
    left = np.arange(len(ids))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _within(f[left], f[x], probe, verify)
            if len(near):
                new = left[near]
                queue.extend(new.tolist())
                out.extend((ids[x], ids[y]) for y in new)
                left = np.delete(left, near)
    return out


def bucket_links(batches: Iterator[pa.RecordBatch], probe_bits: int, verify_bits: int) -> Iterator[pa.RecordBatch]:
    """(a, b) links of rows (key, node, f0..f3) sorted by key; only rows of one key are compared."""

    def work(key: np.ndarray, ids: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(heads, len(key)))
        found_a, found_b = [], []
        for h, s in zip(heads[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
            for x, y in link_bucket(ids[h : h + s], f[h : h + s], probe_bits, verify_bits):
                found_a.append([x])
                found_b.append([y])
        end = np.repeat(heads + sizes, sizes)
        rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 64), sizes))
        for k in range(1, 64):
            rows = rows[rows + k < end[rows]]
            if not len(rows):
                break
            ok = rows[_within(f[rows], f[rows + k], probe_bits, verify_bits)]
            found_a.append(ids[ok])
            found_b.append(ids[ok + k])
        if found_a:
            pairs = np.unique(np.column_stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], ["a", "b"])

    kept: list[np.ndarray] = []  # rows of six numbers
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(np.column_stack([c.to_numpy() for c in batch.columns]))
        rows += batch.num_rows
        if rows < 100_000:
            continue
        x = np.concatenate(kept)
        last = int(np.searchsorted(x[:, 0], x[-1, 0]))  # the last bucket may go on
        if last:
            yield from work(x[:last, 0], x[:last, 1], np.ascontiguousarray(x[:last, 2:]).view(np.uint64))
        kept, rows = [x[last:].copy()], 0
    if kept:
        x = np.concatenate(kept)
        yield from work(x[:, 0], x[:, 1], np.ascontiguousarray(x[:, 2:]).view(np.uint64))


def block_links(batches: Iterator[pa.RecordBatch], probe_bits: int, verify_bits: int) -> Iterator[pa.RecordBatch]:
    """(a, b) links of rows (key, node, f0..f3, component, block, side), sorted by key, block and side: those of side 1 are held against those of side 0."""
    now, held, x = None, [], None
    for batch in batches:
        every = np.column_stack([c.to_numpy() for c in batch.columns])
        edges = np.append(np.flatnonzero(np.append(True, (every[1:, [0, 7, 8]] != every[:-1, [0, 7, 8]]).any(axis=1))), len(every)) if len(every) else []
        for i, j in zip(edges[:-1], edges[1:]):
            run = every[i:j]
            if now != (run[0, 0], run[0, 7]):
                now, held, x = (run[0, 0], run[0, 7]), [], None
            if run[0, 8] == 0:
                held.append(run)
                continue
            if not held:
                continue
            if x is None:
                x = np.concatenate(held)
                f = np.ascontiguousarray(x[:, 2:6]).view(np.uint64)
            own = np.ascontiguousarray(run[:, 2:6]).view(np.uint64)
            found = []
            for k in range(len(run)):
                near = _within(f, own[k], probe_bits, verify_bits)
                near = near[x[near, 6] != run[k, 6]]
                if len(near):  # one link to each component is enough
                    near = near[np.unique(x[near, 6], return_index=True)[1]]
                    found.append(np.column_stack([np.full(len(near), run[k, 1]), x[near, 1]]))
            if found:
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])


def near_edges(prints: DataFrame, plan: list[tuple[list[int], int]], probe_bits: int, verify_bits: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b) links of nodes whose components are those of all near pairs of prints(node, f0..f3), all fingerprints distinct."""
    links = "a bigint, b bigint"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                f0 = np.ascontiguousarray(part.column(1).to_numpy()).view(np.uint64)
                for key in _keys(f0, plan):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *part.columns], ["key", "node", *_F])

    def linked(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by).select("key", "node", *_F).mapInArrow(lambda batches: bucket_links(batches, probe_bits, verify_bits), links)

    posted = prints.select("node", *_F).mapInArrow(post, f"key bigint, node bigint, {_BITS}")
    hot = cut(posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("key", F.ceil(F.col("n") / hot_rows).alias("blocks")))
    if not hot.limit(1).count():
        return linked(posted, "key")
    # the key of a block is its own, so that rows of other blocks aren't taken for its bucket
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = cut(posted.join(hot, "key").withColumn("block", block))
    first = cut(linked(posted.join(hot, "key", "left_anti"), "key").union(linked(rows.withColumn("key", F.xxhash64("key", "block")), "key")))
    parts = connected_components(first).withColumnRenamed("component", "c")
    rows = cut(rows.join(parts, "node", "left").withColumn("component", F.coalesce("c", "node")).drop("c"))
    largest = rows.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("k")).where("k > 1")
    rows = rows.join(cut(largest.select("key", F.col("m.component").alias("main"))), "key")
    columns = ["key", "node", *_F, "component", "block", "side"]
    data = rows.withColumn("side", F.lit(0)).select(*columns)
    asks = rows.where("component <> main").drop("block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).withColumn("side", F.lit(1)).select(*columns)
    cross = data.union(asks).repartition("key", "block").sortWithinPartitions("key", "block", "side").mapInArrow(lambda batches: block_links(batches, probe_bits, verify_bits), links)
    return first.union(cross)


def _members(docs: DataFrame, probe_bits: int, verify_bits: int, hot_rows: int) -> DataFrame:
    """(doc_id, txt, kept) of every document in a group of at least two; kept is the (doc_id, txt) that stays."""
    prints = cut(fingerprints(docs).distinct())
    # the numbers are written down, so they stay what they are
    reps = cut(prints.groupBy(*_F).agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), *_F))
    n, together = bit_counts(reps)
    plan = allocate(n, together, probe_bits)
    links = near_edges(reps, plan, probe_bits, verify_bits, hot_rows) if n else reps.selectExpr("node a", "node b").limit(0)
    grouped = prints.join(reps, list(_F)).select("doc_id", "txt", "node").join(connected_components(links), "node", "left").select("doc_id", "txt", F.coalesce("component", "node").alias("component"))
    kept = cut(grouped.groupBy("component").agg(F.min(F.struct("doc_id", "txt")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("component", "kept"))
    return grouped.join(kept, "component").select("doc_id", "txt", "kept")


def near_groups(docs: DataFrame, probe_bits: int = PROBE_BITS, verify_bits: int = VERIFY_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, kept_doc_id) of every document in a group of at least two; the least doc_id of the group is kept."""
    return _members(docs, probe_bits, verify_bits, hot_rows).select("doc_id", F.col("kept.doc_id").alias("kept_doc_id"))


def keep_one(docs: DataFrame, probe_bits: int = PROBE_BITS, verify_bits: int = VERIFY_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with one document of each group; columns stay as they are."""
    gone = _members(docs, probe_bits, verify_bits, hot_rows).where("doc_id <> kept.doc_id or txt <> kept.txt").select(F.col("doc_id").alias("_gone_id"), F.col("txt").alias("_gone_txt"))
    kept = docs.join(gone.hint("shuffle_hash"), (docs["doc_id"].cast("bigint") == F.col("_gone_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_gone_txt")), "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        mark = "_row_of_document"
        once = Window.partitionBy("doc_id", "text").orderBy("doc_id")
        kept = kept.withColumn(mark, F.when(F.col("doc_id").isNull(), 1).otherwise(F.row_number().over(once))).where(F.col(mark) == 1).drop(mark)
    return kept
