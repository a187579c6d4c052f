"""Operator 5. Approximate nearest neighbours with a permutation index.

A vector is represented by the order of its `prefix` nearest pivots. Each shard
of the table posts its vectors in an inverted file of (pivot; vector, place). A
query walks the lists of its own pivots and adds up the footrule distance
between its order and those it meets (a pivot missing on one side counts as
standing at place `prefix`). Vectors whose footrule distance is within a bound
are candidates and are reranked by exact cosine.

The bound is calibrated, not guessed: for `n_probe` queries (the next by hash of
vec_id after the pivots, which are untypically near to their own order; pivots
only where other rows don't suffice) the true neighbours are found by brute force
over the whole table, and the bound is the footrule distance within which the
share `target` of them lies. A query that meets fewer than k in a shard takes
those of the k least footrules there. No number of candidates is capped. All rows
are indexed; queries are the rows whose vec_id `ask_every` divides, and each asks
every shard, so the index keeps its recall on vectors that don't cluster; there
the bound admits most rows, up to all of them (then no lists are walked), and the
cost is that of brute force, queries times rows.

Defined cases: null, empty, non-finite or zero vectors and vectors of another length than most have no
neighbours and are none; rows with a null vec_id are left out; of rows that
repeat a vec_id the least vector counts; equal similarities are ordered by vec_id; a table of
n vectors gives min(k, n - 1) neighbours for each;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.runtime import cut

K = 10
PIVOTS, PREFIX = 256, 16
N_PROBE = 200
TARGET = 0.97
SHARD_ROWS = 8192
_NEAR = "vec_id bigint, neighbor_id bigint, similarity double"


def permutation(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(n, prefix) the nearest pivots of each row, nearest first."""
    far = -(x @ pivots.T)
    some = np.argpartition(far, min(prefix, far.shape[1]) - 1, axis=1)[:, :prefix] if prefix < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(x), 1))
    by = np.lexsort((some, np.take_along_axis(far, some, 1)), axis=1) if len(x) else some
    return np.take_along_axis(some, by, 1).astype(np.int32)


class InvertedFiles:
    """Lists by pivot of the vectors of one shard with the place the pivot has for them."""

    def __init__(self, perms: np.ndarray, n_pivots: int):
        n, self.prefix = perms.shape
        flat = perms.ravel()
        order = np.argsort(flat, kind="stable")
        self.first = np.searchsorted(flat[order], np.arange(n_pivots + 1))
        self.vector = (order // self.prefix).astype(np.int32)
        self.place = (order % self.prefix).astype(np.int16)
        self.n = n

    def footrule(self, perm: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector of the shard to a query's order."""
        # start as if nothing were shared: both sides' pivots are moved to the end
        out = np.full(self.n, self.prefix * (self.prefix + 1), np.int16)
        for at, pivot in enumerate(perm.tolist()):
            a, b = self.first[pivot], self.first[pivot + 1]
            place = self.place[a:b]
            out[self.vector[a:b]] += np.abs(place - np.int16(at)) - (np.int16(2 * self.prefix - at) - place)
        return out


def _unit(df: DataFrame) -> DataFrame:
    """(vec_id, v) with usable vectors of unit length, one row a vec_id."""
    x = df.selectExpr("cast(vec_id as bigint) vec_id", "transform(embedding, e -> cast(e as double)) v").where("vec_id is not null and size(v) > 0")
    x = x.where("not exists(v, e -> e is null or isnan(e) or abs(e) = double('infinity'))")
    x = x.withColumn("norm", F.expr("sqrt(aggregate(v, 0d, (s, e) -> s + e * e))")).where("norm > 0")
    x = x.groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("x")).select("vec_id", F.expr("transform(x.v, e -> float(e / x.norm))").alias("v"))
    return x


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def nearest(df: DataFrame, k: int = K, n_pivots: int = PIVOTS, prefix: int = PREFIX, n_probe: int = N_PROBE, target: float = TARGET, shard_rows: int = SHARD_ROWS, ask_every: int = 1) -> DataFrame:
    """(vec_id, neighbor_id, similarity, rank) of the k nearest others, among all vectors, of each whose vec_id `ask_every` divides."""
    spark = df.sparkSession
    unit = cut(_unit(df))
    sizes = unit.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], _NEAR + ", rank int")
    dim, n = sizes["d"], sizes["count"]
    unit = unit.where(F.size("v") == dim)
    hashed = unit.orderBy(F.xxhash64("vec_id"), "vec_id")
    first = hashed.limit(n_pivots + n_probe).collect()  # n_pivots + n_probe vectors
    pivots = np.array([r["v"] for r in first[:n_pivots]], np.float32)
    probe = (first[n_pivots:] + first[:n_pivots])[:n_probe]
    prefix = min(prefix, len(pivots))
    pid, pv = np.array([r["vec_id"] for r in probe]), np.array([r["v"] for r in probe], np.float32)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each batch for each probe, with their footrule distances."""
        mine = permutation(pv, pivots, prefix)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            inv = InvertedFiles(permutation(x, pivots, prefix), len(pivots))
            s = pv @ x.T
            s[pid[:, None] == ids[None, :]] = -9
            top = np.argpartition(-s, min(k, len(ids)) - 1, axis=1)[:, :k]
            foot = np.array([inv.footrule(p)[t] for p, t in zip(mine, top)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(pid, top.shape[1])), pa.array(np.take_along_axis(s, top, 1).ravel().astype(np.float64)), pa.array(foot.ravel().astype(np.int32))],
                ["vec_id", "similarity", "footrule"],
            )

    best = Window.partitionBy("vec_id").orderBy(F.desc("similarity"))
    true = unit.mapInArrow(exact, "vec_id bigint, similarity double, footrule int").where("similarity > -2")
    bound = true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).agg(F.expr(f"percentile(footrule, {float(target)}d)").alias("b")).first()["b"]
    bound = int(np.ceil(bound)) if bound is not None else 0

    every = bound >= prefix * (prefix + 1)  # as far as orders can be from one another
    n_shards = max(1, -(-n // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")
    data = unit.select("vec_id", "v", shard.alias("shard"), F.lit(0).alias("side"))
    asks = unit.where(F.col("vec_id") % ask_every == 0).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).alias("side"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, inv, ids, x = None, [], None, None, None
        for batch in batches:
            shards, sides = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, (np.diff(shards) != 0) | (np.diff(sides) != 0))), len(shards)) if len(shards) else []
            for a, b in zip(edges[:-1], edges[1:]):
                run = batch.slice(int(a), int(b - a))
                if shards[a] != now:
                    now, held, inv, ids, x = shards[a], [], None, None, None
                if sides[a] == 0:
                    held.append(run)
                    continue
                if not held:
                    continue
                if ids is None:
                    ids = np.concatenate([h.column(0).to_numpy() for h in held])
                    x = np.concatenate([_matrix(h.column(1), dim) for h in held])
                    inv = None if every else InvertedFiles(permutation(x, pivots, prefix), len(pivots))
                qid, q = run.column(0).to_numpy(), _matrix(run.column(1), dim)
                perms = None if every else permutation(q, pivots, prefix)
                out = []
                for i in range(len(qid)):
                    if every:
                        cand = np.flatnonzero(ids != qid[i])
                    else:
                        foot = inv.footrule(perms[i])
                        cand = np.flatnonzero((foot <= bound) & (ids != qid[i]))
                        if len(cand) < k:
                            others = np.flatnonzero(ids != qid[i])
                            near = foot[others]
                            cand = others[near <= np.partition(near, k - 1)[k - 1]] if len(others) > k else others
                    if not len(cand):
                        continue
                    s = (x @ q[i])[cand] if len(cand) * 4 > len(ids) else x[cand] @ q[i]
                    if len(cand) > k:
                        some = np.argpartition(-s, k - 1)
                        least = s[some[k - 1]]
                        some = np.flatnonzero(s >= least)  # ties of the last one too
                        cand, s = cand[some], s[some]
                    out.append((np.full(len(cand), qid[i]), ids[cand], s))
                if out:
                    c = [np.concatenate(t) for t in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2].astype(np.float64))], ["vec_id", "neighbor_id", "similarity"])

    met = data.union(asks).repartition(n_shards, "shard").sortWithinPartitions("shard", "side").mapInArrow(search, _NEAR)
    order = Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbor_id")
    return met.withColumn("similarity", F.round("similarity", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
