"""Operator 4. Quality by Bradley-Terry ranking of preference pairs.

Training: of at most `max_labelled` labelled documents (the least by hash of
doc_id) each good one is preferred to bad ones in `n_pairs` drawn pairs, and
P(a over b) = logistic(w . (x_a - x_b)) is fitted by Newton steps on the ridge-
penalised logistic loss of feature differences. The score w . x of every
document is then one narrow pass. Documents below a quantile of all scores go (by
percentile_approx with accuracy 10,000: the level may be off by 0.0001); the level of that quantile is the share of bad labels in the sample unless given.

Defined cases: a text without words (null, empty, blank) has no score and is not
kept; a null doc_id is scored like any; repeated rows are scored each time, but teach once; a
score equal to the threshold stays; conflicting labels count as bad; without
labels of both kinds all weights are 0, all scores tie, and all with words stay;
other columns pass untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.runtime import cut

from .arrowtext import PLAIN, slices, words

MAX_LABELLED = 6_000
N_PAIRS = 20_000
SCORED = "doc_id bigint, score double"

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 letter, 2 capital, 3 digit, 4 space, 5 stop, 6 symbol
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _c >= 128 or _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch.isspace() else 5 if _ch in ".,;:!?'\"-()" else 6 if 32 < _c < 127 else 0
FEATURES = ("log_words", "word_bytes", "short_words", "long_words", "distinct", "repeated", "symbols", "stops", "digits", "capitals", "line_words")


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, features) of a column of texts, and which have words at all."""
    w = words(col, PLAIN)
    n = len(w.offs) - 1
    count = np.diff(w.first).astype(float)
    safe = np.maximum(count, 1)
    size = np.maximum(np.diff(w.offs), 1).astype(float)
    length = (w.ends - w.starts).astype(float)
    by_doc = lambda x: np.bincount(w.doc, weights=x, minlength=n) / safe
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((h, w.doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    distinct = np.bincount(w.doc[order][fresh], minlength=n) / safe
    kinds = _CLASS[w.data]
    doc_of = np.repeat(np.arange(n), np.diff(w.offs))
    table = np.bincount(doc_of * 7 + kinds, minlength=7 * n).reshape(n, 7)
    lines = np.bincount(doc_of[w.data == 10], minlength=n) + 1.0
    x = np.column_stack([
        np.log1p(count), by_doc(length), by_doc(length <= 3), by_doc(length >= 12), distinct * np.log1p(count), by_doc(again),
        table[:, 6] / size, table[:, 5] / safe, table[:, 3] / size, table[:, 2] / safe, np.log1p(count / lines),
    ])
    return x, count > 0


@dataclass(frozen=True)
class Ranking:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bad_share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ np.array(self.weights)


def fit_pairs(x: np.ndarray, good: np.ndarray, n_pairs: int = N_PAIRS, ridge: float = 1e-2, seed: int = 7) -> Ranking:
    """Bradley-Terry weights from pairs of a good and a bad row of x."""
    k = x.shape[1]
    share = float(1 - good.mean()) if len(good) else 0.0
    if not len(good) or good.all() or not good.any():
        return Ranking((0.0,) * k, (1.0,) * k, (0.0,) * k, 0.0)
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(np.flatnonzero(good), n_pairs)] - z[rng.choice(np.flatnonzero(~good), n_pairs)]
    w = np.zeros(k)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (1 - p) / n_pairs - ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n_pairs + ridge * np.eye(k)
        step = np.linalg.solve(curve, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Ranking(tuple(mean), tuple(scale), tuple(w), share)


def learn_ranking(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, n_pairs: int = N_PAIRS) -> Ranking:
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    k = len(FEATURES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, has = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(has), part.column(2)], ["quality", "x", "has", "doc_id"])

    # a doc_id counts once, however often it comes, so at most max_labelled rows go to the driver
    got = (
        docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
        .join(F.broadcast(sample), "doc_id")
        .select(F.col("quality").cast("int"), "text", "doc_id")
        .mapInArrow(rows, "quality int, x array<double>, has boolean, doc_id bigint")
        .where("has")
        .groupBy("doc_id")
        .agg(F.min(F.struct("quality", "x")).alias("r"))
        .select("r.*")
        .collect()
    )
    got.sort(key=lambda r: (r["quality"], r["x"]))
    x = np.array([r["x"] for r in got]).reshape(-1, k)
    return fit_pairs(x, np.array([r["quality"] > 0 for r in got], bool), n_pairs)


def score_quality(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """(doc_id, score) of every document; no score where there are no words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, has = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(ranking.score(x), 9), mask=~has)], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(rows, SCORED)


def keep_quality(docs: DataFrame, labels: DataFrame, drop: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, threshold) of the documents that stay."""
    ranking = learn_ranking(docs, labels, max_labelled)
    scored = cut(score_quality(docs, ranking))
    level = ranking.bad_share if drop is None else drop
    least = scored.agg(F.percentile_approx("score", level, 10_000).alias("threshold"))
    return scored.crossJoin(F.broadcast(least)).where("score >= threshold")  # one row
