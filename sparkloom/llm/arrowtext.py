"""Vectorised text handling over Arrow batches, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes handled at once by one Python worker; bounds its memory, not what is processed.
SLICE_BYTES = 1 << 21

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Verbatim words: whatever stands between white space.
VERBATIM = ~_SPACE
#: Plain words: letters and digits; bytes beyond ASCII count as letters.
PLAIN = np.zeros(256, bool)
PLAIN[[c for c in range(128) if chr(c).isalnum()]] = True
PLAIN[128:] = True
#: Words of letters, marks and digits as Unicode has them, so that typographic signs separate too.
UNICODE = None


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for many ranges at once (values: uint64)."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(_BASE, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of `batch` in runs of at most `limit` text bytes; a longer text comes alone and whole."""
    n = batch.num_rows
    if not n:
        return
    offs = offsets(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


def offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


@dataclass
class Bytes:
    data: np.ndarray  # uint8, all texts end to end
    offs: np.ndarray  # int64, n + 1


def text_bytes(col: pa.Array) -> Bytes:
    if not len(col):
        return Bytes(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    if col.null_count:
        col = col.fill_null("")
    offs = offsets(col)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return Bytes(data, offs - offs[0])


@dataclass
class Words:
    data: np.ndarray
    offs: np.ndarray  # text i is data[offs[i]:offs[i + 1]]
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # text of each word
    first: np.ndarray  # words of text i are first[i]:first[i + 1]

    def hashes(self) -> np.ndarray:
        return range_hash(_BYTE[self.data], self.starts, self.ends)


@lru_cache(maxsize=1)
def _in_words() -> np.ndarray:
    """Which code points are letters, marks or numbers."""
    import unicodedata

    return np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), bool, 0x110000)


def _inside_words(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters, marks or numbers of valid UTF-8."""
    inside = PLAIN[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        a, b, c, d = pad[lead], pad[lead + 1] & 63, pad[lead + 2] & 63, pad[lead + 3] & 63
        size = 2 + (a >= 0xE0) + (a >= 0xF0)
        cp = np.select([size == 2, size == 3], [(a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
        ok = _in_words()[np.minimum(cp, 0x10FFFF)]
        for k in range(4):
            own = size > k
            at = lead[own] + k
            inside[at[at < len(data)]] = ok[own][at < len(data)]
    return inside


def words(col: pa.Array, kind: np.ndarray | None) -> Words:
    b = text_bytes(col)
    n = len(b.data)
    inside = _inside_words(b.data) if kind is None else kind[b.data]
    heads = b.offs[:-1][b.offs[:-1] < b.offs[1:]]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[heads] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[b.offs[1:][b.offs[:-1] < b.offs[1:]] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(b.offs, starts, "right") - 1
    return Words(b.data, b.offs, starts, ends, doc, np.searchsorted(starts, b.offs, "left"))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n word hashes; the last n - 1 positions are absent."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return range_hash(h, at, at + n)
