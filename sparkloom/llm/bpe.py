"""Operator 3. Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Encoding: the documents of a block (a run of one task's input, `block_bytes` of
text) are split into pre-tokens, and the block's distinct pre-tokens become its
dictionary, the most frequent first. Exploding gives the block's distinct words, put into buckets by
their hash, and for each document its positions: places in the dictionary, in
order, which is the position list of the exploded form without repeating the
word. Words are shuffled by bucket, each distinct one is encoded once there, its
ids are joined back to every block that has it, and the blocks reassemble their
documents by position.

Decoding joins each id to the token-byte table by position and concatenates.

The texts are split once: words and positions leave in one shuffle, and both
sides read it. Each task first sorts its rows by a hash, so a task that runs
again numbers the words as it did before, whatever order its input comes in.

Shuffled are the blocks' distinct words, their ids and, for each pre-token, the
entropy of its rank, not the texts and not a row a token. A row holds the words
of a block and bucket together, compressed. Nothing is broadcast; the vocabulary is a file of
fixed size read once by each worker, whose path is a parameter.

Defined cases: null text gives null ids, empty text an empty list; a null
doc_id is carried; repeated rows are encoded as often as they come; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrowtext import _BYTE, range_hash, slices
from .pretokens import pretokens
from .vocab import DEFAULT_PATTERN, DEFAULT_VOCAB, byte_table, encoding, token_bytes

BLOCK_BYTES = 24 << 20
ENCODED = "doc_id bigint, token_ids array<int>, n_tokens int, round_trip boolean"
#: A bucket's words: owner is their block. A block's documents: owner is DOCS. The buckets of a block's dictionary: owner is ORDER.
_EXPLODED = "block bigint, owner bigint, data binary"
DOCS, ORDER = -1, -2


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _digest(raw) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def split_column(col: pa.Array, pattern: str, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(references of all pre-tokens into `known`, which grows; how many each text has, -1 for null; digests of the texts)."""
    if pattern == DEFAULT_PATTERN:
        try:
            raw, starts, ends, first = pretokens(col)
        except UnicodeDecodeError:
            return _split_slowly(col, pattern, known)
        data = np.frombuffer(raw, np.uint8)
        _, at, which = np.unique(range_hash(_BYTE[data], starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        # pre-tokens tile the bytes, so each can be held against the one that its hash stands for
        if (size[at][which] == size).all() and (data == data[np.repeat(starts[at][which] - starts, size) + np.arange(len(data))]).all():
            own = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[at].tolist(), ends[at].tolist())), np.uint32, len(at))
            refs = own[which] if len(at) else np.zeros(0, np.uint32)
            bounds = np.append(starts, len(raw))[first].tolist()
            view = memoryview(raw)
            digests = np.fromiter((_digest(view[i:j]) for i, j in zip(bounds, bounds[1:])), np.int64, len(col))
            return refs, np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(first), -1), digests
    return _split_slowly(col, pattern, known)


def _split_slowly(col: pa.Array, pattern: str, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by the regular expression itself: for other patterns, broken text and words whose hashes collide."""
    split = _splitter(pattern)
    texts = col.to_pylist()
    refs = [np.fromiter((known.setdefault(_raw(w), len(known)) for w in split(t or "")), np.uint32) for t in texts]
    counts = [-1 if t is None else len(r) for t, r in zip(texts, refs)]
    return np.concatenate([*refs, np.zeros(0, np.uint32)]), np.array(counts, np.int64), np.array([_digest(_raw(t or "")) for t in texts], np.int64)


def _join(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed piece of bytes."""
    parts = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def _part(data: bytes, kinds: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_PLANES = [np.uint8, np.uint8, np.uint16, np.uint32]
_TWO, _THREE, _FIVE = 192, 248, 255  # first bytes from which one, two or four more follow
_FROM_THREE = _TWO + (_THREE - _TWO) * 256
_FROM_FIVE = _FROM_THREE + (_FIVE - _THREE) * 65536


def _pack(ranks: np.ndarray) -> list[np.ndarray]:
    """Ranks in planes: a byte of each, and one, two or four more of those that are larger."""
    r = ranks.astype(np.int64)
    two, three, five = (r >= _TWO) & (r < _FROM_THREE), (r >= _FROM_THREE) & (r < _FROM_FIVE), r >= _FROM_FIVE
    first = np.select([two, three, five], [_TWO + (r - _TWO) // 256, _THREE + (r - _FROM_THREE) // 65536, _FIVE], r).astype(np.uint8)
    return [first, ((r[two] - _TWO) % 256).astype(np.uint8), ((r[three] - _FROM_THREE) % 65536).astype(np.uint16), (r[five] - _FROM_FIVE).astype(np.uint32)]


def _unpack(planes: list[np.ndarray]) -> np.ndarray:
    r = planes[0].astype(np.int64)
    two, three, five = (r >= _TWO) & (r < _THREE), (r >= _THREE) & (r < _FIVE), r == _FIVE
    r[two] = (r[two] - _TWO) * 256 + planes[1] + _TWO
    r[three] = (r[three] - _THREE) * 65536 + planes[2] + _FROM_THREE
    r[five] = planes[3].astype(np.int64) + _FROM_FIVE
    return r


def _exploded_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["block", "owner", "data"])


def _block_rows(block: int, known: dict[bytes, int], parts: list[list[np.ndarray]], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """The rows of one block: its words by bucket, its documents, and the buckets of its dictionary."""
    times = np.zeros(len(known), np.int64)
    for part in parts:
        times += np.bincount(part[0], minlength=len(known))
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    for refs, *about in parts:
        yield block, DOCS, _join([*about, *_pack(rank[refs])])
    words = list(known)
    words = [words[i] for i in order.tolist()]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
    yield block, ORDER, _join([bucket.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.copy()])
    by = np.argsort(bucket, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(bucket[by]) != 0)) if len(by) else []
    for a, b in zip(heads, [*heads[1:], len(by)]):
        own = [words[i] for i in by[a:b].tolist()]
        yield int(bucket[by[a]]), block, _join([np.array([len(w) for w in own], np.uint32), np.frombuffer(b"".join(own), np.uint8)])


def encode(docs: DataFrame, vocab: str = DEFAULT_VOCAB, pattern: str = DEFAULT_PATTERN, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """ENCODED for docs(doc_id, text): ids of each document and whether decoding them gave its text again.

    buckets: of words; twice the session's shuffle partitions if None.
    """
    n_buckets = buckets or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = n_buckets + (TaskContext.get().partitionId() << 32)
        known: dict[bytes, int] = {}
        parts: list[list[np.ndarray]] = []
        seen = 0

        def close() -> Iterator[pa.RecordBatch]:
            for row in _block_rows(block, known, parts, n_buckets):
                yield _exploded_batch([row])

        for batch in batches:
            for part in slices(batch):
                refs, counts, digests = split_column(part.column(1), pattern, known)
                ids = part.column(0)
                parts.append([refs, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), counts.astype(np.int64), digests])
                seen += part.column(1).nbytes
                if seen >= block_bytes:
                    yield from close()
                    block, known, parts, seen = block + 1, {}, [], 0
        if parts:
            yield from close()

    nothing = to_arrow_schema(StructType.fromDDL(ENCODED))
    kind = np.uint16 if len(token_bytes(vocab)) <= 1 << 16 else np.uint32

    def words_to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(vocab, pattern)._encode_single_piece
        bucket, memo = None, {}
        for batch in batches:
            for b, owner, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if owner < 0:
                    continue
                if b != bucket:  # all blocks' words of a bucket come together, so each distinct one is encoded once
                    bucket, memo = b, {}
                sizes, raw = _part(data, [np.uint32, np.uint8])
                raw, ids = raw.tobytes(), []
                ends = np.cumsum(sizes, dtype=np.int64).tolist()
                for x, y in zip([0, *ends], ends):
                    w = raw[x:y]
                    got = memo.get(w)
                    if got is None:
                        got = memo[w] = one(w)
                    ids.append(got)
                flat = np.fromiter((t for x in ids for t in x), kind)
                yield pa.RecordBatch.from_arrays([pa.array([owner]), pa.array([b]), pa.array([_join([np.array([len(x) for x in ids], np.uint32), flat])], pa.binary())], ["block", "owner", "data"])

    def reassemble(replies: pa.Table, own: pa.Table) -> pa.Table:
        lengths_of, starts_of, flat_bytes = byte_table(vocab)
        order = np.argsort(replies.column("owner").to_numpy(), kind="stable").tolist()
        answers = replies.column("data").to_pylist()
        answers = [_part(answers[i], [np.uint32, kind]) for i in order]
        flat = np.concatenate([np.zeros(0, kind), *(x[1] for x in answers)])
        in_order = np.concatenate([np.zeros(0, np.int64), *(x[0].astype(np.int64) for x in answers)])
        rows = [x for x in zip(own.column("owner").to_pylist(), own.column("data").to_pylist()) if x[0] < 0]
        if not rows:
            return pa.Table.from_batches([], nothing)
        lengths = firsts = in_order
        for owner, data in rows:
            if owner == ORDER:
                bucket = _part(data, [np.uint8])[0].reshape(4, -1).T.copy().view(np.uint32).ravel()
                by = np.argsort(bucket, kind="stable")
                lengths, firsts = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
                lengths[by] = in_order
                firsts[by] = np.cumsum(in_order) - in_order
        out = []
        for owner, data in rows:
            if owner != DOCS:
                continue
            ids, has_id, counts, digests, *planes = _part(data, [np.int64, np.uint8, np.int64, np.int64, *_PLANES])
            refs = _unpack(planes)
            n = lengths[refs]
            tokens = flat[np.repeat(firsts[refs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int32)
            null = counts < 0
            upto = np.concatenate([[0], np.cumsum(np.where(null, 0, counts))])
            offs = np.concatenate([[0], np.cumsum(n)])[upto]  # tokens before each text
            size = lengths_of[tokens]
            back = flat_bytes[np.repeat(starts_of[tokens] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()
            view, ends = memoryview(back), np.concatenate([[0], np.cumsum(size)])[offs].tolist()
            ok = np.fromiter((_digest(view[x:y]) == d for x, y, d in zip(ends, ends[1:], digests.tolist())), bool, len(ids))
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=has_id == 0),
                        pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(tokens), mask=pa.array(null)),
                        pa.array(np.diff(offs).astype(np.int32), mask=null),
                        pa.array(ok, mask=null),
                    ],
                    ["doc_id", "token_ids", "n_tokens", "round_trip"],
                )
            )
        return pa.Table.from_batches(out)

    key = F.xxhash64("doc_id", "text")
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").sortWithinPartitions(key, "doc_id", F.length("text"))
    exploded = rows.mapInArrow(explode, _EXPLODED).repartition("block")
    # a filter would go below the exchange and make two of it: both sides read it whole and leave the other's rows
    coded = exploded.sortWithinPartitions("block").mapInArrow(words_to_ids, _EXPLODED)
    return coded.groupBy("block").cogroup(exploded.groupBy("block")).applyInArrow(reassemble, ENCODED)


def decode(encoded: DataFrame, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, token_ids). Null ids give null text; an unknown id or broken UTF-8 gives U+FFFD."""

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocab)
        n = len(table)
        lost = "�".encode()
        for batch in batches:
            texts = [None if ids is None else b"".join([table[x] if x is not None and 0 <= x < n else lost for x in ids]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as bigint) doc_id", "token_ids").mapInArrow(join_bytes, "doc_id bigint, text string")
