"""Operator 10. Secret scans by token efficiency.

A byte-pair vocabulary spends few tokens on language and many on random
characters. Each run of at least `min_chars` characters of the key alphabet that
holds letters and digits (or much mixed case) is encoded whole; fewer than
`max_ratio` characters a token exposes it as random. In a run that language
explains as a whole (a path, an address, a key with a worded prefix) the tokens
are scored one by one, and every stretch of at least `min_chars` letters and
digits that takes fewer than `max_ratio` of them a token is exposed, out to the
separators around it. Left alone are known digests and identifiers: hexadecimal
runs, or pieces of such a run, of a digest's length that no credential word
introduces, values listed in `known_sha256`, UUIDs, and what language explains.

One narrow pass; no shuffle. Defined cases: null or empty text has no finding;
null doc_id is carried; a repeated row repeats its findings; columns besides
doc_id and text are neither read nor named by the scan; an empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrowtext import slices
from .vocab import DEFAULT_VOCAB, encoding

MIN_CHARS = 20
MAX_RATIO = 2.2
PLACEHOLDER = "[SECRET]"
FINDINGS = "doc_id bigint, char_start int, n_chars int, n_tokens int, chars_per_token double, context string, value_sha256 string"

_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_CREDENTIAL = re.compile(r"(?i)(token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth(?:orization)?|bearer|credential)s?$")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_KNOWN_PIECE = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")
#: a stretch ends where its score has fallen by so much: a word of eight letters, or two of five
_DROP = 5.5


def _turns(s: str) -> int:
    return sum(a.islower() != b.islower() for a, b in zip(s, s[1:]))


@lru_cache(maxsize=8)
def _run(min_chars: int) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % max(min_chars, 1))


def _lead(text: str, at: int, joined: bool = False) -> re.Match | None:
    """The credential word before `at`: a quotation mark, an operator and any amount of white space may stand between, and separators before a part of a run."""

    def back(i: int, chars: str, most: int) -> int:
        least = max(0, i - most)
        while i > least and (text[i - 1] in chars if chars else text[i - 1].isspace()):
            i -= 1
        return i

    if joined:
        at = back(at, "/_-+", at)
    at = back(back(at, "\"'`", 1), "", at)
    at -= 2 if text[max(0, at - 2) : at] in ("=>", ":=") else text[at - 1 : at] in ("=", ":")
    at = back(back(at, "", at), "\"'", 1)
    return _CREDENTIAL.search(text, max(0, at - 24), at)  # no such word is longer


def random_parts(text: str, start: int, end: int, enc, min_chars: int, max_ratio: float) -> list[tuple[int, int]]:
    """The random stretches, out to the separators around them, of a run that isn't random as a whole."""
    s = text[start:end]
    left_alone = [
        m.span()
        for m in _KNOWN_PIECE.finditer(s)
        if ("-" in m.group() or len(m.group()) in _DIGEST_LENGTHS) and _lead(text, start + m.start(), m.start() > 0) is None
    ]
    # (start, end, score) of each token; separators count for nothing, what is left alone ends a stretch
    tokens, at = [], 0
    for t in enc.encode_ordinary(s):
        b = at + len(enc.decode_single_token_bytes(t))
        alone = any(x <= at and b <= y for x, y in left_alone)
        tokens.append((at, b, -1e9 if alone else max_ratio - (b - at) if s[at].isalnum() else 0.0))
        at = b
    pieces = [m.span() for m in _PIECE.finditer(s)]
    firsts, ends = [p[0] for p in pieces], [p[1] for p in pieces]
    scores = [0.0] * len(pieces)
    for a, _, w in tokens:
        if s[a].isalnum():
            scores[bisect_right(firsts, a) - 1] += w
    out, i = [], 0
    while i < len(tokens):
        if tokens[i][2] <= 0:
            i += 1
            continue
        total, best, last = 0.0, 0.0, i
        for j in range(i, len(tokens)):
            total += tokens[j][2]
            if total > best:
                best, last = total, j
            if total <= 0 or total < best - _DROP:
                break
        a, b = tokens[i][0], tokens[last][1]
        i = last + 1
        # whole pieces; those at the ends that language explains are left out
        p, q = bisect_right(ends, a), bisect_left(firsts, b)
        while q - p > 1 and scores[p] <= 0:
            p += 1
        while q - p > 1 and scores[q - 1] <= 0:
            q -= 1
        if b - a < min_chars and sum(scores[p:q]) <= 0:
            continue
        key = "".join(s[x:y] for x, y in pieces[p:q])
        if len(key) < min_chars or not any(c.isalpha() for c in key) or not (any(c.isdigit() for c in key) or _turns(key) * 4 >= len(key)):
            continue
        a, b = max(firsts[p], out[-1][1] if out else 0), ends[q - 1]
        if a < b:
            out.append((a, b))
    return [(start + a, start + b) for a, b in out]


def find(text: str, enc, min_chars: int, max_ratio: float, known: frozenset[str]) -> list[tuple]:
    """(start, end, tokens, context, sha256) of each secret in one text."""
    out = []
    for m in _run(min_chars).finditer(text):
        s = m.group()
        if len(s) < min_chars:
            continue
        digits = any(c.isdigit() for c in s)
        letters = any(c.isalpha() for c in s)
        turns = _turns(s)
        if not letters or not (digits or turns * 4 >= min_chars):
            continue
        lead = _lead(text, m.start())
        if lead is None and (_UUID.fullmatch(s) or (len(s) in _DIGEST_LENGTHS and _HEX.fullmatch(s))):
            continue
        n = len(enc.encode_ordinary(s))
        if len(s) < max_ratio * n and (digits or turns * 4 >= len(s)):
            parts = [m.span()]
        else:
            parts = random_parts(text, *m.span(), enc, min_chars, max_ratio)
        if not parts or hashlib.sha256(s.encode()).hexdigest() in known:
            continue
        for a, b in parts:
            if a > m.start():
                lead = _lead(text, a, joined=True)
            sha = hashlib.sha256(text[a:b].encode()).hexdigest()
            if sha not in known:
                out.append((a, b, len(enc.encode_ordinary(text[a:b])), lead.group(1).lower() if lead else "", sha))
    return out


def scan_secrets(
    docs: DataFrame,
    vocab: str = DEFAULT_VOCAB,
    min_chars: int = MIN_CHARS,
    max_ratio: float = MAX_RATIO,
    known_sha256: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each secret of docs(doc_id, text)."""
    known = frozenset(known_sha256)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab)
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), _run(min_chars).pattern), False))
            rows = []
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for a, b, n, lead, sha in find(text, enc, min_chars, max_ratio, known):
                        rows.append((doc, a, b - a, n, (b - a) / n, lead, sha))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string())
                names = [x.split()[0] for x in FINDINGS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(scan, FINDINGS)


def redact_secrets(
    docs: DataFrame,
    vocab: str = DEFAULT_VOCAB,
    min_chars: int = MIN_CHARS,
    max_ratio: float = MAX_RATIO,
    known_sha256: tuple[str, ...] = (),
) -> DataFrame:
    """docs with every secret replaced by a placeholder; other columns and all rows stay.

    n_chars, where there is such a column, follows the text of a row that changed.
    """
    known = frozenset(known_sha256)
    names = docs.columns
    at = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocab)
        for batch in batches:
            mask = pc.fill_null(pc.match_substring_regex(batch.column(at), _run(min_chars).pattern), False)
            texts = batch.column(at)
            hit, new = [], []
            for i in pc.indices_nonzero(mask).to_pylist():
                text = texts[i].as_py()
                found = find(text, enc, min_chars, max_ratio, known)
                if found:
                    for a, b, *_ in reversed(found):
                        text = text[:a] + PLACEHOLDER + text[b:]
                    hit.append(i)
                    new.append(text)
            if hit:
                changed = [False] * batch.num_rows
                for i in hit:
                    changed[i] = True
                columns = list(batch.columns)
                columns[at] = pc.replace_with_mask(texts, pa.array(changed), pa.array(new, texts.type))
                if chars is not None:
                    kind = columns[chars].type
                    columns[chars] = pc.replace_with_mask(columns[chars], pa.array(changed), pa.array([len(x) for x in new]).cast(kind))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(redact, docs.schema)
