"""Public tokenizer vocabularies; a file's path is always a parameter and files are read where they lie."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Where the files lie unless a caller names another path.
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The byte-level vocabulary's own pre-token pattern.
DEFAULT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = DEFAULT_PATTERN):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table as a list: token id -> bytes."""
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for b, i in known.items():
        out[i] = b
    return out


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as (lengths, starts, bytes end to end)."""
    table = token_bytes(path)
    size = np.fromiter(map(len, table), np.int64, len(table))
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)
