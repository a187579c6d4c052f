"""Pre-tokens of the byte-level vocabulary found without a regular expression, over whole Arrow columns.

Characters are classed by a table, and boundaries follow from neighbouring
classes: runs of letters, numbers or other signs, each with one space before it;
runs of white space, whose last character stands apart if text follows; and the
English contractions after an apostrophe that stands alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .arrowtext import text_bytes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, as the regex engine has them."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def boundaries(cp: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: a flag for each code point. heads: where texts start."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    cls = classes()[cp]
    head = np.zeros(n + 3, bool)
    head[heads] = True
    head[n:] = True
    start = head[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    # text after white space: its last character stands apart, and a plain space belongs to what follows
    after = np.flatnonzero(start[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~head[1:n]) + 1
    start[after - 1] = True
    start[after] = cp[after - 1] != 32
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        pad = np.append(cp, np.zeros(3, cp.dtype))
        one, two = np.where(head[quote + 1], 0, pad[quote + 1]), np.where(head[quote + 1] | head[quote + 2], 0, pad[quote + 2])
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(single, 2, np.where(double, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        beyond = quote + size
        start[beyond[beyond < n]] = True
    return start


def pretokens(col: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, starts, ends, first): pre-token k is bytes[starts[k]:ends[k]]; those of text i are first[i]:first[i + 1].

    Null texts have none. Texts that aren't valid UTF-8 raise UnicodeDecodeError.
    """
    b = text_bytes(col)
    raw = b.data.tobytes()
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    at = np.flatnonzero((b.data & 0xC0) != 0x80)  # byte of each code point
    nonempty = b.offs[:-1][b.offs[1:] > b.offs[:-1]]
    starts = at[boundaries(cp, np.searchsorted(at, nonempty))]
    ends = np.append(starts[1:], len(raw)) if len(starts) else starts
    return raw, starts, ends, np.searchsorted(starts, b.offs, "left")
