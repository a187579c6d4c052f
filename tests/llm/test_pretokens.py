from __future__ import annotations

import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.bpe import split_column
from sparkloom.llm.pretokens import pretokens
from sparkloom.llm.vocab import DEFAULT_PATTERN

_split = regex.compile(DEFAULT_PATTERN).findall
_TEXT = st.text(alphabet=st.sampled_from(list("ab'strevlmd\n\t 12.,!é　中😀٣́\r")) | st.characters(exclude_categories=["Cs"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | _TEXT, max_size=6))
def test_same_as_the_regular_expression(texts):
    raw, starts, ends, first = pretokens(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert [raw[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] == _split(t or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | _TEXT, max_size=6))
def test_references_name_the_pretokens(texts):
    known: dict[bytes, int] = {b"earlier": 0}
    refs, raws = split_column(pa.array(texts, pa.string()), DEFAULT_PATTERN, known)
    words = list(known)
    for t, r, raw in zip(texts, refs, raws):
        assert (r is None) == (t is None) == (raw is None)
        if t is not None:
            assert [words[k].decode() for k in r] == _split(t) and raw.decode() == t
