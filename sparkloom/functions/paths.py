"""Predicates and labels derived from paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_PATH = r"test_|_test\.|_spec\.|\.spec\.|tests/|__tests__/"


def _by_suffix(spec: str) -> dict[str, str]:
    return {f".{x}": line.split()[0] for line in spec.split(";") for x in line.split()[1:]}


EXTENSIONS = _by_suffix("ruby rb; c h c; cpp hpp cc cpp; java java; go go; rust rs; typescript tsx ts; javascript jsx js; python py")
#: The parser's own map: headers and C count as C++, and more suffixes are known.
PARSER_EXTENSIONS = _by_suffix("cpp h c hpp cc cxx cpp; rust rs; go go; typescript tsx ts; javascript mjs jsx js; python py")
#: Names that generated code carries.
GENERATED = r"_(?:auto|generated)_|Generated|_pb2|pb2\.|(?:openapi|swagger)_"


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last component with its dot; empty where there is none or only a leading dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language_of(path: Column, known: dict[str, str] = EXTENSIONS) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.nullif(suffix(path), F.lit("")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")
