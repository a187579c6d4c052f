"""The five base tables of the code index, and the files that hold them."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

VERSION = 3


def _table(*columns: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in columns])


_long, _int, _text, _real = LongType(), IntegerType(), StringType(), DoubleType()

FILES = _table(("id", _long, False), ("path", _text, False), ("mtime", _long, False), ("size", _long, False), ("content_hash", _text, False), ("indexed_at", _long, False), ("language", _text, True), ("lang", _text, True))
SYMBOLS = _table(("id", _long, False), ("file_id", _long, False), ("name", _text, False), ("kind", _text, False), ("line_start", _int, False), ("line_end", _int, True), ("column_start", _int, True), ("column_end", _int, True), ("signature", _text, True), ("docstring", _text, True), ("parent_id", _long, True))
EDGES = _table(("id", _long, False), ("source_id", _long, False), ("target_id", _long, False), ("kind", _text, False), ("file_id", _long, False), ("confidence", _real, True), ("metadata", _text, True))
CALLSITES = _table(("id", _long, False), ("edge_id", _long, False), ("line", _int, False), ("column", _int, True), ("context", _text, True))
META = _table(("key", _text, False), ("value", _text, False))
#: What the parsers found, before names are resolved.
CALLS = _table(("file_id", _long, False), ("line", _int, False), ("callee", _text, False), ("confidence", _real, True))
IMPORTS = _table(("file_id", _long, False), ("line", _int, False), ("module", _text, False), ("name", _text, True), ("alias", _text, True), ("raw_text", _text, True))
#: The inverted index of symbol names.
POSTINGS = _table(("term", _text, False), ("doc_id", _long, False), ("tf", _long, False), ("positions", ArrayType(_int), False))
TABLES: dict[str, StructType] = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES, "callsites": CALLSITES, "calls": CALLS, "imports": IMPORTS, "postings": POSTINGS, "meta": META}
