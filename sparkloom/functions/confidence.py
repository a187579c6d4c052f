"""How sure an edge or a call is, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_EDGE = 0.8
#: An edge of such a kind is never less sure than this.
FLOORS = {"call": 0.9, "import": 0.85}


def edge_confidence(metadata: Column, kind: Column) -> Column:
    """Confidence noted in an edge's JSON metadata (0.8 where there is none), raised to its kind's floor, at most 1."""
    noted = F.coalesce(F.get_json_object(metadata, "$.confidence").cast("double"), F.lit(DEFAULT_EDGE))
    floor = F.lit(0.0)
    for name, least in FLOORS.items():
        floor = F.when(kind == name, F.lit(least)).otherwise(floor)
    return F.least(F.lit(1.0), F.greatest(noted, floor))


def call_confidence(callee: Column) -> Column:
    """0.5, more if the callee is qualified (+0.2) or a plain identifier (+0.1), at most 1."""
    dotted = F.when(callee.contains("."), 0.2).otherwise(0.0)
    plain = F.when(callee.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + dotted + plain)


def line_call_confidence(callee: Column, language: Column) -> Column:
    """What the line parser gives a call: Python 0.6 if qualified, else 0.3; C++ 0.5."""
    return F.when(language == "cpp", 0.5).when(callee.contains("."), 0.6).otherwise(0.3)
