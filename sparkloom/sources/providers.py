"""Where answers about symbols come from: providers of one interface, and the first that has an answer."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.workspace import first_provider
from sparkloom.sources import scip

_PLACE = "point_id long, symbol string, path string, line int, character int"


class Provider(Protocol):
    """Each method takes and gives DataFrames; an empty one is no answer."""

    def definitions(self, points: DataFrame) -> DataFrame: ...
    def references(self, points: DataFrame) -> DataFrame: ...
    def call_hierarchy(self) -> DataFrame: ...
    def imports(self) -> DataFrame: ...
    def document_symbols(self) -> DataFrame: ...


class ScipProvider:
    """Answers from a code-intelligence index: documents() of sources.scip."""

    def __init__(self, docs: DataFrame):
        self.docs, self.occurrences = docs, scip.occurrences(docs)

    def definitions(self, points: DataFrame) -> DataFrame:
        return scip.definitions(self.occurrences, points)

    def references(self, points: DataFrame) -> DataFrame:
        return scip.references(self.occurrences, points).drop("is_definition")

    def call_hierarchy(self) -> DataFrame:
        return scip.call_hierarchy(scip.symbols(self.docs), self.occurrences)

    def imports(self) -> DataFrame:
        return scip.import_symbols(self.docs)

    def document_symbols(self) -> DataFrame:
        return scip.symbols(self.docs).select("path", "symbol", "display_name", scip.kind_name(F.col("kind")).alias("kind"))


class NoProvider:
    """Has no answer to anything; what stands last where nothing is known."""

    def __init__(self, spark):
        self._spark = spark

    def _none(self, schema: str) -> DataFrame:
        return self._spark.createDataFrame([], schema)

    def definitions(self, points: DataFrame) -> DataFrame:
        return self._none(_PLACE)

    def references(self, points: DataFrame) -> DataFrame:
        return self._none(_PLACE)

    def call_hierarchy(self) -> DataFrame:
        return self._none("symbol string, other string, direction string, path string, line int")

    def imports(self) -> DataFrame:
        return self._none("path string, symbol string")

    def document_symbols(self) -> DataFrame:
        return self._none("path string, symbol string, display_name string, kind string")


class Composite:
    """For each point, or path, the rows of the first provider that has any."""

    def __init__(self, providers: list[Provider]):
        self.providers = providers

    def _first(self, key: str, answers: list[DataFrame]) -> DataFrame:
        ranked = [df.withColumn("provider_rank", F.lit(k)).withColumnRenamed(key, "key") for k, df in enumerate(answers)]
        return first_provider(reduce(DataFrame.unionByName, ranked)).drop("provider_rank").withColumnRenamed("key", key)

    def definitions(self, points: DataFrame) -> DataFrame:
        return self._first("point_id", [p.definitions(points) for p in self.providers])

    def references(self, points: DataFrame) -> DataFrame:
        return self._first("point_id", [p.references(points) for p in self.providers])

    def call_hierarchy(self) -> DataFrame:
        return self._first("symbol", [p.call_hierarchy() for p in self.providers])

    def imports(self) -> DataFrame:
        return self._first("path", [p.imports() for p in self.providers])

    def document_symbols(self) -> DataFrame:
        return self._first("path", [p.document_symbols() for p in self.providers])
