"""What a plan did when it ran."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def rows_of_nodes(df: DataFrame) -> list[int]:
    """Run `df`; the rows that each of its operators gave, where they are counted."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan()  # planned anew
        plan.executeCollectPublic()
        return [x.metrics().get("numOutputRows").get().value() for x in _nodes(plan) if x.metrics().contains("numOutputRows")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
