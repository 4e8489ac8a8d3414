"""Plans as rows: planned, or run and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def planned(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"EXPLAIN FORMATTED {sql}")


def measured(spark: SparkSession, sql: str) -> DataFrame:
    """Runs the statement and returns (depth, node, metric, value) of the plan
    that ran last, adaptive stages resolved. Rows are counted on executors."""
    run = spark.sql(sql)._jdf.queryExecution()
    run.toRdd().count()
    rows: list[tuple[int, str, str, int]] = []
    todo = [(0, run.executedPlan())]
    while todo:
        depth, node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append((depth, node.executedPlan()))
            continue
        if name.endswith("QueryStage"):
            todo.append((depth, node.plan()))
            continue
        metrics = node.metrics()
        keys = metrics.keys().toSeq()
        values = [(keys.apply(i), metrics.apply(keys.apply(i)).value()) for i in range(keys.size())]
        rows += [(depth, name, k, int(v)) for k, v in sorted(values)] or [(depth, name, "", 0)]
        children = node.children()
        todo += [(depth + 1, children.apply(i)) for i in reversed(range(children.size()))]
    return spark.createDataFrame(rows, "depth int, node string, metric string, value long")
