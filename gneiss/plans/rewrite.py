"""UPDATE and DELETE of file tables by writing them anew.

Spark refuses row-level writes to file tables. Here the statement is parsed, the
table's new rows are a SELECT of CASE expressions or of the rows that stay, and
they replace the table once they are all written elsewhere: a failure before that
leaves the table as it was. A reader meanwhile sees the old or, for the moment of
the replacement, no files; two writers at once are the caller's to prevent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gneiss.errors import QueryError
from gneiss.functions.ident import quote_ident

#: Column that tells which rows the statement means.
_MARK = "gneiss row is meant"


def row_level(spark: SparkSession, sql: str, args: dict | None = None) -> int | None:
    """Rows changed by an UPDATE or DELETE; None for any other statement."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    kind = plan.getClass().getSimpleName()
    if kind not in ("UpdateTable", "DeleteFromTable"):
        return None
    if args:
        raise QueryError("UPDATE and DELETE take no parameters here")
    target = plan.table()
    while target.getClass().getSimpleName() == "SubqueryAlias":
        target = target.child()
    parts = target.multipartIdentifier()
    name = ".".join(quote_ident(parts.apply(i)) for i in range(parts.size()))
    fields = spark.table(name).schema.fields
    hit = _condition(spark, plan, kind)
    marked = _frame(spark, _project(spark, plan, kind, fields, hit))
    return _replace(spark, name, marked, delete=kind == "DeleteFromTable")


def _condition(spark: SparkSession, plan, kind: str):
    """Whether a row is meant: the condition is true, not null."""
    jvm = spark._jvm.org.apache.spark.sql.catalyst.expressions
    given = plan.condition()
    if kind == "UpdateTable":
        given = given.get() if given.isDefined() else jvm.Literal.TrueLiteral()
    return jvm.EqualNullSafe(given, jvm.Literal.TrueLiteral())


def _expressions(spark: SparkSession, items: list):
    return spark._jvm.PythonUtils.toSeq(items)


def _alias(spark: SparkSession, expression, name: str):
    jvm = spark._jvm
    none = getattr(jvm.scala, "None$")
    empty = getattr(none, "MODULE$")
    ids = jvm.org.apache.spark.sql.catalyst.expressions.NamedExpression.newExprId()
    return jvm.org.apache.spark.sql.catalyst.expressions.Alias(expression, name, ids, _expressions(spark, []), empty, _expressions(spark, []))


def _project(spark: SparkSession, plan, kind: str, fields, hit):
    jvm = spark._jvm.org.apache.spark.sql.catalyst
    values = {}
    if kind == "UpdateTable":
        for i in range(plan.assignments().size()):
            each = plan.assignments().apply(i)
            key = each.key().nameParts()
            values[key.apply(key.size() - 1).lower()] = each.value()
    known = {f.name.lower() for f in fields}
    if strange := set(values) - known:
        raise QueryError(f"no such column: {', '.join(sorted(strange))}")
    out = []
    for f in fields:
        own = jvm.analysis.UnresolvedAttribute.quoted(f.name)
        if f.name.lower() in values:
            own = getattr(jvm.expressions, "If")(hit, values[f.name.lower()], own)
        out.append(_alias(spark, own, f.name))
    out.append(_alias(spark, hit, _MARK))
    return jvm.plans.logical.Project(_expressions(spark, out), plan.table())


def _frame(spark: SparkSession, plan) -> DataFrame:
    made = getattr(getattr(spark._jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$").ofRows(spark._jsparkSession, plan)
    return DataFrame(made, spark)


def _replace(spark: SparkSession, name: str, marked: DataFrame, delete: bool) -> int:
    aside = f"gneiss_aside_{uuid.uuid4().hex}"
    kept = spark.table(name).schema
    columns = [marked[quote_ident(f.name)].cast(f.dataType).alias(f.name) for f in kept.fields]
    meant = marked[quote_ident(_MARK)]
    try:
        marked.select(*columns, meant.alias(_MARK)).write.format("parquet").saveAsTable(aside)
        table = spark.table(aside)
        changed = table.where(table[quote_ident(_MARK)]).count()
        if changed:
            rest = table.where(~table[quote_ident(_MARK)]) if delete else table
            rest.drop(_MARK).write.insertInto(name, overwrite=True)
            spark.catalog.refreshTable(name)
        return changed
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {aside}")
