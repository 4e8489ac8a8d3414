"""The read-only gate: a walk over the parsed, not yet analysed plan.

The root's class tells what a statement is; what hides below it (an INSERT in a
WITH, a TRANSFORM, a call into Java, a path in place of a table) is found by
walking children, inner children and the plans inside expressions, and the
statements that EXPLAIN and DESCRIBE QUERY hold. Nothing is resolved or run.

Spark reads ``format.`path` `` wherever a two-part name is no table of the
catalog, for every format and class on the class path. So such names must be
tables that the catalog has; a list of formats would not hold. Names that an
expression makes (IDENTIFIER) are refused, as nothing can be told of them.
"""

from __future__ import annotations

from enum import Enum

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from gneiss.errors import DangerousFunction, FileReadBlocked, FileWriteBlocked, MultiStatement, QueryError, ReadOnlyViolation, TableNotFound
from gneiss.functions.ident import quote_ident


class StatementKind(Enum):
    SELECT = "select"  # can be paged
    NON_SELECT = "non_select"  # one page


_NON_SELECT = {
    *("ShowTables", "ShowTableExtended", "ShowNamespaces", "ShowNamespacesCommand", "ShowColumns", "ShowCreateTable", "ShowViews"),
    *("ShowFunctions", "ShowProceduresCommand", "ShowProcedures", "ShowPartitions", "ShowTableProperties", "ShowCurrentNamespaceCommand", "ShowCatalogsCommand"),
    *("DescribeRelation", "DescribeRelationJsonCommand", "DescribeColumn", "DescribeNamespace", "DescribeFunction", "DescribeQueryCommand", "DescribeProcedure"),
    *("ExplainCommand", "SetCatalogAndNamespace", "SetNamespaceCommand"),
}
_MOVING = {"SetCatalogAndNamespace", "SetNamespaceCommand", "SetCatalogCommand"}
#: Statements that hold others which can't be seen here.
_SCRIPTS = {"CompoundBody", "SingleStatement", "UnresolvedExecuteImmediate", "ExecuteImmediateQuery", "ExecuteImmediateCommands"}
_BLOCKED = {"reflect", "java_method", "try_reflect", "load_file"}
_MADE_NAMES = {"PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"}
_CATALYST = "org.apache.spark.sql.catalyst"


def statements(sql: str) -> list[str]:
    """The parts between semicolons that hold more than space and comments."""
    parts, at, n = [[]], 0, len(sql)
    while at < n:
        c, two = sql[at], sql[at : at + 2]
        if two == "--":
            end = sql.find("\n", at)
            at = n if end < 0 else end
        elif two == "/*":
            depth, at = 1, at + 2
            while at < n and depth:
                step = {"/*": 1, "*/": -1}.get(sql[at : at + 2], 0)
                depth += step
                at += 2 if step else 1
        elif c in "'\"`":
            end = at + 1
            while end < n and sql[end] != c:
                end += 2 if sql[end] == "\\" and c != "`" else 1
            parts[-1].append(sql[at : end + 1])
            at = end + 1
        elif c == ";":
            parts.append([])
            at += 1
        else:
            parts[-1].append(c)
            at += 1
    return [text for p in parts if (text := "".join(p).strip())]


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


class Gate:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        jvm = spark._jvm
        named = jvm.org.apache.spark.util.Utils.classForName
        self.commands = [named(f"{_CATALYST}.plans.logical.{c}", True, False) for c in ("Command", "ParsedStatement")]
        self.subquery = named(f"{_CATALYST}.expressions.PlanExpression", True, False)

    def classify(self, sql: str) -> StatementKind:
        """What a statement is, or the error why it must not run."""
        plan = self.parse(sql)
        root = plan.getClass().getSimpleName()
        if root in _NON_SELECT:
            self._walk_held(plan)
            return StatementKind.NON_SELECT
        self._walk(plan)
        return StatementKind.SELECT

    def inspect(self, sql: str) -> None:
        """Errors of a statement that is planned and not run: it may be a command,
        but may not reach files or Java."""
        self._walk(self.parse(sql), commands=True)

    def moves(self, sql: str) -> bool:
        """Whether a statement changes the session's current database."""
        return self.parse(sql).getClass().getSimpleName() in _MOVING

    def parse(self, sql: str):
        """The parsed plan of the only statement."""
        text = sql.strip()
        found = statements(text)
        if not found:
            raise ReadOnlyViolation("empty")
        if "\x00" in text:
            raise QueryError("null byte in statement")
        if len(found) > 1:
            raise MultiStatement()
        try:
            return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        except ParseException as e:
            raise QueryError(str(e).split("\n\nJVM")[0]) from e

    def _walk_held(self, plan) -> None:
        name = plan.getClass().getSimpleName()
        if name == "ExplainCommand":
            self._walk(plan.logicalPlan(), commands=True)
        elif name == "DescribeQueryCommand":
            self._walk(plan.plan(), commands=True)

    def _table(self, parts: list[str]) -> None:
        """Names of one part are views, tables of the session's database or parts
        of the statement; longer ones must be in the catalog."""
        catalog = self.spark.catalog
        if len(parts) == 1 or len(parts) == 2 and parts[0].lower() in ("global_temp", "session"):
            return
        if not catalog.databaseExists(".".join(map(quote_ident, parts[:-1]))):
            raise FileReadBlocked(f"reading by the format or database '{parts[0]}'")
        if not catalog.tableExists(".".join(map(quote_ident, parts))):
            raise TableNotFound(".".join(parts))

    def _is_command(self, node) -> bool:
        return ".execution.command." in node.getClass().getName() or any(c.isInstance(node) for c in self.commands)

    def _walk(self, plan, commands: bool = False) -> None:
        todo = [plan]
        while todo:
            node = todo.pop()
            name = node.getClass().getSimpleName()
            if name.startswith("InsertIntoDir"):
                raise FileWriteBlocked("INSERT OVERWRITE DIRECTORY")
            if name in _SCRIPTS or not commands and self._is_command(node):
                raise ReadOnlyViolation(name)
            if name == "ScriptTransformation":
                raise DangerousFunction("TRANSFORM")
            if name in _MADE_NAMES:
                raise DangerousFunction("IDENTIFIER")
            if name == "UnresolvedRelation":
                self._table(_seq(node.multipartIdentifier()))
            self._walk_held(node)
            todo += _seq(node.children()) + _seq(node.innerChildren())
            self._check(_seq(node.expressions()), todo)

    def _check(self, todo: list, plans: list) -> None:
        while todo:
            e = todo.pop()
            name = e.getClass().getSimpleName()
            if name in _MADE_NAMES:
                raise DangerousFunction("IDENTIFIER")
            if name == "UnresolvedFunction":
                called = _seq(e.nameParts())[-1].lower()
                if called in _BLOCKED:
                    raise DangerousFunction(f"{called.upper()}()")
            if self.subquery.isInstance(e):
                plans.append(e.plan())
            todo += _seq(e.children())
