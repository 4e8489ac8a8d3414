"""Tools by name, with their annotations; read-only mode hides the writing ones."""

from __future__ import annotations

from dataclasses import dataclass

from gneiss.gateway import Gateway


@dataclass(frozen=True)
class Tool:
    name: str
    method: str
    description: str
    read_only: bool
    destructive: bool
    idempotent: bool
    open_world: bool


def _listing(name: str, method: str, what: str) -> Tool:
    return Tool(name, method, f"Sorted pages of {what}.", True, False, True, False)


TOOLS = (
    _listing("listDatabases", "list_databases", "database names"),
    _listing("listTables", "list_tables", "tables, with metadata if asked for"),
    _listing("listViews", "list_views", "view names"),
    _listing("listTriggers", "list_triggers", "trigger names (Spark has none)"),
    _listing("listFunctions", "list_functions", "user function names"),
    _listing("listProcedures", "list_procedures", "procedure names"),
    _listing("listMaterializedViews", "list_materialized_views", "materialized view names"),
    Tool("readQuery", "read_query", "Pages of a SELECT; SHOW, DESCRIBE, USE and EXPLAIN whole.", True, False, True, True),
    Tool("explainQuery", "explain_query", "A statement's plan, or its run's metrics.", True, False, True, True),
    Tool("writeQuery", "write_query", "Runs any statement.", False, True, False, True),
    Tool("createDatabase", "create_database", "Creates a database.", False, False, False, False),
    Tool("dropDatabase", "drop_database", "Drops a database and all in it.", False, True, False, False),
    Tool("dropTable", "drop_table", "Drops a table.", False, True, False, False),
)


class Registry:
    def __init__(self, gateway: Gateway):
        self.gateway = gateway
        self.tools = {t.name: t for t in TOOLS if t.read_only or not gateway.config.read_only}

    def list_tools(self) -> list[Tool]:
        return list(self.tools.values())

    def get_tool(self, name: str) -> Tool | None:
        return self.tools.get(name)

    def call_tool(self, name: str, **arguments) -> dict:
        if name not in self.tools:
            raise KeyError(f"unknown tool: {name}")
        return getattr(self.gateway, self.tools[name].method)(**arguments)

    def get_info(self) -> dict:
        return {"name": "gneiss", "readOnly": self.gateway.config.read_only, "tools": list(self.tools)}
