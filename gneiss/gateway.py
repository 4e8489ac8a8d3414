"""The gateway: thirteen tools over one SparkSession."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from gneiss import runner
from gneiss.config import GatewayConfig
from gneiss.errors import QueryError, ReadOnlyViolation, SqlError, TableNotFound, from_spark
from gneiss.functions import encode
from gneiss.functions.ident import quote_ident, resolve_database, validate_ident
from gneiss.operators import catalog
from gneiss.plans import explain, rewrite
from gneiss.plans.gate import Gate, StatementKind
from gneiss.plans.paging import DEEP, DEEP_SETTING, Pager
from gneiss.plans.walks import RUN, Stored, Walks

#: Sessions of other databases that are kept for further requests.
SESSIONS = 16


class Gateway:
    """Operators as methods; results are plain dicts, ready for JSON.

    Requests that name a database run in a session of that database, which is
    kept (the ``SESSIONS`` used last are), and USE in one of its own, so that
    nobody's current database moves. Temporary views are visible to requests
    that name none. Statements take values for their named parameters (``:a``)
    as ``args``, which no text of theirs can change.
    """

    def __init__(self, spark: SparkSession, config: GatewayConfig | None = None):
        self.spark = spark
        self.config = (config or GatewayConfig()).validate()
        self.gate = Gate(spark)
        self.sessions: OrderedDict[str, SparkSession] = OrderedDict()
        self.walks = Walks()
        if int(spark.conf.get(DEEP_SETTING)) > DEEP:
            spark.conf.set(DEEP_SETTING, DEEP)

    # Sessions.

    def active(self) -> str:
        return self.config.name or self.spark.catalog.currentDatabase()

    def _database(self, name: str | None) -> str:
        name = resolve_database(name) or self.active()
        if not self.spark.catalog.databaseExists(quote_ident(name)):
            raise QueryError(f"database '{name}' does not exist")
        return name

    def _session(self, database: str | None) -> SparkSession:
        name = resolve_database(database) or self.config.name
        if name is None or name == self.spark.catalog.currentDatabase():
            return self.spark
        other = self.sessions.pop(name, None)
        if other is None or not self.spark.catalog.databaseExists(quote_ident(name)):
            other = self.spark.newSession()
            for setting in ("spark.sql.session.timeZone", DEEP_SETTING):
                other.conf.set(setting, self.spark.conf.get(setting))
            try:
                other.catalog.setCurrentDatabase(name)
            except Exception as e:
                raise from_spark(e) from e
        self.sessions[name] = other
        while len(self.sessions) > SESSIONS:
            self.sessions.popitem(last=False)
        return other

    def _gate(self, session: SparkSession) -> Gate:
        return self.gate if session is self.spark else Gate(session)

    def _timed(self, work, sql: str):
        return runner.run(self.spark, work, sql, self.config.query_timeout)

    def _page(self, frame: DataFrame, cursor: str | None, field: str) -> dict:
        pager = Pager(cursor, self.config.page_size)
        names, after = pager.finish([r["name"] for r in self._timed(lambda: pager.window(frame).collect(), field)])
        return {field: names} | ({"nextCursor": after} if after else {})

    def _writable(self) -> None:
        if self.config.read_only:
            raise ReadOnlyViolation("read-only mode")
        self.walks.clear()  # their pages would show what was there before

    # Catalog.

    def list_databases(self, cursor: str | None = None) -> dict:
        return self._page(catalog.databases(self.spark), cursor, "databases")

    def list_tables(self, database: str | None = None, cursor: str | None = None, search: str | None = None, detailed: bool = False) -> dict:
        """Names, or with ``detailed`` an object of metadata by name in the same
        order; metadata is fetched for the page's tables only."""
        pager = Pager(cursor, self.config.page_size)
        database = self._database(database)
        frame = catalog.tables(self.spark, database, search)
        found, after = pager.finish(self._timed(lambda: pager.window(frame).collect(), "listTables"))
        if detailed:
            listed = {r["name"]: catalog.describe(self.spark, database, r["name"]) for r in found}
        else:
            listed = [r["name"] for r in found]
        return {"tables": listed} | ({"nextCursor": after} if after else {})

    def list_views(self, database: str | None = None, cursor: str | None = None) -> dict:
        return self._page(catalog.views(self.spark, self._database(database)), cursor, "views")

    def list_triggers(self, database: str | None = None, cursor: str | None = None) -> dict:
        return self._page(catalog.triggers(self.spark, self._database(database)), cursor, "triggers")

    def list_functions(self, database: str | None = None, cursor: str | None = None) -> dict:
        return self._page(catalog.functions(self.spark, self._database(database)), cursor, "functions")

    def list_procedures(self, database: str | None = None, cursor: str | None = None) -> dict:
        return self._page(catalog.procedures(self.spark, self._database(database)), cursor, "procedures")

    def list_materialized_views(self, database: str | None = None, cursor: str | None = None) -> dict:
        return self._page(catalog.materialized_views(self.spark, self._database(database)), cursor, "materializedViews")

    # Queries.

    def frame(self, query: str, database: str | None = None, args: dict | None = None) -> tuple[DataFrame, StatementKind]:
        """The gated statement as a lazy frame, not paged."""
        session = self._session(database)
        gate = self._gate(session)
        kind = gate.classify(query)
        if kind is StatementKind.NON_SELECT and gate.moves(query):
            session = session.newSession()
        try:
            return session.sql(query.strip().rstrip(";"), args=args), kind
        except Exception as e:
            raise from_spark(e) from e

    def page_frame(self, query: str, cursor: str | None = None, database: str | None = None, args: dict | None = None) -> DataFrame:
        """One page of a SELECT as a lazy frame; other statements whole."""
        pager = Pager(cursor, self.config.page_size)
        df, kind = self.frame(query, database, args)
        return pager.page(df) if kind is StatementKind.SELECT else df

    def read_query(self, query: str, database: str | None = None, cursor: str | None = None, args: dict | None = None) -> dict:
        """Rows of a SELECT, a page at a time; of SHOW, DESCRIBE, EXPLAIN and USE
        all rows, whatever the cursor. Pages hang together under a total ORDER BY.
        A traversal of more than ``RUN`` pages is stored (``plans/walks.py``) and
        then shows what was there at that time."""
        pager = Pager(cursor, self.config.page_size)
        key = self.walks.key(query, resolve_database(database) or self.active(), args)
        walk, found = self.walks.take(key, pager.start), None
        try:
            if walk.stored is not None:
                found = self._stored_page(walk, pager, query)
            if found is None:
                df, kind = self.frame(query, database, args)
                if kind is StatementKind.NON_SELECT:
                    return {"rows": self._timed(lambda: encode.rows(df), query)}
                if walk.pages >= RUN and not walk.runs:
                    found = self._stored_page(walk, pager, query, df)
            if found is None:
                found = self._timed(lambda: encode.rows(pager.window(df)), query)
                walk.pages += 1
        except BaseException:
            walk.drop()
            raise
        found, after = pager.finish(found)
        if after is None:
            walk.drop()
            return {"rows": found}
        self.walks.put(key, walk, pager.start + pager.size)
        return {"rows": found, "nextCursor": after}

    def _stored_page(self, walk, pager: Pager, query: str, df: DataFrame | None = None) -> list | None:
        """A page from what is stored, of ``df`` where that is still to be done.
        None where it can't be (types that files don't hold, no shared folder, no
        time, files that are gone): such a traversal runs its pages."""
        try:
            if df is not None:
                walk.stored = self._timed(lambda: Stored(df), query)
            return self._timed(lambda: walk.stored.rows(pager.start, pager.limit), query)
        except SqlError:
            walk.runs = True
            walk.drop()
            return None

    def write_query(self, query: str, database: str | None = None, args: dict | None = None) -> dict:
        """Any statement; the rows it returns, mostly none, and where rows were
        written or changed, how many (``affected``). UPDATE and DELETE of a file
        table write it anew (``plans/rewrite.py``); MERGE is Spark's alone."""
        self._writable()
        session = self._session(database)
        text = query.strip().rstrip(";")

        def work() -> dict:
            changed = rewrite.row_level(session, text, args)
            if changed is not None:
                return {"rows": [], "affected": changed}
            df = session.sql(text, args=args)
            written = encode.affected(df)
            return {"rows": encode.rows(df)} | ({"affected": written} if written is not None else {})

        return self._timed(work, query)

    def explain_query(self, query: str, database: str | None = None, analyze: bool = False) -> dict:
        """The plan; with ``analyze`` the statement runs and its metrics come
        back. In read-only mode what is planned may be a write, what is run not,
        and neither may reach files or Java."""
        session = self._session(database)
        text = query.strip().rstrip(";")
        if self.config.read_only:
            gate = self._gate(session)
            gate.classify(query) if analyze else gate.inspect(query)
        work = explain.measured if analyze else explain.planned
        return {"rows": self._timed(lambda: encode.rows(work(session, text)), query)}

    # DDL.

    def create_database(self, database: str) -> dict:
        self._writable()
        validate_ident(database)
        self._timed(lambda: self.spark.sql(f"CREATE DATABASE {quote_ident(database)}"), "createDatabase")
        return {"message": f"created database {database}"}

    def drop_database(self, database: str) -> dict:
        """With all it holds; the active one can't be dropped."""
        self._writable()
        validate_ident(database)
        if database.lower() == self.active().lower():
            raise SqlError(f"{database} is this gateway's own database and stays")
        self._timed(lambda: self.spark.sql(f"DROP DATABASE {quote_ident(database)} CASCADE"), "dropDatabase")
        self.sessions.pop(database, None)
        return {"message": f"dropped database {database} and all in it"}

    def drop_table(self, table: str, database: str | None = None, cascade: bool = False) -> dict:
        """``cascade`` is accepted; nothing depends on a Spark table."""
        self._writable()
        validate_ident(table)
        database = self._database(database)
        at = f"{quote_ident(database)}.{quote_ident(table)}"
        if not self.spark.catalog.tableExists(at):
            raise TableNotFound(table)
        self._timed(lambda: self.spark.sql(f"DROP TABLE {at}"), "dropTable")
        return {"message": f"dropped table {table}"}

    def create_materialized_view(self, name: str, query: str, database: str | None = None) -> dict:
        """A marked table that holds a gated SELECT's rows; created anew to refresh."""
        self._writable()
        validate_ident(name)
        home = self._database(database)
        at = f"{quote_ident(home)}.{quote_ident(name)}"
        df, _ = self.frame(query, database)
        self._timed(lambda: df.write.mode("overwrite").saveAsTable(at), query)
        self._timed(lambda: catalog.mark_materialized(self.spark, home, name), query)
        return {"message": f"stored view {name}"}
