import datetime as dt
import json
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gneiss import errors, sources
from gneiss.config import GatewayConfig
from gneiss.functions import encode
from gneiss.functions.ident import quote_ident, quote_literal, resolve_database, validate_ident
from gneiss.gateway import Gateway
from gneiss.operators.registry import Registry
from gneiss.plans.gate import Gate, StatementKind, statements
from gneiss.plans.paging import Cursor, Pager


@pytest.fixture(scope="module")
def app(spark):
    """A small schema: users, posts, tags and what hangs on them."""
    for name in ("app_t", "analytics_t", "canary_t"):
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
        spark.sql(f"CREATE DATABASE {name}")
    spark.sql("CREATE TABLE app_t.users (id INT, name STRING COMMENT 'full name', email STRING) USING parquet COMMENT 'people'")
    spark.sql("INSERT INTO app_t.users VALUES (1, 'Alice Johnson', 'alice@example.com'), (2, 'Bob Smith', 'bob@example.com'), (3, 'Charlie Brown', 'charlie@example.com')")
    spark.sql("CREATE TABLE app_t.posts (id INT, user_id INT, title STRING, published BOOLEAN) USING parquet")
    spark.sql("INSERT INTO app_t.posts VALUES (1,1,'Getting Started with SQL',true),(2,1,'Advanced Queries',true),(3,2,'Database Design',true),(4,2,'Draft Post',false),(5,3,'My First Post',false)")
    for t in ("orders", "erp_orders", "order_items", "inventory"):
        spark.sql(f"CREATE TABLE app_t.{t} (id BIGINT, total DECIMAL(12,2), tags ARRAY<STRING>) USING parquet")
    spark.sql("CREATE TABLE app_t.logs (id BIGINT, payload STRING, day DATE) USING parquet PARTITIONED BY (day)")
    spark.sql("CREATE VIEW app_t.active_users AS SELECT * FROM app_t.users")
    spark.sql("CREATE VIEW app_t.published_posts AS SELECT * FROM app_t.posts WHERE published")
    spark.sql("CREATE FUNCTION app_t.calc_total(n INT) RETURNS INT RETURN n * 2")
    spark.sql("CREATE FUNCTION app_t.double_it(n INT) RETURNS INT RETURN n + n")
    spark.range(3).createOrReplaceTempView("only_temporary")
    return spark


@pytest.fixture
def gateway(app):
    return Gateway(app, GatewayConfig(name="app_t", page_size=2, read_only=False))


# Cursors and pages.


@given(st.integers(0, (1 << 64) - 1))
def test_cursor_round_trip(n):
    text = Cursor(n).encode()
    assert Cursor.decode(text).offset == n and "=" not in text


@pytest.mark.parametrize("bad", ["!!!not-base64", "bm90LWpzb24", "eyJ4IjoxfQ", "eyJvZmZzZXQiOi0xfQ", "eyJvZmZzZXQiOjF9=="])
def test_malformed_cursor(bad):
    with pytest.raises(errors.InvalidCursor) as e:
        Cursor.decode(bad)
    assert e.value.code == -32602


def test_pager_boundaries():
    pager = Pager(None, 50)
    assert (pager.offset, pager.limit) == (0, 51)
    assert pager.finish(list(range(50))) == (list(range(50)), None)
    items, after = pager.finish(list(range(51)))
    assert len(items) == 50 and Cursor.decode(after).offset == 50
    with pytest.raises(errors.InvalidCursor):
        Pager(Cursor((1 << 64) - 1).encode(), 50).offset


def test_traversal_equals_one_page(gateway, app):
    sql, seen, cursor = "SELECT id, title FROM posts ORDER BY id", [], None
    while True:
        page = gateway.read_query(sql, cursor=cursor)
        assert len(page["rows"]) <= 2
        seen += page["rows"]
        cursor = page.get("nextCursor")
        if cursor is None:
            break
    assert seen == Gateway(app, GatewayConfig(name="app_t")).read_query(sql)["rows"] and len(seen) == 5


def test_no_cursor_on_exact_short_and_empty_pages(gateway):
    assert "nextCursor" not in gateway.read_query("SELECT id FROM users WHERE id < 3 ORDER BY id")
    assert gateway.read_query("SELECT id FROM users WHERE id < 0") == {"rows": []}
    assert gateway.read_query("SELECT id FROM users ORDER BY id", cursor=Cursor(999).encode()) == {"rows": []}


def test_inner_limit_is_kept(gateway):
    assert [r["id"] for r in gateway.read_query("SELECT id FROM posts ORDER BY id LIMIT 3 OFFSET 1", cursor=Cursor(2).encode())["rows"]] == [4]


def test_cursor_is_ignored_on_show_and_explain(gateway):
    with_cursor = gateway.read_query("SHOW TABLES IN app_t", cursor=Cursor(1).encode())
    assert len(with_cursor["rows"]) > 2 and "nextCursor" not in with_cursor
    assert gateway.read_query("EXPLAIN SELECT 1", cursor=Cursor(5).encode())["rows"]


def test_cursor_does_not_pass_the_gate(gateway):
    with pytest.raises(errors.ReadOnlyViolation):
        gateway.read_query("DROP TABLE users", cursor=Cursor(1).encode())


# The gate.


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1", "select * from users", "SELECT COUNT(*) FROM t", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT 1 UNION SELECT 2", "SELECT * FROM (SELECT 1) AS t", "TABLE users", "SELECT ';' AS a", "SELECT 1 -- ; x\n", "SELECT '-- ' || \"; DROP TABLE x\"", "SELECT a FROM t WHERE a IN (SELECT b FROM u)", "FROM t |> WHERE a > 1"],
)
def test_selects_pass(spark, sql):
    assert Gate(spark).classify(sql) is StatementKind.SELECT


@pytest.mark.parametrize("sql", ["SHOW DATABASES", "SHOW TABLES", "SHOW COLUMNS IN t", "SHOW CREATE TABLE t", "SHOW VIEWS", "SHOW FUNCTIONS", "DESC t", "DESCRIBE t", "USE a", "EXPLAIN SELECT 1"])
def test_metadata_passes(spark, sql):
    assert Gate(spark).classify(sql) is StatementKind.NON_SELECT


@pytest.mark.parametrize(
    "sql",
    [
        *("INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t", "DROP TABLE t", "CREATE TABLE t (a INT)", "ALTER TABLE t ADD COLUMN b INT", "TRUNCATE TABLE t", "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE"),
        *("", "  ", "-- only", "/* only */", ";", "SET x = 1", "CACHE TABLE t", "ADD JAR '/tmp/x.jar'", "SELEC 1", "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE t", "/* SELECT */ DELETE FROM t"),
        *("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM a INSERT INTO b SELECT * INSERT INTO c SELECT *", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1", "CREATE TABLE t AS SELECT 1"),
        *("SELECT TRANSFORM(a) USING 'cat' FROM t", "SELECT java_method('a', 'b')", "SELECT try_reflect('a', 'b')", "SELECT (SELECT reflect('a', 'b'))", "SELECT 1 FROM t WHERE EXISTS (SELECT reflect('a','b'))", "WITH x AS (SELECT reflect('a','b')) SELECT * FROM x"),
        *("SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM parquet.`s3://a/b`", "SELECT 1\x00; DROP TABLE t", "SELECT 1; DROP TABLE t", "SELECT 1； DROP TABLE t", "BEGIN SELECT 1; END"),
    ],
)
def test_everything_else_is_blocked(spark, sql):
    with pytest.raises(errors.SqlError):
        Gate(spark).classify(sql)


def test_statement_scanner():
    assert statements("a; b -- ; c\n; /* ; /* ; */ */ 'x;''y' ; `;`") == ["a", "b", "'x;''y'", "`;`"]


# Identifiers.


@pytest.mark.parametrize("name", ["users", "my table", "a.b", "тест", "x" * 10_000, "a`b", "1"])
def test_idents_pass(name):
    assert validate_ident(name) == name and quote_ident(name) == "`" + name.replace("`", "``") + "`"


@pytest.mark.parametrize("name", ["", " ", "\t", "a\nb", "a\x00b", "\x7f"])
def test_idents_fail(name):
    with pytest.raises(errors.InvalidIdentifier):
        validate_ident(name)


def test_blank_database_is_the_active_one():
    assert resolve_database(None) is resolve_database("  ") is None and resolve_database(" x ") == "x"


@given(st.text(st.characters(exclude_categories=["Cs", "Cc"]), max_size=30))
def test_quoted_literals_come_back(spark, text):
    assert spark.sql(f"SELECT {quote_literal(text)}").first()[0] == text


# Rows as JSON.


def test_temporal_and_typed_goldens(spark):
    sql = """SELECT DATE'2026-04-20' AS d, TIME'14:30:00' AS tm, TIMESTAMP_NTZ'2026-04-20 14:30:00' AS n, TIMESTAMP_NTZ'2026-04-20 14:30:00.120' AS f,
        TIMESTAMP'2026-04-20 14:30:00+02:00' AS z, unhex('00ff') AS b, CAST('NaN' AS DOUBLE) AS nan, CAST(NULL AS INT) AS nil, 12.50BD AS dec,
        CAST(18446744073709551615 AS DECIMAL(20,0)) AS big, CAST(7 AS DECIMAL(20,0)) AS small, 0.12345678901234567890BD AS exact, true AS t,
        array(1, NULL) AS a, map('k', DATE'2026-01-01') AS m, named_struct('x', 1.5D) AS s, parse_json('{"q": [1]}') AS v, 1 AS dup, 2 AS dup"""
    (row,) = encode.rows(spark.sql(sql))
    assert row == {
        **{"d": "2026-04-20", "tm": "14:30:00", "n": "2026-04-20T14:30:00", "f": "2026-04-20T14:30:00.12", "z": "2026-04-20T12:30:00Z", "b": "AP8=", "nan": None, "nil": None, "dec": 12.5},
        **{"big": "18446744073709551615", "small": 7, "exact": "0.12345678901234567890", "t": True, "a": [1, None], "m": {"k": "2026-01-01"}, "s": {"x": 1.5}, "v": {"q": [1]}, "dup": 2},
    }
    json.dumps(row)


# The catalog.


def test_listings(gateway):
    assert gateway.list_tables()["tables"] == ["erp_orders", "inventory"]
    everything = Gateway(gateway.spark, GatewayConfig(name="app_t"))
    names = everything.list_tables()["tables"]
    assert names == sorted(names) and "only_temporary" not in names and "active_users" not in names
    assert everything.list_views()["views"] == ["active_users", "published_posts"]
    assert everything.list_functions()["functions"] == ["calc_total", "double_it"]
    assert everything.list_procedures() == {"procedures": []} and everything.list_triggers() == {"triggers": []}
    assert everything.list_views("analytics_t") == {"views": []}
    assert {"app_t", "analytics_t", "canary_t"} <= set(everything.list_databases()["databases"])


def test_search(app):
    g = Gateway(app, GatewayConfig(name="app_t"))
    assert g.list_tables(search="ORDER")["tables"] == ["erp_orders", "order_items", "orders"]
    assert g.list_tables(search="order__")["tables"] == ["order_items"]
    assert g.list_tables(search="  ")["tables"] == g.list_tables()["tables"]
    assert g.list_tables(search="'; DROP TABLE users; --") == {"tables": []}


def test_detailed_listing(app):
    g = Gateway(app, GatewayConfig(name="app_t"))
    found = g.list_tables(detailed=True)["tables"]
    assert list(found) == g.list_tables()["tables"] and all("name" not in meta for meta in found.values())
    assert found["logs"]["kind"] == "PARTITIONED_TABLE" and found["users"]["kind"] == "TABLE" and found["users"]["comment"] == "people"
    assert [(c["name"], c["dataType"], c["ordinalPosition"]) for c in found["orders"]["columns"]] == [("id", "bigint", 1), ("total", "decimal(12,2)", 2), ("tags", "array<string>", 3)]
    assert found["users"]["columns"][1]["comment"] == "full name" and found["users"]["constraints"] == found["users"]["indexes"] == found["users"]["triggers"] == []


def test_materialized_views(gateway):
    gateway.create_materialized_view("mv_posts", "SELECT user_id, count(*) AS n FROM posts GROUP BY user_id")
    assert gateway.list_materialized_views() == {"materializedViews": ["mv_posts"]}
    assert "mv_posts" not in Gateway(gateway.spark, GatewayConfig(name="app_t")).list_tables()["tables"]
    assert gateway.read_query("SELECT n FROM mv_posts ORDER BY n LIMIT 1")["rows"] == [{"n": 1}]
    gateway.drop_table("mv_posts")


# Queries, writes, DDL.


def test_reads_of_the_small_schema(gateway):
    one = lambda sql: gateway.read_query(sql)["rows"]
    assert one("SELECT count(*) AS n FROM users") == [{"n": 3}]
    assert one("SELECT count(*) AS n FROM posts p JOIN users u ON u.id = p.user_id") == [{"n": 5}]
    assert one("SELECT name FROM users WHERE id IN (SELECT user_id FROM posts WHERE NOT published) ORDER BY id")[0] == {"name": "Bob Smith"}
    assert one("/* a */ SELECT id FROM users ORDER BY id LIMIT 1 -- b") == [{"id": 1}]
    assert one("SELECT id FROM users ORDER BY id LIMIT 1;") == [{"id": 1}]


def test_database_of_a_request(gateway):
    before = gateway.spark.catalog.currentDatabase()
    gateway.write_query("CREATE TABLE events (id INT) USING parquet", "analytics_t")
    gateway.write_query("INSERT INTO events VALUES (1), (2)", "analytics_t")
    assert gateway.read_query("SELECT count(*) AS n FROM events", "analytics_t")["rows"] == [{"n": 2}]
    assert gateway.read_query("USE analytics_t")["rows"] == [] and gateway.spark.catalog.currentDatabase() == before
    with pytest.raises(errors.TableNotFound):
        gateway.read_query("SELECT * FROM events")
    with pytest.raises(errors.SqlError):
        gateway.read_query("SELECT 1", "no_such_database")
    gateway.drop_table("events", "analytics_t", cascade=True)


def test_databases_come_and_go(gateway):
    with pytest.raises(errors.QueryError):
        gateway.create_database("canary_t")
    gateway.write_query("CREATE TABLE held (a INT) USING parquet", "canary_t")
    gateway.drop_database("canary_t")
    assert "canary_t" not in gateway.list_databases(Cursor(0).encode())["databases"]
    assert "created" in gateway.create_database("canary_t")["message"]
    for name in ("app_t", "APP_T"):
        with pytest.raises(errors.SqlError, match="stays"):
            gateway.drop_database(name)
    with pytest.raises(errors.TableNotFound):
        gateway.drop_table("nothing_here")
    with pytest.raises(errors.InvalidIdentifier):
        gateway.drop_table(" ")


def test_row_level_writes(gateway):
    gateway.write_query("CREATE TABLE people USING parquet AS SELECT * FROM users")
    assert gateway.write_query("INSERT INTO people VALUES (4, NULL, NULL), (5, 'Eve', 'e')") == {"rows": [], "affected": 2}
    assert gateway.write_query("UPDATE people AS p SET name = upper(p.name), EMAIL = '' WHERE p.id > 2") == {"rows": [], "affected": 3}
    assert gateway.read_query("SELECT name FROM people WHERE email = '' ORDER BY id", cursor=None)["rows"] == [{"name": "CHARLIE BROWN"}, {"name": None}]
    assert gateway.write_query("DELETE FROM people WHERE name LIKE 'A%'")["affected"] == 1  # a null name is not meant
    assert gateway.write_query("DELETE FROM people WHERE id = 77")["affected"] == 0
    assert gateway.read_query("SELECT count(*) AS n, count(name) AS named FROM people")["rows"] == [{"n": 4, "named": 3}]
    for bad in ("UPDATE people SET nothing = 1", "UPDATE no_such SET a = 1", "MERGE INTO people USING users ON people.id = users.id WHEN MATCHED THEN DELETE"):
        with pytest.raises(errors.SqlError):
            gateway.write_query(bad)
    assert gateway.write_query("DELETE FROM people")["affected"] == 4
    gateway.drop_table("people")


def test_no_way_to_a_file(app, tmp_path):
    (tmp_path / "secret.txt").write_text("word")
    g, at = Gateway(app, GatewayConfig(name="app_t")), f"`{tmp_path}/secret.txt`"
    kinds = ["text", "csv", "`org.apache.spark.sql.execution.datasources.text.TextFileFormat`", "`org.apache.spark.sql.execution.datasources.v2.text.TextDataSourceV2`", "TEXT", "binaryFile"]
    for kind in kinds:
        for sql in (f"SELECT * FROM {kind}.{at}", f"EXPLAIN SELECT * FROM {kind}.{at}", f"DESCRIBE QUERY SELECT * FROM {kind}.{at}", f"WITH x AS (SELECT * FROM {kind}.{at}) SELECT * FROM x", f"SELECT (SELECT max(value) FROM {kind}.{at})"):
            with pytest.raises(errors.SqlError):
                g.read_query(sql)
        with pytest.raises(errors.SqlError):
            g.explain_query(f"INSERT INTO users SELECT 1, value, value FROM {kind}.{at}")
    for sql in (f"SELECT * FROM IDENTIFIER('text.{at}')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'lineSeparator')", f"SELECT * FROM app_t.{at}", "EXECUTE IMMEDIATE 'SELECT 1'"):
        with pytest.raises(errors.SqlError):
            g.read_query(sql)
    assert g.read_query("SELECT count(*) AS n FROM app_t.users")["rows"] == [{"n": 3}]


def test_parameters_are_values(gateway):
    ask = "SELECT id FROM users WHERE name = :name ORDER BY id"
    assert gateway.read_query(ask, args={"name": "Bob Smith"})["rows"] == [{"id": 2}]
    assert gateway.read_query(ask, args={"name": "x' OR 1 = 1 --"})["rows"] == []
    assert gateway.write_query("INSERT INTO users SELECT id, :n, email FROM users WHERE id < 0", args={"n": "z"})["affected"] == 0


def test_a_write_that_is_out_of_time_does_not_commit(app):
    g = Gateway(app, GatewayConfig(name="app_t", query_timeout=1, read_only=False))
    slow = "INSERT INTO orders SELECT id, 1, NULL FROM range(0, 100000000000, 1, 4) WHERE sqrt(id) = 0.5"
    with pytest.raises(errors.QueryTimeout):
        g.write_query(slow)
    time.sleep(1)
    assert app.table("app_t.orders").count() == 0


def test_deep_pages_sort_on_executors(gateway):
    plan = lambda offset: gateway.page_frame("SELECT id FROM range(1000000) ORDER BY id DESC", Cursor(offset).encode())._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(10) and "TakeOrderedAndProject" not in plan(500_000)
    assert gateway.read_query("SELECT id FROM range(1000000) ORDER BY id DESC", cursor=Cursor(500_000).encode())["rows"][0] == {"id": 499_999}


def test_read_only_blocks_every_write(app):
    g = Gateway(app, GatewayConfig(name="app_t"))
    for call in (lambda: g.write_query("SELECT 1"), lambda: g.create_database("x"), lambda: g.drop_database("x"), lambda: g.drop_table("users"), lambda: g.create_materialized_view("a", "SELECT 1")):
        with pytest.raises(errors.ReadOnlyViolation):
            call()


def test_explain(app):
    g = Gateway(app, GatewayConfig(name="app_t"))
    assert "Physical Plan" in g.explain_query("INSERT INTO users VALUES (4, 'a', 'b')")["rows"][0]["plan"]
    with pytest.raises(errors.ReadOnlyViolation):
        g.explain_query("INSERT INTO users VALUES (4, 'a', 'b')", analyze=True)
    measured = g.explain_query("SELECT user_id, count(*) AS n FROM posts GROUP BY user_id", analyze=True)["rows"]
    assert any(r["metric"] == "numOutputRows" and r["value"] == 5 for r in measured)
    assert g.read_query("SELECT count(*) AS n FROM users")["rows"] == [{"n": 3}]


def test_timeout_cancels(app):
    g = Gateway(app, GatewayConfig(name="app_t", query_timeout=2))
    began = time.monotonic()
    with pytest.raises(errors.QueryTimeout, match="time limit"):
        g.read_query("SELECT count(*) AS n FROM range(0, 100000000000, 1, 8) WHERE sqrt(id) = 0.5")
    assert time.monotonic() - began < 10
    assert g.read_query("SELECT 1 AS a")["rows"] == [{"a": 1}]


# Registry and configuration.


def test_registry_hides_writes(app):
    read, write = (Registry(Gateway(app, GatewayConfig(read_only=r))) for r in (True, False))
    assert len(write.list_tools()) == 13
    assert set(write.tools) - set(read.tools) == {"writeQuery", "createDatabase", "dropDatabase", "dropTable"}
    assert all(t.read_only and not t.destructive for t in read.list_tools())
    assert read.call_tool("readQuery", query="SELECT 1 AS a") == {"rows": [{"a": 1}]}
    with pytest.raises(KeyError):
        read.call_tool("dropTable", table="x")
    assert read.get_tool("dropTable") is None and read.get_info()["readOnly"]


def test_config_collects_problems():
    with pytest.raises(ValueError) as e:
        GatewayConfig(page_size=0, query_timeout=-1, name=" ").validate()
    assert str(e.value).count(";") == 2
    assert GatewayConfig(page_size=500).validate().page_size == 500
    assert "secret" not in repr(GatewayConfig(jdbc_options={"password": "secret"}))


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("GNEISS_PAGE_SIZE", "7")
    monkeypatch.setenv("GNEISS_READ_ONLY", "false")
    config = GatewayConfig.from_environment(page_size=9)
    assert (config.page_size, config.read_only, config.query_timeout) == (9, False, 30) and GatewayConfig.from_environment().page_size == 7


def test_requests_by_line(app, monkeypatch, capsys):
    import io

    from gneiss import __main__ as shell

    asked = [{"id": 1, "tool": "readQuery", "arguments": {"query": "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1"}}, {"id": 2, "tool": "readQuery", "arguments": {"query": "DROP TABLE x"}}, {"id": 3, "tool": "nothing"}]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(map(json.dumps, asked)) + "\n"))
    assert shell.main(["--data", "/root/testdata/sf0.001", "--page-size", "3", "serve"]) == 0
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(told[0]["result"]["rows"]) == 1 and "nextCursor" not in told[0]["result"]
    assert told[1]["error"]["kind"] == "ReadOnlyViolation" and told[2]["error"]["code"] == -32602
    assert shell.main(["tools"]) == 0 and len(capsys.readouterr().out.splitlines()) == 9
    assert shell.main(["call", "listTriggers"]) == 0 and json.loads(capsys.readouterr().out) == {"triggers": []}


def test_jdbc_source_reports_a_missing_driver(spark):
    with pytest.raises(Exception):
        sources.read_jdbc(spark, "jdbc:nothing://host/db", "t")


def test_dates_before_1970_keep_their_fraction():
    from pyspark.sql import types as T

    assert encode.encode(dt.datetime(1969, 1, 1, 0, 0, 0, 500), T.TimestampNTZType()) == "1969-01-01T00:00:00.0005"


def _walk(gateway, sql, args=None):
    """Rows of all pages, a call that gives each, and what it returned."""
    cursor, out = None, []
    while True:
        page = gateway.read_query(sql, cursor=cursor, args=args)
        out += page["rows"]
        if (cursor := page.get("nextCursor")) is None:
            return out


def test_a_traversal_does_not_run_its_query_for_every_page(spark, monkeypatch):
    from gneiss import scratch
    from gneiss.plans import walks

    monkeypatch.setattr(walks, "ROWS", 70)
    gateway, runs = Gateway(spark, GatewayConfig(page_size=10)), []
    monkeypatch.setattr(Gateway, "frame", lambda self, *a, frame=Gateway.frame: runs.append(a) or frame(self, *a))
    sql = "SELECT id % 7 AS a, id AS a, id % 7 AS m, if(id % 3 = 0, NULL, id) AS n FROM range(0, 2000, 1, 8) WHERE id >= :least ORDER BY n DESC NULLS FIRST, id"
    there = set(scratch.SCRATCH)
    got = _walk(gateway, sql, {"least": 5})
    assert got == encode.rows(spark.sql(sql, args={"least": 5})) and len(got) == 1995
    assert len(runs) <= 10
    assert set(scratch.SCRATCH) == there  # nothing stays behind
    # Any other page is run: the same one again, and one of other arguments.
    assert _walk(gateway, sql, {"least": 1900}) == encode.rows(spark.sql(sql, args={"least": 1900}))


def test_a_stored_traversal_tells_the_same_and_ends_with_a_write(app, monkeypatch):
    from gneiss.plans import walks

    monkeypatch.setattr(walks, "RUN", 1)
    gateway = Gateway(app, GatewayConfig(page_size=3, read_only=False))
    kinds = "id, CAST(id AS DECIMAL(20,3)) / 7 AS d, TIMESTAMP '1850-01-02 03:04:05.678' AS t, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS z, DATE '0999-12-31' AS y, encode('x', 'utf-8') AS b, array(id, NULL) AS l, map('k', id) AS m, named_struct('x', double('NaN')) AS s, INTERVAL '1' DAY AS i, X'00ff' AS e"
    for extra in ("", ", NULL AS v", ", parse_json('{\"q\": [1, null]}') AS v"):  # files hold no void
        sql = f"SELECT {kinds}{extra} FROM range(20) ORDER BY id DESC"
        assert _walk(gateway, sql) == encode.rows(app.sql(sql))
    gateway.write_query("CREATE TABLE app_t.walked USING parquet AS SELECT id FROM range(30)")
    try:
        sql, cursor = "SELECT id FROM app_t.walked ORDER BY id", None
        for _ in range(3):
            cursor = gateway.read_query(sql, cursor=cursor)["nextCursor"]
        assert gateway.walks.known
        gateway.write_query("DELETE FROM app_t.walked WHERE id = 9")
        assert not gateway.walks.known
        assert [r["id"] for r in gateway.read_query(sql, cursor=cursor)["rows"]] == [10, 11, 12]
    finally:
        gateway.write_query("DROP TABLE app_t.walked")
