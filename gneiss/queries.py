"""The gateway's driver queries, each through the gate, and their oracle SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import sources
from gneiss.config import GatewayConfig
from gneiss.errors import SqlError
from gneiss.functions import encode
from gneiss.functions.ident import quote_ident, quote_literal, validate_ident
from gneiss.gateway import Gateway
from gneiss.operators import catalog
from gneiss.operators.registry import Registry
from gneiss.plans.paging import Cursor

_LISTED = ("customer", "lineitem", "nation", "orders", "region")

# Name: the statement for both engines, or one for each.
READS: dict[str, str | tuple[str, str]] = {
    "read_projection_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "read_empty_result": "SELECT o_orderkey FROM orders WHERE o_orderkey < 0",
    "read_count": "SELECT count(*) AS n FROM lineitem",
    "read_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "read_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "read_count_distinct": "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem",
    "read_distinct": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders",
    "read_inner_join": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "read_join_three": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "read_composite_join": "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "read_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "read_full_join": "SELECT coalesce(a.n_nationkey, -1) AS a, coalesce(b.k, -1) AS b FROM nation a FULL JOIN (SELECT DISTINCT s_nationkey + 5 AS k FROM supplier) b ON a.n_nationkey = b.k",
    "read_cross_join": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b",
    "read_theta_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "read_in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "read_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "read_not_exists": "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)",
    "read_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "read_correlated_scalar": "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region",
    "read_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON c_custkey = o_custkey WHERE total > 500000 GROUP BY c_mktsegment",
    "read_recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    "read_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "read_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "read_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "read_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "read_derived_table": "SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) AS t WHERE n > 10",
    "read_inner_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "read_comments": "/* leading */ SELECT r_name -- inner\nFROM region -- trailing",
    "read_trailing_semicolon": "SELECT r_regionkey, r_name FROM region;",
    "read_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "read_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "read_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "read_window_rank": "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rn, cast(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS bigint) AS rk FROM orders",
    "read_window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before FROM orders",
    "read_functions": "SELECT n_nationkey, lower(n_name) AS low, replace(n_name, 'A', 'x') AS rep, cast(length(n_name) AS bigint) AS len, concat(n_name, '-', 'z') AS cat, n_name || '!' AS bar FROM nation",
    "read_dates": "SELECT o_orderkey, cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, cast(cast(date_trunc('month', o_orderdate) AS date) AS varchar(10)) AS first FROM orders",
    "read_math": "SELECT n_nationkey, abs(n_nationkey - 12) AS a, round(sqrt(n_nationkey), 6) AS r, cast(floor(n_nationkey / 2) AS bigint) AS f, 7 / 2 AS half FROM nation",
    "read_nulls_order": "SELECT n_nationkey, cast(row_number() OVER (ORDER BY nullif(n_regionkey, 2) ASC NULLS LAST, n_nationkey) AS bigint) AS rn FROM nation",
    "case_coalesce_nullif": "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'zero' WHEN n_regionkey < 3 THEN 'low' ELSE 'high' END AS c, coalesce(nullif(n_regionkey, 1), -1) AS k, cast(n_nationkey AS varchar(10)) AS t FROM nation",
    "search_ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%' || 'RE' || '%'",
    "search_lower_like": "SELECT n_name FROM nation WHERE lower(n_name) LIKE lower(concat('%', 'N', '%')) AND n_name NOT LIKE '%5'",
    "search_underscore": "SELECT r_name FROM region WHERE r_name ILIKE 'a_ia'",
    "search_null_param": "SELECT n_name FROM nation WHERE (CAST(NULL AS varchar(10)) IS NULL OR n_name ILIKE CAST(NULL AS varchar(10)))",
    "string_agg_ordered": (
        "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "array_agg_ordered": (
        "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_nationkey AS k, n_name AS v))), s -> s.v), '|') AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey), '|') AS names FROM nation GROUP BY n_regionkey",
    ),
    "unnest_ordinality": (
        "SELECT n_nationkey, cast(pos + 1 AS bigint) AS pos, part FROM nation LATERAL VIEW posexplode(split(n_name, 'A')) x AS pos, part",
        "SELECT n_nationkey, unnest(range(1, len(string_split(n_name, 'A')) + 1)) AS pos, unnest(string_split(n_name, 'A')) AS part FROM nation",
    ),
    "lateral_unnest": (
        "SELECT n_nationkey, x FROM nation, LATERAL (SELECT explode(sequence(1, n_regionkey + 1)) AS x)",
        "SELECT n_nationkey, cast(x AS int) AS x FROM nation, LATERAL (SELECT unnest(range(1, n_regionkey + 2)) AS x)",
    ),
    "json_object": (
        "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS j FROM nation",
        "SELECT n_nationkey, json_object('name', n_name, 'region', n_regionkey)::varchar AS j FROM nation",
    ),
    "json_agg_ordered": (
        "SELECT n_regionkey, to_json(array_sort(collect_list(named_struct('k', n_nationkey, 'v', n_name)))) AS j FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, to_json(array_agg({'k': n_nationkey, 'v': n_name} ORDER BY n_nationkey))::varchar AS j FROM nation GROUP BY n_regionkey",
    ),
    "json_reparse": (
        "SELECT event_id, cast(from_json(props, 'k BIGINT').k AS bigint) AS k, to_json(parse_json(props)) AS again FROM events",
        "SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k, json(props)::varchar AS again FROM events",
    ),
    "read_max_min": "SELECT o_orderstatus, max(o_totalprice) AS most, min(o_totalprice) AS least, max(o_orderkey) AS last FROM orders GROUP BY o_orderstatus",
    "read_sum_int": "SELECT l_returnflag, cast(sum(l_linenumber) AS bigint) AS s, cast(sum(l_orderkey) AS bigint) AS k FROM lineitem GROUP BY l_returnflag",
    "read_existence": "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS some, EXISTS (SELECT 1 FROM orders WHERE o_orderkey < 0) AS none",
    "read_composite_join_two": "SELECT l_orderkey, l_linenumber, most FROM lineitem JOIN (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS most FROM lineitem GROUP BY l_orderkey, l_linenumber) m ON l_orderkey = k AND l_linenumber = n WHERE l_quantity = most",
    "read_approximate": (
        "SELECT approx_count_distinct(n_regionkey) AS regions, percentile_approx(n_nationkey, 0.5, 1000000) AS middle FROM nation",
        "SELECT approx_count_distinct(n_regionkey) AS regions, quantile_disc(n_nationkey, 0.5) AS middle FROM nation",
    ),
    "read_map_functions": (
        "SELECT n_nationkey, element_at(map(n_name, n_regionkey, 'x', -1), n_name) AS own, element_at(map('x', -1), n_name) AS missing, cardinality(map_keys(map(n_name, 1, 'x', 2))) AS size FROM nation",
        "SELECT n_nationkey, map {n_name: n_regionkey, 'x': -1}[n_name] AS own, map {'x': -1}[n_name] AS missing, cast(len(map_keys(map {n_name: 1, 'x': 2})) AS int) AS size FROM nation",
    ),
    "read_array_functions": (
        "SELECT n_nationkey, array_contains(split(n_name, 'A'), '') AS starts, element_at(array_sort(split(n_name, 'A')), 1) AS first, cast(size(array_distinct(split(n_name, ''))) AS int) AS letters FROM nation",
        "SELECT n_nationkey, list_contains(string_split(n_name, 'A'), '') AS starts, list_sort(string_split(n_name, 'A'))[1] AS first, cast(len(list_distinct(string_split(n_name, ''))) AS int) AS letters FROM nation",
    ),
    "series": ("SELECT explode(sequence(1, 10)) AS n", "SELECT cast(unnest(range(1, 11)) AS int) AS n"),
}

_ORDERED = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey"
_NATIONS = "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"
_CUSTOMERS = "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey"
_TOP = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 5"
_BAD_CURSORS = ("!!!not-base64", "bm90LWpzb24", "eyJ4IjoxfQ", "eyJvZmZzZXQiOi0xfQ")

# Statement with named parameters, their values, and the same with the values in it.
BOUND = {
    "bound_parameters": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = :region AND n_name <> :name", {"region": 1, "name": "'' OR 1 = 1 --"}, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"),
    "optional_filter_null": ("SELECT n_name FROM nation WHERE (:p IS NULL OR n_name ILIKE '%' || :p || '%')", {"p": None}, "SELECT n_name FROM nation"),
    "optional_filter_set": ("SELECT n_name FROM nation WHERE (:p IS NULL OR n_name ILIKE '%' || :p || '%')", {"p": "n1"}, "SELECT n_name FROM nation WHERE n_name ILIKE '%n1%'"),
}

_STATEMENTS = [
    *(("SELECT 1", "select"), ("WITH x AS (SELECT 1) SELECT * FROM x", "select"), ("SELECT 1 UNION SELECT 2", "select"), ("VALUES (1)", "select")),
    *(("SHOW DATABASES", "non_select"), ("SHOW TABLES", "non_select"), ("DESCRIBE users", "non_select"), ("DESC users", "non_select"), ("USE app", "non_select"), ("EXPLAIN SELECT 1", "non_select")),
    *(("INSERT INTO users VALUES (1)", "ReadOnlyViolation"), ("UPDATE users SET name = 1", "ReadOnlyViolation"), ("DELETE FROM users", "ReadOnlyViolation"), ("DROP TABLE users", "ReadOnlyViolation"), ("CREATE TABLE t (id INT)", "ReadOnlyViolation")),
    *(("/* SELECT */ DELETE FROM users", "ReadOnlyViolation"), ("SELECT 1 -- DELETE FROM users", "select"), ("", "ReadOnlyViolation"), ("-- nothing", "ReadOnlyViolation"), ("SET a = 1", "ReadOnlyViolation")),
    *(("SELECT 1; SELECT 2", "MultiStatement"), ("SELECT 1; DROP TABLE users", "MultiStatement"), ("SELECT 1;", "select"), ("SELECT ''; DROP TABLE x''", "select"), ("SELEC * FORM users", "QueryError")),
    *(("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "ReadOnlyViolation"), ("FROM a INSERT INTO b SELECT * INSERT INTO c SELECT *", "ReadOnlyViolation")),
    *(("SELECT TRANSFORM(a) USING ''cat'' FROM region", "DangerousFunction"), ("SELECT reflect(''java.lang.System'', ''exit'', 0)", "DangerousFunction"), ("SELECT load_file(''/etc/passwd'')", "DangerousFunction")),
    *(("SELECT ''LOAD_FILE(/etc/passwd)''", "select"), ("SELECT * FROM text.`/etc/passwd`", "FileReadBlocked"), ("INSERT OVERWRITE DIRECTORY ''/tmp/x'' SELECT 1", "FileWriteBlocked")),
    *(("SELECT * FROM r WHERE a IN (SELECT reflect(''a'', ''b''))", "DangerousFunction"), ("SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/passwd`", "FileReadBlocked")),
    *(("SELECT * FROM json.relative", "FileReadBlocked"), ("EXPLAIN SELECT * FROM text.`/etc/passwd`", "FileReadBlocked"), ("DESCRIBE QUERY SELECT * FROM text.`/etc/passwd`", "FileReadBlocked"), ("EXPLAIN INSERT INTO t SELECT 1", "non_select")),
    *(("SELECT * FROM default.no_such_table", "TableNotFound"), ("EXPLAIN SELECT reflect(''a'', ''b'')", "DangerousFunction"), ("WITH t AS (SELECT * FROM csv.`/tmp`) SELECT * FROM t", "FileReadBlocked")),
]
_IDENTS = [("users", True), ("my table", True), ("a.b", True), ("", False), ("   ", False), ("a\tb", False), ("naïve", True), ("x" * 200, True)]
_OFFSETS = [0, 1, 99, 100, 101, 12345, (1 << 63) - 1]


def _gateway(spark: SparkSession, sf_dir: str, sql: str = "", **config) -> Gateway:
    """Over views of the tables that the statement names; each costs a footer."""
    sources.register_views(spark, sf_dir, tuple(t for t in sources.TABLES if re.search(rf"\b{t}\b", sql)))
    return Gateway(spark, GatewayConfig(**{"query_timeout": 0} | config))


def _read(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return _gateway(spark, sf_dir, sql).frame(sql)[0]


def _page(spark: SparkSession, sf_dir: str, sql: str, offset: int, size: int = 100) -> DataFrame:
    return _gateway(spark, sf_dir, sql, page_size=size).page_frame(sql, Cursor(offset).encode())


def _page_walk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a traversal by cursor, put together."""
    gateway, cursor, rows = _gateway(spark, sf_dir, _CUSTOMERS, page_size=400), None, []
    while True:
        page = gateway.read_query(_CUSTOMERS, cursor=cursor)
        rows += [(r["c_custkey"], r["c_name"]) for r in page["rows"]]
        cursor = page.get("nextCursor")
        if cursor is None:
            return spark.createDataFrame(rows, "c_custkey long, c_name string")


def _bound(spark: SparkSession, sf_dir: str, sql: str, args: dict) -> DataFrame:
    return _gateway(spark, sf_dir, sql).frame(sql, args=args)[0]


def _told(call: Callable) -> str:
    """The name of the error that a call raises, or of what it returns."""
    try:
        return type(call()).__name__
    except SqlError as e:
        return f"{type(e).__name__} {e.code}"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call for each kind of error."""
    read, write = (_gateway(spark, sf_dir, read_only=r) for r in (True, False))
    timed = _gateway(spark, sf_dir, query_timeout=0.5)
    calls = {
        "write in read-only mode": lambda: read.write_query("SELECT 1"),
        "function": lambda: read.read_query("SELECT reflect('a', 'b')"),
        "path": lambda: read.read_query("SELECT * FROM text.`/etc/hosts`"),
        "directory": lambda: read.read_query("INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1"),
        "two statements": lambda: read.read_query("SELECT 1; SELECT 2"),
        "identifier": lambda: write.create_database(" "),
        "no table": lambda: read.read_query("SELECT * FROM no_such_table"),
        "syntax": lambda: read.read_query("SELEC 1"),
        "time limit": lambda: timed.read_query("SELECT count(*) AS n FROM range(0, 100000000000, 1, 4) WHERE sqrt(id) = 0.5"),
        "far cursor": lambda: read.read_query("SELECT 1 AS a", cursor=Cursor(1 << 33).encode()),
        **{f"cursor {c}": (lambda c=c: read.read_query("SELECT 1 AS a", cursor=c)) for c in _BAD_CURSORS},
        "nothing wrong": lambda: read.read_query("SELECT 1 AS a"),
    }
    return spark.createDataFrame([(name, _told(call)) for name, call in calls.items()], "call string, told string")


_TOLD = {
    **{"write in read-only mode": "ReadOnlyViolation -32603", "function": "DangerousFunction -32603", "path": "FileReadBlocked -32603", "directory": "FileWriteBlocked -32603", "two statements": "MultiStatement -32603", "identifier": "InvalidIdentifier -32603"},
    **{"no table": "TableNotFound -32603", "syntax": "QueryError -32603", "time limit": "QueryTimeout -32603", "far cursor": "InvalidCursor -32602", **{f"cursor {c}": "InvalidCursor -32602" for c in _BAD_CURSORS}, "nothing wrong": "dict"},
}


def _quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and texts through the quoting, as Spark reads them back."""
    row = spark.sql("SELECT " + ", ".join(f"{quote_literal(n)} AS {quote_ident(n)}" for n in _QUOTED))
    return spark.createDataFrame(list(zip(row.columns, row.first())), "name string, text string")


_QUOTED = ["plain", "two words", "a`b", "it's", "back\\slash", "dot.ted", "naïve"]


def _databases_of_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a blank, a given and a padded database name lead to; sessions are kept."""
    sources.register_tables(spark, "gneiss_scratch", sf_dir, ("region",))
    gateway = Gateway(spark, GatewayConfig(query_timeout=0))
    rows = [(n or "", gateway.read_query("SELECT current_database() AS d", n)["rows"][0]["d"]) for n in (None, "  ", "gneiss_scratch", " gneiss_scratch ")]
    return spark.createDataFrame([*rows, ("kept", str(len(gateway.sessions)))], "given string, used string")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many problems settings have, and whether a secret is shown."""
    given = {"good": GatewayConfig(), "page of 0": GatewayConfig(page_size=0), "page of 501": GatewayConfig(page_size=501), "three": GatewayConfig(name=" ", page_size=-1, query_timeout=-1)}
    rows = [(k, len(c.problems())) for k, c in given.items()]
    shown = repr(GatewayConfig(jdbc_options={"password": "secret", "user": "me", "fetchsize": "7"}))
    return spark.createDataFrame([*rows, ("secrets shown", sum(x in shown for x in ("secret", "me'")))], "setting string, problems int")


def _tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    registries = [Registry(_gateway(spark, sf_dir, read_only=r)) for r in (True, False)]
    called = registries[0].call_tool("readQuery", query="SELECT 1 AS a")["rows"][0]["a"]
    return spark.createDataFrame([(t.name, t.read_only, t.destructive, registries[0].get_tool(t.name) is not None, called) for t in registries[1].list_tools()], "tool string, reads boolean, destroys boolean, in_read_only boolean, called int")


_TOOLS = [*((f"list{x}", True, False, True, 1) for x in ("Databases", "Tables", "Views", "Triggers", "Functions", "Procedures", "MaterializedViews")), ("readQuery", True, False, True, 1), ("explainQuery", True, False, True, 1), ("writeQuery", False, True, False, 1), ("createDatabase", False, False, False, 1), ("dropDatabase", False, True, False, 1), ("dropTable", False, True, False, 1)]


def _statement(spark: SparkSession, sf_dir: str, sql: str, keys: tuple[str, ...], where: str = "true") -> DataFrame:
    """Columns of a statement that is no SELECT, run whole through the gate."""
    gateway = _demo(spark, sf_dir)
    rows = gateway.read_query(sql, "gneiss_demo", cursor=Cursor(3).encode())["rows"]
    return spark.createDataFrame([tuple(str(r[k]) for k in keys) for r in rows], ", ".join(f"{k} string" for k in keys)).where(where)


def _use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """USE answers without rows and moves nobody's current database."""
    gateway, before = _demo(spark, sf_dir), spark.catalog.currentDatabase()
    rows = gateway.read_query("USE gneiss_demo")["rows"]
    return spark.createDataFrame([(len(rows), spark.catalog.currentDatabase() == before)], "n int, stayed boolean")


def _version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "SELECT version() RLIKE '^[0-9]+[.][0-9]+[.][0-9]+' AS told")


def _explain_nodes(spark: SparkSession, sf_dir: str, analyze: bool = False) -> DataFrame:
    """What every plan of this statement has, by the read or the explain tool."""
    sql = READS["read_group_by"]
    if analyze:
        rows = _gateway(spark, sf_dir, sql).explain_query(sql, analyze=True)["rows"]
        scanned = max(r["value"] for r in rows if r["metric"] == "numOutputRows")
        return spark.createDataFrame([(scanned, any("Aggregate" in r["node"] for r in rows))], "scanned long, aggregates boolean")
    plan = _gateway(spark, sf_dir, sql).read_query("EXPLAIN FORMATTED " + sql)["rows"][0]["plan"]
    return spark.createDataFrame([(w, w in plan) for w in ("Scan parquet", "HashAggregate", "Sort", "l_returnflag", "l_comment")], "word string, there boolean")


def _write_rows(spark: SparkSession, sf_dir: str, statements: tuple[str, ...]) -> DataFrame:
    """A copy of nation after row-level writes, and how many rows each changed."""
    sources.register_tables(spark, "gneiss_scratch", sf_dir, ("nation",))
    gateway = Gateway(spark, GatewayConfig(query_timeout=0, read_only=False))
    gateway.write_query("DROP TABLE IF EXISTS gneiss_scratch.held")
    done = [gateway.write_query("CREATE TABLE gneiss_scratch.held USING parquet AS SELECT * FROM gneiss_scratch.nation")]
    done += [gateway.write_query(s) for s in statements]
    changed = ",".join(str(d.get("affected")) for d in done)
    return gateway.frame("SELECT n_nationkey, n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM gneiss_scratch.held")[0].withColumn("changed", F.lit(changed))


_UPDATES = ("UPDATE gneiss_scratch.held SET n_name = concat(n_name, '!'), n_regionkey = n_regionkey + 10 WHERE n_regionkey = 1 AND n_name <> 'none'", "UPDATE gneiss_scratch.held SET n_regionkey = 99 WHERE n_nationkey < 0")
_DELETES = ("DELETE FROM gneiss_scratch.held WHERE n_regionkey IN (SELECT r_regionkey FROM gneiss_scratch.held JOIN gneiss_scratch.regions ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%')", "INSERT INTO gneiss_scratch.held VALUES (100, 'NEW', NULL), (101, 'OLD', 1)", "DELETE FROM gneiss_scratch.held WHERE n_regionkey <> 2 AND n_nationkey >= 100")


def _write_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources.register_tables(spark, "gneiss_scratch", sf_dir, ("region",))
    spark.sql("CREATE OR REPLACE VIEW gneiss_scratch.regions AS SELECT * FROM gneiss_scratch.region")
    return _write_rows(spark, sf_dir, _DELETES)


def _fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First cells, first columns and rows of statements."""
    frame = lambda sql: _read(spark, sf_dir, sql)
    cell = encode.first_cell(frame("SELECT max(o_orderkey) AS k, 1 AS x FROM orders"))
    none = encode.first_cell(frame("SELECT o_orderkey FROM orders WHERE o_orderkey < 0"))
    names = encode.first_column(frame("SELECT r_name, r_regionkey FROM region ORDER BY r_regionkey"))
    return spark.createDataFrame([(cell, none is None, ",".join(names), len(encode.rows(frame("SELECT * FROM nation"))))], "cell long, none boolean, names string, n int")


def _constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a table's properties declare, out of the detailed listing."""
    gateway = _demo(spark, sf_dir)
    keys = [{"name": "pk", "type": "PRIMARY KEY", "columns": ["n_nationkey"]}, {"name": "fk", "type": "FOREIGN KEY", "columns": ["n_regionkey"], "referencedTable": "region", "referencedColumns": ["r_regionkey"]}]
    gateway.write_query(f"ALTER TABLE nation SET TBLPROPERTIES ('{catalog.CONSTRAINTS}'={quote_literal(json.dumps(keys))})", "gneiss_demo")
    found = gateway.list_tables("gneiss_demo", search="nation", detailed=True)["tables"]
    return spark.createDataFrame([(t, c["name"], c["type"], ",".join(c["columns"]), c["referencedTable"]) for t, meta in found.items() for c in meta["constraints"]], "table string, name string, type string, columns string, referenced string")


def _demo(spark: SparkSession, sf_dir: str) -> Gateway:
    sources.register_tables(spark, "gneiss_demo", sf_dir, _LISTED)
    spark.sql("CREATE OR REPLACE VIEW gneiss_demo.big_orders AS SELECT o_orderkey FROM gneiss_demo.orders WHERE o_totalprice > 100000")
    spark.sql("CREATE OR REPLACE FUNCTION gneiss_demo.double_it(n INT) RETURNS INT RETURN n + n")
    return Gateway(spark, GatewayConfig(query_timeout=0, read_only=False))


def _named(frame: DataFrame, column: str) -> DataFrame:
    return frame.select(F.col("name").alias(column))


def _list_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    _demo(spark, sf_dir)
    return _named(catalog.databases(spark).where(F.col("name") == "gneiss_demo"), "database")


def _list_tables(spark: SparkSession, sf_dir: str, search: str | None = None) -> DataFrame:
    _demo(spark, sf_dir)
    found = [r["name"] for r in catalog.tables(spark, "gneiss_demo", search).collect()]
    return spark.createDataFrame([(n, catalog.kind(spark, "gneiss_demo", n)) for n in found], "table string, kind string")


def _list_tables_detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _demo(spark, sf_dir).list_tables("gneiss_demo", detailed=True)["tables"]
    rows = [(t, c["name"], c["ordinalPosition"], c["dataType"]) for t, meta in found.items() for c in meta["columns"]]
    return spark.createDataFrame(rows, "table string, column string, position int, type string")


def _list_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    _demo(spark, sf_dir)
    return _named(catalog.views(spark, "gneiss_demo"), "view")


def _list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _demo(spark, sf_dir)
    return _named(catalog.functions(spark, "gneiss_demo"), "function")


def _list_materialized_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    _demo(spark, sf_dir).create_materialized_view("mv_regions", "SELECT r_regionkey, r_name FROM gneiss_demo.region", "gneiss_demo")
    return _named(catalog.materialized_views(spark, "gneiss_demo"), "materialized_view")


def _list_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(catalog.triggers(spark, "default"), "trigger")


def _list_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(catalog.procedures(spark, "default"), "procedure")


def _row_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through the gateway's encoder."""
    sql = "SELECT r_regionkey AS k, r_name AS name, CAST(NULL AS INT) AS nothing, r_regionkey = 1 AS flag, DATE'2026-04-20' AS d, TIMESTAMP_NTZ'2026-04-20 14:30:00' AS t, unhex('00ff') AS b FROM region"
    rows = encode.rows(_read(spark, sf_dir, sql))
    return spark.createDataFrame([(r["k"], json.dumps(r, separators=(",", ":"))) for r in rows], "k int, j string")


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gateway, rows = _gateway(spark, sf_dir), []
    for sql, _ in _STATEMENTS:
        sql = sql.replace("''", "'")
        try:
            said = gateway.gate.classify(sql).value
        except SqlError as e:
            said = type(e).__name__
        rows.append((sql, said))
    return spark.createDataFrame(rows, "statement string, verdict string")


def _idents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ok(name: str) -> bool:
        try:
            return validate_ident(name) == name
        except SqlError:
            return False

    return spark.createDataFrame([(n, ok(n)) for n, _ in _IDENTS], "name string, valid boolean")


def _cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, Cursor.decode(Cursor(n).encode()).offset) for n in _OFFSETS], "given long, back long")


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the explain tool's plan of a statement has."""
    plan = _gateway(spark, sf_dir, READS["read_group_by"]).explain_query(READS["read_group_by"])["rows"][0]["plan"]
    return spark.createDataFrame([(w, w in plan) for w in ("Physical Plan", "Exchange", "l_quantity", "l_tax")], "word string, there boolean")


def _explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gateway(spark, sf_dir, READS["read_group_by"]).explain_query(READS["read_group_by"], analyze=True)["rows"]
    return spark.createDataFrame([(r["depth"], r["node"], r["metric"], r["value"]) for r in rows], "depth int, node string, metric string, value long")


def _write_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources.register_tables(spark, "gneiss_scratch", sf_dir, ("region",))
    gateway = Gateway(spark, GatewayConfig(query_timeout=0, read_only=False))
    gateway.write_query("DROP TABLE IF EXISTS gneiss_scratch.copied")
    gateway.write_query("CREATE TABLE gneiss_scratch.copied (k INT, name STRING) USING parquet")
    gateway.write_query("INSERT INTO gneiss_scratch.copied SELECT r_regionkey, r_name FROM gneiss_scratch.region")
    gateway.write_query("INSERT INTO gneiss_scratch.copied VALUES (100, 'extra')")
    return gateway.frame("SELECT k, name FROM gneiss_scratch.copied")[0]


def _create_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    gateway = _demo(spark, sf_dir)
    spark.sql("DROP DATABASE IF EXISTS gneiss_canary CASCADE")
    said = [gateway.create_database("gneiss_canary")["message"]]
    gateway.write_query("CREATE TABLE t (a INT) USING parquet", "gneiss_canary")
    said += [gateway.drop_table("t", "gneiss_canary", cascade=True)["message"], gateway.drop_database("gneiss_canary")["message"]]
    return spark.createDataFrame(list(enumerate(said)), "step int, message string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {name: partial(_read, sql=sql if isinstance(sql, str) else sql[0]) for name, sql in READS.items()}
    out |= {
        "page_first": partial(_page, sql=_ORDERED, offset=0),
        "page_middle": partial(_page, sql=_ORDERED, offset=3000),
        "page_last_short": partial(_page, sql=_NATIONS, offset=20, size=10),
        "page_off_end": partial(_page, sql=_NATIONS, offset=1000),
        "page_walk_all": _page_walk_all,
        "page_comment": partial(_page, sql=_NATIONS + "; -- all of them", offset=5, size=10),
        "page_inner_limit": partial(_page, sql=_TOP, offset=30, size=20),
        **{name: partial(_bound, sql=sql, args=args) for name, (sql, args, _) in BOUND.items()},
        "errors": _errors,
        "quoting": _quoting,
        "databases_of_requests": _databases_of_requests,
        "settings": _settings,
        "tools": _tools,
        "show_tables": partial(_statement, sql="SHOW TABLES", keys=("tableName",), where="tableName in ('nation', 'region', 'big_orders')"),
        "show_databases": partial(_statement, sql="SHOW DATABASES LIKE 'gneiss_demo'", keys=("namespace",)),
        "show_columns": partial(_statement, sql="SHOW COLUMNS IN nation", keys=("col_name",)),
        "describe_table": partial(_statement, sql="DESCRIBE nation", keys=("col_name", "data_type")),
        "use_database": _use,
        "server_version": _version,
        "explain_read": _explain_nodes,
        "explain_measured": partial(_explain_nodes, analyze=True),
        "write_update": partial(_write_rows, statements=_UPDATES),
        "write_delete": _write_delete,
        "fetch": _fetch,
        "declared_constraints": _constraints,
        "list_databases": _list_databases,
        "list_tables": _list_tables,
        "list_tables_search": partial(_list_tables, search="ON"),
        "list_tables_detailed_columns": _list_tables_detailed,
        "list_views": _list_views,
        "list_functions": _list_functions,
        "list_procedures": _list_procedures,
        "list_triggers": _list_triggers,
        "list_materialized_views": _list_materialized_views,
        "row_to_json": _row_to_json,
        "gate_classification": _gate,
        "ident_validation": _idents,
        "cursor_codec": _cursors,
        "explain_plan": _explain,
        "explain_analyze": _explain_analyze,
        "write_insert_readback": _write_readback,
        "create_drop_database": _create_drop,
    }
    return out


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\t", "' || chr(9) || '") + "'"
        return str(v).lower() if isinstance(v, bool) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def oracle_sql() -> dict[str, str]:
    out = {name: sql if isinstance(sql, str) else sql[1] for name, sql in READS.items()}
    listed = [(t, "TABLE") for t in _LISTED]
    names = ", ".join(f"'{t}'" for t in _LISTED)
    out |= {
        "page_first": f"SELECT * FROM ({_ORDERED}) LIMIT 100 OFFSET 0",
        "page_middle": f"SELECT * FROM ({_ORDERED}) LIMIT 100 OFFSET 3000",
        "page_last_short": f"SELECT * FROM ({_NATIONS}) LIMIT 10 OFFSET 20",
        "page_off_end": f"SELECT * FROM ({_NATIONS}) LIMIT 100 OFFSET 1000",
        "page_walk_all": _CUSTOMERS,
        "page_comment": f"SELECT * FROM ({_NATIONS}) LIMIT 10 OFFSET 5",
        "page_inner_limit": f"SELECT * FROM ({_TOP}) LIMIT 20 OFFSET 30",
        **{name: sql for name, (_, _, sql) in BOUND.items()},
        "errors": _values(list(_TOLD.items()), "call, told"),
        "quoting": _values([(n.replace("'", "''"),) * 2 for n in _QUOTED], "name, text"),
        "databases_of_requests": _values([("", "default"), ("  ", "default"), ("gneiss_scratch", "gneiss_scratch"), (" gneiss_scratch ", "gneiss_scratch"), ("kept", "1")], "given, used"),
        "settings": _values([("good", 0), ("page of 0", 1), ("page of 501", 1), ("three", 3), ("secrets shown", 0)], "setting, problems"),
        "tools": _values(_TOOLS, "tool, reads, destroys, in_read_only, called"),
        "show_tables": "SELECT unnest(['big_orders', 'nation', 'region']) AS tableName",
        "show_databases": "SELECT 'gneiss_demo' AS namespace",
        "show_columns": "SELECT column_name AS col_name FROM information_schema.columns WHERE table_name = 'nation'",
        "describe_table": "SELECT column_name AS col_name, CASE data_type WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS data_type FROM information_schema.columns WHERE table_name = 'nation'",
        "use_database": "SELECT 0 AS n, true AS stayed",
        "server_version": "SELECT regexp_matches('1.2.3', '^[0-9]+[.][0-9]+[.][0-9]+') AS told",
        "explain_plan": _values([("Physical Plan", True), ("Exchange", True), ("l_quantity", True), ("l_tax", False)], "word, there"),
        "explain_read": _values([("Scan parquet", True), ("HashAggregate", True), ("Sort", True), ("l_returnflag", True), ("l_comment", False)], "word, there"),
        "explain_measured": "SELECT count(*) AS scanned, true AS aggregates FROM lineitem",
        "write_update": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey + CASE WHEN n_regionkey = 1 THEN 10 ELSE 0 END AS n_regionkey, (SELECT 'None,' || sum((n_regionkey = 1)::int) || ',0' FROM nation) AS changed FROM nation",
        "write_delete": "SELECT *, (SELECT 'None,' || sum((r_name LIKE 'A%')::int) || ',2,1' FROM nation JOIN region ON r_regionkey = n_regionkey) AS changed FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') UNION ALL SELECT 100, 'NEW', -1)",
        "fetch": "SELECT (SELECT max(o_orderkey) FROM orders) AS cell, true AS none, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS names, (SELECT count(*) FROM nation) AS n",
        "declared_constraints": "SELECT * FROM (VALUES ('nation', 'pk', 'PRIMARY KEY', 'n_nationkey', NULL), ('nation', 'fk', 'FOREIGN KEY', 'n_regionkey', 'region')) AS t(\"table\", name, type, columns, referenced)",
        "list_databases": "SELECT 'gneiss_demo' AS database",
        "list_tables": _values(listed, '"table", kind'),
        "list_tables_search": _values([("nation", "TABLE"), ("region", "TABLE")], '"table", kind'),
        "list_tables_detailed_columns": f"""SELECT table_name AS "table", column_name AS "column", cast(ordinal_position AS int) AS position,
            CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type
            FROM information_schema.columns WHERE table_name IN ({names})""",
        "list_views": "SELECT 'big_orders' AS \"view\"",
        "list_functions": "SELECT 'double_it' AS \"function\"",
        "list_procedures": "SELECT '' AS \"procedure\" WHERE false",
        "list_triggers": "SELECT '' AS \"trigger\" WHERE false",
        "list_materialized_views": "SELECT 'mv_regions' AS materialized_view",
        "row_to_json": """SELECT r_regionkey AS k, '{"k":' || r_regionkey || ',"name":"' || r_name || '","nothing":null,"flag":' || (r_regionkey = 1) || ',"d":"2026-04-20","t":"2026-04-20T14:30:00","b":"AP8="}' AS j FROM region""",
        "gate_classification": _values(_STATEMENTS, "statement, verdict"),
        "ident_validation": _values(_IDENTS, "name, valid"),
        "cursor_codec": "SELECT cast(n AS bigint) AS given, cast(n AS bigint) AS back FROM (VALUES " + ", ".join(f"({n})" for n in _OFFSETS) + ") AS t(n)",
        "write_insert_readback": "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 100, 'extra'",
        "create_drop_database": _values([(0, "created database gneiss_canary"), (1, "dropped table t"), (2, "dropped database gneiss_canary and all in it")], "step, message"),
    }
    return out
