"""Queries of what isn't a SELECT: definitions, changes, transactions, constraints, indexes, storage and interfaces.

Each builds a database of whole test tables, runs statements through the engine, and returns what a reader then
finds, or the outcome of each statement, as a DataFrame with a DuckDB counterpart.
"""

from __future__ import annotations

import atexit
import io
import json
import os
import shutil
import socket
import tempfile
from collections.abc import Callable
from contextlib import redirect_stdout

from pyspark.sql import DataFrame, SparkSession

from tessera import dbapi
from tessera.client import ServerError, connect
from tessera.database import Database
from tessera.errors import SqlError
from tessera.plans.grammar import parse
from tessera.repl import Shell, text_table
from tessera.server import Server

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Keys and columns of the test tables that the scenarios load; all rows of each.
LOADED = {
    "region": ("r_regionkey", ("r_regionkey", "r_name")),
    "nation": ("n_nationkey", ("n_nationkey", "n_name", "n_regionkey")),
    "customer": ("c_custkey", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "orders": ("o_orderkey", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")),
    "labels": ("doc_id", ("doc_id", "quality", "toxic")),
    "documents": ("doc_id", ("doc_id", "text")),
}


def scenario(sql: str):
    """Registers a function of (database, reader of test tables) under its name with its counterpart."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(made(spark), Tables(spark, sf_dir))

        QUERIES[fn.__name__], ORACLE[fn.__name__] = run, sql
        return fn

    return register


def made(spark: SparkSession, path: str = ":memory:") -> Database:
    """A database that lives as long as this process, since what is returned is read later."""
    db = Database(path, spark=spark)
    atexit.register(db.close)
    return db


def folder() -> str:
    path = tempfile.mkdtemp(prefix="tessera-scenario-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def load(self, db: Database, *names: str) -> Database:
        for name in names:
            pk, columns = LOADED[name]
            db.load(name, db.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").select(*columns), pk)
        return db

    def frame(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in rows], schema)

    def outcomes(self, db: Database, statements: list) -> DataFrame:
        """The message of each statement, or the kind of its error."""
        rows = []
        for k, s in enumerate(statements):
            sql, params = (s, ()) if isinstance(s, str) else s
            try:
                rows.append((k, db.execute(sql, params).message))
            except SqlError as e:
                rows.append((k, type(e).__name__))
        return self.frame(rows, "step int, outcome string")


def values(names: str, *rows: tuple) -> str:
    shown = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({names})"


def steps(*outcomes: str) -> str:
    return values("step, outcome", *enumerate(outcomes))


# -- definitions -----------------------------------------------------------------


@scenario(values("tbl, col, kind, rule", ("depot", "code", "INT", "key"), ("depot", "town", "TEXT", "filled"), ("depot", "load", "FLOAT", "")))
def create_table(db: Database, t: Tables) -> DataFrame:
    db.execute("CREATE TABLE depot (code INT PRIMARY KEY, town TEXT NOT NULL, load FLOAT)")
    rows = [(v.name, c, k, "key" if c == v.pk else "filled" if c in v.not_null else "") for v in db.tables().values() for c, k in v.columns]
    return t.frame(rows, "tbl string, col string, kind string, rule string")


@scenario("SELECT * FROM (SELECT 'nation' AS tbl, count(*) AS n FROM nation)")
def drop_table(db: Database, t: Tables) -> DataFrame:
    t.load(db, "region", "nation").execute("DROP TABLE region")
    return t.frame([(name, db.execute(f"SELECT COUNT(*) FROM {name}").rows[0][0]) for name in db.tables()], "tbl string, n long")


@scenario(values("step, line", (0, "Seq Scan on customer  [filter]"), (1, "Index Scan on seg (c_mktsegment = 'BUILDING')"), (2, "Index Scan on seg (c_mktsegment >= 'M')"), (3, "Seq Scan on customer  [filter]")))
def create_and_drop_index(db: Database, t: Tables) -> DataFrame:
    t.load(db, "customer")
    asked = "EXPLAIN SELECT * FROM customer WHERE c_mktsegment"
    lines = [db.execute(f"{asked} = 'BUILDING'").rows[0][0]]
    db.execute("CREATE INDEX seg ON customer(c_mktsegment, c_acctbal)")
    lines += [db.execute(f"{asked} {x}").rows[0][0] for x in ("= 'BUILDING'", ">= 'M'")]
    db.execute("DROP INDEX seg")
    lines.append(db.execute(f"{asked} = 'BUILDING'").rows[0][0])
    return t.frame(list(enumerate(lines)), "step int, line string")


@scenario("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_scan_eq(db: Database, t: Tables) -> DataFrame:
    t.load(db, "customer").execute("CREATE INDEX seg ON customer(c_mktsegment)")
    return db.sql("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")


@scenario("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 2500 AND c_acctbal <= 4000")
def index_scan_range(db: Database, t: Tables) -> DataFrame:
    t.load(db, "customer").execute("CREATE INDEX bal ON customer(c_acctbal)")
    return db.sql("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 2500 AND c_acctbal <= 4000")


# -- changes ----------------------------------------------------------------------


@scenario("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (90, 'ARCTIC'), (91, 'OCEAN'), (92, NULL)) t(a, b)")
def insert_rows(db: Database, t: Tables) -> DataFrame:
    t.load(db, "region").execute("INSERT INTO region VALUES (91, 'OCEAN'), (90, 'ARCTIC')")
    db.execute("INSERT INTO region (r_regionkey) VALUES (92)")
    return db.sql("SELECT * FROM region")


@scenario("SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, CASE WHEN c_acctbal < 0 THEN 'IN DEBT' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey = 7 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(db: Database, t: Tables) -> DataFrame:
    t.load(db, "customer").execute("UPDATE customer SET c_mktsegment = 'IN DEBT' WHERE c_acctbal < 0")
    db.execute("UPDATE customer SET c_acctbal = 1.5 WHERE c_custkey = 7")
    return db.sql("SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer")


@scenario("SELECT o_orderkey, 0::BIGINT AS o_custkey, o_totalprice FROM orders")
def update_every_row(db: Database, t: Tables) -> DataFrame:
    t.load(db, "orders").execute("UPDATE orders SET o_custkey = 0")
    return db.sql("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")


@scenario("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 100000) AND o_orderkey <> 3")
def delete_rows(db: Database, t: Tables) -> DataFrame:
    t.load(db, "orders").execute("DELETE FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
    db.execute("DELETE FROM orders WHERE o_orderkey = 3")
    return db.sql("SELECT o_orderkey, o_orderstatus FROM orders")


@scenario("SELECT doc_id FROM labels WHERE FALSE")
def delete_every_row(db: Database, t: Tables) -> DataFrame:
    t.load(db, "labels").execute("DELETE FROM labels")
    return db.sql("SELECT doc_id FROM labels")


@scenario("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN 'A;B -- C' ELSE n_name END AS n_name FROM nation WHERE n_regionkey <> 1")
def script(db: Database, t: Tables) -> DataFrame:
    t.load(db, "nation").executescript("BEGIN; -- one; two\nUPDATE nation SET n_name = 'A;B -- C' WHERE n_regionkey = 2;\nDELETE FROM nation WHERE n_regionkey = 1; COMMIT; -- end;")
    return db.sql("SELECT n_nationkey, n_name FROM nation")


# -- transactions -------------------------------------------------------------------


@scenario("SELECT doc_id, quality::BIGINT AS quality, (1 - toxic)::BIGINT AS toxic FROM labels WHERE quality = 1")
def txn_commit(db: Database, t: Tables) -> DataFrame:
    t.load(db, "labels")
    for sql in ("BEGIN", "UPDATE labels SET toxic = 2 WHERE toxic = 0", "UPDATE labels SET toxic = 0 WHERE toxic = 1", "UPDATE labels SET toxic = 1 WHERE toxic = 2", "DELETE FROM labels WHERE quality = 0", "COMMIT"):
        db.execute(sql)
    return db.sql("SELECT doc_id, quality, toxic FROM labels")


@scenario("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def txn_rollback(db: Database, t: Tables) -> DataFrame:
    t.load(db, "nation", "region")
    for sql in ("BEGIN", "DELETE FROM nation WHERE n_regionkey > 1", "DROP TABLE region", "CREATE TABLE extra (k INT PRIMARY KEY)", "UPDATE nation SET n_name = 'gone'", "ROLLBACK"):
        db.execute(sql)
    assert list(db.tables()) == ["nation", "region"]
    return db.sql("SELECT * FROM nation")


@scenario("SELECT * FROM (SELECT 'inside' AS seen, count(*) FILTER (r_regionkey >= 3) + 1 AS n FROM region UNION ALL SELECT 'after', count(*) FROM region)")
def txn_own_writes(db: Database, t: Tables) -> DataFrame:
    t.load(db, "region")
    for sql in ("BEGIN", "DELETE FROM region WHERE r_regionkey < 3", "INSERT INTO region VALUES (50, 'X')"):
        db.execute(sql)
    inside = db.execute("SELECT COUNT(*) FROM region").rows[0][0]
    db.execute("ROLLBACK")
    return t.frame([("inside", inside), ("after", db.execute("SELECT COUNT(*) FROM region").rows[0][0])], "seen string, n long")


@scenario("SELECT 'reader' AS who, r_regionkey::BIGINT AS k, r_name AS name FROM region UNION ALL SELECT 'newest', r_regionkey, upper('moved') FROM region WHERE r_regionkey > 1")
def txn_snapshot_isolation(db: Database, t: Tables) -> DataFrame:
    t.load(db, "region")
    reader = db.begin()
    db.execute("UPDATE region SET r_name = 'MOVED'")
    db.execute("DELETE FROM region WHERE r_regionkey <= 1")
    db.vacuum()
    asked = parse("SELECT r_regionkey, r_name FROM region")
    rows = [("reader", *r) for r in db.run(asked, reader).rows] + [("newest", *r) for r in db.run(asked, db.begin()).rows]
    return t.frame(rows, "who string, k long, name string")


@scenario(values("step, outcome", (0, "INSERT 1"), (1, "TransactionError"), (2, "INSERT 1"), (3, "7")))
def txn_write_conflict(db: Database, t: Tables) -> DataFrame:
    """A commit on an old snapshot is refused; run again on a new one it succeeds, in another handle too."""
    path = folder()
    one, two = t.load(made(t.spark, path), "region"), made(t.spark, path)
    two.execute("BEGIN")
    two.execute("INSERT INTO region VALUES (71, 'two')")
    said = [one.execute("INSERT INTO region VALUES (70, 'one')").message]
    try:
        two.execute("COMMIT")
    except SqlError as e:
        said.append(type(e).__name__)
    said.append(two.execute("INSERT INTO region VALUES (71, 'two')").message)
    said.append(str(one.execute("SELECT COUNT(*) FROM region").rows[0][0]))
    return t.frame(list(enumerate(said)), "step int, outcome string")


@scenario(steps("INSERT 1", "ConstraintError", "ConstraintError", "TransactionError", "TransactionError", "BEGIN", "TransactionError", "ROLLBACK"))
def txn_autocommit(db: Database, t: Tables) -> DataFrame:
    t.load(db, "region")
    return t.outcomes(db, ["INSERT INTO region VALUES (60, 'kept')", "INSERT INTO region VALUES (61, 'lost'), (60, 'twice')", "INSERT INTO region VALUES (60, 'twice')", "COMMIT", "ROLLBACK", "BEGIN", "BEGIN", "ROLLBACK"])


@scenario(values("what, n", ("commits", 0), ("records", 0)))
def txn_read_only_commit(db: Database, t: Tables) -> DataFrame:
    t.load(db, "nation")
    before = db.store.commits, len(os.listdir(db.store.log))
    for sql in ("BEGIN", "SELECT COUNT(*) FROM nation", "DELETE FROM nation WHERE n_nationkey < 0", "COMMIT"):
        db.execute(sql)
    return t.frame([("commits", db.store.commits - before[0]), ("records", len(os.listdir(db.store.log)) - before[1])], "what string, n int")


# -- constraints and analysis ----------------------------------------------------------


@scenario(steps("ConstraintError", "ConstraintError", "INSERT 1", "ConstraintError"))
def primary_key_is_unique(db: Database, t: Tables) -> DataFrame:
    t.load(db, "nation")
    return t.outcomes(db, ["INSERT INTO nation VALUES (3, 'again', 1)", "INSERT INTO nation VALUES (95, 'a', 1), (95, 'b', 1)", "INSERT INTO nation VALUES (95, 'a', 1)", "INSERT INTO nation VALUES (95, 'b', 1)"])


@scenario(steps("CREATE TABLE m", "ConstraintError", "ConstraintError", "INSERT 1", "ConstraintError", "UPDATE 1"))
def not_null(db: Database, t: Tables) -> DataFrame:
    return t.outcomes(db, [
        "CREATE TABLE m (k INT PRIMARY KEY, a TEXT NOT NULL, b FLOAT)", "INSERT INTO m VALUES (NULL, 'a', 1.0)", "INSERT INTO m (k, b) VALUES (1, 1.0)",
        "INSERT INTO m (k, a) VALUES (1, 'x')", "UPDATE m SET a = NULL", "UPDATE m SET b = NULL",
    ])


@scenario(steps("ConstraintError", "CREATE INDEX uq", "ConstraintError", "INSERT 2", "ConstraintError", "ConstraintError", "DROP INDEX uq", "INSERT 1"))
def unique_index(db: Database, t: Tables) -> DataFrame:
    t.load(db, "nation")
    return t.outcomes(db, [
        "CREATE UNIQUE INDEX bad ON nation(n_regionkey)", "CREATE UNIQUE INDEX uq ON nation(n_name, n_regionkey)", ("INSERT INTO nation VALUES (96, ?, ?)", tuple(db.execute("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 4").rows[0])),
        "INSERT INTO nation VALUES (97, 'N', NULL), (98, 'N', NULL)", "UPDATE nation SET n_name = 'same', n_regionkey = 1", "UPDATE nation SET n_regionkey = 3, n_name = 'N' WHERE n_nationkey >= 97", "DROP INDEX uq",
        ("INSERT INTO nation VALUES (96, ?, ?)", tuple(db.execute("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey = 4").rows[0])),
    ])


@scenario(steps(*["ExecutionError"] * 11))
def names_must_exist(db: Database, t: Tables) -> DataFrame:
    """Keys can't be updated; tables, columns and indexes have to be there, once."""
    t.load(db, "nation")
    return t.outcomes(db, [
        "UPDATE nation SET n_nationkey = 99", "UPDATE nation SET nowhere = 1", "DELETE FROM nowhere", "SELECT nowhere FROM nation", "INSERT INTO nation (nowhere) VALUES (1)", "DROP TABLE nowhere",
        "DROP INDEX nowhere", "CREATE INDEX i ON nation(nowhere)", "CREATE TABLE nation (k INT PRIMARY KEY)", "SELECT other.n_name FROM nation", "CREATE TABLE z (k TEXT PRIMARY KEY)",
    ])


@scenario("SELECT k::BIGINT AS k, f::DOUBLE AS f, s FROM (VALUES (1, 2.0, 'x'), (2, 3.5, NULL)) t(k, f, s)")
def coercion(db: Database, t: Tables) -> DataFrame:
    db.execute("CREATE TABLE c (k INT PRIMARY KEY, f FLOAT, s TEXT)")
    refused = t.outcomes(db, ["INSERT INTO c VALUES ('1', 1, 'x')", "INSERT INTO c VALUES (1.5, 1, 'x')", "INSERT INTO c VALUES (1, 'x', 'x')", "INSERT INTO c VALUES (1, 1, 5)", "INSERT INTO c VALUES (1, TRUE, 'x')"])
    assert {r.outcome for r in refused.collect()} == {"TypeMismatch"}
    db.execute("INSERT INTO c VALUES (TRUE, 2, 'x'), (2.0, 3.5, NULL)")
    return db.sql("SELECT * FROM c")


@scenario(steps("ExecutionError", "ExecutionError", "ParseError", "ParseError", "INSERT 1", "ParseError"))
def arity(db: Database, t: Tables) -> DataFrame:
    """Of INSERT and of parameters."""
    t.load(db, "region")
    return t.outcomes(db, [
        "INSERT INTO region VALUES (80)", "INSERT INTO region (r_name) VALUES ('x', 81)", ("INSERT INTO region VALUES (?, ?)", (82,)), ("INSERT INTO region VALUES (?, ?)", (82, "x", 3)),
        ("INSERT INTO region VALUES (?, ?)", (82, "x")), ("SELECT * FROM region", (1,)),
    ])


@scenario("SELECT n_name FROM nation WHERE n_nationkey = 5 UNION ALL SELECT '''; DROP TABLE nation; --'")
def parameters_stay_values(db: Database, t: Tables) -> DataFrame:
    t.load(db, "nation").execute("INSERT INTO nation VALUES (?, ?, ?)", (94, "'; DROP TABLE nation; --", None))
    return db.sql("SELECT n_name FROM nation WHERE n_nationkey = ? OR n_name = ?", (5, "'; DROP TABLE nation; --"))


@scenario(steps(*["ExecutionError"] * 7, "ParseError"))
def grouping_rules(db: Database, t: Tables) -> DataFrame:
    t.load(db, "customer")
    return t.outcomes(db, [
        "SELECT c_name, COUNT(*) FROM customer GROUP BY c_nationkey", "SELECT * FROM customer GROUP BY c_custkey", "SELECT COUNT(*) FROM customer WHERE COUNT(*) > 1", "SELECT c_name FROM customer ORDER BY COUNT(*)",
        "SELECT COUNT(*) FROM customer ORDER BY c_name", "SELECT SUM(c_name) FROM customer", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING c_name = 'x'", "SELECT SUM(*) FROM customer",
    ])


# -- storage -----------------------------------------------------------------------------


@scenario("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def table_sink(db: Database, t: Tables) -> DataFrame:
    path = folder()
    with Database(path, spark=t.spark) as first:
        t.load(first, "orders")
    return made(t.spark, path).sql("SELECT * FROM orders")


@scenario("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT 40, 'kept'")
def recovery(db: Database, t: Tables) -> DataFrame:
    """A torn last record, an orphan folder and an open transaction count for nothing."""
    path = folder()
    first = t.load(made(t.spark, path), "region")
    first.execute("INSERT INTO region VALUES (40, 'kept')")
    first.execute("INSERT INTO region VALUES (41, 'torn')")
    first.execute("BEGIN")
    first.execute("INSERT INTO region VALUES (42, 'never committed')")
    os.truncate(os.path.join(path, "log", f"{first.store.current.seq:012d}.json"), 30)
    os.makedirs(os.path.join(path, "data", "region", "orphan"))
    again = made(t.spark, path)
    again.check()
    return again.sql("SELECT * FROM region")


@scenario(values("step, outcome", (0, "sound"), (1, "CorruptionError"), (2, "CorruptionError"), (3, "CorruptionError")))
def corruption(db: Database, t: Tables) -> DataFrame:
    """A flipped byte in a data file is told by check and by a scan; a damaged record amid the log by opening."""
    path = folder()
    first = t.load(made(t.spark, path), "customer")
    said = []

    def attempt(run) -> None:
        try:
            run()
            said.append("sound")
        except SqlError as e:
            said.append(type(e).__name__)

    attempt(first.check)
    listed = first.store.current.tables["customer"].folders[0]
    name = os.path.join(listed.path.removeprefix("file://"), listed.files[0][0])
    with open(name, "r+b") as f:
        f.seek(os.path.getsize(name) // 3)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 255]))
    attempt(first.check)
    attempt(lambda: first.execute("SELECT * FROM customer"))
    for k in range(2):
        first.execute(f"CREATE TABLE more{k} (k INT PRIMARY KEY)")
    os.truncate(os.path.join(path, "log", f"{first.store.current.seq - 1:012d}.json"), 9)
    attempt(lambda: Database(path, spark=t.spark))
    return t.frame(list(enumerate(said)), "step int, outcome string")


@scenario("SELECT * FROM (SELECT 'rows' AS what, count(*) AS n FROM customer UNION ALL SELECT 'removed', 1 UNION ALL SELECT 'folders', 1)")
def vacuum(db: Database, t: Tables) -> DataFrame:
    t.load(db, "customer").execute("UPDATE customer SET c_nationkey = 1")
    db.compact()
    before = db.store.current.tables["customer"]
    removed = db.vacuum()
    held = db.execute("SELECT COUNT(*) FROM customer").rows[0][0]
    return t.frame([("rows", held), ("removed", int(removed >= 1)), ("folders", len(before.folders))], "what string, n long")


@scenario("SELECT c_custkey, 2::BIGINT AS c_nationkey FROM customer")
def checkpoint(db: Database, t: Tables) -> DataFrame:
    """Log and deltas folded into one sorted folder; nothing is lost by reopening after old records are removed."""
    path = folder()
    first = t.load(made(t.spark, path), "customer")
    first.execute("UPDATE customer SET c_nationkey = 2")
    first.compact()
    first.vacuum()
    again = made(t.spark, path)
    assert not again.store.current.tables["customer"].delta
    return again.sql("SELECT c_custkey, c_nationkey FROM customer")


@scenario(values("what, n", ("hits", 1), ("misses", 1), ("commits", 1)))
def cache_stats(db: Database, t: Tables) -> DataFrame:
    t.load(db, "nation")
    before = db.cache_stats()
    for _ in range(2):
        db.execute("SELECT COUNT(*) FROM nation")
    db.execute("INSERT INTO nation VALUES (93, 'z', 1)")
    after = db.cache_stats()
    return t.frame([(k, int(after[k] > before[k])) for k in ("hits", "misses", "commits")], "what string, n int")


@scenario("SELECT doc_id, length(text) AS n, text FROM documents")
def large_values(db: Database, t: Tables) -> DataFrame:
    from pyspark.sql import functions as F

    t.load(db, "documents").compact()
    return db.sql("SELECT doc_id, text FROM documents").select("doc_id", F.length("text").cast("long").alias("n"), "text")


@scenario("SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400")
def key_order(db: Database, t: Tables) -> DataFrame:
    """A range of keys comes in order without a job, whatever was deleted and put back meanwhile."""
    t.load(db, "orders").execute("DELETE FROM orders WHERE o_orderkey = 200")
    row = db.spark.read.parquet(f"{t.sf_dir}/orders.parquet").where("o_orderkey = 200").select(*LOADED["orders"][1]).first()
    if row:
        db.execute("INSERT INTO orders VALUES (?, ?, ?, ?)", tuple(row))
    rows = db.execute("SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 400").rows
    return t.frame([(r[0], i) for i, r in enumerate(rows)], "k long, place long")


# -- interfaces ----------------------------------------------------------------------------


@scenario("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def cursor_fetch(db: Database, t: Tables) -> DataFrame:
    path = folder()
    t.load(made(t.spark, path), "nation")
    with dbapi.connect(path, spark=t.spark) as c:
        cursor = c.cursor().execute("SELECT n_nationkey, n_name FROM nation")
        assert [d[0] for d in cursor.description] == ["n_nationkey", "n_name"]
        rows = [cursor.fetchone(), *cursor.fetchmany(3), *(r for _, r in zip(range(2), cursor)), *cursor.fetchall()]
    return t.frame(rows, "k long, name string")


@scenario(values("step, outcome", (0, "2 rows"), (1, "IntegrityError"), (2, "ProgrammingError"), (3, "ProgrammingError"), (4, "DatabaseError"), (5, "0 rows"), (6, "ProgrammingError")))
def driver_connection(db: Database, t: Tables) -> DataFrame:
    """executemany, rollback, the exception tree, and use after close."""
    c = dbapi.connect(spark=t.spark)
    cursor = c.cursor()
    cursor.execute("CREATE TABLE w (k INT PRIMARY KEY, x FLOAT)")
    c.commit()
    said = [f"{cursor.executemany('INSERT INTO w VALUES (?, ?)', [(1, 1.0), (2, None)]).rowcount} rows"]
    for sql in ("INSERT INTO w VALUES (1, 2.0)", "SELEKT", "SELECT y FROM w", "INSERT INTO w VALUES ('a', 2.0)"):
        try:
            cursor.execute(sql)
        except dbapi.Error as e:
            said.append(type(e).__name__)
    c.rollback()
    said.append(f"{len(cursor.execute('SELECT * FROM w').fetchall())} rows")
    c.close()
    try:
        c.cursor()
    except dbapi.Error as e:
        said.append(type(e).__name__)
    return t.frame(list(enumerate(said)), "step int, outcome string")


@scenario("SELECT * FROM (SELECT 'inside' AS seen, count(*) + 1 AS n FROM region UNION ALL SELECT 'outside', count(*) FROM region UNION ALL SELECT 'left', count(*) FROM region UNION ALL SELECT 'refused', 1)")
def json_server(db: Database, t: Tables) -> DataFrame:
    """Two clients, one in a transaction that ends with its connection; a line that is no request."""
    path = folder()
    with Database(path, spark=t.spark) as first:
        t.load(first, "region")
    count, seen = "SELECT COUNT(*) FROM region", {}
    with Server(path, port=0, spark=t.spark) as server:
        with connect(port=server.port) as b:
            with connect(port=server.port) as a:
                a.execute("BEGIN")
                a.execute("INSERT INTO region VALUES (?, ?)", (30, "mine"))
                seen["inside"], seen["outside"] = a.rows(count)[0][0], b.rows(count)[0][0]
            seen["left"] = b.rows(count)[0][0]
            try:
                b.execute("COMMIT")
            except ServerError:
                seen["refused"] = 1
        with socket.create_connection((server.host, server.port)) as s, s.makefile("rwb") as wire:
            wire.write(b"{}\n")
            wire.flush()
            assert json.loads(wire.readline())["ok"] is False
    return t.frame(list(seen.items()), "seen string, n long")


@scenario("SELECT row_number() OVER (ORDER BY r_regionkey) + 1 AS line, rpad(r_regionkey::VARCHAR, 11, ' ') || ' | ' || rpad(r_name, greatest(6, (SELECT max(length(r_name)) FROM region))::INT, ' ') AS shown FROM region")
def text_output(db: Database, t: Tables) -> DataFrame:
    result = t.load(db, "region").execute("SELECT * FROM region")
    lines = text_table(result.columns, result.rows).split("\n")
    return t.frame([(i, line) for i, line in enumerate(lines) if i > 1], "line long, shown string")


@scenario(values("line, said", (0, "CREATE TABLE s"), (1, "INSERT 1"), (2, "k | a  "), (3, "--+----"), (4, "1 | x;y"), (5, "1 row"), (6, "s"), (7, "CREATE TABLE s (k INT PRIMARY KEY, a TEXT);"), (8, "! ParseError"), (9, "no command .nope")))
def shell(db: Database, t: Tables) -> DataFrame:
    """Statements over lines and several in one, a semicolon inside a string, commands, errors."""
    said = io.StringIO()
    with redirect_stdout(said):
        Shell(db).session(["CREATE TABLE s (k INT", "PRIMARY KEY, a TEXT); INSERT INTO s VALUES (1, 'x;y'); -- done;", "SELECT * FROM s;", ".tables", ".schema s", "SELECT;", ".nope", ".quit", "DROP TABLE s;"])
    lines = [line.split(" [")[0].split(": ")[0].split(";  there")[0].split("; there")[0] for line in said.getvalue().splitlines()]
    return t.frame(list(enumerate(lines)), "line int, said string")


@scenario(values("name", "tessera.repl:main".split(), "tessera.server:main".split()))
def entry_points(db: Database, t: Tables) -> DataFrame:
    from tessera import repl, server

    return t.frame([(f"{m.__name__}:{m.main.__name__}",) for m in (repl, server) if callable(m.main)], "name string")
