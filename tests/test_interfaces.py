import json
import socket

import pytest

from tessera import dbapi
from tessera.client import ServerError, connect
from tessera.repl import Shell
from tessera.server import Server


@pytest.fixture
def driver(spark):
    c = dbapi.connect(spark=spark)
    c.execute("CREATE TABLE reading (at INT PRIMARY KEY, sensor TEXT, level FLOAT)")
    c.cursor().executemany("INSERT INTO reading VALUES (?, ?, ?)", [(10 * k, "ab"[k % 2], k / 4) for k in range(9)])
    c.commit()
    yield c
    c.close()


def test_globals_and_tree():
    assert (dbapi.apilevel, dbapi.threadsafety, dbapi.paramstyle) == ("2.0", 1, "qmark")
    under = {e.__name__: e.__mro__[1].__name__ for e in (dbapi.InterfaceError, dbapi.DatabaseError, dbapi.DataError, dbapi.OperationalError, dbapi.IntegrityError, dbapi.InternalError, dbapi.ProgrammingError, dbapi.NotSupportedError)}
    assert set(under.values()) == {"Error", "DatabaseError"} and under["InterfaceError"] == under["DatabaseError"] == "Error"


@pytest.mark.parametrize("held", [2, 10_000])
def test_fetching(driver, held, monkeypatch):
    monkeypatch.setattr(dbapi, "HELD", held)
    cursor = driver.cursor().execute("SELECT at, level FROM reading WHERE sensor = 'a'")
    assert [d[0] for d in cursor.description] == ["at", "level"] and cursor.rowcount == (5 if held > 5 else -1)
    assert cursor.fetchone() == (0, 0.0) and cursor.fetchmany() == [(20, 0.5)] and cursor.fetchmany(2) == [(40, 1.0), (60, 1.5)]
    assert list(cursor) == [(80, 2.0)] and cursor.fetchone() is None and cursor.fetchall() == []
    assert [r[0] for r in driver.execute("SELECT at FROM reading ORDER BY level DESC LIMIT 3")] == [80, 70, 60]
    cursor.close()
    with pytest.raises(dbapi.ProgrammingError):
        cursor.fetchone()


def test_errors_and_rollback(driver):
    assert driver.execute("UPDATE reading SET level = NULL WHERE sensor = ?", ("b",)).rowcount == 4
    for sql, kind in (
        ("INSERT INTO reading VALUES (10, 'c', 1)", dbapi.IntegrityError), ("INSERT INTO reading (sensor) VALUES ('c')", dbapi.IntegrityError), ("SELECT at reading", dbapi.ProgrammingError),
        ("SELECT volume FROM reading", dbapi.ProgrammingError), ("UPDATE reading SET level = 'high'", dbapi.DatabaseError),
    ):
        with pytest.raises(kind):
            driver.execute(sql)
    driver.rollback()
    assert driver.execute("SELECT COUNT(level) FROM reading").fetchone() == (9,)


def test_a_context_commits_or_takes_back(spark, tmp_path):
    where = str(tmp_path / "store")
    with dbapi.connect(where, spark=spark) as c:
        c.execute("CREATE TABLE jar (k INT PRIMARY KEY, jam TEXT)")
        c.execute("INSERT INTO jar VALUES (?, ?)", (5, "plum"))
    with pytest.raises(ZeroDivisionError), dbapi.connect(where, spark=spark) as c:
        c.execute("DELETE FROM jar")
        c.execute("INSERT INTO jar VALUES (?, ?)", (6, str(1 // 0)))
    with dbapi.connect(where, spark=spark) as c:
        assert c.execute("SELECT * FROM jar").fetchall() == [(5, "plum")]


@pytest.fixture
def server(spark, tmp_path):
    with Server(str(tmp_path / "served"), port=0, spark=spark) as s:
        yield s


def test_sessions_have_their_own_transactions(server):
    with connect(port=server.port) as left, connect(port=server.port) as right:
        assert left.execute("CREATE TABLE stock (item INT PRIMARY KEY, n INT)") == {"ok": True, "kind": "ddl", "rowcount": -1, "message": "CREATE TABLE stock"}
        assert left.execute("INSERT INTO stock VALUES (1, 10), (2, 20)")["rowcount"] == 2
        left.execute("BEGIN")
        left.execute("UPDATE stock SET n = 11 WHERE item = ?", [1])
        assert left.rows("SELECT n FROM stock") == [[11], [20]] and right.rows("SELECT n FROM stock") == [[10], [20]]
        right.execute("BEGIN")
        right.execute("DELETE FROM stock WHERE item = 2")
        assert left.execute("COMMIT")["message"] == "COMMIT"
        with pytest.raises(ServerError, match="conflict"):
            right.execute("COMMIT")
        for sql in ("ROLLBACK", "SELECT n FROM", "SELECT m FROM stock"):
            with pytest.raises(ServerError):
                right.execute(sql)
        right.execute("BEGIN")
        right.execute("DELETE FROM stock")
    with connect(port=server.port) as later:  # right's transaction has gone with it
        assert later.execute("SELECT * FROM stock")["rows"] == [[1, 11], [2, 20]]


def test_lines_that_are_no_requests(server):
    with socket.create_connection((server.host, server.port)) as s, s.makefile("rwb") as wire:
        for line in (b"{", b"[1]", b'{"params": [1]}', b'{"sql": 5}', b'{"sql": ""}'):
            wire.write(line + b"\n\n")
            wire.flush()
            answer = json.loads(wire.readline())
            assert answer["ok"] is False and answer["error"]


def test_shell(db):
    said = []
    sh = Shell(db, said.append)
    sh.session(["-- a note;", "CREATE TABLE kit (k INT PRIMARY KEY,", "note TEXT NOT NULL, w FLOAT);", "INSERT INTO kit VALUES (1, 'a;b', 0.5); INSERT INTO kit VALUES (2, '-- c', NULL);", "SELECT * FROM kit;"])
    assert [x.split(" [")[0] for x in said[:3]] == ["CREATE TABLE kit", "INSERT 1", "INSERT 1"]
    assert said[3].split("\n")[:4] == ["k | note | w   ", "--+------+-----", "1 | a;b  | 0.5 ", "2 | -- c | NULL"] and said[3].split("\n")[4].startswith("2 rows [")
    said.clear()
    sh.session([".schema kit", ".schema none", ".TABLES", ".what", "DELETE FROM kit WHERE;", "SELECT k FROM kit WHERE k > 5;", "", ".help", ".exit", "DROP TABLE kit;"])
    assert said[:2] == ["CREATE TABLE kit (k INT PRIMARY KEY, note TEXT NOT NULL, w FLOAT);", "kit"] and said[2].startswith("no command .what")
    assert said[3].startswith("! ParseError") and said[4].startswith("0 rows [") and ".schema" in said[5] and len(said) == 6 and sh.over and list(db.tables()) == ["kit"]
