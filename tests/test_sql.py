"""Statements on a small harbour: ships, the ports they are registered in, and their calls."""

import random

import pytest

from tessera.errors import ConstraintError, ExecutionError, SqlError

SHIPS = [[4, "Alba", 1200.5, 2], [7, "Brig", None, 2], [9, "Corsa", 80.0, None], [12, "Alba", 300.0, 5]]


@pytest.fixture
def harbour(db):
    db.executescript("""
        CREATE TABLE ships (reg INT PRIMARY KEY, title TEXT NOT NULL, tons FLOAT, port INT);
        CREATE TABLE ports (code INT PRIMARY KEY, title TEXT, depth INT);
        CREATE TABLE calls (nr INT PRIMARY KEY, ship INT, port INT, days INT);
        INSERT INTO ships VALUES (12, 'Alba', 300, 5), (4, 'Alba', 1200.5, 2), (9, 'Corsa', 80.0, NULL);
        INSERT INTO ships (title, reg, port) VALUES ('Brig', 7, 2);
        INSERT INTO ports VALUES (2, 'Oran', 14), (5, 'Visby', 9), (8, NULL, 30);
        INSERT INTO calls VALUES (100, 4, 5, 3), (101, 4, 8, 1), (102, 12, 2, NULL), (103, 77, 2, 6), (104, 9, 2, 3)
    """)
    return db


def rows(db, sql, *params):
    return db.execute(sql, params).rows


def ids(db, sql, *params):
    return [r[0] for r in rows(db, sql, *params)]


def test_rows_come_in_key_order(harbour):
    found = harbour.execute("SELECT * FROM ships")
    assert found.columns == ["reg", "title", "tons", "port"] and found.rows == SHIPS
    assert ids(harbour, "SELECT ships.reg FROM ships WHERE tons >= 80 LIMIT 2") == [4, 9]
    assert rows(harbour, "SELECT title, reg FROM ships WHERE reg = 7") == [["Brig", 7]]
    assert ids(harbour, "SELECT reg FROM ships WHERE reg = 7 AND title = 'Alba'") == []
    assert ids(harbour, "SELECT reg FROM ships LIMIT 0") == []


@pytest.mark.parametrize("compacted", [False, True])
def test_key_ranges_with_and_without_a_job(harbour, compacted, monkeypatch):
    if compacted:
        harbour.compact()
        harbour.executescript("DELETE FROM ships WHERE reg = 9; INSERT INTO ships VALUES (9, 'Corsa', 80, NULL), (5, 'New', 1, 1); DELETE FROM ships WHERE reg = 5")
    asked = ["reg >= 5", "reg > 4 AND reg <= 9", "reg < 4", "reg > 4 AND reg < 9 AND reg >= 7", "reg > 12", "reg >= 3 AND reg < 99999999999999999999", "reg = 12", "reg = 5", "reg = 99999999999999999999"]
    direct = [rows(harbour, f"SELECT * FROM ships WHERE {w}") for w in asked]
    monkeypatch.setattr(type(harbour), "_seek", lambda *a: None)
    assert direct == [rows(harbour, f"SELECT * FROM ships WHERE {w}") for w in asked]
    assert direct[0] == SHIPS[1:] and direct[1] == SHIPS[1:3] and direct[7] == []


def test_change_and_remove(harbour):
    assert harbour.execute("UPDATE ships SET tons = 1, port = NULL WHERE title = 'Alba' AND reg > 5").message == "UPDATE 1"
    assert rows(harbour, "SELECT tons, port FROM ships WHERE reg = 12") == [[1.0, None]]
    assert harbour.execute("UPDATE ships SET tons = 2 WHERE reg = 4 AND reg > 4").rowcount == 0
    assert harbour.execute("DELETE FROM ships WHERE port = 2").rowcount == 2 and ids(harbour, "SELECT reg FROM ships") == [9, 12]
    assert harbour.execute("UPDATE calls SET days = 9").rowcount == 5 and harbour.execute("DELETE FROM calls").message == "DELETE 5"
    assert rows(harbour, "SELECT COUNT(*), MAX(days) FROM calls") == [[0, None]]


REFUSED = [
    "INSERT INTO ships VALUES (4, 'x', 1, 1)", "INSERT INTO ships VALUES (30, 'x', 1, 1), (30, 'y', 1, 1)", "INSERT INTO ships VALUES (30, NULL, 1, 1)", "INSERT INTO ships (title) VALUES ('keyless')",
    "INSERT INTO ships VALUES (30, 'x', 'heavy', 1)", "INSERT INTO ships VALUES (30, 'x', 1, 0.5)", "INSERT INTO ships VALUES (30, 'x')", "INSERT INTO ships (reg, title, reg) VALUES (30, 'x', 31)",
    "INSERT INTO ships (reg, colour) VALUES (30, 'red')", "INSERT INTO ships VALUES (9223372036854775808, 'x', 1, 1)", "UPDATE ships SET reg = 31 WHERE reg = 4", "UPDATE ships SET title = NULL WHERE reg = 4",
    "UPDATE ships SET colour = 'red'", "UPDATE ships SET port = 1 WHERE colour = 'red'", "UPDATE ships SET port = 1 WHERE ports.code = 2", "UPDATE ships SET port = 1 WHERE COUNT(*) = 1", "DELETE FROM ships WHERE colour = 'red'",
    "DELETE FROM quays", "SELECT * FROM quays", "SELECT colour FROM ships", "SELECT quays.reg FROM ships", "SELECT colour FROM ships WHERE reg = 4", "DROP TABLE quays", "DROP INDEX quays", "CREATE TABLE ports (k INT PRIMARY KEY)",
    "CREATE TABLE q (k FLOAT PRIMARY KEY)", "CREATE TABLE q (k INT PRIMARY KEY, a INT, a TEXT)", "CREATE INDEX q ON ships(colour)", "CREATE INDEX q ON quays(k)", "CREATE UNIQUE INDEX q ON ships(title)",
    "SELECT reg FROM ships WHERE MAX(reg) > 1", "SELECT reg FROM ships ORDER BY MAX(reg)", "SELECT AVG(title) FROM ships", "SELECT reg, COUNT(*) FROM ships GROUP BY title", "SELECT * FROM ships GROUP BY reg",
    "SELECT MAX(reg) FROM ships ORDER BY title", "SELECT title FROM ships GROUP BY title HAVING tons > 1", "SELECT reg FROM ships JOIN ships ON reg = reg", "SELECT title FROM ships JOIN ports ON port = code",
    "SELECT reg FROM ships JOIN ports ON SUM(reg) = code", "SELECT reg FROM ships JOIN calls ON ship = reg AND depth = 1 JOIN ports ON code = calls.port", "SELECT quays.* FROM ships", "SELECT",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refusals_leave_no_trace(harbour, sql):
    with pytest.raises(SqlError):
        harbour.execute(sql)
    assert rows(harbour, "SELECT * FROM ships") == SHIPS and list(harbour.tables()) == ["calls", "ports", "ships"]


def test_names_differ_by_case(harbour):
    harbour.execute("CREATE TABLE Ships (K INT PRIMARY KEY, k TEXT)")
    harbour.execute("INSERT INTO Ships VALUES (1, 'low')")
    assert rows(harbour, "SELECT k, K FROM Ships WHERE k = 'low'") == [["low", 1]] and len(rows(harbour, "SELECT * FROM ships")) == 4
    with pytest.raises(ExecutionError):
        harbour.execute("SELECT REG FROM ships")


def test_a_dropped_table_takes_its_indexes(harbour):
    harbour.execute("CREATE INDEX by_port ON ships(port)")
    harbour.execute("DROP TABLE ships")
    for sql in ("SELECT * FROM ships", "DROP INDEX by_port"):
        with pytest.raises(ExecutionError):
            harbour.execute(sql)


@pytest.mark.parametrize(
    "where,found",
    [
        ("tons > 100", [4, 12]), ("NOT tons > 100", [9]), ("tons = NULL", []), ("NOT tons = NULL", []), ("tons > 100 OR NOT tons > 100", [4, 9, 12]), ("tons <> 80 OR reg = 7", [4, 7, 12]),
        ("NOT (port = 2 AND tons > 1)", [12]), ("port = 2 OR port > 2", [4, 7, 12]), ("title = 4", []), ("title != 4", [4, 7, 9, 12]), ("title < 4", []), ("NOT reg = 'Alba'", [4, 7, 9, 12]), ("reg = port", []), ("TRUE = FALSE", []),
    ],
)
def test_unknown_is_neither_true_nor_false(harbour, where, found):
    assert ids(harbour, f"SELECT reg FROM ships WHERE {where}") == found


def test_numbers_meet_across_types(db):
    db.execute("CREATE TABLE n (k INT PRIMARY KEY, x FLOAT)")
    db.execute("INSERT INTO n VALUES (TRUE, 7), (3.0, ?), (4, ?)", (float("nan"), float("-inf")))
    assert rows(db, "SELECT k FROM n WHERE x = 7 OR x < -5.5") == [[1], [4]]
    assert [len(rows(db, f"SELECT k FROM n WHERE {w}")) for w in ("x = x", "x != x", "x >= x", "k = TRUE", "k > TRUE", "k < 99999999999999999999", "k <= x")] == [2, 1, 2, 1, 2, 3, 1]
    for bad in ("INSERT INTO n VALUES (9, TRUE)", "INSERT INTO n VALUES ('9', 1)"):
        with pytest.raises(ValueError):
            db.execute(bad)


def test_nulls_sort_as_the_largest_and_ties_by_key(harbour):
    assert ids(harbour, "SELECT reg FROM ships ORDER BY tons") == [9, 12, 4, 7] and ids(harbour, "SELECT reg FROM ships ORDER BY tons DESC") == [7, 4, 12, 9]
    assert ids(harbour, "SELECT reg FROM ships ORDER BY title DESC") == [9, 7, 4, 12] and ids(harbour, "SELECT port FROM ships GROUP BY port") == [2, None, 5]
    assert ids(harbour, "SELECT title FROM ships ORDER BY port LIMIT 3") == ["Alba", "Brig", "Alba"]


def test_joins(harbour):
    found = harbour.execute("SELECT ships.title, ports.title, days FROM calls JOIN ships ON ship = reg JOIN ports ON code = calls.port ORDER BY days DESC")
    assert found.columns == ["title", "title", "days"] and found.rows == [["Alba", "Oran", None], ["Alba", "Visby", 3], ["Corsa", "Oran", 3], ["Alba", None, 1]]
    assert rows(harbour, "SELECT nr, reg FROM calls LEFT JOIN ships ON ship = reg AND tons > 100") == [[100, 4], [101, 4], [102, 12], [103, None], [104, None]]
    found = harbour.execute("SELECT * FROM ports JOIN ships ON ships.port = ports.code WHERE reg < 10")
    assert found.columns == ["code", "ports.title", "depth", "reg", "ships.title", "tons", "port"] and [r[3] for r in found.rows] == [4, 7]
    assert harbour.execute("SELECT ports.* FROM ports LEFT JOIN calls ON port = code WHERE nr = 101").rows == [[8, None, 30]]
    assert len(rows(harbour, "SELECT reg FROM ships JOIN ports ON 1 = 1")) == 12 and ids(harbour, "SELECT reg FROM ships JOIN ports ON depth > tons AND code = 8") == []


def test_groups(harbour):
    found = harbour.execute("SELECT COUNT(*), COUNT(days), SUM(days), AVG(days), MIN(days), MAX(ship) FROM calls")
    assert found.columns == ["count(*)", "count(days)", "sum(days)", "avg(days)", "min(days)", "max(ship)"] and found.rows == [[5, 4, 13, 3.25, 1, 77]]
    assert rows(harbour, "SELECT COUNT(*), SUM(days), MIN(ship) FROM calls WHERE nr < 0") == [[0, None, None]] and rows(harbour, "SELECT port FROM calls WHERE nr < 0 GROUP BY port") == []
    assert rows(harbour, "SELECT port, COUNT(*), SUM(days) FROM calls GROUP BY calls.port HAVING COUNT(days) > 0 ORDER BY SUM(days) DESC") == [[2, 3, 9], [5, 1, 3], [8, 1, 1]]
    assert ids(harbour, "SELECT port FROM calls GROUP BY port HAVING MAX(days) < 5 AND port > 5") == [8] and rows(harbour, "SELECT COUNT(*) FROM calls HAVING COUNT(*) > 5") == []


def test_sums_of_integers_stay_exact(db):
    db.execute("CREATE TABLE big (k INT PRIMARY KEY, x INT)")
    db.execute("INSERT INTO big VALUES (1, ?), (2, ?), (3, ?)", (2**62, 2**62, 2**62))
    assert rows(db, "SELECT SUM(x) FROM big") == [[3 * 2**62]]


def test_parameters_are_not_text(harbour):
    assert ids(harbour, "SELECT reg FROM ships WHERE title = ? AND tons < ?", "Alba", 1000) == [12]
    assert ids(harbour, "SELECT reg FROM ships WHERE title = ?", "Alba' OR 1 = 1 --") == [] and ids(harbour, "SELECT reg FROM ships WHERE tons = ?", None) == []


@pytest.mark.parametrize(
    "where,line",
    [
        ("reg = 9", "Index Seek on ships_pkey (reg = 9)"), ("reg = 9 AND tons < 5", "Index Seek on ships_pkey (reg = 9)  [filter]"), ("reg > 3 AND reg <= 8", "Index Range Scan on ships_pkey (4 <= reg <= 8)"),
        ("reg < 3 AND title = 'x'", "Index Range Scan on ships_pkey (-inf <= reg <= 2)  [filter]"), ("port = 2", "Index Scan on by_port (port = 2)"), ("port >= 2 AND title = 'x'", "Index Scan on by_port (port >= 2)  [filter]"),
        ("tons = 2", "Seq Scan on ships  [filter]"), ("reg = 1 OR port = 2", "Seq Scan on ships  [filter]"),
    ],
)
def test_explained_paths(harbour, where, line):
    harbour.execute("CREATE INDEX by_port ON ships(port, title)")
    assert rows(harbour, f"EXPLAIN SELECT title FROM ships WHERE {where}") == [[line]]


def test_explained_join(harbour):
    lines = ids(harbour, "EXPLAIN SELECT nr FROM calls LEFT JOIN ports ON calls.port = ports.code JOIN ships ON title = 'x'".replace("title", "ships.title"))
    assert lines == ["Nested Loop Join", "  -> Seq Scan on calls", "  -> LEFT Join  Index Seek on ports_pkey (ports.code = outer) [per outer row]", "  -> INNER Join  Seq Scan on ships [per outer row]"]


def test_unique_indexes(harbour):
    harbour.execute("CREATE UNIQUE INDEX one ON ships(title, port)")
    for sql in ("INSERT INTO ships VALUES (40, 'Brig', 1, 2)", "UPDATE ships SET title = 'Brig' WHERE reg = 4", "UPDATE ships SET title = 'z', port = 1"):
        with pytest.raises(ConstraintError):
            harbour.execute(sql)
    harbour.executescript("INSERT INTO ships VALUES (41, 'Brig', 1, NULL), (42, 'Brig', 2, NULL); DELETE FROM ships WHERE reg = 7; INSERT INTO ships VALUES (43, 'Brig', 1, 2); UPDATE ships SET port = 2 WHERE reg = 43")
    assert ids(harbour, "SELECT reg FROM ships WHERE title = 'Brig'") == [41, 42, 43]


def test_an_index_changes_no_answer(db):
    rng = random.Random(31)
    db.execute("CREATE TABLE m (k INT PRIMARY KEY, a INT, b TEXT)")
    db.execute("BEGIN")
    for k in range(150):
        db.execute("INSERT INTO m VALUES (?, ?, ?)", (k, rng.choice((None, rng.randrange(9))), f"b{rng.randrange(5)}"))
    db.execute("COMMIT")
    asked = [f"SELECT k FROM m WHERE {w}" for w in ("a = 4", "a >= 6", "b = 'b3'", "a < 3 AND b > 'b1'")]
    before = [sorted(rows(db, q)) for q in asked]
    db.executescript("CREATE INDEX ia ON m(a); CREATE INDEX ib ON m(b, a)")
    assert [sorted(rows(db, q)) for q in asked] == before and all(before)


def test_frames_are_lazy(harbour):
    df = harbour.sql("SELECT title, tons FROM ships WHERE tons > ?", (50,))
    assert df.columns == ["title", "tons"] and df.count() == 3
    names, found = harbour.stream("SELECT title FROM ships ORDER BY tons")
    assert names == ["title"] and [r[0] for r in found] == ["Corsa", "Alba", "Alba", "Brig"]
