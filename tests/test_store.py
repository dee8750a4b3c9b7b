import os
import random

import pytest

from tessera import Database
from tessera.errors import CorruptionError, SqlError, TransactionError
from tessera.plans.grammar import parse
from tessera.sources import store as S


@pytest.fixture
def small_delta(monkeypatch):
    """A delta of a few rows, so that folders, rewrites and compaction come into play."""
    from tessera.operators import mutation

    monkeypatch.setattr(mutation, "DELTA_ROWS", 8)
    monkeypatch.setattr(S, "DELTA_ROWS", 8)


def opened(spark, path):
    return Database(str(path), spark=spark)


def test_a_snapshot_is_left_by_rollback_as_it_was_found(db):
    """Delta, folders and definitions of a transaction that is taken back leave neither rows nor records behind."""
    db.execute("CREATE TABLE log (nr INT PRIMARY KEY, line TEXT)")
    db.execute("INSERT INTO log VALUES (5, 'five'), (6, 'six')")
    db.compact()
    db.execute("INSERT INTO log VALUES (7, 'seven')")
    was, records = db.store.current, sorted(os.listdir(db.store.log))
    db.executescript("BEGIN; DELETE FROM log WHERE nr < 7; UPDATE log SET line = 'changed'; CREATE TABLE side (k INT PRIMARY KEY); CREATE INDEX by_line ON log(line)")
    assert db.execute("SELECT * FROM log").rows == [[7, "changed"]] and list(db.tables()) == ["log", "side"]
    db.execute("ROLLBACK")
    assert db.store.current is was and sorted(os.listdir(db.store.log)) == records
    assert db.execute("SELECT line FROM log").rows == [["five"], ["six"], ["seven"]]
    db.executescript("BEGIN; DELETE FROM log WHERE nr = 6; INSERT INTO log VALUES (6, 'six again'); COMMIT")
    assert db.execute("SELECT line FROM log WHERE nr = 6").rows == [["six again"]] and db.store.current.seq == was.seq + 1


def test_survives_reopening(spark, tmp_path):
    with opened(spark, tmp_path / "d") as a:
        a.execute("CREATE TABLE t (id INT PRIMARY KEY, f FLOAT, s TEXT NOT NULL)")
        a.execute("CREATE UNIQUE INDEX u ON t(s)")
        a.execute("INSERT INTO t VALUES (1, ?, 'é\n')", (float("inf"),))
        a.execute("BEGIN")
        a.execute("INSERT INTO t VALUES (2, 1.0, 'gone')")
    with opened(spark, tmp_path / "d") as b:
        assert b.execute("SELECT * FROM t").rows == [[1, float("inf"), "é\n"]]
        assert "Index Scan on u" in b.execute("EXPLAIN SELECT * FROM t WHERE s = 'x'").rows[0][0]
        with pytest.raises(Exception, match="UNIQUE"):
            b.execute("INSERT INTO t VALUES (9, 1.0, 'é\n')")
        b.check()


def test_torn_and_uncommitted_records_count_for_nothing(spark, tmp_path):
    with opened(spark, tmp_path / "d") as a:
        a.execute("CREATE TABLE t (id INT PRIMARY KEY)")
        a.execute("INSERT INTO t VALUES (1)")
        a.execute("INSERT INTO t VALUES (2)")
        last = os.path.join(a.store.log, f"{a.store.current.seq:012d}.json")
        os.makedirs(os.path.join(tmp_path, "d", "data", "t", "orphan"))
    with open(last, "r+") as f:
        f.truncate(20)
    with opened(spark, tmp_path / "d") as b:
        assert b.execute("SELECT id FROM t").rows == [[1]]
        b.execute("INSERT INTO t VALUES (3)")
        assert b.vacuum() >= 1
    with opened(spark, tmp_path / "d") as c:
        assert c.execute("SELECT id FROM t").rows == [[1], [3]]


def test_two_handles_race_and_retry(db, spark):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    db.execute("INSERT INTO t VALUES (1, 100)")
    other = Database(db.temporary, spark=spark)
    reader = db.begin()
    other.execute("UPDATE t SET v = 200 WHERE id = 1")
    query = parse("SELECT v FROM t WHERE v > 0")
    assert db.run(query, reader).rows == [[100]] and db.execute("SELECT v FROM t").rows == [[200]]
    db.run(parse("INSERT INTO t VALUES (2, 2)"), reader)
    with pytest.raises(TransactionError):
        db.commit(reader)
    for k, handle in enumerate((db, other, db, other, db)):  # a lost race is no lasting harm
        handle.execute("INSERT INTO t VALUES (?, ?)", (10 + k, k))
    assert [h.execute("SELECT COUNT(*) FROM t").rows for h in (db, other)] == [[[6]], [[6]]]
    assert db.store.current.seq == other.store.current.seq


@pytest.mark.parametrize("which,kept", [(3, None), (1, None), (6, 4), (0, None)])
def test_damage_is_told_from_a_torn_tail(spark, tmp_path, which, kept):
    with opened(spark, tmp_path / "d") as a:
        a.execute("CREATE TABLE t (id INT PRIMARY KEY)")
        for k in range(5):
            a.execute("INSERT INTO t VALUES (?)", (k,))
        log = a.store.log
    if which:
        name = os.path.join(log, f"{which:012d}.json")
        raw = bytearray(open(name, "rb").read())
        raw[-2] ^= 1
        open(name, "wb").write(raw)
    else:
        os.unlink(os.path.join(log, f"{4:012d}.json"))
    before = sorted(os.listdir(log))
    if kept is None:
        with pytest.raises(CorruptionError):
            opened(spark, tmp_path / "d")
        assert sorted(os.listdir(log)) == before  # nothing is moved or removed
    else:
        with opened(spark, tmp_path / "d") as b:
            assert b.execute("SELECT COUNT(*) FROM t").rows == [[kept]]


def test_a_damaged_newest_full_record_is_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FULL_EVERY", 3)
    with opened(spark, tmp_path / "d") as a:
        a.execute("CREATE TABLE t (id INT PRIMARY KEY)")
        for k in range(3):
            a.execute("INSERT INTO t VALUES (?)", (k,))
        last = os.path.join(a.store.log, f"{a.store.current.seq:012d}.json")
        assert a.store.current.seq % 3 == 1
    os.truncate(last, 25)
    with pytest.raises(CorruptionError):
        opened(spark, tmp_path / "d")


def test_vacuum_spares_what_others_are_writing(spark, tmp_path):
    with opened(spark, tmp_path / "d") as writer, opened(spark, tmp_path / "d") as cleaner:
        writer.load("t", spark.range(50).withColumnRenamed("id", "k"), "k")
        writer.execute("BEGIN")
        writer.execute("DELETE FROM t")
        writer.load("u", spark.range(9000).withColumnRenamed("id", "k"), "k")
        cleaner.vacuum()
        writer.vacuum()
        writer.execute("COMMIT")
        assert cleaner.execute("SELECT COUNT(*) FROM u").rows == [[9000]] and not [f for f in os.listdir(writer.store.log) if f.endswith(".lease")]
        writer.execute("BEGIN")
        writer.load("lost", spark.range(5).withColumnRenamed("id", "k"), "k")
        writer.execute("ROLLBACK")
        assert writer.vacuum() >= 1 and not os.listdir(tmp_path / "d" / "data" / "lost")
        cleaner.check()


@pytest.mark.parametrize("root", ["{}", "file:{}", "file://{}", "file://{}/"])
def test_vacuum_removes_folders_wherever_data_is(spark, tmp_path, root):
    """A path without a scheme, as spark.checkpoint.dir may name one, and other ways to write the same place."""
    place = tmp_path / "data"
    with Database(str(tmp_path / "d"), spark=spark, data_root=root.format(place)) as a:
        a.load("t", spark.range(30).withColumnRenamed("id", "k"), "k")
        reader = a.begin()
        a.execute("INSERT INTO t VALUES (30)")
        a.compact()
        os.makedirs(place / "t" / "notes")
        assert a.vacuum() == 0 and len(os.listdir(place / "t")) == 3
        a.abandon(reader)
        assert a.vacuum() == 1 and len(os.listdir(place / "t")) == 2
    with Database(str(tmp_path / "d"), spark=spark, data_root=f"file://{place}") as b:
        assert b.vacuum() == 0 and b.execute("SELECT COUNT(*) FROM t").rows == [[31]]


def test_load_checks_its_key(db, spark):
    frame = spark.createDataFrame([(1, "a", 0.5), (2, None, None)], "k int, s string, f double")
    assert db.load("t", frame, "k") == 2 and db.execute("SELECT * FROM t").rows == [[1, "a", 0.5], [2, None, None]]
    for bad, key in ((frame.union(frame), "k"), (frame.selectExpr("nullif(k, 1) k", "s"), "k"), (frame, "s"), (frame, "k")):
        with pytest.raises(SqlError):
            db.load("t" if bad is frame else "u", bad, key)
    assert list(db.tables()) == ["t"]


def test_corruption_is_told(spark, tmp_path):
    with opened(spark, tmp_path / "d") as a:
        a.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
        a.execute("INSERT INTO t VALUES (1, 'x'), (2, 'y')")
        a.compact()
        folder = a.store.current.tables["t"].folders[0]
        path = os.path.join(folder.path.removeprefix("file://"), folder.files[0][0])
        raw = bytearray(open(path, "rb").read())
        raw[len(raw) // 3] ^= 0xFF
        open(path, "wb").write(raw)
        with pytest.raises(CorruptionError):
            a.execute("SELECT * FROM t")
        with pytest.raises(CorruptionError):
            a.check()
        os.unlink(path)
        with pytest.raises(CorruptionError):
            a.check()


def test_bulk_rows_go_to_folders(spark, tmp_path):
    with opened(spark, tmp_path / "d") as a:
        a.execute("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
        a.execute("BEGIN")
        for k in range(0, 6000, 100):
            a.execute("INSERT INTO t VALUES " + ", ".join(f"({i}, {i % 7})" for i in range(k, k + 100)))
        a.execute("COMMIT")
        v = a.store.current.tables["t"]
        assert not v.delta and v.folders[0].rows == 6000
        assert a.execute("UPDATE t SET v = 100 WHERE v >= 0").rowcount == 6000
        assert a.execute("DELETE FROM t WHERE id < 5500").rowcount == 5500
        assert a.execute("SELECT COUNT(*), SUM(v) FROM t").rows == [[500, 50000]]
        with pytest.raises(Exception, match="duplicate"):
            a.execute("INSERT INTO t VALUES (5999, 1)")
        assert a.vacuum() >= 1 and a.cache_stats()["commits"] == 4
        a.check()


def test_random_transactions_against_a_dict(spark, tmp_path, small_delta):
    rng, model = random.Random(20240607), {}
    db = opened(spark, tmp_path / "d")
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT)")
    for step in range(30):
        trial = dict(model)
        db.execute("BEGIN")
        for _ in range(rng.randint(1, 4)):
            k, v = rng.randint(1, 40), f"v{rng.randint(0, 999)}" * rng.randint(1, 20)
            what = rng.random()
            if what < 0.5 and k not in trial:
                db.execute("INSERT INTO t VALUES (?, ?)", (k, v))
                trial[k] = v
            elif what < 0.75:
                assert db.execute("UPDATE t SET v = ? WHERE id = ?", (v, k)).rowcount == (k in trial)
                trial.update({k: v} if k in trial else {})
            else:
                assert db.execute("DELETE FROM t WHERE id = ?", (k,)).rowcount == (k in trial)
                trial.pop(k, None)
        if rng.random() < 0.8:
            db.execute("COMMIT")
            model = trial
        else:
            db.execute("ROLLBACK")
        if step % 10 == 9:
            db.close()
            db = opened(spark, tmp_path / "d")
        if step % 5 == 4:
            assert db.execute("SELECT * FROM t").rows == [[k, model[k]] for k in sorted(model)]
    db.check()
    db.close()


@pytest.mark.parametrize("size", [4096, 1 << 20])
def test_large_values(spark, tmp_path, size):
    with opened(spark, tmp_path / "d") as a:
        a.execute("CREATE TABLE t (id INT PRIMARY KEY, body TEXT)")
        a.execute("INSERT INTO t VALUES (1, ?)", ("é" * size,))
        a.compact()
    with opened(spark, tmp_path / "d") as b:
        assert b.execute("SELECT body FROM t").rows == [["é" * size]]
