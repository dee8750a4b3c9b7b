"""PEP 249 driver.  A connection opens a transaction by itself before its first statement.

Names, globals and the tree of exceptions are fixed by PEP 249.  A query's first ``HELD`` rows are fetched when it
runs; if there are more, the rest stays on the cluster and comes a partition at a time, and ``rowcount`` is -1, as
PEP 249 has it for a number that isn't known.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from itertools import islice

from tessera import errors
from tessera.database import Database, Result
from tessera.plans import nodes as n
from tessera.plans.grammar import parse

apilevel = "2.0"
threadsafety = 1
paramstyle = "qmark"
HELD = 10_000


class Warning(Exception):  # noqa: A001
    pass


class Error(Exception):
    pass


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


_KINDS = (
    (errors.ConstraintError, IntegrityError), (errors.ParseError, ProgrammingError), (errors.ExecutionError, ProgrammingError),
    (errors.TypeMismatch, DatabaseError), (errors.TransactionError, DatabaseError), (errors.CorruptionError, DatabaseError),
)


def _outward(e: Exception) -> Error:
    return next((to for kind, to in _KINDS if isinstance(e, kind)), DatabaseError)(str(e))


class Connection:
    def __init__(self, database: str = ":memory:", **options):
        self._db = Database(database, **options)
        self._closed = False

    def _run(self, sql: str, params: Sequence) -> tuple[Result, Iterator[list]]:
        """The result, and rows that are still to come."""
        if self._closed:
            raise ProgrammingError("the connection has been closed")
        try:
            statement = parse(sql, params)
            if self._db.current is None and not isinstance(statement, (n.Begin, n.Commit, n.Rollback)):
                self._db.execute("BEGIN")
            if not isinstance(statement, n.Select) or statement.explain:
                return self._db.execute(sql, params), iter(())
            columns, rows = self._db.stream(sql, params)
            return Result("select", columns, list(islice(rows, HELD))), rows
        except Error:
            raise
        except Exception as e:
            raise _outward(e) from e

    def cursor(self) -> Cursor:
        if self._closed:
            raise ProgrammingError("the connection has been closed")
        return Cursor(self)

    def execute(self, sql: str, params: Sequence = ()) -> Cursor:
        return self.cursor().execute(sql, params)

    def _finish(self, word: str) -> None:
        if self._closed:
            raise ProgrammingError("the connection has been closed")
        if self._db.current is not None:
            try:
                self._db.execute(word)
            except Exception as e:
                raise _outward(e) from e

    def commit(self) -> None:
        self._finish("COMMIT")

    def rollback(self) -> None:
        self._finish("ROLLBACK")

    def close(self) -> None:
        if not self._closed:
            self.rollback()
            self._db.close()
            self._closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *rest) -> None:
        try:
            self.commit() if kind is None else self.rollback()
        finally:
            self.close()


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection = connection
        self.description: list[tuple] | None = None
        self.rowcount = -1
        self._rows: deque[tuple] = deque()
        self._later: Iterator[list] = iter(())
        self._closed = False

    def _open(self) -> None:
        if self._closed:
            raise ProgrammingError("the cursor has been closed")

    def execute(self, sql: str, params: Sequence = ()) -> Cursor:
        self._open()
        result, self._later = self.connection._run(sql, tuple(params))
        reads = result.kind in ("select", "explain")
        self.description = [(c, *[None] * 6) for c in result.columns] if reads else None
        self._rows = deque(tuple(r) for r in result.rows) if reads else deque()
        self.rowcount = result.rowcount if not reads else len(self._rows) if len(self._rows) < HELD else -1
        return self

    def executemany(self, sql: str, rows: Sequence[Sequence]) -> Cursor:
        total = 0
        for params in rows:
            self.execute(sql, params)
            total += max(0, self.rowcount)
        self.rowcount = total
        return self

    def fetchone(self) -> tuple | None:
        self._open()
        if not self._rows:
            try:
                self._rows.extend(tuple(r) for r in islice(self._later, HELD))
            except Exception as e:
                raise _outward(e) from e
        return self._rows.popleft() if self._rows else None

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return list(islice(self, self.arraysize if size is None else size))

    def fetchall(self) -> list[tuple]:
        return list(self)

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.fetchone, None)

    def close(self) -> None:
        self._closed = True

    def setinputsizes(self, sizes) -> None:
        pass

    def setoutputsize(self, size, column=None) -> None:
        pass


def connect(database: str = ":memory:", **options) -> Connection:
    return Connection(database, **options)
