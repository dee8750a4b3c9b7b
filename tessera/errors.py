"""Errors of the engine."""


class SqlError(Exception):
    """Base of everything the engine raises on purpose."""


class ParseError(SqlError):
    """The text is not a statement of the dialect."""


class ExecutionError(SqlError):
    """The statement can't be carried out: unknown names, ambiguity, misplaced aggregates."""


class ConstraintError(ExecutionError):
    """A primary key, NOT NULL or UNIQUE rule would be broken."""


class TypeMismatch(SqlError, ValueError):
    """A value doesn't fit its column."""


class TransactionError(SqlError, RuntimeError):
    """BEGIN, COMMIT or ROLLBACK at the wrong time, or another writer came first."""


class CorruptionError(SqlError):
    """Stored data doesn't match its checksum or its manifest."""
