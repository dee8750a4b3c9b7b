"""Statements and expressions as immutable values."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Column:
    name: str
    table: str | None = None

    @property
    def spelled(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Parameter:
    index: int


@dataclass(frozen=True)
class Aggregate:
    func: str
    arg: Column | None  # None: all rows

    @property
    def label(self) -> str:
        return f"{self.func.lower()}({self.arg.spelled if self.arg else '*'})"


@dataclass(frozen=True)
class Compare:
    op: str  # = != < <= > >=
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str  # AND OR
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    operand: Any


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # INNER LEFT
    table: str
    on: Any


@dataclass(frozen=True)
class Order:
    key: Column | Aggregate
    descending: bool = False


@dataclass(frozen=True)
class Select:
    items: tuple
    table: str
    joins: tuple[Join, ...] = ()
    where: Any = None
    group_by: tuple[Column, ...] = ()
    having: Any = None
    order: Order | None = None
    limit: int | None = None
    explain: bool = False


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str  # INT FLOAT TEXT
    primary_key: bool = False
    not_null: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class DropIndex:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, Any], ...]
    where: Any = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Any = None


@dataclass(frozen=True)
class Begin:
    pass


@dataclass(frozen=True)
class Commit:
    pass


@dataclass(frozen=True)
class Rollback:
    pass


def conjuncts(predicate: Any) -> list:
    """The parts of a predicate that all have to hold."""
    if predicate is None:
        return []
    if isinstance(predicate, Logic) and predicate.op == "AND":
        return [*conjuncts(predicate.left), *conjuncts(predicate.right)]
    return [predicate]


def leaves(node: Any):
    """Every column and aggregate in an expression."""
    if isinstance(node, (Column, Aggregate)):
        yield node
    elif isinstance(node, (Compare, Logic)):
        yield from leaves(node.left)
        yield from leaves(node.right)
    elif isinstance(node, Not):
        yield from leaves(node.operand)
