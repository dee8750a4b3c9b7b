"""SELECT as one lazy DataFrame: scan, join, filter, group, sort, limit, project.

Everything is handed to Catalyst as declared, so filters and columns reach the scans, joins get their strategy
from sizes, aggregates combine before they shuffle, and a sort with a limit becomes a top-k.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ExecutionError
from tessera.functions.aggregates import aggregate
from tessera.functions.predicates import Typed, predicate
from tessera.plans import nodes as n
from tessera.plans.access import Path, choose, drives_key
from tessera.plans.analyzer import Scope, Table, checked, is_grouped


@dataclass
class Planned:
    df: DataFrame  # columns by position; labels may repeat
    labels: list[str]


def _tables(q: n.Select, tables: Mapping[str, Table]) -> list[Table]:
    out = []
    for name in (q.table, *(j.table for j in q.joins)):
        if name not in tables:
            raise ExecutionError(f"no such table: {name}")
        out.append(tables[name])
    return out


def base_path(q: n.Select, scope: Scope) -> Path:
    """The access path of the first table, by the conjuncts that concern it alone."""
    own = None
    for c in n.conjuncts(q.where):
        if all(scope.find(x)[0] == q.table for x in n.leaves(c)):
            own = c if own is None else n.Logic("AND", own, c)
    base = scope.tables[0]
    return choose(base.name, base.pk, [(i[0], i[1]) for i in base.indexes], own)


def explain(q: n.Select, tables: Mapping[str, Table]) -> list[str]:
    scope = Scope(_tables(q, tables))
    checked(q, scope)
    lines = [base_path(q, scope).line]
    if not q.joins:
        return lines
    lines = ["Nested Loop Join", f"  -> {lines[0]}"]
    for join, table in zip(q.joins, scope.tables[1:]):
        on = _qualified(join.on, scope)
        how = f"Index Seek on {table.name}_pkey ({table.name}.{table.pk} = outer)" if drives_key(on, table.name, table.pk) else f"Seq Scan on {table.name}"
        lines.append(f"  -> {join.kind} Join  {how} [per outer row]")
    return lines


def _qualified(node, scope: Scope):
    if isinstance(node, n.Column):
        table, name = scope.find(node)
        return n.Column(name, table)
    if isinstance(node, (n.Compare, n.Logic)):
        return type(node)(node.op, _qualified(node.left, scope), _qualified(node.right, scope))
    return n.Not(_qualified(node.operand, scope)) if isinstance(node, n.Not) else node


def _natural(q: n.Select, scope: Scope) -> list[Column]:
    """Columns in whose order rows come when nothing sorts them: the base table's path, then each joined key."""
    base = scope.tables[0]
    keys = [(base.name, c) for c in base_path(q, scope).order] + [(t.name, t.pk) for t in scope.tables[1:] if t.pk]
    return [F.col(f"`{scope.inner(*k)}`") for k in keys]


def _sorted_by(key: Column, descending: bool) -> Column:
    # Nulls are the largest values.
    return key.desc_nulls_first() if descending else key.asc_nulls_last()


def select(q: n.Select, tables: Mapping[str, Table], ordered: bool = False, exact: bool = False) -> Planned:
    """ordered: rows come, and ties stand, in natural order, as a materialised result promises; exact: integer sums never overflow."""
    scope = Scope(_tables(q, tables))
    checked(q, scope)
    df = scope.frame(scope.tables[0])
    for k, (join, table) in enumerate(zip(q.joins, scope.tables[1:])):
        on = predicate(join.on, lambda c, k=k: scope.typed(c, k + 2))
        df = df.join(scope.frame(table), on, "left" if join.kind == "LEFT" else "inner")
    if q.where is not None:
        df = df.where(predicate(q.where, scope.typed))
    natural = _natural(q, scope) if ordered or q.limit is not None else []
    return (_grouped if is_grouped(q) else _plain)(q, scope, df, natural, exact)


def _plain(q: n.Select, scope: Scope, df: DataFrame, natural: list[Column], exact: bool) -> Planned:
    keys = [_sorted_by(scope.typed(q.order.key).column, q.order.descending)] if q.order else []
    keys += [c.asc_nulls_first() for c in natural]
    if keys:
        df = df.orderBy(*keys)
    if q.limit is not None:
        df = df.limit(q.limit)
    wanted = [x for item in q.items for x in (scope.star(item) if isinstance(item, n.Star) else [(item.name, item)])]
    return Planned(df.select(*[scope.typed(c).column.alias(label) for label, c in wanted]), [label for label, _ in wanted])


def _grouped(q: n.Select, scope: Scope, df: DataFrame, natural: list[Column], exact: bool) -> Planned:
    groups = {scope.find(c): scope.typed(c) for c in q.group_by}
    made: dict[tuple, tuple[str, Typed]] = {}
    extra = [q.order.key] if q.order else []
    for x in [*q.items, *n.leaves(q.having), *extra]:
        if isinstance(x, n.Aggregate):
            key = (x.func, scope.find(x.arg) if x.arg else None)
            if key not in made:
                made[key] = (f"a{len(made)}", aggregate(x.func, scope.typed(x.arg) if x.arg else None, exact))

    def resolve(x) -> Typed:
        if isinstance(x, n.Aggregate):
            name, typed = made[x.func, scope.find(x.arg) if x.arg else None]
            return typed._replace(column=F.col(name))
        return groups[scope.find(x)]

    aggs = [typed.column.alias(name) for name, typed in made.values()]
    if natural and groups:
        aggs.append(F.min(F.struct(*[c.alias(f"n{i}") for i, c in enumerate(natural)])).alias("first"))
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("unused")]
    df = df.groupBy(*[t.column for t in groups.values()]).agg(*aggs) if groups else df.agg(*aggs)
    if q.having is not None:
        df = df.where(predicate(q.having, resolve))
    keys = [_sorted_by(resolve(q.order.key).column, q.order.descending)] if q.order else []
    if natural and groups:
        keys.append(F.col("first").asc_nulls_first())
    if keys and groups:
        df = df.orderBy(*keys)
    if q.limit is not None:
        df = df.limit(q.limit)
    labels = [x.label if isinstance(x, n.Aggregate) else x.name for x in q.items]
    return Planned(df.select(*[resolve(x).column.alias(label) for x, label in zip(q.items, labels)]), labels)
