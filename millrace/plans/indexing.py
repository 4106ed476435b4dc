"""Which index serves a query, and which conditions it can answer by itself.

An index part holds an index's columns, sorted, with the position and file of every row.  Equalities on leading columns and
one range, list or prefix on the next let Parquet's statistics skip most of it; what it finds names the files and positions
that the table's scan is then narrowed to.  All conditions are applied again to what that scan returns.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..functions import types as K
from .predicate import Condition
from .schema import Index, TableSchema

RANGES = (">", ">=", "<", "<=", "BETWEEN", "IN")
#: Positions that a probe may return; where there are more the table is scanned as a whole.
MOST_POSITIONS = 1000


def _fixed(c: Condition) -> bool:
    return not c.negated and c.operator == "=" and c.value is not None


def _ranged(c: Condition, kind: str, collation: str | None) -> bool:
    """Whether statistics in byte order can skip by the condition."""
    if c.negated:
        return False
    if c.operator == "LIKE":
        return bool(c.value) and c.value[0] not in "%\\"
    if c.operator == "IN":
        return None not in c.value and bool(c.value)
    return c.operator in RANGES and not (collation and K.base_of(kind) == "string")


def prefix(conditions: Iterable[Condition], index: Index, schema: TableSchema, collation: str | None = None) -> tuple[int, bool]:
    """(leading columns that are fixed, whether the next one is in a range)."""
    conditions, n = list(conditions), 0
    names = [f for f, _ in index.fields]
    while n < len(names) and any(c.field == names[n] and _fixed(c) for c in conditions):
        n += 1
    return n, n < len(names) and any(c.field == names[n] and _ranged(c, schema.columns[names[n]], collation) for c in conditions)


def choose(conditions: Iterable[Condition], schema: TableSchema, built: Iterable[str], collation: str | None = None) -> Index | None:
    """The built index that fixes most; among equals the one of fewer columns, then the one declared first."""
    conditions, built = list(conditions), set(built)
    best, rank = None, (0, False)
    for index in schema.indexes:
        got = prefix(conditions, index, schema, collation)
        if index.name in built and (got > rank or (got == rank != (0, False) and best is not None and len(index.fields) < len(best.fields))):
            best, rank = index, got
    return best


def servable(conditions: Iterable[Condition], index: Index) -> list[Condition]:
    """Conditions that the index's own columns decide, negated ones included."""
    names = {f for f, _ in index.fields}
    return [c for c in conditions if c.field in names]
