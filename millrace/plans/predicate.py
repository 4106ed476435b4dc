"""Conditions under two-valued logic: a negation matches exactly what the condition does not, nulls included."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import types as K
from ..functions.like import like

OPERATORS = ("=", ">", ">=", "<", "<=", "BETWEEN", "IN", "LIKE")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: object
    negated: bool = False

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise QueryError("InvalidOperator", operator=self.operator)


@dataclass(frozen=True)
class Filter:
    """An immutable list of conditions, all of which must hold."""

    conditions: tuple[Condition, ...] = field(default=())

    def where(self, name: str, operator: str, value, negated: bool = False) -> Filter:
        return self.condition(Condition(name, operator, value, negated))

    def condition(self, c: Condition) -> Filter:
        return Filter((*self.conditions, c))

    def is_empty(self) -> bool:
        return not self.conditions


def _pair(value) -> list:
    if isinstance(value, dict):
        value = list(value.values())
    if not isinstance(value, (list, tuple)) or len(value) != 2 or any(v is None or isinstance(v, (list, dict, tuple)) for v in value):
        raise QueryError("InvalidBetween", value=repr(value))
    return list(value)


def _listed(value) -> list:
    if isinstance(value, dict):
        value = list(value.values())
    if not isinstance(value, (list, tuple)) or any(isinstance(v, (list, dict, tuple, set)) for v in value):
        raise QueryError("InvalidIn", value=repr(value))
    return list(value)


def encode(c: Condition, columns: dict[str, str], zone: str = "UTC", table: str = "") -> Condition:
    """The condition with checked, stored-form literals.  Nothing runs before all conditions have passed this."""
    if c.field not in columns:
        raise QueryError("QueryUnknownColumn", table=table, column=c.field)
    kind = columns[c.field]
    base = K.base_of(kind)

    def lit(v):
        return K.literal(v, kind, c.field, zone)

    if c.operator == "LIKE":
        if base in K.INSTANTS:
            raise QueryError("LikeOnInstantUnsupported", column=c.field)
        if base not in K.TEXT_LIKE:
            raise QueryError("LikeOnNonStringColumn", column=c.field)
        if not isinstance(c.value, str):
            raise QueryError("InvalidLikePattern", value=repr(c.value))
        return c
    if c.operator == "BETWEEN":
        value = [lit(v) for v in _pair(c.value)]
    elif c.operator == "IN":
        value = [None if v is None else lit(v) for v in _listed(c.value)]
    elif c.value is None and c.operator == "=":
        value = None
    elif c.value is None or isinstance(c.value, (list, tuple, dict, set)):
        raise QueryError("InvalidOperand", operator=c.operator, value=repr(c.value))
    else:
        value = lit(c.value)
    return Condition(c.field, c.operator, value, c.negated)


def to_column(c: Condition, columns: dict[str, str], collation: str | None = None) -> Column:
    """Predicate of an encoded condition.

    Positive forms drop nulls by themselves.  Negations spell out the null branch instead of wrapping the predicate in
    coalesce, which would keep it from the Parquet scan.
    """
    x = F.col(f"`{c.field}`")
    base = K.base_of(columns[c.field])
    v, no = c.value, c.negated
    ranged = F.collate(x, collation) if collation and base == "string" else x

    def operand(value) -> Column:
        out = F.lit(value)
        return F.collate(out, collation) if collation and base == "string" else out

    if c.operator == "=":
        if v is None:
            return x.isNotNull() if no else x.isNull()
        return ~x.eqNullSafe(F.lit(v)) if no else x.eqNullSafe(F.lit(v))
    if c.operator == "IN":
        some, has_null = [i for i in v if i is not None], None in v
        if not v:
            return F.lit(no)
        if not some:
            return x.isNotNull() if no else x.isNull()
        hit = x.isin(some)
        if no:
            return x.isNotNull() & ~hit if has_null else x.isNull() | ~hit
        return hit | x.isNull() if has_null else hit
    if c.operator == "BETWEEN":
        hit = (ranged >= operand(v[0])) & (ranged <= operand(v[1]))
    elif c.operator == "LIKE":
        hit = like(x, v)
    else:
        y = operand(v)
        hit = {">": ranged > y, ">=": ranged >= y, "<": ranged < y, "<=": ranged <= y}[c.operator]
    return x.isNull() | ~hit if no else hit


def conjunction(conditions: Iterable[Condition], columns: dict[str, str], zone: str = "UTC", table: str = "", collation: str | None = None) -> Column | None:
    """All conditions, checked first and then joined; None where there are none."""
    encoded = [encode(c, columns, zone, table) for c in conditions]
    return reduce(lambda a, b: a & b, [to_column(c, columns, collation) for c in encoded]) if encoded else None
