"""Record classes: dataclasses that stand for the rows of a table."""

from __future__ import annotations

import dataclasses
import types
import typing
from datetime import date, datetime, time
from enum import Enum

from .errors import MappingError
from .functions import types as K
from .plans.schema import PK, TableSchema

_CAPITALS, _LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("abcdefghijklmnopqrstuvwxyz")
_SMALL = _LETTERS | set("0123456789")
#: What a field of a temporal column may be declared as, beside its text.
_MOMENTS = {"date": (date, datetime), "time": (time, datetime), "timez": (time, datetime), "datetime": (datetime,), "datetimez": (datetime,)}
_PYTHON = {"string": str, "int": int, "float": float, "bool": bool, "year": int, "month": int, "day": int}


def snake_case(name: str) -> str:
    """camelCase to snake_case: a capital begins a word if a small letter or digit stands before it, or, within a run of
    capitals, if a small letter follows."""
    out = []
    for i, c in enumerate(name):
        if c in _CAPITALS and i:
            before, after = name[i - 1], name[i + 1 : i + 2]
            if before in _SMALL or (before in _CAPITALS and after in _LETTERS):
                out.append("_")
        out.append(c.lower() if c in _CAPITALS else c)
    return "".join(out)


def record(table: str, snake: bool = False):
    """Class decorator: names the table, and whether camelCase fields stand for snake_case columns."""

    def mark(cls):
        cls.__millrace__ = {"table": table, "snake": snake}
        return cls if dataclasses.is_dataclass(cls) else dataclasses.dataclass(cls)

    return mark


def column(name: str, **options):
    """Field of another name than its column."""
    return dataclasses.field(metadata={"column": name}, **options)


@dataclasses.dataclass(frozen=True)
class Slot:
    attribute: str
    column: str
    enum: type[Enum] | None
    nullable: bool
    kind: str = "string"
    moment: type | None = None


class RecordMap:
    """A record class compiled against a schema; every mismatch is found here, before any row is read."""

    def __init__(self, cls: type, schema: TableSchema, zone: str = "UTC"):
        if not dataclasses.is_dataclass(cls):
            raise MappingError("RecordClassInvalid", cls=cls.__name__)
        options = getattr(cls, "__millrace__", {"table": schema.name, "snake": False})
        if options["table"] != schema.name:
            raise MappingError("RecordTableMismatch", cls=cls.__name__, table=schema.name)
        hints = typing.get_type_hints(cls)
        self.cls, self.schema, self.zone, self.slots = cls, schema, zone, []
        for f in dataclasses.fields(cls):
            name = f.metadata.get("column") or (snake_case(f.name) if options["snake"] else f.name)
            if name not in schema.columns:
                raise MappingError("RecordColumnUnknown", cls=cls.__name__, field=f.name, column=name)
            self.slots.append(self._slot(f.name, name, hints[f.name], schema.columns[name]))
        mapped = {s.column for s in self.slots}
        if PK not in mapped or len(mapped) < len(self.slots):
            raise MappingError("RecordClassInvalid", cls=cls.__name__)
        lost = [c for c, k in schema.columns.items() if c not in mapped and not K.nullable(k)]
        self.writable = not lost

    def _slot(self, attribute: str, column_: str, hint, kind: str) -> Slot:
        can_be_null = False
        if typing.get_origin(hint) in (typing.Union, types.UnionType):
            rest = [a for a in typing.get_args(hint) if a is not type(None)]
            can_be_null, hint = len(rest) < len(typing.get_args(hint)), rest[0] if len(rest) == 1 else None
        enum = hint if isinstance(hint, type) and issubclass(hint, Enum) else None
        plain = type(next(iter(enum)).value) if enum else hint
        want = _PYTHON.get(K.base_of(kind), str)
        moment = hint if hint in _MOMENTS.get(K.base_of(kind), ()) else None
        ok = (plain is want or moment is not None) and (can_be_null or not K.nullable(kind) or column_ == PK) and (column_ == PK or K.nullable(kind) or not can_be_null)
        if not ok:
            raise MappingError("RecordTypeMismatch", cls=self.cls.__name__, field=attribute, type=kind)
        return Slot(attribute, column_, enum, can_be_null, K.base_of(kind), moment)

    def hydrate(self, row: dict):
        values = {}
        for s in self.slots:
            v = row.get(s.column)
            if v is None and not s.nullable:
                raise MappingError("RecordNull", cls=self.cls.__name__, field=s.attribute)
            try:
                if v is not None and (s.enum or s.moment):
                    v = s.enum(v) if s.enum else K.local_value(s.kind, v, self.zone, s.moment)
                values[s.attribute] = v
            except ValueError as e:
                raise MappingError("RecordEnumValue" if s.enum else "RecordTemporalValue", cls=self.cls.__name__, field=s.attribute, value=v) from e
        return self.cls(**values)

    def extract(self, obj) -> dict:
        if not isinstance(obj, self.cls):
            raise MappingError("RecordClassInvalid", cls=type(obj).__name__)
        out = {}
        for s in self.slots:
            v = getattr(obj, s.attribute)
            if s.moment and v is not None:
                v = K.local_text(s.kind, v, self.zone)
            out[s.column] = v.value if isinstance(v, Enum) else v
        return out


class Registry:
    """One record class for a table; registering the same one again changes nothing."""

    def __init__(self, db):
        self.db, self.maps = db, {}

    def register(self, cls: type, table: str | None = None) -> None:
        table = table or getattr(cls, "__millrace__", {}).get("table")
        if table in self.maps and self.maps[table].cls is not cls:
            raise MappingError("RecordTableTaken", table=table)
        self.maps[table] = RecordMap(cls, self.db.schema(table), self.db.zone)

    def forget(self, table: str) -> None:
        self.maps.pop(table, None)

    def of(self, table: str) -> RecordMap:
        if table not in self.maps:
            raise MappingError("RecordClassMissing", table=table)
        return self.maps[table]
