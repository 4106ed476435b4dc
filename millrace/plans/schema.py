"""Catalog objects: tables, indexes, unique constraints and relations, with their checks and differences."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from ..errors import RelationError, SchemaError
from ..functions import types as K

PK = "id"
SERVICE_PREFIX = "_fk_"
RESERVED = {"_pendingRename"}
_NAME = re.compile(r"(?!\d+\Z)[A-Za-z0-9_][A-Za-z0-9_-]{0,63}")
ACTIONS = ("noAction", "cascade", "setNull", "restrict")
KINDS = ("belongsTo", "hasMany", "hasOne")


def check_name(name: str, what: str = "column") -> None:
    """Names of letters, digits, _ and -, not all digits, up to 64 long; some are kept for the engine."""
    if not isinstance(name, str) or not _NAME.fullmatch(name) or (what == "table" and name in RESERVED):
        raise SchemaError("InvalidIdentifier", name=name, what=what)


@dataclass(frozen=True)
class Index:
    name: str
    fields: tuple[tuple[str, str], ...]  # (column, asc or desc)
    service: bool = False

    @staticmethod
    def on(name: str, *fields: str | tuple[str, str]) -> Index:
        return Index(name, tuple((f, "asc") if isinstance(f, str) else (f[0], f[1].lower()) for f in fields))


@dataclass(frozen=True)
class Unique:
    name: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Relation:
    """`child.column` refers to `parent.references`; kind tells from which side it was declared."""

    child: str
    column: str
    parent: str
    references: str = PK
    kind: str = "belongsTo"
    on_delete: str = "noAction"
    on_update: str = "noAction"
    backing_index: str | None = None

    @staticmethod
    def declared(from_: str, foreign_key: str, to: str, references: str = PK, kind: str = "belongsTo", on_delete: str = "noAction", on_update: str = "noAction") -> Relation:
        """belongsTo is declared by the child, hasMany and hasOne by the parent."""
        child, parent = (from_, to) if kind == "belongsTo" else (to, from_)
        return Relation(child, foreign_key, parent, references, kind, on_delete, on_update)

    @property
    def key(self) -> tuple:
        return self.child, self.column, self.parent, self.references

    @property
    def enforced(self) -> bool:
        return self.on_delete != "noAction" or self.on_update != "noAction"


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: dict[str, str]
    indexes: tuple[Index, ...] = ()
    uniques: tuple[Unique, ...] = ()
    comment: str = ""
    column_comments: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def create(name: str, columns: dict[str, str], indexes=(), uniques=(), comment: str = "", column_comments: dict[str, str] | None = None) -> TableSchema:
        """A checked schema; `id int` is put first where it is missing."""
        return TableSchema(name, {PK: "int", **columns}, tuple(indexes), tuple(uniques), comment, dict(column_comments or {})).checked()

    def checked(self) -> TableSchema:
        check_name(self.name, "table")
        if next(iter(self.columns), None) != PK or self.columns[PK] != "int":
            raise SchemaError("PrimaryKeyInvalid", table=self.name)
        for c, kind in self.columns.items():
            check_name(c)
            K.check_type(kind)
        names: set[str] = set()
        for i in self.indexes:
            if not i.service:
                check_name(i.name, "index")
            if i.name.lower() in names or i.name.lower() == PK:
                raise SchemaError("DuplicateIndexName", table=self.name, index=i.name)
            if i.name.startswith(SERVICE_PREFIX) and not i.service:
                raise SchemaError("ReservedIndexName", table=self.name, index=i.name)
            names.add(i.name.lower())
            if not i.fields or len({f for f, _ in i.fields}) != len(i.fields) or any(d not in ("asc", "desc") for _, d in i.fields):
                raise SchemaError("InvalidIndexFields", table=self.name, index=i.name)
            self._known(f for f, _ in i.fields)
        seen: set[str] = set()
        for u in self.uniques:
            check_name(u.name, "constraint")
            if u.name.lower() in seen or not u.fields or len(set(u.fields)) != len(u.fields):
                raise SchemaError("InvalidUniqueConstraint", table=self.name, name=u.name)
            seen.add(u.name.lower())
            self._known(u.fields)
        self._known(self.column_comments)
        return self

    def _known(self, names) -> None:
        for n in names:
            if n not in self.columns:
                raise SchemaError("ColumnNotFound", table=self.name, column=n)

    @property
    def user_indexes(self) -> tuple[Index, ...]:
        return tuple(i for i in self.indexes if not i.service)

    def struct(self) -> T.StructType:
        fields = [T.StructField(c, K.spark_type(kind), True, {"type": kind, "comment": self.column_comments.get(c, "")}) for c, kind in self.columns.items()]
        return T.StructType(fields)

    def stored(self) -> T.StructType:
        return T.StructType([*self.struct().fields, T.StructField("__pos", T.LongType())])

    def with_(self, **changes) -> TableSchema:
        return replace(self, **changes).checked()

    def to_json(self) -> dict:
        out: dict = {"columns": self.columns}
        if self.comment:
            out["tableComment"] = self.comment
        if any(self.column_comments.values()):
            out["columnComment"] = {c: t for c, t in self.column_comments.items() if t}
        out["unique"] = [{"name": u.name, "fields": list(u.fields)} for u in self.uniques]
        out["indexes"] = [{"name": i.name, "fields": [{"field": f, "direction": d} for f, d in i.fields], **({"isService": True} if i.service else {})} for i in self.indexes]
        return out

    @staticmethod
    def from_json(name: str, raw: dict) -> TableSchema:
        """Strict: anything that is not a schema raises."""
        try:
            indexes = tuple(
                Index(i["name"], tuple((f["field"], f.get("direction", "asc")) for f in i["fields"]), bool(i.get("isService")))
                for i in raw.get("indexes", ()) if not i.get("isPrimary")
            )
            uniques = tuple(Unique(u["name"], tuple(u["fields"])) for u in raw.get("unique", ()))
            return TableSchema(name, dict(raw["columns"]), indexes, uniques, raw.get("tableComment", ""), dict(raw.get("columnComment", {}))).checked()
        except (KeyError, TypeError, AttributeError) as e:
            raise SchemaError("InvalidSchemaFile", table=name, reason=str(e)) from e


def relation_to_json(r: Relation) -> dict:
    first, second = (r.child, r.parent) if r.kind == "belongsTo" else (r.parent, r.child)
    out = {"from": first, "foreignKey": r.column, "to": second, "references": r.references, "type": r.kind}
    out |= {k: v for k, v in (("onDelete", r.on_delete), ("onUpdate", r.on_update)) if v != "noAction"}
    return out | ({"backingIndex": r.backing_index} if r.backing_index else {})


def relation_from_json(raw: dict) -> Relation:
    try:
        r = Relation.declared(raw["from"], raw["foreignKey"], raw["to"], raw["references"], raw["type"], raw.get("onDelete", "noAction"), raw.get("onUpdate", "noAction"))
    except KeyError as e:
        raise SchemaError("InvalidSchemaFile", table="relations", reason=str(e)) from e
    return replace(r, backing_index=raw.get("backingIndex"))


def check_relation(r: Relation, tables: dict[str, TableSchema], others: tuple[Relation, ...]) -> None:
    """Both ends exist and have one base type; setNull needs a nullable column; a relation is declared once."""
    if r.kind not in KINDS or r.on_delete not in ACTIONS or r.on_update not in ACTIONS:
        raise RelationError("InvalidRelation", relation=str(r.key))
    for t, c in ((r.child, r.column), (r.parent, r.references)):
        if t not in tables:
            raise RelationError("RelationTableNotFound", table=t)
        if c not in tables[t].columns:
            raise RelationError("RelationColumnNotFound", table=t, column=c)
    child = tables[r.child].columns[r.column]
    if K.base_of(child) != K.base_of(tables[r.parent].columns[r.references]):
        raise RelationError("RelationTypeMismatch", relation=str(r.key))
    if "setNull" in (r.on_delete, r.on_update) and not K.nullable(child):
        raise RelationError("SetNullNeedsNullable", child=r.child, column=r.column)
    unique = r.references == PK or any(u.fields == (r.references,) for u in tables[r.parent].uniques)
    if r.enforced and not unique:
        raise RelationError("RelationReferencesNotUnique", table=r.parent, column=r.references)
    if any(o.key == r.key for o in others):
        raise RelationError("RelationDuplicate", relation=str(r.key))


@dataclass(frozen=True)
class TableDiff:
    """How a wanted schema differs from a table's; comments do not count."""

    added_columns: dict[str, str]
    dropped_columns: tuple[str, ...]
    changed_types: dict[str, tuple[str, str]]
    reordered: bool
    added_indexes: tuple[str, ...]
    dropped_indexes: tuple[str, ...]
    changed_indexes: tuple[str, ...]
    added_uniques: tuple[str, ...]
    dropped_uniques: tuple[str, ...]
    changed_uniques: tuple[str, ...]

    @property
    def is_empty(self) -> bool:
        return not any(vars(self).values())

    @staticmethod
    def between(now: TableSchema, wanted: TableSchema) -> TableDiff:
        a, b = now.columns, wanted.columns
        ia, ib = ({i.name.lower(): i.fields for i in s.user_indexes} for s in (now, wanted))
        ua, ub = ({u.name: frozenset(u.fields) for u in s.uniques} for s in (now, wanted))
        common = [c for c in a if c in b]
        return TableDiff(
            {c: t for c, t in b.items() if c not in a}, tuple(c for c in a if c not in b), {c: (a[c], b[c]) for c in common if a[c] != b[c]},
            common != [c for c in b if c in a], tuple(k for k in ib if k not in ia), tuple(k for k in ia if k not in ib), tuple(k for k in ia if k in ib and ia[k] != ib[k]),
            tuple(k for k in ub if k not in ua), tuple(k for k in ua if k not in ub), tuple(k for k in ua if k in ub and ua[k] != ub[k]),
        )
