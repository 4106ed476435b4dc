"""The database: catalog, queries, writes, schema changes, integrity, backup."""

from __future__ import annotations

import hashlib
import io
import json
import os
import shutil
import tarfile
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import Cache, NullCache
from .errors import DataError, IoError, LockError, RelationError, SchemaError, ServiceError, TableError
from .functions import types as K
from .mapping import Registry
from .operators import integrity
from .operators.fk import WritePlan
from .operators.relational import duplicates
from .plans import indexing, query
from .plans.predicate import Condition, Filter, conjunction, encode, to_column
from .plans.query import POS
from .plans.schema import PK, SERVICE_PREFIX, Index, Relation, TableDiff, TableSchema, Unique, check_name, check_relation, relation_from_json, relation_to_json
from .sources import ndjson, point
from .sources.files import Files
from .sources.store import FILE, GENERATION, STEPS, Meta, Snapshot, Store
from .table import Table

Where = Filter | Iterable[Condition]

#: An index gets a part for data files that it does not cover once these are many or large; beyond MOST_ENTRIES parts it is
#: built anew.  Of a table of over MOST_PARTS parts those under SMALL_BYTES are gathered into one.
TAIL_FILES, TAIL_BYTES, MOST_ENTRIES = 16, 32 << 20, 8
MOST_PARTS, SMALL_BYTES = 32, 16 << 20
BACKUP_FORMAT = "millrace-backup"


class Database:
    """One directory of tables.  Reads are lazy DataFrames over the snapshot at the time of the call."""

    def __init__(self, spark: SparkSession, root: str, zone: str = "UTC", collation: str | None = None, cache: Cache | None = None, lock_timeout: float = 30.0, logger=None, broken_records: str = "Drop"):
        self.spark, self.store = spark, Store(spark, root, lock_timeout)
        self.set_broken_records(broken_records)
        self.zone, self.collation = zone, collation
        self.cache: Cache = cache or NullCache()
        self.backing_policy, self.logger = "SingleColumn", logger
        self.records = Registry(self)

    # ---------------------------------------------------------------------------------------- opening

    @classmethod
    def create(cls, spark: SparkSession, root: str, **options) -> Database:
        db = cls(spark, root, **options)
        if db.store.exists():
            raise TableError("DatabaseAlreadyExists", path=root)
        db.store.init()
        return db

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Database:
        db = cls(spark, root, **options)
        if not db.store.exists():
            raise TableError("DatabaseNotFound", path=root)
        db.store.load()
        return db

    @staticmethod
    def exists(spark: SparkSession, root: str) -> bool:
        return Store(spark, root).exists()

    def break_lock(self) -> None:
        """Removes the lock file of a writer that died; only for use when no writer is alive."""
        if self.store.files.exists(self.store.lock.path):
            self.store.files.delete(self.store.lock.path)

    def set_collation(self, collation: str | None) -> None:
        """None orders text by bytes; a collation such as UNICODE affects order and ranges only."""
        self.collation = collation

    def set_backing_policy(self, policy: str) -> None:
        if policy not in ("SingleColumn", "LeadingColumn"):
            raise RelationError("InvalidBackingPolicy", policy=policy)
        self.backing_policy = policy

    def set_broken_records(self, policy: str) -> None:
        """What loads of NDJSON do with lines that are no records: `Drop` them, or `Refuse` before anything is written."""
        if policy not in ("Drop", "Refuse"):
            raise DataError("InvalidBrokenRecordPolicy", policy=policy)
        self.broken_records = policy

    # ---------------------------------------------------------------------------------------- catalog

    def snapshot(self) -> Snapshot:
        return self.store.load()

    def begin(self, *names: str) -> Snapshot:
        """The state that a write starts from; the writer's lock is held.

        Tables that the write may touch are compared with what their last commit left.  Where files or counters were changed
        by other hands, the counters are derived from the data first, so that no id is given out twice; where data is
        missing the write is refused.
        """
        now = self.store.load(for_write=True)
        new, waiting, seen = now.copy(), list(names), set()
        while waiting:
            name = waiting.pop()
            meta = now.meta.get(name)
            if name in seen or meta is None or name not in now.tables:
                continue
            seen.add(name)
            waiting += [r.child for r in now.relations if r.parent == name]
            if self.store.freshness(meta) == "stale":
                if not all(self.store.files.exists(self.store.files.at(p)) for p in meta.parts):
                    raise TableError("TableFileMissing", table=name)
                new.meta[name] = self.store.recounted(now, name)
        if new.meta != now.meta:
            self.store.commit(new, now)
        return new

    def commit(self, new: Snapshot, old: Snapshot) -> None:
        """Brings indexes and parts of changed tables into shape and shows the new state.

        A writer whose lease ran out under way, so that another one came in between, is refused and changes nothing.
        """
        for name, meta in new.meta.items():
            before = old.meta.get(name)
            if meta is not None and name in new.tables and (before is None or meta.parts != before.parts):
                self._gathered(new, name)
                self._indexed(new, name)
        self.store.lock.renew()
        if self.store.load().version != old.version:
            raise LockError("LockLost", path=self.store.root)
        self.store.commit(new, old)

    def _gathered(self, new: Snapshot, name: str) -> None:
        """Small parts of a table of many become one."""
        meta = new.meta[name]
        if len(meta.parts) <= MOST_PARTS:
            return
        sizes = {p: sum(n for _, n in self.store.files.listed(self.store.files.at(p))) for p in meta.parts}
        small = [p for p, n in sizes.items() if n < SMALL_BYTES]
        if len(small) > 1:
            part = self.store.write(self.store.only(new, name, small).repartitionByRange(POS).sortWithinPartitions(POS), new, name)
            new.meta[name] = replace(meta, parts=[*[p for p in meta.parts if p not in small], part])

    def _indexed(self, new: Snapshot, name: str, wanted: Sequence[str] = ()) -> None:
        """Index parts for data files that lack them: where these are many, where all that the index covered was written anew,
        or where the index is wanted.  What covers nothing goes."""
        schema, meta = new.tables[name], new.meta[name]
        parts, out = set(meta.parts) | {p.rsplit("/", 1)[0] for p in meta.parts if p.count("/") == 2}, {}
        for index in schema.indexes:
            held = [] if index.name in wanted else [e for e in meta.indexes.get(index.name, []) if parts & set(e["covers"])]
            now = replace(meta, indexes={index.name: held})
            tail = self.store.tail(now, index.name)
            lost = not held and bool(meta.indexes.get(index.name))
            large = len(tail) > TAIL_FILES or sum(self.store.files.size(self.store.files.at(f)) for f in tail) > TAIL_BYTES
            if tail and (index.name in wanted or lost or large):
                if len(held) >= MOST_ENTRIES:
                    held, tail = [], self.store.all_files(meta)
                # whole parts are named by their folder, which keeps the manifest short
                folders = [p for p in meta.parts if p.count("/") == 1 and any(f.startswith(p + "/") for f in tail)]
                covers = folders + [f for f in tail if f.rsplit("/", 1)[0] not in folders]
                held = [*held, self.store.write_index(new, name, index, covers)]
            if held:
                out[index.name] = held
        new.meta[name] = replace(meta, indexes=out)

    def table(self, name: str) -> Table:
        self.schema(name)
        return Table(self, name)

    def schema(self, name: str) -> TableSchema:
        """The schema as declared, without the engine's own indexes."""
        s = self.store.schema(self.snapshot(), name)
        return replace(s, indexes=s.user_indexes)

    def has_table(self, name: str) -> bool:
        return name in self.snapshot().tables

    def table_names(self) -> list[str]:
        return list(self.snapshot().tables)

    def column_names(self, name: str) -> list[str]:
        return list(self.schema(name).columns)

    def describe(self, name: str) -> DataFrame:
        """position, column, type, comment of a table's columns."""
        s = self.schema(name)
        rows = [(i, c, k, s.column_comments.get(c) or None) for i, (c, k) in enumerate(s.columns.items())]
        return self.spark.createDataFrame(rows, "position int, column string, type string, comment string")

    def diff(self, wanted: TableSchema) -> TableDiff:
        return TableDiff.between(self.schema(wanted.name), wanted)

    def relations(self, name: str | None = None) -> list[Relation]:
        return [r for r in self.snapshot().relations if name is None or name in (r.child, r.parent)]

    def last_id(self, name: str) -> int:
        return self._meta(self.snapshot(), name).last_id

    def next_id(self, name: str) -> int:
        return self.last_id(name) + 1

    @staticmethod
    def _meta(snapshot: Snapshot, name: str) -> Meta:
        meta = snapshot.meta.get(name)
        if meta is None:
            raise TableError("MetaEntryMissing", table=name)
        return meta

    # ---------------------------------------------------------------------------------------- reading

    def stored(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """Stored form with POS: what rewrites start from; never cached."""
        return self.store.frame(snapshot or self.snapshot(), name)

    def _readable(self, name: str, where: Where = ()) -> tuple[DataFrame, TableSchema]:
        snapshot = self.snapshot()
        schema = self.store.schema(snapshot, name)
        key = (self.store.root, name, snapshot.version)
        found = self.cache.get(key)
        if found is None:
            narrowed = self._narrowed(snapshot, name, where)
            if narrowed is not None:
                return narrowed, schema
            found = self.store.frame(snapshot, name)
            self.cache.set(key, found)
        return found, schema

    def explain_index(self, name: str, where: Where) -> str | None:
        """Name of the index that a query with these conditions is planned with."""
        snapshot = self.snapshot()
        schema = self.store.schema(snapshot, name)
        conditions = where.conditions if isinstance(where, Filter) else tuple(where)
        index = indexing.choose([encode(c, schema.columns, self.zone, name) for c in conditions], schema, self._meta(snapshot, name).indexes, self.collation)
        return index.name if index else None

    def _narrowed(self, snapshot: Snapshot, name: str, where: Where) -> DataFrame | None:
        """Rows at the places that an index finds, and all rows of files that it does not cover yet; None where no index
        serves, or it finds too much."""
        conditions, meta = where.conditions if isinstance(where, Filter) else tuple(where), snapshot.meta.get(name)
        if not conditions or meta is None or not meta.indexes:
            return None
        schema = snapshot.tables[name]
        encoded = [encode(c, schema.columns, self.zone, name) for c in conditions]
        index = indexing.choose(encoded, schema, meta.indexes, self.collation)
        entries = meta.indexes[index.name] if index else []
        if not entries or not all(self.store.files.exists(self.store.files.at(e["part"])) for e in entries):
            return None
        hits = self.store.index_frame(snapshot, name, index)
        for c in indexing.servable(encoded, index):
            hits = hits.where(to_column(c, schema.columns, self.collation))
        found = hits.select(POS, FILE).limit(indexing.MOST_POSITIONS + 1).collect()
        if len(found) > indexing.MOST_POSITIONS:
            return None
        tail, live = self.store.tail(meta, index.name), set(self.store.all_files(meta))
        found = [r for r in found if r[FILE] in live]  # rows that were written anew stand in another file now
        parts = []
        if found:
            at = sorted(r[POS] for r in found)
            parts.append(self.store.only(snapshot, name, sorted({r[FILE] for r in found})).where(F.col(POS).between(at[0], at[-1]) & F.col(POS).isin(at)))
        if tail:
            parts.append(self.store.only(snapshot, name, tail))
        if not parts:
            return self.spark.createDataFrame([], schema.stored())
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read_all(self, name: str) -> DataFrame:
        df, schema = self._readable(name)
        return query.select(df.orderBy(POS), columns=schema.columns, zone=self.zone)

    def select(self, name: str, where: Where = (), order: Iterable = (), distinct: Sequence[str] = (), limit: int | None = None, offset: int | None = None, project: Sequence[str] | None = None, ordered: bool = False) -> DataFrame:
        where = where if isinstance(where, Filter) else tuple(where)
        df, schema = self._readable(name, where)
        return query.select(df, where, order, distinct, limit, offset, project, schema.columns, zone=self.zone, table=name, collation=self.collation, ordered=ordered)

    def count(self, name: str, where: Where = (), distinct: Sequence[str] = ()) -> int:
        conditions = where.conditions if isinstance(where, Filter) else tuple(where)
        if not conditions and not distinct:  # the manifest knows
            snapshot = self.snapshot()
            self.store.schema(snapshot, name)
            return self._meta(snapshot, name).rows
        df, schema = self._readable(name, conditions)
        return query.count(df, conditions, distinct, schema.columns, self.zone, name, self.collation).first()["n"]

    def row_exists(self, name: str, where: Where = ()) -> bool:
        where = where if isinstance(where, Filter) else tuple(where)
        df, schema = self._readable(name, where)
        return query.exists(df, where, columns=schema.columns, zone=self.zone, table=name, collation=self.collation)

    def by_id(self, name: str, id_: int) -> dict | None:
        """One row, without a Spark job where the driver can read it from few local files."""
        snapshot = self.snapshot()
        schema, meta = self.store.schema(snapshot, name), self._meta(snapshot, name)
        K.literal(id_, schema.columns[PK], PK)  # refuses what is no id
        if point.serves(self.store, schema, meta, self.zone):
            try:
                return point.row(self.store, schema, meta, id_)
            except (OSError, ValueError, pa.ArrowException):  # columns that older files lack, files out of the driver's reach
                pass
        got = self.select(name, [Condition(PK, "=", id_)], limit=1).collect()
        return got[0].asDict() if got else None

    def by_position(self, name: str, positions: DataFrame) -> DataFrame:
        """Rows at the positions in the one column of a DataFrame, in physical order."""
        df, schema = self._readable(name)
        return query.select(df.join(positions.toDF(POS).distinct(), POS, "left_semi").orderBy(POS), columns=schema.columns, zone=self.zone)

    def last_row(self, name: str) -> dict | None:
        df, schema = self._readable(name)
        got = df.agg(F.max_by(F.struct(*schema.columns), POS).alias("r")).first()["r"]
        return got.asDict() if got else None

    def invalidate_cache(self, name: str) -> None:
        self.cache.invalidate((self.store.root, name))

    def flush_cache(self) -> None:
        self.cache.invalidate((self.store.root,))

    # ---------------------------------------------------------------------------------------- writing

    def _encoded(self, schema: TableSchema, record: dict, partial: bool = False) -> dict:
        """Stored values of a record; keys that are no columns are dropped, and so is the id."""
        out = {}
        for c, kind in schema.columns.items():
            if c == PK:
                continue
            if c not in record:
                if partial:
                    continue
                if not K.nullable(kind):
                    raise DataError("RequiredColumnMissing", table=schema.name, column=c)
                out[c] = None
            elif record[c] is None:
                if not K.nullable(kind):
                    raise DataError("NullInColumn", table=schema.name, column=c)
                out[c] = None
            else:
                out[c] = K.literal(record[c], kind, c, self.zone)
        return out

    def insert(self, name: str, record: dict) -> int:
        return self.insert_many(name, [record])[0]

    def insert_many(self, name: str, records: Sequence[dict]) -> list[int]:
        """Appends the records as one part; all or nothing."""
        with self.store.lock:
            old = self.begin(name)
            schema, new = self.store.schema(old, name), old.copy()
            rows = [self._encoded(schema, r) for r in records]
            if not rows:
                return []
            meta = self._meta(new, name)
            for u in schema.uniques:
                self._check_new(name, u, rows, old)
            ids = list(range(meta.last_id + 1, meta.last_id + 1 + len(rows)))
            data = [(i, *[r[c] for c in schema.columns if c != PK], meta.next_pos + k) for k, (i, r) in enumerate(zip(ids, rows))]
            part = self.store.write(self.spark.createDataFrame(data, schema.stored()).coalesce(1), new, name)
            new.meta[name] = replace(meta, parts=[*meta.parts, part], rows=meta.rows + len(rows), last_id=ids[-1], next_pos=meta.next_pos + len(rows))
            self.commit(new, old)
            return ids

    def _check_new(self, name: str, u: Unique, rows: list[dict], snapshot: Snapshot) -> None:
        keys = [tuple(r[f] for f in u.fields) for r in rows if all(r.get(f) is not None for f in u.fields)]
        if len(set(keys)) < len(keys):
            raise TableError("UniqueViolation", table=name, name=u.name)
        if not keys:
            return
        df = self.stored(name, snapshot)
        if len(keys) <= 100:  # literals reach the Parquet scan
            hit = None
            for key in keys:
                one = None
                for f, v in zip(u.fields, key):
                    eq = F.col(f"`{f}`") == F.lit(v)
                    one = eq if one is None else one & eq
                hit = one if hit is None else hit | one
            found = df.where(hit)
        else:
            kinds = snapshot.tables[name].struct()
            found = df.join(self.spark.createDataFrame(keys, kinds.__class__([kinds[f] for f in u.fields])), list(u.fields), "left_semi")
        if not found.limit(1).isEmpty():
            raise TableError("UniqueViolation", table=name, name=u.name)

    def _plan(self, snapshot: Snapshot) -> WritePlan:
        return WritePlan(snapshot.tables, snapshot.relations, lambda t: self.store.frame(snapshot, t))

    def _apply(self, plan: WritePlan, old: Snapshot) -> None:
        """Writes the new state of every touched table and shows all of them at once.

        Only files that hold a touched row are written anew; where those are most of a table, all of it is, which also
        gathers what has become scattered.
        """
        new, touched = old.copy(), plan.touched()
        for t in touched:
            plan.check_unique(t, plan.final(t))
        for t in touched:
            meta = new.meta[t]
            files, every = self.store.files_of(old, t, plan.positions(t)), self.store.all_files(meta)
            some = 2 * len(files) < len(every)
            part = self.store.write(plan.final(t, self.store.only(old, t, files) if some else None), new, t)
            rows = meta.rows - (plan.gone[t].count() if t in plan.gone else 0)
            new.meta[t] = replace(meta, parts=self.store.replaced(meta, files, part) if some else [part], rows=rows)
        if touched:
            self.commit(new, old)

    def update(self, name: str, where: Where, patch: dict) -> int:
        """Rows that matched, changed or not; an `id` in the patch and keys that are no columns are passed over."""
        conditions = where.conditions if isinstance(where, Filter) else tuple(where)
        with self.store.lock:
            old = self.begin(name)
            schema = self.store.schema(old, name)
            predicate = conjunction(conditions, schema.columns, self.zone, name, self.collation)
            values = self._encoded(schema, patch, partial=True)
            df = self.stored(name, old)
            rows = df.where(predicate) if predicate is not None else df
            matched = rows.count()
            if not matched or not values:
                return matched
            plan = self._plan(old)
            for c, v in values.items():
                plan.change(name, c, rows.select(POS, F.col(f"`{c}`").alias("old"), F.lit(v).cast(df.schema[c].dataType).alias("new")))
            plan.close()
            self._apply(plan, old)
            return matched

    def delete(self, name: str, where: Where) -> int:
        """Rows of this table that went; what cascades is not counted."""
        conditions = where.conditions if isinstance(where, Filter) else tuple(where)
        with self.store.lock:
            old = self.begin(name)
            schema = self.store.schema(old, name)
            predicate = conjunction(conditions, schema.columns, self.zone, name, self.collation)
            df = self.stored(name, old)
            plan = self._plan(old)
            plan.delete(name, df.where(predicate) if predicate is not None else df)
            n = plan.gone[name].count() if name in plan.gone else 0
            plan.close()
            self._apply(plan, old)
            return n

    def truncate(self, name: str) -> None:
        """Empties a table and starts its ids anew; relations are not looked at."""
        with self.store.lock:
            old = self.begin()
            self.store.schema(old, name)
            new = old.copy()
            meta = self._meta(old, name)
            new.meta[name] = Meta(streams=meta.streams, home=meta.home)
            self.commit(new, old)

    def import_records(self, name: str, records: Sequence[dict] | DataFrame) -> int:
        """Replaces a table's content.  Ids are needed, positive and unique; the order is the input's.

        A DataFrame is checked and written without passing through the driver.
        """
        with self.store.lock:
            old = self.begin(name)
            schema, new = self.store.schema(old, name), old.copy()
            if not isinstance(records, DataFrame):
                rows = []
                for r in records:
                    i = r.get(PK)
                    if isinstance(i, bool) or not isinstance(i, int) or i < 1:
                        raise DataError("ImportIdInvalid", table=name, value=repr(i))
                    rows.append({PK: i, **self._encoded(schema, r)})
                df = self.spark.createDataFrame([tuple(r[c] for c in schema.columns) for r in rows], schema.struct())
            else:
                df = self._checked_frame(schema, records)
            df = df.withColumn(POS, F.monotonically_increasing_id())
            part = self.store.write(df, new, name)
            back = self.spark.read.schema(schema.stored()).parquet(self.store.files.at(part))
            try:
                for label, fields in (("id", (PK,)), *((u.name, u.fields) for u in schema.uniques)):
                    if not duplicates(back, fields).limit(1).isEmpty():
                        raise TableError("UniqueViolation", table=name, name=label)
            except TableError:
                self.store.files.delete(self.store.files.at(part))
                raise
            got = back.agg(F.count("*").alias("n"), F.max(PK).alias("m"), F.max(POS).alias("p")).first()
            meta = self._meta(old, name)
            new.meta[name] = replace(meta, parts=[part], rows=got["n"], last_id=max(meta.last_id, got["m"] or 0), next_pos=(got["p"] if got["p"] is not None else -1) + 1)
            self.commit(new, old)
            return got["n"]

    def _encoded_columns(self, schema: TableSchema, have: Sequence[str]) -> list:
        """Stored forms of a frame's columns, in the schema's order; nulls for those that it lacks."""
        return [
            K.encode_column(F.col(f"`{c}`").cast(K.spark_type(k)), k, self.zone) if c in have else F.lit(None).cast(K.spark_type(k))
            for c, k in schema.columns.items()
        ]

    def _checked_frame(self, schema: TableSchema, df: DataFrame) -> DataFrame:
        missing = [c for c, k in schema.columns.items() if c not in df.columns and not K.nullable(k)]
        if missing:
            raise DataError("RequiredColumnMissing", table=schema.name, column=missing[0])
        for f in df.schema.fields:
            if f.name in schema.columns and K.from_spark(f.dataType, False) != K.from_spark(K.spark_type(schema.columns[f.name]), False):
                if not (K.base_of(schema.columns[f.name]) == "float" and K.from_spark(f.dataType, False) == "int"):
                    raise DataError("TypeMismatch", column=f.name, type=schema.columns[f.name], value=f.dataType.simpleString())
        out = df.select(*[x.alias(c) for c, x in zip(schema.columns, self._encoded_columns(schema, df.columns))])
        bad = [
            F.count_if((F.col(f"`{c}`").isNull() & F.lit(not K.nullable(k))) | ~F.coalesce(K.valid(F.col(f"`{c}`"), k), F.lit(True))).alias(c)
            for c, k in schema.columns.items()
        ]
        got = out.agg(*bad, F.count_if(F.col(PK) < 1).alias("__ids")).first().asDict()
        for c, n in got.items():
            if n:
                raise DataError("ImportValuesInvalid", table=schema.name, column=PK if c == "__ids" else c, count=n)
        return out

    # ---------------------------------------------------------------------------------------- schema changes

    def _change(self, work: Callable[[Snapshot, Snapshot], object]):
        with self.store.lock:
            old = self.begin()
            new = old.copy()
            out = work(old, new)
            self.commit(new, old)
            return out

    def create_table(self, schema: TableSchema) -> None:
        def work(old, new):
            schema.checked()
            if self.store.name_taken(old, schema.name):
                raise TableError("TableAlreadyExists", table=schema.name)
            new.tables[schema.name] = schema
            home = self.store.free_home(old, schema.name)
            new.meta[schema.name] = Meta(home="" if home == schema.name else home)

        self._change(work)

    def drop_table(self, name: str) -> None:
        """Nothing happens for an unknown table; relations of the table go with it."""

        def work(old, new):
            if name not in old.tables:
                return
            gone = [r for r in new.relations if name in (r.child, r.parent)]
            new.relations = tuple(r for r in new.relations if r not in gone)
            del new.tables[name]
            new.meta.pop(name, None)
            for r in gone:
                self._free_backing(new, r)
            return self.store.home(old.meta.get(name), name)

        home = self._change(work)
        if home:
            self.store.files.delete(self.store.files.at(home))
        self.records.forget(name)

    def rename_table(self, name: str, to: str) -> None:
        def work(old, new):
            schema = self.store.schema(old, name)
            check_name(to, "table")
            if self.store.name_taken(old, to) and to.lower() != name.lower() or to == name:
                raise TableError("TableAlreadyExists", table=to)
            new.tables = {(to if n == name else n): (replace(s, name=to) if n == name else s) for n, s in old.tables.items()}
            # the table keeps its folder, so no data moves and readers of the last state are not disturbed
            moved = replace(self._meta(old, name), home=self.store.home(old.meta[name], name))
            new.meta = {(to if n == name else n): (moved if n == name else m) for n, m in new.meta.items()}
            new.relations = tuple(replace(r, child=to if r.child == name else r.child, parent=to if r.parent == name else r.parent) for r in new.relations)

        self._change(work)
        self.records.forget(name)

    def _rewrite(self, old: Snapshot, new: Snapshot, name: str, df: DataFrame) -> None:
        meta = self._meta(old, name)
        if meta.parts:
            part = self.store.write(df, new, name)
            new.meta[name] = replace(meta, parts=[part])

    def migrate(self, name: str, wanted: dict[str, str]) -> dict[str, list[str]]:
        """Adds and drops columns so that they are the wanted ones; types never change."""

        def work(old, new):
            schema = self.store.schema(old, name)
            columns = {PK: "int", **wanted}
            for c, k in columns.items():
                check_name(c)
                K.check_type(k)
                if c in schema.columns and schema.columns[c] != k:
                    raise SchemaError("MigrateColumnTypeChange", table=name, column=c)
            added, dropped = [c for c in columns if c not in schema.columns], [c for c in schema.columns if c not in columns]
            for c in added:
                if not K.default_of(columns[c])[0] and self._meta(old, name).rows:
                    raise SchemaError("MigrateColumnNoDefault", table=name, column=c)
            for c in dropped:
                self._free_column(old, schema, c)
            comments = {c: t for c, t in schema.column_comments.items() if c in columns}
            kept = {c: k for c, k in schema.columns.items() if c in columns} | {c: columns[c] for c in added}
            new.tables[name] = replace(schema, columns=kept, column_comments=comments).checked()
            df = self.stored(name, old)
            cols = [F.col(f"`{c}`") if c in schema.columns else F.lit(K.default_of(k)[1]).cast(K.spark_type(k)).alias(c) for c, k in kept.items()]
            self._rewrite(old, new, name, df.select(*cols, POS))
            return {"added": added, "dropped": dropped}

        return self._change(work)

    @staticmethod
    def _free_column(snapshot: Snapshot, schema: TableSchema, c: str) -> None:
        used = [i.name for i in schema.indexes if any(f == c for f, _ in i.fields)] + [u.name for u in schema.uniques if c in u.fields]
        used += [str(r.key) for r in snapshot.relations if (r.child, r.column) == (schema.name, c) or (r.parent, r.references) == (schema.name, c)]
        if used:
            raise SchemaError("ColumnInUse", table=schema.name, column=c, by=used)

    def reorder_columns(self, name: str, order: Sequence[str]) -> None:
        def work(old, new):
            schema = self.store.schema(old, name)
            unknown = [c for c in order if c not in schema.columns]
            if unknown:
                raise SchemaError("ReorderColumnsUnknown", table=name, columns=unknown)
            if len(set(order)) < len(order):
                raise SchemaError("ReorderColumnsDuplicate", table=name)
            full = [PK, *[c for c in order if c != PK]]
            if set(full) != set(schema.columns):
                raise SchemaError("ReorderColumnsIncomplete", table=name)
            new.tables[name] = replace(schema, columns={c: schema.columns[c] for c in full})

        self._change(work)  # Parquet finds columns by name: no data moves

    def rename_column(self, name: str, column: str, to: str) -> None:
        """Indexes, constraints, relations and comments follow."""

        def work(old, new):
            schema = self.store.schema(old, name)
            if column not in schema.columns:
                raise SchemaError("ColumnNotFound", table=name, column=column)
            if column == PK:
                raise SchemaError("PkColumnNotRenamable", table=name)
            check_name(to)
            if to in schema.columns:
                raise SchemaError("ColumnAlreadyExists", table=name, column=to)
            swap = lambda c: to if c == column else c
            service = {i.name: SERVICE_PREFIX + to for i in schema.indexes if i.service and i.name == SERVICE_PREFIX + column}
            new.tables[name] = replace(
                schema, columns={swap(c): k for c, k in schema.columns.items()},
                indexes=tuple(replace(i, name=service.get(i.name, i.name), fields=tuple((swap(f), d) for f, d in i.fields)) for i in schema.indexes),
                uniques=tuple(replace(u, fields=tuple(swap(f) for f in u.fields)) for u in schema.uniques),
                column_comments={swap(c): t for c, t in schema.column_comments.items()},
            ).checked()
            new.relations = tuple(
                replace(
                    r, column=to if (r.child, r.column) == (name, column) else r.column, references=to if (r.parent, r.references) == (name, column) else r.references,
                    backing_index=service.get(r.backing_index, r.backing_index) if r.child == name else r.backing_index,
                )
                for r in new.relations
            )
            self._rewrite(old, new, name, self.stored(name, old).withColumnRenamed(column, to))

        self._change(work)
        self.records.forget(name)

    def add_index(self, name: str, index: Index) -> None:
        def work(old, new):
            schema = self.store.schema(old, name)
            new.tables[name] = schema.with_(indexes=(*schema.indexes, index))
            self._indexed(new, name)

        self._change(work)

    def drop_index(self, name: str, index: str) -> None:
        def work(old, new):
            schema = self.store.schema(old, name)
            if index.lower() == PK:
                raise SchemaError("PrimaryIndexNotDroppable", table=name)
            found = next((i for i in schema.indexes if i.name.lower() == index.lower()), None)
            if found is None or found.service:
                raise SchemaError("IndexNotFound", table=name, index=index)
            new.tables[name] = schema.with_(indexes=tuple(i for i in schema.indexes if i is not found))
            for r in new.relations:  # relations that it backed take another one
                if r.child == name and r.backing_index == found.name:
                    new.relations = tuple(x if x is not r else replace(r, backing_index=self._back(new, r)) for x in new.relations)

        self._change(work)

    def rebuild_index(self, name: str, index: str) -> None:
        """Builds the parts of an index anew.  The primary index is the table's own order of ids (see `optimize`)."""
        if index.lower() == PK:
            self.optimize(name)
            return

        def work(old, new):
            schema = self.store.schema(old, name)
            found = next((i for i in schema.indexes if i.name.lower() == index.lower()), None)
            if found is None:
                raise SchemaError("IndexNotFound", table=name, index=index)
            self._indexed(new, name, [found.name])

        self._change(work)

    def rebuild_all_indexes(self, name: str) -> None:
        """Builds the parts of every index of the table, service ones included, anew."""
        self._change(lambda old, new: self._indexed(new, name, [i.name for i in self.store.schema(old, name).indexes]))

    def add_unique(self, name: str, unique: Unique) -> None:
        def work(old, new):
            schema = self.store.schema(old, name)
            new.tables[name] = schema.with_(uniques=(*schema.uniques, unique))
            if not duplicates(self.stored(name, old), unique.fields).limit(1).isEmpty():
                raise TableError("UniqueViolation", table=name, name=unique.name)

        self._change(work)

    def drop_unique(self, name: str, unique: str) -> None:
        def work(old, new):
            schema = self.store.schema(old, name)
            found = next((u for u in schema.uniques if u.name.lower() == unique.lower()), None)
            if found is None:
                raise SchemaError("UniqueNotFound", table=name, name=unique)
            if any(r.parent == name and r.enforced and found.fields == (r.references,) for r in old.relations):
                raise SchemaError("UniqueInUse", table=name, name=unique)
            new.tables[name] = schema.with_(uniques=tuple(u for u in schema.uniques if u is not found))

        self._change(work)

    def _back(self, new: Snapshot, r: Relation) -> str | None:
        """Name of an index that serves a relation's probes, declared if need be."""
        if not r.enforced:
            return None
        schema = new.tables[r.child]
        for i in schema.user_indexes:
            lead = i.fields[0][0] == r.column
            if lead and (len(i.fields) == 1 or self.backing_policy == "LeadingColumn"):
                return i.name
        name = SERVICE_PREFIX + r.column
        if all(i.name != name for i in schema.indexes):
            new.tables[r.child] = schema.with_(indexes=(*schema.indexes, Index(name, ((r.column, "asc"),), True)))
        return name

    @staticmethod
    def _free_backing(new: Snapshot, r: Relation) -> None:
        schema = new.tables.get(r.child)
        if schema and r.backing_index and r.backing_index.startswith(SERVICE_PREFIX) and not any(o.child == r.child and o.backing_index == r.backing_index for o in new.relations):
            new.tables[r.child] = schema.with_(indexes=tuple(i for i in schema.indexes if i.name != r.backing_index))

    def add_relation(self, relation: Relation) -> None:
        def work(old, new):
            check_relation(relation, old.tables, old.relations)
            new.relations = (*new.relations, replace(relation, backing_index=self._back(new, relation)))

        self._change(work)

    def drop_relation(self, relation: Relation) -> None:
        def work(old, new):
            found = next((r for r in old.relations if r.key == relation.key), None)
            if found is None:
                raise RelationError("RelationNotFound", relation=str(relation.key))
            new.relations = tuple(r for r in new.relations if r.key != relation.key)
            self._free_backing(new, found)

        self._change(work)

    def set_table_comment(self, name: str, text: str | None) -> None:
        self._change(lambda old, new: new.tables.__setitem__(name, replace(self.store.schema(old, name), comment=text or "")))

    def set_column_comments(self, name: str, texts: dict[str, str | None]) -> None:
        """Merged with those that are there; an empty text clears one."""

        def work(old, new):
            schema = self.store.schema(old, name)
            merged = {c: t for c, t in {**schema.column_comments, **texts}.items() if t}
            new.tables[name] = schema.with_(column_comments=merged)
            for c in texts:
                if c not in schema.columns:
                    raise SchemaError("ColumnNotFound", table=name, column=c)

        self._change(work)

    def table_comment(self, name: str) -> str | None:
        return self.schema(name).comment or None

    def column_comment(self, name: str, column: str) -> str | None:
        s = self.schema(name)
        if column not in s.columns:
            raise SchemaError("ColumnNotFound", table=name, column=column)
        return s.column_comments.get(column) or None

    # ---------------------------------------------------------------------------------------- upkeep

    def optimize(self, name: str) -> None:
        """One part, rows in order of id."""

        def work(old, new):
            schema, meta = self.store.schema(old, name), self._meta(old, name)
            if meta.parts:
                df = self.stored(name, old).orderBy(PK, POS).withColumn(POS, F.monotonically_increasing_id())
                part = self.store.write(df, new, name)
                top = self.store.spark.read.schema(schema.stored()).parquet(self.store.files.at(part)).agg(F.max(POS)).first()[0]
                new.meta[name] = replace(meta, parts=[part], next_pos=(top if top is not None else -1) + 1)

        self._change(work)

    def vacuum(self) -> int:
        """Deletes parts that the manifest does not name.  Readers that hold a shared lock are waited for; others of
        earlier snapshots must be done."""
        with self.store.lock:
            self.store.lock.exclusive()
            return self.store.vacuum(self.snapshot())

    @contextmanager
    def reading(self) -> Iterator[Snapshot]:
        """A snapshot whose parts stay while it is in use, vacuum or not."""
        held = self.store.lock.share()
        try:
            yield self.snapshot()
        finally:
            self.store.lock.release(held)

    def storage_status(self) -> dict:
        """Generation and, for each table, whether its files are what the last commit left."""
        s = self.snapshot()
        return {"generation": s.generation, "current": GENERATION, "tables": {n: self.store.freshness(m) if m else "unstamped" for n, m in s.meta.items()}}

    def migrate_storage(self, generation: int = GENERATION) -> dict:
        """Upward only, one step at a time; a step that is done already is passed over.

        Generation 2 has counters for every table in the manifest; generation 3 has parts for every declared index and
        stamps.  Tables without readable counters are skipped and reported.
        """

        def work(old, new):
            if generation < old.generation or generation > GENERATION:
                raise ServiceError("StorageGenerationInvalid", wanted=generation, now=old.generation)
            done = [g for g in sorted(STEPS) if old.generation < g <= generation]
            skipped = [n for n in old.tables if done and old.meta.get(n) is None]
            for name in [n for n in old.tables if n not in skipped]:
                if 2 in done:
                    new.meta[name] = self.store.recounted(old, name)
                if 3 in done:
                    self._indexed(new, name, [i.name for i in old.tables[name].indexes])
                    new.meta[name].stamp = self.store.stamp(new.meta[name])
            new.generation = generation
            return {"from": old.generation, "to": generation, "steps": [STEPS[g] for g in done], "skipped": skipped}

        return self._change(work)

    # ---------------------------------------------------------------------------------------- integrity

    def validate(self) -> integrity.Report:
        s = self.snapshot()
        issues = [i for t in s.tables for i in integrity.table_issues(self.store, s, t)]
        return self._logged(integrity.Report(issues + integrity.database_issues(self.store, s)).sorted())

    def validate_table(self, name: str) -> integrity.Report:
        s = self.snapshot()
        self.store.schema(s, name)
        return self._logged(integrity.Report(integrity.table_issues(self.store, s, name)).sorted())

    def _logged(self, report: integrity.Report) -> integrity.Report:
        """Every finding of a validation goes to the logger once, at the level of its severity."""
        for i in report.issues if self.logger else ():
            self.logger.log(integrity.LEVELS[i.severity], "%s %s: %s", i.category, i.table or "-", i.message)
        return report

    def repair(self, name: str | None = None) -> integrity.Report:
        """Validates and mends; failures are recorded in the report and never raised."""
        with self.store.lock:
            report = self.validate_table(name) if name else self.validate()
            old = self.store.load(for_write=True)
            new, mended = old.copy(), set()
            for issue in report.issues:
                try:
                    integrity.repair_issue(self.store, new, issue)
                    if issue.repaired and issue.table in new.tables and issue.category != "table_unverified":
                        mended.add(issue.table)
                except Exception as e:  # the report carries it
                    issue.repair_error = str(e)
                    report.issues.append(integrity.Issue("repair_failed", issue.table, str(e)))
            self.store.commit(new, None)
            for issue in report.issues:
                if issue.category in integrity.INDEX_FINDINGS and issue.repaired:
                    self.rebuild_index(issue.table, issue.context["index"])
            for t in sorted(mended):
                self.optimize(t)
                report.issues.append(integrity.Issue("table_optimized", t, "rows are in order of id", repaired=True))
            return report.sorted()

    # ---------------------------------------------------------------------------------------- backup

    def export_ndjson(self, name: str, path: str) -> None:
        """A table as NDJSON part files in row order, written by the executors."""
        df, schema = self._readable(name)
        ndjson.exported(df, schema).write.text(path)

    def import_ndjson(self, name: str, path: str, broken_lines: str | None = None) -> dict:
        """Replaces a table by the records of NDJSON files; {rows, broken, odd values}.

        Lines that are no records are dropped, or stop the import before anything is written: as `broken_lines` says, or
        else the database's policy.
        """
        schema = self.schema(name)
        good, broken = ndjson.split(ndjson.lines(self.spark, path))
        ndjson.check_names(good)
        lost = broken.count()
        if lost and (broken_lines or self.broken_records) == "Refuse":
            raise DataError("BrokenRecordBlocksRewrite", count=lost)
        records = ndjson.typed(good, schema)
        odd = records.agg(F.sum(F.size("__odd")).alias("n")).first()["n"] or 0
        rows = self.import_records(name, ndjson.filled(records, schema).orderBy(POS).drop(POS))
        return {"rows": rows, "broken": lost, "odd": odd}

    def backup(self, destination: str, check: bool = True) -> str:
        """A .tar.gz of manifest.json, information_schema.json and tables/<name>.ndjson on the driver's disk, or, where the
        destination ends in a slash, a folder of the same on any file system.

        Executors write the tables' lines.  A folder takes them as they are, each part file with its checksum; an archive
        is one file, into which the driver copies them a buffer at a time.
        """
        with self.store.lock:
            folder = destination.endswith("/")
            if not folder and os.path.isdir(destination):
                destination = os.path.join(destination, f"backup-{time.strftime('%Y%m%d-%H%M%S')}-{uuid.uuid4().hex[:6]}.tar.gz")
            if not folder and not destination.endswith((".tar.gz", ".tar")):
                destination += ".tar.gz"
            target = Files(self.spark, destination) if folder else None
            if target.exists(target.root) if folder else os.path.exists(destination):
                raise ServiceError("BackupArchiveExists", path=destination)
            if _plain(destination).startswith(_plain(self.store.root) + "/"):
                raise ServiceError("BackupDestinationInsideDb", path=destination)
            if check and self.validate().has_errors():
                raise ServiceError("BackupSourceInvalid")
            s = self.snapshot()
            catalog = json.dumps({"tables": {n: t.to_json() for n, t in s.tables.items()}, "relations": [relation_to_json(r) for r in s.relations]}, ensure_ascii=False)
            counters = {n: m.last_id for n, m in s.meta.items() if m}
            body = {"format": BACKUP_FORMAT, "version": 1, "createdAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "tables": list(s.tables), "counters": counters, "storageFormat": s.generation}
            stage = target.at("tables") if folder else self.store.files.at(f"_backup-{uuid.uuid4().hex}")
            try:
                for n, schema in s.tables.items():
                    ndjson.exported(self.store.frame(s, n), schema).write.text(f"{stage}/{n}.ndjson")
                if folder:
                    sums = {**self._part_sums(stage), "information_schema.json": hashlib.sha256(catalog.encode()).hexdigest()}
                    target.write(target.at("information_schema.json"), catalog)
                    target.replace(target.at("manifest.json"), json.dumps({**body, "checksums": sums}))  # last: without it this is no backup
                else:
                    self._packed(destination, stage, catalog, body, list(s.tables))
            finally:
                if not folder:
                    self.store.files.delete(stage)
            return destination

    def _part_sums(self, stage: str) -> dict[str, str]:
        """SHA-256 of every part file under a folder of tables, computed by the executors; one row a file comes back."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(stage)
        rows = files.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("member"), F.sha2("content", 256).alias("sum")).collect()
        return {r["member"]: r["sum"] for r in rows}

    def _packed(self, destination: str, stage: str, catalog: str, body: dict, tables: list[str]) -> None:
        sums: dict[str, str] = {}
        tmp = f"{destination}.{uuid.uuid4().hex}.tmp"
        try:
            with tarfile.open(tmp, "w:gz" if destination.endswith(".gz") else "w") as tar:

                def add(member: str, path: str) -> None:
                    with open(path, "rb") as f:
                        sums[member] = hashlib.file_digest(f, "sha256").hexdigest()
                    tar.add(path, member)
                    os.unlink(path)

                with open(f"{tmp}.part", "w", encoding="utf-8") as f:
                    f.write(catalog)
                add("information_schema.json", f"{tmp}.part")
                for n in tables:
                    whole = f"{stage}/{n}.whole"
                    self.store.files.joined(f"{stage}/{n}.ndjson", whole)
                    self.store.files.to_local(whole, f"{tmp}.part")
                    self.store.files.delete(whole)
                    add(f"tables/{n}.ndjson", f"{tmp}.part")
                data = json.dumps({**body, "checksums": sums}).encode()
                info = tarfile.TarInfo("manifest.json")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            os.replace(tmp, destination)
        finally:
            for left in (tmp, f"{tmp}.part"):
                if os.path.exists(left):
                    os.unlink(left)

    def restore(self, archive: str, adopt_schema: bool = False, prune: bool = False) -> None:
        """Lays a backup's records on the current schema, or on the backup's with `adopt_schema`.

        All tables are staged first and shown by one manifest, so a failure leaves the database as it was.  Members of an
        archive are copied to the store a buffer at a time; a folder is read where it lies.
        """
        with self.store.lock:
            stage = self.store.files.at(f"_restore-{uuid.uuid4().hex}")
            source = FolderBackup(self, archive) if archive.endswith("/") else ArchiveBackup(self, archive, stage)
            try:
                with source:
                    self._restored(source, adopt_schema, prune)
            finally:
                self.store.files.delete(stage)

    def _restored(self, source, adopt_schema: bool, prune: bool) -> None:
        manifest = source.manifest
        if manifest.get("format") != BACKUP_FORMAT:
            raise ServiceError("BackupFormatUnknown", format=manifest.get("format"))
        if manifest.get("version") != 1:
            raise ServiceError("BackupVersionUnknown", version=manifest.get("version"))
        source.check()
        raw = json.loads(source.catalog())
        archived = {n: TableSchema.from_json(n, t) for n, t in raw["tables"].items()}
        old = self.begin()
        new = old.copy()
        extra = sorted(set(old.tables) - set(archived))
        if adopt_schema:
            if extra and not prune:
                raise ServiceError("RestoreTableSetMismatch", tables=extra)
            new.tables, new.relations = archived, tuple(relation_from_json(r) for r in raw.get("relations", ()))
            new.meta = {n: new.meta.get(n) or Meta() for n in archived}
        elif set(old.tables) != set(archived):
            raise ServiceError("RestoreTableSetMismatch", tables=sorted(set(old.tables) ^ set(archived)))
        try:
            for n, schema in new.tables.items():
                good, broken = ndjson.split(ndjson.lines(self.spark, source.table(n)))
                ndjson.check_names(good)
                lost = broken.count() if self.broken_records == "Refuse" else 0
                if lost:
                    raise DataError("BrokenRecordBlocksRewrite", count=lost)
                df = ndjson.filled(ndjson.typed(good, schema), schema).orderBy(PK, POS).withColumn(POS, F.monotonically_increasing_id())
                lacking = [c for c, k in schema.columns.items() if not K.default_of(k)[0]]
                if lacking:
                    short = good.where(F.size(F.array_intersect("__keys", F.array(*[F.lit(c) for c in lacking]))) < len(lacking))
                    if not short.limit(1).isEmpty():
                        raise DataError("RequiredColumnMissing", table=n, column=lacking[0])
                part = self.store.write(df, new, n)
                got = self.spark.read.schema(schema.stored()).parquet(self.store.files.at(part)).agg(F.count("*").alias("n"), F.max(PK).alias("m"), F.max(POS).alias("p")).first()
                last, top = max(manifest.get("counters", {}).get(n, 0), got["m"] or 0), got["p"] if got["p"] is not None else -1
                new.meta[n] = replace(new.meta[n], parts=[part], rows=got["n"], last_id=last, next_pos=top + 1)
        except (DataError, SchemaError):
            raise
        except Exception as e:
            raise ServiceError("RestoreFailed", reason=str(e)) from e
        new.generation = GENERATION
        self.commit(new, old)
        for n in extra if adopt_schema else []:
            self.store.files.delete(self.store.files.at(self.store.home(old.meta.get(n), n)))


def _plain(path: str) -> str:
    """A path without a scheme that names the local file system, for comparison."""
    path = path.removeprefix("file://") if path.startswith("file://") else path
    return path.rstrip("/") if "://" in path else os.path.abspath(path)


class FolderBackup:
    """A backup that is a folder of part files."""

    def __init__(self, db: Database, path: str):
        self.db, self.files = db, Files(db.spark, path)
        if not self.files.exists(self.files.at("manifest.json")):
            raise ServiceError("BackupNotFound", path=path)
        self.manifest = self.files.read_json(self.files.at("manifest.json"))

    def __enter__(self) -> FolderBackup:
        return self

    def __exit__(self, *_) -> None: ...

    def catalog(self) -> str:
        return self.files.read(self.files.at("information_schema.json"))

    def check(self) -> None:
        found = {**self.db._part_sums(self.files.at("tables")), "information_schema.json": hashlib.sha256(self.catalog().encode()).hexdigest()}
        want = self.manifest.get("checksums", {})
        for member in sorted({*want, *found}):
            if want.get(member) != found.get(member):
                raise ServiceError("BackupChecksumMismatch", member=member)

    def table(self, name: str) -> str:
        return self.files.at("tables", f"{name}.ndjson")


class ArchiveBackup:
    """A backup that is one tar file on the driver's disk."""

    def __init__(self, db: Database, path: str, stage: str):
        self.db, self.stage = db, stage
        if not os.path.exists(path):
            raise ServiceError("BackupNotFound", path=path)
        self.tar = tarfile.open(path)
        self.manifest = json.load(self.tar.extractfile("manifest.json"))

    def __enter__(self) -> ArchiveBackup:
        return self

    def __exit__(self, *_) -> None:
        self.tar.close()

    def catalog(self) -> str:
        return self.tar.extractfile("information_schema.json").read().decode("utf-8")

    def check(self) -> None:
        for member, want in self.manifest.get("checksums", {}).items():
            try:
                with self.tar.extractfile(member) as f:
                    ok = hashlib.file_digest(f, "sha256").hexdigest() == want
            except KeyError:
                ok = False
            if not ok:
                raise ServiceError("BackupChecksumMismatch", member=member)

    def table(self, name: str) -> str:
        """The member, copied to the store for the executors to read."""
        path, local = f"{self.stage}/{name}.ndjson", None
        try:
            with self.tar.extractfile(f"tables/{name}.ndjson") as f, tempfile.NamedTemporaryFile(delete=False) as out:
                local = out.name
                shutil.copyfileobj(f, out, 1 << 22)
            self.db.store.files.from_local(local, path)
        finally:
            if local:
                os.unlink(local)
        return path


__all__ = ["Database", "IoError"]
