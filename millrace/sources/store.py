"""Versioned Parquet snapshots behind one manifest.

    root/_manifest.json             format, version, schemas, relations and, for each table, parts, counters, streams, indexes
    root/<home>/p-<part>/*.parquet  one base part and appended ones; parts never change
    root/<home>/i-<part>/*.parquet  entries of an index for some of the data files, sorted by the index's columns

A part is named by its folder, or by those of its files that are still valid after a write replaced the others.  A table's
home is the folder that it was made in; a renamed table keeps it.

A commit writes new parts and then replaces the manifest by one rename, so writes to any number of tables appear at once;
readers hold on to the parts they began with.  Parts are deleted when neither the new nor the last manifest names them.
"""

from __future__ import annotations

import copy
import hashlib
import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IoError, TableError
from ..plans.query import POS
from ..plans.schema import Index, Relation, TableSchema, relation_from_json, relation_to_json
from .files import Files, WriterLock

GENERATION = 3
#: What each generation brought; a database is brought up one step at a time.
STEPS = {2: "counters in the manifest", 3: "index parts and stamps"}
MANIFEST = "_manifest.json"
INDEX_FORMAT = 2
#: File of a row, in an index part.
FILE = "__file"
#: Features a reader must know (incompat), a writer must know (roCompat), or may ignore (compat).
FEATURES = {"compat": ["index-parts"], "roCompat": ["append-parts", "streams"], "incompat": ["parquet-snapshots"]}


@dataclass
class Meta:
    """A table's parts and counters, the last batch of each stream into it, and the parts of its indexes.

    `stamp` is a digest of the files' names and sizes and of the counters as the last commit left them.
    """

    parts: list[str] = field(default_factory=list)
    rows: int = 0
    last_id: int = 0
    next_pos: int = 0
    streams: dict[str, int] = field(default_factory=dict)
    indexes: dict[str, list[dict]] = field(default_factory=dict)
    home: str = ""
    stamp: str = ""


@dataclass
class Snapshot:
    version: int
    tables: dict[str, TableSchema]
    relations: tuple[Relation, ...]
    meta: dict[str, Meta]
    generation: int = GENERATION
    renaming: dict | None = None

    def copy(self) -> Snapshot:
        return Snapshot(self.version, dict(self.tables), self.relations, copy.deepcopy(self.meta), self.generation, self.renaming)


def folder(part: str) -> str:
    """Folder of a part that is named by it or by a file in it."""
    return "/".join(part.split("/")[:2])


class Store:
    def __init__(self, spark: SparkSession, root: str, lock_timeout: float = 30.0):
        self.spark, self.files = spark, Files(spark, root)
        self.root, self.path = self.files.root, self.files.at(MANIFEST)
        self.lock = WriterLock(self.files, lock_timeout)

    # ---------------------------------------------------------------------------------------- manifest

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def init(self) -> None:
        self.files.mkdirs(self.root)
        self.commit(Snapshot(0, {}, (), {}), None)

    def load(self, for_write: bool = False) -> Snapshot:
        """The last committed state.  Writers are refused where the format has features that they must know and do not."""
        try:
            raw = self.files.read_json(self.path)
        except ValueError as e:
            raise IoError("ManifestUnreadable", path=self.path, reason=str(e)) from e
        unknown = set(raw["format"]["incompat"]) - set(FEATURES["incompat"])
        if unknown or raw["format"]["generation"] > GENERATION:
            raise IoError("StorageFormatUnknown", features=sorted(unknown), generation=raw["format"]["generation"])
        strange = set(raw["format"].get("roCompat", ())) - set(FEATURES["roCompat"])
        if for_write and strange:
            raise IoError("StorageReadOnly", features=sorted(strange))
        tables = {n: TableSchema.from_json(n, s) for n, s in raw["tables"].items()}
        meta = {}
        for n, m in raw["meta"].items():
            ok = isinstance(m, dict) and all(isinstance(m.get(k), int) for k in ("rows", "last_id", "next_pos")) and isinstance(m.get("parts"), list)
            meta[n] = Meta(**{k: m[k] for k in Meta.__dataclass_fields__ if k in m}) if ok else None
        return Snapshot(raw["version"], tables, tuple(relation_from_json(r) for r in raw["relations"]), meta, raw["format"]["generation"], raw.get("renaming"))

    def commit(self, new: Snapshot, old: Snapshot | None) -> None:
        new.version += 1
        for n, m in new.meta.items():
            if m is not None and (old is None or m != old.meta.get(n)):
                m.stamp = self.stamp(m)
        body = {
            "format": {"generation": new.generation, **FEATURES}, "version": new.version, "tables": {n: s.to_json() for n, s in new.tables.items()},
            "relations": [relation_to_json(r) for r in new.relations], "meta": {n: vars(m) for n, m in new.meta.items() if m is not None},
        }
        if new.renaming:
            body["renaming"] = new.renaming
        self.files.replace(self.path, json.dumps(body, ensure_ascii=False, indent=1))
        if old is not None:
            self._sweep(new, old)

    def _sweep(self, new: Snapshot, old: Snapshot) -> None:
        """Parts of the last manifest stay for its readers; those of the one before it go."""
        keep = self.named(new) | self.named(old)
        for n, m_new in new.meta.items():
            m_old = old.meta.get(n)
            if m_new is None or m_old is None or (m_new.parts == m_old.parts and m_new.indexes == m_old.indexes):
                continue
            self._delete_unnamed(self.home(m_new, n), keep)

    def _delete_unnamed(self, home: str, keep: set[str]) -> int:
        gone = [p for p in self.files.names(self.files.at(home)) if p.startswith(("p-", "i-")) and f"{home}/{p}" not in keep]
        for part in gone:
            self.files.delete(self.files.at(home, part))
        return len(gone)

    def vacuum(self, snapshot: Snapshot) -> int:
        keep = self.named(snapshot)
        return sum(self._delete_unnamed(self.home(m, n), keep) for n, m in snapshot.meta.items())

    @staticmethod
    def named(snapshot: Snapshot) -> set[str]:
        """Folders that a manifest names."""
        metas = [m for m in snapshot.meta.values() if m]
        return {folder(p) for m in metas for p in m.parts} | {e["part"] for m in metas for entries in m.indexes.values() for e in entries}

    @staticmethod
    def home(meta: Meta | None, name: str) -> str:
        return (meta.home if meta else "") or name

    def free_home(self, snapshot: Snapshot, name: str) -> str:
        """A folder for a new table: its name, unless a renamed table lives there or files were left."""
        taken = {self.home(m, n) for n, m in snapshot.meta.items()}
        return name if name not in taken and not self.files.exists(self.files.at(name)) else f"{name}-{self.new_name()[:8]}"

    @staticmethod
    def new_name() -> str:
        return uuid.uuid4().hex

    # ---------------------------------------------------------------------------------------- stamps

    def stamp(self, meta: Meta) -> str:
        sizes = [(p, n, size) for p in meta.parts for n, size in self.files.listed(self.files.at(p)) if n.endswith(".parquet")]
        return hashlib.sha256(repr((sizes, meta.rows, meta.last_id, meta.next_pos)).encode()).hexdigest()

    def freshness(self, meta: Meta) -> str:
        """stamped, stale (files or counters are not what the last commit left) or unstamped."""
        return "unstamped" if not meta.stamp else "stamped" if meta.stamp == self.stamp(meta) else "stale"

    def recounted(self, snapshot: Snapshot, name: str) -> Meta:
        """Counters derived from the data; ids never fall behind what was given out."""
        meta = snapshot.meta[name]
        got = self.frame(snapshot, name).agg(F.count("*").alias("n"), F.max("id").alias("m"), F.max(POS).alias("p")).first()
        return replace(meta, rows=got["n"], last_id=max(meta.last_id, got["m"] or 0), next_pos=max(meta.next_pos, (got["p"] if got["p"] is not None else -1) + 1))

    # ---------------------------------------------------------------------------------------- tables

    def frame(self, snapshot: Snapshot, name: str) -> DataFrame:
        """Stored form of a table with POS."""
        schema, meta = self.schema(snapshot, name), snapshot.meta.get(name)
        if meta is None:
            raise TableError("MetaEntryMissing", table=name)
        if not meta.parts:
            return self.spark.createDataFrame([], schema.stored())
        return self.spark.read.schema(schema.stored()).parquet(*[self.files.at(p) for p in meta.parts])

    @staticmethod
    def schema(snapshot: Snapshot, name: str) -> TableSchema:
        if name not in snapshot.tables:
            raise TableError("TableNotFound", table=name)
        return snapshot.tables[name]

    def write(self, df: DataFrame, snapshot: Snapshot, name: str) -> str:
        """A new part of a table, in the form of its schema in the snapshot."""
        part = f"{self.home(snapshot.meta.get(name), name)}/p-{self.new_name()}"
        df.select(*[F.col(f"`{f.name}`") for f in snapshot.tables[name].stored().fields]).write.parquet(self.files.at(part))
        return part

    # ---------------------------------------------------------------------------------------- index parts

    @staticmethod
    def covered(entry: dict, file: str) -> bool:
        return file in entry["covers"] or folder(file) in entry["covers"]

    def tail(self, meta: Meta, index: str) -> list[str]:
        """Data files that no part of the index covers."""
        entries = meta.indexes.get(index, [])
        return [f for f in self.all_files(meta) if not any(self.covered(e, f) for e in entries)]

    def index_schema(self, schema: TableSchema, index: Index) -> T.StructType:
        kinds = schema.struct()
        return T.StructType([*(kinds[f] for f, _ in index.fields), T.StructField(POS, T.LongType()), T.StructField(FILE, T.StringType())])

    def index_frame(self, snapshot: Snapshot, name: str, index: Index) -> DataFrame:
        entries = snapshot.meta[name].indexes.get(index.name, [])
        return self.spark.read.schema(self.index_schema(snapshot.tables[name], index)).parquet(*[self.files.at(e["part"]) for e in entries])

    def write_index(self, snapshot: Snapshot, name: str, index: Index, parts: list[str]) -> dict:
        """An index part for data parts: the index's columns, sorted, with the place of every row."""
        fields = [F.col(f"`{f}`") for f, _ in index.fields]
        source = self.only(snapshot, name, parts).select(*fields, POS, F.array_join(F.slice(F.split("_metadata.file_path", "/"), -3, 3), "/").alias(FILE))
        part = f"{self.home(snapshot.meta.get(name), name)}/i-{self.new_name()}"
        source.repartitionByRange(*fields, F.col(POS)).sortWithinPartitions(*fields, POS).write.parquet(self.files.at(part))
        rows = self.spark.read.parquet(self.files.at(part)).count()
        return {"part": part, "covers": list(parts), "rows": rows, "format": INDEX_FORMAT}

    # ---------------------------------------------------------------------------------------- files

    def files_of(self, snapshot: Snapshot, name: str, rows: DataFrame) -> list[str]:
        """Data files of a table that hold the rows at the positions in `rows`."""
        where = self.frame(snapshot, name).select(POS, "_metadata.file_path").join(rows.select(POS), POS, "left_semi")
        return sorted("/".join(r[0].split("/")[-3:]) for r in where.select("file_path").distinct().collect())

    def all_files(self, meta: Meta) -> list[str]:
        out = []
        for p in meta.parts:
            out += [p] if p.count("/") == 2 else [f"{p}/{n}" for n in self.files.names(self.files.at(p)) if n.endswith(".parquet")]
        return out

    def only(self, snapshot: Snapshot, name: str, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema(snapshot, name).stored()).parquet(*[self.files.at(f) for f in files])

    def replaced(self, meta: Meta, files: list[str], part: str) -> list[str]:
        """The parts of a table after the rows of `files` were written anew as `part`."""
        gone, out = set(files), []
        for p in meta.parts:
            own = [p] if p.count("/") == 2 else [f"{p}/{n}" for n in self.files.names(self.files.at(p)) if n.endswith(".parquet")]
            out += [p] if not gone & set(own) else [f for f in own if f not in gone]
        return [*out, part]

    def name_taken(self, snapshot: Snapshot, name: str) -> bool:
        return name.lower() in {n.lower() for n in snapshot.tables}
