"""Databases kept as NDJSON directories: information_schema.json, meta.json and <table>/<table>.ndjson.

Imports such a directory into a database of this engine, exports one, and reports what is wrong with one.  Table files
have lower-case names.  Index files are never needed: the engine's files carry their own statistics.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, IoError
from ..functions import types as K
from ..operators.integrity import SAMPLE, Issue, Report
from ..plans.query import POS
from ..plans.schema import PK, TableSchema, relation_from_json, relation_to_json
from . import ndjson
from .files import Files

SCHEMA, META = "information_schema.json", "meta.json"


def _catalog(files: Files) -> tuple[dict[str, TableSchema], tuple, dict]:
    if not files.exists(files.at(SCHEMA)):
        raise IoError("SchemaFileMissing", path=files.at(SCHEMA))
    raw = files.read_json(files.at(SCHEMA))
    tables = {n: TableSchema.from_json(n, t) for n, t in raw.get("tables", {}).items()}
    meta = files.read_json(files.at(META)) if files.exists(files.at(META)) else {}
    return tables, tuple(relation_from_json(r) for r in raw.get("relations", ())), meta


def table_path(files: Files, name: str) -> str:
    return files.at(name.lower(), f"{name.lower()}.ndjson")


def torn(files: Files, path: str) -> bool:
    """Whether the file's last line was never finished."""
    size = files.size(path)
    if not size:
        return False
    stream = files.fs.open(files._path(path))
    try:
        stream.seek(size - 1)
        return stream.read() != 10
    finally:
        stream.close()


def read_table(spark: SparkSession, files: Files, schema: TableSchema) -> DataFrame:
    """Records in file order with missing keys filled, in stored form with POS."""
    good, _ = ndjson.split(ndjson.lines(spark, table_path(files, schema.name)))
    ndjson.check_names(good)
    return ndjson.filled(ndjson.typed(good, schema), schema)


def import_directory(db, path: str) -> dict[str, int]:
    """Creates the directory's tables and relations in `db` and loads their records; rows by table.

    Values are taken over as they are stored, as an exact copy is wanted; counters never fall below the directory's.
    """
    files = Files(db.spark, path)
    tables, relations, meta = _catalog(files)
    out = {}
    for name, schema in tables.items():
        db.create_table(schema)
        if db.broken_records == "Refuse" and files.exists(table_path(files, name)):
            _refuse_broken(db.spark, files, name)
        with db.store.lock:
            old = db.begin()
            new = old.copy()
            if files.exists(table_path(files, name)):
                part = db.store.write(read_table(db.spark, files, schema), new, name)
                stored = db.spark.read.schema(schema.stored()).parquet(db.store.files.at(part))
                got = stored.agg(F.count("*").alias("n"), F.max(PK).alias("m"), F.max(POS).alias("p")).first()
                entry = new.meta[name]
                entry.parts, entry.rows = [part], got["n"]
                entry.last_id = max(got["m"] or 0, meta.get(name, {}).get("lastInsertedId", 0))
                entry.next_pos = (got["p"] if got["p"] is not None else -1) + 1
                db.commit(new, old)
            out[name] = new.meta[name].rows
    for r in relations:
        db.add_relation(r)
    return out


def _refuse_broken(spark: SparkSession, files: Files, name: str) -> None:
    """Stops a load that would lose lines.  An unfinished last line was never acknowledged and may go."""
    path = table_path(files, name)
    _, broken = ndjson.split(ndjson.lines(spark, path))
    n = broken.count()
    if n and torn(files, path):
        last = ndjson.lines(spark, path).orderBy(F.desc(POS)).first()
        n -= int(broken.where(F.col(POS) == last[POS]).count())
    if n:
        raise DataError("BrokenRecordBlocksRewrite", count=n)


def export_directory(db, path: str) -> None:
    """Writes the directory.  Executors write a table's lines; its one file is put together from theirs without a pass
    through Python."""
    files, s = Files(db.spark, path), db.snapshot()
    meta, stage = {}, f"{path}/.stage-{db.store.new_name()}"
    try:
        for name, schema in s.tables.items():
            target = table_path(files, name)
            files.mkdirs(files.at(name.lower()))
            ndjson.exported(db.store.frame(s, name), schema).write.text(f"{stage}/{name}")
            files.joined(f"{stage}/{name}", target)
            meta[name] = {"lastInsertedId": s.meta[name].last_id, "lineCount": s.meta[name].rows, "byteSize": files.size(target)}
    finally:
        files.delete(stage)
    catalog = {"tables": {n: t.to_json() for n, t in s.tables.items()}, "relations": [relation_to_json(r) for r in s.relations]}
    files.replace(files.at(SCHEMA), json.dumps(catalog, ensure_ascii=False))
    files.replace(files.at(META), json.dumps(meta))


def validate_directory(spark: SparkSession, path: str) -> Report:
    """Findings on the files of a directory: lines, keys, nulls, ids, counters, files that belong to nothing."""
    files = Files(spark, path)
    tables, _, meta = _catalog(files)
    issues: list[Issue] = []
    if meta.get("_pendingRename"):
        issues.append(Issue("rename_incomplete", None, "a rename was begun and not finished", context=meta["_pendingRename"]))
    for name in meta:
        if name not in tables and name != "_pendingRename":
            issues.append(Issue("meta_orphan_entry", name, "meta.json has an entry for no table"))
    known = {n.lower() for n in tables} | {SCHEMA, META}
    issues += [Issue("orphan_db_entry", None, f"{e} belongs to no table", context={"entry": e}) for e in files.names(path) if e not in known and not e.startswith(".")]
    for name, schema in tables.items():
        file = table_path(files, name)
        if not files.exists(file):
            issues.append(Issue("table_file_missing", name, "the data file is missing"))
            continue
        if not isinstance(meta.get(name), dict):
            issues.append(Issue("meta_entry_missing" if name not in meta else "meta_entry_corrupt", name, "meta.json has no usable entry"))
        declared = {f"{name.lower()}.ndjson", "id.index.ndjson", *(f"{i.name.lower()}.index.ndjson" for i in schema.indexes)}
        issues += [Issue("orphan_index_file", name, f"{e} is not declared", context={"file": e}) for e in files.names(files.at(name.lower())) if e not in declared]
        issues += _lines(spark, files, file, schema, meta.get(name))
    return Report(issues).sorted()


def _lines(spark: SparkSession, files: Files, file: str, schema: TableSchema, entry) -> list[Issue]:
    name, out = schema.name, []
    good, broken = ndjson.split(ndjson.lines(spark, file))
    lost = broken.orderBy(POS).limit(SAMPLE).collect()
    n_broken = broken.count()
    if n_broken and torn(files, file) and lost[-1]["value"] == broken.orderBy(F.desc(POS)).first()["value"]:
        n_broken -= 1  # an unfinished last line was never acknowledged
        lost = lost[: max(0, n_broken)]
    if n_broken:
        out.append(Issue("broken_record", name, f"{n_broken} unreadable lines", context={"lines": [r["value"] for r in lost], "count": n_broken}))
    moved = ndjson.key_order_differs(good, schema).count()
    if moved:
        out.append(Issue("record_key_order", name, f"{moved} records have other keys or another order", context={"count": moved}))
    df = ndjson.typed(good, schema)
    strict = [c for c, k in schema.columns.items() if not K.nullable(k)]
    nulls = [F.count_if(F.array_contains("__keys", c) & F.col(f"`{c}`").isNull() & ~F.array_contains("__odd", c)).alias(c) for c in strict]
    got = df.agg(F.count("*").alias("__n"), F.max(PK).alias("__max"), *nulls).first()
    out += [Issue("present_null", name, f"{got[c]} nulls in {c}", context={"column": c, "count": got[c]}) for c in strict if got[c]]
    twice = df.where(F.col(PK).isNotNull()).groupBy(PK).agg(F.count("*").alias("n")).where("n > 1")
    ids = [r[PK] for r in twice.orderBy(PK).limit(SAMPLE).collect()]
    if ids:
        out.append(Issue("pk_duplicate", name, "ids are not unique", context={"ids": ids}))
    if isinstance(entry, dict):
        if isinstance(entry.get("lineCount"), int) and entry["lineCount"] != got["__n"]:
            out.append(Issue("meta_line_count_drift", name, f"{got['__n']} rows, {entry['lineCount']} recorded", context={"actual": got["__n"]}))
        if isinstance(entry.get("lastInsertedId"), int) and entry["lastInsertedId"] < (got["__max"] or 0):
            out.append(Issue("meta_last_id_drift", name, f"greatest id {got['__max']}, {entry['lastInsertedId']} recorded", context={"actual": got["__max"]}))
    return out


def repair_tail(spark: SparkSession, path: str) -> int:
    """Drops an unfinished last line of an NDJSON file; bytes removed."""
    files = Files(spark, path.rsplit("/", 1)[0])
    if not torn(files, path):
        return 0
    size = files.size(path)
    kept = files.last_newline(path, size)
    files.shorten(path, kept)
    return size - kept


def repair_directory(spark: SparkSession, path: str) -> Report:
    """Validates a directory and mends what has one right answer.

    A rename that was begun is finished where the new file is there and undone where only the old one is.  Tables with
    broken lines, keys in another order, or counters that drifted are written anew in canonical form and counted; the id
    counter never falls.  Files that belong to nothing are removed where they are empty.
    """
    files, report = Files(spark, path), validate_directory(spark, path)
    tables, _, meta = _catalog(files)
    pending = meta.pop("_pendingRename", None)
    for i in report.by_category("rename_incomplete"):
        _finish_rename(files, pending, meta)
        i.repaired = True
    for name in [n for n in meta if n not in tables]:
        del meta[name]
    for i in report.by_category("meta_orphan_entry"):
        i.repaired = True
    rewritten = {"broken_record", "record_key_order", "meta_line_count_drift", "meta_last_id_drift", "meta_entry_missing", "meta_entry_corrupt"}
    for name in sorted({i.table for i in report.issues if i.category in rewritten and i.table in tables}):
        schema, file, stage = tables[name], table_path(files, name), f"{path}/.stage-{name.lower()}"
        ndjson.exported(read_table(spark, files, schema), schema).write.text(stage)
        got = spark.read.text(stage).agg(F.count("*").alias("n"), F.max(F.get_json_object("value", "$.id").cast("long")).alias("m")).first()
        files.joined(stage, file)
        files.delete(stage)
        entry = meta[name] if isinstance(meta.get(name), dict) else {}
        meta[name] = {**entry, "lineCount": got["n"], "lastInsertedId": max(got["m"] or 0, entry.get("lastInsertedId", 0)), "byteSize": files.size(file)}
        for i in report.issues:
            i.repaired |= i.table == name and i.category in rewritten
    for i in report.issues:
        if i.category in ("orphan_index_file", "orphan_db_entry"):
            stray = files.at(i.table.lower(), i.context["file"]) if i.table else files.at(i.context["entry"])
            if not files.is_dir(stray) and (files.size(stray) == 0 or stray.endswith(".index.ndjson")):
                files.delete(stray)
                i.repaired = True
            else:
                i.repair_error = "holds data; remove it by hand"
    files.replace(files.at(META), json.dumps(meta))
    return report.sorted()


def _finish_rename(files: Files, pending: dict, meta: dict) -> None:
    """The catalog decides which name holds: the marker is written before it changes."""
    raw = files.read_json(files.at(SCHEMA))
    old, new = pending["from"], pending["to"]
    here, gone = (new, old) if new in raw.get("tables", {}) else (old, new)
    source, target = table_path(files, gone), table_path(files, here)
    if files.exists(source) and not files.exists(target):
        files.mkdirs(files.at(here.lower()))
        files.rename(source, target)
    if gone in meta:
        meta.setdefault(here, meta[gone])
        del meta[gone]
