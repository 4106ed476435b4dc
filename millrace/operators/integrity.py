"""Integrity: findings on a database, most severe first, and repair of what has one right answer."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..functions import types as K
from ..plans.query import POS
from ..plans.schema import PK, SERVICE_PREFIX, Index
from ..sources.store import FILE, INDEX_FORMAT, Meta
from .relational import duplicates, orphans

SEVERITIES = ("critical", "error", "warning", "info")
LEVELS = {"critical": logging.CRITICAL, "error": logging.ERROR, "warning": logging.WARNING, "info": logging.INFO}
CATEGORIES = {
    "table_file_missing": "critical", "meta_entry_missing": "critical", "meta_entry_corrupt": "critical", "meta_line_count_drift": "error",
    "meta_last_id_drift": "error", "pk_duplicate": "error", "rename_incomplete": "error", "fk_backing_index_missing": "error", "repair_failed": "error",
    "index_file_missing": "error", "index_file_corrupt": "error", "index_drift": "error", "index_unreliable": "error", "broken_record": "warning",
    "present_null": "warning", "unique_duplicate": "warning", "fk_orphan": "warning", "orphan_index_file": "warning", "record_key_order": "warning",
    "meta_orphan_entry": "warning", "orphan_db_entry": "warning", "fk_backing_index_orphaned": "warning", "index_format_outdated": "info",
    "table_unverified": "info", "unique_index_missing": "info", "table_optimized": "info",
}
INDEX_FINDINGS = ("index_file_missing", "index_file_corrupt", "index_drift", "index_unreliable", "index_format_outdated")
#: Samples of keys kept in a finding; the count is always of all.
SAMPLE = 20


@dataclass
class Issue:
    category: str
    table: str | None
    message: str
    severity: str = ""
    context: dict = field(default_factory=dict)
    repaired: bool = False
    repair_error: str | None = None

    def __post_init__(self):
        self.severity = self.severity or CATEGORIES[self.category]


@dataclass
class Report:
    issues: list[Issue] = field(default_factory=list)

    def sorted(self) -> Report:
        return Report(sorted(self.issues, key=lambda i: SEVERITIES.index(i.severity)))

    def has_errors(self) -> bool:
        return any(i.severity in ("critical", "error") for i in self.issues)

    def has_warnings(self) -> bool:
        return any(i.severity == "warning" for i in self.issues)

    def by_category(self, category: str) -> list[Issue]:
        return [i for i in self.issues if i.category == category]

    def by_severity(self, severity: str) -> list[Issue]:
        return [i for i in self.issues if i.severity == severity]

    def format(self) -> str:
        rows = []
        for i in self.sorted().issues:
            state = "repaired" if i.repaired else f"not repaired: {i.repair_error}" if i.repair_error else ""
            rows.append(f"[{i.severity.upper():8}] {i.category:26} {i.table or '-':20} {i.message} {state}".rstrip())
        return "\n".join(rows) or "no findings"


def table_issues(store, snapshot, name: str) -> list[Issue]:
    """Findings on one table."""
    schema, out = snapshot.tables[name], []
    if name not in snapshot.meta:
        return [Issue("meta_entry_missing", name, "the manifest has no entry for the table")]
    meta = snapshot.meta[name]
    if meta is None:
        return [Issue("meta_entry_corrupt", name, "the manifest's entry is not readable")]
    lost = [p for p in meta.parts if not store.files.exists(store.files.at(p))]
    if lost:
        return [Issue("table_file_missing", name, f"{len(lost)} parts are missing", context={"parts": lost})]
    home = store.home(meta, name)
    for entry in store.files.names(store.files.at(home)):
        if not entry.startswith(("p-", "i-")):  # parts of earlier states stay for their readers
            out.append(Issue("orphan_index_file", name, f"{entry} is not part of the table", context={"file": entry}))
    freshness = store.freshness(meta)
    if freshness != "stamped":
        what = "no commit has recorded its files" if freshness == "unstamped" else "its files or counters are not what the last commit left"
        out.append(Issue("table_unverified", name, what, context={"freshness": freshness}))
    out += index_issues(store, snapshot, name)
    df = store.frame(snapshot, name)
    # one pass gives the counters and the nulls where none may be
    strict = [c for c, k in schema.columns.items() if not K.nullable(k)]
    got = df.agg(F.count("*").alias("__n"), F.max(PK).alias("__max"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in strict]).first()
    if got["__n"] != meta.rows:
        out.append(Issue("meta_line_count_drift", name, f"{got['__n']} rows, {meta.rows} recorded", context={"actual": got["__n"]}))
    if (got["__max"] or 0) > meta.last_id:
        out.append(Issue("meta_last_id_drift", name, f"greatest id {got['__max']}, {meta.last_id} recorded", context={"actual": got["__max"]}))
    out += [Issue("present_null", name, f"{got[c]} nulls in {c}", context={"column": c, "count": got[c]}) for c in strict if got[c]]
    for category, label, fields in [("pk_duplicate", "id", (PK,)), *(("unique_duplicate", u.name, u.fields) for u in schema.uniques)]:
        found = duplicates(df, fields)
        keys = [r.asDict() for r in found.orderBy(*fields).limit(SAMPLE).collect()]
        if keys:
            out.append(Issue(category, name, f"{found.count()} keys of {label} are not unique", context={"constraint": label, "keys": keys}))
    for u in schema.uniques:
        if not any({f for f, _ in i.fields} == set(u.fields) for i in schema.user_indexes):
            out.append(Issue("unique_index_missing", name, f"no index on the fields of {u.name}", context={"constraint": u.name}))
    return out


def index_issues(store, snapshot, name: str) -> list[Issue]:
    """Findings on the parts of a table's indexes: there, readable, complete, and of the values that the data has."""
    schema, meta, out = snapshot.tables[name], snapshot.meta[name], []
    every = store.all_files(meta)
    for index in schema.indexes:
        entries, context = meta.indexes.get(index.name, []), {"index": index.name}
        if not entries:
            continue
        lost = [e["part"] for e in entries if not store.files.exists(store.files.at(e["part"]))]
        if lost:
            out.append(Issue("index_file_missing", name, f"{len(lost)} parts of {index.name} are missing", context=context))
            continue
        if any(e.get("format", 1) < INDEX_FORMAT for e in entries):
            out.append(Issue("index_format_outdated", name, f"{index.name} has parts of an older form", context=context))
        fields = [f for f, _ in index.fields]
        try:
            found = store.spark.read.parquet(*[store.files.at(e["part"]) for e in entries])
            if not {*fields, POS, FILE} <= set(found.columns):
                raise ValueError(f"columns {found.columns}")
            n = found.count()
        except Exception as e:  # whatever the reader makes of the files
            out.append(Issue("index_file_corrupt", name, f"{index.name} is not readable: {str(e)[:200]}", context=context))
            continue
        if n != sum(e["rows"] for e in entries):
            out.append(Issue("index_drift", name, f"{index.name} has {n} entries, {sum(e['rows'] for e in entries)} recorded", context=context))
            continue
        live = [f for f in every if any(store.covered(e, f) for e in entries)]
        if not live:
            continue
        # the same rows on both sides, whatever their order
        digest = [F.count("*").alias("n"), F.sum(F.xxhash64(POS, *[F.col(f"`{f}`") for f in fields]).cast("decimal(38,0)")).alias("h")]
        names = store.spark.createDataFrame([(f,) for f in live], f"{FILE} string")
        if tuple(store.only(snapshot, name, live).agg(*digest).first()) != tuple(store.index_frame(snapshot, name, index).join(F.broadcast(names), FILE).agg(*digest).first()):
            out.append(Issue("index_unreliable", name, f"{index.name} does not hold the values of the data", context=context))
    return out


def database_issues(store, snapshot) -> list[Issue]:
    """Findings on the root, the manifest and the relations."""
    out, homes = [], {store.home(snapshot.meta.get(n), n) for n in snapshot.tables}
    if snapshot.renaming:
        out.append(Issue("rename_incomplete", snapshot.renaming.get("to"), "a rename was begun and not finished", context=snapshot.renaming))
    for name in snapshot.meta:
        if name not in snapshot.tables:
            out.append(Issue("meta_orphan_entry", name, "the manifest has an entry for no table"))
    for entry in store.files.names(store.root):
        if entry not in homes and not entry.startswith(("_", ".")):
            out.append(Issue("orphan_db_entry", None, f"{entry} belongs to no table", context={"entry": entry}))
    backing = set()
    for r in snapshot.relations:
        if r.child not in snapshot.tables or r.parent not in snapshot.tables or r.column not in snapshot.tables[r.child].columns or r.references not in snapshot.tables[r.parent].columns:
            out.append(Issue("fk_orphan", r.child, f"relation {r.key} addresses a missing table or column", context={"relation": r.key}))
            continue
        backing.add((r.child, r.backing_index))
        if r.enforced and not any(i.name == r.backing_index for i in snapshot.tables[r.child].indexes):
            out.append(Issue("fk_backing_index_missing", r.child, f"no index backs {r.column}", context={"relation": r.key}))
        if snapshot.meta.get(r.child) is None or snapshot.meta.get(r.parent) is None:
            continue
        if K.base_of(snapshot.tables[r.child].columns[r.column]) != K.base_of(snapshot.tables[r.parent].columns[r.references]):
            out.append(Issue("fk_orphan", r.child, f"relation {r.key} joins different types", context={"relation": r.key}))
            continue
        lost = orphans(store.frame(snapshot, r.child), r.column, store.frame(snapshot, r.parent), r.references)
        sample = [x[0] for x in lost.select(PK).orderBy(PK).limit(SAMPLE).collect()]
        if sample:
            severity = "info" if r.on_delete == "noAction" else "warning"
            out.append(Issue("fk_orphan", r.child, f"{lost.count()} rows refer to no {r.parent}", severity, {"relation": r.key, "ids": sample}))
    for t, s in snapshot.tables.items():
        for i in s.indexes:
            if i.service and (t, i.name) not in backing:
                out.append(Issue("fk_backing_index_orphaned", t, f"{i.name} backs no relation", context={"index": i.name}))
    return out


def repair_issue(store, snapshot, issue: Issue) -> None:
    """Mends `snapshot` (or the files) for one issue; what has no single right answer is reported and left."""
    t, meta = issue.table, snapshot.meta.get(issue.table) if issue.table else None
    if issue.category in ("meta_entry_missing", "meta_entry_corrupt"):
        parts = [f"{t}/{p}" for p in store.files.names(store.files.at(t)) if p.startswith("p-")]
        snapshot.meta[t] = Meta(parts)
        if parts:
            got = store.frame(snapshot, t).agg(F.count("*").alias("n"), F.max(PK).alias("m"), F.max(POS).alias("p")).first()
            snapshot.meta[t] = Meta(parts, got["n"], got["m"] or 0, (got["p"] if got["p"] is not None else -1) + 1)
    elif issue.category == "table_file_missing":
        meta.parts = [p for p in meta.parts if store.files.exists(store.files.at(p))]
        meta.rows = store.frame(snapshot, t).count()
    elif issue.category in INDEX_FINDINGS:
        meta.indexes.pop(issue.context["index"], None)  # a scan of the table answers until the index is built anew
    elif issue.category == "table_unverified":
        snapshot.meta[t] = store.recounted(snapshot, t)
    elif issue.category == "meta_line_count_drift":
        meta.rows = issue.context["actual"]
    elif issue.category == "meta_last_id_drift":
        meta.last_id = issue.context["actual"]
    elif issue.category == "meta_orphan_entry":
        del snapshot.meta[t]
    elif issue.category == "orphan_index_file":
        path = store.files.at(store.home(meta, t), issue.context["file"])
        if store.files.is_dir(path) or (store.files.size(path) and not path.endswith(".index.ndjson")):
            issue.repair_error = "holds data; remove it by hand"
            return
        store.files.delete(path)
    elif issue.category == "orphan_db_entry":
        path = store.files.at(issue.context["entry"])
        if issue.context["entry"].lower() != issue.context["entry"] or (store.files.is_dir(path) and _holds_data(store, path)):
            issue.repair_error = "holds data; remove it by hand"
            return
        store.files.delete(path)
    elif issue.category == "fk_backing_index_missing":
        from dataclasses import replace

        child, column = issue.context["relation"][0], issue.context["relation"][1]
        schema = snapshot.tables[child]
        own = next((i for i in schema.user_indexes if [f for f, _ in i.fields] == [column]), None)
        name = own.name if own else SERVICE_PREFIX + column
        if own is None and all(i.name != name for i in schema.indexes):
            snapshot.tables[child] = schema.with_(indexes=(*schema.indexes, Index(name, ((column, "asc"),), True)))
        snapshot.relations = tuple(replace(r, backing_index=name) if r.key == tuple(issue.context["relation"]) else r for r in snapshot.relations)
    elif issue.category == "fk_backing_index_orphaned":
        schema = snapshot.tables[t]
        if any(r.child == t and r.backing_index == issue.context["index"] for r in snapshot.relations):
            issue.repaired = True  # mending a relation has put it to use
            return
        snapshot.tables[t] = schema.with_(indexes=tuple(i for i in schema.indexes if i.name != issue.context["index"]))
    elif issue.category == "rename_incomplete":
        snapshot.renaming = None
    elif issue.category == "pk_duplicate":
        issue.repair_error = "duplicate ids are resolved by hand"
        return
    else:
        return
    issue.repaired = True


def _holds_data(store, path: str) -> bool:
    for n in store.files.names(path):
        p = f"{path}/{n}"
        if _holds_data(store, p) if store.files.is_dir(p) else store.files.size(p):
            return True
    return False
