"""Tables, writes, relations, schema changes, integrity and backup of a database on disk."""

import json
import tarfile
from dataclasses import dataclass

import pytest

from millrace import Condition, Database, Filter, Index, Relation, TableSchema, Unique, record
from millrace.cache import FrameCache
from millrace.errors import DataError, MappingError, RelationError, SchemaError, ServiceError, StoreError, TableError
from millrace.functions.types import encode_temporal


@pytest.fixture()
def db(spark, root):
    d = Database.create(spark, root)
    d.create_table(TableSchema.create("owners", {"email": "string", "name": "string|null"}, uniques=[Unique("u_email", ("email",))]))
    d.create_table(TableSchema.create("items", {"ownerId": "int|null", "title": "string", "price": "float|null"}, [Index.on("by_owner", "ownerId")]))
    return d


def seed(db):
    db.insert_many("owners", [{"email": f"e{i}", "name": None} for i in range(1, 4)])
    db.insert_many("items", [{"ownerId": o, "title": f"t{o}{k}", "price": float(k)} for o in (1, 2, 3) for k in range(2)])


def test_insert_select_update_delete(db):
    seed(db)
    assert db.table("owners").next_id() == 4 and db.count("items") == 6
    t = db.table("items")
    assert [r["title"] for r in t.where("ownerId", "=", 2).order_by("price", "desc").rows()] == ["t21", "t20"]
    assert len(t.rows()) == 6  # the builder starts anew
    assert t.where("price", ">", 0).update({"price": None, "id": 99, "nowhere": 1}) == 3 and t.affected_rows() == 3
    assert t.where("price", ">", 0, negated=True).count() == 6
    assert t.delete_by_id(1) == 1 and db.count("items") == 5 and db.last_id("items") == 6
    assert db.insert("items", {"ownerId": None, "title": "n"}) == 7
    assert t.limit(2).one()["id"] == 2 and t.limit(0).one() is None
    assert t.column("id") == [2, 3, 4, 5, 6, 7] and db.last_row("items")["title"] == "n"
    db.truncate("items")
    assert db.count("items") == 0 and db.next_id("items") == 1


@pytest.mark.parametrize(
    ("row", "code"),
    [({"title": 5}, "TypeMismatch"), ({}, "RequiredColumnMissing"), ({"title": None}, "NullInColumn"), ({"title": "a", "price": True}, "TypeMismatch"), ({"title": "a", "price": float("inf")}, "NonFiniteFloat")],
)
def test_rejected_values(db, row, code):
    with pytest.raises(DataError) as e:
        db.insert("items", row)
    assert e.value.code == code and db.count("items") == 0


def test_unique(db):
    seed(db)
    with pytest.raises(TableError):
        db.insert("owners", {"email": "e1"})
    with pytest.raises(TableError):
        db.insert_many("owners", [{"email": "x"}, {"email": "x"}])
    with pytest.raises(TableError):
        db.update("owners", [Condition("id", "=", 1)], {"email": "e2"})
    assert db.update("owners", [Condition("id", "=", 1)], {"email": "e1"}) == 1
    db.create_table(TableSchema.create("pair", {"a": "int|null", "b": "int|null"}, uniques=[Unique("u", ("a", "b"))]))
    db.insert_many("pair", [{"a": 1, "b": None}, {"a": 1, "b": None}, {"a": 1, "b": 2}])
    with pytest.raises(TableError):
        db.add_unique("pair", Unique("ua", ("a",)))


def test_cascade_set_null_restrict(db):
    seed(db)
    db.add_relation(Relation.declared("items", "ownerId", "owners", on_delete="cascade"))
    assert db.delete("owners", [Condition("id", "=", 2)]) == 1 and db.count("items") == 4
    db.drop_relation(Relation("items", "ownerId", "owners"))
    db.add_relation(Relation.declared("owners", "ownerId", "items", kind="hasMany", on_delete="setNull"))
    db.delete("owners", [Condition("id", "=", 3)])
    assert db.table("items").where("ownerId", "=", None).count() == 2
    db.drop_relation(Relation("items", "ownerId", "owners"))
    db.add_relation(Relation.declared("items", "ownerId", "owners", on_delete="restrict"))
    with pytest.raises(RelationError) as e:
        db.delete("owners", ())
    assert e.value.code == "ForeignKeyRestricted" and db.count("owners") == 1


def test_cycles_and_self_reference(spark, root):
    db = Database.create(spark, root)
    db.create_table(TableSchema.create("nodes", {"parentId": "int|null"}))
    db.add_relation(Relation.declared("nodes", "parentId", "nodes", on_delete="cascade"))
    db.insert_many("nodes", [{"parentId": p} for p in (None, 1, 2, 3, None, 4)])
    db.update("nodes", [Condition("id", "=", 1)], {"parentId": 4})  # 1 -> 4 -> 3 -> 2 -> 1
    assert db.delete("nodes", [Condition("id", "=", 3)]) == 1
    assert db.table("nodes").column("id") == [5]


def test_update_cascades_and_nulls_travel_on(spark, root):
    db = Database.create(spark, root)
    db.create_table(TableSchema.create("a", {"code": "string"}, uniques=[Unique("u", ("code",))]))
    db.create_table(TableSchema.create("b", {"aRef": "string|null"}, uniques=[Unique("u", ("aRef",))]))
    db.create_table(TableSchema.create("d", {"x": "string|null"}))
    db.add_relation(Relation.declared("b", "aRef", "a", "code", on_delete="setNull", on_update="cascade"))
    db.add_relation(Relation.declared("d", "x", "b", "aRef", on_update="cascade"))
    db.insert("a", {"code": "p"})
    db.insert("b", {"aRef": "p"})
    db.insert_many("d", [{"x": "p"}, {"x": None}])
    db.update("a", (), {"code": "q"})
    assert db.table("d").column("x") == ["q", None] and db.table("b").column("aRef") == ["q"]
    db.delete("a", ())
    assert db.table("d").column("x") == [None, None]
    db.drop_relation(Relation("d", "x", "b", "aRef"))
    db.add_relation(Relation.declared("d", "x", "b", "aRef", on_update="restrict"))
    db.update("b", (), {"aRef": "z"})
    db.update("d", [Condition("id", "=", 1)], {"x": "z"})
    with pytest.raises(RelationError):
        db.update("b", (), {"aRef": "y"})


def test_import(db, spark):
    assert db.import_records("items", [{"id": 9, "title": "x"}, {"id": 3, "title": "y"}]) == 2
    assert db.table("items").column("id") == [9, 3] and db.next_id("items") == 10
    for bad in ([{"id": 1, "title": "a"}, {"id": 1, "title": "b"}], [{"id": 0, "title": "a"}], [{"title": "a"}]):
        with pytest.raises(StoreError):
            db.import_records("items", bad)
    assert db.count("items") == 2
    assert db.import_records("items", spark.range(1, 1001).selectExpr("id", "cast(id % 5 as long) AS ownerId", "concat('t', id) AS title")) == 1000
    with pytest.raises(DataError):
        db.import_records("items", spark.range(1, 5).selectExpr("id", "cast(null as string) AS title"))
    assert db.count("items", [Condition("ownerId", "=", 3)]) == 200


def test_temporal(spark, root):
    assert encode_temporal("datetime", "2026-01-01T10:00:00+02:00", "UTC") == "2026-01-01 08:00:00"
    assert encode_temporal("datetimez", "2026-07-01 10:00:00.5", "Europe/Berlin") == "2026-07-01 08:00:00.500"
    for kind, text in [("date", "2026-02-30"), ("date", "2026-00-01"), ("time", "24:00:00"), ("datetime", "2026-01-01 10:00:00.1"), ("datetime", "2026-01-01 10:00:00+15:00"), ("datetime", "0000-01-01 00:00:00+01:00")]:
        assert encode_temporal(kind, text, "UTC") is None, text
    assert encode_temporal("date", "0000-02-29", "UTC") == "0000-02-29" and encode_temporal("timez", "10:00:00.5", "UTC") == "10:00:00.500"
    db = Database.create(spark, root, zone="Europe/Berlin")
    db.create_table(TableSchema.create("e", {"at": "datetime", "on": "date", "mo": "month", "p": "datetimez|null"}))
    db.insert("e", {"at": "2026-01-01 00:00:00", "on": "2026-01-01", "mo": 12, "p": "2026-06-01T00:00:00.250"})
    assert db.stored("e").first()["at"] == "2025-12-31 23:00:00"
    row = db.table("e").where("at", "=", "2025-12-31T23:00:00Z").one()
    assert row["at"] == "2026-01-01 00:00:00" and row["p"] == "2026-06-01 00:00:00.250"
    with pytest.raises(DataError):
        db.insert("e", {"at": "2026-01-01 00:00:00", "on": "2026-01-01", "mo": 13})
    with pytest.raises(StoreError) as e:
        db.table("e").where("at", "LIKE", "2026%").rows()
    assert e.value.code == "LikeOnInstantUnsupported" and db.table("e").where("on", "LIKE", "2026-%").count() == 1


def test_schema_changes(db):
    seed(db)
    assert db.migrate("items", {"ownerId": "int|null", "title": "string", "qty": "int"}) == {"added": ["qty"], "dropped": ["price"]}
    assert db.table("items").column("qty") == [0] * 6
    for columns, code in [({"title": "int"}, "MigrateColumnTypeChange"), ({"ownerId": "int|null", "title": "string", "d": "date"}, "MigrateColumnNoDefault"), ({"title": "string"}, "ColumnInUse")]:
        with pytest.raises(SchemaError) as e:
            db.migrate("items", columns)
        assert e.value.code == code
    db.rename_column("items", "ownerId", "owner")
    assert db.schema("items").indexes[0].fields == (("owner", "asc"),) and db.table("items").where("owner", "=", 1).count() == 2
    db.reorder_columns("items", ["qty", "title", "owner"])
    assert list(db.table("items").one()) == ["id", "qty", "title", "owner"]
    for order, code in [(["zz"], "ReorderColumnsUnknown"), (["qty"], "ReorderColumnsIncomplete"), (["qty", "qty"], "ReorderColumnsDuplicate")]:
        with pytest.raises(SchemaError) as e:
            db.reorder_columns("items", order)
        assert e.value.code == code
    db.rename_table("items", "things")
    assert db.table_names() == ["owners", "things"] and db.count("things", [Condition("qty", "=", 0)]) == 6
    with pytest.raises(TableError):
        db.rename_table("things", "OWNERS")
    db.set_column_comments("things", {"qty": "pieces"})
    db.set_table_comment("things", "all of them")
    assert db.column_comment("things", "qty") == "pieces" and db.table_comment("things") == "all of them"
    assert [r["column"] for r in db.describe("things").orderBy("position").collect()] == ["id", "qty", "title", "owner"]
    wanted = TableSchema.create("things", {"qty": "float", "extra": "string"})
    d = db.diff(wanted)
    assert d.added_columns == {"extra": "string"} and d.changed_types == {"qty": ("int", "float")} and d.dropped_indexes == ("by_owner",) and not d.is_empty
    db.rebuild_index("things", "by_owner")
    db.drop_index("things", "by_owner")
    db.optimize("things")
    assert db.table("things").column("id") == [1, 2, 3, 4, 5, 6] and db.vacuum() >= 1
    db.drop_table("things")
    db.drop_table("things")
    assert not db.has_table("things")


@pytest.mark.parametrize("name", ["12", "", "a b", "x" * 65, "_pendingRename"])
def test_names(name):
    with pytest.raises(SchemaError):
        TableSchema.create(name, {"a": "int"})


def test_relations_are_checked(db):
    for r, code in [
        (Relation.declared("items", "title", "owners"), "RelationTypeMismatch"), (Relation.declared("items", "ownerId", "nobody"), "RelationTableNotFound"),
        (Relation.declared("items", "zz", "owners"), "RelationColumnNotFound"), (Relation.declared("items", "title", "owners", "email", on_delete="setNull"), "SetNullNeedsNullable"),
        (Relation.declared("items", "title", "owners", "name", on_delete="cascade"), "RelationReferencesNotUnique"),
    ]:
        with pytest.raises(RelationError) as e:
            db.add_relation(r)
        assert e.value.code == code
    db.add_relation(Relation.declared("items", "ownerId", "owners", on_delete="cascade"))
    assert db.relations("items")[0].backing_index == "by_owner"
    db.drop_index("items", "by_owner")
    assert db.relations()[0].backing_index == "_fk_ownerId" and db.schema("items").indexes == ()
    with pytest.raises(RelationError):
        db.add_relation(Relation.declared("owners", "ownerId", "items", kind="hasMany"))


def test_snapshots_stay_readable(db):
    seed(db)
    before = db.table("items").frame()
    db.delete("items", ())
    assert before.count() == 6 and db.count("items") == 0


def test_integrity_and_repair(db, spark):
    seed(db)
    db.add_relation(Relation.declared("items", "ownerId", "owners"))
    db.insert("items", {"ownerId": 77, "title": "lost"})
    db.create_table(TableSchema.create("Docs", {"a": "int"}))
    files = db.store.files
    raw = json.loads(files.read(db.store.path))
    raw["meta"]["items"]["rows"], raw["meta"]["items"]["last_id"] = 1, 2
    raw["meta"]["ghost"] = {"parts": [], "rows": 0, "last_id": 0, "next_pos": 0}
    del raw["meta"]["Docs"]
    files.replace(db.store.path, json.dumps(raw))
    files.mkdirs(files.at("stray"))
    said = []
    db.logger = type("L", (), {"log": lambda self, level, text, *args: said.append((level, text % args))})()
    report = db.validate()
    assert len(said) == len(report.issues) and said[0][0] == 50
    found = {(i.category, i.severity) for i in report.issues}
    assert {("meta_line_count_drift", "error"), ("meta_last_id_drift", "error"), ("meta_orphan_entry", "warning"), ("meta_entry_missing", "critical"), ("orphan_db_entry", "warning"), ("fk_orphan", "info"), ("unique_index_missing", "info")} <= found
    assert report.has_errors() and report.issues[0].severity == "critical" and "fk_orphan" in report.format()
    db.repair()
    left = {i.category for i in db.validate().issues}
    assert left == {"fk_orphan", "unique_index_missing"} and db.count("items") == 7 and db.last_id("items") == 7


def test_backup_restore(db, tmp_path):
    seed(db)
    db.delete("items", [Condition("id", "=", 6)])
    path = db.backup(str(tmp_path))
    with tarfile.open(path) as tar:
        assert sorted(tar.getnames()) == ["information_schema.json", "manifest.json", "tables/items.ndjson", "tables/owners.ndjson"]
        assert json.loads(tar.extractfile("tables/items.ndjson").readline()) == {"id": 1, "ownerId": 1, "title": "t10", "price": 0.0}
    db.truncate("items")
    db.restore(path)
    assert db.table("items").column("id") == [1, 2, 3, 4, 5] and db.next_id("items") == 7
    db.create_table(TableSchema.create("later", {}))
    with pytest.raises(ServiceError):
        db.restore(path)
    with pytest.raises(ServiceError):
        db.restore(path, adopt_schema=True)
    db.restore(path, adopt_schema=True, prune=True)
    assert db.table_names() == ["owners", "items"]
    with pytest.raises(ServiceError):
        db.backup(path)
    broken = f"{tmp_path}/broken.tar.gz"
    with tarfile.open(path) as a, tarfile.open(broken, "w:gz") as b:
        import io

        for m in a.getmembers():
            data = a.extractfile(m).read()
            data = data.replace(b"t10", b"t99") if m.name.endswith("items.ndjson") else data
            m.size = len(data)
            b.addfile(m, io.BytesIO(data))
    with pytest.raises(ServiceError) as e:
        db.restore(broken)
    assert e.value.code == "BackupChecksumMismatch"


def test_ndjson(db, tmp_path):
    lines = ['{"id":1,"title":"a","price":2}', "", "not json", '{"id":2,"title":"b","extra":[1],"ownerId":"7"}', "[1,2]", "5", '{"price":{"x":1},"title":"c","id":3}']
    (tmp_path / "in.ndjson").write_text("\n".join(lines) + '\n{"id":4,"ti')
    with pytest.raises(DataError) as e:
        db.import_ndjson("items", f"file://{tmp_path}/in.ndjson", broken_lines="Refuse")
    assert e.value.code == "BrokenRecordBlocksRewrite"
    got = db.import_ndjson("items", f"file://{tmp_path}/in.ndjson")
    assert got == {"rows": 3, "broken": 4, "odd": 2}
    assert [(r["id"], r["title"], r["price"], r["ownerId"]) for r in db.table("items").rows()] == [(1, "a", 2.0, None), (2, "b", None, None), (3, "c", None, None)]
    db.export_ndjson("items", f"file://{tmp_path}/out")
    assert db.import_ndjson("items", f"file://{tmp_path}/out")["rows"] == 3


def test_cache_and_record_classes(spark, root):
    db = Database.create(spark, root, cache=FrameCache())
    db.create_table(TableSchema.create("users", {"full_name": "string", "age": "int|null"}))

    @record("users", snake=True)
    @dataclass
    class User:
        id: int | None
        fullName: str
        age: int | None = None

    db.records.register(User)
    t = db.table("users")
    t.insert(User(None, "Ann", 5))
    assert list(t.records()) == [User(1, "Ann", 5)] and t.record() == User(1, "Ann", 5)
    t.update_record(User(1, "Bo"))
    assert t.where("age", "=", None).record() == User(1, "Bo") and db.count("users", Filter().where("full_name", "=", "Bo")) == 1

    @dataclass
    class Wrong:
        id: int
        full_name: int

    with pytest.raises(MappingError):
        db.records.register(Wrong, "users")
    db.flush_cache()


def test_append_stream(spark, db, tmp_path):
    from millrace.streaming.append import append_batch, append_stream, query_id

    spark.range(3).selectExpr("concat('s', id) AS title").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("title string").parquet(f"{tmp_path}/in")
    append_stream(db, "items", stream, f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(db.table("items").column("title")) == ["s0", "s1", "s2"] and sorted(db.table("items").column("id")) == [1, 2, 3]
    name = query_id(db, f"{tmp_path}/cp")
    assert append_batch(db, "items", spark.sql("SELECT 'again' AS title"), 0, name) == 0 and db.count("items") == 3


def test_writes_replace_only_the_files_they_touch(db):
    for k in range(6):
        db.insert_many("items", [{"ownerId": k, "title": f"t{k}{i}"} for i in range(3)])
    before = db.snapshot().meta["items"].parts
    assert db.update("items", [Condition("ownerId", "=", 2)], {"price": 5.0}) == 3
    after = db.snapshot().meta["items"].parts
    assert len(after) == 6 and set(before) - set(after) == {before[2]}
    assert db.delete("items", [Condition("title", "IN", ["t40", "t51"])]) == 2
    assert len(set(before) & set(db.snapshot().meta["items"].parts)) == 3
    assert [r["title"] for r in db.table("items").rows()] == [f"t{k}{i}" for k in range(6) for i in range(3) if f"{k}{i}" not in ("40", "51")]
    assert db.table("items").where("price", "=", 5).column("ownerId") == [2, 2, 2] and db.count("items") == 16
    db.import_records("items", db.spark.range(1, 401).selectExpr("id", "id AS ownerId", "concat('b', id) AS title").repartition(8))
    db.update("items", [Condition("ownerId", "=", 7)], {"title": "new"})
    parts = db.snapshot().meta["items"].parts
    assert len(parts) == 8 and all(p.count("/") == 2 for p in parts[:-1])  # seven files stay, one is new
    assert db.count("items", [Condition("title", "=", "new")]) == 1 and db.table("items").frame().count() == 400
    assert {i.category for i in db.validate().issues} <= {"unique_index_missing"}
    db.vacuum()
    assert db.table("items").frame().count() == 400
    db.optimize("items")
    assert len(db.snapshot().meta["items"].parts) == 1


def test_one_writer_at_a_time(spark, root):
    from millrace.errors import LockError

    db, other = Database.create(spark, root), Database.open(spark, root, lock_timeout=0.2)
    db.create_table(TableSchema.create("t", {"a": "int"}))
    with db.store.lock:
        with pytest.raises(LockError):
            other.insert("t", {"a": 1})
        assert other.count("t") == 0  # readers need no lock
        db.insert("t", {"a": 2})
    assert other.insert("t", {"a": 3}) == 2
    db.store.files.write(db.store.lock.path, "")  # a writer that died
    with pytest.raises(LockError):
        other.insert("t", {"a": 4})
    other.break_lock()
    assert other.insert("t", {"a": 4}) == 3


def test_formats_from_the_future_are_refused(db):
    raw = json.loads(db.store.files.read(db.store.path))
    raw["format"]["incompat"].append("new-thing")
    db.store.files.replace(db.store.path, json.dumps(raw))
    with pytest.raises(StoreError) as e:
        db.count("items")
    assert e.value.code == "StorageFormatUnknown"


def test_storage_status_and_messages(db):
    from millrace.errors import English, Russian

    assert db.storage_status()["generation"] == 3 and db.migrate_storage() == {"from": 3, "to": 3, "steps": [], "skipped": []}
    try:
        StoreError.set_locale(Russian())
        with pytest.raises(TableError, match="нет таблицы"):
            db.table("nowhere")
    finally:
        StoreError.set_locale(English())
    with pytest.raises(TableError, match="there is no table nowhere"):
        db.table("nowhere")
