"""Streams, index parts, the gate before writes, locks, backups in folders, moments in records, directories and their repair."""

import json
import time
from dataclasses import dataclass
from datetime import UTC, date, datetime
from datetime import time as clock
from zoneinfo import ZoneInfo

import pytest

from millrace import Condition, Database, Index, Relation, TableSchema, record
from millrace import database as module
from millrace.errors import DataError, English, IoError, LockError, MappingError, RelationError, Russian, SchemaError, ServiceError, TableError
from millrace.functions.types import encode_temporal
from millrace.mapping import snake_case
from millrace.operators.relational import temporary
from millrace.plans import indexing
from millrace.sources.directory import export_directory, import_directory, repair_directory, validate_directory
from millrace.sources.store import Store
from millrace.streaming.append import append_batch, append_stream, query_id


@pytest.fixture()
def db(spark, root):
    d = Database.create(spark, root)
    d.create_table(TableSchema.create("t", {"a": "int|null", "b": "string", "c": "float|null"}, [Index.on("by_a", "a"), Index.on("by_ab", "a", ("b", "desc"))]))
    return d


def load(db, n=100):
    db.import_records("t", db.spark.range(1, n + 1).selectExpr("id", "id % 10 AS a", "concat('b', id % 7) AS b", "id * 0.5D AS c"))


def edited(db, change):
    raw = json.loads(db.store.files.read(db.store.path))
    change(raw)
    db.store.files.replace(db.store.path, json.dumps(raw))


# ------------------------------------------------------------------------------------------------ streams


def test_streams_into_one_table(spark, db, tmp_path):
    """Two streams, one begun anew with another checkpoint, a batch delivered again and a truncate between: all rows, once."""
    for name in ("x", "y"):
        spark.range(5).selectExpr(f"concat('{name}', id) AS b").repartition(3).write.parquet(f"{tmp_path}/{name}")

    def run(name, cp):
        append_stream(db, "t", spark.readStream.schema("b string").parquet(f"{tmp_path}/{name}"), f"{tmp_path}/{cp}").awaitTermination(60)

    run("x", "cp1")
    run("y", "cp2")
    assert sorted(db.table("t").column("b")) == [f"{n}{i}" for n in "xy" for i in range(5)] and sorted(db.table("t").column("id")) == list(range(1, 11))
    run("x", "cp1")  # nothing new
    assert db.count("t") == 10
    run("x", "cp3")  # the same source from the start, by another checkpoint
    assert db.count("t") == 15 and sorted(db.table("t").column("id")) == list(range(1, 16))
    one = query_id(db, f"{tmp_path}/cp1")
    again = spark.read.parquet(f"{tmp_path}/x")
    assert append_batch(db, "t", again, 0, one) == 0 and db.count("t") == 15
    db.truncate("t")
    assert append_batch(db, "t", again, 0, one) == 0 and db.count("t") == 0  # it was taken once, before the truncate
    assert append_batch(db, "t", again, 1, one) == 5 and sorted(db.table("t").column("id")) == [1, 2, 3, 4, 5]
    assert append_batch(db, "t", again.limit(0), 2, one) == 0 and append_batch(db, "t", again, 2, one) == 0
    with pytest.raises(DataError):
        append_batch(db, "t", spark.sql("SELECT CAST(NULL AS STRING) AS b"), 3, one)
    assert db.count("t") == 5 and not [n for n in db.store.files.names(db.store.root) if n.startswith("_stage")]
    assert {i.category for i in db.validate().issues} == set()


# ------------------------------------------------------------------------------------------------ index parts


def answers(db, *where):
    conditions = [Condition(*w) for w in where]
    return db.explain_index("t", conditions), sorted(r["id"] for r in db.select("t", conditions).collect())


def test_indexes_are_chosen_kept_and_answer_as_a_scan(db, monkeypatch):
    load(db)
    wheres = [[("a", "=", 3)], [("a", "=", 3), ("b", "=", "b2")], [("a", "=", 3), ("b", "LIKE", "b1%")], [("a", "IN", [3, 4])], [("a", "BETWEEN", [2, 3]), ("c", ">", 20)], [("a", "=", 3), ("b", "=", "b2", True)],
              [("b", "=", "b2")], [("a", "=", 3, True)], [("a", "=", None)], [("a", ">", 8)]]
    plain = [answers(db, *w) for w in wheres]
    assert {p for p, _ in plain} == {None}  # a small table needs no index part
    db.rebuild_all_indexes("t")
    built = [answers(db, *w) for w in wheres]
    assert [rows for _, rows in built] == [rows for _, rows in plain]
    assert [p for p, _ in built] == ["by_a", "by_ab", "by_ab", "by_a", "by_a", "by_a", None, None, None, "by_a"]
    # rows that came or changed later stand in files that the parts do not cover
    db.insert_many("t", [{"a": 3, "b": "b2"}, {"a": None, "b": "b9"}])
    db.update("t", [Condition("id", "=", 3)], {"a": 4})
    db.update("t", [Condition("id", "=", 4)], {"a": 3, "b": "b2"})
    db.delete("t", [Condition("id", "=", 13)])
    with_index = [answers(db, *w)[1] for w in wheres]
    assert with_index[0] == [4, 23, 33, 43, 53, 63, 73, 83, 93, 101] and db.count("t", [Condition("a", "=", 3)]) == 10
    monkeypatch.setattr(indexing, "MOST_POSITIONS", 2)  # too much is found: the table is scanned
    assert [answers(db, *w)[1] for w in wheres] == with_index
    assert db.row_exists("t", [Condition("a", "=", 3)]) and not db.row_exists("t", [Condition("a", "=", 77)])
    assert db.validate().issues == []
    db.optimize("t")
    assert [answers(db, *w)[1] for w in wheres] == with_index and db.explain_index("t", [Condition("a", "=", 1)]) == "by_a"


def test_tails_are_merged_and_small_parts_gathered(db, monkeypatch):
    monkeypatch.setattr(module, "TAIL_FILES", 3)
    monkeypatch.setattr(module, "MOST_ENTRIES", 2)
    monkeypatch.setattr(module, "MOST_PARTS", 6)
    for k in range(14):
        db.insert_many("t", [{"a": k % 3, "b": f"b{k}"}])
        meta = db.snapshot().meta["t"]
        assert len(meta.parts) <= 7 and all(len(e) <= 2 for e in meta.indexes.values())
        assert len(db.store.tail(meta, "by_a")) <= 4
        assert answers(db, ("a", "=", 1))[1] == [i for i in range(1, k + 2) if (i - 1) % 3 == 1]
    assert db.table("t").column("b") == [f"b{k}" for k in range(14)]
    assert db.validate().issues == [] and db.vacuum() >= 0 and db.count("t", [Condition("a", "=", 0)]) == 5


@pytest.mark.parametrize(
    ("change", "category"),
    [
        (lambda db, e: db.store.files.delete(db.store.files.at(e["part"])), "index_file_missing"),
        (lambda db, e: db.spark.range(3).write.mode("overwrite").parquet(db.store.files.at(e["part"])), "index_file_corrupt"),
        (lambda db, e: edited(db, lambda raw: raw["meta"]["t"]["indexes"]["by_a"][0].update(rows=5)), "index_drift"),
        (lambda db, e: edited(db, lambda raw: raw["meta"]["t"]["indexes"]["by_a"][0].pop("format")), "index_format_outdated"),
    ],
)
def test_index_findings(db, change, category):
    load(db)
    db.rebuild_all_indexes("t")
    change(db, db.snapshot().meta["t"].indexes["by_a"][0])
    found = db.validate()
    assert {i.category for i in found.issues if i.context.get("index") == "by_a"} == {category}
    if category == "index_file_missing":
        assert answers(db, ("a", "=", 3))[1] == [3 + 10 * i for i in range(10)]  # the table is scanned
    db.repair()
    assert db.validate().issues == [] and answers(db, ("a", "=", 3)) == ("by_a", [3 + 10 * i for i in range(10)])


def test_unreliable_index(db):
    load(db)
    db.rebuild_index("t", "by_a")
    entry = db.snapshot().meta["t"].indexes["by_a"][0]
    rows = db.spark.read.parquet(db.store.files.at(entry["part"])).cache()
    rows.count()
    rows.selectExpr("a + 1 AS a", "__pos", "__file").write.mode("overwrite").parquet(db.store.files.at(entry["part"]))
    assert {i.category for i in db.validate().issues} == {"index_unreliable"}
    db.repair()
    assert db.validate().issues == []
    with pytest.raises(SchemaError):
        db.rebuild_index("t", "nowhere")


# ------------------------------------------------------------------------------------------------ the gate before writes


def test_gate_derives_counters_anew(db):
    load(db, 20)
    edited(db, lambda raw: raw["meta"]["t"].update(rows=3, last_id=5, next_pos=2))
    assert db.storage_status()["tables"] == {"t": "stale"} and {i.category for i in db.validate().issues} >= {"table_unverified"}
    assert db.insert("t", {"b": "new"}) == 21 and db.count("t") == 21
    assert db.storage_status()["tables"] == {"t": "stamped"} and db.validate().issues == []
    edited(db, lambda raw: raw["meta"]["t"].pop("stamp"))
    assert db.storage_status()["tables"] == {"t": "unstamped"} and [i.category for i in db.validate().issues] == ["table_unverified"]
    db.repair()
    assert db.validate().issues == []
    db.store.files.delete(db.store.files.at(db.snapshot().meta["t"].parts[0]))
    with pytest.raises(TableError) as e:
        db.insert("t", {"b": "x"})
    assert e.value.code == "TableFileMissing"


def test_restriction_needs_its_index(db):
    db.create_table(TableSchema.create("kids", {"t": "int|null"}))
    db.add_relation(Relation.declared("kids", "t", "t", on_delete="restrict", on_update="restrict"))
    load(db, 5)
    assert db.delete("t", [Condition("id", "=", 5)]) == 1
    edited(db, lambda raw: raw["relations"][0].update(backingIndex="gone"))
    for work in (lambda: db.delete("t", [Condition("id", "=", 4)]),):
        with pytest.raises(RelationError) as e:
            work()
        assert e.value.code == "FkBackingIndexMissing" and db.count("t") == 4
    db.repair()
    assert db.delete("t", [Condition("id", "=", 4)]) == 1


def test_writers_must_know_their_features(db):
    edited(db, lambda raw: raw["format"]["roCompat"].append("new-thing"))
    assert db.count("t") == 0
    for work in (lambda: db.insert("t", {"b": "x"}), lambda: db.truncate("t"), lambda: db.drop_table("t"), db.repair, db.migrate_storage):
        with pytest.raises(IoError) as e:
            work()
        assert e.value.code == "StorageReadOnly"


def test_generations_are_brought_up(db):
    load(db, 30)
    edited(db, lambda raw: (raw["format"].update(generation=1), raw["meta"]["t"].update(rows=1, indexes={}, stamp="")))
    assert db.storage_status()["generation"] == 1
    assert db.migrate_storage(2) == {"from": 1, "to": 2, "steps": ["counters in the manifest"], "skipped": []} and db.count("t") == 30
    assert db.migrate_storage()["steps"] == ["index parts and stamps"] and set(db.snapshot().meta["t"].indexes) == {"by_a", "by_ab"}
    assert db.migrate_storage()["steps"] == []
    with pytest.raises(ServiceError):
        db.migrate_storage(1)


def test_renamed_tables_keep_their_folder(db):
    load(db, 10)
    before, parts = db.table("t").frame(), db.snapshot().meta["t"].parts
    db.rename_table("t", "u")
    assert db.snapshot().meta["u"].parts == parts and before.count() == 10 and db.count("u") == 10
    db.create_table(TableSchema.create("t", {"x": "int"}))
    db.insert("t", {"x": 1})
    db.insert("u", {"b": "x"})
    assert db.table("t").column("x") == [1] and db.count("u") == 11 and db.validate().issues == []
    db.drop_table("u")
    assert db.table("t").column("x") == [1] and db.validate().issues == []


# ------------------------------------------------------------------------------------------------ locks


def test_leases_and_shared_locks(spark, db, root):
    other = Database.open(spark, root, lock_timeout=0.2)
    with db.store.lock:
        assert db.store.lock.owner()["owner"] == db.store.lock.me
        with pytest.raises(LockError):
            other.truncate("t")
    db.store.files.write(db.store.lock.path, json.dumps({"owner": "dead", "until": time.time() - 1}))
    assert other.insert("t", {"b": "x"}) == 1  # a lease that ran out
    db.store.files.write(db.store.lock.path, json.dumps({"owner": "alive", "until": time.time() + 60}))
    with pytest.raises(LockError):
        other.insert("t", {"b": "y"})
    other.break_lock()
    with db.reading() as snapshot:
        assert snapshot.meta["t"].rows == 1
        other.insert("t", {"b": "y"})  # writers do not wait for readers
        with pytest.raises(LockError):
            other.vacuum()
    assert other.vacuum() == 0


def test_a_writer_that_lost_its_lock_changes_nothing(spark, db, root):
    other = Database.open(spark, root)
    with pytest.raises(LockError) as e:
        with db.store.lock:
            db.store.files.replace(db.store.lock.path, json.dumps({"owner": db.store.lock.me, "until": time.time() - 1}))
            other.insert("t", {"b": "theirs"})  # the lease ran out
            db.insert("t", {"b": "mine"})
    assert e.value.code == "LockLost" and db.table("t").column("b") == ["theirs"]
    assert db.insert("t", {"b": "again"}) == 2
    assert [r["b"] for r in db.select("t", (c for c in [Condition("id", ">", 1)])).collect()] == ["again"]


def test_temporary_folders_are_for_local_sessions(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(IoError):
        temporary(Elsewhere)
    assert temporary(spark)


# ------------------------------------------------------------------------------------------------ backups


def test_backup_in_a_folder(spark, db, tmp_path):
    load(db, 50)
    path = f"file://{tmp_path}/backup/"
    assert db.backup(path) == path
    with pytest.raises(ServiceError):
        db.backup(path)
    with pytest.raises(ServiceError) as e:
        db.backup(f"{db.store.root}/inside/")
    assert e.value.code == "BackupDestinationInsideDb"
    rows = db.table("t").rows()
    db.truncate("t")
    db.restore(path)
    assert db.table("t").rows() == rows and db.next_id("t") == 51
    copy = Database.create(spark, f"file://{tmp_path}/copy")
    copy.restore(path, adopt_schema=True)
    assert copy.table("t").rows() == rows and copy.validate().issues == []
    part = next(p for p in (tmp_path / "backup/tables/t.ndjson").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    part.write_text(part.read_text().replace("b1", "b2"))
    for crc in (tmp_path / "backup/tables/t.ndjson").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ServiceError) as e:
        db.restore(path)
    assert e.value.code == "BackupChecksumMismatch" and db.table("t").rows() == rows
    manifest = tmp_path / "backup/manifest.json"
    manifest.write_text(manifest.read_text().replace("millrace-backup", "other"))
    with pytest.raises(ServiceError) as e:
        db.restore(path)
    assert e.value.code == "BackupFormatUnknown"
    with pytest.raises(ServiceError):
        db.restore(f"file://{tmp_path}/nowhere/")


# ------------------------------------------------------------------------------------------------ records


def test_moments_in_records(spark, root):
    db = Database.create(spark, root, zone="Europe/Berlin")
    db.create_table(TableSchema.create("events", {"day": "date", "at": "time", "fine": "timez|null", "made": "datetime", "exact": "datetimez|null"}))

    @record("events")
    @dataclass
    class Event:
        id: int | None
        day: date
        at: clock
        fine: datetime | None
        made: datetime
        exact: datetime | None = None

    db.records.register(Event)
    berlin = ZoneInfo("Europe/Berlin")
    t = db.table("events")
    t.insert(Event(None, date(2024, 2, 29), clock(23, 5, 59, 999999), datetime(1970, 1, 1, 1, 2, 3, 456789), datetime(2024, 7, 1, 12, 0, 0, 999000, UTC), datetime(2024, 1, 1, 0, 0, 0, 123999)))
    t.insert(Event(None, datetime(2020, 5, 6, 7), clock(0), None, datetime(2024, 7, 1, 12, tzinfo=berlin)))
    assert db.stored("events").orderBy("id").select("made", "exact", "at", "fine", "day").collect()[0].asDict() == {
        "made": "2024-07-01 12:00:00", "exact": "2023-12-31 23:00:00.123", "at": "23:05:59", "fine": "01:02:03.456", "day": "2024-02-29",
    }
    first, second = list(t.records())
    assert first == Event(1, date(2024, 2, 29), clock(23, 5, 59), datetime(1970, 1, 1, 1, 2, 3, 456000, UTC), datetime(2024, 7, 1, 14, tzinfo=berlin), datetime(2024, 1, 1, 0, 0, 0, 123000, berlin))
    assert second.day == date(2020, 5, 6) and second.made == datetime(2024, 7, 1, 10, tzinfo=UTC) and second.exact is None
    edited_rows = db.stored("events").selectExpr("id", "day", "at", "fine", "'soon' AS made", "exact", "__pos")
    part = db.store.write(edited_rows, db.snapshot(), "events")
    edited(db, lambda raw: raw["meta"]["events"].update(parts=[part]))
    with pytest.raises(MappingError) as e:
        t.record()
    assert e.value.code == "RecordTemporalValue"


def test_offsets_need_no_colon(spark, root):
    for text in ("2024-07-01 12:00:00+0300", "2024-07-01T12:00:00+03:00", "2024-07-01 09:00:00Z"):
        assert encode_temporal("datetime", text, "UTC") == "2024-07-01 09:00:00"
    assert encode_temporal("datetimez", "2024-07-01 12:00:00.5-0130", "UTC") == "2024-07-01 13:30:00.500" and encode_temporal("datetime", "2024-07-01 12:00:00+03000", "UTC") is None
    db = Database.create(spark, root)
    db.create_table(TableSchema.create("e", {"made": "datetime"}))
    db.import_records("e", spark.sql("SELECT 1L AS id, '2024-07-01 12:00:00+0300' AS made UNION ALL SELECT 2L, '2024-07-01 12:00:00+03:00' UNION ALL SELECT 3L, '2024-07-01 09:00:00'"))
    assert db.table("e").column("made") == ["2024-07-01 09:00:00"] * 3


@pytest.mark.parametrize(("name", "want"), [("fullName", "full_name"), ("HTTPServer", "http_server"), ("parseJSON", "parse_json"), ("a1B", "a1_b"), ("ABC", "abc"), ("x", "x"), ("already_snake", "already_snake"), ("userID2", "user_id2"), ("_Under", "_under")])
def test_snake_case(name, want):
    assert snake_case(name) == want


def test_every_code_has_texts():
    assert set(English.TEXTS) == set(Russian.TEXTS) and len(English.TEXTS) > 80


# ------------------------------------------------------------------------------------------------ pages and lines


def test_offset_without_limit_stays_distributed(spark):
    from millrace.plans import query

    df = spark.range(0, 1000, 1, 7).selectExpr("id % 50 AS k", "id AS __pos")
    for offset in (1, 7, 499, 999, 1000, 5000):
        out = query.select(df, order=[("k", "desc")], offset=offset)
        want = sorted(range(1000), key=lambda i: (-(i % 50), i))[offset:]
        assert [r["k"] for r in out.collect()] == [i % 50 for i in want]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert query.select(df, order=["k"], offset=500).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_policies_and_tripwire(db, tmp_path):
    (tmp_path / "strange.ndjson").write_text('{"id":1,"b c":"x"}\n')
    with pytest.raises(SchemaError) as e:
        db.import_ndjson("t", f"file://{tmp_path}/strange.ndjson")
    assert e.value.code == "InvalidIdentifier"
    (tmp_path / "broken.ndjson").write_text('{"id":1,"b":"x"}\noops\n')
    db.set_broken_records("Refuse")
    with pytest.raises(DataError):
        db.import_ndjson("t", f"file://{tmp_path}/broken.ndjson")
    db.set_broken_records("Drop")
    assert db.import_ndjson("t", f"file://{tmp_path}/broken.ndjson") == {"rows": 1, "broken": 1, "odd": 0}
    with pytest.raises(DataError):
        db.set_broken_records("Keep")


def test_directories_are_mended(spark, db, tmp_path):
    load(db, 10)
    out = f"{tmp_path}/dir"
    export_directory(db, f"file://{out}")
    assert validate_directory(spark, f"file://{out}").issues == []
    with open(f"{out}/t/t.ndjson", "a", encoding="utf-8") as f:
        f.write('oops\n{"b":"x","id":20,"a":null,"c":1.5}\n{"id":21,"b')
    meta = json.load(open(f"{out}/meta.json"))
    json.dump({**meta, "ghost": {}}, open(f"{out}/meta.json", "w"))
    open(f"{out}/t/old.index.ndjson", "w").close()
    strict = Database.create(spark, f"{db.store.root}3", broken_records="Refuse")
    with pytest.raises(DataError):
        import_directory(strict, f"file://{out}")
    report = repair_directory(spark, f"file://{out}")
    assert all(i.repaired for i in report.issues) and validate_directory(spark, f"file://{out}").issues == []
    other = Database.create(spark, f"{db.store.root}2")
    assert import_directory(other, f"file://{out}") == {"t": 11} and other.last_row("t") == {"id": 20, "a": None, "b": "x", "c": 1.5}
    # a rename that stopped after the catalog had changed
    raw = json.load(open(f"{out}/information_schema.json"))
    raw["tables"]["u"] = raw["tables"].pop("t")
    json.dump(raw, open(f"{out}/information_schema.json", "w"))
    meta = json.load(open(f"{out}/meta.json"))
    json.dump({**meta, "_pendingRename": {"from": "t", "to": "u"}}, open(f"{out}/meta.json", "w"))
    assert "rename_incomplete" in {i.category for i in validate_directory(spark, f"file://{out}").issues}
    repair_directory(spark, f"file://{out}")
    assert not {i.category for i in validate_directory(spark, f"file://{out}").issues} - {"orphan_db_entry"}
    again = Database.create(spark, f"{db.store.root}4")
    assert import_directory(again, f"file://{out}") == {"u": 11} and again.next_id("u") == 21


def test_store_root_may_be_moved_to_another_instance(spark, db, root):
    load(db, 3)
    assert Store(spark, root).load().meta["t"].rows == 3


def test_a_changed_file_is_read_anew(spark, tmp_path):
    from millrace.sources.tables import parquet

    path = f"file://{tmp_path}/p"
    spark.range(3).write.parquet(path)
    assert parquet(spark, path).columns == ["id"] and parquet(spark, path).count() == 3
    time.sleep(0.01)
    spark.sql("SELECT 1 AS a, 2 AS b").write.mode("overwrite").parquet(path)
    assert parquet(spark, path).columns == ["a", "b"] and parquet(spark, path).count() == 1


def test_rows_by_id_are_read_alike_with_and_without_a_job(spark, db, monkeypatch):
    from millrace.sources import point

    load(db, 30)
    db.update("t", [Condition("id", "=", 7)], {"a": None})
    db.delete("t", [Condition("id", "=", 8)])
    db.insert("t", {"b": "new", "c": -0.5})
    ids = [1, 7, 8, 30, 31, 99, -1, 2**63 - 1]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    fast = [db.table("t").where("id", "=", i).one() for i in ids]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    monkeypatch.setattr(point, "MOST_FILES", -1)
    assert [db.table("t").where("id", "=", i).one() for i in ids] == fast and fast[1]["a"] is None and fast[2] is None
    monkeypatch.undo()
    t = db.table("t")
    assert t.where("id", "=", 1).limit(0).one() is None and t.where("id", "=", 1).where("a", "=", 99).one() is None and t.where("id", "=", 1, True).order_by("id").one()["id"] == 2
    with pytest.raises(DataError):
        t.where("id", "=", True).one()
    with pytest.raises(DataError):
        t.where("id", "=", 2**70).one()
    db.migrate("t", {"a": "int|null", "b": "string", "c": "float|null", "d": "int"})
    assert db.table("t").where("id", "=", 1).one() == {**fast[0], "d": 0}
    other = Database.open(spark, db.store.root, zone="Europe/Berlin")
    other.create_table(TableSchema.create("m", {"made": "datetime"}))
    other.insert("m", {"made": "2024-07-01 12:00:00"})
    assert other.table("m").where("id", "=", 1).one()["made"] == "2024-07-01 12:00:00" and db.table("m").where("id", "=", 1).one()["made"] == "2024-07-01 10:00:00"
