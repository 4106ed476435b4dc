"""Import, export and validation of NDJSON directories."""

import json

from millrace import Database, Relation, TableSchema, queries
from millrace.sources.directory import export_directory, import_directory, repair_tail, validate_directory
from millrace.sources.files import Files


def test_round_trip_and_findings(spark, root, tmp_path):
    db = Database.create(spark, root)
    db.create_table(TableSchema.create("Parents", {"name": "string", "score": "float|null"}))
    db.create_table(TableSchema.create("kids", {"parentId": "int|null"}))
    db.add_relation(Relation.declared("kids", "parentId", "Parents", on_delete="cascade"))
    db.insert_many("Parents", [{"name": "a", "score": 99.0}, {"name": "ж/", "score": None}, {"name": "gone", "score": 0.5}])
    db.table("Parents").delete_by_id(3)
    db.insert("kids", {"parentId": 1})
    out = f"{tmp_path}/dir"
    export_directory(db, f"file://{out}")
    first = open(f"{out}/parents/parents.ndjson", encoding="utf-8").readline()
    assert first == '{"id":1,"name":"a","score":99.0}\n'
    assert validate_directory(spark, f"file://{out}").issues == []
    other = Database.create(spark, f"{root}2")
    assert import_directory(other, f"file://{out}") == {"Parents": 2, "kids": 1}
    assert other.table("Parents").rows() == db.table("Parents").rows() and other.next_id("Parents") == 4
    assert other.delete("Parents", []) == 2 and other.count("kids") == 0

    with open(f"{out}/parents/parents.ndjson", "a", encoding="utf-8") as f:
        f.write('oops\n{"name":"x","id":2,"score":1}\n{"id":9,"name":null,"score":1}\n{"id":10,"na')
    open(f"{out}/parents/old.index.ndjson", "w").close()
    meta = json.load(open(f"{out}/meta.json"))
    meta["ghost"] = {}
    json.dump(meta, open(f"{out}/meta.json", "w"))
    found = {i.category: i for i in validate_directory(spark, f"file://{out}").issues}
    assert set(found) == {"broken_record", "record_key_order", "present_null", "pk_duplicate", "meta_line_count_drift", "meta_last_id_drift", "orphan_index_file", "meta_orphan_entry"}
    assert found["broken_record"].context["count"] == 1 and found["record_key_order"].context["count"] == 1
    assert repair_tail(spark, f"file://{out}/parents/parents.ndjson") == len('{"id":10,"na') and repair_tail(spark, f"file://{out}/parents/parents.ndjson") == 0


def test_lines_are_added_without_a_task_that_reads_the_whole_file(spark, monkeypatch):
    seen, joined, jobs = [], Files.joined, spark.sparkContext.statusTracker()

    def watched(self, folder, path):
        if not folder.endswith("/.new"):
            return joined(self, folder, path)
        before = self.read(path)
        joined(self, folder, path)
        seen.append((before, self.read(path)))

    monkeypatch.setattr(Files, "joined", watched)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        old = set(jobs.getJobIdsForGroup(None))
        rows = queries.QUERIES["store_directory_findings"](spark, "/root/testdata/sf0.01").collect()
        new = set(jobs.getJobIdsForGroup(None)) - old
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    [(before, after)] = seen
    assert after == before + 'oops\n{"status":"N","id":2,"customer":null,"total":1.5}\n'
    n = before.count("\n")
    found = [("broken_record", "1"), ("meta_line_count_drift", ""), ("meta_orphan_entry", ""), ("orphan_index_file", ""), ("record_key_order", "1")]
    assert sorted(map(tuple, rows)) == [*(("found", *x) for x in found), ("rows", "orders", str(n + 1))]

    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    read = []
    for stage in {s for j in new for s in jobs.getJobInfo(j).stageIds}:
        tasks = sc.statusStore().taskList(stage, 0, 1000)
        metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
        read += [m.get().inputMetrics().bytesRead() + m.get().shuffleReadMetrics().localBytesRead() for m in metrics if m.isDefined()]
    assert sum(read) > len(before) and max(read) < len(before) / 2
