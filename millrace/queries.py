"""Queries over the driver's tables, one for each operator of the record store, with the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .database import Database
from .errors import StoreError
from .operators.relational import Edge, closure, cut_lineage, duplicates, orphans, patched, referring, set_null, temporary, without
from .plans import query
from .plans.predicate import Condition, Filter, conjunction
from .plans.schema import Index, Relation, TableSchema, Unique
from .sources.tables import parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parquet(spark, f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str):
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _select(name: str, table: str, sql: str, where=(), **options) -> None:
    """A query of the select pipeline over one table."""
    conditions = [Condition(*c) for c in where]
    _add(name, sql)(lambda spark, sf: query.select(_table(spark, sf, table), conditions, **options))


# ------------------------------------------------------------------------------------------------ scans and projections

_select("scan_all", "orders", f"SELECT {ORDERS} FROM orders")
_select("project_column", "customer", "SELECT c_name FROM customer", project=["c_name"])
_select("project_columns", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem", project=["l_orderkey", "l_quantity"])

# ------------------------------------------------------------------------------------------------ conditions


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with labels, null where there is none."""
    docs = _table(spark, sf, "documents").select("doc_id", "lang", "source")
    return docs.join(_table(spark, sf, "labels"), "doc_id", "left")


_LABELLED = "SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _on_nulls(name: str, predicate: str, *where) -> None:
    conditions = [Condition(*c) for c in where]
    _add(name, f"SELECT * FROM ({_LABELLED}) WHERE {predicate}")(lambda spark, sf: query.select(_labelled(spark, sf), conditions, tie=["doc_id"]))


for _name, _predicate, _where in [
    ("filter_eq", "o_orderstatus = 'F'", ("o_orderstatus", "=", "F")), ("filter_not_eq", "o_orderstatus IS DISTINCT FROM 'F'", ("o_orderstatus", "=", "F", True)),
    ("filter_gt", "o_totalprice > 200000", ("o_totalprice", ">", 200000)), ("filter_gte", "o_custkey >= 700", ("o_custkey", ">=", 700)),
    ("filter_lt", "o_totalprice < 50000.5", ("o_totalprice", "<", 50000.5)), ("filter_lte", "o_custkey <= 300", ("o_custkey", "<=", 300)),
    ("filter_not_gt", "o_totalprice IS NULL OR NOT (o_totalprice > 200000)", ("o_totalprice", ">", 200000, True)),
    ("filter_between", "o_totalprice BETWEEN 100000 AND 150000", ("o_totalprice", "BETWEEN", [100000, 150000])),
    ("filter_between_reversed", "o_totalprice BETWEEN 150000 AND 100000", ("o_totalprice", "BETWEEN", [150000, 100000])),
    ("filter_not_between", "o_totalprice IS NULL OR NOT (o_totalprice BETWEEN 100000 AND 150000)", ("o_totalprice", "BETWEEN", [100000, 150000], True)),
    ("filter_in", "o_orderpriority IN ('1-URGENT', '2-HIGH')", ("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"])),
    ("filter_not_in", "o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT')", ("o_orderpriority", "IN", ["1-URGENT"], True)),
    ("filter_in_empty", "false", ("o_custkey", "IN", [])), ("filter_not_in_empty", "true", ("o_custkey", "IN", [], True)),
]:
    _select(_name, "orders", f"SELECT {ORDERS} FROM orders WHERE {_predicate}", [_where])

_on_nulls("filter_is_null", "quality IS NULL", ("quality", "=", None))
_on_nulls("filter_is_not_null", "quality IS NOT NULL", ("quality", "=", None, True))
_on_nulls("filter_eq_on_nulls", "quality = 1", ("quality", "=", 1))
_on_nulls("filter_not_eq_on_nulls", "quality IS DISTINCT FROM 1", ("quality", "=", 1, True))
_on_nulls("filter_not_gt_on_nulls", "quality IS NULL OR NOT (quality > 0)", ("quality", ">", 0, True))
_on_nulls("filter_not_gte_on_nulls", "quality IS NULL OR NOT (quality >= 1)", ("quality", ">=", 1, True))
_on_nulls("filter_not_lt_on_nulls", "quality IS NULL OR NOT (quality < 1)", ("quality", "<", 1, True))
_on_nulls("filter_not_lte_on_nulls", "quality IS NULL OR NOT (quality <= 0)", ("quality", "<=", 0, True))
_on_nulls("filter_not_between_on_nulls", "quality IS NULL OR NOT (quality BETWEEN 1 AND 5)", ("quality", "BETWEEN", [1, 5], True))
_on_nulls("filter_in_with_null", "quality = 0 OR quality IS NULL", ("quality", "IN", [0, None]))
_on_nulls("filter_not_in_with_null", "quality IS NOT NULL AND quality <> 0", ("quality", "IN", [0, None], True))
_on_nulls("filter_not_in_on_nulls", "quality IS NULL OR quality <> 0", ("quality", "IN", [0], True))
_on_nulls("filter_not_range_and_not_null", "NOT (quality > 0) AND quality IS NOT NULL", ("quality", ">", 0, True), ("quality", "=", None, True))

for _name, _pattern, _predicate in [
    ("like_exact", "Customer#000000042", "c_name = 'Customer#000000042'"), ("like_prefix", "Customer#00000001%", "starts_with(c_name, 'Customer#00000001')"),
    ("like_suffix", "%7", "ends_with(c_name, '7')"), ("like_contains", "%0001%", "contains(c_name, '0001')"), ("like_any", "%", "c_name IS NOT NULL"),
    ("like_both_ends", "C%9", "starts_with(c_name, 'C') AND ends_with(c_name, '9')"),
    ("like_inner_wildcards", "C%00%1%", r"regexp_matches(c_name, '(?s)\AC.*00.*1.*\z')"), ("like_underscore_literal", "Customer_%", "starts_with(c_name, 'Customer_')"),
    ("like_escaped_percent", r"%\%%", "contains(c_name, '%')"),
]:
    _select(_name, "customer", f"SELECT c_custkey, c_name FROM customer WHERE {_predicate}", [("c_name", "LIKE", _pattern)], project=["c_custkey", "c_name"])
_select("not_like", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_name IS NULL OR NOT ends_with(c_name, '7')", [("c_name", "LIKE", "%7", True)], project=["c_custkey", "c_name"])

_select(
    "conjunction", "orders", f"SELECT {ORDERS} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND NOT starts_with(o_orderpriority, '1')",
    [("o_orderstatus", "=", "F"), ("o_totalprice", ">", 100000), ("o_orderpriority", "LIKE", "1%", True)],
)


@_add("reusable_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 150000 AND o_custkey < 500")
def _reusable(spark, sf):
    dear = Filter().where("o_orderstatus", "=", "O").where("o_totalprice", ">=", 150000)
    return query.select(_table(spark, sf, "orders"), dear.where("o_custkey", "<", 500), project=["o_orderkey"])


# ------------------------------------------------------------------------------------------------ order, slice, distinct

_select(
    "order_limit_topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 10",
    [("o_orderstatus", "=", "F")], order=[("o_totalprice", "desc")], tie=["o_orderkey"], limit=10, project=["o_orderkey", "o_totalprice"],
)
_select(
    "order_multi_key", "orders", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50",
    order=[("o_orderpriority", "ASC"), ("o_orderdate", "Desc")], tie=["o_orderkey"], limit=50, project=["o_orderkey", "o_orderpriority"],
)
_select("deep_page", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 5000", order=["o_totalprice"], tie=["o_orderkey"], limit=20, offset=5000, project=["o_orderkey"])
_select("offset_only", "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100", order=["c_custkey"], tie=[], offset=100, project=["c_custkey"])
_select("limit_zero", "customer", "SELECT c_custkey FROM customer LIMIT 0", limit=0, project=["c_custkey"])


def _ranked(df: DataFrame) -> DataFrame:
    """Rows of an ordered frame with their number in that order: sorted partitions are counted, then numbered."""
    df = cut_lineage(df).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    starts = df.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return df.join(F.broadcast(starts), "__p").withColumn("place", F.col("__start") + F.col("__k") + 1).drop("__p", "__k", "__start")


_add("order_nulls_first", f"SELECT doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS FIRST, doc_id) AS place FROM ({_LABELLED})")(
    lambda spark, sf: _ranked(query.select(_labelled(spark, sf), order=["quality"], tie=["doc_id"], project=["doc_id", "quality"]))
)
_add("order_nulls_last", f"SELECT doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS LAST, doc_id) AS place FROM ({_LABELLED})")(
    lambda spark, sf: _ranked(query.select(_labelled(spark, sf), order=[("quality", "desc")], tie=["doc_id"], project=["doc_id", "quality"]))
)
_select("select_one", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 1", [("o_custkey", "=", 7)], order=["o_orderkey"], tie=[], limit=1, project=["o_orderkey", "o_totalprice"])
_select("point_lookup", "orders", f"SELECT {ORDERS} FROM orders WHERE o_orderkey = 4001", [("o_orderkey", "=", 4001)])
_select(
    "distinct_on_keep_first", "orders", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1",
    order=["o_totalprice"], tie=["o_orderkey"], distinct=["o_custkey"], project=["o_custkey", "o_orderkey", "o_totalprice"],
)
_select(
    "distinct_on_paged", "orders",
    "SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1) ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 30",
    order=[("o_totalprice", "desc")], tie=["o_orderkey"], distinct=["o_custkey"], limit=15, offset=30, project=["o_custkey", "o_orderkey"],
)
_add("distinct_on_nulls", f"SELECT doc_id, quality, toxic FROM ({_LABELLED}) QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) = 1")(
    lambda spark, sf: query.select(_labelled(spark, sf), tie=["doc_id"], distinct=["quality", "toxic"], project=["doc_id", "quality", "toxic"])
)

# ------------------------------------------------------------------------------------------------ counts

_add("count_all", "SELECT count(*) AS n FROM lineitem")(lambda spark, sf: query.count(_table(spark, sf, "lineitem")))
_add("count_where", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")(
    lambda spark, sf: query.count(_table(spark, sf, "lineitem"), [Condition("l_quantity", ">", 25), Condition("l_returnflag", "=", "R")])
)
_add("count_distinct", "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")(
    lambda spark, sf: query.count(_table(spark, sf, "lineitem"), distinct=["l_returnflag", "l_linestatus"])
)
_add("count_distinct_with_null", f"SELECT count(*) AS n FROM (SELECT DISTINCT quality FROM ({_LABELLED}))")(lambda spark, sf: query.count(_labelled(spark, sf), distinct=["quality"]))
_add("exists_where", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 400000")(
    lambda spark, sf: spark.createDataFrame([(query.exists(_table(spark, sf, "orders"), [Condition("o_totalprice", ">", 400000)]),)], "found boolean")
)
# ------------------------------------------------------------------------------------------------ constraints and relations

_add("unique_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")(
    lambda spark, sf: duplicates(_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
)
_add("unique_duplicates_skip_nulls", f"SELECT source, quality, count(*) AS count FROM ({_LABELLED}) WHERE quality IS NOT NULL GROUP BY ALL HAVING count(*) > 1")(
    lambda spark, sf: duplicates(_labelled(spark, sf), ["source", "quality"])
)
_add("pk_duplicates", "SELECT o_orderkey, count(*) AS count FROM orders GROUP BY o_orderkey HAVING count(*) > 1")(lambda spark, sf: duplicates(_table(spark, sf, "orders"), ["o_orderkey"]))
_add("fk_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")(
    lambda spark, sf: orphans(_table(spark, sf, "orders"), "o_custkey", _table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")
)
_add("fk_restrict_probe", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")(
    lambda spark, sf: referring(_table(spark, sf, "orders"), "o_custkey", _table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")).select("o_orderkey")
)


@_add(
    "cascade_delete_closure",
    """
WITH n AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')),
c AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT k FROM n)), o AS (SELECT o_orderkey AS k FROM orders WHERE o_custkey IN (SELECT k FROM c))
SELECT 'region' AS table_name, count(*) AS deleted FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'customer', count(*) FROM c
UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT k FROM o)
""",
)
def _cascade(spark, sf):
    names = ["region", "nation", "customer", "orders", "lineitem"]
    tables = {n: _table(spark, sf, n) for n in names}
    edges = [
        Edge("region", "nation", "n_regionkey", "r_regionkey"), Edge("nation", "customer", "c_nationkey", "n_nationkey"),
        Edge("customer", "orders", "o_custkey", "c_custkey"), Edge("orders", "lineitem", "l_orderkey", "o_orderkey"),
    ]
    ids = {n: [tables[n].columns[0]] for n in names}
    reached = closure(tables, ids, edges, {"region": tables["region"].where("r_name = 'ASIA'")})
    out = None
    for n in names:
        row = reached[n].agg(F.lit(n).alias("table_name"), F.count("*").alias("deleted"))
        out = row if out is None else out.unionByName(row)
    return out


_add("set_null_result", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")(
    lambda spark, sf: set_null(_table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", _table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey"))
)


def _predicate(df: DataFrame, *where):
    return conjunction([Condition(*c) for c in where], query.column_types(df))


@_add("update_where_result", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _updated(spark, sf):
    df = _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return patched(df, _predicate(df, ("o_totalprice", ">", 300000)), {"o_orderstatus": "X"}).drop("o_totalprice")


@_add("delete_where_result", f"SELECT doc_id, quality FROM ({_LABELLED}) WHERE quality IS DISTINCT FROM 1")
def _deleted(spark, sf):
    df = _labelled(spark, sf)
    return without(df, _predicate(df, ("quality", "=", 1))).select("doc_id", "quality")


@_add("join_two_step", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 250000")
def _two_step(spark, sf):
    dear = query.select(_table(spark, sf, "orders"), [Condition("o_totalprice", ">", 250000)], project=["o_orderkey", "o_custkey"])
    parents = query.select(_table(spark, sf, "customer"), project=["c_custkey", "c_name"])
    return dear.join(parents, dear["o_custkey"] == parents["c_custkey"]).select("o_orderkey", "c_name")


# ------------------------------------------------------------------------------------------------ the store itself


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where the session names none (local runs)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared or 'file://' + temporary(spark)}/store-{uuid.uuid4().hex}"


def _shop(spark: SparkSession, sf: str, on_delete: str = "cascade", on_update: str = "noAction") -> Database:
    """customers and orders in a database of their own, joined by a relation on the customer's code."""
    db = Database.create(spark, _folder(spark))
    db.create_table(TableSchema.create("customers", {"code": "int", "name": "string", "balance": "float"}, uniques=[Unique("u_code", ("code",))]))
    db.create_table(TableSchema.create("orders", {"customer": "int|null", "status": "string", "total": "float"}, [Index.on("by_customer", "customer")]))
    db.import_records("customers", _table(spark, sf, "customer").selectExpr("c_custkey + 1 AS id", "c_custkey AS code", "c_name AS name", "c_acctbal AS balance"))
    db.import_records("orders", _table(spark, sf, "orders").selectExpr("o_orderkey + 1 AS id", "o_custkey AS customer", "o_orderstatus AS status", "o_totalprice AS total"))
    db.add_relation(Relation.declared("orders", "customer", "customers", "code", on_delete=on_delete, on_update=on_update))
    return db


_STORED = "SELECT o_orderkey + 1 AS id, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS total FROM orders"

_add("store_import", _STORED)(lambda spark, sf: _shop(spark, sf).read_all("orders"))


@_add("store_builder_page", f"SELECT id, total FROM ({_STORED}) WHERE status = 'O' AND total BETWEEN 1000 AND 200000 ORDER BY total DESC, id LIMIT 25 OFFSET 50")
def _store_page(spark, sf):
    t = _shop(spark, sf).table("orders").where("status", "=", "O").where("total", "BETWEEN", [1000, 200000])
    return t.order_by("total", "desc").order_by("id").limit(25).offset(50).frame().select("id", "total")


@_add("store_insert", f"SELECT id, total FROM ({_STORED}) WHERE total > 400000 UNION ALL SELECT (SELECT max(o_orderkey) + 1 FROM orders) + i, 500000.0 + i FROM range(1, 4) r(i)")
def _store_insert(spark, sf):
    db = _shop(spark, sf)
    db.insert_many("orders", [{"customer": None, "status": "N", "total": 500000.0 + i} for i in (1, 2, 3)])
    return db.select("orders", [Condition("total", ">", 400000)], project=["id", "total"])


@_add("store_update", f"SELECT id, CASE WHEN total > 300000 THEN 'X' ELSE status END AS status FROM ({_STORED})")
def _store_update(spark, sf):
    db = _shop(spark, sf)
    db.table("orders").where("total", ">", 300000).update({"status": "X"})
    return db.select("orders", project=["id", "status"])


@_add("store_delete_cascade", f"SELECT id, customer FROM ({_STORED}) WHERE customer NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _store_cascade(spark, sf):
    db = _shop(spark, sf)
    db.delete("customers", [Condition("balance", "<", 0)])
    return db.select("orders", project=["id", "customer"])


@_add("store_delete_set_null", f"SELECT id, CASE WHEN customer IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN NULL ELSE customer END AS customer FROM ({_STORED})")
def _store_set_null(spark, sf):
    db = _shop(spark, sf, on_delete="setNull")
    db.delete("customers", [Condition("balance", "<", 0)])
    return db.select("orders", project=["id", "customer"])


@_add("store_update_cascade", f"SELECT id, CASE WHEN customer = 7 THEN -7 ELSE customer END AS customer FROM ({_STORED})")
def _store_update_cascade(spark, sf):
    db = _shop(spark, sf, on_update="cascade")
    db.update("customers", [Condition("code", "=", 7)], {"code": -7})
    return db.select("orders", project=["id", "customer"])


@_add("store_restrict", "SELECT 'ForeignKeyRestricted' AS code, (SELECT count(*) FROM customer) AS customers")
def _store_restrict(spark, sf):
    db, code = _shop(spark, sf, on_delete="restrict"), "none"
    try:
        db.delete("customers", [Condition("balance", "<", 0)])
    except StoreError as e:
        code = e.code
    return spark.createDataFrame([(code, db.count("customers"))], "code string, customers long")


@_add("store_schema_changes", f"SELECT id, 0::BIGINT AS points, total AS amount, NULL::VARCHAR AS note FROM ({_STORED})")
def _store_schema_changes(spark, sf):
    db = _shop(spark, sf)
    db.drop_relation(db.relations()[0])
    db.drop_index("orders", "by_customer")
    db.migrate("orders", {"total": "float", "note": "string|null", "points": "int"})
    db.rename_column("orders", "total", "amount")
    db.reorder_columns("orders", ["points", "amount", "note"])
    db.rename_table("orders", "sales")
    db.optimize("sales")
    return db.read_all("sales")


@_add("store_backup_restore", f"SELECT * FROM ({_STORED}) WHERE status <> 'P'")
def _store_backup(spark, sf):
    db = _shop(spark, sf)
    db.delete("orders", [Condition("status", "=", "P")])
    with tempfile.TemporaryDirectory() as d:  # archives are files of the driver
        archive = db.backup(f"{d}/a.tar.gz")
        db.truncate("orders")
        db.restore(archive)
    return db.read_all("orders")


@_add("store_ndjson", _STORED)
def _store_ndjson(spark, sf):
    db, other = _shop(spark, sf), _folder(spark)
    db.export_ndjson("orders", other)
    db.truncate("orders")
    db.import_ndjson("orders", other)
    return db.read_all("orders")


@_add("store_validate", "SELECT 'fk_orphan' AS category, 'info' AS severity, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))::VARCHAR AS found UNION ALL SELECT 'unique_index_missing', 'info', 'no'")
def _store_validate(spark, sf):
    db = _shop(spark, sf, on_delete="noAction")
    db.delete("customers", [Condition("balance", "<", 0)])
    rows = [(i.category, i.severity, i.message.split()[0]) for i in db.validate().issues]
    return spark.createDataFrame(rows, "category string, severity string, found string")


# ------------------------------------------------------------------------------------------------ more of the store

_add("meta_counters", "SELECT count(*) AS row_count, max(o_orderkey) + 1 AS last_id, max(o_orderkey) + 2 AS next_id FROM orders")(
    lambda spark, sf: _counters(spark, _shop(spark, sf))
)


def _counters(spark, db) -> DataFrame:
    return spark.createDataFrame([(db.count("orders"), db.last_id("orders"), db.table("orders").next_id())], "row_count long, last_id long, next_id long")


@_add("migrate_columns_result", f"SELECT id, status, total, 0::BIGINT AS points, NULL::VARCHAR AS note FROM ({_STORED})")
def _migrated(spark, sf):
    db = _shop(spark, sf)
    db.drop_relation(db.relations()[0])
    db.drop_index("orders", "by_customer")
    db.migrate("orders", {"status": "string", "total": "float", "points": "int", "note": "string|null"})
    return db.read_all("orders")


@_add("rename_column_result", f"SELECT id, customer, status AS state, total FROM ({_STORED})")
def _renamed(spark, sf):
    db = _shop(spark, sf)
    db.rename_column("orders", "status", "state")
    return db.read_all("orders")


_add("store_rename_table", f"SELECT * FROM ({_STORED}) WHERE total > 300000")(lambda spark, sf: _moved(_shop(spark, sf)))


def _moved(db: Database) -> DataFrame:
    db.rename_table("orders", "sales")
    db.create_table(TableSchema.create("orders", {"x": "int"}))  # the old name is free, the old folder is not
    db.insert("orders", {"x": 1})
    return db.select("sales", [Condition("total", ">", 300000)])


def _codes(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    """Name and error code of each case, or `none`."""
    rows = []
    for name, work in cases.items():
        code = "none"
        try:
            work()
        except StoreError as e:
            code = e.code
        rows.append((name, code))
    return spark.createDataFrame(rows, "name string, code string")


def _values(**codes: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in codes.items()) + ") t(name, code)"


@_add("query_errors", _values(column="QueryUnknownColumn", operator="InvalidOperator", type="TypeMismatch", nan="NonFiniteFloat", pair="InvalidBetween", list="InvalidIn", like="LikeOnNonStringColumn", operand="InvalidOperand", limit="InvalidLimit", offset="InvalidOffset", direction="InvalidSortDirection", distinct="QueryUnknownColumn", boolean="TypeMismatch"))
def _query_errors(spark, sf):
    t = _table(spark, sf, "orders")
    run = lambda *c, **o: (lambda: query.select(t, [Condition(*c)] if c else (), **o))
    return _codes(spark, {
        "column": run("nowhere", "=", 1), "operator": run("o_custkey", "~", 1), "type": run("o_custkey", "=", "7"), "nan": run("o_totalprice", ">", float("nan")), "pair": run("o_custkey", "BETWEEN", [1]),
        "list": run("o_custkey", "IN", [[1]]), "like": run("o_custkey", "LIKE", "1%"), "operand": run("o_custkey", ">", None), "limit": run(limit=-1), "offset": run(offset=-1),
        "direction": run(order=[("o_custkey", "up")]), "distinct": run(distinct=["nowhere"]), "boolean": run("o_custkey", "=", True),
    })


@_add("store_unique", _values(insert="UniqueViolation", together="UniqueViolation", update="UniqueViolation", same="none", constraint="UniqueViolation", primary="UniqueViolation"))
def _unique(spark, sf):
    db = _shop(spark, sf)
    row = {"code": 7, "name": "again", "balance": 1.0}
    return _codes(spark, {
        "insert": lambda: db.insert("customers", row), "together": lambda: db.insert_many("customers", [{**row, "code": -1}, {**row, "code": -1}]),
        "update": lambda: db.update("customers", [Condition("code", "=", 8)], {"code": 7}), "same": lambda: db.update("customers", [Condition("code", "=", 7)], {"code": 7}),
        "constraint": lambda: db.add_unique("orders", Unique("u_status", ("status",))), "primary": lambda: db.import_records("customers", [{"id": 1, **row}, {"id": 1, **row, "code": 9}]),
    })


@_add("store_rejected_values", _values(missing="RequiredColumnMissing", null="NullInColumn", text="TypeMismatch", infinite="NonFiniteFloat", widened="none", unknown="none", id="ImportIdInvalid", bulk="ImportValuesInvalid", kind="TypeMismatch"))
def _rejected(spark, sf):
    db, row = _shop(spark, sf), {"customer": None, "status": "N", "total": 1.0}
    bad = spark.sql("SELECT 1L AS id, CAST('nan' AS DOUBLE) AS total, 'N' AS status, 1L AS customer")
    return _codes(spark, {
        "missing": lambda: db.insert("orders", {"status": "N"}), "null": lambda: db.insert("orders", {**row, "status": None}), "text": lambda: db.insert("orders", {**row, "total": "1"}),
        "infinite": lambda: db.insert("orders", {**row, "total": float("inf")}), "widened": lambda: db.insert("orders", {**row, "total": 1}), "unknown": lambda: db.insert("orders", {**row, "nowhere": 1}),
        "id": lambda: db.import_records("orders", [{**row, "id": 0}]), "bulk": lambda: db.import_records("orders", bad), "kind": lambda: db.import_records("orders", bad.withColumn("status", F.lit(1))),
    })


@_add("store_update_set_null", f"SELECT id, CASE WHEN customer BETWEEN 5 AND 9 THEN NULL ELSE customer END AS customer FROM ({_STORED})")
def _update_set_null(spark, sf):
    db = _shop(spark, sf, on_update="setNull")
    for code in range(5, 10):
        db.update("customers", [Condition("code", "=", code)], {"code": -code})
    return db.select("orders", project=["id", "customer"])


@_add("store_update_restrict", "SELECT 'ForeignKeyRestricted' AS code, (SELECT min(o_custkey) FROM orders) AS kept, (SELECT min(o_custkey) FROM orders) AS still")
def _update_restrict(spark, sf):
    db, code = _shop(spark, sf, on_update="restrict"), "none"
    least = db.table("orders").order_by("customer").where("customer", "=", None, True).limit(1).one()["customer"]
    try:
        db.update("customers", [Condition("code", "=", least)], {"code": -1})
    except StoreError as e:
        code = e.code
    kept = db.table("customers").where("code", "=", least).one()["code"]
    return spark.createDataFrame([(code, kept, least)], "code string, kept long, still long")


@_add("store_cyclic_cascade", """
WITH RECURSIVE t AS (SELECT o_orderkey + 1 AS id, CASE WHEN o_orderkey = 0 THEN 33 WHEN o_orderkey % 4 = 0 THEN o_orderkey // 8 * 4 + 1 ELSE o_orderkey END AS parent FROM orders WHERE o_orderkey < 400),
gone AS (SELECT id FROM t WHERE id = 5 UNION SELECT t.id FROM t JOIN gone ON t.parent = gone.id)
SELECT id, parent FROM t WHERE id NOT IN (SELECT id FROM gone)
""")
def _cyclic(spark, sf):
    """A tree whose root hangs on one of its leaves: deleting any node deletes all that can be reached."""
    db = Database.create(spark, _folder(spark))
    db.create_table(TableSchema.create("nodes", {"parent": "int"}))
    parent = "CASE WHEN o_orderkey = 0 THEN 33 WHEN o_orderkey % 4 = 0 THEN o_orderkey div 8 * 4 + 1 ELSE o_orderkey END AS parent"
    db.import_records("nodes", _table(spark, sf, "orders").where("o_orderkey < 400").selectExpr("o_orderkey + 1 AS id", parent))
    db.add_relation(Relation.declared("nodes", "parent", "nodes", on_delete="cascade"))
    db.delete("nodes", [Condition("id", "=", 5)])
    return db.read_all("nodes")


@_add("distinct_signed_zero", "SELECT count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN '-0.0' ELSE '0.0' END) AS n FROM orders")
def _signed_zero(spark, sf):
    df = _table(spark, sf, "orders").selectExpr("o_totalprice * 0.0D * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS x")
    return query.count(df, distinct=["x"])


_add("order_collated", "SELECT c_custkey, row_number() OVER (ORDER BY upper(c_mktsegment), c_custkey) AS place FROM customer")(
    lambda spark, sf: _ranked(query.select(_table(spark, sf, "customer"), order=["c_mktsegment"], tie=["c_custkey"], project=["c_custkey"], collation="UNICODE"))
)


@_add("store_index_plan", f"SELECT 'by_customer' AS plan, * FROM ({_STORED}) WHERE customer = 7 AND total > 1000 UNION ALL SELECT 'scan', * FROM ({_STORED}) WHERE status = 'P' AND total > 250000 UNION ALL SELECT 'by_customer_total', * FROM ({_STORED}) WHERE customer = 11 AND total BETWEEN 50000 AND 200000")
def _index_plan(spark, sf):
    """Rows found through an index, through the better of two, and by a scan, after inserts, updates and deletes."""
    db = _shop(spark, sf)
    db.add_index("orders", Index.on("by_customer_total", "customer", ("total", "desc")))
    db.drop_relation(db.relations()[0])
    db.rebuild_all_indexes("orders")
    top = db.last_id("orders")
    db.insert_many("orders", [{"customer": 7, "status": "N", "total": 2000.0 + i} for i in range(3)])
    db.update("orders", [Condition("customer", "=", 11), Condition("total", "<", 50000)], {"total": 49999.0})
    db.delete("orders", [Condition("id", ">", top)])
    out = None
    for where in ([("customer", "=", 7), ("total", ">", 1000)], [("status", "=", "P"), ("total", ">", 250000)], [("customer", "=", 11), ("total", "BETWEEN", [50000, 200000])]):
        conditions = [Condition(*c) for c in where]
        plan = db.explain_index("orders", conditions)
        if where[0][1:] == ("=", 7):
            db.drop_index("orders", "by_customer_total")
            plan = db.explain_index("orders", conditions)
            part = cut_lineage(db.select("orders", conditions))
            db.add_index("orders", Index.on("by_customer_total", "customer", ("total", "desc")))
            db.rebuild_index("orders", "by_customer_total")
        else:
            part = db.select("orders", conditions)
        part = part.select(F.lit(plan or "scan").alias("plan"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@_add("store_positions", f"SELECT id, total FROM ({_STORED}) QUALIFY row_number() OVER (ORDER BY id) IN (1, 3, 10)")
def _positions(spark, sf):
    db = _shop(spark, sf)
    at = db.stored("orders").orderBy("id").select("__pos").limit(10).collect()
    wanted = spark.createDataFrame([(at[i][0],) for i in (9, 0, 2)], "p long")
    return db.by_position("orders", wanted).select("id", "total")


@_add("store_stream", f"SELECT customer, status, total FROM ({_STORED}) UNION ALL SELECT customer, status, total FROM ({_STORED}) WHERE total > 200000")
def _stream(spark, sf):
    """Two streams of batches into one table, one of them delivered twice."""
    from .streaming.append import append_batch

    db = _shop(spark, sf)
    rows = cut_lineage(db.read_all("orders").drop("id"))
    db.truncate("orders")
    for k in range(3):
        append_batch(db, "orders", rows.where(F.pmod("customer", F.lit(3)) == k), k, "first")
    append_batch(db, "orders", rows, 2, "first")
    for _ in range(2):
        append_batch(db, "orders", rows.where("total > 200000"), 0, "second")
    ids = db.stored("orders").agg(F.max("id") - F.count("*"), F.countDistinct("id") - F.count("*")).first()
    return db.read_all("orders").drop("id") if tuple(ids) == (0, 0) else spark.createDataFrame([], "customer long, status string, total double")


@_add("store_temporal", """
SELECT o_orderkey + 1 AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate + to_hours(2 + o_orderkey % 10), '%Y-%m-%d %H:%M:%S') AS made, strftime(o_orderdate - to_hours(1), '%Y-%m-%d %H:%M:%S') AS shifted
FROM orders WHERE o_orderkey < 200
""")
def _temporal(spark, sf):
    """Instants given in the engine's zone (two hours ahead of UTC all year) or with an offset, read back in that zone."""
    db = Database.create(spark, _folder(spark), zone="Etc/GMT-2")
    db.create_table(TableSchema.create("t", {"day": "date", "made": "datetime", "shifted": "datetime"}))
    t = "CAST(o_orderdate AS TIMESTAMP)"
    made = f"date_format({t} + make_interval(0, 0, 0, 0, 2 + o_orderkey % 10), 'yyyy-MM-dd HH:mm:ss') AS made"
    given = f"concat(date_format({t}, 'yyyy-MM-dd HH:mm:ss'), '+0300') AS shifted"
    db.import_records("t", _table(spark, sf, "orders").where("o_orderkey < 200").selectExpr("o_orderkey + 1 AS id", f"date_format({t}, 'yyyy-MM-dd') AS day", made, given))
    return db.read_all("t")


@_add("store_records", f"SELECT id, customer, total FROM ({_STORED}) WHERE total > 400000")
def _records(spark, sf):
    """Rows as objects of a record class and back."""
    from dataclasses import dataclass

    from .mapping import record

    @record("orders")
    @dataclass
    class Order:
        id: int | None
        customer: int | None
        status: str
        total: float

    db = _shop(spark, sf)
    db.records.register(Order)
    rows = [(o.id, o.customer, o.total) for o in db.table("orders").where("total", ">", 400000).records()]
    return spark.createDataFrame(rows, "id long, customer long, total double")


@_add("store_directory", f"SELECT * FROM ({_STORED})")
def _directory(spark, sf):
    from .sources.directory import export_directory, import_directory, validate_directory

    db, path = _shop(spark, sf), _folder(spark)
    export_directory(db, path)
    other = Database.create(spark, _folder(spark))
    import_directory(other, path)
    return other.read_all("orders") if not validate_directory(spark, path).has_errors() else other.read_all("customers")


@_add("store_backup_folder", f"SELECT * FROM ({_STORED})")
def _backup_folder(spark, sf):
    db, folder = _shop(spark, sf), f"{_folder(spark)}/"
    db.backup(folder)
    db.truncate("orders")
    db.restore(folder)
    return db.read_all("orders")


@_add("store_broken_lines", "SELECT 6 AS rows, 3 AS broken, 1 AS odd, 'BrokenRecordBlocksRewrite' AS refused, 'InvalidIdentifier' AS strange")
def _broken_lines(spark, sf):
    db, path = _shop(spark, sf), _folder(spark)
    good = [f'{{"id":{i},"customer":{i},"status":"N","total":1.5}}' for i in range(1, 6)]
    lines = [*good[:3], "not json", "[1]", *good[3:], '{"id":6,"customer":"x","status":"N","total":2}', '{"id":7,"cu']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/broken")
    spark.createDataFrame([('{"id":1,"a b":2}',)], "value string").coalesce(1).write.text(f"{path}/strange")
    db.set_broken_records("Refuse")
    codes = {r["name"]: r["code"] for r in _codes(spark, {"refused": lambda: db.import_ndjson("orders", f"{path}/broken"), "strange": lambda: db.import_ndjson("orders", f"{path}/strange")}).collect()}
    got = db.import_ndjson("orders", f"{path}/broken", "Drop")
    return spark.createDataFrame([(got["rows"], got["broken"], got["odd"], codes["refused"], codes["strange"])], "rows int, broken int, odd int, refused string, strange string")


@_add("store_schema_errors", _values(table="TableAlreadyExists", case="TableAlreadyExists", name="InvalidIdentifier", type="InvalidColumnType", index="InvalidIndexFields", column="ColumnInUse", migrate="MigrateColumnTypeChange", default="MigrateColumnNoDefault", relation="RelationTypeMismatch", target="RelationReferencesNotUnique", twice="RelationDuplicate", null="SetNullNeedsNullable", constraint="UniqueInUse", primary="PrimaryIndexNotDroppable", id="PkColumnNotRenamable"))
def _schema_errors(spark, sf):
    db = _shop(spark, sf)
    new = lambda name, columns=None, indexes=(): (lambda: db.create_table(TableSchema.create(name, columns or {"a": "int"}, indexes)))
    link = lambda *a, **o: (lambda: db.add_relation(Relation.declared(*a, **o)))
    return _codes(spark, {
        "table": new("orders"), "case": new("Orders"), "name": new("a b"), "type": new("n", {"a": "decimal"}), "index": new("n", {"a": "int"}, [Index("i", ())]),
        "column": lambda: db.migrate("orders", {"status": "string", "total": "float"}), "migrate": lambda: db.migrate("customers", {"code": "int", "name": "int", "balance": "float"}),
        "default": lambda: db.migrate("customers", {"code": "int", "name": "string", "balance": "float", "day": "date"}), "relation": link("orders", "status", "customers", "code"),
        "target": link("orders", "total", "customers", "balance", on_delete="cascade"), "twice": link("orders", "customer", "customers", "code"), "null": link("customers", "code", "orders", "id", on_delete="setNull"),
        "constraint": lambda: db.drop_unique("customers", "u_code"), "primary": lambda: db.drop_index("orders", "id"), "id": lambda: db.rename_column("orders", "id", "key"),
    })


@_add("store_catalog", "SELECT * FROM (VALUES (0, 'id', 'int', NULL), (1, 'customer', 'int|null', 'who bought'), (2, 'status', 'string', NULL), (3, 'total', 'float', NULL)) t(position, \"column\", type, comment)")
def _catalog(spark, sf):
    db = _shop(spark, sf)
    db.set_column_comments("orders", {"customer": "who bought", "status": "x"})
    db.set_column_comments("orders", {"status": None})
    return db.describe("orders")


@_add("store_repair", f"SELECT 'before' AS state, category FROM (VALUES ('meta_line_count_drift'), ('meta_last_id_drift'), ('table_unverified'), ('index_drift'), ('meta_orphan_entry'), ('unique_index_missing')) t(category) UNION ALL SELECT 'after', 'unique_index_missing' UNION ALL SELECT 'rows', (SELECT count(*) FROM ({_STORED}))::VARCHAR UNION ALL SELECT 'next', (SELECT max(id) + 1 FROM ({_STORED}))::VARCHAR")
def _repaired(spark, sf):
    import json

    db = _shop(spark, sf)
    db.rebuild_index("orders", "by_customer")
    files, path = db.store.files, db.store.path
    raw = json.loads(files.read(path))
    raw["meta"]["orders"] |= {"rows": 1, "last_id": 2}
    raw["meta"]["orders"]["indexes"]["by_customer"][0]["rows"] += 1
    raw["meta"]["ghost"] = {"parts": [], "rows": 0, "last_id": 0, "next_pos": 0}
    files.replace(path, json.dumps(raw))
    rows = [("before", i.category) for i in db.validate().issues]
    db.repair()
    rows += [("after", i.category) for i in db.validate().issues]
    return spark.createDataFrame([*rows, ("rows", str(db.count("orders"))), ("next", str(db.next_id("orders")))], "state string, category string")


@_add("store_gate", f"SELECT (SELECT max(id) + 1 FROM ({_STORED})) AS id, 'FkBackingIndexMissing' AS backing, 'StorageReadOnly' AS strange, 'LockTimeout' AS locked")
def _gate(spark, sf):
    """Counters that were set back give out no id twice; a restriction without its index, a strange format and a held lock refuse."""
    import json

    db = _shop(spark, sf, on_delete="restrict")
    files, path = db.store.files, db.store.path
    raw = json.loads(files.read(path))
    raw["meta"]["orders"] |= {"rows": 1, "last_id": 2}
    raw["relations"][0]["backingIndex"] = "gone"
    files.replace(path, json.dumps(raw))
    id_ = db.insert("orders", {"customer": None, "status": "N", "total": 1.0})
    codes = {"backing": lambda: db.delete("customers", [Condition("code", "=", 7)])}
    got = {r["name"]: r["code"] for r in _codes(spark, codes).collect()}
    raw = json.loads(files.read(path))
    raw["format"]["roCompat"].append("new-thing")
    files.replace(path, json.dumps(raw))
    got |= {r["name"]: r["code"] for r in _codes(spark, {"strange": lambda: db.truncate("orders")}).collect()}
    other = Database.open(spark, db.store.root, lock_timeout=0.1)
    with db.store.lock:
        got |= {r["name"]: r["code"] for r in _codes(spark, {"locked": lambda: other.truncate("orders")}).collect()}
    return spark.createDataFrame([(id_, got["backing"], got["strange"], got["locked"])], "id long, backing string, strange string, locked string")


@_add("store_last_row", f"SELECT * FROM ({_STORED}) ORDER BY id DESC LIMIT 1")
def _last_row(spark, sf):
    db = _shop(spark, sf)
    row = db.last_row("orders")
    return spark.createDataFrame([tuple(row.values())], "id long, customer long, status string, total double")


@_add("store_old_snapshot", f"SELECT 'before' AS state, count(*) AS n, sum(id) AS ids FROM ({_STORED}) UNION ALL SELECT 'after', count(*), sum(id) FROM ({_STORED}) WHERE total <= 200000")
def _old_snapshot(spark, sf):
    """A frame keeps the rows that it began with while the table goes on."""
    db = _shop(spark, sf)
    before = db.table("orders").frame()
    db.delete("orders", [Condition("total", ">", 200000)])
    both = [x.agg(F.lit(state).alias("state"), F.count("*").alias("n"), F.sum("id").alias("ids")) for state, x in (("before", before), ("after", db.table("orders").frame()))]
    return both[0].unionByName(both[1])


@_add("store_cached_reads", f"SELECT 1 AS pass, count(*) AS n FROM ({_STORED}) WHERE status = 'O' UNION ALL SELECT 2, count(*) FROM ({_STORED}) WHERE status = 'O' UNION ALL SELECT 3, count(*) FROM ({_STORED}) WHERE status = 'O' AND total <= 100000")
def _cached(spark, sf):
    """The same answer from the cache, and a new one after a write."""
    from .cache import FrameCache

    plain = _shop(spark, sf)
    db = Database.open(spark, plain.store.root, cache=FrameCache())
    where = [Condition("status", "=", "O")]
    rows = [(1, db.count("orders", where)), (2, db.count("orders", where))]
    db.delete("orders", [Condition("total", ">", 100000)])
    rows.append((3, db.count("orders", where)))
    db.flush_cache()
    return spark.createDataFrame(rows, "pass int, n long")


@_add("store_facade", f"""
SELECT 'next_id' AS name, (SELECT max(id) + 1 FROM ({_STORED}))::VARCHAR AS value UNION ALL SELECT 'count', (SELECT count(*) FROM ({_STORED}))::VARCHAR
UNION ALL SELECT 'distinct', (SELECT count(DISTINCT status) FROM ({_STORED}))::VARCHAR UNION ALL SELECT 'exists', (SELECT CASE WHEN count(*) > 0 THEN 'True' ELSE 'False' END FROM ({_STORED}) WHERE total > 400000)
UNION ALL SELECT 'affected', (SELECT count(*) FROM ({_STORED}) WHERE status = 'F')::VARCHAR UNION ALL SELECT 'column', (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM (SELECT id FROM ({_STORED}) ORDER BY id LIMIT 5))
UNION ALL SELECT 'tables', 'customers,orders' UNION ALL SELECT 'columns', 'id,customer,status,total' UNION ALL SELECT 'diff', 'note;total;customer' UNION ALL SELECT 'relations', 'orders.customer>customers.code' UNION ALL SELECT 'comment', 'sales'
""")
def _facade(spark, sf):
    db = _shop(spark, sf)
    t = db.table("orders")
    db.set_table_comment("orders", "sales")
    diff = db.diff(TableSchema.create("orders", {"customer": "string|null", "status": "string", "note": "string"}))
    t.where("status", "=", "F").update({"status": "F"})
    rows = {
        "affected": t.affected_rows(), "next_id": t.next_id(), "count": t.count(), "distinct": t.distinct("status").count(), "exists": t.where("total", ">", 400000).exists(), "column": ",".join(map(str, t.order_by("id").limit(5).column("id"))),
        "tables": ",".join(sorted(db.table_names())), "columns": ",".join(db.column_names("orders")), "diff": f"{','.join(diff.added_columns)};{','.join(diff.dropped_columns)};{','.join(diff.changed_types)}",
        "relations": ",".join(f"{r.child}.{r.column}>{r.parent}.{r.references}" for r in db.relations("orders")), "comment": db.table_comment("orders"),
    }
    return spark.createDataFrame([(k, str(v)) for k, v in rows.items()], "name string, value string")


@_add("store_directory_findings", "SELECT 'found' AS state, * FROM (VALUES ('broken_record', '1'), ('record_key_order', '1'), ('meta_line_count_drift', ''), ('meta_orphan_entry', ''), ('orphan_index_file', '')) t(category, n) UNION ALL SELECT 'rows', 'orders', ((SELECT count(*) FROM orders) + 1)::VARCHAR")
def _directory_findings(spark, sf):
    """A directory with a broken line, a record in another order and stray files: what is found, and what is left when mended."""
    import json

    from .sources.directory import export_directory, import_directory, repair_directory, table_path, validate_directory
    from .sources.files import Files

    db, path = _shop(spark, sf), _folder(spark)
    export_directory(db, path)
    files = Files(spark, path)
    lines = spark.read.text(table_path(files, "orders")).unionByName(spark.createDataFrame([("oops",), ('{"status":"N","id":2,"customer":null,"total":1.5}',)], "value string").coalesce(1))
    lines.write.text(f"{path}/.new")  # parts in the file's order, the two lines last
    files.joined(f"{path}/.new", table_path(files, "orders"))
    files.delete(f"{path}/.new")
    meta = files.read_json(files.at("meta.json"))
    files.replace(files.at("meta.json"), json.dumps({**meta, "ghost": {}}))
    files.write(files.at("orders", "old.index.ndjson"), "")
    found = [i for i in validate_directory(spark, path).issues if i.category != "pk_duplicate"]
    repair_directory(spark, path)
    left = [i for i in validate_directory(spark, path).issues if i.category != "pk_duplicate"]
    other = Database.create(spark, _folder(spark))
    n = import_directory(other, path)["orders"]
    rows = [("found", i.category, str(i.context["count"]) if i.category in ("broken_record", "record_key_order") else "") for i in found] + [("left", i.category, "") for i in left]
    return spark.createDataFrame([*rows, ("rows", "orders", str(n))], "state string, category string, n string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest finished orders."""
    where = [Condition("o_orderstatus", "=", "F"), Condition("o_totalprice", ">", 100000)]
    return query.select(_table(spark, sf_dir, "orders"), where, order=[("o_totalprice", "desc")], tie=["o_orderkey"], limit=10)
