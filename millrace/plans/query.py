"""Single-table queries as DataFrame plans: filter, order, first row of each distinct key, slice, project."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import types as K
from ..operators.relational import cut_lineage
from .predicate import Condition, Filter, conjunction

#: Physical order of stored rows; the last key of every ordering.
POS = "__pos"


def column_types(df: DataFrame) -> dict[str, str]:
    """Declared types for a DataFrame that no catalog describes."""
    return {f.name: K.from_spark(f.dataType, f.nullable) for f in df.schema.fields if f.name != POS}


def checked_order(order: Iterable[tuple[str, str] | str], columns: dict[str, str], table: str = "") -> list[tuple[str, bool]]:
    """(column, descending) of each key."""
    out = []
    for key in order:
        name, direction = (key, "asc") if isinstance(key, str) else key
        if direction.lower() not in ("asc", "desc"):
            raise QueryError("InvalidSortDirection", direction=direction)
        if name not in columns:
            raise QueryError("QueryUnknownColumn", table=table, column=name)
        out.append((name, direction.lower() == "desc"))
    return out


def sort_keys(order: list[tuple[str, bool]], columns: dict[str, str], tie: Sequence[str], collation: str | None = None) -> list[Column]:
    """Null is the smallest value; ties keep physical order whatever the direction."""
    out = []
    for name, down in order:
        x = F.col(f"`{name}`")
        if collation and K.base_of(columns[name]) == "string":
            x = F.collate(x, collation)
        out.append(x.desc_nulls_last() if down else x.asc_nulls_first())
    return out + [F.col(f"`{t}`").asc_nulls_first() for t in tie]


def distinct_keys(fields: Sequence[str], columns: dict[str, str]) -> list[Column]:
    """Grouping would fold -0.0 into 0.0; the text of a float tells them apart."""
    keys = []
    for f in fields:
        keys.append(F.col(f"`{f}`"))
        if K.base_of(columns[f]) == "float":
            keys.append(F.col(f"`{f}`").cast("string"))
    return keys


def check_slice(limit: int | None, offset: int | None) -> None:
    if limit is not None and limit < 0:
        raise QueryError("InvalidLimit", limit=limit)
    if offset is not None and offset < 0:
        raise QueryError("InvalidOffset", offset=offset)


def select(
    df: DataFrame, where: Filter | Iterable[Condition] = (), order: Iterable = (), distinct: Sequence[str] = (), limit: int | None = None,
    offset: int | None = None, project: Sequence[str] | None = None, columns: dict[str, str] | None = None, tie: Sequence[str] | None = None,
    zone: str = "UTC", table: str = "", collation: str | None = None, ordered: bool = False,
) -> DataFrame:
    """The query pipeline.  `tie` names the columns that stand for physical order (default: POS where there is one).

    Without keys or a slice the rows come as the scan has them, unless `ordered` asks for physical order."""
    columns = columns or column_types(df)
    conditions = where.conditions if isinstance(where, Filter) else tuple(where)
    check_slice(limit, offset)
    keys = checked_order(order, columns, table)
    for f in [*distinct, *(project or ())]:
        if f not in columns:
            raise QueryError("QueryUnknownColumn", table=table, column=f)
    predicate = conjunction(conditions, columns, zone, table, collation)
    tie = list(tie) if tie is not None else [POS] if POS in df.columns else []
    if predicate is not None:
        df = df.where(predicate)
    by = sort_keys(keys, columns, tie, collation)
    if distinct:
        window = Window.partitionBy(*distinct_keys(distinct, columns)).orderBy(*(by or [F.lit(0)]))
        df = df.withColumn("__first", F.row_number().over(window)).where("__first = 1").drop("__first")
    # a slice needs the physical order even where none is asked for
    if keys or ((ordered or limit is not None or offset or distinct) and tie):
        df = df.orderBy(*by)
    if offset and limit is None and by:
        df = skipped(df, offset)
    elif offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*[K.present(F.col(f"`{c}`"), columns[c], zone).alias(c) for c in (project if project is not None else columns)])


def skipped(df: DataFrame, offset: int) -> DataFrame:
    """A sorted frame without its first rows, in as many partitions as it has.

    The sort is checkpointed, so that partitions stay what they are; one count for each tells where the first row lies.
    """
    df = cut_lineage(df.withColumn("__at", F.lit(0)))  # a column of its own keeps frames without columns apart
    sizes = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    left = offset
    for p in sorted(sizes):
        if left < sizes[p]:
            # row k of partition p is numbered p * 2**33 + k
            return df.withColumn("__at", F.monotonically_increasing_id()).where(F.col("__at") >= (p << 33) + left).drop("__at")
        left -= sizes[p]
    return df.limit(0).drop("__at")


def count(df: DataFrame, where: Filter | Iterable[Condition] = (), distinct: Sequence[str] = (), columns: dict[str, str] | None = None, zone: str = "UTC", table: str = "", collation: str | None = None) -> DataFrame:
    """One row `n`: matching rows, or distinct keys among them (a key of nulls counts)."""
    columns = columns or column_types(df)
    for f in distinct:
        if f not in columns:
            raise QueryError("QueryUnknownColumn", table=table, column=f)
    conditions = where.conditions if isinstance(where, Filter) else tuple(where)
    predicate = conjunction(conditions, columns, zone, table, collation)
    if predicate is not None:
        df = df.where(predicate)
    if distinct:
        df = df.select(*[k.alias(f"k{i}") for i, k in enumerate(distinct_keys(distinct, columns))]).distinct()
    return df.agg(F.count("*").alias("n"))


def exists(df: DataFrame, where: Filter | Iterable[Condition] = (), **options) -> bool:
    """Whether a row matches; stops at the first."""
    return not select(df, where, limit=1, tie=(), **options).isEmpty()
