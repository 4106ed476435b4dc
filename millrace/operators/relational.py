"""Relational probes on DataFrames: duplicates, orphans, references and closures along foreign keys."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IoError

_TEMP: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's `spark.checkpoint.dir`; a temporary folder only where none is set."""
    spark: SparkSession = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(temporary(spark))
    return df.checkpoint(eager=True)


def temporary(spark: SparkSession) -> str:
    """A folder of this machine, for sessions that run in one process; refused where executors run elsewhere."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise IoError("SharedFolderMissing", master=master)
    _TEMP.append(tempfile.mkdtemp(prefix="millrace-"))
    return _TEMP[-1]


def duplicates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keys without nulls that occur more than once, with their `count`.

    The count is a partial sum, so a key that holds a large share of the rows costs no task more than any other.
    """
    for f in fields:
        df = df.where(F.col(f"`{f}`").isNotNull())
    return df.groupBy(*fields).agg(F.count("*").alias("count")).where("count > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, references: str) -> DataFrame:
    """Rows of `child` whose key is not null and has no parent."""
    keys = parent.select(F.col(f"`{references}`").alias("__key")).where("__key IS NOT NULL")
    return child.where(F.col(f"`{column}`").isNotNull()).join(keys, F.col(f"`{column}`") == F.col("__key"), "left_anti")


def referring(child: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of `child` whose `column` is among the values of the one column of `keys`."""
    keys = keys.toDF("__key").where("__key IS NOT NULL")
    return child.join(keys, F.col(f"`{column}`") == F.col("__key"), "left_semi")


@dataclass(frozen=True)
class Edge:
    parent: str
    child: str
    column: str
    references: str


def closure(tables: dict[str, DataFrame], ids: dict[str, Sequence[str]], edges: Sequence[Edge], roots: dict[str, DataFrame], cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> dict[str, DataFrame]:
    """All rows that cascade from `roots` along `edges`, by the row keys `ids` of each table.

    Semi-naive: each round follows only the rows of the round before, less those reached already, so cycles end.  Where
    the edges form no cycle the order of tables settles every table in one pass and nothing is checkpointed.
    """
    order = _topological(edges, roots)
    if order is not None:
        reached = dict(roots)
        for t in order:
            found = [reached[t]] if t in reached else []
            found += [referring(tables[t], e.column, reached[e.parent].select(e.references)) for e in edges if e.child == t and e.parent in reached]
            if found:
                out = found[0]
                for x in found[1:]:
                    out = out.unionByName(x)
                reached[t] = out.dropDuplicates(list(ids[t])) if len(found) > 1 else out
        return reached
    reached, frontier = dict(roots), dict(roots)
    while frontier:
        found: dict[str, DataFrame] = {}
        for e in edges:
            if e.parent in frontier:
                hit = referring(tables[e.child], e.column, frontier[e.parent].select(e.references))
                found[e.child] = found[e.child].unionByName(hit) if e.child in found else hit
        frontier = {}
        for t, hit in found.items():
            hit = hit.dropDuplicates(list(ids[t]))
            if t in reached:
                hit = hit.join(reached[t].select(*ids[t]), list(ids[t]), "left_anti")
            hit = cut(hit)
            if not hit.isEmpty():
                frontier[t] = hit
                reached[t] = reached[t].unionByName(hit) if t in reached else hit
    return reached


def _topological(edges: Sequence[Edge], roots: dict[str, DataFrame]) -> list[str] | None:
    names = {*roots, *(e.parent for e in edges), *(e.child for e in edges)}
    waiting = {n: {e.parent for e in edges if e.child == n} for n in names}
    out: list[str] = []
    while waiting:
        free = sorted(n for n, parents in waiting.items() if not parents - set(out))
        if not free:
            return None
        out += free
        for n in free:
            del waiting[n]
    return out


def set_null(child: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """`child` with `column` null wherever it refers to one of `keys`."""
    marked = keys.toDF("__key").where("__key IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    joined = child.join(marked, F.col(f"`{column}`") == F.col("__key"), "left")
    value = F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(f"`{column}`"))
    return joined.select(*[value.alias(c) if c == column else F.col(f"`{c}`") for c in child.columns])


def patched(df: DataFrame, predicate: Column | None, values: dict[str, object]) -> DataFrame:
    """`df` with the values written where the predicate holds."""
    hit = predicate if predicate is not None else F.lit(True)
    return df.select(*[F.when(hit, F.lit(values[c]).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])


def without(df: DataFrame, predicate: Column | None) -> DataFrame:
    """Rows that a delete keeps: the exact complement, rows on which the predicate is null included."""
    return df.limit(0) if predicate is None else df.where(~F.coalesce(predicate, F.lit(False)))
