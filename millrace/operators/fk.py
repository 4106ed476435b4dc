"""Plans of writes that follow foreign keys: which rows go, which cells change, over the state before the statement."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RelationError, TableError
from ..functions import types as K
from ..plans.query import POS
from ..plans.schema import Relation, TableSchema
from .relational import cut_lineage, referring


class WritePlan:
    """Deleted rows and patched cells by table, grown breadth first until no relation asks for more.

    Restrictions look at the state before the statement.  A row is deleted once and a cell patched once, so cycles end.
    Row sets stay DataFrames of positions and of the columns that relations refer to; each round is checkpointed.
    """

    def __init__(self, schemas: dict[str, TableSchema], relations: tuple[Relation, ...], base: Callable[[str], DataFrame]):
        self.schemas, self.relations, self._base = schemas, relations, base
        self.frames: dict[str, DataFrame] = {}
        self.gone: dict[str, DataFrame] = {}
        self.cells: dict[tuple[str, str], DataFrame] = {}
        self.queue: deque = deque()

    def base(self, table: str) -> DataFrame:
        if table not in self.frames:
            self.frames[table] = self._base(table)
        return self.frames[table]

    def _fresh(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.join(self.gone[table], POS, "left_anti") if table in self.gone else rows

    def delete(self, table: str, rows: DataFrame) -> None:
        referred = sorted({r.references for r in self.relations if r.parent == table and r.references in rows.columns})
        rows = cut_lineage(self._fresh(table, rows).select(POS, *[F.col(f"`{c}`") for c in referred]))
        if rows.isEmpty():
            return
        pos = rows.select(POS)
        self.gone[table] = self.gone[table].unionByName(pos) if table in self.gone else pos
        self.queue.append(("delete", table, None, rows))

    def change(self, table: str, column: str, cells: DataFrame) -> None:
        """cells: POS, old, new."""
        cells = self._fresh(table, cells)
        if (table, column) in self.cells:
            cells = cells.join(self.cells[table, column].select(POS), POS, "left_anti")
        cells = cut_lineage(cells.where(~F.col("old").eqNullSafe(F.col("new"))))
        if cells.isEmpty():
            return
        known = self.cells.get((table, column))
        self.cells[table, column] = known.unionByName(cells) if known is not None else cells
        self.queue.append(("change", table, column, cells))

    def close(self) -> None:
        while self.queue:
            what, table, column, rows = self.queue.popleft()
            for r in self.relations:
                if r.parent != table:
                    continue
                if what == "delete" and r.on_delete != "noAction":
                    self._check(r)
                    self._deleted(r, rows)
                elif what == "change" and r.references == column and r.on_update != "noAction":
                    self._check(r)
                    self._changed(r, rows)

    def _check(self, r: Relation) -> None:
        for t, c in ((r.child, r.column), (r.parent, r.references)):
            if t not in self.schemas or c not in self.schemas[t].columns:
                raise RelationError("RelationColumnNotFound", table=t, column=c)
        child, parent = self.schemas[r.child].columns[r.column], self.schemas[r.parent].columns[r.references]
        if K.base_of(child) != K.base_of(parent) or ("setNull" in (r.on_delete, r.on_update) and not K.nullable(child)):
            raise RelationError("RelationNotExecutable", relation=str(r.key))

    def _check_backing(self, r: Relation) -> None:
        """A restriction is probed through the index that backs the relation, which must be there and led by its column."""
        if not any(i.name == r.backing_index and i.fields[0][0] == r.column for i in self.schemas[r.child].indexes):
            raise RelationError("FkBackingIndexMissing", child=r.child, column=r.column)

    def _deleted(self, r: Relation, rows: DataFrame) -> None:
        if r.on_delete == "restrict":
            self._check_backing(r)
        hit = referring(self.base(r.child), r.column, rows.select(r.references))
        if r.on_delete == "restrict":
            if not hit.limit(1).isEmpty():
                raise RelationError("ForeignKeyRestricted", table=r.parent, child=r.child, column=r.column)
        elif r.on_delete == "cascade":
            self.delete(r.child, hit)
        else:
            old = F.col(f"`{r.column}`")
            self.change(r.child, r.column, hit.select(POS, old.alias("old"), F.lit(None).cast(hit.schema[r.column].dataType).alias("new")))

    def _changed(self, r: Relation, cells: DataFrame) -> None:
        if r.on_update == "restrict":
            self._check_backing(r)
        pairs = cells.where("old IS NOT NULL").select(F.col("old").alias("__old"), F.col("new").alias("__new")).dropDuplicates(["__old"])
        child = self.base(r.child)
        hit = child.join(pairs, F.col(f"`{r.column}`") == F.col("__old"))
        if r.on_update == "restrict":
            if not hit.limit(1).isEmpty():
                raise RelationError("ForeignKeyRestricted", table=r.parent, child=r.child, column=r.column)
            return
        new = F.col("__new") if r.on_update == "cascade" else F.lit(None).cast(child.schema[r.column].dataType)
        self.change(r.child, r.column, hit.select(POS, F.col("__old").alias("old"), new.alias("new")))

    # ---------------------------------------------------------------------------------------- outcome

    def touched(self) -> list[str]:
        return sorted({*self.gone, *(t for t, _ in self.cells)})

    def positions(self, table: str) -> DataFrame:
        """Positions of all rows that go or change."""
        found = [self.gone[table]] if table in self.gone else []
        found += [cells.select(POS) for (t, _), cells in self.cells.items() if t == table]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out.distinct()

    def final(self, table: str, base: DataFrame | None = None) -> DataFrame:
        """Rows of the table, or of the part of it in `base`, after the statement, with `__changed`."""
        df = self._fresh(table, base if base is not None else self.base(table)).withColumn("__changed", F.lit(False))
        for (t, c), cells in self.cells.items():
            if t != table:
                continue
            df = df.join(cells.select(POS, F.col("new").alias("__new"), F.lit(True).alias("__hit")), POS, "left")
            value = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(f"`{c}`"))
            df = df.withColumn(c, value).withColumn("__changed", F.col("__changed") | F.coalesce("__hit", F.lit(False))).drop("__new", "__hit")
        return df

    def check_unique(self, table: str, df: DataFrame) -> None:
        """Changed rows must be unique in the state after; duplicates among untouched rows do not block."""
        for u in self.schemas[table].uniques:
            if any((table, f) in self.cells for f in u.fields):
                keyed = df
                for f in u.fields:
                    keyed = keyed.where(F.col(f"`{f}`").isNotNull())
                found = keyed.groupBy(*u.fields).agg(F.count("*").alias("n"), F.max("__changed").alias("c")).where("n > 1 AND c")
                if not found.limit(1).isEmpty():
                    raise TableError("UniqueViolation", table=table, name=u.name)
