"""The query builder: chained calls gather a query, a terminal call runs it and clears what was gathered."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .errors import QueryError
from .plans.predicate import Condition, Filter
from .plans.query import check_slice
from .plans.schema import PK


class Table:
    def __init__(self, db, name: str):
        self.db, self.name, self._affected = db, name, 0
        self._reset()

    def _reset(self) -> None:
        self._filter, self._order, self._distinct, self._limit, self._offset = Filter(), [], (), None, None

    def _run(self, work):
        try:
            return work()
        finally:
            self._reset()

    # ---------------------------------------------------------------------------------------- gathering

    def where(self, field: str, operator: str, value, negated: bool = False) -> Table:
        self._filter = self._filter.where(field, operator, value, negated)
        return self

    def condition(self, condition: Condition) -> Table:
        self._filter = self._filter.condition(condition)
        return self

    def set_filter(self, filter_: Filter) -> Table:
        """Replaces the conditions; later ones are added to it."""
        self._filter = filter_
        return self

    def order_by(self, field: str, direction: str = "asc") -> Table:
        if direction.lower() not in ("asc", "desc"):
            raise QueryError("InvalidSortDirection", direction=direction)
        self._order.append((field, direction))
        return self

    def limit(self, n: int) -> Table:
        check_slice(n, None)
        self._limit = n
        return self

    def offset(self, n: int) -> Table:
        check_slice(None, n)
        self._offset = n
        return self

    def distinct(self, *fields: str) -> Table:
        """The first row in result order of each combination of values."""
        self._distinct = fields
        return self

    # ---------------------------------------------------------------------------------------- reading

    def _frame(self, limit: int | None = None, project=None, ordered: bool = True) -> DataFrame:
        limit = self._limit if limit is None else limit if self._limit is None else min(limit, self._limit)
        return self.db.select(self.name, self._filter, self._order, self._distinct, limit, self._offset, project, ordered)

    def frame(self) -> DataFrame:
        """The query as a lazy DataFrame; without keys or a slice its rows are in no order."""
        return self._run(lambda: self._frame(ordered=False))

    def rows(self) -> list[dict]:
        return self._run(lambda: [r.asDict() for r in self._frame().collect()])

    def one(self) -> dict | None:
        def work():
            only = self._filter.conditions
            plain = not self._order and not self._distinct and not self._offset and self._limit != 0
            if plain and len(only) == 1 and only[0] == Condition(PK, "=", only[0].value) and type(only[0].value) is int:
                return self.db.by_id(self.name, only[0].value)
            got = self._frame(limit=1).collect()
            return got[0].asDict() if got else None

        return self._run(work)

    def column(self, field: str) -> list:
        return self._run(lambda: [r[0] for r in self._frame(project=[field]).collect()])

    def records(self) -> Iterator:
        """Objects of the registered class, fetched partition by partition."""
        mapped = self.db.records.of(self.name)
        df = self._run(self._frame)
        return (mapped.hydrate(r.asDict()) for r in df.toLocalIterator())

    def record(self):
        row = self.one()
        return None if row is None else self.db.records.of(self.name).hydrate(row)

    def count(self) -> int:
        """Matching rows, or distinct combinations among them; order and slice do not count."""

        def work():
            if self._order:
                known = self.db.schema(self.name).columns
                for f, _ in self._order:
                    if f not in known:
                        raise QueryError("QueryUnknownColumn", table=self.name, column=f)
            return self.db.count(self.name, self._filter, self._distinct)

        return self._run(work)

    def exists(self) -> bool:
        return self._run(lambda: self.db.row_exists(self.name, self._filter))

    # ---------------------------------------------------------------------------------------- writing

    def _counted(self, n: int) -> int:
        self._affected = n
        return n

    def insert(self, row) -> int:
        def work():
            values = row if isinstance(row, dict) else self.db.records.of(self.name).extract(row)
            out = self.db.insert(self.name, values)
            self._counted(1)
            return out

        return self._run(work)

    def update(self, patch: dict) -> int:
        return self._run(lambda: self._counted(self.db.update(self.name, self._filter, patch)))

    def update_by_id(self, id_: int, patch: dict) -> int:
        return self._run(lambda: self._counted(self.db.update(self.name, Filter().where(PK, "=", id_), patch)))

    def update_record(self, obj, missing: str = "WriteNull") -> int:
        """Writes an object over the row of its id.  Columns that its class lacks become null or, with KeepStored, stay."""

        def work():
            mapped = self.db.records.of(self.name)
            values = mapped.extract(obj)
            if missing == "WriteNull":
                values = {**{c: None for c in mapped.schema.columns if c != PK}, **values}
            id_ = values.pop(PK)
            return self._counted(self.db.update(self.name, Filter().where(PK, "=", id_), values))

        return self._run(work)

    def delete(self) -> int:
        return self._run(lambda: self._counted(self.db.delete(self.name, self._filter)))

    def delete_by_id(self, id_: int) -> int:
        return self._run(lambda: self._counted(self.db.delete(self.name, Filter().where(PK, "=", id_))))

    # ---------------------------------------------------------------------------------------- about the table

    def affected_rows(self) -> int:
        return self._affected

    def last_id(self) -> int:
        return self.db.last_id(self.name)

    def next_id(self) -> int:
        return self.db.next_id(self.name)

    def reorder_columns(self, order: list[str]) -> None:
        self.db.reorder_columns(self.name, order)

    def rebuild_index(self, index: str) -> None:
        self.db.rebuild_index(self.name, index)

    def rebuild_all_indexes(self) -> None:
        self.db.rebuild_all_indexes(self.name)

    def optimize(self) -> None:
        self.db.optimize(self.name)
