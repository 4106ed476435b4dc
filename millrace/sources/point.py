"""One row by its id without a Spark job: the driver reads the row group that holds it.

Only for tables of few files on a file system that the driver mounts; everything else goes through Spark.
"""

from __future__ import annotations

import pyarrow.dataset as ds

from ..functions import types as K
from ..plans.query import POS
from ..plans.schema import PK, TableSchema
from .store import Meta, Store

#: Files whose footers the driver reads at most.
MOST_FILES = 64


def serves(store: Store, schema: TableSchema, meta: Meta, zone: str) -> bool:
    """Whether rows can be read here: local files, few of them, and values that are shown as they are stored."""
    local = store.root.startswith("file:/") or store.root.startswith("/")
    shown = zone == "UTC" or not any(K.base_of(k) in K.INSTANTS for k in schema.columns.values())
    return local and shown and len(meta.parts) <= MOST_FILES


def row(store: Store, schema: TableSchema, meta: Meta, id_: int) -> dict | None:
    """The first row in physical order with the id, or None; statistics skip row groups that cannot hold it."""
    paths = [store.files.at(f) for f in store.all_files(meta)]
    if len(paths) > MOST_FILES:
        raise ValueError("too many files")
    if not paths:
        return None
    local = [p.removeprefix("file:").replace("//", "/", 1) if p.startswith("file:") else p for p in paths]
    found = ds.dataset(["/" + p.lstrip("/") for p in local], format="parquet").to_table(columns=[*schema.columns, POS], filter=ds.field(PK) == id_)
    rows = sorted(found.to_pylist(), key=lambda r: r[POS])
    return {c: rows[0][c] for c in schema.columns} if rows else None
