"""Caches of table snapshots.  Keys are (root, table, version), so an entry never answers for a later state.

A cache that fails is a cache that misses: errors degrade to reading the files.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from typing import Protocol

from pyspark.sql import DataFrame


class Cache(Protocol):
    def get(self, key: tuple) -> DataFrame | None: ...

    def set(self, key: tuple, df: DataFrame) -> None: ...

    def invalidate(self, prefix: tuple) -> None: ...


class NullCache:
    def get(self, key: tuple) -> None:
        return None

    def set(self, key: tuple, df: DataFrame) -> None:
        pass

    def invalidate(self, prefix: tuple) -> None:
        pass


class FrameCache:
    """Persists DataFrames on the executors; the oldest go first beyond `max_entries`, and all after `ttl` seconds."""

    def __init__(self, ttl: float = 0, max_entries: int = 100):
        self.ttl, self.max_entries = ttl, max_entries
        self.entries: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: tuple) -> DataFrame | None:
        found = self.entries.get(key)
        if found is None:
            return None
        if self.ttl and time.monotonic() - found[0] > self.ttl:
            self._drop(key)
            return None
        return found[1]

    def set(self, key: tuple, df: DataFrame) -> None:
        for stale in [k for k in self.entries if k[:2] == key[:2]]:
            self._drop(stale)
        self.entries[key] = (time.monotonic(), df.persist())
        while self.max_entries and len(self.entries) > self.max_entries:
            self._drop(next(iter(self.entries)))

    def invalidate(self, prefix: tuple) -> None:
        for k in [k for k in self.entries if k[: len(prefix)] == prefix]:
            self._drop(k)

    def _drop(self, key: tuple) -> None:
        self.entries.pop(key)[1].unpersist()
