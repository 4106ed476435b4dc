"""Appends from a stream: each micro-batch becomes one part of a table, with ids of its own.

The manifest keeps the last batch of every stream for each table, written by the commit that shows the batch, so that a batch
that is delivered again after a failure is taken once.  A stream is known by the id in its checkpoint: two streams into one
table, or one begun anew with another checkpoint, never stand in each other's way.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..database import Database
from ..plans.query import POS
from ..plans.schema import PK
from ..sources.files import Files


def append_stream(db: Database, table: str, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that appends the stream's rows, which lack ids, to a table."""
    known: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        if not known:
            known.append(query_id(db, checkpoint))
        append_batch(db, table, batch, number, known[0])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def query_id(db: Database, checkpoint: str) -> str:
    """The id that the engine gave a stream when it made its checkpoint."""
    files = Files(db.spark, checkpoint)
    return json.loads(files.read(files.at("metadata")))["id"]


def append_batch(db: Database, table: str, batch: DataFrame, number: int, stream: str = "batches") -> int:
    """Rows appended: none where the manifest has this batch of the stream, or a later one, already.

    The batch is computed once, into a staged part; its rows are numbered from there, file by file.
    """
    with db.store.lock:
        old = db.snapshot()
        schema, new, meta = db.store.schema(old, table), old.copy(), db._meta(old, table)
        if number <= meta.streams.get(stream, -1):
            return 0
        stage = db.store.files.at(f"_stage-{db.store.new_name()}")
        try:
            batch.select(*[c for c in batch.columns if c in schema.columns and c != PK]).withColumn(PK, F.lit(1).cast("long")).write.parquet(stage)
            rows = db.spark.read.parquet(stage)
            checked = db._checked_frame(schema, rows)
            placed = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
            sizes = [(r["__file"], r["n"]) for r in placed.groupBy("__file").agg(F.count("*").alias("n")).orderBy("__file").collect()]  # one row a file
            upto, starts = 0, []
            for name, n in sizes:
                starts.append((name, upto))
                upto += n
            known = dict(zip(schema.columns, db._encoded_columns(schema, rows.columns)))
            begun = db.spark.createDataFrame(starts, "__file string, __start long")
            placed = placed.join(F.broadcast(begun), "__file").withColumn("__k", F.col("__start") + F.col("__row"))
            ids = (F.col("__k") + meta.last_id + 1).alias(PK)
            final = placed.select(*[ids if c == PK else known[c].alias(c) for c in schema.columns], (F.col("__k") + meta.next_pos).alias(POS))
            parts = [db.store.write(final, new, table)] if upto else []
        finally:
            db.store.files.delete(stage)
        new.meta[table] = replace(
            meta, parts=[*meta.parts, *parts], rows=meta.rows + upto, last_id=meta.last_id + upto, next_pos=meta.next_pos + upto, streams={**meta.streams, stream: number},
        )
        db.store.commit(new, old)
        return upto
