"""Shared pieces: table reading, shared-folder checkpoints and vectorised byte kernels."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


class _Local(dict):
    """Tables that each process makes for itself; empty wherever it is sent."""

    def __reduce__(self):
        return _Local, ()


_CACHE = _Local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local_folder(spark: SparkSession) -> str:
    """A temporary folder, for sessions that name no shared one; refused where executors run on other machines."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return _CACHE.setdefault("folder", tempfile.mkdtemp(prefix="millrace-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that `spark.checkpoint.dir` names.

    Only where the session names none and runs in one process (tests) is a temporary folder set up.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_local_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none (local tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark)


#: Rows of one key are dealt to this many salts before they meet what is known of the key.
SALTS = 16


def salted(df: DataFrame, *by: str) -> DataFrame:
    """Adds __salt, a hash of the columns that tell the rows of a key apart."""
    return df.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def salt_mask() -> Column:
    """Aggregate: the salts that a group's rows have, as bits."""
    return F.bit_or(F.expr("shiftleft(1, __salt)")).alias("__mask")


def by_salt(groups: DataFrame) -> DataFrame:
    """A row for each salt that a group has, never more than the group has rows, to be joined by key and salt."""
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("__mask"), i) == 1)
    return groups.withColumn("__salt", F.explode(held)).drop("__mask")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


# --------------------------------------------------------------------------------------------- byte kernels


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary array without a copy; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type):
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)
    else:
        off = np.frombuffer(col.buffers()[1], dtype=np.int32).astype(np.int64)
    off = off[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Splits rows into slices of at most `limit` bytes (a longer row stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def with_text(df: DataFrame, keep: list[str], text: str = "text") -> tuple[DataFrame, int]:
    """Columns `keep` of df and where the text stands among them; it is added as bytes only where it is not kept."""
    columns = [F.col(f"`{c}`") for c in keep]
    if text in keep:
        return df.select(*columns), keep.index(text)
    name = "__text"
    while name in keep:
        name += "_"
    return df.select(*columns, F.col(f"`{text}`").cast("binary").alias(name)), len(keep)


def unless(keep: list[str], added: list[str]) -> list[str]:
    """Kept columns, less those that bear the name of a result, whatever its case: the result takes their place."""
    names = {c.lower() for c in added}
    return [c for c in keep if c.lower() not in names]


def bites(batches, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of a binary column (a longer value stands alone), without copies.

    Spark's batches hold up to 64 MB; what is made of them a piece at a time needs memory for the piece only.
    """
    for batch in batches:
        _, off = binary_parts(batch.column(column))
        for i, j in runs(off, limit):
            yield batch.slice(i, j - i)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker and grown on demand."""
    got = _CACHE.get(("pow", base))
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        arr = np.full(size, base, U64)
        arr[0] = 1
        got = np.multiply.accumulate(arr)
        _CACHE[("pow", base)] = got
    return got


def byte_table(seed: int) -> np.ndarray:
    got = _CACHE.get(("tab", seed))
    if got is None:
        got = np.random.RandomState(seed).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        _CACHE[("tab", seed)] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit hash."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BASE2 = 0xD6E8FEB86659FD93 | 1


def prefix_sums(buf: np.ndarray, seed: int, base: int) -> np.ndarray:
    """P with P[e] - P[s] = sum of T[byte j] * base**j over s <= j < e."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(byte_table(seed)[buf] * powers(len(buf) + 1, base)[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, s: np.ndarray, e: np.ndarray, base: int) -> np.ndarray:
    """Position-independent hash of byte spans [s, e)."""
    n = len(pre)
    lift = powers(n + 1, base)
    # multiplying by base**(n - s) makes equal strings equal wherever they stand; n differs between buffers,
    # so the inverse power of the buffer length brings it back to base**(-s)
    inv = U64(pow(pow(base, n, 1 << 64), -1, 1 << 64))
    return mix((pre[e] - pre[s]) * lift[n - s] * inv + (e - s).astype(U64))


_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_spans(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of lower-cased documents, none across documents.

    Returns (starts, ends, first word index of each document and the total).
    """
    if len(low) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = _WORD[low]
    before = np.empty_like(w)
    before[0] = False
    before[1:] = w[:-1]
    inside = off[:-1][off[:-1] < len(low)]
    before[inside] = False
    after = np.empty_like(w)
    after[-1] = False
    after[:-1] = w[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(w & ~before)
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(low, 7, BASE), starts, ends, BASE)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive word hashes from each position (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc = np.zeros(n, U64)
    for j in range(k):
        acc = (acc + h[j : j + n]) * U64(BASE2)
        acc ^= acc >> U64(29)
    return mix(acc + U64(k))


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (len(x) - w + 1 of them), by doubling."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    out = x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n]) if have < w else out[:n]


def index_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of range(s, s + n)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)
