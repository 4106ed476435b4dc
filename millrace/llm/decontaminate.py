"""Operator 8 - benchmark decontamination by a prefix-filtered set join.

Every benchmark item yields windows of eight consecutive words (shorter items one window).  A window's shingles are its
word pairs (a single word for one-word windows), ordered by how many different windows of the whole benchmark hold them.
Exact containment needs all of them, so the rarest alone is the necessary prefix: a document can hold a window only where it
holds that shingle.  Documents give up the places of their shingles that may be prefixes, each with the words around it;
these are joined with the windows on the shingle.  The shingle's place in the window bounds where the window starts and the
window's length where it ends, and the bytes of the candidate span are then compared with the window's.

The benchmark is a table from beginning to end.  What travels to all tasks is a bitmap of the prefixes, of at most
2**MAX_BITS bits whatever the benchmark's size: a false positive of it costs one row in the join.  Windows are broadcast
while there are at most BROADCAST_WINDOWS of them; beyond, both sides are exchanged by shingle and Spark splits hot ones.

Defined results: null, empty and word-free texts have no words and no hits; very long texts are read whole; equal items count
as items of their own; an item_id that repeats with several texts counts once; items without an id mark words as hit, count
as one item together and add nothing to the joined ids; an empty benchmark hits nothing; repeated document rows get rows of
their own; no documents give no rows.  A kept column that bears the name of one of the results is left out; all other
columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BASE, U64, binary_parts, bites, by_salt, checkpointed, index_ranges, lower_ascii, mix, prefix_sums, runs, salt_mask, salted, span_hash, table, word_spans

WINDOW = 8
SLICE_BYTES = 1 << 20
#: Windows and candidates are made in batches of this many rows.
BATCH_ROWS = 50_000
MAX_BITS = 27
BROADCAST_WINDOWS = 50_000
BROADCAST_DOCS = 200_000
RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix((h[:-1] * U64(0x9E3779B97F4A7C15)) ^ (h[1:] + U64(0x632BE59BD9B4E019)))


def _spaced(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words, each followed by a space, and where each begins (with the end of all)."""
    at = np.concatenate([[0], np.cumsum(e - s + 1)])
    text = np.append(low, np.uint8(0x20))[index_ranges(s, e - s + 1)]
    text[at[1:] - 1] = 0x20
    return text.tobytes(), at


# ------------------------------------------------------------------------------------------------ the benchmark


def windows(items: DataFrame) -> DataFrame:
    """One row per item and window: item, win (its words joined by spaces), n, shingles in order."""

    def run(batches):
        for batch in bites(batches, 1, SLICE_BYTES):
            raw, off = binary_parts(batch.column(1))
            low = lower_ascii(raw)
            s, e, first = word_spans(low, off)
            if not len(s):
                continue
            h = span_hash(prefix_sums(low, 7, BASE), s, e, BASE)
            pairs = _pairs(h)
            text, at = _spaced(low, s, e)
            for k in range(len(off) - 1):
                a, b = int(first[k]), int(first[k + 1])
                n = min(WINDOW, b - a)
                for i in range(a, b - n + 1 if n else a, BATCH_ROWS):
                    starts = np.arange(i, min(i + BATCH_ROWS, b - n + 1))
                    held = [text[x:y] for x, y in zip(at[starts].tolist(), (at[starts + n] - 1).tolist())]
                    own = h[starts][:, None] if n == 1 else pairs[starts[:, None] + np.arange(n - 1)[None, :]]
                    shingles = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), pa.array(own.ravel().view(np.int64)))
                    item = pa.array([batch.column(0)[k].as_py()] * len(starts), pa.string())
                    yield pa.RecordBatch.from_arrays([item, pa.array(held, pa.binary()), pa.array(np.full(len(starts), n, np.int32)), shingles], ["item", "win", "n", "shingles"])

    source = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "item string, win binary, n int, shingles array<long>")


def prefixed(made: DataFrame) -> DataFrame:
    """key, win, n, offset of each different window: its rarest shingle and where it stands in the window."""
    one = made.groupBy("win").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    placed = checkpointed(salted(one.select("win", "n", F.posexplode("shingles").alias("offset", "key")), "win"))
    held = by_salt(placed.groupBy("key").agg(F.countDistinct("win").alias("held"), salt_mask()))
    least = F.min(F.struct("held", "offset", "key")).alias("x")
    return checkpointed(placed.join(held, ["key", "__salt"]).groupBy("win", "n").agg(least).select("x.key", "win", "n", "x.offset"))


def bitmap(keys: DataFrame, n_keys: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits of two hashes of every key, as 64-bit words; at most 2**max_bits bits come to the driver."""
    bits = min(max_bits, max(16, int(64 * max(1, n_keys) - 1).bit_length()))
    top, low = F.shiftrightunsigned(F.col("key"), 64 - bits), F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    at = keys.select(F.explode(F.array(top, low)).alias("at"))
    word = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    got = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(U64)
    return out


def _held(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(len(mask) * 64 - 1).bit_length()
    out = np.ones(len(keys), bool)
    for at in (keys >> U64(64 - bits), keys & U64((1 << bits) - 1)):
        out &= (mask[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
    return out


# ------------------------------------------------------------------------------------------------ documents


def identity(docs: DataFrame, text: str) -> tuple[Column, Column]:
    """128 bits of a row's text and doc_id; rows that are equal in both share their result."""
    parts = [F.col(f"`{c}`") for c in ("doc_id", text) if c in docs.columns]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def candidates(docs: DataFrame, keep: list[str], text: str, mask: np.ndarray) -> DataFrame:
    """A row (kept, k1, k2, n_words) for each document, and rows (k1, k2, key, at, around, begins) for its places.

    `around` holds the words from which a window with that shingle can be made, joined by spaces; begins[o] is where the
    word o before the shingle stands in it.
    """
    k1, k2 = identity(docs, text)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<x:int>")
    source = docs.select(kept.alias("kept"), k1.alias("k1"), k2.alias("k2"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = T.StructType([
        T.StructField("kept", source.schema["kept"].dataType), *source.schema.fields[1:3], T.StructField("n_words", T.LongType()), T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType()),
        T.StructField("around", T.BinaryType()), T.StructField("begins", T.ArrayType(T.IntegerType())),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in bites(batches, 3):
            raw, off = binary_parts(batch.column(3))
            for i, j in runs(off, SLICE_BYTES):
                low, o = lower_ascii(raw[off[i] : off[j]]), off[i : j + 1] - off[i]
                s, e, first = word_spans(low, o)
                part, n = batch.slice(i, j - i), j - i
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(first[1:] - first[:-1]), *(pa.nulls(n, arrow.field(c).type) for c in range(4, 8))], schema=arrow)
                if not len(s):
                    continue
                h = span_hash(prefix_sums(low, 7, BASE), s, e, BASE)
                pairs, spaced = _pairs(h), _spaced(low, s, e)
                inside = np.ones(len(pairs), bool)
                cuts = first[1:-1]
                inside[cuts[(cuts > 0) & (cuts < len(h))] - 1] = False
                for keys, reach, ok in ((h, 0, None), (pairs, WINDOW - 2, inside)):
                    at = np.flatnonzero(_held(mask, keys) if ok is None else _held(mask, keys) & ok)
                    for a in range(0, len(at), BATCH_ROWS):
                        yield _places(part, *spaced, first, at[a : a + BATCH_ROWS], keys, reach, arrow)

    return source.mapInArrow(run, schema)


def _places(part: pa.RecordBatch, text: bytes, where: np.ndarray, first: np.ndarray, at: np.ndarray, keys: np.ndarray, reach: int, arrow: pa.Schema) -> pa.RecordBatch:
    doc = np.searchsorted(first, at, side="right") - 1
    begin = np.maximum(first[doc], at - reach)
    end = np.minimum(first[doc + 1], at + (reach + 2 if reach else 1))
    around = [text[a:b] for a, b in zip(where[begin].tolist(), (where[end] - 1).tolist())]
    n = at - begin + 1
    cuts = np.concatenate([[0], np.cumsum(n)])
    begins = where[np.repeat(at, n) - index_ranges(np.zeros(len(n), np.int64), n)] - np.repeat(where[begin], n)
    owner = pa.array(doc)
    lists = pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(begins.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(at), arrow.field(0).type), part.column(1).take(owner), part.column(2).take(owner), pa.nulls(len(at), pa.int64()),
            pa.array(keys[at].view(np.int64)), pa.array((at - first[doc]).astype(np.int32)), pa.array(around, pa.binary()), lists,
        ],
        schema=arrow,
    )


def hits(found: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """k1, k2, begin, n, win of every verified occurrence."""
    keys = F.broadcast(keys) if n_keys <= BROADCAST_WINDOWS else keys.hint("merge")  # sizes seen before windows are made mislead
    both = found.where("at IS NOT NULL").select("k1", "k2", "key", "at", "around", "begins").join(keys, "key")
    start, size = F.get("begins", F.col("offset")), F.octet_length("win")
    same = F.substr("around", start + 1, size) == F.col("win")
    after = F.substr("around", start + size + 1, F.lit(1))
    ends = (F.octet_length("around") == start + size) | (after == F.lit(b" "))
    # the shingle's place bounds the start (begins has no such entry before the document), the window's length the end
    return both.where((F.col("offset") < F.size("begins")) & same & ends).select("k1", "k2", (F.col("at") - F.col("offset")).alias("begin"), "n", "win")


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (begin, n) spans."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        end = x["begin"] + x["n"]
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["sum"] + F.greatest(F.lit(0), end - F.greatest(acc["upto"], x["begin"]))).alias("sum"))

    return F.aggregate(spans, start, step, lambda acc: acc["sum"])


def by_document(hit: DataFrame, made: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, n_hit) and (k1, k2, n_items, items_sha256) of the documents with hits."""
    hit = checkpointed(hit)
    words = hit.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("begin", "n"))).alias("spans")).select("k1", "k2", _covered(F.col("spans")).alias("n_hit"))
    owners = made.select("win", "item").distinct()
    owners = owners if n_keys <= BROADCAST_WINDOWS else owners.hint("merge")
    named = hit.select("k1", "k2", "win").distinct().join(owners, "win").select("k1", "k2", "item").distinct()
    ids = F.sort_array(F.collect_list("item"))  # items without an id are left out here and counted
    return words, named.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", below: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """Columns `keep` of every document with n_words, n_hit, n_items, items_sha256 and contaminated.

    With `below`, the documents that hold windows of fewer items than that, in the columns `keep` alone.
    """
    made = checkpointed(windows(items))
    keys = prefixed(made)
    n_keys = keys.count()
    mask = bitmap(keys, n_keys, max_bits)
    own = [] if below is not None else [c for c in keep if c not in RESULT]
    found = checkpointed(candidates(docs, own, text, mask))
    words, named = by_document(hits(found, keys, n_keys), made, n_keys)
    if below is not None:
        k1, k2 = identity(docs, text)
        bad = checkpointed(named.where(F.col("n_items") >= below).select("k1", "k2"))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), k1.alias("k1"), k2.alias("k2"))
        rows = rows.join(F.broadcast(bad) if bad.count() <= BROADCAST_DOCS else bad, ["k1", "k2"], "left_anti")
        return rows.select(*[F.col("kept").getField(c).alias(c) for c in keep])
    per_doc = words.join(named, ["k1", "k2"])
    rows = found.where("at IS NULL").select("kept", "k1", "k2", "n_words").join(per_doc, ["k1", "k2"], "left")
    n_items, none = F.coalesce("n_items", F.lit(0).cast("long")), F.sha2(F.lit("").cast("binary"), 256)
    return rows.select(
        *[F.col("kept").getField(c).alias(c) for c in own], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (n_items >= 2).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
