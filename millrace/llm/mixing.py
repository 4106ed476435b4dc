"""Operator 7 - mixing sources to target weights.

Words are packed, source by source in order of a hash of doc_id and then of doc_id, into blocks of a fixed length.  Target weights become a number of
block slots per source; every output shard draws its source counts from a multinomial over what is left to place.  Slot
k of a source maps to block perm(k mod blocks) in epoch k div blocks, where perm is a keyed Feistel permutation of the
source's block indices, and slots join the blocks by index.  A source's slots never exceed three times its blocks and an
epoch uses each block once, so no document is taken more than three times.

Defined results: null or empty texts have size 0 and take 0 words; null is a source of its own and sorts last; very long texts
fill many blocks, each of which is drawn for itself; rows that tie in doc_id and size take each other's place at will; repeated
rows are packed one after another; an empty table, or one without words, gives rows that take nothing, or none; reruns agree as
everything is keyed by a seed.  `mix_digest` reads doc_id, source and text alone; `mixed_texts` passes other columns through,
whatever their names.

Sources may be as many as documents: their figures are a table.  Multinomial draws come in two steps where sources are many,
among buckets of sources on the driver and among a bucket's sources in a task, which is the same draw taken apart.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, binary_parts, bites, by_salt, checkpointed, index_ranges, mix, runs, salt_mask, salted, table, with_text

MAX_REPEATS = 3


#: Sources that are drawn among in one task, and buckets of sources on the driver at least and at most.
BUCKET_SOURCES, LEAST_BUCKETS, MOST_BUCKETS = 10_000, 1_024, 65_536
BROADCAST_SOURCES = 50_000
#: Slots that a row stands for before they are spelled out, and that a batch holds.
RANGE_SLOTS = 1 << 16


def with_targets(sums: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds source_ix (by code point, null last) and target, the words wanted: weights 1, 2, 3, 1, ..., capped and reshared.

    `sums` has __source and source_size.  A unit of weight is worth what is left beside the capped sources; it only grows
    from round to round, so that a capped source stays capped, until no other is.
    """
    df = numbered(sums, [F.col("__source").asc_nulls_last()], "source_ix")
    df = checkpointed(df.withColumn("__weight", (F.col("source_ix") % 3 + 1).cast("double")))
    most = F.lit(float(repeats)) * F.col("source_size")
    unit, n_over = 0.0, -1
    while True:
        over = F.lit(unit) * F.col("__weight") > most
        got = df.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(over, most).otherwise(0.0)).alias("capped"), F.sum(F.when(~over, F.col("__weight"))).alias("weight"), F.count_if(over).alias("n"),
        ).first()
        if got["n"] == n_over or not got["all"] or not got["weight"]:
            return df.withColumn("target", F.when(over, most).otherwise(F.lit(unit) * F.col("__weight"))).drop("__weight")
        unit, n_over = (float(got["all"]) - got["capped"]) / got["weight"], got["n"]


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in order: sorted partitions are counted, then numbered, none of them seen as a whole."""
    df = checkpointed(df.orderBy(*order)).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    starts = df.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return df.join(F.broadcast(starts), "__p").withColumn(name, F.col("__start") + F.col("__k")).drop("__p", "__k", "__start")


def even(total: int, n: int) -> list[int]:
    """n sizes as equal as can be, the smaller ones first."""
    out = []
    for m in range(n):
        out.append((total - sum(out)) // (n - m))
    return out


def draws(wanted: np.ndarray, takes: list[int], rng: np.random.Generator) -> np.ndarray:
    """Slots of each source (columns) in each output shard (rows): multinomial draws of `takes` from what is left."""
    rest = np.asarray(wanted, np.int64)
    out = np.zeros((len(takes), len(rest)), np.int64)
    for m, take in enumerate(takes):
        if m == len(takes) - 1:
            out[m] = rest
        while take > 0 and m < len(takes) - 1:  # a draw beyond what a source has left is drawn anew among the others
            left = rest - out[m]
            got = np.minimum(rng.multinomial(take, left / left.sum()), left)
            out[m] += got
            take -= int(got.sum())
        rest = rest - out[m]
    return out


def shard_counts(wanted: list[int], n_shards: int, seed: int) -> np.ndarray:
    return draws(np.asarray(wanted, np.int64), even(int(sum(wanted)), n_shards), np.random.default_rng(seed))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed pseudorandom permutation of 0 .. n-1, by element.

    A four-round Feistel network permutes the least even number of bits that holds n; values that leave 0 .. n-1 walk on
    along their cycle until they return, which they must as the network is a permutation.
    """
    n = n.astype(np.int64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.int64) // 2).astype(U64)
    mask = (U64(1) << half) - U64(1)

    def network(x, half, mask, key):
        hi, lo = x >> half, x & mask
        for i in range(4):
            hi, lo = lo, hi ^ (mix(lo + key + U64(i * 0x51_7CC1)) & mask)
        return (hi << half) | lo

    out = network(index.astype(U64), half, mask, key)
    while len(away := np.flatnonzero(out >= n.astype(U64))):
        out[away] = network(out[away], half[away], mask[away], key[away])
    return out.astype(np.int64)


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def count_words(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Runs of bytes that are not white space, by text."""
    out = np.zeros(len(off) - 1, np.int64)
    for i, j in runs(off, 1 << 20):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        begins = ~_SPACE[part]
        inner = begins[:-1].copy()
        begins[1:] &= ~inner
        head = o[:-1][(o[1:] > o[:-1]) & (o[:-1] > 0)]
        begins[head] |= ~_SPACE[part[head]]
        out[i:j] = np.diff(np.concatenate([[0], np.cumsum(begins)])[o])
    return out


def sized(df: DataFrame, keep: list[str], text: str = "text", name: str = "size") -> DataFrame:
    """Columns `keep` of df and the number of words of its text."""
    source, at = with_text(df, keep, text)
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField(name, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in bites(batches, at):
            size = count_words(*binary_parts(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(size)], schema=arrow)

    return source.mapInArrow(run, schema)


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def packed(rows: DataFrame, rows_per_chunk: int) -> DataFrame:
    """Adds `start`, the words of the source before this row, and `uid`, unique within (source, chunk).

    A hot source is dealt to chunks by hash; rows add up within a chunk and chunks add up in a small table.
    """
    most = rows.groupBy("__key").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64("doc_id"), F.lit(max(16, -(-most // rows_per_chunk)))))
    before = Window.partitionBy("__key").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__key", "__chunk").agg(F.sum("size").alias("__sum"))
    offsets = offsets.select("__key", "__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__key", "__chunk").orderBy(F.col("doc_id").asc_nulls_first(), "size")
    run = rows.withColumn("uid", F.row_number().over(inside))
    run = run.withColumn("__own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return run.join(offsets, ["__key", "__chunk"]).withColumn("start", F.col("__before") + F.col("__own")).drop("__before", "__own")


def draw_slots(plan: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """All slots of the mix: source_ix, slot, out_shard, epoch, block."""
    spark = plan.sparkSession
    wanted = plan.where("n_slots > 0").select("source_ix", "n_blocks", "n_slots")
    n_sources = wanted.count()
    n_buckets = max(1, min(n_sources, max(LEAST_BUCKETS, min(MOST_BUCKETS, n_sources // BUCKET_SOURCES))))
    dealt = wanted.withColumn("bucket", F.col("source_ix") % n_buckets)
    totals = {r["bucket"]: r["n"] for r in dealt.groupBy("bucket").agg(F.sum("n_slots").alias("n")).collect()}
    names = sorted(totals)
    takes = dict(zip(names, shard_counts([totals[b] for b in names], n_shards, seed).T)) if names else {}

    def divide(key, tab):
        bucket = key[0].as_py()
        order = np.argsort(tab.column("source_ix").to_numpy())
        ix, blocks, slots = (tab.column(c).to_numpy()[order] for c in ("source_ix", "n_blocks", "n_slots"))
        counts = draws(slots, takes[bucket].tolist(), np.random.default_rng([seed, bucket]))
        first = np.cumsum(counts, axis=0) - counts
        m, s = np.nonzero(counts)
        return pa.table({"source_ix": pa.array(ix[s]), "n_blocks": pa.array(blocks[s]), "out_shard": pa.array(m), "first": pa.array(first[m, s]), "n": pa.array(counts[m, s])})

    ranges = dealt.groupBy("bucket").applyInArrow(divide, "source_ix long, n_blocks long, out_shard long, first long, n long")
    # a source's slots of one shard are many where it is hot: ranges of bounded length are dealt to tasks
    ranges = ranges.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(RANGE_SLOTS))))
    ranges = ranges.select("source_ix", "n_blocks", "out_shard", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(RANGE_SLOTS), F.col("n") - F.col("at")).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spelled(batches):
        for b in batches:
            ix, blocks, shard, first, n = (c.to_numpy() for c in b.columns)
            for i, j in runs(np.concatenate([[0], np.cumsum(n)]), 4 * RANGE_SLOTS):
                slot = index_ranges(first[i:j], n[i:j])
                src, n_blocks, out = (np.repeat(x[i:j], n[i:j]) for x in (ix, blocks, shard))
                epoch, index = slot // n_blocks, slot % n_blocks
                keys = mix(src.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed) + epoch.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
                block = permuted(index, n_blocks, keys)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (src, slot, out, epoch, block)], ["source_ix", "slot", "out_shard", "epoch", "block"])

    return ranges.repartition(parts, "source_ix", "out_shard", "first").mapInArrow(spelled, "source_ix long, slot long, out_shard long, epoch long, block long")


def mix_documents(docs: DataFrame, block_words: int = 128, n_shards: int = 64, seed: int = 20_240_601, rows_per_chunk: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed documents with start and uid, plan with a row per source, slots with out_shard, epoch and block)."""
    rows = docs.select("doc_id", _source_key(F.col("source")).alias("__key"), F.col("source").alias("__source"), "text")
    rows = checkpointed(salted(sized(rows, ["doc_id", "__key", "__source"]), "doc_id"))
    sums = with_targets(rows.groupBy("__key", "__source").agg(F.sum("size").alias("source_size"), salt_mask()))
    n = F.ceil(F.col("source_size") / block_words).cast("long")
    slots = F.least(F.lit(MAX_REPEATS) * n, F.bround(F.col("target") * n / F.col("source_size")).cast("long"))
    plan = sums.withColumn("n_blocks", n).withColumn("n_slots", F.when(F.col("source_size") > 0, slots).otherwise(0)).drop("__source")
    plan = checkpointed(plan)
    if plan.count() <= BROADCAST_SOURCES:
        parts = packed(rows, rows_per_chunk).join(F.broadcast(plan.drop("__mask")), "__key")
    else:
        parts = packed(rows, rows_per_chunk).join(by_salt(plan), ["__key", "__salt"])
    return parts.drop("__salt"), plan, draw_slots(plan, n_shards, seed)


def covered(parts: DataFrame, slots: DataFrame, block_words: int, by: list[str]) -> DataFrame:
    """Documents cut at block bounds and joined to how often each block is taken: one row per document and block."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = parts.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    cut = cut.withColumn("from_word", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")))
    cut = cut.withColumn("to_word", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")))
    uses = slots.groupBy("source_ix", "block", *by).agg(F.count("*").alias("uses"))
    # slots are spelled out of a small table, by which the optimiser would judge their size and broadcast them
    return cut.join(uses.hint("merge"), ["source_ix", "block"])


def mix_digest(docs: DataFrame, block_words: int = 128, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    parts, _, slots = mix_documents(docs, block_words, **options)
    row = ["doc_id", "source_ix", "__chunk", "uid", "size", "source_size", "target"]
    hits = covered(parts, slots, block_words, []).select(*row, ((F.col("to_word") - F.col("from_word")) * F.col("uses")).alias("taken"))
    out = hits.unionByName(parts.select(*row, F.lit(0).cast("long").alias("taken"))).groupBy(*row).agg(F.sum("taken").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, block_words: int = 128, **options) -> DataFrame:
    """The mix as documents: for each epoch the words taken of a document, in their order; columns as in `docs`.

    A document taken whole keeps its text; of one taken in part the blocks' words are joined by single spaces.  Rows that
    share doc_id and source share one packing per occurrence, so repeated rows stay repeated.
    """
    cols = docs.columns
    parts, _, slots = mix_documents(docs, block_words, **options)
    row = ["doc_id", "__key", "size", "uid", "epoch"]
    pieces = covered(parts, slots, block_words, ["epoch"]).groupBy(*row).agg(
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("__spans"), F.sum(F.col("to_word") - F.col("from_word")).alias("__got"),
    )
    same = Window.partitionBy("doc_id", "__key", "size")
    pieces = pieces.withColumn("__nth", F.dense_rank().over(same.orderBy("uid"))).drop("uid")
    # the text travels once, beside the other columns
    rest = F.struct(*[F.col(c) for c in cols if c != "text"])
    body = docs.select(rest.alias("b_row"), F.col("doc_id").alias("b_id"), _source_key(F.col("source")).alias("b_key"), F.col("text").alias("b_text"))
    body = sized(body, body.columns, "b_text", "b_size")
    body = body.withColumn("b_nth", F.row_number().over(Window.partitionBy("b_id", "b_key", "b_size").orderBy("b_text")))
    on = [F.col(x).eqNullSafe(F.col(y)) for x, y in (("b_id", "doc_id"), ("b_key", "__key"), ("b_size", "size"), ("b_nth", "__nth"))]
    both = body.join(pieces, on)
    whole = F.col("__got") == F.col("b_size")
    spans = F.when(~whole, F.flatten(F.transform("__spans", lambda s: F.array(s["from_word"], s["to_word"]))))
    given = both.select(*[(F.col("b_text") if c == "text" else F.col("b_row").getField(c)).alias(c) for c in cols], spans.alias("__cut"))
    schema, at = docs.schema, cols.index("text")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in bites(batches, at):
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(len(cols)).to_pylist()):
                if cut is not None:
                    words = _WORDS.findall(text)
                    text = " ".join(w for a, b in zip(cut[::2], cut[1::2]) for w in words[a:b])
                texts.append(text)
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c].cast(arrow.field(c).type) if c in new else batch.column(k) for k, c in enumerate(cols)], schema=arrow)

    return given.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))
