"""Operator 2 - near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised; cosine >= SIMILARITY is then a distance of at most sqrt(2 - 2 SIMILARITY).  A table hashes a vector
to floor((a . v + b) / WIDTH) for several Gaussian directions a; vectors of one label that agree in all of a table's hashes
share a bucket and are compared exactly in double precision.  The number of hashes grows with the logarithm of the largest
label so that about BUCKET unrelated vectors of it share a bucket, and the number of tables is what bounds the chance that a
pair at the threshold meets in none by MISS.

Equal vectors of a label are one class with a multiplicity.  Vectors travel as they are stored (four bytes a component for
floats) and are normalised where they are compared.  Buckets beyond a block of BLOCK_BYTES are dealt to tasks as pairs of
blocks.  A pair counts in the first table where it meets, so the links of a vector add up without being listed; for the
components each task returns a forest, never more edges than members.

Defined results: vectors that are null, empty, zero, of a null label, or hold null or non-finite components link with
nothing; finite components of any size are compared, as a vector is first divided by its largest one; vectors of different
lengths never link; a null vec_id links with nothing; cosines at the threshold link; repeated rows are vectors of their own
and link with each other; labels are compared as text and may be of any length; an empty table gives an empty result; vec_id,
label and embedding alone are read, so columns of clashing names play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, binary_parts, by_salt, checkpointed, index_ranges, mix, salt_mask, salted, table
from .graph import components, settle

SIMILARITY, WIDTH, MISS = 0.93, 3.0, 1e-4
#: Unrelated vectors of a label that a bucket is meant to hold, and bytes (as doubles) of a block of a larger one.
BUCKET, BLOCK_BYTES = 256, 4 << 20
#: Buckets of up to SMALL vectors are compared pair by pair; a task's group has about GROUP_ROWS rows.
SMALL, GROUP_ROWS = 32, 20_000


def agreement(distance: float, width: float = WIDTH) -> float:
    """Chance that one hash agrees for two vectors at a distance."""
    c = width / distance
    normal = 0.5 * (1 + math.erf(-c / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(largest: int, similarity: float = SIMILARITY, miss: float = MISS) -> tuple[int, int]:
    """(hashes in a table, tables) for a label of `largest` different vectors."""
    near, far = agreement(math.sqrt(2 - 2 * similarity)), agreement(math.sqrt(2))  # far: at right angles
    n_hashes = max(4, round(math.log(max(1, largest / BUCKET)) / -math.log(far)))
    return n_hashes, math.ceil(math.log(miss) / math.log(1 - near**n_hashes))


def _keys(x: np.ndarray, n_hashes: int, n_tables: int, seed: int) -> np.ndarray:
    """(vectors, tables) bucket keys of normalised rows."""
    rng = np.random.RandomState(seed)
    a, b = rng.randn(x.shape[1], n_tables * n_hashes), rng.rand(n_tables * n_hashes) * WIDTH
    q = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(U64).reshape(len(x), n_tables, n_hashes)
    key = np.tile(np.arange(n_tables, dtype=np.int64).astype(U64), (len(x), 1))
    for j in range(n_hashes):
        key = mix(key * U64(0x9E3779B97F4A7C15) + q[:, :, j])
    return key


def _rows(col, stored: type) -> np.ndarray:
    """Normalised rows of doubles; all vectors of `col` have one length.  The largest component comes out first, so that
    no square overflows or vanishes."""
    raw, off = binary_parts(col)
    x = np.frombuffer(raw.tobytes(), stored).reshape(len(off) - 1, -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _same_length(col):
    """Positions of the rows of each length."""
    _, off = binary_parts(col)
    size = off[1:] - off[:-1]
    return [np.flatnonzero(size == s) for s in np.unique(size)]


def _to_bytes(classes: DataFrame) -> DataFrame:
    """Embeddings as the bytes of their stored components."""

    def run(batches):
        for batch in batches:
            rows = batch.column(2)
            off = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
            values = rows.values.to_numpy(zero_copy_only=False)
            out = [values[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), batch.column(3)], ["cid", "label", "unit", "mult"])

    return classes.select("cid", "label", "embedding", "mult").mapInArrow(run, "cid long, label string, unit binary, mult long")


def _bucketed(units: DataFrame, stored: type, n_hashes: int, n_tables: int, seed: int) -> DataFrame:
    """cid, table_no, key of each vector and table; the key also holds the label and the length."""

    def run(batches):
        for batch in batches:
            labels = np.array([hash_text(x) for x in batch.column(1).to_pylist()], U64)
            for at in _same_length(batch.column(2)):
                if not len(at):
                    continue
                x = _rows(batch.column(2).take(pa.array(at)), stored)
                key = mix(_keys(x, n_hashes, n_tables, seed) + labels[at][:, None] + U64(x.shape[1]))
                cid = np.repeat(batch.column(0).take(pa.array(at)).to_numpy(), n_tables)
                number = np.tile(np.arange(n_tables, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(number), pa.array(key.ravel().view(np.int64))], ["cid", "table_no", "key"])

    return units.select("cid", "label", "unit").mapInArrow(run, "cid long, table_no int, key long")


def hash_text(x: str) -> int:
    h = 0xCBF29CE484222325
    for c in x.encode():
        h = ((h ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _pairs_of(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs p < q of positions within each run of rows."""
    row = index_ranges(start, size)
    left = np.repeat(start + size, size) - row - 1  # rows of the run behind each row
    return np.repeat(row, left), index_ranges(row + 1, left)


def _alike(x: np.ndarray, start: np.ndarray, size: np.ndarray, split: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in one run whose cosine is high enough.

    `split` is the number of leading rows of a run that are compared with the others only (a pair of different blocks),
    or 0 where all rows are compared with each other.
    """
    out_p, out_q = [], []
    small = np.flatnonzero((size <= SMALL) & (split == 0))
    p, q = _pairs_of(start[small], size[small])
    for a in range(0, len(p), 20_000):
        i, j = p[a : a + 20_000], q[a : a + 20_000]
        on = np.einsum("ij,ij->i", x[i], x[j]) >= similarity
        out_p.append(i[on])
        out_q.append(j[on])
    for k in np.flatnonzero((size > SMALL) | (split > 0)).tolist():
        rows = np.arange(start[k], start[k] + size[k])
        left, right = (rows[: split[k]], rows[split[k] :]) if split[k] else (rows, rows)
        for a in range(0, len(left), 256):
            i, j = np.nonzero(x[left[a : a + 256]] @ x[right].T >= similarity)
            i, j = left[a + i], right[j]
            on = slice(None) if split[k] else i < j
            out_p.append(i[on])
            out_q.append(j[on])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_p or none), np.concatenate(out_q or none)


def _compared(members: DataFrame, stored: type, n_groups: int, n_hashes: int, n_tables: int, seed: int, similarity: float) -> DataFrame:
    """a, b, n: n links of class a (b null), or an edge of a forest (n = 0).

    Buckets and pairs of blocks are dealt to groups by hash, so that a task meets many small buckets at a time.
    """

    def run(key, tab):
        get = lambda name: tab.column(name).to_numpy()
        units = tab.column("unit").combine_chunks()
        links, us, vs = [], [], []
        for at in _same_length(units):
            number, bucket, i, j, cid, mult, block = (get(c)[at] for c in ("table_no", "key", "i", "j", "cid", "mult", "block"))
            order = np.lexsort((cid, block != i, j, i, bucket, number))
            number, bucket, i, j, cid, mult, block = (z[order] for z in (number, bucket, i, j, cid, mult, block))
            x = _rows(units.take(pa.array(at[order])), stored)
            new = np.ones(len(at), bool)
            new[1:] = (number[1:] != number[:-1]) | (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(at)))
            split = np.where(i[start] != j[start], np.add.reduceat(block == i, start), 0)
            none_left = (i[start] != j[start]) & (split == 0)
            start, size, split = start[~none_left], size[~none_left], split[~none_left]
            p, q = _alike(x, start, size, split, similarity)
            # a pair that met in an earlier table was counted there
            fresh = np.ones(len(p), bool)
            rows, where = np.unique(np.concatenate([p, q]), return_inverse=True)
            keys = _keys(x[rows], n_hashes, n_tables, seed)
            later = np.arange(n_tables)[None, :] >= number[p][:, None] if len(p) < 200_000 else None
            for a in range(0, len(p), 200_000):
                e = min(len(p), a + 200_000)
                after = later[a:e] if later is not None else np.arange(n_tables)[None, :] >= number[p[a:e]][:, None]
                same = keys[where[a:e]] == keys[where[len(p) + a : len(p) + e]]
                fresh[a:e] = ~(same & ~after).any(1)
            p, q = p[fresh], q[fresh]
            n = np.zeros(len(at), np.int64)
            np.add.at(n, p, mult[q])
            np.add.at(n, q, mult[p])
            some = np.flatnonzero(n)
            ids, inverse = np.unique(cid[some], return_inverse=True)
            links.append((ids, np.bincount(inverse, weights=n[some], minlength=len(ids)).astype(np.int64)))
            u, v = settle(cid[p], cid[q])
            us.append(u)
            vs.append(v)
        ids, n = (np.concatenate(z) for z in zip(*links))
        u, v = np.concatenate(us), np.concatenate(vs)
        b = pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(v, pa.int64())])
        return pa.table({"a": pa.array(np.concatenate([ids, u]), pa.int64()), "b": b, "n": pa.array(np.concatenate([n, np.zeros(len(u), np.int64)]))})

    dealt = members.withColumn("__group", F.pmod(F.xxhash64("key", "table_no", "i", "j"), F.lit(n_groups)))
    return dealt.groupBy("__group").applyInArrow(run, "a long, b long, n long")


def near_embeddings(df: DataFrame, similarity: float = SIMILARITY, seed: int = 17, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept.  `block` is the number of vectors in a block, by default what BLOCK_BYTES holds."""
    single = isinstance(df.schema["embedding"].dataType, T.ArrayType) and isinstance(df.schema["embedding"].dataType.elementType, T.FloatType)
    kind, stored = ("float", np.float32) if single else ("double", np.float64)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))
    rows = rows.withColumn("__fit", fit)
    code = F.sha2(F.concat_ws(",", F.col("label"), F.lit("|"), F.transform("embedding", lambda x: (x + F.lit(0.0).cast(kind)).cast("string"))), 256)
    good = salted(rows.where("__fit").withColumn("__code", code), "vec_id")  # a class may hold a large share of the rows
    classes = good.groupBy("__code").agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), salt_mask())
    # classes are numbered by hash, as one vec_id may stand for several vectors; a collision calls for another salt
    bare = checkpointed(classes.withColumnRenamed("cid", "least"))
    for salt in range(100):
        classes = bare.withColumn("cid", F.xxhash64("__code", F.lit(salt)))
        if classes.agg(F.count("*") - F.countDistinct("cid")).first()[0] == 0:
            break
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    n_hashes, n_tables = plan(largest, similarity)
    units = checkpointed(_to_bytes(classes))
    if block is None:
        widest = classes.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1
        block = min(8192, max(256, BLOCK_BYTES // (8 * widest)))
    met = _bucketed(units, stored, n_hashes, n_tables, seed)
    sizes = met.groupBy("key", "table_no").agg(F.count("*").alias("n")).where("n > 1")
    met = met.join(sizes, ["key", "table_no"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # a member of block x goes to the block pairs (i, x) and (x, j)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "table_no", "cid", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    members = met.join(units.select("cid", "unit", "mult"), "cid")
    n_groups = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() * n_tables // GROUP_ROWS))
    found = checkpointed(_compared(members, stored, n_groups, n_hashes, n_tables, seed, similarity))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    root = components(found.where("b IS NOT NULL"))
    by_class = classes.select("__code", "__mask", "cid", "least", "mult").join(links, "cid", "left").join(root, F.col("cid") == F.col("node"), "left")
    by_class = checkpointed(by_class.select("__code", "__mask", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    names = by_class.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = by_class.join(names, "root").select("__code", "__mask", "n_links", "component_id")
    linked = good.select("vec_id", "__code", "__salt").join(by_salt(by_class), ["__code", "__salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("__fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))
