"""Operator 6 - near-duplicate documents by DartMinHash.

A document is the multiset of its shingles of five lower-cased words (all its words where there are fewer); similarity is
weighted Jaccard, the sum of least counts over the sum of greatest.  Every unit of weight of a shingle is a region into
which hashed darts fall as a Poisson stream over rank, the gaps being exponentials of hashes; a document throws the darts
of rank below t / weight, t = K ln K + 2 K, so that it meets about t of them whatever its weight.  Darts are hashed to K
coordinates and the earliest of each is kept; where a coordinate stays empty the ranks are doubled.  Equal signatures at a
coordinate have probability equal to the similarity.  ROWS coordinates make a band key; documents that share one are
candidates, and every reported link is verified on the shingles.

Documents with equal shingles are one class and signed once.  Within a band key the classes are linked to their least
member first; a key's members meet what is known of the key over salts.  Verified links make components; only band keys that
still hold several are looked at again: in small keys those pairs that the triangle inequality of the Jaccard distance to the
least member leaves open, in large keys the members outside the largest component, block by block, against all others.  A
task returns a forest of links, and only these few are settled again, as links between components.

Defined results: null texts and texts without words are classes of their own; very long texts are signed whole, a slice of
documents at a time; repeated rows fall in one class; the least doc_id of a component names it; a similarity of exactly 0.8
links; ties in rank cannot arise between different darts but by hash; a null doc_id links with nothing; an empty table stays
empty; doc_id and text alone are read, so columns of clashing names play no part, and `keep_one` passes all columns through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, binary_parts, by_salt, checkpointed, gram_hashes, index_ranges, lower_ascii, mix, runs, salt_mask, salted, table, word_hashes, word_spans
from .graph import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
SLICE_BYTES, SLICE_DOCS = 2 << 20, 4096
LOW_BITS = U64(52)
#: Keys of up to FEW members are compared pair by pair, larger ones in blocks of BLOCK members.
FEW, BLOCK = 32, 1024


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 52-bit shingle, count) in order of document and shingle; at most SLICE_DOCS documents."""
    low = lower_ascii(raw)
    s, e, first = word_spans(low, off)
    n = first[1:] - first[:-1]
    h = word_hashes(low, s, e) if len(s) else np.zeros(0, U64)
    full = np.flatnonzero(n >= WORDS)
    grams = gram_hashes(h, WORDS)
    at = index_ranges(first[full], n[full] - WORDS + 1)
    doc, value = np.repeat(full, n[full] - WORDS + 1), grams[at]
    for k in range(1, WORDS):
        short = np.flatnonzero(n == k)
        if len(short):
            g = gram_hashes(h, k)[first[short]]
            doc, value = np.concatenate([doc, short]), np.concatenate([value, g])
    both = np.sort((doc.astype(U64) << LOW_BITS) | (value >> U64(12)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(both)))
    both = both[at]
    return (both >> LOW_BITS).astype(np.int64), both & U64((1 << 52) - 1), count


def regions(doc: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, region hash) of every unit of weight."""
    copy = index_ranges(np.zeros(len(count), np.int64), count).astype(U64)
    return np.repeat(doc, count), mix(np.repeat(value, count) + copy * U64(0x9E3779B97F4A7C15))


def _throw(doc: np.ndarray, region: np.ndarray, until: np.ndarray, n_docs: int) -> np.ndarray:
    """The earliest dart of each coordinate, as rank bits and dart bits; all ones where none fell."""
    best = np.full(n_docs * K, ~U64(0), U64)
    rank, first, width = np.zeros(len(doc)), 0, 2
    while len(doc):
        n = np.arange(first, first + width, dtype=np.int64).astype(U64)
        h = mix(region[:, None] + (n * U64(0xD1B54A32D192ED03))[None, :])
        gap = -np.log(((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        ranks = np.cumsum(gap, axis=1) + rank[:, None]
        i, j = np.nonzero(ranks < until[doc][:, None])
        dart = mix(h[i, j] ^ U64(0xA0761D6478BD642F))
        packed = (ranks[i, j].astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (dart & U64(0xFFFFFFFF))
        np.minimum.at(best, doc[i] * K + ((dart >> U64(32)) % U64(K)).astype(np.int64), packed)
        rank = ranks[:, -1]
        on = rank < until[doc]
        doc, region, rank = doc[on], region[on], rank[on]
        first, width = first + width, 8 if first < 8 else 32
    return best.reshape(n_docs, K)


def signatures(doc: np.ndarray, region: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, K) signatures; rows without regions are all ones."""
    weight = np.bincount(doc, minlength=n_docs)
    until = DARTS / np.maximum(weight, 1)
    best = _throw(doc, region, until, n_docs)
    while True:
        empty = (best == ~U64(0)).any(1) & (weight > 0)
        if not empty.any():
            return best
        until = until * 2
        again = empty[doc]
        where = np.cumsum(empty) - 1
        best[empty] = _throw(where[doc[again]], region[again], until[empty], int(empty.sum()))


def _slices(off: np.ndarray):
    for i, j in runs(off, SLICE_BYTES):
        for a in range(i, j, SLICE_DOCS):
            yield a, min(j, a + SLICE_DOCS)


def contents(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each document's shingles and counts, whatever their order."""
    out = np.zeros((2, n), U64)
    one = mix(value * U64(0x9E3779B97F4A7C15) + count.astype(U64))
    np.add.at(out[0], doc, one)
    np.add.at(out[1], doc, mix(one + U64(0x1234567)))
    return out[0].view(np.int64), out[1].view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, weight, c1 and c2 (a 128-bit hash of the shingles and counts) and bands (null where there are no words)."""

    def run(batches):
        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            for i, j in _slices(off):
                n = j - i
                doc, value, count = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                c1, c2 = contents(doc, value, count, n)
                d, region = regions(doc, value, count)
                weight = np.bincount(d, minlength=n)
                best = signatures(d, region, n).reshape(n, BANDS, ROWS)
                key = np.tile(np.arange(BANDS, dtype=np.int64).astype(U64), (n, 1))
                for r in range(ROWS):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + best[:, :, r])
                bands = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(key.ravel().view(np.int64)), mask=pa.array(weight == 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(weight), pa.array(c1), pa.array(c2), bands],
                    ["doc_id", "weight", "c1", "c2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, weight long, c1 long, c2 long, bands array<long>"
    )


def region_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted region hashes as bytes."""

    def run(batches):
        for batch in batches:
            raw, off = binary_parts(batch.column(1))
            for i, j in _slices(off):
                doc, value, count = shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                c1, c2 = contents(doc, value, count, j - i)
                doc, region = regions(doc, value, count)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                blobs = [np.sort(region[a:b]).tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                cols = [batch.column(0).slice(i, j - i), pa.array(c1), pa.array(c2), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "c1", "c2", "regions"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, c1 long, c2 long, regions binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and the exact similarity of each pair."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("regions").alias("ra")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("regions").alias("rb")), "b").select("a", "b", "ra", "rb")

    def run(batches):
        for batch in batches:
            ra, oa = binary_parts(batch.column(2))
            rb, ob = binary_parts(batch.column(3))
            out = np.zeros(batch.num_rows)
            for k in range(batch.num_rows):
                x, y = ra[oa[k] : oa[k + 1]].tobytes(), rb[ob[k] : ob[k + 1]].tobytes()
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                z = np.sort(np.concatenate([x, y]), kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                out[k] = same / max(1, len(z) - same)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


def blockwise(members: DataFrame, sets: DataFrame, similarity: float, block: int | None = None) -> DataFrame:
    """Links a, b between components of one key (columns key, __salt, cid, comp): a forest of them, never all pairs.

    Only pairs of different components are open, so each has a member outside the key's largest component.  Those members
    are dealt to blocks, the others to blocks of their own, and a task gets one of the former with any one: members of the
    largest component are copied once for each block of outsiders, never for each other.  A task has exact intersections
    from products of its members' incidence matrix, whose columns are the regions that at least two members hold, a slice
    of columns at a time.
    """

    def run(key, tab):
        i, j = key[1].as_py(), key[2].as_py()
        at = np.array(tab.column("block").to_pylist())
        left = np.flatnonzero(at == i)
        right = left if i == j else np.flatnonzero(at == j)
        cid, comp = np.array(tab.column("cid").to_pylist(), np.int64), np.array(tab.column("comp").to_pylist(), np.int64)
        raw = [np.frombuffer(x, U64) for x in tab.column("regions").to_pylist()]
        size = np.array([len(x) for x in raw], np.int64)
        values, column, n = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(raw)), size)
        shared = np.cumsum(n > 1) - 1
        on = n[column] > 1
        row, column = row[on], shared[column[on]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        width = 2048
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            m = np.zeros((len(raw), width), np.float32)
            m[row[lo:hi], column[lo:hi] - a] = 1
            both += m[left] @ m[right].T
        alike = both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-6
        alike &= comp[left][:, None] != comp[right][None, :]
        up: dict[int, int] = {}

        def root(v: int) -> int:
            while up.setdefault(v, v) != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        edges = []
        for p, q in zip(*(z.tolist() for z in np.nonzero(alike))):
            p, q = left[p], right[q]
            x, y = root(int(comp[p])), root(int(comp[q]))
            if x != y:
                up[max(x, y)] = min(x, y)
                edges.append((int(cid[p]), int(cid[q])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    block = block or BLOCK
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("c"), salt_mask())
    main = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"), F.bit_or("__mask").alias("__mask"))
    outside = F.ceil((F.col("n") - F.col("top.c")) / block).cast("int")
    main = by_salt(main.select("key", F.col("top.comp").alias("main"), outside.alias("outside"), F.ceil(F.col("top.c") / block).cast("int").alias("inside"), "__mask"))
    df = members.join(main, ["key", "__salt"]).withColumn("hash", F.xxhash64("cid"))
    # outsiders are in blocks 0 .. outside - 1 and meet every block; the others come behind and meet those alone
    out = F.col("comp") != F.col("main")
    df = df.withColumn("block", F.when(out, F.pmod("hash", "outside")).otherwise(F.col("outside") + F.pmod("hash", "inside")).cast("int"))
    last = F.when(out, F.col("outside") + F.col("inside") - 1).otherwise(F.col("outside") - 1)
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    df = df.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "comp", "block")
    df = df.join(sets.withColumnRenamed("id", "cid"), "cid").select("key", "i", "j", "cid", "comp", "block", "regions")
    return df.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id, the least doc_id of its component, for every row with a doc_id.

    Rows with equal doc_id are one document; where their texts differ, the one with the least content hash stands for it.
    """
    rows = checkpointed(signed(docs.where(F.col("doc_id").isNotNull())))
    total, distinct = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
    one = rows
    if total > distinct:
        least = F.min(F.struct("c1", "c2", "weight", "bands")).alias("x")
        one = checkpointed(rows.groupBy("doc_id").agg(least).select("doc_id", "x.*"))
    worded = salted(one.where(F.col("bands").isNotNull()), "doc_id")  # a class may hold a large share of the rows
    classes = worded.groupBy("c1", "c2").agg(F.min("doc_id").alias("cid"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), salt_mask())
    classes = checkpointed(classes)
    member = salted(classes.select("cid", "weight", F.explode("bands").alias("key")), "cid")
    shared = by_salt(member.groupBy("key").agg(F.min(F.struct("cid", "weight")).alias("pivot"), F.count("*").alias("n"), salt_mask()).where("n > 1").drop("n"))
    met = member.join(shared, ["key", "__salt"])
    member = checkpointed(met.select("key", "__salt", "cid", "weight", F.col("pivot.cid").alias("pivot"), F.col("pivot.weight").alias("pivot_weight")))
    touched = member.select("cid").distinct()
    bodies = docs.select("doc_id", "text").join(touched, F.col("doc_id") == F.col("cid"), "left_semi")
    sets = region_sets(bodies)
    if total > distinct:
        own = classes.select(F.col("cid").alias("id"), "c1", "c2")
        sets = sets.join(own, ["id", "c1", "c2"], "left_semi").dropDuplicates(["id"])
    sets = checkpointed(sets.select("id", "regions"))

    def alike(x: str, y: str):
        return F.least(x, y) >= F.lit(similarity) * F.greatest(x, y)

    stars = member.where((F.col("cid") != F.col("pivot")) & alike("weight", "pivot_weight"))
    stars = checkpointed(verified(stars.select(F.col("cid").alias("a"), F.col("pivot").alias("b")).distinct(), sets))
    links = stars.where(F.col("similarity") >= similarity).select("a", "b")
    root = components(links)
    # Pairs that share a key but no component, unless the distances to the key's pivot rule them out.  A member whose
    # weight alone puts it out of the pivot's reach gets the bound that the weights give.
    far = member.join(stars.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), (1 - F.col("similarity")).alias("exact")), ["cid", "pivot"], "left")
    far = far.join(root.withColumnRenamed("node", "cid"), "cid", "left")
    far = far.select("key", "__salt", "cid", "weight", F.when(F.col("cid") == F.col("pivot"), 0.0).otherwise(F.col("exact")).alias("d"), F.coalesce("root", "cid").alias("comp"))
    mixed = far.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), salt_mask()).where("lo < hi")
    x = checkpointed(far.join(by_salt(mixed.select("key", "n", "__mask")), ["key", "__salt"]))
    few = x.where(F.col("n") <= FEW)
    y = few.select("key", F.col("cid").alias("other"), F.col("weight").alias("w2"), F.col("d").alias("d2"), F.col("comp").alias("comp2"))
    near = F.coalesce(F.abs(F.col("d") - F.col("d2")) <= 1 - similarity + 1e-9, F.lit(True))
    open_ = few.join(y, "key").where((F.col("cid") < F.col("other")) & (F.col("comp") != F.col("comp2")) & near & alike("weight", "w2"))
    open_ = open_.select(F.col("other").alias("a"), F.col("cid").alias("b")).distinct()
    # a pivot is the least member of its keys, so a pair that was verified has its pivot second
    open_ = open_.join(stars.select("a", "b"), ["a", "b"], "left_anti")
    more = verified(open_, sets).where(F.col("similarity") >= similarity).select("a", "b")
    many = x.where(F.col("n") > FEW).select("key", "__salt", "cid", "comp")
    more = checkpointed(more.unionByName(blockwise(many, sets, similarity)))
    # the new links join components: only these are settled again
    ends = root.select(F.col("node").alias("a"), F.col("root").alias("ra")), root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    again = components(more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    again = again.select(F.col("node").alias("comp"), F.col("root").alias("class"))
    by_class = classes.select("c1", "c2", "cid", "__mask").join(root, F.col("cid") == F.col("node"), "left").select("c1", "c2", "__mask", F.coalesce("root", "cid").alias("comp"))
    by_class = by_class.join(again, "comp", "left").select("c1", "c2", "__mask", F.coalesce("class", "comp").alias("class_id"))
    out = worded.select("doc_id", "c1", "c2", "__salt").join(by_salt(by_class), ["c1", "c2", "__salt"]).select("doc_id", "class_id")
    out = out.unionByName(one.where(F.col("bands").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))
    return out if total == distinct else rows.select("doc_id").join(out, "doc_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stand for their class; rows without a doc_id stay, and of repeated rows one stays."""
    kept = near_copies(docs, similarity).where("doc_id = class_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").limit(1).count()
    if again:
        named = named.dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
