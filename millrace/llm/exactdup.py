"""Operator 1 - removal of repeated byte strings by suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts earlier (smaller doc_id, or earlier in the same document)
is removed; strings are judged on the input and never cross documents.

Documents are dealt, in order of doc_id, to shards of about SHARD_BYTES.  A window of LENGTH bytes is represented by the
least hash of its GRAM-byte substrings; neighbouring windows with one least hash make a unit.  Equal windows have equal
least hashes, so:

1. each shard sends its distinct units (least hash, hash of the unit's bytes) to buckets by least hash;
2. a bucket merges the shards' sorted runs by binary search and tells each shard which of its units start earlier in
   another shard (all their windows are repeated) and which share a least hash with other units (open units);
3. a shard builds the suffix array of its parts whose least hash recurs in it (Larsson-Sadakane refinement) and the
   common prefixes (Kasai) and marks the windows repeated within it; it sends fingerprints of the other windows of open
   units to buckets;
4. those buckets merge the shards' sorted runs by binary search and return the windows that start in an earlier shard;
5. each shard cuts the covered bytes out of its documents.

A least hash with many units in a shard is common: its units go to buckets by their own hash and are taken for open, so no
bucket gathers all places of a common string.  Fingerprints have 96 bits or more beside the bytes compared in a shard.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH keep theirs; a very long text is a shard of its
own, read whole; rows with equal doc_id come in order of their texts, equal rows one after the other, each counting as earlier
than the next; a null doc_id is the smallest; an empty table gives an empty result; doc_id and text alone are read and only the
operator's columns returned, so columns of clashing names play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, BASE2, U64, index_ranges, mix, powers, prefix_sums, runs, slide_min, span_hash, table
from .suffix import repeated_windows

LENGTH, GRAM = 100, 40
SPAN = LENGTH - GRAM + 1  # grams in a window
SHARD_BYTES = 1_500_000
COMMON_UNITS = 16
BUCKET_BYTES = 16_000_000
SA_BYTES = 8_000_000
MARKER = U64(0)

_UNIT = np.dtype([("h", "<u8"), ("f", "<u8")])
_WINDOW = np.dtype([("a", "<u8"), ("b", "<u4"), ("at", "<u4")])


# ------------------------------------------------------------------------------------------------ one shard


class Shard:
    """The concatenated documents of a shard with their units."""

    def __init__(self, tab: pa.Table):
        ids, texts = tab.column("doc_id").to_pylist(), tab.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k] or b""))
        self.ids = [ids[k] for k in order]
        self.texts = [texts[k] or b"" for k in order]
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        self.raw = np.frombuffer(b"".join(self.texts), np.uint8)

    def split(self) -> None:
        """Units: first and last window, least hash and hash of the bytes.  Windows: positions with LENGTH bytes left."""
        # a text that stands earlier in the shard is repeated as a whole
        seen: dict[bytes, int] = {}
        self.copies = np.zeros(len(self.texts), bool)
        for k, t in enumerate(self.texts):
            if len(t) >= LENGTH:
                key = hashlib.sha256(t).digest()
                self.copies[k] = key in seen
                seen.setdefault(key, k)
        n_windows = np.where(self.copies, 0, np.maximum(0, self.off[1:] - self.off[:-1] - LENGTH + 1))
        self.valid = index_ranges(self.off[:-1], n_windows)
        empty = np.zeros(0, np.int64)
        self.first = self.last = empty
        self.h = self.f = np.zeros(0, U64)
        if not len(self.valid):
            return
        self.one, self.two = prefix_sums(self.raw, 7, BASE), prefix_sums(self.raw, 8, BASE2)
        # hash of the gram at i, brought back to position 0 by inverse powers
        inverse = powers(len(self.raw) + 1, pow(BASE, -1, 1 << 64))
        gram = (self.one[GRAM:] - self.one[:-GRAM]) * inverse[: len(self.raw) - GRAM + 1]
        gram ^= gram >> U64(32)
        gram *= U64(0x94D049BB133111EB)
        self.gram = gram
        least = slide_min(gram, SPAN)[self.valid]
        begins = np.ones(len(least), bool)
        begins[1:] = (least[1:] != least[:-1]) | (self.valid[1:] != self.valid[:-1] + 1)
        starts = np.flatnonzero(begins)
        size = np.diff(np.append(starts, len(least)))
        parts = -(-size // SPAN)  # periodic texts have one least hash for long: cut these runs
        starts = np.repeat(starts, parts) + index_ranges(np.zeros(len(parts), np.int64), parts) * SPAN
        ends = np.append(starts[1:], len(least)) - 1
        self.first, self.last = self.valid[starts], self.valid[ends]
        self.h = least[starts]
        self.f = span_hash(self.two, self.first, self.last + LENGTH, BASE2)

    def units(self) -> np.ndarray:
        """Distinct (h, f) of the shard, sorted."""
        u = np.empty(len(self.h), _UNIT)
        u["h"], u["f"] = self.h, self.f
        u = u[np.lexsort((u["f"], u["h"]))]
        new = np.ones(len(u), bool)
        new[1:] = (u["h"][1:] != u["h"][:-1]) | (u["f"][1:] != u["f"][:-1])
        return u[new]

    def inner(self) -> np.ndarray:
        """Windows, by place in `valid`, that also start earlier in the shard: by suffix arrays of the recurring parts."""
        order = np.argsort(self.h, kind="stable")
        h = self.h[order]
        twice = np.zeros(len(h), bool)
        twice[1:] = h[1:] == h[:-1]
        twice[:-1] |= twice[1:]
        # in periodic texts a least gram stands more than once within its own unit
        reach = self.last - self.first + SPAN
        places = np.add.reduceat(self.gram[index_ranges(self.first, reach)] == np.repeat(self.h, reach), np.cumsum(reach) - reach) if len(h) else reach
        units = np.union1d(order[twice], np.flatnonzero(places > 1))
        out = np.zeros(len(self.valid), bool)
        if not len(units):
            return out
        # neighbouring recurring units make a segment, which ends with the last window's bytes
        first, last = self.first[units], self.last[units]
        opens = np.ones(len(units), bool)
        opens[1:] = first[1:] != last[:-1] + 1
        begin = first[opens]
        end = last[np.append(np.flatnonzero(opens)[1:], len(units)) - 1] + LENGTH
        at = index_ranges(begin, end - begin)
        size = end - begin
        to = np.concatenate([[0], np.cumsum(size)])
        windows = index_ranges(to[:-1], size - LENGTH + 1)
        text = self.raw[at]
        if len(text) > 1 << 31:
            raise ValueError("a shard's recurring text must stay under 2 GiB")
        again = repeated_windows(text, windows, LENGTH)
        out[np.searchsorted(self.valid, at[windows[again]])] = True
        return out


def _column(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _blobs(records: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Records grouped by bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    names, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))
    return names, [records[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


def _bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % U64(n)).astype(np.int64)


ROW = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
ROW_SQL = "bucket long, shard long, kind int, blob binary"
UNITS, COMMON, WINDOWS, KNOWN = 0, 1, 2, 3


def _rows(bucket, shard, kind, blob) -> pa.Table:
    return pa.Table.from_arrays([_column(bucket), _column(shard), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], schema=ROW)


def _send_units(n_buckets: int):
    def run(key, tab):
        shard = Shard(tab)
        shard.split()
        u, number = shard.units(), key[0].as_py()
        if not len(u):
            return ROW.empty_table()
        names, at, n = np.unique(u["h"], return_index=True, return_counts=True)
        common = np.repeat(n > COMMON_UNITS, n)
        marks = np.zeros(int((n > COMMON_UNITS).sum()), _UNIT)
        marks["h"] = names[n > COMMON_UNITS]  # the bucket of the least hash learns that it is common
        plain = np.concatenate([u[~common], marks])
        b1, x1 = _blobs(plain, _bucket_of(plain["h"], n_buckets))
        b2, x2 = _blobs(u[common], _bucket_of(u["f"][common] ^ u["h"][common], n_buckets))
        return _rows([*b1, *b2], [number] * (len(b1) + len(b2)), [UNITS] * len(b1) + [COMMON] * len(b2), [*x1, *x2])

    return run


def _merge_units(key, tab):
    """For every shard its units that start in an earlier shard (UNITS), and its open ones (COMMON)."""
    shard = np.array(tab.column("shard").to_pylist(), np.int64)
    kind = np.array(tab.column("kind").to_pylist())
    blobs = [np.frombuffer(x, _UNIT) for x in tab.column("blob").to_pylist()]
    size = np.array([len(x) for x in blobs])
    u = np.concatenate(blobs)
    s, common = np.repeat(shard, size), np.repeat(kind == COMMON, size)
    order = np.lexsort((s, u["f"], u["h"]))
    u, s, common = u[order], s[order], common[order]
    mark = u["f"] == MARKER
    new_h = np.ones(len(u), bool)
    new_h[1:] = u["h"][1:] != u["h"][:-1]
    new_u = new_h.copy()
    new_u[1:] |= u["f"][1:] != u["f"][:-1]
    # the merged run of different units with their least shards, in which every entry finds its own by binary search
    by_f = np.lexsort((s, u["h"], u["f"]))
    merged, least = u[by_f], s[by_f]
    one = np.ones(len(u), bool)
    one[1:] = (merged["f"][1:] != merged["f"][:-1]) | (merged["h"][1:] != merged["h"][:-1])
    merged, least = merged[one], least[one]
    place = np.searchsorted(merged["f"], u["f"])
    while len(off := np.flatnonzero(~mark & (merged["h"][place] != u["h"]))):
        place[off] += 1
    earlier = ~mark & (s > least[place])
    h_at = np.cumsum(new_h) - 1
    n_units = np.bincount(h_at[new_u])
    lo = np.full(len(n_units), np.iinfo(np.int64).max)
    hi = np.full(len(n_units), -1)
    np.minimum.at(lo, h_at, s)
    np.maximum.at(hi, h_at, s)
    marked = np.zeros(len(n_units), bool)
    marked[h_at[mark]] = True
    several = (n_units > 1) & ((lo < hi) | marked)
    open_ = ~mark & ~earlier & (several[h_at] | common)
    out_s, out_k, out_b = [], [], []
    for kind, on in ((UNITS, earlier), (COMMON, open_)):
        names, found = _blobs(u["f"][on].copy(), s[on])
        out_s += names.tolist()
        out_k += [kind] * len(names)
        out_b += found
    return _rows([0] * len(out_s), out_s, out_k, out_b)


def _send_windows(n_buckets: int):
    def run(key, left, right):
        if left.num_rows == 0:
            return ROW.empty_table()
        shard, number = Shard(left), key[0].as_py()
        shard.split()
        told = {UNITS: [np.zeros(0, U64)], COMMON: [np.zeros(0, U64)]}
        for kind, blob in zip(right.column("kind").to_pylist(), right.column("blob").to_pylist()):
            told[kind].append(np.frombuffer(blob, U64))
        known, open_ = (np.isin(shard.f, np.concatenate(told[k])) for k in (UNITS, COMMON))
        again = shard.inner()
        size = shard.last - shard.first + 1
        again |= np.repeat(known, size)
        ask = np.repeat(open_, size) & ~again
        at = shard.valid[ask]
        w = np.empty(len(at), _WINDOW)
        names, blobs = [], []
        if len(at):
            w["a"] = span_hash(shard.two, at, at + LENGTH, BASE2)
            w["b"] = (span_hash(shard.one, at, at + LENGTH, BASE) >> U64(32)).astype(np.uint32)
            w["at"] = at
            w = w[np.lexsort((w["b"], w["a"]))]  # a sorted run for each bucket
            names, blobs = _blobs(w, _bucket_of(w["a"], n_buckets))
        # what is known already passes by as runs of windows
        at = shard.valid[again]
        opens = np.ones(len(at), bool)
        opens[1:] = at[1:] != at[:-1] + 1
        first = at[opens]
        last = at[np.append(np.flatnonzero(opens)[1:], len(at)) - 1] if len(at) else at
        whole = np.flatnonzero(shard.copies)
        first = np.concatenate([first, shard.off[whole]]).astype("<u4")
        last = np.concatenate([last, shard.off[whole + 1] - LENGTH]).astype("<u4")
        mine = np.stack([first, last], 1).tobytes()
        n = len(names)
        return _rows([*names, -1 - number], [number] * (n + 1), [WINDOWS] * n + [KNOWN], [*blobs, mine])

    return run


def _merge_windows(key, tab):
    """Windows that also start in an earlier shard, for their shards; what is known passes through."""
    if key[0].as_py() < 0:
        return tab.select(ROW.names).cast(ROW)
    shard = tab.column("shard").to_pylist()
    runs = [np.frombuffer(x, _WINDOW) for x in tab.column("blob").to_pylist()]
    merged = np.concatenate(runs)
    owner = np.repeat(np.array(shard, np.int64), [len(x) for x in runs])
    order = np.lexsort((owner, merged["b"], merged["a"]))
    merged, owner = merged[order], owner[order]
    new = np.ones(len(merged), bool)
    new[1:] = (merged["a"][1:] != merged["a"][:-1]) | (merged["b"][1:] != merged["b"][:-1])
    merged, owner = merged[new], owner[new]  # least shard of every window
    out: dict[int, list[bytes]] = {}
    for s, run in zip(shard, runs):
        place = np.searchsorted(merged["a"], run["a"])
        while len(off := np.flatnonzero(merged["b"][place] != run["b"])):  # equal first hashes stand together
            place[off] += 1
        found = run["at"][owner[place] < s]
        if len(found):
            out.setdefault(s, []).append(found.tobytes())
    names = list(out)
    return _rows([0] * len(names), names, [WINDOWS] * len(names), [b"".join(out[s]) for s in names])


def _cut(texts: bool):
    def run(key, left, right):
        if left.num_rows == 0:
            return RESULT.empty_table()
        shard = Shard(left)
        edge = np.zeros(len(shard.raw) + 1, np.int64)
        for kind, blob in zip(right.column("kind").to_pylist(), right.column("blob").to_pylist()):
            if kind == KNOWN:
                both = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
                np.add.at(edge, both[:, 0], 1)
                np.add.at(edge, both[:, 1] + LENGTH, -1)
            else:
                at = np.frombuffer(blob, "<u4").astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + LENGTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        heads = shard.off[:-1][shard.off[:-1] < len(gone)]
        opens[heads] = gone[heads]
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[shard.off])
        spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[shard.off])
        kept = []
        for a, b, r, t in zip(shard.off[:-1].tolist(), shard.off[1:].tolist(), removed.tolist(), shard.texts):
            kept.append(shard.raw[a:b][~gone[a:b]].tobytes() if r else t)
        digest = [hashlib.sha256(x).hexdigest() for x in kept]
        return pa.Table.from_arrays(
            [pa.array(shard.ids, pa.int64()), _column(np.diff(shard.off)), _column(removed), _column(spans), pa.array(digest), pa.array(kept if texts else [None] * len(kept), pa.binary())],
            schema=RESULT,
        )

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


# ------------------------------------------------------------------------------------------------ all shards


_PIECE = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("rows", pa.int64())])
PREFIX = 3
#: Pieces of 24 bytes that the driver is told of at most, whatever the table's size.
MOST_PIECES = 1_000_000


def _pieces(limit: int, most: int):
    """From rows in order of doc_id: first id, bytes and rows of pieces of at most `limit` bytes.  A larger id stands alone.

    A partition of more than `most` pieces joins neighbours, so that it tells of fewer and larger ones.
    """

    def cut(held: np.ndarray, limit: int) -> np.ndarray:
        off = np.concatenate([[0], np.cumsum(held[:, 1])])
        starts = [i for i, _ in runs(off, limit)]
        return np.stack([held[starts, 0], np.add.reduceat(held[:, 1], starts), np.add.reduceat(held[:, 2], starts)], 1)

    def run(batches):
        none, last = np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)  # the last id may go on in the next batch
        nulls, n_nulls, out, now = 0, 0, none, limit
        for batch in batches:
            ids, size = batch.column(0), batch.column(1).to_numpy()
            k = ids.null_count  # they come first
            nulls, n_nulls = nulls + int(size[:k].sum()), n_nulls + k
            ids = ids.slice(k).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(ids):
                continue
            held = np.concatenate([last, np.stack([ids, size[k:], np.ones_like(ids)], 1)])
            begins = np.flatnonzero(np.append(True, held[1:, 0] != held[:-1, 0]))
            held = np.stack([held[begins, 0], np.add.reduceat(held[:, 1], begins), np.add.reduceat(held[:, 2], begins)], 1)
            last = held[-1:]
            if len(held) > 1:
                out = np.concatenate([out, cut(held[:-1], now)])
            while len(out) > most:
                now *= 2
                out = cut(out, now) if len(out) < 4 * most else cut(out, now * 4)
        out = np.concatenate([out, last])
        columns = [_column([*([None] if n_nulls else []), *out[:, 0].tolist()]), _column([*([nulls] if n_nulls else []), *out[:, 1].tolist()]), _column([*([n_nulls] if n_nulls else []), *out[:, 2].tolist()])]
        yield pa.RecordBatch.from_arrays(columns, schema=_PIECE)

    return run


def sharded(docs: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """(shard, doc_id, text as bytes; total bytes).  Shards follow doc_id, then text, and hold `shard_bytes` or one larger row.

    Shards are cut by the bytes that stand before an id in sorted order, wherever the ids lie.  The driver sees pieces of a
    quarter of a shard, or larger ones where MOST_PIECES would not do.  A piece, an id or the null id of over 2 * shard_bytes
    in several rows is cut by the bytes that stand before each row in order of ids and texts: sums by id and by the texts'
    first PREFIX bytes, then a running sum within each of these.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    most = max(1, MOST_PIECES // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_order = df.select("doc_id", size.alias("n")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    got = in_order.mapInArrow(_pieces(max(1, shard_bytes // 4), most), "first long, n long, rows long").toArrow().sort_by("first")
    first, n, rows = (got.column(c).combine_chunks() for c in ("first", "n", "rows"))
    null = first.is_null().to_numpy(zero_copy_only=False)
    first, n, rows = first.fill_null(0).to_numpy(), n.to_numpy(), rows.to_numpy()
    off = np.concatenate([[0], np.cumsum(n[~null])]).astype(np.int64)
    starts = np.array([i for i, _ in runs(off, shard_bytes)], np.int64)
    ends = np.append(starts[1:], len(off) - 1)[: len(starts)]
    # slot 0 is the null id's
    held = np.concatenate([[n[null].sum()], off[ends] - off[starts]]).astype(np.int64)
    several = np.concatenate([[True], (ends == starts + 1) & (rows[~null][starts] > 1)])
    split = several & (held > 2 * shard_bytes)
    number = np.concatenate([[0], np.cumsum(np.where(split, held // shard_bytes + 1, 1))[:-1]])
    code, opening = np.where(split, -1 - number, number), first[~null][starts]

    def place(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(opening, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(code[np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, at)], pa.int64())

    placed = df.withColumn("shard", F.arrow_udf(place, "long")("doc_id"))
    if not split.any():
        return placed.select("shard", "doc_id", "text"), int(n.sum())
    prefix = F.coalesce(F.substring("text", 1, PREFIX), F.lit(b""))
    # null ids have a slot of their own, so 0 stands for none but them there
    big = placed.where("shard < 0").select((-1 - F.col("shard")).alias("base"), F.coalesce("doc_id", F.lit(0)).alias("id"), prefix.alias("prefix"), "doc_id", "text", size.alias("n"))
    sums = big.groupBy("base", "id", "prefix").agg(F.sum("n").alias("own"))
    before = sums.select("base", "id", "prefix", (F.sum("own").over(Window.partitionBy("base").orderBy("id", "prefix")) - F.col("own")).alias("before"))
    here = F.sum("n").over(Window.partitionBy("base", "id", "prefix").orderBy("text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    big = big.withColumn("here", here).join(before, ["base", "id", "prefix"])
    shard = F.col("base") + F.floor((F.col("before") + F.col("here")) / F.lit(shard_bytes)).cast("long")
    return placed.where("shard >= 0").select("shard", "doc_id", "text").unionByName(big.select(shard.alias("shard"), "doc_id", "text")), int(n.sum())


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `texts`, the kept bytes of every document."""
    df, total = sharded(docs, shard_bytes)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(4 * least, -(-total // BUCKET_BYTES))
    units = df.groupBy("shard").applyInArrow(_send_units(n_buckets), ROW_SQL)
    told = units.groupBy("bucket").applyInArrow(_merge_units, ROW_SQL)
    asked = df.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_send_windows(n_buckets), ROW_SQL)
    found = asked.groupBy("bucket").applyInArrow(_merge_windows, ROW_SQL)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return df.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(_cut(texts), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
