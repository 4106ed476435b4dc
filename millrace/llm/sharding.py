"""Operator 10 - sharding by a hierarchical weighted hash tree.  DataFrame functions only.

A topology is a tree region -> rack -> shard; a node weighs what its shards weigh.  A row descends it level by level: of a
node's children the one with the least -ln(u) / weight is taken, u being a hash of the row's key and the child's path, so a
child is taken with probability weight / total.  A row meets one draw per region, per rack of its region and per shard of its
rack - nine for 24 shards - and the draws of other subtrees are never made.

A changed weight alters the draws of the nodes above it and no others.  Among a node's children rows therefore move only into
or out of the one whose weight changed: a heavier shard 5 draws rows from other regions into its region, from other racks
there into its rack and from other shards there into itself, and no row moves between two nodes whose weights stayed.  The
25th shard opens a region of its own, so growth from 24 moves rows into it alone.  A 26th shard makes that region heavier:
rows move into the region, where they meet shards 24 and 25, and within it from 24 to 25; the first two regions only give.

Defined results: a null key hashes as a value of its own; null texts weigh 8 bytes, empty ones too; very long texts are
hashed as any; rows equal in key get one shard and, where they are equal in all the digest holds, any of their slots; an
empty table gives an empty result; `shard_documents` returns the digest alone and reads no other column, so columns of
clashing names play no part; `assign` and `slots` replace a column of the name they are asked to add and refuse names that
begin with two underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, n_bytes, table

SHARDS_PER_RACK, RACKS_PER_REGION = 4, 3


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards 0..n-1 in racks of four and regions of three racks; ids and places never change as the tree grows."""
    weights = weights or {}
    if n_shards < 1 or any(w <= 0 for w in weights.values()):
        raise ValueError("at least one shard and positive weights are needed")
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    return [Leaf(s // per_region, s // SHARDS_PER_RACK, s, weights.get(s, 1.0)) for s in range(n_shards)]


class Tree:
    """Children of the root, of each region and of each rack, as (id, weight)."""

    def __init__(self, leaves: list[Leaf]):
        regions: dict[int, dict[int, list[Leaf]]] = {}
        for x in leaves:
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
        total = lambda part: sum(x.weight for x in part)
        self.regions = [(r, sum(total(p) for p in racks.values())) for r, racks in regions.items()]
        self.racks = {r: [(k, total(p)) for k, p in racks.items()] for r, racks in regions.items()}
        self.shards = {k: [(x.shard, x.weight) for x in p] for racks in regions.values() for k, p in racks.items()}


def _bits(*texts: Column) -> Column:
    """52 bits of a hash of the texts, joined by slashes, which SQL engines compute alike."""
    joined = F.concat_ws("/", *[F.coalesce(t.cast("string"), F.lit("null")) for t in texts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("long")


def _arrival(key: Column, path: Column, weight: Column) -> Column:
    u = (_bits(key, path).cast("double") + F.lit(0.5)) * F.lit(2.0**-52)  # in (0, 1)
    return -F.log(u) / weight


def _nodes(children: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in children])


def _taken(key: Column, parent: Column | None, children: Column) -> Column:
    """Id of the child with the least arrival; `parent` is the path of the node they hang on."""

    def draw(x: Column) -> Column:
        path = x["id"].cast("string") if parent is None else F.concat_ws("/", parent, x["id"].cast("string"))
        return F.struct(_arrival(key, path, x["weight"]).alias("t"), x["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def _below(children: dict[int, list[tuple[int, float]]], node: Column) -> Column:
    """The children of the node of an id, by a lookup in a constant map."""
    pairs = [x for i, c in children.items() for x in (F.lit(i), _nodes(c))]
    return F.element_at(F.create_map(*pairs), node)


def _descended(df: DataFrame, key: Column, tree: Tree, region: Column, out: str) -> DataFrame:
    """Adds `out`, struct(region, rack, shard), for rows whose region is drawn already."""
    df = df.withColumn("__region", region)
    df = df.withColumn("__rack", _taken(key, F.col("__region").cast("string"), _below(tree.racks, F.col("__region"))))
    path = F.concat_ws("/", F.col("__region").cast("string"), F.col("__rack").cast("string"))
    df = df.withColumn("__shard", _taken(key, path, _below(tree.shards, F.col("__rack"))))
    named = F.struct(F.col("__region").alias("region"), F.col("__rack").alias("rack"), F.col("__shard").alias("shard"))
    return df.withColumn(out, named).drop("__region", "__rack", "__shard")


def assign(df: DataFrame, key: str, n_shards: int, out: str = "shard", weights: dict[int, float] | None = None, grown: str | None = None) -> DataFrame:
    """Adds the shard of each row, and with `grown` the shard it would have in a tree of one more shard."""
    if any(c.startswith("__") for c in df.columns):
        raise ValueError("names that begin with two underscores are the operator's own")
    k, tree = F.col(f"`{key}`"), Tree(topology(n_shards, weights))
    df = _descended(df, k, tree, _taken(k, None, _nodes(tree.regions)), "__place")
    if not grown:
        return df.withColumn(out, F.col("__place.shard")).drop("__place")
    more = Tree(topology(n_shards + 1, weights))
    df = df.withColumn("__then", _taken(k, None, _nodes(more.regions)))
    # a row whose region stays and has no changed node below keeps its place; only the others descend anew
    same = [r for r, racks in tree.racks.items() if more.racks[r] == racks and all(more.shards[x] == tree.shards[x] for x, _ in racks)]
    stays = (F.col("__then") == F.col("__place.region")) & F.col("__then").isin(same)
    rack = F.when(~stays, _taken(k, F.col("__then").cast("string"), _below(more.racks, F.col("__then"))))
    df = df.withColumn("__rack", rack)
    path = F.concat_ws("/", F.col("__then").cast("string"), F.col("__rack").cast("string"))
    moved = F.when(F.col("__rack").isNotNull(), _taken(k, path, _below(more.shards, F.col("__rack"))))
    df = df.withColumn("__grown", F.coalesce(moved, F.col("__place.shard")))
    return df.withColumn(out, F.col("__place.shard")).withColumn(grown, F.col("__grown")).drop("__place", "__then", "__rack", "__grown")


def slots(df: DataFrame, shard: str, order: list[str], rows_per_chunk: int = 50_000, out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard.

    A shard's rows are dealt to chunks by hash, numbered within the chunk, and shifted by the rows of earlier chunks, so
    no task sees a whole shard.  Chunks grow with the table.  Ties in `order` are rows that do not differ in the result.
    `df` is read three times: callers checkpoint what was costly to make.
    """
    sizes = df.groupBy(shard).agg(F.count("*").alias("__n")).agg(F.max("__n").alias("n")).first()
    n_chunks = max(16, -(-(sizes["n"] or 0) // rows_per_chunk))
    df = df.withColumn("__chunk", F.pmod(_bits(*[F.col(c) for c in order]), F.lit(n_chunks)))
    before = Window.partitionBy(shard).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(shard, "__chunk").agg(F.count("*").alias("__n"))
    offsets = offsets.select(shard, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(shard, "__chunk").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = df.withColumn("__rank", F.row_number().over(inside).cast("long"))
    return numbered.join(offsets, [shard, "__chunk"]).withColumn(out, F.col("__before") + F.col("__rank") - 1).drop("__chunk", "__rank", "__before")


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Digest rows: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(
        F.col("doc_id"), (n_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
    )
    placed = checkpointed(assign(rows, "doc_id", n_shards, grown="grown_shard"))  # a few dozen bytes a row
    out = slots(placed, "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
