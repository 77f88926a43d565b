"""Sharding by a hierarchical weighted hash tree.

A key descends regions, racks and shards. At each level every child draws -ln(u) / weight, with u
hashed from key and child, and the least draw wins; a child's weight is the sum of those below it.
Draws of children whose weights stay are unchanged, so a reweighted shard moves keys only into or out
of the subtrees above it. A new shard opens a region of its own: no other weight changes, and keys move
into the new shard only (law "key"). All of it is column arithmetic; nothing is shuffled but the few
columns that number the rows of a shard.

Defined results: a null text has size 1 and the checksum of no bytes. A null doc_id is a key like any
other; repeated rows go to the same shard under slots of their own. Slots follow doc_id within parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelark.llm.common import materialise

#: Rows of a shard are numbered in this many parts side by side.
PARTS = 256


@dataclass(frozen=True)
class HashTree:
    """regions[r][k] maps shard numbers to weights for rack k of region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> HashTree:
        """Shards 0 to regions * racks * shards - 1 of weight 1."""
        number = iter(range(regions * racks * shards))
        return HashTree(tuple(tuple(tuple((next(number), 1.0) for _ in range(shards)) for _ in range(racks)) for _ in range(regions)))

    def count(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def with_shard(self, weight: float = 1.0) -> HashTree:
        """One more shard, in a new region."""
        return HashTree((*self.regions, ((((self.count()), weight),),)))

    def reweighted(self, shard: int, weight: float) -> HashTree:
        return HashTree(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    def shard_of(self, *key: Column) -> Column:
        """The shard of a key."""

        def weight(node: tuple) -> float:
            return float(node[1]) if isinstance(node[0], int) else sum(map(weight, node))

        def children(nodes: tuple, level: int, path: str) -> Column:
            ids = [n[0] if level == 2 else i for i, n in enumerate(nodes)]
            return F.array(*(F.struct(F.lit(f"{level}:{path}{i}").alias("name"), F.lit(weight(n)).alias("w"), F.lit(i).alias("id")) for i, n in zip(ids, nodes)))

        def winner(nodes: Column) -> Column:
            def draw(c: Column) -> Column:
                u = (F.shiftrightunsigned(F.xxhash64(*key, c["name"]), 11).cast("double") + 0.5) / float(1 << 53)
                return F.struct((-F.log(u) / c["w"]).alias("draw"), c["id"].alias("id"))

            return F.array_min(F.transform(F.filter(nodes, lambda c: c["w"] > 0), draw))["id"]

        region = winner(children(self.regions, 0, ""))
        rack = winner(F.get(F.array(*(children(r, 1, f"{i}.") for i, r in enumerate(self.regions))), region))
        racks = F.array(*(F.array(*(children(k, 2, "") for k in r)) for r in self.regions))
        return winner(F.get(F.get(racks, region), rack))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with slot: their gapless number from 0 within group, for a group of few values, each of any size.

    Parts of a group are numbered side by side and shifted by the sizes of the parts before; the sizes,
    one per group value and part, are broadcast.
    """
    rows = materialise(rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int")))
    sizes = rows.groupBy(group, "part").count()
    before = sizes.withColumn("before", F.sum("count").over(Window.partitionBy(group).orderBy("part")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(F.broadcast(before), [group, "part"]).withColumn("slot", F.col("before") + F.col("own")).drop("before", "own", "part")


def sharded(docs: DataFrame, tree: HashTree) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree.shard_of(F.col("doc_id")).alias("shard"),
        tree.with_shard().shard_of(F.col("doc_id")).alias("grown_shard"),
    )
    return numbered(rows, "shard", "doc_id", "size", "text_crc32")
