"""Sharding by best-fit-decreasing bin packing (operator 2).

Indivisible groups (equal texts) are sorted by size and each enters the bin with the tightest remaining capacity, found in a
balanced tree of remaining capacities. For a given number of shards the capacity is the least one found, from the mean size on,
at which no further bin opens. The driver packs the histogram of group sizes, not the groups: of a run of equal groups the
tightest bin takes as many as it has room for, which is what placing them one by one gives. There are at most sqrt(2 * bytes)
different sizes, whatever the number of documents. Groups of a size are then numbered, and intervals of numbers go to bins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, part_rows, ranked, table

SHARDS = 8
#: Most intervals that are broadcast; beyond, the join shuffles.
MOST_PLACES = 1_000_000


@dataclass
class _Node:
    key: tuple[int, int]
    left: _Node | None = None
    right: _Node | None = None
    height: int = 1


class CapacityTree:
    """AVL tree of (remaining capacity, bin): insert, remove and tightest fit in logarithmic time."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _h(n: _Node | None) -> int:
        return n.height if n else 0

    def _fix(self, n: _Node) -> _Node:
        tilt = self._h(n.left) - self._h(n.right)
        if tilt > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn(n.left, "right", "left")
            n = self._turn(n, "left", "right")
        elif tilt < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn(n.right, "left", "right")
            n = self._turn(n, "right", "left")
        else:
            n.height = 1 + max(self._h(n.left), self._h(n.right))
        return n

    def _turn(self, n: _Node, up: str, down: str) -> _Node:
        top = getattr(n, up)
        setattr(n, up, getattr(top, down))
        setattr(top, down, n)
        for x in (n, top):
            x.height = 1 + max(self._h(x.left), self._h(x.right))
        return top

    def insert(self, key: tuple[int, int]) -> None:
        def put(n):
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._fix(n)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def drop(n, key):
            if key < n.key:
                n.left = drop(n.left, key)
            elif key > n.key:
                n.right = drop(n.right, key)
            elif n.left and n.right:
                least = n.right
                while least.left:
                    least = least.left
                n.key = least.key
                n.right = drop(n.right, least.key)
            else:
                return n.left or n.right
            return self._fix(n)

        self.root = drop(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        n, best = self.root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_counts(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """(size, first, end, bin): which of the groups of each (size, how many), largest size first, go to which bin; None if more than
    `most` bins would open."""
    tree, bins, held, out = CapacityTree(), 0, None, []  # held: the bin that was filled last, outside the tree
    for size, count in sizes:
        at = 0
        while at < count:
            found = tree.tightest(size)
            if not (held and held[0] >= size and (found is None or held < found)):
                if found is None:
                    if bins == most or size > capacity:
                        return None
                    fresh = (capacity, bins)
                    bins += 1
                else:
                    fresh = found
                    tree.remove(found)
                if held:
                    tree.insert(held)
                held = fresh
            n = min(count - at, held[0] // size)
            out.append((size, at, at + n, held[1]))
            held = (held[0] - n * size, held[1])
            at += n
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size in the given order of sizes; None if more than `most` bins would open. Ties go by position."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    got = best_fit_counts(sorted(Counter(sizes).items(), reverse=True), capacity, most)
    if got is None:
        return None
    out = [0] * len(sizes)
    for i, b in zip(order, (b for _, first, end, b in got for _ in range(end - first))):
        out[i] = b
    return out


def into_shards(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing of (size, how many) with the least capacity found, by halving, at which `shards` bins hold all."""
    sizes = sorted(sizes, reverse=True)
    if not sizes:
        return []
    largest = sizes[0][0]
    low = max(-(-sum(s * n for s, n in sizes) // shards), largest)
    best = best_fit_counts(sizes, low, shards)
    if best is not None:
        return best
    high = low + largest  # at this much room no size finds all bins too full
    best = best_fit_counts(sizes, high, shards)
    while high - low > max(1, low // 100_000):
        mid = (low + high) // 2
        got = best_fit_counts(sizes, mid, shards)
        if got is None:
            low = mid
        else:
            best, high = got, mid
    return best


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near equal bytes, equal texts together.

    size is the UTF-8 bytes of the text plus 1; a null text has none and groups with the empty text. law is `bytes`. slot is
    gapless from 0 within a shard, in no promised order. Where one group is larger than the mean shard it makes its shard
    larger, as groups are not divided. Very long texts count by their bytes only. Repeated rows and null doc_ids are kept as
    rows; extra columns go; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    raw = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("text_key"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("text_key").agg(F.sum("size").alias("group_size")), "groups")
    sizes = [tuple(r) for r in groups.groupBy("group_size").agg(F.count("*")).collect()]  # at most sqrt(2 * bytes)
    places = into_shards(sizes, shards)
    n_places = len(places)
    places = spark.createDataFrame(places, "group_size long, first long, end long, shard int")
    numbered = ranked(groups, ["group_size"], ["text_key"], sum(n for _, n in sizes))
    placed = numbered.join(F.broadcast(places) if n_places <= MOST_PLACES else places, "group_size").where("first <= rank and rank < end")
    placed = materialize(placed.select("text_key", "shard"), "placed")
    rows = rows.join(placed, "text_key").select("doc_id", "size", "text_crc32", "shard")
    rows = materialize(rows, "items")
    discard(groups), discard(placed)
    return slots(rows, part_rows(rows.count())).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def slots(rows: DataFrame, chunks: int) -> DataFrame:
    """rows with `slot`: gapless from 0 in each shard. A shard is numbered in chunks by hash of doc_id, with offsets from counts."""
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks)))
    counts = rows.groupBy("shard", "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    spot = Window.partitionBy("shard", "_chunk").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("_spot", F.row_number().over(spot) - 1)
    return rows.join(base, ["shard", "_chunk"]).withColumn("slot", (F.col("_base") + F.col("_spot")).cast("long"))


def op2_bfd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
