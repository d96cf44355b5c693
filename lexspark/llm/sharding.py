"""Best-fit-decreasing sharding of indivisible groups."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked

#: Group sizes keep so many leading bits and are rounded up beyond, which bounds the size classes (about 2000 for each doubling) that the driver packs.
SIZE_BITS = 12


class CapacityTree:
    """Balanced search tree (treap) of remaining capacities; each node holds the bins that have just that much left."""

    def __init__(self):
        self.root = None

    def _merge(self, a, b):
        if not a or not b:
            return a or b
        if a[1] > b[1]:
            a[4] = self._merge(a[4], b)
            return a
        b[3] = self._merge(a, b[3])
        return b

    def _split(self, t, key):
        if not t:
            return None, None
        if t[0] < key:
            t[4], right = self._split(t[4], key)
            return t, right
        left, t[3] = self._split(t[3], key)
        return left, t

    def add(self, left: int, bin_: int) -> None:
        node = self.root
        while node and node[0] != left:
            node = node[3] if left < node[0] else node[4]
        if node:
            node[2].append(bin_)
            return
        low, high = self._split(self.root, left)
        new = [left, zlib.crc32(b"%d" % left), [bin_], None, None]
        self.root = self._merge(self._merge(low, new), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least capacity of at least size, taken out; None if there is none."""
        best, node = None, self.root
        while node:
            if node[0] >= size:
                best, node = node, node[3]
            else:
                node = node[4]
        if not best:
            return None
        out = best[0], best[2].pop()
        if not best[2]:
            low, rest = self._split(self.root, best[0])
            _, high = self._split(rest, best[0] + 1)
            self.root = self._merge(low, high)
        return out


def best_fit(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[dict[int, list[tuple[int, int]]], int] | None:
    """Best-fit-decreasing of (size, count) classes: size -> [(bin, how many)], and the number of bins; None beyond `most` bins.

    Items of one class go on entering the bin just chosen while they fit, as it stays the tightest; so a class is placed bin by bin and not item by item, with the same result.
    """
    tree, bins, out = CapacityTree(), 0, {}
    for size, count in sorted(classes, reverse=True):
        runs = out.setdefault(size, [])
        if size > capacity:
            return None
        while count:
            found = tree.take_tightest(size)
            if not found:
                if most is not None and bins >= most:
                    return None
                found, bins = (capacity, bins), bins + 1
            n = min(count, found[0] // size)
            runs.append((found[1], n))
            count -= n
            tree.add(found[0] - n * size, found[1])
    return out, bins


def balanced_fit(classes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """Best-fit-decreasing with the least capacity that needs no more than `shards` bins.

    A group above its fair share takes a shard of its own first, so it doesn't raise the capacity of the others.
    """
    left, free, out = dict(classes), shards, {}
    total = sum(s * c for s, c in left.items())
    own = 0
    while left and free > 1 and (big := max(left)) * free > total:
        out.setdefault(big, []).append((own, 1))
        own, free, total = own + 1, free - 1, total - big
        left[big] -= 1
        if not left[big]:
            del left[big]
    if not left:
        return out
    items = list(left.items())
    low = max(max(left), -(-total // free))
    high = low + max(left)
    best = best_fit(items, high, free)
    while best is None:
        high *= 2
        best = best_fit(items, high, free)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(items, middle, free)
        if tried:
            best, high = tried, middle
        else:
            low = middle + 1
    for size, runs in best[0].items():
        out.setdefault(size, []).extend((own + b, n) for b, n in runs)
    return out


def size_class(size):
    """The size rounded up to SIZE_BITS leading bits, as a column."""
    bits = F.length(F.bin(size))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), bits - SIZE_BITS)).cast("long")
    return (F.ceil(size / step) * step).cast("long")


def shard_groups(rows: DataFrame, key: list[str], size: str, shards: int) -> DataFrame:
    """rows with `shard`, 0 to shards - 1: all rows of a key share one, and shards get near equal sums of `size`.

    Rows of one key must have one size. The driver sees only the histogram of group sizes (bounded by SIZE_BITS); groups are ranked within their class, and the packing says which ranks go where. An empty table gives an empty result; null sizes count as 0.
    """
    rows = cut(rows.withColumn("_size", F.greatest(F.lit(1), F.coalesce(F.col(size), F.lit(0))).cast("long")))
    groups = rows.groupBy(*key).agg(F.sum("_size").alias("_bytes")).withColumn("_class", size_class(F.col("_bytes")))
    groups = cut(groups.drop("_bytes"))
    counts = [(r[0], r[1]) for r in groups.groupBy("_class").count().collect()]
    plan = []
    for s, runs in balanced_fit(counts, shards).items():
        ends, bins, end = [], [], 0
        for bin_, n in runs:
            end += n
            ends.append(end)
            bins.append(bin_)
        plan.append((s, ends, bins))
    spark = rows.sparkSession
    placed = spark.createDataFrame(plan, "_class long, _ends array<long>, _bins array<int>")
    found = ranked(groups, ["_class"], key, F.struct(*key), "_at").join(F.broadcast(placed), "_class")
    shard = F.expr("element_at(_bins, size(filter(_ends, e -> e <= _at)) + 1)").alias("shard")
    return rows.drop("_size").join(found.select(*key, shard), key)


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `slot`, gapless from 0 within each shard."""
    return ranked(rows, ["shard"], order, F.struct(*order), "slot")


def text_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents in shards of near equal bytes; equal texts share a shard (null and empty are equal). Other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    placed = cut(shard_groups(slim, ["_hash", "text_crc32", "size"], "size", shards))
    return with_slots(placed, ["_hash", "doc_id"]).drop("_hash")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = text_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
